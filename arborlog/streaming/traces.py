"""The trace operators on streams.

A stream of actions keeps, for each attempt, the time of its last action and what has been added up so far. Actions that come after the
watermark has passed them are dropped, which a batch over the whole log doesn't do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.trace import IDLE_AFTER, SEGMENT_GAP

STATE = "last long, active long, idle long, segments long"
PROFILE = "attempt long, active long, idle long, segments long, last long"


def time_profile(events: DataFrame, delay: str = "10 minutes", forget: int = 30 * 86400) -> DataFrame:
    """After each micro-batch, the profile so far of the attempts it touched: (attempt, active, idle, segments, last).

    An attempt's state goes ``forget`` seconds after its last action, once the watermark has passed that; what comes later begins anew.
    """
    log = events.withWatermark("ts", delay).select(F.col("user_id").alias("attempt"), F.col("event_id").alias("id"), F.col("ts"), F.unix_timestamp("ts").alias("t"))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["t", "id"])
        last, active, idle, segments = state.get if state.exists else (None, 0, 0, 0)
        for t in rows["t"].tolist():
            if last is None:
                segments += 1
            elif t > last:
                gap = t - last
                if gap < SEGMENT_GAP:
                    rest = max(gap - IDLE_AFTER, 0)
                    idle, active = idle + rest, active + gap - rest
                else:
                    segments += 1
            last = t if last is None else max(last, t)
        state.update((last, active, idle, segments))
        state.setTimeoutTimestamp(max((last + forget) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"attempt": [key[0]], "active": [active], "idle": [idle], "segments": [segments], "last": [last]})

    return log.groupBy("attempt").applyInPandasWithState(update, PROFILE, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, message, n, attempts) of each window, once the watermark has passed it."""
    rows = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type")
    return rows.agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("attempts")).select(F.col("window.start").alias("start"), F.col("event_type").alias("message"), "n", "attempts")


def with_model(requests: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """A stream of requests joined with a model that is read anew in each micro-batch."""
    return requests.join(model, key, "left")


def growing_counts(events: DataFrame, path: str, keys: list[str], checkpoint: str):
    """A query that adds each micro-batch's counts by ``keys`` to a table of its own under ``path``; ``grown`` sums them up.

    A batch's table is overwritten if the batch is run again, so each counts once.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def grown(spark, path: str, keys: list[str]) -> DataFrame:
    """The model so far: (keys, n) over all batches."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("n").alias("n"))
