"""Operators on ordered traces of actions.

A log has a row for each action: attempt (whose trace it belongs to), id, t (seconds), message, and any other columns. A trace is
ordered by (t, id). All operators are windows or aggregates on the attempt, so one shuffle by attempt serves a chain of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A gap this long (seconds) begins a new work segment; of a shorter one, what is over IDLE_AFTER is idle time.
SEGMENT_GAP = 300
IDLE_AFTER = 60
ORDER = ("t", "id")


def trace(*more: str):
    return Window.partitionBy("attempt", *more).orderBy(*ORDER)


def so_far(*more: str):
    return trace(*more).rowsBetween(Window.unboundedPreceding, 0)


def seconds(ts: str) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def log_of(events: DataFrame) -> DataFrame:
    """The log of an event table: a user's events are an attempt."""
    return events.select(F.col("user_id").alias("attempt"), F.col("event_id").alias("id"), seconds("ts").alias("t"), F.col("event_type").alias("message"), "value", "props", "ts")


# --- time ---


def gaps(log: DataFrame) -> DataFrame:
    return log.withColumn("gap", F.col("t") - F.lag("t").over(trace()))


def _split(gap: Column) -> tuple[Column, Column, Column]:
    inside = gap < SEGMENT_GAP
    idle = F.when(inside, F.greatest(gap - IDLE_AFTER, F.lit(0))).otherwise(0)
    return F.when(inside, gap).otherwise(0) - idle, idle, F.when(gap.isNull() | ~inside, 1).otherwise(0)


def time_profile(log: DataFrame) -> DataFrame:
    """(attempt, active, idle, segments) in seconds; the first action opens a segment."""
    active, idle, opens = _split(F.col("gap"))
    return gaps(log).groupBy("attempt").agg(F.sum(active).cast("long").alias("active"), F.sum(idle).cast("long").alias("idle"), F.sum(opens).cast("long").alias("segments"))


def running_time(log: DataFrame) -> DataFrame:
    """Adds active (seconds worked up to the row) and segment (its number, from 1)."""
    active, _, opens = _split(F.col("gap"))
    return gaps(log).withColumns({"active": F.sum(active).over(so_far()).cast("long"), "segment": F.sum(opens).over(so_far()).cast("long")}).drop("gap")


def edit_time(log: DataFrame, is_edit: Column, idle_after: int = 180) -> DataFrame:
    """(attempt, active, idle): between edits only; a gap over ``idle_after`` is idle as a whole."""
    return gaps(log.where(is_edit)).groupBy("attempt").agg(
        F.coalesce(F.sum(F.when(F.col("gap") <= idle_after, F.col("gap"))), F.lit(0)).cast("long").alias("active"),
        F.coalesce(F.sum(F.when(F.col("gap") > idle_after, F.col("gap"))), F.lit(0)).cast("long").alias("idle"),
    )


def minutes(log: DataFrame, width: int = 60) -> DataFrame:
    """The first action of each ``width`` seconds of active time."""
    rows = running_time(log).withColumn("bucket", F.floor(F.col("active") / width).cast("long"))
    return rows.withColumn("n", F.row_number().over(trace("bucket"))).where("n = 1").drop("n")


# --- position and change ---


def positions(log: DataFrame) -> DataFrame:
    """Adds place (from 1) and fraction (of the trace's rows)."""
    n = F.count("*").over(Window.partitionBy("attempt"))
    place = F.row_number().over(trace())
    return log.withColumns({"place": place.cast("long"), "fraction": place / n})


def changes(log: DataFrame, value: str) -> DataFrame:
    """Only rows whose value isn't that of the row before."""
    w = trace()
    return log.withColumns({"before": F.lag(value).over(w), "n": F.row_number().over(w)}).where((F.col("n") == 1) | ~F.col(value).eqNullSafe(F.col("before"))).drop("before", "n")


def transitions(log: DataFrame, state: str) -> DataFrame:
    """(attempt, source, target) of each step to another state."""
    return changes(log, state).select("attempt", F.lag(state).over(trace()).alias("source"), F.col(state).alias("target")).where("source is not null")


def first_seen(log: DataFrame, value: str) -> DataFrame:
    """(attempt, value, code): dense numbers from 0 in the order in which values first appear."""
    first = log.groupBy("attempt", value).agg(F.min(F.struct(*ORDER)).alias("o"))
    return first.select("attempt", value, (F.dense_rank().over(Window.partitionBy("attempt").orderBy("o")) - 1).cast("long").alias("code"))


def first_counts(log: DataFrame, label: str) -> DataFrame:
    """(attempt, label, n, place): when the n-th of a label came, as a rank among such first times."""
    n = F.row_number().over(trace(label))
    return positions(log.withColumn("n", n.cast("long"))).select("attempt", label, "n", "place")


def first_times(log: DataFrame, label: str) -> DataFrame:
    """(attempt, label, t, since): when each label first came and the seconds since the label first seen before it (or the start)."""
    first = log.groupBy("attempt", label).agg(F.min(F.struct("t", "id")).alias("o"))
    begin = F.min("o.t").over(Window.partitionBy("attempt"))
    w = Window.partitionBy("attempt").orderBy("o")
    return first.select("attempt", label, F.col("o.t").alias("t"), (F.col("o.t") - F.coalesce(F.lag("o.t").over(w), begin)).alias("since"))


def cut_after_gap(log: DataFrame, gap: int, fraction: float = 0.65) -> DataFrame:
    """Rows before the first gap of at least ``gap`` seconds past that share of the trace."""
    rows = gaps(positions(log))
    stop = F.min(F.when((F.col("gap") >= gap) & (F.col("fraction") > fraction), F.col("place"))).over(Window.partitionBy("attempt"))
    return rows.withColumn("stop", stop).where("stop is null or place < stop").drop("stop", "gap", "place", "fraction")


def accumulated(log: DataFrame, features: dict[str, Column]) -> DataFrame:
    """Each feature once true stays true; ``flips`` says how many became true at the row."""
    w = so_far()
    now = {k: F.max(F.coalesce(c.cast("int"), F.lit(0))).over(w) for k, c in features.items()}
    rows = log.withColumns(now)
    flips = sum((F.col(k) - F.coalesce(F.lag(k).over(trace()), F.lit(0)) for k in features), F.lit(0))
    return rows.withColumn("flips", flips)


# --- as-of joins within a trace ---


def carried(log: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the latest non-null value at or before the row."""
    return log.withColumn(name, F.last(value, ignorenulls=True).over(so_far()))


def looked_ahead(log: DataFrame, at: Column, wanted: Column, most: int = 5) -> DataFrame:
    """(attempt, id, step, found_id): the next ``most`` wanted rows after each row where ``at`` holds.

    Wanted rows are numbered along the trace; a row joins the numbers after its own by equality, so no range join is made.
    """
    w = so_far()
    rows = log.select("attempt", "id", "t", at.alias("at"), wanted.alias("wanted")).withColumn("n", F.sum(F.when(F.col("wanted"), 1).otherwise(0)).over(w))
    found = rows.where("wanted").select("attempt", "n", F.col("id").alias("found_id"))
    asks = rows.where("at").select("attempt", "id", F.col("n").alias("own"), F.explode(F.sequence(F.lit(1), F.lit(most))).alias("step"))
    return asks.withColumn("n", F.col("own") + F.col("step")).join(found, ["attempt", "n"]).select("attempt", "id", F.col("step").cast("long").alias("step"), "found_id")


def looked_back(log: DataFrame, key: str) -> DataFrame:
    """Adds the id of the latest earlier row of the trace with the same key."""
    return log.withColumn("earlier_id", F.lag("id").over(trace(key)))


# --- filters ---


def without_grabs(log: DataFrame, has_state: Column, is_grab: Column) -> DataFrame:
    """Drops a grab whose next row has a state of its own."""
    rows = log.withColumn("has", has_state).withColumn("next", F.lead("has").over(trace()))
    return rows.where(~(is_grab & F.col("has") & F.coalesce(F.col("next"), F.lit(False)))).drop("has", "next")


def up_to_last(log: DataFrame, mark: Column) -> DataFrame:
    """Rows up to the last marked one of the trace; traces without a mark go."""
    place = F.row_number().over(trace())
    rows = log.withColumn("place", place).withColumn("m", mark)
    stop = F.max(F.when(F.col("m"), F.col("place"))).over(Window.partitionBy("attempt"))
    return rows.withColumn("stop", stop).where("place <= stop").drop("place", "m", "stop")


def long_enough(log: DataFrame, rows: int = 3, duration: int = 0) -> DataFrame:
    """Traces with more than ``rows`` rows that last at least ``duration`` seconds."""
    w = Window.partitionBy("attempt")
    kept = log.withColumns({"n": F.count("*").over(w), "d": F.max("t").over(w) - F.min("t").over(w)})
    return kept.where((F.col("n") > rows) & (F.col("d") >= duration)).drop("n", "d")


def between_ids(log: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows after ``after`` (exclusive) and from ``start`` on, where an attempt has such bounds."""
    rows = log.join(bounds, "attempt", "left")
    return rows.where((F.col("after").isNull() | (F.col("id") > F.col("after"))) & (F.col("start").isNull() | (F.col("id") >= F.col("start")))).select(*log.columns)


# --- slices, spans, subgoals ---


def slices(log: DataFrame, n: int = 50) -> DataFrame:
    """Adds slice, which of ``n`` equal parts of its trace a row lies in (from 0), and done, the share of the trace's active time up to it."""
    rows = running_time(positions(log)).withColumn("__n", F.count("*").over(Window.partitionBy("attempt")))
    total = F.max("active").over(Window.partitionBy("attempt"))
    return rows.withColumns({"slice": F.floor((F.col("place") - 1) * n / F.col("__n")).cast("long"), "done": F.when(total > 0, F.col("active") / total).otherwise(0.0)}).drop("__n")


def spans(log: DataFrame, begins: Column, ends: Column, value: str, name: str) -> DataFrame:
    """Adds what ``value`` was where the latest span began, from that row to the one that ends it; null outside."""
    w = so_far()
    mark = F.when(begins, F.struct(F.lit(True).alias("open"), F.col(value).alias("v"))).when(ends, F.struct(F.lit(False).alias("open"), F.lit(None).cast(log.schema[value].dataType).alias("v")))
    rows = log.withColumn("__mark", mark).withColumn("__ends", ends)
    before = F.last("__mark", ignorenulls=True).over(trace().rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"__now": F.last("__mark", ignorenulls=True).over(w), "__was": before})
    held = F.when(F.col("__ends"), F.col("__was")).otherwise(F.col("__now"))
    return rows.withColumn("__held", held).withColumn(name, F.when(F.col("__held.open"), F.col("__held.v"))).drop("__mark", "__ends", "__now", "__was", "__held")


def lasting_times(log: DataFrame, features: dict[str, Column], hold: int = 3) -> DataFrame:
    """(attempt, feature, t): when a feature first came and still held in the next ``hold`` rows (or up to the end)."""
    cells = F.array(*[F.struct(F.lit(k).alias("feature"), F.coalesce(c, F.lit(False)).cast("int").alias("ok")) for k, c in features.items()])
    each = log.select("attempt", "id", "t", F.explode(cells).alias("x")).select("attempt", "id", "t", "x.feature", "x.ok")
    lasts = F.min("ok").over(trace("feature").rowsBetween(0, hold))
    return each.withColumn("__l", lasts).where("__l = 1").groupBy("attempt", "feature").agg(F.min(F.struct("t", "id")).alias("o")).select("attempt", "feature", F.col("o.t").alias("t"))


def subgoals(log: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """(attempt, test, finish, at_end): when a test first held, and whether it holds in the last row."""
    cells = F.array(*[F.struct(F.lit(k).alias("test"), F.coalesce(c, F.lit(False)).alias("ok")) for k, c in tests.items()])
    each = log.select("attempt", "id", "t", F.explode(cells).alias("x")).select("attempt", "id", "t", "x.test", "x.ok")
    return each.groupBy("attempt", "test").agg(F.min(F.when(F.col("ok"), F.col("t"))).alias("finish"), F.max_by("ok", F.struct("t", "id")).alias("at_end"))


# --- sequential operators ---


def _each_trace(log: DataFrame, keep: Callable[[pd.DataFrame], Iterable[bool]]) -> DataFrame:
    """Rows that a function of a trace keeps. Traces lie in order in their partitions and are read as a stream, with no call into Spark for each."""
    columns = log.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def whole(rows: pd.DataFrame) -> pd.DataFrame:
            marks = [m for _, one in rows.groupby("attempt", sort=False, dropna=False) for m in keep(one)]
            return rows[marks][columns]

        for batch in batches:
            if not len(batch):
                continue
            rows = pd.concat([*held, batch]) if held else batch
            end = rows["attempt"].iloc[-1]
            last = rows["attempt"].isna() if pd.isna(end) else rows["attempt"].eq(end)
            done, rest = rows[~last], rows[last]
            if len(done):
                yield whole(done)
            held = [rest]
        if held:
            yield whole(held[0])

    return log.repartition("attempt").sortWithinPartitions("attempt", *ORDER).mapInPandas(run, log.schema)


def thinned(log: DataFrame, interval: int, state: str) -> DataFrame:
    """A row is kept if ``interval`` seconds have gone by since the last kept row and its state differs from that row's; the last row always is.

    Whether a row is kept depends on which were kept before, so a trace is read in order, in one call.
    """

    def keep(rows: pd.DataFrame) -> list[bool]:
        out, t0, s0 = [], None, None
        for k, (t, s) in enumerate(zip(rows["t"].tolist(), rows[state].tolist(), strict=True)):
            use = t0 is None or k == len(rows) - 1 or (t - t0 >= interval and s != s0)
            out.append(use)
            if use:
                t0, s0 = t, s
        return out

    return _each_trace(log, keep)


def rate_limited(log: DataFrame, wait: int, state: str, fraction: float = 0.2) -> DataFrame:
    """A row is kept if ``wait`` seconds have gone by since the last kept one, its state wasn't kept before, and it lies past that share of the trace's time."""

    def keep(rows: pd.DataFrame) -> list[bool]:
        times = rows["t"].tolist()
        begin, end = times[0], times[-1]
        out, t0, seen = [], None, set()
        for t, s in zip(times, rows[state].tolist(), strict=True):
            use = (t0 is None or t - t0 >= wait) and s not in seen and (end == begin or (t - begin) / (end - begin) >= fraction)
            out.append(use)
            if use:
                t0 = t
                seen.add(s)
        return out

    return _each_trace(log, keep)


def unstable(log: DataFrame, is_state: Column, item: str, pause: int = 20, fresh: int = 5) -> DataFrame:
    """State rows at least ``pause`` seconds after the row before, with ``fresh`` or more items not seen up to the last state row."""
    w = so_far()
    rows = gaps(log).withColumn("new", F.when(F.row_number().over(trace(item)) == 1, 1).otherwise(0)).withColumn("s", is_state)
    rows = rows.withColumn("seen", F.sum("new").over(w))
    last = F.last(F.when(F.col("s"), F.col("seen")), ignorenulls=True).over(trace().rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("fresh", F.col("seen") - F.coalesce(last, F.lit(0))).where(F.col("s") & (F.col("gap") >= pause) & (F.col("fresh") >= fresh)).select(*log.columns, "fresh")
