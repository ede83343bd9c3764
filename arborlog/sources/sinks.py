"""Writers of logs, models and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stats import numbered
from .logs import safe_name


def split_by_project(log: DataFrame, path: str) -> None:
    """A folder for each assignment and project; rows are dealt by project first, so each file is written once."""
    rows = log.withColumns({"assignment": safe_name(F.col("assignment_id")), "project": safe_name(F.col("project_id"))})
    rows.repartition("assignment", "project").sortWithinPartitions("assignment", "project", "time", "id").write.mode("overwrite").partitionBy("assignment", "project").option("header", True).csv(path)


def code_dictionary(log: DataFrame, code: str = "code") -> DataFrame:
    """(code, code_id): ids from 0 in the order in which codes first appear; only distinct codes are numbered."""
    first = log.where(F.col(code).isNotNull()).groupBy(code).agg(F.min(F.struct("t", "id")).alias("o"))
    return numbered(first, ["o"], "code_id").select(code, "code_id")


def session_events(log: DataFrame, session: str = "session") -> DataFrame:
    """(attempt, order, event, id, t): the actions with Session.Start and Session.End put around each run of one session."""
    w = Window.partitionBy("attempt").orderBy("t", "id")
    begin = F.coalesce(F.lag(session).over(w) != F.col(session), F.lit(True))
    end = F.coalesce(F.lead(session).over(w) != F.col(session), F.lit(True))
    steps = log.withColumns({"b": begin, "e": end}).select("attempt", "id", "t", F.explode(F.filter(F.array(F.when(F.col("b"), F.struct(F.lit(0).alias("k"), F.lit("Session.Start").alias("event"))), F.struct(F.lit(1).alias("k"), F.col("message").alias("event")), F.when(F.col("e"), F.struct(F.lit(2).alias("k"), F.lit("Session.End").alias("event")))), lambda x: x.isNotNull())).alias("s"))
    order = F.row_number().over(Window.partitionBy("attempt").orderBy("t", "id", "s.k"))
    return steps.select("attempt", order.cast("long").alias("order"), "s.event", "id", "t")


def mapped_events(log: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with their type, messages without one). A message with two types fails."""
    from ..operators.stats import unique_or_fail

    table = unique_or_fail(mapping, "message")
    return log.join(F.broadcast(table), "message"), log.join(F.broadcast(table), "message", "left_anti").select("message").distinct()


def change_rows(log: DataFrame, code: str) -> DataFrame:
    """Adds ``shown``: the code where it isn't that of the row before."""
    before = F.lag(code).over(Window.partitionBy("attempt").orderBy("t", "id"))
    return log.withColumn("shown", F.when(~F.col(code).eqNullSafe(before), F.col(code)))


def tab_separated(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def category_events(log: DataFrame, categories: DataFrame) -> DataFrame:
    return log.join(F.broadcast(categories.where("category is not null")), "message").select("attempt", "id", "category")


def grammar(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(type, flexible, children): of each node type the types seen at each place; flexible if its nodes differ in number of children."""
    counts = nodes.groupBy("type").agg((F.count_distinct(F.size("types")) > 1).alias("flexible"))
    at = nodes.select("type", F.posexplode("types").alias("place", "child")).groupBy("type", "place").agg(F.array_sort(F.collect_set("child")).alias("kinds"))
    places = at.groupBy("type").agg(F.array_sort(F.collect_list(F.struct("place", "kinds"))).alias("children"))
    return counts.join(places, "type", "left")


def model_path(base: str, assignment: str, min_grade: float, dataset: str = "") -> str:
    return f"{base}/{assignment}-g{round(100 * min_grade):03d}" + (f"-{dataset}" if dataset else "")


def save_model(parts: dict[str, DataFrame], path: str) -> None:
    for name, rows in parts.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def dashboard(profile: DataFrame) -> DataFrame:
    """(json): a row's fields as JSON."""
    return profile.select(F.to_json(F.struct(*profile.columns)).alias("json"))
