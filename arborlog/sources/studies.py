"""Readers of what studies add to a log: start rows, hints, consensus, repaired hints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def start_rows(spark: SparkSession, path: str) -> DataFrame:
    """(assignment, user, start): from which row of which user's log an assignment counts."""
    raw = spark.read.csv(path, header=True)
    start = F.col("startAssignment") if "startAssignment" in raw.columns else F.col("assignment")
    return raw.select("assignment", F.col("code").alias("user"), F.expr("try_cast(id AS bigint)").alias("start"), F.coalesce(start, F.col("assignment")).alias("start_assignment"))


def tutor_hints(spark: SparkSession, path: str, left_out: tuple[str, ...] = ("highlight", "algorithms")) -> DataFrame:
    """(hint, user, row, assignment, priority, code) of hints written by people; programs' and empty ones are left out."""
    raw = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    rows = raw.select(F.expr("try_cast(hid AS bigint)").alias("hint"), F.col("userID").alias("user"), F.expr("try_cast(rowID AS bigint)").alias("row"), F.col("trueAssignmentID").alias("assignment"), F.expr("try_cast(priority AS int)").alias("priority"), F.col("hintCode").alias("code"))
    return rows.where(~F.lower(F.coalesce("user", F.lit(""))).isin(*left_out) & F.col("code").isNotNull() & ~F.upper(F.trim("code")).isin("", "NULL"))


def consensus(spark: SparkSession, path: str) -> DataFrame:
    """(hint, validity, priority, votes): fails where more are counted for a hint than voted."""
    raw = spark.read.csv(path, header=True)
    n = lambda c: F.coalesce(F.expr(f"try_cast(`{c}` AS int)"), F.lit(0)) if c in raw.columns else F.lit(0)
    votes = n("P1") + n("P2") + n("P3") + n("P4")
    rows = raw.select(F.expr("try_cast(`Hint ID` AS bigint)").alias("hint"), F.col("`Consensus (Validity)`").alias("validity"), F.expr("try_cast(`Consensus (Priority)` AS int)").alias("priority"), (n("V1") - n("P4")).alias("votes"), (n("V1") > votes).alias("__bad"))
    checked = F.when(F.col("__bad"), F.raise_error(F.concat(F.lit("too many votes for hint "), F.col("hint").cast("string")))).otherwise(F.lit(True))
    return rows.withColumn("__ok", checked).where("__ok").drop("__bad", "__ok")


def repaired(spark: SparkSession, path: str) -> DataFrame:
    """(attempt, row, hints) of files of a JSON object from row id to hints, named by attempt."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("attempt"), "value")
    rows = raw.select("attempt", F.explode(F.from_json("value", "map<string,string>")).alias("row", "hints"))
    return rows.select("attempt", F.expr("try_cast(row AS bigint)").alias("row"), "hints")


def submitted_folder(spark: SparkSession, path: str) -> DataFrame:
    """(project, file, xml) of a folder of project files: the guid of each, or nolog-<file> without one; the same guid twice fails."""
    from ..operators.stats import unique_or_fail

    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("xml"))
    guid = F.nullif(F.regexp_extract("xml", r'guid="([^"]+)"', 1), F.lit(""))
    return unique_or_fail(raw.select(F.coalesce(guid, F.concat(F.lit("nolog-"), "file")).alias("project"), "file", "xml"), "project")
