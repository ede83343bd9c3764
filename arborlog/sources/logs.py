"""Readers of action logs and of what is known about attempts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An id that isn't a number.
NO_ID = -1
TIME = "yyyy-MM-dd HH:mm:ss"


def action_log(spark: SparkSession, path: str, options: dict[str, str] | None = None) -> DataFrame:
    """A CSV log with a header: id, time, message, data (or jsonData), userID, sessionID, projectID, assignmentID, code; what is absent is null.

    Ids that aren't numbers are -1; rows without a project are dropped; the file's name is kept as ``file``, without its ending as ``attempt``.
    """
    raw = spark.read.options(header=True, multiLine=True, escape='"', mode="PERMISSIVE", **(options or {})).csv(path)
    has = {c.lower(): c for c in raw.columns}
    col = lambda *names: F.coalesce(*[F.col(f"`{has[n.lower()]}`") for n in names if n.lower() in has], F.lit(None).cast("string"))
    time = col("time")
    rows = raw.select(
        F.coalesce(F.expr(f"try_cast(`{has['id']}` AS bigint)"), F.lit(NO_ID)).alias("id") if "id" in has else F.lit(NO_ID).cast("long").alias("id"),
        F.coalesce(F.try_to_timestamp(time, F.lit(TIME)), F.try_to_timestamp(time)).alias("time"),
        col("message").alias("message"),
        col("data", "jsonData").alias("data"),
        col("userID").alias("user_id"),
        col("sessionID").alias("session_id"),
        col("projectID").alias("project_id"),
        col("assignmentID").alias("assignment_id"),
        F.nullif(col("code"), F.lit("")).alias("code"),
        F.col("_metadata.file_name").alias("file"),
        F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("attempt"),
    )
    return rows.where("coalesce(project_id, '') <> ''")


def cross_rows(log: DataFrame, assignment: str, attempts: DataFrame) -> DataFrame:
    """The rows that attempts (attempt) have in the log of another assignment."""
    return log.where(F.col("assignment_id") == assignment).join(attempts.select("attempt").distinct(), "attempt", "left_semi")


def tree_states(spark: SparkSession, path: str) -> DataFrame:
    """(student, file, tree, correct) of a folder of students' folders of JSON trees; a file that can't be read, and what a student has after it, is left out."""
    from ..operators.trees import packed

    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    rows = raw.select(F.regexp_extract(name, r"([^/]+)/[^/]+$", 1).alias("student"), F.col("_metadata.file_name").alias("file"), packed(F.col("value"), "json").alias("tree"), F.coalesce(F.get_json_object("value", "$.correct").cast("boolean"), F.lit(False)).alias("correct"))
    broken = rows.where("tree is null").groupBy("student").agg(F.min("file").alias("__first"))
    return rows.join(broken, "student", "left").where("__first is null or file < __first").drop("__first")


def hint_requests(rows: DataFrame, body: str = "body") -> DataFrame:
    """Requests as a service gets them (JSON with xml, assignmentID, dataset, minGrade, hintTypes, hint) with their parts as columns; works on streams too."""
    kind = "xml string, assignmentID string, dataset string, minGrade double, hintTypes string, hint string"
    parts = rows.withColumn("__r", F.from_json(body, kind))
    return parts.select(*rows.columns, F.col("__r.xml").alias("xml"), F.col("__r.assignmentID").alias("assignment"), F.coalesce("__r.dataset", F.lit("")).alias("dataset"), F.coalesce("__r.minGrade", F.lit(1.0)).alias("min_grade"), F.split(F.coalesce("__r.hintTypes", F.lit("")), ",").alias("hint_types"), F.col("__r.hint").alias("hint"))


def jdbc_log(spark: SparkSession, url: str, assignment: str, before: str | None = None, table: str = "trace", **options: str) -> DataFrame:
    """The log of an assignment in a database; both predicates are pushed down."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().where(F.col("assignmentID") == assignment)
    return rows.where(F.col("time") < F.lit(before)) if before else rows


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9._-]+", "_")


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """attempt,location,row files without a header; another number of fields fails; row -1 is none."""
    rows = spark.read.csv(path, schema="attempt string, location string, row long", mode="FAILFAST")
    return rows.withColumn("row", F.nullif("row", F.lit(-1)))


def grades(spark: SparkSession, path: str, ignored: tuple[str, ...] = ("rowNum", "Extra code", "Comment")) -> DataFrame:
    """(attempt, graded_id, outlier, test, score): a row for each test; pass is 2, fail 0, numbers as they are; an empty cell makes an outlier.

    The table ends at the first row without a project.
    """
    lines = spark.read.csv(path, header=True).withColumn("__line", F.monotonically_increasing_id())
    stop = F.broadcast(lines.agg(F.min(F.when(F.col("`Project ID`").isNull(), F.col("__line"))).alias("__stop")))
    raw = lines.join(stop).where("__stop is null or __line < __stop").drop("__line", "__stop")
    fixed = ["Project ID", "Graded ID", "Outlier?"]
    tests = [c for c in raw.columns if c not in fixed and c not in ignored]
    cell = lambda c: F.when(F.lower(F.trim(F.col(f"`{c}`"))) == "pass", 2).when(F.lower(F.trim(F.col(f"`{c}`"))) == "fail", 0).otherwise(F.expr(f"try_cast(`{c}` AS int)"))
    empty = F.lit(False)
    for c in tests:
        empty = empty | F.col(f"`{c}`").isNull()
    rows = raw.where(F.col("`Project ID`").isNotNull()).select(F.col("`Project ID`").alias("attempt"), F.expr("try_cast(`Graded ID` AS bigint)").alias("graded_id"), ((F.lower(F.coalesce(F.col("`Outlier?`"), F.lit(""))) == "yes") | empty).alias("outlier"), F.explode(F.array(*[F.struct(F.lit(c).alias("test"), cell(c).alias("score")) for c in tests])).alias("t"))
    return rows.select("attempt", "graded_id", "outlier", "t.test", F.when(~F.col("outlier"), F.col("t.score")).alias("score"))


def class_grades(spark: SparkSession, path: str, totals: str) -> DataFrame:
    """(user, assignment, grade): points over the assignment's total."""
    rows, total = spark.read.csv(path, header=True), spark.read.csv(totals, header=True)
    names = [c for c in rows.columns if c != "AnonID" and c in total.columns]
    points = rows.unpivot(["AnonID"], names, "assignment", "points")
    of = total.select(*names).unpivot([], names, "assignment", "total")
    return points.join(F.broadcast(of), "assignment").select(F.col("AnonID").alias("user"), "assignment", (F.col("points").cast("double") / F.col("total").cast("double")).alias("grade"))


def categories(spark: SparkSession, path: str) -> DataFrame:
    """message to category; blank ones and those marked to be ignored have none."""
    raw = spark.read.csv(path, header=True)
    return raw.select(F.col("Message").alias("message"), F.when(F.coalesce(F.trim("Ignore"), F.lit("")) == "", F.nullif(F.trim("`Translated Event`"), F.lit(""))).alias("category"))


def block_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(type, category, kind) of a JSON object of blocks; predicates count as reporters."""
    raw = spark.read.text(path, wholetext=True)
    cell = "map<string,struct<type:string,category:string,spec:string>>"
    rows = raw.select(F.explode(F.from_json("value", cell)).alias("type", "b"))
    return rows.select("type", "b.category", F.when(F.col("b.type") == "predicate", "reporter").otherwise(F.col("b.type")).alias("kind"))


def documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, tree) of a folder of XML, JSON or HTML files."""
    from ..operators.trees import packed

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), packed(F.col("value"), kind).alias("tree"))


def code_states(main: DataFrame, states: DataFrame) -> DataFrame:
    """A main table with the code of each state id."""
    return main.join(states, "CodeStateID", "left")


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, n, columns): lines of a CSV file whose number of columns (outside quotes) isn't the first line's."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    n = (F.size(F.split(F.regexp_replace("value", '"(?:[^"]|"")*"', ""), ",", -1))).alias("n")
    first = lines.orderBy("line").limit(1).select(n).first()
    return lines.select("line", n, F.lit(first[0] if first else 0).alias("columns")).where("n <> columns")


def plain(text: str) -> str:
    return unicodedata.normalize("NFC", text)
