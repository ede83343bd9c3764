"""Filters of attempts and rows by what is known of the attempt."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .trace import positions, time_profile, trace


@dataclass(frozen=True)
class Filter:
    """``facts`` are aggregates over an attempt's rows, ``keep`` is what must hold of them; a filter of fixed ids has no facts."""

    name: str
    facts: dict[str, Column]
    keep: Callable[[], Column]


def submitted_only(is_submission: Column) -> Filter:
    return Filter("submitted", {"submitted": F.max(is_submission.cast("int"))}, lambda: F.col("submitted") == 1)


def likely_submitted(is_submission: Column, least: int) -> Filter:
    """Submitted, or with so many rows that it was likely handed in by other means."""
    return Filter("likely", {"likely": F.max(is_submission.cast("int")), "likely_rows": F.count("*")}, lambda: (F.col("likely") == 1) | (F.col("likely_rows") >= least))


def started_after(t: int) -> Filter:
    return Filter("started", {"started": F.min("t")}, lambda: F.col("started") > t)


def more_rows_than(n: int) -> Filter:
    return Filter("rows", {"rows": F.count("*")}, lambda: F.col("rows") > n)


def kept(log: DataFrame, filters: Sequence[Filter], ignored: Sequence = ()) -> DataFrame:
    """Rows of the attempts that all filters keep; the facts of all filters are one aggregate, and ignored attempts go before it."""
    rows = log.where(~F.col("attempt").isin(list(ignored))) if ignored else log
    facts = [c.alias(k) for f in filters for k, c in f.facts.items()]
    if not facts:
        return rows
    fine = rows.groupBy("attempt").agg(*facts)
    for f in filters:
        fine = fine.where(f.keep())
    return rows.join(fine.select("attempt"), "attempt", "left_semi")


def prequel_ends(submissions: DataFrame) -> DataFrame:
    """(attempt, ord, end) of rows (attempt, ord, location, row): for each assignment the row at which the latest earlier one with the same location ended.

    An earlier assignment whose row lies behind the own one, or at another location, doesn't count.
    """
    a = submissions.select("attempt", "ord", "location", "row")
    before = a.select("attempt", F.col("ord").alias("o"), F.col("location").alias("l"), F.col("row").alias("r"))
    found = a.join(before, "attempt").where((F.col("o") < F.col("ord")) & (F.col("l") == F.col("location")) & (F.col("r") < F.col("row")))
    return found.groupBy("attempt", "ord").agg(F.max_by("r", "o").alias("end"))


def export_gated(log: DataFrame, is_export: Column, is_submitted: Column, exported_only: bool = True) -> DataFrame:
    """Rows up to the last export (on wish), and in any case none behind the first submitted row."""
    whole = Window.partitionBy("attempt")
    rows = positions(log).withColumns({"__export": is_export, "__submitted": is_submitted})
    rows = rows.withColumns({"__last": F.max(F.when(F.col("__export"), F.col("place"))).over(whole), "__stop": F.min(F.when(F.col("__submitted"), F.col("place"))).over(whole)})
    keep = F.coalesce(F.col("place") <= F.col("__stop"), F.lit(True))
    if exported_only:
        keep = keep & F.coalesce(F.col("place") <= F.col("__last"), F.lit(False))
    return rows.where(keep).select(*log.columns)


def emptied_if_short(log: DataFrame, least: int) -> DataFrame:
    """(attempt, rows, active): every attempt, with zeros for one that lasts less than ``least`` seconds."""
    n = log.groupBy("attempt").agg(F.count("*").alias("rows"), (F.max("t") - F.min("t")).alias("d"))
    long = F.col("d") >= least
    return n.join(time_profile(log).select("attempt", "active"), "attempt").select("attempt", F.when(long, F.col("rows")).otherwise(0).alias("rows"), F.when(long, F.col("active")).otherwise(0).alias("active"))


def graded(log: DataFrame, grades: DataFrame, least: float, left_out: Sequence = ()) -> DataFrame:
    """Rows of attempts with a grade (attempt, average) of at least that, without those left out for testing."""
    fine = grades.where((F.col("average") >= least) & ~F.col("attempt").isin(list(left_out)))
    return log.join(fine.select("attempt"), "attempt", "left_semi")


def hint_rows(log: DataFrame, dialogs: Sequence[str], toggles: Sequence[str], shows: Column) -> DataFrame:
    """Rows that show a hint: the dialogs, and toggles whose payload says that they show; ``dialog`` tells them apart."""
    dialog = F.col("message").isin(list(dialogs))
    return log.where(dialog | (F.col("message").isin(list(toggles)) & F.coalesce(shows, F.lit(False)))).withColumn("dialog", F.col("message").isin(list(dialogs)))


def without_hints(log: DataFrame, hints: DataFrame) -> DataFrame:
    """Attempts that never got a hint."""
    return log.join(hints.select("attempt").distinct(), "attempt", "left_anti")


def first_of_place(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each place, in that order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def child_place(types: Column, wanted: Column | str, start: int = 0, stop: int | None = None) -> Column:
    """The place of the first child of a type in [start, stop), -1 if there is none."""
    part = F.slice(types, start + 1, F.greatest((F.size(types) if stop is None else F.least(F.size(types), F.lit(stop))) - start, F.lit(0)))
    at = F.array_position(part, wanted)
    return F.when(at > 0, at + start - 1).otherwise(-1)


def parent_type(path: Column) -> Column:
    """The type of a node's parent, null for the root."""
    return F.when(F.size(path) > 1, F.element_at(path, -2))


def switches(log: DataFrame, state: str, is_marker: Column) -> DataFrame:
    """Rows right after a marker whose state isn't the one before the marker: the work of another assignment was loaded."""
    w = trace()
    rows = log.withColumn("__m", is_marker).withColumns({"__marked": F.lag("__m").over(w), "before": F.lag(state, 2).over(w)})
    return rows.where(F.col("__marked") & F.col("before").isNotNull() & (F.col("before") != F.col(state))).drop("__m", "__marked")
