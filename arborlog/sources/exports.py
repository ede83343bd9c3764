"""Exports of traces: rows for learning-data repositories, bundles of tables, matrices, reports and responses."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stats import numbered
from ..operators.trace import thinned, trace

TIME = "yyyy-MM-dd HH:mm:ss"


def shop_rows(log: DataFrame, code: str, is_hint: Column, problem: str, level: Column) -> DataFrame:
    """The fourteen columns of a tutoring-log export: each action a step, the code shown only where it changes, hints as requests.

    ``attempt`` stays as the student; attempt numbers count the rows of a student's step.
    """
    w = trace()
    changed = ~F.col(code).eqNullSafe(F.lag(code).over(w))
    n = F.row_number().over(Window.partitionBy("attempt", "message").orderBy("t", "id"))
    rows = log.withColumns({"__n": n, "__shown": F.when(changed, F.col(code)), "__hint": is_hint, "__level": level})
    hint = F.col("__hint")
    return rows.select(
        F.col("attempt").alias("student"),
        F.concat_ws("-", F.lit("s"), "attempt", F.floor(F.col("t") / 86400).cast("string")).alias("session"),
        F.date_format("ts", TIME).alias("time"),
        F.lit("UTC").alias("time_zone"),
        F.when(hint, "HINT_REQUEST").otherwise("ATTEMPT").alias("response_type"),
        F.when(hint, "HINT_MSG").otherwise("RESULT").alias("tutor_response"),
        F.col("__level").alias("level"),
        F.lit(problem).alias("problem"),
        F.col("message").alias("step"),
        F.col("__n").cast("long").alias("attempt_at_step"),
        F.when(hint, "HINT").when(F.col("message") == "error", "INCORRECT").otherwise("CORRECT").alias("outcome"),
        F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("selection"),
        F.coalesce("__shown", F.lit("")).alias("code"),
        "id",
    )


def anonymised(rows: DataFrame, kind: str, name: str, order: list[str], within: str | None = None) -> DataFrame:
    """(within, kind, name, number): dense numbers from 0 for each kind's names, in the order in which they first appear."""
    keys = [within, kind] if within else [kind]
    first = rows.where(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.min(F.struct(*order)).alias("__o"))
    if within:
        return first.select(*keys, name, (F.row_number().over(Window.partitionBy(*keys).orderBy("__o")) - 1).cast("long").alias("number"))
    # all names of a kind would be one partition of a window: number them together, and take off where each kind begins
    every = numbered(first, [kind, "__o"], "__all")
    start = every.groupBy(kind).agg(F.min("__all").alias("__start"))
    return every.join(F.broadcast(start), kind).select(kind, name, (F.col("__all") - F.col("__start")).alias("number"))


def with_anonymous_refs(code: Column, numbers: Column, pattern: str = r'"id":"([^"]+)"') -> Column:
    """JSON code in which each id of a map (id to number) stands as that number; other ids stay."""

    @F.udf("string", useArrow=True)
    def run(text, known):
        import re

        return None if text is None else re.sub(pattern, lambda m: f'"id":{known[m.group(1)]}' if known and m.group(1) in known else m.group(), text)

    return run(code, numbers)


def event_rows(log: DataFrame, types: DataFrame, code_ids: DataFrame, code: str) -> DataFrame:
    """Main-table rows: (event_id, subject, order, event_type, code_state, server_time, tool); messages without a type stay as X-<message>.

    ``types`` is (message, event_type) with unique messages; ``code_ids`` is (code, code_id). The code state carries on while a row has none.
    """
    rows = log.join(F.broadcast(types), "message", "left").join(code_ids.select(F.col(code), "code_id"), code, "left")
    state = F.last("code_id", ignorenulls=True).over(trace().rowsBetween(Window.unboundedPreceding, 0))
    order = F.row_number().over(trace())
    return rows.select(
        F.concat_ws("-", F.col("attempt").cast("string"), F.col("id").cast("string")).alias("event_id"),
        F.col("attempt").alias("subject"),
        order.cast("long").alias("order"),
        F.coalesce("event_type", F.concat(F.lit("X-"), "message")).alias("event_type"),
        F.coalesce(state, F.lit(-1)).alias("code_state"),
        F.date_format("ts", TIME).alias("server_time"),
        F.lit("editor").alias("tool"),
    )


def project_events(log: DataFrame, is_submission: Column, session: str = "session") -> DataFrame:
    """(attempt, order, event, id, t): Project.Open before the first action, Session.Start and End around each run of a session, Submit after submissions, Project.Close after the last action."""
    w = trace()
    edge = {"__first": F.lag("id").over(w).isNull(), "__last": F.lead("id").over(w).isNull(), "__begin": F.coalesce(F.lag(session).over(w) != F.col(session), F.lit(True)), "__end": F.coalesce(F.lead(session).over(w) != F.col(session), F.lit(True)), "__submit": is_submission}
    put = lambda k, name: F.struct(F.lit(k).alias("k"), (name if isinstance(name, Column) else F.lit(name)).alias("event"))
    events = F.array(
        F.when(F.col("__begin"), put(0, "Session.Start")), F.when(F.col("__first"), put(1, "Project.Open")), put(2, F.col("message")),
        F.when(F.col("__submit"), put(3, "Submit")), F.when(F.col("__last"), put(4, "Project.Close")), F.when(F.col("__end"), put(5, "Session.End")),
    )
    each = log.withColumns(edge).select("attempt", "id", "t", F.explode(F.filter(events, lambda x: x.isNotNull())).alias("e"))
    order = F.row_number().over(Window.partitionBy("attempt").orderBy("t", "id", "e.k"))
    return each.select("attempt", order.cast("long").alias("order"), "e.event", "id", "t")


def subject_links(grades: DataFrame, tests: list[str]) -> DataFrame:
    """(assignment, subject, a column for each test): grades (assignment, subject, test, score) as columns; a missing one is -1."""
    return grades.groupBy("assignment", "subject").pivot("test", tests).agg(F.max("score")).na.fill(-1, tests)


def bundle(path: str, main: DataFrame, code_states: DataFrame, links: dict[str, DataFrame], metadata: dict[str, str]) -> None:
    """A folder of MainTable, CodeStates, LinkTables/<name> and DatasetMetadata as CSV."""
    put = lambda rows, name: rows.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    put(main, "MainTable")
    put(code_states, "CodeStates")
    for name, rows in links.items():
        put(rows, f"LinkTables/{name}")
    put(main.sparkSession.createDataFrame(sorted(metadata.items()), "Property string, Value string"), "DatasetMetadata")


def distance_matrix(pairs: DataFrame, names: list[str]) -> DataFrame:
    """A row for each item and a column for each of a bounded list of names, of (a, b, distance)."""
    return pairs.groupBy("a").pivot("b", names).agg(F.first("distance"))


def interval_rows(log: DataFrame, seconds: int, state: str) -> DataFrame:
    """(attempt, n, id, t): snapshots at least so far apart, numbered along the trace."""
    rows = thinned(log.select("attempt", "id", "t", state), seconds, state)
    return rows.select("attempt", F.row_number().over(trace()).cast("long").alias("n"), "id", "t")


def goal_report(goals: DataFrame, contexts: DataFrame) -> DataFrame:
    """(place, state, value, context, n): goals by value, highest first, each with how often it stood in which context."""
    ranked = numbered(goals, [F.desc("value"), "state"], "place")
    n = contexts.groupBy("state", "context").agg(F.count("*").alias("n"))
    return ranked.join(n, "state", "left").select((F.col("place") + 1).alias("place"), "state", "value", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("n", F.lit(0)).alias("n"))


def hint_response(rows: DataFrame, before: Column, after: Column, kind: Column, data: Column, error: Column | None = None) -> DataFrame:
    """Adds ``json``: {from, to, type, data} of a hint, or {error: true, message} where there is an error."""
    hint = F.to_json(F.struct(before.alias("from"), after.alias("to"), kind.alias("type"), data.alias("data")))
    wrong = F.lit(None).cast("string") if error is None else error
    return rows.withColumn("json", F.when(wrong.isNotNull(), F.to_json(F.struct(F.lit(True).alias("error"), wrong.alias("message")))).otherwise(hint))


def debug_json(a, b, cfg=None) -> str:
    """What an alignment found: paired nodes, paired names, cost and edits, as JSON."""
    from ..operators import alignment

    cfg = cfg or alignment.Config()
    m = alignment.align(a, b, cfg)
    number = {id(n): i for x in (a, b) for i, n in enumerate(x.walk())}
    pairs = [{"from": number[id(n)], "to": number[id(m.to[id(n)])], "type": n.type} for n in a.walk() if id(n) in m.to]
    return json.dumps({"cost": m.cost, "pairs": pairs, "names": alignment.value_mapping(a, m), "edits": alignment.edits(a, b, m, cfg)}, sort_keys=True)


def row_link(base: str, *parts: Column) -> Column:
    """A spreadsheet formula that opens a row in a viewer."""
    return F.concat(F.lit(f'=HYPERLINK("{base}'), F.concat_ws("/", *parts), F.lit('")'))


def capture_key(xml: Column, hint: Column) -> Column:
    """The name under which a request and its hint are kept as a test."""
    return F.substring(F.sha2(F.concat_ws("\n", xml, hint), 256), 1, 16)


def capture(rows: DataFrame, path: str, xml: str = "xml", hint: str = "hint") -> None:
    """A folder for each assignment with (key, xml, hint) of the requests worth testing again; equal ones once."""
    kept = rows.withColumn("key", capture_key(F.col(xml), F.col(hint))).dropDuplicates(["assignment", "key"])
    kept.select("assignment", "key", F.col(xml).alias("xml"), F.col(hint).alias("hint")).write.mode("append").partitionBy("assignment").json(path)


def repaired_hints(requests: DataFrame, hints: DataFrame) -> DataFrame:
    """(attempt, json): of attempts whose hint rows lack their hints, an object from row id to the hints found anew.

    ``requests`` is (attempt, row, hints); ``hints`` is (attempt, row, found). A hot attempt is bounded by its own requests.
    """
    empty = requests.where("coalesce(hints, '') = ''").join(hints, ["attempt", "row"])
    cells = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("row").cast("string").alias("key"), F.col("found").alias("value")))))
    return empty.groupBy("attempt").agg(F.to_json(cells).alias("json"))


def preorder_text(types: Column) -> Column:
    """The labels of a packed tree in pre-order, one to a line, set in by depth by their consumer: an interchange format of tree tools."""
    return F.array_join(F.transform(types, lambda x: x["type"]), "\n")


def cached(spark, path: str, version: int, make, mode: str = "use") -> DataFrame:
    """A table kept at a path with its version: ``use`` it if it is there and of this version, ``ignore`` it, or ``overwrite`` it."""
    at = f"{path}/v{version}"
    if mode == "ignore":
        return make()
    if mode == "use":
        try:
            return spark.read.parquet(at)
        except Exception as e:  # nothing readable is there
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def to_database(rows: DataFrame, url: str, table: str, **options: str) -> None:
    """Rows added to a table of a database, by prepared statements and never as text."""
    rows.write.mode("append").format("jdbc").options(url=url, dbtable=table, **options).save()


def prepared(spark, raw: str, path: str, version: int = 1) -> DataFrame:
    """A big log read once, split by assignment and project, and kept as a table for what follows."""
    from . import logs, sinks

    def make() -> DataFrame:
        log = logs.action_log(spark, raw)
        sinks.split_by_project(log, f"{path}/split")
        return log

    return cached(spark, f"{path}/log", version, make)
