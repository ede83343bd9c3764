"""Evaluation of hints, predictions and policies over traces and trees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .trace import positions, so_far, trace
from .trees import backbone


def done_and_undone(log: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """(test, done, undone): steps that make a test pass and steps that make it fail again."""
    cells = F.array(*[F.struct(F.lit(k).alias("test"), F.coalesce(c, F.lit(False)).alias("ok")) for k, c in tests.items()])
    each = log.select("attempt", "id", "t", F.explode(cells).alias("x")).select("attempt", "id", "t", "x.test", "x.ok")
    before = F.lag("ok").over(trace("test"))
    steps = each.withColumn("before", before)
    return steps.groupBy("test").agg(F.count_if(F.col("ok") & ~F.coalesce("before", F.lit(False))).alias("done"), F.count_if(~F.col("ok") & F.coalesce("before", F.lit(False))).alias("undone"))


def came_true(log: DataFrame, at: Column, state: str, within: int = 5) -> DataFrame:
    """(attempt, id, hit): of each row where ``at`` holds, whether one of the next rows has its state."""
    ahead = F.collect_list(state).over(trace().rowsBetween(1, within))
    return log.withColumn("ahead", ahead).where(at).select("attempt", "id", F.array_contains("ahead", F.col(state)).alias("hit"))


def solve_step(log: DataFrame, solved: Column) -> DataFrame:
    """(attempt, step): the first place at which it is solved, -1 if never."""
    return positions(log).groupBy("attempt").agg(F.coalesce(F.min(F.when(solved, F.col("place"))), F.lit(-1)).alias("step"))


def placement(log: DataFrame, state: str) -> DataFrame:
    """(attempt, fraction): at what share of the trace its last state first came."""
    last = F.last(state).over(trace().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = positions(log).withColumn("last", last)
    return rows.where(F.col(state).eqNullSafe(F.col("last"))).groupBy("attempt").agg(F.min("fraction").alias("fraction"))


def followed(log: DataFrame, at: Column, key: str, within: int = 5) -> DataFrame:
    """(attempt, id, pause, steps): after a hint, the seconds to the next row and how many rows until its key comes again (0: not within reach)."""
    rows = log.withColumns({"next": F.lead("t").over(trace()), "ahead": F.collect_list(key).over(trace().rowsBetween(1, within))})
    return rows.where(at).select("attempt", "id", F.coalesce(F.col("next") - F.col("t"), F.lit(-1)).alias("pause"), F.array_position("ahead", F.col(key)).alias("steps"))


def usage(log: DataFrame, hint: Column, edit: Column) -> DataFrame:
    """(attempt, hints, before_first, edits): hints asked for, edits before the first of them, all edits."""
    seen = F.sum(F.when(hint, 1).otherwise(0)).over(so_far())
    rows = log.withColumn("seen", seen)
    return rows.groupBy("attempt").agg(F.count_if(hint).alias("hints"), F.count_if(edit & (F.col("seen") == 0)).alias("before_first"), F.count_if(edit).alias("edits"))


def training_and_requests(log: DataFrame, solved: Column, asked: Column) -> tuple[DataFrame, DataFrame]:
    """Attempts that were solved without asking, and those that asked."""
    by = log.groupBy("attempt").agg(F.max(F.when(solved, 1).otherwise(0)).alias("s"), F.max(F.when(asked, 1).otherwise(0)).alias("a"))
    return by.where("s = 1 and a = 0").select("attempt"), by.where("a = 1").select("attempt")


def common_paths(nodes: DataFrame, key: str, length: int = 3, least: int = 2) -> DataFrame:
    """(path, n, trees): tails of root paths that come more than ``least`` times, with the trees that have them."""
    tail = F.array_join(F.slice("path", F.greatest(F.size("path") - length + 1, F.lit(1)), F.lit(length)), "->")
    return nodes.groupBy(tail.alias("path")).agg(F.count("*").alias("n"), F.count_distinct(key).alias("trees")).where(F.col("n") > least)


@dataclass(frozen=True)
class Test:
    """A tree passes if a node's path fits one of the patterns (see trees.backbone), at least so often."""

    name: str
    patterns: tuple[tuple[str, ...], ...]
    least: int = 1


def graded(nodes: DataFrame, key: str, tests: list[Test]) -> DataFrame:
    """(key, test, score): 2 if a tree passes, 1 if it has the last type of a pattern at all, else 0."""
    hits = {}
    for t in tests:
        fits, tried = F.lit(False), F.lit(False)
        for p in t.patterns:
            fits = fits | backbone(list(p))
            tried = tried | F.col("type").isin(p[-1].split("|"))
        hits[t.name] = F.when(F.count_if(fits) >= t.least, 2).when(F.count_if(tried) > 0, 1).otherwise(0)
    rows = nodes.groupBy(key).agg(*[c.alias(n) for n, c in hits.items()])
    return rows.unpivot([key], list(hits), "test", "score")


def hit_sweep(log: DataFrame, at: Column, state: str, most: int) -> DataFrame:
    """(within, asked, hits): of the rows where ``at`` holds, how many have their state again within 1, 2, ... rows; each row is looked at once."""
    w = trace().rowsBetween(1, most)
    rows = log.withColumn("ahead", F.collect_list(state).over(w)).where(at).select(F.array_position("ahead", F.col(state)).alias("n"))
    by = rows.groupBy("n").agg(F.count("*").alias("c"))
    sweep = by.sparkSession.range(1, most + 1).withColumnRenamed("id", "within")
    total = F.sum("c").alias("asked")
    return sweep.join(F.broadcast(by)).groupBy("within").agg(total, F.sum(F.when((F.col("n") > 0) & (F.col("n") <= F.col("within")), F.col("c")).otherwise(0)).alias("hits"))


def hint_set(rows: DataFrame) -> DataFrame:
    """(request, outcome, weight): equal outcomes of a request together, weights in shares of the request's whole."""
    each = rows.groupBy("request", "outcome").agg(F.sum("weight").alias("w"))
    return each.select("request", "outcome", (F.col("w") / F.sum("w").over(Window.partitionBy("request"))).alias("weight"))


def by_outcome(hints: DataFrame, text: Column) -> DataFrame:
    """(outcome, n, first, agreed): hints grouped by what they lead to (a digest of the normalised text); whether all give it the same priority."""
    rows = hints.withColumn("outcome", F.md5(F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), F.min("hint").alias("first"), (F.min("priority") == F.max("priority")).alias("agreed"))


def looked_up(rows: DataFrame, digests: DataFrame, text: str) -> DataFrame:
    """Rows whose text's digest is on a list (digest)."""
    return rows.withColumn("digest", F.md5(F.col(text))).join(digests.select("digest").distinct(), "digest", "left_semi")


def to_grade(attempts: DataFrame, grades: DataFrame, least: int) -> DataFrame:
    """Attempts with enough rows that have no grade yet."""
    return attempts.where(F.col("rows") >= least).join(grades.select("attempt"), "attempt", "left_anti")


def attributes(log: DataFrame, names: list[str], minutes: int, grades: DataFrame) -> DataFrame:
    """(attempt, a column for each name, average): how often each action came in the first minutes of active time, beside the grade."""
    from .trace import running_time

    rows = running_time(log).where(F.col("active") < 60 * minutes)
    counts = rows.groupBy("attempt").pivot("message", names).agg(F.count(F.lit(1))).na.fill(0, names)
    return counts.join(grades.select("attempt", "average"), "attempt")


def register(query, table) -> None:
    from .trace import log_of

    log_sql = "log AS (SELECT user_id AS attempt, event_id AS id, floor(epoch(ts))::BIGINT AS t, event_type AS message, value, props FROM events)"
    w = "(PARTITION BY attempt ORDER BY t, id)"
    ahead = "(PARTITION BY attempt ORDER BY t, id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"

    def log(spark, d):
        return log_of(table(spark, d, "events"))

    @query(f"""WITH {log_sql}, e AS (SELECT attempt, id, t, 'large' AS test, coalesce(value > 50, false) AS ok FROM log UNION ALL SELECT attempt, id, t, 'view', message = 'view' FROM log),
b AS (SELECT *, coalesce(lag(ok) OVER (PARTITION BY attempt, test ORDER BY t, id), false) AS before FROM e) SELECT test, count_if(ok AND NOT before)::BIGINT AS done, count_if(NOT ok AND before)::BIGINT AS undone FROM b GROUP BY 1""")
    def eval_done_and_undone(spark, d):
        return done_and_undone(log(spark, d), {"large": F.col("value") > 50, "view": F.col("message") == "view"})

    @query(f"WITH {log_sql}, a AS (SELECT *, list(props) OVER {ahead} AS l FROM log) SELECT attempt, id, coalesce(list_contains(l, props), false) AS hit FROM a WHERE message = 'error'")
    def eval_came_true(spark, d):
        return came_true(log(spark, d), F.col("message") == "error", "props")

    @query(f"WITH {log_sql}, p AS (SELECT *, row_number() OVER {w} AS place FROM log) SELECT attempt, coalesce(min(CASE WHEN message = 'purchase' THEN place END), -1) AS step FROM p GROUP BY 1")
    def eval_solve_step(spark, d):
        return solve_step(log(spark, d), F.col("message") == "purchase")

    @query(f"""WITH {log_sql}, p AS (SELECT *, row_number() OVER {w} AS place, count(*) OVER (PARTITION BY attempt) AS n FROM log), l AS (SELECT attempt, arg_max(props, place) AS last FROM p GROUP BY 1)
SELECT attempt, round(min(place / n), 9) AS fraction FROM p JOIN l USING (attempt) WHERE props = last GROUP BY 1""")
    def eval_placement(spark, d):
        return placement(log(spark, d), "props").select("attempt", F.round("fraction", 9).alias("fraction"))

    @query(f"""WITH {log_sql}, a AS (SELECT *, lead(t) OVER {w} AS nxt, list(message) OVER {ahead} AS l FROM log) SELECT attempt, id, coalesce(nxt - t, -1) AS pause, coalesce(list_position(l, 'view'), 0)::BIGINT AS steps FROM a WHERE message = 'view'""")
    def eval_followed(spark, d):
        return followed(log(spark, d), F.col("message") == "view", "message")

    @query(f"""WITH {log_sql}, s AS (SELECT *, sum((message = 'error')::INT) OVER (PARTITION BY attempt ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS seen FROM log)
SELECT attempt, count_if(message = 'error')::BIGINT AS hints, count_if(message = 'click' AND seen = 0)::BIGINT AS before_first, count_if(message = 'click')::BIGINT AS edits FROM s GROUP BY 1""")
    def eval_usage(spark, d):
        return usage(log(spark, d), F.col("message") == "error", F.col("message") == "click")

    @query("SELECT user_id AS attempt FROM events GROUP BY 1 HAVING bool_or(value > 90) AND NOT bool_or(value < 1 AND value IS NOT NULL)")
    def eval_training_set(spark, d):
        return training_and_requests(log(spark, d), F.col("value") > 90, F.col("value") < 1)[0]

    @query("SELECT user_id AS attempt FROM events WHERE value < 1 GROUP BY 1")
    def eval_request_set(spark, d):
        return training_and_requests(log(spark, d), F.col("value") > 90, F.col("value") < 1)[1]

    @query(f"""WITH {log_sql}, c AS (SELECT attempt, count(*) AS n FROM log GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n) AS r, count(*) OVER () AS m FROM c) SELECT min(n) AS least, max(CASE WHEN r = m // 2 + 1 THEN n END) AS median, max(n) AS most FROM r""")
    def eval_edit_counts(spark, d):
        from .stats import upper_median_of

        rows = log(spark, d).groupBy("attempt").agg(F.count("*").alias("n"))
        return rows.agg(F.min("n").alias("least"), F.max("n").alias("most")).join(F.broadcast(upper_median_of(rows, [], "n"))).select("least", "median", "most")

    @query("SELECT c_custkey, right(c_name, 8) AS suffix, CASE WHEN c_acctbal < 0 THEN 'HOMEWORK' ELSE 'IN-LAB' END AS level FROM customer")
    def level_and_suffix(spark, d):
        rows = table(spark, d, "customer")
        return rows.select("c_custkey", F.expr("right(c_name, 8)").alias("suffix"), F.when(F.col("c_acctbal") < 0, "HOMEWORK").otherwise("IN-LAB").alias("level"))

    @query("SELECT r_name AS user, assignment, points / 10.0 AS grade FROM (SELECT r_name, r_regionkey::DOUBLE AS first, (2 * r_regionkey)::DOUBLE AS second FROM region) UNPIVOT (points FOR assignment IN (first, second))")
    def unpivoted_grades(spark, d):
        rows = table(spark, d, "region").select(F.col("r_name").alias("user"), F.col("r_regionkey").cast("double").alias("first"), (2 * F.col("r_regionkey")).cast("double").alias("second"))
        return rows.unpivot(["user"], ["first", "second"], "assignment", "points").select("user", "assignment", (F.col("points") / 10).alias("grade"))
