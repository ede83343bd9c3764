"""Queries of filters, spans, subgoals, orders and matrices over the event log and the order tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import filters, stats, trace
from .registry import GAPS, LOG, UP, W, _r, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _log(spark, d):
    return trace.log_of(table(spark, d, "events"))


def _bought():
    return F.col("message") == "purchase"


def _failed():
    return F.col("message") == "error"


START = 1704067200  # the first day of 2024


# --- attempts ---
@query(f"""WITH {LOG}, a AS (SELECT attempt, bool_or(message = 'purchase') AS s, min(t) AS b, count(*) AS n FROM log WHERE attempt NOT IN (1, 2, 3) GROUP BY 1)
SELECT attempt, id FROM log JOIN a USING (attempt) WHERE s AND b > {START + 600} AND n > 3""")
def filter_by_attempts(spark, d):
    how = [filters.submitted_only(_bought()), filters.started_after(START + 600), filters.more_rows_than(3)]
    return filters.kept(_log(spark, d), how, (1, 2, 3)).select("attempt", "id")


@query(f"""WITH {LOG}, a AS (SELECT attempt FROM log GROUP BY 1 HAVING bool_or(message = 'purchase') OR count(*) >= 12) SELECT attempt, id FROM log SEMI JOIN a USING (attempt)""")
def filter_likely_submitted(spark, d):
    return filters.kept(_log(spark, d), [filters.likely_submitted(_bought(), 12)]).select("attempt", "id")


PARTS = "s AS (SELECT o_custkey AS attempt, year(o_orderdate) AS ord, arg_max(o_orderpriority, o_orderkey) AS location, max(o_orderkey) AS r FROM orders GROUP BY 1, 2)"


@query(f"""WITH {PARTS} SELECT a.attempt, a.ord, arg_max(b.r, b.ord) AS "end" FROM s a JOIN s b ON a.attempt = b.attempt AND b.ord < a.ord AND a.location = b.location AND b.r < a.r GROUP BY 1, 2""")
def filter_prequel_ends(spark, d):
    o = table(spark, d, "orders")
    parts = o.groupBy(F.col("o_custkey").alias("attempt"), F.year("o_orderdate").cast("long").alias("ord")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("location"), F.max("o_orderkey").alias("row"))
    return filters.prequel_ends(parts)


@query(f"""WITH {LOG}, p AS (SELECT *, row_number() OVER {W} AS place FROM log), s AS (SELECT *, max(CASE WHEN message = 'view' THEN place END) OVER (PARTITION BY attempt) AS last, min(CASE WHEN message = 'purchase' THEN place END) OVER (PARTITION BY attempt) AS stop FROM p)
SELECT attempt, id FROM s WHERE place <= last AND (stop IS NULL OR place <= stop)""")
def filter_export_gated(spark, d):
    return filters.export_gated(_log(spark, d), F.col("message") == "view", _bought()).select("attempt", "id")


@query(f"""WITH {GAPS}, a AS (SELECT attempt, count(*) AS n, max(t) - min(t) AS d, sum(CASE WHEN gap < 300 THEN gap - greatest(gap - 60, 0) ELSE 0 END)::BIGINT AS active FROM g GROUP BY 1)
SELECT attempt, CASE WHEN d >= 86400 THEN n ELSE 0 END AS rows, CASE WHEN d >= 86400 THEN active ELSE 0 END AS active FROM a""")
def filter_short_emptied(spark, d):
    return filters.emptied_if_short(_log(spark, d), 86400)


GRADES = "gr AS (SELECT attempt, count_if(score = 2) / count(score) AS average FROM (SELECT attempt, CASE message WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 WHEN 'error' THEN 0 END AS score FROM log) GROUP BY 1 HAVING count(score) > 0)"


def _grades(log):
    score = F.when(_bought(), 2).when(F.col("message") == "click", 1).when(_failed(), 0)
    return stats.grade(log.select("attempt", score.alias("score")).where("score is not null"))


@query(f"WITH {LOG}, {GRADES} SELECT attempt, id FROM log SEMI JOIN (SELECT attempt FROM gr WHERE average >= 0.3 AND attempt <> 7) USING (attempt)")
def filter_graded(spark, d):
    log = _log(spark, d)
    return filters.graded(log, _grades(log), 0.3, (7,)).select("attempt", "id")


HINTS = "(message = 'error' OR (message = 'click' AND (props->>'$.k')::BIGINT >= 90))"


def _hints(log):
    return filters.hint_rows(log, ["error"], ["click"], F.get_json_object("props", "$.k").cast("long") >= 90)


@query(f"WITH {LOG} SELECT attempt, id, message = 'error' AS dialog FROM log WHERE {HINTS}")
def filter_hint_rows(spark, d):
    return _hints(_log(spark, d)).select("attempt", "id", "dialog")


@query(f"WITH {LOG} SELECT attempt, count(*) AS n FROM log ANTI JOIN (SELECT attempt FROM log WHERE message = 'click' AND (props->>'$.k')::BIGINT >= 90) h USING (attempt) GROUP BY 1")
def filter_without_hints(spark, d):
    log = _log(spark, d)
    return filters.without_hints(log, _hints(log).where("not dialog")).groupBy("attempt").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) = 1")
def filter_first_of_place(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey")
    return filters.first_of_place(rows, ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey"])


# --- along the trace ---
@query(f"""WITH {GAPS}, a AS (SELECT *, sum(CASE WHEN gap < 300 THEN gap - greatest(gap - 60, 0) ELSE 0 END) OVER {UP}::BIGINT AS active, row_number() OVER {W} AS place, count(*) OVER (PARTITION BY attempt) AS n FROM g),
m AS (SELECT *, max(active) OVER (PARTITION BY attempt) AS total FROM a) SELECT attempt, id, ((place - 1) * 50 // n)::BIGINT AS slice, round(CASE WHEN total > 0 THEN active / total ELSE 0 END, 9) AS done FROM m""")
def trace_slices(spark, d):
    return trace.slices(_log(spark, d)).select("attempt", "id", "slice", *_r("done"))


@query(f"""WITH {LOG}, m AS (SELECT *, CASE WHEN message = 'view' THEN 1 WHEN message = 'purchase' THEN 0 END AS mark FROM log),
c AS (SELECT *, last_value(CASE WHEN mark IS NOT NULL THEN struct_pack(o := mark, v := id) END IGNORE NULLS) OVER {UP} AS now, last_value(CASE WHEN mark IS NOT NULL THEN struct_pack(o := mark, v := id) END IGNORE NULLS) OVER (PARTITION BY attempt ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM m),
h AS (SELECT attempt, id, CASE WHEN message = 'purchase' THEN was ELSE now END AS held FROM c) SELECT attempt, id, coalesce(CASE WHEN held.o = 1 THEN held.v END, -1) AS opened FROM h""")
def trace_spans(spark, d):
    rows = trace.spans(_log(spark, d), F.col("message") == "view", _bought(), "id", "opened")
    return rows.select("attempt", "id", F.coalesce("opened", F.lit(-1)).alias("opened"))


@query(f"""WITH {LOG}, l AS (SELECT *, lag(message) OVER {W} = 'signup' AS marked, lag(message, 2) OVER {W} AS before FROM log) SELECT attempt, id, before, message FROM l WHERE marked AND before IS NOT NULL AND before <> message""")
def trace_switches(spark, d):
    return filters.switches(_log(spark, d), "message", F.col("message") == "signup").select("attempt", "id", "before", "message")


@query(f"""WITH {LOG}, e AS (SELECT attempt, id, t, 'large' AS test, coalesce(value > 50, false) AS ok FROM log UNION ALL SELECT attempt, id, t, 'bought', message = 'purchase' FROM log)
SELECT attempt, test, coalesce(min(CASE WHEN ok THEN t END), -1) AS finish, arg_max(ok, struct_pack(t := t, id := id)) AS at_end FROM e GROUP BY 1, 2""")
def trace_subgoals(spark, d):
    found = trace.subgoals(_log(spark, d), {"large": F.col("value") > 50, "bought": _bought()})
    return found.select("attempt", "test", F.coalesce("finish", F.lit(-1)).alias("finish"), "at_end")


TIMES = f"""{LOG}, e AS (SELECT attempt, id, t, 'small' AS feature, coalesce(value < 30, false)::INT AS ok FROM log UNION ALL SELECT attempt, id, t, 'calm', (message <> 'error')::INT FROM log),
l AS (SELECT *, min(ok) OVER (PARTITION BY attempt, feature ORDER BY t, id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS k FROM e), ft AS (SELECT attempt, feature, arg_min(t, struct_pack(t := t, id := id)) AS t FROM l WHERE k = 1 GROUP BY 1, 2)"""


def _times(spark, d):
    return trace.lasting_times(_log(spark, d), {"small": F.col("value") < 30, "calm": ~_failed()})


@query(f"WITH {TIMES} SELECT attempt, feature, t FROM ft")
def trace_lasting_times(spark, d):
    return _times(spark, d)


@query(f"WITH {TIMES} SELECT x.feature AS a, y.feature AS b, count(*) AS n, round(avg(x.t - y.t), 6) AS mean FROM ft x JOIN ft y ON x.attempt = y.attempt AND x.feature <> y.feature GROUP BY 1, 2")
def agg_timing_differences(spark, d):
    return stats.timing_differences(_times(spark, d)).select("a", "b", "n", F.round("mean", 6).alias("mean"))


# --- aggregates ---
@query(f"""WITH {LOG}, {GRADES}, l AS (SELECT count(DISTINCT p) AS n FROM (SELECT arg_max(props, struct_pack(t := t, id := id)) AS p FROM log GROUP BY attempt))
SELECT count(DISTINCT props) AS states, count(*) AS rows, (SELECT n FROM l) AS last_states, (SELECT round(avg(average), 9) FROM gr) AS mean, (SELECT round(min(average), 9) FROM gr) AS least, (SELECT count_if(average >= 1) FROM gr)::BIGINT AS perfect FROM log""")
def agg_state_summary(spark, d):
    log = _log(spark, d)
    return stats.state_summary(log, "props", _grades(log)).select("states", "rows", "last_states", *_r("mean", "least"), "perfect")


@query(f"""WITH {LOG}, b AS (SELECT DISTINCT props, attempt FROM log WHERE message = 'purchase'), n AS (SELECT props, count(*) AS n FROM b GROUP BY 1)
SELECT x.props AS a, y.props AS b, round(count(*) / any_value(n.n), 9) AS share FROM b x JOIN b y ON x.attempt = y.attempt AND x.props <> y.props JOIN n ON n.props = x.props GROUP BY 1, 2""")
def agg_dominance(spark, d):
    return stats.dominance(_log(spark, d).where(_bought()), "props", "attempt").select("a", "b", *_r("share"))


FIRST = f"{LOG}, f AS (SELECT attempt, message, min(struct_pack(t := t, id := id)) AS o FROM log GROUP BY 1, 2), r AS (SELECT attempt, message, row_number() OVER (PARTITION BY attempt ORDER BY o) AS r FROM f)"


@query(f"WITH {FIRST} SELECT x.message AS a, y.message AS b, round(stddev_pop(x.r - y.r), 9) AS sd FROM r x JOIN r y ON x.attempt = y.attempt AND x.message <> y.message GROUP BY 1, 2")
def agg_order_matrix(spark, d):
    return stats.order_matrix(_log(spark, d), "message").select("a", "b", *_r("sd"))


@query(f"""WITH {FIRST}, p AS (SELECT x.message AS a, y.message AS b, avg((x.r < y.r)::INT) AS before FROM r x JOIN r y ON x.attempt = y.attempt AND x.message <> y.message GROUP BY 1, 2), w AS (SELECT a, count_if(before > 0.5)::BIGINT AS wins FROM p GROUP BY 1)
SELECT a, wins, row_number() OVER (ORDER BY wins DESC, a) AS place FROM w""")
def rank_by_precedence(spark, d):
    return stats.copeland(stats.pair_order(_log(spark, d), "message", 0))


@query("""WITH c AS (SELECT o_custkey, o_orderkey, count(*) AS lines, 1 + (o_orderkey % 3) AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
e AS (SELECT o_custkey, lines, unnest(range(weight)) FROM c), r AS (SELECT o_custkey, lines, row_number() OVER (PARTITION BY o_custkey ORDER BY lines) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM e) SELECT o_custkey, lines AS median FROM r WHERE r = n // 2 + 1""")
def agg_weighted_median(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    rows = table(spark, d, "orders").join(lines, "o_orderkey").withColumn("weight", 1 + F.col("o_orderkey") % 3)
    return stats.median_by_weight(rows, ["o_custkey"], "lines", "weight")


@query(f"""WITH {LOG}, e AS (SELECT attempt, t, id, levenshtein(message, last_value(message) OVER (PARTITION BY attempt ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS far FROM log),
s AS (SELECT *, far - lag(far) OVER {W} AS step FROM e) SELECT attempt, count_if(step < 0)::BIGINT AS closer, count_if(step > 0)::BIGINT AS farther, round(avg(far), 9) AS mean FROM s GROUP BY 1""")
def agg_distance_to_end(spark, d):
    """How often a step comes closer to the last state, or goes farther from it."""
    whole = trace.trace().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = _log(spark, d).withColumn("far", F.levenshtein("message", F.last("message").over(whole))).withColumn("step", F.col("far") - F.lag("far").over(trace.trace()))
    return rows.groupBy("attempt").agg(F.count_if(F.col("step") < 0).alias("closer"), F.count_if(F.col("step") > 0).alias("farther"), F.round(F.avg("far"), 9).alias("mean"))


@query(f"""WITH {GAPS}, a AS (SELECT *, sum(CASE WHEN gap < 300 THEN gap - greatest(gap - 60, 0) ELSE 0 END) OVER {UP} AS active FROM g), b AS (SELECT *, (active // 60)::BIGINT AS bucket FROM a),
f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY attempt, bucket ORDER BY t, id) = 1) SELECT attempt, bucket, least(levenshtein(message, 'purchase'), levenshtein(message, 'preview'), levenshtein(message, 'click'))::BIGINT AS cost FROM f""")
def agg_progress_by_minute(spark, d):
    """Of the first action of each active minute, the cost of the best of the known solutions."""
    cost = F.least(*[F.levenshtein(F.col("message"), F.lit(x)) for x in ("purchase", "preview", "click")])
    return trace.minutes(_log(spark, d)).select("attempt", "bucket", cost.cast("long").alias("cost"))


@query(f"""WITH {LOG}, p AS (SELECT *, row_number() OVER {W} AS place FROM log), s AS (SELECT attempt, min(CASE WHEN message = 'purchase' THEN place END) AS step FROM p GROUP BY 1), m AS (SELECT step, row_number() OVER (ORDER BY step) AS r, count(*) OVER () AS n FROM s WHERE step IS NOT NULL)
SELECT attempt, coalesce(step, -1) AS step, coalesce(step - (SELECT step FROM m WHERE r = n // 2 + 1), 0) AS behind FROM s""")
def agg_solve_difference(spark, d):
    """At which step an attempt was solved, and how much later than the middle one."""
    from ..operators import evaluation

    steps = evaluation.solve_step(_log(spark, d), _bought())
    middle = stats.upper_median_of(steps.where("step > 0"), [], "step")
    return steps.join(F.broadcast(middle), how="left").select("attempt", "step", F.when(F.col("step") > 0, F.col("step") - F.col("median")).otherwise(0).alias("behind"))


# --- orders, samples, limits ---
@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice, len(p_type), p_partkey) AS place FROM part")
def rank_rules(spark, d):
    """Rules by support, then priority, then depth, then name."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_retailprice", F.length("p_type"), "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.row_number().over(w).cast("long").alias("place"))


@query(f"""WITH {LOG}, h AS (SELECT *, (t % 86400 < 43200)::INT AS half FROM log), r AS (SELECT *, row_number() OVER (PARTITION BY attempt, half ORDER BY md5('s' || id::VARCHAR), id) AS r FROM h) SELECT attempt, id FROM r QUALIFY row_number() OVER (PARTITION BY attempt ORDER BY r, half DESC) <= 2""")
def sample_early_late(spark, d):
    return stats.early_late(_log(spark, d), "attempt", F.col("t") % 86400 < 43200, "id").select("attempt", "id")


@query(f"WITH {LOG} SELECT attempt, id FROM log SEMI JOIN (SELECT DISTINCT attempt FROM log ORDER BY attempt LIMIT 10) USING (attempt)")
def limit_attempts(spark, d):
    log = _log(spark, d)
    return log.join(F.broadcast(log.select("attempt").distinct().orderBy("attempt").limit(10)), "attempt", "left_semi").select("attempt", "id")
