"""Queries over the driver's tables: each applies an operator to a whole table, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluation, joins, stats, trace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: The log of the events table, as trace.log_of gives it.
LOG = "log AS (SELECT user_id AS attempt, event_id AS id, floor(epoch(ts))::BIGINT AS t, event_type AS message, value, props FROM events)"
W = "(PARTITION BY attempt ORDER BY t, id)"
UP = "(PARTITION BY attempt ORDER BY t, id ROWS UNBOUNDED PRECEDING)"
GAPS = f"{LOG}, g AS (SELECT *, t - lag(t) OVER {W} AS gap FROM log)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def on_log(name: str, make: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """Registers a query over the event log."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(trace.log_of(table(spark, sf_dir, "events")))

    run.__name__ = name
    query(sql)(run)


def _r(*cols: str) -> list:
    return [F.round(c, 9).alias(c) for c in cols]


# --- time and position ---
on_log("trace_profile", trace.time_profile, f"""WITH {GAPS} SELECT attempt, sum(CASE WHEN gap < 300 THEN gap - greatest(gap - 60, 0) ELSE 0 END)::BIGINT AS active,
sum(CASE WHEN gap < 300 THEN greatest(gap - 60, 0) ELSE 0 END)::BIGINT AS idle, sum(CASE WHEN gap IS NULL OR gap >= 300 THEN 1 ELSE 0 END)::BIGINT AS segments FROM g GROUP BY 1""")
on_log("trace_running_time", lambda x: trace.running_time(x).select("attempt", "id", "active", "segment"), f"""WITH {GAPS} SELECT attempt, id,
sum(CASE WHEN gap < 300 THEN gap - greatest(gap - 60, 0) ELSE 0 END) OVER {UP}::BIGINT AS active, sum(CASE WHEN gap IS NULL OR gap >= 300 THEN 1 ELSE 0 END) OVER {UP}::BIGINT AS segment FROM g""")
on_log("trace_edit_time", lambda x: trace.edit_time(x, F.col("message").isin("click", "view")), f"""WITH {LOG}, g AS (SELECT *, t - lag(t) OVER {W} AS gap FROM log WHERE message IN ('click', 'view'))
SELECT attempt, coalesce(sum(CASE WHEN gap <= 180 THEN gap END), 0)::BIGINT AS active, coalesce(sum(CASE WHEN gap > 180 THEN gap END), 0)::BIGINT AS idle FROM g GROUP BY 1""")
on_log("trace_minutes", lambda x: trace.minutes(x).select("attempt", "bucket", "id"), f"""WITH {GAPS}, a AS (SELECT *, sum(CASE WHEN gap < 300 THEN gap - greatest(gap - 60, 0) ELSE 0 END) OVER {UP} AS active FROM g),
b AS (SELECT attempt, id, t, (active // 60)::BIGINT AS bucket FROM a) SELECT attempt, bucket, id FROM b QUALIFY row_number() OVER (PARTITION BY attempt, bucket ORDER BY t, id) = 1""")
on_log("trace_positions", lambda x: trace.positions(x).select("attempt", "id", "place", *_r("fraction")), f"""WITH {LOG} SELECT attempt, id, row_number() OVER {W} AS place,
round(row_number() OVER {W} / count(*) OVER (PARTITION BY attempt), 9) AS fraction FROM log""")
on_log("trace_changes", lambda x: trace.changes(x, "message").select("attempt", "id", "message"), f"""WITH {LOG} SELECT attempt, id, message FROM log QUALIFY lag(message) OVER {W} IS DISTINCT FROM message OR row_number() OVER {W} = 1""")
on_log("trace_next_flags", lambda x: x.select("attempt", "id", F.coalesce(F.lead("message").over(trace.trace()) == "error", F.lit(False)).alias("error_next"), F.coalesce(F.lag("message").over(trace.trace()) != F.col("message"), F.lit(True)).alias("changed")),
       f"WITH {LOG} SELECT attempt, id, coalesce(lead(message) OVER {W} = 'error', false) AS error_next, coalesce(lag(message) OVER {W} <> message, true) AS changed FROM log")
on_log("trace_first_seen", lambda x: trace.first_seen(x, "message"), f"""WITH {LOG}, f AS (SELECT attempt, message, min(struct_pack(t := t, id := id)) AS o FROM log GROUP BY 1, 2)
SELECT attempt, message, dense_rank() OVER (PARTITION BY attempt ORDER BY o) - 1 AS code FROM f""")
on_log("trace_first_counts", lambda x: trace.first_counts(x, "message"), f"WITH {LOG} SELECT attempt, message, row_number() OVER (PARTITION BY attempt, message ORDER BY t, id) AS n, row_number() OVER {W} AS place FROM log")
on_log("trace_first_times", lambda x: trace.first_times(x, "message"), f"""WITH {LOG}, f AS (SELECT attempt, message, min(struct_pack(t := t, id := id)) AS o FROM log GROUP BY 1, 2)
SELECT attempt, message, o.t AS t, o.t - coalesce(lag(o.t) OVER (PARTITION BY attempt ORDER BY o), min(o.t) OVER (PARTITION BY attempt)) AS since FROM f""")
on_log("trace_cut_after_gap", lambda x: trace.cut_after_gap(x, 7200).select("attempt", "id"), f"""WITH {GAPS}, p AS (SELECT *, row_number() OVER {W} AS place, row_number() OVER {W} / count(*) OVER (PARTITION BY attempt) AS f FROM g),
s AS (SELECT *, min(CASE WHEN gap >= 7200 AND f > 0.65 THEN place END) OVER (PARTITION BY attempt) AS stop FROM p) SELECT attempt, id FROM s WHERE stop IS NULL OR place < stop""")
on_log("trace_accumulated", lambda x: trace.accumulated(x, {"bought": F.col("message") == "purchase", "failed": F.col("message") == "error", "large": F.col("value") > 50}).select("attempt", "id", "bought", "failed", "large", "flips"),
       f"""WITH {LOG}, m AS (SELECT attempt, id, t, max((message = 'purchase')::INT) OVER {UP} AS bought, max((message = 'error')::INT) OVER {UP} AS failed, max(coalesce(value > 50, false)::INT) OVER {UP} AS large FROM log)
SELECT attempt, id, bought, failed, large, (bought - coalesce(lag(bought) OVER {W}, 0) + failed - coalesce(lag(failed) OVER {W}, 0) + large - coalesce(lag(large) OVER {W}, 0))::INT AS flips FROM m""")
on_log("trace_thinned", lambda x: trace.thinned(x.select("attempt", "id", "t", "message"), 3600, "message").select("attempt", "id"), f"""WITH RECURSIVE {LOG}, o AS (SELECT attempt, id, t, message, row_number() OVER {W} AS n, count(*) OVER (PARTITION BY attempt) AS m FROM log),
r AS (SELECT attempt, id, n, m, t AS t0, message AS s0, true AS kept FROM o WHERE n = 1
UNION ALL SELECT o.attempt, o.id, o.n, o.m, CASE WHEN o.n = o.m OR (o.t - r.t0 >= 3600 AND o.message <> r.s0) THEN o.t ELSE r.t0 END, CASE WHEN o.n = o.m OR (o.t - r.t0 >= 3600 AND o.message <> r.s0) THEN o.message ELSE r.s0 END,
o.n = o.m OR (o.t - r.t0 >= 3600 AND o.message <> r.s0) FROM r JOIN o ON o.attempt = r.attempt AND o.n = r.n + 1) SELECT attempt, id FROM r WHERE kept""")
on_log("trace_rate_limited", lambda x: trace.rate_limited(x.select("attempt", "id", "t", "message"), 30, "message").select("attempt", "id"), f"""WITH RECURSIVE {LOG}, o AS (SELECT attempt, id, t, message, row_number() OVER {W} AS n, min(t) OVER (PARTITION BY attempt) AS b, max(t) OVER (PARTITION BY attempt) AS e FROM log),
r AS (SELECT attempt, id, n, CASE WHEN b = e THEN t END AS t0, CASE WHEN b = e THEN [message] ELSE []::VARCHAR[] END AS seen, b = e AS kept FROM o WHERE n = 1
UNION ALL SELECT o.attempt, o.id, o.n, CASE WHEN k.ok THEN o.t ELSE r.t0 END, CASE WHEN k.ok THEN list_append(r.seen, o.message) ELSE r.seen END, k.ok
FROM r JOIN o ON o.attempt = r.attempt AND o.n = r.n + 1, LATERAL (SELECT (r.t0 IS NULL OR o.t - r.t0 >= 30) AND NOT list_contains(r.seen, o.message) AND (o.b = o.e OR (o.t - o.b) / (o.e - o.b) >= 0.2) AS ok) k) SELECT attempt, id FROM r WHERE kept""")
on_log("trace_unstable", lambda x: trace.unstable(x.select("attempt", "id", "t", "message", "props"), F.col("message") == "view", "props").select("attempt", "id", "fresh"), f"""WITH {GAPS}, n AS (SELECT *, (row_number() OVER (PARTITION BY attempt, props ORDER BY t, id) = 1)::INT AS new, message = 'view' AS s FROM g),
c AS (SELECT *, sum(new) OVER {UP}::BIGINT AS seen FROM n), l AS (SELECT *, seen - coalesce(last_value(CASE WHEN s THEN seen END IGNORE NULLS) OVER (PARTITION BY attempt ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fresh FROM c)
SELECT attempt, id, fresh FROM l WHERE s AND gap >= 20 AND fresh >= 5""")

# --- as-of joins ---
on_log("asof_carried", lambda x: trace.carried(x, F.when(F.col("message") == "purchase", F.col("id")), "last_purchase").select("attempt", "id", F.coalesce("last_purchase", F.lit(-1)).alias("last_purchase")), f"WITH {LOG} SELECT attempt, id, coalesce(last_value(CASE WHEN message = 'purchase' THEN id END IGNORE NULLS) OVER {UP}, -1) AS last_purchase FROM log")
on_log("asof_looked_ahead", lambda x: trace.looked_ahead(x, F.col("message") == "error", F.col("message") == "view"), f"""WITH {LOG}, n AS (SELECT *, sum((message = 'view')::INT) OVER {UP} AS n FROM log)
SELECT a.attempt, a.id, (b.n - a.n)::BIGINT AS step, b.id AS found_id FROM n a JOIN n b ON a.attempt = b.attempt AND b.n BETWEEN a.n + 1 AND a.n + 5 WHERE a.message = 'error' AND b.message = 'view'""")
on_log("asof_looked_back", lambda x: trace.looked_back(x, "props").select("attempt", "id", F.coalesce("earlier_id", F.lit(-1)).alias("earlier_id")), f"WITH {LOG} SELECT attempt, id, coalesce(lag(id) OVER (PARTITION BY attempt, props ORDER BY t, id), -1) AS earlier_id FROM log")

# --- filters ---
on_log("filter_states_only", lambda x: x.where("value is not null and message <> 'error'").select("attempt", "id"), f"WITH {LOG} SELECT attempt, id FROM log WHERE value IS NOT NULL AND message <> 'error'")
on_log("filter_without_grabs", lambda x: trace.without_grabs(x, F.col("value").isNotNull(), F.col("message") == "click").select("attempt", "id"), f"WITH {LOG} SELECT attempt, id FROM log QUALIFY NOT (message = 'click' AND value IS NOT NULL AND coalesce(lead(value IS NOT NULL) OVER {W}, false))")
on_log("filter_up_to_last", lambda x: trace.up_to_last(x, F.col("message") == "purchase").select("attempt", "id"), f"""WITH {LOG}, p AS (SELECT *, row_number() OVER {W} AS place FROM log) SELECT attempt, id FROM p QUALIFY place <= max(CASE WHEN message = 'purchase' THEN place END) OVER (PARTITION BY attempt)""")
on_log("filter_long_enough", lambda x: trace.long_enough(x, 3, 300).select("attempt", "id"), f"WITH {LOG} SELECT attempt, id FROM log QUALIFY count(*) OVER (PARTITION BY attempt) > 3 AND max(t) OVER (PARTITION BY attempt) - min(t) OVER (PARTITION BY attempt) >= 300")
on_log("filter_date_range", lambda x: x.where((F.col("ts") >= F.lit("2024-01-03").cast("timestamp_ntz")) & ((F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")) | (F.col("message") == "purchase"))).select("attempt", "id"),
       "SELECT user_id AS attempt, event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND (ts < TIMESTAMP '2024-01-20' OR event_type = 'purchase')")


@query(f"""WITH {LOG}, b AS (SELECT attempt, max(CASE WHEN message = 'signup' THEN id END) AS after, min(CASE WHEN message = 'view' THEN id END) AS start FROM log GROUP BY 1)
SELECT attempt, id FROM log JOIN b USING (attempt) WHERE (after IS NULL OR id > after) AND (start IS NULL OR id >= start)""")
def filter_between_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = trace.log_of(table(spark, sf_dir, "events"))
    bounds = log.groupBy("attempt").agg(F.max(F.when(F.col("message") == "signup", F.col("id"))).alias("after"), F.min(F.when(F.col("message") == "view", F.col("id"))).alias("start"))
    return trace.between_ids(log, bounds).select("attempt", "id")


# --- aggregates ---
on_log("agg_counts", lambda x: x.groupBy("message").agg(F.count("*").alias("n"), F.count_distinct("attempt").alias("attempts")), f"WITH {LOG} SELECT message, count(*) AS n, count(DISTINCT attempt) AS attempts FROM log GROUP BY 1")
on_log("agg_profile", lambda x: x.groupBy("attempt").agg(F.count_if(F.col("message") == "error").alias("errors"), F.count_if(F.col("message") == "view").alias("views"), F.min(F.when(F.col("message") == "purchase", F.col("t"))).alias("first_purchase"), F.count_distinct("props").alias("kinds"), F.round(F.sum("value"), 4).alias("total")),
       f"WITH {LOG} SELECT attempt, count_if(message = 'error')::BIGINT AS errors, count_if(message = 'view')::BIGINT AS views, min(CASE WHEN message = 'purchase' THEN t END) AS first_purchase, count(DISTINCT props) AS kinds, round(sum(value), 4) AS total FROM log GROUP BY 1")
on_log("agg_repeats", lambda x: stats.repeats(x, "props"), f"""WITH {LOG}, r AS (SELECT attempt, row_number() OVER (PARTITION BY attempt, props ORDER BY t, id) AS n, lag(props) OVER {W} IS NOT DISTINCT FROM props AS p FROM log)
SELECT attempt, count(*) AS shown, count_if(n > 1)::BIGINT AS duplicates, count_if(p)::BIGINT AS repeated FROM r GROUP BY 1""")
on_log("agg_grade", lambda x: stats.grade(x.select("attempt", F.when(F.col("message") == "purchase", 2).when(F.col("message") == "click", 1).when(F.col("message") == "error", 0).alias("score"))).select("attempt", *_r("average", "partial")),
       f"""WITH {LOG}, s AS (SELECT attempt, CASE message WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 WHEN 'error' THEN 0 END AS score FROM log)
SELECT attempt, round(CASE WHEN count(score) > 0 THEN count_if(score = 2) / count(score) ELSE 0 END, 9) AS average, round(CASE WHEN count(score) > 0 THEN sum(score) / (2 * count(score)) ELSE 0 END, 9) AS partial FROM s GROUP BY 1""")
on_log("agg_duplicate_share", lambda x: stats.duplicate_share(x, "props").select("states", "shared", *_r("by_state", "by_attempt", "by_row")), f"""WITH {LOG}, b AS (SELECT props, attempt, count(*) AS n FROM log GROUP BY 1, 2), o AS (SELECT props, count(*) AS a, sum(n) AS n FROM b GROUP BY 1)
SELECT count(*) AS states, count_if(a > 1)::BIGINT AS shared, round(avg((a > 1)::INT), 9) AS by_state, round(sum(CASE WHEN a > 1 THEN a ELSE 0 END) / sum(a), 9) AS by_attempt, round(sum(CASE WHEN a > 1 THEN n ELSE 0 END) / sum(n), 9) AS by_row FROM o""")
VERTICES = f"""{LOG}, l AS (SELECT attempt, arg_max(props, struct_pack(t := t, id := id)) AS last FROM log GROUP BY 1),
v AS (SELECT props, count(*) AS weight, count_if(props = last)::BIGINT AS goals FROM (SELECT DISTINCT attempt, props FROM log) JOIN l USING (attempt) GROUP BY 1)"""
EDGES = f"""c AS (SELECT * FROM log QUALIFY lag(props) OVER {W} IS DISTINCT FROM props OR row_number() OVER {W} = 1), tr AS (SELECT attempt, lag(props) OVER {W} AS source, props AS target FROM c),
e AS (SELECT source, target, count(*) AS weight FROM (SELECT DISTINCT * FROM tr WHERE source IS NOT NULL) GROUP BY 1, 2)"""
on_log("graph_vertex_weights", lambda x: stats.vertex_weights(x, "props"), f"WITH {VERTICES} SELECT props, weight, goals FROM v")
on_log("graph_edge_weights", lambda x: stats.edge_weights(x, "props"), f"WITH {LOG}, {EDGES} SELECT source, target, weight FROM e")
on_log("graph_edge_probabilities", lambda x: stats.edge_probabilities(stats.edge_weights(x, "props")).select("source", "target", "weight", *_r("p")), f"WITH {LOG}, {EDGES} SELECT source, target, weight, round(weight / sum(weight) OVER (PARTITION BY source), 9) AS p FROM e")
on_log("graph_degrees", lambda x: stats.degrees(stats.edge_weights(x, "props")), f"WITH {LOG}, {EDGES}, b AS (SELECT target AS state, weight AS i, 0 AS o FROM e UNION ALL SELECT source, 0, weight FROM e) SELECT state, sum(i)::BIGINT AS weight_in, sum(o)::BIGINT AS weight_out FROM b GROUP BY 1")
on_log("graph_pruned", lambda x: stats.pruned(stats.vertex_weights(x, "props"), stats.edge_weights(x, "props"), "props", 60), f"WITH {VERTICES}, {EDGES}, k AS (SELECT props FROM v WHERE weight >= 60 OR goals > 0) SELECT source, target, weight FROM e WHERE source IN (FROM k) AND target IN (FROM k)")
on_log("agg_last_states", lambda x: stats.last_states(x, "props"), f"WITH {LOG}, l AS (SELECT attempt, arg_max(props, struct_pack(t := t, id := id)) AS props FROM log GROUP BY 1) SELECT props, count(*) AS n FROM l GROUP BY 1")
FIRST = f"{LOG}, f AS (SELECT attempt, message, min(struct_pack(t := t, id := id)) AS o FROM log GROUP BY 1, 2)"
on_log("agg_pair_order", lambda x: stats.pair_order(x, "message").select("a", "b", "n", *_r("before")), f"""WITH {FIRST}, c AS (SELECT message FROM f GROUP BY 1 HAVING count(*) >= 0.3 * (SELECT count(DISTINCT attempt) FROM f))
SELECT x.message AS a, y.message AS b, count(*) AS n, round(avg((x.o < y.o)::INT), 9) AS before FROM f x JOIN f y ON x.attempt = y.attempt AND x.message <> y.message WHERE x.message IN (FROM c) AND y.message IN (FROM c) GROUP BY 1, 2""")
on_log("agg_order_deviation", lambda x: stats.order_deviation(x, "message").select("message", *_r("mean", "sd")), f"WITH {FIRST}, r AS (SELECT message, row_number() OVER (PARTITION BY attempt ORDER BY o) AS r FROM f) SELECT message, round(avg(r), 9) AS mean, round(stddev_pop(r), 9) AS sd FROM r GROUP BY 1")
on_log("agg_median_gap", lambda x: stats.upper_median_of(trace.gaps(x), ["message"], "gap"), f"WITH {GAPS}, r AS (SELECT message, gap, row_number() OVER (PARTITION BY message ORDER BY gap) AS r, count(*) OVER (PARTITION BY message) AS n FROM g WHERE gap IS NOT NULL) SELECT message, gap AS median FROM r WHERE r = n // 2 + 1")
on_log("agg_follower_overlap", lambda x: stats.follower_overlap(x, "props", "attempt").select("a", "b", F.col("both").alias("common"), "either", *_r("jaccard")), f"""WITH {LOG}, d AS (SELECT DISTINCT props, attempt FROM log), s AS (SELECT props, count(*) AS n FROM d GROUP BY 1),
j AS (SELECT x.props AS a, y.props AS b, count(*) AS c FROM d x JOIN d y ON x.attempt = y.attempt AND x.props < y.props GROUP BY 1, 2)
SELECT a, b, c AS common, sa.n + sb.n - c AS either, round(c / (sa.n + sb.n - c), 9) AS jaccard FROM j JOIN s sa ON sa.props = a JOIN s sb ON sb.props = b""")


@query(f"""WITH {LOG}, c AS (SELECT attempt, message, count(*) AS n FROM log GROUP BY 1, 2), a AS (SELECT count(DISTINCT attempt) AS n FROM log),
r AS (SELECT message, unnest(range(1, n + 1)) AS least FROM c) SELECT message, least, count(*) AS followers FROM r GROUP BY 1, 2 HAVING count(*) >= ceil(0.4 * (SELECT n FROM a)) AND count(*) < (SELECT n FROM a)""")
def mine_rule_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = trace.log_of(table(spark, sf_dir, "events"))
    n = log.select("attempt").distinct().count()
    return stats.rule_support(log.groupBy("attempt", "message").count(), "message", n, 0.4)


@query("""WITH c AS (SELECT toxic = 1 AS a, quality = 0 AS s FROM labels), k AS (SELECT count_if(a AND s)::BIGINT AS tp, count_if(NOT a AND s)::BIGINT AS fp, count_if(a AND NOT s)::BIGINT AS fn, count_if(NOT a AND NOT s)::BIGINT AS tn FROM c)
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall FROM k""")
def agg_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select((F.col("toxic") == 1).alias("a"), (F.col("quality") == 0).alias("s"))
    return stats.confusion(rows, "a", "s").select("tp", "fp", "fn", "tn", *_r("precision", "recall"))


@query("SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('s' || c_custkey::VARCHAR), c_custkey) <= 5")
def sample_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.hashed_sample(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_custkey", 5).select("c_nationkey", "c_custkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def topk_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k % 3 = 0")
def sample_every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("k", k).where("k % 3 = 0").select("o_orderkey")


@query("SELECT p_type, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS place FROM part GROUP BY 1")
def types_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return n.select("p_type", "n", F.rank().over(Window.orderBy(F.desc("n"))).cast("long").alias("place"))


@query("SELECT l_orderkey, min_by(l_linenumber, l_extendedprice) AS line FROM (SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_extendedprice) = 1) GROUP BY 1")
def best_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    one = rows.withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey", "l_extendedprice"))).where("n = 1")
    return one.groupBy("l_orderkey").agg(F.min_by("l_linenumber", "l_extendedprice").alias("line"))


# --- joins ---
joins.register(query, table)
evaluation.register(query, table)


def _modules() -> list:
    from . import attempts, more, outputs, shapes

    return [more, attempts, outputs, shapes]


def queries() -> dict[str, Query]:
    out = dict(QUERIES)
    for m in _modules():
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = dict(SQL)
    for m in _modules():
        out |= m.SQL
    return out
