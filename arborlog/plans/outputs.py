"""Queries of the exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats, trace
from ..sources import exports, sinks
from .registry import LOG, W, table

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


TLOG = "log AS (SELECT user_id AS attempt, event_id AS id, floor(epoch(ts))::BIGINT AS t, event_type AS message, value, props, ts FROM events)"
SHOWN = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


@query(f"""WITH {TLOG} SELECT attempt AS student, 's-' || attempt || '-' || (t // 86400)::BIGINT AS session, {SHOWN} AS time, 'UTC' AS time_zone, CASE WHEN message = 'error' THEN 'HINT_REQUEST' ELSE 'ATTEMPT' END AS response_type,
CASE WHEN message = 'error' THEN 'HINT_MSG' ELSE 'RESULT' END AS tutor_response, CASE WHEN value > 50 THEN 'hard' ELSE 'easy' END AS level, 'shop' AS problem, message AS step, row_number() OVER (PARTITION BY attempt, message ORDER BY t, id) AS attempt_at_step,
CASE WHEN message = 'error' THEN 'HINT' ELSE 'CORRECT' END AS outcome, coalesce(props->>'$.k', '') AS selection, CASE WHEN lag(props) OVER {W} IS DISTINCT FROM props THEN props ELSE '' END AS code, id FROM log""")
def export_shop_rows(spark, d):
    return exports.shop_rows(_log(spark, d), "props", F.col("message") == "error", "shop", F.when(F.col("value") > 50, "hard").otherwise("easy"))


@query(f"""WITH {LOG}, f AS (SELECT attempt, message, props, min(struct_pack(t := t, id := id)) AS o FROM log GROUP BY 1, 2, 3) SELECT attempt, message, props, row_number() OVER (PARTITION BY attempt, message ORDER BY o) - 1 AS number FROM f""")
def export_anonymised_within(spark, d):
    return exports.anonymised(_log(spark, d), "message", "props", ["t", "id"], "attempt")


@query(f"""WITH {LOG}, f AS (SELECT message, props, min(struct_pack(t := t, id := id)) AS o FROM log GROUP BY 1, 2) SELECT message, props, row_number() OVER (PARTITION BY message ORDER BY o) - 1 AS number FROM f""")
def export_anonymised(spark, d):
    return exports.anonymised(_log(spark, d), "message", "props", ["t", "id"])


TYPES = "(VALUES ('click', 'File.Edit'), ('view', 'File.Open'), ('purchase', 'Submit')) AS ty(message, event_type)"


@query(f"""WITH {TLOG}, f AS (SELECT props, min(struct_pack(t := t, id := id)) AS o FROM log GROUP BY 1), c AS (SELECT props, row_number() OVER (ORDER BY o) - 1 AS code_id FROM f)
SELECT attempt::VARCHAR || '-' || id::VARCHAR AS event_id, attempt AS subject, row_number() OVER {W} AS "order", coalesce(event_type, 'X-' || message) AS event_type, code_id AS code_state, {SHOWN} AS server_time, 'editor' AS tool FROM log LEFT JOIN {TYPES} USING (message) JOIN c USING (props)""")
def export_event_rows(spark, d):
    types = spark.createDataFrame([("click", "File.Edit"), ("view", "File.Open"), ("purchase", "Submit")], "message string, event_type string")
    log = _log(spark, d)
    return exports.event_rows(log, types, sinks.code_dictionary(log, "props"), "props")


@query(f"WITH {LOG} SELECT message, count(*) AS n FROM log WHERE message NOT IN (SELECT message FROM {TYPES}) GROUP BY 1")
def export_unmapped_events(spark, d):
    types = spark.createDataFrame([("click", "File.Edit"), ("view", "File.Open"), ("purchase", "Submit")], "message string, event_type string")
    log = _log(spark, d)
    _, unmapped = sinks.mapped_events(log, types)
    return log.join(unmapped, "message").groupBy("message").agg(F.count("*").alias("n"))


@query(f"""WITH {LOG}, s AS (SELECT *, lag(id) OVER {W} IS NULL AS f, lead(id) OVER {W} IS NULL AS l, coalesce(lag(t // 86400) OVER {W} <> t // 86400, true) AS b, coalesce(lead(t // 86400) OVER {W} <> t // 86400, true) AS e FROM log),
x AS (SELECT attempt, id, t, 0 AS k, 'Session.Start' AS event FROM s WHERE b UNION ALL SELECT attempt, id, t, 1, 'Project.Open' FROM s WHERE f UNION ALL SELECT attempt, id, t, 2, message FROM s UNION ALL SELECT attempt, id, t, 3, 'Submit' FROM s WHERE message = 'purchase'
UNION ALL SELECT attempt, id, t, 4, 'Project.Close' FROM s WHERE l UNION ALL SELECT attempt, id, t, 5, 'Session.End' FROM s WHERE e) SELECT attempt, row_number() OVER (PARTITION BY attempt ORDER BY t, id, k) AS "order", event, id, t FROM x""")
def export_project_events(spark, d):
    return exports.project_events(_log(spark, d).withColumn("session", F.floor(F.col("t") / 86400)), F.col("message") == "purchase")


@query("""WITH g AS (SELECT o_custkey AS subject, year(o_orderdate)::VARCHAR AS assignment, o_orderstatus AS test, count(*) AS score FROM orders GROUP BY 1, 2, 3)
SELECT assignment, subject, coalesce(max(CASE WHEN test = 'F' THEN score END), -1) AS "F", coalesce(max(CASE WHEN test = 'O' THEN score END), -1) AS "O", coalesce(max(CASE WHEN test = 'P' THEN score END), -1) AS "P" FROM g GROUP BY 1, 2""")
def export_subject_links(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("subject"), F.year("o_orderdate").cast("string").alias("assignment"), F.col("o_orderstatus").alias("test")).agg(F.count("*").alias("score"))
    return exports.subject_links(rows, ["F", "O", "P"])


MESSAGES = ["click", "error", "purchase", "signup", "view"]


@query("SELECT a, " + ", ".join(f"levenshtein(a, '{m}')::BIGINT AS {m}" for m in MESSAGES) + " FROM (SELECT DISTINCT event_type AS a FROM events)")
def export_distance_matrix(spark, d):
    a = table(spark, d, "events").select(F.col("event_type").alias("a")).distinct()
    names = spark.createDataFrame([(m,) for m in MESSAGES], "b string")  # a fixed list
    return exports.distance_matrix(a.join(F.broadcast(names)).withColumn("distance", F.levenshtein("a", "b").cast("long")), MESSAGES)


@query(f"""WITH RECURSIVE {LOG}, o AS (SELECT attempt, id, t, message, row_number() OVER {W} AS n, count(*) OVER (PARTITION BY attempt) AS m FROM log),
r AS (SELECT attempt, id, t, n, t AS t0, message AS s0, true AS kept FROM o WHERE n = 1
UNION ALL SELECT o.attempt, o.id, o.t, o.n, CASE WHEN o.n = o.m OR (o.t - r.t0 >= 7200 AND o.message <> r.s0) THEN o.t ELSE r.t0 END, CASE WHEN o.n = o.m OR (o.t - r.t0 >= 7200 AND o.message <> r.s0) THEN o.message ELSE r.s0 END,
o.n = o.m OR (o.t - r.t0 >= 7200 AND o.message <> r.s0) FROM r JOIN o ON o.attempt = r.attempt AND o.n = r.n + 1) SELECT attempt, row_number() OVER (PARTITION BY attempt ORDER BY t, id) AS n, id, t FROM r WHERE kept""")
def export_intervals(spark, d):
    return exports.interval_rows(_log(spark, d), 7200, "message")


@query(f"""WITH {LOG}, l AS (SELECT attempt, arg_max(props, struct_pack(t := t, id := id)) AS state, arg_max(message, struct_pack(t := t, id := id)) AS context FROM log GROUP BY 1), g AS (SELECT state, 100.0 * count(*) AS value FROM l GROUP BY 1), c AS (SELECT state, context, count(*) AS n FROM l GROUP BY 1, 2),
r AS (SELECT state, value, row_number() OVER (ORDER BY value DESC, state) AS place FROM g) SELECT place, state, value::DOUBLE AS value, context, n FROM r JOIN c USING (state)""")
def export_goal_report(spark, d):
    last = _log(spark, d).groupBy("attempt").agg(F.max_by("props", F.struct("t", "id")).alias("state"), F.max_by("message", F.struct("t", "id")).alias("context"))
    goals = last.groupBy("state").agg((100.0 * F.count("*")).alias("value"))
    return exports.goal_report(goals, last)


@query(f"""WITH {LOG}, h AS (SELECT attempt, id, message, value, lead(message) OVER {W} AS nxt FROM log) SELECT attempt, id, CASE WHEN value IS NULL THEN '{{"error":true,"message":"no value"}}' ELSE '{{"from":"error","to":"' || coalesce(nxt, 'end') || '","type":"next","data":' || id || '}}' END AS json FROM h WHERE message = 'error'""")
def export_hint_responses(spark, d):
    rows = _log(spark, d).withColumn("next", F.coalesce(F.lead("message").over(trace.trace()), F.lit("end"))).where("message = 'error'")
    return exports.hint_response(rows, F.col("message"), F.col("next"), F.lit("next"), F.col("id"), F.when(F.col("value").isNull(), "no value")).select("attempt", "id", "json")


@query("""SELECT event_id, '=HYPERLINK("http://logs/' || user_id || '/' || event_id || '")' AS link FROM events""")
def export_links(spark, d):
    return table(spark, d, "events").select("event_id", exports.row_link("http://logs/", F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("link"))


@query("SELECT user_id % 7 AS assignment, substr(sha256(event_type || chr(10) || props), 1, 16) AS key, count(*) AS n FROM events GROUP BY 1, 2")
def export_capture_keys(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 7).alias("assignment"), exports.capture_key(F.col("event_type"), F.col("props")).alias("key"))
    return rows.groupBy("assignment", "key").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT user_id AS attempt, event_id AS id, CASE WHEN value > 50 THEN 'x' ELSE '' END AS hints, event_type AS found FROM events WHERE event_type = 'error' AND value IS NOT NULL)
SELECT attempt, '{' || string_agg('"' || id || '":"' || found || '"', ',' ORDER BY id::VARCHAR) || '}' AS json FROM r WHERE hints = '' GROUP BY 1""")
def export_repaired_hints(spark, d):
    rows = _log(spark, d).where("message = 'error' and value is not null").select("attempt", F.col("id").alias("row"), F.when(F.col("value") > 50, "x").otherwise("").alias("hints"), F.col("message").alias("found"))
    return exports.repaired_hints(rows.drop("found"), rows.drop("hints"))


@query(f"WITH {LOG} SELECT attempt AS id, count(*) AS size, max(t) - min(t) AS span FROM log WHERE t < 1704153600 GROUP BY 1")
def export_dashboard(spark, d):
    """What the dashboard shows of the attempts up to a time; its JSON is read back here."""
    profile = _log(spark, d).where("t < 1704153600").groupBy(F.col("attempt").alias("id")).agg(F.count("*").alias("size"), (F.max("t") - F.min("t")).alias("span"))
    return sinks.dashboard(profile).select(F.from_json("json", "id long, size long, span long").alias("x")).select("x.*")


@query(f"WITH {LOG}, s AS (SELECT attempt, message, count(*) AS n FROM log GROUP BY 1, 2), l AS (SELECT attempt, arg_max(message, struct_pack(t := t, id := id)) AS last FROM log GROUP BY 1) SELECT message, sum(n)::BIGINT AS n, count_if(last = message)::BIGINT AS ended FROM s JOIN l USING (attempt) GROUP BY 1")
def export_usage_table(spark, d):
    log = _log(spark, d)
    n = log.groupBy("message").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(stats.last_states(log, "message").withColumnRenamed("n", "ended")), "message", "left").select("message", "n", F.coalesce("ended", F.lit(0)).alias("ended"))
