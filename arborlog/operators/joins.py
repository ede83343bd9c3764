"""Joins of logs with what is known of their attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def completed(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All keys of either side; ``side`` says where a key was found."""
    a, b = left.withColumn("__l", F.lit(True)), right.withColumn("__r", F.lit(True))
    side = F.when(F.col("__l").isNull(), "right").when(F.col("__r").isNull(), "left").otherwise("both")
    return a.join(b, key, "full").withColumn("side", side).drop("__l", "__r")


def spliced(log: DataFrame, other: DataFrame, bounds: DataFrame) -> DataFrame:
    """The log with the rows of ``other`` whose id lies within its attempt's (low, high], marked as spliced."""
    inside = other.join(bounds, "attempt").where((F.col("id") > F.col("low")) & (F.col("id") <= F.col("high"))).select(*log.columns)
    return log.withColumn("spliced", F.lit(False)).unionByName(inside.withColumn("spliced", F.lit(True)))


def submitted_row(log: DataFrame, submissions: DataFrame, state: str) -> DataFrame:
    """(attempt, id): the last row of each attempt whose state is the submitted one; states are compared by digest."""
    rows = log.select("attempt", "id", "t", F.md5(state).alias("m"))
    asked = submissions.select("attempt", F.md5(state).alias("m"))
    return rows.join(asked, ["attempt", "m"]).groupBy("attempt").agg(F.max_by("id", F.struct("t", "id")).alias("id"))


def node_changes(log: DataFrame, item: str, step: Column) -> DataFrame:
    """(attempt, step, added, deleted, kept) between the item sets of an attempt's consecutive steps."""
    items = log.select("attempt", step.alias("step"), item).distinct()
    steps = items.select("attempt", "step").distinct().withColumn("next", F.lead("step").over(Window.partitionBy("attempt").orderBy("step"))).where("next is not null")
    before = items.join(steps, ["attempt", "step"]).select("attempt", F.col("next").alias("step"), item, F.lit(1).alias("b"))
    after = items.join(steps.select("attempt", F.col("next").alias("step")), ["attempt", "step"]).withColumn("a", F.lit(1))
    both = before.join(after, ["attempt", "step", item], "full")
    return both.groupBy("attempt", "step").agg(F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a").isNull()).alias("deleted"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("kept"))


def greedy_match(left: DataFrame, right: DataFrame, keys: list[str], place: str) -> DataFrame:
    """(keys, left_place, right_place): first rows of equal keys at the same place, then the rest in order of place."""
    n = Window.partitionBy(*keys, place).orderBy(F.lit(0))
    a, b = (x.select(*keys, place, F.row_number().over(n).alias("n")) for x in (left, right))
    same = a.join(b, [*keys, place, "n"])
    rest = [x.join(same, [*keys, place, "n"], "left_anti").withColumn("m", F.row_number().over(Window.partitionBy(*keys).orderBy(place, "n"))) for x in (a, b)]
    other = rest[0].select(*keys, "m", F.col(place).alias("left_place")).join(rest[1].select(*keys, "m", F.col(place).alias("right_place")), [*keys, "m"])
    return same.select(*keys, F.col(place).alias("left_place"), F.col(place).alias("right_place")).unionByName(other.select(*keys, "left_place", "right_place"))


def leave_one_out(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """(key, n, others): how many pairs of different owners share a key, and how many owners have another beside them; counted without making the pairs."""
    n = F.count("*")
    return rows.select(key, owner).distinct().groupBy(key).agg((n * (n - 1)).alias("n"), n.alias("others")).where("others > 1")


def with_prefix(log: DataFrame, earlier: DataFrame) -> DataFrame:
    """The log with the rows that its attempts have in an earlier assignment's log, marked."""
    rows = earlier.join(log.select("attempt").distinct(), "attempt", "left_semi").select(*log.columns)
    return log.withColumn("earlier", F.lit(False)).unionByName(rows.withColumn("earlier", F.lit(True)))


def resolved_parent(hints: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(hint, node): the node a hint means: the one with its parent id, else the one with its root id, else the first of its root type.

    hints (hint, key, parent_id, root_id, root_type), nodes (key, node, ext_id, type); of several the first in pre-order.
    """
    by = lambda col, name: nodes.where(F.col(col).isNotNull()).groupBy(key, F.col(col).alias(name)).agg(F.min("node").alias(f"__{name}"))
    rows = hints.join(by("ext_id", "parent_id"), [key, "parent_id"], "left").join(by("ext_id", "root_id"), [key, "root_id"], "left").join(by("type", "root_type"), [key, "root_type"], "left")
    return rows.select("hint", F.coalesce("__parent_id", "__root_id", "__root_type").alias("node"))


def in_copy(nodes: DataFrame, copy: DataFrame, key: str) -> DataFrame:
    """(key, node, there): for each node the one of a copy with its id, if that comes once in both, else the one at its place."""
    once = lambda rows, name: rows.where("ext_id is not null").groupBy(key, "ext_id").agg(F.min("node").alias(name), F.count("*").alias("__n")).where("__n = 1").drop("__n")
    ids = once(nodes, "node").join(once(copy, "__id"), [key, "ext_id"]).select(key, "node", "__id")
    at = nodes.select(key, "node", "places").join(copy.select(key, F.col("node").alias("__at"), "places"), [key, "places"], "left").select(key, "node", "__at")
    return at.join(ids, [key, "node"], "left").select(key, "node", F.coalesce("__id", "__at").alias("there"))


def nearest_of(rows: DataFrame, medoids: DataFrame, key: str, vector: str, distance) -> DataFrame:
    """(key, medoid, distance): the nearest of a bounded number of medoids (medoid, vector), ties to the lesser."""
    met = rows.select(key, F.col(vector).alias("__v")).join(F.broadcast(medoids.select("medoid", F.col(vector).alias("__m"))))
    best = met.withColumn("__d", distance("__v", "__m")).groupBy(key).agg(F.min(F.struct("__d", "medoid")).alias("b"))
    return best.select(key, "b.medoid", F.col("b.__d").alias("distance"))


def pair_distances(pairs: DataFrame, rows: DataFrame, a: str, b: str, key: str, text: str) -> DataFrame:
    """Pairs of keys with the edit distance of their rows' texts: two equi-joins."""
    x, y = rows.select(F.col(key).alias(a), F.col(text).alias("__x")), rows.select(F.col(key).alias(b), F.col(text).alias("__y"))
    return pairs.join(x, a).join(y, b).withColumn("distance", F.levenshtein("__x", "__y")).drop("__x", "__y")


def with_required(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows joined with what must be known of their key; fails when read if it isn't."""
    found = rows.join(known.withColumn("__found", F.lit(True)), key, "left")
    fine = F.when(F.col("__found").isNull(), F.raise_error(F.concat(F.lit("nothing is known of "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return found.withColumn("__fine", fine).where("__fine").drop("__found", "__fine")


def bag_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, common, only_left, only_right) with multiplicities."""
    a, b = left.groupBy(key).agg(F.count("*").alias("a")), right.groupBy(key).agg(F.count("*").alias("b"))
    x, y = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return a.join(b, key, "full").select(key, F.least(x, y).alias("common"), F.greatest(x - y, F.lit(0)).alias("only_left"), F.greatest(y - x, F.lit(0)).alias("only_right"))


def register(query, table) -> None:
    """Queries of the joins."""
    from .trace import log_of

    @query("""WITH l AS (SELECT user_id AS attempt, count(*) AS n FROM events GROUP BY 1), s AS (SELECT c_custkey AS attempt, c_mktsegment AS location FROM customer)
SELECT attempt, coalesce(n, 0) AS n, coalesce(location, '') AS location, CASE WHEN n IS NULL THEN 'right' WHEN location IS NULL THEN 'left' ELSE 'both' END AS side FROM l FULL JOIN s USING (attempt)""")
    def join_completed(spark, d):
        logs = log_of(table(spark, d, "events")).groupBy("attempt").agg(F.count("*").alias("n"))
        known = table(spark, d, "customer").select(F.col("c_custkey").alias("attempt"), F.col("c_mktsegment").alias("location"))
        return completed(logs, known, "attempt").select("attempt", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("location", F.lit("")).alias("location"), "side")

    @query("SELECT e.event_id AS id, e.user_id AS attempt, c.c_mktsegment AS segment FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id")
    def join_attributes(spark, d):
        known = table(spark, d, "customer").select(F.col("c_custkey").alias("attempt"), F.col("c_mktsegment").alias("segment"))
        return log_of(table(spark, d, "events")).join(known, "attempt", "left").select("id", "attempt", "segment")

    @query("""WITH o AS (SELECT user_id AS attempt, event_id AS id FROM events WHERE event_type = 'error'), m AS (SELECT user_id AS attempt, event_id AS id FROM events WHERE event_type <> 'error'), b AS (SELECT attempt, min(id) AS low, max(id) AS high FROM m GROUP BY 1)
SELECT attempt, id, false AS spliced FROM m UNION ALL SELECT attempt, id, true FROM o JOIN b USING (attempt) WHERE id > low AND id <= high""")
    def join_spliced(spark, d):
        log = log_of(table(spark, d, "events")).select("attempt", "id", "message")
        main, other = (log.where(c).select("attempt", "id") for c in ("message <> 'error'", "message = 'error'"))
        return spliced(main, other, main.groupBy("attempt").agg(F.min("id").alias("low"), F.max("id").alias("high")))

    @query("""WITH s AS (SELECT user_id AS attempt, min(props) AS props FROM events GROUP BY 1) SELECT attempt, arg_max(event_id, struct_pack(t := floor(epoch(ts)), id := event_id)) AS id
FROM events JOIN s ON s.attempt = events.user_id AND s.props = events.props GROUP BY 1""")
    def join_submitted_row(spark, d):
        log = log_of(table(spark, d, "events"))
        return submitted_row(log, log.groupBy("attempt").agg(F.min("props").alias("props")), "props")

    @query("""WITH i AS (SELECT DISTINCT user_id AS attempt, CAST(CAST(ts AS DATE) AS VARCHAR) AS step, props FROM events), s AS (SELECT attempt, step, lead(step) OVER (PARTITION BY attempt ORDER BY step) AS nxt FROM (SELECT DISTINCT attempt, step FROM i)),
b AS (SELECT i.attempt, s.nxt AS step, i.props FROM i JOIN s USING (attempt, step) WHERE s.nxt IS NOT NULL), a AS (SELECT i.* FROM i JOIN s ON s.attempt = i.attempt AND s.nxt = i.step)
SELECT attempt, step, count_if(b.props IS NULL)::BIGINT AS added, count_if(a.props IS NULL)::BIGINT AS deleted, count_if(a.props IS NOT NULL AND b.props IS NOT NULL)::BIGINT AS kept
FROM (SELECT coalesce(a.attempt, b.attempt) AS attempt, coalesce(a.step, b.step) AS step, a, b FROM a FULL JOIN b ON a.attempt = b.attempt AND a.step = b.step AND a.props = b.props) GROUP BY 1, 2""")
    def join_node_changes(spark, d):
        return node_changes(log_of(table(spark, d, "events")), "props", F.col("ts").cast("date").cast("string"))

    @query("""WITH l AS (SELECT l_partkey AS k, l_linenumber AS p, row_number() OVER (PARTITION BY l_partkey, l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT l_partkey AS k, l_linenumber AS p, row_number() OVER (PARTITION BY l_partkey, l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'A'),
s AS (SELECT k, p, n FROM l JOIN r USING (k, p, n)), a AS (SELECT k, p, row_number() OVER (PARTITION BY k ORDER BY p, n) AS m FROM l ANTI JOIN s USING (k, p, n)), b AS (SELECT k, p, row_number() OVER (PARTITION BY k ORDER BY p, n) AS m FROM r ANTI JOIN s USING (k, p, n))
SELECT k, p AS left_place, p AS right_place FROM s UNION ALL SELECT k, a.p, b.p FROM a JOIN b USING (k, m)""")
    def join_greedy_match(spark, d):
        rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("p"), "l_returnflag")
        return greedy_match(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'A'"), ["k"], "p")

    @query("""WITH a AS (SELECT user_id AS attempt, props FROM events WHERE event_type = 'view') SELECT x.props, count(*) AS n, count(DISTINCT y.attempt) AS others FROM (SELECT DISTINCT attempt, props FROM a) x JOIN (SELECT DISTINCT attempt, props FROM a) y ON x.props = y.props AND x.attempt <> y.attempt GROUP BY 1""")
    def join_leave_one_out(spark, d):
        return leave_one_out(log_of(table(spark, d, "events")).where("message = 'view'"), "props", "attempt")

    @query("""WITH a AS (SELECT l_partkey AS k, count(*) AS a FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS b FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT k, least(coalesce(a, 0), coalesce(b, 0)) AS common, greatest(coalesce(a, 0) - coalesce(b, 0), 0) AS only_left, greatest(coalesce(b, 0) - coalesce(a, 0), 0) AS only_right FROM a FULL JOIN b USING (k)""")
    def set_bag_overlap(spark, d):
        rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
        return bag_overlap(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'A'"), "k")

    def two(spark, d):
        rows = table(spark, d, "lineitem")
        return rows.where("l_returnflag = 'R'").select("l_partkey"), rows.where("l_returnflag = 'A'").select("l_partkey")

    pair = "(SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') {} (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')"

    @query(pair.format("INTERSECT ALL"))
    def set_intersect_all(spark, d):
        a, b = two(spark, d)
        return a.intersectAll(b)

    @query(pair.format("EXCEPT ALL"))
    def set_except_all(spark, d):
        a, b = two(spark, d)
        return a.exceptAll(b)

    @query(pair.format("INTERSECT"))
    def set_agreed(spark, d):
        a, b = two(spark, d)
        return a.intersect(b)

    @query(pair.format("EXCEPT"))
    def set_missed(spark, d):
        a, b = two(spark, d)
        return a.subtract(b)

    @query(pair.format("UNION ALL"))
    def set_union_all(spark, d):
        a, b = two(spark, d)
        return a.unionAll(b)

    @query(pair.format("UNION"))
    def set_distinct(spark, d):
        a, b = two(spark, d)
        return a.union(b).distinct()
