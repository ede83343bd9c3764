"""Aggregates over attempts, states and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved
from .trace import transitions


def upper_median_of(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median): the middle value, the upper of two. Equal values are counted first, so a hot key has only its different values in one place."""
    many = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    summed = many.withColumns({"__to": F.sum("__n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "__all": F.sum("__n").over(w)})
    middle = F.floor(F.col("__all") / 2) + 1
    return summed.where((F.col("__to") >= middle) & (F.col("__to") - F.col("__n") < middle)).select(*keys, F.col(value).alias("median"))


def numbered(rows: DataFrame, order: list, name: str = "number") -> DataFrame:
    """Adds dense numbers from 0 in that order, without a single task for all rows.

    The rows are sorted by ranges, each partition is numbered by itself, and what stands before it is added; what is collected has a row for
    each partition. Which small partitions are put together hangs on the columns that a run reads, so the sorted rows are saved before they are counted.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the number within its partition is in the lower 33 bits
    marked = ranged.withColumn("__id", F.monotonically_increasing_id()).withColumns({"__part": F.shiftrightunsigned("__id", 33), "__at": F.col("__id").bitwiseAND((1 << 33) - 1)}).drop("__id")
    marked = saved(marked)
    sizes = sorted((r["__part"], r["n"]) for r in marked.groupBy("__part").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    if not before:
        return rows.withColumn(name, F.lit(None).cast("long"))
    at = F.broadcast(spark.createDataFrame(before, "__part long, __before long"))
    return marked.join(at, "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def grade(scores: DataFrame) -> DataFrame:
    """(attempt, average, partial) of rows (attempt, score in 0 fail, 1 attempt, 2 pass): passed / n and points / 2n; 0 without tests."""
    n = F.count("score")
    return scores.groupBy("attempt").agg(
        F.when(n > 0, F.count_if(F.col("score") == 2) / n).otherwise(0.0).alias("average"),
        F.when(n > 0, F.sum("score") / (2 * n)).otherwise(0.0).alias("partial"),
    )


def repeats(log: DataFrame, key: str) -> DataFrame:
    """(attempt, shown, duplicates, repeated): rows, rows whose key came before, rows whose key is that of the row before."""
    w = Window.partitionBy("attempt").orderBy("t", "id")
    rows = log.withColumns({"n": F.row_number().over(Window.partitionBy("attempt", key).orderBy("t", "id")), "p": F.lag(key).over(w)})
    return rows.groupBy("attempt").agg(F.count("*").alias("shown"), F.count_if(F.col("n") > 1).alias("duplicates"), F.count_if(F.col("p").eqNullSafe(F.col(key))).alias("repeated"))


def duplicate_share(log: DataFrame, state: str) -> DataFrame:
    """One row: states, those seen in more than one attempt, and their share by state, by (attempt, state) and by row."""
    by = log.groupBy(state, "attempt").agg(F.count("*").alias("n"))
    one = by.groupBy(state).agg(F.count("*").alias("attempts"), F.sum("n").alias("n"))
    shared = F.col("attempts") > 1
    return one.agg(
        F.count("*").alias("states"),
        F.count_if(shared).alias("shared"),
        F.avg(shared.cast("double")).alias("by_state"),
        (F.sum(F.when(shared, F.col("attempts")).otherwise(0)) / F.sum("attempts")).alias("by_attempt"),
        (F.sum(F.when(shared, F.col("n")).otherwise(0)) / F.sum("n")).alias("by_row"),
    )


def vertex_weights(log: DataFrame, state: str) -> DataFrame:
    """(state, weight, goals): attempts that contain it and attempts that end in it."""
    last = log.groupBy("attempt").agg(F.max_by(state, F.struct("t", "id")).alias("last"))
    marked = log.select("attempt", state).distinct().join(last, "attempt")
    return marked.groupBy(state).agg(F.count("*").alias("weight"), F.count_if(F.col(state).eqNullSafe(F.col("last"))).alias("goals"))


def edge_weights(log: DataFrame, state: str) -> DataFrame:
    """(source, target, weight): attempts that make the step; loops don't count."""
    return transitions(log, state).distinct().groupBy("source", "target").agg(F.count("*").alias("weight"))


def edge_probabilities(edges: DataFrame) -> DataFrame:
    """Adds p, the weight's share of what leaves the source."""
    return edges.withColumn("p", F.col("weight") / F.sum("weight").over(Window.partitionBy("source")))


def degrees(edges: DataFrame) -> DataFrame:
    """(state, weight_in, weight_out) of every end of an edge."""
    ends = edges.select(F.col("target").alias("state"), F.col("weight").alias("i"), F.lit(0).cast("long").alias("o")).unionAll(edges.select(F.col("source").alias("state"), F.lit(0).cast("long"), F.col("weight")))
    return ends.groupBy("state").agg(F.sum("i").alias("weight_in"), F.sum("o").alias("weight_out"))


def pruned(vertices: DataFrame, edges: DataFrame, state: str, least: int = 2) -> DataFrame:
    """Edges between vertices that have at least that weight or are a goal."""
    kept = vertices.where((F.col("weight") >= least) | (F.col("goals") > 0)).select(F.col(state).alias("v"))
    return edges.join(kept.withColumnRenamed("v", "source"), "source", "left_semi").join(kept.withColumnRenamed("v", "target"), "target", "left_semi").select("source", "target", "weight")


def last_states(log: DataFrame, state: str) -> DataFrame:
    """(state, n): how many attempts end in it."""
    return log.groupBy("attempt").agg(F.max_by(state, F.struct("t", "id")).alias(state)).groupBy(state).agg(F.count("*").alias("n"))


def pair_order(log: DataFrame, label: str, least: float = 0.3) -> DataFrame:
    """(a, b, n, before): of the attempts that have both labels, the share in which a comes first; labels that enough attempts have.

    Labels are few and an attempt's labels are sorted into one array, so pairs are made within an attempt and never between attempts.
    """
    first = log.groupBy("attempt", label).agg(F.min(F.struct("t", "id")).alias("o"))
    n = first.agg(F.count_distinct("attempt").alias("n"))
    common = first.groupBy(label).agg(F.count("*").alias("c")).join(F.broadcast(n)).where(F.col("c") >= F.col("n") * least).select(label)
    first = first.join(F.broadcast(common), label)
    pairs = first.select("attempt", F.col(label).alias("a"), F.col("o").alias("oa")).join(first.select("attempt", F.col(label).alias("b"), F.col("o").alias("ob")), "attempt").where("a <> b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg((F.col("oa") < F.col("ob")).cast("double")).alias("before"))


def order_deviation(log: DataFrame, label: str) -> DataFrame:
    """(label, mean, sd) of the place at which labels first come in their attempts."""
    first = log.groupBy("attempt", label).agg(F.min(F.struct("t", "id")).alias("o"))
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("attempt").orderBy("o")))
    return ranked.groupBy(label).agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"))


def follower_overlap(bridge: DataFrame, rule: str, follower: str) -> DataFrame:
    """(a, b, both, either, jaccard) of each pair of rules with a common follower, a < b."""
    bridge = bridge.select(rule, follower).distinct()
    size = bridge.groupBy(rule).agg(F.count("*").alias("n"))
    both = bridge.select(F.col(rule).alias("a"), follower).join(bridge.select(F.col(rule).alias("b"), follower), follower).where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    both = both.join(size.select(F.col(rule).alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col(rule).alias("b"), F.col("n").alias("nb")), "b")
    either = F.col("na") + F.col("nb") - F.col("both")
    return both.select("a", "b", "both", either.alias("either"), (F.col("both") / either).alias("jaccard"))


def rule_support(counts: DataFrame, key: str, n: int, support: float) -> DataFrame:
    """(key, least, followers): of rows (attempt, key, count), the rules "key at least so often" that enough but not all of ``n`` attempts follow."""
    rules = counts.select("attempt", key, F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("least"))
    found = rules.groupBy(key, F.col("least").cast("long").alias("least")).agg(F.count("*").alias("followers"))
    return found.where((F.col("followers") >= F.ceil(F.lit(n) * support)) & (F.col("followers") < n))


def confusion(rows: DataFrame, actual: str, said: str) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall of two boolean columns."""
    a, s = F.col(actual), F.col(said)
    c = rows.agg(F.count_if(a & s).alias("tp"), F.count_if(~a & s).alias("fp"), F.count_if(a & ~s).alias("fn"), F.count_if(~a & ~s).alias("tn"))
    ratio = lambda x, y: F.when(F.col(x) + F.col(y) > 0, F.col(x) / (F.col(x) + F.col(y)))
    return c.select("*", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"))


def unique_or_fail(rows: DataFrame, key: str) -> DataFrame:
    """The rows; fails when read if a key comes twice."""
    n = F.count("*").over(Window.partitionBy(key))
    return rows.withColumn("__n", n).withColumn("__ok", F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("duplicate key "), F.col(key).cast("string")))).otherwise(F.lit(True))).where("__ok").select(*rows.columns)


def hashed_sample(rows: DataFrame, keys: list[str], by: str, n: int, seed: str = "s") -> DataFrame:
    """``n`` rows of each group in the order of a hash, the same in every run."""
    order = F.md5(F.concat(F.lit(seed), F.col(by).cast("string")))
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order, by))).where(F.col("__r") <= n).drop("__r")


def state_summary(log: DataFrame, state: str, grades: DataFrame) -> DataFrame:
    """One row: different states, rows, different last states, and of the grades (attempt, average) the mean, the least and how many are perfect."""
    n = log.agg(F.count_distinct(state).alias("states"), F.count("*").alias("rows"))
    last = last_states(log, state).agg(F.count("*").alias("last_states"))
    g = grades.agg(F.avg("average").alias("mean"), F.min("average").alias("least"), F.count_if(F.col("average") >= 1).alias("perfect"))
    return n.join(F.broadcast(last)).join(F.broadcast(g))


def dominance(bridge: DataFrame, rule: str, follower: str) -> DataFrame:
    """(a, b, share): of those who follow a, the share that follow b; pairs without a common follower are left out."""
    size = bridge.select(rule, follower).distinct().groupBy(F.col(rule).alias("a")).agg(F.count("*").alias("n"))
    both = follower_overlap(bridge, rule, follower).select("a", "b", "both")
    ways = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "both"))
    return ways.join(size, "a").select("a", "b", (F.col("both") / F.col("n")).alias("share"))


def timing_differences(times: DataFrame, key: str = "feature") -> DataFrame:
    """(a, b, n, mean): over the attempts that have both, the mean of the seconds from b to a."""
    x, y = times.select("attempt", F.col(key).alias("a"), F.col("t").alias("ta")), times.select("attempt", F.col(key).alias("b"), F.col("t").alias("tb"))
    return x.join(y, "attempt").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"), F.avg(F.col("ta") - F.col("tb")).alias("mean"))


def order_matrix(log: DataFrame, label: str) -> DataFrame:
    """(a, b, sd): the deviation, over attempts, of how many places a label first comes behind another."""
    first = log.groupBy("attempt", label).agg(F.min(F.struct("t", "id")).alias("o"))
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("attempt").orderBy("o")))
    x, y = ranked.select("attempt", F.col(label).alias("a"), F.col("r").alias("ra")), ranked.select("attempt", F.col(label).alias("b"), F.col("r").alias("rb"))
    return x.join(y, "attempt").where("a <> b").groupBy("a", "b").agg(F.stddev_pop(F.col("ra") - F.col("rb")).alias("sd"))


def copeland(order: DataFrame) -> DataFrame:
    """(a, wins, place) of pairs (a, b, before): labels by how many others they come before more often than not, ties to the lesser name.

    Precedence by pairs need not be transitive, so labels aren't compared two at a time but by this score.
    """
    wins = order.groupBy("a").agg(F.count_if(F.col("before") > 0.5).alias("wins"))
    return wins.withColumn("place", F.row_number().over(Window.orderBy(F.desc("wins"), "a")).cast("long"))  # as many rows as labels


def early_late(rows: DataFrame, key: str, early: Column, by: str, seed: str = "s") -> DataFrame:
    """One row of each half of a group, by a hash; where a half is empty, a second one of the other half."""
    order = F.md5(F.concat(F.lit(seed), F.col(by).cast("string")))
    half = rows.withColumn("__half", early.cast("int")).withColumn("__r", F.row_number().over(Window.partitionBy(key, "__half").orderBy(order, by)))
    w = Window.partitionBy(key).orderBy("__r", F.desc("__half"))
    return half.withColumn("__k", F.row_number().over(w)).where("__k <= 2").select(*rows.columns)


def median_by_weight(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """(keys, median): the upper median of values that count as often as their weight says."""
    many = rows.where((F.col(weight) > 0) & F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("__n"))
    w = Window.partitionBy(*keys)
    summed = many.withColumns({"__to": F.sum("__n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "__all": F.sum("__n").over(w)})
    middle = F.floor(F.col("__all") / 2) + 1
    return summed.where((F.col("__to") >= middle) & (F.col("__to") - F.col("__n") < middle)).select(*keys, F.col(value).alias("median"))
