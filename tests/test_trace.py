"""Trace operators on hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from arborlog.operators import joins, stats, trace

LOG = "attempt long, id long, t long, message string, value double"


def log(spark, *rows):
    return spark.createDataFrame([(1, i, t, m, v) for i, (t, m, v) in enumerate(rows)], LOG)


def test_time_profile(spark):
    rows = log(spark, *[(t, "x", None) for t in (0, 30, 100, 460, 1000)])
    assert trace.time_profile(rows).first()[1:] == (90, 10, 3)


@pytest.mark.parametrize(("gap", "want"), [(299, (60, 239, 1)), (300, (0, 0, 2))])
def test_time_profile_at_the_boundary(spark, gap, want):
    assert trace.time_profile(log(spark, (0, "x", None), (gap, "x", None))).first()[1:] == want


def test_running_time_ends_at_the_profile(spark):
    rows = log(spark, *[(t, "x", None) for t in (0, 30, 100, 460, 1000)])
    assert [(r.active, r.segment) for r in trace.running_time(rows).orderBy("id").collect()] == [(0, 1), (30, 1), (90, 1), (90, 2), (90, 3)]


def test_carry_and_look_ahead(spark):
    rows = log(spark, (0, "a", 1.0), (1, "hint", None), (2, "b", None), (3, "a", 2.0), (4, "a", 3.0))
    assert [r.last for r in trace.carried(rows, F.col("value"), "last").orderBy("id").collect()] == [1.0, 1.0, 1.0, 2.0, 3.0]
    ahead = trace.looked_ahead(rows, F.col("message") == "hint", F.col("message") == "a", 2).orderBy("step").collect()
    assert [(r.id, r.step, r.found_id) for r in ahead] == [(1, 1, 3), (1, 2, 4)]


def test_changes_and_transitions(spark):
    rows = log(spark, (0, "a", None), (1, "a", None), (2, "b", None), (3, "a", None))
    assert [r.id for r in trace.changes(rows, "message").orderBy("id").collect()] == [0, 2, 3]
    assert sorted((r.source, r.target) for r in trace.transitions(rows, "message").collect()) == [("a", "b"), ("b", "a")]


def test_sequential_thinning(spark):
    rows = log(spark, (0, "a", None), (5, "b", None), (12, "b", None), (13, "c", None), (25, "b", None), (26, "b", None))
    assert [r.id for r in trace.thinned(rows, 10, "message").orderBy("id").collect()] == [0, 2, 5]


def test_rate_limit(spark):
    rows = log(spark, (0, "a", None), (50, "b", None), (60, "c", None), (90, "b", None), (100, "d", None))
    assert [r.id for r in trace.rate_limited(rows, 30, "message", 0.2).orderBy("id").collect()] == [1, 4]


def test_filters(spark):
    rows = log(spark, (0, "grab", 1.0), (1, "drop", 1.0), (2, "export", None), (3, "x", None))
    assert [r.id for r in trace.without_grabs(rows, F.col("value").isNotNull(), F.col("message") == "grab").orderBy("id").collect()] == [1, 2, 3]
    assert [r.id for r in trace.up_to_last(rows, F.col("message") == "export").orderBy("id").collect()] == [0, 1, 2]
    assert trace.long_enough(rows, 4).count() == 0 and trace.long_enough(rows, 3).count() == 4


def test_grade_and_medians(spark):
    scores = spark.createDataFrame([(1, 2), (1, 0), (1, 1), (2, None)], "attempt long, score int")
    assert sorted((r.attempt, round(r.average, 6), r.partial) for r in stats.grade(scores).collect()) == [(1, round(1 / 3, 6), 0.5), (2, 0.0, 0.0)]
    rows = spark.createDataFrame([(0, v) for v in (4, 1, 3, 2)], "k int, v int")
    assert stats.upper_median_of(rows, [], "v").first().median == 3
    assert stats.upper_median_of(rows, ["k"], "v").first().median == 3
    assert stats.median_by_weight(rows.withColumn("w", F.when(F.col("v") == 1, 9).otherwise(1)), ["k"], "v", "w").first().median == 1


def test_numbers_without_a_single_task(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 1009).alias("v")).repartition(7)
    got = {r.v: r.number for r in stats.numbered(rows, ["v"]).collect()}
    assert [got[v] for v in sorted(got)] == list(range(500))
    assert stats.numbered(rows.limit(0), ["v"]).count() == 0


def test_numbers_do_not_hang_on_partitions(spark):
    """Columns that a run doesn't read make other partitions, as small ones are put together by size."""
    small = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k"}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        numbers = stats.numbered(spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("v"), F.sha2(F.col("id").cast("string"), 512).alias("rest")), ["v"])
        got = [(r.v, r.number) for r in numbers.where("length(rest) = 128").collect()]
    finally:
        for key in small:
            spark.conf.unset(key)
    assert sorted(got) == [(v, v) for v in range(20_000)]


def test_samples_of_both_halves(spark):
    rows = spark.createDataFrame([(1, k, k < 3) for k in range(6)] + [(2, k, True) for k in range(3)] + [(3, 9, False)], "a int, k int, early boolean")
    got = stats.early_late(rows, "a", F.col("early"), "k").collect()
    assert sorted((r.a, r.early) for r in got) == [(1, False), (1, True), (2, True), (2, True), (3, False)]


def test_duplicate_keys_fail(spark):
    rows = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    with pytest.raises(Exception, match="duplicate key"):
        stats.unique_or_fail(rows, "k").collect()


def test_greedy_match_takes_equal_places_first(spark):
    a = spark.createDataFrame([("x", 0), ("x", 3), ("y", 1)], "k string, p int")
    b = spark.createDataFrame([("x", 3), ("x", 5), ("z", 1)], "k string, p int")
    assert sorted(tuple(r) for r in joins.greedy_match(a, b, ["k"], "p").collect()) == [("x", 0, 5), ("x", 3, 3)]


def test_completed(spark):
    a, b = spark.createDataFrame([(1, 1)], "attempt int, n int"), spark.createDataFrame([(1, "l"), (2, "m")], "attempt int, location string")
    assert sorted((r.attempt, r.side) for r in joins.completed(a, b, "attempt").collect()) == [(1, "both"), (2, "right")]
