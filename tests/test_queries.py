"""Every query of the library against its SQL, on the smallest tables; and a stream against the batch."""

import os
import random
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from arborlog.operators import mining, trace
from arborlog.plans import registry
from arborlog.streaming import traces

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def shown(frame, columns):
    values = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
    return sorted(map(repr, values))


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    import duckdb

    got = QUERIES[name](spark, DATA).toPandas()
    if name not in SQL:
        return
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    want = con.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert shown(got, columns) == shown(want, columns)


@needs_data
def test_nearest_are_of_all_conversations(spark):
    from arborlog.operators import alignment, trees
    from arborlog.plans import more

    talks = {r.conv_id: r.tree for r in more._talks(spark, DATA).collect()}
    cost = {(a, b): alignment.align(trees.unpack(x), trees.unpack(y)).cost for a, x in talks.items() for b, y in talks.items() if a != b}
    want = {(a, b, round(cost[a, b], 6), i + 1) for a in talks for i, b in enumerate(sorted((b for b in talks if b != a), key=lambda b: (cost[a, b], len(talks[b]), b))[:3])}
    assert {(r.query, r.solution, r.cost, r["rank"]) for r in QUERIES["align_nearest"](spark, DATA).collect()} == want
    near = alignment.nearest(*(more._talks(spark, DATA).withColumnRenamed("conv_id", x) for x in ("query", "solution")), 5)
    votes = lambda rows: sorted((r.query, r.action, r.node, r.parent, r.type, r.votes) for r in rows.collect())
    assert votes(QUERIES["align_consensus"](spark, DATA)) == votes(alignment.consensus(near))


def test_entry_without_the_training_data_operators(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def refuse(name, *args, **kw):
        if name == "corpus_pipeline" or name.startswith("arborlog.llm"):
            raise ImportError(name)
        return real(name, *args, **kw)

    for m in [m for m in sys.modules if m in ("__spark_entry__", "corpus_pipeline")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", refuse)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL)


def on_events(spark, name, rows, at):
    """What a query and its SQL give on a table of events (event_id, second, user_id, event_type, props)."""
    import duckdb

    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, props string")
    events.selectExpr("event_id", "timestampadd(SECOND, s, timestamp_ntz'2024-01-01 00:00:00') AS ts", "user_id", "event_type", "1.0D AS value", "props").write.parquet(f"{at}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{at}/events.parquet/*.parquet'")
    want = con.sql(SQL[name])
    assert sorted(QUERIES[name](spark, str(at)).columns) == sorted(want.columns)
    got = QUERIES[name](spark, str(at)).select(*want.columns).collect()
    return sorted(repr(tuple(r)) for r in got), sorted(repr(r) for r in want.fetchall())


def test_align_cost_on_odd_events(spark, tmp_path):
    """No user, no action, no time, actions of one letter and an empty one."""
    rows = [(i, 5 * i % 17, u, m, "p") for i, (u, m) in enumerate([(1, "view"), (1, "vote"), (2, "vote"), (2, None), (3, None), (4, "click"), (4, ""), (5, ""), (6, "error"), (None, "view"), (None, "click"), (2, "click")])]
    rows += [(90, None, 1, "click", "p"), (None, 3, 2, "signup", "p"), (91, 3, 2, "error", "p")]
    got, want = on_events(spark, "seq_align_cost", rows, tmp_path)
    assert got == want and len(want) > 4


def test_agreeing_on_odd_events(spark, tmp_path):
    """No user, no rule, equal sets, a rule that all have and rules of one's own."""
    rng = random.Random(4)
    rows = [(i, i, rng.choice([*range(30), None]), "view", rng.choice([*"aaaabcdefghij", f"own{i}", None])) for i in range(300)]
    rows += [(1000 + 10 * u + k, 0, 100 + u, "view", p) for u in range(12) for k, p in enumerate("xyza")] + [(5000, 0, 200, "view", "alone"), (5001, 0, 201, "view", None)]
    got, want = on_events(spark, "mine_agreeing", rows, tmp_path)
    assert got == want and len(want) > 200
    nothing = spark.createDataFrame([], "query int, solution int, rule string")
    assert mining.agreeing(nothing, nothing).count() == 0


def test_agreeing_does_not_join_by_rule(spark):
    """2,500 sets of 300 of 400 rules, which have 1.4 billion rows of common rules."""
    rng = np.random.default_rng(8)
    has = np.argsort(rng.random((2500, 400)), axis=1) < 300
    rows = spark.createDataFrame(pd.DataFrame({"attempt": np.nonzero(has)[0], "rule": np.nonzero(has)[1]}))
    begun = time.monotonic()
    got = mining.agreeing(rows.withColumnRenamed("attempt", "query"), rows.withColumnRenamed("attempt", "solution"), 3).collect()
    assert time.monotonic() - begun < 45
    common = (has.astype(np.float32) @ has.T.astype(np.float32)).astype(int)
    q, s = np.nonzero(common >= np.sort(common, axis=1)[:, [-3]])
    assert sorted(map(tuple, got)) == list(zip(q.tolist(), s.tolist(), common[q, s].tolist(), strict=True))


@pytest.mark.parametrize("dense", [0, 0.2, 2])
def test_agreeing_in_blocks(monkeypatch, dense):
    for name, value in {"ROWS": 7, "COLUMNS": 5, "PAIRS": 50, "DENSE": dense}.items():
        monkeypatch.setattr(mining, name, value)
    rng = random.Random(3)
    sets = [sorted(set(rng.choices(range(40), weights=range(1, 41), k=rng.randint(1, 9)))) for _ in range(90)]
    rows = [(part, split, asks, i, 1, x) for part in range(2) for split in range(2) for asks in range(2) for i, x in enumerate(sets) if i % 2 == (split if asks else part)]
    names = ["part", "split", "asks", "class", "weight", "rules"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[k : k + 33]]) for k in range(0, len(rows), 33)]
    got = {(a, b): n for x in mining._best(iter([*batches[:1], batches[0].slice(0, 0), *batches[1:]]), 4) for a, b, n in zip(*(x.column(k).to_pylist() for k in range(3)), strict=True)}
    common = {(a, b): len({*x} & {*y}) for a, x in enumerate(sets) for b, y in enumerate(sets)}
    assert all(common[p] == n > 0 for p, n in got.items())
    for a in range(90):
        for part in range(2):
            last = sorted((common[a, b] for b in range(part, 90, 2)), reverse=True)[3]
            assert {b for b in range(part, 90, 2) if (a, b) in got} == {b for b in range(part, 90, 2) if common[a, b] >= max(last, 1)}


@needs_data
def test_stream_ends_at_the_batch_profile(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = traces.time_profile(stream).writeStream.outputMode("update").format("memory").queryName("profile").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.attempt, r.active, r.idle, r.segments) for r in spark.table("profile").collect()}
    batch = trace.time_profile(trace.log_of(spark.read.parquet(f"{DATA}/events.parquet")))
    assert got == {tuple(r) for r in batch.collect()}
