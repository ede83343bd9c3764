"""Graders, policies, canonical forms, hints and rules on small programs."""

import random

from pyspark.sql import functions as F

from arborlog.functions import payloads
from arborlog.operators import alignment, canonical, graders, graphs, joins, mining, policies, trace, trees
from arborlog.sources import exports

J = trees.from_json


def tree(text):
    """type=value(children, ...)"""
    from arborlog.plans import templates

    return templates.variants(text)[0]


def test_graders():
    good = tree("stage { sprite { script { doSayFor { literal } doAsk { literal } doSetVar { var reportRandom } doUntil { reportEquals { var getLastAnswer } } } } }")
    assert {k: graders.passes(good, t) for k, t in graders.GUESSING.items()} == dict.fromkeys(graders.GUESSING, True)
    bad = tree("stage { sprite { script { doUntil { reportEquals { literal var } } doAsk { literal } doSayFor { literal } } } }")
    assert not any(graders.passes(bad, t) for t in graders.GUESSING.values())
    forever = tree("sprite { script { doForever { script { doIf { reportEquals { var var } script { doStopThis } } } } } }")
    assert graders.passes(forever, graders.GUESSING["until guessed"])
    shape = tree("sprite { script { doAsk down doRepeat { getLastAnswer script { forward turn { reportQuotient { literal:360 getLastAnswer } } } } } }")
    assert all(graders.passes(shape, t) for t in graders.POLYGON.values())
    assert not any(graders.passes(tree("sprite { script { forward down } }"), t) for t in graders.POLYGON.values())


def test_paths_of_nodes_as_in_columns(spark):
    rng = random.Random(4)
    patterns = [["a", "...", "b"], ["a", "b", "...", "c"], ["...", "a", "b"], ["a|b", "c"], ["b", "...", "a", "...", "c"]]
    rows = [(["".join(rng.choice("abc")) for _ in range(rng.randint(1, 6))],) for _ in range(150)]
    df = spark.createDataFrame(rows, "path array<string>")
    got = df.select(*[trees.backbone(p).alias(f"p{k}") for k, p in enumerate(patterns)]).collect()
    for (path,), r in zip(rows, got, strict=True):
        n = None
        for x in path:
            m = trees.Node(x)
            n = n.add(m) if n is not None else m
        assert [graders.under(*p)(n) for p in patterns] == list(r), path


def test_policies(spark):
    goal = tree("script { ask say { x } wait }")
    start = tree("script { wait say }")
    way = list(policies.followed(start, policies.direct([goal])))
    assert way[-1].text() == goal.text() and len(way) >= 2
    again = policies.student([start, *way])
    assert [n.text() for n in policies.followed(start, again)] == [n.text() for n in way]
    assert list(policies.followed(start, policies.known_steps({start.text(): goal})))[0].text() == goal.text()
    df = spark.createDataFrame([(1, [tuple(x.values()) for x in trees.pack(start)]), (2, None)], f"k int, tree {trees.TREE}")
    out = policies.completed(df, policies.direct([goal]), "k").collect()
    assert [(r.k, r.steps) for r in out] == [(1, len(way))] and trees.unpack(out[0].tree).text() == goal.text()


def test_canonical_names_ids_and_orders(spark):
    t = J('{"type":"stage","children":[{"type":"script","id":"b"},{"type":"var"},{"type":"script","id":"a","children":[{"type":"x"}]}]}')
    (parent, order), = canonical.ordered_scripts(t, {"stage"}, {"script"})
    assert [c.ext_id for c in parent.children] == ["a", None, "b"] and canonical.reorder_vector(order, 1) == [3, 2, 1]
    assert [n.ext_id for n in canonical.filled_ids(t).walk()] == ["GEN_0", "a", "GEN_1", "GEN_2", "b"]
    assert [n.ext_id for n in canonical.dynamic_ids(t).walk()] == ["ID0", "ID1", "ID2", "ID3", "ID4"]
    assert canonical.normalised(J('{"type":"a","value":"1","children":[{"type":"c"},{"type":"b","value":"2"}]}'), True).text() == "a:[b, c]"
    assert canonical.placeholders_emptied(J('{"type":"Call","children":[{"type":"Str","value":"~"},{"type":"Str","value":"x"}]}')).text() == "Call:[EMPTY, Str=x]"
    assert canonical.renamed_calls(["draw", "x", "move"], ["draw square", "move a", "move b"]) == {"draw": "draw square"}


def test_tokens_and_contents():
    assert payloads.tokens("if x==1: y") == ["if", " ", "x", "=", "=", "1", ":", " ", "y"] and payloads.tokens("") == []
    assert mining.contained(("a", "b", "c"), ("r", "a", "x", "b", "c"), 1) is True
    assert mining.contained(("a", "c", "b"), ("r", "a", "x", "b", "c"), 1) is False


def test_edits_of_grams_are_minimised():
    found = [("relabel", "X", "a>b"), ("relabel", "X", "b>a"), ("delete", "X", "c"), ("insert", "Y", "c"), ("insert", "X", "d")]
    assert mining.minimised(found) == [("insert", "X", "d"), ("move", "X>Y", "c")]
    assert mining.mean_jaccard([{1, 2}, {2, 3}]) == (1 / 3) / 2 and mining.mean_jaccard([{1}]) == 0


def test_implausible_solutions_go(spark):
    ranked = spark.createDataFrame([("q", f"s{i}") for i in range(10)], "query string, solution string")
    follows = spark.createDataFrame([("s0", "odd"), *[(f"s{i}", "usual") for i in range(5)], ("s1", "own")], "solution string, rule string")
    own = spark.createDataFrame([("q", "own")], "query string, rule string")
    assert sorted(r.solution for r in mining.plausible(ranked, follows, own).collect()) == [f"s{i}" for i in range(1, 10)]


def test_interactions_and_reuse(spark):
    rows = [(1, 1, "n", "g", "a"), (1, 2, "n", "g", "ab"), (1, 2, "m", "g", "x"), (1, 3, "m", "h", "x"), (2, 1, "n", "g", "a")]
    nodes = spark.createDataFrame(rows, "attempt int, step int, node string, graph string, state string")
    got = sorted((r.attempt, r.graph, r.source, r.target) for r in graphs.interactions(nodes).collect())
    assert got == [(1, "g", "", "x"), (1, "g", "a", "ab"), (1, "g", "ab", "")]
    assert graphs.reused(["a", "b", "a"], ["a", "a", "c", "a", "b"]) == [0, 2, -1, -1, 1]
    hints = [{"parent": 1, "from": ["a"], "to": ["a", "b"]}, {"parent": 2, "from": ["b", "c"], "to": ["c"]}, {"parent": 0, "from": ["script"], "to": ["script", "script"]}]
    assert [(h["parent"], h["takes"]) for h in graphs.linked(hints)] == [(1, [2]), (2, [])]


def test_swept_values_of_the_known_chain(spark):
    v = spark.createDataFrame([("x", "g", 2), ("x", "s", 0), ("x", "t", 0)], "graph string, state string, goals long")
    e = spark.createDataFrame([("x", "t", "s", 1), ("x", "s", "g", 1), ("x", "s", "s", 9)], "graph string, source string, target string, weight long")
    assert {r.state: r.value for r in graphs.swept(v, e, 9).collect()} == {"g": 200.0, "s": 198.0, "t": 196.015625} == graphs.backup(["g", "s", "t"], [2, 0, 0], [("t", "s", 1), ("s", "g", 1), ("s", "s", 9)])
    assert {r.state: r.value for r in graphs.finished(v.withColumn("weight", F.lit(2).cast("long")), e, 1).collect()}["t"] == 0.0
    known = spark.createDataFrame([("x", "ab", 5.0), ("x", "abc", 9.0)], "graph string, state string, value double")
    steps = spark.createDataFrame([("x", "ab", "abd"), ("x", "abc", "abcd")], "graph string, source string, target string")
    asked = spark.createDataFrame([(1, "x", "ab"), (2, "x", "abx"), (3, "x", "zzzzzzzz")], "request int, graph string, state string")
    assert sorted((r.request, r.next, r.via) for r in graphs.hints_or_neighbours(asked, steps, known).collect()) == [(1, "abd", "state"), (2, "abcd", "neighbour"), (3, None, None)]


def test_script_goals(spark):
    rows = spark.createDataFrame([("g", "s1", "a", 2, 3), ("g", "s2", "b", 1, 1)], "graph string, state string, item string, n int, goals int")
    assert {r.item: r.median for r in graphs.script_goals(rows).collect()} == {"a": 2, "b": 0}


def test_parents_and_copies(spark):
    rows = [(1, 0, None, "script", []), (1, 1, "x", "say", [0]), (1, 2, "y", "ask", [1])]
    nodes = spark.createDataFrame(rows, "k int, node int, ext_id string, type string, places array<int>")
    hints = spark.createDataFrame([(1, 1, "y", None, None), (2, 1, "no", "x", "ask"), (3, 1, None, None, "say"), (4, 1, None, "no", None)], "hint int, k int, parent_id string, root_id string, root_type string")
    assert sorted((r.hint, r.node) for r in joins.resolved_parent(hints, nodes, "k").collect()) == [(1, 2), (2, 1), (3, 1), (4, None)]
    copy = spark.createDataFrame([(1, 0, None, "script", []), (1, 1, "y", "ask", [0]), (1, 2, "z", "say", [1])], nodes.schema)
    assert sorted((r.node, r.there) for r in joins.in_copy(nodes, copy, "k").collect()) == [(0, 0), (1, 1), (2, 1)]


def test_debug_json_cache_and_refs(spark, tmp_path):
    import json

    out = json.loads(exports.debug_json(tree("script { a }"), tree("script { b }")))
    assert {e["action"] for e in out["edits"]} == {"insert", "delete"} and out["pairs"][0]["type"] == "script"
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for mode, n in (("use", 1), ("use", 1), ("overwrite", 2), ("ignore", 3)):
        assert exports.cached(spark, str(tmp_path / "c"), 1, make, mode).count() == 3 and len(made) == n
    df = spark.createDataFrame([('[{"id":"a"},{"id":"q"}]', {"a": 7}), (None, None)], "code string, m map<string,int>")
    assert [r[0] for r in df.select(exports.with_anonymous_refs(F.col("code"), F.col("m"))).collect()] == ['[{"id":7},{"id":"q"}]', None]
    exports.bundle(str(tmp_path / "b"), spark.range(2), spark.range(1), {"Assignment": spark.range(1)}, {"Version": "1"})
    assert spark.read.csv(str(tmp_path / "b/DatasetMetadata"), header=True).collect()[0].Value == "1"
    exports.capture(spark.createDataFrame([("h", "<a/>", "{}"), ("h", "<a/>", "{}")], "assignment string, xml string, hint string"), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 1


def test_traces_are_read_as_a_stream(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, None]), k, rng.randint(0, 500), rng.choice("xy")) for k in range(300)]
    log = spark.createDataFrame(rows, "attempt int, id int, t int, message string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # traces go on over batches
    try:
        got = sorted((str(r.attempt), r.t, r.id) for r in trace.thinned(log, 50, "message").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for a in (1, 2, None):
        own, last = sorted((t, i, m) for x, i, t, m in rows if x == a), None
        for k, (t, i, m) in enumerate(own):
            if last is None or k == len(own) - 1 or (t - last[0] >= 50 and m != last[1]):
                want.append((str(a), t, i))
                last = (t, m)
    assert got == sorted(want)


def test_alignment_with_names():
    a, b = tree("script { set:x say:x }"), tree("script { set:n say:n }")
    exact, mapped = (alignment.edits(a, b, alignment.align(a, b, c), c) for c in (alignment.Config(values="exact"), alignment.Config(values="mapped")))
    assert mapped == [] and exact


def test_steps_and_references():
    from arborlog.functions import sequences as q

    rng = random.Random(9)
    for _ in range(400):
        a, b = rng.choices("abc", k=rng.randint(0, 6)), rng.choices("abcd", k=rng.randint(0, 6))
        for n in range(40):
            if a == b:
                break
            a = q.next_edit(a, b)
        assert a == b
    assert q.directed_distance("abx", "ab") == 0 and q.directed_distance("a", "ab") == 0.5
    t = tree("script { a:1 b { c } }")
    assert trees.reference(t.children[1].children[0]) == '{"label": "c", "index": 0, "parent": {"label": "b", "index": 1, "parent": {"label": "script", "index": 0, "parent": null}}}'
    assert trees.pretty(t) == "script\n  a: 1\n  b\n    c"
    a, b = tree("script { a b { c } }"), tree("script { b { c d } e }")
    n = 0
    while a is not None and a.text() != b.text():
        a, n = trees.one_step(a, b), n + 1
    assert a.text() == b.text() and n <= 3


def test_priorities(spark):
    t, sols = tree("script { a }"), [tree("script { a b }"), tree("script { a b c }"), tree("script { x }")]
    others = [alignment.edits(t, s, alignment.align(t, s)) for s in sols]
    found = alignment.with_priorities(others[0], list(t.walk()), others)
    assert [(e["type"], round(p, 2)) for e, p in found] == [("b", 0.67)]
    assert alignment.nearest_by_text(t, sols) is sols[2] or alignment.nearest_by_text(t, sols) is sols[0]
    ordered = alignment.by_order(others[1], {"a"}, {("b", "c"): 0.9, ("a", "b"): 1.0})
    assert [(e["type"], m) for e, m, _ in ordered] == [("b", 0), ("c", 1)]
    rows = [(k, [tuple(x.values()) for x in trees.pack(n)]) for k, n in (("s0", sols[0]), ("s1", sols[1]))]
    asked = spark.createDataFrame([("q", [tuple(x.values()) for x in trees.pack(t)])], f"query string, tree {trees.TREE}")
    got = alignment.cost_matrix(asked, spark.createDataFrame(rows, f"solution string, tree {trees.TREE}"), ["s0", "s1"]).first()
    assert got.s0 == alignment.align(t, sols[0]).cost and got.s1 == alignment.align(t, sols[1]).cost


def test_functions_in_sql(spark):
    from arborlog.functions import sql

    sql.register(spark)
    one = spark.sql("SELECT align_cost(array('a', 'b'), array('a')) AS c, tree_distance('{\"type\":\"a\"}', '{\"type\":\"b\"}') AS d").first()
    assert tuple(one) == (1.0, 1.0)
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM aligned_pairs(array('a', 'b'), array('b'))").collect()) == [(0, -1), (1, 0)]
    assert [tuple(r) for r in spark.sql("SELECT * FROM tree_edits('{\"type\":\"script\"}', '{\"type\":\"script\",\"children\":[{\"type\":\"x\"}]}')").collect()] == [("insert", -1, 0, "x")]
    assert spark.sql("SELECT * FROM tree_grams('{\"type\":\"a\"}', 1, 1)").first().gram == "a *"


def test_more_sources(spark, tmp_path):
    import pytest

    from arborlog.sources import logs
    from arborlog.streaming import traces

    for s, name, text in (("amy", "1.json", '{"type":"a","correct":true}'), ("amy", "2.json", "{"), ("amy", "3.json", '{"type":"b"}'), ("bob", "1.json", '{"type":"c"}')):
        (tmp_path / "ast" / s).mkdir(parents=True, exist_ok=True)
        (tmp_path / "ast" / s / name).write_text(text)
    assert sorted((r.student, r.file, r.correct) for r in logs.tree_states(spark, str(tmp_path / "ast")).collect()) == [("amy", "1.json", True), ("bob", "1.json", False)]
    body = spark.createDataFrame([('{"xml":"<a/>","assignmentID":"h","hintTypes":"x,y"}',), (None,)], "body string")
    got = logs.hint_requests(body).collect()
    assert (got[0].assignment, got[0].min_grade, got[0].hint_types) == ("h", 1.0, ["x", "y"]) and got[1].xml is None
    (tmp_path / "p7.csv").write_text("id,time,message,projectID,assignmentID\n1,2020-01-01 00:00:00,go,p,h\n")
    log = logs.action_log(spark, str(tmp_path / "p7.csv"))
    assert log.first().attempt == "p7"
    assert logs.cross_rows(log, "h", spark.createDataFrame([("p7",)], "attempt string")).count() == 1 and logs.cross_rows(log, "x", log).count() == 0
    (tmp_path / "g.csv").write_text("Project ID,Graded ID,Outlier?,t1\np,5,,pass\n,,,\nq,6,,fail\n")
    assert [r.attempt for r in logs.grades(spark, str(tmp_path / "g.csv")).collect()] == ["p"]
    with pytest.raises(ValueError):
        trees.from_xml('<project><ref id="9"/></project>', trees.TAGS)
    assert trees.from_xml('<project><block s="x"><ref id="9"/></block></project>', trees.TAGS).text() == "project:[x]"
    spark.createDataFrame([("a",), ("b",), ("a",)], "m string").write.parquet(str(tmp_path / "in"))
    traces.growing_counts(spark.readStream.schema("m string").parquet(str(tmp_path / "in")), str(tmp_path / "model"), ["m"], str(tmp_path / "c")).awaitTermination()
    assert sorted(tuple(r) for r in traces.grown(spark, str(tmp_path / "model"), ["m"]).collect()) == [("a", 2), ("b", 1)]


def test_models_are_built_in_order(spark):
    import pytest

    from arborlog.plans import models, templates

    log = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "attempt int, message string")
    counts = models.Model("counts", lambda x, _: x.groupBy("message").count(), finish=lambda rows: rows.where("count > 1"))
    share = models.Model("share", lambda x, made: made["counts"].withColumn("n", F.lit(x.count())), ("counts",))
    got = models.built(log, [share, counts])
    assert [tuple(r) for r in got["counts"].collect()] == [("a", 2)] and got["share"].count() == 2
    with pytest.raises(ValueError):
        models.in_order([models.Model("x", None, ("y",))])
    assert templates.with_defaults(tree("script { ask say }"), tree("stage { ask { literal:hi } say { var } }")).text() == "script:[ask:[literal=hi], say]"


def test_tables_of_catalogs_and_grades(spark, tmp_path):
    from arborlog.sources import logs, sinks

    (tmp_path / "e.csv").write_text("Message,Translated Event,Ignore\na,EDIT,\nb,EDIT,yes\nc,,\n")
    assert sorted((r.message, r.category) for r in logs.categories(spark, str(tmp_path / "e.csv")).collect()) == [("a", "EDIT"), ("b", None), ("c", None)]
    (tmp_path / "b.json").write_text('{"move":{"type":"command","category":"motion"},"not":{"type":"predicate","category":"ops"}}')
    assert sorted((r.type, r.category, r.kind) for r in logs.block_catalog(spark, str(tmp_path / "b.json")).collect()) == [("move", "motion", "command"), ("not", "ops", "reporter")]
    (tmp_path / "c.csv").write_text("AnonID,hw1,hw2\nx,5,\n")
    (tmp_path / "t.csv").write_text("AnonID,hw1,hw2\ntotal,10,20\n")
    assert sorted((r.assignment, r.grade) for r in logs.class_grades(spark, str(tmp_path / "c.csv"), str(tmp_path / "t.csv")).collect()) == [("hw1", 0.5), ("hw2", None)]
    main = spark.createDataFrame([(1, "s")], "id int, CodeStateID string")
    assert logs.code_states(main, spark.createDataFrame([("s", "code")], "CodeStateID string, Code string")).first().Code == "code"
    assert sinks.model_path("m", "hw", 0.5, "d") == "m/hw-g050-d"
    sinks.save_model({"edges": spark.range(2)}, str(tmp_path / "model"))
    assert spark.read.parquet(str(tmp_path / "model/edges")).count() == 2
    (tmp_path / "x").mkdir()
    (tmp_path / "x/1.xml").write_text("<project><stage/></project>")
    assert logs.documents(spark, str(tmp_path / "x"), "xml").first().tree[1].type == "stage"
