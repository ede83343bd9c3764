"""Sequences, trees, alignment, graphs, mining and templates."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlog.functions import sequences as q
from arborlog.operators import alignment, graphs, mining, trees
from arborlog.plans import templates
from arborlog.sources import logs, sinks

J = trees.from_json


def test_sequence_functions_on_known_cases():
    assert q.align_cost("abc", "acb") == 2
    assert q.progress("ac", "abc") == 3.75
    assert q.missing_count("ac", "abc") == 1
    assert 0.25 * q.missing_count("ac", "abc") - q.progress("ac", "abc") == -3.5
    assert q.context_distance("abc", 1, "axd", 1) == 0.5
    assert [round(q.distance_weight(d), 4) for d in (0, 0.5, 1)] == [1, 0.25, 0.1111]
    assert q.norm_align_cost("", "") == 0 and q.align_score("ab", "ab") == 1
    assert q.reordered("ba", "abc", [1, 1, 0]) == [1, 0, 2]
    assert q.progress("ba", "ab", [1, 1]) == 4 and q.progress("ba", "ab") == 2 + 1 - 0.25


def test_alignments_are_of_least_cost():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 6))) for _ in range(2))
        pairs = q.align_pairs(a, b, 1, 1, 2)
        assert [i for i, _ in pairs if i >= 0] == list(range(len(a))) and [j for _, j in pairs if j >= 0] == list(range(len(b)))
        assert all(a[i] == b[j] for i, j in pairs if i >= 0 and j >= 0)
        assert sum(1 for i, j in pairs if i < 0 or j < 0) == q.align_cost(a, b, 1, 1, 2)


def test_sequence_columns(spark):
    df = spark.createDataFrame([(["a", "c"], ["a", "b", "c"]), (None, ["a"])], "a array<string>, b array<string>")
    got = df.select(q.align_cost_col(F.col("a"), F.col("b")), q.missing_count_col(F.col("a"), F.col("b")), q.progress_col(F.col("a"), F.col("b"))).collect()
    assert tuple(got[0]) == (1.0, 1, 3.75) and got[1][0] is None


def test_parsers_and_packing():
    t = trees.from_xml('<project><stage name="S"><script><block s="doIf"><l>5</l><block var="x"/></block><comment/></script></stage></project>')
    assert t.text() == "project:[stage=S:[script:[doIf:[literal=5, block=x]]]]"
    assert trees.unpack(trees.pack(t)).text() == t.text() and J(trees.to_json(t)).text() == t.text()
    assert trees.from_xml("<a>") is None and trees.from_xml("") is None and trees.from_xml(None) is None and trees.from_xml("<a>" + "x" * 64993 + "</a>") is None
    assert J("{") is None and J(None) is None and J('{"value": 1}') is None
    assert trees.from_html("<p>a<br><b>c</p></i><p>").text() == "document:[p:[br, b], p]" and trees.from_html("<ul><li>a<li>b<ul><li>c</ul></ul>").text() == "document:[ul:[li, li:[ul:[li]]]]"


def test_canonical_forms():
    assert trees.canonical(J('{"type":"reportGreaterThan","children":[{"type":"b"},{"type":"a"}]}')).text() == "reportLessThan:[a, b]"
    assert trees.canonical(J('{"type":"reportSum","children":[{"type":"b"},{"type":"a"}]}')).text() == "reportSum:[a, b]"
    assert trees.pruned_leaves(J('{"type":"r","children":[{"type":"list","children":[{"type":"literal"}]},{"type":"literal","value":"1"}]}'), {"literal", "list"}).text() == "r:[literal=1]"
    assert trees.largest_script(J('{"type":"sprite","children":[{"type":"script"},{"type":"script","children":[{"type":"a"}]}]}'), {"sprite"}, {"script"}).text() == "sprite:[script:[a]]"


def test_tree_distance():
    a, b = J('{"type":"X","children":[{"type":"a"},{"type":"b","children":[{"type":"c"}]}]}'), J('{"type":"X","children":[{"type":"a"},{"type":"c"}]}')
    assert trees.tree_distance(a, b) == 1 and trees.tree_distance(a, a) == 0 and trees.tree_distance(b, a, insert=5) == 5


def test_node_table(spark):
    df = spark.createDataFrame([(1, '{"type":"sprite","children":[{"type":"script","children":[{"type":"doIf","children":[{"type":"script","children":[{"type":"doAsk","id":"7"}]}]}]}]}'), (2, None)], "k int, j string")
    packed = df.select("k", trees.packed(F.col("j"), "json").alias("tree"))
    nodes = trees.node_table(packed)
    assert nodes.count() == 5
    leaf = nodes.where("type = 'doAsk'")
    for pattern, want in ((["sprite|customBlock", "...", "script", "doAsk"], 1), (["script", "doAsk"], 1), (["sprite", "doAsk"], 0), (["sprite", "script", "...", "doAsk"], 0), (["sprite", "...", "doAsk"], 1)):
        assert leaf.where(trees.backbone(pattern)).count() == want, pattern
    paths = spark.createDataFrame([(list("abxbc"),), (list("abc"),), (list("abxc"),), (list("abbc"),)], "path array<string>")
    assert [r[0] for r in paths.select(trees.backbone(["a", "b", "...", "c"])).collect()] == [False, True, True, False]
    assert leaf.select(trees.root_path(2)).first()[0] == "script->doAsk"
    assert trees.descendants(nodes.where("type = 'doIf'"), nodes, ["k"]).count() == 2
    assert trees.repacked(nodes, ["k"]).first().tree == packed.where("k = 1").first().tree
    assert sorted(r[0] for r in nodes.select(trees.stable_id(["k"])).collect()) == ["7", "GEN_doIf_1_0", "GEN_script_0_0", "GEN_script_2_0", "GEN_sprite_-1_0"]
    assert {r.type: r.flexible for r in sinks.grammar(nodes, ["k"]).collect()} == {"sprite": False, "script": False, "doIf": False, "doAsk": False}


def test_hungarian():
    rng = np.random.default_rng(0)
    for _ in range(200):
        r, c = (int(x) for x in rng.integers(1, 6, 2))
        cost = rng.integers(0, 20, (r, c)).astype(float)
        got = alignment.hungarian(cost)
        k = min(r, c)
        best = min(sum(cost[i, j] for i, j in zip(a, b, strict=True)) for a in itertools.combinations(range(r), k) for b in itertools.permutations(range(c), k))
        assert sum(cost[i, j] for i, j in enumerate(got) if j >= 0) == best and len({j for j in got if j >= 0}) == k


def test_edits():
    a = J('{"type":"script","children":[{"type":"a"},{"type":"b"},{"type":"x"}]}')
    b = J('{"type":"script","children":[{"type":"b"},{"type":"a"},{"type":"c"}]}')
    m = alignment.align(a, b)
    kinds = sorted(e["action"] + ":" + e["type"] for e in alignment.edits(a, b, m))
    assert kinds in (["delete:x", "insert:c", "reorder:a"], ["delete:x", "insert:c", "reorder:b"])
    same = a.copy()
    assert alignment.edits(a, same, alignment.align(a, same)) == []
    assert alignment.applied(a, alignment.edits(a, b, m)).text() == b.text()
    assert alignment.align(a, same).cost < m.cost


def random_tree(rng, n):
    root = trees.Node("script")
    every = [root]
    for _ in range(n):
        p, c = rng.choice(every), trees.Node(rng.choice(["script", "say", "ask", "literal", "doIf"]), rng.choice([None, "1", "x"]))
        c.parent = p
        p.children.insert(rng.randint(0, len(p.children)), c)
        every.append(c)
    return root


@pytest.mark.parametrize("values", ["ignore", "mapped", "exact"])
def test_applied_edits_give_the_target(values):
    rng, cfg = random.Random(3), alignment.Config(values=values)
    for _ in range(600):
        a = random_tree(rng, rng.randint(0, 12))
        b = random_tree(rng, rng.randint(0, 12)) if rng.random() < 0.5 else a.copy()
        if rng.random() < 0.5:
            rng.shuffle(b.children)
        text = a.text()
        got, want = alignment.applied(a, alignment.edits(a, b, alignment.align(a, b, cfg), cfg)), b.copy()
        if values != "exact":
            for n in (*got.walk(), *want.walk()):
                n.value = None
        assert got.text() == want.text() and a.text() == text


def test_edits_respect_groups_wildcards_and_ids():
    a = J('{"type":"script","children":[{"type":"b"},{"type":"a"},{"type":"loop","children":[{"type":"x"},{"type":"y"}]}]}')
    b = templates.variants("script { @anyOrder { a b } loop { @anything } }")[0]
    b = trees.unpack(trees.pack(b))
    assert alignment.edits(a, b, alignment.align(a, b)) == []
    c, d = J('{"type":"script","children":[{"type":"say","id":"1"},{"type":"say","id":"2"}]}'), J('{"type":"script","children":[{"type":"say","id":"2"},{"type":"say","id":"1"},{"type":"ask","id":"3"}]}')
    found = alignment.edits(c, d, alignment.by_ids(c, d))
    assert sorted(e["action"] for e in found) == ["insert", "reorder"] and alignment.applied(c, found).text() == d.text()
    nodes = list(c.walk())
    assert len({alignment.edit_key(e, nodes) for e in found}) == 2
    put = next(e for e in found if e["action"] == "insert")
    assert alignment.shown(put, nodes) == {"message": "insert", "parent": "script", "from": ["say", "say"], "to": ["say", "ask", "say"]} or alignment.shown(put, nodes)["to"].count("ask") == 1
    assert [e["action"] for e in alignment.displayed(found)] == ["insert"]


def test_deletions_below_deletions_are_implied():
    a, b = J('{"type":"script","children":[{"type":"doIf","children":[{"type":"say"}]},{"type":"x"}]}'), J('{"type":"script"}')
    found = alignment.edits(a, b, alignment.align(a, b))
    left = alignment.cleaned(found, list(a.walk()), frozenset({"x"}))
    assert [e["type"] for e in left] == ["doIf"] and len(found) == 3
    c = J('{"type":"script","children":[{"type":"doIf","children":[{"type":"ask","children":[{"type":"y"}]}]}]}')
    more = alignment.edits(b, c, alignment.align(b, c))
    assert alignment.nested(more) == [(1, 0), (2, 1)]


def test_nearest_bound_is_below_the_cost():
    rng = random.Random(8)
    cfg = alignment.Config()
    for _ in range(400):
        a, b = random_tree(rng, rng.randint(0, 10)), random_tree(rng, rng.randint(0, 10))
        known = alignment.Solutions([("k", 1, trees.pack(b), "")], cfg)
        assert known.bounds(trees.pack(a))[0] <= alignment.align(a, b, cfg).cost + 1e-9


def test_nearest_solutions_and_votes(spark, monkeypatch):
    sols = templates.solutions(spark, {"t": "script { a b @or { c d } @optional { e } }"})
    assert sols.count() == 4
    ask = spark.createDataFrame([("q", [tuple(x.values()) for x in trees.pack(J('{"type":"script","children":[{"type":"a"},{"type":"b"},{"type":"c"}]}'))])], f"query string, tree {trees.TREE}")
    near = alignment.nearest(ask, sols, 3)
    rows = near.orderBy("rank").collect()
    assert len(rows) == 3 and rows[0].edits == [] and [r["rank"] for r in rows] == [1, 2, 3]
    whole = [tuple(r) for r in rows]
    monkeypatch.setattr(alignment, "BROADCAST_SOLUTIONS", 2)
    assert [tuple(r) for r in alignment.nearest(ask, sols, 3).orderBy("rank").collect()] == whole
    votes = alignment.consensus(near, 0.3).collect()
    assert all(v.priority >= 1 / 3 for v in votes)


def test_backup_on_the_known_chain(spark):
    assert graphs.backup(["g", "s", "t"], [2, 0, 0], [("t", "s", 1), ("s", "g", 1), ("s", "s", 9)]) == {"g": 200.0, "s": 198.0, "t": 196.015625}
    v = spark.createDataFrame([("x", "g", 2), ("x", "s", 0), ("x", "t", 0)], "graph string, state string, goals long")
    e = spark.createDataFrame([("x", "t", "s", 1), ("x", "s", "g", 1)], "graph string, source string, target string, weight long")
    value = graphs.values(v, e)
    steps = {r.source: r.target for r in graphs.best_steps(e, value).collect()}
    assert graphs.follow(steps, "t") == ["t", "s", "g"]


def test_clusters():
    x = np.array([0, 1, 2, 50, 51, 52.0])
    d = np.abs(x[:, None] - x[None])
    got = graphs.k_medoids(d, 2)
    assert got[:3] == [1] * 3 and got[3:] == [4] * 3
    assert graphs.average_linkage(d)[-1][2] == 50.0
    assert "<node id=" in graphs.graphml([("a&b", 1, 2.0)], [("a&b", "c", 1, 1.0, True)])


def test_grams(spark):
    t = J('{"type":"X","children":[{"type":"a"},{"type":"a"}]}')
    assert mining.pq_grams(t, 1, 1) == {("X", "a"): 2, ("a", "*"): 1}
    assert mining.profile(t, 1, 1)[("a", "*")] == 2
    assert mining.profile_distance(t, t) == 0
    df = spark.createDataFrame([(1, [tuple(x.values()) for x in trees.pack(t)])], f"k int, tree {trees.TREE}")
    bag = {r.gram: r.n for r in mining.grams(df, "k", p=2, q=2, bag=True).collect()}
    assert bag == {" ".join(g): n for g, n in mining.profile(t, 2, 2).items()}
    jvm = {r.gram: r.n for r in mining.root_path_grams(trees.node_table(df), ["k"], 2, 2).collect()}
    assert jvm == bag
    assert mining.disjunctions({"a": {1, 2}, "b": {3, 4}, "c": {1, 2, 3}}, 4) == [("a", "b")]


def test_templates():
    texts = [n.text() for n in templates.variants("snapshot { // two scripts\n script { ask @repeat(1, 2) { wait } } say:`hi there` }")]
    assert texts == ["snapshot:[script:[ask, wait], say=hi there]", "snapshot:[script:[ask, wait, wait], say=hi there]"]
    n = templates.variants("@defBlock(b) { x } script { @block(b) @if(v) { y } @defVar(v) @unless(v) { z } @+inline { w } }")
    assert sorted(x.text() for x in n) == ["script:[x, w]", "script:[x]"]
    any_ = templates.variants("script { @anyOrder { a b } loop { @anything } }")[0]
    assert [c.order_group for c in any_.children] == [1, 1, 0] and any_.children[2].any_children
    assert templates.problems("reportGreaterThan") == ["reportGreaterThan should be reportLessThan"]
    for bad in ("a {", "a }", "@what", "@block(b)"):
        with pytest.raises(ValueError):
            templates.variants(bad)


def test_template_hints():
    text = "@defHint(h, `say hello`) script { @hint(h) { say } @hint(`ask now`) { ask { x } } }"
    assert templates.hints(text) == [(0, 1, "say hello"), (0, 2, "ask now")]


def test_deep_trees():
    t = trees.from_html("<div>" * 3000 + "x")
    assert t.copy().size == 3001 and t.text().count("div") == 3000 and trees.pruned_leaves(t.copy(), {"div"}).size == 1
    assert trees.tree_distance(trees.from_html("<p>a<p>b"), trees.from_html("<p>a<p>b<br>")) == 1


def test_log_source_and_sinks(spark, tmp_path):
    (tmp_path / "log.csv").write_text('id,time,message,jsonData,projectID,sessionID,code\n1,2020-01-02 03:04:05,go,"{""a"": 1}",p 1,s,"<a>\n</a>"\nx,2020-01-02 03:04:06,stop,,p 1,s,\n3,,none,,,s,\n')
    rows = logs.action_log(spark, str(tmp_path / "log.csv")).orderBy("time").collect()
    assert [(r.id, r.message, r.code) for r in rows] == [(1, "go", "<a>\n</a>"), (-1, "stop", None)] and rows[0].data == '{"a": 1}'
    log = logs.action_log(spark, str(tmp_path / "log.csv")).withColumn("assignment_id", F.lit("hw/1"))
    sinks.split_by_project(log, str(tmp_path / "out"))
    assert (tmp_path / "out/assignment=hw_1/project=p_1").is_dir()
    (tmp_path / "sub.txt").write_text("a,home,-1\nb,,7\n")
    assert sorted((r.attempt, r.row) for r in logs.submissions(spark, str(tmp_path / "sub.txt")).collect()) == [("a", None), ("b", 7)]
    (tmp_path / "g.csv").write_text("Project ID,Graded ID,Outlier?,t1,t2\np,5,,pass,1\nq,6,yes,fail,2\n")
    assert sorted((r.attempt, r.test, r.score) for r in logs.grades(spark, str(tmp_path / "g.csv")).collect()) == [("p", "t1", 2), ("p", "t2", 1), ("q", "t1", None), ("q", "t2", None)]
    (tmp_path / "bad.csv").write_text('a,b\n1,"x,y"\n1,2,3\n')
    assert [r.n for r in logs.broken_lines(spark, str(tmp_path / "bad.csv")).collect()] == [3]


def test_values_replacements_and_hints(spark):
    a = J('{"type":"script","children":[{"type":"set","value":"x"},{"type":"say","value":"y"},{"type":"p"}]}')
    b = J('{"type":"script","children":[{"type":"set","value":"n"},{"type":"say","value":"y"},{"type":"q"}]}')
    m = alignment.align(a, b)
    assert alignment.value_mapping(a, m) == {"x": "n", "y": "y"}
    found = alignment.with_replacements(alignment.edits(a, b, m))
    assert [(e["action"], e["node"], e["type"]) for e in found] == [("replace", 3, "q")]
    assert alignment.closest_match(a.children[2], m) is b
    assert graphs.nearest_state(("a", "b", "x"), {("a", "b"): 1.0, ("a", "b", "c"): 5.0}) == ("a", "b")
    assert graphs.nearest_state(("a",), {("b", "c", "d", "e"): 1.0}) is None
    assert mining.gram_edits(J('{"type":"X","children":[{"type":"a"}]}'), J('{"type":"X","children":[{"type":"b"}]}')) == [("relabel", "X", "a>b")]
    e = spark.createDataFrame([("g", "s", "s", 1), ("g", "s", "t", 3)], "graph string, source string, target string, weight long")
    assert graphs.stays(e).first().stayed == 0.25
