"""Queries of trees, names, payloads, graphs, rules and evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payloads
from ..operators import canonical, evaluation, filters, graphs, joins, mining, stats, trace, trees
from .more import EDGES, GRAMS, TONE, _talks
from .registry import LOG, UP, W, _r, table

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


def _nodes(spark, d):
    return trees.node_table(_talks(spark, d), keys=["conv_id"])


TALK = f"t AS (SELECT conv_id, turn, role, {TONE} AS tone, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"


# --- trees ---
@query(f"WITH {TALK}, e AS (SELECT conv_id, list(role ORDER BY i) AS l FROM t GROUP BY 1) SELECT conv_id, coalesce(list_position(l[2:4], 'user'), 0)::BIGINT + CASE WHEN list_position(l[2:4], 'user') > 0 THEN 0 ELSE -1 END AS place FROM e")
def tree_child_search(spark, d):
    nodes = _nodes(spark, d).where("depth = 0")
    return nodes.select("conv_id", filters.child_place(F.col("types"), "user", 1, 4).cast("long").alias("place"))


@query(f"WITH {TALK} SELECT conv_id, role AS parent, tone AS type, count(*) AS n FROM t GROUP BY 1, 2, 3")
def tree_parent_types(spark, d):
    nodes = _nodes(spark, d).where("depth = 2")
    return nodes.groupBy("conv_id", filters.parent_type(F.col("path")).alias("parent"), "type").agg(F.count("*").alias("n"))


@query(f"""WITH {TALK} SELECT conv_id, 0 AS node, -1 AS parent, 0 AS idx, 'script' AS type, 0 AS depth, (2 * max(n))::INT AS post, (2 * max(n) + 1)::INT AS tree_size, 'script' AS path FROM t GROUP BY 1
UNION ALL SELECT conv_id, (2 * i + 1)::INT, 0, i::INT, role, 1, (2 * i + 2)::INT, 2, 'script->' || role FROM t UNION ALL SELECT conv_id, (2 * i + 2)::INT, (2 * i + 1)::INT, 0, tone, 2, (2 * i + 2)::INT, 1, 'script->' || role || '->' || tone FROM t""")
def tree_talk_nodes(spark, d):
    return _nodes(spark, d).select("conv_id", "node", "parent", "idx", "type", "depth", "post", "tree_size", trees.root_path().alias("path"))


@query(f"WITH {TALK} SELECT conv_id, (2 * i + 2)::INT AS node, tone AS type FROM t WHERE role = 'user'")
def tree_talk_descendants(spark, d):
    nodes = _nodes(spark, d)
    return trees.descendants(nodes.where("type = 'user'"), nodes, ["conv_id"]).select("conv_id", "node", "type")


@query(f"""WITH {TALK}, c AS (SELECT 'script' AS type, i AS place, role AS child FROM t UNION ALL SELECT role, 0, tone FROM t), k AS (SELECT type, place, string_agg(DISTINCT child, '|' ORDER BY child) AS kinds FROM c GROUP BY 1, 2),
x AS (SELECT type, string_agg(place || ':' || kinds, ' ' ORDER BY place) AS children FROM k GROUP BY 1) SELECT type, CASE WHEN type = 'script' THEN (SELECT count(DISTINCT n) > 1 FROM t) ELSE false END AS flexible, children FROM x UNION ALL SELECT DISTINCT tone, false, '' FROM t""")
def export_talk_grammar(spark, d):
    from ..sources import sinks

    rows = sinks.grammar(_nodes(spark, d), ["conv_id"])
    shown = F.array_join(F.transform("children", lambda x: F.concat(x["place"].cast("string"), F.lit(":"), F.array_join(x["kinds"], "|"))), " ")
    return rows.select("type", "flexible", F.coalesce(shown, F.lit("")).alias("children"))


@query(f"WITH {TALK} SELECT conv_id, 'Tree:' || i AS place, role AS type FROM t UNION ALL SELECT conv_id, 'Tree:' || i || ':0', tone FROM t UNION ALL SELECT DISTINCT conv_id, 'Tree:', 'script' FROM t")
def tree_locations(spark, d):
    return _nodes(spark, d).select("conv_id", payloads.location(F.col("places")).alias("place"), "type")


@query(f"WITH {TALK} SELECT label, count(*) AS n FROM (SELECT role AS label FROM t UNION ALL SELECT role || '->' || tone FROM t UNION ALL SELECT DISTINCT '' || left('', conv_id::INT * 0) AS label FROM (SELECT DISTINCT conv_id FROM t)) WHERE label <> '' GROUP BY 1")
def tree_ordering_labels(spark, d):
    nodes = _nodes(spark, d).where("depth > 0")
    return nodes.groupBy(payloads.ordering_label(F.col("path"), ["script"]).alias("label")).agg(F.count("*").alias("n"))


@query(f"""WITH {TALK}, r AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY i) - 1 AS k FROM t)
SELECT 'GEN_' || role || '_0_' || k AS id, count(*) AS n FROM r GROUP BY 1""")
def tree_generated_ids(spark, d):
    nodes = _nodes(spark, d).where("depth = 1").select("conv_id", trees.stable_id(["conv_id"]).alias("id"))
    return nodes.groupBy("id").agg(F.count("*").alias("n"))


@query(f"WITH {TALK}, s AS (SELECT conv_id, string_agg(role, ',' ORDER BY i) AS types FROM t GROUP BY 1) SELECT types, count(*) AS n FROM s GROUP BY 1")
def tree_child_types(spark, d):
    nodes = _nodes(spark, d).where("depth = 0")
    return nodes.groupBy(F.array_join("types", ",").alias("types")).agg(F.count("*").alias("n"))


@query(f"""WITH {TALK}, p AS (SELECT conv_id, i::VARCHAR AS p FROM t UNION ALL SELECT conv_id, i || ':0' FROM t UNION ALL SELECT DISTINCT conv_id, '' FROM t)
SELECT a.conv_id, count(*) AS nodes, count(b.p) AS there FROM p a LEFT JOIN (SELECT conv_id + 1 AS conv_id, p FROM p) b ON a.conv_id = b.conv_id AND a.p = b.p GROUP BY 1""")
def join_in_copy(spark, d):
    """The nodes of a conversation's tree that the one before it has at the same places."""
    nodes = _nodes(spark, d).select("conv_id", "node", "ext_id", "places")
    found = joins.in_copy(nodes, nodes.withColumn("conv_id", F.col("conv_id") + 1), "conv_id")
    return found.groupBy("conv_id").agg(F.count("*").alias("nodes"), F.count("there").alias("there"))


@query(f"""WITH {TALK} SELECT conv_id * 10 + 1 AS hint, min(2 * i + 1) AS node FROM t WHERE role = 'user' GROUP BY conv_id""")
def join_hint_parents(spark, d):
    nodes = _nodes(spark, d)
    none = F.lit(None).cast("string")
    hints = nodes.where("type = 'user'").select("conv_id").distinct().select((F.col("conv_id") * 10 + 1).alias("hint"), "conv_id", none.alias("parent_id"), none.alias("root_id"), F.lit("user").alias("root_type"))
    return joins.resolved_parent(hints, nodes, "conv_id").select("hint", F.col("node").cast("long").alias("node"))


# --- canonical forms ---
@query("SELECT l_orderkey, l_linenumber, least(l_returnflag, l_linestatus) AS a, greatest(l_returnflag, l_linestatus) AS b FROM lineitem")
def canonical_symmetric(spark, d):
    """The arguments of a symmetric operator in order, JVM-side."""
    pair = F.array_sort(F.array("l_returnflag", "l_linestatus"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", pair[0].alias("a"), pair[1].alias("b"))


@query("""SELECT p_partkey, regexp_replace('do %''' || p_brand || ''' with %''' || p_type || '''', '%''[^'']*''', '%s', 'g') AS selector, 2 AS inputs FROM part""")
def canonical_selectors(spark, d):
    name = F.concat(F.lit("do %'"), "p_brand", F.lit("' with %'"), "p_type", F.lit("'"))
    return table(spark, d, "part").select("p_partkey", canonical.selector(name).alias("selector"), F.size(canonical.inputs(name)).alias("inputs"))


@query("SELECT p_partkey, CASE WHEN p_size <= 5 THEN p_brand ELSE 'evaluateCustomBlock' END AS type, CASE WHEN p_size <= 5 THEN '' ELSE p_brand || '/' || p_size END AS value FROM part")
def canonical_called_blocks(spark, d):
    parts = table(spark, d, "part")
    calls = parts.select("p_partkey", F.when(F.col("p_size") <= 5, F.col("p_brand")).otherwise(F.concat_ws("/", "p_brand", F.col("p_size").cast("string"))).alias("name"))
    found = canonical.called_blocks(calls, parts.select(F.col("p_brand").alias("name")).distinct())
    return found.select("p_partkey", "type", F.coalesce("value", F.lit("")).alias("value"))


@query("""SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey IN (1, 3) THEN 'edited ' || s_suppkey WHEN s_nationkey = 2 THEN 'of two' ELSE s_name END AS s_name, s_suppkey IN (1, 3) OR s_nationkey = 2 AS edited FROM supplier""")
def canonical_overlay(spark, d):
    edits = spark.createDataFrame([(1, None, "edited 1"), (3, None, "edited 3"), (None, 2, "of two")], "s_suppkey long, s_nationkey long, s_name string")
    stored = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.col("s_nationkey").cast("long").alias("s_nationkey"), "s_name")
    return canonical.with_edits(stored, edits, "s_suppkey", "s_nationkey", ["s_name"])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'varMenu' WHEN l_returnflag = 'A' AND l_linenumber = 2 THEN 'option' ELSE 'literal' END AS kind FROM lineitem")
def canonical_literal_kinds(spark, d):
    kind = canonical.literal_kind(F.col("l_returnflag"), F.col("l_linenumber"), {"R": 1}, {"A": 2})
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"))


@query("SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN CASE event_type WHEN 'view' THEN 'v1' END ELSE TRY_CAST(CASE WHEN event_type = 'click' THEN value::INT::VARCHAR ELSE event_type END AS INT)::VARCHAR END, '-') AS kept FROM events")
def canonical_sanitised(spark, d):
    value = F.when(F.col("event_type") == "click", F.bround("value", 0).cast("int").cast("string")).otherwise(F.col("event_type"))
    kind = F.when(F.col("event_type") == "view", "name").otherwise("literal")
    return table(spark, d, "events").select("event_id", F.coalesce(canonical.sanitised(value, kind, {"view": "v1"}), F.lit("-")).alias("kept"))


@query("""WITH s AS (SELECT l_orderkey AS tree, l_returnflag AS path, l_linenumber AS line, l_quantity AS size FROM lineitem), n AS (SELECT tree, path, count(*) AS n FROM s GROUP BY 1, 2),
e AS (SELECT a.tree, b.path, coalesce(n, 0) AS n FROM (SELECT DISTINCT tree FROM s) a CROSS JOIN (SELECT DISTINCT path FROM s) b LEFT JOIN n ON n.tree = a.tree AND n.path = b.path),
m AS (SELECT path, n AS m FROM (SELECT path, n, row_number() OVER (PARTITION BY path ORDER BY n) AS r, count(*) OVER (PARTITION BY path) AS c FROM e) WHERE r = c // 2 + 1),
r AS (SELECT s.*, m, count(*) OVER (PARTITION BY tree, s.path) AS every, row_number() OVER (PARTITION BY tree, s.path ORDER BY size DESC) AS rk FROM s JOIN m USING (path)),
l AS (SELECT *, max(CASE WHEN rk = m THEN size END) OVER (PARTITION BY tree, path) AS least FROM r) SELECT tree, path, line FROM l WHERE every <= m OR coalesce(size >= least, false)""")
def canonical_side_scripts(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tree"), F.col("l_returnflag").alias("path"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("size"))
    return canonical.side_scripts_dropped(rows, "tree", "path", "size").select("tree", "path", "line")


@query("""WITH c AS (SELECT DISTINCT o_custkey AS project, left(o_orderpriority, 3) AS call FROM orders), d AS (SELECT DISTINCT o_custkey AS project, o_orderpriority AS name FROM orders),
m AS (SELECT c.project, call, name, count(*) OVER (PARTITION BY c.project, call) AS n FROM c JOIN d ON c.project = d.project AND (contains(name, call) OR contains(call, name)) WHERE NOT EXISTS (FROM d x WHERE x.project = c.project AND x.name = c.call)) SELECT project, call, name FROM m WHERE n = 1""")
def canonical_renamed_calls(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("project"), "o_orderpriority")
    return canonical.renamed_call_rows(o.select("project", F.substring("o_orderpriority", 1, 3).alias("call")), o.select("project", F.col("o_orderpriority").alias("name")), "project")


# --- payloads and features ---
@query("SELECT event_id, event_type AS plain, (props->>'$.k') AS block, (props->>'$.k') AS guid FROM events")
def payload_accessors(spark, d):
    inner = F.concat(F.lit('{"id":{"id":'), F.get_json_object("props", "$.k"), F.lit(',"selector":"s"},"guid":"'), F.get_json_object("props", "$.k"), F.lit('"}'))
    return table(spark, d, "events").select("event_id", payloads.as_string(F.concat(F.lit('"'), "event_type", F.lit('"'))).alias("plain"), payloads.block_id(inner).alias("block"), payloads.field_of(inner, "guid").alias("guid"))


@query("SELECT p_partkey, len(regexp_extract_all(p_name || '(' || p_type || ')', '[ \\t\\n()\\[\\]{}:,.+*/%=<>!\"''#-]|[^ \\t\\n()\\[\\]{}:,.+*/%=<>!\"''#-]+')) AS tokens FROM part")
def payload_tokens(spark, d):
    source = F.concat("p_name", F.lit("("), "p_type", F.lit(")"))
    return table(spark, d, "part").select("p_partkey", F.size(payloads.tokens_col(source)).cast("long").alias("tokens"))


@query("""WITH w AS (SELECT doc_id, string_split(lower(text), ' ') AS l FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(l) AS x FROM w) GROUP BY 1, 2), p AS (SELECT a.doc_id FROM w a JOIN w b ON b.doc_id = a.doc_id + 1),
u AS (SELECT p.doc_id, x, n FROM p JOIN b USING (doc_id) UNION ALL SELECT p.doc_id, x, -n FROM p JOIN b ON b.doc_id = p.doc_id + 1) SELECT doc_id, sum(abs(n))::BIGINT AS distance FROM (SELECT doc_id, x, sum(n) AS n FROM u GROUP BY 1, 2) GROUP BY 1""")
def distance_of_bags(spark, d):
    """Tokens that only one of two neighbouring documents has: counts are joined, so long texts cost no pairs of tokens."""
    words = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split(F.lower("text"), " ", -1)).alias("x"))
    bag = words.groupBy("doc_id", "x").agg(F.count("*").alias("n"))
    ids = table(spark, d, "documents").where("text is not null").select("doc_id")
    pairs = ids.join(ids.select((F.col("doc_id") - 1).alias("doc_id")), "doc_id")
    both = pairs.join(bag, "doc_id").unionByName(pairs.join(bag.select((F.col("doc_id") - 1).alias("doc_id"), "x", (-F.col("n")).alias("n")), "doc_id"))
    return both.groupBy("doc_id", "x").agg(F.sum("n").alias("n")).groupBy("doc_id").agg(F.sum(F.abs("n")).alias("distance"))


@query(f"""WITH {LOG}, v AS (SELECT attempt, bool_or(message = 'purchase' AND id % 2 = 0) AS a1, bool_or(message = 'error' AND id % 2 = 0) AS a2, bool_or(message = 'purchase' AND id % 2 = 1) AS b1, bool_or(message = 'error' AND id % 2 = 1) AS b2 FROM log GROUP BY 1)
SELECT attempt, ((a1 AND b1)::INT + (a2 AND b2)::INT)::BIGINT AS common, CASE WHEN a1 OR b1 OR a2 OR b2 THEN round(((a1 AND b1)::INT + (a2 AND b2)::INT) / ((a1 OR b1)::INT + (a2 OR b2)::INT), 9) ELSE 1.0 END AS alike FROM v""")
def feature_vectors(spark, d):
    has = lambda m, r: F.max((F.col("message") == m) & (F.col("id") % 2 == r))
    rows = _log(spark, d).groupBy("attempt").agg(F.array(has("purchase", 0), has("error", 0)).alias("a"), F.array(has("purchase", 1), has("error", 1)).alias("b"))
    return rows.select("attempt", payloads.matches(F.col("a"), F.col("b")).cast("long").alias("common"), F.round(payloads.alike(F.col("a"), F.col("b")), 9).alias("alike"))


@query(f"WITH {TALK}, l AS (SELECT conv_id, list(CASE WHEN role = 'assistant' THEN 'evaluateCustomBlock' ELSE role END ORDER BY i) AS l FROM t GROUP BY 1) SELECT conv_id, array_to_string(CASE WHEN l[1] = 'prototypeHatBlock' THEN l[2:] ELSE l END, ',') AS shown FROM l")
def hint_texts(spark, d):
    types = F.transform("types", lambda x: F.when(x == "assistant", "doCustomBlock").otherwise(x))
    return _nodes(spark, d).where("depth = 0").select("conv_id", F.array_join(payloads.hint_text(F.concat(F.array(F.lit("prototypeHatBlock")), types)), ",").alias("shown"))


# --- joins ---
@query(f"WITH {LOG}, l AS (SELECT attempt, id FROM log WHERE message <> 'signup'), e AS (SELECT attempt, id FROM log WHERE message = 'signup') SELECT attempt, id, false AS earlier FROM l UNION ALL SELECT attempt, id, true FROM e WHERE attempt IN (SELECT attempt FROM l)")
def join_with_prefix(spark, d):
    log = _log(spark, d).select("attempt", "id", "message")
    return joins.with_prefix(log.where("message <> 'signup'"), log.where("message = 'signup'")).select("attempt", "id", "earlier")


@query("SELECT a.event_id AS a, b.event_id AS b, levenshtein(a.event_type, b.event_type)::BIGINT AS distance FROM events a JOIN events b ON b.event_id = a.event_id + 1")
def join_pair_distances(spark, d):
    e = table(spark, d, "events")
    pairs = e.select(F.col("event_id").alias("a"), (F.col("event_id") + 1).alias("b"))
    return joins.pair_distances(pairs, e, "a", "b", "event_id", "event_type").select("a", "b", F.col("distance").cast("long").alias("distance"))


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey")
def join_required(spark, d):
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return joins.with_required(table(spark, d, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey").select("o_orderkey", "c_mktsegment")


@query("""WITH m AS (SELECT vec_id AS medoid, embedding::DOUBLE[] AS m FROM embeddings WHERE vec_id < 4), d AS (SELECT vec_id, medoid, list_sum(list_transform(range(1, len(m) + 1), lambda i: (e[i] - m[i]) * (e[i] - m[i]))) AS d FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) CROSS JOIN m)
SELECT vec_id, arg_min(medoid, d) AS medoid FROM d GROUP BY 1""")
def join_nearest_medoid(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    medoids = rows.where("vec_id < 4").select(F.col("vec_id").alias("medoid"), "v")
    far = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, z: acc + z)
    return joins.nearest_of(rows, medoids, "vec_id", "v", far).select("vec_id", "medoid")


# --- graphs ---
STEPS = """s AS (SELECT o_custkey AS attempt, dense_rank() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate)) AS step, o_orderpriority AS node, o_orderstatus AS st, o_orderkey AS k FROM orders),
nd AS (SELECT attempt, step, node, 'cart' AS graph, string_agg(st, '' ORDER BY k) AS state FROM s GROUP BY 1, 2, 3), lst AS (SELECT attempt, max(step) AS last FROM nd GROUP BY 1),
ia AS (SELECT attempt, step, node, state AS source FROM nd JOIN lst USING (attempt) WHERE step < last), ib AS (SELECT attempt, step - 1 AS step, node, state AS target FROM nd WHERE step > 1),
ix AS (SELECT coalesce(ia.attempt, ib.attempt) AS attempt, coalesce(source, '') AS source, coalesce(target, '') AS target FROM ia FULL JOIN ib ON ia.attempt = ib.attempt AND ia.step = ib.step AND ia.node = ib.node)"""


def _states(spark, d):
    """The orders of each customer and year as a snapshot, of each priority a node, whose state is the statuses."""
    from pyspark.sql import Window

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("attempt"), F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("node"), "o_orderstatus", "o_orderkey")
    step = F.dense_rank().over(Window.partitionBy("attempt").orderBy("y"))
    rows = o.withColumn("step", step).groupBy("attempt", "step", "node").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("l"))
    return rows.select("attempt", "step", "node", F.lit("cart").alias("graph"), F.array_join(F.col("l.o_orderstatus"), "").alias("state"))


@query(f"WITH {STEPS} SELECT 'cart' AS graph, source, target, count(DISTINCT attempt) AS weight FROM ix WHERE source <> target GROUP BY 2, 3")
def graph_interactions(spark, d):
    return graphs.interaction_edges(graphs.interactions(_states(spark, d)))


SWEEPS = 4
VALUES = f"""{LOG}, {EDGES}, lastp AS (SELECT attempt, arg_max(props, struct_pack(t := t, id := id)) AS last FROM log GROUP BY 1),
vx AS (SELECT props AS state, count_if(props = last) AS goals, count(*) AS weight FROM (SELECT DISTINCT attempt, props FROM log) JOIN lastp USING (attempt) GROUP BY 1), v0 AS (SELECT state, CASE WHEN goals >= 2 THEN 100.0 * goals ELSE 0.0 END::DOUBLE AS worth, worth AS value FROM vx)""" + "".join(
    f""", m{k} AS (SELECT e.source AS state, sum(e.weight * v.value) / sum(e.weight) AS mean FROM e JOIN v{k - 1} v ON v.state = e.target GROUP BY 1),
v{k} AS (SELECT v0.state, v0.worth, CASE WHEN mean IS NULL THEN v0.worth ELSE greatest(floor(mean * 0.99 * 64 + 0.5) / 64, v0.worth) END AS value FROM v0 LEFT JOIN m{k} USING (state))"""
    for k in range(1, SWEEPS + 1)
)


def _graph(spark, d):
    log = _log(spark, d)
    v = stats.vertex_weights(log, "props").select(F.lit("all").alias("graph"), F.col("props").alias("state"), "weight", "goals")
    e = stats.edge_weights(log, "props").select(F.lit("all").alias("graph"), "source", "target", "weight")
    return v, e


@query(f"WITH {VALUES} SELECT 'all' AS graph, state, value FROM v{SWEEPS}")
def graph_swept_values(spark, d):
    return graphs.swept(*_graph(spark, d), SWEEPS)


@query(f"WITH {VALUES}, o AS (SELECT e.source, e.target, v.value FROM e JOIN v{SWEEPS} v ON v.state = e.target JOIN v{SWEEPS} w ON w.state = e.source WHERE v.value > w.value) SELECT 'all' AS graph, source, target, value FROM o QUALIFY row_number() OVER (PARTITION BY source ORDER BY value DESC, target) = 1")
def graph_next_steps(spark, d):
    v, e = _graph(spark, d)
    return graphs.best_steps(e, graphs.swept(v, e, SWEEPS))


@query(f"""WITH {VALUES}, o AS (SELECT e.source, e.target, v.value FROM e JOIN v{SWEEPS} v ON v.state = e.target JOIN v{SWEEPS} w ON w.state = e.source WHERE v.value > w.value), b AS (SELECT source, target FROM o QUALIFY row_number() OVER (PARTITION BY source ORDER BY value DESC, target) = 1)
SELECT attempt AS request, 'all' AS graph, last AS state, coalesce(target, '') AS next FROM lastp LEFT JOIN b ON b.source = last""")
def graph_hints(spark, d):
    log = _log(spark, d)
    v, e = _graph(spark, d)
    asked = log.groupBy(F.col("attempt").alias("request")).agg(F.max_by("props", F.struct("t", "id")).alias("state")).withColumn("graph", F.lit("all"))
    found = graphs.hints(asked, graphs.best_steps(e, graphs.swept(v, e, SWEEPS)))
    return found.select("request", "graph", "state", F.coalesce("next", F.lit("")).alias("next"))


@query(f"""WITH RECURSIVE {VALUES}, o AS (SELECT e.source, e.target, v.value FROM e JOIN v{SWEEPS} v ON v.state = e.target JOIN v{SWEEPS} w ON w.state = e.source WHERE v.value > w.value), b AS (SELECT source, target FROM o QUALIFY row_number() OVER (PARTITION BY source ORDER BY value DESC, target) = 1),
r AS (SELECT state AS start, 0 AS n, state FROM vx WHERE goals = 0 UNION ALL SELECT start, n + 1, target FROM r JOIN b ON b.source = r.state WHERE n < 3) SELECT 'all' AS graph, start, n, state FROM r""")
def graph_ways(spark, d):
    """Where the best steps lead from the states in which no attempt ends."""
    v, e = _graph(spark, d)
    return graphs.ways(graphs.best_steps(e, graphs.swept(v, e, SWEEPS)), v.where("goals = 0").select("graph", "state"), 3)


@query(f"""WITH {LOG}, m AS (SELECT attempt, t, id, max((message = 'purchase')::INT) OVER {UP} AS a, max((message = 'error')::INT) OVER {UP} AS b, max(coalesce(value > 50, false)::INT) OVER {UP} AS c FROM log), v AS (SELECT attempt, t, id, a || '' || b || c AS target, a + b + c AS n FROM m),
s AS (SELECT attempt, target, coalesce(lag(target) OVER {W}, '000') AS source, n - coalesce(lag(n) OVER {W}, 0) AS d FROM v) SELECT source, target, count(DISTINCT attempt) AS weight FROM s WHERE d = 1 GROUP BY 1, 2""")
def graph_features(spark, d):
    rows = trace.accumulated(_log(spark, d), {"bought": F.col("message") == "purchase", "failed": F.col("message") == "error", "large": F.col("value") > 50})
    return graphs.feature_edges(rows, ["bought", "failed", "large"])


@query(f"WITH {LOG}, c AS (SELECT * FROM log QUALIFY lag(message) OVER {W} IS DISTINCT FROM message OR row_number() OVER {W} = 1) SELECT attempt, string_agg(message, '>' ORDER BY t, id) AS path, count(*) AS steps FROM c GROUP BY 1")
def graph_paths(spark, d):
    return graphs.paths(_log(spark, d), "message").select("attempt", "path", F.col("steps").cast("long").alias("steps"))


CONTEXT = f"""{TALK}, gc AS (SELECT conv_id, i, role, tone, coalesce(string_agg(role, ',') OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(role, ',') OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), '') AS after FROM t)"""


@query(f"WITH {CONTEXT} SELECT 'script->' || role AS graph, tone AS state, before, after, count(*) AS n FROM gc GROUP BY 1, 2, 3, 4 UNION ALL SELECT 'script->' || role || '->' || tone, '', '', '', count(*) FROM t GROUP BY 1")
def graph_goal_contexts(spark, d):
    found = graphs.goal_contexts(_nodes(spark, d), ["conv_id"])
    return found.groupBy("graph", "state", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after")).agg(F.count("*").alias("n"))


LETTERS = f"""{TALK}, gl AS (SELECT conv_id, i, role, tone, coalesce(string_agg(role[1], '') OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(role[1], '') OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), '') AS after FROM t)"""


@query(f"""WITH {LETTERS}, q AS (SELECT conv_id AS request, 'script->' || role AS graph, before AS b, after AS a FROM gl WHERE i = 0), c AS (SELECT 'script->' || role AS graph, tone AS state, before, after, count(*) AS n FROM gl GROUP BY 1, 2, 3, 4), g AS (SELECT 'script->' || role AS graph, tone AS state, 100.0 * count(*) AS value FROM gl GROUP BY 1, 2),
f AS (SELECT request, graph, state, n, 0.25 / power(0.5 + (CASE WHEN greatest(len(before), len(b)) > 0 THEN levenshtein(before, b) / greatest(len(before), len(b)) ELSE 0 END + CASE WHEN greatest(len(after), len(a)) > 0 THEN levenshtein(after, a) / greatest(len(after), len(a)) ELSE 0 END) / 2, 2) AS w FROM c JOIN q USING (graph)),
m AS (SELECT request, graph, state, sum(n) AS n, sum(n * w) / sum(n) AS mean FROM f GROUP BY 1, 2, 3) SELECT request, graph, state, round(CASE WHEN n >= 2 THEN mean * value ELSE 0 END, 6) AS value FROM m JOIN g USING (graph, state)""")
def graph_contextual_values(spark, d):
    letters = lambda c: F.array_join(F.transform(c, lambda x: F.substring(x, 1, 1)), "")
    first = graphs.goal_contexts(_nodes(spark, d), ["conv_id"]).where("graph not like '%->%->%'")
    rows = first.select("conv_id", "graph", "state", letters("before").alias("before"), letters("after").alias("after"))
    asked = rows.where("before = ''").select(F.col("conv_id").alias("request"), "graph", "before", "after")
    goals = rows.groupBy("graph", "state").agg((100.0 * F.count("*")).alias("value"))
    return graphs.contextual(goals, rows, asked).select("request", "graph", "state", F.round("value", 6).alias("value"))


# --- rules ---
@query(f"WITH {LOG}, b AS (SELECT DISTINCT props, attempt FROM log) SELECT x.props AS a, y.props AS b, count(*) AS followers FROM b x JOIN b y ON x.attempt = y.attempt AND x.props < y.props GROUP BY 1, 2 HAVING count(*) >= 5")
def mine_conjunctions(spark, d):
    return mining.conjunctions(_log(spark, d), "props", "attempt", 5)


@query(f"WITH {GRAMS}, l AS (SELECT DISTINCT conv_id, role || ' ' || tone || ' * *' AS gram FROM t), a AS (SELECT DISTINCT conv_id, gram FROM e UNION SELECT conv_id, gram FROM l), n AS (SELECT count(DISTINCT conv_id) AS n FROM t) SELECT gram, round(count(*) / (SELECT n FROM n), 9) AS support FROM a GROUP BY 1 HAVING count(*) >= 0.1 * (SELECT n FROM n)")
def mine_shapes(spark, d):
    talks = _talks(spark, d)
    return mining.shapes(mining.grams(talks, "conv_id", p=2, q=2), "conv_id", talks.count(), 0.1).select("gram", *_r("support"))


@query(f"""WITH {LOG}, f AS (SELECT attempt, 'bought' AS rule, bool_or(message = 'purchase') AS ok FROM log GROUP BY 1 UNION ALL SELECT attempt, 'failed', bool_or(message = 'error') FROM log GROUP BY 1 UNION ALL SELECT attempt, 'joined', bool_or(message = 'signup') FROM log GROUP BY 1)
SELECT attempt, cluster, min(ok::INT) AS has FROM f JOIN (VALUES ('bought', 1), ('failed', 1), ('joined', 2)) c(rule, cluster) USING (rule) GROUP BY 1, 2""")
def mine_cluster_features(spark, d):
    log = _log(spark, d)
    has = lambda m: F.max(F.col("message") == m)
    wide = log.groupBy("attempt").agg(has("purchase").alias("bought"), has("error").alias("failed"), has("signup").alias("joined"))
    clusters = spark.createDataFrame([("bought", 1), ("failed", 1), ("joined", 2)], "rule string, cluster int")
    return mining.cluster_features(wide.unpivot(["attempt"], ["bought", "failed", "joined"], "rule", "ok"), clusters, "attempt")


@query(f"""WITH {LOG}, l AS (SELECT DISTINCT attempt, props FROM log), a AS (SELECT x.attempt AS query, y.attempt AS solution, count(*) AS agreed FROM l x JOIN l y ON x.props = y.props GROUP BY 1, 2) SELECT query, solution, agreed FROM a QUALIFY rank() OVER (PARTITION BY query ORDER BY agreed DESC) <= 5""")
def mine_agreeing(spark, d):
    seen = _log(spark, d).select("attempt", "props").distinct()
    return mining.agreeing(seen.select(F.col("attempt").alias("query"), F.col("props").alias("rule")), seen.select(F.col("attempt").alias("solution"), F.col("props").alias("rule")), 5)


# --- evaluations ---
@query(f"""WITH {LOG}, n AS (SELECT attempt, id, message, props, row_number() OVER {W} AS p FROM log), f AS (SELECT a.attempt, a.id, min(b.p - a.p) AS n FROM n a LEFT JOIN n b ON b.attempt = a.attempt AND b.message = a.message AND b.p > a.p AND b.p <= a.p + 20 WHERE a.message = 'error' GROUP BY 1, 2)
SELECT k AS "within", (SELECT count(*) FROM f) AS asked, count_if(n <= k)::BIGINT AS hits FROM f, range(1, 21) r(k) GROUP BY 1""")
def eval_hit_sweep(spark, d):
    return evaluation.hit_sweep(_log(spark, d), F.col("message") == "error", "message", 20)


@query("WITH e AS (SELECT l_orderkey AS request, l_returnflag AS outcome, sum(l_linenumber) AS w FROM lineitem GROUP BY 1, 2) SELECT request, outcome, round(w / sum(w) OVER (PARTITION BY request), 9) AS weight FROM e")
def eval_hint_set(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_returnflag").alias("outcome"), F.col("l_linenumber").alias("weight"))
    return evaluation.hint_set(rows).select("request", "outcome", *_r("weight"))


@query("""SELECT md5(lower(regexp_replace(trim(text, ' '), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS outcome, count(*) AS n, min(doc_id) AS first, min(quality) = max(quality) AS agreed FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL GROUP BY 1""")
def eval_by_outcome(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return evaluation.by_outcome(rows.select(F.col("doc_id").alias("hint"), F.col("quality").alias("priority"), "text"), F.col("text"))


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1)")
def eval_looked_up(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    twice = docs.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n")).where("n > 1")
    return evaluation.looked_up(docs, twice, "text").select("doc_id", "digest")


@query("SELECT o_custkey AS attempt, count(*) AS rows FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL) GROUP BY 1 HAVING count(*) >= 3")
def eval_to_grade(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("attempt")).agg(F.count("*").alias("rows"))
    return evaluation.to_grade(rows, table(spark, d, "events").select(F.col("user_id").alias("attempt")).distinct(), 3)


GAPLOG = f"{LOG}, g AS (SELECT *, t - lag(t) OVER {W} AS gap FROM log)"


@query(f"""WITH {GAPLOG}, a AS (SELECT *, sum(CASE WHEN gap < 300 THEN gap - greatest(gap - 60, 0) ELSE 0 END) OVER {UP} AS active FROM g), c AS (SELECT attempt, count_if(message = 'click')::BIGINT AS click, count_if(message = 'view')::BIGINT AS view FROM a WHERE active < 300 GROUP BY 1),
s AS (SELECT attempt, CASE message WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 WHEN 'error' THEN 0 END AS score FROM log), gr AS (SELECT attempt, count_if(score = 2) / count(score) AS average FROM s GROUP BY 1 HAVING count(score) > 0) SELECT attempt, click, view, round(average, 9) AS average FROM c JOIN gr USING (attempt)""")
def eval_attributes(spark, d):
    log = _log(spark, d)
    score = F.when(F.col("message") == "purchase", 2).when(F.col("message") == "click", 1).when(F.col("message") == "error", 0)
    grades = stats.grade(log.select("attempt", score.alias("score")).where("score is not null"))
    return evaluation.attributes(log, ["click", "view"], 5, grades).select("attempt", "click", "view", *_r("average"))


@query("WITH n AS (SELECT o_custkey % 5 AS assignment, o_custkey, count(*) AS hints FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY assignment ORDER BY hints) AS r, count(*) OVER (PARTITION BY assignment) AS c FROM n) SELECT assignment, max(c) AS requests, min(hints) AS least, max(CASE WHEN r = c // 2 + 1 THEN hints END) AS median, max(hints) AS most FROM r GROUP BY 1")
def eval_gold_standard(spark, d):
    """Of each assignment the requests and the least, median and greatest number of hints for one."""
    n = table(spark, d, "orders").groupBy((F.col("o_custkey") % 5).alias("assignment"), "o_custkey").agg(F.count("*").alias("hints"))
    out = n.groupBy("assignment").agg(F.count("*").alias("requests"), F.min("hints").alias("least"), F.max("hints").alias("most"))
    return out.join(stats.upper_median_of(n, ["assignment"], "hints"), "assignment").select("assignment", "requests", "least", "median", "most")


@query("WITH a AS (SELECT doc_id, quality AS q FROM labels), b AS (SELECT doc_id, toxic AS q FROM labels WHERE doc_id > 10) SELECT doc_id, sum(q)::BIGINT AS votes, count(*) AS raters FROM (FROM a UNION ALL FROM b) GROUP BY 1")
def set_merged(spark, d):
    """Two raters' sets as one."""
    lab = table(spark, d, "labels")
    both = lab.select("doc_id", F.col("quality").alias("q")).unionByName(lab.where("doc_id > 10").select("doc_id", F.col("toxic").alias("q")))
    return both.groupBy("doc_id").agg(F.sum("q").alias("votes"), F.count("*").alias("raters"))


@query(f"WITH {TALK}, d AS (SELECT DISTINCT conv_id, tone FROM t) SELECT tone AS type, count(*) AS trees, count(*) * 2 > (SELECT count(DISTINCT conv_id) FROM t) AS most FROM d GROUP BY 1")
def eval_majority(spark, d):
    from ..operators import graders

    return graders.majority(_nodes(spark, d), "conv_id", ["asks", "exclaims", "tells"])


@query(f"WITH {TALK}, f AS (SELECT conv_id, bool_or(i = 0 AND role = 'user') AS begins, bool_or(tone = 'asks') AS asks FROM t GROUP BY 1) SELECT conv_id, begins, asks FROM f")
def eval_grades(spark, d):
    """Graders over the conversations' trees: does the user begin, does anyone ask."""
    from ..operators import graders

    tests = {"begins": graders.every(graders.under("script"), graders.child(0, graders.kind("user"))), "asks": graders.under("script", "...", "asks")}
    rows = _talks(spark, d).withColumn("g", graders.grades(F.col("tree"), tests))
    return rows.select("conv_id", F.col("g")["begins"].alias("begins"), F.col("g")["asks"].alias("asks"))


@query(f"""WITH {LOG}, e AS (SELECT attempt AS key, row_number() OVER {W} AS step, 'bought' AS test, message = 'purchase' AS ok FROM log UNION ALL SELECT attempt, row_number() OVER {W}, 'calm', message <> 'error' FROM log), b AS (SELECT *, lag(ok) OVER (PARTITION BY key, test ORDER BY step) AS b FROM e)
SELECT test, count_if(ok AND NOT b)::BIGINT AS done, count_if(NOT ok AND b)::BIGINT AS undone, count(*) AS steps FROM b WHERE b IS NOT NULL GROUP BY 1""")
def eval_policy_scores(spark, d):
    from ..operators import policies

    rows = trace.positions(_log(spark, d)).select(F.col("attempt").alias("key"), F.col("place").alias("step"), "message")
    return policies.policy_scores(rows, {"bought": F.col("message") == "purchase", "calm": F.col("message") != "error"})


@query("""WITH a AS (SELECT doc_id, CASE quality WHEN 1 THEN 'insert' ELSE 'delete' END AS l FROM labels), b AS (SELECT doc_id, CASE toxic WHEN 1 THEN 'delete' ELSE 'insert' END AS r FROM labels WHERE doc_id > 10)
SELECT coalesce(l, 'keep') AS left, coalesce(r, 'keep') AS right, count(*) AS n FROM a FULL JOIN b USING (doc_id) GROUP BY 1, 2""")
def join_agreement(spark, d):
    """How two raters' edits agree."""
    from ..operators import alignment

    lab = table(spark, d, "labels")
    a = lab.select("doc_id", F.when(F.col("quality") == 1, "insert").otherwise("delete").alias("action"))
    b = lab.where("doc_id > 10").select("doc_id", F.when(F.col("toxic") == 1, "delete").otherwise("insert").alias("action"))
    return alignment.agreement(a, b, ["doc_id"], "action")


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def agg_lists(spark, d):
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("l"))
    return lists.select("o_custkey", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("orders"))


@query(f"WITH {TALK}, x AS (SELECT conv_id, role AS type FROM t UNION ALL SELECT conv_id, tone FROM t) SELECT conv_id, count(*) AS n FROM x WHERE type IN ('user', 'asks') GROUP BY 1")
def tree_of_types(spark, d):
    """Nodes that are of some types, or stand below such a one directly under the root: predicates are columns."""
    of_type = F.col("type").isin("user", "asks")
    return _nodes(spark, d).where(of_type & (F.col("depth") > 0)).groupBy("conv_id").agg(F.count("*").alias("n"))


@query(f"WITH {TALK} SELECT conv_id, min(2 * i + 2)::INT AS node FROM t WHERE tone = 'tells' GROUP BY 1")
def tree_first_of_type(spark, d):
    return _nodes(spark, d).where("type = 'tells'").groupBy("conv_id").agg(F.min("node").alias("node"))


@query(f"WITH {TALK} SELECT conv_id, 'script,' || string_agg(role || ',' || tone, ',' ORDER BY i) AS types FROM t GROUP BY 1")
def tree_preorder(spark, d):
    return _talks(spark, d).select("conv_id", F.array_join(F.transform("tree", lambda x: x["type"]), ",").alias("types"))


@query("SELECT p_partkey, round(levenshtein(p_brand, p_type) / greatest(len(p_brand), len(p_type)), 9) AS cost, round((greatest(len(p_brand), len(p_type)) - levenshtein(p_brand, p_type) + 1) / (greatest(len(p_brand), len(p_type)) + 1), 9) AS score FROM part")
def seq_normalised(spark, d):
    """The cost over the longer length, and the score made of it."""
    longer, cost = F.greatest(F.length("p_brand"), F.length("p_type")), F.levenshtein("p_brand", "p_type")
    return table(spark, d, "part").select("p_partkey", F.round(cost / longer, 9).alias("cost"), F.round((longer - cost + 1) / (longer + 1), 9).alias("score"))


NEAR = f"""{STEPS}, ed AS (SELECT source, target, count(DISTINCT attempt) AS weight FROM ix WHERE source <> target GROUP BY 1, 2), st AS (SELECT DISTINCT state FROM nd)"""


@query(f"""WITH {NEAR}, kept AS (SELECT source, target, weight FROM ed WHERE levenshtein(source, target) <= 2), near AS (SELECT a.state AS source, b.state AS target, 1 AS weight FROM st a JOIN st b ON a.state <> b.state AND levenshtein(a.state, b.state) <= 1)
SELECT source, target, weight FROM kept UNION ALL SELECT * FROM near n WHERE NOT EXISTS (FROM kept k WHERE k.source = n.source AND k.target = n.target)""")
def graph_near_states(spark, d):
    """Edges that aren't too long, and such between states next to one another."""
    from ..functions import sequences

    states = _states(spark, d)
    comma = lambda c: F.array_join(F.split(c, ""), ",")
    edges = graphs.interaction_edges(graphs.interactions(states)).select("graph", comma("source").alias("source"), comma("target").alias("target"), "weight")
    far = lambda p, q: sequences.align_cost(p.split(",") if p else [], q.split(",") if q else [])
    found = graphs.near_states(edges, states.select("graph", comma("state").alias("state")).distinct(), far)
    plain = lambda c: F.regexp_replace(c, ",", "").alias(c)
    return found.select(plain("source"), plain("target"), "weight")


@query(f"""WITH {NEAR}, have AS (SELECT source, min(target) AS next FROM ed WHERE source <> '' AND target <> '' GROUP BY 1), asked AS (SELECT DISTINCT state || 'F' AS state FROM st), c AS (SELECT a.state, h.source, h.next, levenshtein(a.state, h.source) AS d FROM asked a JOIN have h ON abs(len(a.state) - len(h.source)) <= 3 WHERE levenshtein(a.state, h.source) <= 3 AND a.state NOT IN (SELECT source FROM have)),
b AS (SELECT state, next FROM c QUALIFY row_number() OVER (PARTITION BY state ORDER BY d, len(source) DESC, source) = 1) SELECT a.state, coalesce(h.next, b.next, '') AS next, CASE WHEN h.next IS NOT NULL THEN 'state' WHEN b.next IS NOT NULL THEN 'neighbour' ELSE '' END AS via FROM asked a LEFT JOIN have h ON h.source = a.state LEFT JOIN b ON b.state = a.state""")
def graph_neighbour_hints(spark, d):
    """For states that may not be known, the next state of the nearest known one."""
    states = _states(spark, d)
    edges = graphs.interaction_edges(graphs.interactions(states)).where("source <> '' and target <> ''")
    steps = edges.groupBy("graph", "source").agg(F.min("target").alias("target"))
    known = steps.select("graph", F.col("source").alias("state"), F.length("source").cast("double").alias("value"))
    asked = states.select("graph", F.concat("state", F.lit("F")).alias("state")).distinct().withColumn("request", F.col("state"))
    found = graphs.hints_or_neighbours(asked, steps, known)
    return found.select("state", F.coalesce("next", F.lit("")).alias("next"), F.coalesce("via", F.lit("")).alias("via"))


@query(f"WITH {LOG}, {EDGES}, lo AS (SELECT props, count(*) AS n FROM (SELECT DISTINCT attempt, props FROM (SELECT attempt, props, lag(props) OVER {W} AS b FROM log) WHERE b = props) GROUP BY 1), o AS (SELECT source, target, weight FROM e UNION ALL SELECT props, props, n FROM lo), s AS (SELECT source AS state, sum(CASE WHEN source = target THEN weight ELSE 0 END) / sum(weight) AS stayed FROM o GROUP BY 1) SELECT 'all' AS graph, state, round(stayed, 9) AS stayed, stayed >= 0.67 AS caution FROM s")
def graph_stays(spark, d):
    """How often a state is left for itself."""
    from pyspark.sql import Window

    log = _log(spark, d)
    before = F.lag("props").over(Window.partitionBy("attempt").orderBy("t", "id"))
    loops = log.withColumn("b", before).where("b = props").select("attempt", "props").distinct().groupBy(F.col("props").alias("source")).agg(F.count("*").alias("weight")).withColumn("target", F.col("source"))
    edges = stats.edge_weights(log, "props").unionByName(loops).withColumn("graph", F.lit("all"))
    return graphs.stays(edges).select("graph", "state", *_r("stayed"), "caution")
