"""Interaction graphs: values of states by Bellman backup, next steps, clusters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A goal is worth so much for each attempt that ends in it; a step costs a hundredth; values are kept to 1/64.
GOAL, DISCOUNT, GRAIN, SWEEPS = 100.0, 0.99, 64.0, 1000
#: From this share of staying on, a hint to leave a state needs care.
CAUTION = 0.67


def backup(states: Sequence, goals: Sequence[int], edges: Sequence[tuple], least: int = 2) -> dict:
    """Values of a graph's states: in turn, each gets the discounted mean of what it leads to, and no goal falls below its own worth.

    States are visited in their given order and see values as they are, so runs agree; edges are (source, target, weight), loops don't count.
    """
    at = {s: i for i, s in enumerate(states)}
    worth = np.array([GOAL * g if g >= least else 0.0 for g in goals])
    out: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in edges:
        if a != b and a in at and b in at:
            out.setdefault(at[a], []).append((at[b], w))
    steps = {i: (np.array([j for j, _ in x]), np.array([w for _, w in x]) / sum(w for _, w in x)) for i, x in out.items()}
    value = worth.copy()
    for _ in range(SWEEPS):
        before = value.copy()
        for i in sorted(steps):
            j, p = steps[i]
            value[i] = max(np.floor(DISCOUNT * float(p @ value[j]) * GRAIN + 0.5) / GRAIN, worth[i])
        if (value == before).all():
            break
    return dict(zip(states, value.tolist(), strict=True))


def values(vertices: DataFrame, edges: DataFrame, graph: str = "graph", least: int = 2) -> DataFrame:
    """(graph, state, value) of graphs given as (graph, state, goals) and (graph, source, target, weight).

    A graph is one cogroup: those of a path of node types are small; it is for many graphs that Spark is used.
    """
    kind = vertices.schema[graph].dataType.simpleString()

    def one(key, v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("state")
        found = backup(v["state"].tolist(), v["goals"].tolist(), list(e[["source", "target", "weight"]].itertuples(index=False, name=None)), least)
        return pd.DataFrame({"graph": [key[0]] * len(found), "state": list(found), "value": list(found.values())})

    return vertices.groupBy(graph).cogroup(edges.groupBy(graph)).applyInPandas(one, f"graph {kind}, state string, value double")


def best_steps(edges: DataFrame, value: DataFrame) -> DataFrame:
    """(graph, source, target, value): of each state the successor of greatest value, if it is above the state's own; ties to the lesser name."""
    v = value.select("graph", "state", "value")
    rows = edges.where("source <> target").join(v.withColumnRenamed("state", "target"), ["graph", "target"]).join(v.select("graph", F.col("state").alias("source"), F.col("value").alias("own")), ["graph", "source"])
    w = Window.partitionBy("graph", "source").orderBy(F.desc("value"), "target")
    return rows.where(F.col("value") > F.col("own")).withColumn("r", F.row_number().over(w)).where("r = 1").select("graph", "source", "target", "value")


def follow(steps: dict, state, most: int = 100) -> list:
    """The way from a state along best steps."""
    way, seen = [state], {state}
    while state in steps and steps[state] not in seen and len(way) < most:
        state = steps[state]
        seen.add(state)
        way.append(state)
    return way


def union(graphs: Sequence[DataFrame]) -> DataFrame:
    """One graph of several: equal edges are added up."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    return out.groupBy("graph", "source", "target").agg(F.sum("weight").alias("weight"))


def near_states(edges: DataFrame, states: DataFrame, distance: Callable[[str, str], float], least: float = 1, most: float = 2) -> DataFrame:
    """Edges without those over ``most`` and with those (weight 1, both ways) between states at most ``least`` apart; states of a graph are compared only if their lengths allow it."""

    @F.pandas_udf("double")
    def d(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([distance(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    n = lambda c: F.size(F.split(c, ","))
    kept = edges.where(d("source", "target") <= most)
    a, b = states.select("graph", F.col("state").alias("source")), states.select("graph", F.col("state").alias("target"))
    near = a.join(b, "graph").where((F.col("source") != F.col("target")) & (F.abs(n(F.col("source")) - n(F.col("target"))) <= least)).where(d("source", "target") <= least)
    new = near.join(kept, ["graph", "source", "target"], "left_anti").withColumn("weight", F.lit(1).cast("long"))
    return kept.unionByName(new.select(*kept.columns))


def k_medoids(distance: np.ndarray, k: int, rounds: int = 50, seed: int = 0) -> list[int]:
    """For each item its medoid; distinct medoids are drawn first and an empty cluster draws anew."""
    rng = np.random.default_rng(seed)
    n = len(distance)
    medoids = sorted(rng.choice(n, min(k, n), replace=False).tolist())
    for _ in range(rounds):
        near = distance[:, medoids].argmin(axis=1)
        new = []
        for c in range(len(medoids)):
            own = np.flatnonzero(near == c)
            new.append(int(own[distance[np.ix_(own, own)].sum(axis=1).argmin()]) if len(own) else int(rng.integers(n)))
        if sorted(set(new)) == medoids:
            break
        medoids = sorted(set(new))
    return [medoids[c] for c in distance[:, medoids].argmin(axis=1).tolist()]


def average_linkage(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, distance) of least mean distance; new clusters are numbered on from n."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    label, size, out = list(range(n)), [1] * n, []
    for step in range(n - 1):
        i, j = sorted(divmod(int(d.argmin()), n))
        out.append((label[i], label[j], float(d[i, j])))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[i] = n + step
    return out


def graphml(vertices: Sequence[tuple], edges: Sequence[tuple]) -> str:
    """GraphML text of (state, weight, value) and (source, target, weight, p, best)."""
    from xml.sax.saxutils import quoteattr

    keys = [("node", "weight", "int"), ("node", "value", "double"), ("edge", "weight", "int"), ("edge", "p", "double"), ("edge", "best", "boolean")]
    head = "".join(f'<key id="{f[0]}{n}" for="{f}" attr.name="{n}" attr.type="{t}"/>' for f, n, t in keys)
    v = "".join(f'<node id={quoteattr(str(s))}><data key="nweight">{w}</data><data key="nvalue">{x}</data></node>' for s, w, x in vertices)
    e = "".join(f'<edge source={quoteattr(str(a))} target={quoteattr(str(b))}><data key="eweight">{w}</data><data key="ep">{p}</data><data key="ebest">{str(bool(x)).lower()}</data></edge>' for a, b, w, p, x in edges)
    return f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{head}<graph edgedefault="directed">{v}{e}</graph></graphml>'


def nearest_state(state: Sequence, known: dict, bound: float = 300, insert: float = 100, delete: float = 1, replace: float = 10_000):
    """Of known states (tuples of types, with values) the one that is cheapest to reach within a bound, ties to the greater value."""
    from ..functions.sequences import align_cost

    costs = [(align_cost(list(state), list(s), insert, delete, replace), -v, s) for s, v in known.items()]
    best = min(costs, default=None)
    return best[2] if best and best[0] <= bound else None


def hints(requests: DataFrame, steps: DataFrame) -> DataFrame:
    """Requests (graph, state, ...) with the best next state, where the graph has one."""
    return requests.join(steps.select("graph", F.col("source").alias("state"), F.col("target").alias("next"), "value"), ["graph", "state"], "left")


def stays(edges: DataFrame) -> DataFrame:
    """(graph, state, stayed, caution): the share of what leaves a state that leads back to it, and whether that is so much that a hint away from it needs care."""
    rows = edges.groupBy("graph", F.col("source").alias("state")).agg((F.sum(F.when(F.col("source") == F.col("target"), F.col("weight")).otherwise(0)) / F.sum("weight")).alias("stayed"))
    return rows.withColumn("caution", F.col("stayed") >= CAUTION)


# --- from traces to graphs ---


def interactions(nodes: DataFrame) -> DataFrame:
    """(attempt, graph, source, target) of rows (attempt, step, node, graph, state), steps numbered from 1 without gaps.

    A node that both of two neighbouring snapshots have gives an edge where its state changed, in the graph it is in afterwards; one that is new gives an edge from the
    empty state, one that is gone an edge to it.
    """
    last = nodes.groupBy("attempt").agg(F.max("step").alias("__last"))
    rows = nodes.join(last, "attempt")
    a = rows.where("step < __last").select("attempt", F.col("step"), "node", F.col("graph").alias("ga"), F.col("state").alias("source"))
    b = rows.where("step > 1").select("attempt", (F.col("step") - 1).alias("step"), "node", F.col("graph").alias("gb"), F.col("state").alias("target"))
    both = a.join(b, ["attempt", "step", "node"], "full").select("attempt", F.coalesce("gb", "ga").alias("graph"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("target", F.lit("")).alias("target"))
    return both.where("source <> target")


def interaction_edges(steps: DataFrame) -> DataFrame:
    """(graph, source, target, weight): how many attempts make each step."""
    return steps.distinct().groupBy("graph", "source", "target").agg(F.count("*").alias("weight"))


def swept(vertices: DataFrame, edges: DataFrame, sweeps: int, least: int = 2) -> DataFrame:
    """(graph, state, value) after so many sweeps in which all states see the values of the sweep before.

    For graphs of any size: a sweep is a join of edges with values and a partial aggregate by source. Weights are whole and values are 64ths, so sums
    are exact in any order. Lineage is cut every eight sweeps where a checkpoint folder is set.
    """
    spark = vertices.sparkSession
    worth = F.when(F.col("goals") >= least, GOAL * F.col("goals")).otherwise(0.0)
    base = vertices.select("graph", "state", worth.cast("double").alias("worth"))
    steps = edges.where("source <> target").select("graph", "source", "target", "weight")
    value = base.withColumn("value", F.col("worth"))
    can_cut = not spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty()
    for k in range(sweeps):
        v = value.select("graph", F.col("state").alias("target"), "value")
        next_ = steps.join(v, ["graph", "target"]).groupBy("graph", F.col("source").alias("state")).agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("mean"))
        new = F.greatest(F.floor(F.col("mean") * DISCOUNT * GRAIN + 0.5) / GRAIN, F.col("worth"))
        value = base.join(next_, ["graph", "state"], "left").select("graph", "state", "worth", F.when(F.col("mean").isNull(), F.col("worth")).otherwise(new).alias("value"))
        if can_cut and k % 8 == 7:
            value = value.checkpoint()
    return value.select("graph", "state", "value")


def finished(vertices: DataFrame, edges: DataFrame, sweeps: int, prune: int = 2) -> DataFrame:
    """Values of a graph whose states that few attempts reach (and none ends in) are left out: vertices (graph, state, weight, goals)."""
    fine = vertices.where((F.col("weight") >= prune) | (F.col("goals") > 0))
    names = fine.select("graph", "state")
    kept = edges.join(names.withColumnRenamed("state", "source"), ["graph", "source"], "left_semi").join(names.withColumnRenamed("state", "target"), ["graph", "target"], "left_semi")
    return swept(fine, kept, sweeps)


def goal_contexts(nodes: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """(keys, graph, state, before, after) of the nodes of final trees: child types, and the types of up to ``most`` siblings on each side."""
    up = nodes.select(*keys, F.col("node").alias("parent"), F.col("types").alias("row"))
    rows = nodes.where("parent >= 0").join(up, [*keys, "parent"])
    begin = F.greatest(F.col("idx") - most, F.lit(0))
    return rows.select(*keys, F.array_join("path", "->").alias("graph"), F.array_join("types", ",").alias("state"), F.slice("row", begin + 1, F.col("idx") - begin).alias("before"), F.slice("row", F.col("idx") + 2, F.lit(most)).alias("after"))


def contextual(goals: DataFrame, contexts: DataFrame, requests: DataFrame, least: int = 2) -> DataFrame:
    """(request, graph, state, value): a goal's value for a request by how alike the contexts are in which it was reached.

    goals (graph, state, value); contexts (graph, state, before, after); requests (request, graph, before, after); contexts are strings with a letter for each
    type. The weight of a context is 0.25 / (0.5 + d)^2, d the mean of the two normalised distances; a goal with fewer than ``least`` contexts is worth 0.
    Equal contexts are counted first, and requests meet only those of their graph.
    """
    many = contexts.groupBy("graph", "state", "before", "after").agg(F.count("*").alias("n"))
    asked = requests.select("request", "graph", F.col("before").alias("b"), F.col("after").alias("a"))

    def far(x: str, y: str):
        longer = F.greatest(F.length(x), F.length(y))
        return F.when(longer > 0, F.levenshtein(F.col(x), F.col(y)) / longer).otherwise(0.0)

    d = (far("before", "b") + far("after", "a")) / 2
    met = asked.join(many, "graph").withColumn("w", F.lit(0.25) / F.pow(F.lit(0.5) + d, F.lit(2.0)))
    mean = met.groupBy("request", "graph", "state").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("w")) / F.sum("n")).alias("mean"))
    return mean.join(goals, ["graph", "state"]).select("request", "graph", "state", F.when(F.col("n") >= least, F.col("mean") * F.col("value")).otherwise(0.0).alias("value"))


def feature_edges(log: DataFrame, features: list[str]) -> DataFrame:
    """(source, target, weight) between vectors of features (0/1 columns that stay true): only steps that flip a single one, by attempts that make them."""
    vector = F.concat_ws("", *[F.col(f).cast("string") for f in features])
    w = Window.partitionBy("attempt").orderBy("t", "id")
    rows = log.withColumn("target", vector).withColumn("source", F.coalesce(F.lag("target").over(w), F.lit("0" * len(features))))
    ones = sum(F.length(F.regexp_replace(c, "0", "")) * k for c, k in (("target", 1), ("source", -1)))
    return rows.where(ones == 1).select("attempt", "source", "target").distinct().groupBy("source", "target").agg(F.count("*").alias("weight"))


def paths(log: DataFrame, state: str) -> DataFrame:
    """(attempt, path, steps): the states an attempt goes through, in order, without repeats in a row. Traces are bounded by what a user does."""
    from .trace import changes

    rows = changes(log, state).groupBy("attempt").agg(F.array_sort(F.collect_list(F.struct("t", "id", F.col(state).alias("s")))).alias("p"))
    return rows.select("attempt", F.array_join(F.col("p.s"), ">").alias("path"), F.size("p").alias("steps"))


def ways(steps: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(graph, start, n, state): the states reached from each start along best steps (graph, source, target), a join for each step."""
    at = starts.select("graph", F.col("state").alias("start"), F.lit(0).alias("n"), "state")
    out = at
    s = steps.select("graph", F.col("source").alias("state"), F.col("target").alias("__next"))
    for _ in range(most):
        at = at.join(s, ["graph", "state"]).select("graph", "start", (F.col("n") + 1).alias("n"), F.col("__next").alias("state"))
        out = out.unionByName(at)
    return out


def hints_or_neighbours(requests: DataFrame, steps: DataFrame, known: DataFrame, bound: int = 3) -> DataFrame:
    """Requests (request, graph, state) with the best next state; one whose state has none gets that of the nearest known state with a step.

    known (graph, state, value); states are strings with a letter for each child. Ties go to the greater value, then the lesser name; a neighbour farther than
    ``bound`` is none. Equal states ask once.
    """
    have = steps.select("graph", F.col("source").alias("state"), F.col("target").alias("next"))
    open_ = requests.select("graph", "state").distinct().join(have, ["graph", "state"], "left_anti")
    targets = known.join(have, ["graph", "state"]).select("graph", F.col("state").alias("near"), "value", "next")
    length = F.abs(F.length("state") - F.length("near")) <= bound
    met = open_.join(targets, "graph").where(length).withColumn("d", F.levenshtein("state", "near")).where(F.col("d") <= bound)
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("graph", "state").orderBy("d", F.desc("value"), "near"))).where("r = 1")
    every = have.withColumn("via", F.lit("state")).unionByName(best.select("graph", "state", "next", F.lit("neighbour").alias("via")))
    return requests.join(every, ["graph", "state"], "left").select("request", "graph", "state", "next", "via")


def reused(before: Sequence[str], after: Sequence[str]) -> list[int]:
    """For each child of a state hinted at, which child there is now takes the place (the first unused of its type), or -1 for a new one."""
    free: dict[str, list[int]] = {}
    for i, x in enumerate(before):
        free.setdefault(x, []).append(i)
    return [free[x].pop(0) if free.get(x) else -1 for x in after]


def linked(found: list[dict], ratio: float = 2.0) -> list[dict]:
    """Hints (parent, from, to) for one request without those that only add a script beside others, and with the parents from which each may take what it adds.

    A hint may take blocks of a parent that others would have fewer of, as long as it adds at most ``ratio`` times what is left over there.
    """
    from collections import Counter

    out = []
    left = {h["parent"]: Counter(h["from"]) - Counter(h["to"]) for h in found}
    for h in found:
        new = Counter(h["to"]) - Counter(h["from"])
        if set(new) == {"script"} and "script" in h["from"]:
            continue
        takes = [p for p, spare in sorted(left.items()) if p != h["parent"] and (common := sum((new & spare).values())) and sum(new.values()) <= ratio * common]
        out.append({**h, "takes": takes})
    return out


def script_goals(counts: DataFrame) -> DataFrame:
    """(graph, item, median): of goal states (graph, state, item, n, goals) the upper median of how often an item is in them; states without it count as zero."""
    from .stats import median_by_weight

    states = counts.select("graph", "state", "goals").distinct()
    items = counts.select("graph", "item").distinct()
    every = states.join(items, "graph").join(counts.select("graph", "state", "item", "n"), ["graph", "state", "item"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return median_by_weight(every, ["graph", "item"], "n", "goals")
