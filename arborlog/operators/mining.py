"""Frequent shapes of trees and the rules they make."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved
from .stats import follower_overlap, numbered, rule_support
from .trees import Node, unpack

EMPTY = "*"
#: Of ``agreeing``: different sets and their values in a part at most (a longer set is a part of its own), sets held against a part, rules and pairs counted at a time.
PART, VALUES, ROWS, COLUMNS, PAIRS = 8192, 4_000_000, 1024, 1024, 4_000_000
#: A rule is counted by matrices where its pairs are at least this share of a block's.
DENSE = 1 / 128


def pq_grams(root: Node, p: int, q: int) -> dict[tuple[str, ...], int]:
    """Grams of p nodes of a path and q neighbouring children, with how often they come; a leaf's gram counts once.

    That a gram comes n times says that it comes at least 1, 2, ... n times, which is what a rule is about.
    """
    found: Counter = Counter()
    for n in root.walk():
        stem = [x.type for _, x in zip(range(p), n.up(), strict=False)][::-1]
        stem = [EMPTY] * (p - len(stem)) + stem
        if not n.children:
            found.setdefault((*stem, *[EMPTY] * q), 1)
            continue
        row = [EMPTY] * (q - 1) + n.types + [EMPTY] * (q - 1)
        found.update((*stem, *row[i : i + q]) for i in range(len(row) - q + 1))
    return dict(found)


def all_grams(root: Node, most_p: int = 3, most_q: int = 4) -> dict[tuple[str, ...], int]:
    return {(f"{p},{q}", *g): n for p in range(1, most_p + 1) for q in range(1, most_q + 1) for g, n in pq_grams(root, p, q).items()}


def profile(root: Node, p: int = 2, q: int = 3) -> Counter:
    """The bag of p,q-grams (Augsten et al. 2005), leaves counting as often as they come."""
    out: Counter = Counter()
    for n in root.walk():
        stem = [x.type for _, x in zip(range(p), n.up(), strict=False)][::-1]
        stem = [EMPTY] * (p - len(stem)) + stem
        row = [EMPTY] * (q - 1) + n.types + [EMPTY] * (q - 1) if n.children else [EMPTY] * q
        out.update((*stem, *row[i : i + q]) for i in range(len(row) - q + 1))
    return out


def profile_distance(a: Node, b: Node, p: int = 2, q: int = 3) -> float:
    x, y = profile(a, p, q), profile(b, p, q)
    return 1 - 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))


def grams(trees: DataFrame, key: str, tree: str = "tree", p: int = 2, q: int = 3, bag: bool = False) -> DataFrame:
    """(key, gram, n) of packed trees; the gram is its tokens joined by spaces."""

    @F.pandas_udf("array<struct<gram:string,n:int>>")
    def run(rows: pd.Series) -> pd.Series:
        make = profile if bag else pq_grams
        return pd.Series([[{"gram": " ".join(g), "n": n} for g, n in sorted(make(unpack(t), p, q).items())] if t is not None and len(t) else None for t in rows])

    return trees.select(key, F.explode(run(tree)).alias("g")).select(key, "g.gram", F.col("g.n").cast("long").alias("n"))


def gram_distance(grams_: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(a, b, distance) of pairs of keys, from their bags of grams."""
    total = grams_.groupBy(key).agg(F.sum("n").alias("total"))
    a, b = grams_.select(F.col(key).alias("a"), "gram", F.col("n").alias("na")), grams_.select(F.col(key).alias("b"), "gram", F.col("n").alias("nb"))
    both = pairs.select("a", "b").join(a, "a").join(b, ["b", "gram"]).groupBy("a", "b").agg(F.sum(F.least("na", "nb")).alias("common"))
    rows = pairs.select("a", "b").join(both, ["a", "b"], "left").join(total.select(F.col(key).alias("a"), F.col("total").alias("ta")), "a").join(total.select(F.col(key).alias("b"), F.col("total").alias("tb")), "b")
    return rows.select("a", "b", (1 - 2 * F.coalesce("common", F.lit(0)) / (F.col("ta") + F.col("tb"))).alias("distance"))


def frequent_rules(grams_: DataFrame, key: str, n: int, support: float) -> DataFrame:
    """(gram, least, followers) of the rules that enough but not all of n trees follow."""
    counts = grams_.select(F.col(key).alias("attempt"), F.col("gram").alias("key"), F.col("n").alias("count"))
    return rule_support(counts, "key", n, support).withColumnRenamed("key", "gram")


def followers(grams_: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(rule, key): which trees follow which rules."""
    return rules.select("gram", "least").join(grams_, "gram").where("n >= least").select(F.concat_ws("#", "gram", "least").alias("rule"), key)


def without_doubles(bridge: DataFrame, rule: str, follower: str, similar: float = 0.975) -> DataFrame:
    """The rules none of whose betters (more followers, then the lesser name) has nearly the same followers."""
    size = bridge.select(rule, follower).distinct().groupBy(rule).agg(F.count("*").alias("n"))
    near = follower_overlap(bridge, rule, follower).where(F.col("jaccard") >= similar)
    a, b = size.select(F.col(rule).alias("a"), F.col("n").alias("na")), size.select(F.col(rule).alias("b"), F.col("n").alias("nb"))
    ranked = near.join(a, "a").join(b, "b")
    worse = ranked.select(F.when(F.col("na") >= F.col("nb"), F.col("b")).otherwise(F.col("a")).alias(rule)).distinct()
    return size.join(worse, rule, "left_anti")


def disjunctions(follow: dict[str, set], n: int, overlap: float = 0.15, ratio: float = 0.4, support: float = 0.9) -> list[tuple[str, ...]]:
    """Sets of rules that exclude one another and together hold for nearly all of n solutions; grown greedily from each rule.

    ``follow`` has the rules kept by without_doubles, whose number doesn't grow with the log.
    """
    out = set()
    order = sorted(follow, key=lambda r: (-len(follow[r]), r))
    for first in order:
        group, seen = [first], set(follow[first])
        for r in order:
            own = follow[r]
            if r in group or not own or len(own & seen) / len(own) > overlap or len(own & seen) / len(own | seen) >= ratio:
                continue
            group.append(r)
            seen |= own
        if len(group) > 1 and len(seen) >= support * n:
            out.add(tuple(sorted(group)))
    return sorted(out)


class _Part:
    """Solutions' sets of rules, to hold queries' sets against; rows (class, weight, rules)."""

    def __init__(self, rows: pa.Table):
        self.ids, self.weight = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        self.n = len(self.ids)
        own = np.repeat(np.arange(self.n), pc.list_value_length(rows.column(2)).to_numpy())
        self.rules, code = np.unique(pc.list_flatten(rows.column(2)).to_numpy(), return_inverse=True)
        order = np.argsort(code, kind="stable")
        self.code, self.own = code[order], own[order]
        self.many = np.bincount(code, minlength=len(self.rules))
        self.start = np.cumsum(self.many) - self.many

    def common(self, rows: pa.RecordBatch) -> np.ndarray:
        """How many rules each of the queries' sets shares with each of the part's: frequent rules by products of matrices, rare ones by their pairs."""
        own = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows.column(2)).to_numpy())
        value = pc.list_flatten(rows.column(2)).to_numpy()
        code = np.minimum(np.searchsorted(self.rules, value), len(self.rules) - 1)
        known = self.rules[code] == value
        own, code = own[known], code[known]
        kind = np.float32 if len(self.rules) < 1 << 24 else np.float64  # so that counts are exact
        out = np.zeros((rows.num_rows, self.n), kind)
        often = np.bincount(code, minlength=len(self.rules)) * self.many >= DENSE * out.size
        frequent = np.flatnonzero(often)
        for k in range(0, len(frequent), COLUMNS):
            chunk = frequent[k : k + COLUMNS]
            at = np.full(len(self.rules), -1)
            at[chunk] = np.arange(len(chunk))
            x, y = np.zeros((rows.num_rows, len(chunk)), kind), np.zeros((self.n, len(chunk)), kind)
            for m, o, c in ((x, own, at[code]), (y, self.own, at[self.code])):
                m[o[c >= 0], c[c >= 0]] = 1
            out += x @ y.T
        own, code = own[~often[code]], code[~often[code]]
        many, flat = self.many[code], out.reshape(-1)
        ends = np.cumsum(many)
        cuts = np.flatnonzero(np.diff(ends // PAIRS, prepend=0))
        for low, high in pairwise([0, *cuts.tolist(), len(code)]):
            m = many[low:high]
            before = np.cumsum(m) - m
            other = self.own[np.arange(m.sum()) + np.repeat(self.start[code[low:high]] - before, m)]
            np.add.at(flat, np.repeat(own[low:high] * self.n, m) + other, 1)
        return out

    def best(self, rows: pa.RecordBatch, least: int) -> pa.RecordBatch:
        """(a, b, agreed, weight): of each of the queries' sets the sets that can be among its best, which are those of the part with ties."""
        common = self.common(rows)
        last = self.n - max(1, min(least, self.n))
        low = np.maximum(np.partition(common, last, axis=1)[:, last], 1)
        i, j = np.nonzero(common >= low[:, None])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (rows.column(0).to_numpy()[i], self.ids[j], common[i, j].astype(np.int64), self.weight[j])], names=["a", "b", "agreed", "weight"])


def _best(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, split, asks, class, weight, rules) in order of the first three: what ``best`` gives for each split of queries and part of solutions."""
    now, held, part = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for low, high in pairwise(sorted({0, *edges.tolist(), len(keys)})):
            rows = batch.select([3, 4, 5]).slice(low, high - low)
            if (keys[low, :2] != now).any():
                now, held, part = keys[low, :2], [], None
            if not keys[low, 2]:
                held.append(rows)
                continue
            if part is None:
                part, held = _Part(pa.Table.from_batches(held)), []
            for k in range(0, rows.num_rows, ROWS):
                yield part.best(rows.slice(k, ROWS), least)


def agreeing(query_rules: DataFrame, solution_rules: DataFrame, least: int = 5) -> DataFrame:
    """(query, solution, agreed): solutions ranked by the decisions they share with a query; the best ``least`` with ties.

    Exact: queries and solutions with equal sets of rules are grouped, and each different set of a query is held against each of the
    solutions, a bounded part of them at a time; of a part only those travel that are among its best. A null is no rule.
    """
    known = numbered(solution_rules.select("rule").where("rule is not null").distinct(), ["rule"])

    def sets(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """(key, rules), and the different sets (class, weight, rules) with how many have them, numbered by size."""
        named = saved(rows.join(known, "rule").groupBy(key).agg(F.sort_array(F.collect_set("number")).alias("rules")))
        return named, numbered(named.groupBy(F.size("rules").alias("size"), "rules").agg(F.count("*").alias("weight")), ["size", "rules"], "class")

    queries, asked = sets(query_rules, "query")
    solutions, found = sets(solution_rules, "solution")
    bits = F.floor(F.log2("size")).cast("int")
    found = found.withColumn("bits", bits).withColumn("part", F.expr(f"bits * (1L << 48) + class div greatest(1, least({PART}, {VALUES} div (2L << bits)))"))
    asked = asked.withColumn("split", F.expr(f"class div {PART}"))
    parts, splits = saved(found.select("part").distinct()), saved(asked.select("split").distinct())
    columns = ["part", "split", "asks", "class", "weight", "rules"]
    rows = found.crossJoin(F.broadcast(splits)).withColumn("asks", F.lit(0).cast("long")).select(columns)
    rows = rows.unionByName(asked.crossJoin(F.broadcast(parts)).withColumn("asks", F.lit(1).cast("long")).select(columns))
    tasks = max(1, min(parts.count() * splits.count(), 10_000))
    rows = rows.repartition(tasks, "part", "split").sortWithinPartitions("part", "split", "asks")
    pairs = rows.mapInArrow(lambda batches: _best(batches, least), "a long, b long, agreed long, weight long")
    better = F.sum("weight").over(Window.partitionBy("a").orderBy(-F.col("agreed")).rangeBetween(Window.unboundedPreceding, -1))
    pairs = pairs.withColumn("better", F.coalesce(better, F.lit(0))).where(F.col("better") < least).select("a", "b", "agreed")
    queries = queries.join(asked.select("rules", F.col("class").alias("a")), "rules").select("query", "a")
    solutions = solutions.join(found.select("rules", F.col("class").alias("b")), "rules").select("solution", "b")
    return pairs.join(queries, "a").join(solutions, "b").select("query", "solution", "agreed")


def feature_columns(bridge: DataFrame, rules: list[str], key: str) -> DataFrame:
    """A 0/1 column for each of the rules."""
    has = lambda r: F.max((F.col("rule") == r).cast("int"))
    return bridge.groupBy(key).agg(*[has(r).alias(f"f{k}") for k, r in enumerate(rules)])


def root_path_grams(nodes: DataFrame, keys: list[str], p: int, q: int) -> DataFrame:
    """(keys, gram, n) from a node table, JVM-side: the tail of the path and sliding slices of the padded child types."""
    pad = lambda k: F.array(*[F.lit(EMPTY)] * k) if k else F.array().cast("array<string>")
    stem: Column = F.slice(F.concat(pad(p), F.col("path")), -p, p)
    inner = F.concat(pad(q - 1), F.col("types"), pad(q - 1))
    row = F.when(F.size("types") == 0, pad(q)).otherwise(inner)
    gram = F.transform(F.sequence(F.lit(1), F.size(row) - q + 1), lambda i: F.array_join(F.concat(stem, F.slice(row, i, q)), " "))
    each = nodes.select(*keys, F.explode(gram).alias("gram"))
    return each.groupBy(*keys, "gram").agg(F.count("*").alias("n"))


def gram_edits(a: Node, b: Node, p: int = 2, q: int = 3) -> list[tuple[str, str, str]]:
    """(action, parent, label): labels that the bags of grams gain or lose under a parent's label; a loss and a gain there are a relabel (old>new)."""
    x, y = profile(a, p, q), profile(b, p, q)
    lost, won = Counter(), Counter()
    for bag, out in ((x - y, lost), (y - x, won)):
        for g, n in bag.items():
            if g[p] != EMPTY and all(t == EMPTY for t in g[p + 1 :]):  # each child ends one row of its parent once
                out[(g[p - 1], g[p])] += n
    edits = []
    for parent in sorted({k[0] for k in lost} | {k[0] for k in won}):
        old = sorted(x for (par, x), n in lost.items() if par == parent for _ in range(n))
        new = sorted(x for (par, x), n in won.items() if par == parent for _ in range(n))
        edits += [("relabel", parent, f"{o}>{n}") for o, n in zip(old, new, strict=False)]
        edits += [("delete", parent, o) for o in old[len(new) :]] + [("insert", parent, n) for n in new[len(old) :]]
    return edits


def minimised(found: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Edits (action, parent, label) without pairs that undo one another, and with a deletion and an insertion of one label elsewhere as a move (from>to)."""
    count: Counter = Counter(found)
    for action, parent, label in list(count):
        if action == "relabel":
            old, new = label.split(">")
            back = ("relabel", parent, f"{new}>{old}")
            n = min(count[(action, parent, label)], count.get(back, 0))
            if old < new and n:
                count[(action, parent, label)] -= n
                count[back] -= n
    for (_, parent, label), n in sorted((k, v) for k, v in count.items() if k[0] == "delete"):
        for k in sorted(k for k in count if k[0] == "insert" and k[2] == label):
            m = min(n, count[k])
            if m:
                count[k] -= m
                count[("delete", parent, label)] -= m
                n -= m
                if k[1] != parent:
                    count[("move", f"{parent}>{k[1]}", label)] += m
    return sorted(x for x in count.elements())


def contained(small: tuple[str, ...], large: tuple[str, ...], p: int) -> bool:
    """Whether a gram (p stem labels, then base labels) is part of another of at least its size: its stem ends the other's, its base stands in a row of the other's."""
    stem, base = small[:p], small[p:]
    for q in range(p, len(large)):
        head, row = large[:q], large[q:]
        if head[-len(stem) :] == stem and any(row[i : i + len(base)] == base for i in range(len(row) - len(base) + 1)):
            return True
    return False


def conjunctions(bridge: DataFrame, rule: str, follower: str, least: int) -> DataFrame:
    """(a, b, followers): pairs of rules that at least so many follow together."""
    return follower_overlap(bridge, rule, follower).where(F.col("both") >= least).select("a", "b", F.col("both").alias("followers"))


def shapes(grams_: DataFrame, key: str, n: int, support: float = 0.1) -> DataFrame:
    """(gram, support): shapes that enough of n trees have at all."""
    found = grams_.select("gram", key).distinct().groupBy("gram").agg(F.count("*").alias("followers"))
    return found.where(F.col("followers") >= support * n).select("gram", (F.col("followers") / n).alias("support"))


def cluster_features(features: DataFrame, clusters: DataFrame, key: str) -> DataFrame:
    """(key, cluster, has): whether a tree follows all rules of a cluster; features (key, rule, ok), clusters (rule, cluster)."""
    return features.join(F.broadcast(clusters), "rule").groupBy(key, "cluster").agg(F.min(F.col("ok").cast("int")).alias("has"))


def mean_jaccard(sets: list[set]) -> float:
    """The mean over the pairs of rules of a disjunction; one more is counted than there are pairs, so a single rule has 0."""
    total, n = 0.0, 1
    for i, a in enumerate(sets):
        for b in sets[:i]:
            total += len(a & b) / len(a | b) if a | b else 0.0
            n += 1
    return total / n


def plausible(ranked: DataFrame, follows: DataFrame, query_follows: DataFrame, share: float = 0.15) -> DataFrame:
    """Of ranked solutions (query, solution) those that are left when, rule by rule, the followers of a rule that the query doesn't follow go if they are some but under ``share`` of what is left.

    follows (solution, rule), query_follows (query, rule). The set shrinks as it goes, so a query's few solutions are one group.
    """
    rows = ranked.select("query", "solution").join(follows, "solution").groupBy("query", "solution").agg(F.collect_set("rule").alias("rules"))
    rows = ranked.select("query", "solution").join(rows, ["query", "solution"], "left")
    own = query_follows.groupBy("query").agg(F.collect_set("rule").alias("own"))
    rows = rows.join(own, "query", "left")
    kinds = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in ("query", "solution"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        own = set(x if (x := group["own"].iloc[0]) is not None else ())
        has = {s: set(r if r is not None else ()) for s, r in zip(group["solution"], group["rules"], strict=True)}
        left = set(has)
        for rule in sorted(set().union(*has.values()) - own):
            gone = {s for s in left if rule in has[s]}
            if 0 < len(gone) < share * len(left):
                left -= gone
        return group[group["solution"].isin(left)][["query", "solution"]]

    return rows.groupBy("query").applyInPandas(one, kinds)
