"""Alignment of a tree with solutions, the edits between them, and votes over the nearest solutions.

Nodes are compared only with nodes whose parents stand on the same path of types (the block), so a tree's cost is the sum of its blocks'.
Within a block, the cost of pairing two nodes is how little of the one's children the other has; the Hungarian method
finds the pairing of least cost. Different solutions are broadcast in blocks of bounded size; a query orders them by a lower bound of their cost,
from the paths of types that both trees have, and aligns them only until no other can be among its nearest.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import align_cost, align_pairs, missing_count, progress
from .trees import TREE, Node, unpack

#: Different trees of solutions that are broadcast at most; beyond, queries meet them in blocks.
BROADCAST_SOLUTIONS = 10_000
#: And of what size, as JSON.
BROADCAST_MB = 64


@dataclass(frozen=True)
class Config:
    """What is known of a language."""

    containers: frozenset = frozenset({"script", "sprite", "stage", "document", "body"})
    flexible: frozenset = frozenset({"script", "sprite", "stage", "snapshot", "document", "body", "div", "ul", "table"})
    valueless: frozenset = frozenset({"literal", "null"})
    ordered: float = 2.0
    unordered: float = 1.0
    missing: float = 0.25
    unmatched: float = 0.25
    #: What of a value counts: "ignore" it, "mapped" (names that the first round pairs count as equal, others don't count), "exact".
    values: str = "ignore"

    def fixed(self, n: Node) -> bool:
        return n.type not in self.flexible


def hungarian(cost: np.ndarray) -> list[int]:
    """For each row the column of a least-cost pairing, or -1 if there are more rows than columns (shortest augmenting paths)."""
    rows, cols = cost.shape
    if rows > cols:
        back = hungarian(cost.T)
        out = [-1] * rows
        for j, i in enumerate(back):
            out[i] = j
        return out
    u, v = np.zeros(rows + 1), np.zeros(cols + 1)
    owner, prev = np.zeros(cols + 1, int), np.zeros(cols + 1, int)
    for i in range(1, rows + 1):
        owner[0], j = i, 0
        low, done = np.full(cols + 1, np.inf), np.zeros(cols + 1, bool)
        while True:
            done[j] = True
            slack = cost[owner[j] - 1] - u[owner[j]] - v[1:]
            open_ = ~done[1:]
            better = open_ & (slack < low[1:])
            low[1:][better] = slack[better]
            prev[1:][better] = j
            k = int(np.where(open_, low[1:], np.inf).argmin()) + 1
            step = low[k]
            u[owner[done]] += step
            v[done] -= step
            low[~done] -= step
            j = k
            if not owner[j]:
                break
        while j:
            owner[j] = owner[prev[j]]
            j = prev[j]
    out = [-1] * rows
    for j in range(1, cols + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


@dataclass
class Mapping:
    cost: float = 0.0
    to: dict[int, Node] = field(default_factory=dict)
    back: dict[int, Node] = field(default_factory=dict)
    #: Nodes below one that is paired with a wildcard: they stay as they are.
    free: set[int] = field(default_factory=set)

    def pair(self, a: Node, b: Node) -> None:
        """One to one: earlier partners of both are let go."""
        if (old := self.to.pop(id(a), None)) is not None:
            self.back.pop(id(old), None)
        if (old := self.back.pop(id(b), None)) is not None:
            self.to.pop(id(old), None)
        self.to[id(a)], self.back[id(b)] = b, a


def child_cost(a: Node, b: Node, cfg: Config, x: list[str] | None = None, y: list[str] | None = None) -> float:
    """Less, the more of b's children (labels y) a has (labels x). Children with fixed places are compared place by place."""
    if b.any_children:
        return 0.0
    x, y = a.types if x is None else x, b.types if y is None else y
    if not cfg.fixed(a):
        return cfg.missing * missing_count(x, y) - progress(x, y, [c.order_group for c in b.children], cfg.ordered, cfg.unordered, cfg.missing)
    same = sum(-cfg.ordered if p == q and p not in cfg.valueless else 0.0 if p == q else cfg.missing for p, q in zip(x, y))  # noqa: B905
    return same + cfg.missing * max(0, len(y) - len(x))


def align(a: Node, b: Node, cfg: Config = Config()) -> Mapping:  # noqa: B008
    """The pairing of two trees and its cost. Where names are mapped, a first round without them finds which names belong together."""
    if cfg.values == "ignore":
        return _round(a, b, cfg, {id(n): n.type for root in (a, b) for n in root.walk()})
    valued = lambda n, value: n.type if value is None else f"{n.type}:{value}"
    if cfg.values == "exact":
        return _round(a, b, cfg, {id(n): valued(n, n.value) for root in (a, b) for n in root.walk()})
    first = _round(a, b, cfg, {id(n): n.type for root in (a, b) for n in root.walk()})
    names = value_mapping(a, first)
    known = set(names.values())
    label = {id(n): valued(n, names.get(n.value)) for n in a.walk()}
    label |= {id(n): valued(n, n.value if n.value in known else None) for n in b.walk()}
    return _round(a, b, cfg, label)


def _round(a: Node, b: Node, cfg: Config, label: dict[int, str]) -> Mapping:
    out = Mapping()
    out.pair(a, b)
    blocks: dict[tuple, tuple[list[Node], list[Node]]] = defaultdict(lambda: ([], []))
    kids, walks = {}, {}
    for side, root in enumerate((a, b)):
        path: dict[int, tuple] = {}
        for n in root.walk():
            path[id(n)] = (path[id(n.parent)] if n is not root else ()) + (label[id(n)],)
            kids[id(n)] = [label[id(c)] for c in n.children]
            if n.children or not cfg.fixed(n) or n.any_children:
                blocks[path[id(n)]][side].append(n)
    whole = lambda n: walks.setdefault(id(n), [label[id(x)] for x in n.walk()])
    for key in sorted(blocks, key=len):
        left, right = blocks[key]
        if not left or not right:
            if right:
                out.cost += cfg.unmatched * sum(n.size - 1 for n in right)
            continue
        cost = np.array([[child_cost(p, q, cfg, kids[id(p)], kids[id(q)]) for q in right] for p in left])
        if len(left) == len(right) == 1:
            pairs = [0]
        else:
            tie = np.array([[0.001 * -progress(whole(p), whole(q), None, cfg.ordered, cfg.unordered, cfg.missing) - (0.0001 if out.to.get(id(p)) is q else 0.0) for q in right] for p in left])
            pairs = hungarian(cost + tie - (cost + tie).min())
        known = {id(p) for p in left if id(p) in out.to}, {id(q) for q in right if id(q) in out.back}
        taken = set(pairs)
        for i, (p, j) in enumerate(zip(left, pairs, strict=True)):
            if j < 0:
                continue
            q = right[j]
            out.cost += float(cost[i, j])
            if id(p) not in known[0] and id(q) not in known[1] and p.type not in cfg.valueless:
                out.cost -= cfg.unordered + cfg.missing
            out.pair(p, q)
            if q.any_children:
                out.free |= {id(x) for x in p.walk()} - {id(p)}
            else:
                _pair_children(p, q, out)
        out.cost += sum(cfg.unmatched * (q.size - 1) for j, q in enumerate(right) if j not in taken)
    return out


def _pair_children(p: Node, q: Node, out: Mapping) -> None:
    """Children of paired nodes: in order as far as they align, then what is left by type."""
    rest_p, rest_q = [], []
    for i, j in align_pairs(p.types, q.types, 2, 2, 3):
        if i >= 0 and j >= 0:
            out.pair(p.children[i], q.children[j])
        elif i >= 0:
            rest_p.append(p.children[i])
        else:
            rest_q.append(q.children[j])
    for c in rest_p:
        match = next((d for d in rest_q if d.type == c.type), None)
        if match is not None:
            out.pair(c, match)
            rest_q.remove(match)


# --- edits ---


def edits(a: Node, b: Node, m: Mapping, cfg: Config = Config()) -> list[dict]:  # noqa: B008
    """What turns a into b: reorder, insert, move, relabel and delete rows, the most telling first; ``applied`` carries them out.

    ``node`` and ``parent`` are numbers of a's nodes in pre-order (-1: none; a parent that is inserted itself is known by ``pair_parent``);
    ``pair`` and ``pair_parent`` are numbers of b's nodes, ``place`` the place among the parent's children in b, ``index`` where in a that would be.
    An insertion of what is deleted elsewhere (same type) names the deleted node as its candidate. A reorder that stays within an order group is none.
    """
    number, target = ({id(n): i for i, n in enumerate(x.walk())} for x in (a, b))
    at = {id(c): i for x in (a, b) for n in x.walk() for i, c in enumerate(n.children)} | {id(a): 0, id(b): 0}
    out: list[dict] = []

    def row(action: str, n: Node | None, parent: Node | None, index: int, q: Node, pair: Node | None, candidate: Node | None = None) -> dict:
        up = pair.parent if pair is not None else None
        return {
            "action": action, "node": number[id(n)] if n is not None else -1, "parent": number[id(parent)] if parent is not None else -1, "index": index, "type": q.type, "value": q.value,
            "candidate": number[id(candidate)] if candidate is not None else -1, "pair": target[id(pair)] if pair is not None else -1, "pair_parent": target[id(up)] if up is not None else -1, "place": at[id(pair)] if pair is not None else -1,
        }

    gone = []
    for n in a.walk():
        pair = m.to.get(id(n))
        if pair is None:
            if id(n) not in m.free:
                gone.append(n)
            continue
        if n.type != pair.type or (cfg.values == "exact" and n.value != pair.value):
            out.append(row("relabel", n, n.parent, at[id(n)], pair, pair))
        if n.parent is None or pair.parent is None:
            continue
        home = m.back.get(id(pair.parent))
        if home is not n.parent:
            out.append(row("move", n, home, _slot(pair, home, m, at), n, pair))
    for n in a.walk():
        if id(n) in m.to:
            own = [c for c in n.children if id(c) in m.to and m.to[id(c)].parent is m.to[id(n)]]
            stay = set(_rising([at[id(m.to[id(c)])] for c in own]))
            for k, c in enumerate(own):
                pair = m.to[id(c)]
                if k not in stay and not _within_group(pair, [m.to[id(x)] for x in own], k):
                    out.append(row("reorder", c, n, at[id(pair)] if cfg.fixed(n) else _slot(pair, n, m, at), c, pair))
    for q in b.walk():
        if id(q) in m.back or q.parent is None:
            continue
        home = m.back.get(id(q.parent))
        reuse = min((g for g in gone if g.type == q.type), key=lambda g: (g.value != q.value, child_cost(g, q, cfg)), default=None)
        if reuse is not None:
            gone = [g for g in gone if g is not reuse]
        index = at[id(q)] if home is not None and cfg.fixed(home) else _slot(q, home, m, at)
        out.append(row("insert", None, home, index, q, q, reuse))
    out += [row("delete", n, n.parent, at[id(n)], n, None) for n in gone]
    rank = {"reorder": 0, "insert": 1, "move": 1, "relabel": 1, "delete": 2}
    return sorted(out, key=lambda e: rank[e["action"]])


def _rising(values: list[int]) -> list[int]:
    """Positions of a longest rising subsequence."""
    tails: list[int] = []
    tops: list[int] = []
    before: list[int] = []
    for k, v in enumerate(values):
        i = bisect_left(tops, v)
        before.append(tails[i - 1] if i else -1)
        tails[i : i + 1], tops[i : i + 1] = [k], [v]
    out, k = [], tails[-1] if tails else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _within_group(pair: Node, others: list[Node], k: int) -> bool:
    """Whether all that ``pair`` stands on the wrong side of are of its own order group."""
    at = pair.index
    wrong = [o for i, o in enumerate(others) if (i < k) != (o.index < at) and i != k]
    return pair.order_group > 0 and all(o.order_group == pair.order_group for o in wrong)


def _slot(q: Node, home: Node | None, m: Mapping, at: dict[int, int]) -> int:
    """After the nearest earlier sibling of q that has a partner under ``home``."""
    if home is None or q.parent is None:
        return 0
    for s in reversed(q.parent.children[: at[id(q)]]):
        p = m.back.get(id(s))
        if p is not None and p.parent is home:
            return at[id(p)] + 1
    return 0


def applied(a: Node, found: list[dict]) -> Node:
    """A copy of a with the edits carried out.

    What moves, is reordered, reused or deleted is taken out first; then, from the outside in and from left to right, each is put, and each new
    node made, at its place under its parent: a node of a, or one that an earlier insertion made. A place beyond the end is the end.
    An edit whose parent there isn't is passed over.
    """
    root = a.copy()
    nodes = list(root.walk())
    made: dict[int, Node] = {}

    def take(n: Node) -> None:
        if n.parent is not None:
            n.parent.children = [c for c in n.parent.children if c is not n]
            n.parent = None

    for e in found:
        if e["action"] == "relabel":
            nodes[e["node"]].type, nodes[e["node"]].value = e["type"], e["value"]
            if e["pair"] >= 0:
                made[e["pair"]] = nodes[e["node"]]
    puts = [e for e in found if e["action"] in ("insert", "move", "reorder")]
    used = {e["candidate"] for e in puts if e["candidate"] >= 0}
    for e in found:
        if e["action"] == "delete" and e["node"] not in used or e["action"] in ("move", "reorder"):
            take(nodes[e["node"]])
    for k in used:
        take(nodes[k])
    for e in sorted(puts, key=lambda e: e["pair"]):  # pre-order of the target: parents and earlier siblings come first
        if e["action"] == "insert" and e["candidate"] < 0:
            n = Node(e["type"], e["value"])
        else:
            n = nodes[e["node"] if e["action"] != "insert" else e["candidate"]]
            if e["action"] == "insert":
                n.value = e["value"]
        made[e["pair"]] = n
        parent = nodes[e["parent"]] if e["parent"] >= 0 else made.get(e["pair_parent"])
        if parent is None or any(x is n for x in parent.up()):
            continue
        n.parent = parent
        parent.children.insert(min(e["place"], len(parent.children)), n)
    return root


def edit_key(e: dict, nodes: list[Node]) -> str:
    """Equal for edits of two alignments of one tree that ask for the same: by action, parent, place, and what is put or taken."""
    name = lambda k: "-" if k < 0 else nodes[k].ext_id or f"{nodes[k].type}#{k}"
    return "|".join([e["action"], name(e["parent"]), str(e["index"]), e["type"], e["value"] or "", name(e["node"]), name(e["candidate"])])


def shown(e: dict, nodes: list[Node]) -> dict:
    """What an edit looks like: (message, parent, from, to), the child types of the parent before and after it alone."""
    parent = nodes[e["parent"]] if e["parent"] >= 0 else None
    before = parent.types if parent is not None else []
    after = list(before)
    if e["node"] >= 0 and nodes[e["node"]].parent is parent and parent is not None:
        del after[nodes[e["node"]].index]
    if e["action"] == "relabel" and e["node"] >= 0 and parent is not None:
        after.insert(nodes[e["node"]].index, e["type"])
    if e["action"] in ("insert", "move", "reorder"):
        after.insert(min(e["index"], len(after)), e["type"])
    return {"message": e["action"], "parent": parent.type if parent is not None else None, "from": before, "to": after}


def priority(e: dict) -> float:
    """Reorders before insertions (with a known parent first) before deletions."""
    return {"reorder": 5.0, "move": 3.5, "relabel": 3.4, "insert": 3.3 if e["parent"] >= 0 else 3.0, "delete": 1.0}[e["action"]]


def displayed(found: list[dict], first_only: bool = False) -> list[dict]:
    """Insertions and moves with a known parent, in their order; on wish only the first for each place."""
    kept, seen = [], set()
    for e in found:
        if e["action"] in ("insert", "move") and e["parent"] >= 0:
            if first_only and (e["parent"], e["index"]) in seen:
                continue
            seen.add((e["parent"], e["index"]))
            kept.append(e)
    return kept


def cleaned(found: list[dict], nodes: list[Node], harmless: frozenset = frozenset()) -> list[dict]:
    """Without insertions that have neither parent nor candidate, and without deletions of harmless types or below what goes or moves anyway."""
    gone = {e["node"] for e in found if e["action"] in ("delete", "move", "replace")} | {e["candidate"] for e in found if e["candidate"] >= 0}
    number = {id(n): i for i, n in enumerate(nodes)}
    out = []
    for e in found:
        if e["action"] == "insert" and e["parent"] < 0 and e["candidate"] < 0:
            continue
        if e["action"] == "delete":
            n = nodes[e["node"]]
            if n.type in harmless or any(number[id(u)] in gone for u in n.up() if u is not n):
                continue
        out.append(e)
    return out


def nested(found: list[dict]) -> list[tuple[int, int]]:
    """(edit, within): of each insertion whose parent is inserted itself, the edit that inserts the parent; edits are numbered as they stand."""
    makes = {e["pair"]: i for i, e in enumerate(found) if e["action"] == "insert"}
    return [(i, makes[e["pair_parent"]]) for i, e in enumerate(found) if e["action"] in ("insert", "move") and e["parent"] < 0 and e["pair_parent"] in makes]


def by_ids(a: Node, b: Node) -> Mapping:
    """The pairing of two trees by the ids that their nodes share."""
    out = Mapping()
    out.pair(a, b)
    there = {n.ext_id: n for n in b.walk() if n.ext_id is not None and n is not b}
    for n in a.walk():
        if n is not a and n.ext_id in there and there[n.ext_id].type == n.type:
            out.pair(n, there.pop(n.ext_id))
    return out


EDITS = "array<struct<action:string,node:int,parent:int,index:int,type:string,value:string,candidate:int,pair:int,pair_parent:int,place:int>>"


def aligned(pairs: DataFrame, a: str, b: str, cfg: Config = Config()) -> DataFrame:  # noqa: B008
    """Adds cost and edits of two packed-tree columns; null trees give null."""

    @F.pandas_udf(f"struct<cost:double,edits:{EDITS}>")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        cost, found = [], []
        for p, q in zip(x, y, strict=True):
            s, t = unpack(p), unpack(q)
            if s is None or t is None:
                cost.append(None)
                found.append(None)
                continue
            m = align(s, t, cfg)
            cost.append(m.cost)
            found.append(edits(s, t, m, cfg))
        return pd.DataFrame({"cost": cost, "edits": found})

    return pairs.withColumn("__r", run(a, b)).select("*", "__r.cost", "__r.edits").drop("__r")


class Solutions:
    """Trees of solutions, with the paths of types that each has."""

    def __init__(self, rows: list[tuple], cfg: Config):
        self.cfg = cfg
        self.rows = [(key, solution, place) for key, solution, _, place in rows]
        self.packed = [tree for _, _, tree, _ in rows]
        self.trees: dict[int, Node] = {}
        self.size = np.array([len(t) for t in self.packed])
        self.members: dict[object, np.ndarray] = {}
        for place in {x[2] for x in self.rows}:
            self.members[place] = np.array([i for i, x in enumerate(self.rows) if x[2] == place])
        counts: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for i, tree in enumerate(self.packed):
            for path, n in type_paths(tree).items():
                counts[path].append((i, n))
        self.counts = {path: tuple(np.array(x) for x in zip(*found, strict=True)) for path, found in counts.items()}

    def bounds(self, query) -> np.ndarray:
        """Of each solution, what its cost is at least: each node of a path that both have earns at most a match and a pairing, all others cost a miss."""
        common = np.zeros(len(self.rows))
        for path, n in type_paths(query).items():
            if path in self.counts:
                i, many = self.counts[path]
                common[i] += np.minimum(many, n)
        c = self.cfg
        return -(c.ordered + c.unordered + c.missing) * common + min(c.missing, c.unmatched) * np.maximum(0, self.size - 1 - common)

    def tree(self, i: int) -> Node:
        if i not in self.trees:
            self.trees[i] = unpack(self.packed[i])
        return self.trees[i]

    def best(self, query, place, most: int) -> list[tuple[float, int, object, int, list[dict]]]:
        """(cost, size, solution, row, edits) of the solutions of least cost, ties to the smaller and the lesser."""
        own = self.members.get(place, np.zeros(0, np.int64))
        low = self.bounds(query)[own]
        root = unpack(query)
        found: list[tuple[float, int, object, int]] = []
        for k in np.argsort(low, kind="stable").tolist():
            if len(found) >= most and low[k] > found[most - 1][0] + 1e-9:
                break
            i = int(own[k])
            insort(found, (align(root, self.tree(i), self.cfg).cost, int(self.size[i]), self.rows[i][1], i))
            del found[most:]
        return [(*f, edits(root, self.tree(f[3]), align(root, self.tree(f[3]), self.cfg), self.cfg)) for f in found]


def type_paths(tree) -> dict[tuple, int]:
    """How many nodes of a packed tree stand on each path of types."""
    path: list[tuple] = []
    out: dict[tuple, int] = defaultdict(int)
    for x in tree:
        path.append((path[x["parent"]] if x["parent"] >= 0 else ()) + (x["type"],))
        out[path[-1]] += 1
    return out


def nearest(queries: DataFrame, solutions: DataFrame, k: int = 10, query_id: str = "query", solution_id: str = "solution", tree: str = "tree", block: str | None = None, cfg: Config = Config()) -> DataFrame:  # noqa: B008
    """(query, solution, cost, edits, rank): the k solutions of least cost, ties to the smaller tree, then the lesser id.

    Every query is held against all solutions but its own id. Equal trees are grouped on both sides first, so each pair of different
    trees is aligned at most once; different solutions are met in blocks of ``BROADCAST_SOLUTIONS``. ``block`` names a column (the problem)
    that both sides must share. A query with a null tree has no solutions.
    """
    spark = queries.sparkSession
    place = F.col(block).cast("string") if block else F.lit("")
    key = F.sha2(F.to_json(F.col(tree)), 256)
    s = solutions.select(F.col(solution_id).alias("solution"), F.col(tree).alias("t"), place.alias("b"), key.alias("sk")).where("solution is not null and size(t) > 0")
    q = queries.select(F.col(query_id).alias("query"), F.col(tree).alias("t"), place.alias("b"), key.alias("qk")).where("query is not null and size(t) > 0")
    kinds = s.groupBy("b", "sk").agg(F.first("t").alias("t"), F.min("solution").alias("solution"))
    asked = q.groupBy("b", "qk").agg(F.first("t").alias("t")).repartition(spark.sparkContext.defaultParallelism * 2, "b", "qk")
    n, mb = kinds.agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json("t"))), F.lit(0)) / 1e6).first()
    # so many rows are kept of a group that k are left once those of the query's own id are gone
    spare = k + (s.groupBy("solution").count().agg(F.max("count")).first()[0] or 0)
    kind = s.schema["solution"].dataType.simpleString()
    many = max(1, -(-n // BROADCAST_SOLUTIONS), int(-(-mb // BROADCAST_MB)))

    def one(part: int) -> DataFrame:
        held = kinds.where(F.pmod(F.xxhash64("sk"), F.lit(many)) == part) if many > 1 else kinds
        sent = spark.sparkContext.broadcast([(r.sk, r.solution, [x.asDict() for x in r.t], r.b) for r in held.collect()])

        def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
            known = Solutions(sent.value, cfg)
            for batch in batches:
                rows = [(b, qk, known.rows[i][0], solution, cost, found, size) for b, qk, t in zip(batch["b"], batch["qk"], batch["t"], strict=True) for cost, size, solution, i, found in known.best(t, b, spare)]
                yield pd.DataFrame(rows, columns=["b", "qk", "sk", "solution", "cost", "edits", "size"])

        return asked.mapInPandas(run, f"b string, qk string, sk string, solution {kind}, cost double, edits {EDITS}, size int")

    def best(rows: DataFrame, most: int, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("cost", "size", "solution")
        return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)

    pairs = one(0)
    for part in range(1, many):
        pairs = pairs.unionByName(one(part))
    if many > 1:
        pairs = best(pairs, spare, "b", "qk").drop("rank")
    least = s.select("b", "sk", "solution", F.row_number().over(Window.partitionBy("b", "sk").orderBy("solution")).alias("n")).where(F.col("n") <= spare)
    held = best(pairs.drop("solution").join(least, ["b", "sk"]), spare, "b", "qk").drop("rank")
    out = best(q.select("query", "b", "qk").join(held, ["b", "qk"]).where(F.col("query") != F.col("solution")), k, "query")
    return out.select("query", "solution", "cost", "edits", "rank")


def consensus(near: DataFrame, share: float = 0.6) -> DataFrame:
    """(query, action, node, parent, type, votes, priority): edits that at least that share of a query's nearest solutions ask for."""
    n = near.groupBy("query").agg(F.count("*").alias("k"))
    each = near.select("query", "solution", F.explode("edits").alias("e")).select("query", "solution", "e.action", "e.node", "e.parent", "e.type").distinct()
    votes = each.groupBy("query", "action", "node", "parent", "type").agg(F.count("*").alias("votes"))
    return votes.join(n, "query").where(F.col("votes") >= F.ceil(F.col("k") * share)).select("query", "action", "node", "parent", "type", "votes", (F.col("votes") / F.col("k")).alias("priority"))


def agreement(left: DataFrame, right: DataFrame, key: list[str], action: str) -> DataFrame:
    """(left, right, n): how two sets of edits label the same places; ``keep`` where one has none."""
    a, b = left.select(*key, F.col(action).alias("l")), right.select(*key, F.col(action).alias("r"))
    keep = F.lit("keep")
    return a.join(b, key, "full").groupBy(F.coalesce("l", keep).alias("left"), F.coalesce("r", keep).alias("right")).agg(F.count("*").alias("n"))


def edit_distance_columns(pairs: DataFrame, a: str, b: str, distance: Callable[[Node, Node], float], name: str = "distance") -> DataFrame:
    """Adds a distance of two packed trees."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([distance(unpack(p), unpack(q)) if p is not None and q is not None else None for p, q in zip(x, y, strict=True)], dtype="float64")

    return pairs.withColumn(name, run(a, b))


def trees_of(rows: Iterable[tuple[object, Node]]) -> list[tuple]:
    from .trees import pack

    return [(k, [tuple(x.values()) for x in pack(n)]) for k, n in rows]


SOLUTIONS = f"solution string, tree {TREE}"


# --- what mappings and edits say ---


def value_mapping(a: Node, m: Mapping) -> dict[str, str]:
    """Names of a to names of its partner: equal names first, the rest so that as many paired nodes as can be agree."""
    seen: dict[tuple[str, str], int] = defaultdict(int)
    for n in a.walk():
        p = m.to.get(id(n))
        if p is not None and n.value is not None and p.value is not None:
            seen[(n.value, p.value)] += 1
    left, right = sorted({x for x, _ in seen}), sorted({y for _, y in seen})
    out = {x: x for x in left if x in right}
    left, right = [x for x in left if x not in out], [y for y in right if y not in out]
    if left and right:
        pairs = hungarian(-np.array([[float(seen.get((x, y), 0)) for y in right] for x in left]))
        out |= {x: right[j] for x, j in zip(left, pairs, strict=True) if j >= 0 and seen.get((x, right[j]))}
    return out


def with_replacements(found: list[dict]) -> list[dict]:
    """An insertion and a deletion at one place of one parent become a replacement of the deleted node."""
    gone = {(e["parent"], e["index"]): e for e in found if e["action"] == "delete"}
    out, used = [], set()
    for e in found:
        old = gone.get((e["parent"], e["index"])) if e["action"] == "insert" else None
        if old is not None and old["node"] not in used:
            used.add(old["node"])
            e = {**e, "action": "replace", "node": old["node"]}
        out.append(e)
    return [e for e in out if not (e["action"] == "delete" and e["node"] in used)]


def closest_match(n: Node, m: Mapping) -> Node | None:
    """The partner of the nearest ancestor of n (n itself first) that has one."""
    return next((m.to[id(x)] for x in n.up() if id(x) in m.to), None)


def nearest_by_text(root: Node, solutions: list[Node]) -> Node | None:
    """The solution whose types in pre-order are nearest by edit distance, the first of equals."""
    own = [n.type for n in root.walk()]
    return min(solutions, key=lambda s: align_cost(own, [n.type for n in s.walk()]), default=None)


def with_priorities(found: list[dict], nodes: list[Node], others: list[list[dict]]) -> list[tuple[dict, float]]:
    """Edits with the share of alignments (each a list of edits) that ask for the same."""
    keys = [{edit_key(e, nodes) for e in edits_} for edits_ in others]
    return [(e, sum(edit_key(e, nodes) in k for k in keys) / len(keys) if keys else 0.0) for e in found]


def by_order(found: list[dict], present: set[str], before: dict[tuple[str, str], float], threshold: float = 0.85) -> list[tuple[dict, int, int]]:
    """Insertions with how many labels that usually come before theirs are missing, and how many that usually come after are there already.

    ``before`` has, of pairs of labels, the share of attempts in which the first comes before the second.
    """
    out = []
    for e in found:
        if e["action"] == "insert":
            own = e["type"]
            missing = sum(1 for (a, b), p in before.items() if b == own and p >= threshold and a not in present)
            late = sum(1 for (a, b), p in before.items() if a == own and p >= threshold and b in present)
            out.append((e, missing, late))
    return sorted(out, key=lambda x: (x[1], -x[2]))


def cost_matrix(requests: DataFrame, traces: DataFrame, names: list[str], cfg: Config = Config()) -> DataFrame:  # noqa: B008
    """A row for each request (query, tree) and a column for each of a bounded list of solutions (solution, tree): what aligning them costs."""
    known = traces.where(F.col("solution").isin(names))
    rows = nearest(requests, known, len(names), cfg=cfg)
    return rows.groupBy("query").pivot("solution", names).agg(F.first("cost"))
