"""Trees as columns.

A packed tree is an array of nodes in pre-order: struct(type, value, ext_id, parent, idx, order_group, any_children), parent being the
position in the array (-1 of the root). It goes through one Arrow call as a whole. The node table has a row for each node with its path from
the root and its interval (pre, post), so ancestors are a range predicate and paths are arrays.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREE = "array<struct<type:string,value:string,ext_id:string,parent:int,idx:int,order_group:int,any_children:boolean>>"
# Names of a block language.
#: Two-argument operators whose arguments may be swapped, and those that are written as another with swapped arguments.
SYMMETRIC = {"reportSum", "reportProduct", "reportRandom", "reportEquals", "reportAnd", "reportOr"}
OPPOSITE = {"reportGreaterThan": "reportLessThan"}
#: A stored document of exactly this length was cut off.
CUT_LENGTH = 65000


@dataclass(eq=False)
class Node:
    type: str
    value: str | None = None
    ext_id: str | None = None
    children: list[Node] = field(default_factory=list)
    parent: Node | None = None
    order_group: int = 0
    any_children: bool = False
    hint: str | None = None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += n.children[::-1]

    def up(self) -> Iterator[Node]:
        n: Node | None = self
        while n is not None:
            yield n
            n = n.parent

    @property
    def index(self) -> int:
        return next(i for i, c in enumerate(self.parent.children) if c is self) if self.parent else 0

    @property
    def size(self) -> int:
        return sum(1 for _ in self.walk())

    @property
    def path(self) -> list[str]:
        return [n.type for n in self.up()][::-1]

    @property
    def types(self) -> list[str]:
        return [c.type for c in self.children]

    def text(self) -> str:
        """type=value:[children], written without recursion, so a tree may be of any depth."""
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
                continue
            out.append(n.type if n.value is None else f"{n.type}={n.value}")
            if n.children:
                out.append(":[")
                todo.append("]")
                todo += [x for c in reversed(n.children) for x in (c, ", ")][:-1]
        return "".join(out)

    def copy(self) -> Node:
        made: dict[int, Node] = {}
        for n in self.walk():
            made[id(n)] = Node(n.type, n.value, n.ext_id, order_group=n.order_group, any_children=n.any_children, hint=n.hint)
            if n is not self:
                made[id(n.parent)].add(made[id(n)])
        return made[id(self)]


# --- conversions ---


def pack(root: Node | None) -> list[dict] | None:
    if root is None:
        return None
    at: dict[int, int] = {}
    out = []
    for n in root.walk():
        at[id(n)] = len(out)
        out.append({"type": n.type, "value": n.value, "ext_id": n.ext_id, "parent": at[id(n.parent)] if n is not root else -1, "idx": n.index if n is not root else 0, "order_group": n.order_group, "any_children": n.any_children})
    return out


def unpack(rows) -> Node | None:
    if rows is None or not len(rows):
        return None
    nodes = [Node(r["type"], r["value"], r["ext_id"], order_group=r["order_group"] or 0, any_children=bool(r["any_children"])) for r in rows]
    for n, r in zip(nodes, rows, strict=True):
        if r["parent"] >= 0:
            nodes[r["parent"]].add(n)
    return nodes[0]


def from_json(text: str | None) -> Node | None:
    """{type, value?, id?, children?}; null if it isn't that."""
    try:
        top = json.loads(text or "null")
    except (ValueError, RecursionError):
        return None

    try:
        if not top:
            return None
        root = shell(top)
        todo = [(root, top)]
        while todo:
            n, x = todo.pop()
            for c in x.get("children") or []:
                kid = n.add(shell(c) if c is not None else Node("null"))
                if c is not None:
                    todo.append((kid, c))
        return root
    except (TypeError, KeyError, AttributeError):
        return None


def shell(x: dict) -> Node:
    """A node of {type, value?, id?} without its children."""
    return Node(str(x["type"]), None if x.get("value") is None else str(x["value"]), None if x.get("id") is None else str(x["id"]))


def to_json(root: Node) -> str:
    made: dict[int, dict] = {}
    for n in reversed(list(root.walk())):  # children before their parents
        made[id(n)] = {k: v for k, v in (("type", n.type), ("value", n.value), ("id", n.ext_id), ("children", [made.pop(id(c)) for c in n.children])) if v not in (None, [])}
    return json.dumps(made[id(root)], ensure_ascii=False)


#: Tags of a project's file that are read; containers among them have no node type of their own.
TAGS = {"project", "stage", "sprites", "sprite", "scripts", "script", "block", "custom-block", "block-definition", "blocks", "inputs", "input", "header", "code", "l", "color", "list", "item", "ref", "option", "bool"}
SKIPPED = {"watcher", "comment", "autolambda", "variables", "receiver"}


def from_xml(text: str | None, known: set[str] | None = None) -> Node | None:
    """A project's XML as a tree; null if it is empty, cut off or broken.

    Elements are nodes named by their type attribute ``s`` or their tag; texts are values; a ``ref`` stands for the element with its id. Where
    ``known`` tags are given (as TAGS), another tag is an error, and so is a ref to nothing that isn't the input of a block.
    """
    if not text or len(text) == CUT_LENGTH:
        return None
    try:
        top = ET.fromstring(text.replace("\r", "").replace("\n", ""))
    except ET.ParseError:
        return None
    by_id = {e.get("id"): e for e in top.iter() if e.get("id") and e.tag != "ref"}

    def make(e: ET.Element, open_: frozenset, within: str = "") -> Node | None:
        if e.tag in SKIPPED:
            return None
        if e.tag == "ref":
            target = by_id.get(e.get("id") or e.get("mediaID"))
            if target is None and known is not None and within not in ("block", "custom-block"):
                raise ValueError(f"nothing has the id of a ref within {within}")
            return make(target, open_ | {e.get("id")}) if target is not None and target is not e and e.get("id") not in open_ else None
        if known is not None and e.tag not in known:
            raise ValueError(f"unknown tag {e.tag}")
        if e.tag in ("l", "color"):
            n = Node("literal" if e.tag == "l" else "color", (e.text or "").strip() or None, e.get("id"))
        else:
            n = Node(e.get("s") or e.tag, e.get("var") or e.get("name"), e.get("guid") or e.get("id"))
        for c in e:
            got = make(c, open_, e.tag)
            if got is not None:
                n.add(got)
        return n

    return make(top, frozenset())


class _Html(HTMLParser):
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("document")

    #: A tag that ends what is open of these tags, as their end tags may be left out.
    ENDS = {"p": {"p"}, "li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
    #: Tags within which another list or table begins.
    BARRIERS = {"ul", "ol", "table", "dl", "select", "document"}

    def handle_starttag(self, tag, attrs):
        while self.at.type in self.ENDS.get(tag, ()) and self.at.type not in self.BARRIERS:
            self.at = self.at.parent
        n = self.at.add(Node(tag, None, dict(attrs).get("id")))
        if tag not in self.VOID:
            self.at = n

    def handle_endtag(self, tag):
        n = next((x for x in self.at.up() if x.type == tag and x.parent), None)
        if n is not None:
            self.at = n.parent


def from_html(text: str | None) -> Node | None:
    """The element tree of a web page; end tags close what is open, strays are passed over."""
    if text is None:
        return None
    p = _Html()
    p.feed(text)
    p.close()
    return p.root


PARSERS: dict[str, Callable[[str | None], Node | None]] = {"json": from_json, "xml": from_xml, "html": from_html}


def packed(text: Column, kind: str) -> Column:
    """The packed tree of a text column of JSON, XML or HTML; null where there is none."""

    @F.pandas_udf(TREE)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([pack(PARSERS[kind](t)) for t in texts])

    return run(text)


def node_table(df: DataFrame, tree: str = "tree", keys: list[str] | None = None) -> DataFrame:
    """A row for each node: keys, node (pre-order), parent, idx, type, value, ext_id, depth, post, tree_size, path, types, order_group, any_children, places (among siblings, from below the root)."""
    keys = keys if keys is not None else [c for c in df.columns if c != tree]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for row in rows.itertuples(index=False):
                nodes = getattr(row, "tree__")
                if nodes is None or not len(nodes):
                    continue
                own = tuple(getattr(row, k) for k in keys)
                n = len(nodes)
                size, kids = [1] * n, [[] for _ in range(n)]
                depth, path, places = [0] * n, [None] * n, [None] * n
                for i, x in enumerate(nodes):
                    p = x["parent"]
                    path[i] = [*path[p], x["type"]] if p >= 0 else [x["type"]]
                    places[i] = [*places[p], x["idx"]] if p >= 0 else []
                    depth[i] = depth[p] + 1 if p >= 0 else 0
                    if p >= 0:
                        kids[p].append(x["type"])
                for i in range(n - 1, 0, -1):
                    size[nodes[i]["parent"]] += size[i]
                out += [(*own, i, x["parent"], x["idx"], x["type"], x["value"], x["ext_id"], depth[i], i + size[i] - 1, size[i], path[i], kids[i], x["order_group"], x["any_children"], places[i]) for i, x in enumerate(nodes)]
            yield pd.DataFrame(out, columns=[*keys, "node", "parent", "idx", "type", "value", "ext_id", "depth", "post", "tree_size", "path", "types", "order_group", "any_children", "places"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, node int, parent int, idx int, type string, value string, ext_id string, depth int, post int, tree_size int, path array<string>, types array<string>, order_group int, any_children boolean, places array<int>"
    return df.select(*keys, F.col(tree).alias("tree__")).mapInPandas(run, schema)


def repacked(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The packed trees of a node table."""
    cell = F.struct("node", "type", "value", "ext_id", "parent", "idx", "order_group", "any_children")
    rows = nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("tree"))
    return rows.withColumn("tree", F.transform("tree", lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"), x["ext_id"].alias("ext_id"), x["parent"].alias("parent"), x["idx"].alias("idx"), x["order_group"].alias("order_group"), x["any_children"].alias("any_children"))))


# --- columns of the node table ---


def root_path(n: int | None = None) -> Column:
    path = F.col("path") if n is None else F.slice("path", F.greatest(F.size("path") - n + 1, F.lit(1)), F.lit(n))
    return F.array_join(path, "->")


def backbone(pattern: list[str], path: str = "path") -> Column:
    """Whether the end of a node's path fits: a type, alternatives ``a|b``, or ``...`` between two of them.

    The path is matched upwards from the node, and ``...`` climbs to the nearest node that fits what stands before it, without
    trying farther ones; a leading ``...`` accepts every ancestor. The pattern is a regular expression over the joined path, matched JVM-side:
    the gap is a run of nodes none of which fits what stands before the gap.
    """
    one = lambda p: "(?:" + "|".join(re.escape(x) for x in p.split("|")) + ")/"
    parts = [p for k, p in enumerate(pattern) if p != "..." or k == 0 or pattern[k - 1] != "..."]
    rx = "".join((rf"(?:(?!{one(parts[k - 1])})[^/]+/)*" if k else "") if p == "..." else one(p) for k, p in enumerate(parts))
    return F.concat(F.array_join(path, "/"), F.lit("/")).rlike(r"(?:^|/)" + rx + "$")


def descendants(a: DataFrame, d: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``d`` that lie under a row of ``a`` in the same tree, each once: the intervals of ancestors are joined by tree."""
    spans = a.select(*keys, F.col("node").alias("__lo"), F.col("post").alias("__hi"))
    return d.join(spans, [*keys] if keys else None, "left_semi") if not keys else d.alias("d").join(spans.alias("a"), [F.col(f"d.{k}") == F.col(f"a.{k}") for k in keys] + [F.col("d.node") > F.col("a.__lo"), F.col("d.node") <= F.col("a.__hi")], "left_semi")


def sibling_rank(keys: list[str]) -> Column:
    """The rank among siblings of the same type, from 0."""
    return F.row_number().over(Window.partitionBy(*keys, "parent", "type").orderBy("idx")) - 1


def stable_id(keys: list[str]) -> Column:
    return F.coalesce("ext_id", F.concat_ws("_", F.lit("GEN"), "type", F.col("parent").cast("string"), sibling_rank(keys).cast("string")))


# --- canonical forms ---


def canonical(root: Node) -> Node:
    """Opposite operators written one way, arguments of symmetric ones in order of their types."""
    for n in list(root.walk()):
        if n.type in OPPOSITE:
            n.type = OPPOSITE[n.type]
            n.children.reverse()
        if n.type in SYMMETRIC and len(n.children) == 2 and n.children[0].type > n.children[1].type:
            n.children.reverse()
    return root


def pruned_leaves(root: Node, types: set[str]) -> Node:
    """Without leaves of these types, from the bottom up."""
    for n in reversed(list(root.walk())):  # children before their parents
        n.children = [c for c in n.children if c.children or c.type not in types or c.value is not None]
    return root


def largest_script(root: Node, parents: set[str], scripts: set[str]) -> Node:
    """Of the scripts under each stage or sprite, only the largest (the first of equals)."""
    for n in list(root.walk()):
        if n.type in parents:
            own = [c for c in n.children if c.type in scripts]
            keep = max(own, key=lambda c: c.size, default=None)
            n.children = [c for c in n.children if c not in own or c is keep]
    return root


def mapped(tree: Column, change: Callable[[Node], Node]) -> Column:
    """A packed tree changed by a function of its root."""

    @F.pandas_udf(TREE)
    def run(trees: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or not len(t) else pack(change(unpack(t))) for t in trees])

    return run(tree)


def canonical_text(tree: Column) -> Column:
    @F.pandas_udf("string")
    def run(trees: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or not len(t) else unpack(t).text() for t in trees])

    return run(tree)


# --- distances ---


def _after_children(root: Node) -> list[Node]:
    """The nodes in post-order."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += n.children
    return out[::-1]


def tree_distance(a: Node, b: Node, insert: float = 1, delete: float = 1, rename: float = 1) -> float:
    """Ordered tree edit distance (Zhang and Shasha 1989)."""

    def order(root: Node):
        nodes = [n for n in _after_children(root)]
        at = {id(n): i for i, n in enumerate(nodes)}
        left = []
        for i, n in enumerate(nodes):
            left.append(left[at[id(n.children[0])]] if n.children else i)
        keys = sorted({x: i for i, x in enumerate(left)}.values())
        return nodes, left, keys

    (x, lx, kx), (y, ly, ky) = order(a), order(b)
    d = [[0.0] * len(y) for _ in x]
    for i in kx:
        for j in ky:
            m, n = i - lx[i] + 2, j - ly[j] + 2
            f = [[0.0] * n for _ in range(m)]
            for p in range(1, m):
                f[p][0] = f[p - 1][0] + delete
            for q in range(1, n):
                f[0][q] = f[0][q - 1] + insert
            for p in range(1, m):
                s = lx[i] + p - 1
                for q in range(1, n):
                    t = ly[j] + q - 1
                    best = min(f[p - 1][q] + delete, f[p][q - 1] + insert)
                    if lx[s] == lx[i] and ly[t] == ly[j]:
                        same = x[s].type == y[t].type and x[s].value == y[t].value
                        f[p][q] = min(best, f[p - 1][q - 1] + (0 if same else rename))
                        d[s][t] = f[p][q]
                    else:
                        f[p][q] = min(best, f[lx[s] - lx[i]][ly[t] - ly[j]] + d[s][t])
    return d[-1][-1]


def reference(n: Node) -> str:
    """Where a node is, as JSON: its label, its place, and its parent in the same way up to the root."""
    out = None
    for x in list(n.up())[::-1]:
        out = {"label": x.type, "index": x.index, "parent": out}
    return json.dumps(out)


def pretty(n: Node, indent: str = "  ") -> str:
    """A line for each node, set in by its depth."""
    out, todo = [], [(n, 0)]
    while todo:
        x, depth = todo.pop()
        out.append(indent * depth + (x.type if x.value is None else f"{x.type}: {x.value}"))
        todo += [(c, depth + 1) for c in reversed(x.children)]
    return "\n".join(out)


def one_step(a: Node, b: Node) -> Node | None:
    """a after one renaming, insertion or deletion of a node that brings it nearer to b by tree distance; null if they are equal.

    A deleted node's children take its place; an inserted one is a leaf or takes over a run of children.
    """
    far = tree_distance(a, b)
    if not far:
        return None
    labels = sorted({(x.type, x.value or "") for x in b.walk()})

    def tries() -> Iterator[Node]:
        for i, n in enumerate(a.walk()):
            for t, v in labels:
                if (t, v) != (n.type, n.value or ""):
                    new = a.copy()
                    x = list(new.walk())[i]
                    x.type, x.value = t, v or None
                    yield new
            if n.parent is not None:
                new = a.copy()
                x = list(new.walk())[i]
                at = x.index
                for c in x.children:
                    c.parent = x.parent
                x.parent.children[at : at + 1] = x.children
                yield new
            for t, v in labels:
                for low in range(len(n.children) + 1):
                    for high in range(low, len(n.children) + 1):
                        new = a.copy()
                        x = list(new.walk())[i]
                        put = Node(t, v or None, parent=x, children=x.children[low:high])
                        for c in put.children:
                            c.parent = put
                        x.children[low:high] = [put]
                        yield new

    return next((t for t in tries() if tree_distance(t, b) < far), None)
