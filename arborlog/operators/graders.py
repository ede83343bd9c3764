"""Graders of programs: conditions on nodes, put together from a few kinds, and tests that a tree passes if some node meets them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trees import Node, unpack

Condition = Callable[[Node], bool]


def kind(*types: str) -> Condition:
    return lambda n: n.type in types


def valued(value: str) -> Condition:
    return lambda n: n.value == value


def child(place: int, what: Condition) -> Condition:
    return lambda n: len(n.children) > place and what(n.children[place])


def children(least: int, most: int | None = None) -> Condition:
    return lambda n: least <= len(n.children) and (most is None or len(n.children) <= most)


def every(*parts: Condition) -> Condition:
    return lambda n: all(p(n) for p in parts)


def some(*parts: Condition) -> Condition:
    return lambda n: any(p(n) for p in parts)


def within(what: Condition) -> Condition:
    """The node or one below it."""
    return lambda n: any(what(x) for x in n.walk())


def place_of(n: Node, what: Condition, start: int = 0) -> int:
    return next((i for i, c in enumerate(n.children[start:], start) if what(c)), -1)


def ahead_of(what: Condition, *limits: Condition) -> Condition:
    """A child that comes before the first child of the first of these limits that there is."""

    def test(n: Node) -> bool:
        at = place_of(n, what)
        stop = next((p for p in (place_of(n, x) for x in limits) if p >= 0), len(n.children))
        return 0 <= at < stop

    return test


def followed_by(what: Condition, then: Condition) -> Condition:
    """The first child of one kind has, somewhere behind it, a child of the other."""

    def test(n: Node) -> bool:
        at = place_of(n, what)
        return at >= 0 and place_of(n, then, at + 1) >= 0

    return test


def under(*pattern: str) -> Condition:
    """Whether a node's path fits, as trees.backbone."""

    def test(n: Node) -> bool:
        at: Node | None = n
        for k in range(len(pattern) - 1, -1, -1):
            if pattern[k] == "...":
                if k == 0:
                    return True
                while at is not None and at.type not in pattern[k - 1].split("|"):
                    at = at.parent
            elif at is None or at.type not in pattern[k].split("|"):
                return False
            else:
                at = at.parent
        return True

    return test


# Names of a block language's blocks, as the tests of its exercises use them.
SCRIPT = under("sprite|customBlock", "script")
GREETS = every(kind("doSayFor", "bubble"), child(0, kind("literal")))
ASKS = kind("doAsk")
LOOPS = (kind("doUntil"), kind("doForever"))
OPERAND = kind("var", "getLastAnswer")
COMPARES = every(kind("reportEquals"), children(2, 2), child(0, OPERAND), child(1, OPERAND))
CHECKS_AND_STOPS = every(kind("doIf", "doIfElse"), within(COMPARES), within(kind("doStopThis")))
GUESSING = {
    "welcome": every(SCRIPT, children(3), ahead_of(GREETS, ASKS)),
    "ask name": every(SCRIPT, ahead_of(ASKS, *LOOPS)),
    "random number": every(SCRIPT, ahead_of(every(kind("doSetVar"), child(1, kind("reportRandom"))), *LOOPS)),
    "until guessed": some(every(under("sprite|customBlock", "...", "script", "doUntil", "reportEquals"), COMPARES), every(under("sprite|customBlock", "...", "script", "doForever", "script"), within(CHECKS_AND_STOPS))),
}
POLYGON = {
    "asks for sides": every(under("sprite", "script"), followed_by(ASKS, every(kind("doRepeat"), child(0, kind("getLastAnswer"))))),
    "draws": every(kind("script"), some(followed_by(kind("down"), kind("forward")), followed_by(kind("down"), within(kind("forward"))))),
    "moves and turns": every(under("sprite|customBlock", "script", "...", "doRepeat"), child(0, kind("getLastAnswer", "literal")), child(1, every(children(2), lambda n: place_of(n, kind("forward")) >= 0, lambda n: place_of(n, kind("turn", "turnLeft")) >= 0))),
    "turns by the angle": every(kind("turn", "turnLeft"), children(1, 1), child(0, every(kind("reportQuotient"), children(2, 2), child(0, valued("360")), child(1, kind("getLastAnswer"))))),
}


def passes(root: Node, test: Condition) -> bool:
    return any(test(n) for n in root.walk())


def grades(tree: Column, tests: dict[str, Condition]) -> Column:
    """Which tests a packed tree passes, as a map; null for no tree."""

    @F.pandas_udf("map<string,boolean>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or not len(t) else (lambda n: {k: passes(n, f) for k, f in tests.items()})(unpack(t)) for t in rows])

    return run(tree)


def majority(nodes: DataFrame, key: str, types: Sequence[str]) -> DataFrame:
    """(type, trees, most): of these types, in how many trees they are, and whether in more than half."""
    n = nodes.agg(F.count_distinct(key).alias("__n"))
    found = nodes.where(F.col("type").isin(list(types))).groupBy("type").agg(F.count_distinct(key).alias("trees"))
    return found.join(F.broadcast(n)).select("type", "trees", (F.col("trees") * 2 > F.col("__n")).alias("most"))
