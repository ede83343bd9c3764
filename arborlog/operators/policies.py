"""Policies: what a learner could do next, and where following a policy ends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import alignment
from .trees import Node, pack, unpack

#: From a tree to the trees that may come next, the best first.
Policy = Callable[[Node], list[Node]]


def direct(solutions: list[Node], cfg: alignment.Config = alignment.Config()) -> Policy:  # noqa: B008
    """One edit towards the nearest solution."""

    def steps(root: Node) -> list[Node]:
        if not solutions:
            return []
        best = min(solutions, key=lambda s: (alignment.align(root, s, cfg).cost, s.size))
        found = alignment.edits(root, best, alignment.align(root, best, cfg), cfg)
        seen, out = {root.text()}, []
        for e in sorted(found, key=alignment.priority, reverse=True):
            new = alignment.applied(root, [e])
            if new.text() not in seen:
                seen.add(new.text())
                out.append(new)
        return out

    return steps


def student(history: list[Node]) -> Policy:
    """What the learner did next."""
    after: dict[str, Node] = {}
    for a, b in zip(history, history[1:], strict=False):
        if a.text() != b.text():
            after.setdefault(a.text(), b)
    return lambda root: [after[root.text()].copy()] if root.text() in after else []


def known_steps(steps: dict[str, Node]) -> Policy:
    """The best next state of each known state, by its text."""
    return lambda root: [steps[root.text()].copy()] if root.text() in steps else []


def followed(root: Node, policy: Policy, most: int = 100) -> Iterator[Node]:
    """The trees that come of the policy's first choice, over and over, until it has none, comes back, or has been asked often enough."""
    seen = {root.text()}
    for _ in range(most):
        nxt = policy(root)
        if not nxt or nxt[0].text() in seen:
            return
        root = nxt[0]
        seen.add(root.text())
        yield root


def completed(rows: DataFrame, policy: Policy, key: str, tree: str = "tree", most: int = 100) -> DataFrame:
    """(key, steps, tree): where a policy ends from each tree, and after how many steps."""
    from .trees import TREE

    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b["k"], b["t"], strict=True):
                if t is None or not len(t):
                    continue
                way = [unpack(t), *followed(unpack(t), policy, most)]
                out.append((k, len(way) - 1, pack(way[-1])))
            yield pd.DataFrame(out, columns=[key, "steps", "tree"])

    return rows.select(F.col(key).alias("k"), F.col(tree).alias("t")).mapInPandas(run, f"{key} {kind}, steps int, tree {TREE}")


def policy_scores(paths: DataFrame, tests: dict) -> DataFrame:
    """(test, done, undone, steps) over rows (key, step, and a boolean column for each test): how often a step makes a test pass or fail again."""
    from pyspark.sql import Window

    cells = F.array(*[F.struct(F.lit(k).alias("test"), F.coalesce(c, F.lit(False)).alias("ok")) for k, c in tests.items()])
    each = paths.select("key", "step", F.explode(cells).alias("x")).select("key", "step", "x.test", "x.ok")
    before = F.lag("ok").over(Window.partitionBy("key", "test").orderBy("step"))
    rows = each.withColumn("__b", before).where("__b is not null")
    return rows.groupBy("test").agg(F.count_if(F.col("ok") & ~F.col("__b")).alias("done"), F.count_if(~F.col("ok") & F.col("__b")).alias("undone"), F.count("*").alias("steps"))
