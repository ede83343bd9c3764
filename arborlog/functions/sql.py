"""The library's functions under names that SQL can call: scalar functions and table functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import alignment, mining, trees
from . import sequences


def _align_cost(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else sequences.align_cost(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def _tree_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of two trees as JSON."""
    pairs = [(trees.from_json(x), trees.from_json(y)) for x, y in zip(a, b, strict=True)]
    return pd.Series([trees.tree_distance(x, y) if x is not None and y is not None else None for x, y in pairs], dtype="float64")


class AlignedPairs:
    """Rows (i, j) of two arrays' alignment; -1 where a token has no partner."""

    def eval(self, a: list, b: list) -> Iterator[tuple[int, int]]:
        yield from sequences.align_pairs(a or [], b or [], 2, 2, 3)


class TreeEdits:
    """The edits that turn one JSON tree into another."""

    def eval(self, a: str, b: str) -> Iterator[tuple[str, int, int, str]]:
        x, y = trees.from_json(a), trees.from_json(b)
        if x is not None and y is not None:
            for e in alignment.edits(x, y, alignment.align(x, y)):
                yield e["action"], e["node"], e["parent"], e["type"]


class TreeGrams:
    """The grams of a JSON tree, with how often they come."""

    def eval(self, a: str, p: int, q: int) -> Iterator[tuple[str, int]]:
        x = trees.from_json(a)
        if x is not None:
            yield from ((" ".join(g), n) for g, n in sorted(mining.pq_grams(x, p, q).items()))


def register(spark: SparkSession) -> None:
    for name, f in (("align_cost", _align_cost), ("tree_distance", _tree_distance)):
        spark.udf.register(name, F.pandas_udf(f, "double"))
    for name, table, kind in (("aligned_pairs", AlignedPairs, "i int, j int"), ("tree_edits", TreeEdits, "action string, node int, parent int, type string"), ("tree_grams", TreeGrams, "gram string, n int")):
        spark.udtf.register(name, F.udtf(table, returnType=kind))
