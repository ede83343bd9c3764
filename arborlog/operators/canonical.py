"""Canonical and sanitised trees: orders, names, literals and ids that don't depend on who wrote a program."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import upper_median_of
from .trees import Node

#: Parts of a name that stand for an input, and what they are written as.
INPUT = re.compile(r"%'([^']*)'")


def filled_ids(root: Node, prefix: str = "GEN") -> Node:
    """Nodes without an id get one by a counter over the pre-order."""
    for k, n in enumerate(x for x in root.walk() if x.ext_id is None):
        n.ext_id = f"{prefix}_{k}"
    return root


def dynamic_ids(root: Node) -> Node:
    """All ids anew, in pre-order."""
    for k, n in enumerate(root.walk()):
        n.ext_id = f"ID{k}"
    return root


def ordered_scripts(root: Node, parents: set[str], scripts: set[str]) -> list[tuple[Node, list[int]]]:
    """Puts the scripts of each stage or sprite in order, the largest first, then by id; gives for each changed parent where its children stood."""
    out = []
    for n in root.walk():
        if n.type in parents:
            at = [i for i, c in enumerate(n.children) if c.type in scripts]
            want = sorted(at, key=lambda i: (-n.children[i].size, n.children[i].ext_id or ""))
            order = list(range(len(n.children)))
            for slot, i in zip(at, want, strict=True):
                order[slot] = i
            if order != sorted(order):
                n.children = [n.children[i] for i in order]
                out.append((n, order))
    return out


def reorder_vector(order: list[int], offset: int = 0) -> list[int]:
    """For each old place (behind ``offset`` leading children) its new one."""
    new = [0] * len(order)
    for place, old in enumerate(order):
        new[old] = place
    return [offset + x for x in new]


def selector(name: Column) -> Column:
    """The name of a block of the user's own with its inputs as %s."""
    return F.regexp_replace(name, INPUT.pattern, "%s")


def inputs(name: Column) -> Column:
    """The names of its inputs."""
    return F.regexp_extract_all(name, F.lit(INPUT.pattern), 1)


def called_blocks(calls: DataFrame, imported: DataFrame, name: str = "name") -> DataFrame:
    """(..., type, value): calls of imported tools are a type of their own, others one common type with the selector as value."""
    known = F.broadcast(imported.select(selector(F.col(name)).alias("__s")).distinct().withColumn("__known", F.lit(True)))
    rows = calls.withColumn("__s", selector(F.col(name))).join(known, "__s", "left")
    return rows.withColumns({"type": F.when(F.col("__known"), F.col("__s")).otherwise("evaluateCustomBlock"), "value": F.when(F.col("__known").isNull(), F.col("__s"))}).drop("__s", "__known")


def with_edits(stored: DataFrame, edits: DataFrame, key: str, place: str, columns: list[str]) -> DataFrame:
    """Stored definitions, each replaced by its edited version: the one with its key, else the one at its place without a key."""
    by_key = edits.where(F.col(key).isNotNull()).select(key, *[F.col(c).alias(f"__k_{c}") for c in columns], F.lit(True).alias("__k"))
    by_place = edits.where(F.col(key).isNull()).select(place, *[F.col(c).alias(f"__p_{c}") for c in columns], F.lit(True).alias("__p"))
    rows = stored.join(by_key, key, "left").join(by_place, place, "left")
    new = [F.when(F.col("__k"), F.col(f"__k_{c}")).when(F.col("__p"), F.col(f"__p_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    return rows.select(key, place, *new, (F.coalesce("__k", F.lit(False)) | F.coalesce("__p", F.lit(False))).alias("edited"))


def literal_kind(parent: Column, place: Column, variables: dict[str, int], options: dict[str, int]) -> Column:
    """What a literal is by where it stands: a variable's name, a choice of a menu, or text."""
    at = lambda kinds: F.coalesce(*[F.when(parent == p, place == i) for p, i in kinds.items()], F.lit(False))
    return F.when(at(variables), "varMenu").when(at(options), "option").otherwise("literal")


def sanitised(value: Column, kind: Column, names: dict[str, str] | None = None) -> Column:
    """Values without personal text: of literals only numbers stay, names go through a dictionary."""
    number = F.when(value.try_cast("double").isNotNull(), value)
    other = F.create_map(*[F.lit(x) for kv in (names or {"": ""}).items() for x in kv])[value]
    return F.when(kind == "literal", number).otherwise(F.coalesce(other, value))


def placeholders_emptied(root: Node, placeholder: str = "~") -> Node:
    """String nodes whose value is the placeholder become EMPTY."""
    for n in root.walk():
        if n.type == "Str" and n.value == placeholder:
            n.type, n.value = "EMPTY", None
    return root


def normalised(root: Node, sort: bool = False) -> Node:
    """Without values; on wish children stand in the order of their canonical texts."""
    for n in reversed(list(root.walk())):
        n.value = None
        if sort:
            n.children.sort(key=Node.text)
    return root


def side_scripts_dropped(scripts: DataFrame, tree: str, path: str, size: str) -> DataFrame:
    """The scripts (a row each) of solutions without the side scripts: for each path the upper median m of how many scripts solutions have there; of a solution with more, those smaller than its m-th largest go."""
    n = scripts.groupBy(tree, path).agg(F.count("*").alias("__here"))
    every = scripts.select(tree).distinct().join(scripts.select(path).distinct()).join(n, [tree, path], "left").select(tree, path, F.coalesce("__here", F.lit(0)).alias("__here"))
    m = upper_median_of(every, [path], "__here").withColumnRenamed("median", "__m")
    w = Window.partitionBy(tree, path)
    rows = scripts.withColumns({"__all": F.count("*").over(w), "__rank": F.row_number().over(w.orderBy(F.desc(size)))}).join(F.broadcast(m), path)
    least = F.max(F.when(F.col("__rank") == F.col("__m"), F.col(size))).over(w)
    rows = rows.withColumn("__least", least)
    return rows.where((F.col("__all") <= F.col("__m")) | F.coalesce(F.col(size) >= F.col("__least"), F.lit(False))).select(*scripts.columns)


def renamed_calls(calls: Iterable[str], defined: Iterable[str]) -> dict[str, str]:
    """For each call whose name isn't defined, the one defined name that contains it or is contained in it, if there is just one."""
    known = sorted(set(defined))
    out = {}
    for c in sorted(set(calls) - set(known)):
        near = [d for d in known if c and d and (c in d or d in c)]
        if len(near) == 1:
            out[c] = near[0]
    return out


def renamed_call_rows(calls: DataFrame, defined: DataFrame, key: str) -> DataFrame:
    """(key, call, name) of the same within each project (key), whose calls and definitions are few."""
    groups = calls.groupBy(key).agg(F.collect_set("call").alias("c")).join(defined.groupBy(key).agg(F.collect_set("name").alias("d")), key)

    @F.pandas_udf("array<struct<call:string,name:string>>")
    def run(c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([[{"call": k, "name": v} for k, v in sorted(renamed_calls(x, y).items())] for x, y in zip(c, d, strict=True)])

    return groups.select(key, F.explode(run("c", "d")).alias("x")).select(key, "x.*")
