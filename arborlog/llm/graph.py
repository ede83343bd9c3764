"""Connected components of links between integer ids, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Rows of a lookup table that are sent to every executor at most (16 bytes each); beyond, the join is salted.
BROADCAST_ROWS = 1_000_000
SALTS = 16
#: Links that a task works on at least, on average: few links make few tasks and files, whatever the number of shuffle partitions.
TASK_LINKS = 50_000


def lookup(rows: DataFrame, key: str, table: DataFrame, value: str, n_table: int) -> DataFrame:
    """``rows`` with ``value`` of ``table`` for its ``key`` (null where it has none); a hot key is dealt out by salt."""
    if n_table <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, "left")
    salt = "__salt"
    many = table.withColumn(salt, F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    other = next(c for c in rows.columns if c != key)
    return rows.withColumn(salt, F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).join(many, [key, salt], "left").drop(salt)


def salted(rows: DataFrame, table: DataFrame, keys: list[str], by: str, n_table: int) -> DataFrame:
    """``rows`` left-joined with ``table`` on ``keys``: by broadcast where it has few rows, else rows of one key are dealt out by their ``by``."""
    if n_table <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys, "left")
    salt = "__salt"
    many = table.withColumn(salt, F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(many, [*keys, salt], "left").drop(salt)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each id with a link to another, the least id that it reaches.

    Alternates the large-star and small-star operations (Kiveris et al. 2014) until the links no longer change.
    Least neighbours are partial aggregates, so a hub doesn't gather its neighbours in one task. Each round has tasks
    in number with the links that are left, and no more than there are partitions. Links with a null end or to itself mean nothing.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    edges = saved(edges)
    state = None
    while True:
        n, mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, mark) == state or not n:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = (n, mark)
        tasks = n // TASK_LINKS + 1
        edges = edges.coalesce(tasks)
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        low = both.groupBy("u").agg(F.min("v").alias("m")).where("m < u").coalesce(tasks)
        # large star: every greater neighbour of u goes to the least of u and its neighbours
        up = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))
        large = lookup(up, "u", low, "m", n).select(F.col("w").alias("u"), F.coalesce("m", "u").alias("v")).distinct()
        large = saved(large.coalesce(tasks))
        # small star: u and its lesser neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = lookup(large, "u", low, "m", n)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct()
        edges = saved(small.coalesce(tasks))
