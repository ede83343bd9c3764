"""Nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised apart, each to one of ``k`` centroids; the pair is the vector's cell, so 2k
centroids make k * k cells. A query orders the centroids of each half by their inner product with its own half and takes
pairs from a heap, best sum first, until the cells hold as many vectors as the index was calibrated for; what lies in them is
reranked by exact inner products.

Equal vectors are indexed once, with as many of their least ids as a result can hold, so a vector that a third of the rows
share is one entry. The centroids and the share of vectors to visit are found on a sample of ``SAMPLE`` vectors (the
latter so that the sample's own queries reach a recall of ``RECALL``); every vector is indexed. Queries go to the vectors in blocks
of ``BLOCK``, with a bit for each cell they visit.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

K_NEAREST = 20
SAMPLE = 20_000
RECALL = 0.97
BLOCK = 4096
#: Vectors that a scan holds before it lets go of those that are no query's best.
HELD = 65_536
SALTS = 16


def usable(vec: Column) -> Column:
    """Not null, not all zero, without null or non-finite components."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = closest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c**2).sum(axis=1)[None] - 2 * (x @ c.T), axis=1)


class Codebook:
    def __init__(self, x: np.ndarray, k: int):
        self.half = (x.shape[1] + 1) // 2  # of one dimension, the second half is empty and has one cell
        self.k = k
        self.parts = [kmeans(p, k, seed=s) for s, p in enumerate(self.halves(x))]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (closest(p, c) for p, c in zip(self.halves(x), self.parts, strict=True))
        return a * self.k + b

    def distances(self, q: np.ndarray) -> list[np.ndarray]:
        """Of each half of the queries to the centroids: less is nearer in inner product."""
        return [-(p @ c.T) for p, c in zip(self.halves(q), self.parts, strict=True)]

    def traverse(self, d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, want: int) -> list[int]:
        """Cells in the order of summed distances, from a heap, until they hold ``want`` vectors."""
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        s1, s2, c1, c2 = d1[o1].tolist(), d2[o2].tolist(), o1.tolist(), o2.tolist()
        heap, out, held, k = [(s1[0] + s2[0], 0, 0)], [], 0, self.k
        reach = [0] * k  # of each first centroid: pairs pushed so far
        reach[0] = 1
        while heap and held < want:
            _, i, j = heapq.heappop(heap)
            cell = c1[i] * k + c2[j]
            if counts[cell]:
                out.append(cell)
                held += int(counts[cell])
            if j + 1 < k:
                heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
            if j == 0 and i + 1 < k:
                heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
        return out


def share_to_visit(book: Codebook, x: np.ndarray, nearest: int = K_NEAREST, recall: float = RECALL) -> float:
    """The least share of the sample's vectors by which its queries find ``recall`` of their neighbours."""
    q = x[:: max(1, len(x) // 200)]
    dot = q @ x.T
    top = np.argsort(-dot, axis=1)[:, 1 : nearest + 1]
    cells = book.cells(x)
    d1, d2 = book.distances(q)
    order = d1[:, cells // book.k] + d2[:, cells % book.k]
    rank = np.argsort(np.argsort(order, axis=1, kind="stable"), axis=1)
    found = np.take_along_axis(rank, top, axis=1).ravel()
    return min(1.0, (float(np.quantile(found, recall)) + 1) / len(x))


def _vectors(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


class Best:
    """The best candidates of each query so far."""

    def __init__(self, n_queries: int, keep: int):
        self.keep = keep
        self.least = np.full(n_queries, -np.inf)
        self.q, self.v, self.s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, queries: np.ndarray, vectors: np.ndarray, scores: np.ndarray) -> None:
        i, j = np.nonzero(scores >= self.least[queries][:, None] - 1e-9)
        self.new.append((queries[i], vectors[j], scores[i, j]))
        self.size += len(i)
        if self.size > 2_000_000:
            self.shrink()

    def shrink(self) -> None:
        q, v, s = (np.concatenate(x) for x in zip((self.q, self.v, self.s), *self.new, strict=True))
        order = np.lexsort((-s, q))
        q, v, s = q[order], v[order], s[order]
        first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
        place = np.arange(len(q)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(q) else np.zeros(0, np.int64)
        last = place == self.keep - 1
        self.least[q[last]] = s[last]
        keep = s >= self.least[q] - 1e-9  # ties and what rounding may have put behind stay
        self.q, self.v, self.s, self.new, self.size = q[keep], v[keep], s[keep], [], 0

    def used(self) -> np.ndarray:
        """Which vectors are still among the best; they are numbered anew in this order."""
        self.shrink()
        at, self.v = np.unique(self.v, return_inverse=True)
        return at


def search(
    rows: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    nearest: int = K_NEAREST,
    centroids: int | None = None,
    visit: float | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each query row, by greatest inner product, ties to the lesser id.

    A row is no candidate of its own; where fewer candidates there are, all are given. Rows without an id, with a vector that
    is null, zero or not finite, or of another length than most, take no part. Repeated ids count as one row, with the
    vector of least hash. No usable rows give no results. ``visit`` is the share of the vectors that a query reads.
    """
    spark = rows.sparkSession
    keep = nearest + 1
    base = rows.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), is_query.alias("asks"))
    sizes = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], out_schema)
    dim = sizes.n
    base = base.where(F.size("v") == dim).withColumn("key", F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.reverse("v"), F.lit(1)))))
    base = saved(base.groupBy("id").agg(F.min(F.struct("key", "v", "asks")).alias("r")).select("id", "r.key", "r.v", "r.asks"))
    ranked = base.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("n") <= keep)
    entries = saved(ranked.groupBy("key").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids")))
    n = entries.count()
    drawn = entries.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").toArrow()
    x = _vectors(drawn.column(0).combine_chunks(), dim)
    k = centroids or int(min(256, max(2, 2 ** round(math.log2(max(4.0, n / 48)) / 2))))
    book = Codebook(x, k)
    share = visit or share_to_visit(book, x, nearest)
    sent = spark.sparkContext.broadcast(book)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = sent.value.cells(_vectors(b.column(1), dim)) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.astype(np.int32))], names=["key", "v", "ids", "cell"])

    vec_kind = entries.schema["v"].dataType.simpleString()
    indexed = entries.select("key", "v", "ids").mapInArrow(assign, f"key string, v {vec_kind}, ids array<long>, cell int")
    indexed = saved(indexed.repartitionByRange("cell", "key"))
    counts = np.zeros(k * k, np.int64)
    for r in indexed.groupBy("cell").count().collect():  # at most k * k rows
        counts[r.cell] = r["count"]
    want = max(keep, math.ceil(share * n))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d1, d2 = sent.value.distances(_vectors(b.column(1), dim)) if b.num_rows else ([], [])
            bits = []
            for p, q in zip(d1, d2, strict=True):
                seen = np.zeros(k * k, bool)
                seen[sent.value.traverse(p, q, counts, want)] = True
                bits.append(np.packbits(seen).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bits, pa.binary())], names=["key", "v", "cells"])

    asking = base.where("asks").groupBy("key").agg(F.first("v").alias("v"))
    asking = saved(asking.mapInArrow(route, f"key string, v {vec_kind}, cells binary"))
    blocks = max(1, math.ceil(asking.count() / BLOCK))
    found = None
    for b in range(blocks):
        part = asking.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).toArrow()
        if not part.num_rows:
            continue
        queries = spark.sparkContext.broadcast((part.column(0).to_pylist(), _vectors(part.column(1).combine_chunks(), dim), np.array([np.frombuffer(c, np.uint8) for c in part.column(2).to_pylist()])))

        def scan(batches: Iterator[pa.RecordBatch], queries=queries) -> Iterator[pa.RecordBatch]:
            keys, q, cells = queries.value
            best, ids, kept, base_at = Best(len(keys), keep), [], [], 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                v, cell = _vectors(batch.column(1), dim), batch.column(3).to_numpy()
                ids += batch.column(2).to_pylist()
                kept.append(v)
                order = np.argsort(cell, kind="stable")
                for run in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                    c = int(cell[run[0]])
                    asks = np.flatnonzero(cells[:, c >> 3] & (128 >> (c & 7)))
                    if len(asks):
                        best.add(asks, run + base_at, q[asks] @ v[run].T)
                base_at += len(v)
                if base_at >= HELD:
                    at = best.used()
                    kept, ids, base_at = [np.concatenate(kept)[at]], [ids[i] for i in at.tolist()], len(at)
            best.shrink()
            if not len(best.q):
                return
            v = np.concatenate(kept)
            rows = [(keys[i], j, math.fsum((q[i] * v[at]).tolist())) for i, at in zip(best.q.tolist(), best.v.tolist(), strict=True) for j in ids[at]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows])], names=["key", "vec_id", "score"])

        one = indexed.mapInArrow(scan, "key string, vec_id long, score double")
        one = one.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= keep)
        one = saved(one.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("hits")))
        queries.unpersist()
        found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], out_schema)
    salted = found.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    ask = base.where("asks").select("id", "key", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    hits = ask.join(salted, ["key", "salt"]).select("id", F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("id")), 1, nearest).alias("hits"))
    return hits.select(F.col("id").alias("query_id"), F.posexplode("hits").alias("p", "h")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("h.vec_id"), (-F.col("h.s")).alias("score"))
