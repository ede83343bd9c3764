"""Super-k-mers: how equal windows of all documents meet in one place.

Every window of a document (so many consecutive words, or bytes) has a minimiser, the least hash of its
k-grams; equal windows have equal minimisers. Consecutive windows that share one travel as one packed string to the
bucket of the minimiser, so a window costs little more than one symbol, and windows are compared by their contents there.

A run of documents is packed at a time: strings that are equal within it travel once, so a passage that a third of all
documents share reaches its bucket once for each run and not once for each document. Buckets grow in number, not in
size, with the input.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

#: Characters of text packed at a time, and those that a bucket gets.
PACK_CHARS = 12_000_000
BUCKET_CHARS = 3_000_000
#: Buckets of a partition, and partitions at most; beyond, partitions get more buckets, which are read one after the other.
BUCKETS_EACH, MOST_PARTS = 4, 20_000
#: Windows in a string at most: a text that repeats itself has one minimiser for long.
MAX_RUN = 512
MARKS = "doc_id long, mark long, start int, stop int"
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k values in a row, by doubling."""
    if len(x) < k:
        return np.zeros(0, np.uint64)
    out, done, h, size, step = None, 0, x, 1, np.uint64(0xD6E8FEB86659FD93)
    while True:
        if k & size:
            if out is None:
                out = h
            else:
                n = min(len(out), len(h) - done)
                with np.errstate(over="ignore"):
                    out = out[:n] * step + h[done : done + n]
            done += size
        if done == k:
            return mixed(out[: len(x) - k + 1])
        with np.errstate(over="ignore"):
            h = h[:-size] * step + h[size:]
            step = step * step + np.uint64(2)
        size *= 2


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    size = 1
    while size * 2 <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[:n], h[w - size : w - size + n])


def runs(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, number of windows) of the stretches with one minimiser."""
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    n = np.diff(np.append(first, len(low)))
    if len(n) and n.max() > MAX_RUN:
        cut = -(-n // MAX_RUN)
        at = np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut)
        first, left = np.repeat(first, cut) + at * MAX_RUN, np.repeat(n, cut) - at * MAX_RUN
        n = np.minimum(left, MAX_RUN)
    return first, n


class Packed:
    """Strings of one bucket from one run of documents, in the order of doc_id."""

    def __init__(self, h: np.ndarray, doc_id: np.ndarray, mark: np.ndarray, start: np.ndarray, n: np.ndarray, flag: np.ndarray, strings: list[bytes]):
        self.h, self.doc_id, self.mark, self.start, self.n, self.flag, self.strings = h, doc_id, mark, start, n, flag, strings

    def dump(self) -> bytes:
        import zstandard

        lens = np.array([len(s) for s in self.strings], np.uint32)
        raw = pickle.dumps((self.h, self.doc_id, self.mark, self.start, self.n, self.flag, lens, b"".join(self.strings)), protocol=5)
        return zstandard.ZstdCompressor(level=3).compress(raw)

    @staticmethod
    def load(blobs: list[bytes]) -> Packed:
        import zstandard

        parts = [pickle.loads(zstandard.ZstdDecompressor().decompress(b)) for b in blobs]
        cols = [np.concatenate([p[k] for p in parts]) for k in range(6)]
        strings = []
        for p in parts:
            ends = np.cumsum(p[6], dtype=np.int64)
            strings += [p[7][a:b] for a, b in zip((ends - p[6]).tolist(), ends.tolist(), strict=True)]
        return Packed(*cols, strings)


def windows_seen(
    docs: DataFrame,
    pack: Callable[[list[tuple[int, str]]], tuple[Packed, list[np.ndarray]]],
    solve: Callable[[Packed], Iterator[tuple[int, int, int, int]]],
    id_col: str,
    text_col: str,
    pack_chars: int = PACK_CHARS,
    bucket_chars: int = BUCKET_CHARS,
) -> DataFrame:
    """(doc_id, mark, spans): what ``pack`` marks within a run of documents and ``solve`` within a bucket.

    ``pack`` gets (doc_id, text) sorted by doc_id and gives the strings that must travel (h holds the whole minimiser) and the spans
    already known, as rows (doc_id, mark, start, stop). mark is the hash of the text where a doc_id comes with several texts, and
    else 0, as it is the one column of a string's row that doesn't compress.
    """
    several = not unique_ids(docs, id_col)
    rows = docs.select(docs[id_col].cast("long").alias("i"), docs[text_col].alias("t")).where("i is not null and t is not null")
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    buckets = max(64, -(-size // bucket_chars))

    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple[int, str]]) -> pa.RecordBatch:
            held.sort(key=lambda r: r[0])
            p, known = pack(held)
            if not several:
                p.mark[:] = 0
                known = [(d, 0, a, b) for d, _, a, b in known]
            bucket = ((p.h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ids, blobs = [], []
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                ids.append(int(bucket[part[0]]))
                blobs.append(Packed((p.h[part] & np.uint64(0xFFFFFFFF)).astype(np.uint32), p.doc_id[part], p.mark[part], p.start[part], p.n[part], p.flag[part], [p.strings[k] for k in part.tolist()]).dump())
            if len(known):
                for k in range(0, len(known), 200_000):
                    part = np.array(known[k : k + 200_000], np.int64)
                    ids.append(-1 - int(part[0, 0]) % 512)
                    blobs.append(pickle.dumps(part))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        held, size = [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((i, t))
                size += len(t)
                if size >= pack_chars:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)
        held = []
        release()

    def solving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marks(found: np.ndarray) -> pa.RecordBatch:
            cols = found.reshape(-1, 4).T
            return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32))], names=["doc_id", "mark", "start", "stop"])

        at, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket < 0:
                    yield marks(pickle.loads(blob))
                    continue
                if bucket != at and blobs:
                    yield marks(np.array(list(solve(Packed.load(blobs))), np.int64))
                    blobs = []
                at = bucket
                blobs.append(blob)
        if blobs:
            yield marks(np.array(list(solve(Packed.load(blobs))), np.int64))
        blobs = []
        release()

    # so many partitions that each gets few buckets, however many there are
    parts = min(MOST_PARTS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4, -(-buckets // BUCKETS_EACH)))
    packed = rows.mapInArrow(packing, "bucket long, blob binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = packed.mapInArrow(solving, MARKS)
    grouped = found.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return grouped.mapInArrow(merged, "doc_id long, mark long, spans array<struct<start:int,stop:int>>")


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins spans that overlap or touch."""
    for batch in batches:
        out = []
        for spans in batch.column(2).to_pylist():
            joined: list[list[int]] = []
            for a, b in sorted((x["start"], x["stop"]) for x in spans):
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(b, joined[-1][1])
                else:
                    joined.append([a, b])
            out.append([{"start": a, "stop": b} for a, b in joined])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], names=["doc_id", "mark", "spans"])


def unique_ids(docs: DataFrame, id_col: str) -> bool:
    ids = docs.select(docs[id_col].cast("long").alias("i")).where("i is not null")
    return ids.groupBy("i").count().where("count > 1").isEmpty()


def with_spans(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, broadcast_rows: int) -> DataFrame:
    """(i, t, spans) of all rows of ``docs``; ``found`` is broadcast if it has few spans."""
    n = found.agg(F.sum(F.size("spans") + 2)).first()[0] or 0
    mark = F.lit(0).cast("long") if unique_ids(docs, id_col) else F.xxhash64(docs[text_col])
    rows = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"), docs[id_col].cast("long").alias("doc_id"), mark.alias("mark"))
    return rows.join(F.broadcast(found) if n <= broadcast_rows else found, ["doc_id", "mark"], "left").select("i", "t", "spans")


def text_mark(data: bytes) -> int:
    """As Spark's xxhash64 of the text."""
    h = xxhash.xxh64_intdigest(data, 42)
    return h - (1 << 64) if h >> 63 else h


def covered(spans, n: int) -> np.ndarray:
    """Which of n positions the spans cover."""
    if spans is None or not len(spans):
        return np.zeros(n, bool)
    step = np.zeros(n + 1, np.int64)
    for s in spans:
        step[s["start"]] += 1
        step[s["stop"]] -= 1
    return np.cumsum(step[:-1]) > 0
