"""Benchmark decontamination by winnowing.

Documents and test items become sequences of words. Of each window of ``window`` words only the least hash of its
k-grams is kept (the first of equals) as a fingerprint with its place; equal windows keep the same gram at the same place, so every
shared span of at least that length has a fingerprint in common. The fingerprints of documents are joined with those of the items, and
each meeting is extended word by word to both sides as far as document and item agree; an extended span of at least a window is a hit,
so no hash collision gets into the result, and fingerprints that lie within a hit already extended cost nothing more. Items shorter
than a window are one window of their own length.

The index of the items (words as numbers, fingerprints, places) goes to every task, in blocks of at most ``BLOCK_BYTES`` of item
text; a larger benchmark takes as many passes over the documents as it has blocks.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import filter_texts, map_texts, saved

WINDOW, GRAM = 10, 5
BLOCK_BYTES = 16_000_000
SPAN = "array<struct<start:int,end:int>>"
#: Word characters are ASCII digits and letters, lower-cased, and all beyond ASCII.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


def gram_hashes(values: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k words in a row; the largest value where a word isn't known to the index."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    whole = np.ones(n, bool)
    for j in range(k):
        h = h * STEP + values[j : j + n]
        whole &= known[j : j + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.where(whole, h, TOP)


def kept(h: np.ndarray, w: int) -> np.ndarray:
    """The places that hold the least of some ``w`` hashes in a row, the first of equals; stretches with an unknown word have none."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, at = h[:n].copy(), np.arange(n)
    whole = low != TOP
    for j in range(1, w):
        x = h[j : j + n]
        whole &= x != TOP
        less = x < low
        low[less] = x[less]
        at[less] = np.flatnonzero(less) + j
    return np.unique(at[whole])


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many values at the beginning of two arrays are equal."""
    n, done, step = min(len(a), len(b)), 0, 32
    while done < n:
        stop = min(n, done + step)
        off = np.flatnonzero(a[done:stop] != b[done:stop])
        if len(off):
            return done + int(off[0])
        done, step = stop, step * 4
    return n


class Index:
    """Words of the test items end to end, and their fingerprints by length of window."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW, gram: int = GRAM):
        self.vocab: dict[bytes, int] = {}
        self.gram, self.window = gram, window
        parts, self.items = [], []
        for item, text in items:
            words = words_of(text)
            if words:
                self.items.append(item)
                parts.append(np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words], np.int32))
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.ends = np.cumsum([len(x) for x in parts], dtype=np.int64)
        self.values = np.array([xxhash.xxh64_intdigest(w, 7) for w in self.vocab] or [0], np.uint64)
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        at = 0
        for x in parts:
            n = min(window, len(x))
            h = gram_hashes(self.values[x], np.ones(len(x), bool), min(gram, n))
            own = kept(h, n - min(gram, n) + 1)
            found[n].append((h[own], own + at))
            at += len(x)
        self.prints: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, lists in found.items():
            h, place = (np.concatenate(x) for x in zip(*lists, strict=True))
            order = np.argsort(h, kind="stable")
            self.prints[n] = (h[order], place[order])

    def _extend(self, ids: np.ndarray, p: int, q: int, low: int, high: int) -> tuple[int, int, int]:
        """(start, end, item) of the greatest span around word p of ids[low:high] that agrees with the item around word q."""
        item = int(np.searchsorted(self.ends, q, "right"))
        begin, end = int(self.ends[item - 1]) if item else 0, int(self.ends[item])
        right = agreeing(ids[p:high], self.words[q:end])
        left = agreeing(ids[low:p][::-1], self.words[begin:q][::-1])
        return p - left, p + right, item

    def search(self, texts: list[str]) -> list[tuple[int, list[tuple[int, int]], list]]:
        """Of each text: how many words it has, the spans of words that are hit, the items."""
        get = self.vocab.get
        parts, counts = [], []
        for text in texts:
            words = words_of(text)
            counts.append(len(words))
            parts.append(np.fromiter(map(get, words, repeat(-1)), np.int32, len(words)))
            parts.append(np.array([-1], np.int32))
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        known = ids >= 0
        values = self.values[np.maximum(ids, 0)]
        starts = np.cumsum([0, *(c + 1 for c in counts)])
        grams: dict[int, np.ndarray] = {}
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for n, (prints, places) in self.prints.items():
            k = min(self.gram, n)
            if k not in grams:
                grams[k] = gram_hashes(values, known, k)
            at = kept(grams[k], n - k + 1)
            first, last = (np.searchsorted(prints, grams[k][at], side) for side in ("left", "right"))
            many = last - first
            at, first, many = at[many > 0], first[many > 0], many[many > 0]
            if not len(at):
                continue
            # the join of fingerprints: each place of a document with each place of an item
            p = np.repeat(at, many)
            q = places[np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)]
            order = np.lexsort((p, p - q))
            p, q = p[order], q[order]
            docs = np.searchsorted(starts, p, "right") - 1
            seen, until = None, -1
            for x, y, d in zip(p.tolist(), q.tolist(), docs.tolist(), strict=True):
                if x - y == seen and x < until:
                    continue  # within the span that was extended on this diagonal
                a, b, item = self._extend(ids, x, y, int(starts[d]), int(starts[d + 1]) - 1)
                seen, until = x - y, max(b, x + 1)
                if b - a >= n:
                    found[d].append((a - int(starts[d]), b - int(starts[d]), item))
        out = []
        for d, n_words in enumerate(counts):
            spans: list[tuple[int, int]] = []
            for a, b, _ in sorted(found.get(d, ())):
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                else:
                    spans.append((a, b))
            out.append((n_words, spans, sorted({self.items[x[2]] for x in found.get(d, ())})))
        return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    items = benchmark.select(benchmark[item_col].alias("item"), benchmark[text_col].alias("t")).where("item is not null and t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    return items, max(1, -(-size // block_bytes))


def _indexes(items: DataFrame, blocks: int, window: int, gram: int):
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else items
        yield items.sparkSession.sparkContext.broadcast(Index([(r.item, r.t) for r in part.collect()], window, gram))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, n_words, spans, items).

    Spans are of word positions, end exclusive, merged where they touch; items are the ids of the test items that
    have a window in the document. A null or empty text has no words and no hits; items without an id or without
    words are no items; an empty benchmark hits nothing; repeated documents each get their row, repeated items
    count once.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    arrow_kind = pa.list_(to_arrow_type(benchmark.schema[item_col].dataType))
    items, blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)

    def one(index, all_rows: bool) -> DataFrame:
        def make():
            def work(ids: list, texts: list[str]) -> pa.RecordBatch:
                rows = [(i, xxhash.xxh128_hexdigest(t.encode("utf-8", "surrogatepass")) if blocks > 1 else None, n, [{"start": a, "end": b} for a, b in spans], found) for i, t, (n, spans, found) in zip(ids, texts, index.value.search(texts), strict=True) if all_rows or spans]
                types = [pa.array(ids).type, pa.string(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), None]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                return pa.RecordBatch.from_arrays([pa.array(list(c), t) if t is not None else pa.array(list(c), arrow_kind) for c, t in zip(cols, types, strict=True)], names=["doc_id", "mark", "n_words", "spans", "items"])

            return work

        return map_texts(docs, make, f"doc_id {kind}, mark string, n_words long, spans {SPAN}, items array<{item_kind}>", id_col, text_col)

    made = []
    for b, index in enumerate(_indexes(items, blocks, window, gram)):
        out = one(index, b == 0)
        made.append(saved(out) if blocks > 1 else out)
        if blocks > 1:
            index.unpersist()
    if blocks == 1:
        return made[0].drop("mark")
    key = ["doc_id", "mark", "n_words"]
    hits = made[0].dropDuplicates(key)
    for more in made[1:]:
        hits = hits.unionByName(more.dropDuplicates(key))
    merged = hits.groupBy(*key).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))
    step = "if(size(acc) > 0 and x.start <= element_at(acc, -1).end, concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(x.end, element_at(acc, -1).end)))), concat(acc, array(x)))"
    merged = merged.select(*key, F.expr(f"aggregate(s, cast(array() as {SPAN}), (acc, x) -> {step})").alias("spans"), F.col("i").alias("items"))
    rows = made[0].select(*key)
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return rows.alias("l").join(merged.alias("r"), same).select("l.doc_id", "l.n_words", "r.spans", "r.items")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that share no window with any item, with all their columns."""
    items, blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    for index in _indexes(items, blocks, window, gram):

        def make(index=index):
            return lambda texts: [not spans for _, spans, _ in index.value.search(texts)]

        docs = filter_texts(docs, make, text_col)
    return docs


def digest(found: DataFrame) -> DataFrame:
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


#: For the check by SQL: the words of a text as a list.
SQL_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle(window: int = WINDOW) -> str:
    return f"""
WITH d AS (SELECT doc_id, {SQL_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {SQL_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), {window}) AS n, array_to_string(w[i:i + least(len(w), {window}) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t.s, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""
