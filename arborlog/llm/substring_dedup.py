"""Repeated passages of words by super-k-mer partitioning.

A window of ``WINDOW`` words goes if its words in that order also start in a document with a smaller doc_id; then each word
it covers is removed. Runs of windows that share a minimiser travel as one packed string to the bucket of the minimiser, where
the windows are sorted with their documents, so that the first of equals is known exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .superkmer import Packed, covered, gram_hashes, runs, sliding_min, text_mark, windows_seen, with_spans

WINDOW, GRAM = 13, 3
#: Spans and documents with spans that are broadcast at most (about 32 bytes each); beyond, documents are joined by id.
BROADCAST_SPANS = 4_000_000


def pack(rows: list[tuple[int, str]], window: int = WINDOW, gram: int = GRAM) -> tuple[Packed, list[tuple[int, int, int, int]]]:
    """Strings of a run of documents sorted by doc_id; a string that an earlier document has is known to go."""
    first: dict[bytes, int] = {}
    known: list[tuple[int, int, int, int]] = []
    hs, ids, marks, starts, ns, strings = [], [], [], [], [], []
    gram = min(gram, window)
    digest = xxhash.xxh64_intdigest
    for doc_id, text in rows:
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()
        if len(words) < window:
            continue
        low = sliding_min(gram_hashes(np.array([digest(w) for w in words], np.uint64), gram), window - gram + 1)
        at, n = runs(low)
        joined = b" ".join(words)
        ends = np.cumsum(np.array([len(w) + 1 for w in words])) - 1
        begin = np.concatenate([[0], ends[:-1] + 1])
        mark = text_mark(data)
        for i, k, a, b, h in zip(at.tolist(), n.tolist(), begin[at].tolist(), ends[at + n + window - 2].tolist(), low[at].tolist(), strict=True):
            s = joined[a:b]
            before = first.setdefault(s, doc_id)
            if before < doc_id:
                known.append((doc_id, mark, i, i + k + window - 1))
                continue
            hs.append(h)
            ids.append(doc_id)
            marks.append(mark)
            starts.append(i)
            ns.append(k)
            strings.append(s)
    return Packed(np.array(hs, np.uint64), np.array(ids, np.int64), np.array(marks, np.int64), np.array(starts, np.int32), np.array(ns, np.int16), np.zeros(len(hs), bool), strings), known


def solve(p: Packed, window: int = WINDOW) -> Iterator[tuple[int, int, int, int]]:
    """Of each bucket: sorts the windows of minimisers that came more than once, with their documents; the first of equals stays."""
    order = np.argsort(p.h, kind="stable")
    cuts = np.flatnonzero(np.diff(p.h[order])) + 1
    for group in np.split(order, cuts):
        if len(group) < 2:
            continue
        members = group.tolist()
        least: dict[bytes, int] = {}  # equal strings are cut into windows once
        for k in members:
            s, d = p.strings[k], int(p.doc_id[k])
            if s not in least or d < least[s]:
                least[s] = d
        if len(least) == 1:
            low = min(least.values())
            for k in members:
                if p.doc_id[k] > low:
                    a = int(p.start[k])
                    yield int(p.doc_id[k]), int(p.mark[k]), a, a + int(p.n[k]) + window - 1
            continue
        rows = []
        for s, d in least.items():
            at = [-1, *(i for i, c in enumerate(s) if c == 32), len(s)]
            rows += [(s[at[i] + 1 : at[i + window]], d) for i in range(len(at) - window)]
        rows.sort()
        lowest: dict[bytes, int] = {}
        last = None
        for w, d in rows:
            if w != last:
                lowest[w] = d
                last = w
        for k in members:
            s, d, a = p.strings[k], int(p.doc_id[k]), int(p.start[k])
            at = [-1, *(i for i, c in enumerate(s) if c == 32), len(s)]
            begin = None
            for i in range(len(at) - window + 1):
                gone = i < len(at) - window and lowest[s[at[i] + 1 : at[i + window]]] < d
                if gone and begin is None:
                    begin = i
                elif not gone and begin is not None:
                    yield d, int(p.mark[k]), a + begin, a + i - 1 + window
                    begin = None


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **sizes) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): one row for each row of ``docs``; kept is the words that stay, joined by one space.

    A null or empty text has no words. Rows with the same doc_id are one document and don't remove each other's
    words; rows without an id lose nothing and make nothing go. Ids must be integers.
    """
    found = saved(windows_seen(docs, lambda rows: pack(rows, window), lambda p: solve(p, window), id_col, text_col, **sizes))
    kind = docs.schema[id_col].dataType.simpleString()

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [])
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (t or "").encode("utf-8", "surrogatepass").split()
                gone = covered(spans, len(words)).tolist() if spans else []
                kept = [w for w, g in zip(words, gone, strict=True) if not g] if spans else words
                out[0].append(len(words))
                out[1].append(len(words) - len(kept))
                out[2].append(b" ".join(kept).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return with_spans(docs, found, id_col, text_col, BROADCAST_SPANS).mapInArrow(strip, f"doc_id {kind}, n_words long, n_removed long, kept string")


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def oracle(window: int = WINDOW) -> str:
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {window - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window} + 2)) AS i FROM d WHERE len(w) >= {window})),
f AS (SELECT s, min(doc_id) AS low FROM g GROUP BY 1 HAVING count(*) > 1),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS pos FROM g JOIN f USING (s) WHERE doc_id > low),
l AS (SELECT doc_id, list(pos) AS gone FROM p GROUP BY 1),
k AS (SELECT d.doc_id, w, coalesce(len(gone), 0) AS n, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM d LEFT JOIN l USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, n::BIGINT AS n_removed, sha256(CASE WHEN len(kept) = 0 THEN '' ELSE array_to_string(kept, ' ') END) AS kept_sha256 FROM k"""
