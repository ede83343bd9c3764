"""Repeated strings of bytes by suffix arrays.

A window of ``WINDOW`` bytes that also starts anywhere else goes, in all its places. Windows meet by their minimisers (see
superkmer): the different strings of a bucket whose minimiser came more than once are a shard, laid end to end with a byte between them
that UTF-8 never has. The shard's suffix array is built by induced sorting: suffixes are
classified as larger or smaller than the next, the leftmost-smaller substrings are sorted and named by their contents, their order is
found recursively from the names, and all other suffixes are induced from it in two passes. The common prefix of each suffix with
the one before it in the array, kept by text position, tells which windows are repeated.

Of bytes, induction runs over whole buckets of first letters at a time in numpy: a bucket's entries induce their predecessors together, and
only those that fall into the same bucket wait for another round. Names are written as one or two bytes each and sorted in the same way; entry by
entry induction is left for short arrays and for more names than two bytes hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .superkmer import Packed, covered, gram_hashes, runs, sliding_min, text_mark, windows_seen, with_spans

WINDOW, GRAM = 200, 48
BETWEEN = 255
#: Bytes of a shard at most, and those up to which minimisers share one.
SHARD_BYTES = 4_000_000
SHARED_BYTES = 1_200_000
#: Bytes below which a suffix array is induced entry by entry.
FEW = 12_000
#: Spans and documents with spans that are broadcast at most (about 32 bytes each); beyond, documents are joined by id.
BROADCAST_SPANS = 4_000_000
#: Of a string: all its windows are known to go; its windows may be equal to one another.
KNOWN, TURNS = 1, 2
_rng = np.random.default_rng(20)
VALUES = _rng.integers(0, 2**63, 256, dtype=np.uint64)


# --- suffix arrays ---


def smaller(s: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one; the empty suffix at the end is the least."""
    n = len(s)
    up = np.zeros(n, bool)
    up[:-1] = s[:-1] < s[1:]
    decided = np.ones(n, bool)
    decided[:-1] = s[:-1] != s[1:]
    at = np.where(decided, np.arange(n), n - 1)
    return up[np.minimum.accumulate(at[::-1])[::-1]]


def _place(char: np.ndarray, edge: np.ndarray, back: bool) -> np.ndarray:
    """Slots for entries with these first letters, in order, at the open ends of their buckets; moves the ends."""
    if not len(char):
        return np.zeros(0, np.int64)
    if back:
        char = char[::-1]
    order = np.argsort(char, kind="stable")
    sorted_ = char[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    n = np.diff(np.append(first, len(sorted_)))
    rank = np.arange(len(sorted_)) - np.repeat(first, n)
    slots = np.empty(len(char), np.int64)
    letters = sorted_[first]
    if back:
        slots[order] = edge[sorted_] - 1 - rank
        edge[letters] -= n
        return slots[::-1]
    slots[order] = edge[sorted_] + rank
    edge[letters] += n
    return slots


def induce(s: np.ndarray, is_small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The order of all suffixes, given the order of the leftmost-smaller ones."""
    n = len(s)
    count = np.bincount(s, minlength=k)
    ends = np.cumsum(count)
    starts = ends - count
    present = np.flatnonzero(count)
    sa = np.full(n, -1, np.int64)
    tail = ends.copy()
    sa[_place(s[lms], tail, True)] = lms
    lms_from = tail.copy()
    # larger suffixes, from the left
    head = starts.copy()
    sa[_place(s[n - 1 :], head, False)] = n - 1
    for c in present.tolist():
        done = starts[c]
        while True:
            stop = head[c]
            block = sa[done:stop]
            done = stop
            if not len(block):
                break
            before = block[block > 0] - 1
            before = before[~is_small[before]]
            if len(before):
                sa[_place(s[before], head, False)] = before
        block = sa[lms_from[c] : ends[c]]
        before = block[block > 0] - 1
        before = before[~is_small[before]]
        if len(before):
            sa[_place(s[before], head, False)] = before
    # smaller suffixes, from the right; the leftmost ones are placed anew
    tail = ends.copy()
    for c in present[::-1].tolist():
        done = ends[c]
        while True:
            stop = tail[c]
            block = sa[stop:done][::-1]
            done = stop
            if not len(block):
                break
            before = block[block > 0] - 1
            before = before[is_small[before]]
            if len(before):
                sa[_place(s[before][::-1], tail, True)] = before[::-1]
        block = sa[starts[c] : head[c]][::-1]
        before = block[block > 0] - 1
        before = before[is_small[before]]
        if len(before):
            sa[_place(s[before][::-1], tail, True)] = before[::-1]
    return sa


def _same_substrings(s: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the substrings of bytes at a and b, of these lengths, are equal, by eight bytes at a time."""
    word = _words(s)
    same = np.ones(len(a), bool)
    left = np.arange(len(a))
    k = 0
    while len(left):
        x = word[a[left] + k] ^ word[b[left] + k]
        rest = length[left] - k
        x = np.where(rest < 8, x & ((np.uint64(1) << (np.minimum(rest, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1)), x)
        same[left[x != 0]] = False
        left = left[(x == 0) & (rest > 8)]
        k += 8
    return same


def _words(text: np.ndarray) -> np.ndarray:
    """Of each position, the eight bytes from it on as one number, the first lowest."""
    padded = np.concatenate([text.astype(np.uint8), np.zeros(8, np.uint8)])
    word = np.zeros(len(text), np.uint64)
    for k in range(8):
        word |= padded[k : k + len(text)].astype(np.uint64) << np.uint64(8 * k)
    return word


def names_array(s: list[int], k: int) -> list[int]:
    """The suffix array of numbers below k by induced sorting, entry by entry."""
    n = len(s)
    if n < 2:
        return list(range(n))
    small = [False] * n
    for i in range(n - 2, -1, -1):
        small[i] = s[i] < s[i + 1] or (s[i] == s[i + 1] and small[i + 1])
    ends = np.cumsum(np.bincount(np.array(s), minlength=k)).tolist()
    begins = [0, *ends[:-1]]
    lms = [i for i in range(1, n) if small[i] and not small[i - 1]]

    # what an entry induces in each of the passes, or -1; the last one is for slots that are still empty
    larger = [-1, *(i if not small[i] else -1 for i in range(n - 1)), -1]
    lesser = [-1, *(i if small[i] else -1 for i in range(n - 1)), -1]

    def spread(order: list[int]) -> list[int]:
        sa, tail, head = [-1] * n, ends[:], begins[:]
        for i in reversed(order):
            tail[s[i]] -= 1
            sa[tail[s[i]]] = i
        sa[head[s[-1]]] = n - 1
        head[s[-1]] += 1
        for j in sa:  # grows ahead of the reading
            i = larger[j]
            if i >= 0:
                c = s[i]
                at = head[c]
                sa[at] = i
                head[c] = at + 1
        tail = ends[:]
        for j in reversed(sa):
            i = lesser[j]
            if i >= 0:
                c = s[i]
                at = tail[c] - 1
                sa[at] = i
                tail[c] = at
        return sa

    if not lms:
        return spread(lms)
    stop = dict(zip(lms, [*(x + 1 for x in lms[1:]), n], strict=True))
    name, last, names = [-1] * n, None, -1
    is_lms = bytearray(n)
    for i in lms:
        is_lms[i] = 1
    order = [i for i in spread(lms) if is_lms[i]]
    for i in order:
        own = s[i : stop[i]]
        if own != last or stop[i] == n:  # a substring that reaches the end is like no other
            names += 1
        name[i] = names
        last = own if stop[i] < n else None
    if names < len(lms) - 1:
        order = [lms[j] for j in names_array([name[i] for i in lms], names + 1)]
    return spread(order)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of bytes."""
    n = len(s)
    if n < FEW:
        return np.array(names_array(s.tolist(), 256), np.int64)
    k = int(s.max()) + 1
    wide = s.astype(np.int64)
    is_small = smaller(wide)
    lms = np.flatnonzero(is_small[1:] & ~is_small[:-1]) + 1
    sa = induce(wide, is_small, lms, k)
    if not len(lms):
        return sa
    # name the substrings from one leftmost-smaller place to the next in their order
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by = sa[is_lms[sa]]
    stop = np.full(n, n, np.int64)
    stop[lms[:-1]] = lms[1:] + 1
    a, b = by[1:], by[:-1]
    length = stop[a] - a
    alike = (length == stop[b] - b) & (stop[a] < n) & (stop[b] < n)
    alike[alike] = _same_substrings(s, a[alike], b[alike], length[alike])
    names = np.concatenate([[0], np.cumsum(~alike)])
    if names[-1] < len(lms) - 1:
        name = np.zeros(n, np.int64)
        name[by] = names
        name = name[lms]
        if names[-1] < 256 and 2 * len(name) < n:
            order = suffix_array(name.astype(np.uint8))
        elif names[-1] < 65536 and 5 * len(name) < 2 * n:
            base = math.isqrt(int(names[-1])) + 1
            order = suffix_array(np.stack([name // base, name % base], axis=1).astype(np.uint8).ravel())
            order = order[order % 2 == 0] // 2  # only suffixes of whole names count
        else:
            order = np.array(names_array(name.tolist(), int(names[-1]) + 1))
        by = lms[order]
    return induce(wide, is_small, by, k)


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(permuted, before): by text position, how many bytes each wanted suffix shares with the one before it in the array, up to ``most``, and which that is."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    word = _words(text)
    permuted = np.zeros(n, np.int32)
    at = np.flatnonzero(wanted & (before >= 0))  # in text order, so the text is read in one direction
    k = 0
    while len(at) and k < most:
        b = before[at]
        ok = np.maximum(at, b) + k < n
        at, b = at[ok], b[ok]
        x = word[at + k] ^ word[b + k]
        differ = x != 0
        low = x[differ] & (~x[differ] + np.uint64(1))
        permuted[at[differ]] += (np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int32)
        at = at[~differ]
        permuted[at] += 8
        k += 8
    return np.minimum(permuted, n - np.maximum(np.arange(n), before)), before


def repeated(text: np.ndarray, sa: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """Which valid positions share ``window`` bytes with another: with their neighbour on either side in the suffix array."""
    permuted, before = common_prefixes(text, sa, window, valid)
    later = np.flatnonzero(valid & (permuted >= window))
    out = np.zeros(len(text), bool)
    out[later] = True
    out[before[later]] = True
    return out & valid


# --- documents ---


def pack(rows: list[tuple[int, str]], window: int = WINDOW, gram: int = GRAM) -> tuple[Packed, list[tuple[int, int, int, int]]]:
    """Strings of a run of documents. Equal ones travel once, flagged; the others of them are known to go, as what their flagged copy finds in its shard is theirs."""
    first: dict[bytes, int] = {}
    known: list[tuple[int, int, int, int]] = []
    hs, ids, marks, starts, ns, strings = [], [], [], [], [], []
    flags: list[int] = []
    gram = min(gram, window)

    def know(d: int, m: int, a: int, b: int) -> None:
        if known and known[-1][:2] == (d, m) and known[-1][2] <= a <= known[-1][3]:
            known[-1] = (d, m, known[-1][2], max(b, known[-1][3]))
        else:
            known.append((d, m, a, b))

    for doc_id, text in rows:
        data = text.encode("utf-8", "surrogatepass")
        if len(data) < window:
            continue
        low = sliding_min(gram_hashes(VALUES[np.frombuffer(data, np.uint8)], gram), window - gram + 1)
        at, n = runs(low)
        mark = text_mark(data)
        for i, k, h in zip(at.tolist(), n.tolist(), low[at].tolist(), strict=True):
            s = data[i : i + k + window - 1]
            mine = len(hs)
            before = first.setdefault(s, mine)
            if before != mine:
                flags[before] |= KNOWN
                know(doc_id, mark, i, i + k + window - 1)
                continue
            hs.append(h)
            ids.append(doc_id)
            marks.append(mark)
            starts.append(i)
            ns.append(k)
            # equal windows of one string repeat what the windows have in common
            probe = min(16, window - k)
            flags.append(TURNS if k > 1 and (probe < 1 or s.find(s[k - 1 : k - 1 + probe], k) >= 0) else 0)
            strings.append(s)
    return Packed(np.array(hs, np.uint64), np.array(ids, np.int64), np.array(marks, np.int64), np.array(starts, np.int32), np.array(ns, np.int16), np.array(flags, np.int8), strings), known


def shard_repeats(strings: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each string, which of its windows are repeated in the shard."""
    text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
    lens = np.array([len(s) for s in strings])
    starts = np.cumsum(lens + 1) - lens - 1
    n = np.maximum(lens - window + 1, 0)
    step = np.zeros(len(text) + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n, -1)
    valid = np.cumsum(step[:-1]) > 0
    hit = repeated(text, suffix_array(text), valid, window)
    return [hit[a : a + k] for a, k in zip(starts.tolist(), n.tolist(), strict=True)]


def solve(p: Packed, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """Spans of repeated windows of a bucket. Equal strings are grouped: a group of several is repeated as a whole, and stands once in its shard for what other strings share with it."""
    order = np.argsort(p.h, kind="stable")
    waiting: list[int] = []
    size = 0

    def span(k: int, a: int = 0, n: int | None = None) -> tuple[int, int, int, int]:
        begin = int(p.start[k]) + a
        return int(p.doc_id[k]), int(p.mark[k]), begin, begin + (int(p.n[k]) if n is None else n) + window - 1

    def shard() -> Iterator[tuple[int, int, int, int]]:
        for k, hit in zip(waiting, shard_repeats([p.strings[k] for k in waiting], window), strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
            for a, b in edges.reshape(-1, 2).tolist():
                yield span(k, a, b - a)

    for group in np.split(order, np.flatnonzero(np.diff(p.h[order])) + 1):
        if len(group) < 2 and not p.flag[group[0]]:
            continue
        same: dict[bytes, list[int]] = {}
        for k in group.tolist():
            same.setdefault(p.strings[k], []).append(k)
        for g in same.values():
            if len(g) > 1 or p.flag[g[0]] & KNOWN:
                yield from (span(k) for k in g)
        if len(same) < 2 and (len(group) > 1 or p.flag[group[0]] & KNOWN):
            continue
        members = [g[0] for g in same.values()]
        held = sum(len(p.strings[k]) for k in members)
        if held > shard_bytes:
            yield from _large(p, members, window, shard_bytes, span)
            continue
        if size + held > min(SHARED_BYTES, shard_bytes) and waiting:
            yield from shard()
            waiting, size = [], 0
        waiting += members
        size += held
    if waiting:
        yield from shard()


def _large(p: Packed, copies: list[int], window: int, shard_bytes: int, span) -> Iterator[tuple[int, int, int, int]]:
    """One minimiser with more strings than a shard holds: its windows are dealt out by their own hash, so equal ones meet, and each part is a shard of pieces."""
    windows = sum(int(p.n[k]) for k in copies)
    parts = max(2, -(-windows * window // (8 * shard_bytes)))
    hashes = [gram_hashes(VALUES[np.frombuffer(p.strings[k], np.uint8)], window) for k in copies]
    hits = [np.zeros(int(p.n[k]), bool) for k in copies]
    for part in range(parts):
        where, value = [], []
        for x, h in enumerate(hashes):
            i = np.flatnonzero(h % np.uint64(parts) == part)
            where.append(np.stack([np.full(len(i), x), i], axis=1))
            value.append(h[i])
        where, value = np.concatenate(where), np.concatenate(value)
        order = np.argsort(value, kind="stable")
        where, value = where[order], value[order]
        again = np.zeros(len(value), bool)
        again[1:] |= value[1:] == value[:-1]
        again[:-1] |= value[:-1] == value[1:]
        where = where[again]
        for at in range(0, len(where), shard_bytes // window):
            # windows of equal hash may lie on both sides of a cut, so each part overlaps the next by one hash
            piece = where[max(0, at - 1) : at + shard_bytes // window + 1]
            found = shard_repeats([p.strings[copies[x]][i : i + window] for x, i in piece.tolist()], window)
            for (x, i), f in zip(piece.tolist(), found, strict=True):
                hits[x][i] |= bool(f[0])
    for k, hit in zip(copies, hits, strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        for a, b in edges.reshape(-1, 2).tolist():
            yield span(k, a, b - a)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **sizes) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): one row for each row of ``docs``; kept is the bytes that stay.

    A null or empty text has no bytes. A repeated row is a document of its own: both lose what they share. Rows without an id
    take no part. Ids must be integers. What is kept may begin or end within a character.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = saved(windows_seen(docs, lambda rows: pack(rows, window), lambda p: solve(p, window), id_col, text_col, **sizes))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [])
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (t or "").encode("utf-8", "surrogatepass")
                gone = covered(spans, len(data)) if spans else None
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if spans else data
                out[0].append(len(data))
                out[1].append(len(data) - len(kept))
                out[2].append(int((np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1).sum()) if spans else 0)
                out[3].append(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return with_spans(docs, found, id_col, text_col, BROADCAST_SPANS).mapInArrow(strip, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
