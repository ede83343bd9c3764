"""SentencePiece BPE by vectorised merge rounds.

Each distinct segment (a run of word-boundary marks and the characters after it) is merged once and then
looked up. New segments of a run of rows are laid out as one flat array of symbols; a round finds the lowest
pair rank of every segment (``minimum.reduceat``), merges all its leftmost, non-overlapping occurrences in all
segments at once, and compacts the array, until no pair is left.

The library merges one pair at a time, highest score first and leftmost among equals. Merging all
occurrences at once gives the same unless a merge creates a pair that goes before or level with the others;
segments in which that happens are merged again, one occurrence a round. Marks in a row (whose pieces share one
score below all others) are joined after all else, from left to right.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NONE = np.iinfo(np.int64).max
#: Distinct segments kept by a task; beyond it they are forgotten and merged anew.
CACHE = 300_000


class Model:
    """Pieces, pair ranks and byte pieces of a BPE model with an identity normaliser."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(data)
        n = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models that keep the text as it is")
        if any(p.type == USER for p in m.pieces):
            raise ValueError("user-defined pieces aren't supported")
        self.prefix = n.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (NORMAL, UNUSED)}
        if any(p.type == UNUSED for p in m.pieces):
            raise ValueError("unused pieces aren't supported")
        self.size = len(m.pieces)
        self.eos = next(i for i, p in enumerate(m.pieces) if p.piece == (m.trainer_spec.eos_piece or "</s>"))
        self.unk = next(i for i, p in enumerate(m.pieces) if p.type == UNKNOWN)
        self.bytes = np.full(256, self.unk, np.int32)
        self.fallback = m.trainer_spec.byte_fallback
        for i, p in enumerate(m.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
        self.is_byte = np.array([p.type == BYTE for p in m.pieces])
        self.silent = np.array([p.type == CONTROL for p in m.pieces])
        self.runs = {len(p): i for p, i in self.ids.items() if not p.strip(MARK)}
        inner = {c for p in self.ids for c in p if len(p) > 1}
        self.alone = [c for c in "\n\t" if c not in inner]
        closing = "".join(c for c in ".,;:!?" if not any(re.search(r"[^\W\d_]" + re.escape(c), p) for p in self.ids))
        self.closing = re.compile(rf"([{closing}])(?<=[^\W\d_].)") if closing else None
        self.inner = any(MARK in p.lstrip(MARK) for p in self.ids)
        order = {s: k for k, s in enumerate(sorted({m.pieces[i].score for i in self.ids.values()}, reverse=True))}
        pairs = {}
        for p, i in self.ids.items():
            if not p.strip(MARK) and m.pieces[i].score <= -1e8:
                continue
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (order[m.pieces[i].score], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.late_runs = not any(k >> 32 == self.runs.get(1) and k & 0xFFFFFFFF == self.runs.get(1) for k in pairs)
        chars = {ord(p): i for p, i in self.ids.items() if len(p) == 1}
        self.char_points = np.array(sorted(chars), np.int64)
        self.char_ids = np.array([chars[c] for c in self.char_points.tolist()], np.int64)
        surface = [p.piece.replace(MARK, " ").encode() if p.type == NORMAL else bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else b" \xe2\x81\x87 " if p.type == UNKNOWN else b"" for p in m.pieces]
        self.out_len = np.array([len(x) for x in surface], np.int64)
        self.out_at = np.concatenate([[0], np.cumsum(self.out_len)[:-1]])
        self.out = np.frombuffer(b"".join(surface), np.uint8)
        self.marked = np.array([p.piece.startswith(MARK) and p.type == NORMAL for p in m.pieces])

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.made[at], -1)

    def joined(self, n: int) -> list[int]:
        """Lengths of the pieces of n marks in a row, each pair joined as soon as it can be, from the left."""
        out: list[int] = []
        for _ in range(n):
            out.append(1)
            while len(out) > 1 and out[-2] + out[-1] in self.runs:
                out[-2:] = [out[-2] + out[-1]]
        return out

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all segments end to end, and how many each has; characters without a piece become bytes."""
        flat, lens, again = self._rounds(words, False)
        changed: dict[int, np.ndarray] = {}
        if again:
            redone, n, _ = self._rounds([words[k] for k in again], True)
            changed = dict(zip(again, np.split(redone, np.cumsum(n)[:-1]), strict=True))
        starts = np.cumsum(lens) - lens
        odd = set(np.unique(np.searchsorted(starts, np.flatnonzero(flat >= self.size), "right") - 1).tolist()) if len(flat) else set()
        odd |= {k for k, x in changed.items() if len(x) and x.max() >= self.size}
        if self.late_runs:
            odd |= {k for k, w in enumerate(words) if MARK * 2 in w}
        for k in odd:
            changed[k] = self._spelt(changed.get(k, flat[starts[k] : starts[k] + lens[k]]))
        if changed:
            parts, at = [], 0
            for k in sorted(changed):
                parts += [flat[at : starts[k]], changed[k]]
                at = starts[k] + lens[k]
                lens[k] = len(changed[k])
            flat = np.concatenate([*parts, flat[at:]])
        return flat.astype(np.int32), lens

    def _spelt(self, x: np.ndarray) -> np.ndarray:
        """Joins marks in a row and spells unknown characters as bytes."""
        if self.late_runs:
            same = x == self.runs[1]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
            parts, at = [], 0
            for a, b in edges.reshape(-1, 2).tolist():
                parts += [x[at:a], np.array([self.runs[n] for n in self.joined(b - a)], np.int64)]
                at = b
            x = np.concatenate([*parts, x[at:]])
        return np.array([i for c in x.tolist() for i in ([c] if c < self.size else self.bytes[list(chr(c - self.size).encode("utf-8", "surrogatepass"))].tolist() if self.fallback else [self.unk])], np.int64)

    def _rounds(self, words: list[str], single: bool) -> tuple[np.ndarray, np.ndarray, list[int]]:
        again: set[int] = set()
        which = np.array([k for k, w in enumerate(words) if w], np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words))[which]
        all_lens = np.zeros(len(words), np.int64)
        if not len(which):
            return np.zeros(0, np.int64), all_lens, []
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.char_points, points), len(self.char_points) - 1)
        sym = np.where(self.char_points[at] == points, self.char_ids[at], self.size + points)
        starts = np.cumsum(lens) - lens
        rank, made = self._fresh(sym, starts)
        ended: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(which):
            low = np.minimum.reduceat(rank, starts)
            over = low == NONE
            if over.any():
                gone = np.repeat(over, lens)
                ended.append((which[over], lens[over], sym[gone]))
                sym, rank, made = sym[~gone], rank[~gone], made[~gone]
                which, lens, low = which[~over], lens[~over], low[~over]
                if not len(which):
                    break
                starts = np.cumsum(lens) - lens
            first = np.flatnonzero(rank == np.repeat(low, lens))
            if not single:
                run = np.concatenate([[True], np.diff(first) > 1])
                base = first[run][np.cumsum(run) - 1]
                first = first[(first - base) % 2 == 0]
            seg = np.searchsorted(starts, first, "right") - 1
            if single:
                one = np.concatenate([[True], seg[1:] != seg[:-1]])
                first, seg = first[one], seg[one]
            sym[first] = made[first]
            keep = np.ones(len(sym), bool)
            keep[first + 1] = False
            new_at = (np.cumsum(keep) - 1)[first]
            sym, rank, made = sym[keep], rank[keep], made[keep]
            per = np.bincount(seg, minlength=len(lens))
            lens = lens - per
            starts = np.cumsum(lens) - lens
            last = np.zeros(len(sym), bool)
            last[starts + lens - 1] = True
            before = new_at[new_at > starts[seg]] - 1
            touched = np.concatenate([new_at, before])
            rank[touched] = NONE
            made[touched] = -1
            inside = touched[~last[touched]]
            rank[inside], made[inside] = self.pair(sym[inside], sym[inside + 1])
            if not single and (per > 1).any():
                owner = np.concatenate([seg, seg[new_at > starts[seg]]])
                early = (per > 1)[owner] & (rank[touched] <= low[owner])
                again.update(which[owner[early]].tolist())
        order = np.concatenate([x[0] for x in ended])
        n = np.concatenate([x[1] for x in ended])
        flat = np.concatenate([x[2] for x in ended])
        all_lens[order] = n
        place = (np.cumsum(all_lens) - all_lens)[order]
        out = np.empty_like(flat)
        out[np.arange(len(flat)) + np.repeat(place - (np.cumsum(n) - n), n)] = flat
        return out, all_lens, sorted(again)

    def _fresh(self, sym: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(sym), NONE), np.full(len(sym), -1)
        rank[:-1], made[:-1] = self.pair(sym[:-1], sym[1:])
        ends = np.concatenate([starts[1:], [len(sym)]]) - 1
        rank[ends], made[ends] = NONE, -1
        return rank, made

    def segments(self, text: str) -> list[str]:
        """Parts of a text that no merge crosses, with a mark for each space.

        No piece goes on with a mark after another character, holds a line break beside others, or has one of the
        closing signs after a letter; so far as that is true of the model, texts are cut there.
        """
        if not text:
            return []
        if self.inner:
            return [(MARK if self.prefix else "") + text.replace(" ", MARK)]
        if self.prefix and text[0] != " " and "  " not in text and MARK not in text:
            text = MARK + text.replace(" ", " " + MARK)
            for c in self.alone:
                text = text.replace(c, f" {c} ")
            return (self.closing.sub(r" \1", text) if self.closing else text).split(" ")
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", (MARK if self.prefix else "") + text.replace(" ", MARK))

    def decode(self, ids: np.ndarray, lens: np.ndarray) -> list[str]:
        """Texts of the id lists laid end to end in ``ids``."""
        n = self.out_len[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        flat = np.arange(total) + np.repeat(self.out_at[ids] - (ends - n), n)
        raw = self.out[flat].tobytes()
        bounds = np.concatenate([[0], ends])
        rows = np.concatenate([[0], np.cumsum(lens)])
        texts = []
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            first = a
            while first < b and self.silent[ids[first]]:
                first += 1
            skip = int(self.prefix and first < b and self.marked[ids[first]])
            part = raw[bounds[a] + skip : bounds[b]]
            try:
                texts.append(part.decode())
            except UnicodeDecodeError:
                texts.append(self._damaged(ids[a:b], skip))
        return texts

    def _damaged(self, ids: np.ndarray, skip: int) -> str:
        """As decode, for byte pieces that aren't UTF-8: each byte that belongs to no character becomes U+FFFD."""
        out, held = [], b""

        def flush(held: bytes) -> str:
            text, at = "", 0
            while at < len(held):
                for n in (1, 2, 3, 4):
                    try:
                        text += held[at : at + n].decode()
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    text += "�"
                    at += 1
            return text

        for i in ids.tolist():
            piece = self.out[self.out_at[i] : self.out_at[i] + self.out_len[i]].tobytes()
            if self.is_byte[i]:
                held += piece
            elif not self.silent[i]:
                out += [flush(held), piece.decode()]
                held = b""
        return "".join([*out, flush(held)])[skip:]


class Encoder:
    """Encodes lists of texts; remembers segments between calls."""

    def __init__(self, m: Model):
        self.m = m
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def learn(self, words: list[str]) -> None:
        base = len(self.at)
        flat, lens = self.m.merge(words)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while base + len(words) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[base : base + len(words)] = self.used + np.cumsum(lens) - lens
        self.length[base : base + len(words)] = lens
        self.used += len(flat)
        self.at.update(zip(words, range(base, base + len(words)), strict=True))

    def encode(self, texts: list[str], eos: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each text has."""
        if len(self.at) > CACHE:
            self.clear()
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            part = self.m.segments(text)
            counts[k] = len(part)
            words += part
        new = list(set(words).difference(self.at))
        if new:
            self.learn(new)
        at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        n = self.length[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.start[at] - (ends - n), n)]
        cut = np.concatenate([[0], np.cumsum(counts)])
        bounds = np.concatenate([[0], ends])[cut]
        lens = np.diff(bounds)
        if not eos:
            return ids, lens
        out = np.full(total + len(texts), self.m.eos, np.int32)
        out[np.arange(total) + np.repeat(np.arange(len(texts)), lens)] = ids
        return out, lens + 1


@lru_cache(maxsize=1)
def encoder(data: bytes) -> Encoder:
    """One for each worker process, so that later tasks find the segments of earlier ones."""
    return Encoder(Model(data))


def encode_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", eos: bool = True) -> DataFrame:
    """One row for each row of ``df``: (doc_id, ids, decoded).

    A null text counts as empty: it has the end id alone and decodes to an empty text. Repeated rows give repeated
    rows; an empty table gives no rows. The model is read on the driver and sent to the tasks: its size is fixed.
    """
    with open(model_path, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        enc = encoder(data.value)
        m = enc.m

        def work(ids: list, texts: list[str]) -> pa.RecordBatch:
            flat, lens = enc.encode(texts, eos)
            offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(m.decode(flat, lens), pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

        return work

    return map_texts(df, make, f"doc_id {kind}, ids array<int>, decoded string", id_col, text_col)


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by single spaces."""
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids_text(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
