"""Near-duplicate documents by SimHash and BK-trees.

Equal fingerprints are grouped first, so copies cost no comparisons. Two fingerprints of 64 bits that differ in at
most r bits agree in whole in ``agree`` of ``r + agree`` blocks of bits; for each choice of blocks, the fingerprints that
agree there form a shard with a BK-tree of its own: children are keyed by their Hamming distance to the parent, and a
search follows only the edges within the radius of the distance at hand.

A subtree whose edge is within the radius is linked to its parent as a whole, so a search that has met the
parent passes it over: what is sought are the components, not each pair, and dense groups stay cheap. Shards of more
than ``SHARD`` fingerprints are cut into parts of which each pair has its tree, so no task gets an unbounded shard.

``similar`` links texts whose sets of runs of five words have a Jaccard similarity of 0.8 or more, by fingerprints of 128 bits, BK-trees
and an exact count. Equal sets are grouped. At that similarity 19 bits differ on average (24 of the shortest sets, with a deviation of 4), too many for
blocks of bits, so the shards are those that agree in a band of minima of hashes (a pair at 0.8 misses all bands with a chance
of 3e-6, whatever the number of texts). Each shard has a BK-tree, searched at radii that rise to 52 bits; its least
spanning forest is counted exactly, about one pair for each member and shard. Where members of a shard are still apart then, the sets travel to the
shard, its BK-tree gives all near pairs of theirs, and blocks with such pairs are counted by products of matrices; only links leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, map_texts, release, saved
from .graph import connected_components, salted

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints in a tree at most, but for two parts of a cut shard that share one.
SHARD = 8192
#: Fingerprints a shard has on average, at most, before more blocks must agree.
MEAN_SHARD = 256
#: Rows of the list of large shards that are broadcast at most.
BROADCAST_ROWS = 200_000
FRONTIER = 400_000
#: Of ``similar``: words of a shingle, least similarity, bands and minima in a band.
SIMILAR_SHINGLE, SIMILARITY, BANDS, BAND = 5, 0.8, 32, 5
#: Bits of 128 that may differ, as radii at which a BK-tree is searched one after the other.
SIMILAR_RADII = (4, 8, 12, 16, 20, 24, 30, 40, 52)
#: Rows and columns of a matrix, and values of a block of sets, at a time, where all pairs of a shard are counted.
ROWS, COLUMNS, VALUES = 1024, 1024, 400_000
#: Pairs that meet one copy of a set of shingles at most.
HUB = 64


def fingerprint(text: str, shingle: int = SHINGLE, seeds: tuple[int, ...] = (SEED,)) -> list[int]:
    """Words are runs without ASCII white space, A-Z in lower case; a bit is set if over half the shingles' XXH64 have it. 64 bits for each seed."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return [0] * len(seeds)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    out = []
    for seed in seeds:
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts, last, strict=True)], "<u8")
        bits = np.zeros(64, np.int64)
        for k in range(0, n, 65536):
            bits += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0]))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """(doc_id, fp0, fp1, ...): one row for each row of ``docs``; null and empty texts have fingerprint zero."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [f"fp{k}" for k in range(len(seeds))]

    def make():
        def work(ids: list, texts: list[str]) -> pa.RecordBatch:
            found = np.array([fingerprint(t, shingle, seeds) for t in texts], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(found[:, k]) for k in range(len(seeds)))], names=["doc_id", *names])

        return work

    return map_texts(docs, make, f"doc_id {kind}, " + ", ".join(f"{x} long" for x in names), id_col, text_col)


def masks(radius: int, agree: int) -> list[tuple[int, ...]]:
    """For each choice of ``agree`` among ``radius + agree`` blocks, the mask of their bits."""
    n = radius + agree
    edges = [64 * k // n for k in range(n + 1)]
    block = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(n)]
    return [(sum(block[k] for k in c),) for c in combinations(range(n), agree)]


def _distance(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(fp[a, w] ^ fp[b, w]).astype(np.int64) for w in range(fp.shape[1]))


class Forest:
    """BK-trees, one of each root: root[i] is the first index of i's tree. ``fp`` has a row of words for each fingerprint; those of a tree must differ.

    ``above[i]`` has the links of points to the first point on their way down that is within the radius, if one is given.
    """

    def __init__(self, fp: np.ndarray, root: np.ndarray, radius: int = -1):
        self.fp, self.root, self.radius = fp.reshape(len(fp), -1), root, radius
        at = np.arange(len(fp))
        points, cur = at[root != at], root[root != at]
        linked = np.zeros(len(fp), bool)
        self.above: list[tuple[np.ndarray, np.ndarray]] = []
        edges = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while len(points):
            d = _distance(self.fp, points, cur)
            near = (d <= radius) & ~linked[points]
            self.above.append((points[near], cur[near]))
            linked[points[near]] = True
            key = cur * 256 + d
            order = np.argsort(key, kind="stable")
            points, key = points[order], key[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            child = points[first][np.cumsum(first) - 1]
            edges.append((key[first], points[first]))
            points, cur = points[~first], child[~first]
        keys, kids = (np.concatenate(x) for x in zip(*edges, strict=True))
        order = np.argsort(keys)
        self.keys, self.kids = keys[order], kids[order]

    def search(self, ask: np.ndarray, radius: int, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (q, v) of those who ask and what is within the radius of them in their tree: all, or, if not ``whole``, without what is below a near edge of a v."""
        stack = [(ask[k : k + 20_000], self.root[ask[k : k + 20_000]]) for k in range(0, len(ask), 20_000)]
        while stack:
            q, v = stack.pop()
            if len(q) > FRONTIER:
                stack += [(q[k : k + FRONTIER // 2], v[k : k + FRONTIER // 2]) for k in range(0, len(q), FRONTIER // 2)]
                continue
            d = _distance(self.fp, q, v)
            near = d <= radius
            other = near & (q != v)
            yield q[other], v[other]
            low = np.searchsorted(self.keys, v * 256 + np.maximum(np.where(near & (not whole), radius + 1, d - radius), 0))
            high = np.searchsorted(self.keys, v * 256 + np.minimum(d + radius, 255), "right")
            many = np.maximum(high - low, 0)
            total = int(many.sum())
            if total:
                ends = np.cumsum(many)
                stack.append((np.repeat(q, many), self.kids[np.arange(total) + np.repeat(low - (ends - many), many)]))

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links that join what is within the radius of the trees."""
        yield from self.above
        if len(self.keys):
            yield from self.search(np.arange(len(self.fp)), self.radius, False)


def forest_links(fp: np.ndarray, root: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within the radius, in trees of their own: root[i] is the first index of i's tree."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    a, b = (np.concatenate(x) for x in zip(none, *Forest(fp, root, radius).links(), strict=True))
    return a, b


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n points, the least index it reaches by the links."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        np.minimum.at(new, label[a], m)
        np.minimum.at(new, label[b], m)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _shards(batches: Iterator[pa.RecordBatch], solve: Callable[..., pa.RecordBatch], most: int = 4 * SHARD) -> Iterator[pa.RecordBatch]:
    """Calls ``solve`` with the columns of whole shards; rows (shard, ...) come sorted by shard."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size >= most:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last shard may go on
            if cut:
                yield solve(*(x[:cut] for x in cols))
            held, size = [[x[cut:] for x in cols]], size - cut
    if size:
        yield solve(*(np.concatenate(x) for x in zip(*held, strict=True)))
    held.clear()
    release()


def _shard_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, node, fp0, ...) sorted by shard: links of each node to the least it reaches in its shard."""

    def solve(shard: np.ndarray, node: np.ndarray, *fp: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((node, shard))
        shard, node = shard[order], node[order]
        first = np.concatenate([[True], shard[1:] != shard[:-1]])
        root = np.flatnonzero(first)[np.cumsum(first) - 1]
        a, b = forest_links(np.stack([x[order].view(np.uint64) for x in fp], axis=1), root, radius)
        label = least_reached(len(node), a, b)
        far = np.flatnonzero(label != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[label[far]])], names=["a", "b"])

    return _shards(batches, solve)


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _cut(parts: DataFrame, fps: list[str], shard: int) -> DataFrame:
    """Rows (shard, node, fps, ...) in order of shards, where each pair of parts of a shard of too many rows is one of its own."""
    rest = [c for c in parts.columns if c != "shard"]
    big = saved(parts.groupBy("shard").count().where(F.col("count") > shard).select("shard", F.ceil(F.col("count") / shard).cast("int").alias("cuts")))
    n_big = big.count()
    if n_big:
        parts = parts.join(F.broadcast(big) if n_big <= BROADCAST_ROWS else big, "shard", "left")
        mine = F.pmod(F.xxhash64(*fps), F.col("cuts")).cast("int")
        pairs = F.transform(F.filter(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: j != mine), lambda j: F.xxhash64("shard", F.least(mine, j), F.greatest(mine, j)))
        parts = parts.select(*rest, F.explode(F.when(F.col("cuts").isNull(), F.array("shard")).otherwise(pairs)).alias("shard"))
    return parts.select("shard", *rest).repartition("shard").sortWithinPartitions("shard")


def components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    seeds: tuple[int, ...] = (SEED,),
    shard: int = SHARD,
) -> DataFrame:
    """(doc_id, fp0, ..., component_id): one row for each row of ``docs``.

    component_id is the least doc_id reached over links between fingerprints that differ in at most ``radius`` bits;
    a document linked to nothing is its own component. Null and empty texts share fingerprint zero and are linked like
    any other. Rows without an id have no part in links; they get the component of their fingerprint, or null. Rows
    that repeat a doc_id with other texts link these texts. Ids must be integers.
    """
    fps = [f"fp{k}" for k in range(len(seeds))]
    rows = saved(fingerprints(docs.select(docs[id_col].cast("long").alias("i"), docs[text_col].alias("t")), "i", "t", shingle, seeds))
    prints = saved(rows.where("doc_id is not null").groupBy(*fps).agg(F.min("doc_id").alias("node")))
    n = prints.count()
    agree = 1
    while agree < 4 and n > MEAN_SHARD << (64 * agree // (radius + agree)):
        agree += 1
    tables = masks(radius, agree)
    # an equal hash of two shards only makes them share a tree
    keys = F.explode(F.array(*[F.xxhash64(F.lit(k), *[F.col(x).bitwiseAND(_signed(m)) for x, m in zip(fps, mask, strict=True)]) for k, mask in enumerate(tables)]))
    parts = prints.select("node", *fps, keys.alias("shard"))
    parts = _cut(parts, fps, shard)
    links = parts.mapInArrow(lambda batches: _shard_links(batches, radius), "a long, b long")
    # an id with several texts links their fingerprints
    named = rows.where("doc_id is not null")
    several = named.groupBy("doc_id").agg(F.count_distinct(*fps).alias("n")).where("n > 1").select("doc_id")
    ties = named.join(several, "doc_id", "left_semi").join(prints, fps).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = connected_components(links.union(ties))
    labelled = prints.join(found, "node", "left").select(*fps, F.coalesce("component", "node").alias("component_id"))
    return salted(rows, labelled, fps, "doc_id", n).select("doc_id", *fps, "component_id")


# --- exact similarity ---


def shingles(text: str) -> np.ndarray:
    """Sorted different XXH64 of the runs of five words (of all words, if fewer); words are as in ``fingerprint``."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - SIMILAR_SHINGLE + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    last = ends[min(SIMILAR_SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last, strict=True)], "<u8"))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_RNG = np.random.default_rng(SEED)
_XOR, _ODD = (_RNG.integers(0, 2**63, (BANDS * BAND, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def sketch(h: np.ndarray) -> tuple[list[int], list[int]]:
    """Of a set of shingles: the fingerprint of two words, and a key for each band of minima."""
    low = np.full(BANDS * BAND, 2**64 - 1, np.uint64)
    bits = np.zeros(128, np.int64)
    for k in range(0, len(h), 4096):
        x = h[k : k + 4096]
        low = np.minimum(low, ((x ^ _XOR) * _ODD).min(axis=1))
        both = np.stack([x, _mixed(x)], axis=1)
        bits += np.unpackbits(both.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = np.packbits(2 * bits > len(h), bitorder="little").view("<i8").tolist()
    low = low.reshape(BANDS, BAND)
    return fp, [xxhash.xxh64_intdigest(low[k].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of different values; two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return common / (len(a) + len(b) - common)


def _joining(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the links, earlier ones first, join groups that are apart, and the labels (least index) afterwards."""
    at, x, y = np.arange(len(a)), label[a], label[b]
    taken = [at[:0]]
    while (apart := x != y).any():
        at, x, y = at[apart], x[apart], y[apart]
        least = np.full(len(label), len(x))
        np.minimum.at(least, x, np.arange(len(x)))
        np.minimum.at(least, y, np.arange(len(x)))
        pick = np.unique(least[least < len(x)])
        taken.append(at[pick])
        new = least_reached(len(label), x[pick], y[pick])
        label, x, y = new[label], new[x], new[y]
    return label, np.concatenate(taken)


def spanning(fp: np.ndarray, root: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the least spanning forests of fingerprints over distances of at most the last radius, one of each root.

    BK-trees are searched at rising radii for those outside the largest group of their tree, until a tree's points are together. Ties go
    by node, so trees that share members share edges.
    """
    n = len(fp)
    forest, label = Forest(fp, root), np.arange(n)
    edges = [(label[:0], label[:0])]

    def least(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((np.maximum(node[a], node[b]), np.minimum(node[a], node[b]), _distance(fp, a, b)))
        new, taken = _joining(label, a[order], b[order])
        return new, a[order][taken], b[order][taken]

    for radius in SIMILAR_RADII:
        score = np.bincount(label, minlength=n)[label] * n + label
        most = np.zeros(n, np.int64)
        np.maximum.at(most, root, score)
        ask = np.flatnonzero(score != most[root])
        if not len(ask):
            break
        held, size = [(ask[:0], ask[:0])], 0
        for a, b in forest.search(ask, radius, True):
            apart = label[a] != label[b]
            held.append((a[apart], b[apart]))
            size += len(held[-1][0])
            if size > 4 * FRONTIER:  # links that lie on no least forest of some lie on none of all
                held, size = [least(held)[1:]], 0
        label, a, b = least(held)
        edges.append((a, b))
    a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
    return a, b


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, node, fp0, fp1) sorted by shard: edges of its members, of equal fingerprints to the first of them and of different ones by the shard's BK-tree."""

    def solve(shard: np.ndarray, node: np.ndarray, fp0: np.ndarray, fp1: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((node, fp1, fp0, shard))
        shard, node, fp = shard[order], node[order], np.stack([fp0[order], fp1[order]], axis=1).view(np.uint64)
        begins = np.concatenate([[True], shard[1:] != shard[:-1]])
        differs = begins | np.concatenate([[True], (fp[1:] != fp[:-1]).any(axis=1)])
        first = np.flatnonzero(differs)  # of equal fingerprints
        same = np.flatnonzero(~differs)
        root = np.flatnonzero(begins[first])[np.cumsum(begins[first]) - 1]
        a, b = spanning(fp[first], root, node[first])
        a, b = np.concatenate([first[a], same]), np.concatenate([first[b], first[np.cumsum(differs) - 1][same]])
        a, b = node[a], node[b]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return _shards(batches, solve)


def _ends(shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.append(np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard))
    return np.concatenate([[0], ends[:-1]]), ends


def near_pairs(fp: np.ndarray, label: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """For positions in a row, which of all fingerprints a BK-tree finds within the last radius of them, where the labels differ."""
    _, first, group = np.unique(fp, axis=0, return_index=True, return_inverse=True)
    group = group.reshape(-1)
    forest = Forest(fp[first], np.zeros(len(first), np.int64))

    def search(ask: np.ndarray) -> np.ndarray:
        if (label[ask[0] :] == label[ask[0]]).all():
            return np.zeros((len(ask), len(fp)), bool)
        asked, own = np.unique(group[ask], return_inverse=True)
        found = np.zeros((len(asked), len(first)), bool)
        found[np.arange(len(asked)), asked] = True
        for q, v in forest.search(asked, SIMILAR_RADII[-1], True):
            found[np.searchsorted(asked, q), v] = True
        return found[own.reshape(-1)][:, group] & (label[ask][:, None] != label)

    return search


def alike_pairs(sets: list[np.ndarray], label: np.ndarray, near: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions i < j of all sets of different labels whose similarity is enough, counted by products of matrices of members and values.

    Sets are taken in blocks of bounded size, each pair of blocks once. ``near`` says for a block's positions which others are candidates.
    """
    size = np.array([len(x) for x in sets])
    edge = np.flatnonzero(np.diff(np.cumsum(size) // VALUES)) + 1
    blocks = np.split(np.arange(len(sets)), sorted({*edge.tolist(), *range(ROWS, len(sets), ROWS)}))
    a, b = [], []
    for x, left in enumerate(blocks):
        met = near(left) if near and len(left) else None
        for right in blocks[x:]:
            both = left if right is left else np.concatenate([left, right])
            if (label[both] == label[both[0]]).all() or (met is not None and not met[:, right].any()):
                continue
            i, j = _alike_in(sets, size, left, right)
            ok = (label[i] != label[j]) & (i < j)
            if met is not None:
                ok &= met[i - left[0], j]
            a.append(i[ok])
            b.append(j[ok])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def _alike_in(sets: list[np.ndarray], size: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a member of ``left`` and one of ``right`` that are alike."""
    both = left if right is left else np.concatenate([left, right])
    own = np.repeat(np.arange(len(both), dtype=np.int32), size[both])
    value = np.concatenate([sets[k] for k in both.tolist()])
    order = np.argsort(value, kind="stable")
    value, own = value[order], own[order]
    first = np.concatenate([[True], value[1:] != value[:-1]])
    many = np.diff(np.append(np.flatnonzero(first), len(value)))
    shared = np.repeat(many > 1, many)
    column = (np.cumsum(many > 1) - 1).repeat(many)[shared]
    own = own[shared]
    kind = np.float32 if size[both].max(initial=0) < 1 << 20 else np.float64  # so that counts are exact
    common = np.zeros((len(left), len(right)), kind)
    at = 0
    while at < len(column):
        base = int(column[at])
        stop = int(np.searchsorted(column, base + COLUMNS))
        x = np.zeros((len(both), COLUMNS), kind)
        x[own[at:stop], column[at:stop] - base] = 1
        common += x[: len(left)] @ x[-len(right) :].T
        at = stop
    union = size[left][:, None] + size[right][None] - common
    i, j = np.nonzero(common >= SIMILARITY * union - 1e-9 * union)
    return left[i], right[j]


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, node, label, fp0, fp1, h) sorted by shard: links between nodes of different labels that the shard's BK-tree finds near and whose sets are alike."""

    def solve(shard: np.ndarray, node: np.ndarray, label: np.ndarray, fp0: np.ndarray, fp1: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        fp = np.stack([fp0, fp1], axis=1).view(np.uint64)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for s, e in zip(*(x.tolist() for x in _ends(shard)), strict=True):
            names, own, many = np.unique(label[s:e], return_inverse=True, return_counts=True)
            if len(names) > 1:
                order = s + np.argsort(own == many.argmax(), kind="stable")  # the largest group comes last, so nothing is sought for its blocks
                a, b = alike_pairs([np.frombuffer(x, "<u8") for x in h[order]], label[order], near_pairs(fp[order], label[order]))
                found.append((order[a], order[b]))
        a, b = (node[np.concatenate(x)] for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return _shards(batches, solve, ROWS)


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (node, h) are alike by ``SIMILARITY``; a node of many pairs is dealt out by salt."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    hubs = saved(ends.groupBy("node").count().where(F.col("count") > HUB).select("node", F.ceil(F.col("count") / HUB).cast("int").alias("cuts")))
    few = hubs.count() <= BROADCAST_ROWS
    one = F.coalesce("cuts", F.lit(1))

    def with_cuts(rows: DataFrame, key: str) -> DataFrame:
        named = hubs.withColumnRenamed("node", key)
        return rows.join(F.broadcast(named) if few else named, key, "left")

    copies = with_cuts(sets, "node").select("node", "h", F.explode(F.sequence(F.lit(0), one - 1)).alias("salt"))
    rows = pairs
    for key, other, name in (("a", "b", "x"), ("b", "a", "y")):
        rows = with_cuts(rows, key).withColumn("salt", F.pmod(F.xxhash64(other), one).cast("int")).drop("cuts")
        rows = rows.join(copies.select(F.col("node").alias(key), F.col("h").alias(name), "salt"), [key, "salt"]).drop("salt")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2), batch.column(3), strict=True)
            keep = [similarity(*(np.frombuffer(s.as_buffer(), "<u8") for s in xy)) >= SIMILARITY for xy in both]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return rows.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """(doc_id, component_id) of the rows with an id, linked where the runs of five words are alike by 0.8 or more.

    Texts without a word are equal. Rows that repeat a doc_id with other texts link these texts. Ids must be integers.
    """
    texts = docs.select(docs[id_col].cast("long").alias("i"), docs[text_col].alias("t")).where("i is not null")

    def make():
        def work(ids: list, batch: list[str]) -> pa.RecordBatch:
            keys, fps, bands = [], [], []
            for t in batch:
                h = shingles(t)
                fp, band = sketch(h)
                keys.append(xxhash.xxh64_intdigest(h.tobytes(), 1) - (1 << 63))
                fps.append(fp)
                bands.append(band)
            fp = np.array(fps, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(fp[:, 0]), pa.array(fp[:, 1]), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "node", "fp0", "fp1", "bands"])

        return work

    def make_sets():
        def work(ids: list, batch: list[str]) -> pa.RecordBatch:
            sets = [shingles(t).tobytes() for t in batch]
            return pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(h, 1) - (1 << 63) for h in sets], pa.int64()), pa.array(sets, pa.binary())], names=["node", "h"])

        return work

    rows = saved(map_texts(texts, make, "doc_id long, node long, fp0 long, fp1 long, bands array<long>", "i", "t"))
    # ``node`` is a hash of the set of shingles
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp0").alias("fp0"), F.first("fp1").alias("fp1"), F.first("bands").alias("bands"))
    nodes = saved(nodes)
    met = nodes.select("node", "fp0", "fp1", F.posexplode("bands")).select("node", "fp0", "fp1", F.xxhash64("pos", "col").alias("shard"))
    tree = saved(_cut(met, ["fp0", "fp1", "node"], shard).mapInArrow(_candidates, "a long, b long").distinct())
    # each text that has a candidate is in a tree; of equal texts the least id is read
    part = tree.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    read = nodes.join(part, "node", "left_semi").select(F.col("least").alias("i")).distinct()
    sets = map_texts(texts.join(read, "i", "left_semi"), make_sets, "node long, h binary", "i", "t")
    spark = docs.sparkSession
    with arrow_rows(spark, ROWS):
        sets = saved(sets.dropDuplicates(["node"]))
    ties = rows.select("doc_id", "node").distinct()
    ties = ties.join(ties.groupBy("doc_id").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1"), "doc_id").select(F.col("node").alias("a"), "b")
    with arrow_rows(spark, ROWS // 4):
        links = saved(_alike(tree, sets).union(ties))
    found = connected_components(links)
    label = F.coalesce("component", "node").alias("label")
    marked = met.join(part, "node", "left_semi").join(found, "node", "left").select("shard", "node", label, "fp0", "fp1")
    mixed = marked.groupBy("shard").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("shard")
    open_ = marked.join(mixed, "shard", "left_semi").join(sets, "node").select("shard", "node", "label", "fp0", "fp1", "h")
    with arrow_rows(spark, ROWS):
        rest = saved(_cut(open_, ["node"], shard).mapInArrow(_apart, "a long, b long").distinct())
    if not rest.isEmpty():
        found = connected_components(links.union(rest))
    labelled = nodes.join(found, "node", "left").select("node", "least", label)
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labelled.join(least, "label").select("node", "component_id")
    return rows.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find=similar) -> DataFrame:
    """The documents that are the least of their component, with all their columns; rows without an id stay.

    Of rows that share a doc_id none or all stay.
    """
    gone = find(docs, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")
