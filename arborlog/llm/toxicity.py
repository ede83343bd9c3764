"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer turns the words of a clause into classes: insult, threat verb, intent, target, negation,
report, or other. Weighted transducers for reported speech, negation, targets and threats each rewrite classes that stand within their
reach; an arc's weight fades towards 1 with the distance. Two of them read a clause from its end, for what follows ("..., he said",
"kill yourself"); their composition and that of the others (two deterministic machines, built once) read each clause that
has an insult or a threat. What comes out is summed by class, and a logistic model turns the sums into
a score, so an insult that is negated or reported counts by a weight of its own.

Insults are learnt: words and word beginnings that toxic training documents have and others lack, with their
log-odds as weights. The other lists are small and fixed. Training looks at ``FIT_ROWS`` labelled rows at
most (those of least hash), none of them held out; nothing but the text enters a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import chunks, filter_texts, map_texts, saved

#: Labelled rows that the lexicon and the model are fitted on, at most.
FIT_ROWS = 20_000
THRESHOLD = 0.3
#: Lengths of word beginnings, and the least share of toxic texts among those that have an entry.
SKETCH = 4
STEMS = (4, 5, 6, 7, 8, 9)
PURITY = 0.6
#: That any word of the sample gets in by chance.
CHANCE = 0.05
#: Words after which a negation, report, target or intent no longer reaches, and the weight of what it rewrites next to it; by each word's distance the weight fades by FADE.
REACH = {"negation": (3, 0.9), "report": (6, 0.9), "target": (4, 1.1), "intent": (4, 1.2), "told": (3, 0.9), "aimed": (3, 1.1)}
FADE = 0.8
OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT = "other", "insult", "threat verb", "intent", "target", "negation", "report"
CLASSES = [OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT]
#: Fixed lists, in English, French, German and Spanish.
WORDS = {
    NEGATION: "not no never isn't aren't wasn't don't doesn't didn't without ne pas jamais sans nicht kein keine keinen nie ohne nunca jamás sin",
    REPORT: "said says say called calls wrote writes quoted quote allegedly reportedly dit disait écrit appelle sagte sagt schrieb nannte angeblich dijo dice escribió llamó",
    TARGET: "you your you're u he she they him her them tu vous toi ils du dich ihr euch sie ihn ustedes usted vosotros él ella ellos yourself yourselves himself herself themselves",
    THREAT: "kill killing hurt destroy murder beat burn shoot stab tuer frapper détruire brûler töten umbringen schlagen zerstören verbrennen matar golpear destruir quemar",
    INTENT: "will want wanna hope must going gonna i'll we'll shall vais allons va werde werden wird voy vamos iré",
}
CLASS = {w: c for c, words in WORDS.items() for w in words.split()}
CLAUSE = re.compile(r"[.!?;\n\r]+")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: What the composed machine may put out, and the weight that each has before any label is seen.
OUTPUTS = {"insult": 1.0, "targeted": 1.2, "negated": 0.3, "reported": 0.4, "threat": 1.5, "reported threat": 0.5, "aimed": 0.2}
PRIOR = [y for x in OUTPUTS.values() for y in (x, 0.0)]


class Transducer:
    """Deterministic, letter to letter: (state, symbol) to (state, output, factor); symbols without an arc pass and lead to ``rest``."""

    def __init__(self, arcs: dict, rest: dict, start=0):
        self.arcs, self.rest, self.start = arcs, rest, start

    def step(self, state, symbol):
        found = self.arcs.get((state, symbol))
        return found if found else (self.rest.get(state, state), symbol, 1.0)

    def compose(self, after: Transducer, alphabet: list[str]) -> Transducer:
        """The machine that passes what this one puts out to ``after``."""
        arcs, todo, seen = {}, [(self.start, after.start)], {(self.start, after.start)}
        while todo:
            pair = todo.pop()
            for symbol in alphabet:
                a, mid, f = self.step(pair[0], symbol)
                b, out, g = after.step(pair[1], mid)
                arcs[(pair, symbol)] = ((a, b), out, f * g)
                if (a, b) not in seen:
                    seen.add((a, b))
                    todo.append((a, b))
        return Transducer(arcs, {}, (self.start, after.start))


def within(trigger: str, reach: int, rewrite: dict[str, str], weight: float = 1.0) -> Transducer:
    """Rewrites classes that come at most ``reach`` words after a trigger; state = words left."""
    arcs, rest = {}, {0: 0}
    for left in range(reach + 1):
        arcs[(left, trigger)] = (reach, trigger, 1.0)
        rest[left] = max(0, left - 1)
        if left:
            for symbol, out in rewrite.items():
                arcs[(left, symbol)] = (left - 1, out, 1 + (weight - 1) * FADE ** (reach - left))
    return Transducer(arcs, rest)


def renamed(names: dict[str, str]) -> Transducer:
    return Transducer({(0, symbol): (0, out, 1.0) for symbol, out in names.items()}, {})


def rules() -> tuple[list[Transducer], list[Transducer]]:
    """What reads a clause from its end, and what then reads it from its beginning, in order."""
    told = within(REPORT, REACH["told"][0], {INSULT: "insult told", THREAT: "threat told"}, REACH["told"][1])
    aimed = within(TARGET, REACH["aimed"][0], {THREAT: "threat aimed"}, REACH["aimed"][1])
    threats = within(INTENT, REACH["intent"][0], {THREAT: "threat made", "threat aimed": "threat made"}, REACH["intent"][1])
    targets = within(TARGET, REACH["target"][0], {INSULT: "targeted"}, REACH["target"][1])
    negations = within(NEGATION, REACH["negation"][0], {INSULT: "negated", "targeted": "negated", "threat made": OTHER, "threat aimed": OTHER}, REACH["negation"][1])
    reports = within(REPORT, REACH["report"][0], {INSULT: "reported", "targeted": "reported", "threat made": "reported threat", "threat aimed": OTHER}, REACH["report"][1])
    last = renamed({"threat made": "threat", "threat aimed": "aimed", "insult told": "reported", "threat told": "reported threat"})
    return [told, aimed], [threats, targets, negations, reports, last]


def composed(machines: list[Transducer], alphabet: list[str]) -> Transducer:
    out = machines[0]
    for more in machines[1:]:
        out = out.compose(more, alphabet)
    return out.compose(Transducer({}, {}), alphabet)


@lru_cache(maxsize=1)
def grammar() -> tuple[Transducer, Transducer]:
    behind, ahead = rules()
    return composed(behind, CLASSES), composed(ahead, [*CLASSES, "insult told", "threat told", "threat aimed"])


def read(symbols: list[str]) -> list[tuple[str, float]]:
    """(output, weight) of each symbol of a clause."""
    behind, ahead = grammar()
    back, state = [], behind.start
    for symbol in reversed(symbols):
        state, out, factor = behind.step(state, symbol)
        back.append((out, factor))
    found, state = [], ahead.start
    for symbol, before in reversed(back):
        state, out, factor = ahead.step(state, symbol)
        found.append((out, before * factor))
    return found


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """By output, the summed weights of what the grammar finds in the clauses of a text: their logarithm and, up to a bound, themselves."""
    sums = dict.fromkeys(OUTPUTS, 0.0)
    low = text.lower()
    words = set(WORD.findall(low))
    hits = {}
    for w in words:
        if w in lexicon:
            hits[w] = lexicon[w]
        else:
            for n in STEMS[::-1]:
                if len(w) > n and (x := lexicon.get(w[:n] + "*")):
                    hits[w] = x
                    break
        if CLASS.get(w) == THREAT:
            hits.setdefault(w, 0.0)
    if hits:
        for clause in CLAUSE.split(low):
            found = WORD.findall(clause)
            if hits.keys().isdisjoint(found):
                continue
            weights = [hits.get(w) for w in found]
            for weight, (out, factor) in zip(weights, read([INSULT if x else CLASS.get(w, OTHER) for w, x in zip(found, weights, strict=True)]), strict=True):
                if out in sums:
                    sums[out] += factor * (weight or 5.0)
    return [y for x in sums.values() for y in (math.log1p(x), min(x, 40.0) / 10)]


def sketch(text: str) -> list[int]:
    """Least hashes of a text's runs of three words, by which copies are known."""
    words = text.encode("utf-8", "surrogatepass").split()
    runs = {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    return [min(xxhash.xxh64_intdigest(r, seed) for r in runs) >> 1 for seed in range(SKETCH)]


def one_of_each(sketches: list[tuple[int, ...]]) -> list[int]:
    """Positions of rows that share less than half of their least hashes with rows before: a text that was copied often is evidence once."""
    seen, kept = set(), []
    for k, hashes in enumerate(sketches):
        own = set(enumerate(hashes))
        if 2 * len(seen & own) < len(hashes):
            kept.append(k)
        seen |= own
    return kept


def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (label, text): words and word beginnings with the number of toxic and other texts that have them."""
    for batch in rows:
        for labels, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got = [Counter(), Counter()]
            for label, text in zip(labels, texts, strict=True):
                words = set(WORD.findall(text.lower()))
                got[int(bool(label))].update(words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n})
            every = list(got[0].keys() | got[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([got[1][w] for w in every], pa.int64()), pa.array([got[0][w] for w in every], pa.int64())], names=["w", "pos", "neg"])


def evidence(pos: float, neg: float, share: float) -> float:
    """By how much (in nats) a share of toxic texts so high is more than chance."""
    n = pos + neg
    k = pos / n if n else 0.0
    if k <= share:
        return 0.0
    return n * (k * math.log(k / share) + ((1 - k) * math.log((1 - k) / (1 - share)) if k < 1 else 0.0))


def tried(sizes: list[tuple[int, int]], share: float) -> int:
    """How many words count as tried (Tarone 1990), of (texts with a word, such words): those in so few texts that even all toxic ones would be chance don't."""
    left = sum(n for _, n in sizes)
    for texts, n in sorted(sizes):
        if texts * math.log(1 / share) >= math.log(max(2, left) / CHANCE):
            break
        left -= n
    return left


def chosen(rows: list[tuple[str, int, int]], n_pos: int, n_neg: int, n_tried: int) -> dict[str, float]:
    """The lexicon from (word or beginning, toxic texts with it, others), of which so many count as tried.

    A share of toxic texts must be so high that chance would not give it to any of the words. A beginning stands
    for its words where what it adds to the best of its continuations is toxic as well; else the continuations stand.
    """
    share, least = n_pos / (n_pos + n_neg), math.log(max(2, n_tried) / CHANCE)
    table = {w: (pos, neg) for w, pos, neg in rows}
    below: dict[str, list[str]] = {}
    for w in table:
        stem = w.rstrip("*")
        top = len(stem) - 1 if w.endswith("*") else len(stem)
        up = next((stem[:n] + "*" for n in range(min(top, STEMS[-1]), STEMS[0] - 1, -1) if stem[:n] + "*" in table and stem[:n] + "*" != w), "")
        below.setdefault(up, []).append(w)

    def good(pos: int, neg: int, most: float) -> bool:
        return pos >= PURITY * (pos + neg) and evidence(pos, neg, share) >= most

    def pick(w: str) -> list[str]:
        kids = below.get(w, [])
        found = [x for k in kids for x in pick(k)]
        if not good(*table[w], least):
            return found
        if not found:
            return [w]
        pos, neg = table[w]
        best = max(found, key=lambda x: evidence(*table[x], share))
        more = (pos - table[best][0], neg - table[best][1])
        return [w] if len(found) > 1 and evidence(pos, neg, share) > evidence(*table[best], share) and good(*more, least / 2) else found

    return {x: math.log((table[x][0] + 0.5) / (n_pos + 1)) - math.log((table[x][1] + 0.5) / (n_neg + 1)) for w in below.get("", []) for x in pick(w)}


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Weights of least loss plus the squared distance from ``prior``, by Newton's method; the first column is the intercept."""
    w = prior.copy()
    hold = np.full(len(w), strength)
    hold[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + hold * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Scorer:
    def __init__(self, lexicon: dict[str, float], weights: list[float]):
        self.lexicon, self.weights = lexicon, np.array(weights)

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(len(texts), len(PRIOR))
        z = self.weights[0] + x @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def df_of(spark: SparkSession, values: set, field: StructField) -> DataFrame:
    return spark.createDataFrame([(v,) for v in sorted(values)], StructType([field]))


def is_held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def held_out(col: Column) -> Column:
    return F.crc32(col.cast("string")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Scorer:
    """Learns from labelled rows that aren't held out. Without labels of both kinds, every score is that of the share of toxic rows (0.05 if there is none)."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.max(label_col).alias("y"))
    sample = marks.orderBy(F.xxhash64(id_col), id_col).limit(fit_rows).select(F.col(id_col).alias("i"), "y")
    rows = saved(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(sample), "i").select("i", "y", "t"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([sketch(t) for t in texts], pa.list_(pa.int64()))], names=["i", "s"])

    # bounded by fit_rows, as is all else that is collected here
    drawn = sorted(tuple(r) for r in rows.select("i", "t").mapInArrow(sketched, f"i {rows.schema['i'].dataType.simpleString()}, s array<long>").collect())
    kept = {drawn[k][0] for k in one_of_each([x[1] for x in drawn])}
    at = df_of(docs.sparkSession, kept, rows.schema["i"])
    rows = rows.join(F.broadcast(at), "i").select("y", "t")
    sizes = {bool(r.y): r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sum(n for y, n in sizes.items() if y), sum(n for y, n in sizes.items() if not y)
    share = n_pos / (n_pos + n_neg) if n_pos + n_neg else 0.05
    if not n_pos or not n_neg:
        p = min(max(share, 1e-4), 1 - 1e-4)
        return Scorer({}, [math.log(p / (1 - p)), *PRIOR])
    words = saved(rows.mapInArrow(counted, "w string, pos long, neg long").groupBy("w").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    # words that can be in the lexicon; as many rows as words of the sample at most, which is bounded
    sizes_of = [tuple(r) for r in words.groupBy((F.col("pos") + F.col("neg")).alias("n")).count().collect()]
    lexicon = chosen([tuple(r) for r in words.where(F.col("pos") >= PURITY * (F.col("pos") + F.col("neg"))).collect()], n_pos, n_neg, tried(sizes_of, share))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ys, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([int(bool(y)) for y in ys], pa.int32()), pa.array([features(t, lexicon) for t in texts], pa.list_(pa.float64()))], names=["y", "x"])

    seen = rows.mapInArrow(turn, "y int, x array<double>").groupBy("y", "x").count().collect()
    y = np.array([r.y for r in seen], float)
    x = np.array([[1.0, *r.x] for r in seen])
    many = np.array([r["count"] for r in seen])
    w = logistic(np.repeat(x, many, axis=0), np.repeat(y, many), np.array([math.log(share / (1 - share)), *PRIOR]))
    return Scorer(lexicon, w.tolist())


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): one row for each row of ``docs``; null and empty texts get the score of a text without any match."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def work(ids: list, texts: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sent.value.scores(texts), pa.float64())], names=["doc_id", "score"])

        return work

    return map_texts(docs, make, f"doc_id {kind}, score double", id_col, text_col)


def keep_clean(docs: DataFrame, scorer: Scorer, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    return filter_texts(docs, lambda: lambda texts: (sent.value.scores(texts) < threshold).tolist(), text_col)


def digest(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
