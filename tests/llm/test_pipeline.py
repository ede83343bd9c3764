"""The pipeline against plain versions of its stages."""

import hashlib
import random
import zlib

import pytest

import corpus_pipeline
from arborlog.llm import queries
from tests.llm.test_operators import brute_hits, words


def test_stages(spark, tmp_path):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=queries.tokenizer_path())
    rng = random.Random(9)
    leak = words(14, 77)
    rows = []
    for i in range(200):
        text = words(rng.randint(40, 90), 1000 + i)
        if i % 8 == 0:
            text += " you vile fool and vile clown"
        rows.append([i, "Site header\n" + text, "en", f"src{i % 2}", 0])
    rows[11][1] = rows[10 - 1][1]  # an exact copy, whose first is 9
    rows[21][1] += "\n" + leak
    bench = [(0, "start " + leak), (1, "short one")]
    for r in rows:
        r[4] = len(r[1])
    labels = [(i, 1, int(i % 8 == 0)) for i in range(200)]
    at = str(tmp_path)
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")

    kept, seen = {}, set()
    for i, text, *_ in rows:
        if i % 8 == 0:
            continue
        text = text.removeprefix("Site header\n")
        if text in seen:
            continue
        seen.add(text)
        if not brute_hits(bench, text)[1]:
            kept[i] = text
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, at).collect()}
    assert set(got) == set(kept) and 11 not in got and 21 not in got
    for i, text in kept.items():
        ids = sp.encode(text, add_eos=True)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in kept) > 0  # held-out rows are among them

    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), at).count() == 0


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, near copies and columns with names of the operators' own."""
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=queries.tokenizer_path())
    at, long = str(tmp_path), words(20_000, 3)
    near = words(200, 4).split()
    rows = [(1, None), (2, ""), (3, "  "), (4, long), (5, long + " end"), (6, " ".join(near)), (7, " ".join([*near[:-3], "other", "words", "here"])), (8, " ".join(near[:100])), (9, "one line of text"), (9, "one line of text"), (None, "no id")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, label string, shard string"
    spark.createDataFrame([(i, t, "en", None if i == 9 else f"src{i}", len(t or ""), "k", "r", "l", "s") for i, t in rows], schema).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, at).columns == docs.columns
    got = sorted((str(r.doc_id), r.n_tokens) for r in corpus_pipeline.run(spark, at).collect())
    want = {"1": "", "4": long, "6": rows[5][1], "8": rows[7][1], "None": "no id"}
    assert got == sorted([*((i, len(sp.encode(t, add_eos=True))) for i, t in want.items()), *2 * [("9", len(sp.encode("one line of text", add_eos=True)))]])


def test_near_copies_by_similarity(spark):
    """Of pairs of each band of similarity, the share that is found; and that what goes is like what it goes for."""
    from arborlog.llm import simhash

    rng = random.Random(5)
    texts, pairs = {}, []
    for k in range(240):
        base = words(150, 5000 + k).split()
        other = list(base)
        for _ in range(rng.randint(0, 6)):
            other[rng.randrange(150)] = f"x{rng.random()}"
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join(other)
        pairs.append((simhash.similarity(*(simhash.shingles(texts[2 * k + i]) for i in (0, 1))), 2 * k))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar(df).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        band = [k for s, k in pairs if low <= s < high]
        assert len(band) > 5 and all(got[k + 1] == k for k in band), (low, high)
    assert all(got[k + 1] == k + 1 for s, k in pairs if s < 0.8)
