"""A corpus-cleaning pipeline made of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents, of whatever names. An empty table stays empty; a null text counts as an empty one and stays null;
rows that repeat are as many afterwards, or none; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborlog.llm import decontam, line_dedup, sentencepiece_bpe, simhash, toxicity
from arborlog.llm.common import stored, table
from arborlog.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; null and empty texts stay. Without labels nothing is learnt and nothing goes."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are on too many pages of their source go; every document stays, be its text empty afterwards, and so does the text of one without a source."""
    return line_dedup.clean(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (runs of five words, similarity 0.8 or more; found by fingerprints in BK-trees, then counted) the least doc_id stays; texts without words are copies of one another, rows without an id stay."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row with a benchmark item go; null and empty texts stay, and all where there is no benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts and what they decode to, as digests; a null or empty text has the end id alone."""
    return sentencepiece_bpe.digest(sentencepiece_bpe.encode_decode(docs, tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash", drop_near_copies),
    ("decontam", drop_contaminated),
    ("sentencepiece", encode),
]

#: SQL has neither the fingerprints nor the tokenizer; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
