"""The thin queries of the operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, line_dedup, pii, sentencepiece_bpe, simhash, substring_dedup, suffix_dedup, toxicity, warc_audit
from .common import table

TOKENIZER = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.components(table(spark, sf_dir, "documents")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_bpe.digest(sentencepiece_bpe.encode_decode(docs, tokenizer_path()))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    primary = warc_audit.records(pages)
    replica = warc_audit.replica(pages)
    return warc_audit.fixity(primary, replica)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.drop_boilerplate(table(spark, sf_dir, "documents")))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup(table(spark, sf_dir, "documents")))


def op9_superkmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.dedup(table(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.digest(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_simhash, op2_pii, op3_decontam, op4_multi_index, op5_sentencepiece, op6_warc, op7_line_dedup, op8_suffix_array, op9_superkmer, op10_toxicity)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontam": decontam.oracle(), "op6_warc": warc_audit.oracle(), "op7_line_dedup": line_dedup.oracle(), "op9_superkmer": substring_dedup.oracle()}
