"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..storage import checkpoint_dir, saved  # noqa: F401

#: Characters of text that a Python step works on at a time, however large the Arrow batch is.
CHUNK_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(ids: list, texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Runs of rows with at most ``limit`` characters in all, or a single longer text; null becomes empty."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        n = len(text or "")
        if size + n > limit and k > start:
            yield ids[start:k], [t or "" for t in texts[start:k]]
            start, size = k, 0
        size += n
    if start < len(ids):
        yield ids[start:], [t or "" for t in texts[start:]]


def release() -> None:
    """Gives memory that a task has let go of back to the system, as worker processes live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        return


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list, list[str]], pa.RecordBatch | Iterable[pa.RecordBatch]]],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Applies a function of (ids, texts) to bounded runs of rows; ``make`` builds it once in each task.

    Only the two named columns reach Python, so other columns may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for ids, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = work(ids, texts)
                yield from [out] if isinstance(out, pa.RecordBatch) else out
        del work
        release()

    return df.select(df[id_col].alias("k"), df[text_col].alias("t")).mapInArrow(run, schema)


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Lets at most ``n`` rows go to Python at a time, for steps whose rows may be long and that are saved within."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(n, int(before)) if int(before) > 0 else n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame) -> DataFrame:
    """As saved, as a compressed table of the shared folder: for rows with texts."""
    path = f"{checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filter_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], list[bool]]], text_col: str = "text") -> DataFrame:
    """The rows whose text a predicate keeps, with all their columns; ``make`` builds the predicate once in each task."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            start = 0
            for _, texts in chunks([None] * batch.num_rows, batch.column(at).to_pylist()):
                yield batch.slice(start, len(texts)).filter(pa.array(keep(texts), pa.bool_()))
                start += len(texts)
        del keep
        release()

    return df.mapInArrow(run, df.schema)
