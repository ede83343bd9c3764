"""Rows that are kept in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Spark's option to remove shuffle files at the end of an execution.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; where none is set, one of our own in local mode, which goes at the end, and else an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not shared:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            shared = tempfile.mkdtemp(prefix="checkpoints")
            atexit.register(shutil.rmtree, shared, True)
        sc.setCheckpointDir(shared)
    return shared or sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """The rows computed now and cut from their lineage, in the shared folder, so that a lost executor costs no recomputation.

    What was shuffled for them goes then, and doesn't wait until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # the option holds for plans made while it is on
    finally:
        spark.conf.set(CLEANUP, before)
