"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; where that is unset, as in tests, under a new temporary folder set as such."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        had = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not had.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = had.get() if had.isDefined() else "file://" + tempfile.mkdtemp(prefix="siftline-")
        if not had.isDefined():
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: With it, an execution's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back: lineage ends here and lost executors lose nothing.

    The shuffle files of the write are deleted with it; df itself is not meant to be run again.
    """
    spark = df.sparkSession
    path, had = shared_dir(spark), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if had is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, had)
    return spark.read.schema(df.schema).parquet(path)
