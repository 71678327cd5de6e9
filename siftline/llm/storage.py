"""Shared folders for intermediate tables."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from siftline.sources.staging import shared_dir, written

__all__ = ["bounded_batches", "discard", "released", "shared_dir", "written"]

BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Fewer rows to an Arrow batch than Spark's default: texts are long, and the JVM and Python each hold a batch whole."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop what finished steps have left, now and not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Deletes the files of written tables that nothing will read again."""
    for table in tables:
        for file in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
