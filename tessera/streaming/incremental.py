"""Batch functions for ``writeStream.foreachBatch``. A batch that is run again after a failure writes the same rows to
the same place, so that each row counts once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decontaminate as dc


def contamination(evals: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """Writes doc_id, item_id, gram of each batch's documents that share a 13-gram with an item. No state is needed:
    a document is matched against the fixed table alone."""

    def write(batch: DataFrame, number: int) -> None:
        dc.ngram_hits(batch, evals).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def appended(path: str, *key: str) -> Callable[[DataFrame, int], None]:
    """Appends rows whose key is not in the log yet, one of each key: resumes where an interrupted run stopped."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(list(key))
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
            done = spark.read.option("basePath", path).parquet(path).where(F.col("batch") != number)
            fresh = fresh.join(done.select(*key).distinct(), list(key), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
