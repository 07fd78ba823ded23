"""Writers: cleaned train sets with a report, sorted JSON lines with digests, registries of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def clean_sets(rows: DataFrame, hits: DataFrame, key: str, train_set: str, path: str, complete: bool = True) -> DataFrame:
    """Writes ``clean`` (JSON lines by train set), ``flagged`` (with the methods of their hits) and ``report`` under
    ``path``; returns the report: train set, rows, flagged. ``hits`` holds key and method. If evaluation sets are
    missing (``complete`` is false) nothing but the report is written: an unchecked row is never passed as clean."""
    methods = hits.groupBy(F.col(key).alias("hit_key")).agg(F.array_sort(F.collect_set("method")).alias("methods"))
    judged = rows.join(methods, F.col(key) == F.col("hit_key"), "left").drop("hit_key")
    report = judged.groupBy(train_set).agg(F.count(F.lit(1)).alias("rows"), F.count("methods").alias("flagged"))
    if complete:
        judged.where("methods is null").drop("methods").write.partitionBy(train_set).json(f"{path}/clean")
        judged.where("methods is not null").write.partitionBy(train_set).json(f"{path}/flagged")
    report.write.json(f"{path}/report")
    return rows.sparkSession.read.schema(report.schema).json(f"{path}/report")


def sorted_line(frame: DataFrame) -> Column:
    """A row as JSON with its columns in order of name; nulls are kept."""
    return F.to_json(F.struct(*sorted(frame.columns)), {"ignoreNullFields": "false"})


def sorted_json_lines(frame: DataFrame, path: str, *order: str) -> DataFrame:
    """Writes JSON lines range-sorted by ``order`` (file names sort like the rows) and returns file, sha256 of each file."""
    frame.orderBy(*order).select(sorted_line(frame).alias("value")).write.text(path)
    return digests(frame.sparkSession, path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))


def numbers(spark: SparkSession, values: dict[str, tuple[float | int | None, str]]) -> DataFrame:
    """key, value, source of a registry of numbers: unknown values stay null, and a key is registered once."""
    return spark.createDataFrame([(k, None if v is None else float(v), s) for k, (v, s) in sorted(values.items())], "key string, value double, source string")
