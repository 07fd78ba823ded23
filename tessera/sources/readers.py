"""Readers: JSON lines, JSON arrays, Arrow IPC shards, described datasets, run logs and text folders.

All are lazy DataFrames over Spark's own file listing, but for what must be known before a plan can be made
(a schema, a description of datasets) and for the check of a strict log.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

SPLITS = ("train", "test", "validation", "val", "dev")
CHUNK_LINES, CHUNK_CHARS = 40, 40


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A row for each line that is not blank. A damaged line is an error; without ``schema`` all lines are read once to infer it."""
    if schema is None:
        schema = spark.read.json(path).schema
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema if isinstance(schema, str) else schema.json(), {"mode": "FAILFAST"}).alias("row")).select("row.*")


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of files that each hold an array of objects, or one object whose only column ``data`` is such an array."""
    frame = spark.read.json(path, multiLine=True)
    if frame.columns == ["data"] and isinstance(frame.schema["data"].dataType, T.ArrayType):
        return frame.select(F.explode("data").alias("row")).select("row.*")
    return frame


def split_of(path: str) -> str | None:
    """The split that a shard's name, or else its folder's, spells out; two of them in one name are an error."""
    for part in reversed(path.rstrip("/").split("/")[-2:]):
        found = {w for w in re.split(r"[^a-z]+", part.lower()) if w in SPLITS}
        if len(found) > 1:
            raise ValueError(f"ambiguous split: {path}")
        if found:
            return found.pop()
    return None


def _open(raw: bytes):
    try:
        return pa.ipc.open_file(raw)
    except pa.ArrowInvalid:
        return pa.ipc.open_stream(raw)


def _batches(raw: bytes):
    reader = _open(raw)
    if isinstance(reader, pa.RecordBatchFileReader):
        yield from (reader.get_batch(k) for k in range(reader.num_record_batches))
    else:
        yield from reader


def arrow_shards(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Rows of Arrow IPC files or streams under ``path``, one shard a task; ``split`` keeps the shards of that split."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if split is not None:
        names = [r.path for r in files.select("path").collect()]  # one row for each shard
        files = files.where(F.col("path").isin([n for n in names if split_of(n) == split]))

    def schemas(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_open(x).schema.serialize().to_pybytes() for x in batch.column(0).to_pylist()], pa.binary())], ["schema"])

    first = files.select("content").mapInArrow(schemas, "schema binary").first()
    if first is None:
        raise FileNotFoundError(f"no shard of split {split} under {path}")
    schema = pa.ipc.read_schema(pa.py_buffer(bytes(first.schema)))

    def rows(batches):
        for batch in batches:
            for raw in batch.column(0):
                for part in _batches(raw.as_py()):
                    yield part.cast(schema)

    return files.select("content").mapInArrow(rows, from_arrow_schema(schema))


READERS = {"jsonl": json_lines, "json": json_rows, "parquet": lambda spark, path: spark.read.parquet(path), "arrow": arrow_shards}


def described(spark: SparkSession, path: str) -> DataFrame:
    """All datasets of a description (JSON lines: dataset, path relative to the description, format, role), by name of
    column, each row with its ``dataset`` and ``role``. The number of reads is that of the lines."""
    base, out = path.rsplit("/", 1)[0], None
    for r in json_lines(spark, path, "dataset string, path string, format string, role string").collect():
        if r.format not in READERS:
            raise ValueError(f"unknown format of {r.dataset}: {r.format}")
        frame = READERS[r.format](spark, r.path if "/" in r.path[:1] or "://" in r.path else f"{base}/{r.path}")
        frame = frame.withColumns({"dataset": F.lit(r.dataset), "role": F.lit(r.role)})
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no dataset in {path}")
    return out


def _log_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, at (sorts like the lines of a file), line, ok of all lines that are not blank."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.trim("value").alias("line"))
    kind = F.schema_of_variant(F.try_parse_json("line"))
    return lines.where("line <> ''").select("file", F.struct("block", "id").alias("at"), "line", F.coalesce(kind.startswith("OBJECT"), F.lit(False)).alias("ok"))


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """file, at, line of each log file's records up to its first line that is no JSON object."""
    lines = _log_lines(spark, path)
    bad = lines.where(~F.col("ok")).groupBy(F.col("file").alias("bad_file")).agg(F.min("at").alias("bad_at"))
    return lines.join(bad, F.col("file") == F.col("bad_file"), "left").where("bad_at is null or at < bad_at").select("file", "at", "line")


def strict_run_log(spark: SparkSession, path: str) -> DataFrame:
    """file, at, line of each log file's records. A torn last line is dropped; damage before it is an error."""
    lines = _log_lines(spark, path)
    last = lines.groupBy(F.col("file").alias("last_file")).agg(F.max("at").alias("last_at"))
    broken = lines.where(~F.col("ok")).join(last, F.col("file") == F.col("last_file")).where("at < last_at").select("file").first()
    if broken:
        raise ValueError(f"damaged record inside {broken.file}")
    return lines.where("ok").select("file", "at", "line")


def text_chunks(frame: DataFrame, key: str, text: str) -> DataFrame:
    """key, chunk (from 0), chunk_text, chunk_id: runs of 40 lines that are longer than 40 characters when stripped."""
    lines = F.split(F.col(text), "\n")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / CHUNK_LINES).cast("int")), lambda i: F.array_join(F.slice("lines", i * CHUNK_LINES + 1, CHUNK_LINES), "\n"))
    out = frame.where(F.col(text).isNotNull()).select(F.col(key), lines.alias("lines")).select(key, F.posexplode(runs).alias("chunk", "chunk_text"))
    out = out.where(F.length(F.trim("chunk_text")) > CHUNK_CHARS)
    return out.withColumn("chunk_id", F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.col("chunk").cast("string"), "chunk_text"), 256))
