"""What several operators need: tables in the shared folder, joins with hot keys, and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where spark.checkpoint.dir is unset, a machine-local folder is made
    for a session whose tasks all run on this machine; on a cluster that is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        path = context.getConf().get("spark.checkpoint.dir")
        if not path:
            if context.master.split("[")[0] != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            path = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(path)
    return context._jsc.sc().getCheckpointDir().get()


def kept(frame: DataFrame, path: str | None = None) -> DataFrame:
    """``frame`` written as Parquet to a path in the shared folder, and read from there."""
    spark = frame.sparkSession
    path = path or f"{folder(spark)}/kept-{uuid.uuid4()}"
    frame.write.parquet(path)
    trimmed(spark)
    return spark.read.schema(frame.schema).parquet(path)


def trimmed(spark: SparkSession) -> str | None:
    """Gives back to the system what the driver's JVM has freed outside its heap, and the allocator still holds for its
    hundreds of threads: it grows with the number of jobs. None where the JVM has no such command (before 17.0.9, or
    not on glibc)."""
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array

    def array(of, *values):
        out = new(of, len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    lang = jvm.java.lang
    try:
        # the server's own class is not exported, so that its method is taken from the interface
        named = [lang.Class.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(lang.Class, *named))
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = lang.management.ManagementFactory.getPlatformMBeanServer()
        return invoke.invoke(server, array(lang.Object, command, "systemTrimNativeHeap", array(lang.Object), array(lang.String)))
    except Py4JError:
        return None


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of ``kept`` that nothing reads any more."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text behind one part of a packed table, so that a part fits a Python worker.
PART_BYTES = 6 << 20


def parts_for(docs: DataFrame, column: str = "text", each: int = PART_BYTES) -> int:
    """Parts for tables made from all texts: by their bytes, and not fewer than the session's."""
    size = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(parts(docs.sparkSession), -(-size // each))


#: A key with more than one in HOT of a frame's rows is hot, so that there are fewer than HOT of them.
HOT = 256


def hot_keys(frame: DataFrame, key: str) -> list[int]:
    total = frame.count()
    if not total:
        return []
    few = frame.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > total / HOT)
    return [r[0] for r in few.select(key).collect()]


def looked_up(frame: DataFrame, key: str, values: DataFrame, value_key: str) -> DataFrame:
    """Left join of ``frame`` (written before: it is read twice) with ``values``, whose long key is unique and whose
    columns have names of their own. Rows of hot keys meet the at most HOT values broadcast, the others are shuffled."""
    hot = hot_keys(frame, key)
    on = F.col(key) == F.col(value_key)
    if not hot:
        return frame.join(values, on, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = frame.where(is_hot).join(F.broadcast(values.where(F.col(value_key).isin(hot))), on, "left")
    return frame.where(~is_hot).join(values, on, "left").unionByName(few)


#: Bits of a filter for each key, and the most words of 64 bits, so that what is broadcast is bounded: beyond 5.6
#: million keys more rows pass.
KEY_BITS, FILTER_WORDS = 12, 1 << 20


def touched(frame: DataFrame, key: list, keys: DataFrame, its_key: list, holds: bool = True) -> DataFrame:
    """Rows of ``frame`` whose key may be one of ``keys`` (all that are, and few more), or without ``holds`` the others:
    so that a join that only these need leaves the others' texts where they are. ``keys`` (written before: it is read
    twice) sets three bits in a word of 64; words are as many as its rows need at any size of the input."""
    words = min(FILTER_WORDS, max(1, -(-keys.count() * KEY_BITS // 64)))
    word = lambda k: F.pmod(F.xxhash64(*k, F.lit("word")), F.lit(words))
    bit = lambda k, at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(F.xxhash64(*k), at).bitwiseAND(63).cast("int"))
    mask = lambda k: bit(k, 0).bitwiseOR(bit(k, 6)).bitwiseOR(bit(k, 12))
    bits = keys.select(word(its_key).alias("f_word"), mask(its_key).alias("f_bits")).groupBy("f_word").agg(F.bit_or("f_bits").alias("f_bits"))
    own = frame.select("*", word(key).alias("t_word"), mask(key).alias("t_mask")).join(F.broadcast(bits), F.col("t_word") == F.col("f_word"), "left")
    may = F.coalesce(F.col("f_bits").bitwiseAND(F.col("t_mask")) == F.col("t_mask"), F.lit(False))
    return own.where(may if holds else ~may).select(*frame.columns)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of all nodes of the edges but the smallest ones themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low < high
        if not open_.any():
            break
        x, y, low, high = x[open_], y[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while (then := root[root]).tobytes() != root.tobytes():
            root = then
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[leaf], nodes[root[leaf]]


EDGES_AT_ONCE = 1 << 20


def _stars_of_parts(batches):
    """The stars of a part's edges (a, b), at most EDGES_AT_ONCE and a batch of them held at a time."""
    held, n = [], 0

    def flush():
        a, b = (np.concatenate(c) for c in zip(*held, strict=True))
        a, b = stars(a, b)
        for at in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + (1 << 16)]), pa.array(b[at : at + (1 << 16)])], ["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
        if n >= EDGES_AT_ONCE:
            yield from flush()
            held, n = [], 0
    if held:
        yield from flush()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b: long); root is the smallest node of the component.

    Each round turns the edges of every part into stars, first where they lie (so that no larger node has more
    edges than there are parts), then dealt by their larger nodes; then each smaller node that has edges of its
    own is replaced by its smallest neighbour. Smaller nodes may be hubs of any size: ``looked_up`` splits them.
    The rounds end when nothing changes. Each is written to the shared folder, and the one before it deleted.
    Edges that one task may hold (EDGES_AT_ONCE: their number, not the input's) are turned into stars by one, in place
    of rounds of many small jobs, whose records and threads fill the driver.
    """
    spark = edges.sparkSession
    schema = "a long, b long"
    base, before, old = f"{folder(spark)}/components-{uuid.uuid4()}", None, []
    edges = edges.select("a", "b").where("a <> b")
    left = edges.count()
    for k in range(rounds):
        if left <= EDGES_AT_ONCE:
            edges = kept(edges.repartition(1).mapInArrow(_stars_of_parts, schema), f"{base}/{k}")
            for path in old:
                removed(spark, path)
            break
        near = kept(edges.mapInArrow(_stars_of_parts, schema).repartition("a").mapInArrow(_stars_of_parts, schema), f"{base}/{k}-near")
        up = near.groupBy("a").agg(F.min("b").alias("up")).withColumnRenamed("a", "up_a")
        jumped = looked_up(near, "b", up, "up_a")
        # the edge to the smaller node is kept where that node moves on by another of its edges
        edges = kept(jumped.select("a", F.coalesce("up", "b").alias("b")), f"{base}/{k}")
        for path in [*old, f"{base}/{k}-near"]:
            removed(spark, path)
        old = [f"{base}/{k}"]
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, left = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    return edges.selectExpr("a as node", "b as root").unionByName(edges.selectExpr("b as node", "b as root").distinct())
