"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by (source, exact length). Each source's budget, less the whole passes it allows,
is fitted on these counts: a proportional share of every length first, then a bounded-knapsack dynamic
program over the counts that are left for what remains of the budget. Which documents of a length are
taken follows from a seeded hash of their ids. Only tables of lengths meet in one task, never documents:
their number is bounded by the distinct lengths of a source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import kept

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SEED = 17
KNAPSACK = 1 << 16
BUCKET_ROWS = 64
FIT = T.StructType([T.StructField("source", T.StringType()), T.StructField("size", T.LongType()), T.StructField("passes", T.IntegerType()), T.StructField("chosen", T.LongType())])


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null is 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Target of each source: shares of ``share`` times all sizes by weight; what stands above ``most``
    times a source's size is shared out again by weight among the others, until none is above."""
    order = sorted(sizes, key=lambda x: (x[0] is None, [ord(c) for c in x[0] or ""]))
    size = {s: float(n) for s, n in order}
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    total = share * sum(size.values())
    target: dict[str | None, float] = {}
    free = list(size)
    while free:
        left = total - sum(target.values())
        all_weight = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / all_weight > most * size[s]]
        if not over:
            target.update({s: left * weight[s] / all_weight for s in free})
            break
        target.update({s: most * size[s] for s in over})
        free = [s for s in free if s not in target]
    return target


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length reach the largest sum that is at most ``budget`` (bounded subset sums)."""
    mask = (1 << (budget + 1)) - 1
    parts, reached = [], [1]
    for k, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        count, step = min(count, budget // length), 1
        while count > 0:  # binary splitting
            step = min(step, count)
            parts.append((k, step, step * length))
            reached.append((reached[-1] | reached[-1] << (step * length)) & mask)
            count, step = count - step, step * 2
        if reached[-1] >> budget & 1:
            break
    at, chosen = reached[-1].bit_length() - 1, [0] * len(lengths)
    for i in range(len(parts) - 1, -1, -1):
        if not reached[i] >> at & 1:
            k, step, size = parts[i]
            chosen[k] += step
            at -= size
    return chosen


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Numbers chosen of each length so that their words come to ``budget`` or as near below as found."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    chosen = np.array([int(c) * budget // total for c in counts], np.int64)
    left = budget - int((lengths * chosen).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:  # the longest first, until the rest is small enough for the dynamic program
        if left <= KNAPSACK:
            break
        n = min(int(counts[i] - chosen[i]), (left - KNAPSACK) // int(lengths[i]) + 1, left // int(lengths[i]))
        chosen[i] += n
        left -= n * int(lengths[i])
    fits = np.flatnonzero((lengths <= left) & (counts > chosen))
    if len(fits) and left > 0:
        chosen[fits] += knapsack([int(x) for x in lengths[fits]], [int(x) for x in (counts - chosen)[fits]], left)
    return chosen


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[pdf["size"] > 0].sort_values("size", ignore_index=True)
    if pdf.empty:
        return pd.DataFrame({"source": [], "size": [], "passes": [], "chosen": []})
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    total = int((lengths * counts).sum())
    budget = int(pdf["target"].iloc[0])
    passes = min(int(MOST), budget // total)
    return pd.DataFrame({"source": pdf["source"], "size": lengths, "passes": passes, "chosen": fit_counts(lengths, counts, budget - passes * total) if passes < MOST else 0 * counts})


def taken_rows(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them. Rows without words are not taken.

    Only ids, sources and sizes are mixed; the rows meet the outcome by doc_id and a hash of all their columns.
    Rows equal in all columns are as good as each other: they share the sum of what they are taken.
    """
    whole = F.xxhash64(*docs.columns)
    mixed = _mixed(docs, [whole.alias("row_hash")], seed)
    each = kept(mixed.groupBy("doc_id", "row_hash").agg(F.sum("times").cast("int").alias("m_times"), F.count(F.lit(1)).alias("m_rows")).where("m_times > 0").selectExpr("doc_id as m_doc", "row_hash as m_hash", "m_times", "m_rows"))
    on = F.col("doc_id").eqNullSafe(F.col("m_doc")) & (whole == F.col("m_hash"))
    single = docs.join(each.where("m_rows = 1"), on).select(*docs.columns, "m_times")
    several = docs.join(each.where("m_rows > 1"), on).groupBy(*docs.columns, "m_hash").agg(F.max("m_times").alias("m_times")).select(*docs.columns, "m_times")
    out = single.unionByName(several)
    return out.withColumn("m_again", F.explode(F.expr("sequence(1, m_times)"))).select(*docs.columns)


def mix_sources(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source).

    ``taken`` is the size times 0, 1 or 2. Null and empty texts have size 0 and take nothing. A null
    source is a source of its own, last in order. Repeated rows are rows of their own; rows that agree in
    all that is ranked take the earlier places in any order, with the same result. An empty table gives none.
    """
    return _mixed(docs, [], seed).select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"))


def _mixed(docs: DataFrame, carried: list[Column], seed: int) -> DataFrame:
    """doc_id, size, source_size, target, ``carried`` of each row, with how many times it is taken."""
    spark = docs.sparkSession
    # words are counted once; what follows reads this table
    base = kept(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id")).alias("rank"), *carried))
    more = base.columns[4:]
    counted = base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    # one row for each source reaches the driver: the weights need their order by code point
    sizes = [(r.source, int(r.total)) for r in counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total")).collect()]
    target = targets(sizes)
    plan = spark.createDataFrame([(s, n, float(target.get(s, 0.0))) for s, n in sizes], "source string, source_size long, target double")
    sourced = counted.join(F.broadcast(plan), counted.source.eqNullSafe(plan.source)).select(counted.source, "size", "n", "source_size", "target")
    fitted = sourced.select(F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("no_source"), "size", "n", "target")
    fitted = fitted.groupBy("source", "no_source").applyInPandas(lambda key, pdf: _fit(pdf).assign(no_source=bool(key[1])), T.StructType([*FIT.fields, T.StructField("no_source", T.BooleanType())]))
    fitted = fitted.select(F.when(~F.col("no_source"), F.col("source")).alias("f_source"), F.col("size").alias("f_size"), "passes", "chosen")
    classes = sourced.join(fitted, sourced.source.eqNullSafe(fitted.f_source) & (sourced["size"] == fitted.f_size), "left")
    classes = classes.select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), "n", "source_size", "target", F.coalesce("passes", F.lit(0)).alias("passes"), F.coalesce("chosen", F.lit(0)).alias("chosen"))
    # a class is cut into buckets by hash, so that only the one in which its last chosen document lies is ranked
    ranked = base.join(classes, base.source.eqNullSafe(classes.c_source) & (base["size"] == classes.c_size))
    ranked = ranked.withColumn("bucket", F.expr(f"pmod(rank, greatest(1L, n div {BUCKET_ROWS}))")).drop("c_source", "c_size")
    buckets = ranked.groupBy("source", "size", "bucket", "chosen").agg(F.count(F.lit(1)).alias("in_bucket"))
    # running counts in two levels: no window holds more than a block of a class's buckets
    block = F.expr("bucket div 256")
    blocks = buckets.groupBy("source", "size", block.alias("block")).agg(F.sum("in_bucket").alias("in_block"))
    blocks = blocks.selectExpr("source as k_source", "size as k_size", "block as k_block", "sum(in_block) over (partition by source, size order by block) - in_block as before_block")
    buckets = buckets.withColumn("block", block)
    buckets = buckets.join(blocks, F.col("source").eqNullSafe(F.col("k_source")) & (F.col("size") == F.col("k_size")) & (F.col("block") == F.col("k_block")))
    buckets = buckets.selectExpr("source as b_source", "size as b_size", "bucket as b_bucket", "in_bucket", "before_block + sum(in_bucket) over (partition by source, size, block order by bucket) - in_bucket as before")
    ranked = ranked.join(buckets, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("bucket") == F.col("b_bucket")))
    room = F.col("chosen") - F.col("before")
    ranked = ranked.withColumn("place", F.when(room <= 0, F.lit(0)).when(room >= F.col("in_bucket"), F.lit(1)))
    sure = ranked.where("place is not null").withColumn("more", F.col("place"))
    torn = ranked.where("place is null").withColumn("order", F.expr(f"row_number() over (partition by source, size, bucket order by {', '.join(['rank', 'doc_id', *more])})"))
    torn = torn.withColumn("more", (F.col("order") <= room).cast("int")).drop("order")
    return sure.unionByName(torn).select("doc_id", "size", "source_size", "target", (F.when(F.col("size") > 0, F.col("passes") + F.col("more")).otherwise(0)).alias("times"), *more)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
