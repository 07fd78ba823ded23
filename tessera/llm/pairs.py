"""All pairs of an exact Jaccard join: the classes, chains and sift of ``jaccard``, then every link of the sets that are
left, with its overlap, and the rows of the linked classes.

Texts are read where they lie; only index lists of prefixes and the sets that may link are shuffled. A component of
many sets is cut into blocks, of which each pair is compared by itself. Copies are linked as members of their class,
whose ids are held in runs: pairs of runs are dealt to tasks before they are spelt out.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import near_sets
from .shared import kept

#: Units of a block (a set is one, and one more for every jaccard.UNIT shingles), and ids of one run of a class.
BLOCK, RUN = 512, 512
_U = np.uint64


def overlaps(left: list[np.ndarray], right: list[np.ndarray], limit: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, overlap) of each left set that links with a right one; of one list, i stands before j in order of size."""
    up, down = limit.numerator, limit.denominator
    size = np.array([len(s) for s in right], np.int64)
    by_size = np.argsort(size, kind="stable")
    place = np.empty(len(right), np.int64)
    place[by_size] = np.arange(len(right))
    size = size[by_size]
    tokens = np.concatenate([right[j] for j in by_size])
    owner = np.repeat(np.arange(len(right)), size)
    rank = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[rank], owner[rank]

    def counted(part: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(tokens, part, "left"), np.searchsorted(tokens, part, "right")
        n = hi - lo
        return np.bincount(owner[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)], minlength=len(right))

    found, before, counts = [], None, None
    # similar sets stand side by side, and a set's counts are derived from those of the set before where few shingles differ
    for i in sorted(range(len(left)), key=lambda i: (int(left[i][0]), len(left[i]))):
        s = left[i]
        if before is not None and len(new := np.setdiff1d(s, before, True)) + len(gone := np.setdiff1d(before, s, True)) < len(s):
            counts = counts + counted(new) - counted(gone)
        else:
            counts = counted(s)
        before = s
        lo, hi = np.searchsorted(down * size, up * len(s), "left"), np.searchsorted(up * size, down * len(s), "right")
        if left is right:
            lo = max(lo, place[i] + 1)
        part = counts[lo:hi]
        hit = np.flatnonzero(down * part >= up * (len(s) + size[lo:hi] - part)) + lo
        if len(hit):
            found.append((np.full(len(hit), i), by_size[hit], counts[hit]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (none, none, none)


def _linked_sets(sets: DataFrame, limit: Fraction) -> DataFrame:
    """a, b, overlap: each pair of ``sets`` (sid, root, m, shingles) that links, once, in no order of a and b."""

    def run(table: pa.Table) -> pa.Table:
        sid, at = np.unique(table.column("sid").to_numpy(), return_index=True)
        own = table.column("own").to_numpy(zero_copy_only=False)[at]
        shingles = [np.frombuffer(x, _U) for x in table.column("shingles").take(pa.array(at)).to_pylist()]
        if table.column("low")[0] == table.column("high")[0]:
            a = b = np.arange(len(sid))
            i, j, n = overlaps(shingles, shingles, limit)
        else:
            a, b = np.flatnonzero(own), np.flatnonzero(~own)
            i, j, n = overlaps([shingles[x] for x in a], [shingles[x] for x in b], limit) if len(a) and len(b) else (np.zeros(0, np.int64),) * 3
        return pa.table({"a": sid[a[i]], "b": sid[b[j]], "overlap": pa.array(n, pa.int32())})

    several = F.expr(f"cast(ceil(m / {BLOCK}) as int)")
    dealt = sets.select("sid", "root", "shingles", several.alias("several")).withColumn("block", F.pmod(F.xxhash64("sid", F.lit("pairs")), F.col("several")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("several") - 1)))
    dealt = dealt.select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "sid", (F.col("block") <= F.col("other")).alias("own"), "shingles")
    return dealt.groupBy("root", "low", "high").applyInArrow(run, "a long, b long, overlap int")


def linked_pairs(docs: DataFrame, size: int, limit: Fraction, least: int = 1, plain=F.col) -> DataFrame:
    """a, b, overlap: the pairs of rows of ``docs`` (doc_id, text) with a < b whose sets link; see ``near_sets``."""
    rows, sets = near_sets(docs, size, limit, least, plain)
    found = kept(_linked_sets(sets, limit))
    rows = rows.where("doc_id is not null and n_shingles > 0").select("doc_id", "sid", "n_shingles")
    # fewer classes than a RUN-th of the rows
    large = rows.groupBy(F.col("sid").alias("l_sid")).agg(F.expr(f"cast(ceil(count(1) / {RUN}) as int)").alias("runs")).where("runs > 1")
    members = rows.join(F.broadcast(large), F.col("sid") == F.col("l_sid"), "left").withColumn("run", F.when(F.col("runs") > 1, F.pmod(F.xxhash64("doc_id"), F.col("runs")).cast("int")))
    members = kept(members.groupBy("sid", "run").agg(F.collect_list("doc_id").alias("ids"), F.min("n_shingles").cast("int").alias("n")))
    side = lambda k: members.select(F.col("sid").alias(f"sid_{k}"), F.col("run").alias(f"run_{k}"), F.col("ids").alias(f"ids_{k}"), F.col("n").alias(f"n_{k}"))
    spelt = lambda pairs, order: pairs.withColumn("x", F.explode("ids_a")).withColumn("y", F.explode("ids_b")).where(order).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "overlap")
    across = found.join(side("a"), F.col("a") == F.col("sid_a")).join(side("b"), F.col("b") == F.col("sid_b")).select("ids_a", "ids_b", "overlap")
    few = members.where("run is null and size(ids) > 1").select(F.col("ids").alias("ids_a"), F.col("ids").alias("ids_b"), F.col("n").alias("overlap"))
    many = side("a").where("run_a is not null").join(side("b").where("run_b is not null"), F.col("sid_a") == F.col("sid_b"))
    one_run = F.col("run_a") == F.col("run_b")
    many = many.where("run_a <= run_b").repartition("sid_a", "run_a", "run_b").select("ids_a", "ids_b", F.col("n_a").alias("overlap"), one_run.alias("one_run"))
    # ids of two runs of a class differ, for a run is told by the id
    return spelt(across, F.expr("x <> y")).unionByName(spelt(few, F.expr("x < y"))).unionByName(spelt(many, F.expr("x < y or (not one_run and x > y)")))
