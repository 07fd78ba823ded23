"""Selective prediction over any frame of scores: thresholds, refusal, Wilson intervals.

Rows are first counted by distinct score (which combines before the shuffle); running counts go over these
counts, and rows themselves are ordered only inside the one group of equal scores that a cut falls into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INF = float("inf")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a share of k in n; null where n is 0."""
    n = F.when(n > 0, n.cast("double"))
    p, d = k / n, 1 + z * z / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / d, (mid + half) / d


def peers(frame: DataFrame, group: str, score: str, correct: str, down: bool = True) -> DataFrame:
    """group, score, n, wrong and their running sums up to and with each distinct score (from the top, or the bottom)."""
    counts = frame.groupBy(group, score).agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col(correct)).alias("wrong"))
    so_far = Window.partitionBy(group).orderBy(F.desc(score) if down else F.asc(score))
    return counts.withColumns({"n_so_far": F.sum("n").over(so_far), "wrong_so_far": F.sum("wrong").over(so_far)})


def choose_threshold(frame: DataFrame, group: str, score: str, correct: str, alpha: float, least: int = 30) -> DataFrame:
    """group, threshold: the lowest score whose prefix has ``least`` rows or more and a risk of ``alpha`` at most;
    equal scores are not split; infinity where none qualifies."""
    good = (F.col("n_so_far") >= least) & (F.col("wrong_so_far") <= alpha * F.col("n_so_far"))
    return peers(frame, group, score, correct).groupBy(group).agg(F.coalesce(F.min(F.when(good, F.col(score))), F.lit(INF)).alias("threshold"))


def taus(frame: DataFrame, group: str, score: str, correct: str, alpha: float = 0.10, precision: float = 0.90, least: int = 20) -> DataFrame:
    """group, tau_hi (smallest t with (wrong + 1) / (n + 1) <= alpha among scores >= t; infinity if none), tau_lo
    (largest t with a share of wrong of ``precision`` or more among scores <= t; minus infinity if none)."""
    hi = (F.col("n_so_far") >= least) & ((F.col("wrong_so_far") + 1) / (F.col("n_so_far") + 1) <= alpha)
    lo = (F.col("n_so_far") >= least) & (F.col("wrong_so_far") / F.col("n_so_far") >= precision)
    top = peers(frame, group, score, correct).groupBy(group).agg(F.coalesce(F.min(F.when(hi, F.col(score))), F.lit(INF)).alias("tau_hi"))
    low = peers(frame, group, score, correct, down=False).groupBy(group).agg(F.coalesce(F.max(F.when(lo, F.col(score))), F.lit(-INF)).alias("tau_lo"))
    return top.join(low, group)


def refusal(frame: DataFrame, group: str, key: str, score: str, correct: str, hard: str, coverage: float) -> DataFrame:
    """group, answered_accuracy, refused_precision (share of wrong rows among the refused; null if none is), hard_recall
    (share of hard rows that are refused). The best ``coverage`` of the rows are answered, half a row to the even
    number, one at least; equal scores go by the key as text."""
    groups = peers(frame, group, score, correct)
    total = groups.groupBy(group).agg(F.sum("n").alias("total")).select(F.col(group).alias("t_group"), F.greatest(F.lit(1), F.bround(F.col("total") * coverage)).cast("long").alias("answers"))
    cut = groups.join(F.broadcast(total), F.col(group) == F.col("t_group")).where((F.col("n_so_far") >= F.col("answers")) & (F.col("n_so_far") - F.col("n") < F.col("answers")))
    cut = cut.select("t_group", F.col(score).alias("t_score"), (F.col("answers") - F.col("n_so_far") + F.col("n")).alias("room"))
    rows = frame.join(F.broadcast(cut), F.col(group) == F.col("t_group"))
    clear = rows.where(F.col(score) != F.col("t_score")).withColumn("answered", F.col(score) > F.col("t_score"))
    torn = rows.where(F.col(score) == F.col("t_score")).withColumn("answered", F.row_number().over(Window.partitionBy(group).orderBy(F.col(key).cast("string"))) <= F.col("room"))
    both = clear.unionByName(torn)
    share = lambda of, where: F.avg(F.when(where, of.cast("double")))
    return both.groupBy(group).agg(
        share(F.col(correct), F.col("answered")).alias("answered_accuracy"),
        share(1 - F.col(correct), ~F.col("answered")).alias("refused_precision"),
        (F.sum(F.when(~F.col("answered"), F.col(hard)).otherwise(0)) / F.greatest(F.lit(1), F.sum(hard))).alias("hard_recall"),
    )
