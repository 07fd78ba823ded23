"""Exact tests and certificates as column expressions, and their powers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selective import INF

#: The fixed sequence of thresholds, the risk that is certified and the error that is allowed.
THRESHOLDS, ALPHA, DELTA = (0.95, 0.925, 0.90, 0.875, 0.85), 0.10, 0.10


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of n draws with chance p: terms are made from each other in logarithms, so that none underflows alone."""
    step = math.log(p) - math.log1p(-p)
    start = F.struct((n * math.log1p(-p)).cast("double").alias("log"), F.lit(0.0).alias("sum"))
    each = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.greatest(k, F.lit(0)).cast("long")), start,
        lambda s, i: F.struct((s["log"] + F.log(F.greatest((n - i) / (i + 1), F.lit(1e-300))) + step).alias("log"), (s["sum"] + F.exp(s["log"])).alias("sum")),
        lambda s: F.least(F.lit(1.0), s["sum"]),
    )
    return F.when(k < 0, F.lit(0.0)).when(k >= n, F.lit(1.0)).otherwise(each)


def mcnemar(b: Column, c: Column, alternative: str = "two-sided") -> Column:
    """Exact p of discordant counts; 1 where there are none. ``greater`` tests b > c, ``less`` b < c."""
    n = b + c
    if alternative == "greater":
        p = 1 - binomial_cdf(b - 1, n, 0.5)
    elif alternative == "less":
        p = binomial_cdf(b, n, 0.5)
    else:
        p = 2 * binomial_cdf(F.least(b, c), n, 0.5)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), p))


def one_sided_p(draws: DataFrame, group: str, value: str, null: float, below: bool = True) -> DataFrame:
    """group, p = (1 + draws on the wrong side of ``null``) / (draws + 1); draws that are no number are left out."""
    v = F.col(value)
    some = draws.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < INF))
    return some.groupBy(group).agg(((1 + F.count_if(v >= null if below else v <= null)) / (F.count(F.lit(1)) + 1)).alias("p"))


def certify(frame: DataFrame, group: str, score: str, correct: str) -> DataFrame:
    """group, certified: the last threshold of the sequence before the first that fails (null if the first does): one
    fails without rows, or where so few errors would not be rare at a risk of ALPHA. One aggregate for all of them."""
    counts = []
    for k, t in enumerate(THRESHOLDS):
        counts += [F.count_if(F.col(score) >= t).alias(f"n{k}"), F.count_if((F.col(score) >= t) & (F.col(correct) == 0)).alias(f"e{k}")]
    frame, last, open_ = frame.groupBy(group).agg(*counts), F.lit(None).cast("double"), F.lit(True)
    for k, t in enumerate(THRESHOLDS):
        n, e = F.col(f"n{k}"), F.col(f"e{k}")
        open_ = open_ & (n > 0) & (binomial_cdf(e, n, ALPHA) <= DELTA)
        last = F.when(open_, F.lit(t)).otherwise(last)
    return frame.select(group, last.alias("certified"))


def _pmf(k: int, n: int, p: float) -> float:
    if p <= 0 or p >= 1:
        return float(k == (n if p >= 1 else 0))
    return math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))


def mcnemar_power(n: int, gained: float, lost: float, alpha: float) -> float:
    """Chance that the one-sided exact test at ``alpha`` rejects when each of n pairs is discordant with these chances."""
    either, power = gained + lost, 0.0
    for d in range(1, n + 1):
        weight = _pmf(d, n, either)
        tail, least = 0.0, d + 1
        while least > 0 and tail + _pmf(least - 1, d, 0.5) <= alpha:
            least -= 1
            tail += _pmf(least, d, 0.5)
        power += weight * sum(_pmf(x, d, gained / either) for x in range(least, d + 1))
    return power
