"""Calibrators of scores, one for each group: a group's calibration rows meet in one task, as a fit needs them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-6


def logit(score: Column) -> Column:
    s = F.least(F.greatest(score, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return F.log(s / (1 - s))


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def isotonic_knots(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of score and label of the blocks that pooling leaves; neighbours are pooled only where the level falls."""
    order = np.argsort(x, kind="stable")
    held: list[tuple[float, float, int]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        block = (a, b, 1)
        while held and held[-1][1] * block[2] > block[1] * held[-1][2]:
            before = held.pop()
            block = (before[0] + block[0], before[1] + block[1], before[2] + block[2])
        held.append(block)
    n = np.array([h[2] for h in held], float)
    return np.array([h[0] for h in held]) / n, np.array([h[1] for h in held]) / n


def fit_isotonic(frame: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """group, xs, ys: knots in order."""

    def fit(key, rows: pd.DataFrame) -> pd.DataFrame:
        xs, ys = isotonic_knots(rows["x"].to_numpy(float), rows["y"].to_numpy(float))
        return pd.DataFrame({"g": [key[0]], "xs": [xs], "ys": [ys]})

    rows = frame.select(F.col(group).alias("g"), F.col(score).cast("double").alias("x"), F.col(label).cast("double").alias("y")).na.drop(subset=["x", "y"])
    kind = rows.schema["g"].dataType.simpleString()
    return rows.groupBy("g").applyInPandas(fit, f"g {kind}, xs array<double>, ys array<double>").withColumnRenamed("g", group)


def isotonic(xs: Column, ys: Column, score: Column) -> Column:
    """The level between two knots on the line that joins them, clipped to the first and last; 0.5 without knots."""
    right = F.size(F.filter(xs, lambda x: x <= score)) + 1
    x0, x1 = F.element_at(xs, right - 1), F.element_at(xs, right)
    y0, y1 = F.element_at(ys, right - 1), F.element_at(ys, right)
    inside = y0 + (y1 - y0) * (score - x0) / (x1 - x0)
    return F.when(F.size(xs) == 0, F.lit(0.5)).when(score <= F.element_at(xs, 1), F.element_at(ys, 1)).when(score >= F.element_at(xs, -1), F.element_at(ys, -1)).otherwise(inside)


def platt_fit(z: np.ndarray, y: np.ndarray, ridge: float = 1e-6) -> tuple[float, float]:
    """Slope and offset on the logit of the score, by Newton's method; with one label only, its smoothed rate."""
    if not len(y) or y.min() == y.max():
        m = (y.sum() + 1) / (len(y) + 2)
        return 0.0, float(np.log(m / (1 - m)))
    w = np.array([0.0, np.log(y.mean() / (1 - y.mean()))])
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit_platt(frame: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """group, a, b of ``sigmoid(a * logit(score) + b)``."""

    def fit(key, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = platt_fit(rows["z"].to_numpy(float), rows["y"].to_numpy(float))
        return pd.DataFrame({"g": [key[0]], "a": [a], "b": [b]})

    rows = frame.select(F.col(group).alias("g"), logit(F.col(score)).alias("z"), F.col(label).cast("double").alias("y")).na.drop(subset=["z", "y"])
    kind = rows.schema["g"].dataType.simpleString()
    return rows.groupBy("g").applyInPandas(fit, f"g {kind}, a double, b double").withColumnRenamed("g", group)
