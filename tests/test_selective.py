"""Thresholds, tests and calibrators against plain Python; chained logs; incremental forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import calibration, inference, logs, selective
from tessera.streaming import incremental


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(7)
    rows = [(g, i, round(float(rng.random()), 1 if g == "ties" else 3), int(rng.random() < 0.7), int(rng.integers(2))) for g in ("ties", "fine", "few") for i in range(7 if g == "few" else 200)]
    return rows, spark.createDataFrame(rows, "g string, id long, p double, y long, hard long")


def test_thresholds(scores):
    rows, frame = scores
    got = {r.g: r.threshold for r in selective.choose_threshold(frame, "g", "p", "y", 0.28).collect()}
    taus = {r.g: (r.tau_hi, r.tau_lo) for r in selective.taus(frame, "g", "p", "y", alpha=0.3, precision=0.35).collect()}
    for g in ("ties", "fine", "few"):
        mine = [(p, y) for h, _, p, y, _ in rows if h == g]
        ok = [t for t in {p for p, _ in mine} if len(s := [y for p, y in mine if p >= t]) >= 30 and s.count(0) <= 0.28 * len(s)]
        assert got[g] == min(ok, default=math.inf)
        hi = [t for t in {p for p, _ in mine} if len(s := [y for p, y in mine if p >= t]) >= 20 and (s.count(0) + 1) / (len(s) + 1) <= 0.3]
        lo = [t for t in {p for p, _ in mine} if len(s := [y for p, y in mine if p <= t]) >= 20 and s.count(0) / len(s) >= 0.35]
        assert taus[g] == (min(hi, default=math.inf), max(lo, default=-math.inf))
    assert got["few"] == math.inf


@pytest.mark.parametrize("coverage", [0.0, 0.5, 0.8, 0.9, 1.0])
def test_refusal(scores, coverage):
    rows, frame = scores
    got = {r.g: r for r in selective.refusal(frame, "g", "id", "p", "y", "hard", coverage).collect()}
    for g in got:
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], str(r[1])))
        n = max(1, round(coverage * len(order)))
        assert got[g].answered_accuracy == pytest.approx(np.mean([r[3] for r in order[:n]]))
        assert got[g].refused_precision == (pytest.approx(np.mean([1 - r[3] for r in order[n:]])) if order[n:] else None)
        assert got[g].hard_recall == pytest.approx(sum(r[4] for r in order[n:]) / max(1, sum(r[4] for r in order)))


def test_exact_tests(spark):
    pairs = [(0, 0), (1, 0), (0, 1), (5, 2), (2, 5), (20, 0), (700, 650), (3000, 10)]
    rows = spark.createDataFrame(pairs, "b long, c long").select("b", "c", *(inference.mcnemar(F.col("b"), F.col("c"), a).alias(a.replace("-", "_")) for a in ("two-sided", "greater", "less"))).collect()
    for r in rows:
        n = r.b + r.c
        cdf = lambda k: sum(math.comb(n, i) for i in range(k + 1)) / 2**n if k >= 0 else 0.0  # noqa: E731, B023
        assert r.two_sided == pytest.approx(min(1, 2 * cdf(min(r.b, r.c))) if n else 1, abs=1e-9)
        assert r.greater == pytest.approx(1 - cdf(r.b - 1) if n else 1, abs=1e-9)
        assert r.less == pytest.approx(min(1, cdf(r.b)) if n else 1, abs=1e-9)
    k = spark.createDataFrame([(0, 0), (0, 5), (3, 10), (10, 10), (-1, 4)], "k long, n long").select("k", "n", inference.binomial_cdf(F.col("k"), F.col("n"), 0.1).alias("v")).collect()
    for r in k:
        assert r.v == pytest.approx(sum(math.comb(r.n, i) * 0.1**i * 0.9 ** (r.n - i) for i in range(r.k + 1)))


def test_one_sided_p_and_power(spark):
    draws = spark.createDataFrame([("a", x) for x in (0.1, -0.2, 0.3, float("nan"), None, -0.4)] + [("b", 1.0)], "g string, v double")
    assert {r.g: r.p for r in inference.one_sided_p(draws, "g", "v", 0.0).collect()} == {"a": 3 / 5, "b": 1.0}
    assert {r.g: r.p for r in inference.one_sided_p(draws, "g", "v", 0.0, below=False).collect()} == {"a": 3 / 5, "b": 0.5}
    n, p10, p01, alpha = 12, 0.4, 0.1, 0.05
    want = 0.0
    for b in range(n + 1):
        for c in range(n + 1 - b):
            d = b + c
            p = sum(math.comb(d, x) for x in range(b, d + 1)) / 2**d if d else 1
            if p <= alpha:
                want += math.factorial(n) / math.factorial(b) / math.factorial(c) / math.factorial(n - d) * p10**b * p01**c * (1 - p10 - p01) ** (n - d)
    assert inference.mcnemar_power(n, p10, p01, alpha) == pytest.approx(want)


def test_certificate_stops_at_the_first_failure(spark):
    rows = [("all", 0.99, 1)] * 60 + [("mid", 0.96, 1)] * 60 + [("mid", 0.91, 0)] * 20 + [("mid", 0.86, 1)] * 2000 + [("none", 0.5, 1)] * 100
    got = {r.g: r.certified for r in inference.certify(spark.createDataFrame(rows, "g string, p double, y long"), "g", "p", "y").collect()}
    assert got == {"all": 0.85, "mid": 0.925, "none": None}


def test_isotonic(spark):
    rng = np.random.default_rng(3)
    x, y = np.round(rng.random(60), 2), rng.integers(0, 2, 60).astype(float)
    xs, ys = calibration.isotonic_knots(x, y)
    assert (np.diff(ys) >= 0).all()
    order = np.argsort(x, kind="stable")
    # the least-squares level of each row, by the largest lower mean
    s = y[order]
    want = [max(min(s[i : j + 1].mean() for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    sizes = [want.count(v) for v in sorted(set(want))]
    assert sorted(set(np.round(want, 9))) == sorted(set(np.round(ys, 9))) and sum(sizes) == 60
    frame = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("h", 0.5, 1.0), ("h", None, 1.0)], "g string, p double, y double")
    fit = calibration.fit_isotonic(frame, "g", "p", "y")
    asked = spark.createDataFrame([("g", v) for v in (-1.0, 0.1, 0.37, 0.9, 2.0)] + [("h", 0.2)], "g string, p double")
    got = {(r.g, r.p): r.v for r in asked.join(fit, "g").select("g", "p", calibration.isotonic(F.col("xs"), F.col("ys"), F.col("p")).alias("v")).collect()}
    assert got[("h", 0.2)] == 1.0
    for (g, p), v in got.items():
        if g == "g" and len(set(xs)) == len(xs):
            assert v == pytest.approx(np.interp(p, xs, ys))


def test_platt(spark):
    rng = np.random.default_rng(4)
    p = rng.random(400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(1.5 * np.log(p / (1 - p)) - 0.5)))).astype(float)
    frame = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(p, y, strict=True)] + [("one", 0.3, 1.0)] * 3, "g string, p double, y double")
    got = {r.g: (r.a, r.b) for r in calibration.fit_platt(frame, "g", "p", "y").collect()}
    assert got["one"] == (0.0, pytest.approx(math.log(4)))
    a, b = got["g"]
    z = np.log(p / (1 - p))
    q = 1 / (1 + np.exp(-(a * z + b)))
    assert abs(((q - y) * z).sum()) < 1e-3 and abs((q - y).sum()) < 1e-3
    back = spark.createDataFrame([(v,) for v in (0.0, 0.2, 1.0)], "v double").select("v", calibration.sigmoid(calibration.logit(F.col("v"))).alias("w")).collect()
    assert all(r.w == pytest.approx(min(max(r.v, 1e-6), 1 - 1e-6)) for r in back)


def test_chains(spark):
    frame = spark.createDataFrame([(c, i, f"{c}-{i}") for c in range(3) for i in range(20)], "c long, i long, body string")
    written = logs.chained(frame, "c", "i", "body")
    assert logs.verify_chain(written, "c", "i", "body").count() == 0
    damaged = written.where("not (c = 1 and i = 7)").withColumn("body", F.when(F.expr("c = 2 and i = 3"), "other").otherwise(F.col("body")))
    assert sorted(tuple(r) for r in logs.verify_chain(damaged, "c", "i", "body").collect()) == [(1, 8, True, False), (2, 3, False, True)]
    assert spark.range(1).select(F.lit(2).alias("b"), F.lit(None).cast("string").alias("a")).select(logs.canonical("b", "a").alias("j")).first().j == '{"a":null,"b":2}'


def test_incremental_forms(spark, tmp_path):
    gram = " ".join(f"word{i}" for i in range(13))
    evals = spark.createDataFrame([(7, gram)], "item_id long, text string").cache()
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "x " + gram), (2, "clean"), (2, "again")], "doc_id long, text string").write.parquet(source)
    stream = lambda: spark.readStream.schema("doc_id long, text string").parquet(source)

    def drain(write, name):
        query = stream().writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()

    hits, log = str(tmp_path / "hits"), str(tmp_path / "log")
    drain(incremental.contamination(evals, hits), "c1")
    drain(incremental.appended(log, "doc_id"), "c2")
    spark.createDataFrame([(2, "late"), (3, gram + " y")], "doc_id long, text string").write.mode("append").parquet(source)
    drain(incremental.contamination(evals, hits), "c1")
    drain(incremental.appended(log, "doc_id"), "c2")
    assert sorted((r.doc_id, r.item_id) for r in spark.read.parquet(hits).collect()) == [(1, 7), (3, 7)]
    assert sorted(r.doc_id for r in spark.read.parquet(log).collect()) == [1, 2, 3]
    again = spark.read.parquet(source)
    incremental.appended(log, "doc_id")(again, 1)
    assert sorted(r.doc_id for r in spark.read.parquet(log).collect()) == [1, 2, 3]
