"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from tessera.llm import neighbours


def _search(spark, rows, kind="float", **extra):
    out: dict = {}
    for r in neighbours.search(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), **extra).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {k: sorted(v) for k, v in out.items()}


def _want(v, q):
    s = v.astype(float) @ v[q].astype(float)
    return [(int(i), s[i]) for i in np.lexsort((np.arange(len(v)), -s)) if i != q][:20]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours(spark, kind):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((300, 12)).astype("f4" if kind == "float" else "f8")
    v[40:60] = v[40]
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)] + [(300, None), (301, [0.0] * 12), (302, [float("nan")] * 12), (303, [1.0] * 3), (None, [1.0] * 12), (304, [None] * 12), (305, [float("inf")] * 12), (306, [])]
    got = _search(spark, rows, kind)
    recall = []
    assert set(got) == set(range(0, 300, 20))
    for q, found in got.items():
        want = _want(v, q)
        assert [f[0] for f in found] == list(range(1, 21))
        recall.append(len({f[1] for f in found} & {w[0] for w in want}) / 20)
        assert all(s == pytest.approx(float(v[i].astype(float) @ v[q].astype(float)), rel=1e-14) for _, i, s in found)
    assert np.mean(recall) >= 0.9


def test_a_lonely_query_gets_twenty_and_crowded_cells_are_split(spark):
    rng = np.random.default_rng(6)
    u = np.eye(16)[3]
    v = (u + 0.01 * rng.standard_normal((3000, 16))).astype("f4")
    v[:10] = -v[:10]
    before = neighbours.CROWD, neighbours.HOT
    try:
        neighbours.CROWD, neighbours.HOT = 100, 1 << 20
        got = _search(spark, [(i, [float(c) for c in x]) for i, x in enumerate(v)], every=100)
    finally:
        neighbours.CROWD, neighbours.HOT = before
    assert set(got) == set(range(0, 3000, 100))
    assert all([f[0] for f in found] == list(range(1, 21)) for found in got.values())
    assert [f[1] for f in got[0]][:9] == [w[0] for w in _want(v, 0)][:9]
    assert np.mean([len({f[1] for f in found} & {w[0] for w in _want(v, q)}) / 20 for q, found in got.items()]) >= 0.9


def test_fewer_rows_than_twenty_and_extra_columns(spark):
    rows = [(i, [float(i % 3), 1.0], i) for i in range(6)] + [(0, [5.0, 5.0], 7), (0, [5.0, 5.0], 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score long").withColumnRenamed("vec_id", "vec_id").selectExpr("*", "1 as id", "2 as cid")
    got = sorted(tuple(r) for r in neighbours.search(frame).collect())
    first = [(s, i) for _, _, i, s in got if s <= 5]
    assert len([r for r in got if r[0] == 0]) == 10 and len(first) >= 5
    assert {r[2] for r in got} == {1, 2, 3, 4, 5}


@pytest.mark.parametrize("n", [3000, 12_000, 120_000])
def test_recall_of_the_hash_by_size(n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 64)).astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = rng.choice(n, 40, replace=False)
    shape = neighbours.Shape(n, 64, 1.0, 1.0)
    assert 10 <= n / shape.cells <= 50
    scores = x[q] @ x.T
    scores[np.arange(40), q] = -9
    top = np.argsort(-scores, 1)[:, :20]
    hit, visits = np.zeros((40, 20), bool), 0
    for t in range(neighbours.TABLES):
        cell = np.concatenate([shape.cell(shape.lifted(x[a : a + 4096].astype(float), False), t) for a in range(0, n, 4096)])
        probed = shape.probed(shape.lifted(x[q].astype(float), True), t)
        assert probed.shape[1] == shape.probes == len(np.unique(probed[0]))
        hit |= (cell[top][:, :, None] == probed[:, None]).any(2)
        visits += np.isin(cell, probed[0]).sum()
    assert hit.mean() >= 0.9
    assert n < 100_000 or visits < 0.5 * n


def test_cells_stay_of_one_size():
    for n in (100, 10**4, 10**5, 10**6, 10**8, 10**10):
        shape = neighbours.Shape(n, 64, 1.0, 1.0)
        assert n / neighbours.CELL / 3 <= shape.cells <= max(4, 3 * n / neighbours.CELL)
        assert shape.probes <= 1 + neighbours.PROBES * shape.cells**0.5
    shape = neighbours.Shape(10**6, 64, 1.0, 1.0)
    x = shape.lifted(np.random.default_rng(1).standard_normal((5, 64)), True)
    every = neighbours.Shape(3000, 64, 1.0, 1.0)
    assert [sorted(r) for r in every.probed(x, 1, every.cells).tolist()] == [list(range(every.cells, 2 * every.cells))] * 5
    assert (shape.probed(x, 0) == shape.cell(x, 0)[:, None]).any(1).all()
