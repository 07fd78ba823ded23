"""Components and the near-copy join against brute force."""

import sys
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard, shared

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, class string"


def _roots(n, pairs):
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            return root
    return root


def test_linked_sets_share_a_prefix_shingle():
    rng = np.random.default_rng(1)
    for limit in (Fraction(85, 100), Fraction(8, 10)):
        linked = 0
        for _ in range(1000):
            n = int(rng.integers(1, 300))
            pool = rng.permutation(2 * n + 50)
            gone, new = rng.integers(0, n // 4 + 1, 2).tolist()
            a, b = np.sort(pool[:n]), np.sort(pool[gone : n + new])
            if n - gone >= limit * (n + new):
                linked += 1
                assert len(np.intersect1d(a[: jaccard.prefix(len(a), limit)], b[: jaccard.prefix(len(b), limit)]))
        assert linked > 100


def test_stars():
    rng = np.random.default_rng(2)
    for n in (1, 5, 60):
        e = rng.integers(0, 80, (n, 2))
        node, root = shared.stars(e[:, 0], e[:, 1])
        want = _roots(80, e.tolist())
        assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {i: r for i, r in enumerate(want) if i != r}
    assert len(shared.stars(np.zeros(0, int), np.zeros(0, int))[0]) == 0


@pytest.mark.parametrize("hub", [0, 500, 999])
def test_components_of_hubs_chains_and_random_edges(spark, hub):
    rng = np.random.default_rng(hub)
    edges = [(hub, i) for i in range(0, 1000, 3)] + [(i, i + 3) for i in range(1, 400, 3)] + rng.integers(400, 700, (150, 2)).tolist() + [(7, 7)]
    want = _roots(1000, edges)
    got = {r.node: r.root for r in shared.components(spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a long, b long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {i: want[i] for i in touched}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("at_once", [0, 400])
def test_components_of_more_edges_than_a_task_holds(spark, monkeypatch, at_once):
    monkeypatch.setattr(shared, "EDGES_AT_ONCE", at_once)
    rng = np.random.default_rng(9)
    edges = [(3, i) for i in range(0, 1000, 3)] + [(i, i + 3) for i in range(1, 400, 3)] + rng.integers(400, 700, (150, 2)).tolist()
    want = _roots(1000, edges)
    got = shared.components(spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in got) == [(i, want[i]) for i in sorted({x for a, b in edges if a != b for x in (a, b)})]


def test_few_edges_need_few_jobs(spark):
    """The driver keeps a record of each job, and a thread for each shuffle."""
    edges = shared.kept(spark.range(2000).selectExpr("id as a", "id + 1 as b"))
    context = spark.sparkContext
    context.setJobGroup("few-edges", "components")
    try:
        found = shared.components(edges)
        assert len(context.statusTracker().getJobIdsForGroup("few-edges")) <= 6
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert {(r.node, r.root) for r in found.collect()} == {(i, 0) for i in range(2001)}


def test_freed_native_memory_is_given_back(spark):
    """By the JVMs that have the command; others answer nothing, and harm nothing."""
    server = spark.sparkContext._jvm.java.lang.Runtime.version()
    said = shared.trimmed(spark)
    assert "rim native heap" in said if sys.platform == "linux" and (server.feature() > 17 or server.feature() == 17 and server.update() >= 9) else said is None or "rim" in said


def test_hot_keys_are_looked_up(spark):
    rows = shared.kept(spark.createDataFrame([(k, i) for i, k in enumerate([1] * 600 + list(range(2, 300)) + [None] * 5)], "k long, i long"))
    values = spark.createDataFrame([(k, -k) for k in range(0, 250)], "v_k long, v long")
    got = shared.looked_up(rows, "k", values, "v_k").collect()
    assert shared.hot_keys(rows, "k") == [1]
    assert len(got) == rows.count() and all(r.v == (-r.k if r.k is not None and r.k < 250 else None) for r in got)


def test_one_of_each_loses_no_text(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(25):
        base = list(rng.choice(words, int(rng.integers(3, 80))))
        for j in range(int(rng.integers(1, 5))):
            near = list(base)
            if j and len(near) > 40:
                near[int(rng.integers(len(near)))] = "changed"
            rows.append((int(rng.integers(0, 40)), " ".join(near), "en", f"s{j}", j, None))
    rows += [(1, "a b c d e f g h", "en", "x", 1, None), (1, "totally other words stand here for once", "de", "x", 1, "c"), (2, "a b c d e f g h", "en", "x", 1, None)]
    rows += [(3, "repeated row with six words", "en", "y", 2, None)] * 3 + [(3, "repeated row with six words", "en", "x", 2, None)]
    rows += [(4, "", "en", "x", 0, None), (4, None, None, None, None, None), (4, " \n", "en", "x", 2, None), (None, "a b c d e f g h", "en", "x", 1, None), (None, None, None, None, None, None)]
    got = sorted((tuple(r) for r in jaccard.one_of_each(spark.createDataFrame(rows, COLUMNS)).collect()), key=repr)

    def shingles(x):
        w = (x or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()

    sets = [shingles(r[1]) for r in rows]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and rows[i][0] is not None and rows[j][0] is not None and 10 * len(a & b) >= 8 * len(a | b)]
    root = _roots(len(rows), links)
    classes: dict = {}
    for i, r in enumerate(rows):
        classes.setdefault(root[i], []).append(r)
    assert len(got) == len(classes)
    left = list(got)
    for members in classes.values():
        lowest = [m for m in members if m[0] == min((x[0] for x in members if x[0] is not None), default=None)]
        stays = [x for x in left if x in lowest]
        assert stays
        left.remove(stays[0])
    assert (3, "repeated row with six words", "en", "x", 2, None) in got


def test_large_components_in_small_blocks(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(12):
        base = list(rng.choice(words, 100))
        for _ in range(15):
            near = list(base)
            for k in rng.integers(0, 100, 2):
                near[k] = str(rng.choice(words))
            texts.append(" ".join(near))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(w[i : i + 4]) for i in range(97)} for w in (x.split() for x in texts)]
    want = _roots(len(texts), [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])])
    before = jaccard.BLOCK
    try:
        for jaccard.BLOCK in (before, 4):
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(docs).collect()}
            assert got == {i: (len(sets[i]), want[i]) for i in range(len(texts))}
    finally:
        jaccard.BLOCK = before


def test_touched_keeps_all_rows_with_a_key_and_few_more(spark):
    frame = spark.range(20_000).selectExpr("id", "id as text")
    keys = shared.kept(spark.range(0, 20_000, 8).selectExpr("id as k"))
    got = {r.id for r in shared.touched(frame, [F.col("id")], keys, [F.col("k")]).collect()}
    rest = {r.id for r in shared.touched(frame, [F.col("id")], keys, [F.col("k")], holds=False).collect()}
    assert got >= set(range(0, 20_000, 8)) and len(got) < 3500
    assert got | rest == set(range(20_000)) and not got & rest


@pytest.mark.parametrize("limit", [Fraction(85, 100), Fraction(8, 10)])
def test_chained_sets_are_sifted_without_loss(spark, limit):
    """One chain component of sets that share half of their shingles, some of which link."""
    rng = np.random.default_rng(7)
    passage = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    sets = []
    for i in range(120):
        own = np.unique(np.concatenate([passage[: (n := int(rng.integers(2, 1200)))], rng.integers(0, 2**63, n, dtype=np.uint64)]))
        sets.append(own)
        if i % 3 == 0:
            sets.append(np.unique(np.concatenate([own[: len(own) - len(own) // 15], rng.integers(0, 2**63, len(own) // 20, dtype=np.uint64)])))
    sets = [x << np.uint64(1) for x in sets]
    n = np.array([len(x) for x in sets])
    marks = jaccard.marks_of(np.concatenate(sets), n)
    frame = spark.createDataFrame([(0, i, int(k), bytearray(m)) for i, (k, m) in enumerate(zip(n, marks, strict=True))], "root long, sid long, n long, marks binary")
    root = {r.node: r.root for r in jaccard._sifted(frame, limit).collect()}
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(x := np.intersect1d(sets[i], sets[j])) >= limit * (n[i] + n[j] - len(x))]
    assert len(links) > 20
    assert all(i in root and root[i] == root[j] for i, j in links)
    assert len(root) < len(sets) - 40


def test_blocks_of_a_large_chain_component_are_sifted(spark, monkeypatch):
    """One component of one size, dealt to blocks: sets that share three fourths of their shingles do not stay."""
    monkeypatch.setattr(jaccard, "SIFTED", 24)
    rng = np.random.default_rng(8)
    passage = rng.integers(0, 2**63, 750, dtype=np.uint64)
    sets = [np.unique(np.concatenate([passage, rng.integers(0, 2**63, 250, dtype=np.uint64)])) for _ in range(80)]
    sets += [np.unique(np.concatenate([x[:970], rng.integers(0, 2**63, 20, dtype=np.uint64)])) for x in sets[:10]]
    n = np.array([len(x) for x in sets])
    marks = jaccard.marks_of(np.concatenate(sets), n)
    frame = spark.createDataFrame([(0, i, int(k), bytearray(m)) for i, (k, m) in enumerate(zip(n, marks, strict=True))], "root long, sid long, n long, marks binary")
    root = {r.node: r.root for r in jaccard._sifted(frame, Fraction(8, 10)).collect()}
    assert root == {i: i % 80 for i in [*range(10), *range(80, 90)]}
