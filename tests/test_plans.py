"""Queries against the checking engine on the smallest tables, and operators on small cases."""

import hashlib
import math
from decimal import Decimal
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators import decontaminate as dc
from tessera.operators import knn
from tessera.plans import dual, registry

SF = "/root/testdata/sf0.001"


def _value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, (float, Decimal)) else v


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows_as_sql(spark, name):
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    con = duckdb.connect()
    for table in dual.TABLES:
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(registry.ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    rows = sorted(str([_value(r[c]) for c in cols]) for r in got.collect())
    assert rows == sorted(str([_value(r[i]) for i in at]) for r in want.fetchall())


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_ngram_rules(spark):
    long = " ".join(f"word{i}" for i in range(13))
    short = " ".join(str(i) for i in range(9))
    docs = spark.createDataFrame([(1, "x " + long + " y"), (2, short), (3, "one two"), (4, None), (5, "")], "doc_id long, text string")
    evals = spark.createDataFrame([(10, long), (11, short), (12, "one two"), (13, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in dc.ngram_hits(docs, evals).collect()) == [(1, 10), (2, 11)]


def test_jaccard_join_against_brute_force(spark):
    texts = [" ".join(str((i * 7 + k) % (20 + i % 3)) for k in range(12 + i % 5)) for i in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.a, r.b) for r in dc.jaccard_join(frame, frame, 0.5, 2).collect()}

    def s(x):
        w = x.split()
        return {tuple(w[i : i + 2]) for i in range(len(w) - 1)}

    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if len(s(a) & s(b)) >= 0.5 * len(s(a) | s(b)) - 1e-9}
    assert got == want


def test_hash_mod_folds_the_whole_digest(spark):
    assert spark.range(1).select(t.hash_mod(F.lit("ab"), 20).alias("m")).first().m == 19


def _stored(spark, folder, **tables):
    for name, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_all_corrections_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i * 90, int(rng.integers(4)), "ab"[int(rng.integers(2))], [0.5, 1.5, None][int(rng.integers(3))]) for i in range(120)]
    sf = _stored(spark, tmp_path, events=(rows, "event_id long, user_id long, event_type string, value double"))
    want, last = [], {}
    for i, user, kind, value in rows:
        if (user, kind) in last and last[user, kind][1] != value:
            want.append((last[user, kind][0], i, last[user, kind][1], value))
        last[user, kind] = i, value
    assert max(b - a for a, b, *_ in want) > 200
    got = [(r.before_id, r.after_id, r.before_s, r.after_s) for r in registry.QUERIES["jn06_all_corrections"](spark, sf).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stratified_bootstrap_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(8)
    docs = [(i, "", ["en", "de", None][int(rng.integers(3))], [f"s{int(rng.integers(5))}", None][int(i % 9 == 0)], 50) for i in range(90)]
    labels = [(i, int(rng.integers(2)), 0) for i in range(80)]
    sf = _stored(spark, tmp_path, documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"), labels=(labels, "doc_id long, quality int, toxic int"))
    h8 = lambda x: int(hashlib.sha256(x.encode()).hexdigest()[:8], 16)
    right = lambda i, quality, tier: 1 - quality if h8(f"c|{i}|{tier}") % 10 < 3 - tier else quality
    held: dict = {}
    for i, quality, _ in labels:
        held.setdefault(docs[i][2] or "", {}).setdefault(docs[i][3] or "", []).append(right(i, quality, 2) - right(i, quality, 0))
    values = []
    for b in range(10_000):
        drawn = []
        for domain, clusters in held.items():
            order = [clusters[c] for c in sorted(clusters)]
            drawn += [x for slot in range(len(order)) for x in order[h8(f"{b}|{domain}|{slot}") % len(order)]]
        values.append(np.mean(drawn))
    got = registry.QUERIES["st02_stratified_bootstrap"](spark, sf).first()
    assert got.n_valid == 10_000
    assert [float(got.lo), float(got.hi)] == pytest.approx(np.percentile(values, [2.5, 97.5]), abs=2e-6)


def _same_as_sql(spark, name, sf):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"create view {table} as select * from '{sf}/{table}.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, sf)
    rows = sorted(tuple(r[c] for c in sorted(got.columns)) for r in got.collect())
    want = con.sql(registry.ORACLES[name])
    at = [want.columns.index(c) for c in sorted(got.columns)]
    assert rows == sorted(tuple(r[i] for i in at) for r in want.fetchall())
    return {r[:2] for r in rows}


def test_template_and_number_matches(spark, tmp_path):
    words = "anna buys apples and pears for her mother then sells"
    item = words + " 12 of the 40 left"
    docs = [(1, item), (2, item.replace("12", "7.5").replace("40", "3")), (3, item.replace("12", "x").replace("40", "12").replace("x", "40")), (4, "other " + words + " quite 40 and 12"), (5, "one two three four five six seven eight nine ten eleven 12 40"), (6, "12 of the 40 left"), (7, None), (8, words + " 12 12 40")]
    evals = [(10, item), (11, "12 of the 40 left"), (12, None)]
    sf = _stored(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=(evals, "item_id long, text string"))
    assert _same_as_sql(spark, "dc09_template_hits", sf) == {(1, 10), (2, 10), (3, 10)}
    assert _same_as_sql(spark, "dc10_number_hits", sf) == {(1, 10), (3, 10), (4, 10)}


def test_containment_needs_half_of_the_smaller_set(spark, tmp_path):
    w = [f"w{i}" for i in range(27)]  # 20 shingles
    docs = [(1, " ".join(w[:17]) + " a b c d e f g h i j k l m"), (2, " ".join(w[:16]) + " a b c d e f g h i j k l m n o")]
    sf = _stored(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=([(10, " ".join(w))], "item_id long, text string"))
    assert _same_as_sql(spark, "dc21_containment_half", sf) == {(1, 10)}


def test_any_shared_gram_may_be_informative(spark, tmp_path):
    prose = "0 0 0 0 0 0 0 0 0 a1 a1 a1 a1 alpha beta gamma delta epsilon zeta eta theta iota kappa"
    dull = "one one one one two two two two one one one one two two"
    rows = [(1, prose), (2, dull), (3, "nothing")]
    sf = _stored(spark, tmp_path, documents=(rows, "doc_id long, text string"), benchmark=(rows, "item_id long, text string"))
    first = {r.doc_id: r.gram for r in registry.QUERIES["dc05_smallest_gram"](spark, sf).collect()}
    assert set(first) == {1, 2} and len(set(first[1].split())) < 5
    assert {tuple(r) for r in registry.QUERIES["dc22_informative"](spark, sf).collect()} == {(1, 1)}


def test_knn_vote_of_odd_vectors(spark, tmp_path):
    """Copies, zero and null vectors, null labels, against SQL; blocks of few rows."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)], int(rng.integers(3))) for i in range(400)]
    rows += [(i, rows[i % 3][1], int(rng.integers(3))) for i in range(400, 480)]
    rows += [(i, None, 1) for i in (480, 500, 501)] + [(i, [0.0] * 6, 1) for i in (490, 491)] + [(502, [1.0] * 6, None), (550, [1.0] * 6, None), (503, [float("nan")] + [1.0] * 5, 2)]
    sf = _stored(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(registry.ORACLES["rt06_knn_vote"]).fetchall())
    before = knn.BLOCK
    try:
        for size in (before, 7):
            knn.BLOCK = size
            assert sorted((r.q, r.votes) for r in registry.QUERIES["rt06_knn_vote"](spark, sf).collect()) == want
    finally:
        knn.BLOCK = before
