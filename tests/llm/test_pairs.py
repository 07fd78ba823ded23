"""All linked pairs against the query's SQL, with small blocks and runs, and what the join shuffles."""

import sys
from fractions import Fraction

import duckdb
import numpy as np
import pytest

import tessera.llm
from tessera.llm import pairs
from tessera.plans import registry

NAME = "jn11_jaccard_documents"


def _texts(rng):
    """Near and exact copies of a few texts, unlike ones, and texts of few words, of other letters and of none."""
    out = []
    for k in range(6):
        base = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(20, 90)))]
        for _ in range(int(rng.integers(3, 12))):
            words = list(base)
            for at in rng.integers(0, len(words), int(rng.integers(0, 3))):
                words[at] = f"x{int(rng.integers(9))}"
            out.append(" ".join(words[: len(words) - int(rng.integers(0, 3))]))
        out += [" ".join(base).upper() + " !"] * (k + 1)
    out += ["one", "one two", "One, two three", "one-two-three", "one two three four", "one two three four ", "one two three", "a b c d e", "a b c d e f"]
    out += ["Straße über naïve Ωmega café 日本 é_1 ٣٤", "STRASSE ÜBER NAÏVE ωMEGA CAFÉ 日本 É_1 ٣٤", "strasse über—naïve ωmega café 日本 é_1 ٣٤", "", None, None, "  ", "\n\t"]
    return out


@pytest.mark.parametrize("block, run", [(pairs.BLOCK, pairs.RUN), (4, 2), (None, None)])
def test_pairs_against_sql(spark, tmp_path, monkeypatch, block, run):
    if block:
        monkeypatch.setattr(pairs, "BLOCK", block)
        monkeypatch.setattr(pairs, "RUN", run)
    else:  # as if the llm subpackage were absent
        monkeypatch.setitem(sys.modules, "tessera.llm.pairs", None)
        monkeypatch.delattr(tessera.llm, "pairs")
    rows = [(i * 7 % 1009, x) for i, x in enumerate(_texts(np.random.default_rng(3)))] + [(None, "one two three")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    con.sql("create table benchmark (item_id bigint, text varchar)")
    want = sorted(con.sql(f"select a, b, overlap from ({registry.ORACLES[NAME]})").fetchall())
    assert len({n for *_, n in want}) > 10
    assert sorted((r.a, r.b, r.overlap) for r in registry.QUERIES[NAME](spark, str(tmp_path)).collect()) == want


@pytest.mark.parametrize("name", ["left", "one"])
def test_overlaps_against_brute_force(name):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 40, int(rng.integers(1, 40)))).astype(np.uint64) for _ in range(80)]
    left, right = (sets, sets) if name == "one" else (sets[:50], sets[50:])
    got = list(zip(*(x.tolist() for x in pairs.overlaps(left, right, Fraction(6, 10))), strict=True))
    both = lambda i, j: len(np.intersect1d(left[i], right[j]))
    want = {(i, j, both(i, j)) for i in range(len(left)) for j in range(len(right)) if (name == "left" or i != j) and 10 * both(i, j) >= 6 * (len(left[i]) + len(right[j]) - both(i, j))}
    assert want and len(got) == len(set(got))
    assert set(got) == want if name == "left" else set(got) | {(j, i, n) for i, j, n in got} == want and 2 * len(got) == len(want)


def _shuffled(spark, after=-1):
    """(bytes written by shuffles of stages after ``after``, the last stage)."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._gateway.jvm.double, 0), None).iterator()
    total, last = 0, after
    while stages.hasNext():
        s = stages.next()
        if s.stageId() > after:
            total += s.shuffleWriteBytes()
        last = max(last, s.stageId())
    return total, last


def test_sets_that_can_not_link_are_not_shuffled(spark, tmp_path):
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 1500)) for _ in range(200)]
    rows = [*enumerate(texts), (200, texts[7]), (201, texts[8] + " more")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    _, last = _shuffled(spark)
    assert [(r.a, r.b) for r in registry.QUERIES[NAME](spark, str(tmp_path)).orderBy("a").collect()] == [(7, 200), (8, 201)]
    # the hashes of all sets are 8 bytes for each shingle
    assert _shuffled(spark, last)[0] < sum(8 * (len(x.split()) - 4) for x in texts) / 2
