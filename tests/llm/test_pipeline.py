"""Each stage of the pipeline, and the whole, against plain Python on a small table with repeated ids and nulls."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import mixing, packing, pii, toxicity

COLUMNS = corpus_pipeline.COLUMNS


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(400):
        w = list(rng.choice(words, int(rng.integers(8, 90))))
        bad = i % 5 == 0
        if bad:
            w[int(rng.integers(len(w)))] = str(rng.choice(["vilea", "vileb", "vilec"]))
        text = " ".join(w)
        rows.append((i, text, "en", ["a", "b", None][i % 3], len(text)))
        labels.append((i, int(rng.integers(2)), int(bad)))
        if i % 7 == 1 and len(w) > 40:
            w[-1] = "changed"
            rows.append((1000 + i, " ".join(w), "de", "b", len(" ".join(w))))
    rows += [rows[3], (3, "another text under a known id", "en", "a", 29), (500, "mail me at a.b@example.com or 10.0.0.7 today please", "en", "a", 50)]
    rows += [(600, None, None, None, None), (601, "", "en", "a", 0), (None, "a row without id is kept as it is", "en", "b", 33)]
    folder = str(tmp_path_factory.mktemp("tables"))
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, ddl).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*labels, (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def _key(r):
    return tuple(r[c] for c in COLUMNS)


def _documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_drop_toxic(spark, sf):
    docs = _documents(spark, sf)
    net = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [_key(r) for r in docs.collect()]
    score = [float(net.scores(*toxicity._block([r[1]]))[0]) for r in rows]
    got = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert got.columns == COLUMNS
    assert Counter(map(_key, got.collect())) == Counter(r for r, s in zip(rows, score, strict=True) if s < toxicity.CUT)
    for r in toxicity.score_texts(docs.where("doc_id < 400"), net).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3)
        near = [s for x, s in zip(rows, score, strict=True) if x[0] == r.doc_id]
        assert min(abs(r.score - s) for s in near) < 1e-5
    held = [(r, s) for r, s in zip(rows, score, strict=True) if r[0] is not None and r[0] < 400 and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([(s >= 0.3) == ("vile" in r[1]) for r, s in held]) >= 0.8


def test_one_of_near_copies(spark, sf):
    docs = _documents(spark, sf)
    rows = [_key(r) for r in docs.collect()]

    def shingles(x):
        w = (x or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()

    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in range(5):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and rows[i][0] is not None and rows[j][0] is not None and 10 * len(a & b) >= 8 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    want = Counter()
    for c in set(root):
        members = [r for r, k in zip(rows, root, strict=True) if k == c]
        want[min(members, key=lambda r: (r[0] is None, r[0]))] += 1
    assert Counter(map(_key, corpus_pipeline.one_of_near_copies(spark, docs, sf).collect())) == want


def test_redact_personal_data(spark, sf):
    docs, judge = _documents(spark, sf), pii.trained()
    want = Counter()
    for r in map(_key, docs.collect()):
        text = r[1]
        for kind, a, b in reversed(pii.find_spans(text, judge) if text else []):
            text = f"{text[:a]}<{kind.upper()}>{text[b:]}"
        want[(r[0], text, r[2], r[3], r[4] if text == r[1] else len(text))] += 1
    got = Counter(map(_key, corpus_pipeline.redact_personal_data(spark, docs, sf).collect()))
    assert got == want and any("<EMAIL>" in (r[1] or "") for r in got)


def test_mix_sources(spark, sf):
    docs = _documents(spark, sf)
    rows = [_key(r) for r in docs.collect()]
    got = Counter(map(_key, corpus_pipeline.mix_sources(spark, docs, sf).collect()))
    assert set(got) <= set(rows)
    assert all(n <= 2 * rows.count(r) and r[1] for r, n in got.items())
    size = lambda r: len((r[1] or "").split())
    totals: dict = {}
    for r in rows:
        totals[r[3]] = totals.get(r[3], 0) + size(r)
    target = mixing.targets(list(totals.items()))
    for source in totals:
        assert abs(sum(n * size(r) for r, n in got.items() if r[3] == source) - target[source]) <= 8
    taken = Counter()
    for r in mixing.mix_sources(docs).collect():
        taken[r.doc_id] += r.taken
    per_id = Counter()
    for r, n in got.items():
        per_id[r[0]] += n * size(r)
    assert +taken == +per_id


def test_the_whole(spark, sf):
    docs = _documents(spark, sf)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.select(*COLUMNS).schema)
    model = Tokenizer.from_file(packing.vocabulary())
    want = Counter((r.doc_id, np.array([*model.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in docs.collect())
    got = corpus_pipeline.run(spark, sf).collect()
    assert sum(r.length for r in got) == sum(n * (len(x) // 4) for (_, x), n in want.items())
    whole = Counter()
    for (doc, _), n in want.items():
        whole[doc] += n
    assert Counter(r.doc_id for r in got if r.start == 0) == whole
    for r in got:
        assert any(x[4 * r.start : 4 * (r.start + r.length)] == bytes(r.ids) for (doc, x) in want if doc == r.doc_id)
    places: dict = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096
