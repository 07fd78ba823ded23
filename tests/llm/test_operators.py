"""Operators against brute force, round trips and held-out accuracy on small cases."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import jaccard, katz, media, mixing, neighbours, packing, pii, repeats, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"


def _docs(spark, texts, sources=None):
    rows = [(i, x, "en", (sources or ["a", "b", None])[i % len(sources or "abc")], len(x or ""), 0.5) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(60)]
    out = [" ".join(rng.choice(vocabulary, rng.integers(1, 120))) for _ in range(40)]
    passage = " ".join(rng.choice(vocabulary, 90))
    out += [passage, passage, passage + " tail", "head " + passage, passage.replace("w1 ", "w2 ", 1), None, "", " \t\n", "A b c", "a B c", "x" * 700, "é" * 300]
    return out


def test_jaccard_components(spark, texts):
    def s(x):
        w = (x or "").encode().lower().split()
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()

    sets = [s(x) for x in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    before = jaccard.BLOCK
    try:
        for jaccard.BLOCK in (before, 2):
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(_docs(spark, texts)).collect()}
            assert got == {i: (len(x), root[i]) for i, x in enumerate(sets)}
    finally:
        jaccard.BLOCK = before


def test_derived_answers_find_every_component():
    rng = np.random.default_rng(1)
    base = rng.choice(10_000, 60, replace=False)
    sets = [np.unique(np.where(rng.random(60) < 0.08, rng.integers(0, 10_000, 60), base)).astype(np.uint64) for _ in range(60)]
    links = jaccard.block_links(sets, np.arange(60), Fraction(85, 100))
    want = {frozenset((i, j)) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert {frozenset(x) for x in links} <= want

    def roots(pairs):
        r = list(range(60))
        for _ in range(60):
            for a, b in map(tuple, pairs):
                r[a] = r[b] = min(r[a], r[b])
        return r

    assert roots(links) == roots(want)


def test_repeats_against_brute_force(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(_docs(spark, texts)).collect()}
    raw = [(x or "").encode() for x in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    for i, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        runs = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        assert got[i] == (len(b), gone.sum(), runs, hashlib.sha256(kept).hexdigest())


def test_katz_is_normalised_and_matches_counts(spark, texts):
    got = {r.doc_id: r for r in katz.score_texts(_docs(spark, texts)).collect()}
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    tokens = [[*(x or "").encode().lower().split(), None] for x in texts]
    counts: dict = {}
    for w in (w for t, h in zip(tokens, held, strict=True) if not h for w in t):
        counts[w] = counts.get(w, 0) + 1
    n = sum(counts.values())
    for i, t in enumerate(tokens):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (len(t), sum(w in counts for w in t), n, held[i])
        assert got[i].base_score == pytest.approx(sum(np.log10((counts.get(w, 0) + 1) / (n + len(counts) + 1)) for w in t))
        assert np.isfinite(got[i].score)


def test_media_round_trip(spark, texts):
    rows = media.text_media(_docs(spark, texts)).collect()
    for r in rows:
        b = (texts[r.doc_id] or "").encode()
        payload = b + bytes(-len(b) % 64 if b else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_symbol_and_array_scans_agree(monkeypatch):
    payload = np.random.default_rng(2).integers(0, 256, 64 * 13).astype("u1").tobytes()
    raw = media.pack_payload(payload)
    fast = media.coefficients(raw)
    monkeypatch.setattr(media, "_array_scan", lambda *a: False)
    slow = media.coefficients(raw)
    assert all((a["coef"] == b["coef"]).all() for a, b in zip(fast["components"], slow["components"], strict=True))
    assert media.unpack_payload(slow) == payload


def test_inverse_transform():
    flat = np.zeros((1, 64))
    flat[0, 0] = 80
    assert np.allclose(flat @ media.INVERSE, 10)


def test_mixing(spark, texts):
    rows = mixing.mix_sources(_docs(spark, texts * 5)).collect()
    by: dict = {}
    for r in rows:
        size = len((texts * 5)[r.doc_id].encode().split()) if (texts * 5)[r.doc_id] else 0
        assert r["size"] == size and r.taken in (0, size, 2 * size)
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (size, target), taken in by.items():
        assert target <= 2 * size + 1e-6 and abs(sum(taken) - target) <= 2
    assert sum(t for _, t in by) == pytest.approx(1.5 * sum(s for s, _ in by))


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(60):
        lengths, counts = rng.choice(np.arange(2, 30), 4, replace=False), rng.integers(0, 4, 4)
        budget = int(rng.integers(1, 60))
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + k * int(n) for s in sums for k in range(c + 1)}
        chosen = mixing.knapsack([int(x) for x in lengths], [int(x) for x in counts], budget)
        assert all(a <= b for a, b in zip(chosen, counts, strict=True))
        assert sum(a * int(b) for a, b in zip(chosen, lengths, strict=True)) == max(s for s in sums if s <= budget)


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.vocabulary())
    special = ["<|endoftext|> A.", "A, b. c.. d!? É. it's. ß. x,", "word. ́x"]
    texts = texts + special
    pieces: dict = {}
    for r in packing.pack(_docs(spark, texts)).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for i, x in enumerate(texts):
        ids = np.array(model.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        got = sorted(pieces[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in got) == ids.tobytes()
    rows = sorted((r.sequence_id, r.offset, r.length) for p in pieces.values() for r in p)
    sums: dict = {}
    for s, offset, length in rows:
        assert offset == sums.get(s, 0)
        sums[s] = offset + length
    assert all(n == 4096 or n & (n - 1) == 0 for n in sums.values())


def test_vocabularies_that_cannot_be_read_by_words():
    import glob
    import os

    from tokenizers import Tokenizer

    texts = [x.encode() for x in ("Some Words, here. And  more!\nLine", "", "é ß don't")]
    for path in sorted(glob.glob(os.path.join(os.path.dirname(packing.vocabulary()), "*.json"))):
        try:
            model = Tokenizer.from_file(path)
        except Exception:  # not a vocabulary
            continue
        want = [np.array(model.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert packing.tokenizer(path).ids(texts) == want, path


def test_hilbert_curve_steps_are_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    path = grid[np.argsort(packing.hilbert(grid, 3))]
    assert sorted(packing.hilbert(grid, 3)) == list(range(512))
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_passages_of_nine_words_lie_whole_in_a_window():
    text = " ".join(f"w{i}" for i in range(200)).encode()
    words = toxicity.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    held = [set(w.tolist()) for w in np.asarray(words.windows()[0]).reshape(-1, toxicity.WINDOW)]
    order = words.index.tolist()
    assert all(any(set(order[i : i + 9]) <= h for h in held) for i in range(192))


def test_toxicity_on_held_out_rows():
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(200)]
    made, labels = [], []
    for i in range(500):
        w = list(rng.choice(words, rng.integers(5, 60)))
        if i % 4 == 0:
            w[rng.integers(len(w))] = rng.choice(["vilea", "vileb", "vilec"])
        made.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    net = toxicity.train(made[:400], np.array(labels[:400]))
    score = net.scores(*toxicity._block([*made[400:], "", None]))
    assert ((score[:100] >= 0.3) == np.array(labels[400:], bool)).mean() >= 0.9
    assert ((score >= 0) & (score <= 1)).all()


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.b.COM/en/1?x"), (2, "https://x.example.com/en/77#t"), (3, None), (4, "nothing"), (5, "http://notexample.net/de/"), (6, "http://q.example.net/de/81"), (7, "http://org/es/")], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, urls.rules_frame(spark)).collect()}
    assert got == {
        1: ("a.b.com", "/en/1", "com/en/", "block"), 2: ("x.example.com", "/en/77", "example.com/en/7", "allow"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"),
        5: ("notexample.net", "/de/", "net/de/", "block"), 6: ("q.example.net", "/de/81", "example.net/de/8", "block"), 7: ("org", "/es/", "org/es/", "block"),
    }


def test_empty_tables(spark):
    none = _docs(spark, [])
    for f in (jaccard.link_components, repeats.remove_repeats, katz.score_texts, media.text_media, pii.scan_texts, mixing.mix_sources, packing.pack):
        assert f(none).count() == 0, f
    assert toxicity.score_texts(none, toxicity.train([], np.array([]))).count() == 0
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), urls.rules_frame(spark)).count() == 0


def test_training_is_not_on_the_driver(spark, monkeypatch):
    import os

    def train(texts, labels, rate):
        net = toxicity.Network()
        net.scale = (float(os.getpid()), float(len(texts)))
        return net

    monkeypatch.setattr(toxicity, "train", train)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(8)], "doc_id long, text string")
    net = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int"))
    known = docs.where(~toxicity.held_out(docs.doc_id)).count()
    assert net.scale[0] != os.getpid() and net.scale[1] == known
