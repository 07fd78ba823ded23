"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is cut into overlapping windows of ``WINDOW`` words, ``STRIDE`` apart, up to its end; every window
is scored. A word enters as a learned word vector (hashed), the mean of learned vectors of its character
trigrams (hashed), its smoothed log-odds in the training rows, and the highest log-odds of its runs of
five bytes (hashed). A text's score is a logistic of its highest window, calibrated on a fourth of the
sample that the network was not trained on. Empty texts are scored as one window of padding.

Training uses at most ``SAMPLE`` labelled rows of at most ``SAMPLE_CHARS`` characters (of each label those
with the smallest hashes of their ids, at most half of them toxic), in one task. A toxic text trains the windows that the network itself
finds most toxic (first those of the highest log-odds); a text that is not trains its windows at random.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb

WINDOW, STRIDE, HIDDEN = 16, 8, 8
WORD_SLOTS, WORD_DIM, CHAR_SLOTS, CHAR_DIM = 1 << 14, 4, 1 << 12, 4
INPUT = WORD_DIM + CHAR_DIM + 2
GRAM_SLOTS = 1 << 18
SAMPLE, SAMPLE_CHARS, CUT = 6000, 20_000, 0.3
BATCH_WINDOWS = 4096
LEAST_STEPS = 64
_F = np.float32


def held_out(doc_id: Column, divisor: int = 4, remainder: int = 2) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(divisor)) == remainder


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Words:
    """Words of a block of texts: distinct words with their slots, character trigrams and log-odds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        start, end, self.counts = tb.words(data, offsets)
        hashes = tb.word_hashes(data, start, end)
        self.index, self.hash = pd.factorize(hashes)
        first = np.empty(len(self.hash), np.int64)
        first[self.index[::-1]] = np.arange(len(hashes))[::-1]
        self.slot = (self.hash % np.uint64(WORD_SLOTS)).astype(np.int64)
        # characters: bytes of each distinct word between two borders, as trigrams
        start, end = start[first], end[first]
        size = end - start
        self.trigram_word = np.repeat(np.arange(len(size)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        low = tb.LOWER[data]
        here = low[at].astype(np.int64)
        left = np.where(at > np.repeat(start, size), low[np.maximum(at - 1, 0)], np.int64(1))
        right = np.where(at + 1 < np.repeat(end, size), low[np.minimum(at + 1, max(len(data) - 1, 0))], np.int64(2))
        self.trigram = ((left * 0x9E37 + here * 0x85EB + right * 0xC2B3) * 0x27D4EB2F >> 7) % CHAR_SLOTS
        self.trigram = self.trigram.astype(np.int32)
        self.size = size
        begin = np.repeat(start, size)
        gram = here
        for k in range(1, 5):
            gram = gram * 0x100000001B3 + np.where(at - k >= begin, low[np.maximum(at - k, 0)], np.int64(1))
        self.gram = (tb.mix(gram.astype(np.uint64)) % np.uint64(GRAM_SLOTS)).astype(np.int32)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(indices of distinct words, -1 for padding; row) of every window. The last window of a text ends
        at its last word; each row has one window at least."""
        n = np.maximum(1, -(-np.maximum(self.counts - WINDOW, 0) // STRIDE) + 1)
        row = np.repeat(np.arange(len(n)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        counts = self.counts[row]
        first = np.minimum(k * STRIDE, np.maximum(counts - WINDOW, 0))
        place = first[:, None] + np.arange(WINDOW)
        inside = place < counts[:, None]
        place += (np.cumsum(self.counts) - self.counts)[row][:, None]
        index = np.full(place.shape, -1, np.int32)
        index[inside] = self.index[place[inside]]
        return index, row


class Network:
    """Parameters are float32 arrays in ``p``; odds: sorted word hashes with their log-odds."""

    def __init__(self, seed: int = 3):
        rng = np.random.Generator(np.random.PCG64(seed))
        draw = lambda *shape, scale=0.3: (rng.standard_normal(shape) * scale).astype(_F)
        self.p = {"word": draw(WORD_SLOTS, WORD_DIM, scale=0.05), "char": draw(CHAR_SLOTS, CHAR_DIM, scale=0.05), "pool": draw(2 * HIDDEN, 1), "mix": draw(2 * HIDDEN, 2 * HIDDEN), "out": draw(2 * HIDDEN, 1), "bias": np.zeros(1, _F)}
        for side in "fb":
            self.p |= {"x" + side: draw(INPUT, 3 * HIDDEN), "h" + side: draw(HIDDEN, 3 * HIDDEN), "c" + side: np.zeros(3 * HIDDEN, _F)}
        self.odds = (np.zeros(0, np.uint64), np.zeros(0, _F))
        self.gram_odds = np.zeros(GRAM_SLOTS, _F)
        self.scale = (1.0, 0.0)

    def log_odds(self, hashes: np.ndarray) -> np.ndarray:
        keys, values = self.odds
        if not len(keys):
            return np.zeros(len(hashes), _F)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, values[at], _F(0))

    def inputs(self, words: Words) -> np.ndarray:
        """A row for each distinct word, and one of zeros for padding (the last)."""
        x = np.zeros((len(words.hash) + 1, INPUT), _F)
        if len(words.hash):
            x[:-1, :WORD_DIM] = self.p["word"][words.slot]
            begin = np.cumsum(words.size) - words.size
            sums = np.add.reduceat(self.p["char"][words.trigram], begin)
            x[:-1, WORD_DIM:-2] = sums / words.size[:, None].astype(_F)
            x[:-1, -2] = np.maximum.reduceat(self.gram_odds[words.gram], begin)
            x[:-1, -1] = self.log_odds(words.hash)
        return x

    def logits(self, x: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Logits of any number of windows over the distinct words' inputs."""
        gates = {side: x @ self.p["x" + side] + self.p["c" + side] for side in "fb"}
        return np.concatenate([np.zeros(0, _F), *(self.forward(gates, index[at : at + BATCH_WINDOWS]) for at in range(0, len(index), BATCH_WINDOWS))])

    def forward(self, gates: dict, index: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows. keep: gets what the backward pass needs."""
        p, n, h3 = self.p, len(index), HIDDEN
        states = np.empty((WINDOW, n, 2 * h3), _F)
        steps = {}
        for side, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            own = gates[side]
            h = np.zeros((n, h3), _F)
            u, lo = p["h" + side], slice(0, h3) if side == "f" else slice(h3, 2 * h3)
            for t in order:
                g = own[index[:, t]]
                r = h @ u
                zr = g[:, : 2 * h3] + r[:, : 2 * h3]
                # sigmoid(x) = (1 + tanh(x / 2)) / 2
                zr *= _F(0.5)
                np.tanh(zr, out=zr)
                zr += _F(1)
                zr *= _F(0.5)
                z, reset = zr[:, :h3], zr[:, h3:]
                inner = r[:, 2 * h3 :]
                c = np.tanh(g[:, 2 * h3 :] + reset * inner)
                new = c + z * (h - c)
                if keep is not None:
                    steps[side, t] = (h, z, reset, inner, c)
                h = new
                states[t, :, lo] = h
        hidden = np.tanh(states.reshape(-1, 2 * h3) @ p["mix"])
        weight = (hidden @ p["pool"]).reshape(WINDOW, n)
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnk->nk", weight, states)
        if keep is not None:
            keep += [states, steps, hidden, weight, pooled]
        return (pooled @ p["out"])[:, 0] + p["bias"][0]

    def gradients(self, words: Words, x: np.ndarray, index: np.ndarray, y: np.ndarray) -> dict:
        keep: list = []
        logit = self.forward({side: x @ self.p["x" + side] + self.p["c" + side] for side in "fb"}, index, keep)
        states, steps, hidden, weight, pooled = keep
        p, n, h3 = self.p, len(index), HIDDEN
        d = ((_sigmoid(logit) - y) / n).astype(_F)[:, None]
        g = {"out": pooled.T @ d, "bias": d.sum(0)}
        d_pooled = d @ p["out"].T
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("tnk,nk->tn", states, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        flat = d_score.reshape(-1, 1)
        g["pool"] = hidden.T @ flat
        d_hidden = (flat @ p["pool"].T) * (1 - hidden**2)
        g["mix"] = states.reshape(-1, 2 * h3).T @ d_hidden
        d_states += (d_hidden @ p["mix"].T).reshape(states.shape)
        d_x = np.zeros_like(x)
        for side, order in (("f", range(WINDOW - 1, -1, -1)), ("b", range(WINDOW))):
            lo = slice(0, h3) if side == "f" else slice(h3, 2 * h3)
            d_gates = np.zeros((len(x), 3 * h3), _F)
            carry = np.zeros((n, h3), _F)
            u = p["h" + side]
            g["h" + side] = np.zeros_like(u)
            for t in order:
                h, z, reset, inner, c = steps[side, t]
                d_h = d_states[t, :, lo] + carry
                d_c = d_h * (1 - z) * (1 - c**2)
                d_z = d_h * (h - c) * z * (1 - z)
                d_r = d_c * inner * reset * (1 - reset)
                d_in = np.concatenate([d_z, d_r, d_c], 1)
                d_rec = np.concatenate([d_z, d_r, d_c * reset], 1)
                g["h" + side] += h.T @ d_rec
                carry = d_h * z + d_rec @ u.T
                np.add.at(d_gates, index[:, t], d_in)
            g["x" + side] = x.T @ d_gates
            g["c" + side] = d_gates.sum(0)
            d_x += d_gates @ p["x" + side].T
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        if len(words.hash):
            np.add.at(g["word"], words.slot, d_x[:-1, :WORD_DIM])
            np.add.at(g["char"], words.trigram, (d_x[:-1, WORD_DIM:-2] / words.size[:, None])[words.trigram_word].astype(_F))
        return g

    def highest(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Words, np.ndarray, np.ndarray, np.ndarray]:
        """Highest window logit of each row, with the words, windows, rows and logits."""
        words = Words(data, offsets)
        x = self.inputs(words)
        index, row = words.windows()
        logit = self.logits(x, index)
        best = np.full(len(offsets) - 1, -np.inf)
        np.maximum.at(best, row, logit)
        return best, words, index, row, logit

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        best = self.highest(data, offsets)[0]
        return _sigmoid(self.scale[0] * best + self.scale[1])


def _block(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return tb.utf8(pa.array(texts, pa.large_string()))


def _odds(pieces, y: np.ndarray, items: int) -> np.ndarray:
    """Smoothed log-odds of a toxic row given each item; 0 for items of fewer than three rows. pieces: arrays of
    (row, item) pairs, with all pairs of a row in one piece; a pair counts once."""
    toxic, seen = np.zeros(items), np.zeros(items)
    for row, item in pieces:
        pair = np.unique(row * np.int64(items) + item)
        row, item = pair // items, pair % items
        toxic += np.bincount(item, y[row], items)
        seen += np.bincount(item, minlength=items)
    rate, strength = y.mean(), 4.0
    odds = np.log((toxic + strength * rate) / (seen - toxic + strength * (1 - rate))) - np.log(rate / (1 - rate))
    return np.clip(np.where(seen >= 3, odds, 0), -4, 4).astype(_F)


def _grams(words: Words, row: np.ndarray):
    """(row, slot of a run of bytes) pairs, a few hundred rows at a time."""
    begin = np.cumsum(words.size) - words.size
    for low in range(0, len(words.counts), 200):
        a, b = np.searchsorted(row, [low, low + 200])
        pair = np.unique(row[a:b] * np.int64(len(words.hash)) + words.index[a:b])
        word = pair % max(len(words.hash), 1)
        size = words.size[word]
        at = np.repeat(begin[word], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        yield np.repeat(pair // max(len(words.hash), 1), size), words.gram[at]


def train(texts: list[str], labels: np.ndarray, rate: float | None = None, rounds: int = 4, seed: int = 3) -> Network:
    """A network for rows of text with labels 0 or 1; rate: that of label 1 among all rows, if the sample's
    differs. Without rows of both labels it scores their rate alone."""
    net = Network(seed)
    y = np.asarray(labels, float)
    if y.sum() < 4 or (1 - y).sum() < 4:
        rate = (y.sum() + 0.5) / (len(y) + 1)
        net.scale = (0.0, float(np.log(rate / (1 - rate))))
        return net
    rng = np.random.Generator(np.random.PCG64(seed))
    fold = np.zeros(len(y), int)
    for label in (0, 1):  # a fourth of either label is kept for the calibration
        at = rng.permutation(np.flatnonzero(y == label))
        fold[at[: -(-len(at) // 4)]] = 1
    texts, kept = np.array(texts, object), (np.array(texts, object)[fold == 1], y[fold == 1])
    y = y[fold == 0]
    words = Words(*_block(list(texts[fold == 0])))
    row = tb.row_of(words.counts)
    odds = _odds([(row, words.index)], y, len(words.hash))
    ranked = np.argsort(words.hash)
    net.odds = (words.hash[ranked], odds[ranked])
    net.gram_odds = _odds(_grams(words, row), y, GRAM_SLOTS)
    index, row = words.windows()
    clue = net.inputs(words)[:, -2:].max(1)
    first = clue[index].max(1)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = turn = 0
    while turn < rounds or step < LEAST_STEPS:  # a small sample has few steps in a turn
        x = net.inputs(words)
        rank = first if turn == 0 else net.logits(x, index)
        order = np.lexsort((-rank, row))
        nth = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        some = rng.choice(order, min(len(order), 2 * len(y)), replace=False)
        chosen = np.concatenate([order[nth < 1], some[y[row[some]] == 0]])
        rng.shuffle(chosen)
        for at in range(0, len(chosen), 256):
            part = chosen[at : at + 256]
            used, local = np.unique(index[part], return_inverse=True)
            local = local.reshape(index[part].shape)
            if used[0] < 0:  # padding is the last row of the inputs
                local = np.where(local == 0, len(used) - 1, local - 1)
            sub = _subset(words, used)
            grads = net.gradients(sub, net.inputs(sub), local, y[row[part]])
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += _F(0.1) * (g - m)
                v += _F(0.01) * (g * g - v)
                net.p[k] -= (_F(0.01) * (m / _F(1 - 0.9**step)) / (np.sqrt(v / _F(1 - 0.99**step)) + _F(1e-6))).astype(_F)
        turn += 1
    slope, offset = _calibrated(net.highest(*_block(list(kept[0])))[0], kept[1])
    if rate is not None and 0 < rate < 1:
        sample = kept[1].mean()
        offset += float(np.log(rate / (1 - rate)) - np.log(sample / (1 - sample)))
    net.scale = (slope, offset)
    return net


def _subset(words: Words, used: np.ndarray) -> Words:
    used = used[used >= 0]
    out = Words.__new__(Words)
    out.hash, out.slot, out.size = words.hash[used], words.slot[used], words.size[used]
    begin = (np.cumsum(words.size) - words.size)[used]
    at = np.repeat(begin, out.size) + np.arange(out.size.sum()) - np.repeat(np.cumsum(out.size) - out.size, out.size)
    out.trigram, out.gram, out.trigram_word = words.trigram[at], words.gram[at], np.repeat(np.arange(len(used)), out.size)
    return out


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic of x, by Newton's method with a little ridge; steps are bounded, as labels that
    are told apart wholly make them overshoot."""
    a, b = 1.0, 0.0
    for _ in range(200):
        p = _sigmoid(a * x + b)
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * x).sum() + 0.1 * a, (p - y).sum()])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum()]])
        d = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - d[0], b - d[1]
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """Trained on rows of ``labels`` (doc_id, toxic) that are not held out; null labels are none."""
    known = labels.select("doc_id", "toxic").na.drop().where(~held_out(F.col("doc_id"))).dropDuplicates(["doc_id"])
    known = known.where("toxic in (0, 1)")
    found = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = min(found.get(1, 0), SAMPLE // 2)
    takes = {1: most, 0: min(found.get(0, 0), SAMPLE - most)}
    order = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30))
    part = F.lit(False)
    for label, n in takes.items():  # a hash threshold with some room, then exactly the smallest
        part |= (F.col("toxic") == label) & (order < int((1 << 30) * min(1.0, (n + 4 * n**0.5 + 1) / max(1, found.get(label, 1)))))
    known = known.where(part).withColumn("order", order).orderBy("order", "doc_id").limit(2 * SAMPLE)
    texts = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS)
    rows = texts.join(F.broadcast(known), "doc_id").select("order", "doc_id", "toxic", "text")  # 2 * SAMPLE labels at most
    total = sum(found.values())
    rate = found.get(1, 0) / total if total else None

    def run(batches):
        rows = pd.concat([pd.DataFrame(columns=["order", "doc_id", "toxic", "text"]), *(b.to_pandas() for b in batches if b.num_rows)])
        rows = rows.drop_duplicates("doc_id").sort_values(["order", "doc_id"])
        rows = pd.concat([rows[rows.toxic == label][:n] for label, n in takes.items()])
        net = train(rows.text.tolist(), rows.toxic.to_numpy().astype(int), rate)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])
        del rows, net
        tb.released()

    # the driver's memory is for plans and results: it gets the parameters alone
    made = rows.repartition(1).mapInArrow(run, "net binary").collect()
    return pickle.loads(made[0].net) if made else train([], np.zeros(0, int), rate)


def score_texts(docs: DataFrame, net: Network, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from ``CUT``) of every row.

    Only the text is looked at. Null and empty texts have one window of padding. With ``keep`` the
    columns of ``docs`` stay, and ``toxic_score`` is added. Repeated rows are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of parameters and the sample's words

    def of(batch, data, offsets):
        return pa.array(shared.value.scores(data, offsets), pa.float64())

    if keep:
        names = docs.columns

        def run(batches):
            for batch, data, offsets in tb.blocks(batches, limit=2 << 20):
                yield pa.RecordBatch.from_arrays([*batch.columns, of(batch, data, offsets)], [*names, "toxic_score"])

        return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType())]))

    def run_ids(batches):
        for batch, data, offsets in tb.blocks(batches, limit=2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), of(batch, data, offsets)], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", "text", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run_ids, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
