"""Language-model scores by Katz backoff over word bigrams.

Tokens are words and one end per text; the first word's history is a start mark. Counts of one to five
are discounted by Good-Turing, a history's probability left over (never none: its count is raised by a
half) goes to the unigrams it was not seen with, exactly normalised, and the unigrams' to one class of
unknown words:

    P(w | h) = d(c(h w)) c(h w) / (c(h) + 1/2)    if c(h w) > 0
             = alpha(h) P(w)                      else, if h was seen;  P(w) if not

Counts are kept in tables partitioned by the hash of the word (``w`` tables) and of the history (``h``
tables), as packed arrays. A block of documents sends each ``w`` table its bigrams once, with the rows that
hold them, so what is known of c(w) and c(h w) is added up per row there; what depends on the history of
unseen bigrams is added at the ``h`` table. A word of more than a thousandth of all tokens (there are at most
a thousand) is split: its bigrams are dealt by both words, and its statistics are known to every task. The
most frequent words (65,535 at most, at any size of the input) have two-byte codes known to every task, so
that packed arrays hold few whole hashes. A table is worked on in slices by the hash of its bigrams' words.

Each packed shuffle is read more than once through the same RDD, so its map side runs once; a lost
executor's part is computed again from the documents.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import kept, parts_for

END, START = np.uint64(0x5EED0000000000E1), np.uint64(0x5EED0000000000A7)
KEPT = 5  # counts above it are not discounted
HEAVY = 1000
CODED = 0xFFFF  # words with codes; also what stands for a word without one
CHUNK_BYTES = 2 << 20
TABLE_BYTES = 16 << 20  # text behind one table
SLICES = 8  # a table's working arrays are made for one slice at a time
_U = np.uint64


def held_out(doc_id, divisor: int = 7, remainder: int = 2):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(divisor)) == remainder


def pack(*arrays: np.ndarray) -> bytes:
    head = b"".join(a.dtype.str[1:].encode() + struct.pack("<q", len(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(bytes([len(arrays)]) + head + b"".join(a.tobytes() for a in arrays))


def unpack(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n, at, heads, out = raw[0], 1, [], []
    for _ in range(n):
        heads.append((np.dtype(raw[at : at + 2].decode()), struct.unpack_from("<q", raw, at + 2)[0]))
        at += 10
    for kind, size in heads:
        out.append(np.frombuffer(raw, kind, size, at))
        at += kind.itemsize * size
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, their histories, tokens of each row): the words of each row and an end."""
    start, end, counts = tb.words(data, offsets)
    hashes = tb.word_hashes(data, start, end)
    n = counts + 1
    last = np.cumsum(n) - 1
    out = np.empty(len(hashes) + len(n), _U)
    word = np.ones(len(out), bool)
    word[last] = False
    out[word], out[last] = hashes, END
    history = np.empty_like(out)
    history[1:] = out[:-1]
    history[last - counts] = START
    return out, history, n


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """d(0..KEPT + 1); d(r) is 1 above KEPT. counts_of_counts[r]: kinds seen r times, r up to KEPT + 1.
    A ratio that Good-Turing leaves outside (0, 1), as few data can, becomes (r - 1/2) / r."""
    n = counts_of_counts.astype(float)
    d = np.ones(KEPT + 2)
    over = (KEPT + 1) * n[KEPT + 1] / n[1] if n[1] else 1.0
    for r in range(1, KEPT + 1):
        value = ((r + 1) * n[r + 1] / (r * n[r]) - over) / (1 - over) if n[r] and over < 1 else -1.0
        d[r] = value if 0 < value < 1 else (r - 0.5) / r
    return d


class Unigrams:
    """What all tasks know: totals, discounts, heavy words (sorted hashes and counts; HEAVY at most) and coded words."""

    def __init__(self, total: int, kinds: int, texts: int, counts_of_counts: np.ndarray, coded: np.ndarray, coded_counts: np.ndarray):
        self.total, self.kinds, self.texts = total, kinds, texts
        self.d = discounts(counts_of_counts)
        heavy = coded_counts * HEAVY >= total
        self.coded, self.heavy, self.heavy_counts = coded, coded[heavy], coded_counts[heavy]
        r = np.arange(KEPT + 2)
        lost = float(((1 - self.d) * r * counts_of_counts)[1 : KEPT + 1].sum())
        # the class of unknown words has half a token's worth at least
        self.mass = total + (0.5 if lost < 0.5 else 0.0)
        self.unknown = (self.mass - (total - lost)) / self.mass if total else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(float)
        return np.where(c > 0, self.d[np.minimum(c, KEPT + 1).astype(int)] * c / max(self.mass, 1), self.unknown)

    def which(self, hashes: np.ndarray) -> np.ndarray:
        """Place among the heavy words, or -1."""
        if not len(self.heavy):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.heavy, hashes), len(self.heavy) - 1)
        return np.where(self.heavy[at] == hashes, at, -1)

    def encode(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, hashes of what has none)."""
        if not len(self.coded):
            return np.full(len(hashes), CODED, np.uint16), hashes
        at = np.minimum(np.searchsorted(self.coded, hashes), len(self.coded) - 1)
        hit = self.coded[at] == hashes
        return np.where(hit, at, CODED).astype(np.uint16), hashes[~hit]

    def decode(self, codes: np.ndarray, others: np.ndarray, a: int = 0, b: int | None = None) -> np.ndarray:
        """Hashes of codes[a:b]."""
        before, codes = np.count_nonzero(codes[:a] == CODED), codes[a:b]
        other = codes == CODED
        out = self.coded[np.where(other, 0, codes)] if len(self.coded) else np.empty(len(codes), _U)
        out[other] = others[before : before + np.count_nonzero(other)]
        return out

    def table_of(self, w: np.ndarray, h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, slice): by the word, and for heavy words by both."""
        mixed = tb.mix(w)
        mixed = np.where(self.which(w) >= 0, tb.mix(mixed ^ tb.mix(h + _U(1))), mixed)
        return (mixed % _U(buckets)).astype(np.int64), (mixed // _U(buckets) % _U(SLICES)).astype(np.int64)


def small(a: np.ndarray) -> np.ndarray:
    """Counts in the narrowest unsigned type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max()))) if len(a) else a.astype(np.uint8)


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, found = pd.factorize(keys)
    return found, np.bincount(codes, weights, len(found)).astype(np.int64)


def count_unigrams(docs: DataFrame, buckets: int) -> Unigrams:
    def run(batches):
        for batch, data, offsets in tb.blocks(batches):
            hashes, _, n = tokens(data, offsets)
            train = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            found, count = _sums(hashes, np.repeat(train, n))
            found, count = found[count > 0], count[count > 0]
            bucket = (tb.mix(found) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(k, pack(found[order[a:b]], count[order[a:b]].astype(np.uint32))) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

    share = max(16, -(-4 * CODED // buckets))  # of each bucket, which holds words by their hash

    def add(batches):
        found = [unpack(raw) for batch in batches for raw in batch.column(0).to_pylist()]
        if not found:
            return
        keys, counts = _sums(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        of_counts = np.bincount(np.minimum(counts, KEPT + 2), minlength=KEPT + 3)[: KEPT + 2]
        top = np.argsort(-counts, kind="stable")[:share]
        ends = counts[keys == END].sum()
        frequent = pa.array([[{"word": w, "times": c} for w, c in zip(tb.signed(keys[top]).tolist(), counts[top].tolist(), strict=True)]], pa.list_(pa.struct([("word", pa.int64()), ("times", pa.int64())])))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (int(counts.sum()), len(keys), int(ends))] + [pa.array([of_counts.tolist()], pa.list_(pa.int64())), frequent], ["total", "kinds", "ends", "of_counts", "frequent"])

    packed = docs.select("text", "held_out").mapInArrow(run, "bucket int, blob binary").repartitionById(buckets, "bucket")
    found = kept(packed.select("blob").mapInArrow(add, "total long, kinds long, ends long, of_counts array<long>, frequent array<struct<word: long, times: long>>"))
    sums = found.agg(*(F.sum(c).alias(c) for c in ("total", "kinds", "ends")), *(F.sum(F.col("of_counts")[r]).alias(f"n{r}") for r in range(KEPT + 2))).first()
    top = found.select(F.explode("frequent").alias("f")).select("f.*").orderBy(F.desc("times"), "word").limit(CODED).collect()
    coded, times = np.array([r.word for r in top], np.int64).view(_U), np.array([r.times for r in top], np.int64)
    order = np.argsort(coded)
    return Unigrams(sums.total or 0, sums.kinds or 0, sums.ends or 0, np.array([sums[f"n{r}"] or 0 for r in range(KEPT + 2)], np.int64), coded[order], times[order])


def _bigram_blobs(docs: DataFrame, known, buckets: int) -> DataFrame:
    """bucket, blob. A blob has a block's bigrams of one bucket, and the rows and times that they occur.
    One bucket also gets the block's ids."""

    def run(batches):
        uni, k = known.value, 0
        for batch, data, offsets in tb.blocks(batches, limit=CHUNK_BYTES):
            chunk, k = (TaskContext.get().partitionId() << 24) + k, k + 1
            held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            word, history, n = tokens(data, offsets)
            codes, names = pd.factorize(np.concatenate([word, history]))
            v, rows = len(names), len(n)
            key = (codes[: len(word)].astype(np.int64) * v + codes[len(word) :]) * rows + np.repeat(np.arange(rows), n)
            key.sort()
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            times = np.diff(np.r_[new, len(key)])
            pair, row = np.divmod(key[new], rows)
            first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            held_by = np.diff(np.r_[first, len(pair)])  # rows of each bigram
            w, h = names[pair[first] // v], names[pair[first] % v]
            bucket, part = uni.table_of(w, h, buckets)
            order = np.argsort(bucket * SLICES + part, kind="stable")
            cuts = np.searchsorted((bucket * SLICES + part)[order], np.arange(buckets * SLICES + 1))
            blobs, to = [], []
            for b in range(buckets):
                at = cuts[b * SLICES : (b + 1) * SLICES + 1]
                mine = order[at[0] : at[-1]]
                if not len(mine):
                    continue
                size = held_by[mine]
                entry = np.repeat(first[mine], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                own_w, own_part = w[mine], part[mine]
                run_at = np.flatnonzero(np.r_[True, (own_w[1:] != own_w[:-1]) | (own_part[1:] != own_part[:-1])])
                blobs.append(pack(np.array([chunk, 0]), at - at[0], *uni.encode(own_w[run_at]), small(np.diff(np.r_[run_at, len(mine)])), *uni.encode(h[mine]), small(size), row[entry].astype(np.uint16), small(times[entry]), np.packbits(held)))
                to.append(b)
            ids = batch.column(0)
            blobs.append(pack(np.array([chunk, 1]), ids.fill_null(0).to_numpy().astype(np.int64), np.packbits(ids.is_null().to_numpy(zero_copy_only=False)), n.astype(np.int64), np.packbits(held)))
            to.append(chunk % buckets)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, "bucket int, blob binary")


class _Slice:
    """The bigrams of one slice of a ``w`` table, from all blocks: (head, arrays) as ``_bigram_blobs`` packs them."""

    def __init__(self, blobs: list, k: int, uni: Unigrams):
        got = {c: [] for c in ("w", "h", "size", "row", "times", "held", "chunk")}
        for chunk, (at, w_codes, w_others, runs, h_codes, h_others, size, row, times, held) in blobs:
            a, b = int(at[k]), int(at[k + 1])
            if a == b:
                continue
            begin = np.cumsum(runs, dtype=np.int64) - runs
            r0, r1 = np.searchsorted(begin, [a, b])
            e0 = int(size[:a].sum(dtype=np.int64))
            e1 = e0 + int(size[a:b].sum(dtype=np.int64))
            got["w"].append(np.repeat(uni.decode(w_codes, w_others, r0, r1), runs[r0:r1]))
            got["h"].append(uni.decode(h_codes, h_others, a, b))
            got["size"].append(size[a:b])
            got["row"].append(row[e0:e1])
            got["times"].append(times[e0:e1])
            got["held"].append(np.unpackbits(held)[row[e0:e1]].astype(bool))
            got["chunk"].append(np.full(b - a, chunk))
        self.empty = not got["w"]
        if self.empty:
            return
        a = {k: np.concatenate(got.pop(k)) for k in list(got)}
        self.w, self.h, self.chunk, self.row, self.times, self.held = a["w"], a["h"], a["chunk"], a["row"], a["times"].astype(np.int64), a["held"]
        self.of = np.repeat(np.arange(len(self.w)), a["size"])  # bigram of each entry
        learned = np.bincount(self.of, np.where(self.held, 0, self.times), len(self.w)).astype(np.int64)
        pair, found = pd.factorize(tb.mix(self.w) * _U(3) + tb.mix(self.h ^ _U(0xA5A5A5A5)))
        self.pair, self.first = pair, np.empty(len(found), np.int64)
        self.first[pair[::-1]] = np.arange(len(pair))[::-1]
        self.count = np.bincount(pair, learned, len(found)).astype(np.int64)  # c(h w) of each kind
        word, names = pd.factorize(self.w)
        counts = np.bincount(word, learned, len(names)).astype(np.int64)
        heavy = uni.which(names)
        counts[heavy >= 0] = uni.heavy_counts[heavy[heavy >= 0]]
        self.c_w = counts[word]  # of each bigram as sent


def _read(blobs) -> tuple[list, list]:
    """(ids' blobs, bigrams' blobs, unpacked) of a ``w`` table."""
    ids, bigrams = [], []
    for raw in blobs:
        head, *rest = unpack(raw)
        if head[1]:
            ids.append((int(head[0]), raw))
        else:
            bigrams.append((int(head[0]), rest))
    return ids, bigrams


def _histories(blobs, uni: Unigrams, buckets: int):
    """(bucket, blob) for ``h`` tables: how many kinds follow each history r times, their unigram counts, and the
    rows with bigrams never seen. Heavy histories' rows are dealt by block. Bucket 0 gets counts of counts."""
    _, bigrams = _read(blobs)
    of_counts, seen, unseen = np.zeros(KEPT + 2, np.int64), [], []
    for k in range(SLICES):
        t = _Slice(bigrams, k, uni)
        if t.empty:
            continue
        of_counts += np.bincount(np.minimum(t.count, KEPT + 2), minlength=KEPT + 3)[: KEPT + 2]
        first, count = t.first[t.count > 0], t.count[t.count > 0]
        seen.append((t.h[first], np.minimum(count, KEPT + 1).astype(np.uint8), t.c_w[first]))
        new = np.flatnonzero(t.held & (t.count[t.pair[t.of]] == 0))
        unseen.append((t.h[t.of[new]], t.chunk[t.of[new]], t.row[new], t.times[new].astype(np.uint32)))
        del t
    del bigrams
    if not seen:
        return
    yield 0, pack(np.array([2]), of_counts)
    h, count, c_w = (np.concatenate(c) for c in zip(*seen, strict=True))
    code, h = pd.factorize(h)
    few = [np.bincount(code, x == r, len(h)).astype(np.uint32) for x in (count, c_w) for r in range(1, KEPT + 1)]
    many = np.bincount(code, np.where(c_w > KEPT, c_w, 0), len(h)).astype(np.int64)
    to = (tb.mix(h) % _U(buckets)).astype(np.int64)
    order = np.lexsort((h, to))
    cuts = np.searchsorted(to[order], np.arange(buckets + 1))
    for b in range(buckets):
        if cuts[b + 1] > cuts[b]:
            mine = order[cuts[b] : cuts[b + 1]]
            yield b, pack(np.array([0]), *uni.encode(h[mine]), *(small(k[mine]) for k in few), small(many[mine]))
    h, chunk, row, times = (np.concatenate(c) for c in zip(*unseen, strict=True))
    to = (np.where(uni.which(h) >= 0, tb.mix(chunk.astype(_U)), tb.mix(h)) % _U(buckets)).astype(np.int64)
    order = np.lexsort((chunk, to))
    cuts = np.searchsorted(to[order], np.arange(buckets + 1))
    for b in range(buckets):
        if cuts[b + 1] > cuts[b]:
            mine = order[cuts[b] : cuts[b + 1]]
            yield b, pack(np.array([1]), *uni.encode(h[mine]), chunk[mine], row[mine], small(times[mine]))


def _history_table(blobs, uni: Unigrams):
    """(histories, their kinds by count, their unigram mass, parts of unseen bigrams, counts of counts) of one ``h`` table."""
    stats, unseen, of_counts = [], [], np.zeros(KEPT + 2, np.int64)
    for raw in blobs:
        head, *rest = unpack(raw)
        if head[0] == 2:
            of_counts = of_counts + rest[0]
        else:
            (unseen if head[0] else stats).append([uni.decode(rest[0], rest[1]), *rest[2:]])
    if not stats:
        return np.zeros(0, _U), np.zeros((KEPT, 0)), np.zeros(0), unseen, of_counts
    code, h = pd.factorize(np.concatenate([s[0] for s in stats]))
    cols = [np.bincount(code, np.concatenate([s[k] for s in stats]), len(h)) for k in range(1, 2 * KEPT + 2)]
    mass = (cols[-1] + (uni.d * np.arange(KEPT + 2))[1 : KEPT + 1] @ np.stack(cols[KEPT:-1])) / max(uni.mass, 1)
    return h, np.stack(cols[:KEPT]), mass, unseen, of_counts


def _gamma(d: np.ndarray, kinds: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """log10 of alpha(h) times (c(h) + 1/2): the half and what the discounts left, over the unigram mass not seen."""
    left = 0.5 + ((1 - d[1 : KEPT + 1]) * np.arange(1, KEPT + 1)) @ kinds
    return np.log10(left) - np.log10(np.maximum(1 - mass, 1e-300))


def score_texts(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    The model learns from the rows that are not held out. Null and empty texts are one end. Repeated rows
    count, and are scored, each. A null doc_id is not held out. Without training rows every probability
    is 1 (one class of unknown words). An empty table gives no rows.
    """
    spark = docs.sparkSession
    buckets = buckets or parts_for(docs, each=TABLE_BYTES)
    docs = docs.select("doc_id", "text", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    uni = count_unigrams(docs, buckets)
    known = spark.sparkContext.broadcast(uni)  # HEAVY words at most
    # both shuffles are read twice; an RDD that is read again doesn't run its map side again
    words = _bigram_blobs(docs, known, buckets).repartitionById(buckets, "bucket").select("blob").rdd
    sent = words.mapPartitions(lambda rows: _histories((r.blob for r in rows), known.value, buckets))
    histories = spark.createDataFrame(sent, "bucket int, blob binary").repartitionById(buckets, "bucket").select("blob").rdd

    def heavy_part(rows):
        h, kinds, mass, _, of_counts = _history_table((r.blob for r in rows), known.value)
        at = known.value.which(h)
        pick = (at >= 0) | (h == START)
        yield of_counts, h[pick], kinds[:, pick], mass[pick]

    of_counts, heavy = np.zeros(KEPT + 2, np.int64), []
    for n, *rest in histories.mapPartitions(heavy_part).collect():
        of_counts = of_counts + n
        heavy.append(rest)
    d = discounts(of_counts)
    gamma = {}
    for h, kinds, mass in heavy:
        gamma |= dict(zip(h.tolist(), _gamma(d, kinds, mass).tolist(), strict=True))
    heavy_gamma = spark.sparkContext.broadcast((np.array(sorted(gamma), _U), np.array([gamma[k] for k in sorted(gamma)])))

    def unseen_part(rows):
        h, kinds, mass, unseen, _ = _history_table((r.blob for r in rows), known.value)
        if not unseen:
            return
        keys, values = heavy_gamma.value
        light = ~np.isin(h, keys)
        keys, values = np.concatenate([keys, h[light]]), np.concatenate([values, _gamma(d, kinds[:, light], mass[light])])
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        h, chunk, row, times = (np.concatenate(c) for c in zip(*unseen, strict=True))
        at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
        add = np.where(keys[at] == h, values[at], 0.0) * times if len(keys) else np.zeros(len(h))
        for chunk, (own,) in _by_chunk(chunk, row, [add]):
            yield chunk, pack(np.array([chunk, 2]), np.array([len(own)]), own)

    def seen_part(rows):
        uni = known.value
        ids, bigrams = _read(r.blob for r in rows)
        yield from ids
        sums: dict[int, list] = {}
        for k in range(SLICES):
            t = _Slice(bigrams, k, uni)
            if t.empty:
                continue
            c_w = t.c_w
            base = np.log10((c_w + 1) / (uni.total + uni.kinds + 1))
            c = t.count[t.pair]
            own = np.where(c > 0, np.log10(np.maximum(c, 1) * d[np.minimum(c, KEPT + 1)]), np.log10(uni.p(c_w)))
            # as the next token's history; what does not hold where that is unseen is put right at the h tables
            own -= np.where((c_w > 0) & (t.w != END), np.log10(c_w + 0.5), 0.0)
            for chunk, more in _by_chunk(t.chunk[t.of], t.row, [own[t.of] * t.times, base[t.of] * t.times, np.where(c_w > 0, 1, 0)[t.of] * t.times]):
                sums[chunk] = [_added(x, y) for x, y in zip(sums[chunk], more, strict=True)] if chunk in sums else more
            del t
        for chunk, (own, base, counted) in sums.items():
            yield chunk, pack(np.array([chunk, 3]), np.array([len(own)]), own, base, small(counted.astype(np.int64)))

    # a union of DataFrames, so that one Python worker a task runs each side
    pieces = spark.createDataFrame(words.mapPartitions(seen_part), "chunk long, blob binary").unionByName(spark.createDataFrame(histories.mapPartitions(unseen_part), "chunk long, blob binary"))
    first = -float(np.log10(uni.texts + 0.5)) if uni.texts else 0.0
    total = uni.total

    def gather(table: pa.Table) -> pa.Table:
        ids, sums = None, {}
        for raw in table.column("blob").to_pylist():
            head, *rest = unpack(raw)
            if head[1] == 1:
                ids = rest
                continue
            names = {2: ("score",), 3: ("score", "base", "known")}[int(head[1])]
            for name, values in zip(names, rest[1:], strict=True):
                if name not in sums or len(sums[name]) < rest[0][0]:
                    sums[name] = np.pad(sums.get(name, np.zeros(0)), (0, int(rest[0][0]) - len(sums.get(name, ()))))
                sums[name][: len(values)] += values
        doc, null, n, held = ids
        rows = len(doc)
        full = {k: np.pad(sums.get(k, np.zeros(0)), (0, rows - len(sums.get(k, ())))) for k in ("score", "base", "known")}
        return pa.table({"doc_id": pa.array(doc, mask=np.unpackbits(null)[:rows].astype(bool)), "held_out": np.unpackbits(held)[:rows].astype(bool), "n_tokens": n, "n_known": full["known"].round().astype(np.int64), "train_tokens": np.full(rows, total), "base_score": full["base"], "score": full["score"] + first})

    return pieces.groupBy("chunk").applyInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _by_chunk(chunk: np.ndarray, row: np.ndarray, values: list[np.ndarray]):
    """(chunk, sums by row) for each chunk."""
    order = np.argsort(chunk, kind="stable")
    chunk, row = chunk[order], row[order]
    values = [v[order] for v in values]
    cuts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(chunk) else []
    for a, b in zip(cuts, [*cuts[1:], len(chunk)][: len(cuts)], strict=True):
        yield int(chunk[a]), [np.bincount(row[a:b], v[a:b]) for v in values]


def _added(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if len(x) < len(y):
        x, y = y, x
    x[: len(y)] += y
    return x


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
