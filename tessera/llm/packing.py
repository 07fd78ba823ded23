"""Packing documents into training sequences along a Hilbert curve.

A document's token counts, hashed to a vector, are projected to a few dimensions by fixed random signs;
the Hilbert index of that point is its key. Documents are range-sorted by the key (ties: a hash of the id,
so that copies spread) with bounds from a sample of about SAMPLE rows, and each range is packed in order into sequences
of ``LENGTH`` tokens, cutting documents at sequence borders. The tail of a range is cut into sequences
whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb

LENGTH = 4096
END = 2
DIMS, BITS = 4, 10
HASHED = 512
SAMPLE, MOST_SAMPLED = 4096, 1 << 16
#: Pieces (of 16 KB at most) sent on at once.
OUT_ROWS = 512
#: Bytes of text behind a range.
RANGE_BYTES = 32 << 20
CACHE_WORDS = 1_000_000
_MARK = re.compile(rb"(?<=[a-z])([.,!])(?=[\x20\x09-\x0D]|\Z)")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of texts, with the ids of each white-space word kept under its 64-bit hash. White space ends every token
    of this vocabulary, and its normaliser changes nothing across white space, so words may be read one by one."""

    def __init__(self, path: str):
        # threads of its own would only compete with the executor's other tasks
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model, self.by_words = Tokenizer.from_file(path), True
        self._forget()
        probes = [x.encode() for x in ("Ab c.", "a, b! c.", "x\ty\nz  w ", " lead AND Trail. ", "É ß x1.5, don't!", "a.b c,d")]
        # a vocabulary of another make is read text by text
        self.by_words = self.ids(probes) == self._whole(probes)

    def _forget(self) -> None:
        # hashes of known words in order, and where and how many their ids are in ``flat``
        self.keys, self.at, self.n, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        found = []
        for at in range(0, len(words), 4000):
            found += [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast([w.decode() for w in words[at : at + 4000]], add_special_tokens=False)]
        n = np.array([len(x) for x in found], np.int64)
        keys, start = np.concatenate([self.keys, hashes]), np.concatenate([self.at, len(self.flat) + np.cumsum(n) - n])
        order = np.argsort(keys)
        self.keys, self.at, self.n = keys[order], start[order], np.concatenate([self.n, n])[order]
        self.flat = np.concatenate([self.flat, *found])

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_words:
            return self._whole(texts)
        # the vocabulary is lower case, and a mark between a letter and white space is a token run of its own:
        # so fewer words differ (texts that may hold a special token stay as they are)
        texts = [t if b"<|" in t else _MARK.sub(rb" \1", t.lower()) for t in texts]
        special = {i for i, t in enumerate(texts) if b"<|" in t}
        data = np.frombuffer(b"".join(b"" if i in special else t for i, t in enumerate(texts)), np.uint8)
        start, end, counts = tb.words(data, np.cumsum([0, *(0 if i in special else len(t) for i, t in enumerate(texts))]))
        code, distinct = pd.factorize(tb.word_hashes(data, start, end))
        if len(self.keys) > CACHE_WORDS:
            self._forget()
        near = np.searchsorted(self.keys, distinct).clip(0, max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[near] != distinct) if len(self.keys) else np.arange(len(distinct))
        if len(new):
            first = np.empty(len(distinct), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            self._learn(distinct[new], [data[a:b].tobytes() for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
        place = np.searchsorted(self.keys, distinct)[code]
        n = self.n[place]
        flat = self.flat[np.repeat(self.at[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype("<u4")
        cuts = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        out = [flat[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in special:
            out[i] = self._whole([texts[i]])[0]
        return out


@lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (rows), by undoing the curve's turns bit by bit from the top."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low, here = (1 << level) - 1, 1 << level
        for i in range(n):
            on = (x[i] & here) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> level & 1
    return key


_rng = np.random.Generator(np.random.PCG64(11))
_PLACE = _rng.integers(0, HASHED, 1 << 16)
_SIGNS = _rng.choice([-1.0, 1.0], (HASHED, DIMS))


def curve_keys(ids: list[bytes]) -> np.ndarray:
    """Hilbert keys of documents given as 32-bit ids."""
    points = np.zeros((len(ids), DIMS))
    for i, raw in enumerate(ids):
        if raw:
            counts = np.bincount(_PLACE[np.frombuffer(raw, "<u4") & 0xFFFF], minlength=HASHED)
            points[i] = (np.sqrt(counts) @ _SIGNS) / np.sqrt(counts.sum())
    # a projection of a unit vector by random signs is about normal: its logistic quantile spreads it over the cells
    cells = ((1 << BITS) / (1 + np.exp(-1.702 * points))).astype(np.int64)
    return hilbert(np.clip(cells, 0, (1 << BITS) - 1))


KEYED = "part int, curve long, tie long, doc_id long, ids binary"


def _keyed(docs: DataFrame, path: str, bounds: np.ndarray | None) -> DataFrame:
    """bounds: (curve, tie) pairs between parts; None gives the number of ids as part, and no ids."""
    small = tokenizer(path).model.get_vocab_size() <= 1 << 16

    def run(batches):
        words = tokenizer(path)
        for batch, data, offsets in tb.blocks(batches, limit=2 << 20):
            raw = data.tobytes()
            cuts = offsets.tolist()
            ids = words.ids([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            curve = curve_keys(ids)
            tie = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            if bounds is None:
                part, ids = np.array([len(x) // 4 + 1 for x in ids], np.int32), [None] * len(ids)
            else:
                part = _part(curve, tie, bounds)
                if small:
                    ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(curve), pa.array(tie), batch.column(0), pa.array(ids, pa.binary())], ["part", "curve", "tie", "doc_id", "ids"])

    return docs.select("doc_id", "text", F.xxhash64("doc_id", F.lit("packing")).alias("tie")).mapInArrow(run, KEYED)


def _part(curve: np.ndarray, tie: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    if not len(bounds):
        return np.zeros(len(curve), np.int32)
    pair = np.empty(len(curve), [("c", np.int64), ("t", np.int64)])
    pair["c"], pair["t"] = curve, tie
    at = np.array([tuple(b) for b in bounds.tolist()], pair.dtype)
    lo = np.searchsorted(at["c"], curve, "left")
    hi = np.searchsorted(at["c"], curve, "right")
    part = lo.copy()
    for i in np.flatnonzero(hi > lo):  # keys equal to bounds' keys: the tie decides
        part[i] = lo[i] + np.searchsorted(at["t"][lo[i] : hi[i]], tie[i], "right")
    return part.astype(np.int32)


PIECE = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), T.StructField("ids", T.BinaryType())])


class _Packer:
    """Cuts one part's documents, in order, into sequences. All but the last are full; the last is held
    back, and cut into sequences of 2**k tokens when the part ends."""

    def __init__(self, part: int):
        self.next, self.fill, self.held, self.rows = part << 32, 0, [], []

    def add(self, doc, ids: np.ndarray) -> None:
        n, start = len(ids), 0
        while start < n:
            size = min(n - start, LENGTH - self.fill)
            self.held.append((doc, start, ids[start : start + size], n))
            start, self.fill = start + size, self.fill + size
            if self.fill == LENGTH:
                self._close([LENGTH])

    def end(self) -> None:
        if self.fill:
            self._close([1 << k for k in range(LENGTH.bit_length(), -1, -1) if self.fill >> k & 1])

    def _close(self, lengths: list[int]) -> None:
        lengths, offset = lengths[::-1], 0
        room = lengths.pop()
        for doc, start, ids, n in self.held:
            while len(ids):
                if not room:
                    self.next, offset, room = self.next + 1, 0, lengths.pop()
                piece = ids[:room]
                raw = piece.tobytes()
                self.rows.append((doc, start, len(piece), zlib.crc32(raw), n, self.next, offset, raw))
                ids, start, offset, room = ids[len(piece) :], start + len(piece), offset + len(piece), room - len(piece)
        self.next, self.fill, self.held = self.next + 1, 0, []

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [[]] * 8
        self.rows = []
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7], pa.binary())], PIECE.names)


def pack(docs: DataFrame, path: str | None = None, parts: int | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Every document ends with id 2; a null or empty text is that id alone. Repeated rows are packed each.
    ``parts`` ranges (default: one for each RANGE_BYTES of text, the session's shuffle partitions at least, of
    16,384 at most: a range is sorted on disk and read as a stream) are packed side by side; a sequence_id
    is the range's number times 2**32 and a running number. An empty table gives no rows.
    """
    spark, path = docs.sparkSession, path or vocabulary()
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    # bounds come from the rows with the smallest hashes of their ids, about 16 for each range, weighed by their tokens
    parts = parts or min(MOST_SAMPLED // 4, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // RANGE_BYTES)))
    share = min(1.0, min(MOST_SAMPLED, max(SAMPLE, 16 * parts)) / max(1, rows))
    sample = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    bounds = np.zeros((0, 2), np.int64)
    if parts > 1 and rows:
        keys = sorted((r.curve, r.tie, r.part) for r in _keyed(sample, path, None).select("curve", "tie", "part").collect())
        weight = np.cumsum([n for *_, n in keys]) if keys else np.zeros(0)
        at = np.searchsorted(weight, np.arange(1, parts) * (weight[-1] / parts)) if keys else np.zeros(0, int)
        bounds = np.array([keys[k][:2] for k in np.unique(at)], np.int64).reshape(-1, 2)
    keyed = _keyed(docs, path, bounds).repartitionById(parts, "part").sortWithinPartitions("part", "curve", "tie", "doc_id", "ids")
    small = tokenizer(path).model.get_vocab_size() <= 1 << 16

    def run(batches):
        part, packer = None, None
        for batch in batches:
            for p, doc, raw in zip(*(batch.column(k) for k in range(3)), strict=True):
                p, raw = p.as_py(), raw.as_py()
                if p != part:
                    if packer:
                        packer.end()
                        yield packer.batch()
                    part, packer = p, _Packer(p)
                ids = np.frombuffer(raw, "<u2").astype("<u4") if small else np.frombuffer(raw, "<u4")
                packer.add(doc.as_py(), np.append(ids, np.uint32(END)).astype("<u4"))
                if len(packer.rows) >= OUT_ROWS:
                    yield packer.batch()
        if packer:
            packer.end()
            yield packer.batch()
        tb.released()

    return keyed.select("part", "doc_id", "ids").mapInArrow(run, PIECE)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
