"""Removal of bytes covered by a string of ``LENGTH`` bytes that also starts elsewhere in the corpus.

Every window of ``LENGTH`` bytes has an anchor, the run of ``GRAM`` bytes in it with the smallest hash (the
leftmost of equal ones); equal windows have equal anchors at equal places. Neighbouring windows with one
anchor form a segment. Segments are dealt to tables by the anchor's hash, as packed arrays.

A table finds equal segments by their hashes: all their windows repeat. Where different segments share an
anchor, the table asks for their bytes and expands intervals of a Burrows-Wheeler transform over them:
intervals of contexts of ``SEED`` bytes come from prefix doubling, which sorts by contexts of twice the
length until then; breadth-first backward extension then splits each interval by the byte before its
contexts, one length after another, and drops those of one row. It stops at ``LENGTH``: the rows left are
the windows that repeat.

Blocks of documents are numbered by input partition, the same in every pass and attempt; they travel
twice, to give the bytes asked for and to be cut.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import textbytes as tb
from .katz import pack, unpack
from .shared import kept, parts_for

LENGTH, GRAM, SEED = 200, 40, 160
PLACE_BITS = 24
STEP, CHUNK_BYTES = 8 << 20, 2 << 20
BLOBS = "part int, blob binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_U = np.uint64
_PLACE = _U((1 << PLACE_BITS) - 1)


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(row, first window, end of the last window's bytes, anchor hash, segment hash) of all segments;
    places are those in the row."""
    found = []
    for at in range(0, max(len(data) - length + 1, 0), STEP):
        part = data[at : at + STEP + length - 1]
        n = len(part)
        windows = n - length + 1
        pre = np.zeros(n + 1, _U)
        np.cumsum(tb.BYTE_CODE[part] * tb.powers(n), out=pre[1:])
        inverse = tb.inverse_powers(n)
        grams = tb.mix((pre[gram:] - pre[:-gram]) * inverse[: n - gram + 1])
        least = (grams & ~_PLACE) | np.arange(len(grams), dtype=_U)
        span, reach = 1, length - gram + 1
        while 2 * span <= reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < reach:
            least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
        anchor = (least & _PLACE).astype(np.int64)
        # windows that lie in one row: its first to its last
        low = np.clip(offsets[:-1] - at, 0, windows)
        high = np.clip(offsets[1:] - length + 1 - at, 0, windows)
        rows = np.flatnonzero(high > low)
        if not len(rows):
            continue
        low, high = low[rows], high[rows]
        new = np.zeros(windows, bool)
        new[1:] = anchor[1:] != anchor[:-1]
        new[low] = True
        start = np.flatnonzero(new)
        k = np.searchsorted(low, start, "right") - 1
        inside = (k >= 0) & (start < high[k])
        start, k = start[inside], k[inside]
        end = np.minimum(np.r_[start[1:], windows], high[k]) - 1 + length
        a = anchor[start]
        whole = tb.mix((pre[end] - pre[start]) * inverse[start] + ((end - start) * 1024 + (a - start)).astype(_U))
        base = offsets[rows[k]] - at
        found.append((rows[k], start - base, end - base, grams[a], whole))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _numbered(batches):
    """Blocks with their numbers, which are the same in every pass over the documents."""
    for k, (batch, data, offsets) in enumerate(tb.blocks(batches, limit=CHUNK_BYTES)):
        yield (TaskContext.get().partitionId() << 24) + k, batch.column(0), data, offsets


def _rows(pairs):
    """A batch of (part, blob)."""
    pairs = list(pairs)
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.binary())], ["part", "blob"])


def _segment_blobs(docs: DataFrame, buckets: int) -> DataFrame:
    """part, blob: each block's segments for each table."""

    def run(batches):
        for chunk, _, data, offsets in _numbered(batches):
            row, start, end, anchor, whole = segments(data, offsets)
            bucket = (tb.mix(anchor) % _U(buckets)).astype(np.int64)
            order = np.lexsort((whole, anchor, bucket))
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = []
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                mine = order[cuts[b] : cuts[b + 1]]
                out.append((b, pack(np.array([0, chunk]), anchor[mine], whole[mine], row[mine].astype(np.uint16), start[mine].astype(np.uint32), (end - start)[mine].astype(np.uint32))))
            yield _rows(out)

    return docs.select("doc_id", "text").mapInArrow(run, BLOBS)


def _text_blobs(docs: DataFrame, buckets: int) -> DataFrame:
    """part, blob: the blocks."""

    def run(batches):
        for chunk, ids, data, offsets in _numbered(batches):
            yield _rows([(chunk % buckets, pack(np.array([1, chunk]), ids.fill_null(0).to_numpy().astype(np.int64), np.packbits(ids.is_null().to_numpy(zero_copy_only=False)), offsets, data))])

    return docs.select("doc_id", "text").mapInArrow(run, BLOBS)


def _by_chunk(kind: int, buckets: int, chunk: np.ndarray, *columns: np.ndarray):
    order = np.argsort(chunk, kind="stable")
    chunk = chunk[order]
    cuts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(chunk) else []
    for a, b in zip(cuts, [*cuts[1:], len(chunk)][: len(cuts)], strict=True):
        yield int(chunk[a] % buckets), pack(np.array([kind, int(chunk[a])]), *(c[order[a:b]] for c in columns))


def _match(blobs, table: int, buckets: int):
    """(part, blob) for blocks: the spans of equal segments (2), and the segments whose bytes are asked for (3)."""
    got = []
    for raw in blobs:
        head, *rest = unpack(raw)
        if head[0] == 0:
            got.append((*rest, np.full(len(rest[0]), head[1])))
    if not got:
        return
    anchor, whole, row, start, size, chunk = (np.concatenate(c) for c in zip(*got, strict=True))
    code, kinds = pd.factorize(tb.mix(anchor) * _U(3) + whole)
    times = np.bincount(code, minlength=len(kinds))
    twice = times[code] > 1
    start, size = start.astype(np.int64), size.astype(np.int64)
    yield from _by_chunk(2, buckets, chunk[twice], row[twice], start[twice], (start + size)[twice])
    first = np.empty(len(kinds), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    by, names = pd.factorize(anchor[first])
    several = np.bincount(by, minlength=len(names)) > 1
    single = np.bincount(by, times == 1, len(names)) > 0
    ask = first[(several & single)[by]]
    # the anchor's hash goes along, so that only segments of one anchor are brought together
    yield from _by_chunk(3, buckets, chunk[ask], row[ask], start[ask], size[ask], times[code[ask]] == 1, np.full(len(ask), table))


def _sorted_out(blobs, kind: int) -> tuple[list, dict[int, list]]:
    """(blocks as they were packed, what is said of each block)."""
    texts, said = [], {}
    for raw in blobs:
        head, *rest = unpack(raw)
        if head[0] == 1:
            texts.append((int(head[1]), raw))
        elif head[0] == kind:
            said.setdefault(int(head[1]), []).append(rest)
    return texts, said


def _bytes_for(blobs):
    """(table, blob): the bytes of the segments that tables ask for."""
    texts, asked = _sorted_out(blobs, 3)
    for chunk, raw in texts:
        if chunk not in asked:
            continue
        head, _, _, offsets, data = unpack(raw)
        row, start, size, single, table = (np.concatenate(c) for c in zip(*asked[chunk], strict=True))
        order = np.argsort(table, kind="stable")
        row, start, size, single, table = (c[order] for c in (row, start, size, single, table))
        cuts = np.flatnonzero(np.r_[True, table[1:] != table[:-1]])
        for a, b in zip(cuts, [*cuts[1:], len(table)][: len(cuts)], strict=True):
            n = size[a:b]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[row[a:b]] + start[a:b], n)
            yield int(table[a]), pack(np.array([4, head[1]]), row[a:b], start[a:b], n, single[a:b], data[at])


def repeated_windows(text: np.ndarray, sizes: np.ndarray, length: int = LENGTH, seed: int = SEED) -> np.ndarray:
    """Places in ``text`` (segments of ``sizes`` bytes, one after another) where a window of ``length`` bytes
    starts that starts at two places or more; none crosses segments."""
    n = len(text)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # bytes up to the segment's end
    # ranks of contexts of 8, 16, ... bytes; a context of its own rank can't be part of a longer one that repeats
    rows = np.flatnonzero(left >= 8)
    key = np.zeros(len(rows), _U)
    for j in range(8):
        key = key << _U(8) | text[rows + j].astype(_U)
    ranks: dict[int, np.ndarray] = {}

    def ranked(rows: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        rows, key = rows[order], key[order]
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        alone = new & np.r_[new[1:], True] if len(key) else new
        rank = np.full(n, -1, np.int64)
        rank[rows] = np.cumsum(new)
        rank[rows[alone]] = -1
        return rows[~alone], rank

    rows, ranks[8] = ranked(rows, key)
    h = 8
    while 2 * h <= seed:
        rows = rows[left[rows] >= 2 * h]
        rows = rows[ranks[h][rows + h] >= 0]
        rows, ranks[2 * h] = ranked(rows, ranks[h][rows] * np.int64(n + 1) + ranks[h][rows + h])
        h *= 2
    while h < seed:
        step = max(k for k in ranks if h + k <= seed)
        rows = rows[left[rows] >= h + step]
        rows = rows[ranks[step][rows + h] >= 0]
        rows, now = ranked(rows, ranks[h][rows] * np.int64(n + 1) + ranks[step][rows + h])
        ranks, h = ranks | {h + step: now}, h + step
    # rows in order of their contexts; the transform is the byte before each
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    interval = ranks[h][rows]
    for _ in range(length - h):
        ok = rows > first[rows]  # a row at its segment's start has nothing before it
        rows, interval = rows[ok] - 1, interval[ok]
        # backward extension: an interval falls into one for each byte that comes before its contexts
        key = interval * np.int64(256) + text[rows]
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        if not len(rows):
            break
        new = np.r_[True, key[1:] != key[:-1]]
        alone = new & np.r_[new[1:], True]
        interval = np.cumsum(new)[~alone]
        rows = rows[~alone]
    return np.sort(rows)


def _expand(blobs, buckets: int):
    """(part, blob) for blocks: spans of repeated windows in segments that occur once (2)."""
    got = []
    for raw in blobs:
        head, *rest = unpack(raw)
        got.append((*rest, np.full(len(rest[0]), head[1])))
    if not got:
        return
    row, start, size, single, text, chunk = (np.concatenate(c) for c in zip(*got, strict=True))
    found = repeated_windows(text, size)
    begin = np.cumsum(size) - size
    of = np.searchsorted(begin, found, "right") - 1
    keep = single[of]
    found, of = found[keep], of[keep]
    if not len(found):
        return
    new = np.flatnonzero(np.r_[True, (found[1:] != found[:-1] + 1) | (of[1:] != of[:-1])])
    last = np.r_[new[1:], len(found)] - 1
    seg = of[new]
    a = start[seg] + found[new] - begin[seg]
    yield from _by_chunk(2, buckets, chunk[seg], row[seg], a, a + (found[last] - found[new]) + LENGTH)


def _finish(blobs):
    """Rows of the result for the blocks of one part."""
    texts, cut = _sorted_out(blobs, 2)
    for chunk, raw in texts:
        _, ids, null, offsets, data = unpack(raw)
        mark = np.zeros(len(data) + 1, np.int32)
        for row, a, b in cut.get(chunk, ()):
            np.add.at(mark, offsets[row] + a, 1)
            np.add.at(mark, offsets[row] + b, -1)
        # an end at a row's border takes back what starts there, so that sums stay in their rows
        gone = np.cumsum(mark)[:-1] > 0
        raw, null = data.tobytes(), np.unpackbits(null)
        for i, doc in enumerate(ids.tolist()):
            a, b = int(offsets[i]), int(offsets[i + 1])
            g = gone[a:b]
            removed = int(g.sum())
            runs = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if removed else 0
            kept_ = data[a:b][~g].tobytes() if removed else raw[a:b]
            yield None if null[i] else doc, b - a, removed, runs, hashlib.sha256(kept_).hexdigest()


def remove_repeats(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text).

    Null texts are empty. Texts shorter than ``LENGTH`` bytes lose nothing. Repeated rows are rows each:
    every byte of an equal text of ``LENGTH`` bytes or more goes from both. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    buckets = buckets or parts_for(docs)

    def each_part(function, *more):
        """A mapInArrow function: one call over all blobs of a part; what it gives is sent on as it comes."""

        def run(batches):
            out, size = [], 0
            for pair in function((x for batch in batches for x in batch.column(0).to_pylist()), *more):
                out.append(pair)
                size += len(pair[1])
                if size > 4 << 20:
                    yield _rows(out)
                    out, size = [], 0
            yield _rows(out)

        return run

    def by_part(frame: DataFrame) -> DataFrame:
        return frame.repartitionById(buckets, "part").select("blob")

    def matching(batches):
        table = TaskContext.get().partitionId()
        yield from each_part(_match, table, buckets)(batches)

    # spans and wishes are short; they are read twice
    answers = kept(by_part(_segment_blobs(docs, buckets)).mapInArrow(matching, BLOBS))
    texts = _text_blobs(docs, buckets)
    tables = by_part(texts.unionByName(answers)).mapInArrow(each_part(_bytes_for), BLOBS)
    more = by_part(tables).mapInArrow(each_part(_expand, buckets), BLOBS)

    def finishing(batches):
        rows = []
        for r in _finish(x for batch in batches for x in batch.column(0).to_pylist()):
            rows.append(r)
            if len(rows) == 5000:
                yield _result(rows)
                rows = []
        yield _result(rows)

    return by_part(texts.unionByName(answers).unionByName(more)).mapInArrow(finishing, RESULT)


def _result(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
