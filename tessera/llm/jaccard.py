"""Exact Jaccard join of word-shingle sets, with components of the links.

1. Equal sets collapse to one class (a 64-bit hash of the set and its size).
2. All classes are indexed by their prefixes: two sets that link share a shingle among the first
   ``n - ceil(limit * n) + 1`` of each in any global order of shingles. The order here is by rarity, counted by
   cells of the shingles' hash over all documents, so that sets which share but common passages seldom meet.
   Within an index list, ordered by size, neighbours whose sizes can link are chained: classes that are in no
   common chain component can't link, and are never compared. A list's runs are cut to their ends where they
   are read, so that a shingle of a third of all sets makes no long list.
3. Sets of a chain component are sifted by parities of their counts by cells of the shingles' hash (a bit for each
   shingle or half of one): two sets differ in no fewer shingles than these bits do, so that pairs whose bits differ
   too much can't link, and texts of sets that are in no other pair are not read again, however many chains the
   prefixes of a large input make. Components of any size are sifted, in pairs of blocks.
4. Each component of what is left is compared exactly. One of more than ``BLOCK`` units (a set is one, and one more
   for every ``UNIT`` shingles, so that blocks are bounded in bytes) is cut into blocks, first each
   by itself with some pivots of the component, so that most sets find their links; then only pairs of
   blocks that are not yet joined. Lists are cut at the positions where sizes can't link (block skipping),
   and a set's overlaps are derived from those of the set before it where they differ in few shingles: only
   the lists of shingles in which the two differ are read.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .katz import pack, unpack
from .shared import EDGES_AT_ONCE, components, kept, looked_up, parts, stars, touched

BLOCK, UNIT, PIVOTS = 1024, 1024, 16
#: Cells of the counts that order shingles by rarity, and the pieces they are added up in.
CELL_BITS, PIECES = 24, 256
CELLS = 1 << CELL_BITS
#: Index entries of one bucket.
ENTRIES = 1 << 20
#: Bytes of text worked on at once (a longer text stands alone).
TEXT_BYTES = 1 << 20
ROW_NAMES = ["doc_id", "tid", "n_shingles", "sid", "marks", "piece", "counts"]
#: A set's marks: parities of its shingles by cells, of which there are as many as shingles or up to twice as many,
#: 2**MARK_BITS[0] to 2**MARK_BITS[1]. A cell is the hash's last bits but MARK_SHIFT, so that halves fold.
MARK_BITS, MARK_SHIFT = (6, 17), 16
#: Most sets and bytes of marks, on average, of a block of a chain component and size band that is sifted.
SIFTED, SIFTED_BYTES = 1 << 14, 1 << 21
_U = np.uint64


def sets_of(data: np.ndarray, offsets: np.ndarray, size: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct shingles of all rows, their numbers, class ids). Rows with fewer than ``least`` words have none."""
    start, end, counts = tb.words(data, offsets)
    values, row = tb.shingles(tb.word_hashes(data, start, end), counts, size)
    if least > 1:
        enough = counts[row] >= least
        values, row = values[enough], row[enough]
    values, n = tb.distinct_per_row(values, row, len(counts))
    sid = np.zeros(len(n), _U)
    some = np.flatnonzero(n)
    if len(some):
        sid[some] = np.add.reduceat(tb.mix(values), (np.cumsum(n) - n)[some])
    return values, n, tb.signed(tb.mix(sid ^ tb.mix(n.astype(_U))))


def marks_of(values: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Of each row's shingles: parities of their counts by cells, as bits."""
    bits = np.clip(np.ceil(np.log2(np.maximum(n, 1))), *MARK_BITS).astype(np.int64)
    end = np.cumsum(1 << bits)
    row = tb.row_of(n)
    at = ((values >> _U(MARK_SHIFT)) & ((_U(1) << bits.astype(_U)) - _U(1))[row]).astype(np.int64) + (end - (1 << bits))[row]
    odd = np.packbits((np.bincount(at, minlength=end[-1] if len(end) else 0) & 1).astype(bool), bitorder="little")
    return [odd[(b - (1 << k)) >> 3 : b >> 3].tobytes() for b, k in zip(end.tolist(), bits.tolist(), strict=True)]


def _rows_and_counts(docs: DataFrame, size: int, least: int = 1, plain=F.col) -> DataFrame:
    """A row for each of ``docs`` (doc_id, tid: a hash of the text, n_shingles, sid, marks) and, in one pass with them,
    rows (piece, counts) of the distinct sets' shingles by cell, of each task."""

    def run(batches):
        counts, rows = np.zeros(CELLS, np.uint32), 0
        for batch, data, offsets in tb.blocks(batches, limit=TEXT_BYTES):
            values, n, sid = sets_of(data, offsets, size, least)
            first = np.zeros(len(n), bool)
            first[np.unique(sid, return_index=True)[1]] = True
            np.add.at(counts, (values[first[tb.row_of(n)]] >> _U(64 - CELL_BITS)).astype(np.int64), np.uint32(1))
            rows += batch.num_rows
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sid), pa.array(marks_of(values, n), pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], ROW_NAMES)
        if rows:
            some = [k for k, c in enumerate(np.split(counts, PIECES)) if c.any()]
            blobs = [pack(np.minimum(c, 255).astype(np.uint8), np.flatnonzero(c >= 255).astype(np.int32), c[c >= 255]) for c in (np.split(counts, PIECES)[k] for k in some)]
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(some), pa.binary()), pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ROW_NAMES)

    ids = docs.select("doc_id", F.xxhash64("text").alias("tid"), plain("text").alias("text"))
    return ids.mapInArrow(run, "doc_id long, tid long, n_shingles long, sid long, marks binary, piece int, counts binary")


def _crowding(counted: DataFrame) -> bytes:
    """Packed: a rank of each cell by its count, in sixths of a doubling. CELLS bytes at any size of the input."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                few, at, many = unpack(raw)
                few = few.astype(np.int64)
                few[at] = many
                sums[k] = sums.get(k, 0) + few
        blobs = [pack(np.minimum(255, np.ceil(6 * np.log2(np.maximum(x, 1)))).astype(np.uint8)) for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(blobs, pa.binary())], ["piece", "ranks"])

    out = np.zeros((PIECES, CELLS // PIECES), np.uint8)
    for r in counted.select("piece", "counts").where("piece is not null").repartition(PIECES, "piece").mapInArrow(run, "piece int, ranks binary").collect():
        out[r.piece] = unpack(r.ranks)[0]
    packed = pack(out.ravel())
    del out
    tb.released()
    return packed


def prefix(n, limit: Fraction):
    """How many of a set's first shingles, in one global order, meet those of every set that it links with."""
    return n - (limit.numerator * n + limit.denominator - 1) // limit.denominator + 1


def _runs(token: np.ndarray, n: np.ndarray, limit: Fraction) -> np.ndarray:
    """Where, in lists ordered by token and size, a run of neighbours whose sizes can link begins."""
    near = (token[1:] == token[:-1]) & (limit.denominator * n[:-1] >= limit.numerator * n[1:])
    return np.flatnonzero(np.r_[True, ~near])


def _postings(docs: DataFrame, size: int, limit: Fraction, crowding: bytes, buckets: int, least: int = 1, plain=F.col) -> DataFrame:
    """bucket, blob: index lists of the prefixes of a block's distinct sets.

    A run of a block's list is chained at once, as a star, and sends only its two ends: all that is between
    them in size is chained with them. So a shingle's list is no longer than twice the number of blocks."""

    def run(batches):
        ranks = unpack(crowding)[0]
        for _, data, offsets in tb.blocks(batches, limit=TEXT_BYTES):
            values, n, sid = sets_of(data, offsets, size, least)
            first = np.zeros(len(n), bool)
            first[np.unique(sid, return_index=True)[1]] = True
            row = tb.row_of(n)
            values, row = values[first[row]], row[first[row]]
            if not len(values):
                continue
            # one global order: rarer cells first, then by the hash, which rows are sorted by
            rank = ranks[(values >> _U(64 - CELL_BITS)).astype(np.int64)].astype(_U)
            order = np.lexsort(((rank << _U(56)) | (values >> _U(8)), row))
            values = values[order]
            some = np.where(first, n, 0)
            place = np.arange(len(row)) - (np.cumsum(some) - some)[row]
            use = place < prefix(n, limit)[row]
            token, row = values[use], row[use]
            order = np.lexsort((n[row], token))
            token, row = token[order], row[order]
            begin = _runs(token, n[row], limit)
            end = np.r_[begin[1:], len(row)] - 1
            whole = np.repeat(begin, end - begin + 1)
            star_a, star_b = stars(sid[row], sid[row[whole]])
            ends = np.unique(np.r_[begin, end[n[row[end]] != n[row[begin]]]])
            token, row = token[ends], row[ends]
            bucket = (tb.mix(token) % _U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            token, row, bucket = token[order], row[order], bucket[order]
            star_bucket = (tb.mix(star_a.view(_U)) % _U(buckets)).astype(np.int32)
            order = np.argsort(star_bucket, kind="stable")
            star_a, star_b, star_bucket = star_a[order], star_b[order], star_bucket[order]
            used = np.unique(np.concatenate([bucket, star_bucket]))
            lo, hi = np.searchsorted(bucket, used, "left"), np.searchsorted(bucket, used, "right")
            s_lo, s_hi = np.searchsorted(star_bucket, used, "left"), np.searchsorted(star_bucket, used, "right")
            blobs = []
            for a, b, c, d in zip(lo.tolist(), hi.tolist(), s_lo.tolist(), s_hi.tolist(), strict=True):
                rows, local = np.unique(row[a:b], return_inverse=True)
                # 40 bits of a shingle beside its bucket: a false meeting chains two sets, and is compared away
                blobs.append(pack((token[a:b] & _U(0xFFFFFFFF)).astype(np.uint32), (token[a:b] >> _U(56)).astype(np.uint8), local.astype(np.uint16 if len(rows) <= 1 << 16 else np.uint32), sid[rows], n[rows].astype(np.uint32), star_a[c:d], star_b[c:d]))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return docs.select(plain("text").alias("text")).mapInArrow(run, "bucket int, blob binary")


def _chains(postings: DataFrame, limit: Fraction, buckets: int) -> DataFrame:
    """a, b: stars of the chains in each bucket's index lists."""

    def run(batches):
        held, stars_of = [], []
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                low, high, local, sid, n, a, b = unpack(raw)
                held.append(((high.astype(_U) << _U(32)) | low, sid[local], n[local]))
                stars_of.append((a, b))
        if not held:
            return
        token, sid, n = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        # only lists of two sets or more are ordered
        order = np.argsort(token)
        token, sid, n = token[order], sid[order], n[order].astype(np.int64)
        same = token[1:] == token[:-1]
        many = np.r_[same, False] | np.r_[False, same]
        token, sid, n = token[many], sid[many], n[many]
        order = np.lexsort((n, token))
        token, sid, n = token[order], sid[order], n[order]
        begin = _runs(token, n, limit) if len(token) else np.zeros(0, np.int64)
        whole = np.repeat(begin, np.diff(np.r_[begin, len(token)]))
        a, b = stars(np.concatenate([sid, *(x[0] for x in stars_of)]), np.concatenate([sid[whole], *(x[1] for x in stars_of)]))
        for at in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + (1 << 16)]), pa.array(b[at : at + (1 << 16)])], ["a", "b"])

    return postings.repartitionById(buckets, "bucket").select("blob").mapInArrow(run, "a long, b long")


class _Marked:
    """A block of sets in order of size, with their marks by length."""

    def __init__(self, sid: np.ndarray, n: np.ndarray, own: np.ndarray, marks: list[bytes]):
        order = np.argsort(n, kind="stable")
        self.sid, self.n = sid[order], n[order]
        # sets of the band itself follow those of the band before
        self.own = len(n) - int(own.sum())
        words = np.array([len(marks[i]) // 8 for i in order.tolist()], np.int64)
        begin = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.zeros(0, np.int64)
        self.runs = [(a, b, np.frombuffer(b"".join(marks[i] for i in order[a:b].tolist()), _U).reshape(b - a, -1)) for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(words)], strict=True)]
        self.folded: dict[tuple[int, int], np.ndarray] = {}

    def cut(self, k: int, words: int) -> np.ndarray:
        """The marks of a run, by fewer cells."""
        if (k, words) not in self.folded:
            bits = self.runs[k][2]
            while bits.shape[1] > words:
                bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
            self.folded[k, words] = bits
        return self.folded[k, words]


def _may_link(left: _Marked, right: _Marked, limit: Fraction):
    """(a, b): stars of the pairs of two blocks (or of one) that may link by their sizes and marks, at least one of
    them of the band itself; at most EDGES_AT_ONCE pairs and a set's held."""
    up, down = limit.numerator, limit.denominator
    first = np.searchsorted(down * right.n, up * left.n, "left")
    last = np.searchsorted(up * right.n, down * left.n, "right")
    if left is right:
        first = np.arange(1, len(left.n) + 1)
    first[: left.own] = np.maximum(first[: left.own], right.own)
    held, pairs = [], 0
    for k, (begin, end, bits) in enumerate(left.runs):
        for i in range(begin, end):
            for m, (a, b, theirs) in enumerate(right.runs):
                lo, hi = max(a, int(first[i])), min(b, int(last[i]))
                if lo >= hi:
                    continue
                words = min(bits.shape[1], theirs.shape[1])
                least = np.bitwise_count(right.cut(m, words)[lo - a : hi - a] ^ left.cut(k, words)[i - begin]).sum(axis=1, dtype=np.int64)
                near = np.flatnonzero(least * (down + up) <= (left.n[i] + right.n[lo:hi]) * (down - up)) + lo
                if len(near):
                    held.append((np.full(len(near), left.sid[i]), right.sid[near]))
                    pairs += len(near)
        if pairs > EDGES_AT_ONCE:
            held = [stars(*(np.concatenate(c) for c in zip(*held, strict=True)))]
            pairs = len(held[0][0])
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return stars(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _sifted(marked: DataFrame, limit: Fraction) -> DataFrame:
    """node, root: components of the sets (root, sid, n, marks) that may link. Sets that link are in one size band or
    in neighbouring ones; each is in its own and in the next. A band of many sets is dealt to blocks, of which each
    pair is compared by itself: marks are copied once for each block, an eighth of a byte or two for a shingle."""

    def run(table: pa.Table) -> pa.Table:
        sid, at = np.unique(table.column("sid").to_numpy(), return_index=True)
        n, own, block = (table.column(c).to_numpy()[at] for c in ("n", "own", "block"))
        marks = table.column("marks").take(pa.array(at)).to_pylist()
        sides = [_Marked(sid[x], n[x], own[x], [marks[i] for i in x.tolist()]) for x in (np.flatnonzero(block == k) for k in np.unique(block))]
        crossed = table.column("low")[0] != table.column("high")[0]
        a, b = (np.zeros(0, np.int64),) * 2 if crossed and len(sides) < 2 else _may_link(sides[0], sides[-1], limit)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    wide = max(1e-3, -math.log(limit)) * (1 + 1e-9)
    band = F.floor(F.ln("n") / wide).cast("int")
    marked = kept(marked.select("root", "sid", "n", "marks"))
    banded = marked.select("root", "sid", "n", "marks", F.posexplode(F.array(band + 1, band)).alias("place", "band"))
    sizes = banded.groupBy(F.col("root").alias("z_root"), F.col("band").alias("z_band")).agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("marks")).alias("size"))
    several = F.greatest(F.ceil(F.col("m") / SIFTED), F.ceil(F.col("size") / SIFTED_BYTES)).cast("int")
    # fewer than twice as many as there are blocks
    large = sizes.select("z_root", "z_band", several.alias("several")).where("several > 1")
    dealt = banded.join(F.broadcast(large), (F.col("root") == F.col("z_root")) & (F.col("band") == F.col("z_band")), "left")
    dealt = dealt.withColumn("several", F.coalesce("several", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("sid", F.lit("sift")), F.col("several")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("several") - 1)))
    dealt = dealt.select("root", "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "sid", "n", "marks", (F.col("place") == 1).alias("own"), "block")
    return components(kept(dealt.groupBy("root", "band", "low", "high").applyInArrow(run, "a long, b long")))


class _Found:
    """Union-find over the sets of a block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def block_links(sets: list[np.ndarray], group: np.ndarray, limit: Fraction) -> list[tuple[int, int]]:
    """Links between sets of different groups that join what is not joined yet (a spanning forest of all links)."""
    up, down = limit.numerator, limit.denominator
    size = np.array([len(s) for s in sets])
    # similar sets stand side by side: order by the smallest shingles, which near sets mostly share
    order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]) if len(sets[i]) else 0, len(sets[i])))
    by_size = np.argsort(size, kind="stable")
    place = np.empty(len(sets), np.int64)
    place[by_size] = np.arange(len(sets))
    sizes = size[by_size]
    tokens = np.concatenate([sets[i] for i in by_size])
    owner = np.repeat(np.arange(len(sets)), sizes)
    rank = np.argsort(tokens, kind="stable")  # lists are in order of size
    tokens, owner = tokens[rank], owner[rank]
    links, joined, before = [], _Found(len(sets)), None
    counts = np.zeros(len(sets), np.int64)

    def lists(part: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(tokens, part, "left"), np.searchsorted(tokens, part, "right")
        n = hi - lo
        return owner[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]

    for i in order:
        s = sets[i]
        if before is not None and len(new := np.setdiff1d(s, before, True)) + len(gone := np.setdiff1d(before, s, True)) < len(s):
            # derived from the answers of the set before: only what differs is read
            counts = counts + np.bincount(lists(new), minlength=len(sets)) - np.bincount(lists(gone), minlength=len(sets))
        else:
            counts = np.bincount(lists(s), minlength=len(sets))
        before = s
        lo, hi = np.searchsorted(down * sizes, up * len(s), "left"), np.searchsorted(up * sizes, down * len(s), "right")
        part = counts[lo:hi]
        for k in (np.flatnonzero(down * part >= up * (len(s) + sizes[lo:hi] - part)) + lo).tolist():
            j = int(by_size[k])
            if j != i and group[i] != group[j]:
                a, b = joined.root(i), joined.root(j)
                if a != b:
                    joined.up[a] = b
                    links.append((i, j))
    return links


def _compare(work: DataFrame, limit: Fraction, spark: SparkSession) -> DataFrame:
    """a, b: links found in each block of ``work`` (block, sid, side, shingles); sets of one side are not compared."""

    def run(table: pa.Table) -> pa.Table:
        sid = table.column("sid").to_numpy()
        _, first = np.unique(sid, return_index=True)
        sets = [np.frombuffer(x, _U) for x in table.column("shingles").take(pa.array(first)).to_pylist()]
        side, sid = table.column("side").to_numpy()[first], sid[first]
        links = np.array(block_links(sets, side, limit), np.int64).reshape(-1, 2)
        return pa.table(dict(zip("ab", stars(sid[links[:, 0]], sid[links[:, 1]]), strict=True)))

    return work.groupBy("block").applyInArrow(run, "a long, b long")


def near_sets(docs: DataFrame, size: int, limit: Fraction, least: int = 1, plain=F.col) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tid, n_shingles, sid of every row; sid, root, units, m, shingles of all sets that may link, by components
    ``root`` of ``m`` units). Words are those of ``plain`` of the column of text; rows with fewer than ``least`` have no
    shingle."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    named = docs.where("doc_id is not null")
    # rows without doc_id are in no index, and are counted in no harm: any order of shingles will do
    passed = kept(_rows_and_counts(docs, size, least, plain))
    rows = passed.where("piece is null").select("doc_id", "tid", "n_shingles", "sid")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(parts(spark), -(-int(total * (1 - limit)) // ENTRIES))
    # a class is read from the row with its smallest id
    classes = rows.where("doc_id is not null and n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.expr(f"1 + min(n_shingles) div {UNIT}").alias("units"))
    classes = kept(classes)
    # written, so that no task runs two Python workers
    chains = kept(_chains(_postings(touched(named, ["doc_id"], classes, ["doc_id"]), size, limit, _crowding(passed), buckets, least, plain), limit, buckets))
    members = components(chains).selectExpr("node as sid", "root")
    chained = kept(members.join(classes, "sid").select(F.col("doc_id").alias("c_doc"), F.col("sid").alias("want"), "root", "units"))
    marked = passed.where("piece is null").select("doc_id", "sid", F.col("n_shingles").alias("n"), "marks")
    marked = touched(marked, ["sid"], chained, ["want"]).join(chained, (F.col("doc_id") == F.col("c_doc")) & (F.col("sid") == F.col("want"))).select("root", "sid", "n", "marks")
    near = _sifted(marked, limit).withColumnRenamed("root", "near")
    wanted = kept(chained.join(near, F.col("want") == F.col("node")).select(F.col("c_doc").alias("doc_id"), "want", F.col("near").alias("root"), "units"))
    cells = wanted.groupBy(F.col("root").alias("m_root")).agg(F.sum("units").alias("m"))
    wanted = kept(looked_up(wanted, "root", cells, "m_root").select(F.col("doc_id").alias("w_doc"), "want", "root", "units", "m"))

    def read_sets(batches):
        for batch, data, offsets in tb.blocks(batches, limit=TEXT_BYTES):
            values, n, sid = sets_of(data, offsets, size, least)
            ends = np.cumsum(n)
            right = np.flatnonzero(sid == batch.column(1).to_numpy())
            blobs = [values[ends[i] - n[i] : ends[i]].tobytes() for i in right.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(sid[right]), *(batch.column(k).take(pa.array(right)) for k in (2, 3, 4)), pa.array(blobs, pa.binary())], ["sid", "root", "units", "m", "shingles"])

    read = touched(named, ["doc_id"], wanted, ["w_doc"]).join(wanted, F.col("doc_id") == F.col("w_doc")).select(plain("text").alias("text"), "want", "root", "units", "m")
    return rows, kept(read.mapInArrow(read_sets, "sid long, root long, units long, m long, shingles binary"))


def linked_rows(docs: DataFrame, size: int, limit: Fraction) -> DataFrame:
    """doc_id, tid, n_shingles, class of links (null without shingles or without doc_id) of every row."""
    spark = docs.sparkSession
    rows, sets = near_sets(docs, size, limit)
    several = F.expr(f"cast(ceil(m / {BLOCK}) as int)")
    mixed = F.xxhash64("sid", F.lit("block"))
    pivot = (several > 1) & (F.expr(f"pmod(xxhash64(sid, 'pivot'), greatest(1L, m div {PIVOTS}))") == 0)
    first = sets.select("sid", "root", "shingles", F.explode(F.when(pivot, F.sequence(F.lit(0), several - 1)).otherwise(F.array(F.pmod(mixed, several).cast("int")))).alias("k"))
    found = kept(_compare(first.selectExpr("struct(root, k) as block", "sid", "sid as side", "shingles"), limit, spark))
    large = sets.where(F.col("m") > BLOCK)
    if not large.isEmpty():
        found = found.unionByName(kept(_across(large, found, limit, spark)))
    joined = components(found).selectExpr("node as j_sid", "root as joined")
    named_class = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("joined", "sid"))
    return looked_up(rows, "sid", joined, "j_sid").select("doc_id", "tid", "n_shingles", named_class.alias("class"))


def link_components(docs: DataFrame, size: int = 4, limit: Fraction = Fraction(85, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    A text with fewer words than ``size`` is its whole sequence as one shingle; an empty or null text has no
    shingle and is alone. Rows link if ``intersection >= limit * union``; component_id is the smallest
    doc_id reachable. Repeated rows are rows each, linked as equal sets. Rows without doc_id link with
    nothing and have no component. An empty table gives no rows.
    """
    rows = kept(linked_rows(docs, size, limit))
    lowest = rows.where("class is not null").groupBy(F.col("class").alias("l_class")).agg(F.min("doc_id").alias("component_id"))
    # a row that is alone is its own component
    return looked_up(rows, "class", lowest, "l_class").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _across(large: DataFrame, found: DataFrame, limit: Fraction, spark: SparkSession) -> DataFrame:
    """Links between blocks of large chain components. Sets that are joined already share a side; sides of
    many sets fill blocks of their own, small ones are put together. Pairs of blocks of one side are left out."""
    joined = components(found).selectExpr("node as j_sid", "root as j_root")
    sides = large.select("sid", "root", "units", "m").join(joined, F.col("sid") == F.col("j_sid"), "left").selectExpr("sid", "root", "units", "m", "coalesce(j_root, sid) as side")
    count = sides.groupBy("side").agg(F.sum("units").alias("in_side")).withColumnRenamed("side", "s_side")
    sides = sides.join(count, F.col("side") == F.col("s_side"))
    own = F.col("in_side") >= BLOCK // 2
    sides = kept(sides.select("sid", "root", "side", F.when(own, F.col("side")).alias("own"),
        F.when(own, F.pmod(F.xxhash64("sid", F.lit("own")), F.expr(f"ceil(in_side / {BLOCK})"))).otherwise(F.pmod(F.xxhash64("side", F.lit("small")), F.expr(f"ceil(m / {BLOCK})"))).cast("int").alias("cell")))
    cells = sides.select("root", "own", "cell").distinct()
    left, right = cells.selectExpr("root", "own as own_a", "cell as cell_a"), cells.selectExpr("root", "own as own_b", "cell as cell_b")
    key = lambda k: F.struct(F.coalesce(f"own_{k}", F.lit(0)), F.col(f"own_{k}").isNull(), F.col(f"cell_{k}"))
    pairs = left.join(right, "root").where(key("a") <= key("b")).where("own_a is null or own_b is null or own_a <> own_b").withColumn("pair", F.struct("root", key("a").alias("x"), key("b").alias("y")))
    uses = pairs.selectExpr("root", "own_a as own", "cell_a as cell", "pair").unionByName(pairs.selectExpr("root", "own_b as own", "cell_b as cell", "pair")).distinct()
    uses = uses.select(F.col("root").alias("u_root"), F.col("own").alias("u_own"), F.col("cell").alias("u_cell"), "pair")
    placed = sides.join(uses, (F.col("root") == F.col("u_root")) & F.col("own").eqNullSafe(F.col("u_own")) & (F.col("cell") == F.col("u_cell"))).select(F.col("sid").alias("p_sid"), "side", "pair")
    work = large.select("sid", "shingles").join(placed, F.col("sid") == F.col("p_sid")).selectExpr("pair as block", "sid", "side", "shingles")
    return _compare(work, limit, spark)


def one_of_each(docs: DataFrame, size: int = 5, limit: Fraction = Fraction(8, 10)) -> DataFrame:
    """One row of each class of linked rows: that of the smallest doc_id, of several texts of that id the one with
    the smallest hash, of rows equal in both the smallest by all columns (which must be orderable).

    Rows without doc_id and rows without shingles link with nothing, and all stay. Rows of one doc_id whose texts
    do not link are rows of classes of their own.
    """
    rows = kept(linked_rows(docs, size, limit).where("class is not null"))
    best = rows.groupBy("class").agg(F.min(F.struct("doc_id", "tid")).alias("k"))
    each = rows.groupBy("class", "doc_id", "tid").agg(F.count(F.lit(1)).alias("copies")).selectExpr("class as e_class", "doc_id as e_doc", "tid as e_tid", "copies")
    best = best.join(each, (F.col("class") == F.col("e_class")) & (F.col("k.doc_id") == F.col("e_doc")) & (F.col("k.tid") == F.col("e_tid"))).select("e_doc", "e_tid", "copies")
    best = kept(best)
    single, repeated = best.where("copies = 1"), best.where("copies > 1")
    # only texts that may go, or stand there several times, are shuffled
    torn = kept(rows.join(single, (F.col("doc_id") == F.col("e_doc")) & (F.col("tid") == F.col("e_tid")), "left_anti").select("doc_id", "tid"))
    own = [F.col("doc_id"), F.xxhash64("text")]
    key = (F.col("doc_id") == F.col("e_doc")) & (F.xxhash64("text") == F.col("e_tid"))
    linked = F.col("doc_id").isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    worded = docs.where(linked)
    # of these, only rows that may stay: most that the filter lets through go
    asked = kept(touched(single, ["e_doc", "e_tid"], torn, ["doc_id", "tid"]))
    stay = touched(touched(worded, own, torn, ["doc_id", "tid"]), own, asked, ["e_doc", "e_tid"]).join(asked, key, "left_semi")
    out = docs.where(~linked).unionByName(touched(worded, own, torn, ["doc_id", "tid"], holds=False)).unionByName(stay)
    if repeated.isEmpty():
        return out
    several = touched(worded, own, repeated, ["e_doc", "e_tid"]).join(repeated, key, "left_semi")
    several = several.groupBy("doc_id", F.xxhash64("text").alias("e_tid")).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return out.unionByName(several)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
  else list_distinct([array_to_string(ws[i:i+3], ' ') for i in range(1, len(ws) - 2)]) end as g from w),
n as (select doc_id, len(g) as n, case when len(g) > 0 then md5(array_to_string(list_sort(g), chr(10))) else 'row ' || doc_id end as k from s),
c as (select k, min(doc_id) as rep, any_value(n) as n from n group by k),
t as (select s.doc_id, unnest(s.g) as g from s join c on c.rep = s.doc_id),
f as (select g from t group by g having count(*) > 1),
u as (select t.* from t join f using (g)),
p as (select a.doc_id as x, b.doc_id as y, count(*) as o from u a join u b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from p join c cx on cx.rep = x join c cy on cy.rep = y where 100 * o >= 85 * (cx.n + cy.n - o)),
b as (select x, y from e union all select y, x from e),
r(node, root) as (select rep, rep from c union select b.y, r.root from r join b on b.x = r.node),
m as (select node, min(root) as root from r group by node)
select n.doc_id, n.n::bigint as n_shingles, m.root as component_id from n join c using (k) join m on m.node = c.rep
"""
