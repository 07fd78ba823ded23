"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are turned by fast pseudo-rotations (three rounds of random signs and a Hadamard transform); the
nearest signed axis is a vector's hash. One rotation gives as many cells as it has signed axes; so many are
joined, the last one over as few axes as needed, that a cell holds about ``CELL`` vectors at any number of them.
Each of ``TABLES`` tables is probed at the cells nearest to a query, whose number grows as the root of the cells,
and the candidates are reranked by their exact inner product in double precision. A query that finds fewer than
it should is asked again with more probes, at last at all cells.

The largest inner product is wanted, so vectors are first brought to one length by an added coordinate.
Equal vectors are one class, with its smallest ids: a vector that many rows share fills no cell. A cell that
holds many classes all the same is dealt to several parts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .katz import pack, unpack
from .shared import kept, parts
from .textbytes import mix

NEAREST, EVERY = 20, 20
TABLES, SEED = 16, 29
#: Classes in a cell, and probes of a table for each root of its cells.
CELL, PROBES = 25, 0.9
#: Bytes of vectors dealt to a part, and entries of one cell that stay together; at most HOT cells are split.
PART_BYTES, CROWD, HOT = 32 << 20, 1 << 15, 4096
_U = np.uint64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows, in place; their number of columns is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        y = x.reshape(len(x), -1, 2, step)
        a, b = y[:, :, 0].copy(), y[:, :, 1]
        y[:, :, 0] += b
        np.subtract(a, b, out=y[:, :, 1])
        step *= 2
    x *= n**-0.5
    return x


def rotate(x: np.ndarray, table: int, part: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64([SEED, table, part]))
    x = x.copy()
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


class Shape:
    """Sizes of the hash: columns of the padded vectors, axes of each rotation, probes, longest norm."""

    def __init__(self, classes: int, dims: int, longest: float, shortest: float):
        self.dims, self.longest = dims, longest
        # vectors of one length (but for rounding) need no added coordinate
        self.even = longest <= shortest * (1 + 1e-5)
        self.padded = 1 << int(dims - 1 if self.even else dims).bit_length()
        self.used, left = [], classes / CELL
        while left > 1.5 or not self.used:
            self.used.append(min(self.padded, max(1, math.ceil(left / 2))))
            left /= 2 * self.used[-1]
        self.probes = min(self.cells, math.ceil(PROBES * self.cells**0.5))

    @property
    def cells(self) -> int:
        return math.prod(2 * n for n in self.used)

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Unit vectors of ``padded`` columns: inner products keep the order of the original ones."""
        out = np.zeros((len(x), self.padded))
        norm = np.linalg.norm(x, axis=1)
        if query or self.even:
            out[:, : self.dims] = x / norm[:, None]
        else:
            out[:, : self.dims] = x / self.longest
            out[:, self.dims] = np.sqrt(np.maximum(0, 1 - (norm / self.longest) ** 2))
        return out

    def axes(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """Signed coordinates (positive axes, then negative) of the rotations."""
        out = [rotate(x, table, k)[:, :n] for k, n in enumerate(self.used)]
        return [np.concatenate([y, -y], 1) for y in out]

    def cell(self, x: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(x), np.int64)
        for y in self.axes(x, table):
            code = code * y.shape[1] + y.argmax(1)
        return code + table * self.cells

    def probed(self, x: np.ndarray, table: int, probes: int | None = None) -> np.ndarray:
        """The cells nearest to each query by the loss of its coordinates against the best axes."""
        probes = min(self.cells, probes or self.probes)
        if len(x) > (most := max(1, (1 << 21) // min(self.cells, 2 * self.padded * probes))):
            return np.concatenate([self.probed(x[a : a + most], table, probes) for a in range(0, len(x), most)])
        loss, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
        for y in self.axes(x, table):
            order = np.argsort(-y, 1, kind="stable")[:, :probes]
            value = np.take_along_axis(y, order, 1)
            loss = (loss[:, :, None] + ((value[:, :1] - value) ** 2)[:, None]).reshape(len(x), -1)
            code = (code[:, :, None] * y.shape[1] + order[:, None]).reshape(len(x), -1)
            if loss.shape[1] > probes:  # losses add up, so the best of a part are among its best
                best = np.argpartition(loss, probes - 1, 1)[:, :probes]
                loss, code = np.take_along_axis(loss, best, 1), np.take_along_axis(code, best, 1)
        return code + table * self.cells


def _vectors(column: pa.Array, dtype: str, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dims)


def _classes(frame: DataFrame, dims: int, dtype: str) -> DataFrame:
    """cid (smallest id), ids (the NEAREST + 1 smallest), vec: distinct vectors. Each batch combines first."""

    def run(batches):
        for batch in batches:
            ids, vec = batch.column(0).to_numpy(), batch.column(1)
            x = vec.flatten().to_numpy().astype(dtype).reshape(-1, dims) + np.dtype(dtype).type(0)  # no -0.0
            raw = [r.tobytes() for r in x]
            code, _ = pd.factorize(pd.Series(raw, dtype=object))
            order = np.lexsort((ids, code))
            cuts = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]]) if len(code) else np.zeros(0, int)
            few = [np.unique(ids[order[a:b]])[: NEAREST + 1].tolist() for a, b in zip(cuts, [*cuts[1:], len(code)][: len(cuts)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([raw[order[a]] for a in cuts], pa.binary()), pa.array(few, pa.list_(pa.int64()))], ["vec", "ids"])

    few = frame.mapInArrow(run, "vec binary, ids array<long>").groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, NEAREST + 1).alias("ids"))
    return few.select(F.element_at("ids", 1).alias("cid"), "ids", "vec")


def _crowds(classes: DataFrame, shape: Shape, dtype: str, total: int) -> dict[int, int]:
    """Into how many pieces each crowded cell is split. Fewer than HOT cells are, as each holds more than a share."""

    def run(batches):
        for batch in batches:
            lifted = shape.lifted(_vectors(batch.column(0), dtype, shape.dims).astype(float), False)
            if len(lifted):
                cell, n = np.unique(np.concatenate([shape.cell(lifted, t) for t in range(TABLES)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    many = max(CROWD, total * TABLES / HOT)
    counts = classes.select("vec").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return {r.cell: -(-r.n // CROWD) for r in counts.where(F.col("n") > many).collect()}


def _dealt(frame: DataFrame, shape: Shape, dtype: str, buckets: int, crowds: dict[int, int], probes: int | None) -> DataFrame:
    """part, blob of the cells of each table (of queries, which have ``probes``: all probed cells)."""
    hot = np.array(sorted(crowds), np.int64)
    pieces = np.array([crowds[c] for c in hot.tolist()], np.int64)

    def split(row, cell, ids):
        """Piece of each entry; a query goes to all pieces of a crowded cell."""
        piece = np.zeros(len(cell), np.int64)
        if len(hot):
            at = np.searchsorted(hot, cell).clip(0, len(hot) - 1)
            n = np.where(hot[at] == cell, pieces[at], 1)
            if probes is None:
                piece = (mix(ids[row].astype(_U) + _U(SEED)) % n.astype(_U)).astype(np.int64)
            else:
                row, cell = np.repeat(row, n), np.repeat(cell, n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return row, cell, piece

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            x = _vectors(batch.column(1), dtype, shape.dims)
            lifted = shape.lifted(x.astype(float), probes is not None)
            if probes is not None:
                cells = np.concatenate([shape.probed(lifted, t, probes) for t in range(TABLES)], 1)
                row, cell = np.repeat(np.arange(len(ids)), cells.shape[1]), cells.ravel()
            else:
                cell = np.concatenate([shape.cell(lifted, t) for t in range(TABLES)])
                row = np.tile(np.arange(len(ids)), TABLES)
            row, cell, piece = split(row, cell, ids)
            part = (mix(mix(cell.astype(_U)) + piece.astype(_U)) % _U(buckets)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            to, lo = np.unique(part[order], return_index=True)
            blobs = []
            for a, b in zip(lo.tolist(), [*lo[1:].tolist(), len(order)], strict=True):
                mine = order[a:b]
                used, local = np.unique(row[mine], return_inverse=True)
                blobs.append(pack(np.array([int(probes is not None)]), ids[used], x[used].ravel(), local.astype(np.int32), cell[mine]))
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "blob"])

    return frame.mapInArrow(run, "part int, blob binary")


class _Best:
    """The NEAREST + 1 best classes of each query so far, by exact scores in double precision."""

    def __init__(self, q: np.ndarray, x: np.ndarray, ids: np.ndarray):
        self.q, self.x, self.ids = q, x, ids
        self.margin = 1e-5 * float(np.linalg.norm(q, axis=1).max() * np.linalg.norm(x, axis=1).max())
        self.least = np.full(len(q), -np.inf)
        self.key, self.score = np.zeros(0, np.int64), np.zeros(0)
        self.new: list[np.ndarray] = []
        self.waiting = 0

    def add(self, here: np.ndarray, there: np.ndarray, score: np.ndarray) -> None:
        """``score`` may be rounded: what is surely worse than the best so far is left out."""
        a, b = np.nonzero(score >= self.least[here][:, None])
        self.new.append(here[a].astype(np.int64) * len(self.ids) + there[b])
        self.waiting += len(a)
        if self.waiting > 1 << 20:
            self.settle()

    def settle(self) -> None:
        key = np.setdiff1d(np.unique(np.concatenate([*self.new, self.key])), self.key, True)
        self.new, self.waiting = [], 0
        here, there = np.divmod(key, len(self.ids))
        score = [np.einsum("ij,ij->i", self.q[here[a : a + 65536]].astype(float), self.x[there[a : a + 65536]].astype(float)) for a in range(0, len(key), 65536)]
        self.key, self.score = np.concatenate([self.key, key]), np.concatenate([self.score, *score])
        here, there = np.divmod(self.key, len(self.ids))
        order = np.lexsort((self.ids[there], -self.score, here))
        here = here[order]
        nth = np.arange(len(here)) - np.searchsorted(here, here)
        last = nth == NEAREST
        self.least[here[last]] = self.score[order][last] - self.margin
        self.key, self.score = self.key[order][nth <= NEAREST], self.score[order][nth <= NEAREST]


def _join(shape: Shape, dtype: str):
    """Best classes of each query over one part's cells: query_id, tag of its vector, cids, scores."""

    def run(batches):
        sides = ([], [])
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                head, *rest = unpack(raw)
                sides[int(head[0])].append(rest)
        if not sides[0] or not sides[1]:
            return
        got = []
        for side in sides:
            base = np.cumsum([0, *(len(s[0]) for s in side)])
            ids, x = np.concatenate([s[0] for s in side]), np.concatenate([s[1] for s in side]).reshape(-1, shape.dims)
            row = np.concatenate([s[2] + b for s, b in zip(side, base[:-1], strict=True)])
            cell = np.concatenate([s[3] for s in side])
            order = np.argsort(cell, kind="stable")
            got.append((ids, x, row[order], cell[order]))
        (ids, x, row, cell), (q_ids, q, q_row, q_cell) = got
        best = _Best(q, x, ids)
        cuts = np.flatnonzero(np.r_[True, q_cell[1:] != q_cell[:-1]])
        lo, hi = np.searchsorted(cell, q_cell[cuts], "left"), np.searchsorted(cell, q_cell[cuts], "right")
        for a, b, l, h in zip(cuts.tolist(), [*cuts[1:].tolist(), len(q_cell)], lo.tolist(), hi.tolist(), strict=True):
            for l0 in range(l, h, 1024):  # a crowded cell goes in blocks
                there = row[l0 : min(h, l0 + 1024)]
                for a0 in range(a, b, 1024):
                    here = q_row[a0 : min(b, a0 + 1024)]
                    best.add(here, there, q[here] @ x[there].T)
        best.settle()
        here, there = np.divmod(best.key, len(ids))
        if not len(here):
            return
        cuts = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
        at = pa.array(np.r_[cuts, len(here)], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[here[cuts]]), pa.array([q[i].tobytes() for i in here[cuts]], pa.binary()), pa.ListArray.from_arrays(at, pa.array(ids[there])), pa.ListArray.from_arrays(at, pa.array(best.score))], ["query_id", "vec", "cids", "scores"])

    return run


def search(frame: DataFrame, every: int = EVERY, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the NEAREST rows found for every row whose id is a multiple of ``every``
    (all other rows, if they are fewer).

    Vectors that are null, zero, hold a null or non-finite component, or have another length than most rows,
    and rows without id, take no part. Rows of one id and vector are one candidate; a query is not its own.
    Ties go to the smaller id. Components are taken as they are (``array<float>`` or ``array<double>``; of other
    types, as doubles). No cell has a cap; an empty table gives no rows.
    """
    spark = frame.sparkSession
    single = dict(frame.dtypes)[vector] == "array<float>"
    dtype, kind = ("f4", "array<float>") if single else ("f8", "array<double>")
    rows = frame.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("vec")).where("id is not null and vec is not null")
    rows = rows.where(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0))
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = lengths[0].n
    rows = rows.where(F.size("vec") == dims)
    classes = kept(_classes(rows, dims, dtype))

    def norms(batches):
        for batch in batches:
            x = _vectors(batch.column(0), dtype, dims).astype(float)
            if len(x):
                size = np.linalg.norm(x, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([float(size.max())]), pa.array([float(size.min())])], ["n", "most", "least"])

    total = classes.select("vec").mapInArrow(norms, "n long, most double, least double").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("least").alias("least")).first()
    shape = Shape(total.n, dims, total.most, total.least)
    buckets = max(parts(spark), -(-total.n * TABLES * dims * (4 if single else 8) // PART_BYTES))
    crowds = _crowds(classes, shape, dtype, total.n)

    def raw(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().astype(dtype).reshape(-1, dims) + np.dtype(dtype).type(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "vec"])

    # queries are a stated share of the rows
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).mapInArrow(raw, "id long, vec binary").distinct()
    queries = kept(asked.repartition(parts(spark), "id"))
    members = classes.select(F.col("cid").alias("c_cid"), "ids")

    def answers(queries: DataFrame, probes: int) -> DataFrame:
        """The best rows of each of ``queries`` (id, vec): query_id, tag, score, vec_id, rank."""
        dealt = _dealt(classes.select("cid", "vec"), shape, dtype, buckets, crowds, None).unionByName(_dealt(queries, shape, dtype, buckets, crowds, probes))
        found = dealt.repartitionById(buckets, "part").select("blob").mapInArrow(_join(shape, dtype), "query_id long, vec binary, cids array<long>, scores array<double>")
        pairs = found.select("query_id", F.xxhash64("vec").alias("tag"), F.explode(F.arrays_zip("cids", "scores")).alias("hit")).select("query_id", "tag", F.col("hit.cids").alias("cid"), F.col("hit.scores").alias("score"))
        pairs = pairs.groupBy("query_id", "tag", "cid").agg(F.max("score").alias("score"))
        best = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "cid")
        pairs = pairs.withColumn("k", F.row_number().over(best)).where(F.col("k") <= NEAREST + 1).select("query_id", "tag", "cid", "score")
        each = pairs.join(members, F.col("cid") == F.col("c_cid")).select("query_id", "tag", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
        order = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
        return kept(each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEAREST))

    probes, out = shape.probes, None
    while True:
        got = answers(queries, probes)
        whole = got.where(F.col("rank") == NEAREST).select(F.col("query_id").alias("w_id"), F.col("tag").alias("w_tag"))
        on = (F.col("id") == F.col("w_id")) & (F.xxhash64("vec") == F.col("w_tag"))
        short = queries.join(whole, on, "left_anti")
        if probes >= shape.cells or short.isEmpty():
            break
        got = got.join(whole, (F.col("query_id") == F.col("w_id")) & (F.col("tag") == F.col("w_tag")), "left_semi")
        out = got if out is None else out.unionByName(got)
        queries, probes = kept(short), min(shape.cells, 16 * probes)
    out = got if out is None else out.unionByName(got)
    return out.select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
