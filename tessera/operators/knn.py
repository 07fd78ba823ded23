"""Exact cosine neighbours of asked vectors: products of blocks of both sides, in bounded memory.

A task reads its rows block by block and holds, for each asked vector, the best so far. Products of matrices choose
the pairs that may be among them; their cosines are then summed in the order of the components, as SQL sums them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Asked vectors of one pass over the rows, and asked vectors and rows of a product.
PASS, BLOCK = 1 << 16, 1024
#: Cosines that round to the same nine digits differ by less.
MARGIN = 2e-9
#: Pairs whose cosines are summed at once.
PAIRS = 1 << 17


def _vectors(column) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, vectors, norms) for each length; null vectors and those with null components are in none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.array(column.value_lengths().fill_null(-1))
    flat = column.flatten()
    known = np.array(flat.is_valid())
    flat = np.array(flat.fill_null(0), np.float64)
    start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    out = []
    for length in np.unique(size[size >= 0]).tolist():
        at = np.flatnonzero(size == length)
        cells = start[at][:, None] + np.arange(length)
        whole = known[cells].all(axis=1)
        at, v = at[whole], flat[cells[whole]]
        total = np.zeros(len(at))
        for d in range(length):
            total += v[:, d] * v[:, d]
        out.append((at, v, np.sqrt(total)))
    return out


def _best(q: np.ndarray, s: np.ndarray, vec: np.ndarray, same: np.ndarray, k: int):
    """What may be among each q's k best after rounding, ordered, and the k-th best values less MARGIN (q, value)."""
    order = np.lexsort((vec, -s, q))
    q, s, vec, same = q[order], s[order], vec[order], same[order]
    if not len(q):
        return (q, s, vec, same), (q, s)
    begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    count = np.diff(np.r_[begin, len(q)])
    least = np.where(count >= k, s[np.minimum(begin + k - 1, len(q) - 1)] - MARGIN, -np.inf)
    run = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (s[1:] != s[:-1])])
    within = np.arange(len(q)) - np.repeat(run, np.diff(np.r_[run, len(q)]))
    stay = (s >= np.repeat(least, count)) & (within < k)
    return (q[stay], s[stay], vec[stay], same[stay]), (q[begin], least)


def _pass(rows: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    with pa.BufferOutputStream() as sink:
        with pa.ipc.new_stream(sink, asked.schema) as writer:
            writer.write_table(asked)
        raw = sink.getvalue().to_pybytes()

    def run(batches):
        asked = pa.ipc.open_stream(raw).read_all()
        blocks = []
        for at in range(0, asked.num_rows, BLOCK):
            part = asked.slice(at, BLOCK).combine_chunks()
            label = part.column("label").to_pylist()
            blocks.append([part.column("vec_id").to_numpy(), np.array([x if x is not None else np.nan for x in label], float), _vectors(part.column("v")), None, np.full(part.num_rows, -np.inf)])
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                part = part.take(pa.array(np.argsort(part.column(0).to_numpy(), kind="stable")))
                vec, mine = part.column(0).to_numpy(), _vectors(part.column(2))
                label = np.array(part.column(1).fill_null(0), float)
                label[np.array(part.column(1).is_null())] = np.nan
                for block in blocks:
                    _meet(block, vec, label, mine, k)
        for ids, _, _, held, _ in blocks:
            if held is not None and len(held[0]):
                q, s, vec, same = held
                value = pa.array(np.where(s == np.inf, np.nan, s), mask=s == -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(vec), pa.array(same), value], ["q", "vec_id", "same", "s"])

    return rows.mapInArrow(run, "q long, vec_id long, same long, s double")


def _meet(block: list, vec: np.ndarray, label: np.ndarray, mine: list, k: int) -> None:
    ids, wanted, theirs, held, least = block
    # no cosine (null, other lengths): last; not a number (zero or non-finite vectors): first, as SQL orders them
    near = np.full((len(ids), len(vec)), -np.inf)
    where_q, where_v = np.zeros(len(ids), np.int64), np.zeros(len(vec), np.int64)
    lengths = {v.shape[1]: (at, v, m) for at, v, m in mine}
    both = [(a, lengths[a[1].shape[1]]) for a in theirs if a[1].shape[1] in lengths and len(a[0]) and len(lengths[a[1].shape[1]][0])]
    for (q_at, qv, qm), (v_at, v, m) in both:
        where_q[q_at], where_v[v_at] = np.arange(len(q_at)), np.arange(len(v_at))
        with np.errstate(all="ignore"):
            cosine = (qv / qm[:, None]) @ (v / m[:, None]).T
            cosine[~np.isfinite(cosine)] = np.inf
        near[np.ix_(q_at, v_at)] = cosine
    if len(vec) > k + 1 and np.isneginf(least).any():
        # the k-th best of this block alone, beside the asked row itself
        least = np.maximum(least, np.partition(near, len(vec) - k - 1, axis=1)[:, len(vec) - k - 1] - MARGIN)
    may = near >= least[:, None]
    odd = ~np.isfinite(near)
    if odd.any():
        for value in (np.inf, -np.inf):
            those = near == value
            may &= ~those | (np.cumsum(those, axis=1) <= k + 1)
    q, at = np.nonzero(may)
    other = ids[q] != vec[at]
    q, at = q[other], at[other]
    if not len(q):
        return
    s = near[q, at]
    exact = np.flatnonzero(np.isfinite(s))
    for (q_at, qv, qm), (v_at, v, m) in both:
        here = exact[np.isin(q[exact], q_at) & np.isin(at[exact], v_at)] if len(both) > 1 else exact
        for lo in range(0, len(here), PAIRS):
            x = here[lo : lo + PAIRS]
            i, j = where_q[q[x]], where_v[at[x]]
            total = np.zeros(len(x))
            for d in range(qv.shape[1]):
                total += v[j, d] * qv[i, d]
            s[x] = total / (m[j] * qm[i])
    new = q, s, vec[at], (label[at] == wanted[q]).astype(np.int64)
    if held is not None:
        new = tuple(np.concatenate(c) for c in zip(held, new, strict=True))
    block[3], (some, value) = _best(*new, k)
    block[4] = least.copy()
    block[4][some] = np.maximum(least[some], value)


def neighbours(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """q, vec_id, same (1 for an equal label), s: of each asked vector's others all that can be among the k with the
    largest cosine, rounded to nine digits. Both have vec_id, label, embedding; the asked ones are held by the driver."""
    cut = lambda f: f.where("vec_id is not null").select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"))
    asked = cut(asked).toArrow()
    rows, out = cut(rows), None
    for at in range(0, max(1, asked.num_rows), PASS):
        part = _pass(rows, asked.slice(at, PASS), k)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("s", F.round("s", 9))
