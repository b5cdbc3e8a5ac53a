"""The best rows of each query, block by block: a product of matrices in place of a row for each pair.

Rows and queries are dealt into slices by hashes of their ids, and each slice of rows meets each slice of queries in one group of a
cogroup. A group finds, in single precision and within a bound of its error, which pairs can be among the n best of a query; these
alone are scored in double, term after term as ``functions.vectors.cosine`` does, so the scores are the same to the last bit. A group gives n rows
a query and list, and what ranks them in whole sees no other pairs. The number of groups grows with the pairs, a group's size does not.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and queries of a group, pairs evaluated at a time, and neighbouring rows of which the largest score is taken first.
ROWS, QUERIES, PAIRS, RUN = 32_768, 2_048, 1 << 22, 64


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as a matrix with NaN for what is null, and which of them have no score for being null or holding null."""
    column = column.combine_chunks()
    lengths = pc.list_value_length(column)
    known = np.asarray(lengths.is_valid())
    sizes = np.unique(lengths.drop_null().to_numpy())
    if len(sizes) > 1:
        raise ValueError(f"vectors of sizes {sizes[0]} and {sizes[-1]}")
    flat = column.flatten()
    size = int(sizes[0]) if len(sizes) else 0
    out = np.full((len(column), size), np.nan)
    out[known] = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(known.sum(), size)
    void = ~known
    void[known] = np.asarray(flat.is_null()).reshape(known.sum(), size).any(1) if flat.null_count else False
    return out, void


def _norms(x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * x[:, j]
    return np.sqrt(total)


def _postings(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(items in order, the rows that hold them) of lists without repeats."""
    column = column.combine_chunks()
    items = column.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy())
    order = np.argsort(items, kind="stable")
    return items[order], rows[order]


def _near(approx: np.ndarray, n: int, margin: float) -> np.ndarray:
    """Which places of each line can be among its n largest, if values are off by half of margin; -inf are none, NaN may be any.

    The n-th largest of the maxima of short runs is not above the n-th largest of all, so it is a bound, and a quick one.
    """
    odd = np.isnan(approx)
    values = np.where(odd, -np.inf, approx) if odd.any() else approx
    full = values.shape[1] // RUN
    if full >= 2 * n:
        tops = values[:, : full * RUN].reshape(len(values), full, RUN).max(2)
        least = np.partition(tops, full - n, axis=1)[:, full - n]
    elif values.shape[1] > n:
        least = np.partition(values, values.shape[1] - n, axis=1)[:, values.shape[1] - n]
    else:
        least = np.full(len(values), -np.inf, values.dtype)
    return ((values >= (least - margin)[:, None]) & (values > -np.inf)) | odd


def _group(n: int, id_col: str, vector_col: str, kept: Sequence[str], grams: bool, others: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids = rows[id_col].to_numpy()
        x, x_void = _vectors(rows[vector_col])
        q, q_void = _vectors(asked["query_vec"])
        if len(ids) and len(q) and not q_void.all() and not x_void.all() and x.shape[1] != q.shape[1]:
            raise ValueError(f"vectors of sizes {x.shape[1]} and {q.shape[1]}")
        x_norm, q_norm = _norms(x), _norms(q)
        columns = np.ascontiguousarray(x.T), np.ascontiguousarray(q.T)
        with np.errstate(all="ignore"):
            unit = [np.where(length[:, None] == 0, 0.0, v / length[:, None]).astype(np.float32) for v, length in ((x, x_norm), (q, q_norm))]
        for u, length in zip(unit, (x_norm, q_norm)):
            u[~np.isfinite(length)] = np.nan
        margin = np.float32((x.shape[1] + 8) * 2.4e-7)
        items, holders = _postings(rows["_held"]) if grams else (None, None)
        wanted = asked["_grams"].to_pylist() if grams else [[]] * len(q)
        order = np.argsort(ids, kind="stable")
        query_ids = asked["query_id"].to_numpy() if others else None

        def scores(qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
            total = np.zeros(len(qi))
            for a, b in zip(*columns):
                total += a[xi] * b[qi]
            length = x_norm[xi] * q_norm[qi]
            with np.errstate(all="ignore"):
                return np.where(length == 0, 0.0, total / length)

        found = []
        step = max(1, PAIRS // max(1, len(ids)))
        for at in range(0, len(q) if len(ids) else 0, step):
            block = slice(at, min(at + step, len(q)))
            if x.shape[1] == q.shape[1]:
                approx = unit[1][block] @ unit[0].T
            else:  # one side has null vectors alone
                approx = np.full((block.stop - at, len(ids)), np.nan, np.float32)
            if others:
                low, high = (np.searchsorted(ids, query_ids[block], side, sorter=order) for side in ("left", "right"))
                for k in np.flatnonzero(high > low):
                    approx[k, order[low[k] : high[k]]] = -np.inf
            matched = np.zeros(approx.shape, np.int32) if any(wanted[block]) else None
            for k, grams_of in enumerate(wanted[block] if matched is not None else ()):
                first, end = (np.searchsorted(items, sorted(set(grams_of)), side) for side in ("left", "right"))
                held = [holders[a:b] for a, b in zip(first, end)]
                matched[k] = np.bincount(np.concatenate(held), minlength=len(ids)) if held else 0
            lists = [approx] if matched is None else [np.where(matched > 0, approx, -np.inf), np.where(matched > 0, -np.inf, approx)]
            for values in lists:
                qi, xi = np.nonzero(_near(values, n, margin))
                none = q_void[qi + at] | x_void[xi]
                s = scores(qi + at, xi) if x.shape[1] == q.shape[1] else np.full(len(qi), np.nan)
                key = np.where(none, -np.inf, np.where(np.isnan(s), np.inf, s))
                best = np.lexsort((ids[xi], -key, qi))
                starts = np.searchsorted(qi[best], np.arange(block.stop - at))
                best = best[np.arange(len(best)) - starts[qi[best]] < n]
                count = np.zeros(len(best), np.int32) if matched is None else matched[qi[best], xi[best]]
                found.append((qi[best] + at, xi[best], s[best], none[best], count))
        empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool), np.empty(0, np.int32))
        qi, xi, s, none, count = (np.concatenate(c) for c in zip(*(found or [empty])))
        out = [asked["query_id"].take(pa.array(qi)), *(rows[c].take(pa.array(xi)) for c in kept), pa.array(s, mask=none)]
        names = ["query_id", *kept, "score"]
        if grams:
            sizes = np.array([len(g) for g in wanted], np.int32)
            out, names = [*out, pa.array(count), pa.array(sizes[qi])], [*names, "matched", "n_grams"]
        return pa.table(dict(zip(names, out)))

    return run


def best(rows: DataFrame, queries: DataFrame, n: int, *, id_col: str = "segment_index", vector_col: str = "embedding", keys: Sequence[str] = (), others: bool = False) -> DataFrame:
    """Pairs with ``score`` (cosine) that can be among the n best of a query (query_id, query_vec) by score and id: all that are, and few more.

    Columns of rows are kept but the vector. With ``keys``, columns of both, pairs have equal ones (null equals nothing). With ``others``, a row
    whose id is the query's is no pair of it. If rows have ``_held`` and queries ``_grams`` (arrays of numbers), pairs have ``matched`` and
    ``n_grams`` too, and the n best with a match and the n best without are given. Vectors of unequal sizes raise.
    """
    rows = rows.filter(F.col(vector_col).isNotNull())
    for k in keys:
        rows, queries = rows.filter(F.col(k).isNotNull()), queries.filter(F.col(k).isNotNull())
    grams = "_held" in rows.columns
    queries = queries.select("query_id", "query_vec", *keys, *(["_grams"] if grams else []))
    most = [side.drop("_held", "_grams").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.count(F.lit(1))).first() for side in (rows, queries)]
    slices = [max(1, -(-(m[0] or 0) // size)) for m, size in zip(most, (ROWS, QUERIES))]
    part = lambda c, k: F.pmod(F.xxhash64(c), F.lit(slices[k])).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(slices[k] - 1)))
    by = [*keys, "_rows", "_queries"]
    tasks = min(2000, 3 * max(1, most[0][1]) * slices[0] * slices[1])  # groups fall into tasks by a hash
    left = rows.withColumns({"_rows": part(id_col, 0), "_queries": every(1)}).repartition(tasks, *by)
    right = queries.withColumns({"_rows": every(0), "_queries": part("query_id", 1)}).repartition(tasks, *by)
    kept = [c for c in rows.columns if c not in (vector_col, "_held")]
    fields = [f"query_id {queries.schema['query_id'].dataType.simpleString()}", *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "score double", *(["matched int", "n_grams int"] if grams else [])]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_group(n, id_col, vector_col, kept, grams, others), ", ".join(fields))
