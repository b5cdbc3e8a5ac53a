"""Product quantisation of vectors with integer codebooks.

Components become integers floor(scale * x). A vector is cut into ``parts`` equal consecutive parts, and each part position has
a codebook of at most ``entries`` rows, at first the parts of the vectors with the smallest ids. In a round the codebooks are
broadcast (parts * entries rows, whatever the input); Arrow batches assign each part to its nearest entry by |x|^2 - 2xc + |c|^2,
with exact int64 matrix products and the first of equal distances; a task sums its parts by entry, a grouped shuffle merges these
sums, and each used entry becomes floor(sum / count). Everything is integer arithmetic, so no order of rows changes a result.

Vectors that are null or hold null or infinite or undefined components are left out. Rows with equal ids are all kept; as first
entries they count in order of their vectors, and a null id comes after all others. An empty table has no codebooks and no codes.
With fewer vectors than entries there are as many entries as vectors. Vectors of unequal sizes, of a size that the parts don't
divide, and components so large that squared distances would leave 64 bits, raise. Other columns pass through unread,
whatever their names. Texts play no role.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import spare_name, staged

#: Rows whose distances a task holds at once.
ROWS = 2048
#: Groups whose sums may be broadcast.
GROUPS = 100_000


@dataclasses.dataclass(frozen=True)
class Codebooks:
    entries: np.ndarray  # [part, entry, position], int64
    scale: int

    def sha256(self) -> str:
        """Of all components in order of part, entry and position, in decimal with commas between."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: bytes) -> np.ndarray:
        """The vector that a code stands for."""
        return np.concatenate([self.entries[p, c] for p, c in enumerate(code)]) / self.scale


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def integers(vectors: pa.Array, scale: int, size: int | None = None) -> np.ndarray:
    """Rows of integers; ``size`` is what each vector must have."""
    lengths = np.diff(vectors.offsets.to_numpy())
    size = int(lengths[0]) if size is None else size
    if (lengths != size).any():
        raise ValueError(f"vectors of sizes {size} and {lengths[lengths != size][0]}")
    x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)  # of float32, times a power of two: exact
    if len(x) and 4.0 * size * np.abs(x).max() ** 2 >= 2.0**62:
        raise ValueError(f"a component of size {np.abs(x).max() / scale:g}: squared distances would leave 64 bits")
    return x.astype(np.int64).reshape(-1, size)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of integers: the index of each part's nearest entry, and the squared distances summed over parts."""
    n, parts = len(x), len(books)
    index, error = np.empty((n, parts), np.int64), np.zeros(n, np.int64)
    for p, (part, book) in enumerate(zip(np.split(x, parts, axis=1), books)):
        norms = (book * book).sum(1)
        for at in range(0, n, ROWS):
            rows = slice(at, at + ROWS)
            own = part[rows]
            d = norms - 2 * (own @ book.T)
            first = d.argmin(1)
            index[rows, p] = first
            error[rows] += d[np.arange(len(first)), first] + (own * own).sum(1)
    return index, error


def _partial_sums(books, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = books.value
        parts, n, width = entries.shape
        count, total = np.zeros((parts, n), np.int64), np.zeros((parts, n, width), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            x = integers(batch["_vector"], scale, parts * width)
            for p, (i, part) in enumerate(zip(nearest(x, entries)[0].T, np.split(x, parts, axis=1))):
                order = np.argsort(i, kind="stable")
                used, at = np.unique(i[order], return_index=True)
                total[p, used] += np.add.reduceat(part[order], at)
                count[p] += np.bincount(i, minlength=n)
        p, e = np.nonzero(count)
        # at -1: how many parts an entry has
        values = np.concatenate((count[p, e][:, None], total[p, e]), 1)
        shape = values.shape
        grid = lambda v: np.broadcast_to(v, shape).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(grid(v).astype(t)) for v, t in ((p[:, None], np.int32), (e[:, None], np.int32), (np.arange(-1, width), np.int32), (values, np.int64))], ["part", "entry", "at", "value"])

    return run


def train(vectors: DataFrame, *, id_col: str, vector_col: str, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks | None:
    """Codebooks of all vectors, or None without any. Only codebooks and their sums come to the driver."""
    kept = vectors.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_vector"))
    first = kept.orderBy(F.asc_nulls_last("_id"), "_vector").limit(entries).select("_vector").toArrow()["_vector"].combine_chunks()
    if not len(first):
        return None
    start = integers(first, scale)
    if start.shape[1] % parts:
        raise ValueError(f"{parts} equal parts of vectors of size {start.shape[1]}")
    books = np.stack(np.split(start, parts, axis=1))
    spark = vectors.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        sums = kept.select("_vector").mapInArrow(_partial_sums(sent, scale), "part int, entry int, at int, value long")
        table = sums.groupBy("part", "entry", "at").agg(F.sum("value").alias("value")).toArrow()
        p, e, at, value = (table[c].to_numpy() for c in ("part", "entry", "at", "value"))
        total = np.zeros((parts, books.shape[1], books.shape[2] + 1), np.int64)
        total[p, e, at + 1] = value
        count = total[:, :, :1]
        books = np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), books)
        sent.destroy()
    return Codebooks(books, scale)


def _encoder(books, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = books.value
        for batch in batches:
            if len(batch):
                index, error = nearest(integers(batch["_vector"], scale, entries.shape[0] * entries.shape[2]), entries)
                code = pa.array([r.tobytes() for r in index.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c != "_vector"), code, pa.array(error)], [*(c for c in batch.schema.names if c != "_vector"), "_code", "_error"])

    return run


def encode(vectors: DataFrame, books: Codebooks | None, *, vector_col: str, code_col: str = "code", error_col: str = "error", columns: list[str] | None = None) -> DataFrame:
    """Rows with a usable vector, of them ``columns`` (all, without the vector), the code (a byte a part) and the squared error."""
    kept = vectors.filter(usable(F.col(vector_col)))
    names = [c for c in vectors.columns if c != vector_col] if columns is None else list(columns)
    rows = kept.select(F.struct(*(F.col(f"`{c}`").alias(c) for c in names)).alias("_row"), F.col(vector_col).alias("_vector"))
    kind = rows.schema["_row"].dataType.simpleString()
    if books is None:
        coded = rows.limit(0).select("_row", F.lit(None).cast("binary").alias("_code"), F.lit(None).cast("long").alias("_error"))
    else:
        if books.entries.shape[1] > 256:
            raise ValueError("a code holds a byte for each part: at most 256 entries")
        coded = rows.mapInArrow(_encoder(vectors.sparkSession.sparkContext.broadcast(books.entries), books.scale), f"_row {kind}, _code binary, _error long")
    return coded.select(*(F.col("_row").getField(c).alias(c) for c in names), F.col("_code").alias(code_col), F.col("_error").alias(error_col))


def group_errors(coded: DataFrame, group_col: str, error_col: str = "error", *, out_col: str = "group_error", most: int = GROUPS) -> DataFrame:
    """coded with the sum of errors over rows of an equal group, nulls together.

    The sums, a row a group, are broadcast if there are at most ``most``, else joined by a shuffle that adaptive execution may split.
    """
    group, total = spare_name(coded, "_group"), spare_name(coded, out_col)
    sums = staged(coded.groupBy(F.col(group_col).alias(group)).agg(F.sum(error_col).alias(total)), "group-errors")
    sums = F.broadcast(sums) if sums.limit(most + 1).count() <= most else sums
    return coded.join(sums, F.col(group_col).eqNullSafe(F.col(group)), "left").drop(group)
