"""Inverted-file index of vectors: cells around centres, and a search that looks into a few of them.

Centres are found by integer k-means (components as floor(SCALE * x)) on a bounded sample: the ``sample`` rows whose ids have the
smallest MD5, the first of which are the first centres. Every row is then put into the cell of its nearest centre (the lowest
of equal ones) and written with its cell as a partition, so a search reads the cells that its queries probe and no others. Rows
that come later are appended with the same centres. A query takes its ``probes`` nearest cells; filters on rows apply before
ranking, so a filtered search still fills its list from these cells. The exact way stays in ``retrieval``; ``recall`` compares.

Null vectors are left out. Vectors of unequal sizes raise, and so does an index of no vectors, which has no centres to search by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine, norm
from . import nearest, retrieval

#: With vectors that hardly cluster about half of the cells must be looked into for a recall of 0.9; clustered ones need few.
CELLS, PROBES, SAMPLE, ROUNDS, SCALE = 128, 64, 20_000, 5, 1024


@dataclass(frozen=True)
class Index:
    """rows has all columns of what was indexed, and cell; centres is an array of integers [cell, position]."""

    rows: DataFrame
    centres: np.ndarray


def _integers(vectors: pa.Array | pa.ChunkedArray, size: int | None = None) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.diff(vectors.offsets.to_numpy())
    size = size if size is not None else int(lengths[0]) if len(lengths) else 0
    if (lengths != size).any():
        raise ValueError(f"vectors of sizes {size} and {lengths[lengths != size][0]}")
    x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    return x.astype(np.int64).reshape(len(lengths), size)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, without the part that is the same for all centres."""
    return (centres * centres).sum(1) - 2 * (x @ centres.T)


def fit(vectors: DataFrame, *, id_col: str, vector_col: str, cells: int = CELLS, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of a sample of at most ``sample`` rows; as many as there are rows if these are fewer."""
    order = F.md5(F.col(id_col).cast("string"))
    rows = vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).orderBy(order, "id").limit(sample)
    x = _integers(rows.select("v").toArrow()["v"])
    centres = x[:cells].copy()
    for _ in range(rounds if len(x) else 0):
        at = _distances(x, centres).argmin(1)
        for c in np.unique(at):
            centres[c] = x[at == c].sum(0) // (at == c).sum()
    return centres


def _nearest(centres, n: int, column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Appends the n nearest cells of ``column``: a number if n is 1, else a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for batch in batches:
            if not len(batch):
                continue
            found = []
            for at in range(0, len(batch), 4096):
                d = _distances(_integers(batch[column].slice(at, 4096), c.shape[1]), c)
                found.append(d.argmin(1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n])
            cell = np.concatenate(found).astype(np.int32)
            out = pa.array(cell[:, 0]) if n == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(cell) + 1) * cell.shape[1], pa.int32()), pa.array(cell.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "cell"])

    return run


def in_cells(vectors: DataFrame, centres: np.ndarray, *, vector_col: str) -> DataFrame:
    """Rows that have a vector, with their cell."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)  # cells * size numbers
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.filter(F.col(vector_col).isNotNull()).mapInArrow(_nearest(sent, 1, vector_col), f"{kind}, cell int")


def build(vectors: DataFrame, path: str, *, id_col: str, vector_col: str, cells: int = CELLS, sample: int = SAMPLE, rounds: int = ROUNDS) -> Index:
    """Write the index of vectors to ``path``: centres, and rows with a partition for each cell, of files that are neither tiny nor huge."""
    spark = vectors.sparkSession
    centres = fit(vectors, id_col=id_col, vector_col=vector_col, cells=cells, sample=sample, rounds=rounds)
    if not len(centres):
        raise ValueError("no vectors: an index of no rows has no centres")
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<long>").coalesce(1).write.parquet(f"{path}/centres")
    in_cells(vectors, centres, vector_col=vector_col).hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    centres = [r["centre"] for r in spark.read.schema("cell int, centre array<long>").parquet(f"{path}/centres").orderBy("cell").collect()]
    return Index(spark.read.parquet(f"{path}/rows"), np.array(centres, np.int64))


def add(index: Index, vectors: DataFrame, path: str, *, vector_col: str) -> Index:
    """Append rows to the index at ``path``; its centres stay."""
    in_cells(vectors, index.centres, vector_col=vector_col).hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{path}/rows")
    return load(vectors.sparkSession, path)


def probed(queries: DataFrame, centres: np.ndarray, probes: int = PROBES) -> DataFrame:
    """queries (query_id, query_vec) with a row for each of their nearest cells."""
    asked = queries.filter(F.col("query_vec").isNotNull()).select("query_id", "query_vec")
    sent = queries.sparkSession.sparkContext.broadcast(centres)
    n = min(probes, len(centres))
    kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, query_vec {queries.schema['query_vec'].dataType.simpleString()}"
    return asked.mapInArrow(_nearest(sent, n, "query_vec"), f"{kind}, cell {'int' if n == 1 else 'array<int>'}").withColumn("cell", F.col("cell") if n == 1 else F.explode("cell"))


def scored(index: Index, queries: DataFrame, *, vector_col: str, probes: int = PROBES) -> DataFrame:
    """Rows of the cells that each query probes, with ``score`` (cosine), as ``retrieval.vector_candidates`` ranks them.

    Queries are broadcast, and so prune cells that none of them probes, if they are below retrieval.QUERIES_BYTES; else both sides meet by a shuffle on cells.
    """
    asked = probed(queries, index.centres, probes).withColumn("_query_norm", norm(F.col("query_vec")))
    size = queries.agg(F.coalesce(F.sum(F.size("query_vec") * 8 + 64), F.lit(0))).first()[0] * min(probes, len(index.centres))
    pairs = index.rows.withColumn("_norm", norm(F.col(vector_col))).join(F.broadcast(asked) if size <= retrieval.QUERIES_BYTES else asked, "cell")
    score = cosine(F.col(vector_col), F.col("query_vec"), F.col("_norm"), F.col("_query_norm"))
    return pairs.withColumn("score", score).drop(vector_col, "query_vec", "_norm", "_query_norm")


def nearest_rows(index: Index, queries: DataFrame, n: int, *, id_col: str, vector_col: str, probes: int = PROBES) -> DataFrame:
    """Of the pairs of ``scored``, those that can be among a query's n best: each cell's rows meet the queries that probe it in blocks.

    Cells that no query probes are not read.
    """
    asked = probed(queries, index.centres, probes)
    rows = index.rows.join(F.broadcast(asked.select("cell").distinct()), "cell", "left_semi")  # at most a row a cell
    return nearest.best(rows, asked, n, id_col=id_col, vector_col=vector_col, keys=["cell"])


def recall(exact: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """One row: queries, wanted and found rows of the exact lists (query_id, id_col), and their share."""
    hit = exact.join(found.select("query_id", id_col, F.lit(1).alias("_hit")), ["query_id", id_col], "left")
    out = hit.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("wanted"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("found"))
    return out.withColumn("recall", F.when(F.col("wanted") > 0, F.col("found") / F.greatest("wanted", F.lit(1))))
