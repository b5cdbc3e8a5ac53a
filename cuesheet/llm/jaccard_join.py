"""Exact join of documents by the Jaccard similarity of their word n-grams, with signature trees.

Documents with equal sets form a class, and one document of a class goes on. Sets are put in an order common to all: by the count of a
shingle's cell over all documents (CELLS cells, so a common shingle comes late), then by hash. Sets that are similar enough share
a shingle of their prefixes in that order. A set stands in the node of its most shared prefix shingle, with sets of like size, and
each node's signature tree is traversed against itself. One set of each component found goes on to the next level, where nodes hold
such representatives, as long as a level joins one in WORTH; so a group of any size is joined in linear time. At last the
sets whose prefixes still meet other components go through ``signature_tree.between``, which is exact.

A-Z are lower-cased, words are split at ASCII white space; a text of fewer words is one shingle. Null and empty texts, or texts
without words, have an empty set and are linked with nothing. Very long texts are taken whole: a set and its prefix are a row. Repeated
rows are copies like any others. A null id comes after all others. An empty table gives none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import signature_tree
from .classes import first_rows, named, representatives, slim, texts_of
from .graph import components
from .minhash import _WordHashes, shingle_set, shingles
from .staging import light, release, staged

#: Cells of the counts that order shingles (8 MiB), sent in slices.
CELLS, SLICE = 1 << 20, 1 << 14
WORTH, LEVELS = 5, 8


def _cells(s: np.ndarray) -> np.ndarray:
    return ((s >> np.uint64(24)) & np.uint64(CELLS - 1)).astype(np.int64)


def _cell_counts(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, count, held, n = _WordHashes(), np.zeros(CELLS, np.int64), [], 0
        for batch in batches:
            for text in batch["_text"]:
                held.append(_cells(shingles(text.as_py(), size, hashes)))
                n += len(held[-1])
                if n >= CELLS:
                    count += np.bincount(np.concatenate(held), minlength=CELLS)
                    held, n = [], 0
        if held:
            count += np.bincount(np.concatenate(held), minlength=CELLS)
        used = [k for k in range(CELLS // SLICE) if count[k * SLICE : (k + 1) * SLICE].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([count[k * SLICE : (k + 1) * SLICE].tobytes() for k in used], pa.binary())], ["slice", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, each in zip(batch["slice"].to_pylist(), batch["counts"]):
            part = np.frombuffer(each.as_buffer(), np.int64)
            total[k] = total[k] + part if k in total else part
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "counts"])


def cell_counts(rows: DataFrame, size: int) -> np.ndarray:
    """How many shingles of all documents fall into each cell, those that repeat too."""
    kind = "slice int, counts binary"
    parts = rows.select("_text").mapInArrow(_cell_counts(size), kind).repartition("slice").mapInArrow(_summed, kind)
    out = np.zeros(CELLS, np.int64)
    for k, part in parts.collect():  # CELLS numbers in all
        out[k * SLICE : (k + 1) * SLICE] = np.frombuffer(part, np.int64)
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Cells in order of their counts, as numbers of 16 bits."""
    out = np.empty(len(counts), np.int64)
    out[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    return (out * (1 << 16) // len(counts)).astype(np.uint16)


def _prefixed(size: int, percent: int, counts) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, cells = _WordHashes(), counts.value
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch, n, names, prefixes, short = whole.slice(at, 1000), [], [], [], []
                for row, text in zip(batch["_row"].to_pylist(), batch["_text"]):
                    s = shingle_set(text.as_py(), size, hashes)
                    n.append(len(s))
                    names.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else b"row" + row.to_bytes(8, "big"))  # an empty set is a class of its own
                    few, many = signature_tree.prefix_lengths(len(s), percent) if len(s) else (0, 0)
                    order = np.argsort(cells[_cells(s)], kind="stable")  # then by hash: s is sorted
                    prefixes.append(s[order[:many]].view(np.int64))
                    short.append(few)
                ends = pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32())
                keys = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *prefixes])))
                cols = [batch["_row"], batch["_id"], batch["_hash"], pa.array(n, pa.int64()), pa.array(names, pa.binary()), keys, pa.array(short, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["_row", "_id", "_hash", "_n", "_class", "_prefix", "_short"])

    return run


def _set_of(size: int) -> Callable[[pa.Scalar], np.ndarray]:
    hashes = _WordHashes()
    return lambda text: shingle_set(text.as_py().decode(), size, hashes)


def similar_documents(docs: DataFrame, *, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, _hash (of the text), n_shingles, component_id (smallest id reachable by links), first (whether it is that document).

    Links: 100 * intersection >= percent * union of the sets of ``size``-word shingles.
    """
    rows = slim(docs, id_col, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    counts = docs.sparkSession.sparkContext.broadcast(ranks(cell_counts(rows, size)))
    sketch = staged(rows.mapInArrow(_prefixed(size, percent, counts), f"_row long, _id {id_type}, _hash long, _n long, _class binary, _prefix array<long>, _short int"), "prefixes")
    counts.destroy()
    classes = first_rows(sketch)

    reps = representatives(sketch, light(classes, 64))  # else prefixes are shuffled
    keyed = staged(reps.select("_row", "_short", F.posexplode("_prefix").alias("_at", "_shingle")).select("_row", "_shingle", (F.col("_at") < F.col("_short")).alias("_short")), "keys")
    shared = keyed.groupBy("_shingle").agg(F.count(F.lit(1)).alias("_many"), F.max("_short").alias("_any")).filter("_many > 1 and _any").select("_shingle", "_many")
    keys = staged(keyed.join(shared, "_shingle"), "shared-keys")
    release(keyed)
    members = keys.groupBy("_row").agg(F.max(F.struct("_many", "_shingle")).alias("_most"), F.sum("_many").alias("_mates"))
    members = staged(members.join(sketch.select("_row", "_n"), "_row").select("_row", "_n", F.col("_most._shingle").alias("_cluster"), "_mates"), "members")
    # texts stand for their sets: they are shorter, and a set is made of one in the time that it takes to read it
    sets = staged(texts_of(rows, sketch, members.select("_row")).select("_row", F.encode("_text", "UTF-8").alias("_set")), "texts")
    decode = _set_of(size)

    level, found, label = members.withColumn("_c", F.col("_row")), None, None
    for _ in range(LEVELS):
        more = signature_tree.inside(level.select("_row", "_c", "_cluster", "_n"), sets, percent, decode)
        found = more if found is None else found.unionByName(more)
        if label is not None:
            release(label)
        label = components(found)
        if more.count() * WORTH <= level.count():
            break
        # of each component the set with most mates
        placed = members.join(label.withColumnRenamed("node", "_row"), "_row", "left").withColumn("_c", F.coalesce("label", "_row"))
        best = placed.groupBy("_c").agg(F.max_by(F.struct("_row", "_cluster", "_n"), F.struct("_mates", "_row")).alias("_best"))
        grown = more.select(F.col("a").alias("_row")).join(members, "_row").select("_cluster").distinct()  # where no set was linked, none will be
        level = staged(best.select("_c", "_best.*").join(grown, "_cluster", "left_semi"), "level")

    left = keys.select("_shingle", "_row", "_short").join(label.withColumnRenamed("node", "_row"), "_row", "left").withColumn("_c", F.coalesce("label", "_row"))
    mixed = left.groupBy("_shingle").agg(F.min("_c").alias("_min"), F.max("_c").alias("_max")).filter("_min < _max").select("_shingle")
    left = staged(left.join(mixed, "_shingle"), "left")
    release(keys)
    if left.limit(1).count():
        apart = left.select("_row", "_c").distinct().join(members.drop("_mates"), "_row")
        more = signature_tree.between(left.select("_row", "_shingle", "_short"), apart, sets, percent, decode)
        if more.limit(1).count():
            release(label)
            label = components(found.unionByName(more))
    for x in (left, sets):
        release(x)
    return named(sketch, classes, label, id_col)
