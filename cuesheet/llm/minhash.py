"""MinHash near-duplicates with sequential Bayesian verification.

Documents with the same set of word shingles form a class, and only one document of a class goes on. A signature of
``bands`` x ``rows`` minima gives band keys; classes that share a key are candidates. First each member is compared with one
hub, the one with most mates over all bands that it meets in a bucket, which joins dense groups in linear time. In buckets that still
hold several components, members outside the largest are compared with one of its members, in a few rounds, as long as
one in ``WORTH`` of these pairs is a link. At last members of such buckets go through ``signature_tree.between_sets``, which finds
the links between their components exactly and moves nodes of sets, never pairs of them.

A pair is compared in batches of its one-byte signatures: it is dropped as soon as the posterior probability (uniform prior)
that its similarity reaches the threshold falls below ``miss``. Survivors are confirmed on their full sets, of 64-bit hashes of
shingles; equal sets are told by a 128-bit hash of these. At similarity 0.8, 40 bands of 6 rows miss a pair with probability 5e-6.

Null and empty texts have an empty set and are linked with nothing. Very long texts are taken whole: a set and its prefixes
are a row. Repeated rows are copies like any others. A null id comes after all others. Other columns pass through unread.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import signature_tree
from .classes import first_rows, named, representatives, slim, texts_of
from .graph import components
from .staging import packed, release, staged, unpacked

BANDS, ROWS, BATCH = 40, 6, 40
STAR_ROUNDS, WORTH = 3, 10
#: Distinct words whose hashes a task keeps.
KEPT_WORDS = 200_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _M3
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, size: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; of fewer words, of the whole sequence."""
    x = np.sort(shingles(text, size, hashes))  # much faster than np.unique
    return x[np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1]))]


def shingles(text: str | None, size: int, hashes: dict) -> np.ndarray:
    """``shingle_set`` in order of the text, with those that repeat."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, and only ASCII white space splits
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mixed(out * _M1 + h[k : len(h) - size + 1 + k] * _M2 + np.uint64(k))
    return out


@functools.cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return (rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1))[:, None], rng.integers(0, 1 << 32, n, np.uint32)[:, None]


def signature(s: np.ndarray, n: int) -> np.ndarray:
    """n minima of a set under n permutations of 32 bits."""
    a, b = _permutations(n)
    x = (s >> np.uint64(32)).astype(np.uint32)
    parts = [(a * x[i : i + 2048] + b).min(1) for i in range(0, len(x), 2048)]
    return parts[0] if len(parts) == 1 else np.minimum.reduce(parts)


def _sketches(size: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    salt = np.arange(bands, dtype=np.uint64) * _M1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            n, ids, sigs, keys = [], [], [], []
            for row, text in zip(batch["_row"].to_pylist(), batch["_text"]):
                s = shingle_set(text.as_py(), size, hashes)
                n.append(len(s))
                if not len(s):  # a class of its own
                    ids.append(b"row" + row.to_bytes(8, "big"))
                    sigs.append(None)
                    keys.append([])
                    continue
                ids.append(xxhash.xxh128_digest(s.tobytes()))
                sig = signature(s, bands * rows)
                sigs.append(sig.astype(np.uint8).tobytes())
                key = salt.copy()
                for part in sig.reshape(bands, rows).T.astype(np.uint64):
                    key = _mixed(key * _M2 + part)
                keys.append(key.view(np.int64))
            ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            keys = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *keys]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch["_row"], batch["_id"], batch["_hash"], pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary()), keys], ["_row", "_id", "_hash", "_n", "_class", "_sig", "_keys"])

    return run


def _sets(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part["_row"], pa.array([shingle_set(t.as_py(), size, hashes).tobytes() for t in part["_text"]], pa.binary())], ["_row", "_set"])

    return run


@functools.cache
def least_matches(n_hashes: int, batch: int, threshold: float, miss: float) -> tuple[int, ...]:
    """After each batch, the fewest matches with which P(similarity >= threshold) is still ``miss`` or more.

    One-byte signatures match by chance too: a similarity J matches with probability J + (1 - J) / 256.
    """
    j = (np.arange(4000) + 0.5) / 4000
    p = j + (1 - j) / 256
    out = []
    for n in range(batch, n_hashes + 1, batch):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        w = np.exp(log - log.max(1, keepdims=True))
        out.append(int(np.argmax(w[:, j >= threshold].sum(1) / w.sum(1) >= miss)))
    return tuple(out)


def _promising(n_hashes: int, threshold: float, miss: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    least = least_matches(n_hashes, BATCH, threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, n_hashes) for c in ("_x", "_y"))
            left, found = np.arange(len(batch)), np.zeros(len(batch), np.int32)
            for k, most in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                found[left] += (x[left, part] == y[left, part]).sum(1, dtype=np.int32)
                left = left[found[left] >= most]
            yield pa.RecordBatch.from_arrays([batch["a"].take(pa.array(left)), batch["b"].take(pa.array(left))], ["a", "b"])

    return run


def _confirmed(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["_x"], batch["_y"]):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if percent * max(len(x), len(y)) > 100 * min(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], ["a", "b"])

    return run


def _with(pairs: DataFrame, table: DataFrame, what: str) -> DataFrame:
    """pairs with ``what`` of both sides as _x and _y."""
    one = lambda side, to: table.select(F.col("_row").alias(side), F.col(what).alias(to))
    return pairs.join(one("a", "_x"), "a").join(one("b", "_y"), "b").select("a", "b", "_x", "_y")


def _distinct_pairs(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, miss: float = 1e-6) -> DataFrame:
    """A row per document: id, _hash (of the text), n_shingles, component_id (smallest id reachable), first (whether it is the one to stay).

    Links: 100 * intersection >= percent * union of the sets of ``size``-word shingles, A-Z lower-cased, words split at ASCII white space.
    """
    slim_docs = slim(docs, id_col, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    sketch = staged(slim_docs.mapInArrow(_sketches(size, bands, rows), f"_row long, _id {id_type}, _hash long, _n long, _class binary, _sig binary, _keys array<long>"), "sketches")
    classes = first_rows(sketch)

    reps = representatives(sketch, classes)
    keyed = staged(reps.select("_row", F.explode("_keys").alias("_key")), "keys")
    shared = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_many")).filter("_many > 1").select("_key")
    buckets = staged(keyed.join(shared, "_key").select("_key", "_row"), "buckets")
    release(keyed)
    # a member's mates over all bands: a copy's source has more of them than its other copies
    mates = buckets.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    mates = buckets.join(mates, "_key").groupBy("_row").agg((-F.sum("_n")).alias("_mates"))
    bare, buckets = buckets, staged(buckets.join(mates, "_row").select("_key", "_row", "_mates"), "buckets")
    release(bare)

    texts = texts_of(slim_docs, sketch, buckets.select("_row"))
    sets = staged(texts.mapInArrow(_sets(size), "_row long, _set binary"), "sets")

    def links(pairs: DataFrame) -> DataFrame:
        maybe = staged(_with(pairs, sketch, "_sig").mapInArrow(_promising(bands * rows, percent / 100, miss), "a long, b long"), "promising")
        out = staged(_with(maybe, sets, "_set").mapInArrow(_confirmed(percent), "a long, b long"), "near-links")
        release(maybe)
        return out

    def first_of(k: int) -> Column:
        """The member with most mates (k = 0), else the first in order of a hash."""
        return F.min(F.struct(F.col("_mates") if k == 0 else F.xxhash64(F.lit(k), "_row"), F.col("_row").alias("row")))

    def split(found: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Labels; bucket members with their component _c; and of buckets with several, the largest and a member of it."""
        label = components(found)
        left = buckets.join(label.withColumnRenamed("node", "_row"), "_row", "left").select("_key", "_row", "_mates", F.coalesce("label", "_row").alias("_c"))
        left = staged(left, "left")
        sizes = left.groupBy("_key", "_c").agg(F.count(F.lit(1)).alias("_many"), first_of(k).alias("_one"))
        mixed = sizes.groupBy("_key").agg(F.count(F.lit(1)).alias("_parts"), F.max(F.struct("_many", "_c", "_one")).alias("_most")).filter("_parts > 1")
        return label, left, staged(mixed.select("_key", F.col("_most._c").alias("_main"), F.col("_most._one.row").alias("_other")), "mixed")

    # one hub for each member: of those with most mates in its buckets, that with most
    hubs = staged(buckets.groupBy("_key").agg(first_of(0).alias("_hub")), "hubs")
    stars = buckets.join(hubs, "_key").groupBy("_row").agg(F.min("_hub").alias("_hub")).filter("_row <> _hub.row")
    tested = staged(stars.select(*_distinct_pairs("_row", "_hub.row")).distinct(), "pairs")
    release(hubs)
    found = links(tested)
    label, left, mixed = split(found, 0)
    worth = True
    for k in range(1, STAR_ROUNDS + 1):
        if not worth or not mixed.limit(1).count():
            break
        # one partner for each member and component in a round: the largest of those that its buckets offer
        stars = left.join(mixed, "_key").filter("_c <> _main").groupBy("_row", "_main").agg(F.min(F.struct(F.xxhash64(F.lit(k), "_other"), F.col("_other").alias("row"))).alias("_other"))
        stars = stars.select(*_distinct_pairs("_row", "_other.row")).distinct()
        stars = staged(stars.join(tested, ["a", "b"], "left_anti"), "pairs")
        more = links(stars)
        worth = more.count() * WORTH >= stars.count()
        tested, found = tested.unionByName(stars), found.unionByName(more)
        for x in (label, left, mixed):
            release(x)
        label, left, mixed = split(found, k)

    if mixed.limit(1).count():
        more = signature_tree.between_sets(left.join(mixed, "_key").select("_row", "_c").distinct(), sets, percent)
        if more.limit(1).count():
            release(label)
            label = components(found.unionByName(more))
    for x in (left, mixed, sets, buckets):
        release(x)

    return named(sketch, classes, label, id_col)


def drop_near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one document of each component: that with the smallest id; of rows that repeat it, one."""
    kept = near_duplicates(docs, size=size, percent=percent, id_col=id_col, text_col=text_col, **how).filter("first").select(F.col(id_col).alias("_i"), F.col("_hash").alias("_h"))
    kept = staged(kept, "kept")
    rows = packed(docs, _key=F.col(id_col), _text_hash=F.xxhash64(text_col))
    same = F.col("_key").eqNullSafe(F.col("_i")) & (F.col("_text_hash") == F.col("_h"))
    out = rows.join(kept, same, "left_semi")
    again = docs.groupBy(F.col(id_col).alias("_i"), F.xxhash64(text_col).alias("_h")).agg(F.count(F.lit(1)).alias("_many")).filter("_many > 1")
    again = staged(again, "repeated")
    if again.limit(1).count():
        once = out.join(again, same, "left_semi").dropDuplicates(["_key", "_text_hash"])
        out = out.join(again, same, "left_anti").unionByName(once)
    return unpacked(out, docs)
