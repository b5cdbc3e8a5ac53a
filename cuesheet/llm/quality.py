"""Quality classifier by importance resampling.

Words, pairs of neighbours and the shapes of pairs (punctuation, capitals, repetition) are hashed into ``2**bits`` buckets.
One model holds the bucket frequencies of all documents, one those of the target: documents labelled good. A document's log
weight is the log ratio of its probability under the two. Both counts of a bucket get ``PRIOR`` occurrences more, so where
the target is expected to have few, as in a language with few labels, its silence tells little. Each document gets Gumbel
noise from a hash of its id and text; the k documents with the largest sums are an importance sample without replacement.

If k is not given, a document is judged by the log weight that ``LENGTH`` of its features have on average (by its own, if it
has fewer), since a sum over all features grows with the length. k is the number of documents for which that is at least
``least``, and the noise is added to it: what is likelier under the raw model by more than that goes.

Sums of log ratios are large beside Gumbel noise (scale 1): the draw decides among documents of nearly equal weight, and is
nearly a cut elsewhere. What is good but for a few words, such as toxic ones in clean prose, has a weight like any good
document's and stays: this judges the make of a text, not its topics.

The target is a sample of at most ``max_target`` labelled ids (those with the smallest hashes), a bound that also allows their
broadcast; the raw model and the weights cover all documents. Without a good label every document is taken. Null and empty
texts have weight 0; very long ones are counted whole, as a row; rows with the same id and text share their fate, also where
this exceeds k; other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .select_top import kth_largest
from .staging import packed, release, staged, unpacked

BITS = 14
MAX_TARGET = 50_000
LEAST = -16.0
#: Occurrences added to a bucket's count and to the expected one; features beyond which a log weight is scaled down.
PRIOR, LENGTH = 10.0, 200
BROADCAST_BYTES = 64 << 20
TOKEN = re.compile(r"\w+|[^\w\s]+")
_M = np.uint64(0x9E3779B97F4A7C15)
Batches = Iterator[pa.RecordBatch]


class _Tokens(dict):
    """token: hash of its lower case, with its shape (1 plain, 2 capitals, 3 punctuation) in the two lowest bits."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        shape = 3 if not (token[0].isalnum() or token[0] == "_") else 2 if len(token) > 1 and token.isupper() else 1
        self[token] = x = zlib.crc32(token.lower().encode()) << 2 | shape
        return x


def features(text: str | None, tokens: dict, bits: int) -> np.ndarray:
    """The buckets of a text's features."""
    found = TOKEN.findall(text or "")
    x = np.fromiter(map(tokens.__getitem__, found), np.uint64, len(found))
    shape, x = x & np.uint64(3), x >> np.uint64(2)
    pair = (x[1:] * _M + x[:-1]) * np.uint64(0xC2B2AE3D27D4EB4F)
    shapes = shape[1:] * np.uint64(4) + shape[:-1] + np.uint64(16) * (x[1:] == x[:-1])
    bucket = [((y + np.uint64(k)) * _M) >> np.uint64(64 - bits) for k, y in ((1, x), (2, pair), (3, shapes))]
    return np.concatenate(bucket).astype(np.int64)


def _counts(bits: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        tokens, counts = _Tokens(), np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for text, good in zip(batch["_text"], batch["_good"].to_pylist()):
                c = np.bincount(features(text.as_py(), tokens, bits), minlength=1 << bits)
                counts[0] += c
                if good:
                    counts[1] += c
        bucket = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(counts[0, bucket]), pa.array(counts[1, bucket])], ["bucket", "raw", "target"])

    return run


def _weights(ratio: np.ndarray, bits: int, length: int | None) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        tokens = _Tokens()
        for batch in batches:
            found = [ratio[features(t.as_py(), tokens, bits)] for t in batch["_text"]]
            w = np.array([x.sum() for x in found], np.float64)
            judged = w * np.array([length / max(len(x), length) for x in found], np.float64) if length else w
            u = (batch["_noise"].to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5
            raw = (judged - np.log(-np.log(u / (1 << 53)))).view(np.int64)
            key = raw ^ ((raw >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))  # sorts as the number does
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["_hash"], pa.array(w), pa.array(judged), pa.array(key)], ["_id", "_hash", "log_weight", "_judged", "_key"])

    return run


def log_ratio(docs: DataFrame, good_ids: DataFrame, *, bits: int = BITS, max_target: int = MAX_TARGET, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray | None:
    """Log of the target's count over the one that the raw model expects, for each bucket; None without a good document. good_ids has the one column _good_id."""
    sample = good_ids.distinct().orderBy(F.xxhash64("_good_id"), "_good_id").limit(max_target)
    sample = staged(sample.withColumn("_good", F.lit(True)), "good-ids")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), F.col("_id") == F.col("_good_id"), "left").select("_text", "_good")
    each = rows.mapInArrow(_counts(bits), "bucket long, raw long, target long")
    found = each.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).toPandas().to_numpy(np.int64)
    release(sample)
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    raw[found[:, 0]] += found[:, 1]
    target[found[:, 0]] += found[:, 2]
    if not len(found) or not found[:, 2].any():
        return None
    return np.log((target + PRIOR) / (raw * (target.sum() / raw.sum()) + PRIOR))


def importance_sample(docs: DataFrame, good_ids: DataFrame, k: int | None = None, *, least: float = LEAST, bits: int = BITS, max_target: int = MAX_TARGET, seed: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, _hash (of the text), log_weight, selected."""
    ratio = log_ratio(docs, good_ids, bits=bits, max_target=max_target, id_col=id_col, text_col=text_col)
    whole = ratio is None
    ratio = np.zeros(1 << bits) if whole else ratio
    hashed = F.xxhash64(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), hashed.alias("_hash"), F.xxhash64(F.lit(seed), F.col(id_col), hashed).alias("_noise"), F.col(text_col).alias("_text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    scored = staged(rows.mapInArrow(_weights(ratio, bits, LENGTH if k is None else None), f"_id {id_type}, _hash long, log_weight double, _judged double, _key long"), "weights")
    if k is None:
        k = scored.filter(F.col("_judged") >= least).count()
    cut = None if whole else kth_largest(scored, "_key", k) if k else 1 << 62
    selected = F.lit(True) if cut is None else F.col("_key") >= cut
    return scored.select(F.col("_id").alias(id_col), "_hash", "log_weight", selected.alias("selected"))


def keep_selected(docs: DataFrame, good_ids: DataFrame, k: int | None = None, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without those that the importance sample leaves out."""
    out = importance_sample(docs, good_ids, k, id_col=id_col, text_col=text_col, **how).filter("not selected").select(F.col(id_col).alias("_i"), F.col("_hash").alias("_h")).distinct()
    out = staged(out, "rejected")
    out = F.broadcast(out) if out.count() * 64 <= BROADCAST_BYTES else out.hint("merge")
    rows = packed(docs, _key=F.col(id_col), _text_hash=F.xxhash64(text_col))
    return unpacked(rows.join(out, F.col("_key").eqNullSafe(F.col("_i")) & (F.col("_text_hash") == F.col("_h")), "left_anti"), docs)
