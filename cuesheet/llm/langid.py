"""Language identification with string kernels.

The kernel of two texts is the number of byte n-grams (n = 1..4, of the lower-cased text) that both hold, over the geometric
mean of what each holds: a blended spectrum of presence bits, hashed into ``2**bits`` places. Landmarks are a part of the
training sample; Nystroem features of the kernel go into one-versus-rest kernel ridge regression. Scoring is a batched
product of presence bits, landmarks and weights.

The sample has at most ``per_lang`` different texts of each language (those with the smallest hashes), each once however
many copies it has; texts are whole everywhere, very long ones in parts. Only the landmarks' bits reach the driver, at most
max(n_landmarks, 8 a language) of 2**bits / 8 bytes; of the rest of the sample it gets the sums of the normal equations, one
part after another.
Null texts and texts without a letter are ``und`` with score 0, as is everything if there is no training row. Of languages
with equal scores the first by code point is given. Repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import release, staged

BITS, ORDERS = 14, (1, 2, 3, 4)
PER_LANG, LANDMARKS, RIDGE = 400, 128, 1e-2
UNKNOWN = "und"
#: Bytes of text and texts handled at once.
BYTES, TEXTS = 1 << 19, 64
#: Sampled texts whose sums are taken together.
SUMMED = 8192
BROADCAST_BYTES = 64 << 20
Batches = Iterator[pa.RecordBatch]


def presence(texts: list[str], bits: int = BITS) -> np.ndarray:
    """float32 (texts, 2**bits): 1 where a text holds an n-gram of that place. A long text goes in parts."""
    out = np.zeros((len(texts), 1 << bits), np.float32)
    flat = out.reshape(-1)
    for i, text in enumerate(texts):
        raw = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8)
        for at in range(0, len(raw), BYTES):
            x = raw[at : at + BYTES + max(ORDERS) - 1].astype(np.uint64)
            code = np.zeros(len(x), np.uint64)
            for n in range(1, max(ORDERS) + 1):
                code = (code[: len(x) - n + 1] << np.uint64(8)) | x[n - 1 :] if n > 1 else x
                if n in ORDERS and len(code):
                    place = ((code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
                    flat[place.astype(np.int64) + (i << bits)] = 1
    return out


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Normalised kernel of presence rows."""
    norm = lambda z: np.sqrt(np.maximum(z.sum(1), 1))
    return (x @ y.T) / np.outer(norm(x), norm(y))


def nystroem(land: np.ndarray) -> np.ndarray:
    """The map from kernels with the landmarks to features."""
    value, vector = np.linalg.eigh(kernel(land, land).astype(np.float64))
    good = value > 1e-6
    return vector[:, good] / np.sqrt(value[good])


def _sums(land: np.ndarray, root: np.ndarray, names: list[str], bits: int) -> Callable[[Batches], Batches]:
    """Of sampled rows (_lang, _bits): the rows of features' and features by languages' sums, and the number of texts, for the normal equations."""
    packed, place = np.packbits(land.astype(bool), axis=1), {name: k for k, name in enumerate(names)}

    def run(batches: Batches) -> Batches:
        land = np.unpackbits(packed, axis=1).astype(np.float32)
        total, n = np.zeros((root.shape[1], root.shape[1] + len(names))), 0
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                x = np.unpackbits(np.frombuffer(b"".join(part["_bits"].to_pylist()), np.uint8).reshape(len(part), -1), axis=1).astype(np.float32)
                y = np.zeros((len(part), len(names)))
                y[np.arange(len(part)), [place[v] for v in part["_lang"].to_pylist()]] = 1
                phi = kernel(x, land) @ root
                total += phi.T @ np.hstack([phi, y])
                n += len(part)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(total)), pa.array(range(len(total))), pa.array([r.tobytes() for r in total], pa.binary())], ["n", "k", "sums"])

    return run


def _sampled(bits: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        seen = set()
        for batch in batches:
            new = []
            for i, key in enumerate(zip(batch["_lang"].to_pylist(), batch["_h"].to_pylist())):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            batch = batch.take(pa.array(new, pa.int64()))
            packed = [np.packbits(presence([t.as_py()], bits)[0].astype(bool)).tobytes() for t in batch["_text"]]
            yield pa.RecordBatch.from_arrays([batch["_lang"], batch["_h"], batch["_k"], pa.array(packed, pa.binary())], ["_lang", "_h", "_k", "_bits"])

    return run


def train(docs: DataFrame, *, per_lang: int = PER_LANG, bits: int = BITS, n_landmarks: int = LANDMARKS, ridge: float = RIDGE, lang_col: str = "lang", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, list[str]] | None:
    """The model of docs' labelled rows: landmarks' bits, weights by landmark and language, languages; None if no row has both a language and a letter."""
    rows = docs.select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).filter(F.col("_lang").isNotNull() & F.col("_text").rlike(r"\p{L}")).withColumn("_h", F.xxhash64("_text"))
    texts = staged(rows.select("_lang", "_h").distinct(), "lang-texts")
    counts = {r[0]: r[1] for r in texts.groupBy("_lang").count().collect()}  # a row a language
    if not counts:
        release(texts)
        return None
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2 * per_lang / n + 20 / n))))
    some = texts.filter(F.shiftrightunsigned("_h", 11) < share[F.col("_lang")] * float(1 << 53))
    first = F.row_number().over(W.partitionBy("_lang").orderBy("_h"))  # of few rows: the share is small
    some = staged(some.withColumn("_k", first).filter(F.col("_k") <= per_lang).select(F.col("_lang").alias("_l"), F.col("_h").alias("_s"), "_k"), "lang-sample")
    release(texts)
    size = some.count()
    each = F.broadcast(some) if size * 64 <= BROADCAST_BYTES else some.hint("merge")
    found = rows.join(each, (F.col("_lang") == F.col("_l")) & (F.col("_h") == F.col("_s"))).select("_lang", "_h", "_k", "_text")
    found = staged(found.mapInArrow(_sampled(bits), "_lang string, _h long, _k int, _bits binary").dropDuplicates(["_lang", "_h"]), "lang-bits")
    release(some)
    names = sorted(counts)
    marks = found.orderBy("_k", "_lang").limit(max(n_landmarks, 8 * len(names))).collect()  # the languages take turns
    if not marks:
        release(found)
        return None
    land = np.unpackbits(np.frombuffer(b"".join(r["_bits"] for r in marks), np.uint8).reshape(len(marks), -1), axis=1).astype(np.float32)
    root = nystroem(land)
    parts = found.repartition(-(-size // SUMMED), F.col("_h")).sortWithinPartitions("_lang", "_h").mapInArrow(_sums(land, root, names, bits), "n long, k long, sums binary")
    total, n = np.zeros((root.shape[1], root.shape[1] + len(names))), 0
    for r in parts.toLocalIterator():  # a part in memory at a time
        total[r["k"]] += np.frombuffer(r["sums"])
        n += r["n"] if r["k"] == 0 else 0
    release(found)
    m = root.shape[1]
    w = np.linalg.solve(total[:, :m] + ridge * n * np.eye(m), total[:, m:])
    return land, (root @ w).astype(np.float32), names


def _predicted(model: tuple | None, bits: int) -> Callable[[Batches], Batches]:
    if model:
        packed = np.packbits(model[0].astype(bool), axis=1)

    def run(batches: Batches) -> Batches:
        if model:
            land = np.unpackbits(packed, axis=1).astype(np.float32)
            weights = model[1] / np.sqrt(np.maximum(land.sum(1), 1))[:, None]
        for batch in batches:
            texts = batch["_text"].to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            told = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model else []
            for k in range(0, len(told), TEXTS):
                part = told[k : k + TEXTS]
                x = presence([texts[i] for i in part], bits)
                s = (x @ land.T) @ weights / np.sqrt(np.maximum(x.sum(1), 1))[:, None]
                for i, row in zip(part, s):
                    lang[i] = model[2][int(row.argmax())]
                    score[i] = min(max(float(row.max()), 0.0), 1.0)
            yield pa.RecordBatch.from_arrays([batch["_id"], pa.array(lang), pa.array(score)], ["_id", "lang_pred", "score"])

    return run


def predict_language(docs: DataFrame, model: tuple | None, *, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, lang_pred, score."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    if model:
        model = (model[0].astype(np.uint8), model[1], model[2])
    return rows.mapInArrow(_predicted(model, bits), f"_id {id_type}, lang_pred string, score double").withColumnRenamed("_id", id_col)
