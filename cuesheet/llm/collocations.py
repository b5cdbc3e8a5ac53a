"""Phrases whose words occur together more often than their parts do apart.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and equal pieces of a language become one with a
multiplicity. The n-grams of pieces are then counted by length. A batch of pieces gives each n-gram once, with its weight, if both
its (n-1)-grams may reach ``least``: they are looked up in a bitmap of those that do, of at most BITS bits, where a false hit
costs a row and changes nothing. The n-grams are dealt by a hash, and DuckDB counts each hash bucket out of core, with
MEMORY of memory and a scratch folder that goes with the task, as Spark's own spill files do. A candidate asks for the counts of its
parts by requests that are shuffled to where the parts are counted. All counts are of all documents, and exact.

Null texts are empty, and a null language is ``und``, as is that name itself. Empty texts have no pieces. Very long texts and pieces
are taken whole. Repeated rows count each time. An empty table has no phrases. Ties in score go by count, then by phrase in
order of UTF-8 bytes, so a rank is never shared. Other columns are not read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most bits of the bitmap of frequent n-grams (16 MiB); bits for each of them; those of one row of the bitmap.
BITS, SPARSE, PAGE = 1 << 27, 16, 32768
MEMORY = "192MB"
#: Words whose n-grams a task reduces at once.
WORDS = 1_000_000
GRAMS = "lang string, phrase string, n long"


def pieces(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, times): the distinct pieces with a word, their words separated by single spaces."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    each = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.explode(F.split(text, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    piece = F.trim(F.regexp_replace("piece", r"[\x20\x09]+", " "))
    return each.select("lang", piece.alias("piece")).filter("piece <> ''").groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("times"))


class _Words:
    """The words of some pieces as numbers, in one sequence; a number stands for a word of a language."""

    def __init__(self, part: pa.Table):
        words = pc.split_pattern(part["piece"].combine_chunks(), " ")
        lengths = np.diff(words.offsets.to_numpy())
        piece = np.repeat(np.arange(len(lengths)), lengths)
        flat, lang = words.flatten().dictionary_encode(), part["lang"].combine_chunks().dictionary_encode()
        n = max(1, len(flat.dictionary))
        kinds, self.at = np.unique(lang.indices.to_numpy().astype(np.int64)[piece] * n + flat.indices.to_numpy(), return_inverse=True)
        self.lang, self.text = lang.dictionary.take(pa.array(kinds // n)), flat.dictionary.take(pa.array(kinds % n))
        self.weight = part["times"].to_numpy().astype(np.int64)[piece]
        self.left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(piece))  # words from here to the piece's end

    def hashes(self) -> np.ndarray:
        """A hash of each word in the sequence, with its language."""
        each = (xxhash.xxh64_intdigest(f"{g}\t{w}") for g, w in zip(self.lang.to_pylist(), self.text.to_pylist()))
        return np.fromiter(each, np.uint64, len(self.text))[self.at]

    def grams(self, start: np.ndarray, n: int) -> pa.RecordBatch:
        """The n-grams that begin at these places, each once, with their weights."""
        code, kinds = self.at[start], max(2, len(self.text))
        for k in range(1, n):
            if len(code) and int(code.max()).bit_length() + kinds.bit_length() > 62:
                code = np.unique(code, return_inverse=True)[1]
            code = code * kinds + self.at[start + k]
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        weight = np.add.reduceat(self.weight[start][order], first) if len(first) else np.empty(0, np.int64)
        start = start[order[first]]
        words = [self.text.take(pa.array(self.at[start + k])) for k in range(n)]
        return pa.RecordBatch.from_arrays([self.lang.take(pa.array(self.at[start])), pc.binary_join_element_wise(*words, " ") if n > 1 else words[0], pa.array(weight)], ["lang", "phrase", "n"])


def _next(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of n-grams that have one word more."""
    x = h * np.uint64(0x9E3779B97F4A7C15) + word * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _places(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of n-grams (piece, lang, times): their places in a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _Words(pa.Table.from_batches([batch]))
            word = words.hashes()
            h, start = word, np.flatnonzero(np.diff(words.left, prepend=0) >= 0)
            for k in range(1, int(words.left.max(initial=1))):
                h = _next(h[:-1], word[k:])
            yield pa.RecordBatch.from_arrays([pa.array((h[start] & np.uint64(bits - 1)).astype(np.int64))], ["at"])

    return run


def frequent(counts: DataFrame) -> np.ndarray:
    """A bitmap of counts (lang, phrase), phrases of equal numbers of words, as bytes; a page is made by each group of places."""
    bits, n = 1 << 16, counts.count()
    while bits < min(n * SPARSE, BITS):
        bits *= 2
    at = counts.select("lang", F.col("phrase").alias("piece"), F.lit(1).cast("long").alias("times")).mapInArrow(_places(bits), "at long")
    page = at.select(F.shiftright("at", 15).alias("page"), F.col("at").bitwiseAND(F.lit(PAGE - 1)).alias("at"))
    out = np.zeros(bits // 8, np.uint8)
    for k, bitmap in page.groupBy("page").agg(F.bitmap_construct_agg("at")).collect():  # at most BITS bits in all
        out[k * PAGE // 8 : (k + 1) * PAGE // 8] = np.frombuffer(bytes(bitmap), np.uint8)
    return out


def held(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the bitmap has."""
    at = h & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _grams_of(words: _Words, n: int, filters: list[np.ndarray]) -> pa.RecordBatch:
    """n-grams all of whose shorter ones pass the filters."""
    start = np.arange(len(words.at))
    if n > 1:
        h = word = words.hashes()
        ok = np.zeros(len(word) + 1, bool)
        for k, bitmap in enumerate(filters, 1):
            start = start[held(bitmap, h[start])]
            ok[:], ok[start] = False, True
            start = start[ok[start + 1] & (words.left[start] > k)]  # a (k+1)-gram begins where a k-gram passes and the next word begins one that passes too
            h = np.concatenate((_next(h[: len(word) - k], word[k:]), np.zeros(k, np.uint64)))
    return words.grams(start, n)


def _grams(n: int, filters) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def reduced(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _grams_of(_Words(pa.Table.from_batches(batches)), n, filters.value)
        for at in range(0, len(whole), 50_000):
            yield whole.slice(at, 50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_bytes = [], 0
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                held.append(part)
                n_bytes += pc.sum(pc.binary_length(part["piece"])).as_py()
                if n_bytes >= WORDS * 6:
                    yield from reduced(held)
                    held, n_bytes = [], 0
        if held:
            yield from reduced(held)

    return run


def _counted(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """DuckDB's sums over a hash bucket; it reads the batches as they come and spills what it can't hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
        with tempfile.TemporaryDirectory(prefix="counts-") as scratch:
            con = duckdb.connect(config={"memory_limit": MEMORY, "temp_directory": scratch, "threads": 1, "preserve_insertion_order": False})
            rows = pa.RecordBatchReader.from_batches(schema, (b.cast(schema) for b in batches))  # noqa: F841  read by name
            found = con.sql(f"SELECT lang, phrase, CAST(sum(n) AS BIGINT) AS n FROM rows GROUP BY lang, phrase HAVING sum(n) >= {least}").to_arrow_reader(20_000)
            yield from (b.cast(schema) for b in found)
            con.close()

    return run


def counts(cut: DataFrame, *, least: int, longest: int) -> list[DataFrame]:
    """For n = 1 .. longest the n-grams (lang, phrase, n) that occur at least ``least`` times; staged."""
    out, filters = [], []
    sc = cut.sparkSession.sparkContext
    for n in range(1, longest + 1):
        sent = sc.broadcast(filters)
        found = cut.mapInArrow(_grams(n, sent), GRAMS).repartition("lang", "phrase").mapInArrow(_counted(least), GRAMS)
        out.append(staged(found, f"grams-{n}"))
        sent.destroy()
        if n < longest:
            filters = [*filters, frequent(out[-1])]
    return out


def _big(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(19,0)")


def collocations(docs: DataFrame, *, least: int = 30, longest: int = 4, share: int = 80, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first ``top`` phrases of each language by score, with the counts of the phrase (a), of its parts (l, r) and of words (n).

    score: floor(2000000 a / (l + r)) of the lowest-scoring cut. A phrase inside a longer candidate that has ``share`` percent of its
    occurrences or more goes.
    """
    cut = staged(pieces(docs, text_col=text_col, lang_col=lang_col), "pieces")
    total = cut.groupBy("lang").agg(F.sum(F.size(F.split("piece", " ")) * F.col("times")).alias("n"))
    by_length = counts(cut, least=least, longest=longest)
    candidates = by_length[1]
    for each in by_length[2:]:
        candidates = candidates.unionByName(each)
    every = by_length[0].unionByName(candidates).select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    words = F.split("phrase", " ")
    candidates = candidates.select("lang", "phrase", F.col("n").alias("a"), words.alias("words"), F.size(words).alias("size"))

    places = F.explode(F.expr("sequence(1, size - 1)"))
    parts = F.expr("array(array_join(slice(words, 1, k), ' '), array_join(slice(words, k + 1, size - k), ' '))")
    requests = candidates.withColumn("k", places).select("lang", "phrase", "a", "k", F.posexplode(parts).alias("side", "part"))
    told = requests.join(every, ["lang", "part"])  # parts are at least as frequent, so each is there
    cuts = told.groupBy("lang", "phrase", "a", "k").agg(F.max(F.expr("if(side = 0, f, null)")).alias("l"), F.max(F.expr("if(side = 1, f, null)")).alias("r"))
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_cut")).select("lang", "phrase", "a", "_cut.score", "_cut.l", "_cut.r")

    inner = F.expr("flatten(transform(sequence(2, size - 1), w -> transform(sequence(1, size - w + 1), i -> array_join(slice(words, i, w), ' '))))")
    around = candidates.filter("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    free = scored.join(around, ["lang", "phrase"], "left").filter(F.col("_longer").isNull() | (_big("_longer") * 100 < _big("a") * share))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = free.withColumn("rank", place).filter(F.col("rank") <= top)
    return best.join(F.broadcast(staged(total, "words")) if total.limit(10_001).count() <= 10_000 else total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
