"""Hybrid retrieval: exact vector ranking, keyword ranking, relevance, two-tier gate.

Queries are a DataFrame (query_id, query_vec, grams), so that many are answered in one plan. ``scored`` gives every pair: queries are
broadcast in blocks of at most QUERIES_BYTES, and each segment is read once for a block. ``pooled`` gives only the pairs that can be
in a query's lists, found by ``nearest`` in blocks of segments and queries; what ranks pairs gives the same from them. Which grams a
segment holds is found once a segment, and met with each query's grams by number.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import contains_any, matched_grams, search_grams
from ..functions.vectors import cosine, norm
from . import nearest

POOL, FLOOR, HIGH, LOW_LIMIT, BOOST = 50, 0.4, 0.6, 3, 0.1
QUERIES_BYTES = 64 << 20
#: Words of which a task remembers the grams.
WORDS = 1 << 17


def filtered(segments: DataFrame, tenant_id: str | None = None, video_id: str | None = None) -> DataFrame:
    """Segments of a tenant and a video; None or empty means no such filter."""
    for name, value in (("tenant_id", tenant_id), ("video_id", video_id)):
        if value:
            segments = segments.filter(F.col(name) == value)
    return segments


def with_grams(queries: DataFrame, mode: str = "hybrid") -> DataFrame:
    """queries (query_id, query_vec, query) with their grams; outside hybrid mode there are none."""
    grams = search_grams(F.col("query")) if mode.lower() == "hybrid" else F.array().cast("array<string>")
    return queries.withColumn("grams", grams)


def _vocabulary(text: Column) -> Column:
    """The distinct runs of characters that grams consist of: a text holds a gram if one of these does, and they are far shorter."""
    return F.array_join(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9+#.一-鿿]+")), " ")


def _blocks(queries: DataFrame) -> list[DataFrame]:
    """queries in parts by a hash of query_id, each below QUERIES_BYTES in the mean by half."""
    size = queries.agg(F.coalesce(F.sum(F.size("query_vec") * 8 + F.size("grams") * 32 + 64), F.lit(0))).first()[0]
    n = -(-2 * size // QUERIES_BYTES) if size > QUERIES_BYTES else 1
    return [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k) for k in range(n)] if n > 1 else [queries]


def scored(segments: DataFrame, queries: DataFrame) -> DataFrame:
    """Each segment with a vector, for each query: score (cosine) and matched (grams found)."""
    rows = segments.filter(F.col("embedding").isNotNull()).withColumns({"_norm": norm(F.col("embedding")), "_low": _vocabulary(F.col("text_content"))}).drop("text_content")
    out = None
    for block in _blocks(queries.select("query_id", "query_vec", "grams")):
        each, asked = _numbered(rows, block)
        pairs = each.crossJoin(F.broadcast(asked.withColumn("_query_norm", norm(F.col("query_vec")))))  # the stated query set against all rows
        score = cosine(F.col("embedding"), F.col("query_vec"), F.col("_norm"), F.col("_query_norm"))
        part = pairs.withColumns({"score": score, "matched": F.size(F.array_intersect("_held", "_grams")), "n_grams": F.size("_grams")})
        part = part.drop("embedding", "query_vec", "_grams", "_held", "_norm", "_query_norm")
        out = part if out is None else out.unionByName(part)
    return out


def _numbered(rows: DataFrame, block: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (_low) with ``_held`` and queries with ``_grams``: numbers of the block's grams that a row holds and a query has.

    A gram lies within a word, so a word's substrings are looked up among the grams, once a task for words that come again.
    """
    grams = block.select(F.explode("grams").alias("g")).distinct().toArrow()["g"].to_pylist()  # below the block's bound
    sent = rows.sparkSession.sparkContext.broadcast({g: i for i, g in enumerate(sorted(grams))})

    @F.pandas_udf("array<int>")
    def held(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        numbers = sent.value
        lengths = sorted({len(g) for g in numbers})

        @functools.lru_cache(maxsize=WORDS)
        def of(word: str) -> tuple[int, ...]:
            pieces = {word[i : i + n] for n in lengths for i in range(len(word) - n + 1)}
            return tuple(numbers[x] for x in pieces if x in numbers)

        for part in parts:
            yield pd.Series([sorted(set().union(*map(of, text.split(" ")))) for text in part])

    @F.pandas_udf("array<int>")
    def places(lists: pd.Series) -> pd.Series:
        return pd.Series([[sent.value[g] for g in x] for x in lists])

    return rows.withColumn("_held", held("_low")).drop("_low"), block.withColumn("_grams", places("grams")).drop("grams")


def pooled(segments: DataFrame, queries: DataFrame, n: int = POOL) -> DataFrame:
    """Of the pairs of ``scored``, those that can be among a query's first n with a gram or first n without: ``candidates`` gives the same.

    Queries without grams meet the vectors alone, so what segments hold is sent only to the others.
    """
    rows, asks = segments.filter(F.col("embedding").isNotNull()), F.size("grams") > 0
    queries = queries.select("query_id", "query_vec", "grams")
    out = nearest.best(rows.drop("text_content"), queries.filter(~asks), n).withColumns({"matched": F.lit(0), "n_grams": F.lit(0)})
    words = rows.withColumn("_low", _vocabulary(F.col("text_content"))).drop("text_content")
    for block in _blocks(queries.filter(asks)):
        out = out.unionByName(nearest.best(*_numbered(words, block), n))
    return out


def vector_topn(segments: DataFrame, query_vec: list[float], n: int = POOL) -> DataFrame:
    """The n segments closest to one vector: a single top-n, without a shuffle of the rest."""
    q = F.array(*(F.lit(float(x)) for x in query_vec))
    rows = segments.filter(F.col("embedding").isNotNull())
    return rows.withColumn("score", cosine(F.col("embedding"), q)).drop("embedding").orderBy(F.desc("score"), "segment_index").limit(n)


def keyword_topn(segments: DataFrame, query_vec: list[float], grams: list[str], n: int = POOL) -> DataFrame:
    """The n closest of the segments that hold a gram, with the number of grams they hold."""
    q, g = F.array(*(F.lit(float(x)) for x in query_vec)), F.array(*(F.lit(x) for x in grams)).cast("array<string>")
    rows = segments.filter(F.col("embedding").isNotNull() & contains_any(F.col("text_content"), g)).withColumn("matched", matched_grams(F.col("text_content"), g))
    return rows.withColumn("score", cosine(F.col("embedding"), q)).drop("embedding").orderBy(F.desc("score"), "segment_index").limit(n)


def _rank(*order) -> Column:
    return F.row_number().over(W.partitionBy("query_id").orderBy(*order))


def vector_candidates(pairs: DataFrame, n: int = POOL) -> DataFrame:
    return pairs.withColumn("rank_vector", _rank(F.desc("score"), "segment_index")).filter(F.col("rank_vector") <= n)


def keyword_candidates(pairs: DataFrame, n: int = POOL) -> DataFrame:
    return pairs.filter("matched > 0").withColumn("rank_keyword", _rank(F.desc("score"), "segment_index")).filter(F.col("rank_keyword") <= n)


def relevance() -> Column:
    """Cosine, not below 0, with up to BOOST for the share of grams found, not above 1."""
    share = F.when(F.col("n_grams") > 0, F.least(F.lit(1.0), F.col("matched") / F.greatest(F.col("n_grams"), F.lit(1)))).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("score", F.lit(0.0))) + BOOST * share)


def candidates(pairs: DataFrame, n: int = POOL) -> DataFrame:
    """Vector and keyword candidates, each segment once, with rank_vector; the pairs are evaluated once.

    First the n best with a gram and the n best without are taken: the best n of all are among them, as both lists are
    ordered by the same score.
    """
    has = F.col("matched") > 0
    place = F.row_number().over(W.partitionBy("query_id", "_has").orderBy(F.desc("score"), "segment_index"))
    near = pairs.withColumn("_has", has).withColumn("_place", place).filter(F.col("_place") <= n).drop("_has", "_place")
    return near.withColumn("rank_vector", _rank(F.desc("score"), "segment_index")).filter((F.col("rank_vector") <= n) | has)


def merged(pairs: DataFrame, n: int = POOL) -> DataFrame:
    """candidates with relevance."""
    return candidates(pairs, n).withColumn("relevance", relevance())


def ranked(pairs: DataFrame, top_k: int = 5, pool: int = POOL, floor: float = FLOOR) -> DataFrame:
    """Candidates at or above the floor in order of relevance, with rank and their query's best relevance."""
    rows = merged(pairs, max(pool, top_k)).filter(F.col("relevance") >= floor)
    best = F.max("relevance").over(W.partitionBy("query_id"))
    return rows.withColumn("rank", _rank(F.desc("relevance"), "segment_index")).withColumn("best", best)


def raw_ranking(pairs: DataFrame, top_k: int = 5, pool: int = POOL) -> DataFrame:
    """Without the gate: the first top_k."""
    return ranked(pairs, top_k, pool).filter(F.col("rank") <= top_k).drop("best", "rank_vector")


def gated(pairs: DataFrame, top_k: int = 5, pool: int = POOL, high: float = HIGH, low_limit: int = LOW_LIMIT) -> DataFrame:
    """With the gate: top_k if the best reaches ``high``, else at most low_limit; rows below ``high`` are low_confidence."""
    limit = F.when(F.col("best") >= high, top_k).otherwise(min(low_limit, top_k))
    return ranked(pairs, top_k, pool).filter(F.col("rank") <= limit).withColumn("low_confidence", F.col("relevance") < high).drop("best", "rank_vector")


def results(found: DataFrame, videos: DataFrame) -> DataFrame:
    """What a search gives: the nine fields of each row of found, which has start_time, end_time and chapter_title; low_confidence is a row's own."""
    text = F.coalesce("corrected_text", "text_content") if "corrected_text" in found.columns else F.col("text_content")
    return named(found, videos).select("query_id", "rank", "video_id", "video_name", "segment_index", "start_time", "end_time", text.alias("text"), "chapter_title", F.col("relevance").alias("score"), "low_confidence")


def named(results: DataFrame, videos: DataFrame) -> DataFrame:
    """results with their video's file name, null if there is none; videos are looked up once for all rows."""
    return results.join(videos.select("video_id", F.col("file_name").alias("video_name")), "video_id", "left")


def drop_counters(pairs: DataFrame, top_k: int = 5, pool: int = POOL, floor: float = FLOOR) -> DataFrame:
    """Per query: candidates of both lists, merged ones, those below the floor and those cut off beyond top_k."""
    n = max(pool, top_k)
    both = merged(pairs, n).groupBy("query_id").agg(
        F.count_if(F.col("rank_vector") <= n).alias("n_vector"), F.count_if(F.col("matched") > 0).alias("n_keyword"), F.count(F.lit(1)).alias("n_merged"), F.count_if(F.col("relevance") < floor).alias("floor_drops")
    )
    return both.withColumn("truncated", F.greatest(F.col("n_merged") - F.col("floor_drops") - top_k, F.lit(0)))
