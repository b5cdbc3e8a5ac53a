"""Evaluation queries: boundaries of conversations, and rankings judged by language and number."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import wilson
from ..operators import evaluation as e
from ..operators import nearest
from ..operators import retrieval as r
from ..operators.segmentation import replayed
from ..sources.tables import lines, load, segments
from . import query
from .retrievals import PAIRS, asked
from .segmentations import FIXED

#: Fixed windows again from stored lines as what was found, boundaries every 100 s as references, windows of 60 s.
CASES_SQL = f"{FIXED}, ends AS (SELECT video_id, max(stop) AS duration FROM lines GROUP BY video_id), h AS (SELECT video_id, list(x ORDER BY x) AS hyp FROM (SELECT video_id, round(min(start), 2) AS x FROM seg WHERE segment > 0 GROUP BY video_id, segment) GROUP BY video_id), cases AS (SELECT video_id, duration, CAST(60 AS DOUBLE) AS w, CASE WHEN floor(duration) > 100 THEN list_transform(range(100, CAST(floor(duration) AS BIGINT), 100), lambda x: CAST(x AS DOUBLE)) ELSE [] END AS ref, coalesce(hyp, []) AS hyp FROM ends LEFT JOIN h USING (video_id))"
WD_SQL = f"{CASES_SQL}, steps AS (SELECT *, unnest(range(CAST(floor(duration - w) AS BIGINT) + 1)) AS t FROM cases), differ AS (SELECT video_id, sum(CASE WHEN (len(list_filter(ref, lambda b: b > t AND b <= t + w)) > 0) <> (len(list_filter(hyp, lambda b: b > t AND b <= t + w)) > 0) THEN 1 ELSE 0 END) AS mismatch, count(*) AS windows, sum(CASE WHEN len(list_filter(ref, lambda b: b > t AND b <= t + w)) <> len(list_filter(hyp, lambda b: b > t AND b <= t + w)) THEN 1 ELSE 0 END) AS counted FROM steps GROUP BY video_id), wd AS (SELECT video_id, CAST(coalesce(mismatch, 0) AS BIGINT) AS mismatch, coalesce(windows, 0) AS windows, CAST(coalesce(counted, 0) AS BIGINT) AS counted, CASE WHEN windows > 0 THEN mismatch / windows ELSE 0 END AS share FROM cases LEFT JOIN differ USING (video_id))"
#: Each asked vector's own segment is its truth's place, but not a result.
RANKED = f"{PAIRS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, segment_index) AS rank FROM pairs WHERE segment_index <> query_id), top AS (SELECT * FROM ranked WHERE rank <= 5), truth AS (SELECT query_id, d.lang AS video_id FROM asked JOIN documents d ON d.doc_id = query_id), firsts AS (SELECT t.query_id, min(CASE WHEN top.video_id = t.video_id AND abs(segment_index - t.query_id) <= 60 THEN rank END) AS first_rank, min(CASE WHEN top.video_id = t.video_id THEN abs(segment_index - t.query_id) END) AS best_dev, max(score) AS best FROM truth t LEFT JOIN top USING (query_id) GROUP BY t.query_id)"

SCOPED = RANKED.replace("FROM pairs WHERE segment_index <> query_id", "FROM pairs JOIN documents own ON own.doc_id = query_id WHERE segment_index <> query_id AND pairs.video_id = own.lang")


def cases(spark, sf_dir):
    """(video_id, duration, window_seconds, ref, hyp) of every conversation."""
    rows = lines(spark, sf_dir)
    ends = rows.groupBy("video_id").agg(F.max("end").alias("_end")).withColumn("_n", F.floor("_end").cast("int"))
    every = F.when(F.col("_n") > 100, F.sequence(F.lit(100), F.col("_n") - 1, F.lit(100)))
    refs = ends.select("video_id", F.coalesce(every, F.array().cast("array<int>")).cast("array<double>").alias("ref"))
    videos = ends.select("video_id", F.lit(None).cast("double").alias("duration"))
    return replayed("fixed", rows, videos, refs).withColumn("window_seconds", F.lit(60.0))


def firsts(spark, sf_dir, scoped=False):
    """First hits over all videos or, scoped, of searches within the truth's own video."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("video_id"))
    truth = asked(spark, sf_dir).select("query_id").join(docs, "query_id").select("query_id", "video_id", F.col("query_id").cast("double").alias("expected_start"), F.lit(60.0).alias("tolerance"))
    rows, queries = segments(spark, sf_dir).select("segment_index", "video_id", "embedding"), asked(spark, sf_dir)
    found = nearest.best(rows, queries.join(truth.select("query_id", "video_id"), "query_id"), 5, keys=["video_id"], others=True) if scoped else nearest.best(rows, queries, 5, others=True)
    top = r.vector_candidates(found, 5).select("query_id", F.col("rank_vector").alias("rank"), "video_id", F.col("segment_index").cast("double").alias("start_time"), F.col("score").alias("relevance"))
    return e.first_hits(top, truth)


@query(f"WITH {WD_SQL} SELECT video_id, mismatch, windows, round(share, 6) AS windowdiff FROM wd")
def windowdiff_presence(spark, sf_dir):
    return e.windowdiff_presence(cases(spark, sf_dir)).withColumn("windowdiff", F.round("windowdiff", 6))


@query(f"WITH {WD_SQL} SELECT video_id, counted AS mismatch, windows FROM wd")
def windowdiff_counts(spark, sf_dir):
    return e.windowdiff_counts(cases(spark, sf_dir))


@query(f"WITH {WD_SQL} SELECT round(sum(mismatch) / sum(windows), 6) AS micro, round(avg(share), 6) AS macro FROM wd")
def windowdiff_micro_macro(spark, sf_dir):
    return e.micro_macro(e.windowdiff_presence(cases(spark, sf_dir))).select(F.round("micro", 6).alias("micro"), F.round("macro", 6).alias("macro"))


@query(f"WITH {CASES_SQL}, found AS (SELECT video_id, len(ref) AS n, len(list_filter(ref, lambda a: len(list_filter(hyp, lambda b: abs(a - b) <= 20)) > 0)) AS hits, len(list_filter(hyp, lambda a: len(list_filter(ref, lambda b: abs(a - b) <= 20)) = 0)) AS f FROM cases) SELECT video_id, CAST(hits AS BIGINT) AS hits, CAST(n - hits AS BIGINT) AS missed, CAST(f AS BIGINT) AS false_cuts FROM found")
def boundary_hits(spark, sf_dir):
    return e.boundary_hits(cases(spark, sf_dir))


@query(f"WITH {RANKED} SELECT query_id, CAST(first_rank AS BIGINT) AS first_rank, CAST(best_dev AS DOUBLE) AS best_dev FROM firsts")
def first_hit_rank(spark, sf_dir):
    return firsts(spark, sf_dir).select("query_id", F.col("first_rank").cast("long").alias("first_rank"), "best_dev")


_WILSON = "(p + 1.9208 / n {sign} 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)"


@query(f"WITH {RANKED}, k AS (SELECT unnest([1, 3, 5]) AS k), a AS (SELECT k, count(*) AS n, CAST(sum(CASE WHEN first_rank <= k THEN 1 ELSE 0 END) AS BIGINT) AS hits, avg(CASE WHEN first_rank <= k THEN best_dev END) AS dev FROM firsts, k GROUP BY k), b AS (SELECT *, hits / n AS p FROM a) SELECT k, n, hits, round(p, 6) AS recall, round(greatest(0.0, {_WILSON.format(sign='-')}), 6) AS ci_low, round(least(1.0, {_WILSON.format(sign='+')}), 6) AS ci_high, round(dev, 6) AS mean_dev FROM b")
def recall_at_k(spark, sf_dir):
    return e.recall_at_k(firsts(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("recall", "ci_low", "ci_high", "mean_dev")})


@query(f"WITH {SCOPED}, k AS (SELECT unnest([1, 3, 5]) AS k), a AS (SELECT k, count(*) AS n, CAST(sum(CASE WHEN first_rank <= k THEN 1 ELSE 0 END) AS BIGINT) AS hits, avg(CASE WHEN first_rank <= k THEN best_dev END) AS dev FROM firsts, k GROUP BY k), b AS (SELECT *, hits / n AS p FROM a) SELECT k, n, hits, round(p, 6) AS recall, round(greatest(0.0, {_WILSON.format(sign='-')}), 6) AS ci_low, round(least(1.0, {_WILSON.format(sign='+')}), 6) AS ci_high, round(dev, 6) AS mean_dev FROM b")
def recall_in_video(spark, sf_dir):
    return e.recall_at_k(firsts(spark, sf_dir, scoped=True)).withColumns({c: F.round(c, 6) for c in ("recall", "ci_low", "ci_high", "mean_dev")})


@query(f"WITH {RANKED} SELECT count(*) AS n, CAST(sum(CASE WHEN first_rank <= 5 AND (best >= 0.6 OR first_rank <= 3) THEN 1 ELSE 0 END) AS BIGINT) AS delivered, CAST(sum(CASE WHEN first_rank = 1 THEN 1 ELSE 0 END) AS BIGINT) AS first FROM firsts")
def delivered_at_k(spark, sf_dir):
    return e.delivered_at_k(firsts(spark, sf_dir))


@query("WITH c AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS hits FROM documents JOIN labels USING (doc_id) GROUP BY lang), b AS (SELECT *, hits / n AS p FROM c) SELECT lang, n, hits, " + f"round(greatest(0.0, {_WILSON.format(sign='-')}), 6) AS ci_low, round(least(1.0, {_WILSON.format(sign='+')}), 6) AS ci_high FROM b")
def wilson_ci(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels"), "doc_id")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("quality") == 1).cast("long")).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return counts.select("lang", "n", "hits", F.round(low, 6).alias("ci_low"), F.round(high, 6).alias("ci_high"))
