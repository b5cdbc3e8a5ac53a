"""Evaluation of boundaries and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import wilson


def windowdiff_presence(cases: DataFrame) -> DataFrame:
    """Of cases (video_id, duration, window_seconds, ref, hyp): mismatch, windows and windowdiff.

    A window (t, t + w], t = 0, 1, ..., mismatches if only one side has a boundary in it: presence is compared, not counts.
    """
    last = F.floor(F.col("duration") - F.col("window_seconds")).cast("int")
    steps = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    inside = lambda side, t: F.exists(side, lambda b: (b > t) & (b <= t + F.col("window_seconds")))
    differ = F.size(F.filter(steps, lambda t: inside("ref", t) != inside("hyp", t)))
    out = cases.select("video_id", differ.cast("long").alias("mismatch"), F.size(steps).cast("long").alias("windows"))
    return out.withColumn("windowdiff", F.when(F.col("windows") > 0, F.col("mismatch") / F.greatest(F.col("windows"), F.lit(1))).otherwise(0.0))


def windowdiff_counts(cases: DataFrame) -> DataFrame:
    """The textbook measure: a window mismatches if the numbers of boundaries in it differ."""
    last = F.floor(F.col("duration") - F.col("window_seconds")).cast("int")
    steps = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    inside = lambda side, t: F.size(F.filter(side, lambda b: (b > t) & (b <= t + F.col("window_seconds"))))
    differ = F.size(F.filter(steps, lambda t: inside("ref", t) != inside("hyp", t)))
    return cases.select("video_id", differ.cast("long").alias("mismatch"), F.size(steps).cast("long").alias("windows"))


def micro_macro(scores: DataFrame) -> DataFrame:
    return scores.agg((F.sum("mismatch") / F.sum("windows")).alias("micro"), F.avg("windowdiff").alias("macro"))


def boundary_hits(cases: DataFrame, tolerance: float = 20.0) -> DataFrame:
    """Per video: references hit and missed, and hypotheses without a reference, within the tolerance."""
    near = lambda one, many: F.exists(many, lambda b: F.abs(b - one) <= tolerance)
    hit = F.size(F.filter("ref", lambda r: near(r, "hyp")))
    false = F.size(F.filter("hyp", lambda h: ~near(h, "ref")))
    return cases.select("video_id", hit.cast("long").alias("hits"), (F.size("ref") - hit).cast("long").alias("missed"), false.cast("long").alias("false_cuts"))


def first_hits(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query of truth (query_id, video_id, expected_start, tolerance): first_rank of a hit (null if none) and best_dev.

    results: (query_id, rank, video_id, start_time, relevance). best_dev is the least deviation of any result of the video.
    """
    want = truth.select("query_id", F.col("video_id").alias("_video"), "expected_start", "tolerance")
    dev = F.when(F.col("video_id") == F.col("_video"), F.abs(F.col("start_time") - F.col("expected_start")))
    rows = want.join(results, "query_id", "left").withColumn("_dev", dev)
    return rows.groupBy("query_id").agg(F.min(F.when(F.col("_dev") <= F.col("tolerance"), F.col("rank"))).alias("first_rank"), F.min("_dev").alias("best_dev"), F.max("relevance").alias("best"))


def in_own_video(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs of each query with segments of its truth's video alone: the scope of a search within a video."""
    return pairs.join(truth.select("query_id", "video_id"), ["query_id", "video_id"], "left_semi")


def recall_at_k(firsts: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """One pass for all k: hits, queries, recall, Wilson interval, mean deviation of hits."""
    rows = firsts.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).withColumn("_hit", F.coalesce(F.col("first_rank") <= F.col("k"), F.lit(False)))
    out = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_hit").cast("long")).alias("hits"), F.avg(F.when(F.col("_hit"), F.col("best_dev"))).alias("mean_dev"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return out.select("k", "n", "hits", (F.col("hits") / F.col("n")).alias("recall"), low.alias("ci_low"), high.alias("ci_high"), "mean_dev")


def delivered_at_k(firsts: DataFrame, top_k: int = 5, high: float = 0.6, low_limit: int = 3) -> DataFrame:
    """Queries whose hit passes the gate: within top_k, and within low_limit if the best row stays below ``high``."""
    passes = F.col("first_rank").between(1, top_k) & ((F.col("best") >= high) | (F.col("first_rank") <= low_limit))
    return firsts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(passes, F.lit(False)).cast("long")).alias("delivered"), F.sum(F.coalesce(F.col("first_rank") == 1, F.lit(False)).cast("long")).alias("first"))
