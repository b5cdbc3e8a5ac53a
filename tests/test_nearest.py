import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cuesheet.operators import evaluation as e
from cuesheet.operators import nearest
from cuesheet.operators import retrieval as r
from cuesheet.plans import QUERIES

SCHEMA = "segment_index int, tenant_id string, video_id string, text_content string, embedding array<float>"


def tables(spark, seed=1, n=300):
    """Segments with equal, null, zero and NaN vectors, and queries of which some have no vector or no grams."""
    rng = random.Random(seed)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(5)]
    some = [vec() for _ in range(6)] + [[0.0] * 5, [float("nan")] + [1.0] * 4, [1.0, None, 1.0, 1.0, 1.0]]
    pick = lambda: rng.choice(some) if rng.random() < 0.5 else vec()
    segments = [(i, "t", rng.choice("ab"), rng.choice(["java lock", "redis map", "javascript", "", None]), pick() if i % 13 else None) for i in range(n)]
    queries = [(k, pick() if k % 9 else None, rng.choice(["Java redis", "lock", "", "no such"])) for k in range(40)]
    asked = r.with_grams(spark.createDataFrame(queries, "query_id int, query_vec array<double>, query string"))
    return spark.createDataFrame(segments, SCHEMA), asked


def shown(df, *cols):
    return sorted(str(tuple(x)) for x in df.select(*cols).collect())


@pytest.mark.parametrize("rows, queries, pairs, run", [(32_768, 2_048, 1 << 22, 64), (50, 7, 100, 4)])
def test_blocks_give_the_lists_of_all_pairs(spark, monkeypatch, rows, queries, pairs, run):
    for name, value in (("ROWS", rows), ("QUERIES", queries), ("PAIRS", pairs)):
        monkeypatch.setattr(nearest, name, value)
    segments, asked = tables(spark)
    every = r.scored(segments, asked).cache()
    some = r.pooled(segments, asked, 8).cache()
    assert sorted(some.columns) == sorted(every.columns) and some.count() < every.count() / 2
    cols = ["query_id", "segment_index", "video_id", "score", "matched", "n_grams", "rank_vector"]
    assert shown(r.candidates(some, 8), *cols) == shown(r.candidates(every, 8), *cols)
    plain = nearest.best(segments.drop("text_content"), asked, 8)
    assert shown(r.vector_candidates(plain, 8), *cols[:4]) == shown(r.vector_candidates(every, 8), *cols[:4])
    truth = asked.select("query_id", F.lit("a").alias("video_id")).filter("query_id > 2")
    mine = nearest.best(segments.drop("text_content"), asked.join(truth, "query_id"), 4, keys=["video_id"], others=True)
    want = e.in_own_video(every.filter("segment_index <> query_id"), truth)
    assert shown(r.vector_candidates(mine, 4), *cols[:4]) == shown(r.vector_candidates(want, 4), *cols[:4])


def test_unequal_sizes_raise_in_blocks(spark):
    segments, asked = tables(spark)
    with pytest.raises(PySparkException, match="sizes 5 and 2"):
        nearest.best(segments, asked.withColumn("query_vec", F.array(F.lit(1.0), F.lit(2.0))), 3).collect()


@pytest.mark.parametrize("name", ["hybrid_low_confidence", "hybrid_result_named", "hybrid_rank", "hybrid_search_gated", "search_drop_counters", "search_results", "vector_batch_topk", "vector_index_search", "vector_index_recall", "recall_at_k", "recall_in_video", "first_hit_rank", "delivered_at_k"])
def test_no_query_makes_a_row_for_each_pair(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "query_vec" not in "".join(line for line in plan.splitlines() if "Join Inner" in line or "Join Cross" in line) and "FlatMapCoGroupsInArrow" in plan
