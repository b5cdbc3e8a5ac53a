import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheet.operators import keyword_index as k
from cuesheet.operators import retrieval as r
from cuesheet.operators import vector_index as v
from cuesheet.plans import QUERIES


def vectors(spark, n=600, size=16, seed=5):
    """Vectors around 20 centres, null ones among them."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, size))
    rows = [(i, (centres[i % 20] + 0.3 * rng.normal(size=size)).tolist() if i % 97 else None, f"t{i % 3}") for i in range(n)]
    return spark.createDataFrame(rows, "segment_index long, embedding array<float>, tenant_id string")


def lists(pairs, n=10):
    found = r.vector_candidates(pairs, n).collect()
    return {(x["query_id"], x["segment_index"]) for x in found}


def test_index_finds_most_of_what_the_exact_way_finds(spark, tmp_path):
    rows = vectors(spark)
    queries = rows.filter("segment_index % 20 = 3").select(F.col("segment_index").alias("query_id"), F.col("embedding").alias("query_vec"), F.array().cast("array<string>").alias("grams"))
    exact = lists(r.scored(rows.withColumn("text_content", F.lit("")), queries))
    index = v.build(rows, str(tmp_path / "i"), id_col="segment_index", vector_col="embedding", cells=24)
    assert index.rows.count() == rows.filter("embedding is not null").count()  # every row, each in one cell
    got = lists(v.scored(index, queries, vector_col="embedding", probes=4))
    assert len(got & exact) >= 0.9 * len(exact)
    assert lists(v.scored(index, queries, vector_col="embedding", probes=24)) == exact  # all cells: the exact way
    one = r.filtered(v.scored(index, queries, vector_col="embedding", probes=4), "t1")
    assert {x["tenant_id"] for x in one.collect()} == {"t1"} and len(lists(one)) == len(exact)


def test_search_reads_the_cells_it_probes(spark, tmp_path):
    rows = vectors(spark)
    index = v.build(rows, str(tmp_path / "i"), id_col="segment_index", vector_col="embedding", cells=24)
    one = rows.filter("segment_index = 3").select(F.col("segment_index").alias("query_id"), F.col("embedding").alias("query_vec"))
    pairs = v.scored(index, one, vector_col="embedding", probes=2)
    plan = pairs._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()
    assert pairs.count() < index.rows.count() / 4


def test_rows_are_added_under_the_same_centres(spark, tmp_path):
    rows, path = vectors(spark), str(tmp_path / "i")
    index = v.build(rows.filter("segment_index < 400"), path, id_col="segment_index", vector_col="embedding", cells=8)
    more = v.add(index, rows.filter("segment_index >= 400"), path, vector_col="embedding")
    assert (more.centres == index.centres).all() and more.rows.count() == rows.filter("embedding is not null").count()
    both = v.load(spark, path)
    assert (both.centres == index.centres).all() and both.rows.select("segment_index").distinct().count() == both.rows.count()


def test_large_query_sets_meet_by_a_shuffle(spark, tmp_path, monkeypatch):
    rows = vectors(spark, 200)
    queries = rows.filter("segment_index % 20 = 3").select(F.col("segment_index").alias("query_id"), F.col("embedding").alias("query_vec"))
    index = v.build(rows, str(tmp_path / "i"), id_col="segment_index", vector_col="embedding", cells=8)
    want = lists(v.scored(index, queries, vector_col="embedding", probes=3))
    monkeypatch.setattr(r, "QUERIES_BYTES", 0)
    assert lists(v.scored(index, queries, vector_col="embedding", probes=3)) == want


def test_unequal_sizes_and_empty_indexes_are_told(spark, tmp_path):
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "segment_index long, embedding array<float>")
    with pytest.raises(ValueError, match="sizes 2 and 1"):
        v.fit(odd, id_col="segment_index", vector_col="embedding")
    with pytest.raises(ValueError, match="no rows"):
        v.build(odd.limit(0), str(tmp_path / "i"), id_col="segment_index", vector_col="embedding")


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_recall_on_the_given_tables(spark, sf):
    row = QUERIES["vector_index_recall"](spark, f"/root/testdata/sf{sf}").first()
    assert row["recall"] >= 0.9 and row["wanted"] == 10 * row["queries"]


def test_postings_answer_as_the_texts_do(spark):
    rng = random.Random(3)
    words = ["Redis", "distributed", "分布式锁", "c++", "C#", "ab", "a", "x.y", "Ünder", "K"]
    texts = [(i, " ".join(rng.choice(words) + rng.choice(["", "-", "s", "三"]) for _ in range(rng.randint(0, 6)))) for i in range(120)] + [(900, None), (901, "")]
    grams = ["a", "ab", "red", "redis", "dist", "ributed", "分布", "布式", "c++", "c#", "x.", ".y", "zzz", "REDIS", "三"]
    segments = spark.createDataFrame(texts, "segment_index long, text_content string")
    queries = spark.createDataFrame([(1, grams), (2, ["zzz"]), (3, []), (4, ["redis", "Redis"])], "query_id long, grams array<string>")
    posted = k.postings(segments)
    got = {(x["query_id"], x["segment_index"]): (x["matched"], x["n_grams"]) for x in k.matches(queries, posted, k.pieces(posted)).collect()}
    held = lambda t, gs: sum(g.lower() in (t or "").lower() for g in gs)
    want = {(q, i): (held(t, gs), len(gs)) for q, gs in ((1, grams), (4, ["redis", "Redis"])) for i, t in texts if held(t, gs)}
    assert got == want
    counts = {x["gram"]: x["n"] for x in k.gram_counts(queries, posted, k.pieces(posted)).collect()}
    assert counts == {g.lower(): sum(g.lower() in (t or "").lower() for _, t in texts) for g in grams}


def test_holders_of_a_gram_are_bits(spark, monkeypatch):
    texts = [(i, "common commons" if i % 3 else "common") for i in range(-640, 640)] + [(2**40 + 63, "commoner"), (7000, "other"), (-(2**63), "common")]
    queries = spark.createDataFrame([(1, ["common", "s", "Common"]), (2, ["oner"])], "query_id long, grams array<string>")
    held = lambda t, gs: sum(g.lower() in t for g in gs)
    want = {(q, i): held(t, gs) for q, gs in ((1, ["common", "s", "Common"]), (2, ["oner"])) for i, t in texts if held(t, gs)}
    monkeypatch.setattr(k, "POSTINGS", 300)
    for kind, name in (("long", int), ("string", str)):
        rows = [(name(i), t) for i, t in texts]
        posted = k.postings(spark.createDataFrame(rows, f"segment_index {kind}, text_content string"))
        found = k.matches(queries, posted, k.pieces(posted))
        assert found.schema["segment_index"].dataType.simpleString() == {"long": "bigint"}.get(kind, kind)
        assert {(x["query_id"], x["segment_index"]): (x["matched"], x["n_grams"]) for x in found.collect()} == {(q, name(i)): (n, 3 if q == 1 else 1) for (q, i), n in want.items()}
        counts = {x["gram"]: x["n"] for x in k.gram_counts(queries, posted, k.pieces(posted)).collect()}
        assert counts == {g: sum(g in t for _, t in texts) for g in ("common", "s", "oner")}
        if kind == "long":
            assert k._holders(spark.createDataFrame([("common",)], "gram string"), posted, k.pieces(posted), "segment_index").count() == 22  # not 1,282 rows


def test_words_are_pruned_by_trigrams(spark):
    posted = k.postings(spark.createDataFrame([(i, f"word{i} other{i}") for i in range(200)], "segment_index long, text_content string"))
    found = k.words_with(spark.createDataFrame([("word17",)], "gram string"), k.pieces(posted))
    assert {x["word"] for x in found.collect()} == {"word17", *(f"word17{d}" for d in range(10))}
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
