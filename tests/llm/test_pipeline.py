import math
import re

import brute
import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F
from test_operators import drawn, plain_weights

from cuesheet.llm import quality, queries


def plain_lines(rows):
    """{doc_id: text} without lines on more than a tenth, and at least three, of a source's pages."""
    pages, seen = {}, {}
    for r in rows:
        pages[r["source"]] = pages.get(r["source"], 0) + 1
        for x in set((r["text"] or "").split("\n")):
            if x.strip(" "):
                seen[r["source"], x] = seen.get((r["source"], x), 0) + 1
    bad = {k for k, n in seen.items() if n >= 3 and n > 0.1 * pages[k[0]]}
    return {r["doc_id"]: r["text"] and "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in bad) for r in rows}


def plain_clean(rows, items):
    """Ids of rows without a window of ten words of an item."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(brute.LOWER))
    windows = {tuple(w[k : k + 10]) for w in map(words, items) if w for k in range(max(len(w) - 9, 1))}
    sizes = {len(w) for w in windows}
    return {r["doc_id"] for r in rows for w in [words(r["text"])] if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))}


def test_stages():
    assert [f.__module__ for _, f in cp.STAGES] == ["corpus_pipeline"] * 5 and cp.ORACLE_SQL is None


def test_each_stage_equals_plain_python(spark, sf_dir):
    stages = dict(cp.STAGES)
    docs = cp._table(spark, sf_dir, "documents")
    columns = docs.columns
    kept = cp.staged(stages["quality"](spark, docs, sf_dir), "t1")
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == columns
    good = {r["_good_id"] for r in queries.good_ids(cp._table(spark, sf_dir, "labels")).collect()}
    noise = {r[0]: (r[1] % (1 << 64) >> 11) + 0.5 for r in docs.select("doc_id", F.xxhash64(F.lit(3), "doc_id", F.xxhash64("text"))).collect()}
    weights = plain_weights([(r["doc_id"], r["text"]) for r in docs.collect()], good)
    order = sorted(weights, key=lambda x: math.log(-math.log(noise[x[0]] / (1 << 53))) - x[2])
    assert ids == {i for i, _, _ in order[: sum(j >= quality.LEAST for _, _, j in weights)]}
    told = {r["doc_id"]: r["quality"] for r in cp._table(spark, sf_dir, "labels").collect()}
    clean, bad = [i for i in told if i in good], [i for i, q in told.items() if q == 0]
    assert sum(i in ids for i in clean) >= 0.97 * len(clean) and sum(i in ids for i in bad) <= 0.35 * len(bad)

    lined = cp.staged(stages["lines"](spark, kept, sf_dir), "t2")
    assert lined.columns == columns and lined.dtypes == docs.dtypes
    assert {r["doc_id"]: r["text"] for r in lined.collect()} == plain_lines(kept.collect())

    near = cp.staged(stages["near duplicates"](spark, lined, sf_dir), "t3")
    want = brute.near_duplicates([(r["doc_id"], r["text"]) for r in lined.collect()], size=5)
    assert near.columns == columns and sorted(r["doc_id"] for r in near.collect()) == sorted(i for i, (_, c) in want.items() if i == c)

    clean = cp.staged(stages["benchmark"](spark, near, sf_dir), "t4")
    items = [r["text"] for r in cp._table(spark, sf_dir, "benchmark").collect()]
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == plain_clean(near.collect(), items)

    mix = stages["mix"](spark, clean, sf_dir)
    assert mix.columns == [*columns, "copy"]
    taken = {}
    for r in mix.collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
        assert r["copy"] == taken[r["doc_id"]] or r["copy"] <= 3
    sizes = clean.select("doc_id", "source", cp.mixing.n_words(F.col("text")).alias("size")).collect()
    assert drawn(spark, clean) == sorted(str((r["doc_id"], r["source"], r["size"], taken.get(r["doc_id"], 0))) for r in sizes)


def test_stages_keep_clashing_columns(spark, sf_dir):
    docs = cp._table(spark, sf_dir, "documents").limit(60).withColumns({c: F.lit(-7) for c in ("n_lines", "n_removed", "copy", "_row", "_hash", "_doc", "_c", "_id")})
    for _, stage in cp.STAGES:
        docs = cp.staged(stage(spark, docs, sf_dir), "clash")
        assert {r for r in docs.select("n_lines", "n_removed", "copy", "_row", "_hash", "_doc", "_c", "_id").distinct().collect()} <= {(-7,) * 8}
    assert docs.columns[-1] == "copy_" and docs.count() > 10


def test_stages_take_empty_tables(spark, sf_dir):
    docs = cp._table(spark, sf_dir, "documents").limit(0)
    for _, stage in cp.STAGES:
        docs = cp.staged(stage(spark, docs, sf_dir), "empty")
        assert docs.count() == 0


@pytest.mark.parametrize("text", [None, "", "x"])
def test_stages_take_odd_rows(spark, sf_dir, text):
    schema = cp._table(spark, sf_dir, "documents").schema
    docs = spark.createDataFrame([(None, text, None, None, None), (1, text, "en", "s", 1), (1, text, "en", "s", 1)], schema)
    # without a good label among them, all are taken; the two that repeat each other, and all three if they have words, are near duplicates
    left = {"quality": 3, "lines": 3, "near duplicates": 1 if text else 2, "benchmark": 1 if text else 2, "mix": 1 if text else 0}
    for name, stage in cp.STAGES:
        docs = cp.staged(stage(spark, docs, sf_dir), "odd")
        assert docs.count() == left[name], name
