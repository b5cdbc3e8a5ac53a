"""Queries over the two indexes: vectors by cells, and text by postings and trigrams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keyword_index as k
from ..operators import nearest
from ..operators import retrieval as r
from ..operators import vector_index as v
from ..sources.folders import new_folder
from ..sources.tables import load, segments
from . import query
from .retrievals import ASKED, FIRST, SEG, asked, first_vector

TOP = 10


def _cells(cells: int = v.CELLS, probes: int = v.PROBES, sample: int = v.SAMPLE, rounds: int = v.ROUNDS) -> str:
    """SQL of the index: near (query_id, cell), held (vec_id, cell, v). Parts are lists of doubles that hold integers, so distances are exact."""
    integers = f"list_transform(embedding, lambda y: floor({v.SCALE} * CAST(y AS DOUBLE)))"
    near = "(SELECT {id}, arg_min(e, d * 4096 + e) AS e FROM (SELECT {id}, e, CAST(list_inner_product(c, c) - 2 * list_inner_product(v, c) AS HUGEINT) AS d FROM {rows}, {books}) GROUP BY {id})"
    text = f"""d AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS q, {integers} AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS MATERIALIZED (SELECT v, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS r FROM d QUALIFY r < {sample}),
b0 AS MATERIALIZED (SELECT r AS e, v AS c FROM s WHERE r < {cells}),
"""
    for i in range(rounds):
        text += f"""a{i} AS {near.format(id="r", rows="s", books=f"b{i}")},
m{i} AS (SELECT e, list(floor(x / CAST(n AS DOUBLE)) ORDER BY j) AS c FROM (SELECT a.e, j, sum(s.v[j]) AS x, count(*) AS n FROM a{i} a JOIN s ON a.r = s.r, LATERAL (SELECT unnest(range(1, len(s.v) + 1)) AS j) GROUP BY ALL) GROUP BY e),
b{i + 1} AS MATERIALIZED (SELECT b.e, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m ON b.e = m.e),
"""
    return text + f"""held AS MATERIALIZED (SELECT d.vec_id, d.q, e AS cell FROM d JOIN {near.format(id="vec_id", rows="d", books=f"b{rounds}")} USING (vec_id)),
near AS MATERIALIZED (SELECT query_id, q, e AS cell FROM (SELECT vec_id AS query_id, q, e, row_number() OVER (PARTITION BY vec_id ORDER BY list_inner_product(c, c) - 2 * list_inner_product(v, c), e) AS p FROM d, b{rounds} WHERE vec_id % 20 = 0) WHERE p <= {probes}),
found AS (SELECT * FROM (SELECT query_id, vec_id AS segment_index, list_cosine_similarity(held.q, near.q) AS score, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(held.q, near.q) DESC, vec_id) AS rank FROM held JOIN near USING (cell)) WHERE rank <= {TOP})"""


def _rows(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("segment_index"), "embedding")


def _queries(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def _found(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    index = v.build(rows, new_folder(spark, "indexes"), id_col="segment_index", vector_col="embedding")
    return r.vector_candidates(v.nearest_rows(index, _queries(spark, sf_dir), TOP, id_col="segment_index", vector_col="embedding"), TOP)


@query(f"WITH {_cells()} SELECT query_id, segment_index, rank, round(score, 6) AS score FROM found")
def vector_index_search(spark, sf_dir):
    """The ten nearest by an index of all vectors, of every vector whose id is divisible by 20."""
    return _found(spark, sf_dir).select("query_id", "segment_index", F.col("rank_vector").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {_cells()}, exact AS (SELECT * FROM (SELECT a.vec_id AS query_id, d.vec_id AS segment_index, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(d.q, a.q) DESC, d.vec_id) AS rank FROM d, d a WHERE a.vec_id % 20 = 0) WHERE rank <= {TOP}) SELECT count(DISTINCT query_id) AS queries, count(*) AS wanted, count(f.rank) AS found, round(count(f.rank) / count(*), 6) AS recall FROM exact LEFT JOIN found f USING (query_id, segment_index)")
def vector_index_recall(spark, sf_dir):
    """How much of the exact lists the index finds."""
    exact = r.vector_candidates(nearest.best(_rows(spark, sf_dir), _queries(spark, sf_dir), TOP), TOP)
    return v.recall(exact.select("query_id", "segment_index"), _found(spark, sf_dir), "segment_index").withColumn("recall", F.round("recall", 6))


@query(f"WITH {SEG}, {ASKED}, g AS (SELECT DISTINCT unnest(grams) AS gram FROM asked) SELECT gram, CAST((SELECT count(*) FROM seg WHERE contains(lower(coalesce(text_content, '')), gram)) AS BIGINT) AS n FROM g")
def gram_frequency(spark, sf_dir):
    """In how many segments each gram of the queries is found, from postings."""
    posted = k.postings(segments(spark, sf_dir))
    return k.gram_counts(asked(spark, sf_dir), posted, k.pieces(posted))


@query(f"WITH {SEG}, {FIRST}, m AS (SELECT segment_index, len(list_filter(['the', 'tion', 'heer', 'q'], lambda g: contains(lower(coalesce(text_content, '')), g))) AS matched, list_cosine_similarity(v, q) AS s FROM seg, first) SELECT segment_index, CAST(matched AS BIGINT) AS matched, round(s, 6) AS score FROM m WHERE matched > 0 ORDER BY s DESC, segment_index LIMIT 50")
def keyword_index_topn(spark, sf_dir):
    """keyword_topn by postings: vectors are read for the segments that hold a gram."""
    rows = segments(spark, sf_dir)
    posted = k.postings(rows)
    one = spark.range(1).select(F.lit(0).alias("query_id"), F.array(*(F.lit(g) for g in ("the", "tion", "heer", "q"))).alias("grams"))
    held = k.matches(one, posted, k.pieces(posted)).select("segment_index", "matched")
    found = r.vector_topn(rows.join(held, "segment_index"), first_vector(spark, sf_dir))
    return found.select("segment_index", "matched", F.round("score", 6).alias("score"))
