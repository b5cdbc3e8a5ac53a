"""Retrieval queries. The query set is every vector whose id is divisible by 20; its words are those of a benchmark item, if there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import search_grams
from ..operators import keyword_index as k
from ..operators import nearest
from ..operators import retrieval as r
from ..operators.tenancy import Catalog, Context, scoped_session
from ..sources.tables import load, segments
from . import query

SEG = "seg AS (SELECT d.source AS tenant_id, d.lang AS video_id, d.doc_id AS segment_index, d.text AS text_content, CAST(e.embedding AS DOUBLE[]) AS v, e.label FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.embedding IS NOT NULL)"
FIRST = "first AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
ASKED = "asked AS (SELECT e.vec_id AS query_id, CAST(e.embedding AS DOUBLE[]) AS q, coalesce(list_distinct(list_transform(regexp_extract_all(b.text, '[A-Za-z][A-Za-z0-9+#.]*'), lambda w: lower(w))), []) AS grams FROM embeddings e LEFT JOIN benchmark b ON b.item_id = e.vec_id // 20 WHERE e.vec_id % 20 = 0)"
PAIRS = f"{SEG}, {ASKED}, pairs AS (SELECT query_id, tenant_id, video_id, segment_index, label, list_cosine_similarity(v, q) AS score, len(list_filter(grams, lambda g: contains(lower(coalesce(text_content, '')), g))) AS matched, len(grams) AS n_grams FROM seg, asked)"
MERGED = """vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, segment_index) AS rk FROM pairs),
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, segment_index) AS rk FROM pairs WHERE matched > 0),
cand AS (SELECT * EXCLUDE rk FROM kw WHERE rk <= 50 UNION SELECT * EXCLUDE rk FROM vec WHERE rk <= 50),
rel AS (SELECT *, least(1.0, greatest(0.0, score) + 0.1 * CASE WHEN n_grams > 0 THEN least(1.0, matched / n_grams) ELSE 0 END) AS relevance FROM cand),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, segment_index) AS rank, max(relevance) OVER (PARTITION BY query_id) AS best FROM rel WHERE relevance >= 0.4)"""


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return load(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, b = load(spark, sf_dir, "embeddings"), load(spark, sf_dir, "benchmark")
    rows = e.filter("vec_id % 20 = 0").join(b, F.floor(F.col("vec_id") / 20) == F.col("item_id"), "left")
    return r.with_grams(rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), F.col("text").alias("query")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs that can be in a query's lists."""
    return r.pooled(segments(spark, sf_dir), asked(spark, sf_dir))


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(f"WITH {SEG}, {FIRST} SELECT segment_index, video_id, round(list_cosine_similarity(v, q), 6) AS score FROM seg, first ORDER BY list_cosine_similarity(v, q) DESC, segment_index LIMIT 50")
def vector_topn(spark, sf_dir):
    return _rounded(r.vector_topn(segments(spark, sf_dir), first_vector(spark, sf_dir)).select("segment_index", "video_id", "score"), "score")


@query(f"WITH {SEG}, {FIRST} SELECT segment_index, tenant_id, video_id, round(list_cosine_similarity(v, q), 6) AS score FROM seg, first WHERE tenant_id = 'src1' AND video_id = 'en' ORDER BY list_cosine_similarity(v, q) DESC, segment_index LIMIT 50")
def vector_topn_filtered(spark, sf_dir):
    rows = r.filtered(segments(spark, sf_dir), "src1", "en")
    return _rounded(r.vector_topn(rows, first_vector(spark, sf_dir)).select("segment_index", "tenant_id", "video_id", "score"), "score")


@query(f"WITH {PAIRS} SELECT query_id, segment_index, rk AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, segment_index) AS rk FROM pairs) WHERE rk <= 50")
def vector_batch_topk(spark, sf_dir):
    found = nearest.best(segments(spark, sf_dir).select("segment_index", "embedding"), asked(spark, sf_dir), r.POOL)
    return _rounded(r.vector_candidates(found).select("query_id", "segment_index", F.col("rank_vector").cast("long").alias("rank"), "score"), "score")


@query(f"WITH {SEG}, {FIRST}, m AS (SELECT segment_index, len(list_filter(['the', 'tion', 'heer'], lambda g: contains(lower(coalesce(text_content, '')), g))) AS matched, list_cosine_similarity(v, q) AS s FROM seg, first) SELECT segment_index, CAST(matched AS BIGINT) AS matched, round(s, 6) AS score FROM m WHERE matched > 0 ORDER BY s DESC, segment_index LIMIT 50")
def keyword_topn(spark, sf_dir):
    found = r.keyword_topn(segments(spark, sf_dir), first_vector(spark, sf_dir), ["the", "tion", "heer"])
    return _rounded(found.select("segment_index", F.col("matched").cast("long").alias("matched"), "score"), "score")


@query(f"WITH {PAIRS} SELECT query_id, segment_index, CAST(matched AS BIGINT) AS matched, CAST(n_grams AS BIGINT) AS n_grams FROM pairs WHERE matched > 0")
def keyword_gram_count(spark, sf_dir):
    posted = k.postings(segments(spark, sf_dir))
    return k.matches(asked(spark, sf_dir), posted, k.pieces(posted)).withColumn("n_grams", F.col("n_grams").cast("long"))


@query(f"WITH {PAIRS}, {MERGED} SELECT query_id, segment_index, CAST(rank AS BIGINT) AS rank, round(relevance, 6) AS relevance FROM ranked WHERE rank <= 5")
def hybrid_rank(spark, sf_dir):
    return _rounded(r.raw_ranking(pairs(spark, sf_dir)).select("query_id", "segment_index", F.col("rank").cast("long").alias("rank"), "relevance"), "relevance")


@query(f"WITH {PAIRS}, {MERGED} SELECT query_id, video_id, segment_index, CAST(rank AS BIGINT) AS rank, round(relevance, 6) AS relevance, relevance < 0.6 AS low_confidence FROM ranked WHERE rank <= CASE WHEN best >= 0.6 THEN 5 ELSE 3 END")
def hybrid_search_gated(spark, sf_dir):
    found = r.gated(pairs(spark, sf_dir))
    return _rounded(found.select("query_id", "video_id", "segment_index", F.col("rank").cast("long").alias("rank"), "relevance", "low_confidence"), "relevance")


@query(f"WITH {PAIRS}, {MERGED} SELECT query_id, count(*) AS delivered, CAST(sum(CASE WHEN relevance < 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS low FROM ranked WHERE rank <= CASE WHEN best >= 0.6 THEN 5 ELSE 3 END GROUP BY query_id")
def hybrid_low_confidence(spark, sf_dir):
    return r.gated(pairs(spark, sf_dir)).groupBy("query_id").agg(F.count(F.lit(1)).alias("delivered"), F.sum(F.col("low_confidence").cast("long")).alias("low"))


@query(f"WITH {PAIRS}, {MERGED}, names AS (SELECT lang AS video_id, lang || '.mp4' AS video_name FROM documents WHERE lang <> 'fr' GROUP BY lang) SELECT query_id, segment_index, video_id, video_name, round(relevance, 6) AS relevance FROM ranked LEFT JOIN names USING (video_id) WHERE rank <= CASE WHEN best >= 0.6 THEN 5 ELSE 3 END")
def hybrid_result_named(spark, sf_dir):
    videos = load(spark, sf_dir, "documents").filter("lang <> 'fr'").groupBy(F.col("lang").alias("video_id")).agg(F.concat(F.first("lang"), F.lit(".mp4")).alias("file_name"))
    found = r.named(r.gated(pairs(spark, sf_dir)), videos)
    return _rounded(found.select("query_id", "segment_index", "video_id", "video_name", "relevance"), "relevance")


@query(f"WITH {PAIRS}, {MERGED}, a AS (SELECT query_id, count(*) AS n_merged, CAST(sum(CASE WHEN relevance < 0.4 THEN 1 ELSE 0 END) AS BIGINT) AS floor_drops FROM rel GROUP BY query_id), b AS (SELECT query_id, count(*) AS n_vector FROM vec WHERE rk <= 50 GROUP BY query_id), c AS (SELECT query_id, count(*) AS n_keyword FROM kw WHERE rk <= 50 GROUP BY query_id) SELECT query_id, n_vector, coalesce(n_keyword, 0) AS n_keyword, n_merged, floor_drops, greatest(n_merged - floor_drops - 5, 0) AS truncated FROM a JOIN b USING (query_id) LEFT JOIN c USING (query_id)")
def search_drop_counters(spark, sf_dir):
    return r.drop_counters(pairs(spark, sf_dir)).select("query_id", "n_vector", "n_keyword", "n_merged", "floor_drops", "truncated")


@query("SELECT item_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+#.]*'), lambda w: lower(w)))), ' ') AS grams FROM benchmark")
def gram_extract(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(search_grams(F.col("text"))), " ").alias("grams"))


#: Letters as Han characters, so that the test tables hold some; u to z stay.
LETTERS, HAN = "abcdefghijklmnopqrst", "三元运算符表达式变量线程池数据库锁分布"


@query(f"WITH t AS (SELECT conv_id, turn, translate(text, '{LETTERS}', '{HAN}') AS t FROM conversations), g AS (SELECT conv_id, turn, list_distinct(list_concat(list_transform(regexp_extract_all(t, '[A-Za-z][A-Za-z0-9+#.]*'), lambda w: lower(w)), list_filter(list_transform(range(1, length(t)), lambda i: t[i:i + 1]), lambda p: regexp_full_match(p, '[一-鿿]{{2}}')))) AS g FROM t) SELECT conv_id, turn, CAST(len(g) AS BIGINT) AS n_grams, md5(array_to_string(list_sort(g), ',')) AS grams_md5 FROM g")
def gram_extract_cjk(spark, sf_dir):
    """Grams of every turn with most of its letters as Han characters: overlapping pairs of these, and words."""
    grams = F.array_sort(search_grams(F.translate("text", LETTERS, HAN)))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(grams).cast("long").alias("n_grams"), F.md5(F.array_join(grams, ",")).alias("grams_md5"))


@query(f"WITH {PAIRS}, {MERGED}, names AS (SELECT DISTINCT lang AS video_id, lang || '.mp4' AS video_name FROM documents WHERE lang <> 'fr') SELECT query_id, CAST(rank AS BIGINT) AS rank, ranked.video_id, video_name, ranked.segment_index, CAST(ranked.segment_index AS DOUBLE) AS start_time, CAST(ranked.segment_index + 1 AS DOUBLE) AS end_time, md5(text) AS text_md5, substr(text, 1, 10) AS chapter_title, round(relevance, 6) AS score, relevance < 0.6 AS low_confidence FROM ranked LEFT JOIN names ON names.video_id = ranked.video_id JOIN documents d ON d.doc_id = ranked.segment_index WHERE rank <= CASE WHEN best >= 0.6 THEN 5 ELSE 3 END")
def search_results(spark, sf_dir):
    """All nine fields of the delivered rows; texts and times are fetched for these alone."""
    docs = load(spark, sf_dir, "documents")
    videos = docs.filter("lang <> 'fr'").select(F.col("lang").alias("video_id"), F.concat("lang", F.lit(".mp4")).alias("file_name")).distinct()
    index = F.col("doc_id")
    rows = docs.select(index.alias("segment_index"), index.cast("double").alias("start_time"), (index + 1).cast("double").alias("end_time"), F.col("text").alias("text_content"), F.substring("text", 1, 10).alias("chapter_title"))
    found = r.results(r.gated(pairs(spark, sf_dir)).join(rows, "segment_index"), videos)
    return _rounded(found, "score").withColumns({"rank": F.col("rank").cast("long"), "text": F.md5("text")}).withColumnRenamed("text", "text_md5")


@query(f"WITH {SEG}, {FIRST} SELECT segment_index, round(list_cosine_similarity(v, q), 6) AS score FROM seg, first ORDER BY list_cosine_similarity(v, q) DESC, segment_index LIMIT 50")
def vector_mode(spark, sf_dir):
    """Outside hybrid mode there are no grams: the pool is the vector list."""
    one = load(spark, sf_dir, "embeddings").filter("vec_id = 0").select(F.lit(0).alias("query_id"), F.col("embedding").alias("query_vec"), F.lit("the tion").alias("query"))
    found = r.merged(r.scored(segments(spark, sf_dir), r.with_grams(one, "Vector")))
    return _rounded(found.select("segment_index", "score"), "score")


def _catalog(spark, sf_dir) -> Catalog:
    docs = load(spark, sf_dir, "documents").select(F.col("source").alias("tenant_id"), F.col("lang").alias("video_id"), "doc_id", "n_chars")
    return Catalog({"video_segment": docs})


@query("SELECT lang AS video_id, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE source = 'src3' GROUP BY lang")
def tenant_scoped_scan(spark, sf_dir):
    return _catalog(spark, sf_dir).table("video_segment", Context("src3")).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT CAST(0 AS BIGINT) AS nobody, count(*) AS everybody FROM documents")
def tenant_fail_closed(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    nobody = c.table("video_segment", Context()).agg(F.count(F.lit(1)).alias("nobody"))
    return nobody.crossJoin(c.table("video_segment", Context(system=True)).agg(F.count(F.lit(1)).alias("everybody")))


@query("WITH d AS (SELECT * FROM documents WHERE source = 'src3') SELECT lang AS video_id, count(*) AS n, count(v.vec_id) AS with_vector, CAST(max(n_chars) AS BIGINT) AS longest FROM d LEFT JOIN embeddings v ON v.vec_id = doc_id WHERE n_chars >= (SELECT avg(n_chars) FROM d) GROUP BY lang")
def tenant_sql(spark, sf_dir):
    """SQL text without a word about tenants, in a tenant's session: its join and its subquery see that tenant's rows alone."""
    tables = {
        "video_segment": lambda own: load(own, sf_dir, "documents").select(F.col("source").alias("tenant_id"), F.col("lang").alias("video_id"), "doc_id", "n_chars"),
        "app_user": lambda own: load(own, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")),
    }
    own = scoped_session(spark, tables, Context("src3"))
    return own.sql("SELECT video_id, count(*) AS n, count(u.doc_id) AS with_vector, max(n_chars) AS longest FROM video_segment s LEFT JOIN app_user u ON u.doc_id = s.doc_id WHERE n_chars >= (SELECT avg(n_chars) FROM video_segment) GROUP BY video_id")
