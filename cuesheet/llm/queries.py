"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, exact_dedup, jaccard_join, langid, line_dedup, minhash, mixing, quality, sql, suffix_dedup, url_reputation, vector_codes, warc
from .staging import staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_repeats=3).select("doc_id", "source", "size", "source_size", "target", "taken")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = langid.train(docs.filter(fold != 0))
    return langid.predict_language(docs, model).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents"), length=200)


#: (verdict, host/path)
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label with its number: bad if it is toxic or of low quality."""
    labels = _table(spark, sf_dir, "labels")
    outcomes = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad"))
    found = url_reputation.judge_urls(_table(spark, sf_dir, "pages"), outcomes, URL_RULES)
    return found.withColumns({"bad_mean": F.round("bad_mean", 6), "bad_low": F.round("bad_low", 6)})


def good_ids(labels: DataFrame) -> DataFrame:
    """Ids that are labelled good and not toxic."""
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias("_good_id"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.importance_sample(_table(spark, sf_dir, "documents"), good_ids(_table(spark, sf_dir, "labels")))
    return found.select("doc_id", "log_weight", "selected")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), least_bytes=0)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"), size=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents"), ratio=0.1, min_pages=3)
    return kept.select("doc_id", "source", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), least=30, longest=4, share=80, top=2000)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(_table(spark, sf_dir, "documents"), size=5, percent=80).select("doc_id", "n_shingles", "component_id")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    books = vector_codes.train(table, id_col="vec_id", vector_col="embedding", parts=4, entries=256, rounds=4, scale=1024)
    coded = staged(vector_codes.encode(table, books, vector_col="embedding", columns=["vec_id", "label"]), "codes")
    found = vector_codes.group_errors(coded, "label", out_col="label_error")
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_exact_dedup, op3_mix_sources, op4_language, op5_suffix_dedup, op6_url_filter, op7_quality, op8_warc, op9_minhash, op10_line_dedup, op11_collocations, op12_jaccard_join, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, text in sql.ORACLES.items() if name in queries()}
