"""A training corpus from ``documents``: quality, boilerplate lines, near duplicates, benchmark leaks, mix.

Each stage reads all that its predecessor kept and returns the columns of documents; the last adds ``copy`` (with underscores
behind it if documents has such a column). Columns that a stage does not use, whatever their names, pass through.

An empty table gives an empty table. Null and empty texts go through the quality, line, near-duplicate and benchmark stages
(they have weight 0, no lines, no shingles and no words) and are not taken by the mix, as they have no words. Very long texts
are judged whole. Rows that repeat another's id and text share its fate, but the near-duplicate stage keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm import decontaminate, line_dedup, minhash, mixing, quality
from cuesheet.llm.queries import good_ids
from cuesheet.llm.staging import staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go; without a good label none. Ties of weight and noise go together."""
    return quality.keep_selected(docs, good_ids(_table(spark, sf_dir, "labels")))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of their source's pages, three at least, go; n_chars follows. A null source is a source."""
    kept = line_dedup.drop_boilerplate(docs, ratio=0.1, min_pages=3)
    n_removed = F.col(kept.columns[-1])
    n_chars = F.when(n_removed > 0, F.length("text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return (kept.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)) if n_chars is not None else kept).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id; null counts as the largest."""
    return minhash.drop_near_duplicates(docs, size=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; an empty benchmark drops none."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"), n=10)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the weights 5, 2, 1; a row for each copy taken. A null source is a source, the last."""
    return mixing.mix_documents(docs, weights=(5, 2, 1), max_repeats=3)


STAGES = [("quality", by_quality), ("lines", without_boilerplate), ("near duplicates", without_near_duplicates), ("benchmark", without_benchmark), ("mix", mixed)]

#: Hash functions of the sampling and signatures have no counterpart in SQL; tests hold the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
