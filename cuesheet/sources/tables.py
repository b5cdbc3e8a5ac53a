"""Tables of the engine: readers for the usual formats, the views that stand for videos and segments, and idempotent writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = T.StructType(
    [
        T.StructField("tenant_id", T.StringType(), False),
        T.StructField("video_id", T.StringType(), False),
        T.StructField("segment_index", T.IntegerType(), False),
        T.StructField("start_time", T.DecimalType(10, 2), False),
        T.StructField("end_time", T.DecimalType(10, 2), False),
        T.StructField("text_content", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("chapter_title", T.StringType()),
        T.StructField("strategy", T.StringType()),
    ]
)
CASES = T.StructType(
    [
        T.StructField(
            "videos",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("videoId", T.StringType()),
                        T.StructField("duration", T.DoubleType()),
                        T.StructField("windowSeconds", T.DoubleType()),
                        T.StructField("ref", T.ArrayType(T.DoubleType())),
                        T.StructField("hyp", T.MapType(T.StringType(), T.ArrayType(T.DoubleType()))),
                    ]
                )
            ),
        )
    ]
)
QUESTIONS = T.StructType([T.StructField("pairs", T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("query", T.StringType()), ("videoId", T.StringType()), ("expectedStart", T.DoubleType()), ("toleranceSeconds", T.DoubleType()))])))])


#: Parts of a table in which rows are replaced by key.
PARTS = 64


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """parquet, orc, csv or json; csv and json want a schema, so that reading twice (to infer one) is never needed."""
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.options(**({"header": "true"} if kind == "csv" else {}) | options)
    return (reader.schema(schema) if schema is not None else reader).format(kind).load(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Boundary cases of a JSON file: (video_id, duration, window_seconds, ref, strategy, hyp)."""
    rows = spark.read.schema(CASES).json(path, multiLine=True).select(F.inline("videos"))
    return rows.select(F.col("videoId").alias("video_id"), "duration", F.col("windowSeconds").alias("window_seconds"), "ref", F.explode("hyp").alias("strategy", "hyp"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON file: (query, video_id, expected_start, tolerance)."""
    rows = spark.read.schema(QUESTIONS).json(path, multiLine=True).select(F.inline("pairs"))
    return rows.select("query", F.col("videoId").alias("video_id"), F.col("expectedStart").alias("expected_start"), F.col("toleranceSeconds").alias("tolerance"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with embeddings as segments: tenant is the source, video the language, index the document's number."""
    docs = load(spark, sf_dir, "documents").select(F.col("source").alias("tenant_id"), F.col("lang").alias("video_id"), F.col("doc_id").alias("segment_index"), F.col("text").alias("text_content"))
    return docs.join(load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("segment_index"), "embedding", "label"), "segment_index")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as timed lines: turns follow each other, ten characters a second."""
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("line"), "role", "text", F.length("text").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy("video_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("video_id", "line", "role", ((upto - F.col("_n")) / 10.0).alias("start"), (upto / 10.0).alias("end"), "text")


def replace_partitions(rows: DataFrame, path: str, by: Sequence[str] = ("tenant_id", "video_id")) -> None:
    """Write rows in place of what their partitions held: running again gives the same table. Each partition is a folder, so keys should be few."""
    rows.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def replace_rows(rows: DataFrame, path: str, by: Sequence[str] = ("tenant_id", "video_id"), parts: int = PARTS) -> None:
    """Write rows in place of those with the same key: running again gives the same table, read by ``replaced_table``.

    The table is dealt into parts by the key, so its files do not grow in number with the keys. Parts that rows fall into are written
    again with what other keys have there; the others stay. A table keeps the number of parts and the columns it began with.
    """
    spark, part = rows.sparkSession, F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")
    touched = [r[0] for r in rows.select(part.alias("part")).distinct().collect()]  # at most ``parts``
    both = rows.withColumns({"part": part, "_new": F.lit(True)})
    if (old := replaced_table(spark, path, rows.schema, part=True)) is not None:
        both = both.unionByName(old.filter(F.col("part").isin(touched)).withColumn("_new", F.lit(False)))
    w = W.partitionBy("part", *by)  # a task has whole parts, so this moves nothing again
    kept = both.repartition(parts, "part").withColumn("_last", F.max("_new").over(w)).filter(F.col("_new") == F.col("_last")).drop("_new", "_last")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def replaced_table(spark: SparkSession, path: str, schema: T.StructType, part: bool = False) -> DataFrame | None:
    """The rows that ``replace_rows`` left at path; None if nothing was written there."""
    try:
        rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.IntegerType())])).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows if part else rows.drop("part")
