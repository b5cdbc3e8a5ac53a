"""Documents with equal sets as one class: what the operators on near duplicates share around their search for links.

A sketch has a row per document: _row, _id, _hash (of the text), _n (size of its set), _class. Of a class only the first row goes
on: that with the smallest id, null last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import light, staged


def slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))


def first_rows(sketch: DataFrame) -> DataFrame:
    """(_class, _first): the row of each class that stands for it; staged."""
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))).alias("_first")
    return staged(sketch.groupBy("_class").agg(first).select("_class", "_first"), "classes")


def representatives(sketch: DataFrame, classes: DataFrame) -> DataFrame:
    """The first rows of classes with a set."""
    return sketch.filter("_n > 0").join(classes.select(F.col("_first.row").alias("_row")), "_row", "left_semi")


def texts_of(slim: DataFrame, sketch: DataFrame, rows: DataFrame) -> DataFrame:
    """(_row, _text) of the _row in rows: texts are found again by id and hash, each once."""
    near = staged(rows.distinct().join(sketch.select("_row", "_id", "_hash"), "_row").select("_row", F.col("_id").alias("_i"), F.col("_hash").alias("_h")), "wanted")
    near = light(near, 48)  # the texts of all documents are not shuffled for a few
    texts = slim.drop("_row").join(near, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h"))).select("_row", "_text")
    if sketch.groupBy("_id", "_hash").agg(F.count(F.lit(1)).alias("_many")).filter("_many > 1").limit(1).count():
        texts = texts.dropDuplicates(["_row"])  # rows that repeat give a class's text once each
    return texts


def named(sketch: DataFrame, classes: DataFrame, label: DataFrame, id_col: str) -> DataFrame:
    """A row per document: id, _hash, n_shingles, component_id (smallest id reachable), first (whether it is that document)."""
    rows = classes.join(label, F.col("_first.row") == F.col("node"), "left").select("_class", "_first", F.coalesce("label", "_first.row").alias("_c"))
    rows = staged(rows, "classes-labelled")
    heads = staged(rows.groupBy("_c").agg(F.min("_first").alias("_head")), "heads")
    rows = staged(rows.join(heads, "_c").select("_class", "_head"), "classes-named")
    out = sketch.join(rows, "_class")
    return out.select(F.col("_id").alias(id_col), "_hash", F.col("_n").alias("n_shingles"), F.col("_head.id").alias("component_id"), (F.col("_row") == F.col("_head.row")).alias("first"))
