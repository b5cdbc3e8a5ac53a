"""Exact dedup by deterministic block naming, with DataFrame functions only.

Every normalised text is cut into blocks of ``block_bytes`` bytes. Distinct blocks are sorted within their partition and
get integer names; then neighbouring names are paired, distinct pairs sorted and named, until each document has one name.
Texts with as many blocks and the same last name are equal: names never rest on a hash alone. Blocks find their name by a
hash; where two different blocks share one (their smallest and largest differ), these blocks are named by their bytes.
Texts cross the network once, after equal blocks of a task have been merged.

Null counts as empty text; all empty texts are equal. Very long texts are cut into blocks within their row. Of equal texts the row with the most code points in the original,
then the smallest id (null last) stays; of rows with the same id, one. Other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import release, staged

SPACE = r"[\x20\x09-\x0D]+"
BLOCK_BYTES = 1 << 14


def normalised(text: Column) -> Column:
    """text without white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def _blocks(norm: Column, block_bytes: int) -> Column:
    raw = F.to_binary(norm, F.lit("utf-8"))
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length(norm), F.lit(1)), F.lit(block_bytes))
    return F.transform(starts, lambda i: F.substring(raw, i, F.lit(block_bytes)))


def _named(values: DataFrame, order: list[str]) -> DataFrame:
    """values with an integer ``name``: sorted within each partition, so a task that runs again gives the same names."""
    return values.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def name_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """A row per document: _id, _row, _points (code points of the original), sha256, _n (blocks), _name; staged.

    hash_bits below 64 makes hashes collide, for tests.
    """
    hashed = lambda b: F.shiftright(F.xxhash64(b), 64 - hash_bits)
    cut = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_norm", normalised(F.col("_text")))
    ids = cut.withColumn("_row", F.monotonically_increasing_id()).select(
        "_id", "_row", F.coalesce(F.length("_text"), F.lit(0)).alias("_points"), F.sha2("_norm", 256).alias("sha256"), _blocks(F.col("_norm"), block_bytes).alias("_blocks")
    )
    rows = staged(ids.withColumn("_hashes", F.transform("_blocks", hashed)).drop("_blocks").withColumn("_n", F.size("_hashes")), "dedup-rows")

    blocks = cut.select(F.explode(_blocks(F.col("_norm"), block_bytes)).alias("_block")).withColumn("_hash", hashed(F.col("_block")))
    by_hash = blocks.groupBy("_hash").agg(F.min("_block").alias("_least"), F.max("_block").alias("_most"))
    named = staged(_named(by_hash, ["_least", "_most"]).select("_hash", (F.col("name") * 2).alias("name"), (F.col("_least") != F.col("_most")).alias("_shared")), "dedup-names")
    alone = named.filter(~F.col("_shared")).drop("_shared")

    if named.filter("_shared").limit(1).count():  # so rare that another pass with the blocks themselves costs nothing in the mean
        rows = staged(ids.withColumn("_n", F.size("_blocks")), "dedup-rows-blocks")
        parts = rows.select("_row", "_n", F.posexplode("_blocks").alias("_pos", "_block")).withColumn("_hash", hashed(F.col("_block")))
        shared = parts.join(named.filter("_shared").select("_hash"), "_hash", "left_semi")
        names = staged(_named(shared.select("_block").distinct(), ["_block"]).withColumn("name", F.col("name") * 2 + 1), "dedup-names-blocks")
        parts = parts.join(alone, "_hash").select(*_PART).unionByName(shared.join(names, "_block").select(*_PART))
        rows = rows.drop("_blocks")
    else:
        parts = rows.select("_row", "_n", F.posexplode("_hashes").alias("_pos", "_hash")).join(alone, "_hash").select(*_PART)
        rows = rows.drop("_hashes")
    last = _last_names(staged(parts, "dedup-level"))
    return staged(rows.join(last, "_row"), "dedup-named")


_PART = ["_row", "_n", "_pos", "name"]


def _last_names(parts: DataFrame) -> DataFrame:
    """(_row, _name) of all documents, from the names of their blocks."""
    done = parts.filter("_n = 1").select("_row", F.col("name").alias("_name"))
    most, left, level = parts.agg(F.coalesce(F.max("_n"), F.lit(1))).first()[0], parts.filter("_n > 1"), 1
    while most > 1:
        half = F.col("_pos") % 2
        pairs = left.groupBy("_row", "_n", F.floor(F.col("_pos") / 2).cast("int").alias("_pos")).agg(F.max(F.when(half == 0, F.col("name"))).alias("_a"), F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(-1)).alias("_b"))
        pairs = staged(pairs, "dedup-pairs")
        names = staged(_named(pairs.select("_a", "_b").distinct(), ["_a", "_b"]), "dedup-pair-names")
        named = staged(pairs.join(names, ["_a", "_b"]).select(*_PART), "dedup-level")
        one = F.col("_n") <= F.lit(1 << level)
        done = done.unionByName(named.filter(one).select("_row", F.col("name").alias("_name")))
        release(pairs)
        release(names)
        left, most, level = named.filter(~one), (most + 1) // 2, level + 1
    return done


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """A row per document: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    named = name_documents(docs, id_col=id_col, text_col=text_col, block_bytes=block_bytes, hash_bits=hash_bits)
    first = F.min(F.struct(-F.col("_points"), F.col("_id").isNull(), F.col("_id").alias("id"), F.col("_row").alias("row")))
    groups = staged(named.groupBy("_n", "_name").agg(first.alias("_first"), F.count(F.lit(1)).alias("group_size")), "dedup-groups")
    out = named.join(groups, ["_n", "_name"])
    return out.select(F.col("_id").alias(id_col), F.col("_first.id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_first.row")).alias("kept"), F.col("sha256").alias("text_sha256"))
