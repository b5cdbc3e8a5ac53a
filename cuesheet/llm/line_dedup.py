"""Site-relative line frequency, with DataFrame functions only.

A line is boilerplate on a host if more than ``ratio`` of the host's pages hold it. ``min_pages`` protects only hosts of a few
pages, where one page or two are more than the ratio already. Lines are
first counted by hash (hashes that collide only add to a count, so no line is missed); those that may pass are counted
again by text. What remains, a list of lines for each host, has at most (lines per page / ratio) entries a host.

Null text counts as a page without lines and stays null; empty text is a page with a blank line; very long texts are split
whole within their row; blank lines are never dropped; a null host is a host of its own;
repeated rows are pages of their own; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import packed, spare_name, staged, unpacked

#: Lists of lines larger than this, all together, are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _joined(docs: DataFrame, lists: DataFrame, size: int) -> DataFrame:
    """docs with their host's list; a broadcast only below the limit."""
    lists = F.broadcast(lists) if size <= BROADCAST_BYTES else lists.hint("merge")
    return docs.join(lists, F.col("_host").eqNullSafe(F.col("_list_host")), "left").drop("_list_host")


def boilerplate_lines(docs: DataFrame, ratio: float = 0.1, min_pages: int = 3, *, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Rows (_host, line, pages, host_pages) of the boilerplate; staged."""
    slim = docs.select(F.col(host_col).cast("string").alias("_host"), F.col(text_col).alias("_text"))
    pages = slim.groupBy("_host").agg(F.count(F.lit(1)).alias("host_pages"))
    enough = lambda counts: counts.join(pages.withColumnRenamed("_host", "_h"), F.col("_host").eqNullSafe(F.col("_h"))).drop("_h").filter((F.col("pages") >= min_pages) & (F.col("pages") > F.col("host_pages") * ratio))

    line = slim.select("_host", F.explode(F.array_distinct(_lines(F.col("_text")))).alias("line")).filter(F.trim("line") != "")
    hashes = staged(enough(line.select("_host", F.xxhash64("line").alias("_hash")).groupBy("_host", "_hash").agg(F.count(F.lit(1)).alias("pages"))), "line-hashes")
    lists = hashes.groupBy(F.col("_host").alias("_list_host")).agg(F.collect_list("_hash").alias("_hashes"))
    maybe = _joined(slim, lists, 8 * hashes.count()).filter("_hashes is not null")
    line = maybe.select("_host", "_hashes", F.explode(F.array_distinct(_lines(F.col("_text")))).alias("line")).filter((F.trim("line") != "") & F.array_contains("_hashes", F.xxhash64("line")))
    return staged(enough(line.groupBy("_host", "line").agg(F.count(F.lit(1)).alias("pages"))), "lines")


def drop_boilerplate(docs: DataFrame, ratio: float = 0.1, min_pages: int = 3, *, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """docs without boilerplate lines, with ``n_lines`` and ``n_removed`` added (with underscores behind them if docs has such columns)."""
    lines = boilerplate_lines(docs, ratio, min_pages, text_col=text_col, host_col=host_col)
    lists = lines.groupBy(F.col("_host").alias("_list_host")).agg(F.collect_list("line").alias("_drop"))
    size = lines.agg(F.coalesce(F.sum(F.octet_length("line") + 16), F.lit(0))).first()[0]
    out = _joined(packed(docs, _host=F.col(host_col).cast("string")), lists, size)
    text = F.col("_doc").getField(text_col)
    split = _lines(text)
    out = out.withColumn("_kept", F.when(F.col("_drop").isNull(), split).otherwise(F.filter(split, lambda x: ~F.array_contains(F.col("_drop"), x))))
    filled = lambda xs: F.when(text.isNull(), 0).otherwise(F.size(F.filter(xs, lambda x: F.trim(x) != ""))).cast("long")
    out = out.withColumns({"_n": filled(split), "_left": filled(F.col("_kept"))})
    kept = F.when(F.col("_drop").isNull(), text).otherwise(F.array_join("_kept", "\n"))
    return unpacked(out, docs, **{text_col: kept, spare_name(docs, "n_lines"): F.col("_n"), spare_name(docs, "n_removed"): F.col("_n") - F.col("_left")})
