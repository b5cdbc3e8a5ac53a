"""Benchmark decontamination by a broadcast hash set of test n-grams, with DataFrame functions only.

Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. Every benchmark item gives its windows
of ``n`` consecutive words; an item with fewer words is one window. The set of distinct windows is keyed by an anchor, a
window's rarest word among the benchmark's windows. Training texts are cut into chunks that overlap by n - 1 words; each
token of a chunk is looked up among the anchors, and each hit is verified against the window's words around it. The set is
broadcast after its size has been measured.

Beyond ``BROADCAST_BYTES`` the windows of the training texts are hashed, those whose hash has no bit in a broadcast bitmap of
the benchmark's hashes (2**BITMAP_BITS bits at most) go at once, and only the others meet the benchmark's in a shuffled join.

Null and empty texts have no words and no hits; very long ones are cut into chunks; repeated rows are judged each by itself;
repeated items count each by its id; an item without an id hits words, but is in no list of items; other columns pass through.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import packed, staged, unpacked

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 64 << 20
BITMAP_BITS = 25
#: Words of a chunk.
CHUNK = 512


def ascii_lower(text: Column) -> Column:
    """text with A-Z lower-cased and nothing else changed."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def raw_words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, n: int = 10, *, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: anchor, off (the anchor's place), len, window (words joined by spaces), items; staged."""
    words = benchmark.select(F.col(item_col).cast("string").alias("_item"), raw_words(ascii_lower(F.col(text_col))).alias("_w")).filter(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - (n - 1), F.lit(1)))
    grams = words.select("_item", F.explode(F.transform(starts, lambda i: F.slice("_w", i, n))).alias("_gram"))
    sets = staged(grams.groupBy("_gram").agg(F.array_sort(F.collect_set("_item")).alias("items")), "windows")
    seen = staged(sets.select(F.explode(F.array_distinct("_gram")).alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("_seen")), "window-words")
    small = seen.agg(F.coalesce(F.sum(F.octet_length("anchor") + 48), F.lit(0))).first()[0] <= BROADCAST_BYTES
    seen = F.broadcast(seen) if small else seen.hint("merge")
    places = sets.select("_gram", "items", F.posexplode("_gram").alias("off", "anchor")).join(seen, "anchor")
    rarest = F.min(F.struct("_seen", (-F.length("anchor")).alias("_short"), "anchor", "off")).alias("_x")
    out = places.groupBy("_gram").agg(rarest, F.first("items").alias("items"))
    return staged(out.select(F.col("_x.anchor").alias("anchor"), F.col("_x.off").alias("off"), F.size("_gram").alias("len"), F.array_join("_gram", " ").alias("window"), "items"), "windows-anchored")


def _size(windows: DataFrame) -> int:
    return windows.agg(F.coalesce(F.sum(F.octet_length("anchor") + F.octet_length("window") + F.size("items") * 24 + 64), F.lit(0))).first()[0]


def _chunks(rows: DataFrame, doc: list[str], n: int, last: Column | None = None) -> DataFrame:
    """rows with words _w: doc, _at and the words _w of each chunk; the first chunk gets ``last`` as a word more."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - 1, F.lit(0)), F.lit(CHUNK))

    def chunk(at: Column) -> Column:
        words = F.slice("_w", at + 1, CHUNK + n - 1)
        return F.struct(at.alias("at"), (words if last is None else F.when(at == 0, F.array_append(words, last)).otherwise(words)).alias("w"))

    return rows.select(*doc, F.explode(F.transform(starts, chunk)).alias("_c")).select(*doc, F.col("_c.at").alias("_at"), F.col("_c.w").alias("_w"))


_DOC = ["_row", "_id", "_hash", "_n_words"]


def _hits(docs: DataFrame, windows: DataFrame, n: int) -> DataFrame:
    """Of docs (_id, _text), a row per document: _id, _hash, _n_words, _spans (sorted (start, len) in words), _items."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "_id", F.xxhash64("_text").alias("_hash"), raw_words(F.col("_text")).alias("_w")).withColumn("_n_words", F.size("_w").cast("long"))
    return _broadcast_hits(rows, windows, n) if _size(windows) <= BROADCAST_BYTES else _shuffled_hits(rows, windows, n)


def _items() -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items")


def _broadcast_hits(rows: DataFrame, windows: DataFrame, n: int) -> DataFrame:
    """_hits by a broadcast of the windows, in one pass.

    Each document carries a marker, the empty word, which meets a marker among the windows: so documents without a hit stay.
    """
    marker = rows.sparkSession.range(1).select(F.lit("").alias("anchor"), F.lit(0).alias("off"), F.lit(0).alias("len"), F.lit("").alias("window"), F.array().cast("array<string>").alias("items"))
    tokens = _chunks(rows, _DOC, n, F.lit("")).select(*_DOC, "_at", "_w", F.posexplode("_w").alias("_pos", "_token")).withColumn("anchor", ascii_lower(F.col("_token")))
    met = tokens.join(F.broadcast(windows.unionByName(marker)), "anchor").withColumn("_start", F.col("_pos") - F.col("off"))
    around = F.slice("_w", F.greatest(F.col("_start"), F.lit(0)) + 1, F.col("len"))
    verified = F.col("_start").between(0, CHUNK - 1) & (ascii_lower(F.array_join(around, " ")) == F.col("window"))
    met = met.filter((F.col("len") == 0) | verified)
    span = F.when(F.col("len") > 0, F.struct((F.col("_at") + F.col("_start")).alias("start"), F.col("len")))
    return met.groupBy("_row").agg(*(F.first(c).alias(c) for c in _DOC[1:]), F.sort_array(F.collect_set(span)).alias("_spans"), _items())


def _shuffled_hits(rows: DataFrame, windows: DataFrame, n: int) -> DataFrame:
    """_hits for a benchmark of any size: only windows that the bitmap lets through are shuffled, and no document without any.

    Hits meet the documents by id and hash of the text, so rows that repeat share them.
    """
    set_ = windows.select("window", "len", "items", F.xxhash64("window").alias("_key"))
    # 64 bits of the bitmap a row: some 8 bits a window, up to 2**BITMAP_BITS; 2**19 rows at most
    bits = min(max((8 * windows.count()).bit_length(), 6), BITMAP_BITS)
    word, bit = F.shiftrightunsigned("_key", 64 - bits + 6).alias("_word"), F.shiftrightunsigned("_key", 64 - bits).bitwiseAND(F.lit(63)).cast("int")
    bitmap = staged(set_.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(_key, " + str(64 - bits) + ") & 63 as int))")).alias("_bits")), "window-bits")
    lens = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most n

    doc = ["_id", "_hash"]
    each = _chunks(rows.select(*doc, F.transform("_w", ascii_lower).alias("_w")), doc, n).withColumn("_len", F.explode(F.array(*(F.lit(x) for x in lens))))
    starts = F.sequence(F.lit(0), F.least(F.size("_w") - F.col("_len"), F.lit(CHUNK - 1)))
    each = each.filter(F.size("_w") >= F.col("_len")).select(*doc, "_at", "_len", F.explode(F.transform(starts, lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("_w", i + 1, F.col("_len")), " ").alias("window")))).alias("_g"))
    each = each.select(*doc, (F.col("_at") + F.col("_g.pos")).alias("start"), F.col("_len").alias("len"), F.col("_g.window").alias("window")).withColumn("_key", F.xxhash64("window"))
    maybe = each.withColumn("_word", word).join(F.broadcast(bitmap), "_word").filter(F.bit_get("_bits", bit) == 1)
    met = maybe.select(*doc, "start", "len", "window", "_key").join(set_.hint("merge"), ["_key", "window", "len"])
    found = met.groupBy(*doc).agg(F.sort_array(F.collect_set(F.struct("start", "len"))).alias("_spans"), _items()).select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), "_spans", "_items")
    out = rows.drop("_w").join(found, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")), "left")
    none = F.array().cast("array<struct<start:int,len:int>>"), F.array().cast("array<string>")
    return out.select(*_DOC, F.coalesce("_spans", none[0]).alias("_spans"), F.coalesce("_items", none[1]).alias("_items"))


def _covered() -> Column:
    """Words inside any of the sorted _spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, s: Column) -> Column:
        end = s["start"] + s["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(end - F.greatest(acc["end"], s["start"]), F.lit(0))).alias("n"))

    return F.aggregate("_spans", start, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """A row per document: id, n_words, n_hit, n_items, items (sorted as strings), spans (start and length in words), contaminated."""
    found = _found(docs, benchmark, n, id_col, text_col, item_col)
    return found.select(F.col("_id").alias(id_col), F.col("_n_words").alias("n_words"), _covered().alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.col("_items").alias("items"), F.col("_spans").alias("spans"), (F.size("_spans") > 0).alias("contaminated"))


def _found(docs: DataFrame, benchmark: DataFrame, n: int, id_col: str, text_col: str, item_col: str) -> DataFrame:
    windows = benchmark_windows(benchmark, n, item_col=item_col, text_col=text_col)
    return _hits(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), windows, n)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, *, remove: str = "document", id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """docs without contaminated documents, or (remove="span") without the words hit, each with what stands before the next word.

    Verdicts meet their documents by id and text, so rows that repeat share one.
    """
    hit = _found(docs, benchmark, n, id_col, text_col, item_col).filter(F.size("_spans") > 0)
    hit = staged(hit.groupBy("_id", "_hash").agg(F.first("_spans").alias("_spans")), "hits")
    size = hit.agg(F.coalesce(F.sum(F.size("_spans") * 8 + 48), F.lit(0))).first()[0]
    hit = F.broadcast(hit) if size <= BROADCAST_BYTES else hit.hint("merge")
    rows = packed(docs, _key=F.col(id_col), _text_hash=F.xxhash64(text_col))
    on = F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    if remove == "document":
        return unpacked(rows.join(hit, on, "left_anti"), docs)
    if remove != "span":
        raise ValueError(f"remove: document or span, not {remove!r}")
    out = rows.join(hit, on, "left")
    text = F.col("_doc").getField(text_col)
    words, between = raw_words(text), F.split(text, WORD)
    covered = lambda i: F.exists("_spans", lambda s: (i >= s["start"]) & (i < s["start"] + s["len"]))
    kept = F.transform(words, lambda w, i: F.when(covered(i), F.lit("")).otherwise(F.concat(w, F.get(between, i + 1))))
    return unpacked(out, docs, **{text_col: F.when(F.col("_spans").isNull(), text).otherwise(F.concat(F.get(between, F.lit(0)), F.array_join(kept, "")))})
