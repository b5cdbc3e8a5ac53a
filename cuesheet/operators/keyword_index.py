"""Inverted index of text for search grams, in place of looking into each text.

A gram lies within one run of the characters that grams consist of, a word. So two small tables answer it: postings (word, segment), each
pair once, and pieces (piece, word), the substrings of one to three characters of each distinct word. A gram of up to three
characters is a piece itself; of a longer one all trigrams are looked up, words that hold them all are candidates, and these are
verified on the word. Texts are read once, to make the postings; a search moves grams, words and postings only.

What holds a gram is kept as bits of 64 neighbouring ids, so that texts that hold it by several words are told apart by "or", and common
grams have a row for 64 texts. Postings are counted first and dealt into as many tasks as that asks for, so a task's share does not grow.

Null and empty texts have no postings. Grams that no text holds have no rows. A gram counts once a query, whatever its case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Postings that a task joins with grams, in the mean.
POSTINGS = 1 << 18
WORD_END = "[^a-z0-9+#.一-鿿]+"


def postings(segments: DataFrame, *, id_col: str = "segment_index", text_col: str = "text_content") -> DataFrame:
    """(word, id_col): each word of each segment once."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), WORD_END))
    return segments.select(F.col(id_col), F.explode(words).alias("word")).filter("word <> ''").select("word", id_col)


def _substrings(text: Column, n: int) -> Column:
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(text, i, F.lit(n)))


def pieces(posted: DataFrame) -> DataFrame:
    """(piece, word) of the distinct words of postings."""
    word = F.col("word")
    every = F.array_distinct(F.concat(*(_substrings(word, n) for n in (1, 2, 3))))
    return posted.select("word").distinct().select(F.explode(every).alias("piece"), "word")


def words_with(grams: DataFrame, pieced: DataFrame) -> DataFrame:
    """(gram, word) of grams (gram): all words that hold the gram."""
    low = grams.select(F.lower("gram").alias("gram")).filter("gram <> ''").distinct()
    asked = F.when(F.length("gram") <= 3, F.array("gram")).otherwise(F.array_distinct(_substrings(F.col("gram"), 3)))
    wanted = low.withColumn("_pieces", asked).select("gram", F.size("_pieces").alias("_all"), F.explode("_pieces").alias("piece"))
    both = wanted.join(pieced, "piece").groupBy("gram", "word").agg(F.count(F.lit(1)).alias("_n"), F.first("_all").alias("_all"))
    return both.filter((F.col("_n") == F.col("_all")) & F.contains(F.col("word"), F.col("gram"))).select("gram", "word")


def _holders(grams: DataFrame, posted: DataFrame, pieced: DataFrame, id_col: str) -> DataFrame:
    """(gram, at, bits): ids that hold the gram, as bits of the 64 from 64 * at on; ids that are no integers have a row each, at themselves."""
    whole = isinstance(posted.schema[id_col].dataType, T.IntegralType)
    number = F.col(id_col).cast("long") if whole else None
    at = F.shiftright(number, 6) if whole else F.col(id_col)
    bits = F.call_function("shiftleft", F.lit(1).cast("long"), F.coalesce(number.bitwiseAND(F.lit(63)), F.lit(0)).cast("int")) if whole else F.lit(1).cast("long")
    n = max(1, -(-posted.count() // POSTINGS))
    found = posted.repartition(n, "word").join(words_with(grams, pieced).repartition(n, "word"), "word")  # in this order a word's grams are held beside its postings
    return found.groupBy("gram", at.alias("at")).agg(F.bit_or(bits).alias("bits"))


def matches(queries: DataFrame, posted: DataFrame, pieced: DataFrame, *, id_col: str = "segment_index") -> DataFrame:
    """(query_id, id_col, matched, n_grams) of queries (query_id, grams): segments that hold at least one gram, and how many."""
    asked = queries.select("query_id", F.size("grams").alias("n_grams"), F.explode(F.array_distinct("grams")).alias("_gram")).withColumn("gram", F.lower("_gram"))
    held = _holders(asked.select("gram"), posted, pieced, id_col)
    both = asked.join(held, "gram").groupBy("query_id", "at").agg(F.collect_list("bits").alias("_bits"), F.bit_or("bits").alias("_any"), F.first("n_grams").alias("n_grams"))
    bit = lambda x, i: F.getbit(x, i).cast("long")
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("_any", i) == 1)
    counts = F.transform(places, lambda i: F.struct(i.alias("_i"), F.aggregate("_bits", F.lit(0).cast("long"), lambda n, x: n + bit(x, i)).alias("matched")))
    kind = posted.schema[id_col].dataType
    number = (F.shiftleft("at", 6) + F.col("_i")).cast(kind) if isinstance(kind, T.IntegralType) else F.col("at")
    return both.select("query_id", "at", "n_grams", F.inline(counts)).select("query_id", number.alias(id_col), "matched", "n_grams")


def gram_counts(queries: DataFrame, posted: DataFrame, pieced: DataFrame, *, id_col: str = "segment_index") -> DataFrame:
    """(gram, n): in how many segments each gram of queries is found, none too."""
    grams = queries.select(F.explode("grams").alias("gram")).select(F.lower("gram").alias("gram")).distinct()
    held = _holders(grams, posted, pieced, id_col).groupBy("gram").agg(F.sum(F.bit_count("bits").cast("long")).alias("n"))
    return grams.join(held, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
