"""Text columns: search grams, cleaning, names and times."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "[一-鿿]"


def search_grams(query: Column) -> Column:
    """Distinct Latin words (lower case, may hold digits and + # .) and overlapping pairs of CJK characters."""
    words = F.transform(F.regexp_extract_all(query, F.lit("[A-Za-z][A-Za-z0-9+#.]*"), F.lit(0)), F.lower)
    pairs = F.regexp_extract_all(query, F.lit(f"(?=({CJK}{{2}}))"), F.lit(1))  # one at each place, so they overlap; linear in the text
    return F.array_union(F.coalesce(words, F.array().cast("array<string>")), F.coalesce(pairs, F.array().cast("array<string>")))


def matched_grams(text: Column, grams: Column) -> Column:
    """How many grams the text holds, whatever their case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(grams, lambda g: F.contains(low, F.lower(g))))


def contains_any(text: Column, grams: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(grams, lambda g: F.contains(low, F.lower(g)))


def asr_clean(text: Column) -> Column:
    """Without <|MARKS|> of capitals, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<\|[A-Z_]+\|>", ""), r"\s+", " "))


def fold_consonants(word: Column) -> Column:
    """Neighbouring equal consonants become one (y counts as a vowel)."""
    return F.regexp_replace(word, r"([^aeiouy])\1+", "$1")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(longer, F.lit(1)))


def snippet(text: Column, n: int = 18) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit("…")))


def clean_title(title: Column, most: int = 50) -> Column:
    """One line without quotes, of at most ``most`` characters; null if nothing is left."""
    bare = F.trim(F.regexp_replace(title, "[\\r\\n\"'“”‘’《》]", ""))
    return F.when(F.length(bare) > 0, F.substring(bare, 1, most))


def safe_filename(name: Column) -> Column:
    """The base name with anything odd replaced; blank names become video.mp4."""
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/\\]*)$", 1)
    safe = F.regexp_replace(base, "[^a-zA-Z0-9._\\-一-龥]", "_")
    return F.when(F.trim(base) == "", F.lit("video.mp4")).otherwise(safe)


def extension(name: Column) -> Column:
    """The lower-case extension with its dot, or empty."""
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"(\.[^./\\]+)$", 1))


def media_type(name: Column) -> Column:
    kinds = {".mp4": "video/mp4", ".mkv": "video/x-matroska", ".mov": "video/quicktime", ".webm": "video/webm", ".avi": "video/x-msvideo"}
    out = F.lit("application/octet-stream")
    for end, kind in kinds.items():
        out = F.when(extension(name) == end, kind).otherwise(out)
    return out


def pair_key(a: Column, b: Column) -> Column:
    """The same for (a, b) and (b, a)."""
    return F.md5(F.concat_ws(":", F.least(a, b), F.greatest(a, b)))


def id_tail(name: Column, n: int = 8) -> Column:
    return F.when(F.length(name) <= n, name).otherwise(F.substring(name, -n, n))


def clock(seconds: Column) -> Column:
    """mm:ss, or h:mm:ss from an hour on; rounded, not below zero."""
    s = F.greatest(F.round(seconds), F.lit(0)).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    minutes = F.floor(s / 60) % 60
    return F.when(s >= 3600, F.concat_ws(":", F.floor(s / 3600).cast("string"), two(minutes), two(s % 60))).otherwise(F.concat_ws(":", two(minutes), two(s % 60)))


def stem_similarity(a: Column, b: Column) -> Column:
    """Length of the common beginning of two file stems (lower case) over the longer length."""
    x, y = (F.lower(F.regexp_replace(n, r"\.[^./\\]+$", "")) for n in (a, b))
    shorter, longer = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    places = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>"))
    common = F.size(F.filter(places, lambda i: F.substring(x, F.lit(1), i) == F.substring(y, F.lit(1), i)))
    return F.when(longer == 0, 0.0).otherwise(common / F.greatest(longer, F.lit(1)))


def drift(a: Column, b: Column) -> Column:
    """|a - b| over the larger; null if neither is positive."""
    most = F.greatest(a, b)
    return F.when(most > 0, F.abs(a - b) / most)


def part_count(size: Column, part: Column) -> Column:
    return F.ceil(size / part)


def last_part_size(size: Column, part: Column) -> Column:
    return size - (part_count(size, part) - 1) * part


#: What keys of upload sessions, names of users and ids of upload tasks look like.
SESSION_KEY, USERNAME, UPLOAD_TASK = "^[A-Za-z0-9_-]{8,64}$", "^[A-Za-z0-9_.-]{3,32}$", "^up_[A-Za-z0-9]{8,32}$"


def valid(text: Column, pattern: str) -> Column:
    """Whether the whole text fits; null does not."""
    return F.coalesce(text.rlike(pattern.replace("$", r"\z")), F.lit(False))


def _hash(texts: Iterable[str | None]) -> np.ndarray:
    """The hash of session_key of each text; all texts go on by one unit at a time, the longest first, so memory goes with their size."""
    units = [np.frombuffer((t or "").encode("utf-16-le", "surrogatepass"), "<u2") for t in texts]
    lengths = np.array([len(u) for u in units], np.int64)
    order = np.argsort(-lengths, kind="stable")
    flat, starts = np.concatenate([*units, np.empty(0, "<u2")]).astype(np.int64), (np.cumsum(lengths) - lengths)[order]
    h = np.full(len(units), 5381, np.int64)
    going = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")  # how many are longer than each place
    for j, n in enumerate(going):
        h[:n] = (h[:n] * 33 & 0xFFFFFFFF) ^ flat[starts[:n] + j]
    out = np.empty_like(h)
    out[order] = h
    return out


def _hashed(text: Column) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(_hash(texts)).where(texts.notna().to_numpy()).astype("Int64")

    return run(text)


def session_key(files: Column) -> Column:
    """The key of an upload session of files (array<struct<name, size, modified>>): a hash in base 36, their number, the first size modulo 100000.

    The hash starts at 5381; for each UTF-16 unit of "name|size|modified#..." it is multiplied by 33 and xor-ed, modulo 2**32.
    """
    raw = F.array_join(F.transform(files, lambda f: F.concat_ws("|", f["name"], f["size"].cast("string"), F.coalesce(f["modified"], F.lit(0)).cast("string"))), "#")
    value = _hashed(raw)
    return F.concat_ws("_", F.lit("sk"), F.lower(F.conv(value.cast("string"), 10, 36)), F.size(files).cast("string"), (F.element_at(files, 1)["size"] % 100000).cast("string"))


#: Characters of a text from which a title is made.
TITLE_INPUT = 800


def chapter_title(text: Column, most: int = 50) -> Column:
    """A title from the first sentence of a text's beginning; it stands where a model's answer would, and is cleaned like one."""
    return clean_title(F.regexp_extract(F.substring(F.trim(text), 1, TITLE_INPUT), r"^[^。！？!?.；;\r\n]*", 0), most)
