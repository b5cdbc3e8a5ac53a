import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuesheet.llm import collocations as c

WORDS = ["new", "york", "times", "ice", "cream", "of", "the", "é", "É", "3", "x y"]


def texts(n=400, seed=2):
    rng = random.Random(seed)
    draw = lambda: " ".join(rng.choices(WORDS, [9, 8, 5, 4, 4, 9, 9, 2, 2, 1, 1], k=rng.randint(1, 12)))
    out = [(i, rng.choice([" ", "\t "]).join([draw() + rng.choice(".,;:!?\n\r\x0b\x0c") for _ in range(rng.randint(1, 4))]), rng.choice(["en", "en", "de", None, "und"])) for i in range(n)]
    out += [(n + k, "New York TIMES. " * 8 + "ice cream", "en") for k in range(9)] + [(900, None, "en"), (901, "", "de"), (902, " ,.\t;", "fr"), (903, "of the " * 20000, "en"), (None, "a b", "xx")]
    return out + out[:3]


def plain(rows, least, top, longest=4, share=80):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(brute.LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        around = defaultdict(int)
        for p, a in cand.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        around[p[i:j]] = max(around[p[i:j]], a)
        rows = []
        for p, a in cand.items():
            if 100 * around[p] < share * a:
                score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "words"), [(3, 2000, 1_000_000), (5, 7, 40)])
def test_collocations_equal_plain_python(spark, monkeypatch, least, top, words):
    """Nulls, empty and long texts, repeated rows, ties, small batches."""
    monkeypatch.setattr(c, "WORDS", words)
    docs = spark.createDataFrame(texts(), "doc_id long, text string, lang string").withColumns({"phrase": F.lit(1), "part": F.lit("x"), "n": F.lit(2)}).repartition(5)
    got = c.collocations(docs, least=least, top=top).collect()
    assert sorted(map(tuple, got)) == plain(texts(), least, top) and len(got) > 10


@pytest.mark.parametrize("n", [1, 2, 3])
def test_filter_holds_all_that_is_frequent(spark, n):
    """What is looked up in a text is found under the hash of the counted phrase."""
    rows = [("en" if i % 2 else "de", " ".join(f"w{i}é{k}" for k in range(n))) for i in range(3000)]
    bitmap = c.frequent(spark.createDataFrame(rows, "lang string, phrase string"))
    words = c._Words(pa.table({"lang": [g for g, _ in rows], "piece": [f"x {p} y" for _, p in rows], "times": [1] * len(rows)}))
    h = word = words.hashes()
    for k in range(1, n):
        h = c._next(h[:-1], word[k:])
    found = c.held(bitmap, h)
    at = np.arange(len(rows)) * (n + 2)
    assert found[at + 1].all() and found[at[:-1]].mean() < 0.1


def test_bitmap_of_few_bits_changes_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(texts(150), "doc_id long, text string, lang string")
    monkeypatch.setattr(c, "SPARSE", 1)
    monkeypatch.setattr(c, "BITS", 1 << 16)
    assert sorted(map(tuple, c.collocations(docs, least=3).collect())) == plain(texts(150), 3, 2000)


def test_counts_past_64_bits(spark):
    """Products of counts near 2^62 are exact: here of a piece that occurs so often."""
    cut = spark.createDataFrame([("en", "a b", 1 << 60), ("en", "a", 1 << 61)], "lang string, piece string, times long")
    one, two = (sorted(map(tuple, x.collect())) for x in c.counts(cut, least=30, longest=2))
    assert one == [("en", "a", (1 << 60) + (1 << 61)), ("en", "b", 1 << 60)] and two == [("en", "a b", 1 << 60)]


def test_empty_table(spark):
    assert c.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
