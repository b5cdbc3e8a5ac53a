import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheet.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, _row string, _vector string, code string, error string"


def plain(rows, parts, entries, rounds, scale=1024):
    """{(id, vector): (code, error)} and the codebooks, in plain integers."""
    kept = [(i, v, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        put = [{} for _ in range(parts)]
        for _, _, v in kept:
            for p in range(parts):
                put[p].setdefault(near(v, p)[1], []).append(cut(v, p))
        books = [[[sum(x) // len(put[p][e]) for x in zip(*put[p][e])] if e in put[p] else c for e, c in enumerate(books[p])] for p in range(parts)]
    return {(i, tuple(v)): (bytes(near(x, p)[1] for p in range(parts)), sum(near(x, p)[0] for p in range(parts))) for i, v, x in kept}, books


def rows(n, size=8, seed=3):
    rng = random.Random(seed)
    f = lambda x: float(np.float32(x))
    out = [(i, [f(rng.gauss(0, 1)) for _ in range(size)]) for i in range(n)]
    out += [out[0], (1, out[2][1]), (n + 1, out[3][1]), (None, out[4][1]), (n + 2, None), (n + 3, [None] + out[0][1][1:]), (n + 4, [float("nan")] + out[0][1][1:]), (n + 5, [float("inf")] + out[0][1][1:]), (n + 6, [f(-1e-5)] * size)]
    return out


@pytest.mark.parametrize(("n", "entries"), [(60, 16), (5, 256), (300, 256)])
def test_codes_equal_plain_integers(spark, n, entries):
    """Nulls, undefined components, repeated ids, fewer vectors than entries, columns of clashing names."""
    given = rows(n)
    table = spark.createDataFrame([(i, v, k % 3 if k % 5 else None, "r", "v", "c", "e") for k, (i, v) in enumerate(given)], SCHEMA).repartition(3)
    books = vector_codes.train(table, id_col="vec_id", vector_col="embedding", entries=entries)
    want, plain_books = plain(given, 4, entries, 4)
    assert books.entries.tolist() == plain_books
    assert books.sha256() == hashlib.sha256(",".join(str(x) for p in plain_books for e in p for x in e).encode()).hexdigest()
    coded = vector_codes.encode(table, books, vector_col="embedding", code_col="_code", error_col="_error")
    assert coded.columns == ["vec_id", "label", "_row", "_vector", "code", "error", "_code", "_error"]
    got = vector_codes.group_errors(coded, "label", "_error", out_col="total").collect()
    assert sorted((bytes(r["_code"]), r["_error"]) for r in got) == sorted(want[i, tuple(v)] for i, v in given if (i, tuple(v or ())) in want)
    sums = {}
    for r in got:
        sums[r["label"]] = sums.get(r["label"], 0) + r["_error"]
    assert all(r["total"] == sums[r["label"]] for r in got) and None in sums


def test_sums_by_a_shuffle_are_the_same(spark):
    table = spark.createDataFrame(rows(40), "vec_id long, embedding array<float>")
    books = vector_codes.train(table, id_col="vec_id", vector_col="embedding", entries=8)
    coded = vector_codes.encode(table, books, vector_col="embedding").withColumn("label", F.col("vec_id") % 3)
    one, other = (sorted(map(str, vector_codes.group_errors(coded, "label", most=m).collect())) for m in (10, 0))
    assert one == other


def test_decoded_vector_is_near(spark):
    table = spark.createDataFrame(rows(300), "vec_id long, embedding array<float>")
    books = vector_codes.train(table, id_col="vec_id", vector_col="embedding")
    r = vector_codes.encode(table, books, vector_col="embedding").filter("vec_id = 7").first()
    v = dict(rows(300))[7]
    assert abs(((books.decode(bytes(r["code"])) - np.floor(np.array(v) * 1024) / 1024) ** 2).sum() * 1024**2 - r["error"]) < 1e-3


def test_empty_and_odd_tables(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    for table in (none, none.limit(0)):
        assert vector_codes.train(table, id_col="vec_id", vector_col="embedding") is None
        assert vector_codes.encode(table, None, vector_col="embedding").collect() == []
    for bad in ([(1, [1.0, 2.0, 3.0, 4.0]), (2, [1.0] * 8)], [(1, [1.0] * 6)], [(1, [3e38] * 4)]):
        with pytest.raises(Exception, match="vectors of size|squared distances"):
            vector_codes.train(spark.createDataFrame(bad, "vec_id long, embedding array<float>"), id_col="vec_id", vector_col="embedding")
