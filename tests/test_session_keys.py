import functools

from pyspark.sql import functions as F

from cuesheet.functions import text


def plain(raw):
    units = raw.encode("utf-16-be")
    return functools.reduce(lambda h, i: (h * 33 & 0xFFFFFFFF) ^ int.from_bytes(units[i : i + 2], "big"), range(0, len(units), 2), 5381)


def test_hashes_of_texts_of_any_length():
    texts = ["", "a", "ab", "三元😀", None, "x" * 3000, "zz", "b"]
    assert text._hash(texts).tolist() == [plain(t or "") for t in texts]
    assert text._hash([]).tolist() == []


def test_a_key_walks_no_array_of_units(spark):
    rows = spark.createDataFrame([(1, [("a😀.mp4", 70, 3), ("b.mp4", 1, None)]), (2, None)], "id int, files array<struct<name:string,size:long,modified:long>>")
    keyed = rows.select("id", text.session_key(F.col("files")).alias("key"))
    got = {r["id"]: r["key"] for r in keyed.collect()}
    base = lambda n: base(n // 36) + "0123456789abcdefghijklmnopqrstuvwxyz"[n % 36] if n else ""
    assert got[1] == f"sk_{base(plain('a😀.mp4|70|3#b.mp4|1|0'))}_2_70"
    assert "aggregate(" not in keyed._jdf.queryExecution().optimizedPlan().toString()
