import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cuesheet.functions import text, vectors
from cuesheet.operators import retrieval as r
from cuesheet.operators.tenancy import Catalog, Context, scoped_session

SCHEMA = "segment_index int, tenant_id string, video_id string, text_content string, embedding array<float>"


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / n if n else 0.0


def naive(segments, q, grams, k, pool, gate):
    """Both candidate lists, merged by id, as lists and loops."""
    rows = [(cosine(s[4], q), sum(g in (s[3] or "").lower() for g in grams), s[0]) for s in segments if s[4]]
    by_score = sorted(rows, key=lambda x: (-x[0], x[2]))
    chosen = {x[2]: x for x in [x for x in by_score if x[1]][:pool]}
    for x in by_score[:pool]:
        chosen.setdefault(x[2], x)
    scored = [(min(1, max(0, c) + (0.1 * min(1, m / len(grams)) if grams else 0)), i) for c, m, i in chosen.values()]
    ranked = sorted([x for x in scored if x[0] >= 0.4], key=lambda x: (-x[0], x[1]))
    limit = k if not gate or (ranked and ranked[0][0] >= 0.6) else min(3, k)
    return [(i, round(s, 6)) for s, i in ranked[:limit]]


@pytest.mark.parametrize("seed", range(4))
def test_hybrid_equals_lists(spark, seed):
    rng = random.Random(seed)
    words = ["java", "javascript", "lock", "redis", "map", "c++"]
    vec = lambda: [rng.uniform(-0.2, 1) for _ in range(4)]
    segments = [(i, "t", "v", " ".join(rng.sample(words, 3)) if i % 7 else None, vec() if i % 11 else None) for i in range(60)]
    queries = [(k, vec(), q) for k, q in enumerate(["Java lock", "no such", "", "C++ map"])]
    asked = r.with_grams(spark.createDataFrame(queries, "query_id int, query_vec array<double>, query string"))
    pairs = r.scored(spark.createDataFrame(segments, SCHEMA), asked)
    grams = {x["query_id"]: x["grams"] for x in asked.collect()}
    for gate, df in ((True, r.gated(pairs, 5, 8)), (False, r.raw_ranking(pairs, 5, 8))):
        got = {}
        for x in sorted(df.collect(), key=lambda x: (x["query_id"], x["rank"])):
            got.setdefault(x["query_id"], []).append((x["segment_index"], round(x["relevance"], 6)))
        for k, q, _ in queries:
            seg32 = [(*s[:4], [float(F32(x)) for x in s[4]] if s[4] else None) for s in segments]
            assert got.get(k, []) == naive(seg32, q, grams[k], 5, 8, gate)


def F32(x):
    import numpy as np

    return np.float32(x)


def test_mode_without_grams(spark):
    asked = spark.createDataFrame([(1, [1.0], "java")], "query_id int, query_vec array<double>, query string")
    assert r.with_grams(asked, "vector").first()["grams"] == []


def test_cosine_cases(spark):
    rows = [(1, [1.0, 0.0], [1.0, 0.0]), (2, [1.0, 0.0], [-1.0, 0.0]), (3, [0.0, 0.0], [1.0, 0.0]), (4, None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, a array<float>, b array<float>")
    assert [x[0] for x in df.orderBy("id").select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, -1.0, 0.0, None]
    with pytest.raises(PySparkException):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>").select(vectors.cosine(F.col("a"), F.col("b"))).collect()


def test_vector_text(spark):
    df = spark.createDataFrame([("[0.5,1]",), ("[]",), (None,)], "t string").select(vectors.parse_vector(F.col("t")).alias("v"))
    assert [x[0] for x in df.collect()] == [[0.5, 1.0], None, None]
    assert df.select(vectors.print_vector("v" and F.col("v"))).first()[0] == "[0.5,1.0]"


def test_gate_bounds(spark):
    def run(best, top_k=5):
        rows = [(1, i, s, 0, 0) for i, s in enumerate([best, 0.5, 0.45, 0.42, 0.41])]
        df = spark.createDataFrame(rows, "query_id int, segment_index int, score double, matched int, n_grams int")
        return [(x["segment_index"], x["low_confidence"]) for x in sorted(r.gated(df, top_k).collect(), key=lambda x: x["rank"])]

    assert run(0.60) == [(0, False), (1, True), (2, True), (3, True), (4, True)]
    assert run(0.5999) == [(0, True), (1, True), (2, True)]
    assert run(0.5999, 1) == [(0, True)]
    low = spark.createDataFrame([(1, 0, 0.39, 0, 0)], "query_id int, segment_index int, score double, matched int, n_grams int")
    assert r.gated(low).count() == 0


def test_tenants(spark):
    c = Catalog({"seg": spark.createDataFrame([("a", 1), ("b", 2)], "tenant_id string, x int"), "tenant": spark.createDataFrame([("a",)], "id string")})
    seen = lambda *a, **b: sorted(x["x"] for x in c.table("seg", Context(*a, **b)).collect())
    assert seen("a") == [1] and seen() == [] and seen("") == [] and seen(system=True) == [1, 2]
    assert c.table("tenant", Context()).count() == 1


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.asr_clean(F.lit(" <|NOISE|>a \n b<|Speech|> "))) == "a b<|Speech|>"
    assert one(text.safe_filename(F.lit("/x/课 程?.mp4"))) == "课_程_.mp4" and one(text.safe_filename(F.lit("  "))) == "video.mp4"
    assert one(text.clock(F.lit(3725.4))) == "1:02:05" and one(text.clock(F.lit(-3))) == "00:00" and one(text.clock(F.lit(59.6))) == "01:00"
    assert one(text.pair_key(F.lit("b"), F.lit("a"))) == one(text.pair_key(F.lit("a"), F.lit("b")))
    assert one(text.stem_similarity(F.lit("abc.mp4"), F.lit("abd.m4a"))) == pytest.approx(2 / 3)
    assert one(text.part_count(F.lit(130), F.lit(64))) == 3 and one(text.last_part_size(F.lit(130), F.lit(64))) == 2
    assert one(text.snippet(F.lit("x" * 20))) == "x" * 18 + "…" and one(text.clean_title(F.lit(' "a"\n '))) == "a"


def test_queries_go_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(3)]
    segments = spark.createDataFrame([(i, "t", "v", rng.choice(["java lock", "redis", None]), vec()) for i in range(20)], SCHEMA)
    asked = r.with_grams(spark.createDataFrame([(k, vec(), "Java redis") for k in range(9)], "query_id int, query_vec array<double>, query string"))
    want = sorted(map(str, r.scored(segments, asked).collect()))
    monkeypatch.setattr(r, "QUERIES_BYTES", 300)
    assert len(r._blocks(asked)) > 3
    assert sorted(map(str, r.scored(segments, asked).collect())) == want and len(want) == 180


def test_a_tenants_session_sees_no_other_rows(spark):
    rows = lambda own: own.createDataFrame([("a", 1), ("b", 2), (None, 3)], "tenant_id string, x int")
    tables = {"seg": rows, "tenant": lambda own: own.createDataFrame([("a",), ("b",)], "id string")}
    seen = lambda context: scoped_session(spark, tables, context)
    text = "SELECT (SELECT count(*) FROM seg) AS n, (SELECT sum(s.x) FROM seg s CROSS JOIN seg t) AS x, (SELECT count(*) FROM tenant) AS t"
    assert [tuple(seen(c).sql(text).first()) for c in (Context("a"), Context(), Context(system=True))] == [(1, 1, 2), (0, None, 2), (3, 18, 2)]
    assert seen(Context("b")).table("seg").count() == 1
    assert not spark.catalog.tableExists("seg")
