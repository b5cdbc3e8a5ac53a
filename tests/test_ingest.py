import datetime as dt
import random

from pyspark.sql import functions as F

from cuesheet.operators import ingest as i
from cuesheet.plans import segmentations
from cuesheet.sources import tables
from cuesheet.streaming import progress as p


def test_upsert_keeps_first_tenant(spark):
    schema = "video_id string, chunk_index int, tenant_id string, text string"
    old = spark.createDataFrame([("a", 1, "t", "x"), ("a", 2, "t", None)], schema)
    new = spark.createDataFrame([("a", 2, "u", "y"), ("b", 1, "u", "z")], schema)
    out = i.upsert(old, new, ["video_id", "chunk_index"], ["tenant_id"])
    assert sorted(map(tuple, out.collect())) == [("a", 1, "t", "x"), ("a", 2, "t", "y"), ("b", 1, "u", "z")]
    assert sorted(map(tuple, i.upsert(out, new, ["video_id", "chunk_index"], ["tenant_id"]).collect())) == sorted(map(tuple, out.collect()))


def test_upsert_of_two_new_rows(spark):
    schema = "k int, n int, text string, at timestamp"
    old = spark.createDataFrame([(1, 0, "x", dt.datetime(2020, 1, 1)), (2, 0, "y", dt.datetime(2020, 1, 1))], schema)
    new = spark.createDataFrame([(1, 7, "a", None), (1, 9, "b", None), (1, 8, "c", None)], schema)
    got = {r["k"]: r for r in i.upsert(old, new, ["k"], [], order="n", stamp="at").collect()}
    assert got[1]["text"] == "b" and got[1]["at"].year > 2023 and got[2]["at"].year == 2020
    assert i.upsert(old, new, ["k"], []).filter("k = 1").first()["text"] == i.upsert(old, new.orderBy("n"), ["k"], []).filter("k = 1").first()["text"]


def test_latest_table_rewrites_touched_parts_and_forgets(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp, task long, stage string, value double"
    batches = [[(k, start, k, "a", 0.0) for k in range(40)], [(90, start + dt.timedelta(hours=30), 3, "b", 1.0)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = p.event_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    q = p.run_into_latest(stream, str(tmp_path / "t"), str(tmp_path / "c"), kept="24 hours", parts=8)
    assert q.lastProgress["batchId"] == 1
    assert len(list((tmp_path / "t" / "v0").glob("part=*"))) == 8 and len(list((tmp_path / "t" / "v1").glob("part=*"))) == 1
    rows = {r["task"]: r["stage"] for r in p.latest_table(spark, str(tmp_path / "t"), 1).collect()}
    assert rows[3] == "b" and 25 < len(rows) < 40  # the others of that part were older than a day


def test_missing_parts(spark):
    parts = spark.createDataFrame([("u", 1), ("u", 3), ("u", 3)], "upload_id string, part int")
    totals = spark.createDataFrame([("u", 3), ("w", 2), ("e", 0)], "upload_id string, total int")
    got = {r["upload_id"]: (r["received"], r["missing"], r["complete"]) for r in i.missing_parts(parts, totals).collect()}
    assert got == {"u": (2, [2], False), "w": (0, [1, 2], False), "e": (0, [], True)}


def test_library_keeps_empty(spark):
    videos = spark.createDataFrame([("a",), ("b",)], "video_id string")
    sk = spark.createDataFrame([("a", 2, 5.0, 6.0, "y"), ("a", 1, 0.0, 5.0, "x")], "video_id string, segment_index int, start_time double, end_time double, chapter_title string")
    got = {r["video_id"]: (r["segment_count"], [c["chapter_title"] for c in r["chapters"]]) for r in i.library(videos, sk).collect()}
    assert got == {"a": (2, ["x", "y"]), "b": (0, [])}


def test_reuse_bounds(spark):
    plan = spark.createDataFrame([("v", k, 10.0, 20.0) for k in range(4)], "video_id string, chunk_index int, start double, end double")
    old = spark.createDataFrame([("v", 0, 10.04, 19.96, "t"), ("v", 1, 10.06, 20.0, "t"), ("v", 2, 10.0, 20.0, "  ")], "video_id string, chunk_index int, start double, end double, text string")
    assert [(r["reused"], r["text"]) for r in i.reusable_chunks(plan, old).orderBy("chunk_index").collect()] == [(True, "t"), (False, None), (False, None), (False, None)]


def test_routes(spark):
    rows = [(None, False, False), (3, False, True), (3, True, True), (0, True, True), (1, True, False), (2, True, True)]
    got = spark.createDataFrame(rows, "status int, has_source boolean, orphan boolean").select(i.upload_route()).collect()
    assert [r[0] for r in got] == ["new", "refinalise", "retry", "orphan", "duplicate", "duplicate"]


def test_tracks():
    v, a = (True, False), (False, True)
    assert i.matched_tracks([("x.m4s", 100.0, *v), ("y.m4s", 100.0, *a), ("x1.m4s", 100.0, *a)]) == [(0, 2, 0.0)]
    assert i.matched_tracks([("p", 100.0, *v), ("q", 80.0, *a)]) == []
    assert i.matched_tracks([("p", 100.0, *v), ("q", 110.0, *v), ("s", 105.0, *a)])[0][0] == 1
    assert i.matched_tracks([("p", 0.0, *v), ("s", 0.0, *a)]) == []


def test_pair_tracks(spark):
    rows = [(1, 0, "a.m4s", 50.0, True, False, None), (1, 1, "b.m4s", 50.0, False, True, None), (1, 2, "c.m4s", 50.0, False, True, "bad"), (2, 0, "d", 9.0, True, False, None)]
    out = i.pair_tracks(spark.createDataFrame(rows, "batch_id int, place int, name string, duration double, has_video boolean, has_audio boolean, error string"))
    assert [tuple(r) for r in out.collect()] == [(1, "a.m4s", "b.m4s", 0.0)]


def test_interrupted(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    videos = spark.createDataFrame([("a", 1, t(0)), ("b", 1, t(0)), ("c", 2, t(0)), ("d", 0, t(0)), ("e", 1, None)], "video_id string, status int, updated_at timestamp")
    heard = spark.createDataFrame([("a", t(30))], "video_id string, ts timestamp")
    out = i.interrupted(videos, heard, spark.createDataFrame([("d",)], "video_id string"), F.lit(dt.datetime(2024, 1, 1, 0, 1, 10)))
    assert sorted(r["video_id"] for r in out.collect()) == ["b", "e"]


def test_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "seg")
    rows = lambda items: spark.createDataFrame(items, "tenant_id string, video_id string, segment_index int")
    tables.replace_partitions(rows([("t", "a", 1), ("t", "a", 2), ("t", "b", 1)]), path)
    for _ in range(2):
        tables.replace_partitions(rows([("t", "a", 9)]), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("video_id", "segment_index").collect()) == [("a", 9), ("b", 1)]


def test_rows_are_replaced_by_key(spark, tmp_path):
    path = str(tmp_path / "seg")
    rows = lambda items: spark.createDataFrame(items, "tenant_id string, video_id string, segment_index int")
    held = lambda: sorted(map(tuple, tables.replaced_table(spark, path, rows([]).schema).collect()), key=str)
    files = lambda: {str(p.relative_to(path)) for p in (tmp_path / "seg").rglob("*.parquet")}
    assert tables.replaced_table(spark, path, rows([]).schema) is None
    first = [("t", f"v{i}", k) for i in range(200) for k in range(2)] + [("u", "v1", 0), (None, "v1", 5)]
    tables.replace_rows(rows(first), path, parts=4)
    before = files()
    assert held() == sorted(first, key=str) and len(before) == 4  # not a file for each video
    again = [("t", "v1", 9), (None, "v1", 6), ("t", "new", 0)]
    want = sorted([r for r in first if r[:2] not in {x[:2] for x in again}] + again, key=str)
    for _ in range(2):
        tables.replace_rows(rows(again), path, parts=4)
        assert held() == want
    before = files()
    tables.replace_rows(rows(again[:1]), path, parts=4)
    assert held() == want and len(before & files()) == 3  # other parts were not touched
    tables.replace_rows(rows([]), path, parts=4)
    assert held() == want


def test_replaced_segments_have_no_folder_for_each_video(spark, sf_dir, tmp_path, monkeypatch):
    path = tmp_path / "segments"
    monkeypatch.setattr(segmentations, "new_folder", lambda *_: str(path))
    few = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    few.crossJoin(spark.range(10).withColumnRenamed("id", "k")).withColumn("conv_id", F.col("conv_id") * 10 + F.col("k")).drop("k").write.parquet(str(tmp_path / "conversations.parquet"))
    videos = segmentations.replaced_segments(spark, str(tmp_path)).select("video_id").distinct().count()
    assert videos == 10 * few.select("conv_id").distinct().count() > tables.PARTS
    assert len(list(path.rglob("*.parquet"))) <= tables.PARTS


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, s string")
    for kind in ("parquet", "orc", "csv", "json"):
        getattr(df.write.option("header", "true"), kind)(str(tmp_path / kind))
        got = tables.read_table(spark, str(tmp_path / kind), kind, None if kind in ("parquet", "orc") else df.schema)
        assert sorted(map(tuple, got.collect())) == [(1, "x"), (2, None)]
    (tmp_path / "c.json").write_text('{"_comment": "", "videos": [{"videoId": "v", "duration": 9.0, "windowSeconds": 2.0, "ref": [1.0], "hyp": {"s1": [1.0], "s2": []}}]}')
    assert sorted(r["strategy"] for r in tables.read_cases(spark, str(tmp_path / "c.json")).collect()) == ["s1", "s2"]
    (tmp_path / "q.json").write_text('{"pairs": [{"query": "q", "videoId": "v", "expectedStart": 1.5, "toleranceSeconds": 60.0}]}')
    assert tuple(tables.read_questions(spark, str(tmp_path / "q.json")).first()) == ("q", "v", 1.5, 60.0)


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(0)
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(seconds=20 * k), rng.randint(1, 4), rng.choice(["a", "b"]), float(k)) for k in range(300)]
    schema = "event_id long, ts timestamp, task int, stage string, value double"
    all_rows = spark.createDataFrame(rows, schema)
    for k in range(3):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: p.event_stream(spark, str(tmp_path / "in"), all_rows.schema)
    q = p.run_into_latest(stream(), str(tmp_path / "latest"), str(tmp_path / "c1"))
    got = p.latest_table(spark, str(tmp_path / "latest"), q.lastProgress["batchId"])
    assert q.lastProgress["batchId"] >= 2
    assert sorted(map(tuple, got.select("task", "stage", "value", "ts").collect())) == sorted(map(tuple, p.latest_state(all_rows).collect()))
    p.run_once(p.stage_counts(stream(), "10 minutes"), str(tmp_path / "counts"), str(tmp_path / "c2"))
    done = {tuple(r) for r in spark.read.parquet(str(tmp_path / "counts")).collect()}
    assert done and done <= {tuple(r) for r in p.stage_counts(all_rows, "10 minutes").collect()}
