import datetime as dt

import pytest
from pyspark.sql import functions as F

from cuesheet.operators import uploads as u
from cuesheet.streaming import progress as p
from cuesheet.streaming import queue, state

SCHEMA = "event_id long, task long, stage string, ts timestamp, value double"
at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def batches(spark, path, *parts):
    """A file of events for each batch: (event_id, task, stage, minute)."""
    for k, rows in enumerate(parts):
        spark.createDataFrame([(i, t, s, at(m), 1.0) for i, t, s, m in rows], SCHEMA).coalesce(1).write.parquet(f"{path}/b{k}")
    return p.event_stream(spark, f"{path}/*", spark.createDataFrame([], SCHEMA).schema, "10 minutes")


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, state.STORE)
    yield
    spark.conf.set(key, before)


def test_snapshots_expire_once_by_event_time(spark, tmp_path, rocks):
    day = 24 * 60
    stream = batches(spark, str(tmp_path / "in"), [(1, 1, "asr", 0), (2, 2, "asr", 5), (3, 3, "asr", 6)], [(4, 1, "done", day - 1), (5, 9, "x", day + 8)], [(6, 9, "x", day * 2), (7, 3, "asr", 3), (8, 1, "asr", day * 4)], [(9, 9, "x", day * 6)])
    p.run_once(state.expiries(stream), str(tmp_path / "t"), str(tmp_path / "c"))
    got = sorted((r["task"], r["stage"], r["expired"]) for r in spark.read.parquet(str(tmp_path / "t")).collect())
    # task 1 is replaced in time once, then expires twice; 7 comes too late to be heard
    assert got == sorted([(1, "done", at(2 * day - 1)), (1, "asr", at(5 * day)), (2, "asr", at(day + 5)), (3, "asr", at(day + 6)), (9, "x", at(3 * day))])


def test_late_rows_join_no_session(spark, tmp_path):
    stream = batches(spark, str(tmp_path / "in"), [(1, 1, "a", 0), (2, 1, "a", 1)], [(3, 2, "a", 60)], [(7, 2, "a", 61)], [(4, 1, "a", 1), (5, 1, "a", 58)], [(6, 2, "a", 200)])
    p.run_once(state.closed_silences(stream, "2 minutes"), str(tmp_path / "t"), str(tmp_path / "c"))
    got = sorted((r["task"], r["first_ts"], r["n"]) for r in spark.read.parquet(str(tmp_path / "t")).collect())
    # event 4 is older than the watermark and dropped; event 5 is out of order, not late; the last session is still open
    assert got == [(1, at(0), 2), (1, at(58), 1), (2, at(60), 2)]


def test_late_joiners_by_two_streams_equal_the_batch(spark, tmp_path):
    rows = [(i, i % 4, "done" if i % 23 == 0 else "asr", 30 * i) for i in range(120)]
    stream = batches(spark, str(tmp_path / "in"), rows[:50], rows[50:] + rows[50:70])  # some come twice
    joins = spark.createDataFrame([(100 + t, t, at(m)) for t in range(4) for m in (700, 1900)], "subscriber long, task long, joined timestamp").withColumn("subscriber", F.col("subscriber") * 10 + F.minute("joined") + F.hour("joined"))
    joins.write.parquet(str(tmp_path / "j"))
    other = spark.readStream.schema(joins.schema).parquet(str(tmp_path / "j")).withWatermark("joined", "10 minutes")
    p.run_once(state.subscribed(state.once(stream), other), str(tmp_path / "t"), str(tmp_path / "c"))
    got = state.delivered(spark.read.parquet(str(tmp_path / "t")))
    batch = spark.createDataFrame([(i, t, s, at(m), 1.0) for i, t, s, m in rows], SCHEMA)
    cols = ["subscriber", "task", "event_id", "stage", "replayed"]
    want = sorted(map(tuple, p.delivered(batch, joins).select(*cols).collect()))
    assert sorted(map(tuple, got.select(*cols).collect())) == want and {x[-1] for x in want} == {True, False}


def test_failed_messages_come_again_and_dead_ones_are_kept(spark, tmp_path):
    topic, out, ck = (str(tmp_path / x) for x in ("topic", "out", "ck"))
    rows = spark.range(40).select("id", F.concat(F.lit("m"), "id").alias("body"))
    queue.send(rows, topic, "one")
    queue.send(rows, topic, "one")  # sent again, same name: the same files
    fails = (F.col("id") % 10 == 0) | ((F.col("id") % 4 == 1) & (F.col("attempt") == 1))
    handle = lambda m: (m.withColumn("result", F.length("body")), ~fails)
    queue.consume(spark, topic, out, ck, handle, most=3)
    done = {r["id"]: r["attempt"] for r in queue.results(spark, out, "done", queue.MESSAGE).collect()}
    dead = sorted(map(tuple, queue.results(spark, out, "dead", queue.MESSAGE).collect()))
    assert done == {i: 2 if i % 4 == 1 else 1 for i in range(40) if i % 10}
    assert dead == [(i, f"m{i}", 3) for i in (0, 10, 20, 30)]
    queue.send(spark.createDataFrame([(77, "late")], "id long, body string"), topic, "two")  # what comes later is read later, and nothing twice
    queue.consume(spark, topic, out, ck, handle, most=3)
    all_done = [r["id"] for r in queue.results(spark, out, "done", queue.MESSAGE).collect()]
    assert len(all_done) == len(set(all_done)) == len(done) + 1 and 77 in all_done


def test_a_handler_that_throws_loses_no_message(spark, tmp_path):
    topic, out, ck = (str(tmp_path / x) for x in ("topic", "out", "ck"))
    queue.send(spark.range(5).select("id", F.lit("b").alias("body")), topic, "one")
    calls = []

    def handle(m):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("the worker went away")
        return m, F.lit(True)

    with pytest.raises(Exception, match="the worker went away"):
        queue.consume(spark, topic, out, ck, handle)
    queue.consume(spark, topic, out, ck, handle)
    assert sorted(r["id"] for r in queue.results(spark, out, "done", queue.MESSAGE).collect()) == [0, 1, 2, 3, 4]


def test_bitmaps_of_batches_merge(spark):
    parts = [(1, 1, at(0)), (1, 2, at(1)), (1, 2, at(2)), (1, 40_000, at(3)), (2, 1, at(0)), (2, 0, at(9)), (2, None, at(9))]
    table = spark.createDataFrame(parts, "upload_id long, part long, ts timestamp")
    both = u.merge_bitmaps(*(u.part_bitmaps(table.filter(F.col("part") % 2 == k)) for k in (0, 1)), u.part_bitmaps(table.filter("upload_id = 1")))
    sessions = spark.createDataFrame([(1, "a", 400_000, 10, 5, at(0)), (2, "b", 7, 10, 5, at(0)), (3, "c", 9, 3, 5, at(0)), (4, "d", 9, 3, 5, at(60 * 23))], "upload_id long, name string, size long, part_size long, modified long, started timestamp")
    got = {r["upload_id"]: tuple(r)[1:] for r in u.session_state(sessions, both, F.lit(at(60 * 24 + 1))).collect()}
    assert got == {1: (40_000, 3, False, False), 2: (1, 1, True, False), 3: (3, 0, False, True), 4: (3, 0, False, False)}
    offered = spark.createDataFrame([(1, "a", 400_000, 10, 5), (2, "b", 8, 10, 5), (9, "z", 1, 1, 1), (3, None, 9, 3, 5)], "upload_id long, name string, size long, part_size long, modified long")
    assert {r["upload_id"]: r["resumes"] for r in u.same_file(sessions, offered).collect()} == {1: True, 2: False, 9: False, 3: False}


def test_a_bitmap_is_a_number(spark):
    parts = spark.createDataFrame([(1, p, at(0)) for p in (1, 63, 64, 65, 128, 129, 128)], "upload_id long, part long, ts timestamp")
    kept = u.part_bitmaps(parts)
    assert kept.schema["bitmap"].dataType.simpleString() == "bigint"  # aggregated in place; 4 kB a session filled tasks' memory
    assert sorted((r["page"], bin(r["bitmap"] & (1 << 64) - 1).count("1")) for r in kept.collect()) == [(0, 3), (1, 2), (2, 1)]


def test_the_first_missing_part_of_a_session(spark):
    came = {1: [*range(1, 65), 66], 2: [2, 65], 3: range(1, 64), 4: range(1, 129), 5: [*range(1, 65), *range(129, 193)], 6: range(1, 65), 7: [], 8: [], 9: [5], 10: [1, 2, 9], 11: [*range(1, 193)], 12: [64]}
    totals = {1: 70, 2: 70, 3: 64, 4: 128, 5: 192, 6: 65, 7: 3, 8: 0, 9: 3, 10: 2, 11: 100, 12: 64}
    parts = spark.createDataFrame([(k, p, at(p)) for k, xs in came.items() for p in xs], "upload_id long, part long, ts timestamp")
    kept = u.merge_bitmaps(*(u.part_bitmaps(parts.filter(F.col("part") % 3 == k)) for k in range(3)))
    sessions = spark.createDataFrame([(k, 10 * n, 10, at(0)) for k, n in totals.items()], "upload_id long, size long, part_size long, started timestamp")
    got = {r["upload_id"]: r["first_missing"] for r in u.session_state(sessions, kept, F.lit(at(0)), missing=True).collect()}
    assert got == {k: min(set(range(1, n + 1)) - set(came[k]), default=None) for k, n in totals.items()}
    assert got == {1: 65, 2: 1, 3: 64, 4: None, 5: 65, 6: 65, 7: 1, 8: None, 9: 1, 10: None, 11: None, 12: 1}


def test_quantiles_of_merged_sketches(spark):
    rows = spark.range(60_000).select((F.col("id") % 2).alias("stage"), (F.col("id") % 30).alias("day"), (F.xxhash64("id") % 10_000).cast("double").alias("value"))
    kept = p.summaries(rows, ["stage", "day"])
    for r in p.merged_quantiles(kept, ["stage"], [0.1, 0.5, 0.99]).collect():
        rank = rows.filter(F.col("stage") == r["stage"]).select(F.avg((F.col("value") <= r["value"]).cast("int"))).first()[0]
        assert abs(rank - r["share"]) < 0.01 and r["n"] == 30_000
