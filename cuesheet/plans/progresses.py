"""Progress queries over ``events``; the streams read the same table as files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import uploads as u
from ..sources.folders import new_folder
from ..sources.tables import load
from ..streaming import progress as p
from ..streaming import queue
from ..streaming import state as st
from . import query


NOON = dt.datetime(2024, 1, 15, 12)


def events(spark, sf_dir):
    return p.as_events(load(spark, sf_dir, "events"))


LATEST = "SELECT user_id AS task, arg_max(event_type, (ts, event_id)) AS stage, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY user_id"


@query(LATEST)
def progress_latest(spark, sf_dir):
    return p.latest_state(events(spark, sf_dir))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id AS task, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, k")
def silence_sessions(spark, sf_dir):
    return p.silence_sessions(events(spark, sf_dir), "6 hours")


@query("SELECT event_type AS stage, count(*) AS n, round(sum(value), 4) AS total, max(value) AS largest, round(median(value), 6) AS median FROM events GROUP BY event_type")
def stage_metrics(spark, sf_dir):
    return p.stage_metrics(events(spark, sf_dir)).withColumns({"total": F.round("total", 4), "median": F.round("median", 6)})


COUNTS = "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type AS stage, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


@query(COUNTS)
def stage_counts(spark, sf_dir):
    return p.stage_counts(events(spark, sf_dir)).withColumn("total", F.round("total", 4))


@query("WITH l AS (SELECT user_id AS task, arg_max(event_type, (ts, event_id)) AS stage, max(ts) AS ts FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events) SELECT task, stage FROM l, n WHERE stage <> 'purchase' AND epoch(date_trunc('second', now)) - epoch(date_trunc('second', ts)) >= 3600")
def silent_tasks(spark, sf_dir):
    rows = events(spark, sf_dir)
    now = rows.agg(F.max("ts")).first()[0]
    return p.silent_tasks(rows, F.lit(now), 3600, ("purchase",)).select("task", "stage")


@query("WITH n AS (SELECT TIMESTAMP '2024-01-15 12:00:00' AS now), l AS (SELECT user_id AS task, arg_max(event_type, (ts, event_id)) AS stage, max(ts) AS ts FROM events, n WHERE ts <= now GROUP BY user_id) SELECT task, stage FROM l, n WHERE ts > now - INTERVAL 24 HOUR")
def live_snapshots(spark, sf_dir):
    return p.snapshots(events(spark, sf_dir), F.lit(NOON)).select("task", "stage")


LATE_JOINERS = "WITH j AS (SELECT DISTINCT user_id AS task, TIMESTAMP '2024-01-15 12:00:00' AS joined FROM events WHERE user_id % 3 = 0), r AS (SELECT task, joined, ts, event_id, event_type AS stage FROM j JOIN events ON user_id = task), old AS (SELECT task, max((ts, event_id)) AS k FROM r WHERE ts <= joined AND ts > joined - INTERVAL 24 HOUR GROUP BY task), got AS (SELECT r.*, ts <= joined AS replayed FROM r LEFT JOIN old USING (task) WHERE ts > joined OR (ts, event_id) = k), e AS (SELECT task, min((ts, event_id)) AS k FROM got WHERE stage = 'purchase' GROUP BY task) SELECT task, event_id, stage, replayed FROM got LEFT JOIN e USING (task) WHERE k IS NULL OR (ts, event_id) <= k"


@query(LATE_JOINERS)
def late_joiners(spark, sf_dir):
    """What those get who join at noon: a purchase ends a task."""
    rows = events(spark, sf_dir)
    return p.delivered(rows, _joins(rows), ended=("purchase",)).select("task", "event_id", "stage", "replayed")


def _joins(rows):
    return rows.filter("task % 3 = 0").select("task").distinct().select(F.col("task").alias("subscriber"), "task", F.lit(NOON).alias("joined"))


def _folder(spark) -> str:
    return new_folder(spark, "streams")


def _stream(spark, sf_dir):
    rows = load(spark, sf_dir, "events")
    return rows.schema, f"{sf_dir}/events.parque[t]"  # a pattern: a stream takes a single file only by one


@query(LATEST)
def stream_latest(spark, sf_dir):
    """The table that a stream keeps of each task's last event."""
    schema, path = _stream(spark, sf_dir)
    out = _folder(spark)
    q = p.run_into_latest(p.as_events(p.event_stream(spark, path, schema)), f"{out}/table", f"{out}/checkpoint")
    return p.latest_table(spark, f"{out}/table", q.lastProgress["batchId"]).select("task", "stage", "value", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(COUNTS)
def stream_stage_counts(spark, sf_dir):
    """Hourly counts of a stream in complete mode, by a sink that writes each version whole."""
    schema, path = _stream(spark, sf_dir)
    out = _folder(spark)
    counts = p.stage_counts(p.as_events(p.event_stream(spark, path, schema)))
    q = counts.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/table/v{n}")).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/table/v{q.lastProgress['batchId']}").withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "total": F.round("total", 4)})


def _events(spark, sf_dir, late=p.LATE):
    schema, path = _stream(spark, sf_dir)
    return p.as_events(p.event_stream(spark, path, schema, late))


@query("WITH n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM events), w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events) SELECT user_id AS task, event_type AS stage, value, ts, ts + INTERVAL 24 HOUR AS expired FROM n, w WHERE later > ts + INTERVAL 24 HOUR OR later IS NULL AND ts + INTERVAL 24 HOUR < mark")
def stream_expiries(spark, sf_dir):
    """Snapshots that no event replaced within 24 hours, by a value state with timers."""
    out, key = _folder(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, st.STORE)
    try:
        p.run_once(st.expiries(_events(spark, sf_dir)), f"{out}/table", f"{out}/checkpoint")
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(f"{out}/table").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "expired")})


SESSIONS = "g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)"


@query(f"WITH {SESSIONS}, w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events) SELECT user_id AS task, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s, w GROUP BY user_id, k, mark HAVING max(ts) + INTERVAL 6 HOUR <= mark")
def stream_silence_sessions(spark, sf_dir):
    """Sessions that a stream has closed: the watermark has passed their last event by the gap."""
    out = _folder(spark)
    p.run_once(st.closed_silences(_events(spark, sf_dir), "6 hours"), f"{out}/table", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/table").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


@query(LATE_JOINERS)
def stream_late_joiners(spark, sf_dir):
    """late_joiners by a join of two streams; events that come twice count once."""
    out = _folder(spark)
    _joins(events(spark, sf_dir)).write.parquet(f"{out}/joins")
    joins = spark.readStream.schema("subscriber long, task long, joined timestamp").parquet(f"{out}/joins").withWatermark("joined", p.LATE)
    p.run_once(st.subscribed(st.once(_events(spark, sf_dir)), joins), f"{out}/table", f"{out}/checkpoint")
    return st.delivered(spark.read.parquet(f"{out}/table"), ended=("purchase",)).select("task", "event_id", "stage", "replayed")


@query("SELECT event_id AS id, CAST(CASE WHEN event_id % 49 = 0 THEN 3 WHEN event_id % 7 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempt, event_id % 49 = 0 AS dead FROM events")
def queue_redelivery(spark, sf_dir):
    """Events as messages: those divisible by 7 fail once, those divisible by 49 always."""
    out = _folder(spark)
    queue.send(events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("stage").alias("body")), f"{out}/topic", "events")
    fails = (F.col("id") % 49 == 0) | ((F.col("id") % 7 == 0) & (F.col("attempt") == 1))
    queue.consume(spark, f"{out}/topic", f"{out}/tables", f"{out}/checkpoint", lambda m: (m, ~fails))
    done, dead = (queue.results(spark, f"{out}/tables", t, queue.MESSAGE) for t in ("done", "dead"))
    return done.select("id", "attempt", F.lit(False).alias("dead")).unionByName(dead.select("id", "attempt", F.lit(True).alias("dead")))


@query("SELECT event_type AS stage, share, count(value) AS n, true AS near FROM events, (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.95 AS DOUBLE)), (CAST(0.99 AS DOUBLE))) AS t(share) GROUP BY ALL")
def stage_quantiles(spark, sf_dir):
    """Quantiles over a month from sketches of its days, and whether each one's rank is within 1 % of where it should be."""
    rows = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    found = p.merged_quantiles(p.summaries(rows, ["stage", "day"]), ["stage"], [0.5, 0.95, 0.99])
    rank = rows.join(found.select("stage", "share", F.col("value").alias("_q")), "stage").groupBy("stage", "share").agg((F.sum((F.col("value") <= F.col("_q")).cast("long")) / F.count("value")).alias("_rank"))
    return found.join(rank, ["stage", "share"]).select("stage", "share", "n", (F.abs(F.col("_rank") - F.col("share")) <= 0.01).alias("near"))


NOW = dt.datetime(2000, 1, 1)


@query("WITH s AS (SELECT o_orderkey AS upload_id, o_orderdate AS started, CAST(1 + o_orderkey % 7 AS BIGINT) AS total FROM orders), g AS (SELECT l_orderkey AS upload_id, count(DISTINCT l_linenumber) AS received, max(l_shipdate) AS last_ts, list(DISTINCT l_linenumber) AS parts FROM lineitem GROUP BY l_orderkey) SELECT upload_id, total, coalesce(received, 0) AS received, coalesce(received, 0) = total AS complete, coalesce(received, 0) <> total AND coalesce(last_ts, started) < TIMESTAMP '2000-01-01' - INTERVAL 24 HOUR AS expired, list_min(list_filter(range(1, total + 1), lambda p: NOT list_contains(coalesce(parts, []), p))) AS first_missing, upload_id % 5 <> 0 AS resumes FROM s LEFT JOIN g USING (upload_id)")
def upload_sessions(spark, sf_dir):
    """Orders as sessions, their lines as parts that came in three batches; files of ids divisible by 5 are offered with another size."""
    orders, parts = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    sessions = orders.select(F.col("o_orderkey").alias("upload_id"), F.col("o_orderdate").alias("started"), F.col("o_orderpriority").alias("name"), ((1 + F.col("o_orderkey") % 7) * 10 - 3).alias("size"), F.lit(10).alias("part_size"), F.col("o_custkey").alias("modified"))
    came = parts.select(F.col("l_orderkey").alias("upload_id"), F.col("l_linenumber").cast("long").alias("part"), F.col("l_shipdate").alias("ts"), (F.col("l_partkey") % 3).alias("batch"))
    kept = u.merge_bitmaps(*(u.part_bitmaps(came.filter(F.col("batch") == k)) for k in range(3)))
    offered = sessions.select("upload_id", "name", (F.col("size") + F.when(F.col("upload_id") % 5 == 0, 1).otherwise(0)).alias("size"), "part_size", "modified")
    state = u.session_state(sessions, kept, F.lit(NOW), missing=True)
    return state.join(u.same_file(sessions, offered).select("upload_id", "resumes"), "upload_id")
