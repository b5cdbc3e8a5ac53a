"""Progress events (task, stage, ts, value): latest state, silence, counts by window, as batches and as streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATE, KEPT = "10 minutes", "24 hours"
ENDED = ("done", "failed")
#: Parts of the table of latest events.
PARTS = 64
#: Rank error of the summaries that bound medians, as a share of the rows: one in ACCURACY. Size of quantile sketches.
ACCURACY, SKETCH = 10_000, 800


def latest_state(events: DataFrame) -> DataFrame:
    """Each task's last event (the larger event_id on equal times), by an aggregate."""
    return events.groupBy("task").agg(F.max_by(F.struct("stage", "value", "ts"), F.struct("ts", "event_id")).alias("s")).select("task", "s.stage", "s.value", "s.ts")


def snapshots(events: DataFrame, now: Column, kept: str = KEPT) -> DataFrame:
    """Each task's last event up to ``now``, unless it is older than ``kept``."""
    return latest_state(events.filter(F.col("ts") <= now)).filter(F.col("ts") > now - F.expr(f"INTERVAL {kept}"))


def delivered(events: DataFrame, joins: DataFrame, ended: tuple[str, ...] = ENDED, kept: str = KEPT) -> DataFrame:
    """What subscribers (subscriber, task, joined) get: (subscriber, task, ts, event_id, stage, value, replayed).

    First the task's last event before they joined, if it is not older than ``kept``; then each later one up to the first
    that ends the task. A replayed end is all that there is.
    """
    rows = joins.join(events, "task").filter(F.col("ts") > F.col("joined") - F.expr(f"INTERVAL {kept}"))
    return deliveries(rows, ended)


def deliveries(rows: DataFrame, ended: tuple[str, ...] = ENDED) -> DataFrame:
    """``delivered`` from rows that have each subscriber's events (subscriber, task, joined, ts, event_id, stage, value)."""
    order = F.struct("ts", "event_id")
    last = rows.filter(F.col("ts") <= F.col("joined")).groupBy("subscriber", "task", "joined").agg(F.max_by(F.struct("ts", "event_id", "stage", "value"), order).alias("s"))
    last = last.select("subscriber", "task", "joined", "s.*")
    new = rows.filter(F.col("ts") > F.col("joined")).select("subscriber", "task", "joined", "ts", "event_id", "stage", "value")
    both = last.withColumn("replayed", F.lit(True)).unionByName(new.withColumn("replayed", F.lit(False)))
    end = F.min(F.when(F.col("stage").isin(*ended), order)).over(W.partitionBy("subscriber", "task"))
    return both.withColumn("_end", end).filter(F.col("_end").isNull() | (order <= F.col("_end"))).drop("_end", "joined")


def silence_sessions(events: DataFrame, gap: str = "60 seconds") -> DataFrame:
    """Runs of a task's events with less than ``gap`` between neighbours; works on streams with a watermark."""
    out = events.groupBy("task", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.select("task", "first_ts", "last_ts", "n")


def stage_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None) -> DataFrame:
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = events.groupBy(w.alias("w"), "stage").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "stage", "n", "total")


def _middles(values: DataFrame, accuracy: int) -> DataFrame:
    """(stage, median) of rows (stage, value): the mean of the two middle values, exactly.

    Bounded summaries give two values a stage between which the middle lies, with a margin of several times their error. Rows below
    are counted; of the few between, each different value is counted once, and those counts alone are put in order.
    """
    rows, slack = values.filter("value is not null"), 4.0 / accuracy
    bounds = rows.groupBy("stage").agg(F.percentile_approx("value", [0.5 - slack, 0.5 + slack], accuracy).alias("_b"), F.count(F.lit(1)).alias("_n"))
    bounds = bounds.select("stage", "_n", F.col("_b")[0].alias("_low"), F.col("_b")[1].alias("_high"))
    counts = rows.join(F.broadcast(bounds), F.col("value").isNotNull() & rows["stage"].eqNullSafe(bounds["stage"])).drop(bounds["stage"])  # a row a stage
    inside = F.when(F.col("value").between(F.col("_low"), F.col("_high")), F.col("value"))
    side = F.when(inside.isNotNull(), 0).when(F.col("value") < F.col("_low"), -1).otherwise(1)
    counts = counts.groupBy("stage", "_n", side.alias("_side"), inside.alias("value")).agg(F.count(F.lit(1)).alias("_k")).filter("_side <= 0")
    upto = F.sum("_k").over(W.partitionBy("stage").orderBy("_side", "value").rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.withColumn("_upto", upto).filter("_side = 0")
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.struct(F.col("_upto").alias("u"), F.col("value").alias("v"), (F.col("_upto") - F.col("_k") < rank).alias("in"))))
    both = ranked.groupBy("stage").agg(at(F.floor((F.col("_n") + 1) / 2)).alias("_a"), at(F.floor(F.col("_n") / 2) + 1).alias("_c"))
    missed = F.raise_error(F.lit("the middle lies outside of its bounds")).cast("double")
    found = F.coalesce(F.col("_a.in") & F.col("_c.in"), F.lit(False))
    return both.select("stage", F.when(found, F.col("_a.v") + (F.col("_c.v") - F.col("_a.v")) * 0.5).otherwise(missed).alias("median"))


def stage_metrics(events: DataFrame, accuracy: int = ACCURACY) -> DataFrame:
    """Count, sum, largest value and median per stage: the middle value, or the mean of the two middle ones. No stage's values meet in one task."""
    out = events.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("largest"))
    middles = _middles(events.select("stage", "value"), accuracy).withColumnRenamed("stage", "_stage")
    return out.join(middles, F.col("stage").eqNullSafe(F.col("_stage")), "left").drop("_stage")


def summaries(events: DataFrame, by: Sequence[str], k: int = SKETCH) -> DataFrame:
    """Quantile sketches of values by the columns ``by`` (such as stage and day): what is kept of a batch, a few kB a row."""
    return events.groupBy(*by).agg(F.count("value").alias("n"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))


def merged_quantiles(kept: DataFrame, by: Sequence[str], shares: Sequence[float], k: int = SKETCH) -> DataFrame:
    """Quantiles over sketches of any number of batches: (by, n, share, value). With k = 800 a rank is off by about 0.4 % of n."""
    whole = kept.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("_sketch"))
    wanted = F.array(*(F.lit(float(s)) for s in shares))
    both = F.arrays_zip(wanted.alias("share"), F.kll_sketch_get_quantile_double("_sketch", wanted).alias("value"))
    return whole.select(*by, "n", F.inline(both).alias("share", "value"))


def silent_tasks(events: DataFrame, now: Column, seconds: int = 60, ended: tuple[str, ...] = ENDED) -> DataFrame:
    """Tasks that have not ended and were last heard ``seconds`` or more before ``now``."""
    last = latest_state(events).filter(~F.col("stage").isin(*ended))
    return last.filter(F.unix_timestamp(now) - F.unix_timestamp("ts") >= seconds)


def as_events(rows: DataFrame) -> DataFrame:
    """The events table as progress events."""
    return rows.select("event_id", F.col("user_id").alias("task"), F.col("event_type").alias("stage"), "ts", "value")


def event_stream(spark: SparkSession, path: str, schema, late: str = LATE, files: int = 1) -> DataFrame:
    """Parquet files of events as a stream with a watermark."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and write it to a Parquet table, exactly once under its checkpoint; returns the ended query."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_into_latest(stream: DataFrame, path: str, checkpoint: str, kept: str | None = None, parts: int = PARTS) -> StreamingQuery:
    """Keep a table of each task's last event, read by ``latest_table``.

    The table is dealt into parts by the task. A batch writes new versions of the parts that it touches, and a small list of
    each part's version; so its cost goes with the batch. A batch that runs again writes the same again. Events older than
    ``kept`` before the batch's last are dropped from the parts it touches.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64("task"), F.lit(parts)).cast("int")
        new = batch.select("task", "stage", "value", "ts", "event_id", part.alias("part"))
        touched = sorted(r[0] for r in new.select("part").distinct().collect())  # at most ``parts``
        old = _versions(spark, path, n - 1) if n else {}
        if before := [f"{path}/v{old[k]}/part={k}" for k in touched if k in old]:
            new = new.unionByName(spark.read.parquet(*before).withColumn("part", part))
        last = new.groupBy("part", "task").agg(F.max_by(F.struct("stage", "value", "ts", "event_id"), F.struct("ts", "event_id")).alias("s")).select("part", "task", "s.*")
        if kept and touched:
            last = last.filter(F.col("ts") > F.lit(batch.agg(F.max("ts")).first()[0]) - F.expr(f"INTERVAL {kept}"))
        last.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/v{n}")
        left = {r[0] for r in last.select("part").distinct().collect()}
        now = {k: v for k, v in old.items() if k not in touched} | {k: n for k in touched if k in left}
        spark.createDataFrame(sorted(now.items()), "part int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/list{n}")

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _versions(spark: SparkSession, path: str, n: int) -> dict[int, int]:
    return {r["part"]: r["version"] for r in spark.read.schema("part int, version long").parquet(f"{path}/list{n}").collect()}


def latest_table(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The table as it was after batch n."""
    schema = "task long, stage string, value double, ts timestamp, event_id long"
    files = [f"{path}/v{v}/part={k}" for k, v in sorted(_versions(spark, path, n).items())]
    return spark.read.parquet(*files) if files else spark.createDataFrame([], schema)
