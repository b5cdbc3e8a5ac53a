"""A queue of messages with redelivery: a folder of Parquet files is the topic, a stream consumes it.

A message (id, body, attempt) is handled in batches. Those that the handler refuses are put back into the topic with one attempt more,
as new files that a later batch reads; after ``most`` attempts they go to the table of dead letters. A batch that is run again after a
failure writes the same files again under its own number, so nothing is lost or put back twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MESSAGE = "id long, body string, attempt int"
MOST = 3


def send(rows: DataFrame, topic: str, name: str) -> None:
    """Put rows (id, body) into the topic, under a name of the sender's: sending again under it changes nothing."""
    rows.select("id", "body", F.lit(1).alias("attempt")).write.mode("overwrite").parquet(f"{topic}/sent-{name}")


def consume(spark: SparkSession, topic: str, out: str, checkpoint: str, handle: Callable[[DataFrame], tuple[DataFrame, Column]], *, most: int = MOST, files: int = 100) -> StreamingQuery:
    """Handle what is in the topic until nothing is left; returns the last query.

    handle takes messages and returns them with the columns of their results, and a condition that tells which succeeded. Results go to
    ``out``/done, dead letters to ``out``/dead, each with the batch's number.
    """

    def batch(messages: DataFrame, n: int) -> None:
        rows, ok = handle(messages)
        rows = rows.withColumn("_ok", F.coalesce(ok, F.lit(False))).persist()
        try:
            again = ~F.col("_ok") & (F.col("attempt") < most)
            rows.filter("_ok").drop("_ok").write.mode("overwrite").parquet(f"{out}/done/batch={n}")
            rows.filter(~F.col("_ok") & ~again).select("id", "body", "attempt").write.mode("overwrite").parquet(f"{out}/dead/batch={n}")
            rows.filter(again).select("id", "body", (F.col("attempt") + 1).cast("int").alias("attempt")).write.mode("overwrite").parquet(f"{topic}/again-{n}")
        finally:
            rows.unpersist()

    while True:
        stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files).parquet(f"{topic}/*")
        query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        if not query.recentProgress or not any(p["numInputRows"] for p in query.recentProgress):
            return query  # what was put back has been read too


def results(spark: SparkSession, out: str, table: str, schema: str) -> DataFrame:
    """The table done or dead of ``consume``."""
    return spark.read.schema(schema).parquet(f"{out}/{table}/*")
