"""Intermediate tables in the folder that driver and executors share.

A staged table cuts lineage: it is written once as Parquet and read again, so a lost executor costs only the tasks it ran.
The folder is ``spark.checkpoint.dir`` of the session. Only a local session may do without that setting.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GC_SECONDS = 3.0
BROADCAST_BYTES = 64 << 20
_FOLDERS: set[str] = set()
_freed = 0.0
_RUN = uuid.uuid4().hex[:12]


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder, without a slash at its end."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/cuesheet"
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a new table or archive; it goes when the driver's Python ends."""
    path = f"{shared_folder(spark)}/staged-{_RUN}/{name}-{uuid.uuid4().hex[:12]}"
    if not _FOLDERS:
        atexit.register(_drop_all, spark)
    _FOLDERS.add(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    free_shuffles(spark)
    return out


def light(df: DataFrame, row_bytes: int) -> DataFrame:
    """A staged table, to be broadcast if its rows, counted, take at most BROADCAST_BYTES; else as it is, for a join by a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of jobs that have ended; at most once in GC_SECONDS."""
    global _freed
    if time.monotonic() - _freed < GC_SECONDS:
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _freed = time.monotonic()


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """All of docs' columns in the one struct ``_doc``, beside the columns ``more``: so no name of docs can clash with ours."""
    return docs.select(F.struct(*(F.col(f"`{c}`").alias(c) for c in docs.columns)).alias("_doc"), *(c.alias(n) for n, c in more.items()))


def unpacked(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """docs' columns again; ``new`` ones take the place of those of the same name, or come last."""
    own = [new[c].alias(c) if c in new else F.col("_doc").getField(c).alias(c) for c in docs.columns]
    return rows.select(*own, *(c.alias(n) for n, c in new.items() if n not in docs.columns))


def spare_name(docs: DataFrame, name: str) -> str:
    """name, with underscores behind it as long as docs has such a column: for columns that an operator adds."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release(df: DataFrame) -> None:
    """Delete a staged table that no lazy plan reads any more."""
    path = getattr(df, "staged_path", None)
    if path in _FOLDERS:
        _delete(df.sparkSession, path)
        _FOLDERS.discard(path)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def _drop_all(spark: SparkSession) -> None:
    for path in _FOLDERS:
        with contextlib.suppress(Exception):  # the JVM may be gone
            _delete(spark, path)
