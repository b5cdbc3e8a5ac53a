"""Ingest: deduplication, upserts, checkpoint reuse, upload parts, library, routing, pairing of tracks."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENDING, PROCESSING, DONE, FAILED = 0, 1, 2, 3
CHECKPOINT_TOLERANCE, MOST_DRIFT, MOST_FAILED, SILENT_SECONDS = 0.05, 0.1, 0.3, 60


def status_text(status: Column) -> Column:
    return F.when(status == DONE, "done").when(status == FAILED, "failed").otherwise("processing")


def by_video(videos: DataFrame, video_id: str) -> DataFrame:
    return videos.filter(F.col("video_id") == video_id)


def user_by_name(users: DataFrame, username: str) -> DataFrame:
    return users.filter(F.col("username") == username)


def newest_first(videos: DataFrame) -> DataFrame:
    return videos.orderBy(F.desc("id"))


def ordered_scan(rows: DataFrame, video_id: str, order: str) -> DataFrame:
    """A video's chunks or segments in order."""
    return rows.filter(F.col("video_id") == video_id).orderBy(order)


def unfinished(videos: DataFrame) -> DataFrame:
    return videos.filter(F.col("status").isin(PENDING, PROCESSING)).orderBy("id")


def owned(videos: DataFrame, video_id: str, tenant_id: str) -> DataFrame:
    """The video if it is the tenant's; one that is absent and one of another tenant look alike."""
    return videos.filter((F.col("video_id") == video_id) & (F.col("tenant_id") == tenant_id))


def first_by_content(rows: DataFrame, digest: str = "md5", order: str = "id", within: tuple[str, ...] = ()) -> DataFrame:
    """Per content digest: the first row's order value and the number of copies; partial sums before the shuffle."""
    return rows.groupBy(*within, digest).agg(F.min(order).alias("first_id"), F.count(F.lit(1)).alias("copies"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by an aggregate (no sort of a key's rows)."""
    rest = [c for c in rows.columns if c not in keys]
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return out.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest)).select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str], *, order: str | None = None, stamp: str | None = None) -> DataFrame:
    """old with new's rows put in or over rows of the same key; the columns ``keep`` stay as they were first.

    Of new rows of one key that with the largest ``order`` counts, or else the largest by all its columns. The column
    ``stamp`` of new rows becomes the time of the call.
    """
    cols = old.columns
    if stamp:
        new = new.withColumn(stamp, F.current_timestamp().cast(old.schema[stamp].dataType))
    rank = F.struct(F.lit(1).alias("new"), *([F.col(order).alias("at")] if order else [F.to_json(F.struct(*cols)).alias("at")]))
    both = new.select(*cols, rank.alias("_new"))
    both = old.select(*cols, F.struct(F.lit(0).alias("new"), F.lit(None).cast(both.schema["_new"].dataType["at"].dataType).alias("at")).alias("_new")).unionByName(both)
    rest = [c for c in cols if c not in keys]
    out = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_new").alias("_last"), *(F.min_by(c, "_new").alias(f"_{c}") for c in keep))
    return out.select(*keys, *(F.col(f"_{c}" if c in keep else f"_last.{c}").alias(c) for c in rest)).select(cols)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose key it lacks."""
    return old.unionByName(new.select(old.columns).join(old.select(*keys), keys, "left_anti").select(old.columns))


def without_videos(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select("video_id"), "video_id", "left_anti")


def reusable_chunks(plan: DataFrame, checkpoints: DataFrame, tolerance: float = CHECKPOINT_TOLERANCE) -> DataFrame:
    """plan (video_id, chunk_index, start, end) with ``text`` of the checkpoint of the same place and times, and ``reused``."""
    old = checkpoints.select("video_id", "chunk_index", F.col("start").alias("_a"), F.col("end").alias("_b"), F.col("text").alias("_t"))
    same = (F.abs(F.col("_a") - F.col("start")) <= tolerance) & (F.abs(F.col("_b") - F.col("end")) <= tolerance) & (F.trim("_t") != "")
    out = plan.join(old, ["video_id", "chunk_index"], "left").withColumn("reused", F.coalesce(same, F.lit(False)))
    return out.withColumn("text", F.when(F.col("reused"), F.col("_t"))).drop("_a", "_b", "_t")


def cost_summary(chunks: DataFrame) -> DataFrame:
    """Mean and largest cost of chunks that were not reused, and whether too many failed."""
    fresh = F.when(~F.col("reused"), F.col("cost"))
    return chunks.agg(F.avg(fresh).alias("mean_cost"), F.max(fresh).alias("max_cost"), (F.sum(F.col("failed").cast("int")) > MOST_FAILED * F.count(F.lit(1))).alias("abort"))


def missing_parts(parts: DataFrame, totals: DataFrame) -> DataFrame:
    """Per upload of totals (upload_id, total): received parts (part) and the list of missing ones."""
    got = parts.groupBy("upload_id").agg(F.collect_set("part").alias("_got"))
    want = F.when(F.col("total") > 0, F.sequence(F.lit(1), F.col("total").cast("int"))).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<int>")
    missing = F.array_except(want, F.coalesce(F.transform("_got", lambda x: x.cast("int")), none))
    out = totals.join(got, "upload_id", "left").withColumn("missing", missing)
    return out.select("upload_id", (F.col("total") - F.size("missing")).cast("long").alias("received"), "missing", (F.size("missing") == 0).alias("complete"))


def library(videos: DataFrame, skeletons: DataFrame) -> DataFrame:
    """videos with segment_count and chapters, ordered; empty if a video has none. One join, not a look-up for each video."""
    chapter = F.struct("segment_index", "start_time", "end_time", "chapter_title")
    chapters = skeletons.groupBy("video_id").agg(F.array_sort(F.collect_list(chapter)).alias("chapters"))
    kind = chapters.schema["chapters"].dataType
    out = videos.join(chapters, "video_id", "left").withColumn("chapters", F.coalesce("chapters", F.array().cast(kind)))
    return out.withColumn("segment_count", F.size("chapters").cast("long"))


def upload_route() -> Column:
    """What to do with an upload whose content has the columns status (null: unknown), has_source and orphan."""
    status = F.col("status")
    return (
        F.when(status.isNull(), "new")
        .when((status == FAILED) & ~F.col("has_source"), "refinalise")
        .when(status == FAILED, "retry")
        .when((status != DONE) & F.col("orphan"), "orphan")
        .otherwise("duplicate")
    )


def interrupted(videos: DataFrame, progress: DataFrame, running: DataFrame, now: Column, silent: int = SILENT_SECONDS) -> DataFrame:
    """Unfinished videos that are not running and of which nothing was heard for ``silent`` seconds."""
    last = progress.groupBy("video_id").agg(F.max("ts").alias("_last"))
    waiting = videos.filter(F.col("status").isin(PENDING, PROCESSING)).join(running.select("video_id"), "video_id", "left_anti").join(last, "video_id", "left")
    heard = F.coalesce(F.unix_timestamp("_last"), F.unix_timestamp("updated_at"), F.lit(0))
    return waiting.filter(F.unix_timestamp(now) - heard >= silent).drop("_last")


def orphans(videos: DataFrame, locked: DataFrame) -> DataFrame:
    """Unfinished videos whose lock nobody holds: what a start-up scan puts back into the queue."""
    return videos.filter(F.col("status").isin(PENDING, PROCESSING)).join(locked.select("video_id").distinct(), "video_id", "left_anti")


def orphans_later(before: DataFrame, locked: DataFrame, videos: DataFrame, still_locked: DataFrame) -> DataFrame:
    """The one recheck after locks have run out: videos unfinished and locked ``before``, now neither locked nor done."""
    waiting = before.filter(F.col("status").isin(PENDING, PROCESSING)).join(locked.select("video_id").distinct(), "video_id", "left_semi").select("video_id")
    return videos.filter(F.col("status") != DONE).join(waiting, "video_id", "left_semi").join(still_locked.select("video_id").distinct(), "video_id", "left_anti")


def needs_processing(tasks: DataFrame, videos: DataFrame, locked: DataFrame) -> DataFrame:
    """Tasks (video_id) to be run: each video once, if it is known, not done and not locked. A task that comes again changes nothing."""
    open_ = videos.filter(F.col("status") != DONE).select("video_id")
    return tasks.select("video_id").distinct().join(open_, "video_id", "left_semi").join(locked.select("video_id").distinct(), "video_id", "left_anti")


def source_of_two() -> Column:
    """Which of two files (v1, a1, v2, a2: whether they hold pictures and sound) a video is made of: first, second, or both, pictures named first."""
    v1, a1, v2, a2 = (F.col(c) for c in ("v1", "a1", "v2", "a2"))
    return (
        F.when(v1 & a1, "first").when(v2 & a2, "second").when(v1 & a2, "first+second").when(v2 & a1, "second+first").when(a1, "first").when(a2, "second").otherwise("no sound")
    )


def upload_sizes(parts: DataFrame) -> DataFrame:
    """Per upload of parts (upload_id, size): how many there are and their bytes together."""
    return parts.groupBy("upload_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("bytes"))


def matched_tracks(tracks: list[tuple[str, float, bool, bool]], most_drift: float = MOST_DRIFT) -> list[tuple[int, int, float]]:
    """(picture, sound, drift) by place in tracks (name, duration, has_video, has_audio).

    Longer pictures choose first, each the free sound of least drift; equal drifts (1e-9) go by the likeness of the names.
    """

    def stem(name: str) -> str:
        base = name.replace("\\", "/").rpartition("/")[2]
        dot = base.rfind(".")
        return (base[:dot] if dot > 0 else base).lower()

    def likeness(a: str, b: str) -> float:
        return len(os.path.commonprefix([a, b])) / max(len(a), len(b), 1)

    usable = [i for i, t in enumerate(tracks) if t[1] and t[1] > 0]
    free = [i for i in usable if tracks[i][3] and not tracks[i][2]]
    out = []
    for v in sorted((i for i in usable if tracks[i][2] and not tracks[i][3]), key=lambda i: -tracks[i][1]):
        best: tuple[float, float, int] | None = None
        for a in free:
            d = abs(tracks[v][1] - tracks[a][1]) / max(tracks[v][1], tracks[a][1])
            like = likeness(stem(tracks[v][0]), stem(tracks[a][0]))
            if d <= most_drift and (best is None or d < best[0] - 1e-9 or abs(d - best[0]) <= 1e-9 and like > best[1]):
                best = (d, like, a)
        if best:
            free.remove(best[2])
            out.append((v, best[2], best[0]))
    return out


def pair_tracks(tracks: DataFrame, most_drift: float = MOST_DRIFT) -> DataFrame:
    """(batch_id, picture, sound, drift) of tracks (batch_id, place, name, duration, has_video, has_audio, error)."""
    return _paired(tracks, most_drift).select("batch_id", "picture", "sound", "drift")


def _paired(tracks: DataFrame, most_drift: float) -> DataFrame:
    """pair_tracks with picture_place and sound_place.

    Choosing is sequential within an upload batch, which a person fills by hand; batches run side by side.
    """

    item = F.struct("place", "name", "duration", "has_video", "has_audio")
    batches = tracks.filter("error is null and duration > 0").groupBy("batch_id").agg(F.array_sort(F.collect_list(item)).alias("tracks"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for batch, rows in zip(part["batch_id"], part["tracks"]):
                given = [(t["name"], t["duration"], t["has_video"], t["has_audio"]) for t in rows]
                out += [(batch, given[v][0], given[a][0], d, rows[v]["place"], rows[a]["place"]) for v, a, d in matched_tracks(given, most_drift)]
            yield pd.DataFrame(out, columns=["batch_id", "picture", "sound", "drift", "picture_place", "sound_place"])

    return batches.mapInPandas(run, f"batch_id {tracks.schema['batch_id'].dataType.simpleString()}, picture string, sound string, drift double, picture_place int, sound_place int")


def batch_groups(tracks: DataFrame, most_drift: float = MOST_DRIFT) -> DataFrame:
    """(batch_id, place, outcome, other) of an upload batch's groups: a pair at its first place, a file alone, or one refused.

    A file that could not be read fails, as do pictures without sound; neither holds up the rest of the batch.
    """
    pairs = _paired(tracks, most_drift).select("batch_id", "picture_place", "sound_place")
    both = pairs.select("batch_id", F.col("picture_place").alias("place"), F.col("sound_place").alias("other")).unionByName(pairs.select("batch_id", F.col("sound_place").alias("place"), F.col("picture_place").alias("other")))
    rows = tracks.select("batch_id", F.col("place").cast("int").alias("place"), "has_video", "has_audio", "error").join(both, ["batch_id", "place"], "left")
    outcome = F.when(F.col("other").isNotNull(), "pair").when(F.col("error").isNotNull(), "failed").when(F.col("has_video") & ~F.col("has_audio"), "no sound").otherwise("alone")
    return rows.filter("other is null or place < other").select("batch_id", "place", outcome.alias("outcome"), "other")
