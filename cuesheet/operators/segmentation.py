"""Topic segmentation of timed lines (video_id, line, start, end, text).

What a window can express is a window: similarity of neighbours, smoothing, valley depth, fixed windows, building. The greedy
scans (pauses, semantic cuts, chunk plans) carry state from cut to cut; they run in Arrow batches over rows that hold a
video's numbers as lists. A video's lines fit a task: an hour has some hundreds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import cosine, norm
from .cues import CHINESE, CuePatterns, detect_cues

MIN_SEGMENT, MAX_SEGMENT, PAUSE, WINDOW, DEPTH_K = 30.0, 300.0, 1.2, 60.0, 0.8
#: Videos whose lists are Python objects at a time.
PART = 64
#: Sentence ends and the fewest characters of a sentence.
SENTENCE_ENDS, MIN_SENTENCE = "。！？!?；;，,", 6


def _per_video(order: str = "line") -> W:
    return W.partitionBy("video_id").orderBy(order)


# ---- scores by windows


def adjacent_similarity(lines: DataFrame, order: str = "line") -> DataFrame:
    """sim of each line's vector to the next one's; the last line of a video is left out."""
    with_norm = lines.withColumn("_norm", norm(F.col("embedding")))
    w = _per_video(order)
    sim = cosine(F.col("embedding"), F.lead("embedding").over(w), F.col("_norm"), F.lead("_norm").over(w))
    return with_norm.withColumn("sim", sim).filter("sim is not null").drop("_norm", "embedding")


def smoothed(sims: DataFrame, order: str = "line") -> DataFrame:
    """smooth: mean of sim and its neighbours in the video."""
    return sims.withColumn("smooth", F.avg("sim").over(_per_video(order).rowsBetween(-1, 1)))


def valley_depth(series: DataFrame, value: str = "smooth", order: str = "line") -> DataFrame:
    """depth: the climb from a value to the top of the slope on its left plus that on its right.

    A slope is a run in which values don't fall, going outwards. Runs are numbered by counting the places where they break,
    so a slope's top is the maximum of the run's part on that side.
    """
    w = _per_video(order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    breaks = series.withColumns({"_fall": F.when(before < F.col(value), 1).otherwise(0), "_rise": F.when(F.col(value) > after, 1).otherwise(0)})
    runs = breaks.withColumns({"_left": F.sum("_fall").over(w.rowsBetween(W.unboundedPreceding, 0)), "_right": F.coalesce(F.sum("_rise").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    left = F.max(value).over(W.partitionBy("video_id", "_left").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    right = F.max(value).over(W.partitionBy("video_id", "_right").orderBy(order).rowsBetween(0, W.unboundedFollowing))
    return runs.withColumn("depth", (left - F.col(value)) + (right - F.col(value))).drop("_fall", "_rise", "_left", "_right")


def depth_candidates(depths: DataFrame, k: float = DEPTH_K) -> DataFrame:
    """Rows whose depth reaches the video's mean plus k population deviations; with that threshold."""
    w = W.partitionBy("video_id")
    return depths.withColumn("threshold", F.avg("depth").over(w) + k * F.stddev_pop("depth").over(w)).filter(F.col("depth") >= F.col("threshold"))


# ---- sentences


def split_sentences(lines: DataFrame, ends: str = SENTENCE_ENDS, least: int = MIN_SENTENCE) -> DataFrame:
    """Lines as sentences: (video_id, line, part, start, end, text); the texts of a line's parts make up the line.

    A piece ends after any of ``ends``; pieces are joined from left to right until they have ``least`` characters, and what is
    left over goes to the last. Times are shared out by characters.
    """
    pieces = F.regexp_extract_all("text", F.lit(f"[^{ends}]*[{ends}]|[^{ends}]+"), F.lit(0))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, piece):
        grown = F.concat(acc["open"], piece)
        full = F.length(grown) >= least
        return F.struct(F.when(full, F.concat(acc["done"], F.array(grown))).otherwise(acc["done"]).alias("done"), F.when(full, F.lit("")).otherwise(grown).alias("open"))

    def finish(acc):
        n = F.size(acc["done"])
        tail = F.concat(F.slice(acc["done"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(acc["done"], -1), acc["open"])))
        return F.when(n == 0, F.array(acc["open"])).when(acc["open"] == "", acc["done"]).otherwise(tail)

    parts = F.when(F.coalesce(F.size(pieces), F.lit(0)) <= 1, F.array("text")).otherwise(F.aggregate(pieces, empty, step, finish))
    rows = lines.select("video_id", "line", "start", "end", F.length("text").alias("_all"), F.posexplode(parts).alias("part", "_text"))
    w = W.partitionBy("video_id", "line").orderBy("part")
    upto = F.sum(F.length("_text")).over(w.rowsBetween(W.unboundedPreceding, 0))
    at = lambda n: F.col("start") + (F.col("end") - F.col("start")) * n / F.greatest(F.col("_all"), F.lit(1))
    return rows.select("video_id", "line", "part", at(upto - F.length("_text")).alias("start"), at(upto).alias("end"), F.col("_text").alias("text"))


# ---- cuts and segments


def fixed_cuts(lines: DataFrame, window: float = WINDOW) -> DataFrame:
    """cut: whether a line starts in another window than the line before."""
    bucket = F.floor(F.col("start") / window)
    return lines.withColumn("cut", F.coalesce(bucket != F.lag(bucket).over(_per_video()), F.lit(False)))


def cuts_at(lines: DataFrame, times: DataFrame) -> DataFrame:
    """cut: whether a line is the first at or after one of the times (video_id, time); a video's first line never is."""
    marks = lines.select("video_id", F.col("start").alias("_t"), F.lit(1).alias("_kind"), "line").unionByName(times.select("video_id", F.col("time").alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(lines.schema["line"].dataType).alias("line")))
    w = W.partitionBy("video_id").orderBy("_t", "_kind", "line")
    found = marks.withColumn("_cut", F.coalesce(F.lag("_kind").over(w) == 0, F.lit(False))).filter("_kind = 1")
    return lines.join(found.select("video_id", "line", "_cut"), ["video_id", "line"]).withColumn("cut", F.col("_cut") & (F.col("line") > F.min("line").over(W.partitionBy("video_id")))).drop("_cut")


def build_segments(lines: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """Segments of lines with ``cut``: (video_id, segment, start_time, end_time, n_lines, text), texts joined without a separator.

    A video's last segment ends with its duration, if that is later.
    """
    rows = lines.withColumn("segment", F.sum(F.col("cut").cast("int")).over(_per_video().rowsBetween(W.unboundedPreceding, 0)))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "")
    out = rows.groupBy("video_id", "segment").agg(F.min_by("start", "line").alias("start_time"), F.max_by("end", "line").alias("_end"), F.count(F.lit(1)).alias("n_lines"), texts.alias("text"))
    if durations is not None:
        out = out.join(durations.select("video_id", "duration"), "video_id", "left")
        last = F.col("segment") == F.max("segment").over(W.partitionBy("video_id"))
        out = out.withColumn("_end", F.when(last, F.greatest("_end", "duration")).otherwise(F.col("_end")))
    return out.select("video_id", "segment", "start_time", F.col("_end").alias("end_time"), "n_lines", "text")


def stored_times(segments: DataFrame) -> DataFrame:
    """Times as they are stored: two decimals, half up."""
    return segments.withColumns({c: F.round(c, 2).cast("decimal(10,2)") for c in ("start_time", "end_time")})


# ---- greedy scans


def pause_cuts(n_lines: int, duration: float, pauses: list[tuple[float, float]], least: float = MIN_SEGMENT, most: float = MAX_SEGMENT) -> list[float]:
    """Cuts at the longest pause (end, length) that ends within [least, most] of the last cut, else after ``most``."""
    cuts: list[float] = []
    if n_lines <= 1:
        return cuts
    at = 0.0
    while duration - at > most:
        fits = [p for p in pauses if at + least <= p[0] <= at + most]
        at = max(fits, key=lambda p: p[1])[0] if fits else at + most
        cuts.append(at)
    return cuts


def semantic_cuts(duration: float, cues: list[float], depths: list[tuple[float, float]], threshold: float, least: float = MIN_SEGMENT, most: float = MAX_SEGMENT) -> list[float]:
    """Cuts of a scan over cues and depth candidates (time, depth) in order of time, a cue first.

    A cue cuts if the segment has ``least`` seconds. A depth of the threshold or more is kept in mind, the deepest first. When
    the segment reaches ``most`` it is cut at that place, or at the candidate nearest to ``most`` in its allowed part.
    """
    events = sorted([(t, 0, 0.0) for t in cues] + [(t, 1, d) for t, d in depths])
    cuts: list[float] = []
    at, best = 0.0, None
    for i, (t, kind, depth) in enumerate(events):
        if kind == 0 and t - at >= least:
            cuts.append(t)
            at, best = t, None
            continue
        if kind == 1 and t - at >= least and depth >= threshold and (best is None or depth > best[1]):
            best = (t, depth)
        if t - at >= most:
            if best is None:
                near = [e[0] for e in events[: i + 1] if at + least < e[0] <= t]
                best = (min(near, key=lambda x: abs(x - at - most)), 0.0)  # t itself is near enough
            cuts.append(best[0])
            at, best = best[0], None
    if cuts and duration - cuts[-1] < least:
        cuts.pop()
    return cuts


def chunk_ranges(duration: float, silences: list[tuple[float, float]], least: float = 8.0, ideal: float = 20.0, most: float = 30.0, shortest: float = 0.1) -> list[tuple[float, float]]:
    """Ranges of audio of at most ``most`` seconds, cut in the middle of the silence (start, end) nearest to ``ideal``, or there."""
    middles = [(a + b) / 2 for a, b in silences]
    edges, at = [0.0], 0.0
    while duration - at > most:
        fits = [m for m in middles if at + least <= m <= at + most]
        at = min(fits, key=lambda m: abs(m - at - ideal)) if fits else at + ideal
        edges.append(at)
    ranges = [(a, b) for a, b in zip(edges, [*edges[1:], duration]) if b - a >= shortest]
    if len(ranges) > 1 and ranges[-1][1] - ranges[-1][0] < least:
        (a, _), (_, b) = ranges[-2:]
        ranges[-2:] = [(a, b)]
    return ranges


def _scan(rows: DataFrame, run: Callable[..., list[tuple[float, ...]]], names: list[str]) -> DataFrame:
    """``run`` over each row (a video with its lists), PART rows as Python objects at a time; nothing is shuffled."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), PART):
                part = batch.slice(at, PART)
                out = [(i, *x) for i, r in enumerate(part.to_pandas().itertuples(index=False)) for x in run(r)]
                ids = part["video_id"].take(pa.array([x[0] for x in out], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[k] for x in out], pa.float64()) for k in range(1, len(names) + 1))], ["video_id", *names])

    kind = rows.schema["video_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"video_id {kind}, " + ", ".join(f"{n} double" for n in names))


def acoustic_times(videos: DataFrame, pause: float = PAUSE) -> DataFrame:
    """(video_id, time) of videos (video_id, n_lines, duration, silences array<struct<end, duration>>)."""
    rows = videos.select("video_id", "n_lines", "duration", F.filter("silences", lambda s: s["duration"] >= pause).alias("silences"))
    return _scan(rows, lambda r: [(t,) for t in pause_cuts(int(r.n_lines), float(r.duration), [(s["end"], s["duration"]) for s in r.silences])], ["time"])


def semantic_times(videos: DataFrame) -> DataFrame:
    """(video_id, time) of videos (video_id, duration, cues array<double>, depths array<struct<time, depth>>, threshold)."""
    rows = videos.select("video_id", "duration", "cues", "depths", "threshold")
    return _scan(rows, lambda r: [(t,) for t in semantic_cuts(float(r.duration), [float(t) for t in r.cues], [(d["time"], d["depth"]) for d in r.depths], float(r.threshold))], ["time"])


def chunk_plan(videos: DataFrame) -> DataFrame:
    """(video_id, start, end) of videos (video_id, duration, silences array<struct<start, end>>)."""
    rows = videos.select("video_id", "duration", "silences")
    return _scan(rows, lambda r: chunk_ranges(float(r.duration), [(s["start"], s["end"]) for s in r.silences]), ["start", "end"])


def parse_silences(log: DataFrame) -> DataFrame:
    """(video_id, start, end, duration) from log lines (video_id, line, text) of a silence detector.

    An end without a start before it starts at end - duration; starts are not below 0.
    """
    number = r"(-?\d+(?:\.\d+)?)"
    begin = F.nullif(F.regexp_extract("text", f"silence_start: {number}", 1), F.lit("")).cast("double")
    end = F.nullif(F.regexp_extract("text", f"silence_end: {number}", 1), F.lit("")).cast("double")
    length = F.nullif(F.regexp_extract("text", rf"silence_duration: {number}", 1), F.lit("")).cast("double")
    rows = log.select("video_id", "line", begin.alias("_begin"), end.alias("end"), length.alias("duration")).filter("_begin is not null or end is not null")
    rows = rows.withColumn("_open", F.lag("_begin").over(_per_video())).filter("end is not null")
    start = F.greatest(F.coalesce("_open", F.col("end") - F.col("duration")), F.lit(0.0))
    return rows.select("video_id", start.alias("start"), "end", "duration")


# ---- strategies: lines with ``cut``, from lines (video_id, line, start, end, text) and videos (video_id, duration, silences)


def by_window(lines: DataFrame, videos: DataFrame, window: float = WINDOW) -> DataFrame:
    return fixed_cuts(lines, window)


def by_pauses(lines: DataFrame, videos: DataFrame, pause: float = PAUSE) -> DataFrame:
    """Cuts at pauses; ``silences`` is array<struct<end, duration>>, and without any a video is cut by its length alone."""
    counts = lines.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_lines"))
    return cuts_at(lines, acoustic_times(videos.join(counts, "video_id"), pause))


def block_depths(blocks: DataFrame) -> DataFrame:
    """(video_id, time, depth, threshold) at the start of each block (lines with ``embedding``) but the first."""
    timed = blocks.select("video_id", "line", "embedding", F.lead("start").over(_per_video()).alias("time"))
    depths = valley_depth(smoothed(adjacent_similarity(timed)))
    w = W.partitionBy("video_id")
    return depths.select("video_id", "time", "depth", (F.avg("depth").over(w) + DEPTH_K * F.stddev_pop("depth").over(w)).alias("threshold"))


def by_topic(lines: DataFrame, videos: DataFrame, patterns: CuePatterns = CHINESE) -> DataFrame:
    """Sentences, with cuts at cues in sentences and at dips of the likeness of neighbouring lines, which have an ``embedding``.

    A video of one line is not cut.
    """
    order = F.row_number().over(W.partitionBy("video_id").orderBy("line", "part")) - 1
    sentences = split_sentences(lines).withColumn("line", order).drop("part")
    depth = block_depths(lines).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("time", "depth"))).alias("depths"), F.first("threshold").alias("threshold"))
    cues = detect_cues(sentences, patterns).groupBy("video_id").agg(F.array_sort(F.collect_list("time")).alias("cues"))
    found = videos.select("video_id", "duration").join(depth, "video_id").join(cues, "video_id", "left")
    return cuts_at(sentences, semantic_times(found.withColumn("cues", F.coalesce("cues", F.array().cast("array<double>")))))


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"fixed": by_window, "acoustic": by_pauses, "semantic": by_topic}


def strategy(name: str) -> Callable[..., DataFrame]:
    if name not in STRATEGIES:
        raise ValueError(f"no segmentation strategy {name!r}; there are: {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[name]


def segmented(name: str, lines: DataFrame, videos: DataFrame, **how) -> DataFrame:
    """Topic segments of the strategy of that name: (video_id, segment, start_time, end_time, n_lines, text)."""
    return build_segments(strategy(name)(lines, videos, **how), videos)


def replayed(name: str, lines: DataFrame, videos: DataFrame, references: DataFrame, **how) -> DataFrame:
    """Segmentation again from stored lines: (video_id, duration, ref, hyp), hyp the boundaries (two decimals, without 0).

    Pauses are not stored, so there are none; a video (video_id, duration) without a duration ends with its last line.
    references: (video_id, ref); videos without any have an empty list.
    """
    ends = lines.groupBy("video_id").agg(F.max_by("end", "line").alias("_end"))
    silences = F.array().cast("array<struct<end:double,duration:double>>")
    known = ends.join(videos.select("video_id", "duration"), "video_id", "left").select("video_id", F.coalesce("duration", "_end").alias("duration"), silences.alias("silences"))
    cuts = segmented(name, lines, known, **how).groupBy("video_id").agg(F.array_sort(F.collect_list(F.when(F.col("segment") > 0, F.floor(F.col("start_time") * 100 + 0.5) / 100))).alias("hyp"))
    none = F.array().cast("array<double>")
    return known.drop("silences").join(cuts, "video_id").join(references.select("video_id", "ref"), "video_id", "left").select("video_id", "duration", F.coalesce("ref", none).alias("ref"), "hyp")
