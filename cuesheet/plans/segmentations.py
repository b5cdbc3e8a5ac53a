"""Segmentation queries: conversations are timed lines, each hundred of embeddings in the order of their ids a series."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import cues as c
from ..operators import evaluation as e
from ..operators import segmentation as s
from ..sources.folders import new_folder
from ..sources.tables import lines, load, replace_rows, replaced_table, segments
from . import query

LINES = "lines AS (SELECT conv_id AS video_id, turn AS line, text, (sum(length(text)) OVER w - length(text)) / 10.0 AS start, sum(length(text)) OVER w / 10.0 AS stop FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))"
SIMS = "sims AS (SELECT vec_id // 100 AS video_id, vec_id AS line, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(lead(embedding) OVER (PARTITION BY vec_id // 100 ORDER BY vec_id) AS DOUBLE[])) AS sim FROM embeddings), ok AS (SELECT * FROM sims WHERE sim IS NOT NULL), smooth AS (SELECT *, avg(sim) OVER (PARTITION BY video_id ORDER BY line ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth FROM ok)"
#: Depths are compared on integers: similarities in millionths, so that both sides see the same ties.
DEPTH = f"{SIMS}, x AS (SELECT video_id, line, CAST(round(smooth * 1000000) AS BIGINT) AS x FROM smooth), b AS (SELECT *, CASE WHEN lag(x) OVER w < x THEN 1 ELSE 0 END AS fall, CASE WHEN x > lead(x) OVER w THEN 1 ELSE 0 END AS rise FROM x WINDOW w AS (PARTITION BY video_id ORDER BY line)), runs AS (SELECT *, sum(fall) OVER (PARTITION BY video_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS l, coalesce(sum(rise) OVER (PARTITION BY video_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM b), depth AS (SELECT video_id, line, x, max(x) OVER (PARTITION BY video_id, l ORDER BY line ROWS UNBOUNDED PRECEDING) + max(x) OVER (PARTITION BY video_id, r ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 2 * x AS depth FROM runs)"
FIXED = f"{LINES}, b AS (SELECT *, CAST(floor(start / 60) AS BIGINT) AS b FROM lines), cuts AS (SELECT *, CASE WHEN b <> lag(b) OVER (PARTITION BY video_id ORDER BY line) THEN 1 ELSE 0 END AS cut FROM b), seg AS (SELECT *, sum(cut) OVER (PARTITION BY video_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS segment FROM cuts)"


def _video(number):
    """A hundred vectors are a video: no group grows with the table."""
    return F.floor(F.col(number) / 100).alias("video_id")


def series(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select(_video("vec_id"), F.col("vec_id").alias("line"), "embedding")


@query(f"WITH {SIMS} SELECT video_id, line, round(sim, 6) AS sim FROM ok")
def adjacent_cosine(spark, sf_dir):
    return s.adjacent_similarity(series(spark, sf_dir)).select("video_id", "line", F.round("sim", 6).alias("sim"))


@query(f"WITH {SIMS} SELECT video_id, line, round(smooth, 6) AS smooth FROM smooth")
def smoothed_similarity(spark, sf_dir):
    return s.smoothed(s.adjacent_similarity(series(spark, sf_dir))).select("video_id", "line", F.round("smooth", 6).alias("smooth"))


def depths(spark, sf_dir):
    smooth = s.smoothed(s.adjacent_similarity(series(spark, sf_dir)))
    return s.valley_depth(smooth.select("video_id", "line", F.round(F.col("smooth") * 1000000).cast("long").alias("smooth")))


@query(f"WITH {DEPTH} SELECT video_id, line, CAST(depth AS BIGINT) AS depth FROM depth")
def valley_depth(spark, sf_dir):
    return depths(spark, sf_dir).select("video_id", "line", "depth")


@query(f"WITH {DEPTH} SELECT video_id, line, CAST(depth AS BIGINT) AS depth FROM (SELECT *, avg(depth) OVER (PARTITION BY video_id) + 0.8 * stddev_pop(depth) OVER (PARTITION BY video_id) AS t FROM depth) WHERE depth >= t")
def depth_candidates(spark, sf_dir):
    return s.depth_candidates(depths(spark, sf_dir)).select("video_id", "line", "depth")


@query(f"WITH {FIXED} SELECT video_id, CAST(segment AS BIGINT) AS segment, count(*) AS n_lines, round(min(start), 1) AS start_time, round(max(stop), 1) AS end_time FROM seg GROUP BY video_id, segment")
def fixed_window_segments(spark, sf_dir):
    out = s.build_segments(s.fixed_cuts(lines(spark, sf_dir)))
    return out.select("video_id", "segment", "n_lines", F.round("start_time", 1).alias("start_time"), F.round("end_time", 1).alias("end_time"))


SEGMENT_BUILD = f"WITH {FIXED} SELECT video_id, CAST(segment AS BIGINT) AS segment, md5(string_agg(text, '' ORDER BY line)) AS text_md5, CAST(CAST(min(start) AS DECIMAL(10,2)) AS DOUBLE) AS start_time FROM seg GROUP BY video_id, segment"


@query(SEGMENT_BUILD)
def segment_build(spark, sf_dir):
    out = s.stored_times(s.build_segments(s.fixed_cuts(lines(spark, sf_dir))))
    return out.select("video_id", "segment", F.md5("text").alias("text_md5"), F.col("start_time").cast("double").alias("start_time"))


@query(SEGMENT_BUILD)
def replaced_segments(spark, sf_dir):
    """Segments as a table by video: written wrong, then replaced by all videos, then by every third again, which changes nothing."""
    path = new_folder(spark, "segments")
    rows = s.stored_times(s.build_segments(s.fixed_cuts(lines(spark, sf_dir))))
    replace_rows(rows.withColumn("text", F.lit("?")), path, by=["video_id"])
    replace_rows(rows, path, by=["video_id"])
    replace_rows(rows.filter("video_id % 3 = 0"), path, by=["video_id"])
    return replaced_table(spark, path, rows.schema).select("video_id", "segment", F.md5("text").alias("text_md5"), F.col("start_time").cast("double").alias("start_time"))


@query("WITH r AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN value WHEN 'error' THEN -value END AS a, CASE WHEN event_type = 'click' THEN value END AS b FROM events WHERE event_type IN ('view', 'error', 'click')), l AS (SELECT *, lag(a) OVER (PARTITION BY user_id ORDER BY event_id) AS opened FROM r) SELECT user_id AS video_id, round(greatest(coalesce(opened, b - 1.5), 0.0), 6) AS start, b AS \"end\", CAST(1.5 AS DOUBLE) AS duration FROM l WHERE b IS NOT NULL")
def silence_log(spark, sf_dir):
    """Events as the log of a silence detector: views and errors open a silence, clicks end one, the rest is noise."""
    kind, value = F.col("event_type"), F.col("value").cast("string")
    text = F.when(kind == "view", F.concat(F.lit("[x] silence_start: "), value)).when(kind == "error", F.concat(F.lit("silence_start: -"), value)).when(kind == "click", F.concat(F.lit("silence_end: "), value, F.lit(" | silence_duration: 1.5"))).otherwise("frame=1")
    log = load(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("line"), text.alias("text"))
    return s.parse_silences(log).withColumn("start", F.round("start", 6))


@query(f"WITH {LINES} SELECT video_id, line, round(start, 1) AS start_time, round(stop, 1) AS end_time FROM lines")
def sentence_offsets(spark, sf_dir):
    return lines(spark, sf_dir).select("video_id", "line", F.round("start", 1).alias("start_time"), F.round("end", 1).alias("end_time"))


_FOLD = "list_reduce(list_transform(pieces, lambda piece: struct_pack(done := CAST([] AS VARCHAR[]), rest := piece)), lambda acc, item: CASE WHEN length(acc.rest || item.rest) >= 6 THEN struct_pack(done := list_append(acc.done, acc.rest || item.rest), rest := '') ELSE struct_pack(done := acc.done, rest := acc.rest || item.rest) END, struct_pack(done := CAST([] AS VARCHAR[]), rest := ''))"


@query(f"WITH {LINES}, p AS (SELECT *, regexp_extract_all(text, '[^。！？!?；;，,]*[。！？!?；;，,]|[^。！？!?；;，,]+') AS pieces FROM lines), f AS (SELECT *, CASE WHEN len(pieces) > 1 THEN {_FOLD} END AS x FROM p), g AS (SELECT video_id, line, start, stop, length(text) AS n, CASE WHEN x IS NULL THEN [text] WHEN len(x.done) = 0 THEN [x.rest] WHEN x.rest = '' THEN x.done ELSE list_append(x.done[:-2], x.done[-1] || x.rest) END AS parts FROM f), e AS (SELECT video_id, line, start, stop, n, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS part FROM g), c AS (SELECT *, sum(length(text)) OVER (PARTITION BY video_id, line ORDER BY part) AS upto FROM e) SELECT video_id, line, CAST(part AS INTEGER) AS part, round(start + (stop - start) * (upto - length(text)) / greatest(n, 1), 6) AS start, round(start + (stop - start) * upto / greatest(n, 1), 6) AS \"end\", text FROM c")
def sentence_split(spark, sf_dir):
    return s.split_sentences(lines(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("start", "end")})


#: Stand-ins for the languages of the test tables.
STAND_IN = c.CuePatterns(hard="the th|que la|von der", gated="heer|tion le|ung der", closer="thst|eau|lich", closing="er the\\.|de la\\.|und die\\.")
CUES = f"{LINES}, f AS (SELECT *, last_value(CASE WHEN regexp_matches(text, 'thst|eau|lich') THEN start END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS closed, lag(regexp_matches(text, 'er the\\.|de la\\.|und die\\.')) OVER (PARTITION BY video_id ORDER BY line) AS ended, lag(start) OVER (PARTITION BY video_id ORDER BY line) IS NULL AS first FROM lines), k AS (SELECT video_id, line, start AS time, CASE WHEN ended THEN 'CLOSING' WHEN regexp_matches(text, 'the th|que la|von der') THEN 'HARD' WHEN regexp_matches(text, 'heer|tion le|ung der') AND start - closed <= 20 THEN 'GATED' END AS kind FROM f WHERE NOT first), cand AS (SELECT * FROM k WHERE kind IS NOT NULL)"


@query(f"WITH {CUES} SELECT video_id, line, round(time, 1) AS time, kind FROM cand")
def cue_gate(spark, sf_dir):
    return c.cue_candidates(lines(spark, sf_dir), STAND_IN).withColumn("time", F.round("time", 1))


@query(f"WITH {CUES}, n AS (SELECT *, lead(time) OVER (PARTITION BY video_id ORDER BY line) AS next FROM cand) SELECT video_id, line, round(time, 1) AS time, kind FROM n WHERE next IS NULL OR next - time > 15")
def cue_cluster(spark, sf_dir):
    return c.detect_cues(lines(spark, sf_dir), STAND_IN).withColumn("time", F.round("time", 1))


def silences(spark, sf_dir):
    """Gaps between a user's events, thousands of seconds as seconds: (video_id, start, end, duration)."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e9
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "ts", (t - F.min(t).over(W.partitionBy("user_id"))).alias("end"))
    rows = rows.withColumn("start", F.lag("end").over(w)).filter("start is not null")
    return rows.select(F.col("user_id").alias("video_id"), "start", "end", (F.col("end") - F.col("start")).alias("duration"))


def _videos(spark, sf_dir):
    pause = F.struct("start", "end", "duration")
    return silences(spark, sf_dir).groupBy("video_id").agg(F.array_sort(F.collect_list(pause)).alias("silences"), F.max("end").alias("duration"), F.count(F.lit(1)).alias("n_lines"))


EVENTS = "ev AS (SELECT user_id, event_id, ts, epoch_us(ts) / 1e9 - min(epoch_us(ts) / 1e9) OVER (PARTITION BY user_id) AS stop FROM events), gaps AS (SELECT user_id AS video_id, lag(stop) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS start, stop FROM ev), pauses AS (SELECT *, stop - start AS length FROM gaps WHERE start IS NOT NULL), videos AS (SELECT video_id, max(stop) AS duration, list(struct_pack(e := stop, m := (start + stop) / 2, n := length) ORDER BY start, stop) AS silences, count(*) AS n_lines FROM pauses GROUP BY video_id)"


@query(f"WITH RECURSIVE {EVENTS}, long AS (SELECT video_id, duration, list_filter(silences, lambda p: p.n >= 30) AS s FROM videos WHERE n_lines > 1), cut AS (SELECT video_id, duration, s, CAST(0 AS DOUBLE) AS time FROM long UNION ALL SELECT video_id, duration, s, coalesce(list_filter(s, lambda p: p.e >= time + 30 AND p.e <= time + 300 AND p.n = list_max(list_transform(list_filter(s, lambda q: q.e >= time + 30 AND q.e <= time + 300), lambda q: q.n)))[1].e, time + 300) FROM cut WHERE duration - time > 300) SELECT video_id, round(time, 6) AS time FROM cut WHERE time > 0")
def acoustic_segments(spark, sf_dir):
    return s.acoustic_times(_videos(spark, sf_dir), pause=30.0).withColumn("time", F.round("time", 6))


@query(f"WITH RECURSIVE {EVENTS}, cut AS (SELECT video_id, duration, silences AS s, 0 AS k, CAST(0 AS DOUBLE) AS time FROM videos UNION ALL SELECT video_id, duration, s, k + 1, coalesce(list_filter(s, lambda p: p.m >= time + 8 AND p.m <= time + 30 AND abs(p.m - time - 20) = list_min(list_transform(list_filter(s, lambda q: q.m >= time + 8 AND q.m <= time + 30), lambda q: abs(q.m - time - 20))))[1].m, time + 20) FROM cut WHERE duration - time > 30), r AS (SELECT video_id, time AS a, coalesce(lead(time) OVER (PARTITION BY video_id ORDER BY k), duration) AS b FROM cut), ok AS (SELECT *, count(*) OVER v AS n, row_number() OVER (PARTITION BY video_id ORDER BY a) AS i, lead(b - a) OVER w AS after, lead(b) OVER w AS upto FROM r WHERE b - a >= 0.1 WINDOW v AS (PARTITION BY video_id), w AS (PARTITION BY video_id ORDER BY a)) SELECT video_id, round(a, 6) AS start, round(CASE WHEN i = n - 1 AND after < 8 THEN upto ELSE b END, 6) AS \"end\" FROM ok WHERE NOT (n > 1 AND i = n AND b - a < 8)")
def chunk_plan(spark, sf_dir):
    return s.chunk_plan(_videos(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("start", "end")})


SCAN = "e AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t, kind, depth) AS i FROM events_), v AS (SELECT video_id, list(t ORDER BY i) AS times FROM e GROUP BY video_id), scan AS (SELECT v.video_id, times, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS base, CAST(NULL AS DOUBLE) AS bt, CAST(NULL AS BIGINT) AS bd, CAST(NULL AS DOUBLE) AS cut FROM v UNION ALL SELECT video_id, times, i, coalesce(cut, base), CASE WHEN cut IS NULL THEN nt END, CASE WHEN cut IS NULL THEN nd END, cut FROM (SELECT video_id, times, i, base, nt, nd, CASE WHEN kind = 0 AND t - base >= 30 THEN t WHEN t - base >= 300 THEN coalesce(nt, list_filter(times, lambda x: x > base + 30 AND x <= t AND abs(x - base - 300) = list_min(list_transform(list_filter(times, lambda y: y > base + 30 AND y <= t), lambda y: abs(y - base - 300))))[1]) END AS cut FROM (SELECT s.video_id, s.times, e.i, s.base, e.t, e.kind, CASE WHEN better THEN e.t ELSE s.bt END AS nt, CASE WHEN better THEN e.depth ELSE s.bd END AS nd FROM (SELECT scan.*, e.kind = 1 AND e.t - base >= 30 AND e.depth >= e.threshold AND (bd IS NULL OR e.depth > bd) AS better FROM scan JOIN e ON e.video_id = scan.video_id AND e.i = scan.i + 1) s JOIN e ON e.video_id = s.video_id AND e.i = s.i + 1))), cuts AS (SELECT video_id, cut AS time, lead(cut) OVER (PARTITION BY video_id ORDER BY cut) IS NULL AS last FROM scan WHERE cut IS NOT NULL)"


@query(f"WITH RECURSIVE {DEPTH}, d AS (SELECT video_id, depth, row_number() OVER (PARTITION BY video_id ORDER BY line) * 20.0 AS t, avg(depth) OVER (PARTITION BY video_id) + 0.8 * stddev_pop(depth) OVER (PARTITION BY video_id) AS threshold FROM depth), events_ AS (SELECT video_id, CAST(t AS DOUBLE) AS t, 1 AS kind, CAST(depth AS BIGINT) AS depth, threshold FROM d UNION ALL SELECT video_id, CAST(t AS DOUBLE), 0, 0, threshold FROM d WHERE t % 340 = 0), {SCAN}, n AS (SELECT video_id, max(t) + 20 AS duration FROM d GROUP BY video_id) SELECT video_id, time FROM cuts JOIN n USING (video_id) WHERE NOT (last AND duration - time < 30)")
def semantic_segments(spark, sf_dir):
    """The scan alone. Vectors of a video as blocks of 20 s; a block whose number is divisible by 17 opens with a cue."""
    w = W.partitionBy("video_id")
    rows = depths(spark, sf_dir).withColumns({"t": F.row_number().over(w.orderBy("line")) * 20.0, "threshold": F.avg("depth").over(w) + 0.8 * F.stddev_pop("depth").over(w)})
    cue = F.when(F.col("t") % 340 == 0, F.col("t"))
    item = F.struct(F.col("t").alias("time"), F.col("depth").cast("double").alias("depth"))
    videos = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(item)).alias("depths"), F.array_sort(F.collect_list(cue)).alias("cues"), F.first("threshold").alias("threshold"), (F.max("t") + 20).alias("duration"))
    return s.semantic_times(videos)


def blocks(spark, sf_dir):
    """Documents with vectors as timed lines of their video, ten characters a second: (video_id, line, start, end, text, embedding)."""
    rows = segments(spark, sf_dir).filter("embedding is not null").select(_video("segment_index"), F.col("segment_index").alias("line"), F.coalesce("text_content", F.lit("")).alias("text"), "embedding")
    upto = F.sum(F.length("text")).over(W.partitionBy("video_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("video_id", "line", ((upto - F.length("text")) / 10.0).alias("start"), (upto / 10.0).alias("end"), "text", "embedding")


def _timed(rows):
    """Videos of lines, with a pause before every eleventh line."""
    pause = F.when(F.col("line") % 11 == 0, F.struct(F.col("start").alias("end"), F.lit(1.5).alias("duration")))
    return rows.groupBy("video_id").agg(F.max("end").alias("duration"), F.array_sort(F.collect_list(pause)).alias("silences"))


@query()
def semantic_strategy(spark, sf_dir):
    """The whole strategy: sentences, cues, depths, cuts and segments; plain Python in tests."""
    rows = blocks(spark, sf_dir)
    out = s.stored_times(s.segmented("semantic", rows, _timed(rows), patterns=STAND_IN))
    return out.select("video_id", "segment", F.col("start_time").cast("double").alias("start_time"), F.col("end_time").cast("double").alias("end_time"), F.md5("text").alias("text_md5"))


@query(f"WITH RECURSIVE {LINES}, long AS (SELECT video_id, max(stop) AS duration, list(struct_pack(e := start, n := 1.5) ORDER BY start) FILTER (WHERE line % 11 = 0) AS s, list(start ORDER BY line) AS starts, count(*) AS n FROM lines GROUP BY video_id), cut AS (SELECT video_id, duration, s, CAST(0 AS DOUBLE) AS time FROM long WHERE n > 1 UNION ALL SELECT video_id, duration, s, coalesce(list_filter(s, lambda p: p.e >= time + 30 AND p.e <= time + 300)[1].e, time + 300) FROM cut WHERE duration - time > 300), marks AS (SELECT DISTINCT cut.video_id, len(list_filter(starts, lambda x: x < time)) AS i FROM cut JOIN long USING (video_id) WHERE time > 0), l AS (SELECT lines.*, row_number() OVER (PARTITION BY video_id ORDER BY line) - 1 AS i FROM lines), seg AS (SELECT l.*, sum(CASE WHEN marks.i IS NULL OR l.i = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY l.video_id ORDER BY l.line ROWS UNBOUNDED PRECEDING) AS segment FROM l LEFT JOIN marks ON marks.video_id = l.video_id AND marks.i = l.i) SELECT video_id, CAST(segment AS BIGINT) AS segment, count(*) AS n_lines, round(min(start), 1) AS start_time, md5(string_agg(text, '' ORDER BY line)) AS text_md5 FROM seg GROUP BY video_id, segment")
def acoustic_strategy(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return s.segmented("acoustic", rows, _timed(rows)).select("video_id", "segment", "n_lines", F.round("start_time", 1).alias("start_time"), F.md5("text").alias("text_md5"))


@query(f"WITH {FIXED}, ends AS (SELECT video_id, max(stop) AS duration FROM lines GROUP BY video_id), hyp AS (SELECT video_id, round(min(start), 2) AS h FROM seg WHERE segment > 0 GROUP BY video_id, segment), ref AS (SELECT video_id, CAST(unnest(range(100, CAST(floor(duration) AS BIGINT), 100)) AS DOUBLE) AS r FROM ends WHERE duration > 100), found AS (SELECT video_id, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM hyp WHERE hyp.video_id = ref.video_id AND abs(h - r) <= 20)) AS hits FROM ref GROUP BY video_id), odd AS (SELECT video_id, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM ref WHERE hyp.video_id = ref.video_id AND abs(h - r) <= 20)) AS f FROM hyp GROUP BY video_id) SELECT video_id, coalesce(hits, 0) AS hits, coalesce(n - hits, 0) AS missed, coalesce(f, 0) AS false_cuts FROM ends LEFT JOIN found USING (video_id) LEFT JOIN odd USING (video_id)")
def segmentation_replay(spark, sf_dir):
    """Fixed windows again from stored lines, against boundaries every 100 s."""
    rows = lines(spark, sf_dir)
    ends = rows.groupBy("video_id").agg(F.max("end").alias("_end")).withColumn("_n", F.floor("_end").cast("int"))
    every = F.when(F.col("_n") > 100, F.sequence(F.lit(100), F.col("_n") - 1, F.lit(100)))
    refs = ends.select("video_id", F.coalesce(every, F.array().cast("array<int>")).cast("array<double>").alias("ref"))
    videos = ends.select("video_id", F.lit(None).cast("double").alias("duration"))
    return e.boundary_hits(s.replayed("fixed", rows, videos, refs))
