"""Ingest queries: documents stand for uploads, conversations for audio chunks, orders for parts, lineitem for part lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..functions import vectors
from ..operators import ingest as i
from ..sources.tables import load
from . import query

VIDEOS = "videos AS (SELECT o_orderkey AS id, 'v' || o_orderkey AS video_id, 'c' || o_custkey AS tenant_id, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS status, o_orderdate AS updated_at, o_totalprice AS price FROM orders)"


def videos(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    key = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(key.alias("id"), F.concat(F.lit("v"), key).alias("video_id"), F.concat(F.lit("c"), "o_custkey").alias("tenant_id"), status.alias("status"), F.col("o_orderdate").alias("updated_at"), F.col("o_totalprice").alias("price"))


@query("SELECT md5(text) AS md5, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY md5(text)")
def dedup_md5(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("md5"))
    return i.first_by_content(rows)


@query("SELECT source AS tenant_id, md5(text) AS md5, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY ALL")
def dedup_md5_by_tenant(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("tenant_id"), F.md5("text").alias("md5"))
    return i.first_by_content(rows, within=("tenant_id",))


@query("WITH p AS (SELECT l_orderkey, md5(CAST(l_partkey AS VARCHAR)) AS a, md5(CAST(l_suppkey AS VARCHAR)) AS b FROM lineitem) SELECT md5(least(a, b) || ':' || greatest(a, b)) AS pair, count(*) AS n FROM p GROUP BY 1")
def pair_key(spark, sf_dir):
    a, b = (F.md5(F.col(n).cast("string")) for n in ("l_partkey", "l_suppkey"))
    return load(spark, sf_dir, "lineitem").select(x.pair_key(a, b).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def dedup_latest(spark, sf_dir):
    return i.latest(load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


CHUNKS = "chunks AS (SELECT conv_id AS video_id, turn AS chunk_index, role AS tenant_id, text FROM conversations)"


def chunks(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("chunk_index"), F.col("role").alias("tenant_id"), "text")


@query(f"WITH {CHUNKS}, new AS (SELECT video_id, chunk_index + 2 AS chunk_index, 'new' AS tenant_id, text || '+' AS text FROM chunks) SELECT coalesce(n.video_id, o.video_id) AS video_id, coalesce(n.chunk_index, o.chunk_index) AS chunk_index, coalesce(o.tenant_id, n.tenant_id) AS tenant_id, md5(CASE WHEN n.video_id IS NULL THEN o.text ELSE n.text END) AS text_md5 FROM chunks o FULL JOIN new n ON o.video_id = n.video_id AND o.chunk_index = n.chunk_index")
def upsert_merge(spark, sf_dir):
    old = chunks(spark, sf_dir)
    new = old.select("video_id", (F.col("chunk_index") + 2).alias("chunk_index"), F.lit("new").alias("tenant_id"), F.concat("text", F.lit("+")).alias("text"))
    return i.upsert(old, new, ["video_id", "chunk_index"], ["tenant_id"]).select("video_id", "chunk_index", "tenant_id", F.md5("text").alias("text_md5"))


@query(f"WITH {CHUNKS} SELECT video_id, chunk_index, tenant_id FROM chunks UNION ALL SELECT video_id, chunk_index + 2, 'new' FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM chunks d WHERE d.video_id = c.video_id AND d.chunk_index = c.chunk_index + 2)")
def seed_insert(spark, sf_dir):
    old = chunks(spark, sf_dir).drop("text")
    new = old.select("video_id", (F.col("chunk_index") + 2).alias("chunk_index"), F.lit("new").alias("tenant_id"))
    return i.insert_absent(old, new, ["video_id", "chunk_index"])


@query(f"WITH {CHUNKS} SELECT video_id, count(*) AS n FROM chunks WHERE video_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system' OR turn >= 5) GROUP BY video_id")
def delete_by_video(spark, sf_dir):
    gone = load(spark, sf_dir, "conversations").filter("role = 'system' or turn >= 5").select(F.col("conv_id").alias("video_id")).distinct()
    return i.without_videos(chunks(spark, sf_dir), gone).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))


@query("WITH plan AS (SELECT l_orderkey AS video_id, l_linenumber AS chunk_index, l_quantity AS start, l_quantity + 20 AS stop FROM lineitem), old AS (SELECT l_orderkey AS video_id, l_linenumber AS chunk_index, l_quantity + l_discount AS start, l_quantity + 20 + l_tax AS stop, l_returnflag AS text FROM lineitem WHERE l_linenumber <= 4) SELECT p.video_id, CAST(p.chunk_index AS BIGINT) AS chunk_index, coalesce(abs(o.start - p.start) <= 0.05 AND abs(o.stop - p.stop) <= 0.05 AND trim(o.text) <> '', false) AS reused FROM plan p LEFT JOIN old o ON o.video_id = p.video_id AND o.chunk_index = p.chunk_index")
def checkpoint_reuse(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem")
    key = [F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").cast("long").alias("chunk_index")]
    plan = rows.select(*key, F.col("l_quantity").alias("start"), (F.col("l_quantity") + 20).alias("end"))
    old = rows.filter("l_linenumber <= 4").select(*key, (F.col("l_quantity") + F.col("l_discount")).alias("start"), (F.col("l_quantity") + 20 + F.col("l_tax")).alias("end"), F.col("l_returnflag").alias("text"))
    return i.reusable_chunks(plan, old).select("video_id", "chunk_index", "reused")


@query("WITH got AS (SELECT l_orderkey AS upload_id, list_distinct(list(CAST(l_linenumber AS BIGINT))) AS g FROM lineitem WHERE l_discount > 0.01 GROUP BY l_orderkey), m AS (SELECT o_orderkey AS upload_id, list_filter(range(1, 8), lambda p: NOT list_contains(coalesce(g, []), p)) AS missing FROM orders LEFT JOIN got ON o_orderkey = upload_id) SELECT upload_id, CAST(7 - len(missing) AS BIGINT) AS received, array_to_string(missing, ',') AS missing, len(missing) = 0 AS complete FROM m")
def missing_parts(spark, sf_dir):
    parts = load(spark, sf_dir, "lineitem").filter("l_discount > 0.01").select(F.col("l_orderkey").alias("upload_id"), F.col("l_linenumber").alias("part"))
    totals = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("upload_id"), F.lit(7).alias("total"))
    return i.missing_parts(parts, totals).withColumn("missing", F.array_join(F.col("missing").cast("array<string>"), ","))


@query(f"WITH {VIDEOS}, c AS (SELECT 'v' || l_orderkey AS video_id, count(*) AS n, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS ch FROM lineitem GROUP BY l_orderkey) SELECT id, video_id, status, coalesce(n, 0) AS segment_count, coalesce(ch, '') AS chapters FROM videos LEFT JOIN c USING (video_id)")
def library_list(spark, sf_dir):
    skeletons = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("v"), "l_orderkey").alias("video_id"), F.col("l_linenumber").alias("segment_index"), F.col("l_quantity").alias("start_time"), F.col("l_tax").alias("end_time"), F.col("l_returnflag").alias("chapter_title"))
    out = i.library(videos(spark, sf_dir), skeletons)
    return out.select("id", "video_id", "status", "segment_count", F.array_join(F.transform("chapters", lambda c: c["segment_index"].cast("string")), ",").alias("chapters"))


@query(f"WITH {VIDEOS} SELECT id, video_id, status FROM videos WHERE status IN (0, 1) ORDER BY id")
def unfinished_scan(spark, sf_dir):
    return i.unfinished(videos(spark, sf_dir)).select("id", "video_id", "status")


@query(f"WITH {VIDEOS} SELECT id, video_id FROM videos WHERE video_id = 'v33' AND tenant_id = (SELECT 'c' || o_custkey FROM orders WHERE o_orderkey = 33)")
def owned_lookup(spark, sf_dir):
    v = videos(spark, sf_dir)
    row = v.filter("video_id = 'v33'").first()
    return i.owned(v, "v33", row["tenant_id"] if row else "").select("id", "video_id")


@query("SELECT conv_id AS video_id, count(*) AS n, min(turn) AS first_chunk, max(turn) AS last_chunk FROM conversations GROUP BY conv_id")
def count_by_video(spark, sf_dir):
    return load(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("video_id")).agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first_chunk"), F.max("turn").alias("last_chunk"))


@query("SELECT lang AS video_id, doc_id AS segment_index, n_chars FROM documents ORDER BY lang, doc_id")
def skeleton_scan(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(F.col("lang").alias("video_id"), F.col("doc_id").alias("segment_index"), "n_chars").orderBy("video_id", "segment_index")


@query(f"WITH {VIDEOS}, t AS (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE status END AS status, price > 1000 AS has_source, id % 3 = 0 AS orphan FROM videos) SELECT id, CASE WHEN status IS NULL THEN 'new' WHEN status = 3 AND NOT has_source THEN 'refinalise' WHEN status = 3 THEN 'retry' WHEN status <> 2 AND orphan THEN 'orphan' ELSE 'duplicate' END AS route FROM t")
def upload_route(spark, sf_dir):
    rows = videos(spark, sf_dir).select("id", F.when(F.col("id") % 7 != 0, F.col("status")).alias("status"), (F.col("price") > 1000).alias("has_source"), (F.col("id") % 3 == 0).alias("orphan"))
    return rows.select("id", i.upload_route().alias("route"))


@query(f"WITH {VIDEOS} SELECT CASE WHEN status = 2 THEN 'done' WHEN status = 3 THEN 'failed' ELSE 'processing' END AS state, count(*) AS n FROM videos GROUP BY 1")
def status_counts(spark, sf_dir):
    return videos(spark, sf_dir).groupBy(i.status_text(F.col("status")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '[^a-zA-Z0-9._\\-一-龥]', '_', 'g') AS name, lower(regexp_extract(url, '(\\.[^./\\\\]+)$', 1)) AS ext FROM pages WHERE trim(regexp_extract(url, '([^/\\\\]*)$', 1)) <> '' UNION ALL SELECT page_id, 'video.mp4', lower(regexp_extract(url, '(\\.[^./\\\\]+)$', 1)) FROM pages WHERE trim(regexp_extract(url, '([^/\\\\]*)$', 1)) = ''")
def safe_filenames(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", x.safe_filename(F.col("url")).alias("name"), x.extension(F.col("url")).alias("ext"))


@query("SELECT event_id, CASE WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') ELSE lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock FROM (SELECT event_id, CAST(greatest(round(value * 40), 0) AS BIGINT) AS s FROM events)")
def clock_format(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", x.clock(F.col("value") * 40).alias("clock"))


def _tracks(spark, sf_dir):
    """Lines of an order as tracks of an upload: odd lines are pictures, even ones sounds."""
    odd = F.col("l_linenumber") % 2 == 1
    name = F.concat(F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber").cast("string"), F.lit(".m4s"))
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("place"), name.alias("name"), F.col("l_quantity").alias("duration"), odd.alias("has_video"), (~odd).alias("has_audio"), F.lit(None).cast("string").alias("error"))


UNREAD = "name LIKE 'R%'"
#: Pictures choose in turn, the longest first, from lists of sounds in order of preference; {unread} tells tracks that can't be read.
PAIRED = """t AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY place, name, dur) AS i FROM (SELECT l_orderkey AS b, l_linenumber AS place, l_returnflag || l_linestatus || l_linenumber || '.m4s' AS name, lower(l_returnflag || l_linestatus || l_linenumber) AS stem, l_quantity AS dur, l_linenumber % 2 = 1 AS pic FROM lineitem) WHERE dur > 0 AND NOT {unread}),
near AS (SELECT v.b, v.i AS v, a.i AS a, abs(v.dur - a.dur) / greatest(v.dur, a.dur) AS d, len(list_filter(range(1, least(length(v.stem), length(a.stem)) + 1), lambda n: v.stem[:n] = a.stem[:n])) / greatest(length(v.stem), length(a.stem)) AS likeness FROM t v JOIN t a ON v.b = a.b AND v.pic AND NOT a.pic),
wish AS (SELECT b, v, list(a ORDER BY d, likeness DESC, a) AS a FROM near WHERE d <= 0.1 GROUP BY b, v),
turns AS (SELECT t.b, t.i AS v, wish.a, row_number() OVER (PARTITION BY t.b ORDER BY t.dur DESC, t.i) AS k FROM t JOIN wish ON wish.b = t.b AND wish.v = t.i),
walk AS (SELECT b, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS v, CAST(NULL AS BIGINT) AS a FROM (SELECT DISTINCT b FROM turns) UNION ALL SELECT b, k, CASE WHEN a IS NULL THEN taken ELSE list_append(taken, a) END, v, a FROM (SELECT w.b, turns.k, w.taken, turns.v, list_filter(turns.a, lambda x: NOT list_contains(w.taken, x))[1] AS a FROM walk w JOIN turns ON turns.b = w.b AND turns.k = w.k + 1)),
paired AS (SELECT walk.b, p.name AS picture, s.name AS sound, p.place AS picture_place, s.place AS sound_place, near.d FROM walk JOIN t p ON p.b = walk.b AND p.i = walk.v JOIN t s ON s.b = walk.b AND s.i = walk.a JOIN near ON near.b = walk.b AND near.v = walk.v AND near.a = walk.a)"""


@query(f"WITH RECURSIVE {PAIRED.format(unread='false')} SELECT b AS batch_id, picture, sound, round(d, 6) AS drift FROM paired")
def track_pairing(spark, sf_dir):
    return i.pair_tracks(_tracks(spark, sf_dir)).withColumn("drift", F.round("drift", 6))


@query(f"WITH RECURSIVE {PAIRED.format(unread=UNREAD)}, ends AS (SELECT b, picture_place AS place, sound_place AS other FROM paired UNION ALL SELECT b, sound_place, picture_place FROM paired) SELECT l_orderkey AS batch_id, CAST(l_linenumber AS INTEGER) AS place, CASE WHEN other IS NOT NULL THEN 'pair' WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linenumber % 2 = 1 THEN 'no sound' ELSE 'alone' END AS outcome, CAST(other AS INTEGER) AS other FROM lineitem LEFT JOIN ends ON b = l_orderkey AND place = l_linenumber WHERE other IS NULL OR l_linenumber < other")
def batch_groups(spark, sf_dir):
    """Groups of those tracks, where returned lines cannot be read."""
    tracks = _tracks(spark, sf_dir).withColumn("error", F.when(F.col("name").startswith("R"), "unreadable"))
    return i.batch_groups(tracks)


@query(f"WITH {VIDEOS} SELECT id, video_id, tenant_id, status FROM videos WHERE video_id = 'v33'")
def point_lookup(spark, sf_dir):
    return i.by_video(videos(spark, sf_dir), "v33").select("id", "video_id", "tenant_id", "status")


@query(f"WITH {VIDEOS} SELECT id, video_id, status FROM videos ORDER BY id DESC")
def library_scan(spark, sf_dir):
    return i.newest_first(videos(spark, sf_dir)).select("id", "video_id", "status")


@query("SELECT c_custkey AS id, c_name AS username FROM customer WHERE c_name = (SELECT c_name FROM customer WHERE c_custkey = 7)")
def user_by_name(spark, sf_dir):
    users = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))
    row = users.filter("id = 7").first()
    return i.user_by_name(users, row["username"] if row else "")


@query(f"WITH {CHUNKS} SELECT video_id, chunk_index, md5(text) AS text_md5 FROM chunks WHERE video_id = 3 ORDER BY chunk_index")
def chunk_scan(spark, sf_dir):
    return i.ordered_scan(chunks(spark, sf_dir), 3, "chunk_index").select("video_id", "chunk_index", F.md5("text").alias("text_md5"))


@query("SELECT doc_id AS segment_index, lang AS video_id, n_chars FROM documents WHERE lang = 'en' ORDER BY doc_id")
def segment_scan(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("segment_index"), F.col("lang").alias("video_id"), "n_chars")
    return i.ordered_scan(rows, "en", "segment_index")


@query("SELECT l_orderkey AS upload_id, count(*) AS parts, CAST(sum(l_partkey) AS BIGINT) AS bytes FROM lineitem GROUP BY l_orderkey")
def upload_sizes(spark, sf_dir):
    return i.upload_sizes(load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("upload_id"), F.col("l_partkey").alias("size")))


@query("SELECT round(avg(CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END), 6) AS mean_cost, max(CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END) AS max_cost, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) > 0.3 * count(*) AS abort FROM lineitem")
def chunk_costs(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 3 == 0).alias("reused"), F.col("l_quantity").alias("cost"), (F.col("l_returnflag") == "R").alias("failed"))
    return i.cost_summary(rows).withColumn("mean_cost", F.round("mean_cost", 6))


@query(f"WITH {VIDEOS} SELECT id, 'now' AS found FROM videos WHERE status IN (0, 1) AND id % 4 <> 0 UNION ALL SELECT id, 'later' FROM videos WHERE status IN (0, 1) AND id % 4 = 0 AND id % 8 <> 0 AND id % 12 <> 0")
def orphan_recovery(spark, sf_dir):
    """Locks are on ids divisible by 4; at the recheck on those divisible by 8, and those divisible by 12 are done."""
    rows = videos(spark, sf_dir)
    locked, still = rows.filter("id % 4 = 0"), rows.filter("id % 8 = 0")
    later = rows.withColumn("status", F.when(F.col("id") % 12 == 0, i.DONE).otherwise(F.col("status")))
    return i.orphans(rows, locked).select("id", F.lit("now").alias("found")).unionByName(i.orphans_later(rows, locked, later, still).select("id", F.lit("later").alias("found")))


@query(f"WITH {VIDEOS} SELECT DISTINCT 'v' || l_orderkey AS video_id FROM lineitem JOIN videos ON video_id = 'v' || l_orderkey WHERE status <> 2 AND l_orderkey % 5 <> 0")
def pipeline_tasks(spark, sf_dir):
    """Messages come more than once; videos with ids divisible by 5 are locked."""
    tasks = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("v"), "l_orderkey").alias("video_id"))
    rows = videos(spark, sf_dir)
    return i.needs_processing(tasks, rows, rows.filter("id % 5 = 0"))


@query("WITH f AS (SELECT l_orderkey AS id, l_partkey % 2 = 0 AS v1, l_partkey % 3 = 0 AS a1, l_suppkey % 2 = 0 AS v2, l_suppkey % 3 = 0 AS a2 FROM lineitem WHERE l_linenumber = 1) SELECT id, CASE WHEN v1 AND a1 THEN 'first' WHEN v2 AND a2 THEN 'second' WHEN v1 AND a2 THEN 'first+second' WHEN v2 AND a1 THEN 'second+first' WHEN a1 THEN 'first' WHEN a2 THEN 'second' ELSE 'no sound' END AS source FROM f")
def track_resolution(spark, sf_dir):
    even, third = lambda c: F.col(c) % 2 == 0, lambda c: F.col(c) % 3 == 0
    rows = load(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), even("l_partkey").alias("v1"), third("l_partkey").alias("a1"), even("l_suppkey").alias("v2"), third("l_suppkey").alias("a2"))
    return rows.select("id", i.source_of_two().alias("source"))


@query("WITH f AS (SELECT l_orderkey, string_agg('p' || l_partkey || '.mp4|' || (l_suppkey * 1000) || '|' || l_linenumber, '#' ORDER BY l_linenumber, 'p' || l_partkey || '.mp4', l_suppkey) AS raw, count(*) AS n, list(l_suppkey * 1000 ORDER BY l_linenumber, 'p' || l_partkey || '.mp4', l_suppkey)[1] AS size FROM lineitem GROUP BY l_orderkey), h AS (SELECT *, list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(raw, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: xor((h * 33) & 4294967295, c)) AS h FROM f) SELECT l_orderkey AS upload_id, 'sk_' || lower(to_base(h, 36)) || '_' || n || '_' || (size % 100000) AS key FROM h")
def session_keys(spark, sf_dir):
    item = F.struct(F.col("l_linenumber").alias("modified"), F.concat(F.lit("p"), "l_partkey", F.lit(".mp4")).alias("name"), (F.col("l_suppkey") * 1000).alias("size"))
    rows = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("upload_id")).agg(F.array_sort(F.collect_list(item)).alias("files"))
    return rows.select("upload_id", x.session_key(F.col("files")).alias("key"))


@query("SELECT o_orderkey AS id, regexp_full_match(o_orderstatus || o_orderpriority, '[A-Za-z0-9_-]{8,64}') AS key, regexp_full_match(o_orderstatus || '.' || o_orderkey, '[A-Za-z0-9_.-]{3,32}') AS name, regexp_full_match('up_' || o_orderkey || '0000000', 'up_[A-Za-z0-9]{8,32}') AS task FROM orders")
def validators(spark, sf_dir):
    key = F.concat("o_orderstatus", "o_orderpriority")
    name = F.concat_ws(".", F.col("o_orderstatus"), F.col("o_orderkey").cast("string"))
    task = F.concat(F.lit("up_"), "o_orderkey", F.lit("0000000"))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), x.valid(key, x.SESSION_KEY).alias("key"), x.valid(name, x.USERNAME).alias("name"), x.valid(task, x.UPLOAD_TASK).alias("task"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, to_json(struct_pack(task := user_id, stage := event_type)) AS message FROM events")
def json_columns(spark, sf_dir):
    rows = load(spark, sf_dir, "events")
    return rows.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.to_json(F.struct(F.col("user_id").alias("task"), F.col("event_type").alias("stage"))).alias("message"))


@query("SELECT l_orderkey AS id, l_linenumber AS line, CAST(ceil(l_partkey / 64.0) AS BIGINT) AS parts, CAST(l_partkey - (ceil(l_partkey / 64.0) - 1) * 64 AS BIGINT) AS last_size, round(abs(l_quantity - l_partkey) / greatest(l_quantity, l_partkey), 6) AS drift FROM lineitem")
def part_arithmetic(spark, sf_dir):
    size, part = F.col("l_partkey"), F.lit(64)
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), x.part_count(size, part).alias("parts"), x.last_part_size(size, part).cast("long").alias("last_size"), F.round(x.drift(F.col("l_quantity"), size.cast("double")), 6).alias("drift"))


@query("WITH n AS (SELECT c_custkey AS id, lower(c_name) AS a, lower(lead(c_name) OVER (ORDER BY c_custkey)) AS b FROM customer) SELECT id, round(len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[:i] = b[:i])) / greatest(length(a), length(b)), 6) AS likeness, CASE WHEN length(a) <= 10 THEN a ELSE a[:10] || '…' END AS snippet, CASE WHEN length(a) <= 8 THEN a ELSE a[-8:] END AS tail FROM n WHERE b IS NOT NULL AND NOT contains(a, '.') AND NOT contains(b, '.')")
def name_functions(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("a"))
    other = rows.select((F.col("id") - 1).alias("id"), F.col("a").alias("b"))
    return rows.join(other, "id").select("id", F.round(x.stem_similarity(F.col("a"), F.col("b")), 6).alias("likeness"), x.snippet(F.col("a"), 10).alias("snippet"), x.id_tail(F.col("a")).alias("tail"))


@query("SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 4) AS total FROM embeddings")
def vector_literals(spark, sf_dir):
    """Vectors printed as literals and parsed again."""
    back = vectors.parse_vector(vectors.print_vector(F.col("embedding")))
    return load(spark, sf_dir, "embeddings").select("vec_id", F.size(back).cast("long").alias("n"), F.round(F.aggregate(back, F.lit(0.0), lambda acc, v: acc + v.cast("double")), 4).alias("total"))


@query("SELECT doc_id, nullif(trim(regexp_replace(regexp_extract(trim(text, ' ')[:800], '^[^。！？!?.；;\\r\\n]*', 0), '[\\r\\n\"''“”‘’《》]', '', 'g'), ' ')[:50], '') AS title FROM documents")
def chapter_titles(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", x.chapter_title(F.col("text")).alias("title"))
