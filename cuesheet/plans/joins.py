"""Joins by time over events: the nearest event of another kind, and events within a band."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal as t
from ..sources.tables import load
from . import query

HOUR = 3600.0
SIDES = "l AS (SELECT * FROM events WHERE event_type = 'purchase'), r AS (SELECT * FROM events WHERE event_type = 'view')"


def _kind(spark, sf_dir, kind):
    return load(spark, sf_dir, "events").filter(F.col("event_type") == kind).select("event_id", "user_id", "ts")


def _asof(spark, sf_dir, direction, hours):
    one, two = _kind(spark, sf_dir, "purchase"), _kind(spark, sf_dir, "view")
    found = t.asof(one, two, by=["user_id"], left_time="ts", right_time="ts", order="event_id", direction=direction, tolerance=hours * HOUR)
    return found.select("event_id", F.col("right_event_id").alias("near_id"))


@query(f"WITH {SIDES} SELECT l.event_id, CASE WHEN l.ts - r.ts <= INTERVAL 24 HOUR THEN r.event_id END AS near_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts")
def asof_backward(spark, sf_dir):
    """The view before each purchase, at most a day back."""
    return _asof(spark, sf_dir, "backward", 24)


@query(f"WITH {SIDES} SELECT l.event_id, CASE WHEN r.ts - l.ts <= INTERVAL 24 HOUR THEN r.event_id END AS near_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts <= r.ts")
def asof_forward(spark, sf_dir):
    """The view after each purchase, at most a day on."""
    return _asof(spark, sf_dir, "forward", 24)


@query(f"WITH {SIDES}, p AS (SELECT l.event_id, r.event_id AS near_id, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(r.ts)), r.ts, r.event_id) AS k FROM l JOIN r ON l.user_id = r.user_id AND abs(epoch_us(l.ts) - epoch_us(r.ts)) <= 12 * 3600000000) SELECT l.event_id, near_id FROM l LEFT JOIN (SELECT * FROM p WHERE k = 1) USING (event_id)")
def asof_nearest(spark, sf_dir):
    """The view nearest to each purchase, before or after, within twelve hours."""
    return _asof(spark, sf_dir, "nearest", 12)


@query(f"WITH {SIDES}, u AS (SELECT user_id FROM l UNION SELECT user_id FROM r), h AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM r WHERE r.user_id = l.user_id AND abs(epoch_us(l.ts) - epoch_us(r.ts)) <= 3 * 3600000000)) AS hits FROM l GROUP BY user_id), f AS (SELECT user_id, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM l WHERE r.user_id = l.user_id AND abs(epoch_us(l.ts) - epoch_us(r.ts)) <= 3 * 3600000000)) AS false_cuts FROM r GROUP BY user_id) SELECT user_id, coalesce(hits, 0) AS hits, coalesce(n - hits, 0) AS missed, coalesce(false_cuts, 0) AS false_cuts FROM u LEFT JOIN h USING (user_id) LEFT JOIN f USING (user_id)")
def band_hits(spark, sf_dir):
    """Purchases as references and views as found boundaries, three hours apart at most: rows on both sides, no lists."""
    one, two = (_kind(spark, sf_dir, kind).withColumnRenamed("ts", "time") for kind in ("purchase", "view"))
    return t.band_hits(one, two, by="user_id", tolerance=3 * HOUR)


@query(f"WITH {SIDES} SELECT l.event_id, r.event_id AS near_id FROM l JOIN r ON l.user_id = r.user_id AND abs(epoch_us(l.ts) - epoch_us(r.ts)) <= 3600000000")
def band_pairs(spark, sf_dir):
    """Purchases and views of a user within an hour of each other."""
    found = t.within(_kind(spark, sf_dir, "purchase"), _kind(spark, sf_dir, "view"), by=["user_id"], left_time="ts", right_time="ts", band=HOUR)
    return found.select("event_id", F.col("right_event_id").alias("near_id"))
