import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cuesheet.operators import temporal as t

SCHEMA = "id long, user string, at double"


def sides(seed=1, n=80):
    rng = random.Random(seed)
    draw = lambda k: [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *(rng.randint(0, 400) / 4 for _ in range(9))])) for i in range(k)]
    return draw(n), draw(n)


def nearest(left, right, direction, tolerance):
    out = []
    for i, u, a in left:
        best = None
        for j, w, b in right:
            if u is None or u != w or a is None or b is None or direction == "backward" and b > a or direction == "forward" and b < a or tolerance is not None and abs(a - b) > tolerance:
                continue
            best = min(best or (1e9,), (abs(a - b), b, j))
        out.append((i, best[2] if best else None))
    return sorted(out)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize(("tolerance", "slices"), [(None, 1e6), (None, 7.0), (2.0, 5.0)])
def test_asof_equals_plain_python(spark, direction, tolerance, slices):
    """Ties in time and distance, null keys and times, keys on one side, whatever the slices."""
    left, right = sides()
    one, two = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    got = t.asof(one, two, by=["user"], left_time="at", right_time="at", order="id", direction=direction, tolerance=tolerance, slice_seconds=slices)
    assert got.columns == ["id", "user", "at", "right_id", "right_user", "right_at"]
    assert sorted((r["id"], r["right_id"]) for r in got.collect()) == nearest(left, right, direction, tolerance)


def test_asof_of_timestamps_and_empty_tables(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    left = spark.createDataFrame([(1, "a", at(10)), (2, "a", at(86_400 * 3))], "id long, user string, at timestamp")
    right = spark.createDataFrame([(7, "a", at(5)), (8, "a", at(10))], "id long, user string, at timestamp")
    how = {"by": ["user"], "left_time": "at", "right_time": "at", "order": "id"}
    assert sorted((r["id"], r["right_id"]) for r in t.asof(left, right, **how).collect()) == [(1, 8), (2, 8)]
    assert sorted((r["id"], r["right_id"]) for r in t.asof(left, right.limit(0), **how).collect()) == [(1, None), (2, None)]
    assert t.asof(left.limit(0), right, **how).collect() == []
    with pytest.raises(ValueError, match="backward, forward or nearest"):
        t.asof(left, right, direction="sideways", **how)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_within_equals_plain_python(spark, how):
    left, right = sides(2)
    one, two = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    got = t.within(one, two, by=["user"], left_time="at", right_time="at", band=1.5, how=how).collect()
    near = {(i, j) for i, u, a in left for j, w, b in right if u is not None and u == w and a is not None and b is not None and abs(a - b) <= 1.5}
    hit = {i for i, _ in near}
    if how in ("left_semi", "left_anti"):
        assert sorted(r["id"] for r in got) == sorted(i for i, *_ in left if (i in hit) == (how == "left_semi"))
    else:
        want = near | ({(i, None) for i, *_ in left if i not in hit} if how == "left" else set())
        assert len(got) == len(want) and {(r["id"], r["right_id"]) for r in got} == want


def test_band_hits_equal_the_arrays_way(spark):
    from cuesheet.operators import evaluation as e

    rng = random.Random(8)
    cases = [(f"v{i}", sorted(rng.uniform(0, 900) for _ in range(rng.randint(0, 6))), sorted(rng.uniform(0, 900) for _ in range(rng.randint(0, 6)))) for i in range(40)]
    table = spark.createDataFrame(cases, "video_id string, ref array<double>, hyp array<double>")
    rows = lambda c: table.select("video_id", F.explode(c).alias("time"))
    got = sorted(map(tuple, t.band_hits(rows("ref"), rows("hyp"), by="video_id").collect()))
    assert got == sorted(map(tuple, e.boundary_hits(table).filter("hits + missed + false_cuts > 0").collect()))


def test_hot_key_is_cut_into_slices(spark):
    """One key's rows are ordered in slices of time, so no task has to sort them all."""
    rows = spark.range(20_000).select("id", F.lit("a").alias("user"), (F.col("id") / 10).alias("at"))
    got = t.asof(rows.filter("id % 2 = 0"), rows.filter("id % 1000 = 1"), by=["user"], left_time="at", right_time="at", order="id", slice_seconds=10.0)
    assert got.filter("right_id is null").count() == 1
    assert got.filter("right_id <> (id - 1) div 1000 * 1000 + 1").count() == 0
    assert "_s" in got._jdf.queryExecution().optimizedPlan().toString().split("Window")[1].split("\n")[0]
