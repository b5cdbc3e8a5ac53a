import gc
import weakref

from cuesheet.operators import correction as c
from cuesheet.operators import segmentation as s
from cuesheet.sources.dictionaries import builtin


def test_a_corrector_goes_with_its_task(monkeypatch):
    monkeypatch.setattr(c, "KNOWN", 3, raising=False)
    one = c.Corrector(builtin())
    assert [one.correct(t)[0] for t in ("reice", "foalse", "abcdq", "reice", "xyzzy", "reice")] == ["Redis", "false", "abcdq", "Redis", "xyzzy", "Redis"]
    assert len(one.known) <= 3
    gone = weakref.ref(one)
    del one
    gc.collect()
    assert gone() is None  # a cache of the class had kept it


def test_lists_become_objects_by_small_parts(spark):
    videos = spark.range(300).selectExpr("id AS video_id", "100.0D AS duration", "array(named_struct('start', 19.0D, 'end', 21.0D)) AS silences").coalesce(1)
    rows = s._scan(videos, lambda r: [(r.duration, s.PART)], ["time", "part"])
    assert {(r["time"], r["part"]) for r in rows.collect()} == {(100.0, 64.0)}
    assert "MapInArrow" in rows._jdf.queryExecution().optimizedPlan().toString() and rows.count() == 300
