import pytest
from pyspark.sql import functions as F

from cuesheet.functions.stats import wilson
from cuesheet.operators import evaluation as e

#: Fixed values: (video, duration, window, reference boundaries, boundaries found).
CASES = (
    ("v_218ecb10", 971.17, 194.0, (169.11, 373.35, 603.24, 879.26), (169.11, 374.62, 604.45, 867.02)),
    ("v_e6eef6fb", 942.01, 235.5, (233.8, 401.3, 662.1), (233.81, 402.53, 663.09)),
    ("v_f22b4919", 984.6, 246.15, (77.4, 518.1, 746.3), (77.36, 373.02, 519.31, 747.36)),
    ("v_234e259d", 1357.31, 226.22, (150.5, 250.5, 418.7, 653.6, 974.7), (252.69, 425.34, 653.58, 918.71, 977.92, 1219.05)),
    ("v_3efb18f1", 1044.86, 348.29, (188.1, 419.0), (188.06, 423.38, 596.85, 744.43)),
    ("v_1840d2ec", 1167.7, 389.23, (412.3, 824.4), (60.13, 363.85, 424.18, 726.79, 831.28, 930.01)),
)

GOLDEN = {"v_218ecb10": (16, 778, 4, 0, 0), "v_e6eef6fb": (3, 707, 3, 0, 0), "v_f22b4919": (145, 739, 3, 0, 1), "v_234e259d": (232, 1132, 4, 1, 2), "v_3efb18f1": (278, 697, 2, 0, 2), "v_1840d2ec": (47, 779, 2, 0, 4)}


def cases(spark):
    rows = [(v, d, w, list(ref), list(hyp)) for v, d, w, ref, hyp in CASES]
    return spark.createDataFrame(rows, "video_id string, duration double, window_seconds double, ref array<double>, hyp array<double>")


def test_published_boundaries(spark):
    wd = {r["video_id"]: (r["mismatch"], r["windows"]) for r in e.windowdiff_presence(cases(spark)).collect()}
    hits = {r["video_id"]: (r["hits"], r["missed"], r["false_cuts"]) for r in e.boundary_hits(cases(spark)).collect()}
    assert {k: (*wd[k], *hits[k]) for k in wd} == GOLDEN
    both = e.micro_macro(e.windowdiff_presence(cases(spark))).first()
    assert round(both["micro"], 4) == 0.1492 and round(both["macro"], 4) == 0.1475


@pytest.mark.parametrize("k, n, low, high", [(15, 20, 0.5313, 0.8881), (19, 20, 0.7639, 0.9911), (17, 20, 0.6396, 0.9476), (20, 20, 0.8389, 1.0), (0, 20, 0.0, 0.1611), (0, 0, 0.0, 1.0)])
def test_wilson(spark, k, n, low, high):
    got = spark.createDataFrame([(k, n)], "k int, n int").select(*wilson(F.col("k"), F.col("n"))).first()
    assert tuple(round(x, 4) for x in got) == (low, high)


def test_first_hits(spark):
    results = spark.createDataFrame([(1, 1, "x", 5.0, 0.9), (1, 2, "v", 200.0, 0.8), (1, 3, "v", 110.0, 0.7), (2, 1, "x", 1.0, 0.5)], "query_id int, rank int, video_id string, start_time double, relevance double")
    truth = spark.createDataFrame([(1, "v", 100.0, 60.0), (2, "v", 0.0, 60.0), (3, "v", 0.0, 60.0)], "query_id int, video_id string, expected_start double, tolerance double")
    firsts = e.first_hits(results, truth)
    assert sorted(map(tuple, firsts.select("query_id", "first_rank", "best_dev").collect())) == [(1, 3, 10.0), (2, None, None), (3, None, None)]
    assert [(r["k"], r["hits"], r["n"]) for r in e.recall_at_k(firsts).orderBy("k").collect()] == [(1, 0, 3), (3, 1, 3), (5, 1, 3)]
    assert tuple(e.delivered_at_k(firsts).first()) == (3, 1, 0)
