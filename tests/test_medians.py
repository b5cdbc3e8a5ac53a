import random
import statistics

from cuesheet.plans import ORACLES
from cuesheet.streaming import progress as p


def test_median_is_exact_beyond_the_accuracy_of_summaries(spark):
    rng = random.Random(4)
    values = {"a": [rng.random() for _ in range(4000)], "b": [float(rng.randint(0, 3)) for _ in range(3001)], "c": [2.5], "d": [1.0, 2.0, None], None: [3.0, 4.0], "e": [None]}
    rows = spark.createDataFrame([(s, v) for s, vs in values.items() for v in vs], "stage string, value double").repartition(7)
    got = {r["stage"]: r["median"] for r in p.stage_metrics(rows, accuracy=100).collect()}
    want = {s: statistics.median(known) if (known := [v for v in vs if v is not None]) else None for s, vs in values.items()}
    assert got == want


def test_the_sql_of_stage_metrics_is_a_median():
    assert "median(value)" in ORACLES["stage_metrics"]
