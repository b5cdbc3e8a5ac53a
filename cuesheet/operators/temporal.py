"""Joins by time: the nearest row before or after (as-of), and rows within a band.

``asof`` is a sort-merge: both sides in one sequence by key and time, where each left row takes the last right row before it, or the
first behind. The sequence is cut by time slices of ``slice_seconds``, so that a key with a third of all rows is sorted in many
tasks; what a slice inherits from earlier ones is one row a slice, joined back as a seed. ``within`` deals rows to slices as wide
as the band, and each left row looks into its slice and the two beside it.

Rows with a null key or time match nothing. Times may be timestamps or numbers of seconds. Of right rows with equal times the one that
is first by ``order`` counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _seconds(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.typeName()
    if kind == "timestamp":
        return F.unix_micros(column) / 1e6
    return F.unix_micros(F.col(column).cast("timestamp")) / 1e6 if kind == "timestamp_ntz" else F.col(column).cast("double")


def _one_way(rows: DataFrame, by: list[str], forward: bool, slice_seconds: float) -> DataFrame:
    """rows (by, _t, _left, _right, _order) with _hit: the struct _right of the nearest row before (or behind) each left row."""
    sign = -1 if forward else 1
    rows = rows.withColumn("_s", F.floor(F.col("_t") / slice_seconds) * sign)
    # of equal times the first by order is nearest, from either side, and rows at the same time count
    place = [F.col("_t") * sign, F.col("_left").isNotNull(), F.desc("_order")]
    nearest = F.max_by("_right", F.struct(F.col("_t") * sign, F.col("_rank")))
    # the last right row of each slice, then of all slices before each: a row a slice
    ends = rows.filter("_right is not null").withColumn("_rank", -F.col("_order")).groupBy(*by, "_s").agg(F.struct(F.max(F.col("_t") * sign).alias("t"), nearest.alias("right")).alias("_end"))
    slices = rows.select(*by, "_s").distinct().join(ends, [*by, "_s"], "left")
    seeds = slices.withColumn("_seed", F.last("_end", ignorenulls=True).over(W.partitionBy(*by).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)))
    seeds = seeds.filter("_seed is not null").select(*by, "_s", F.col("_seed.right").alias("_seed"))
    own = F.last("_right", ignorenulls=True).over(W.partitionBy(*by, "_s").orderBy(*place).rowsBetween(W.unboundedPreceding, 0))
    found = rows.withColumn("_own", own).filter("_left is not null")
    return found.join(seeds, [*by, "_s"], "left").withColumn("_hit", F.coalesce("_own", "_seed")).drop("_own", "_seed", "_s")


def asof(
    left: DataFrame, right: DataFrame, *, by: Sequence[str], left_time: str, right_time: str, order: str, direction: str = "backward", tolerance: float | None = None, prefix: str = "right_", slice_seconds: float = 86_400.0
) -> DataFrame:
    """Every left row, with the columns of the right row of the same key nearest in time, named with ``prefix``, or nulls.

    direction: backward (at or before), forward (at or after) or nearest (of equally near ones the earlier). A match farther than
    ``tolerance`` seconds does not count. order: a numeric column of right, unique within a key and time.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"{direction}: backward, forward or nearest")
    by = list(by)
    sides = []
    for df, time, is_left in ((left, left_time, True), (right, right_time, False)):
        whole = F.struct(*(F.col(f"`{c}`").alias(c) for c in df.columns))
        t = _seconds(df, time)
        own = (F.struct(F.monotonically_increasing_id().alias("id"), whole.alias("row")), F.lit(None)) if is_left else (F.lit(None), F.struct(t.alias("t"), whole.alias("row")))
        sides.append((df, t, *own, F.lit(None).cast("double") if is_left else F.col(order).cast("double")))
    kinds = [None, None]
    rows = []
    for df, t, one, two, rank in sides:
        part = df.select(*(F.col(f"`{c}`").alias(f"_k{k}") for k, c in enumerate(by)), t.alias("_t"), one.alias("_left"), two.alias("_right"), rank.alias("_order"))
        rows.append(part)
        kinds = [kinds[0] or (part.schema["_left"].dataType if part.schema["_left"].dataType.typeName() != "void" else None), kinds[1] or (part.schema["_right"].dataType if part.schema["_right"].dataType.typeName() != "void" else None)]
    rows = [p.withColumns({"_left": F.col("_left").cast(kinds[0]), "_right": F.col("_right").cast(kinds[1])}) for p in rows]
    keys = [f"_k{k}" for k in range(len(by))]
    usable = F.col("_t").isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    both = rows[0].filter(usable).unionByName(rows[1].filter(usable))
    ways = [_one_way(both, keys, forward, slice_seconds) for forward in ((False,) if direction == "backward" else (True,) if direction == "forward" else (False, True))]
    found = ways[0]
    if direction == "nearest":
        after = ways[1].select(F.col("_left.id").alias("_id"), F.col("_hit").alias("_after"))
        later = F.col("_hit").isNull() | ((F.col("_after.t") - F.col("_t")) < (F.col("_t") - F.col("_hit.t")))
        found = found.join(after, F.col("_left.id") == F.col("_id")).withColumn("_hit", F.when(later, F.coalesce("_after", "_hit")).otherwise(F.col("_hit")))
    found = found.unionByName(rows[0].filter(~F.coalesce(usable, F.lit(False))).withColumn("_hit", F.lit(None).cast(kinds[1])).select(*found.select(*keys, "_t", "_left", "_right", "_order", "_hit").columns), allowMissingColumns=True)
    near = F.col("_hit") if tolerance is None else F.when(F.abs(F.col("_hit.t") - F.col("_t")) <= tolerance, F.col("_hit"))
    found = found.withColumn("_hit", near)
    return found.select(*(F.col("_left.row").getField(c).alias(c) for c in left.columns), *(F.col("_hit.row").getField(c).alias(prefix + c) for c in right.columns))


def within(left: DataFrame, right: DataFrame, *, by: Sequence[str], left_time: str, right_time: str, band: float, how: str = "inner", prefix: str = "right_") -> DataFrame:
    """Left and right rows of a key whose times differ by at most ``band`` seconds: inner, left, left_semi or left_anti.

    Right rows are named with ``prefix``. A right row goes to three slices, so a left row finds all its partners in one.
    """
    if band <= 0:
        raise ValueError("the band must be above 0")
    by = list(by)
    t, u = _seconds(left, left_time), _seconds(right, right_time)
    one = left.withColumns({"_t": t, "_slice": F.floor(t / band)})
    keys = [F.col(f"`{c}`").alias(f"_k{k}") for k, c in enumerate(by)]
    at = F.floor(u / band)
    two = right.filter(u.isNotNull()).select(*keys, u.alias("_u"), F.explode(F.array(at - 1, at, at + 1)).alias("_right_slice"), *([] if how in ("left_semi", "left_anti") else [F.col(f"`{c}`").alias(prefix + c) for c in right.columns]))
    on = (F.col("_slice") == F.col("_right_slice")) & (F.abs(F.col("_t") - F.col("_u")) <= band)
    for k, c in enumerate(by):
        on = on & (F.col(f"`{c}`") == F.col(f"_k{k}"))
    out = one.join(two, on, how)
    return out.drop("_t", "_slice", "_u", "_right_slice", *(f"_k{k}" for k in range(len(by))))


def band_hits(references: DataFrame, found: DataFrame, *, by: str, tolerance: float = 20.0) -> DataFrame:
    """Per key of either side: references (by, time) hit and missed, and found ones (by, time) without a reference in the band."""
    band = {"by": [by], "left_time": "time", "right_time": "time", "band": tolerance}
    count = lambda df, name: df.groupBy(by).agg(F.count(F.lit(1)).alias(name))
    hits, false = count(within(references, found, how="left_semi", **band), "hits"), count(within(found, references, how="left_anti", **band), "false_cuts")
    every = count(references, "n").join(hits, by, "full").join(false, by, "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return every.select(by, zero("hits").alias("hits"), (zero("n") - zero("hits")).alias("missed"), zero("false_cuts").alias("false_cuts"))
