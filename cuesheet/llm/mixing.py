"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source's target is a share of all words by weight, but at most ``max_repeats`` times what it has; the excess goes to the
others by weight until none is above. Of a document with expected count e, floor(e) whole copies are certain; the rest p is
drawn by Pareto order: documents are ranked by the odds of a uniform hash divided by the odds of p, and in that order each
document is taken that still fits into the source's remaining words. At last one more may be taken, the smallest that is
left, if that comes closer to the target: so a source misses its target by less than half of a document of its own.

The order is never sorted in one task: a round finds by two levels of 4096 bins where the sizes of the documents that fit
pass what remains; the next round goes on from there with the documents that fit into the new rest, until none does.

The uniform number is a hash of seed, id, source and text, and of rows that repeat these, also of a row's number among them;
so each is drawn for itself, and reruns agree. Null and empty texts have size 0 and are never taken; very long ones count
whole, and are skipped where they do not fit; a null source is a source of its own; other columns of the input don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import packed, release, spare_name, staged, unpacked

#: Words are runs of other than these characters.
SPACE = r"\x20\x09-\x0D"
BINS = 4096
BROADCAST_BYTES = 64 << 20


def n_words(text: Column) -> Column:
    """The number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def _numbered(names: DataFrame) -> DataFrame:
    """names (_source, ...) with _k, their place by code point, null last; staged. No task sees more than its own range."""
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = staged(names.orderBy(F.col("_source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()).withColumns({"_part": part, "_place": place}), "sources-sorted")
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).agg(F.sort_array(F.collect_list(F.struct("_part", "n"))).alias("_all"))  # an entry a partition
    before = lambda x: F.aggregate(F.filter("_all", lambda y: y["_part"] < x["_part"]), F.lit(0).cast("long"), lambda acc, y: acc + y["n"])
    offsets = counts.select(F.inline(F.transform("_all", lambda x: F.struct(x["_part"].alias("_part"), before(x).alias("_before")))))
    out = staged(rows.join(F.broadcast(offsets), "_part").withColumn("_k", F.col("_before") + F.col("_place")).drop("_at", "_part", "_place", "_before"), "sources")
    release(rows)
    return out


def source_targets(sizes: DataFrame, weights: Sequence[float], max_repeats: int) -> DataFrame:
    """Of rows (_source, _size): _source, source_size, target."""
    names = _numbered(sizes.groupBy("_source").agg(F.sum("_size").alias("source_size")))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_k") % len(weights) + 1).cast("int"))
    rows = names.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * max_repeats)
    level, n_full = 0.0, -1
    while True:  # the level at which the open sources share what the full ones leave; more sources become full, until none does
        full = F.col("_cap") < F.lit(level) * F.col("_w")
        x = rows.agg(F.sum("source_size").alias("total"), F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0)).alias("cap"), F.sum(F.when(~full, F.col("_w"))).alias("w"), F.count_if(full).alias("n")).first()
        if x["n"] == n_full or not x["w"]:
            break
        level, n_full = (x["total"] - x["cap"]) / x["w"], x["n"]
    return rows.select("_source", "source_size", F.least(F.col("_cap").cast("double"), F.lit(level) * F.col("_w")).alias("target"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """docs packed, with _id, _source, _size, _tie (a hash that only repeated rows share) and _row."""
    tie = F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col), F.col(text_col))
    return packed(docs, _id=F.col(id_col), _source=F.col(source_col).cast("string"), _size=n_words(F.col(text_col)), _tie=tie, _row=F.monotonically_increasing_id())


def _told_apart(rows: DataFrame, again: DataFrame | None, fixed: bool) -> DataFrame:
    """rows with _h, a hash for each row. Rows of a _tie in ``again`` are numbered, first in their partitions, then over these.

    fixed: whether rows are a staged table; else those that repeat are staged, as their partitions must not change.
    """
    if again is None:
        return rows.withColumn("_h", F.col("_tie"))
    many = rows.join(again, "_tie", "left_semi")
    many = (many if fixed else staged(many, "mix-repeats")).withColumn("_part", F.shiftright("_row", 33))
    per = many.groupBy("_tie", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_tie").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = staged(per.select("_tie", "_part", before.alias("_before")), "mix-offsets")
    place = F.row_number().over(W.partitionBy("_tie", "_part").orderBy("_row")) - 1
    k = F.col("_before") + F.col("_place")
    many = many.withColumn("_place", place).join(offsets, ["_tie", "_part"]).withColumn("_h", F.when(k == 0, F.col("_tie")).otherwise(F.xxhash64("_tie", k)))
    return rows.join(again, "_tie", "left_anti").withColumn("_h", F.col("_tie")).unionByName(many.drop("_part", "_place", "_before"))


def _of_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    return rows.join(plan.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")


def _drawn(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with their source's plan and _v, their rank's ratio of odds: a number from 0 to 1 in the same order."""
    u = (F.shiftrightunsigned("_h", 11) + 0.5) / float(1 << 53)
    p = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) - F.col("_base")
    return _of_source(rows, plan).withColumn("_v", F.coalesce(u * (1 - p) / (u * (1 - p) + (1 - u) * p), F.lit(1.0)))


_KEY = "struct<v:double,h:bigint>"


def _key(v: Column, h: Column) -> Column:
    return F.struct(v.alias("v"), h.alias("h"))


def _passing(rows: DataFrame, bins: list[str], rest: str) -> DataFrame:
    """Of each source, the bin where its rows' cumulated sizes pass ``rest``, and what is left before it; rest and -1 if none."""
    last = bins[-1]
    cum = F.sum("_words").over(W.partitionBy("_source").orderBy(last))
    upto = rows.groupBy("_source", *bins).agg(F.sum("_size").alias("_words"), F.first(rest).alias("_rest")).withColumn("_cum", cum)
    first = F.min(F.when(F.col("_cum") > F.col("_rest"), F.struct(last, (F.col("_rest") - F.col("_cum") + F.col("_words")).alias("left"))))
    out = upto.groupBy("_source").agg(first.alias("_x"), F.min(F.col("_rest") - F.col("_cum")).alias("_all"))
    return out.select("_source", F.coalesce(F.col("_x")[last], F.lit(-1)).alias(f"_cut{last}"), F.coalesce("_x.left", "_all").alias("_rest"))


def _cut(rows: DataFrame) -> DataFrame:
    """Of rows (_source, _size, _v, _h, _gap): for each source _to, the last key up to which all fit into _gap, and _rest, what is left of it; staged."""
    b1 = F.least(F.floor(F.col("_v") * BINS), F.lit(BINS - 1))
    rows = rows.withColumn("_b1", b1).withColumn("_b2", F.least(F.floor((F.col("_v") * BINS - F.col("_b1")) * BINS), F.lit(BINS - 1)))
    one = staged(_passing(rows, ["_b1"], "_gap"), "mix-bin1")
    inside = _of_source(rows, one.withColumnRenamed("_rest", "_rest1")).filter(F.col("_b1") == F.col("_cut_b1"))
    two = staged(_passing(inside, ["_b2"], "_rest1"), "mix-bin2")
    inside = _of_source(inside, two.withColumnRenamed("_rest", "_rest2")).filter(F.col("_b2") == F.col("_cut_b2"))
    inside = inside.withColumn("_cum", F.sum("_size").over(W.partitionBy("_source").orderBy("_v", "_h").rowsBetween(W.unboundedPreceding, 0))).filter(F.col("_cum") <= F.col("_rest2"))
    key = inside.groupBy("_source").agg(F.max(_key(F.col("_v"), F.col("_h"))).alias("_key"), F.max("_cum").alias("_cum"))
    found = one.join(two.select(F.col("_source").alias("_s2"), "_cut_b2", F.col("_rest").alias("_rest2")), F.col("_source").eqNullSafe(F.col("_s2")), "left")
    found = found.join(key.withColumnRenamed("_source", "_s3"), F.col("_source").eqNullSafe(F.col("_s3")), "left")
    edge = _key((F.col("_cut_b1") * BINS + F.col("_cut_b2")) / float(BINS * BINS), F.lit(-(1 << 63)))
    to = F.when(F.col("_cut_b1") < 0, _key(F.lit(2.0), F.lit(0).cast("long"))).otherwise(F.coalesce("_key", edge)).cast(_KEY)
    rest = F.coalesce("_rest2", "_rest") - F.coalesce("_cum", F.lit(0))
    out = staged(found.select("_source", to.alias("_to"), rest.alias("_rest")), "mix-cut")
    release(one)
    release(two)
    return out


def _taken() -> Column:
    """Whether a drawn row is taken, by the rounds of its source's plan."""
    me = _key(F.col("_v"), F.col("_h"))
    in_round = F.exists("_rounds", lambda r: (me > r["from"]) & (me <= r["to"]) & (F.col("_size") <= r["fits"]))
    return (F.col("_base") < F.col("_most")) & (F.col("_size") > 0) & (in_round | F.coalesce(me == F.col("_added"), F.lit(False)))


def mixing_plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rows without text, a plan of a row per source, repeated ties or None); all are staged tables."""
    rows = staged(_keyed(docs, id_col, text_col, source_col, seed).drop("_doc"), "mix-rows")
    again = staged(rows.groupBy("_tie").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_tie"), "mix-repeated")
    if not again.limit(1).count():
        release(again)
        again = None
    else:
        rows = staged(_told_apart(rows, again, True), "mix-rows-told-apart")

    e = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = source_targets(rows, weights, max_repeats).withColumns({"_base": F.least(F.floor(e), F.lit(max_repeats)).cast("long"), "_most": F.lit(max_repeats)})
    plan = plan.withColumns({"_gap": F.col("target") - F.col("_base") * F.col("source_size"), "_from": _key(F.lit(-1.0), F.lit(0).cast("long")).cast(_KEY)})
    plan = staged(plan.withColumn("_rounds", F.array().cast(f"array<struct<from:{_KEY},to:{_KEY},fits:double>>")), "mix-plan")
    hashed = rows if again is not None else rows.withColumn("_h", F.col("_tie"))
    drawn = staged(_drawn(hashed, plan.select("_source", "source_size", "target", "_base", "_most")).filter((F.col("_base") < F.col("_most")) & (F.col("_size") > 0)).select("_source", "_size", "_v", "_h", "_base", "_most"), "mix-drawn")

    left = drawn.drop("_base", "_most")
    while True:
        fits = _of_source(left, plan.select("_source", "_gap", "_from")).filter((F.col("_size") <= F.col("_gap")) & (_key(F.col("_v"), F.col("_h")) > F.col("_from")))
        fits = staged(fits.drop("_from"), "mix-fits")
        release(left)
        if not fits.limit(1).count():
            release(fits)
            break
        cut = _cut(fits)
        this = F.struct(F.col("_from").alias("from"), F.col("_to").alias("to"), F.col("_gap").alias("fits"))
        new = plan.join(cut.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
        new = new.withColumn("_rounds", F.when(F.col("_to").isNull(), F.col("_rounds")).otherwise(F.array_append("_rounds", this)))
        new = staged(new.withColumns({"_gap": F.coalesce("_rest", "_gap"), "_from": F.coalesce("_to", "_from")}).drop("_rest", "_to"), "mix-plan")
        for x in (plan, cut):
            release(x)
        plan, left = new, fits.drop("_gap")
        left.staged_path = fits.staged_path

    free = _of_source(drawn, plan.select("_source", "_rounds", "_gap")).withColumn("_added", F.lit(None).cast(_KEY)).filter((F.col("_size") < 2 * F.col("_gap")) & ~_taken())
    best = free.groupBy(F.col("_source").alias("_s")).agg(F.min(F.struct("_size", "_v", "_h")).alias("_best")).select("_s", _key(F.col("_best._v"), F.col("_best._h")).alias("_added"))
    out = staged(plan.join(best, F.col("_source").eqNullSafe(F.col("_s")), "left").select("_source", "source_size", "target", "_base", "_most", "_rounds", "_added"), "mix-plan-filled")
    release(plan)
    release(drawn)
    return hashed, out, again


def _copies() -> Column:
    return F.when(F.col("_size") == 0, F.lit(0)).otherwise(F.col("_base") + F.when(_taken(), 1).otherwise(0)).cast("long")


def mix_counts(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3, **columns) -> DataFrame:
    """A row per document: id, source, size, source_size, target, copies, taken."""
    rows, plan, _ = mixing_plan(docs, weights, max_repeats, **columns)
    out = _drawn(rows, plan).withColumn("copies", _copies())
    return out.select(F.col("_id").alias(columns.get("id_col", "doc_id")), F.col("_source").alias(columns.get("source_col", "source")), F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_size")).alias("taken"))


def mix_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """The mix: docs' columns and ``copy`` (1, 2, ...; with underscores behind it if docs has such a column), a row for each copy taken.

    Texts are not shuffled if the plan and the list of repeated rows are small.
    """
    rows, plan, again = mixing_plan(docs, weights, max_repeats, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed)
    release(rows)
    if again is not None and again.count() * 16 <= BROADCAST_BYTES:
        again = F.broadcast(again)
    out = _drawn(_told_apart(_keyed(docs, id_col, text_col, source_col, seed), again, False), plan).withColumn("copies", _copies())
    out = out.filter("copies > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return unpacked(out, docs, **{spare_name(docs, "copy"): F.col("_copy")})
