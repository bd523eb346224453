"""Exact quantiles per group by distributed selection (AGG-3).

A quantile lies between two rows of known rank. Per pass every group's rows are
cut at some 65 values spread evenly over them (from a mergeable sketch), the
rows between and at the cuts are counted exactly, and only those stretches that
hold a wanted rank are kept. A rank that falls on a cut is found; any other one
is looked for in its stretch by the next pass, over about a sixty-fourth of the
rows. The cuts decide how fast this goes, never the result. No task holds a
group: cuts and counts are aggregates with map-side combine, and a window runs
over the at most 131 stretches of one part.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsift.session import handoff

CUTS = 64
#: Of the sketch that proposes the cuts: a cut is off by a tenth of a stretch at most.
ACCURACY = 10 * CUTS


def quantiles(df: DataFrame, value: str, by: str, fractions: Sequence[float]) -> DataFrame:
    """One row per ``by``: by, n (values counted), q0, q1, ... (doubles), linear between
    the two nearest rows. Null values and rows without a group are left out; values
    compare as Spark orders doubles (NaN is the largest)."""
    rows = (df.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v"))
            .where("g IS NOT NULL AND v IS NOT NULL").withColumn("part", F.lit("")))
    counts = handoff(rows.groupBy("g").agg(F.count("*").alias("n")), "counts")
    asked = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(f)).alias("f")) for k, f in enumerate(fractions)))
    place = (F.col("n") - 1) * F.col("a.f")
    ranks = F.array_distinct(F.array(F.floor(place), F.ceil(place)))
    open_ranks = counts.select("g", "n", F.explode(asked).alias("a")).select("g", F.explode(ranks).alias("rank")).distinct()
    open_ranks = handoff(open_ranks.select("g", F.lit("").alias("part"), "rank", F.col("rank").alias("wanted")), "ranks")
    found = []
    while not open_ranks.isEmpty():
        rows, open_ranks, at_cuts = _narrowed(rows, open_ranks)
        found.append(at_cuts)
    if not found:
        return counts.select(F.col("g").alias(by), "n", *(F.lit(None).cast("double").alias(f"q{k}") for k in range(len(fractions))))
    values = reduce(DataFrame.unionByName, found).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("wanted", "v"))).alias("at"))
    out = counts.join(values, "g")

    def quantile(f: float):
        h = (F.col("n") - 1) * F.lit(float(f))
        low, high = (F.element_at("at", r(h).cast("long")) for r in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low + (h - F.floor(h)) * (high - low))
    return out.select(F.col("g").alias(by), "n", *(quantile(f).alias(f"q{k}") for k, f in enumerate(fractions)))


def _narrowed(rows: DataFrame, open_ranks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One pass: the rows (g, part, v) that may still hold a wanted rank, the open ranks
    (g, part, rank within the part, wanted: rank within the group), and the ranks found
    (g, wanted, v)."""
    key = ["g", "part"]
    cut = F.array_distinct(F.percentile_approx("v", [i / CUTS for i in range(CUTS + 1)], ACCURACY))
    cuts = handoff(rows.groupBy(*key).agg(cut.alias("cuts")), "cuts")
    # Stretch 2i lies below cut i, stretch 2i + 1 holds the rows equal to it.
    stretch = F.size(F.filter("cuts", lambda c: c < F.col("v"))) * 2 + F.array_contains("cuts", F.col("v")).cast("int")
    cut_rows = rows.join(cuts, key).select(*key, "v", stretch.alias("stretch"))
    upto = F.sum("c").over(Window.partitionBy(*key).orderBy("stretch"))
    cells = cut_rows.groupBy(*key, "stretch").agg(F.count("*").alias("c")).select(*key, "stretch", upto.alias("upto"), (upto - F.col("c")).alias("before"))
    placed = open_ranks.join(cells, key).where("rank >= before AND rank < upto").join(cuts, key)
    placed = handoff(placed.select(*key, "stretch", "wanted", (F.col("rank") - F.col("before")).alias("rank"),
                                   F.expr("IF(stretch % 2 = 1, cuts[stretch div 2], null)").alias("v")), "placed")
    inside = F.concat_ws("/", "part", F.col("stretch").cast("string")).alias("part")
    still = placed.where("stretch % 2 = 0")
    left = handoff(cut_rows.join(still.select(*key, "stretch").distinct(), [*key, "stretch"]).select("g", inside, "v"), "left")
    return left, still.select("g", inside, "rank", "wanted"), placed.where("stretch % 2 = 1").select("g", "wanted", "v")
