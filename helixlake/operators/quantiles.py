"""Exact quantiles from counts that merge, so that no group's values are ever one task's or one hash map's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges of values that the first pass counts in.
BINS = 4096


def of_counts(counts: DataFrame, by: Sequence[str], value: str, q: float, n: str = "n", before: str | None = None, total: str | None = None) -> DataFrame:
    """(by..., quantile): the q-quantile, interpolated between neighbours, of values that occur n times each. A group is ordered
    by its distinct values alone. With `before` and `total` counts are a stretch of the values only: so many lie below."""
    order = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(n).over(order) + (F.col(before) if before else F.lit(0))
    every = F.col(total) if total else F.sum(n).over(Window.partitionBy(*by))
    place = (every - 1) * F.lit(q)
    held = counts.select(*by, F.col(value).cast("double").alias("_x"), upto.alias("_upto"), F.floor(place).alias("_lo"), F.ceil(place).alias("_hi"), (place - F.floor(place)).alias("_part"))
    at = lambda i: F.min(F.when(F.col("_upto") > F.col(i), F.col("_x")))
    found = held.groupBy(*by).agg(at("_lo").alias("_a"), at("_hi").alias("_b"), F.first("_part").alias("_part"))
    return found.select(*by, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias("quantile"))


def quantile(rows: DataFrame, by: Sequence[str], value: Column, q: float, bins: int = BINS) -> DataFrame:
    """(by..., quantile): the exact q-quantile, interpolated, of a numeric value in each group; nulls don't count, and a group of
    nulls has none.

    A first pass counts values in `bins` equal ranges between a group's least and greatest; a second counts the distinct
    values of the one or two ranges that hold the places asked for. Both are partial sums, and what a window orders is
    at most `bins` ranges, then one range's distinct values.
    """
    if not 0 <= q <= 1:
        raise ValueError("q is from 0 to 1")
    held = rows.select(*by, value.cast("double").alias("_value")).filter("_value is not null")
    span = held.groupBy(*by).agg(F.min("_value").alias("_least"), F.max("_value").alias("_most"), F.count(F.lit(1)).alias("_all"))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        """left with right's row of its group (right has one a group); null is a group."""
        on = F.lit(True) if not by else same[0]
        for x in same[1:]:
            on = on & x
        other = right.select(*[F.col(c).alias(f"_by_{c}") for c in by], *[c for c in right.columns if c not in by])
        return left.join(other, on).drop(*[f"_by_{c}" for c in by])

    bin_of = F.when(F.col("_most") > F.col("_least"), F.least(F.floor((F.col("_value") - F.col("_least")) / (F.col("_most") - F.col("_least")) * bins), F.lit(bins - 1))).otherwise(0)
    dealt = meet(held, span).withColumn("_bin", bin_of)
    order = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    ranges = dealt.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.first("_all").alias("_all")).withColumn("_upto", F.sum("_n").over(order))
    place = (F.col("_all") - 1) * F.lit(q)
    holds = lambda p: (F.col("_upto") > p) & (F.col("_upto") - F.col("_n") <= p)
    wanted = ranges.filter(holds(F.floor(place)) | holds(F.ceil(place)))
    wanted = wanted.groupBy(*by).agg(F.min("_bin").alias("_from"), F.max("_bin").alias("_to"), F.min(F.col("_upto") - F.col("_n")).alias("_before"))
    near = meet(dealt, wanted).filter((F.col("_bin") == F.col("_from")) | (F.col("_bin") == F.col("_to")))
    counts = near.groupBy(*by, "_value", "_before", "_all").agg(F.count(F.lit(1)).alias("_n"))
    return of_counts(counts, by, "_value", q, "_n", "_before", "_all")
