"""Tables per array of merged intervals, and views of windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.functions.sequence import has_bit
from helixlake.operators import quantiles
from helixlake.operators.intervals import BUCKET, merge


def array_table(rows: DataFrame, intervals: DataFrame, subjects: Sequence[str], gap: int = 500_000) -> DataFrame:
    """Intervals less than gap apart make an array; statistics cover the intervals only, not the gaps.

    (contig_id, start, end, n, single_copy_pct, shared_pct map, closest_ape): percentages of valid positions; the
    closest is the subject other than hg002 that shares most, the first of equals.
    """
    arrays = merge(intervals, gap).select(F.col("contig_id").alias("_c"), F.col("start").alias("s"), F.col("end").alias("e"))
    meet = (F.col("contig_id") == F.col("_c")) & (F.col("start") >= F.col("s")) & (F.col("end") <= F.col("e"))
    pieces = intervals.select("contig_id", "start", "end").distinct().join(arrays, meet).drop("_c")
    laid = pieces.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor((F.col("end") - 1) / BUCKET)))).withColumnRenamed("contig_id", "_c")
    meet = (F.col("contig_id") == F.col("_c")) & (F.floor(F.col("lpos") / BUCKET) == F.col("_b")) & (F.col("lpos") >= F.col("start")) & (F.col("lpos") < F.col("end"))
    inside = rows.filter("mult > 0").join(laid, meet)
    pct = lambda c: F.avg(c.cast("int")) * 100
    out = inside.groupBy("contig_id", "s", "e").agg(F.count(F.lit(1)).alias("n"), pct(F.col("mult") == 1).alias("single_copy_pct"), *[pct(has_bit(F.col("pres"), i)).alias(s) for i, s in enumerate(subjects)])
    best = F.array_max(F.array(*[F.struct(F.col(s).alias("p"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(subjects) if s != "hg002"]))["s"]
    shared = F.map_from_arrays(F.array(*map(F.lit, subjects)), F.array(*subjects))
    return out.select("contig_id", F.col("s").alias("start"), F.col("e").alias("end"), "n", "single_copy_pct", shared.alias("shared_pct"), best.alias("closest_ape"))


def window_shares(track: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(contig_id, start, layer, share) of windows with valid positions."""
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("layer"), F.try_divide(F.col(c).cast("double"), F.col("valid").cast("double")).alias("share")) for c in columns])).alias("x")
    return track.filter("valid > 0").select("contig_id", "start", x).select("contig_id", "start", "x.*")


def colour_scale(shares: DataFrame, quantile: float = 0.99) -> DataFrame:
    """The upper end of each layer's colours: an exact, interpolated percentile, in two passes of counts."""
    return quantiles.quantile(shares, ["layer"], F.col("share"), quantile).withColumnRenamed("quantile", "top")


def profile(track: DataFrame, intervals: DataFrame, columns: Sequence[str], flank: int = 1_000_000) -> DataFrame:
    """Shares in the windows that lie within flank of a contig's annotated span (SD left out); all windows where it has none."""
    span = intervals.filter(F.col("class") != "SD").groupBy("contig_id").agg(F.greatest(F.min("start") - flank, F.lit(0)).alias("lo"), (F.max("end") + flank).alias("hi"))
    near = track.join(span, "contig_id", "left").filter(F.col("lo").isNull() | ((F.col("start") >= F.col("lo")) & (F.col("end") <= F.col("hi"))))
    shares = [(F.col(c) / F.greatest(F.col("valid"), F.lit(1))).alias(c) for c in columns]
    return near.select("contig_id", "start", "end", *shares)
