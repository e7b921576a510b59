"""Runs of successive sampled positions, and what is made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixlake.functions.sequence import has_bit
from helixlake.operators.intervals import within
from helixlake.operators.quantiles import of_counts

#: Positions that one window group orders; runs are joined across its edges afterwards.
BLOCK = 1 << 20


def islands(rows: DataFrame, subjects: Sequence[str], stride: int = 1, block: int = BLOCK) -> DataFrame:
    """(subject, contig_id, first, last, n, every) of each maximal run of sampled positions that a subject holds.

    first and last are contig-local, every is the patterns' bitwise and. Runs end at contig edges. They are found
    within blocks of positions and then joined, so no task orders a whole contig's positions.
    """
    each = F.explode(F.array(*[F.when(has_bit(F.col("pres"), i), F.lit(s)) for i, s in enumerate(subjects)])).alias("subject")
    held = rows.filter("pres <> 0").select("contig_id", "lpos", "pos", "pres", each).filter("subject is not null")
    held = held.withColumn("at", F.expr(f"pos div {stride}")).withColumn("block", F.expr(f"pos div {block}"))
    order = Window.partitionBy("subject", "contig_id", "block").orderBy("at")
    runs = held.withColumn("run", F.col("at") - F.row_number().over(order)).groupBy("subject", "contig_id", "block", "run")
    runs = runs.agg(F.min("lpos").alias("first"), F.max("lpos").alias("last"), F.min("at").alias("a"), F.max("at").alias("z"), F.count(F.lit(1)).alias("n"), F.bit_and("pres").alias("every"))
    order = Window.partitionBy("subject", "contig_id").orderBy("a")
    new = F.coalesce(F.lag("z").over(order) + 1 != F.col("a"), F.lit(True)).cast("int")
    joined = runs.withColumn("new", new).withColumn("id", F.sum("new").over(order)).groupBy("subject", "contig_id", "id")
    return joined.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.bit_and("every").alias("every")).drop("id")


def segment_classes(runs: DataFrame) -> DataFrame:
    """(subject, class, segments, positions) for runs painted by the class of their first position."""
    return runs.groupBy("subject", "class").agg(F.count(F.lit(1)).alias("segments"), F.sum("n").alias("positions"))


def top_classes(counts: DataFrame, most: int = 4) -> DataFrame:
    """Each subject's classes with the most segments, ties by name."""
    order = Window.partitionBy("subject").orderBy(F.desc("segments"), "class")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def ultraconserved(runs: DataFrame, contigs: DataFrame, subjects: Sequence[str], k: int, anchor: str = "siamang", context: int = 3000, among: Sequence[str] = ("siamang", "borang", "sorang", "gorilla", "chimp")) -> DataFrame:
    """Identical segments with the anchor, longest first: start, end, len, the subjects that hold all of it, and the
    span with context around, cut to the contig."""
    want = [(s, subjects.index(s)) for s in among if s in subjects]
    held = F.array_compact(F.array(*[F.when(has_bit(F.col("every"), i), F.lit(s)) for s, i in want]))
    out = runs.filter(F.col("subject") == anchor).join(contigs.select("contig_id", F.col("len").alias("length")), "contig_id")
    out = out.select("contig_id", F.col("first").alias("start"), (F.col("last") + k).alias("end"), held.alias("in"), "length")
    out = out.select("contig_id", "start", "end", (F.col("end") - F.col("start")).alias("len"), "in", F.greatest(F.col("start") - context, F.lit(0)).alias("span_start"), F.least(F.col("end") + context, F.col("length")).alias("span_end"), "length")
    return out.orderBy(F.desc("len"), "contig_id", "start")


def segment_kinds(segments: DataFrame, rows: DataFrame) -> DataFrame:
    """Segments with dist_end (to the nearer contig end), the median multiplicity of their positions, and kind: single
    where that is 1, telomeric where it is the cap."""
    spans = segments.select("contig_id", "start", "end", F.struct("start", "end", F.least("start", F.col("length") - F.col("end")).alias("dist_end")).alias("id"))
    inside = within(rows.select("contig_id", "lpos", "mult"), spans).select("contig_id", "id.*", "mult")
    by = ["contig_id", "start", "end", "dist_end"]
    out = of_counts(inside.groupBy(*by, "mult").agg(F.count(F.lit(1)).alias("n")), by, "mult", 0.5).withColumnRenamed("quantile", "median_copies")
    return out.withColumn("kind", F.when(F.col("median_copies") >= 255, "telomeric").when(F.col("median_copies") == 1, "single_copy").otherwise("repeated"))
