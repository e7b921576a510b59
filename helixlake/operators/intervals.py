"""Intervals: (contig_id, start, end, class, ord), half open, contig-local."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixlake.functions.sequence import CLASSES

#: Positions of a bucket by which positions and intervals meet.
BUCKET = 4096


def clip(intervals: DataFrame, contigs: DataFrame) -> DataFrame:
    """Intervals cut to [0, len) of their contig; empty ones go."""
    cut = intervals.join(contigs.select("contig_id", "len"), "contig_id")
    cut = cut.withColumn("start", F.greatest("start", F.lit(0))).withColumn("end", F.least("end", "len"))
    return cut.filter("start < end").drop("len")


def disjoint(intervals: DataFrame) -> DataFrame:
    """Pieces (contig_id, start, end, class) that don't overlap: where intervals do, the one of largest ord holds.

    Boundaries cut each contig into elementary pieces; each interval is laid on the boundaries it spans, and each
    piece keeps its last interval. Neighbours of one class are joined.
    """
    ends = intervals.select("contig_id", F.explode(F.array("start", "end")).alias("at")).distinct()
    follow = Window.partitionBy("contig_id").orderBy("at")
    pieces = ends.withColumn("to", F.lead("at").over(follow)).filter("to is not null")
    buckets = lambda s, e: F.explode(F.sequence(F.floor(s / BUCKET), F.floor((e - 1) / BUCKET)))
    own = pieces.withColumn("b", F.floor(F.col("at") / BUCKET))
    laid = intervals.withColumn("b", buckets(F.col("start"), F.col("end")))
    hits = own.join(laid, ["contig_id", "b"]).filter((F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")))
    top = hits.groupBy("contig_id", "at", "to").agg(F.max_by("class", "ord").alias("class"))
    before = Window.partitionBy("contig_id").orderBy("at")
    new = (F.lag("to").over(before) != F.col("at")) | (F.lag("class").over(before) != F.col("class"))
    runs = top.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(before))
    return runs.groupBy("contig_id", "run").agg(F.min("at").alias("start"), F.max("to").alias("end"), F.first("class").alias("class")).drop("run")


def paint(rows: DataFrame, pieces: DataFrame, column: str = "class", default: str = CLASSES[0]) -> DataFrame:
    """rows (contig_id, lpos, ...) with the class of the disjoint piece that holds lpos, or the default: an equi-join on
    buckets of positions, with the range as the rest of the condition."""
    laid = pieces.select("contig_id", "start", "end", F.col("class").alias(column), F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor((F.col("end") - 1) / BUCKET))).alias("_b"))
    laid = laid.select(F.col("contig_id").alias("_c"), "_b", F.col("start").alias("_s"), F.col("end").alias("_e"), column)
    names = rows.columns
    meet = (F.col("contig_id") == F.col("_c")) & (F.floor(F.col("lpos") / BUCKET) == F.col("_b")) & (F.col("lpos") >= F.col("_s")) & (F.col("lpos") < F.col("_e"))
    return rows.join(laid, meet, "left").select(*names, F.coalesce(column, F.lit(default)).alias(column))


def within(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows inside regions (id, contig_id, start, end), once for each region that holds them, by the same buckets."""
    laid = regions.select("id", F.col("contig_id").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor((F.col("end") - 1) / BUCKET))).alias("_b"))
    meet = (F.col("contig_id") == F.col("_c")) & (F.floor(F.col("lpos") / BUCKET) == F.col("_b")) & (F.col("lpos") >= F.col("_s")) & (F.col("lpos") < F.col("_e"))
    return rows.join(laid, meet).select("id", *rows.columns)


def merge(intervals: DataFrame, gap: int | None = None, by: tuple[str, ...] = ("contig_id",)) -> DataFrame:
    """Joined intervals: those that overlap or touch, or, with gap, those less than gap apart."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("start") > reach if gap is None else F.col("start") - reach >= gap
    marked = intervals.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(order))
    return marked.groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("pieces")).drop("_run")


def largest(intervals: DataFrame, least: int = 0) -> DataFrame:
    """The longest interval of each class that is longer than `least`; of equals the first by contig, then order."""
    size = F.col("end") - F.col("start")
    best = F.max(F.struct(size.alias("size"), (-F.col("contig_id")).alias("c"), (-F.col("ord")).alias("o"), "contig_id", "start", "end")).alias("x")
    return intervals.filter(size > least).groupBy("class").agg(best).select("class", "x.contig_id", "x.start", "x.end")


def spotlights(intervals: DataFrame, contigs: DataFrame, fixed: Sequence[tuple[str, str, int, int]] = (), blocks: Sequence[str] = (), edges: Sequence[str] = (), flank: int = 150_000, pad: int = 50_000, longest: int = 400_000) -> DataFrame:
    """Regions worth a closer look, (id, contig_id, start, end), cut to their contigs.

    fixed are (id, contig name, start, end). For each class of blocks: flank to both sides of the middle of its longest
    interval, or less where that with pad around is shorter. For each of edges: flank to both sides of its start. Last
    comes the longest joined duplication (class SD), of which `longest` bases at most.
    """
    top = largest(intervals)
    mid, half = F.expr("(start + end) div 2"), F.least(F.lit(flank), F.expr(f"(end - start) div 2 + {pad}"))
    block = top.filter(F.col("class").isin(list(blocks))).select(F.concat("class", F.lit("_block")).alias("id"), "contig_id", (mid - half).alias("start"), (mid + half).alias("end"))
    edge = top.filter(F.col("class").isin(list(edges))).select(F.concat("class", F.lit("_edge")).alias("id"), "contig_id", (F.col("start") - flank).alias("start"), (F.col("start") + flank).alias("end"))
    joined = merge(intervals.filter("class = 'SD'")).withColumns({"class": F.lit("SD"), "ord": F.col("start")})
    dup = largest(joined).select(F.lit("sd_largest").alias("id"), "contig_id", "start", F.least("end", F.col("start") + longest).alias("end"))
    named = contigs.sparkSession.createDataFrame(list(fixed), "id string, name string, start long, end long")
    named = contigs.select("name", "contig_id").join(F.broadcast(named), "name").select("id", "contig_id", "start", "end")
    return clip(named.unionByName(block).unionByName(edge).unionByName(dup), contigs)
