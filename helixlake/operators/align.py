"""Soundness of presence against alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixlake.operators.intervals import disjoint, merge, paint


def exact_runs(alignments: DataFrame) -> DataFrame:
    """(aln, qstart, qend, a, b) in query coordinates: stretches of `=` that nothing interrupts. alignments: aln, qstart,
    qend, strand, cigar. Adjacent `=` operations are one stretch; a deletion or insertion ends it. For the reverse
    strand the stretches themselves are turned round."""
    ops = F.arrays_zip(F.regexp_extract_all("cigar", F.lit(r"(\d+)([=XIDM])"), F.lit(1)).alias("n"), F.regexp_extract_all("cigar", F.lit(r"(\d+)([=XIDM])"), F.lit(2)).alias("op"))
    steps = alignments.filter("cigar is not null").select("aln", "qstart", "qend", "strand", F.posexplode(ops).alias("i", "x"))
    steps = steps.select("aln", "qstart", "qend", "strand", "i", F.col("x.n").cast("long").alias("n"), F.col("x.op").alias("op"))
    order = Window.partitionBy("aln").orderBy("i")
    used = F.when(F.col("op") == "D", 0).otherwise(F.col("n"))
    steps = steps.withColumn("to", F.sum(used).over(order)).withColumn("from", F.col("to") - used)
    new = F.coalesce((F.col("op") != F.lag("op").over(order)) | (F.col("op") != "="), F.lit(True))
    steps = steps.withColumn("run", F.sum(new.cast("int")).over(order)).filter("op = '='")
    runs = steps.groupBy("aln", "qstart", "qend", "strand", "run").agg(F.min("from").alias("f"), F.max("to").alias("t"))
    length = F.col("qend") - F.col("qstart")
    turned = F.col("strand") == "-"
    a = F.col("qstart") + F.when(turned, length - F.col("t")).otherwise(F.col("f"))
    return runs.select("aln", "qstart", "qend", a.alias("a"), (a + F.col("t") - F.col("f")).alias("b"))


def exact_starts(alignments: DataFrame, k: int) -> DataFrame:
    """(aln, p): query positions whose k-mer lies in one stretch."""
    runs = exact_runs(alignments).filter(F.col("b") - F.col("a") >= k)
    return runs.select("aln", F.explode(F.sequence(F.col("a"), F.col("b") - k)).alias("p"))


def place(alignments: DataFrame, contigs: DataFrame) -> DataFrame:
    """Alignments with the contig_id and start of the contig that qname names; those of no such contig go."""
    return alignments.join(contigs.select(F.col("name").alias("qname"), "contig_id", F.col("start").alias("offset")), "qname")


def _intervals(alignments: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What positions meet: exact stretches; the last primary alignment's word, exact or broken; what primary ones cover."""
    runs = exact_runs(alignments).filter(F.col("b") - F.col("a") >= k).join(alignments.select("aln", "contig_id", "tp"), "aln")
    exact = runs.select("aln", "contig_id", "tp", F.col("a").alias("start"), (F.col("b") - k + 1).alias("end"))
    main = alignments.filter("tp = 'P' and cigar is not null and qstart < qend")
    whole = main.select("contig_id", F.col("qstart").alias("start"), (F.col("qend") - k + 1).alias("end"), F.lit("broken").alias("class"), (F.col("aln") * 2).alias("ord")).filter("start < end")
    inside = exact.filter("tp = 'P'").select("contig_id", "start", "end", F.lit("exact").alias("class"), (F.col("aln") * 2 + 1).alias("ord"))
    span = main.select("contig_id", F.col("qstart").alias("start"), F.col("qend").alias("end"))
    return merge(exact), disjoint(whole.unionByName(inside)), merge(span)


#: What each interval adds to the mark of its positions.
EXACTLY, BROKEN, UNBROKEN, COVERED = 1, 2, 4, 8


def layers(alignments: DataFrame, k: int) -> DataFrame:
    """(contig_id, start, end, mark): the intervals that `concordance` paints positions with, as marks for strata.cells."""
    exact, last, span = _intervals(alignments, k)
    laid = lambda df, mark: df.select("contig_id", "start", "end", mark.alias("mark"))
    return laid(exact, F.lit(EXACTLY)).unionByName(laid(last, F.when(F.col("class") == "exact", UNBROKEN).otherwise(BROKEN))).unionByName(laid(span, F.lit(COVERED)))


def concordance_of_cells(cells: DataFrame, present: Column) -> DataFrame:
    """`concordance` of positions counted by mark: cells (mark, pres, mult, n) with the marks of `layers`."""
    has = lambda bit: F.col("mark").bitwiseAND(bit) != 0
    counts = _counts(F.col("mult") > 0, present, F.col("mult") == 1, has(EXACTLY), has(BROKEN), has(COVERED))
    return cells.agg(*[F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0)).alias(n) for n, x in counts.items()])


def _counts(valid: Column, present: Column, one: Column, exact: Column, broken: Column, covered: Column) -> dict[str, Column]:
    a, b, c = valid & exact, valid & ~exact & broken, valid & ~covered
    return {"valid": valid, "present": valid & present, "exact": a, "exact_present": a & present, "broken": b, "broken_present": b & present, "broken_single": b & one, "broken_single_present": b & one & present, "uncovered": c, "uncovered_present": c & present}


def concordance(alignments: DataFrame, positions: DataFrame, k: int) -> DataFrame:
    """Counts over query positions (contig_id, lpos, valid, present, mult) against alignments (aln, contig_id, qstart, qend,
    strand, cigar, tp), both contig-local.

    A position is exact if its k-mer lies in one stretch of matches of any alignment. It is broken if it is not exact and
    the last primary alignment (tp = P, largest aln) that holds its whole k-mer is not exact there; uncovered if no primary
    alignment holds it. Exact, broken and uncovered positions are told apart by presence, broken ones by single copy too.
    Stretches and spans stay intervals, so what alignments add to positions goes with their operations, not with their bases:
    an alignment's exact stretches lie over its span, and a later alignment's over an earlier one's.
    """
    exact, last, span = _intervals(alignments, k)
    each = paint(positions, exact.withColumn("class", F.lit("yes")), "exact", "no")
    each = paint(each, last, "last", "none")
    each = paint(each, span.withColumn("class", F.lit("yes")), "covered", "no")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    tests = _counts(yes("valid"), yes("present"), F.col("mult") == 1, F.col("exact") == "yes", F.col("last") == "broken", F.col("covered") == "yes")
    return each.agg(*[F.count_if(x).alias(n) for n, x in tests.items()])
