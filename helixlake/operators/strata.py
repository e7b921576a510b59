"""Presence in subjects and multiplicity in the query, at every position of the query."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.operators.kmers import EXACT, bloom, key_columns, keys, pieces
from helixlake.functions.sequence import CLASSES
from helixlake.operators import runs
from helixlake.operators.runs import histogram, presence
from helixlake.plans.staging import stage
from helixlake.sources.genome import index

CAP = 255


def check(subjects: Sequence[str]) -> None:
    if len(subjects) > 8 or len(set(subjects)) != len(subjects):
        raise ValueError("at most 8 subjects, each once")


def subject_bit() -> Column:
    """The bit of a tagged k-mer: tag 0 is the query, which has none, tag 1 the first subject."""
    return F.expr("CASE WHEN tag = 0 THEN 0 ELSE shiftleft(1, tag - 1) END")


def capped(rows: DataFrame, own: bool, *more: str) -> DataFrame:
    full = F.col("mult_full") if own else F.lit(0).cast("long")
    return rows.select(*more, "contig_id", "lpos", "pos", F.col("pres").cast("int").alias("pres"), F.least(full, F.lit(CAP)).cast("int").alias("mult"), full.alias("mult_full"))


def strata_ladder(contigs: DataFrame, query: str, subjects: Sequence[str], ks: Sequence[int], stride: int = 1, own: bool = True) -> DataFrame:
    """`strata` of every k at once, with a column k: the bases are read and dealt once, and the runs of all k go through one
    exchange."""
    check(subjects)
    cut = pieces(contigs.filter(F.col("genome").isin(query, *subjects)), ks)
    return capped(presence(cut, query, subjects, ks, stride), own, "k")


def strata(contigs: DataFrame, query: str, subjects: Sequence[str], k: int, stride: int = 1, own: bool = True, small_query: bool = False) -> DataFrame:
    """(contig_id, lpos, pos, pres, mult, mult_full) of each valid sampled query position.

    pres has bit i set where subject i holds the k-mer on either strand; mult_full counts it over all query positions
    (not only sampled ones), mult is that up to 255. With own=False both are 0. With small_query a Bloom filter of the
    query's k-mers, made first, keeps runs that have none of them from leaving the tasks that cut subjects' k-mers; the exact
    count follows, so results are the same. The filter is as large as the query asks, up to a bound.
    """
    check(subjects)
    cut = pieces(contigs.filter(F.col("genome").isin(query, *subjects)), [k])
    only = None
    if small_query:
        long = index(contigs, query).agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
        only = bloom(keys(cut, [k], genomes=[query], places=False, several=False), long)
    return capped(presence(cut, query, subjects, [k], stride, only=only), own)


def cells(contigs: DataFrame, query: str, subjects: Sequence[str], ks: Sequence[int], stride: int = 1, laid: DataFrame | None = None) -> DataFrame:
    """(k, mark, pres, mult, n) of the positions that `strata` has, by the mark that intervals `laid` (contig_id, start, end, mark)
    give them. Of many bases not all k are exchanged at a time: each pass is staged, and its exchange is gone before the next."""
    check(subjects)
    some = contigs.filter(F.col("genome").isin(query, *subjects))
    one = lambda ks: runs.cells(pieces(some, ks), query, subjects, ks, stride, laid)
    if len(set(ks)) == 1:
        return one(ks)
    bases = index(contigs).filter(F.col("genome").isin(query, *subjects)).agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
    parts = runs.passes(ks, bases)
    return one(ks) if len(parts) == 1 else reduce(DataFrame.unionByName, [stage(one(part), "cells") for part in parts])


def painted_cells(contigs: DataFrame, query: str, subjects: Sequence[str], ks: Sequence[int], painted: DataFrame, stride: int = 1) -> DataFrame:
    """(k, class, pres, mult, n): the cube of positions painted with disjoint pieces (contig_id, start, end, class), the first class
    where there is none. Pieces go to the query's bases, so positions neither leave their tasks nor meet intervals one by one."""
    names = F.array(*map(F.lit, CLASSES))
    got = cells(contigs, query, subjects, ks, stride, painted.select("contig_id", "start", "end", (F.array_position(names, F.col("class")) - 1).alias("mark")))
    return got.select("k", F.get(names, F.col("mark")).alias("class"), "pres", "mult", "n")


def dense(rows: DataFrame, contigs: DataFrame, query: str, stride: int = 1, block: int = 1 << 16) -> DataFrame:
    """Every sampled position of the query, with zeros where there is no valid k-mer."""
    one = index(contigs, query)
    blocks = one.withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("len") - 1, F.lit(0)), F.lit(block).cast("long")))).filter("len > 0")
    first = F.pmod(-(F.col("start") + F.col("a")), F.lit(stride))
    last = F.least(F.col("len") - F.col("a"), F.lit(block)) - 1
    every = blocks.filter(first <= last).withColumn("p", F.explode(F.sequence(first, last, F.lit(stride).cast("long"))))
    every = every.select("contig_id", (F.col("a") + F.col("p")).alias("lpos"), (F.col("start") + F.col("a") + F.col("p")).alias("pos"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(rows.drop("pos"), ["contig_id", "lpos"], "left").select("contig_id", "lpos", "pos", zero("pres"), zero("mult"), zero("mult_full"))


def subject_stats(contigs: DataFrame, query: str, subjects: Sequence[str], k: int, stride: int = 1, small_query: bool = False) -> DataFrame:
    """Per subject: its length, distinct k-mers (with small_query only those shared), and shared distinct sampled query
    k-mers and positions."""
    check(subjects)
    cut = pieces(contigs.filter(F.col("genome").isin(query, *subjects)), [k])
    rows = keys(cut, [k], genomes=[query, *subjects], places=False, several=False, sample=stride)
    sampled = ((F.col("tag") == 0) & F.col("sampled")).cast("long")
    rows = rows.select(*key_columns([k]), (F.col("tag") == 0).cast("long").alias("q"), sampled.alias("s"), subject_bit().alias("bit"))
    by_key = rows.groupBy(*key_columns([k])).agg(F.sum("q").alias("q"), F.sum("s").alias("s"), F.bit_or("bit").alias("pres"))
    if small_query:
        by_key = by_key.filter("q > 0")
    sizes = contigs.groupBy(F.col("genome").alias("subject")).agg(F.sum("len").alias("length"))
    one = F.explode(F.array(*[F.struct(F.lit(s).alias("subject"), F.when(F.col("pres").bitwiseAND(1 << i) != 0, 1).otherwise(0).alias("has")) for i, s in enumerate(subjects)])).alias("x")
    # collapse to patterns first: 256 rows a task go through the exchange
    few = by_key.groupBy("pres").agg(F.count(F.lit(1)).alias("d"), F.sum((F.col("s") > 0).cast("long")).alias("sd"), F.sum("s").alias("se"))
    per = few.select("d", "sd", "se", one).filter("x.has = 1").groupBy("x.subject").agg(F.sum("d").alias("distinct_kmers"), F.sum("sd").alias("shared_distinct"), F.sum("se").alias("shared_entries"))
    names = contigs.sparkSession.createDataFrame([(i, s) for i, s in enumerate(subjects)], "bit int, subject string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return F.broadcast(names).join(sizes, "subject", "left").join(per, "subject", "left").select("subject", "bit", zero("length"), zero("distinct_kmers"), zero("shared_distinct"), zero("shared_entries"))


def run_meta(contigs: DataFrame, query: str, subjects: Sequence[str], k: int, stride: int = 1) -> DataFrame:
    """One row describing a run: lengths, counts, subjects and the query's histogram of multiplicities."""
    own = contigs.filter(F.col("genome") == query)
    cut = pieces(own, [k])
    named = lambda df: df.withColumn("query", F.lit(query))
    total = named(own.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("query_length")))
    valid = named(keys(cut, [k], stride, genomes=[query], places=False).agg(F.count(F.lit(1)).alias("valid_entries")))
    bins = histogram(cut, [query], [k]).groupBy(F.least(F.col("mult"), F.lit(1 << 20).cast("long")).alias("mult")).agg(F.sum("kmers").alias("kmers"))
    bins = named(bins.agg(F.sort_array(F.collect_list(F.struct("mult", "kmers"))).alias("self_histogram"), F.coalesce(F.sum("kmers"), F.lit(0)).alias("query_distinct")))
    stats = named(subject_stats(contigs, query, subjects, k, stride).agg(F.sort_array(F.collect_list(F.struct("bit", "subject", "length", "distinct_kmers", "shared_distinct", "shared_entries"))).alias("subjects")))
    head = total.select("query", F.lit(k).alias("k"), F.lit(stride).alias("stride"), F.lit("exact" if k <= EXACT else "hash128").alias("mode"), "query_length", F.expr(f"(query_length + {stride - 1}) div {stride}").alias("n_entries"))
    return head.join(valid, "query").join(bins, "query").join(stats, "query")
