"""Where results go: partitioned Parquet, tab-separated tables, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_strata(rows: DataFrame, path: str, genome: str, k: int, mode: str = "overwrite", length: int | None = None) -> None:
    """Position tables under path/genome=.../k=..., files sorted by position so that row groups can be skipped.

    Only the run's own partition is replaced; runs of other genomes and k stay. With the genome's length, files are equal ranges
    of it; without, ranges come from a sample of rows, for which these are computed once more.
    """
    out = rows.withColumn("genome", F.lit(genome)).withColumn("k", F.lit(k))
    if length is None:
        ranged = out.repartitionByRange("pos")
    else:
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        width = max(1, -(-length // n))
        ranged = out.repartitionById(n, F.least(F.floor(F.col("pos") / width), F.lit(n - 1)).cast("int"))
    ranged = ranged.sortWithinPartitions("pos")
    ranged.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("genome", "k").parquet(path)


def read_strata(spark: SparkSession, path: str, genome: str, k: int) -> DataFrame:
    """One run; a filter on contig_id and lpos or pos reads only the files and row groups that hold it."""
    return spark.read.parquet(path).filter((F.col("genome") == genome) & (F.col("k") == k)).drop("genome", "k")


def write_table(table: DataFrame, path: str, compress: bool = False, mode: str = "overwrite") -> None:
    """Class tables and window tracks as tab-separated text with a header, gzipped on request."""
    table.write.mode(mode).option("sep", "\t").option("header", True).option("compression", "gzip" if compress else "none").csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, inferSchema=True)


def write_json(meta: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Run descriptions, a line each, nested fields kept."""
    meta.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def write_fasta(contigs: DataFrame, path: str, width: int = 60, mode: str = "overwrite", compress: bool = False) -> None:
    """Contigs as FASTA text, lines of `width` bases, a folder of files that follow the order of contig_id by name and by line."""
    wrapped = F.regexp_replace(F.col("seq").cast("string"), f"(.{{{width}}})(?=.)", "$1\n")
    ordered = contigs.repartitionByRange("contig_id").sortWithinPartitions("contig_id")
    ordered.select(F.concat(F.lit(">"), "name", F.lit("\n"), wrapped)).write.mode(mode).option("compression", "gzip" if compress else "none").text(path)


def write_bed(intervals: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(chrom, start, end, label) as BED."""
    intervals.select(F.concat_ws("\t", "chrom", "start", "end", "label")).write.mode(mode).text(path)


def write_paf(alignments: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Alignments with the twelve columns that read_paf gives, their tags as kind:type:value."""
    names = ["qname", "qlen", "qstart", "qend", "strand", "tname", "tlen", "tstart", "tend", "matches", "block", "mapq"]
    tags = F.transform(F.map_entries("tags"), lambda t: F.concat(t["key"], F.lit(":"), t["value"]))
    alignments.select(F.concat_ws("\t", *names, tags)).write.mode(mode).text(path)
