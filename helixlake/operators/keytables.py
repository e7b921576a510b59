"""K-mers of genomes written once, bucketed by key, for runs with any subjects, stride and multiplicity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.operators.kmers import genome_of, key_columns, keys, pieces
from helixlake.operators.strata import capped, check

#: K-mers that a bucket is to hold at most, copies counted.
BUCKET_KEYS = 1 << 23


def write_keys(contigs: DataFrame, k: int, genomes: Sequence[str], table: str, path: str | None = None, buckets: int = 64) -> DataFrame:
    """Count the k-mers of each genome into a table (genome, key[, key2], n), a folder for each genome, in `buckets` files by key, or
    more where genomes are so long that a bucket would have more than BUCKET_KEYS k-mers, sorted by it. Later runs read the buckets of the genomes they need side by side, so subjects' k-mers are
    exchanged here and never again. A bucket is what one task of a run holds, so its memory doesn't grow with the genomes.
    """
    spark = contigs.sparkSession
    by = key_columns([k])
    bases = getattr(contigs, "_index", contigs).filter(F.col("genome").isin(list(genomes))).agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
    buckets = max(buckets, -(-bases // BUCKET_KEYS))
    rows = keys(pieces(contigs.filter(F.col("genome").isin(list(genomes))), [k]), [k], genomes=genomes, places=False)
    counted = rows.groupBy("tag", *by).agg(F.count(F.lit(1)).alias("n"))
    out = counted.select(*by, "n", genome_of(F.col("tag"), genomes).alias("genome")).repartition(buckets, *by)
    writer = out.write.format("parquet").partitionBy("genome").bucketBy(buckets, *by).sortBy(*by)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return spark.table(table)


def strata_from_keys(spark: SparkSession, table: str, contigs: DataFrame, query: str, subjects: Sequence[str], k: int, stride: int = 1, own: bool = True) -> DataFrame:
    """`strata.strata` of a query whose k-mers, and whose subjects', `write_keys` has in a table. contigs need only hold the query."""
    check(subjects)
    by = key_columns([k])
    bit = F.lit(0)
    for i, s in enumerate(subjects):
        bit = F.when(F.col("genome") == s, 1 << i).otherwise(bit)
    found = spark.table(table).filter(F.col("genome").isin(query, *subjects))
    found = found.select(*by, F.when(F.col("genome") == query, F.col("n")).otherwise(0).alias("q"), bit.alias("bit"))
    found = found.groupBy(*by).agg(F.sum("q").alias("mult_full"), F.bit_or("bit").alias("pres")).filter("mult_full > 0")
    at = keys(pieces(contigs.filter(F.col("genome") == query), [k]), [k], stride, genomes=[query]).drop("tag")
    return capped(at.join(found, by), own)

