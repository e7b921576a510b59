"""A uniform random genome as a negative control."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.plans.staging import ship

#: Fixed values of the counter-based generator (splitmix64); a word gives 32 bases, low bits first.
GAMMA, START, MUL1, MUL2 = 0x9E3779B97F4A7C15, 0x12345678, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
PIECE = 1 << 15  # words that one row of the source draws


def _draw(seed: int):
    letters = np.frombuffer(b"ACGT", np.uint8)

    def run(batches):
        for b in batches:
            seqs = []
            for first, words, bases in zip(*(b.column(c).to_pylist() for c in ("word", "words", "bases")), strict=True):
                with np.errstate(over="ignore"):
                    n = np.arange(first + 1, first + words + 1, dtype=np.uint64)
                    z = np.uint64((seed * GAMMA + START) % 2**64) + n * np.uint64(GAMMA)
                    z = (z ^ (z >> np.uint64(30))) * np.uint64(MUL1)
                    z = (z ^ (z >> np.uint64(27))) * np.uint64(MUL2)
                    z ^= z >> np.uint64(31)
                codes = (z[:, None] >> (2 * np.arange(32, dtype=np.uint64))) & np.uint64(3)
                seqs.append(letters[codes.ravel()[:bases].astype(np.int64)].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("contig_id"), b.column("at"), pa.array(seqs, pa.binary())], names=["contig_id", "at", "seq"])

    return run


def random_genome(spark: SparkSession, length: int, seed: int = 1, contig: int = 100_000_000, genome: str = "random") -> DataFrame:
    """Contigs rand0, rand1, ... of `contig` bases (the last may be shorter), drawn in parallel pieces."""
    ship(spark)
    n = -(-length // contig)
    each = -(-contig // 32)  # words of a full contig
    rows = spark.range(n).select(F.col("id").alias("contig_id"), F.least(F.lit(contig), F.lit(length) - F.col("id") * contig).cast("long").alias("bases"))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(bases + 31) div 32 - 1"), F.lit(PIECE).cast("long"))))
    rows = rows.select("contig_id", "at", (F.col("contig_id") * each + F.col("at")).alias("word"), F.least(F.lit(PIECE).cast("long"), F.expr("(bases + 31) div 32") - F.col("at")).alias("words"), F.least(F.lit(PIECE * 32).cast("long"), F.col("bases") - 32 * F.col("at")).alias("bases"))
    drawn = rows.repartition(max(1, min(n * each // PIECE, 10_000))).mapInArrow(_draw(seed), "contig_id long, at long, seq binary")
    ordered = drawn.groupBy("contig_id").agg(F.sort_array(F.collect_list(F.struct("at", "seq"))).alias("p"))
    whole = F.concat_ws("", F.transform("p", lambda x: x["seq"].cast("string"))).cast("binary")
    out = ordered.select(F.lit(genome).alias("genome"), "contig_id", F.concat(F.lit("rand"), F.col("contig_id").cast("string")).alias("name"), whole.alias("seq"))
    return out.withColumn("len", F.length("seq").cast("long")).withColumn("start", F.col("contig_id") * contig)
