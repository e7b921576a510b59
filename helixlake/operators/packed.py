"""Strata packed into bytes: blocks of positions with their presence and multiplicity, dense and in order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.plans.staging import ship, stage, unstage
from helixlake.sources.genome import index

#: Bases of a contig that one row covers.
BLOCK = 1 << 16


def _pack(table: pa.Table) -> pa.Table:
    """One block's rows (a block's marker, which has its shape, and its positions) as one row."""
    marker = table.column("n").is_valid().to_numpy()
    first, n, stride, contig, block = (int(table.column(c).to_numpy()[marker][0]) for c in ("first", "n", "stride", "contig_id", "block"))
    at = (table.column("lpos").to_numpy()[~marker].astype(np.int64) - first) // stride
    made = []
    for c in ("pres", "mult"):
        out = np.zeros(n, np.uint8)
        out[at] = table.column(c).to_numpy()[~marker].astype(np.uint8)
        made.append(out.tobytes())
    return pa.table({"contig_id": [contig], "block": [block], "first": [first], "n": [n], "pres": pa.array([made[0]], pa.binary()), "mult": pa.array([made[1]], pa.binary())})


def pack(rows: DataFrame, contigs: DataFrame, query: str, stride: int = 1, block: int = BLOCK) -> DataFrame:
    """(contig_id, block, first, n, pres, mult): strata as two bytes a sampled position, 0 where there is no valid k-mer.

    A row covers the n sampled positions first, first + stride, ... of `block` bases of a contig (contig-local); every block of
    the query has its row. Blocks are built from their own positions and one marker each, so nothing is joined.
    """
    ship(rows.sparkSession)
    one = index(contigs, query).filter("len > 0")
    cut = one.select("contig_id", "start", "len", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1, F.lit(block).cast("long"))).alias("a"))
    first = F.col("a") + F.pmod(-(F.col("start") + F.col("a")), F.lit(stride))
    n = F.floor((F.least(F.col("len"), F.col("a") + block) - 1 - first) / stride) + 1
    none = lambda kind: F.lit(None).cast(kind)
    markers = cut.select("contig_id", F.expr(f"a div {block}").alias("block"), none("long").alias("lpos"), none("int").alias("pres"), none("int").alias("mult"), first.alias("first"), n.alias("n"), F.lit(stride).alias("stride")).filter("n > 0")
    held = rows.select("contig_id", F.expr(f"lpos div {block}").alias("block"), "lpos", "pres", "mult", none("long").alias("first"), none("long").alias("n"), F.lit(stride).alias("stride"))
    return markers.unionByName(held).groupBy("contig_id", "block").applyInArrow(_pack, "contig_id long, block long, first long, n long, pres binary, mult binary")


def write_packed(blocks: DataFrame, path: str, genome: str, k: int, stride: int = 1, mode: str = "overwrite", group_bytes: int = 8 << 20) -> None:
    """A packed run under path/genome=.../k=.../stride=..., ranged and sorted by (contig_id, block), in row groups of about
    group_bytes, so that a region's reader skips files and row groups by their least and greatest contig_id and block. Blocks are staged
    first, as ranges come from a sample of them, and making them again costs more than their bytes."""
    made = stage(blocks, "blocks")
    out = made.withColumns({"genome": F.lit(genome), "k": F.lit(k), "stride": F.lit(stride)})
    ranged = out.repartitionByRange("contig_id", "block").sortWithinPartitions("contig_id", "block")
    ranged.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("parquet.block.size", group_bytes).partitionBy("genome", "k", "stride").parquet(path)
    unstage(made)


def read_packed(spark: SparkSession, path: str, genome: str, k: int, stride: int = 1) -> DataFrame:
    kept = (F.col("genome") == genome) & (F.col("k") == k) & (F.col("stride") == stride)
    return spark.read.parquet(path).filter(kept).drop("genome", "k", "stride")


def _spread(stride: int):
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                lo, hi = row["lo"].as_py(), row["hi"].as_py()
                pres, mult = (np.frombuffer(row[c].as_buffer(), np.uint8)[lo:hi].astype(np.int32) for c in ("pres", "mult"))
                if hi > lo:
                    lpos = row["first"].as_py() + stride * np.arange(lo, hi)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, row["contig_id"].as_py())), pa.array(lpos), pa.array(pres), pa.array(mult)], names=["contig_id", "lpos", "pres", "mult"])

    return run


def unpack(blocks: DataFrame, stride: int = 1) -> DataFrame:
    """(contig_id, lpos, pres, mult) of every sampled position of the blocks, zeros included: the dense view, without a join."""
    ship(blocks.sparkSession)
    whole = blocks.withColumns({"lo": F.lit(0).cast("long"), "hi": F.col("n")})
    return whole.select("contig_id", "first", "pres", "mult", "lo", "hi").mapInArrow(_spread(stride), "contig_id long, lpos long, pres int, mult int")


def region(blocks: DataFrame, contig_id: int, start: int, end: int, stride: int = 1, block: int = BLOCK) -> DataFrame:
    """The dense view of [start, end) of a contig: only the files, row groups and blocks that hold it are read, and only its part
    of their bytes is spread."""
    near = blocks.filter((F.col("contig_id") == contig_id) & F.col("block").between(start // block, (end - 1) // block))
    upto = lambda p: F.least(F.greatest(F.ceil((F.lit(p) - F.col("first")) / stride), F.lit(0)), F.col("n"))
    near = near.withColumns({"lo": upto(start), "hi": upto(end)})
    return near.select("contig_id", "first", "pres", "mult", "lo", "hi").mapInArrow(_spread(stride), "contig_id long, lpos long, pres int, mult int")
