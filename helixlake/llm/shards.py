"""Two-pass external shuffle into shards of equal row counts, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixlake.plans.staging import stage, unstage


def _offsets(counts: DataFrame, group: int = 4096) -> DataFrame:
    """Rows before each bucket. The running sum goes by groups of buckets, so no task sees more than `group` rows or one row a group."""
    g = counts.withColumn("g", F.floor(F.col("b") / group))
    heads = g.groupBy("g").agg(F.sum("n").alias("gn"))
    before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("g", F.coalesce(F.sum("gn").over(before), F.lit(0)).alias("g0"))
    within = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    return g.withColumn("b0", F.coalesce(F.sum("n").over(within), F.lit(0))).join(heads, "g").select("b", (F.col("g0") + F.col("b0")).alias("b0"))


def _permutation(n: Column, *seeds: Column) -> Column:
    """0..n-1 as shuffled by Fisher and Yates: from the last place down, each is swapped with one not after it. The draws are
    hashes of the seeds and the place, so they don't depend on where or how often this runs."""
    swaps = F.transform(F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("i"), F.pmod(F.xxhash64(*seeds, i), (i + 1).cast("long")).cast("int").alias("j")))
    at = lambda p, i: F.coalesce(F.get(p, i), F.lit(0))
    swap = lambda p, s: F.transform(p, lambda x, k: F.when(k == s["i"], at(p, s["j"])).when(k == s["j"], at(p, s["i"])).otherwise(x))
    return F.aggregate(swaps, F.sequence(F.lit(0), n - 1), swap)


def shuffle_into_shards(df: DataFrame, n_shards: int, seed: int = 17, key: str = "doc_id", size: Column | None = None, bucket_bytes: int = 16 << 20, bucket_rows: int = 400) -> DataFrame:
    """df's rows in a seeded uniform order, cut into n_shards shards whose row counts differ by one at most.

    Pass 1 scatters whole records into buckets of about bucket_rows (and at most about bucket_bytes) by a seeded hash of
    the record, and numbers each bucket's by that hash, so that a repeated task sees the same. Pass 2 shuffles each bucket's
    numbers by Fisher and Yates, with draws from seed and bucket; records are sorted, never gathered in memory. The buckets one
    after another are one random order, fixed by seed and rows alone; shard s gets its s-th equal cut. Swaps in an array
    cost time with the square of bucket_rows, so buckets are small.

    Result: df's columns, shard int (0..n_shards-1) and slot long (gapless from 0 in each shard); columns of df with
    these names, in any case, are replaced. Nulls are kept as they are; a null key is a key, and rows of one key are spread
    by their other columns. Rows alike in all columns are all kept; they share a bucket. An empty table gives an empty
    result. All columns must be hashable (no maps).
    """
    size = F.lit(64) if size is None else size
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    buckets = max(1, -(-int(total) // bucket_bytes), -(-rows // bucket_rows))
    names = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    others = [F.col(f"`{c}`") for c in names if c != key]
    dealt = df.select(F.xxhash64(F.lit(seed), F.col(key), *others).alias("h"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    dealt = dealt.select(F.pmod("h", F.lit(buckets)).cast("long").alias("b"), "h", "row")
    sizes = dealt.groupBy("b").agg(F.count(F.lit(1)).cast("int").alias("n"))
    mixed = sizes.select("b", _permutation(F.col("n"), F.lit(seed), F.col("b")).alias("order")).join(_offsets(sizes), "b")
    within = Window.partitionBy("b").orderBy("h", F.col(f"row.`{key}`"))
    placed = dealt.withColumn("at", F.row_number().over(within) - 1).join(mixed, "b")
    placed = placed.select("row", (F.col("b0") + F.get("order", F.col("at"))).alias("rank"))
    placed = placed.withColumn("shard", F.expr(f"(rank * {n_shards}) div {max(rows, 1)}").cast("int"))
    first = F.expr(f"(shard * cast({rows} as bigint) + {n_shards - 1}) div {n_shards}")
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "shard", (F.col("rank") - first).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, n_shards: int, file_rows: int = 1_000_000, **options) -> DataFrame:
    """Shuffle df into shards and write one folder per shard under path, rows in slot order within files and from one file
    to the next. A shard of more than about `file_rows` rows is written by several tasks. Returns the written table."""
    out = stage(shuffle_into_shards(df, n_shards, **options), "shards")
    parts = n_shards * max(1, -(-out.count() // (n_shards * file_rows)))
    out.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    unstage(out)
    return df.sparkSession.read.parquet(path)
