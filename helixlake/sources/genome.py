"""Sequence collections as DataFrames of contigs: genome, contig_id, name, seq BINARY (letters ACGTN), len, start."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixlake.functions.sequence import region_class
from helixlake.plans.staging import ship, stage


#: Contig ids that one window group orders.
SPAN = 4096
#: Contigs up to which their offsets are broadcast (some 30 bytes each); of more, they are joined by an exchange.
BROADCAST_CONTIGS = 200_000


def offsets(sizes: DataFrame) -> DataFrame:
    """(genome, contig_id, ..., start, len) from rows with genome, contig_id and len, staged: start is a contig's offset in its
    genome in the order of contig_id. Ids are windowed by spans: sums before each span first, then within it, so no
    task orders a whole genome's contigs."""
    names = [c for c in sizes.columns if c != "len"]
    sizes = sizes.withColumn("span", F.floor(F.col("contig_id") / SPAN))
    before = Window.partitionBy("genome").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("genome", "span").orderBy("contig_id")
    inner = sizes.withColumn("upto", F.sum("len").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    last = inner.groupBy("genome", "span").agg(F.max("upto").alias("n"))
    spans = last.select("genome", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    table = inner.join(spans, ["genome", "span"]).select(*names, (F.col("base") + F.col("upto") - F.col("len")).alias("start"), "len")
    return stage(table, "starts")


def with_starts(contigs: DataFrame) -> DataFrame:
    """Add len and start, a contig's offset in its genome in the order of contig_id. The offsets are staged, now: sequences are read
    once for their lengths, whatever follows, and are not exchanged where the offsets, counted, are few enough to be broadcast.
    """
    sized = contigs if "len" in contigs.columns else contigs.withColumn("len", F.length("seq").cast("long"))
    table = offsets(sized.select("genome", "contig_id", *[c for c in ("name",) if c in sized.columns], "len"))
    small = table.count() <= BROADCAST_CONTIGS
    starts = table.select("genome", "contig_id", "start")
    out = sized.join(F.broadcast(starts) if small else starts, ["genome", "contig_id"])
    out._index = table
    return out


def prepared(contigs: DataFrame) -> DataFrame:
    """Contigs written once, for queries of many passes, which then read coded bases instead of coding them again.
    staging.unstage deletes them."""
    placed = contigs if "start" in contigs.columns else with_starts(contigs)
    return stage(placed, "genome")


_BASES = np.full(256, ord("N"), np.uint8)
_BASES[:33] = 0
for _x in b"ACGT":
    _BASES[[_x, _x + 32]] = _x


def _parse_fasta(batches):
    """Lines as rows: a header with its name, or the bases of the lines up to the next header, numbered within their split."""
    split, part = None, 0
    for batch in batches:
        value = batch.column("value").cast(pa.binary())
        at = np.frombuffer(value.buffers()[1], np.int32, len(value) + 1 + value.offset)[value.offset :]
        raw = np.frombuffer(value.buffers()[2] or b"", np.uint8)
        file, block = batch.column("file").to_pylist(), batch.column("block").to_numpy()
        filled = at[1:] > at[:-1]
        head = np.zeros(len(value), bool)
        head[filled] = raw[at[:-1][filled]] == ord(">")
        edge = np.ones(len(value), bool)
        edge[1:] = (block[1:] != block[:-1]) | np.array([a != b for a, b in zip(file[1:], file, strict=False)], bool) | head[1:] | head[:-1]
        firsts = np.flatnonzero(edge)
        rows = []
        for i, j in zip(firsts, [*firsts[1:], len(value)], strict=True):
            if (file[i], block[i]) != split:
                split, part = (file[i], block[i]), 0
            line = raw[at[i] : at[j]]
            if head[i]:
                words = line[1:].tobytes().decode("utf-8", "replace").split()
                rows.append((*split, part, words[0] if words else "", b""))
            else:
                coded = _BASES[line]
                rows.append((*split, part, None, coded[coded != 0].tobytes()))
            part += 1
        if rows:
            file, block, number, name, seq = zip(*rows, strict=True)
            cols = [pa.array(file), pa.array(block, pa.int64()), pa.array(number, pa.int64()), pa.array(name, pa.string()), pa.array(seq, pa.binary()), pa.array(map(len, seq), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["file", "block", "part", "name", "seq", "n"])


def read_fasta_parts(spark: SparkSession, paths: str | Sequence[str], genome: str, include: str | None = None) -> DataFrame:
    """FASTA files, plain or gzipped, as parts of contigs: genome, contig_id, name, off (of the part in its contig), seq, n, len and
    start (of the contig). A contig is cut wherever its file is, so one of any length is read by many tasks.

    Contigs are in the order of the paths given, then of file names, then of lines. A name is the header's first word; `include`
    keeps contigs whose name contains it, the others taking no offset; what precedes a path's first header is dropped
    if no path before it has one, and else goes on with the contig before. Parts are staged as coded bases; of each
    split of a file only its number of headers and of bases after the last one go into running sums over all splits.
    """
    ship(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    read = None
    for i, path in enumerate(paths):
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        one = lines.mapInArrow(_parse_fasta, "file string, block long, part long, name string, seq binary, n long").withColumn("source", F.lit(i))
        read = one if read is None else read.unionByName(one)
    read = stage(read, "fasta")
    split = ["source", "file", "block"]
    inner = Window.partitionBy(*split).orderBy("part")
    rows = read.select(*split, "part", "name", "n").withColumn("heads", F.sum(F.col("name").isNotNull().cast("long")).over(inner))
    before = Window.partitionBy(*split, "heads").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sums = rows.groupBy(*split, "heads").agg(F.sum("n").alias("n")).groupBy(*split).agg(F.max("heads").alias("h"), F.max_by("n", "heads").alias("tail"))
    order = Window.orderBy(*split)  # a row for each split of the files
    sums = sums.withColumn("earlier", F.sum("h").over(order) - F.col("h")).withColumn("group", F.sum((F.col("h") > 0).cast("int")).over(order))
    upto = F.sum("tail").over(Window.partitionBy("group").orderBy(*split).rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("upto", upto).withColumn("carry", F.coalesce(F.lag("upto").over(order), F.lit(0)))
    placed = rows.join(sums.select(*split, "earlier", "carry"), split)
    placed = placed.withColumn("contig_id", F.col("earlier") + F.col("heads") - 1).withColumn("off", F.col("inner") + F.when(F.col("heads") == 0, F.col("carry")).otherwise(0)).filter("contig_id >= 0")
    sizes = placed.groupBy("contig_id").agg(F.max("name").alias("name"), F.sum("n").alias("len")).select(F.lit(genome).alias("genome"), "contig_id", "name", "len")
    table = offsets(sizes if include is None else sizes.filter(F.contains("name", F.lit(include))))
    parts = placed.filter("n > 0").select(*split, "part", "contig_id", "off")
    out = read.drop("name").join(parts, [*split, "part"]).join(table, "contig_id")
    out = out.select("genome", "contig_id", "name", "off", "seq", "n", "len", "start")
    out._index = table
    return out


def read_fasta(spark: SparkSession, paths: str | Sequence[str], genome: str, include: str | None = None) -> DataFrame:
    """The same with each contig's bases in one row, for contigs of some megabases at most."""
    parts = read_fasta_parts(spark, paths, genome, include)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("off", F.col("seq").cast("string").alias("s")))), lambda x: x["s"]), "")
    seqs = parts.groupBy("contig_id").agg(joined.cast("binary").alias("seq"))
    table = parts._index
    out = table.join(seqs, "contig_id", "left").select("genome", "contig_id", "name", F.coalesce("seq", F.lit(b"")).alias("seq"), "len", "start")
    out._index = table
    return out


def _letters(letters_only: bool):
    """Lower-case texts as letters: a to z stand for A, C, G, T in turn; white space and control bytes go; what else there is, one
    letter in however many bytes, is N, or goes too."""
    table = np.zeros(256, np.uint8)
    if not letters_only:
        table[0x21:0x80] = table[0xC0:] = ord("N")
    table[ord("a") : ord("z") + 1] = np.frombuffer((b"ACGT" * 7)[:26], np.uint8)

    def run(batches):
        for batch in batches:
            text = batch.column("text").fill_null("").cast(pa.large_binary())
            at = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1 + text.offset)[text.offset :]
            raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            step = 0
            while step < len(text):  # a few MB at a time
                end = max(step + 1, int(np.searchsorted(at, at[step] + (4 << 20), "right")) - 1)
                coded = table[raw[at[step] : at[end]]]
                kept = coded != 0
                left = np.concatenate(([0], np.cumsum(kept)))[at[step : end + 1] - at[step]]
                seq = pa.Array.from_buffers(pa.binary(), end - step, [None, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(coded[kept])])
                cut = [batch.column(c).slice(step, end - step) for c in ("genome", "contig_id", "name")]
                yield pa.RecordBatch.from_arrays([*cut, seq, pa.array(np.diff(left))], names=["genome", "contig_id", "name", "seq", "len"])
                step = end

    return run


def from_texts(df: DataFrame, genome: Column, contig_id: Column, text: Column, letters_only: bool = False, include: str | None = None, starts: bool = True) -> DataFrame:
    """Contigs made of a table's texts, so that any corpus can be analysed like a genome collection. Without `starts` they have no
    offsets in their genome: enough, and cheaper, for what doesn't ask where a k-mer is."""
    ship(df.sparkSession)
    out = df.select(genome.alias("genome"), contig_id.cast("long").alias("contig_id"), F.concat(F.lit("d"), contig_id.cast("string")).alias("name"), F.lower(text).alias("text"))
    out = out if include is None else out.filter(F.contains("name", F.lit(include)))
    out = out.mapInArrow(_letters(letters_only), "genome string, contig_id long, name string, seq binary, len long")
    return with_starts(out) if starts else out


def only(contigs: DataFrame, names: Sequence[str] | None = None, without: Sequence[str] = ()) -> DataFrame:
    """The contigs of the given names (all, if none are given), less those of `without`. Offsets stay those of the genome."""
    out = contigs if names is None else contigs.filter(F.col("name").isin(list(names)))
    return out.filter(~F.col("name").isin(list(without))) if without else out


def index(contigs: DataFrame, genome: str | None = None) -> DataFrame:
    """name, start, len of each contig (of one genome): from the staged offsets where contigs are as with_starts gave them, so
    that sequences aren't read for it."""
    table = getattr(contigs, "_index", contigs)
    table = table if genome is None else table.filter(F.col("genome") == genome)
    return table.select("genome", "contig_id", "name", "start", "len")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="name string, start long, len long")


def read_bed(spark: SparkSession, path: str, release: str | None = None, cls: str | None = None) -> DataFrame:
    """Intervals (chrom, start, end, class, ord) in file order: one class for all, or each from the label's family.
    Track and comment lines and labels of no class are skipped."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    lines = lines.filter(~F.col("value").startswith("track") & ~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.split("value", "\t")
    label = F.lit(cls) if cls else region_class(f[3], release or "chm13")
    out = lines.select(f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"), label.alias("class"), "ord")
    return out.filter(F.col("class").isNotNull())


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """Alignments: query and target columns, strand, and the tags as a map."""
    f = F.split(F.col("value"), "\t")
    tags = F.map_from_entries(F.transform(F.slice(f, 13, 1000), lambda t: F.struct(F.substring(t, 1, 4), F.substring(t, 6, 1 << 30))))
    names = ["qname", "qlen", "qstart", "qend", "strand", "tname", "tlen", "tstart", "tend", "matches", "block", "mapq"]
    cast = lambda i, n: f[i] if n in ("qname", "strand", "tname") else f[i].cast("long")
    return spark.read.text(path).select(*[cast(i, n).alias(n) for i, n in enumerate(names)], tags.alias("tags"))
