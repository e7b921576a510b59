"""Token ids of documents in compact files of independently coded blocks, in ascending order of doc_id, and their reader."""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from helixlake.llm import mixcoder
from helixlake.llm.arrowio import slices, texts
from helixlake.llm.packing import WordIds
from helixlake.plans.staging import ship, stage

#: Bytes of text, about, whose ids go into one file: the work of one task.
FILE_BYTES = 32 << 20
#: Marks in a directory: the document has no doc_id; it began before this block; it goes on after it.
NO_ID, BEGAN, GOES_ON = 1, 2, 4
_FILE = "file int, block int, first long, n long, data binary"
_coders: dict[str, WordIds] = {}


class _Writer:
    """Fills blocks with documents. A block ends with a document, unless that alone is longer than a block."""

    def __init__(self, file: int):
        self.file, self.blocks_done, self.ids_done, self.documents = file, 0, 0, 0
        self.ready: list[tuple[np.ndarray, int, bytes]] = []
        self._new()

    def _new(self) -> None:
        self.parts, self.held = [], 0
        self.entries: list[tuple[int, int, int]] = []

    def _end_block(self) -> None:
        if not self.held:
            return
        doc_ids, counts, marks = (np.array(x, t) for x, t in zip(zip(*self.entries, strict=True), ("<i8", "<u4", "u1"), strict=True))
        ends = sum(not m & GOES_ON for _, _, m in self.entries)
        head = struct.pack("<QI", self.documents, len(self.entries))
        self.ready.append((np.concatenate(self.parts), self.ids_done, head + doc_ids.tobytes() + counts.tobytes() + marks.tobytes()))
        self.documents += ends
        self.ids_done += self.held
        self._new()

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        mark = NO_ID if doc_id is None else 0
        if self.held + len(ids) > mixcoder.BLOCK:
            self._end_block()
        at = 0
        while len(ids) - at > mixcoder.BLOCK:
            self._put(doc_id, ids[at : at + mixcoder.BLOCK], mark | GOES_ON)
            self._end_block()
            at, mark = at + mixcoder.BLOCK, mark | BEGAN
        self._put(doc_id, ids[at:], mark)

    def _put(self, doc_id: int | None, ids: np.ndarray, mark: int) -> None:
        self.parts.append(ids)
        self.entries.append((doc_id or 0, len(ids), mark))
        self.held += len(ids)

    def coded(self, last: bool = False):
        """The blocks that fill a group (all that there are, at the end) as a batch of rows."""
        if last:
            self._end_block()
        while len(self.ready) >= (1 if last else mixcoder.LANES):
            some, self.ready = self.ready[: mixcoder.LANES], self.ready[mixcoder.LANES :]
            ids, firsts, directories = map(list, zip(*some, strict=True))
            data = mixcoder.encode(ids, firsts, directories)
            k = len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.file] * k, pa.int32()), pa.array(range(self.blocks_done, self.blocks_done + k), pa.int32()), pa.array(firsts, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array(data, pa.binary())],
                names=["file", "block", "first", "n", "data"],
            )
            self.blocks_done += k


def _write(tokenizer_path: str, end_id: int):
    def run(batches):
        if tokenizer_path not in _coders:
            _coders[tokenizer_path] = WordIds(tokenizer_path)
        coder, end = _coders[tokenizer_path], np.array([end_id], "<u4").tobytes()
        writer = _Writer(TaskContext.get().partitionId())
        for batch in batches:
            for part in slices(batch):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), coder.encode(texts(part)), strict=True):
                    writer.add(doc_id, np.frombuffer(ids + end, "<u4"))
                yield from writer.coded()
        yield from writer.coded(last=True)

    return run


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, file_bytes: int = FILE_BYTES) -> None:
    """Write the token ids of docs.text, each document's followed by `end_id`, under path.

    Texts are ranged by doc_id (rows of one doc_id, or without any, by a hash of the text), so that file after file and
    block after block the documents ascend; nulls come first. One task encodes one range, so ids are never shuffled; it
    holds LANES blocks at most. A file is a Parquet file of rows (file, block, first, n, data); data is a block as
    `mixcoder.encode` lays it out, with a directory of its documents: ordinal in the file of the first (64 bits) and their
    number (32), then doc_ids (64), numbers of ids here (32) and marks (8). A repeated task writes the same bytes.
    A null text is empty, so has only the end id; an empty table gives no blocks; columns other than doc_id and text are not read.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    ranged = docs.withColumn("h", F.xxhash64("text")).repartitionByRange(max(1, -(-total // file_bytes)), "doc_id", "h")
    ranged = ranged.sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    ranged.mapInArrow(_write(tokenizer_path, end_id), _FILE).write.option("compression", "none").parquet(path)


def _read(keep_ids: bool):
    names = ["file", "ordinal", "doc_id", "first", "n_tokens", "ids_crc32", "marks"] + ["ids"] * keep_ids

    def run(batches):
        for batch in batches:
            cols: dict[str, list] = {c: [] for c in names}
            for file, (ids, first, told) in zip(batch.column("file").to_pylist(), mixcoder.decode(batch.column("data").to_pylist()), strict=True):
                ordinal, k = struct.unpack_from("<QI", told)
                doc_ids, counts = np.frombuffer(told, "<i8", k, 12), np.frombuffer(told, "<u4", k, 12 + 8 * k)
                marks = np.frombuffer(told, "u1", k, 12 + 12 * k)
                ends = np.cumsum(counts, dtype=np.int64)
                raw = ids.astype("<u4").tobytes()
                cuts = [0, *ends.tolist()]
                cols["file"].append(np.full(k, file))
                cols["ordinal"].append(ordinal + np.arange(k))
                cols["doc_id"].append(np.ma.array(doc_ids, mask=marks & NO_ID != 0))
                cols["first"].append(first + ends - counts)
                cols["n_tokens"].append(counts.astype(np.int64))
                cols["ids_crc32"].append(np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:], strict=False)]))
                cols["marks"].append(marks.astype(np.int32))
                if keep_ids:
                    cols["ids"] += [ids[a:b].astype(np.int64) for a, b in zip(cuts, cuts[1:], strict=False)]
            if not cols["file"]:
                continue
            out = []
            for c in names:
                if c == "ids":
                    out.append(pa.array(cols[c], pa.list_(pa.int64())))
                elif c == "doc_id":
                    out.append(pa.array(np.concatenate([x.data for x in cols[c]]), pa.int64(), mask=np.concatenate([np.ma.getmaskarray(x) for x in cols[c]])))
                else:
                    out.append(pa.array(np.concatenate(cols[c]), pa.int32() if c in ("file", "marks") else pa.int64()))
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def read_pieces(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """Decode what `write_ids` wrote: file, ordinal (of the document in its file), doc_id, first (ids before it in its file),
    n_tokens, ids_crc32, marks, and ids with keep_ids. A document longer than a block comes in a row for each of its
    blocks. Blocks are decoded wherever they are read; damage to one raises mixcoder.Damaged there."""
    ship(spark)
    schema = "file int, ordinal long, doc_id long, first long, n_tokens long, ids_crc32 long, marks int" + ", ids array<long>" * keep_ids
    return spark.read.schema(_FILE).parquet(path).select("file", "data").mapInArrow(_read(keep_ids), schema)


@functools.lru_cache(4096)
def _zeros(length: int) -> tuple[int, ...]:
    """What `length` zero bytes do to each bit of a crc32: the squares of what one does, multiplied by the bits of length."""
    step = [0xEDB88320, *(1 << i for i in range(31))]  # a zero bit

    def times(m, x: int) -> int:
        out = 0
        for row in m:
            if x & 1:
                out ^= row
            x >>= 1
        return out

    out, bits = [1 << i for i in range(32)], 8 * length
    while bits:
        if bits & 1:
            out = [times(step, x) for x in out]
        step = [times(step, x) for x in step]
        bits >>= 1
    return tuple(out)


def joined_crc(pieces: list[tuple[int, int]]) -> int:
    """The crc32 of bytes of which successive pieces have these (crc32, length)."""
    crc = 0
    for own, length in pieces:
        turned = 0
        for i, row in enumerate(_zeros(length)):
            if crc >> i & 1:
                turned ^= row
        crc = turned ^ own
    return crc


def _before(counts: DataFrame, group: int = 4096) -> DataFrame:
    """(file, base): ids in all files before. Sums go by groups of files, so no task orders more than these or their heads."""
    g = counts.withColumn("g", F.floor(F.col("file") / group))
    ahead = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    heads = g.groupBy("g").agg(F.sum("n").alias("gn")).select("g", F.coalesce(F.sum("gn").over(ahead), F.lit(0)).alias("g0"))
    within = Window.partitionBy("g").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return g.withColumn("f0", F.coalesce(F.sum("n").over(within), F.lit(0))).join(heads, "g").select("file", (F.col("g0") + F.col("f0")).alias("base"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of the files: doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of its ids as
    little-endian unsigned 32-bit integers). Checksums of long documents are joined from those of their pieces, not from ids.
    All files are decoded once, now; what the result reads is a row for each piece, staged in the shared folder."""

    @pandas_udf("long")
    def together(parts: pd.Series) -> pd.Series:
        return pd.Series([joined_crc([(p["ids_crc32"], 4 * p["n_tokens"]) for p in some]) for some in parts], dtype="int64")

    pieces = stage(read_pieces(spark, path), "id-pieces")
    cut = F.col("marks").bitwiseAND(BEGAN | GOES_ON) != 0
    whole = pieces.filter(~cut).select("file", "doc_id", "first", "n_tokens", "ids_crc32")
    parts = F.sort_array(F.collect_list(F.struct("first", "n_tokens", "ids_crc32")))
    long = pieces.filter(cut).groupBy("file", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.min("first").alias("first"), F.sum("n_tokens").alias("n_tokens"), parts.alias("parts"))
    long = long.select("file", "doc_id", "first", "n_tokens", together("parts").alias("ids_crc32"))
    bases = _before(pieces.groupBy("file").agg(F.sum("n_tokens").alias("n")))
    return whole.unionByName(long).join(bases, "file").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
