"""Canonical k-mers of contigs, for one k or a whole ladder of k at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.plans.staging import ship

#: Positions in a chunk: the unit of parallel work, whatever a contig's length.
CHUNK = 4096
#: K-mers up to this are packed into 64 bits, two a base. Longer ones are keyed by 128 bits of hash, so that shuffled rows
#: don't grow with k.
EXACT = 32
LONGEST = 1 << 24
#: Bases, about, that a task works on at a time: what it holds is this many numbers for each power of two up to k.
SLICE = 1 << 17
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.full(256, 4, np.uint8)
_LETTER[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def pieces(contigs: DataFrame, ks: Sequence[int], chunk: int | None = None) -> DataFrame:
    """Contigs cut into chunks of k-mer starts, each with the bases after it that the longest k needs, dealt evenly. All k and
    all genomes read the same cut, so a plan that uses it several times codes and shuffles the bases once.

    Columns: genome, contig_id, a (first start in the contig), base (in the genome; a where contigs have no start), f.
    """
    chunk = chunk_of(ks, chunk)
    if "off" in contigs.columns:
        return _joined(contigs, ks, chunk)
    fits = contigs.filter(F.col("len") >= min(ks))
    cut = fits.withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - min(ks), F.lit(chunk).cast("long"))))
    base = F.col("start") + F.col("a") if "start" in contigs.columns else F.col("a")
    f = F.substring(F.col("seq"), (F.col("a") + 1).cast("int"), F.lit(chunk + max(ks) - 1))
    # so many partitions, whatever their bytes: a base takes a thousand times the work that reading it takes
    n = int(contigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.select("genome", "contig_id", "a", base.alias("base"), f.alias("f")).repartition(n, "genome", "contig_id", "a")


def _joined(parts: DataFrame, ks: Sequence[int], chunk: int) -> DataFrame:
    """Chunks put together from parts of contigs: a part goes to each chunk that it has a base of, with what the longest k needs
    after it, and a chunk's task joins its parts, so no contig is ever in one place."""
    more = max(ks) - 1
    cut = parts.withColumn("cell", F.explode(F.sequence(F.expr(f"greatest(off - {more}, 0) div {chunk}"), F.expr(f"(off + n - 1) div {chunk}"))))
    cut = cut.withColumn("a", F.col("cell") * chunk).filter(F.col("a") + min(ks) <= F.col("len"))
    lo, hi = F.greatest(F.col("a"), F.col("off")), F.least(F.col("a") + chunk + more, F.col("off") + F.col("n"))
    piece = F.substring(F.col("seq"), (lo - F.col("off") + 1).cast("int"), (hi - lo).cast("int")).cast("string")
    cut = cut.select("genome", "contig_id", "a", F.col("start"), lo.alias("lo"), piece.alias("s"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lo", "s"))), lambda x: x["s"]), "")
    out = cut.groupBy("genome", "contig_id", "a").agg(F.first("start").alias("start"), joined.cast("binary").alias("f"))
    return out.select("genome", "contig_id", "a", (F.col("start") + F.col("a")).alias("base"), "f")


def chunk_of(ks: Sequence[int], chunk: int | None = None) -> int:
    if not ks or min(ks) < 1 or max(ks) > LONGEST:
        raise ValueError(f"k must be from 1 to {LONGEST}")
    return max(CHUNK, 4 * max(ks)) if chunk is None else chunk


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Windows:
    """Keys of windows of one row of codes (0 to 3; whatever else is masked), for any k: numbers of windows of twice a length are
    made of two of that length, so all powers of two cost one pass each, and a k is put together from those in it."""

    def __init__(self, codes: np.ndarray, longest: int, exact: bool, hashed: bool):
        self.n = len(codes)
        low = (codes & 3).astype(np.uint64)
        self.forward, self.back = {}, {}
        if exact:
            self._pack(low, min(longest, EXACT))
        self.hashes = []
        if hashed:
            turned = (np.uint64(3) - low)[::-1]
            self.hashes = [(powers(low, longest, s), powers(turned, longest, s)) for s in (1, 2)]

    def _pack(self, low: np.ndarray, longest: int) -> None:
        f, r, w = low, np.uint64(3) - low, 1
        while True:
            self.forward[w], self.back[w] = f, r
            if 2 * w > longest or len(f) <= w:
                return
            bits = np.uint64(2 * w)
            f, r = (f[:-w] << bits) | f[w:], (r[w:] << bits) | r[:-w]
            w *= 2

    def exact(self, k: int, at: np.ndarray) -> np.ndarray:
        """The smaller of a window's letters and their reverse complement, two bits a letter, for windows that start at `at`."""
        f = r = None
        done = 0
        for w in (1 << i for i in range(k.bit_length()) if k >> i & 1):
            x, y = self.forward[w][at + done], self.back[w][at + done]
            f = x if f is None else (f << np.uint64(2 * w)) | x
            r = y if r is None else r | (y << np.uint64(2 * done))
            done += w
        return np.minimum(f, r)

    def hashed(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The smaller 128-bit hash of both strands."""
        (x, u), (y, v) = ((put_together(p, k, at), put_together(q, k, self.n - k - at)) for p, q in self.hashes)
        turned = (u < x) | ((u == x) & (v < y))
        return np.where(turned, u, x), np.where(turned, v, y)


def powers(codes: np.ndarray, longest: int, seed: int) -> dict[int, np.ndarray]:
    """Hashes of all windows of each power of two up to `longest`, by doubling."""
    out, w = {1: _mix(codes.astype(np.uint64) + np.uint64(seed * 4 + 1))}, 1
    while 2 * w <= longest and len(out[w]) > w:
        out[2 * w] = _mix(out[w][:-w] * _FACTOR + out[w][w:])
        w *= 2
    return out


def put_together(power: dict[int, np.ndarray], k: int, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows of k from `at` on, from those of the powers of two in k."""
    out, done = None, 0
    for w in (1 << i for i in range(k.bit_length()) if k >> i & 1):
        part = power[w][at + done]
        out = part if out is None else _mix(out * _FACTOR + part)
        done += w
    return out


def window_hashes(codes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """64-bit hashes of all windows of k codes: each costs the binary logarithm of k, not k."""
    return put_together(powers(codes, k, seed), k, np.arange(len(codes) - k + 1))


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)


def _cut(batch: pa.RecordBatch):
    """Runs of rows of about SLICE bases."""
    ends = np.cumsum(np.diff(_offsets(batch.column("f"))))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, end - at)
        at = end


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' letters as codes, one after another with a 4 after each; where rows start; the row of each place."""
    at = _offsets(column)
    sizes = np.diff(at)
    row = np.repeat(np.arange(len(sizes)), sizes + 1)
    out = np.full(len(row), 4, np.uint8)
    starts = at[:-1] - at[0] + np.arange(len(sizes))
    own = np.arange(at[-1] - at[0]) + np.repeat(np.arange(len(sizes)), sizes)
    out[own] = _LETTER[np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]]
    return out, starts, row


def _keys(ks: tuple[int, ...], stride: int, chunk: int, genomes: tuple[str, ...] | None, places: bool, named: bool, several: bool, chosen: bool, sample: int, only: Broadcast | None):
    """The kernel: for batches of `pieces`, the keys of every k at strided starts without N (or at the starts in `at`, a list
    column, with `chosen`)."""
    index = {g: i for i, g in enumerate(genomes)} if genomes is not None else {}
    two = several or max(ks) > EXACT

    def run(batches):
        for whole in batches:
            if genomes is not None:
                whole = whole.filter(pa.array([g in index for g in whole.column("genome").to_pylist()], pa.bool_()))
            if not len(whole):
                continue
            for batch in _cut(whole):
                codes, starts, row = _codes(batch.column("f"))
                a, base = (batch.column(c).to_numpy() for c in ("a", "base"))
                bad = np.concatenate(([0], np.cumsum(codes == 4)))
                if chosen:
                    lists = batch.column("at")
                    of = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
                    some = lists.flatten().to_numpy() + starts[of]
                else:
                    inner = np.arange(len(codes)) - starts[row]
                    use = (codes != 4) & (inner < chunk)
                    if stride > 1:
                        use &= (inner + base[row]) % stride == 0
                    some = np.flatnonzero(use)
                windows = Windows(codes, max(ks), min(ks) <= EXACT, max(ks) > EXACT)
                tags = np.array([index.get(g, 0) for g in batch.column("genome").to_pylist()], np.int8) if genomes is not None else None
                for k in ks:
                    at = some[some + k < len(codes)]
                    at = at[bad[at + k] == bad[at]]
                    if not len(at):  # nor need there be windows of so many bases
                        continue
                    x, y = (windows.exact(k, at), None) if k <= EXACT else windows.hashed(k, at)
                    if only is not None:
                        there = only.value.has(x) | (tags[row[at]] == 0)
                        at, x, y = at[there], x[there], None if y is None else y[there]
                    if not len(at):
                        continue
                    own, cols = row[at], {}
                    if named:
                        cols["genome"] = batch.column("genome").take(pa.array(own))
                    elif genomes is not None:
                        cols["tag"] = pa.array(tags[own])
                    if places:
                        inner = at - starts[own]
                        cols |= {"contig_id": batch.column("contig_id").take(pa.array(own)), "lpos": pa.array(a[own] + inner), "pos": pa.array(base[own] + inner)}
                    if several:
                        cols["k"] = pa.array(np.full(len(at), k, np.int32))
                    if sample:
                        cols["sampled"] = pa.array((base[own] + at - starts[own]) % sample == 0)
                    cols["key"] = pa.array(x.view(np.int64))
                    if two:
                        cols["key2"] = pa.array(np.zeros(len(at), np.int64) if y is None else y.view(np.int64))
                    yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def keys(cut: DataFrame, ks: Sequence[int], stride: int = 1, chunk: int | None = None, genomes: Sequence[str] | None = None, places: bool = True, named: bool = False, several: bool | None = None, chosen: bool = False, sample: int = 0, only: Broadcast | None = None) -> DataFrame:
    """K-mers of `pieces` made for these ks (and chunk): a row for each k and start without N at a multiple of `stride` in its
    genome, or with `chosen` for the starts in the list column `at`, relative to a.

    Columns: genome with `named`, else, where genomes are given (others are left out), tag tinyint, its index; contig_id,
    lpos, pos with `places`; k where there are several; sampled boolean with `sample`, whether the start is a multiple of it;
    key long, and key2 long where there are several k or a k over EXACT (0 for those up to it). A k-mer and its reverse
    complement have one key: the smaller of both, or the smaller of their 128-bit hashes. With `only`, a broadcast Bloom filter, genomes but the first give the
    k-mers that it may hold.
    """
    if stride < 1:
        raise ValueError("stride must be 1 or more")
    several = len(ks) > 1 if several is None else several
    ship(cut.sparkSession)
    schema = ", ".join(["genome string"] * named + ["tag tinyint"] * (not named and genomes is not None) + ["contig_id long, lpos long, pos long"] * places + ["k int"] * several + ["sampled boolean"] * bool(sample) + [f"{c} long" for c in key_columns(ks, several)[several:]])
    names = tuple(genomes) if genomes is not None else None
    return cut.mapInArrow(_keys(tuple(sorted(set(ks))), stride, chunk_of(ks, chunk), names, places, named, several, chosen, sample, only), schema)


def key_columns(ks: Sequence[int], several: bool | None = None) -> list[str]:
    """The columns of `keys` that tell k-mers apart."""
    several = len(ks) > 1 if several is None else several
    return ["k"] * several + ["key"] + ["key2"] * (several or max(ks) > EXACT)


def kmers(contigs: DataFrame, k: int, stride: int = 1, chunk: int | None = None) -> DataFrame:
    """(genome, contig_id, lpos, pos, key) of each k-mer without N that starts at a multiple of `stride` in its genome; for k
    over EXACT, key is struct<x,y>, the hash's halves."""
    rows = keys(pieces(contigs, [k], chunk), [k], stride, chunk, named=True)
    return rows if k <= EXACT else rows.withColumn("key", F.struct(F.col("key").alias("x"), F.col("key2").alias("y"))).drop("key2")


#: Bits of a Bloom filter for each key, and bytes that one may have: beyond, it lets more through, never less.
BLOOM_BITS, BLOOM_BYTES = 12, 64 << 20


class Bloom:
    """A Bloom filter of keys, blocked by 64-bit words: four bits of one word tell a key, so asking costs one look-up."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def spots(key: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """The word of each key, and its four bits."""
        h = _mix(key.astype(np.uint64, copy=False) * _FACTOR)
        bits = np.zeros(len(h), np.uint64)
        for i in range(4):
            bits |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
        return (h >> np.uint64(24)) % np.uint64(words), bits

    def has(self, key: np.ndarray) -> np.ndarray:
        word, bits = self.spots(key, len(self.words))
        return self.words[word] & bits == bits


def bloom(rows: DataFrame, expected: int) -> Broadcast:
    """A broadcast filter of the column key of `rows`. Tasks set bits in words of their own, which partial aggregation joins; the driver gets each word once, BLOOM_BYTES at most, whatever the rows."""
    words = max(1, min(BLOOM_BYTES // 8, -(-expected * BLOOM_BITS // 64)))

    def mark(batches):
        for batch in batches:
            key = batch.column("key").to_numpy().view(np.uint64)
            word, bits = Bloom.spots(key, words)
            order = np.argsort(word, kind="stable")
            word = word[order]
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else word[:0].astype(np.int64)
            joined = np.bitwise_or.reduceat(bits[order], first) if len(first) else bits
            yield pa.RecordBatch.from_arrays([pa.array(word[first].view(np.int64)), pa.array(joined.view(np.int64))], names=["word", "bits"])

    got = rows.select("key").mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast(Bloom(out))


def genome_of(tag: Column, genomes: Sequence[str]) -> Column:
    return F.get(F.array(*map(F.lit, genomes)), tag.cast("int"))


def multiplicities(rows: DataFrame) -> DataFrame:
    """(genome, key, n): how often each k-mer is in each genome."""
    return rows.groupBy("genome", "key").agg(F.count(F.lit(1)).alias("n"))


def spectrum(rows: DataFrame, most: int = 1 << 20, by: Sequence[str] = ("genome",), key: Sequence[str] = ("key",)) -> DataFrame:
    """(genome, mult, kmers): how many distinct k-mers have each multiplicity; the last bin also holds all above. `by` names what
    k-mers are told apart by (a tag, a k) instead of genome, and `key` the columns of their keys."""
    each = rows.groupBy(*by, *key).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(*by, F.least(F.col("n"), F.lit(most)).alias("mult")).agg(F.count(F.lit(1)).alias("kmers"))
