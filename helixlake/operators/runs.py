"""K-mers of many k counted by runs: successive k-mers of one minimizer go through the exchange as one stretch of bases, two
bits each, so a k-mer costs one or two bytes there, not its key and its place."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.operators.kmers import EXACT, SLICE, Windows, _codes, _cut, _FACTOR, _mix, _offsets, chunk_of, genome_of, pieces
from helixlake.plans.staging import ship

#: K-mers of a run at most: its length and its genome's number are 16 bits.
LONGEST_RUN = (1 << 13) - 1
#: Runs that a task gathers before it deals them out, and k-mers that it counts at a time, if one bucket has no more.
GATHERED, COUNTED = 1 << 20, 1 << 20
#: Bytes, about, of the runs that are exchanged at a time, where there are several k: at least one k's.
PASS = 1 << 30
#: Runs whose bases are laid in a row's order at a time.
LAID = 1 << 16
_NONE, _TAIL = np.uint64(2**64 - 1), np.array([255, 0xC0, 0xF0, 0xFC], np.uint8)
_SCHEMA = "k int, bucket int, own boolean, head binary, part binary, s binary, contig binary, lpos binary, pos binary"


def minimizer(k: int) -> int:
    """Letters of the minimizer of a k-mer: long enough that none is very frequent, short enough that runs are long."""
    return min(k, 16, k // 3 + 5)


def passes(ks: Sequence[int], bases: int) -> list[list[int]]:
    """Rising k in groups whose runs, of two bytes a base, fit into PASS."""
    ks, n = sorted(set(ks)), max(1, PASS // max(2 * bases, 1))
    return [ks[i : i + n] for i in range(0, len(ks), n)]


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... in each of successive stretches."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _least(h: np.ndarray, widths: Sequence[int]):
    """(width, the least of each window of so many) for rising widths, by doubling."""
    level, at = h, 1
    for width in widths:
        while 2 * at <= width and len(level) > at:
            level, at = np.minimum(level[:-at], level[at:]), 2 * at
        yield width, np.minimum(level[: len(h) - width + 1], level[width - at :]) if len(h) >= width else h[:0]


def _runs(codes: np.ndarray, starts: np.ndarray, row: np.ndarray, ks: Sequence[int], chunk: int | np.ndarray, mark: np.ndarray | None = None):
    """(k, places of its k-mers, where runs start among these, hash of each run's minimizer). A minimizer is the same on both
    strands, so all occurrences of a k-mer are in runs of one hash. A run has one mark. `chunk` bounds a row's starts, or each place's."""
    bad = np.concatenate(([0], np.cumsum(codes == 4)))
    some = np.flatnonzero((codes != 4) & (np.arange(len(codes)) - starts[row] < chunk))
    windows = Windows(codes, 16, True, False)
    for m in sorted(set(map(minimizer, ks))):
        if len(codes) <= m:
            continue
        h = _mix(windows.exact(m, np.arange(len(codes) - m + 1)) * _FACTOR + np.uint64(m))
        h[bad[m:] != bad[:-m]] = _NONE
        mine = [k for k in ks if minimizer(k) == m]
        for k, (_, least) in zip(mine, _least(h, [k - m + 1 for k in mine]), strict=True):
            at = some[some + k < len(codes)]
            at = at[bad[at + k] == bad[at]]
            if len(at):
                low = least[at]
                new = (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1])
                if mark is not None:
                    new |= mark[at[1:]] != mark[at[:-1]]
                first = np.flatnonzero(np.concatenate(([True], new)))
                sizes = np.diff(np.append(first, len(at)))
                if sizes.max() > LONGEST_RUN:
                    cut = -(-sizes // LONGEST_RUN)
                    first = np.repeat(first, cut) + LONGEST_RUN * _within(cut)
                yield k, at, first, low[first]


def _marks(column: pa.Array, starts: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The mark of each place, from lists of (start, end, mark) of each row: marks that overlap are added."""
    of = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False) // 3)
    a, b, mark = column.flatten().to_numpy().reshape(-1, 3).T.astype(np.int64)
    change = np.zeros(len(row), np.int64)
    long = np.diff(np.append(starts, len(row))) - 1
    np.add.at(change, starts[of] + np.minimum(a, long[of]), mark)
    np.add.at(change, starts[of] + np.minimum(b, long[of]), -mark)
    return np.cumsum(change)


def _deal(ks: tuple[int, ...], chunk: int, genomes: tuple[str, ...], places: bool, buckets: int, only: Broadcast | None, stride: int = 0, own: bool | None = None):
    """The runs of batches of `pieces`, those of a bucket together in a row."""
    index = {g: i for i, g in enumerate(genomes)}

    def rows(k, parts):
        bucket, head, part, size, data, *where = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(bucket, kind="stable")
        sizes, at = size[order], (np.cumsum(size) - size)[order]
        bucket, head, part = bucket[order], head[order], part[order]
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        ends, bytes_ = np.append(first, len(bucket)), np.concatenate(([0], np.cumsum(sizes)))
        laid = np.empty_like(data)
        for a in range(0, len(order), LAID):  # each byte's place takes eight
            some = sizes[a : a + LAID]
            laid[bytes_[a] : bytes_[a + len(some)]] = data[np.repeat(at[a : a + LAID], some) + _within(some)]
        binary = lambda x, at: pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
        where = [binary(x[order], 8 * ends) for x in where] + [pa.array([b""] * len(first), pa.binary())] * (3 - len(where))
        cols = [pa.array(np.full(len(first), k, np.int32)), pa.array(bucket[first].astype(np.int32)), pa.array(np.full(len(first), places if own is None else own)), binary(head, 2 * ends), binary(part, ends), binary(laid, bytes_[ends]), *where]
        return pa.RecordBatch.from_arrays(cols, names=["k", "bucket", "own", "head", "part", "s", "contig", "lpos", "pos"])

    def run(batches):
        held, n = {}, 0
        for whole in batches:
            whole = whole.filter(pa.array([g in index for g in whole.column("genome").to_pylist()], pa.bool_()))
            for batch in _cut(whole) if len(whole) else ():
                codes, starts, row = _codes(batch.column("f"))
                tags = np.array([index[g] for g in batch.column("genome").to_pylist()], np.uint16)
                contig, a, base = (batch.column(c).to_numpy() for c in ("contig_id", "a", "base"))
                low = np.concatenate((codes & 3, np.zeros(3, np.uint8)))
                packed = (low[:-3] << 6) | (low[1:-2] << 4) | (low[2:-1] << 2) | low[3:]
                windows = None if only is None else Windows(codes, max(ks), min(ks) <= EXACT, max(ks) > EXACT)
                mark = _marks(batch.column("marks"), starts, row) if stride else None
                reach = batch.column("n").to_numpy()[row] if "n" in batch.schema.names else chunk
                for k, at, first, low in _runs(codes, starts, row, ks, reach, mark):
                    sizes = np.diff(np.append(first, len(at)))
                    if only is not None:
                        there = only.value.has(windows.exact(k, at) if k <= EXACT else windows.hashed(k, at)[0])
                        some = np.logical_or.reduceat(there, first)
                        first, sizes, low = first[some], sizes[some], low[some]
                    if not len(first):
                        continue
                    at, long = at[first], sizes + k - 1
                    size = -(-long // 4)
                    data = packed[np.repeat(at, size) + 4 * _within(size)]
                    data[np.cumsum(size) - 1] &= _TAIL[long % 4]
                    of = row[at]
                    inner = at - starts[of]
                    mixed = _mix(low * _FACTOR)
                    bucket, part = (mixed >> np.uint64(20)) % np.uint64(buckets), (mixed >> np.uint64(8)).astype(np.uint8)
                    head = (sizes.astype(np.uint16) << np.uint16(3)) | tags[of]
                    where = (contig[of], a[of] + inner, base[of] + inner)[: 3 if own is None else 2] if places else ()
                    if stride:
                        where = (mark[at], base[of] + inner) if stride > 1 else (mark[at],)
                    held.setdefault(k, []).append((bucket, head, part, size, data, *where))
                    n += len(first)
                if n > GATHERED:
                    yield from (rows(k, parts) for k, parts in held.items())
                    held, n = {}, 0
        yield from (rows(k, parts) for k, parts in held.items())

    return run


def dealt(cut: DataFrame, ks: Sequence[int], genomes: Sequence[str], chunk: int | None = None, places: bool = False, only: Broadcast | None = None, stride: int = 0, own: bool | None = None) -> DataFrame:
    """The runs of `pieces`, of genomes in the order given (eight at most), a row for each k, bucket and about GATHERED runs. There are
    16 buckets for each shuffle partition: what one task holds at a time is a bucket of one k. With a stride, `pieces` are as
    `marked` gives them: contig holds runs' marks, and lpos, where the stride is over 1, their places in the genome. With `own`, which
    says whether they are the query's, runs have their places in contigs only."""
    if len(genomes) > 8:
        raise ValueError("at most 8 genomes")
    ship(cut.sparkSession)
    buckets = max(256, min(16 * int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << 16))
    return cut.mapInArrow(_deal(tuple(sorted(set(ks))), chunk_of(ks, chunk), tuple(genomes), places, buckets, only, stride, own), _SCHEMA)


def _long(codes: np.ndarray, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of windows of k over EXACT: the smaller 128-bit hash of both strands, two sums of hashed 32-mers times powers of an odd
    number. Sums of windows are differences of running sums, so each costs the same for any k."""
    windows, last = Windows(codes, EXACT, True, False), at + (k - EXACT)
    n, halves = len(windows.forward[EXACT]), []
    for seed, odd in ((1, 0x2545F4914F6CDD1D), (2, 0x5851F42D4C957F2D)):
        power, turned = (np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, x, np.uint64))) for x in (odd, pow(odd, -1, 1 << 64)))
        mixed = lambda x: _mix((x + np.uint64(seed)) * _FACTOR)  # noqa: E731, B023
        sums = lambda x: np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
        there, back = sums(mixed(windows.forward[EXACT]) * power), sums(mixed(windows.back[EXACT]) * turned)
        halves.append((_mix((there[last + 1] - there[at]) * turned[at]), _mix((back[last + 1] - back[at]) * power[last])))
    (x, u), (y, v) = halves
    less = (u < x) | ((u == x) & (v < y))
    return np.where(less, u, x), np.where(less, v, y)


class Bucket:
    """The runs of some buckets of one k: equal stretches are taken together, then their k-mers are told apart by their keys."""

    def __init__(self, k: int, rows: list[dict]):
        join = lambda c, kind: np.frombuffer(b"".join(r[c] for r in rows), kind)
        head, data = join("head", np.uint16), join("s", np.uint8)
        self.own = np.repeat([r["own"] for r in rows], [len(r["head"]) // 2 for r in rows])
        place = lambda c, own: np.frombuffer(b"".join(r[c] for r in rows if r["own"] == own), np.int64)
        self.contig, self.lpos, self.pos = (place(c, True) for c in ("contig", "lpos", "pos"))
        #: Places of the runs that are not the query's, where they have any.
        self.there = place("contig", False), place("lpos", False)
        self.tag, self.n = head & 7, (head >> 3).astype(np.int64)
        long = self.n + k - 1
        size = -(-long // 4)
        at = np.concatenate(([0], np.cumsum(size)))
        same = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode().indices.to_numpy()
        _, first, self.of = np.unique(same.astype(np.int64) * 4 + long % 4, return_index=True, return_inverse=True)
        self.kinds, sizes = len(first), size[first]
        #: k-mers of each kind of stretch, and where they start among all.
        self.long = self.n[first]
        self.start = np.cumsum(self.long) - self.long
        data = data[np.repeat(at[first], sizes) + _within(sizes)]
        ends, keys, step = np.cumsum(sizes), [], 0
        while step < len(first):
            done = ends[step - 1] if step else 0
            end = max(step + 1, int(np.searchsorted(ends, done + SLICE // 4, "right")))
            codes = ((data[done : ends[end - 1], None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).ravel()
            places = np.repeat(4 * (ends[step:end] - sizes[step:end] - done), self.long[step:end]) + _within(self.long[step:end])
            keys.append((Windows(codes, k, True, False).exact(k, places),) if k <= EXACT else _long(codes, k, places))
            step = end
        x, *y = (np.concatenate(c) for c in zip(*keys, strict=True))
        self.order = np.argsort(x)
        new = self._new(x)
        if y and (~new & self._new(y[0])).any():  # several hashes of one first half
            self.order = np.lexsort((y[0], x))
            new = self._new(x) | self._new(y[0])
        self.first = np.flatnonzero(new)

    def _new(self, x: np.ndarray) -> np.ndarray:
        x = x[self.order]
        return np.concatenate(([True], x[1:] != x[:-1]))

    def copies(self, chosen: np.ndarray) -> np.ndarray:
        """How often the chosen runs hold each distinct k-mer."""
        each = np.repeat(np.bincount(self.of[chosen], minlength=self.kinds), self.long)
        return np.add.reduceat(each[self.order], self.first)

    def bits(self) -> np.ndarray:
        """Which of the genomes of runs that are not the query's hold each distinct k-mer."""
        out = np.zeros(self.kinds, np.int32)
        for tag in np.unique(self.tag[~self.own]):
            has = np.zeros(self.kinds, np.int32)
            has[self.of[~self.own & (self.tag == tag)]] = 1
            out |= has << tag
        return np.bitwise_or.reduceat(np.repeat(out, self.long)[self.order], self.first)

    def spread(self, of_kmers: np.ndarray) -> np.ndarray:
        """What belongs to distinct k-mers at each place of the kinds of stretches."""
        out = np.empty(len(self.order), of_kmers.dtype)
        out[self.order] = np.repeat(of_kmers, np.diff(np.append(self.first, len(self.order))))
        return out

    def owned(self, some: np.ndarray | None = None):
        """(run among the query's, or some, its place there, its k-mer's place among all) of all k-mers, some runs at a time."""
        some = self.own if some is None else some
        of, n = self.of[some], self.n[some]
        ends, step = np.cumsum(n), 0
        while step < len(n):
            end = max(step + 1, int(np.searchsorted(ends, (ends[step - 1] if step else 0) + SLICE, "right")))
            inner = _within(n[step:end])
            yield np.repeat(np.arange(step, end), n[step:end]), inner, np.repeat(self.start[of[step:end]], n[step:end]) + inner
            step = end


def _part(k: int, r: dict, part: int, parts: int) -> dict:
    """The runs of a bucket's row that are of one of so many parts of it."""
    head, some = np.frombuffer(r["head"], np.uint16), np.frombuffer(r["part"], np.uint8) % parts == part
    size = -(-((head >> 3).astype(np.int64) + k - 1) // 4)
    out = {"own": r["own"], "head": head[some].tobytes(), "s": np.frombuffer(r["s"], np.uint8)[np.repeat(some, size)].tobytes()}
    return out | {c: np.frombuffer(r[c], np.int64)[some].tobytes() if r[c] else b"" for c in ("contig", "lpos", "pos")}


def _counting(made):
    """made(k, Bucket) over rows sorted by k and bucket: whole buckets, taken together until they have COUNTED k-mers. A bucket that has
    several times as many alone is counted in parts, by minimizers too, so what is held beside its packed runs doesn't grow with it."""

    def whole(k, rows, n):
        parts = min(n // COUNTED, 256)
        if parts < 2:
            yield from made(k, Bucket(k, rows))
        for part in range(parts if parts > 1 else 0):
            if some := [x for r in rows if (x := _part(k, r, part, parts))["head"]]:
                yield from made(k, Bucket(k, some))

    def run(batches):
        rows, n, last = [], 0, None
        for batch in batches:
            for r in batch.to_pylist():
                here = (r["k"], r["bucket"])
                if rows and here != last and (n >= COUNTED or here[0] != last[0]):
                    yield from whole(last[0], rows, n)
                    rows, n = [], 0
                rows.append(r)
                n, last = n + int((np.frombuffer(r["head"], np.uint16) >> 3).sum()), here
        if rows:
            yield from whole(last[0], rows, n)

    return run


def counted(runs: DataFrame, made, schema: str) -> DataFrame:
    """made(k, Bucket), which gives record batches, of all buckets."""
    return runs.repartition("k", "bucket").sortWithinPartitions("k", "bucket").mapInArrow(_counting(made), schema)


def _presence(stride: int):
    def made(k, bucket):
        if not bucket.own.any():
            return
        pres, full = bucket.spread(bucket.bits()), bucket.spread(bucket.copies(bucket.own))
        for run, inner, at in bucket.owned():
            pos = bucket.pos[run] + inner
            use = full[at] > 0 if stride == 1 else pos % stride == 0
            run, inner, at, pos = run[use], inner[use], at[use], pos[use]
            if len(run):
                cols = [np.full(len(run), k, np.int32), bucket.contig[run], bucket.lpos[run] + inner, pos, pres[at], full[at].astype(np.int64)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["k", "contig_id", "lpos", "pos", "pres", "mult_full"])

    return made


def presence(cut: DataFrame, query: str, subjects: Sequence[str], ks: Sequence[int], stride: int = 1, chunk: int | None = None, only: Broadcast | None = None) -> DataFrame:
    """(k, contig_id, lpos, pos, pres, mult_full) of each valid sampled position of the query, from `pieces` for these ks: where a
    k-mer's runs meet, its places are too, so they are not exchanged again."""
    return counted(_both(cut, query, subjects, ks, chunk, only), _presence(stride), "k int, contig_id long, lpos long, pos long, pres int, mult_full long")


def marked(cut: DataFrame, query: str, laid: DataFrame | None, chunk: int) -> DataFrame:
    """The query's `pieces` with marks: lists of the (start, end, mark) that their k-mers' starts have of `laid` (contig_id, start, end,
    mark): intervals that overlap only where sums of their marks tell them apart."""
    own = cut.filter(F.col("genome") == query)
    none = F.array().cast("array<bigint>")
    if laid is None:
        return own.withColumn("marks", none)
    cells = laid.filter("start < end").withColumn("a", F.explode(F.sequence(F.expr(f"start div {chunk} * {chunk}"), F.expr(f"(end - 1) div {chunk} * {chunk}"), F.lit(chunk).cast("long"))))
    each = F.array(F.greatest(F.col("start") - F.col("a"), F.lit(0)), F.least(F.col("end") - F.col("a"), F.lit(chunk)), F.col("mark").cast("long"))
    lists = cells.groupBy("contig_id", "a").agg(F.flatten(F.collect_list(each)).alias("marks"))
    return own.join(lists, ["contig_id", "a"], "left").withColumn("marks", F.coalesce("marks", none))


def _cells(stride: int):
    def made(k, bucket):
        if not bucket.own.any():
            return
        code = bucket.spread((bucket.bits() << 8) | np.minimum(bucket.copies(bucket.own), 255))
        for run, inner, at in bucket.owned():
            cell = (bucket.contig[run] << 16) | code[at]
            if stride > 1:
                cell = cell[(bucket.lpos[run] + inner) % stride == 0]
            cell, n = np.unique(cell, return_counts=True)
            cols = [np.full(len(cell), k, np.int32), (cell >> 16).astype(np.int32), ((cell >> 8) & 255).astype(np.int32), (cell & 255).astype(np.int32), n.astype(np.int64)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["k", "mark", "pres", "mult", "n"])

    return made


def cells(cut: DataFrame, query: str, subjects: Sequence[str], ks: Sequence[int], stride: int = 1, laid: DataFrame | None = None, chunk: int | None = None) -> DataFrame:
    """(k, mark, pres, mult, n): how many valid sampled positions of the query have each mark (0 where nothing is laid), presence and
    multiplicity up to 255. They are counted where a k-mer's runs meet: no position leaves its task."""
    own = dealt(marked(cut, query, laid, chunk_of(ks, chunk)), ks, [query], chunk, places=True, stride=stride)
    both = own.unionByName(dealt(cut, ks, subjects, chunk)) if subjects else own
    parts = counted(both, _cells(stride), "k int, mark int, pres int, mult int, n long")
    return parts.groupBy("k", "mark", "pres", "mult").agg(F.sum("n").alias("n"))


def _both(cut, query, subjects, ks, chunk=None, only=None) -> DataFrame:
    own = dealt(cut, ks, [query], chunk, places=True)
    return own.unionByName(dealt(cut, ks, subjects, chunk, only=only)) if subjects else own


def _histogram(k, bucket):
    for tag in np.unique(bucket.tag):
        copies = bucket.copies(bucket.tag == tag)
        mult, kmers = np.unique(copies[copies > 0], return_counts=True)
        cols = [np.full(len(mult), tag, np.int32), np.full(len(mult), k, np.int32), mult.astype(np.int64), kmers.astype(np.int64)]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["tag", "k", "mult", "kmers"])


def histogram(cut: DataFrame, genomes: Sequence[str], ks: Sequence[int], chunk: int | None = None) -> DataFrame:
    """(tag, k, mult, kmers): how many distinct k-mers of each genome have each multiplicity, in parts to be summed."""
    return counted(dealt(cut, ks, genomes, chunk), _histogram, "tag int, k int, mult long, kmers long")


def spectra(contigs: DataFrame, ks: Sequence[int], genomes: Sequence[str], most: int = 1 << 20) -> DataFrame:
    """(genome, k, mult, kmers) of several genomes and k, as kmers.spectrum has it: the bases are read and dealt once."""
    cut = pieces(contigs.filter(F.col("genome").isin(list(genomes))), ks)
    sums = histogram(cut, genomes, ks).groupBy("tag", "k", F.least(F.col("mult"), F.lit(most).cast("long")).alias("mult")).agg(F.sum("kmers").alias("kmers"))
    return sums.select(genome_of(F.col("tag"), genomes).alias("genome"), "k", "mult", "kmers")


def _shared(rungs: dict[int, int]):
    def rows(of, rung, contig, lpos, spread, placed):
        for run, _, at in placed:
            held = spread[at]
            first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
            ends = np.append(first, len(run))
            some = np.maximum.reduceat(held, first) > 0
            held = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(held)])
            run = run[first]
            cols = [pa.array(of[run].astype(np.int32)), pa.array(np.full(len(run), rung, np.int32)), pa.array(contig[run]), pa.array(lpos[run]), held]
            yield pa.RecordBatch.from_arrays(cols, names=["tag", "rung", "contig_id", "lpos", "pres"]).filter(pa.array(some))

    def made(k, bucket):
        if not bucket.own.any() or bucket.own.all():
            return
        pres = bucket.spread(bucket.bits()).astype(np.uint8)
        yield from rows(bucket.tag[bucket.own], rungs[k], bucket.contig, bucket.lpos, pres, bucket.owned())
        if len(bucket.there[0]):
            has = bucket.spread((bucket.copies(bucket.own) > 0).astype(np.uint8))
            yield from rows(bucket.tag[~bucket.own] + 1, rungs[k], *bucket.there, has, bucket.owned(~bucket.own))

    return made


def shared(cut: DataFrame, query: str, subjects: Sequence[str], ks: Sequence[int], chunk: int | None = None, rungs: dict[int, int] | None = None, both: bool = False) -> DataFrame:
    """(tag, rung, contig_id, lpos, pres BINARY) of runs of the query (tag 0) that have a k-mer in common with any subject: a byte of
    presence for each of its k-mers from lpos on; rung is k's number, from 1. No run crosses a chunk. With `both`, for the longest
    k also the subjects' (tags from 1) that the query has a k-mer of, with 1 for each that it has."""
    ks = tuple(sorted(set(ks)))
    parts = [dealt(cut, ks, [query], chunk, places=True, own=True)]
    alone = ks[:-1] if both else ks
    parts += [dealt(cut, alone, subjects, chunk)] if alone else []
    parts += [dealt(cut, ks[-1:], subjects, chunk, places=True, own=False)] if both else []
    return counted(reduce(DataFrame.unionByName, parts), _shared(rungs or {k: i for i, k in enumerate(ks, 1)}), "tag int, rung int, contig_id long, lpos long, pres binary")


def _alive(chunk: int, k: int, follow: int):
    wide = chunk + 2  # a row's places, apart from the next row's

    def run(batches):
        for whole in batches:
            for batch in _cut(whole) if len(whole) else ():
                runs, f = batch.column("runs"), batch.column("f")
                flat = runs.flatten()
                pres, row = flat.field("pres"), np.repeat(np.arange(len(batch)), runs.value_lengths().to_numpy(zero_copy_only=False))
                at, to = _offsets(pres), _offsets(f)
                live = np.zeros(len(batch) * wide, np.int8)
                live[np.repeat(row * wide + flat.field("p").to_numpy() + 1, np.diff(at)) + _within(np.diff(at))] = np.frombuffer(pres.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] != 0
                s, e = np.flatnonzero(np.diff(live)).reshape(-1, 2).T
                row = s // wide
                s, e = s - row * wide, e - row * wide
                some = (e == chunk) | (e - s > follow - k)
                s, e, row = s[some], e[some], row[some]
                long = np.where(e == chunk, np.diff(to)[row] - s, e - 1 + k - s)
                cut = np.frombuffer(f.buffers()[2] or b"", np.uint8)[np.repeat(to[row] + s, long) + _within(long)]
                ends = np.concatenate(([0], np.cumsum(long))).astype(np.int32)
                of = [batch.column(c).to_numpy()[row] for c in ("contig_id", "a", "base")]
                cols = [batch.column("genome").take(pa.array(row)), pa.array(of[0]), pa.array(of[1] + s), pa.array(of[2] + s), pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(cut)]), pa.array(e - s)]
                yield pa.RecordBatch.from_arrays(cols, names=["genome", "contig_id", "a", "base", "f", "n"])

    return run


def alive(cut: DataFrame, held: DataFrame, genomes: Sequence[str], k: int, follow: int, chunk: int) -> DataFrame:
    """The stretches of `pieces` that can have a shared k-mer of `follow` or more letters: those where each k-mer of k letters is
    shared, as the rows of `shared` with both sides tell. n is how many starts a stretch has; what goes on in the next chunk is kept."""
    at = F.col("lpos") - F.col("lpos") % chunk
    runs = held.select("tag", "contig_id", at.alias("a"), F.struct((F.col("lpos") - at).cast("int").alias("p"), "pres").alias("run"))
    runs = runs.groupBy("tag", "contig_id", "a").agg(F.collect_list("run").alias("runs"))  # a chunk's positions at most
    met = cut.join(runs.withColumn("genome", genome_of(F.col("tag"), genomes)).drop("tag"), ["genome", "contig_id", "a"])
    return met.select("genome", "contig_id", "a", "base", "f", "runs").mapInArrow(_alive(chunk, k, follow), "genome string, contig_id long, a long, base long, f binary, n long")
