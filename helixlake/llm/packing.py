"""Best-fit packing by exact complements: tokenised documents in as few fixed-length sequences as found."""

from __future__ import annotations

import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixlake.llm.arrowio import slices, texts
from helixlake.plans.staging import ship, stage

#: Bytes, about, of the words whose ids a Python worker keeps; when full, it starts anew.
CACHE_BYTES = 64 << 20
#: Separators of str.split that are no white space to the tokenizer; texts with them are encoded whole.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")


#: Signs split off a word's end.
_SIGNS = ".,!?;:|"


class WordIds:
    """Ids of whole texts as little-endian 32-bit bytes. The tokenizer drops white space and never joins across it, so words are encoded once each."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.held = 0
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """The same for words of letters only, many at a call: each gives ids up to one that ends a word."""
        out: list[bytes] = []
        for at in range(0, len(words), 500):
            some = words[at : at + 500]
            ids = np.asarray(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = 4 * (np.flatnonzero(self.ends_word[ids]) + 1)
            if len(ends) == len(some):
                data, cuts = ids.tobytes(), ends.tolist()
                out += [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
            else:
                out += self._encode(some)
        return out

    def _learn(self, new: set[str]) -> None:
        """Add words. Letters and the signs after them are always apart to the tokenizer, so only the letters go to it."""
        split, letters, other = [], set(), set()
        for w in new:
            if w.isalpha():
                letters.add(w)
            elif (c := w.rstrip(_SIGNS)).isalpha():
                split.append((w, c, w[len(c) :]))
                letters.add(c)
                other.add(w[len(c) :])
            else:
                other.add(w)
        known = self.known
        for some, encode in ((letters, self._encode_letters), (other, self._encode)):
            some = [w for w in some if w not in known]
            known.update(zip(some, encode(some), strict=True))
        for w, c, end in split:
            known[w] = known[c] + known[end]

    def encode(self, docs: list[str]) -> list[bytes]:
        odd = {i for i, t in enumerate(docs) if any(c in t for c in _ODD)}
        words = [[] if i in odd else _folded(t).split() for i, t in enumerate(docs)]
        new = {w for w in set().union(*words) if w not in self.known}
        self.held += 4 * sum(map(len, new)) + 200 * len(new)
        if self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
            new = set().union(*words)
        self._learn(new)
        out = [b"".join(map(self.known.__getitem__, w)) for w in words]
        for i in odd:
            out[i] = self._encode([docs[i]])[0]
        return out


def _folded(t: str) -> str:
    """In lower case, where the text is Latin-1: there all lower-casings agree with the tokenizer's."""
    try:
        t.encode("latin-1")
    except UnicodeEncodeError:
        return t
    return t if "<|" in t else t.lower()


_loaded: dict[str, WordIds] = {}


def _tokenise(path: str, capacity: int, keep_ids: bool):
    def run(batches):
        coder = _loaded.setdefault(path, None) or _loaded.update({path: WordIds(path)}) or _loaded[path]
        for batch in batches:
            for part in slices(batch):
                cols = defaultdict(list)
                for doc, ids in zip(part.column("doc_id").to_pylist(), coder.encode(texts(part)), strict=True):
                    ids += b"\0\0\0\0"
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        for c, v in (("doc_id", doc), ("piece", k), ("start", at // 4), ("length", len(cut) // 4), ("ids_crc32", zlib.crc32(cut))):
                            cols[c].append(v)
                        if keep_ids:
                            cols["ids"].append(np.frombuffer(cut, "<u4").astype("i4"))
                kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if keep_ids else {})
                yield pa.RecordBatch.from_arrays([pa.array(cols[c], t) for c, t in kinds.items()], names=list(kinds))

    return run


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, how many such bins) for a histogram of lengths, whose size is bounded by the capacity, not by the data.

    From the longest length down, its gap is filled exactly by a single length, a pair or a triple that is still
    available, as many times as the counts allow. What no combination completes goes by best fit, longest first.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] += c
    bins: list[tuple[tuple[int, ...], int]] = []

    def take(parts: tuple[int, ...]) -> None:
        need: dict[int, int] = defaultdict(int)
        for p in parts:
            need[p] += 1
        k = min(int(left[p]) // n for p, n in need.items())
        for p, n in need.items():
            left[p] -= n * k
        bins.append((parts, k))

    def pair(total: int, least: dict[int, int]) -> tuple[int, int] | None:
        """The pair with the longest first part whose lengths sum to total, with `least` of some lengths already spoken for."""
        free = left[: total + 1].copy()
        for p, n in least.items():
            if p <= total:
                free[p] -= n
        a = np.arange((total + 1) // 2, total)
        good = a[(free[a] > 0) & (free[total - a] > (a == total - a))]
        return (int(good[-1]), total - int(good[-1])) if good.size else None

    if left[capacity]:
        take((capacity,))
    rest: dict[int, int] = {}
    for n in range(capacity - 1, 0, -1):
        gap = capacity - n
        while left[n]:
            if left[gap] > (gap == n):
                take((n, gap))
            elif two := pair(gap, {n: 1}):
                take((n, *two))
            else:
                for a in np.flatnonzero(left[: gap - 1])[::-1]:
                    a = int(a)
                    if left[a] > (a == n) and (two := pair(gap - a, {n: 1} | {a: 1 + (a == n)})):
                        take((n, a, *two))
                        break
                else:
                    rest[n] = int(left[n])
                    left[n] = 0
    open_bins: dict[int, list[list]] = defaultdict(list)  # by gap: [lengths, how many]
    for n in sorted(rest, reverse=True):
        count = rest[n]
        while count:
            gap = min((g for g in open_bins if g >= n), default=0)
            if gap:
                parts, have = open_bins[gap].pop()
                if not open_bins[gap]:
                    del open_bins[gap]
                k = min(have, count)
                if have > k:
                    open_bins[gap].append([parts, have - k])
                open_bins[gap - n].append([(*parts, n), k])
                count -= k
            else:
                each = capacity // n
                k, more = divmod(count, each)
                if k:
                    open_bins[capacity - each * n].append([(n,) * each, k])
                if more:
                    open_bins[capacity - more * n].append([(n,) * more, 1])
                count = 0
    return bins + [(tuple(parts), k) for group in open_bins.values() for parts, k in group]


def places(bins: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each length, runs of ranks: (length, first rank, first sequence, offset), ordered; pieces of a run go to successive sequences."""
    seen: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for parts, k in bins:
        offset = 0
        for n in parts:
            rows.append((n, seen[n], sequence, offset))
            seen[n] += k
            offset += n
        sequence += k
    return tuple(np.asarray(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, keep_ids: bool = False, bucket_rows: int = 1000) -> DataFrame:
    """Pack the documents' token ids, each document ended by id 0, into sequences of at most `capacity` ids.

    Only longer documents are cut. Result, a row per piece: doc_id, piece int, start long, length long, ids_crc32 long,
    sequence_id long (gapless from 0), offset long (place in the sequence), and ids array<int> with keep_ids.
    A null text is empty and gives the one id 0; a null doc_id is kept as it is; repeated rows are packed each;
    an empty table gives an empty result. Other columns are not read.

    The driver holds the histogram of lengths and the plan made of it: at most `capacity` lengths, whatever the input.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    pieces = stage(docs.select("doc_id", "text").mapInArrow(_tokenise(tokenizer_path, capacity, keep_ids), schema), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    length_of, rank_of, sequence_of, offset_of = places(plan(counts, capacity))
    # ranks within a length: buckets spread lengths that many pieces share
    buckets = max(1, min(20_000, -(-sum(counts.values()) // bucket_rows)))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(firsts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("first"))

    def assign(batches):
        keys = length_of * (1 << 48) + rank_of
        for b in batches:
            n, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            i = np.searchsorted(keys, n * (1 << 48) + rank, "right") - 1
            cols = {c: b.column(c) for c in b.schema.names if c != "rank"} | {"sequence_id": pa.array(sequence_of[i] + rank - rank_of[i]), "offset": pa.array(offset_of[i])}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return ranked.select(*names, "rank").mapInArrow(assign, schema + ", sequence_id long, offset long")
