"""Near-duplicate documents: one-permutation hashing with optimal densification, bands, stars, exact confirmation."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.llm.arrowio import SMALL, slices
from helixlake.llm.stars import BROADCAST_IDS, components, link_buckets
from helixlake.llm.textkit import U64, common, mix, shingle_sets
from helixlake.plans.staging import ship, stage

#: 64 bands of 8 of 512 bins: a link at the threshold of 0.8 shares no band with a chance of 7.8e-6, at 0.85 of 1e-9;
#: texts of similarity 0.4 share one with a chance of 4 %.
BINS, BANDS = 512, 64
_TRIES = 32


def _targets(tries: int) -> np.ndarray:
    """For each try and empty bin, the bin to borrow from: the same for all documents."""
    out = np.empty((tries, BINS), np.uint16)  # made in parts, as every worker makes it
    with np.errstate(over="ignore"):
        for a in range(0, tries, 256):
            n = min(256, tries - a)
            x = mix(np.arange(a * BINS, (a + n) * BINS, dtype=U64) + U64(0xD1B54A32D192ED03))
            out[a : a + n] = (x % U64(BINS)).reshape(n, BINS)
    return out


_FEW, _MANY = _targets(_TRIES), _targets(4096)
_EDGES = (np.arange(BINS, dtype=U64) << U64(64 - BINS.bit_length() + 1))


def signature(s: np.ndarray) -> np.ndarray:
    """BINS minima of a sorted non-empty set; its hashes' top bits are the bins. An empty bin borrows from the first
    filled one in its own random order of bins (optimal densification)."""
    at = np.searchsorted(s, _EDGES)
    after = np.append(at[1:], len(s))
    filled = after > at
    out = s[np.minimum(at, len(s) - 1)].copy()
    if not filled.all():
        empty = np.flatnonzero(~filled)
        for tries in (_FEW, *np.split(_MANY, 16)):  # most find one early
            hit = filled[tries[:, empty]]
            got = hit.any(axis=0)
            out[empty[got]] = out[tries[hit.argmax(axis=0)[got], empty[got]]]
            empty = empty[~got]
            if not len(empty):
                return out
        out[empty] = s[0]
    return out


def bands(s: np.ndarray) -> np.ndarray:
    rows = signature(s).reshape(BANDS, BINS // BANDS)
    x = np.arange(1, BANDS + 1, dtype=U64)
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            x = mix(x * U64(31) + rows[:, k])
    return x.view(np.int64)


def _sign(words: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, budget=SMALL):
                sets = shingle_sets(part.column("text"), words)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("t"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([bands(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "t", "n_shingles", "kind", "bands"],
                )

    return run


def text_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, t, n_shingles, head) for each row: t is the text's hash, head the smallest (doc_id, t) of the texts that links
    connect with the row's; null for texts without words and rows without doc_id, which are linked with nothing.

    Texts with equal sets are one class from the start, so copies are never compared. A text stands for itself, whatever
    doc_id it has; only rows of the same doc_id and text are one.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    signed = stage(docs.mapInArrow(_sign(words), "doc_id long, t long, n_shingles long, kind binary, bands array<long>"), "signed")
    usable = signed.filter("kind is not null and doc_id is not null")
    classes = usable.groupBy("kind").agg(F.min(F.struct("doc_id", "t", "n_shingles", "bands")).alias("r"))
    classes = stage(classes.select("kind", "r.*", F.monotonically_increasing_id().alias("node")), "classes")  # numbers hold, as they are written
    buckets = classes.select(F.explode("bands").alias("bucket"), F.col("node").alias("member"), F.col("n_shingles").alias("trait"))
    near = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)

    def linked(a: np.ndarray, b: np.ndarray) -> bool:
        if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
            return False
        n = common(a, b)
        return 100 * n >= percent * (len(a) + len(b) - n)

    def texts(ids: DataFrame) -> DataFrame:
        wanted = stage(classes.select(F.col("node").alias("id"), "doc_id", "t").join(ids, "id"), "wanted")
        few = wanted.count() <= BROADCAST_IDS
        return docs.join(F.broadcast(wanted) if few else wanted, ["doc_id", "t"]).select("id", "text")

    groups = link_buckets(buckets, near, texts, lambda c: shingle_sets(c, words), linked)
    comps = classes.join(groups, "node", "left").select("kind", F.coalesce("comp", "node").alias("comp"), F.struct("doc_id", "t").alias("own"))
    heads = comps.join(comps.groupBy("comp").agg(F.min("own").alias("head")), "comp").select("kind", "head")
    out = signed.select("doc_id", "t", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("kind")).alias("kind")).join(heads, "kind", "left")
    return out.select("doc_id", "t", "n_shingles", "head")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Link documents with 100 * |A and B| >= percent * |A or B| over their sets of `words`-word shingles.

    Result, a row per document: doc_id, n_shingles long, component_id (smallest doc_id reachable), kept boolean.
    A text with fewer words is one shingle; a null, empty or wordless text has none and stays alone. Rows with a null
    doc_id are kept, with a null component. Rows that share a doc_id are one document, linked by any of their texts, and
    each get a row. An empty table gives an empty result. Other columns are not read.
    """
    placed = stage(text_groups(docs, words, percent).select("doc_id", "n_shingles", F.coalesce("head.doc_id", "doc_id").alias("own")), "placed")
    spread = placed.filter("doc_id is not null").groupBy("doc_id").agg(F.min("own").alias("a"), F.max("own").alias("b")).filter("a < b")
    if spread.isEmpty():
        out = placed.withColumnRenamed("own", "component_id")
    else:  # documents with texts in several groups join these
        joined = components(placed.filter("doc_id is not null").select(F.col("doc_id").alias("u"), F.col("own").alias("v")))
        out = placed.join(joined, F.col("doc_id") == F.col("node"), "left").withColumn("component_id", F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
