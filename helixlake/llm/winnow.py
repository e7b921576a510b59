"""Document fingerprints by winnowing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What is hashed: runs of letters and digits (24 at most), and each sign of scripts written without spaces.
UNIT = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]]{1,24}"
_LOW = 0x7FFFFFFF
#: Buckets at most, each of this many bytes of text at least.
MOST_BUCKETS, BUCKET_BYTES = 65_536, 2 << 20


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = 5, window: int = 8) -> DataFrame:
    """Add `out`, array<long>: the winnowed k-grams of a text column in order, each as hash (31 bits) * 2^32 + (2^31 - 1 - position).

    Each k-gram of successive units has a hash; each window of `window` (a power of two) successive k-grams gives its
    smallest, the rightmost of equals, so every run of window + k - 1 units that two texts share gives both a common
    hash. Fewer k-grams than a window are one window, fewer units than k one k-gram; no unit, or null, gives no hash.
    The packed order makes the least value the smallest hash, rightmost: windows are minima, by doubling their width.
    """
    keep = [c for c in df.columns if c != out]
    units = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(UNIT), F.lit(0))
    df = df.select(*keep, F.transform(units, lambda u: F.xxhash64(u)).alias("_u"))
    at = lambda a, i: F.get(F.col(a), i)
    grams = F.transform(F.slice("_u", 1, F.greatest(F.size("_u") - (k - 1), F.least(F.size("_u"), F.lit(1)))), lambda u, i: F.shiftrightunsigned(F.xxhash64(u, *[at("_u", i + j) for j in range(1, k)]), 33) * F.lit(1 << 32) + (F.lit(_LOW) - i))
    df = df.select(*keep, grams.alias("_m"))
    width = 1
    while width < window:
        wider = F.transform("_m", lambda x, i: F.least(x, at("_m", i + width)))  # noqa: B023  past the end: shorter windows, cut below
        df = df.select(*keep, wider.alias("_m"))
        width *= 2
    chosen = F.array_distinct(F.slice("_m", 1, F.greatest(F.size("_m") - (window - 1), F.least(F.size("_m"), F.lit(1)))))
    return df.select(*keep, chosen.alias(out))


def as_text(packed: str | Column) -> Column:
    """hash:position of each chosen k-gram, comma-joined."""
    return F.array_join(F.transform(packed, lambda v: F.concat_ws(":", F.shiftright(v, 32).cast("string"), (F.lit(_LOW) - v.bitwiseAND(_LOW)).cast("string"))), ",")


def hashes(packed: str | Column) -> Column:
    return F.array_distinct(F.transform(packed, lambda v: F.shiftright(v, 32)))


def likeness(a: str | Column, b: str | Column) -> Column:
    """Shared hashes among all hashes of two arrays of distinct hashes; 1 if both are empty."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def with_next(df: DataFrame, columns: list[str], prepare=lambda d: d) -> DataFrame:
    """Add next_<c> for the given columns: their values in the next row, descending doc_id; after the last comes the first.

    Rows are dealt once, by ranges of doc_id of about equal size; each range also gets the largest row of the range
    before, so no row needs another task's rows. prepare(df) is applied after dealing. Rows of equal doc_id are ordered
    by their text's hash; a null doc_id counts as the smallest. A sole row's next is itself.
    """
    order = F.struct(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"))
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(max(1, min(MOST_BUCKETS, total // BUCKET_BYTES)))
    side = max(1, round(n**0.5))
    cuts = df.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 4 * n + 10_000)).first()[0] if n > 1 else None
    cuts = sorted(cuts or [])
    rows = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    if cuts:  # the number of cuts not above doc_id: first among every side-th cut, then among those after it
        heads = F.lit([r[0] for r in rows])
        group = F.size(F.filter(heads, lambda c: c <= F.col("doc_id")))
        inside = F.size(F.filter(F.get(F.array(*[F.lit(r) for r in rows]), F.greatest(group - 1, F.lit(0))), lambda c: c <= F.col("doc_id")))
        bucket = F.when(F.col("doc_id").isNull() | (group == 0), 0).otherwise((group - 1) * side + inside)
    else:
        bucket = F.lit(0)
    dealt = df.withColumn("_b", bucket.cast("int")).withColumn("_o", order)
    tops = dealt.groupBy("_b").agg(F.max("_o").alias("_top"))
    around = Window.orderBy("_b")  # MOST_BUCKETS rows at most
    tops = tops.withColumn("_after", F.coalesce(F.lead("_b").over(around), F.min("_b").over(Window.partitionBy())))
    placed = dealt.join(F.broadcast(tops), "_b")
    own = F.struct(F.col("_b").alias("b"), F.lit(1).alias("own"))
    copy = F.struct(F.col("_after").alias("b"), F.lit(0).alias("own"))
    placed = placed.withColumn("_p", F.explode(F.when(F.col("_o") == F.col("_top"), F.array(own, copy)).otherwise(F.array(own))))
    placed = placed.select(*df.columns, "_o", F.col("_p.b").alias("_b"), F.col("_p.own").alias("_own")).repartition("_b")
    placed = prepare(placed)
    before = Window.partitionBy("_b").orderBy("_own", "_o")
    added = placed.select("*", *[F.lag(c).over(before).alias(f"next_{c}") for c in columns])
    return added.filter("_own = 1").drop("_own", "_b", "_o")


def fingerprint_edits(docs: DataFrame, k: int = 5, window: int = 8) -> DataFrame:
    """Fingerprints of each text and of its edited text: the last half of its code points (rounded down) replaced by
    the first as many, or all, of the next document's.

    Result: doc_id, n_chars long, edited_sha256, fingerprint, edited_fingerprint string, near_edited, near_next double.
    A null text is empty; an empty text has an empty fingerprint and likeness 1 to another empty one, 0 to others.
    Repeated rows each get a row; an empty table gives an empty result. Other columns are not read.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(texts, ["text", "fp"], lambda d: with_fingerprint(d, "text", "fp", k, window))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "edited", "fp", F.col("next_fp").alias("nfp"))
    rows = with_fingerprint(rows, "edited", "efp", k, window)
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text("fp").alias("fingerprint"), as_text("efp").alias("edited_fingerprint"), hashes("fp").alias("a"), hashes("efp").alias("e"), hashes("nfp").alias("x"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("a", "e").alias("near_edited"), likeness("a", "x").alias("near_next"))
