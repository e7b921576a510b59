"""Filter interaction audit: what each of several filters removes, in every order, from counts of failure masks alone."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that parts words, as a class of regular expressions, and as the letters to trim.
_BLANKS, _TRIM = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
FILTERS = "ABCDE"


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails: under 100 words; under 80 % distinct words; over 10 % capitals A-Z; a special sign."""
    bare = F.btrim(text, F.lit(_TRIM))
    sizes = lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("d"))
    words = F.get(F.transform(F.array(F.split(bare, _BLANKS)), sizes), F.lit(0))  # the words are made once for both
    some = bare != ""
    n, d = (F.when(some, words[x]).otherwise(F.lit(0).cast("long")) for x in ("n", "d"))
    return [n < 100, 100 * d < 80 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.char_length(text).cast("long"), text.rlike(r"[#$%&*|]")]


def mask_counts(docs: DataFrame, labels: DataFrame, failures=text_failures, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by their part and the set of filters they fail, and how many of them the
    labels call good and toxic. Bit i of mask is filter i; the last bit, after those of `failures`, is set where a smaller
    doc_id has the same text.

    Failures are facts of the text, so copies fall together before the exchange: rows go by (digest, part, labels, mask) with a
    count, the smallest doc_id and how often it is there. Only these groups meet the smallest doc_id of their digest.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures(text))]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    rows = docs.select("doc_id", F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    told = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(told, "doc_id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("good", "toxic")})
    ids = rows.groupBy("doc_id", "digest", "part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    unknown = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unknown")
    groups = ids.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), least, unknown)
    heads = groups.groupBy("digest").agg(F.min("least.doc_id").alias("head"))
    met = groups.join(heads, "digest")
    first = F.col("unknown") + F.when(F.col("least.doc_id") == F.col("head"), F.col("least.n")).otherwise(0)
    again = F.lit(1 << len(bits))
    two = F.explode(F.array(F.struct(F.col("mask").alias("mask"), first.alias("n")), F.struct((F.col("mask") + again).alias("mask"), (F.col("n") - first).alias("n"))))
    split = met.select("part", "good", "toxic", two.alias("x")).select("part", "good", "toxic", "x.*")
    weighted = lambda c: F.sum(F.col("n") * F.col(c)).alias(c)
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), weighted("good"), weighted("toxic"))


def subset_sums(counts: Column, filters: int) -> Column:
    """The zeta transform of an array of 2^filters counts by mask: at U, the sum over all masks within U. One pass a filter
    adds to each set that has it the sum without it."""
    power = F.lit([1 << f for f in range(filters)])
    step = lambda acc, bit: F.transform(acc, lambda v, u: v + F.when(u.bitwiseAND(bit) != 0, F.get(acc, u.bitwiseXOR(bit))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(power, counts, step)


def orders(counts: DataFrame, letters: str = FILTERS) -> DataFrame:
    """Every order of the filters, step by step, for each part of `mask_counts`.

    Result: part, filter_order, step (int, from 1; its filter is that letter of the order), and counts within the part: kept
    after the step, removed by it, redundant (failing its filter, removed earlier), unique_fails (failing its filter alone),
    good_lost and toxic_lost (labelled so, removed by it), shapley (removed by the filter, summed over all orders).
    All are differences of survivors S of neighbouring sets of filters: S(F) counts the masks within F's complement.
    Parts are those of the counts, so an empty table gives no rows; each part takes one row of 2^filters counts.
    """
    k = len(letters)
    every = (1 << k) - 1
    cell = F.struct("n", "good", "toxic")
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", cell.alias("x")))).alias("m")
    parts = counts.groupBy("part").agg(by_mask)
    at = lambda c: F.transform(F.lit(list(range(1 << k))), lambda u: F.coalesce(F.try_element_at("m", u)[c], F.lit(0).cast("long")))
    sums = parts.select("part", *[subset_sums(at(c), k).alias(c) for c in ("n", "good", "toxic")])
    survivors = lambda c, used: F.get(F.col(c), F.lit(every) - used)
    each = sums.select("*", F.explode(F.lit(["".join(p) for p in permutations(letters)])).alias("filter_order"))
    each = each.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    before = sum((F.when(F.instr("filter_order", x) < F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))
    own = sum((F.when(F.instr("filter_order", x) == F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))
    each = each.withColumn("before", before).withColumn("own", own)
    b, o = F.col("before"), F.col("own")
    lost = lambda c: survivors(c, b) - survivors(c, b + o)
    # an order has the set u before its filter in |u|! (k - 1 - |u|)! of all cases
    weights = F.lit([factorial(u.bit_count()) * factorial(max(0, k - 1 - u.bit_count())) for u in range(1 << k)])
    share = lambda acc, u: acc + F.when(u.bitwiseAND(o) == 0, F.get(weights, u) * (survivors("n", u) - survivors("n", u + o))).otherwise(F.lit(0).cast("long"))
    shapley = F.aggregate(F.lit(list(range(1 << k))), F.lit(0).cast("long"), share)
    fails = survivors("n", F.lit(0)) - survivors("n", o)
    return each.select("part", "filter_order", "step", survivors("n", b + o).alias("kept"), lost("n").alias("removed"), (fails - lost("n")).alias("redundant"), (survivors("n", F.lit(every) - o) - survivors("n", F.lit(every))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), shapley.alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """`orders` of the five filters A to E over whole texts: A under 100 words, B under 80 % distinct words, C over 10 % of
    letters A-Z, D any of #$%&*|, E the same text as a smaller doc_id's anywhere in the table, removed or not.

    A null text is empty; a null part is the empty string. Rows of one doc_id are no earlier than each other, and rows
    without doc_id neither fail E nor make others fail. A doc_id with several labels counts as good or toxic if any says
    so; labels without document are not counted. Other columns are not read.
    """
    return orders(mask_counts(docs, labels, part=part))
