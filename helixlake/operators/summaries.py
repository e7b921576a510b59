"""Tables derived from strata: by region class, age, copy number and positional window.

All class tables come from one small cube, so positions are read and shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixlake.functions.sequence import CLASSES, LINEAGES, age_index, age_label, copy_bin, has_any, has_bit, mask_of


def cube(painted: DataFrame, *by: str) -> DataFrame:
    """(class, pres, mult, n) over painted rows: at most classes x 256 x 256 rows, whatever the genome; for each value of `by`."""
    return painted.groupBy(*by, "class", "pres", "mult").agg(F.count(F.lit(1)).alias("n"))


def _sum(condition: Column | None = None) -> Column:
    n = F.col("n") if condition is None else F.when(condition, F.col("n")).otherwise(0)
    return F.coalesce(F.sum(n), F.lit(0)).cast("long")


def with_total(df: DataFrame, by: str, aggs: Sequence[Column], total: str = "ALL", within: Sequence[str] = ()) -> DataFrame:
    """df grouped by a column, with a row of totals (for each value of `within`)."""
    each = [F.col(c) for c in within]
    rolled = df.groupingSets([[*each, F.col(by)], each], *each, F.col(by)).agg(F.grouping(by).alias("_g"), *aggs)
    return rolled.withColumn(by, F.when(F.col("_g") == 1, total).otherwise(F.col(by))).drop("_g")


def apes(subjects: Sequence[str]) -> list[str]:
    return [s for s in subjects if s != "hg002"]


def sharing_columns(subjects: Sequence[str]) -> dict[str, Column]:
    """Conditions over pres of the columns that tables and tracks share."""
    out = {s: has_bit(F.col("pres"), i) for i, s in enumerate(subjects)}
    human = has_any(F.col("pres"), ["hg002"], subjects) & ~has_any(F.col("pres"), apes(subjects), subjects)
    return out | {"human_specific": human, "chm13_only": F.col("pres") == 0, "ape_any": has_any(F.col("pres"), apes(subjects), subjects)}


def class_sharing(cells: DataFrame, subjects: Sequence[str], *by: str, every_class: bool = False) -> DataFrame:
    """Per class and in all (for each value of `by`): valid positions, those shared with each subject and with sets of them,
    single and multiple."""
    valid = cells.filter("mult > 0")
    if every_class:
        spark = cells.sparkSession
        valid = valid.unionByName(spark.createDataFrame([(c, 0, 0, 0) for c in CLASSES], "class string, pres int, mult int, n long"))
    c = sharing_columns(subjects)
    aggs = [_sum().alias("valid_positions"), *[_sum(c[s]).alias(f"shared_{s}") for s in subjects], *[_sum(c[x]).alias(x) for x in ("human_specific", "chm13_only", "ape_any")], _sum(F.col("mult") == 1).alias("unique_in_query"), _sum(F.col("mult") > 1).alias("multi_in_query")]
    return with_total(valid, "class", aggs, within=by)


def age_table(cells: DataFrame, subjects: Sequence[str]) -> DataFrame:
    """Per class and in all: positions by the deepest lineage present, and lineage-sorting patterns."""
    age = age_label(F.col("pres"), subjects)
    labels = ["chm13_only", *[x[0] for x in LINEAGES], "not_in_hg002_but_in_ape"]
    has = lambda *names: has_any(F.col("pres"), names, subjects)
    deep = has("borang", "sorang", "siamang")
    pan, gorilla = has("chimp", "bonobo"), has("gorilla")
    patterns = {"pan_not_gorilla": pan & ~gorilla & ~deep, "gorilla_not_pan": gorilla & ~pan & ~deep, "pan_and_gorilla_only": gorilla & pan & ~deep, "chimp_not_bonobo": has("chimp") & ~has("bonobo"), "bonobo_not_chimp": has("bonobo") & ~has("chimp")}
    aggs = [_sum().alias("positions"), *[_sum(age == x).alias(x) for x in labels], *[_sum(p).alias(x) for x, p in patterns.items()]]
    return with_total(cells.filter("mult > 0"), "class", aggs)


def by_multiplicity(cells: DataFrame, subjects: Sequence[str]) -> DataFrame:
    """Per class (and in all) and copy-number bin: positions, shared ones, and ages 0 to 5."""
    binned = cells.filter("mult > 0").withColumn("copies", copy_bin(F.col("mult")))
    age = age_index(F.col("pres"), subjects)
    aggs = [_sum().alias("positions"), *[_sum(has_bit(F.col("pres"), i)).alias(f"shared_{s}") for i, s in enumerate(subjects)], *[_sum(age == a).alias(f"age{a}") for a in range(6)]]
    both = binned.groupBy("class", "copies").agg(*aggs)
    return both.unionByName(binned.groupBy(F.lit("ALL").alias("class"), "copies").agg(*aggs))


def contig_stats(rows: DataFrame, contigs: DataFrame, subjects: Sequence[str]) -> DataFrame:
    """Per contig: length, valid positions, and those shared with each subject. rows: strata; contigs: the query's."""
    some = rows.filter("mult > 0").groupBy("contig_id").agg(F.count(F.lit(1)).alias("valid"), *[F.count_if(has_bit(F.col("pres"), i)).alias(s) for i, s in enumerate(subjects)])
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("valid", *subjects)]
    return contigs.select("contig_id", "name", F.col("len").alias("length")).join(some, "contig_id", "left").select("contig_id", "name", "length", *zero)


def _every_window(contigs: DataFrame, width: int) -> DataFrame:
    w = contigs.filter("len > 0").select("contig_id", "len", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(len - 1) div {width}"))).alias("win"))
    return w.select("contig_id", "win", (F.col("win") * width).alias("start"), F.least((F.col("win") + 1) * width, F.col("len")).alias("end"))


def windows(rows: DataFrame, contigs: DataFrame, subjects: Sequence[str], width: int = 10_000) -> DataFrame:
    """Tumbling windows of each contig, empty ones too: valid, single-copy and shared positions."""
    conditions = {"uniq": F.col("mult") == 1} | sharing_columns(subjects)
    if "hg002" not in subjects:
        conditions = {c: x for c, x in conditions.items() if c not in ("human_specific", "chm13_only")}
    some = rows.filter("mult > 0").groupBy("contig_id", F.expr(f"lpos div {width}").alias("win")).agg(F.count(F.lit(1)).alias("valid"), *[F.count_if(x).alias(c) for c, x in conditions.items()])
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("valid", *conditions)]
    return _every_window(contigs, width).join(some, ["contig_id", "win"], "left").select("contig_id", "start", "end", *zero)


def pyramid(rows: DataFrame, contigs: DataFrame, subjects: Sequence[str], width: int = 1000, levels: int = 3) -> DataFrame:
    """(level, contig_id, win, c0..c27) for windows of width, 10 width, ...: each level sums ten windows of the one below.

    c0 valid, c1 single-copy, c2-8 by subject, c9-14 by age; c15-27 the same of single-copy positions only.
    """
    one, age = F.col("mult") == 1, age_index(F.col("pres"), subjects)
    sets = [has_bit(F.col("pres"), i) for i in range(7)] + [age == a for a in range(6)]
    conditions = [F.lit(True), one, *sets, *[one & s for s in sets]]
    base = rows.filter("mult > 0").groupBy("contig_id", F.expr(f"lpos div {width}").alias("win")).agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(conditions)])
    base = _every_window(contigs, width).select("contig_id", "win").join(base, ["contig_id", "win"], "left")
    names = [f"c{i}" for i in range(28)]
    level = base.select(F.lit(width).cast("long").alias("level"), "contig_id", "win", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    out = [level]
    for _ in range(levels - 1):
        level = level.groupBy((F.col("level") * 10).alias("level"), "contig_id", F.expr("win div 10").alias("win")).agg(*[F.sum(c).alias(c) for c in names])
        out.append(level)
    return reduce(DataFrame.unionByName, out)


def level_offsets(contigs: DataFrame, width: int = 1000, levels: int = 3) -> DataFrame:
    """(contig_id, name, length, n0, n1, ..., offset): each contig's windows at every level of the pyramid, and where its
    first window of the widest level is when all contigs' windows lie one after another."""
    counts = [F.expr(f"(len + {width * 10**i - 1}) div {width * 10**i}").alias(f"n{i}") for i in range(levels)]
    one = contigs.select("contig_id", "name", F.col("len").alias("length"), *counts)
    order = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    last = f"n{levels - 1}"
    one = one.withColumn("span", F.floor(F.col("contig_id") / 4096))
    spans = one.groupBy("span").agg(F.sum(last).alias("n")).select("span", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    within = Window.partitionBy("span").orderBy("contig_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = one.withColumn("inner", F.coalesce(F.sum(last).over(within), F.lit(0))).join(spans, "span")
    return placed.select("contig_id", "name", "length", *[f"n{i}" for i in range(levels)], (F.col("base") + F.col("inner")).alias("offset"))


def ratios(table: DataFrame, subjects: Sequence[str]) -> DataFrame:
    """(class, subject, share) of a class table: what heat maps and curves draw."""
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("subject"), F.try_divide(F.col(f"shared_{s}").cast("double"), F.col("valid_positions").cast("double")).alias("share")) for s in subjects])).alias("x")
    return table.select("class", rows).select("class", "x.*")


__all__ = ["age_table", "by_multiplicity", "class_sharing", "contig_stats", "cube", "mask_of", "pyramid", "ratios", "windows", "with_total"]
