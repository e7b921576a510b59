"""The registered queries of the engine over genomes made of all documents, and the same in SQL.

A document is a contig; its source's number, modulo 8, says which of eight genomes it belongs to, so every document
takes part. chm13 is the query, the other seven are its subjects.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.functions.sequence import CLASSES, COPY_BINS, FAMILIES, LINEAGES, has_bit, region_class, share
from helixlake.operators import align, arrays, intervals, keytables, ladder, packed, segments, strata, summaries
from helixlake.operators.kmers import keys, kmers, pieces
from helixlake.operators.runs import spectra
from helixlake.plans.staging import shared_root
from helixlake.sources import sinks
from helixlake.sources.genome import from_texts, index, only, prepared, read_bed, read_fasta, read_fasta_parts, read_paf
from helixlake.sources.randgen import random_genome

QUERY = "chm13"
SUBJECTS = ["hg002", "chimp", "bonobo", "gorilla", "borang", "sorang", "siamang"]
GENOMES = [QUERY, *SUBJECTS]
#: q_ladder_sharing is sampled at every eighth position; 31 is what shares and divergence are told at.
LADDER, STRIDE = sorted({*ladder.RUN_LADDER, 31}), 8
#: Annotation of a contig of length L: class, and its span as fractions (numerator, denominator), painted in this order.
PAINT = [("SD", (1, 5), (1, 2)), ("ct", (2, 5), (3, 5)), ("hor_active", (1, 2), (11, 20)), ("hor_active", (3, 5), (13, 20)), ("hsat3", (4, 5), (9, 10))]


def contigs(spark: SparkSession, sf_dir: str, letters_only: bool = False, include: str | None = None, starts: bool = True) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    genome = F.get(F.array(*map(F.lit, GENOMES)), (F.substring("source", 4, 10).cast("int") % 8))
    return from_texts(docs, genome, F.col("doc_id"), F.col("text"), letters_only, include, starts)


def query_contigs(c: DataFrame) -> DataFrame:
    """Names, offsets and lengths of the query's contigs."""
    return index(c, QUERY)


def annotation(c: DataFrame) -> DataFrame:
    part = lambda x: F.expr(f"(len * {x[0]}) div {x[1]}")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(name).alias("class"), part(a).alias("start"), part(b).alias("end")) for i, (name, a, b) in enumerate(PAINT)])).alias("x")
    return c.select("contig_id", each).select("contig_id", "x.*").filter("start < end")


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, fractions to six places: the same in both engines."""
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c).cast("long").alias(c) if k in ("int", "smallint", "tinyint") else F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in kinds.items()])


def _strata(spark, d, k, letters=False, **kw):
    c = contigs(spark, d, letters)
    return c, strata.strata(c, QUERY, SUBJECTS, k, **kw)


def _paint(c, rows):
    return intervals.paint(rows, intervals.disjoint(annotation(query_contigs(c))))


def _cube(c, ks, subjects=SUBJECTS, **kw):
    """The query's cube of classes for each k."""
    return strata.painted_cells(c, QUERY, subjects, ks, intervals.disjoint(annotation(query_contigs(c))), **kw)


def _by_k(cells, ks, **counts):
    """A row for each k: all valid positions, and those that meet conditions."""
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    every = cells.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    return F.broadcast(every).join(cells, "k", "left").groupBy("k").agg(n(F.lit(True)).alias("valid"), *[n(x).alias(c) for c, x in counts.items()])


def _cells(spark, d, k=21):
    return _cube(contigs(spark, d), [k]).drop("k")


# --- SQL pieces -----------------------------------------------------------------------------------------------------


def sql_contigs(letters_only: bool = False) -> str:
    coded = "translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '" + "ACGT" * 6 + "AC')"
    coded = f"regexp_replace({coded}, '[^ACGT]', '', 'g')" if letters_only else f"regexp_replace(regexp_replace({coded}, '[\\x00-\\x20]', '', 'g'), '[^ACGT]', 'N', 'g')"
    names = ", ".join(f"'{g}'" for g in GENOMES)
    return f"""G AS (SELECT ([{names}])[1 + (CAST(substr(source, 4) AS BIGINT) % 8)] AS genome, doc_id AS contig_id, 'd' || doc_id AS name, coalesce({coded}, '') AS s FROM documents),
O AS (SELECT genome, contig_id, name, s, CAST(length(s) AS BIGINT) AS len, CAST(coalesce(sum(length(s)) OVER (PARTITION BY genome ORDER BY contig_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM G)"""


def sql_kmers(k: int, name: str = "K", of: str = "O") -> str:
    key = "least(w, reverse(translate(w, 'ACGT', 'TGCA')))"
    key = key if k <= 31 else f"hash({key})"
    return f"""{name} AS (SELECT genome, contig_id, lpos, start + lpos AS pos, {key} AS key FROM
 (SELECT genome, contig_id, start, lpos, substr(s, lpos + 1, {k}) AS w FROM (SELECT genome, contig_id, start, s, unnest(range(0, len - {k} + 1)) AS lpos FROM {of} WHERE len >= {k})) WHERE NOT contains(w, 'N'))"""


def sql_ladder(ks: list[int]) -> str:
    """Contigs of letters only and their k-mers K<k> for many k. Hashes of 2w letters are made of two of w, on both strands, and
    those of k letters of the powers of two in k, so long k-mers are never cut out of the text."""
    over, steps = "OVER (PARTITION BY contig_id ORDER BY lpos)", []
    steps.append("D1 AS (SELECT genome, contig_id, start, len, lpos, hash(c) AS f1, hash(translate(c, 'ACGT', 'TGCA')) AS r1 FROM (SELECT genome, contig_id, start, len, unnest(range(0, len)) AS lpos, unnest(string_split(s, '')) AS c FROM O WHERE len > 0))")
    w = 1
    while 2 * w <= max(ks):
        steps.append(f"D{2 * w} AS (SELECT *, hash(f{w}, lead(f{w}, {w}) {over}) AS f{2 * w}, hash(lead(r{w}, {w}) {over}, r{w}) AS r{2 * w} FROM D{w})")
        w *= 2
    steps.append(f"D AS MATERIALIZED (SELECT * FROM D{w})")
    for k in ks:
        forward, back, at = [], [], 0
        for p in (1 << i for i in range(k.bit_length()) if k >> i & 1):
            forward.append(f"lead(f{p}, {at}) {over}")
            back.append(f"lead(r{p}, {k - at - p}) {over}")
            at += p
        steps.append(f"K{k} AS (SELECT genome, contig_id, lpos, pos, least(f, r) AS key FROM (SELECT genome, contig_id, len, lpos, start + lpos AS pos, hash({', '.join(forward)}) AS f, hash({', '.join(back)}) AS r FROM D) WHERE lpos + {k} <= len)")
    return sql_contigs(True) + ",\n" + ",\n".join(steps)


def sql_strata(k: int, letters_only: bool = False, suffix: str = "", head: bool = True, made: bool = False, stride: int = 1) -> str:
    bit = "CASE genome " + " ".join(f"WHEN '{s}' THEN {1 << i}" for i, s in enumerate(SUBJECTS)) + " ELSE 0 END"
    x = suffix
    return (sql_contigs(letters_only) + ",\n" if head else "") + ("" if made else sql_kmers(k, f"K{x}") + ",\n") + f"""T{x} AS (SELECT key, count(*) FILTER (WHERE genome = '{QUERY}') AS mf, bit_or({bit}) AS pres FROM K{x} GROUP BY key),
S{x} AS (SELECT contig_id, lpos, pos, CAST(pres AS BIGINT) AS pres, least(mf, 255) AS mult, mf AS mult_full FROM K{x} JOIN T{x} USING (key) WHERE genome = '{QUERY}' AND pos % {stride} = 0)"""


def _sql_class(pos: str) -> str:
    out = "CASE"
    for name, (a, b), (c, d) in reversed(PAINT):
        out += f" WHEN {pos} >= len * {a} // {b} AND {pos} < len * {c} // {d} THEN '{name}'"
    return out + f" ELSE '{CLASSES[0]}' END"


def sql_painted(k: int, letters_only: bool = False, suffix: str = "", head: bool = True, **kw) -> str:
    return sql_strata(k, letters_only, suffix, head, **kw) + f""",
P{suffix} AS (SELECT S{suffix}.*, {_sql_class('lpos')} AS class FROM S{suffix} JOIN O USING (contig_id))"""


def _mask(*names: str) -> int:
    return sum(1 << SUBJECTS.index(n) for n in names)


def _sql_sharing(valid: str = "mult > 0") -> dict[str, str]:
    ape = _mask(*SUBJECTS[1:])
    return {s: f"(pres & {1 << i}) <> 0" for i, s in enumerate(SUBJECTS)} | {"human_specific": f"(pres & 1) <> 0 AND (pres & {ape}) = 0", "chm13_only": "pres = 0", "ape_any": f"(pres & {ape}) <> 0"}


def _sql_age() -> str:
    return "CASE " + " ".join(f"WHEN (pres & {_mask(*names)}) <> 0 THEN {i}" for i, (_, names, _) in reversed(list(enumerate(LINEAGES, 1)))) + " ELSE 0 END"


def _sql_total(body: str, table: str, key: str = "class", where: str = "") -> str:
    return f"SELECT {key}, {body} FROM {table} {where} GROUP BY {key} UNION ALL SELECT 'ALL' AS {key}, {body} FROM {table} {where}"


def _cnt(cond: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {cond}) AS {name}"


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        REGISTRY[name] = lambda spark, d: plain(f(spark, d))
        REGISTRY[name].__doc__ = f.__doc__
        if sql:
            SQL[name] = sql
        return f

    return add


# --- sources and k-mers ---------------------------------------------------------------------------------------------


@query("q_base_composition", f"WITH {sql_contigs()} SELECT genome, base, count(*) AS n FROM (SELECT genome, unnest(string_split(s, '')) AS base FROM O) WHERE base <> '' GROUP BY genome, base")
def base_composition(spark, d):
    """Bases of each genome."""
    c = contigs(spark, d, starts=False)
    n = lambda b: (F.col("len") - F.length(F.replace(F.col("seq").cast("string"), F.lit(b)))).alias("n")
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("base"), n(b)) for b in "ACGTN"])).alias("x")
    return c.select("genome", each).groupBy("genome", "x.base").agg(F.sum("x.n").alias("n")).filter("n > 0")


@query("q_contig_index", f"WITH {sql_contigs()} SELECT genome, contig_id, name, start, len FROM O")
def contig_index(spark, d):
    """The contigs' offsets."""
    return index(contigs(spark, d))


@query("q_include_filter", f"WITH {sql_contigs().replace('FROM documents)', 'FROM documents WHERE contains(doc_id::VARCHAR, chr(55)))')} SELECT genome, contig_id, name, start, len FROM O")
def include_filter(spark, d):
    """Offsets where only contigs whose name holds a 7 are kept."""
    return index(contigs(spark, d, include="7"))


def _spectrum(spark, d, k):
    return spectra(contigs(spark, d, starts=False), [k], GENOMES).drop("k")


for _k in (16, 21, 31):
    query(f"q_kmer_spectrum_k{_k}", f"WITH {sql_contigs()}, {sql_kmers(_k)}, M AS (SELECT genome, key, count(*) AS n FROM K GROUP BY genome, key) SELECT genome, least(n, 1048576) AS mult, count(*) AS kmers FROM M GROUP BY 1, 2")(partial(_spectrum, k=_k))


@query("q_kmer_stride", f"WITH {sql_contigs()}, {sql_kmers(16)} SELECT genome, contig_id, count(*) AS n, CAST(sum(lpos) AS BIGINT) AS places FROM K WHERE pos % 8 = 0 GROUP BY genome, contig_id")
def kmer_stride(spark, d):
    """Every eighth k-mer start of each genome."""
    return kmers(contigs(spark, d), 16, stride=8).groupBy("genome", "contig_id").agg(F.count(F.lit(1)).alias("n"), F.sum("lpos").alias("places"))


# --- strata ---------------------------------------------------------------------------------------------------------


@query("q_strata_k21", f"WITH {sql_strata(21)} SELECT * FROM S")
def strata_k21(spark, d):
    """Presence and multiplicity at every position."""
    return _strata(spark, d, 21)[1]


@query("q_strata_dense_stride4", f"WITH {sql_strata(21)} SELECT A.contig_id, A.lpos, A.pos, coalesce(pres, 0) AS pres, coalesce(mult, 0) AS mult, coalesce(mult_full, 0) AS mult_full FROM (SELECT contig_id, lpos, start + lpos AS pos FROM (SELECT contig_id, start, unnest(range(0, len)) AS lpos FROM O WHERE genome = '{QUERY}') WHERE (start + lpos) % 4 = 0) A LEFT JOIN S ON S.contig_id = A.contig_id AND S.lpos = A.lpos")
def strata_dense(spark, d):
    """Every fourth position, with zeros where there is no k-mer."""
    c, rows = _strata(spark, d, 21, stride=4)
    return strata.dense(rows, c, QUERY, 4)


@query("q_strata_long_k101", f"WITH {sql_strata(101, True)} SELECT * FROM S")
def strata_long(spark, d):
    """Long k-mers, keyed by 128-bit hashes."""
    return _strata(spark, d, 101, True)[1]


@query("q_small_query", f"WITH {sql_strata(31)} SELECT * FROM S")
def small_query(spark, d):
    """The broadcast plan for small queries."""
    return _strata(spark, d, 31, small_query=True)[1]


@query("q_no_self", f"WITH {sql_strata(31)} SELECT contig_id, lpos, pos, pres, CAST(0 AS BIGINT) AS mult, CAST(0 AS BIGINT) AS mult_full FROM S")
def no_self(spark, d):
    """Presence only."""
    return _strata(spark, d, 31, own=False)[1]


_stats = "SELECT '{s}' AS subject, CAST({i} AS BIGINT) AS bit, (SELECT CAST(sum(len) AS BIGINT) FROM O WHERE genome = '{s}') AS length, (SELECT count(DISTINCT key) FROM K WHERE genome = '{s}') AS distinct_kmers, (SELECT count(DISTINCT key) FROM K JOIN T USING (key) WHERE genome = '" + QUERY + "' AND pos % 8 = 0 AND (pres & {b}) <> 0) AS shared_distinct, (SELECT count(*) FROM S WHERE pos % 8 = 0 AND (pres & {b}) <> 0) AS shared_entries"


@query("q_subject_stats", f"WITH {sql_strata(21)} " + " UNION ALL ".join(_stats.format(s=s, i=i, b=1 << i) for i, s in enumerate(SUBJECTS)))
def subject_stats(spark, d):
    """What each subject has and shares, sampling every eighth position."""
    return strata.subject_stats(contigs(spark, d), QUERY, SUBJECTS, 21, 8)


@query("q_run_meta", f"WITH {sql_strata(21)}, M AS (SELECT key, count(*) AS n FROM K WHERE genome = '{QUERY}' GROUP BY key) SELECT '{QUERY}' AS query, CAST(21 AS BIGINT) AS k, CAST(8 AS BIGINT) AS stride, 'exact' AS mode, (SELECT CAST(sum(len) AS BIGINT) FROM O WHERE genome = '{QUERY}') AS query_length, (SELECT CAST((sum(len) + 7) // 8 AS BIGINT) FROM O WHERE genome = '{QUERY}') AS n_entries, (SELECT count(*) FROM S WHERE pos % 8 = 0) AS valid_entries, (SELECT count(*) FROM M) AS query_distinct, (SELECT string_agg(n || ':' || c, ',' ORDER BY n) FROM (SELECT n, count(*) AS c FROM M GROUP BY n)) AS self_histogram")
def run_meta(spark, d):
    """The description of a run."""
    m = strata.run_meta(contigs(spark, d), QUERY, SUBJECTS, 21, 8)
    pairs = F.array_join(F.transform("self_histogram", lambda x: F.concat_ws(":", x["mult"].cast("string"), x["kmers"].cast("string"))), ",")
    return m.withColumn("self_histogram", pairs).drop("subjects")


@query("q_private_kmers", f"WITH {sql_contigs()}, {sql_kmers(21)} SELECT contig_id, count(*) AS private FROM K WHERE genome = '{QUERY}' AND key NOT IN (SELECT key FROM K WHERE genome <> '{QUERY}') GROUP BY contig_id")
def private_kmers(spark, d):
    """Query positions whose k-mer no subject has, by an anti-join."""
    cut = pieces(contigs(spark, d, starts=False), [21])
    others = keys(cut, [21], genomes=SUBJECTS, places=False).select("key").distinct()
    return keys(cut, [21], genomes=[QUERY]).join(others, "key", "left_anti").groupBy("contig_id").agg(F.count(F.lit(1)).alias("private"))


# --- class tables ---------------------------------------------------------------------------------------------------

_sharing_body = "count(*) AS valid_positions, " + ", ".join(_cnt(x, f"shared_{c}" if c in SUBJECTS else c) for c, x in _sql_sharing().items()) + ", count(*) FILTER (WHERE mult = 1) AS unique_in_query, count(*) FILTER (WHERE mult > 1) AS multi_in_query"


@query("q_class_sharing", f"WITH {sql_painted(21)} " + _sql_total(_sharing_body, "P"))
def class_sharing(spark, d):
    """Sharing by region class, with totals."""
    return summaries.class_sharing(_cells(spark, d), SUBJECTS)


@query("q_class_pattern_cube", f"WITH {sql_painted(21)} SELECT class, pres, count(*) AS n FROM P GROUP BY class, pres")
def class_pattern_cube(spark, d):
    """Region class by presence pattern."""
    return _cells(spark, d).groupBy("class", "pres").agg(F.sum("n").alias("n"))


@query("q_class_mult_cube", f"WITH {sql_strata(21)}, D AS (SELECT O.len, A.contig_id, A.lpos FROM (SELECT contig_id, unnest(range(0, len)) AS lpos FROM O WHERE genome = '{QUERY}') A JOIN O USING (contig_id)) SELECT {_sql_class('D.lpos')} AS class, coalesce(mult, 0) AS mult, count(*) AS n FROM D LEFT JOIN S ON S.contig_id = D.contig_id AND S.lpos = D.lpos GROUP BY 1, 2")
def class_mult_cube(spark, d):
    """Region class by multiplicity, invalid positions as 0."""
    c, rows = _strata(spark, d, 21)
    every = strata.dense(rows, c, QUERY)
    painted = intervals.paint(every, intervals.disjoint(annotation(query_contigs(c))))
    return painted.groupBy("class", "mult").agg(F.count(F.lit(1)).alias("n"))


@query("q_age_table", f"WITH {sql_painted(21)}, A AS (SELECT *, {_sql_age()} AS age FROM P) " + _sql_total("count(*) AS positions, count(*) FILTER (WHERE pres = 0) AS chm13_only, " + ", ".join(_cnt(f"age = {i}", x[0]) for i, x in enumerate(LINEAGES, 1)) + ", count(*) FILTER (WHERE age = 0 AND pres <> 0) AS not_in_hg002_but_in_ape", "A"))
def age_table(spark, d):
    """Region class by age."""
    return summaries.age_table(_cells(spark, d), SUBJECTS).drop("pan_not_gorilla", "gorilla_not_pan", "pan_and_gorilla_only", "chimp_not_bonobo", "bonobo_not_chimp")


_pan, _gor, _deep, _ch, _bo = _mask("chimp", "bonobo"), _mask("gorilla"), _mask("borang", "sorang", "siamang"), _mask("chimp"), _mask("bonobo")
_patterns = {"pan_not_gorilla": f"(pres & {_pan}) <> 0 AND (pres & {_gor | _deep}) = 0", "gorilla_not_pan": f"(pres & {_gor}) <> 0 AND (pres & {_pan | _deep}) = 0", "pan_and_gorilla_only": f"(pres & {_gor}) <> 0 AND (pres & {_pan}) <> 0 AND (pres & {_deep}) = 0", "chimp_not_bonobo": f"(pres & {_ch}) <> 0 AND (pres & {_bo}) = 0", "bonobo_not_chimp": f"(pres & {_bo}) <> 0 AND (pres & {_ch}) = 0"}


@query("q_lineage_patterns", f"WITH {sql_painted(16)} " + _sql_total(", ".join(_cnt(x, c) for c, x in _patterns.items()), "P"))
def lineage_patterns(spark, d):
    """Lineage-sorting patterns by region class."""
    return summaries.age_table(_cells(spark, d, 16), SUBJECTS).select("class", *_patterns)


_copies = "CASE " + " ".join(f"WHEN mult BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in COPY_BINS) + " END"
_mbody = "count(*) AS positions, " + ", ".join(_cnt(_sql_sharing()[s], f"shared_{s}") for s in SUBJECTS) + ", " + ", ".join(_cnt(f"age = {a}", f"age{a}") for a in range(6))


@query("q_by_multiplicity", f"WITH {sql_painted(16)}, A AS (SELECT *, {_sql_age()} AS age, {_copies} AS copies FROM P) SELECT class, copies, {_mbody} FROM A GROUP BY class, copies UNION ALL SELECT 'ALL' AS class, copies, {_mbody} FROM A GROUP BY copies")
def by_multiplicity(spark, d):
    """Region class by copy number."""
    return summaries.by_multiplicity(_cells(spark, d, 16), SUBJECTS)


@query("q_class_ratios", f"WITH {sql_painted(21)}, X AS ({_sql_total(_sharing_body, 'P')}) " + " UNION ALL ".join(f"SELECT class, '{s}' AS subject, round(CAST(shared_{s} AS DOUBLE) / valid_positions, 6) AS share FROM X" for s in SUBJECTS))
def class_ratios(spark, d):
    """The matrix of class by genome that figures draw."""
    return summaries.ratios(summaries.class_sharing(_cells(spark, d), SUBJECTS), SUBJECTS)


# --- positions, windows ---------------------------------------------------------------------------------------------


@query("q_chrom_stats", f"WITH {sql_strata(21)}, V AS (SELECT contig_id, count(*) AS valid, {', '.join(_cnt(_sql_sharing()[s], s) for s in SUBJECTS)} FROM S GROUP BY contig_id) SELECT contig_id, name, len AS length, coalesce(valid, 0) AS valid, {', '.join(f'coalesce({s}, 0) AS {s}' for s in SUBJECTS)} FROM O LEFT JOIN V USING (contig_id) WHERE genome = '{QUERY}'")
def chrom_stats(spark, d):
    """Sharing by contig."""
    c, rows = _strata(spark, d, 21)
    return summaries.contig_stats(rows, query_contigs(c), SUBJECTS)


_win = {"uniq": "mult = 1"} | _sql_sharing()


@query("q_window_tracks", f"WITH {sql_strata(21)}, W AS (SELECT contig_id, len, unnest(range(0, (len + 999) // 1000)) AS win FROM O WHERE genome = '{QUERY}'), V AS (SELECT contig_id, lpos // 1000 AS win, count(*) AS valid, {', '.join(_cnt(x, c) for c, x in _win.items())} FROM S GROUP BY 1, 2) SELECT W.contig_id, W.win * 1000 AS start, least((W.win + 1) * 1000, len) AS \"end\", coalesce(valid, 0) AS valid, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _win)} FROM W LEFT JOIN V ON V.contig_id = W.contig_id AND V.win = W.win")
def window_tracks(spark, d):
    """Tumbling windows of 1,000 bases."""
    c, rows = _strata(spark, d, 21)
    return summaries.windows(rows, query_contigs(c), SUBJECTS, 1000)


_sets = [_sql_sharing()[s] for s in SUBJECTS] + [f"({_sql_age()}) = {a}" for a in range(6)]
_cols = ["true", "mult = 1", *_sets, *[f"mult = 1 AND {s}" for s in _sets]]
_pyr = " UNION ALL ".join(f"SELECT CAST({w} AS BIGINT) AS level, W.contig_id, W.win, {', '.join(f'coalesce(c{i}, 0) AS c{i}' for i in range(28))} FROM (SELECT contig_id, unnest(range(0, (len + {w - 1}) // {w})) AS win FROM O WHERE genome = '{QUERY}') W LEFT JOIN (SELECT contig_id, lpos // {w} AS win, {', '.join(_cnt(x, f'c{i}') for i, x in enumerate(_cols))} FROM S GROUP BY 1, 2) V ON V.contig_id = W.contig_id AND V.win = W.win" for w in (100, 1000, 10000))


@query("q_window_pyramid", f"WITH {sql_strata(21)} {_pyr}")
def window_pyramid(spark, d):
    """Windows of 100, 1,000 and 10,000 bases, 28 columns."""
    c, rows = _strata(spark, d, 21)
    return summaries.pyramid(rows, query_contigs(c), SUBJECTS, 100)


# --- ladder ---------------------------------------------------------------------------------------------------------


def _sql_shares(stride: int) -> str:
    return "WITH " + sql_ladder(LADDER) + ", " + ", ".join(sql_painted(k, True, str(k), False, made=True, stride=stride) for k in LADDER) + ", X AS (" + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS k, class, {', '.join(_cnt(_sql_sharing()[s], s) for s in SUBJECTS)}, count(*) AS valid FROM P{k} GROUP BY class" for k in LADDER) + "), L AS (" + " UNION ALL ".join(f"SELECT k, class, '{s}' AS subject, CAST({s} AS DOUBLE) / valid AS share FROM X" for s in SUBJECTS) + ")"


def _shares(c, ks=LADDER, stride=1):
    return ladder.curves(summaries.class_sharing(_cube(c, ks, stride=stride), SUBJECTS, "k").filter("class <> 'ALL'"), SUBJECTS)


@query("q_ladder_sharing", f"{_sql_shares(STRIDE)} SELECT k, class, subject, round(share, 6) AS share FROM L")
def ladder_sharing(spark, d):
    """Sharing by class over the ladder of k, at every eighth position."""
    return _shares(contigs(spark, d, True), stride=STRIDE)


@query("q_divergence", f"{_sql_shares(1)} SELECT subject, round(max(share) FILTER (WHERE k = 31), 6) AS share, round(1 - pow(max(share) FILTER (WHERE k = 31), 1.0 / 31), 6) AS from_one, CASE WHEN count(*) FILTER (WHERE k BETWEEN 31 AND 201 AND share > 0) >= 2 THEN round(1 - exp(regr_slope(ln(share), k) FILTER (WHERE k BETWEEN 31 AND 201 AND share > 0)), 6) END AS from_slope FROM L WHERE class = 'unique' GROUP BY subject")
def divergence(spark, d):
    """Apparent divergence in unannotated sequence, from every position and each k that it is told by."""
    c = contigs(spark, d, True)
    longest = query_contigs(c).agg(F.max("len")).first()[0]
    ks = [k for k in LADDER if 31 <= k <= 201] if longest is not None and longest >= 31 else LADDER  # subjects of shorter k alone have rows of nulls
    return ladder.divergence(_shares(c, ks).filter("class = 'unique'"))


@query("q_decay", f"{_sql_shares(1)} SELECT subject, class, round(share, 6) AS share, CASE subject " + " ".join(f"WHEN '{s}' THEN {t}::DOUBLE" for _, n, t in LINEAGES for s in n) + " END AS mya FROM L WHERE k = 31")
def decay(spark, d):
    """Sharing at k = 31 against divergence time, from every position."""
    return ladder.decay(_shares(contigs(spark, d, True), [31])).select("subject", "class", "share", "mya")


def _sql_census(bins):
    name = "CASE " + " ".join(f"WHEN n >= {low} THEN '{label}'" for low, label in reversed(bins)) + " END"
    every = " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS k, least(count(*), 1048576) AS n FROM K{k} WHERE genome = '{QUERY}' GROUP BY key" for k in LADDER)
    return f"WITH {sql_ladder(LADDER)}, M AS ({every}) SELECT k, {name} AS copies, CAST(sum(n) AS BIGINT) AS positions, round(CAST(sum(n) AS DOUBLE) / (SELECT sum(n) FROM M B WHERE B.k = M.k), 6) AS share FROM M GROUP BY 1, 2"


@query("q_census", _sql_census(ladder.CENSUS_BINS))
def census(spark, d):
    """Positions by multiplicity over the ladder."""
    return ladder.census(contigs(spark, d, True, starts=False), QUERY, LADDER)


@query("q_census_fine", _sql_census(ladder.FINE_BINS))
def census_fine(spark, d):
    """The same in nine bins."""
    return ladder.census(contigs(spark, d, True, starts=False), QUERY, LADDER, ladder.FINE_BINS)


RUNGS = ladder.SURVIVAL_LADDER
_rungs = " UNION ALL ".join(f"SELECT contig_id, lpos, pres, {i} AS rung FROM S{k}" for i, k in enumerate(RUNGS, 1))
_surv = "WITH " + sql_ladder(RUNGS) + ", " + ", ".join(sql_strata(k, True, str(k), False, made=True) for k in RUNGS) + f", R AS ({_rungs} UNION ALL SELECT contig_id, unnest(range(0, len)) AS lpos, 0 AS pres, 0 AS rung FROM O WHERE genome = '{QUERY}'), B AS (SELECT contig_id, lpos, " + ", ".join(f"coalesce(max(rung) FILTER (WHERE (pres & {1 << i}) <> 0), 0) AS {s}" for i, s in enumerate(SUBJECTS)) + " FROM R GROUP BY contig_id, lpos), V AS (" + " UNION ALL ".join(f"SELECT contig_id, lpos, '{s}' AS subject, CASE WHEN lpos + {RUNGS[0]} > len THEN 255 ELSE {s} END AS surv FROM B JOIN O USING (contig_id)" for s in SUBJECTS) + ")"


def _survival(spark, d):
    return ladder.survival_counts(contigs(spark, d, True, starts=False), QUERY, SUBJECTS, RUNGS)


@query("q_survival", f"{_surv} SELECT contig_id, subject, CAST(surv AS BIGINT) AS surv, count(*) AS n FROM V GROUP BY 1, 2, 3")
def survival(spark, d):
    """The last rung at which each position's k-mer survives, counted by contig."""
    return _survival(spark, d).groupBy("contig_id", "subject", "surv").agg(F.sum("n").alias("n"))


@query("q_survival_median", f"{_surv}, M AS (SELECT subject, CAST(floor(quantile_cont(surv, 0.5)) AS BIGINT) AS r FROM V WHERE surv <> 255 GROUP BY subject) SELECT subject, CAST(CASE WHEN r >= 1 THEN ([{', '.join(map(str, RUNGS))}])[r] ELSE 0 END AS BIGINT) AS median_k FROM M")
def survival_median(spark, d):
    """Median survival by subject."""
    return ladder.survival_medians(_survival(spark, d), RUNGS)


@query("q_survival_raster", f"{_surv} SELECT subject, contig_id, lpos // 10 AS bin, round(quantile_cont(CASE WHEN surv <> 255 THEN surv END, 0.5), 6) AS median FROM V GROUP BY 1, 2, 3 HAVING count(*) = 10")
def survival_raster(spark, d):
    """Median survival in bins of ten bases."""
    return ladder.raster_of_blocks(ladder.survival_blocks(contigs(spark, d, True, starts=False), QUERY, SUBJECTS, RUNGS, 10), 10)


# --- segments -------------------------------------------------------------------------------------------------------

#: Documents are short, so long segments are told by k = 61 here, not by the 1,001 that genomes call for.
SEGMENT_K = 61
_isl = ", E AS (" + " UNION ALL ".join(f"SELECT '{s}' AS subject, contig_id, lpos, pos // 4 AS ix, pres FROM S WHERE pos % 4 = 0 AND (pres & {1 << i}) <> 0" for i, s in enumerate(SUBJECTS)) + "), F AS (SELECT *, ix - row_number() OVER (PARTITION BY subject, contig_id ORDER BY ix) AS run FROM E), I AS (SELECT subject, contig_id, min(lpos) AS first, max(lpos) AS last, count(*) AS n, bit_and(pres) AS every FROM F GROUP BY subject, contig_id, run)"


def _islands(spark, d, k=SEGMENT_K):
    c, rows = _strata(spark, d, k, True, stride=4)
    return c, rows, segments.islands(rows, SUBJECTS, 4)


@query("q_segments", f"WITH {sql_strata(SEGMENT_K, True)}{_isl} SELECT * FROM I")
def segment_runs(spark, d):
    """Maximal identical segments with each subject, sampled at every fourth position."""
    return _islands(spark, d)[2]


_segc = f"WITH {sql_strata(SEGMENT_K, True)}{_isl}, C AS (SELECT I.*, {_sql_class('first')} AS class FROM I JOIN O USING (contig_id)), N AS (SELECT subject, class, count(*) AS segments, CAST(sum(n) AS BIGINT) AS positions FROM C GROUP BY 1, 2)"


def _segment_classes(spark, d):
    c, _, runs = _islands(spark, d)
    painted = intervals.paint(runs.withColumn("lpos", F.col("first")), intervals.disjoint(annotation(query_contigs(c))))
    return segments.segment_classes(painted)


@query("q_segment_classes", f"{_segc} SELECT * FROM N")
def segment_classes(spark, d):
    """Segments by the class they start in."""
    return _segment_classes(spark, d)


@query("q_top_classes", f"{_segc} SELECT subject, class, segments, positions, rank FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY segments DESC, class) AS rank FROM N) WHERE rank <= 4")
def top_classes(spark, d):
    """Each subject's four classes with most segments."""
    return segments.top_classes(_segment_classes(spark, d))


_among = ["siamang", "borang", "sorang", "gorilla", "chimp"]
_ucs = f"WITH {sql_strata(SEGMENT_K, True)}{_isl}, U AS (SELECT I.contig_id, first AS start, last + {SEGMENT_K} AS \"end\", last + {SEGMENT_K} - first AS len, concat_ws(',', " + ", ".join(f"CASE WHEN (every & {_mask(s)}) <> 0 THEN '{s}' END" for s in _among) + f") AS \"in\", greatest(first - 3000, 0) AS span_start, least(last + {SEGMENT_K} + 3000, O.len) AS span_end, O.len AS length FROM I JOIN O USING (contig_id) WHERE subject = 'siamang')"


def _ucs_rows(spark, d):
    c, rows, runs = _islands(spark, d)
    return rows, segments.ultraconserved(runs, query_contigs(c), SUBJECTS, SEGMENT_K)


@query("q_ultraconserved", f"{_ucs} SELECT * FROM U")
def ultraconserved(spark, d):
    """Segments identical with the most distant subject."""
    return _ucs_rows(spark, d)[1].withColumn("in", F.array_join("in", ","))


@query("q_segment_kind", f"{_ucs}, M AS (SELECT U.contig_id, U.start, U.\"end\", least(U.start, length - U.\"end\") AS dist_end, quantile_cont(mult, 0.5) AS m FROM U JOIN S ON S.contig_id = U.contig_id AND S.lpos >= U.start AND S.lpos < U.\"end\" AND S.pos % 4 = 0 GROUP BY 1, 2, 3, 4) SELECT contig_id, start, \"end\", dist_end, round(CAST(m AS DOUBLE), 6) AS median_copies, CASE WHEN m >= 255 THEN 'telomeric' WHEN m = 1 THEN 'single_copy' ELSE 'repeated' END AS kind FROM M")
def segment_kind(spark, d):
    """Those segments by distance to the contig's end and copies."""
    rows, found = _ucs_rows(spark, d)
    return segments.segment_kinds(found, rows)


# --- intervals ------------------------------------------------------------------------------------------------------

_ann = f"A AS (SELECT contig_id, {', '.join(['x.ord AS ord', 'x.class AS class', 'x.s AS start', 'x.e AS fin'])} FROM (SELECT contig_id, unnest([" + ", ".join(f"{{'ord': {i}, 'class': '{n}', 's': len * {a} // {b}, 'e': len * {c} // {e}}}" for i, (n, (a, b), (c, e)) in enumerate(PAINT)) + f"]) AS x FROM O WHERE genome = '{QUERY}') WHERE x.s < x.e)"


def _sql_merge(of: str, gap: int | None) -> str:
    new = "start > reach" if gap is None else f"start - reach >= {gap}"
    return f"M0 AS (SELECT *, max(fin) OVER (PARTITION BY contig_id ORDER BY start, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {of}), M1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR {new} THEN 1 ELSE 0 END) OVER (PARTITION BY contig_id ORDER BY start, fin ROWS UNBOUNDED PRECEDING) AS run FROM M0), MG AS (SELECT contig_id, min(start) AS start, max(fin) AS fin, count(*) AS pieces FROM M1 GROUP BY contig_id, run)"


@query("q_merge_intervals", f"WITH {sql_contigs()}, {_ann}, {_sql_merge('A', None)} SELECT contig_id, start, fin AS \"end\", pieces FROM MG")
def merge_intervals(spark, d):
    """Overlapping or touching intervals joined."""
    return intervals.merge(annotation(query_contigs(contigs(spark, d))))


@query("q_merge_gap", f"WITH {sql_contigs()}, {_ann}, {_sql_merge('A', 200)} SELECT contig_id, start, fin AS \"end\", pieces FROM MG")
def merge_gap(spark, d):
    """Intervals less than 200 bases apart joined."""
    return intervals.merge(annotation(query_contigs(contigs(spark, d))), 200)


@query("q_largest_interval", f"WITH {sql_contigs()}, {_ann} SELECT class, contig_id, start, fin AS \"end\" FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY fin - start DESC, contig_id, ord) AS r FROM A) WHERE r = 1")
def largest_interval(spark, d):
    """The longest interval of each class."""
    return intervals.largest(annotation(query_contigs(contigs(spark, d))))


_spots = ", L AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY fin - start DESC, contig_id, ord) AS r FROM A) WHERE r = 1)"


@query("q_spotlights", f"WITH {sql_strata(21)}, {_ann}{_spots} SELECT L.class AS id, S.contig_id, S.lpos, pres, mult FROM L JOIN S ON S.contig_id = L.contig_id AND S.lpos >= L.start AND S.lpos < L.fin")
def spotlights(spark, d):
    """Strata inside the longest interval of each class."""
    c, rows = _strata(spark, d, 21)
    regions = intervals.largest(annotation(query_contigs(c))).withColumnRenamed("class", "id")
    return intervals.within(rows, regions).select("id", "contig_id", "lpos", "pres", "mult")


#: Invented labels in the form of two annotation releases.
LABELS = [("chm13", x) for x in ("hor_1_5(S3C1H2-A,B)", "hor_1_1(S1C1H1L)", "hor_2_1(S1C1H1L,S2)", "hsat1A_3", "ct_1_2", "mon_4", "rDNA_2", "censat_3_1", "junk_1")] + [("hg002", x) for x in ("active_hor(S1C1H1L)", "hor(S3C1)", "mixedAlpha(S1)", "GAP", "HSat3", "cenSat(x)", "bSat", "SD")]
_lab = "(VALUES " + ", ".join(f"('{r}', '{x}')" for r, x in LABELS) + ") t(release, label)"
_fam = "CASE " + " ".join(f"WHEN f2 = '{a}' THEN '{b}'" for a, b in FAMILIES.items()) + " END"


@query("q_label_class", f"WITH B AS (SELECT release, label, split_part(label, '(', 1) AS base FROM {_lab}), D AS (SELECT *, split_part(base, '_', 1) AS f1, CASE WHEN base LIKE 'active%' THEN 'active_hor' ELSE split_part(base, '_', 1) END AS f2, substr(label, length(base) + 1) AS rest FROM B), E AS (SELECT release, label, CASE WHEN release = 'chm13' THEN CASE WHEN f1 = 'hor' AND regexp_matches(rest, 'L\\)$|L,') THEN 'hor_active' ELSE f1 END ELSE {_fam} END AS class FROM D) SELECT release, label, CASE WHEN class IN ({', '.join(repr(c) for c in CLASSES)}) THEN class END AS class FROM E")
def label_class(spark, d):
    """Classes of annotation labels."""
    rows = spark.createDataFrame(LABELS, "release string, label string")
    return rows.withColumn("class", F.when(F.col("release") == "chm13", region_class(F.col("label"))).otherwise(region_class(F.col("label"), "hg002")))


_arr = f"WITH {sql_strata(21)}, {_ann}, H AS (SELECT * FROM A WHERE class = 'hor_active'), {_sql_merge('H', 500)}, Q AS (SELECT MG.contig_id, MG.start, MG.fin, pres, mult FROM MG JOIN (SELECT DISTINCT contig_id, start, fin FROM H) H ON H.contig_id = MG.contig_id AND H.start >= MG.start AND H.fin <= MG.fin JOIN S ON S.contig_id = H.contig_id AND S.lpos >= H.start AND S.lpos < H.fin), Z AS (SELECT contig_id, start, fin, count(*) AS n, 100.0 * avg(CAST(mult = 1 AS INT)) AS sc, " + ", ".join(f"100.0 * avg(CAST((pres & {1 << i}) <> 0 AS INT)) AS {s}" for i, s in enumerate(SUBJECTS)) + " FROM Q GROUP BY 1, 2, 3)"
_best = "CASE " + " ".join(f"WHEN {s} = greatest({', '.join(SUBJECTS[1:])}) THEN '{s}'" for s in SUBJECTS[1:]) + " END"


@query("q_array_table", _arr + " " + " UNION ALL ".join(f"SELECT contig_id, start, fin AS \"end\", n, round(CAST(sc AS DOUBLE), 6) AS single_copy_pct, '{s}' AS subject, round(CAST({s} AS DOUBLE), 6) AS shared_pct, {_best} AS closest_ape FROM Z" for s in SUBJECTS))
def array_table(spark, d):
    """Arrays of active intervals, a row for each subject."""
    c, rows = _strata(spark, d, 21)
    active = annotation(query_contigs(c)).filter("class = 'hor_active'")
    t = arrays.array_table(rows, active, SUBJECTS, 500)
    return t.select("contig_id", "start", "end", "n", "single_copy_pct", F.explode("shared_pct").alias("subject", "shared_pct"), "closest_ape")


# --- others ---------------------------------------------------------------------------------------------------------


@query("q_within_pair", f"WITH {sql_painted(31)} " + _sql_total("count(*) AS valid_positions, " + _cnt("(pres & 2) <> 0", "shared_chimp") + ", " + _cnt("(pres & 4) <> 0", "shared_bonobo") + ", CAST(0 AS BIGINT) AS human_specific, " + _cnt("(pres & 6) = 0", "chm13_only") + ", " + _cnt("(pres & 6) <> 0", "ape_any") + ", count(*) FILTER (WHERE mult = 1) AS unique_in_query, count(*) FILTER (WHERE mult > 1) AS multi_in_query", "P"))
def within_pair(spark, d):
    """Two subjects only, without the one that stands for the query's own kind."""
    c = contigs(spark, d)
    pair = ["chimp", "bonobo"]
    return summaries.class_sharing(_cube(c, [31], pair).drop("k"), pair)


_two = f"WITH {sql_strata(31)}, " + ", ".join(f"X{i} AS (SELECT '{name}' AS run, contig_id, count(*) AS positions, count(*) FILTER (WHERE (pres & {bits}) <> 0) AS shared, CAST(sum(mult_full) AS BIGINT) AS copies FROM S WHERE pos % {step} = 0 GROUP BY contig_id)" for i, (name, bits, step) in enumerate((("pair", 6, 1), ("one", 1, 8))))


@query("q_key_tables", f"{_two} SELECT * FROM X0 UNION ALL SELECT * FROM X1")
def key_tables(spark, d):
    """Two runs, of other subjects and stride, from k-mers that were written once."""
    c = contigs(spark, d)
    name = f"keys_{uuid.uuid4().hex}"
    keytables.write_keys(c, 31, [QUERY, *SUBJECTS], name, f"{shared_root(spark)}/helixlake/{name}", 16)
    out = []
    for run, subjects, stride in (("pair", ["chimp", "bonobo"], 1), ("one", ["hg002"], 8)):
        rows = keytables.strata_from_keys(spark, name, c, QUERY, subjects, 31, stride)
        out.append(rows.groupBy("contig_id").agg(F.count(F.lit(1)).alias("positions"), F.count_if(F.col("pres") != 0).alias("shared"), F.sum("mult_full").alias("copies")).withColumn("run", F.lit(run)))
    return out[0].unionByName(out[1])


_rand = """WITH W AS (SELECT c.i AS contig_id, w.i AS w, ((1::UHUGEINT * 11400714819323198485 * 7 + 305419896 + (c.i * 938 + w.i + 1)::UHUGEINT * 11400714819323198485) % 18446744073709551616)::UBIGINT AS z, least(30000, 100000 - c.i * 30000) AS n FROM range(0, 4) c(i), range(0, 938) w(i)),
A AS (SELECT contig_id, w, n, ((xor(z, z >> 30)::UHUGEINT * 13787848793156543929) % 18446744073709551616)::UBIGINT AS z FROM W),
B AS (SELECT contig_id, w, n, ((xor(z, z >> 27)::UHUGEINT * 10723151780598845931) % 18446744073709551616)::UBIGINT AS z FROM A),
C AS (SELECT contig_id, w, n, xor(z, z >> 31) AS z FROM B),
D AS (SELECT contig_id, w * 32 + j.i AS p, n, (z >> (2 * j.i)::UBIGINT) & 3 AS code FROM C, range(0, 32) j(i))
SELECT contig_id, substr('ACGT', CAST(code AS BIGINT) + 1, 1) AS base, count(*) AS n, CAST(sum(p) AS BIGINT) AS places FROM D WHERE p < n GROUP BY 1, 2"""


@query("q_random_genome", _rand)
def random_bases(spark, d):
    """Bases of a random genome of 100,000 in contigs of 30,000, with the sum of their places."""
    g = random_genome(spark, 100_000, 7, 30_000)
    each = g.select("contig_id", F.posexplode(F.split(F.col("seq").cast("string"), "")).alias("p", "base")).filter("base <> ''")
    return each.groupBy("contig_id", "base").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("places"))


@query("q_random_control", None)
def random_control(spark, d):
    """Chance presence: the query against a random subject at a short and a long k."""
    c = contigs(spark, d, True).select("genome", "contig_id", "name", "seq", "len", "start")
    both = c.unionByName(random_genome(spark, 1_000_000, 1, 300_000).select(*c.columns))
    found = _by_k(strata.cells(both, QUERY, ["random"], [10, 31]), [10, 31], shared=F.col("pres") != 0)
    return found.select("valid", "shared", "k").withColumn("expected", F.round(1 - F.exp(F.lit(-1_000_000.0) * 2 / F.power(F.lit(4.0), "k")), 6))


#: Alignments of a query of 200 bases, made up to hold every operation.
ALIGNED = [(0, 0, 60, "+", "40=1X19=", "P"), (1, 60, 120, "-", "20=1D20=2I18=", "P"), (2, 100, 150, "+", "25=25=", "S"), (3, 120, 180, "-", "10=5X45=", "P"), (4, 150, 190, "+", "15=3D25=", "S")]
_spans = [(0, 0, 40), (0, 41, 60), (1, 60, 78), (1, 80, 100), (1, 100, 120), (2, 100, 150), (3, 120, 165), (3, 170, 180), (4, 150, 165), (4, 165, 190)]


@query("q_alignment_exact", "WITH R AS (SELECT * FROM (VALUES " + ", ".join(map(str, _spans)) + ") t(aln, a, b)) SELECT CAST(aln AS BIGINT) AS aln, CAST(unnest(range(a, b - 14)) AS BIGINT) AS p FROM R WHERE b - a >= 15")
def alignment_exact(spark, d):
    """Query positions whose 15-mer lies in one uninterrupted stretch of matches."""
    rows = spark.createDataFrame(ALIGNED, "aln int, qstart long, qend long, strand string, cigar string, tp string")
    return align.exact_starts(rows, 15)


@query("q_heatmap", f"WITH {sql_strata(21)}, V AS (SELECT contig_id, lpos // 1000 * 1000 AS start, count(*) AS valid, {', '.join(_cnt(_win[c], c) for c in ('chimp', 'siamang', 'human_specific'))} FROM S GROUP BY 1, 2), X AS (" + " UNION ALL ".join(f"SELECT contig_id, start, '{c}' AS layer, CAST({c} AS DOUBLE) / valid AS share FROM V" for c in ("chimp", "siamang", "human_specific")) + ") SELECT X.contig_id, X.start, X.layer, round(X.share, 6) AS share, round(T.top, 6) AS top FROM X JOIN (SELECT layer, quantile_cont(share, 0.99) AS top FROM X GROUP BY layer) T ON T.layer = X.layer")
def heatmap(spark, d):
    """Window shares of three layers with the top of their colour scale."""
    c, rows = _strata(spark, d, 21)
    shares = arrays.window_shares(summaries.windows(rows, query_contigs(c), SUBJECTS, 1000), ["chimp", "siamang", "human_specific"])
    return shares.join(F.broadcast(arrays.colour_scale(shares)), "layer").select("contig_id", "start", "layer", "share", "top")


@query("q_profile", f"WITH {sql_strata(21)}, {_ann}, W AS (SELECT contig_id, len, unnest(range(0, (len + 999) // 1000)) AS win FROM O WHERE genome = '{QUERY}'), V AS (SELECT contig_id, lpos // 1000 AS win, count(*) AS valid, {', '.join(_cnt(_win[c], c) for c in ('chimp', 'gorilla'))} FROM S GROUP BY 1, 2), N AS (SELECT contig_id, greatest(min(start) - 500, 0) AS lo, max(fin) + 500 AS hi FROM A WHERE class <> 'SD' GROUP BY contig_id) SELECT W.contig_id, W.win * 1000 AS start, least((W.win + 1) * 1000, len) AS \"end\", round(coalesce(CAST(chimp AS DOUBLE), 0) / greatest(coalesce(valid, 0), 1), 6) AS chimp, round(coalesce(CAST(gorilla AS DOUBLE), 0) / greatest(coalesce(valid, 0), 1), 6) AS gorilla FROM W LEFT JOIN V ON V.contig_id = W.contig_id AND V.win = W.win LEFT JOIN N ON N.contig_id = W.contig_id WHERE lo IS NULL OR (W.win * 1000 >= lo AND least((W.win + 1) * 1000, len) <= hi)")
def profile(spark, d):
    """Window shares around the annotated span of each contig."""
    c, rows = _strata(spark, d, 21)
    track = summaries.windows(rows, query_contigs(c), SUBJECTS, 1000)
    return arrays.profile(track, annotation(query_contigs(c)), ["chimp", "gorilla"], 500)


# --- round trips through files --------------------------------------------------------------------------------------


def _fresh(spark, name: str) -> str:
    """A folder of its own for a query that writes and reads again."""
    return f"{shared_root(spark)}/helixlake/{name}-{uuid.uuid4().hex}"


@query("q_fasta_round_trip", f"WITH {sql_contigs()} SELECT genome, name, start, len, md5(s) AS digest FROM O")
def fasta_round_trip(spark, d):
    """All genomes written as FASTA, one gzipped, and read again, with their contigs in order."""
    c, out = contigs(spark, d), []
    for genome in GENOMES:
        path = _fresh(spark, "fasta")
        sinks.write_fasta(c.filter(F.col("genome") == genome), path, compress=genome == QUERY)
        out.append(read_fasta(spark, path, genome).select("genome", "name", "start", "len", F.md5("seq").alias("digest")))
    return reduce(DataFrame.unionByName, out)


@query("q_fasta_parts", f"WITH {sql_contigs()}, {sql_kmers(21)} SELECT genome, count(*) AS n, count(DISTINCT key) AS kinds, CAST(sum(pos) AS BIGINT) AS places FROM K WHERE genome IN ('{QUERY}', 'chimp') GROUP BY genome")
def fasta_parts(spark, d):
    """K-mers of genomes read in parts of contigs, never whole."""
    c, out = contigs(spark, d), []
    for genome in (QUERY, "chimp"):
        path = _fresh(spark, "fasta")
        sinks.write_fasta(c.filter(F.col("genome") == genome), path)
        rows = kmers(read_fasta_parts(spark, path, genome), 21)
        out.append(rows.groupBy("genome").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("kinds"), F.sum("pos").alias("places")))
    return reduce(DataFrame.unionByName, out)


@query("q_strata_round_trip", f"WITH {sql_strata(21)} SELECT * FROM S WHERE contig_id % 3 = 0 AND lpos >= 100 AND lpos < 900")
def strata_round_trip(spark, d):
    """A run written by position and k, and a slice of it read again."""
    path = _fresh(spark, "strata")
    c, rows = _strata(spark, d, 21)
    length = query_contigs(c).agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
    sinks.write_strata(rows, path, QUERY, 21, length=length)
    return sinks.read_strata(spark, path, QUERY, 21).filter("contig_id % 3 = 0 and lpos >= 100 and lpos < 900")


_every = f"A AS (SELECT contig_id, lpos, start + lpos AS pos FROM (SELECT contig_id, start, unnest(range(0, len)) AS lpos FROM O WHERE genome = '{QUERY}')), D AS (SELECT A.contig_id, A.lpos, coalesce(S.pres, 0) AS pres, coalesce(S.mult, 0) AS mult FROM A LEFT JOIN S ON S.contig_id = A.contig_id AND S.lpos = A.lpos WHERE A.pos % 4 = 0)"


def _packed(spark, d):
    path = _fresh(spark, "packed")
    c, rows = _strata(spark, d, 21, stride=4)
    packed.write_packed(packed.pack(rows, c, QUERY, 4, 1024), path, QUERY, 21, 4)
    return packed.read_packed(spark, path, QUERY, 21, 4)


@query("q_packed_dense", f"WITH {sql_strata(21)}, {_every} SELECT * FROM D")
def packed_dense(spark, d):
    """Every fourth position from a run packed in blocks of bytes."""
    return packed.unpack(_packed(spark, d), 4)


#: Regions cut out of packed blocks: contig, start, end.
CUT = [(0, 100, 900), (8, 1000, 3000), (16, 0, 50), (24, 1023, 1025), (999_999_999, 0, 10)]


@query("q_packed_regions", f"WITH {sql_strata(21)}, {_every} " + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS region, * FROM D WHERE contig_id = {c} AND lpos >= {a} AND lpos < {b}" for i, (c, a, b) in enumerate(CUT)))
def packed_regions(spark, d):
    """Regions of that run."""
    blocks = _packed(spark, d)
    parts = [packed.region(blocks, c, a, b, 4, 1024).withColumn("region", F.lit(i)) for i, (c, a, b) in enumerate(CUT)]
    return reduce(DataFrame.unionByName, parts)


@query("q_table_round_trip", f"WITH {sql_painted(21)} " + _sql_total(_sharing_body, "P"))
def table_round_trip(spark, d):
    """A class table as gzipped tab-separated text and back."""
    path = _fresh(spark, "table")
    sinks.write_table(summaries.class_sharing(_cells(spark, d), SUBJECTS), path, compress=True)
    return sinks.read_table(spark, path)


@query("q_json_round_trip", f"WITH {sql_strata(21)}, X AS (" + " UNION ALL ".join(_stats.format(s=s, i=i, b=1 << i) for i, s in enumerate(SUBJECTS)) + f") SELECT '{QUERY}' AS query, CAST(21 AS BIGINT) AS k, subject, bit, length, distinct_kmers, shared_distinct, shared_entries FROM X")
def json_round_trip(spark, d):
    """The description of a run as JSON and back, a row for each subject."""
    path = _fresh(spark, "meta")
    sinks.write_json(strata.run_meta(contigs(spark, d), QUERY, SUBJECTS, 21, 8), path)
    return sinks.read_json(spark, path).select("query", "k", F.explode("subjects").alias("s")).select("query", "k", "s.*")


#: Labels that the annotation's classes are written as.
BED_LABELS = {"SD": "SD_1", "ct": "ct_4_2", "hor_active": "hor_3_1(S1C3H1L)", "hsat3": "hsat3_1(x)"}


@query("q_bed_round_trip", f"WITH {sql_contigs()}, A AS (SELECT contig_id, x.class AS class, x.s AS start, x.e AS fin FROM (SELECT contig_id, unnest([" + ", ".join(f"{{'class': '{n}', 's': len * {a} // {b}, 'e': len * {c} // {e}}}" for n, (a, b), (c, e) in PAINT) + f"]) AS x FROM O WHERE genome = '{QUERY}') WHERE x.s < x.e) SELECT 'd' || contig_id AS chrom, start, fin AS \"end\", class FROM A")
def bed_round_trip(spark, d):
    """The annotation written as BED labels and read as classes."""
    path = _fresh(spark, "bed")
    c = query_contigs(contigs(spark, d))
    label = F.coalesce(*[F.when(F.col("class") == k, F.lit(v)) for k, v in BED_LABELS.items()])
    sinks.write_bed(annotation(c).join(c.select("contig_id", F.col("name").alias("chrom")), "contig_id").withColumn("label", label), path)
    return read_bed(spark, path).select("chrom", "start", "end", "class")


# --- alignments of the query's contigs ------------------------------------------------------------------------------


def made_alignments(c: DataFrame) -> DataFrame:
    """Three alignments for each contig of 100 bases or more: two primary ones, one of them of the other strand, and a secondary."""
    long, third = c.filter("len >= 100"), "cast(n div 3 as string)"
    spans = [(0, "len div 10", "len * 9 div 10", "+", "P", f"concat(n div 4, '=1X', {third}, '=2D', n - n div 4 - 1 - n div 3, '=')"), (1, "len div 2", "len - len div 20", "-", "P", f"concat({third}, '=3I', n - n div 3 - 3, '=')"), (2, "cast(0 as bigint)", "len div 5", "+", "S", "concat(n, '=')")]
    out = []
    for i, a, b, strand, kind, cigar in spans:
        one = long.select("name", "len", (F.col("contig_id") * 3 + i).alias("aln"), F.expr(a).alias("qstart"), F.expr(b).alias("qend"), F.lit(strand).alias("strand"), F.lit(kind).alias("tp"))
        out.append(one.withColumn("n", F.col("qend") - F.col("qstart")).withColumn("cigar", F.expr(cigar)))
    return out[0].unionByName(out[1]).unionByName(out[2])


def read_back(spark, rows: DataFrame, c: DataFrame) -> DataFrame:
    """The same through a PAF file, placed on contigs by name."""
    path = _fresh(spark, "paf")
    zero = F.lit(0).cast("long")
    tags = F.create_map(F.lit("tp:A"), "tp", F.lit("cg:Z"), "cigar", F.lit("id:i"), F.col("aln").cast("string"))
    sinks.write_paf(rows.select(F.col("name").alias("qname"), F.col("len").alias("qlen"), "qstart", "qend", "strand", F.lit("t").alias("tname"), F.col("len").alias("tlen"), zero.alias("tstart"), F.col("n").alias("tend"), F.col("n").alias("matches"), F.col("n").alias("block"), F.lit(60).alias("mapq"), tags.alias("tags")), path)
    back = read_paf(spark, path).select("qname", "qstart", "qend", "strand", F.col("tags")["cg:Z"].alias("cigar"), F.col("tags")["tp:A"].alias("tp"), F.col("tags")["id:i"].cast("long").alias("aln"))
    return align.place(back, c)


_aln = "N AS (SELECT *, len // 10 AS q0, len * 9 // 10 AS e0, len // 2 AS q1, len - len // 20 AS e1, len // 5 AS e2 FROM O WHERE genome = '" + QUERY + "' AND len >= 100), Z AS (SELECT *, e0 - q0 AS n0, e1 - q1 AS n1 FROM N)"
_fits = lambda *spans: " OR ".join(f"(lpos >= {a} AND lpos + 21 <= {b})" for a, b in spans)
_ok0 = _fits(("q0", "q0 + n0 // 4"), ("q0 + n0 // 4 + 1", "q0 + n0 // 4 + 1 + n0 // 3"), ("q0 + n0 // 4 + 1 + n0 // 3", "e0"))
_ok1 = _fits(("e1 - n1 // 3", "e1"), ("q1", "e1 - n1 // 3 - 3"))
_conc = f"""WITH {sql_strata(21)}, {_aln}, X AS (SELECT S.pres, S.mult, Z.len IS NOT NULL AND (({_ok0}) OR ({_ok1}) OR ({_fits(('0', 'e2'))})) AS exact, CASE WHEN Z.len IS NOT NULL AND lpos >= q1 AND lpos + 21 <= e1 THEN ({_ok1}) WHEN Z.len IS NOT NULL AND lpos >= q0 AND lpos + 21 <= e0 THEN ({_ok0}) END AS last, Z.len IS NOT NULL AND ((lpos >= q0 AND lpos < e0) OR (lpos >= q1 AND lpos < e1)) AS covered FROM S LEFT JOIN Z ON Z.contig_id = S.contig_id), Y AS (SELECT *, (pres & 2) <> 0 AS present, NOT exact AND last IS NOT NULL AND NOT last AS broken FROM X) SELECT count(*) AS valid, {_cnt('present', 'present')}, {_cnt('exact', 'exact')}, {_cnt('exact AND present', 'exact_present')}, {_cnt('broken', 'broken')}, {_cnt('broken AND present', 'broken_present')}, {_cnt('broken AND mult = 1', 'broken_single')}, {_cnt('broken AND mult = 1 AND present', 'broken_single_present')}, {_cnt('NOT covered', 'uncovered')}, {_cnt('NOT covered AND present', 'uncovered_present')} FROM Y"""


@query("q_alignment_concordance", _conc)
def alignment_concordance(spark, d):
    """Presence in one subject against alignments of every contig, through a PAF file."""
    c = contigs(spark, d)
    own = query_contigs(c)
    laid = align.layers(read_back(spark, made_alignments(own), own), 21)
    return align.concordance_of_cells(strata.cells(c, QUERY, SUBJECTS, [21], laid=laid), F.col("pres").bitwiseAND(2) != 0)


# --- regions, levels, chromosomes, chance ---------------------------------------------------------------------------

#: Fixed regions by contig name, as spotlights have them for chromosomes.
FIXED = [("head", "d0", 0, 300), ("inside", "d24", 200, 100_000), ("none", "nowhere", 0, 10)]
_half = "least(150, (fin - start) // 2 + 50)"
_regions = f"""{_ann}, L AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY fin - start DESC, contig_id, ord) AS r FROM A) WHERE r = 1), SDS AS (SELECT * FROM A WHERE class = 'SD'), {_sql_merge('SDS', None)},
R0 AS (SELECT class || '_block' AS id, contig_id, (start + fin) // 2 - {_half} AS a, (start + fin) // 2 + {_half} AS b FROM L WHERE class IN ('hsat3', 'ct') UNION ALL SELECT 'hor_active_edge', contig_id, start - 150, start + 150 FROM L WHERE class = 'hor_active' UNION ALL (SELECT 'sd_largest', contig_id, start, least(fin, start + 400) FROM MG ORDER BY fin - start DESC, contig_id, start LIMIT 1) UNION ALL SELECT f.id, contig_id, f.a, f.b FROM (VALUES {', '.join(map(str, FIXED))}) f(id, name, a, b) JOIN O ON O.name = f.name WHERE genome = '{QUERY}'),
R AS (SELECT id, contig_id, greatest(a, 0) AS a, least(b, len) AS b FROM R0 JOIN O USING (contig_id) WHERE greatest(a, 0) < least(b, len))"""


@query("q_spotlight_regions", f"WITH {sql_strata(21)}, {_regions} SELECT R.id, R.contig_id, a AS start, b AS \"end\", count(S.lpos) AS n, coalesce(CAST(sum(pres) AS BIGINT), 0) AS pres, coalesce(CAST(sum(mult) AS BIGINT), 0) AS mult FROM R LEFT JOIN S ON S.contig_id = R.contig_id AND S.lpos >= a AND S.lpos < b GROUP BY 1, 2, 3, 4")
def spotlight_regions(spark, d):
    """Fixed regions, blocks, an edge and the longest joined duplication, with what the strata hold there."""
    c, rows = _strata(spark, d, 21)
    own = query_contigs(c)
    regions = intervals.spotlights(annotation(own), own, FIXED, ("hsat3", "ct"), ("hor_active",), 150, 50, 400)
    inside = intervals.within(rows, regions).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("pres").alias("pres"), F.sum("mult").alias("mult"))
    return regions.join(inside, "id", "left").select("id", "contig_id", "start", "end", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n", "pres", "mult")])


@query("q_level_offsets", f"WITH {sql_contigs()} SELECT contig_id, name, len AS length, (len + 99) // 100 AS n0, (len + 999) // 1000 AS n1, (len + 9999) // 10000 AS n2, CAST(coalesce(sum((len + 9999) // 10000) OVER (ORDER BY contig_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM O WHERE genome = '{QUERY}'")
def level_offsets(spark, d):
    """Windows of each contig at each level, and where its widest ones start."""
    return summaries.level_offsets(query_contigs(contigs(spark, d)), 100)


@query("q_chrom_filter", f"WITH {sql_painted(21)}, Q AS (SELECT * FROM P WHERE contig_id % 16 IN (0, 8) AND contig_id <> 16) SELECT class, valid_positions, round(100.0 * shared_hg002 / valid_positions, 1) AS hg002_pct, round(100.0 * shared_siamang / valid_positions, 1) AS siamang_pct, CASE WHEN shared_siamang > 0 THEN round(100.0 * human_specific / shared_siamang, 1) END AS specific_pct FROM (" + _sql_total(_sharing_body, "Q") + ")")
def chrom_filter(spark, d):
    """Class sharing in percent over chosen contigs, one of them left out by name; what has nothing to share is null."""
    c, rows = _strata(spark, d, 21)
    chosen = only(query_contigs(c).filter("contig_id % 16 in (0, 8)"), without=["d16"]).select("contig_id")
    t = summaries.class_sharing(summaries.cube(_paint(c, rows.join(chosen, "contig_id", "left_semi"))), SUBJECTS)
    pct = lambda a, b: F.round(share(F.col(a), F.col(b)) * 100, 1)
    return t.select("class", "valid_positions", pct("shared_hg002", "valid_positions").alias("hg002_pct"), pct("shared_siamang", "valid_positions").alias("siamang_pct"), pct("human_specific", "shared_siamang").alias("specific_pct"))


CHANCE = [8, 10, 12, 31]
_rand_bases = _rand.split("\nSELECT contig_id, substr")[0].replace("* 938", "* 63").replace("range(0, 938)", "range(0, 63)").replace("range(0, 4)", "range(0, 50)").replace("least(30000, 100000 - c.i * 30000)", "2000")
_chance = _rand_bases + f""", RG AS (SELECT 'random' AS genome, contig_id, string_agg(substr('ACGT', CAST(code AS BIGINT) + 1, 1), '' ORDER BY p) AS s FROM D WHERE p < n GROUP BY contig_id),
{sql_contigs(True)}, BOTH_ AS (SELECT genome, contig_id, start, s, len FROM O WHERE genome IN ('{QUERY}', 'hg002') UNION ALL SELECT genome, contig_id, contig_id * 2000 AS start, s, CAST(2000 AS BIGINT) AS len FROM RG)"""
_chance += "".join(f", {sql_kmers(k, f'K{k}', 'BOTH_')}, T{k} AS (SELECT key, bool_or(genome = 'random') AS hit, bool_or(genome = 'hg002') AS own FROM K{k} GROUP BY key)" for k in CHANCE)
_chance += " " + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS k, count(*) AS valid, {_cnt('hit', 'random')}, {_cnt('own', 'hg002')}, round(1 - exp(-100000.0 * 2 / pow(4.0, {k})), 6) AS expected FROM K{k} JOIN T{k} USING (key) WHERE genome = '{QUERY}'" for k in CHANCE)


@query("q_random_curve", _chance)
def random_curve(spark, d):
    """Presence over k in a random genome of 100,000 bases beside that in a subject, with what chance would give."""
    c = contigs(spark, d, True).filter(F.col("genome").isin(QUERY, "hg002")).select("genome", "contig_id", "name", "seq", "len", "start")
    both = prepared(c.unionByName(random_genome(spark, 100_000, 7, 2000).select(*c.columns)).drop("start"))
    found = _by_k(strata.cells(both, QUERY, ["random", "hg002"], CHANCE), CHANCE, random=has_bit(F.col("pres"), 0), hg002=has_bit(F.col("pres"), 1))
    return found.select("valid", "random", "hg002", "k").withColumn("expected", F.round(1 - F.exp(F.lit(-100_000.0) * 2 / F.power(F.lit(4.0), "k")), 6))


__all__ = ["REGISTRY", "SQL", "contigs"]
