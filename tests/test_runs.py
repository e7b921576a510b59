"""Counting k-mers by runs, against k-mers one by one."""

import random

import pytest
from pyspark.sql import functions as F

from helixlake.operators import keytables, ladder
from helixlake.operators import strata as S
from helixlake.operators.kmers import kmers, pieces, spectrum
from tests.test_kmers import comp, contigs_of


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    bricks = ["".join(r.choices("ACGT", k=700)) for _ in range(30)]
    row = lambda n: "".join(comp(x) if r.random() < 0.4 else x for x in r.choices(bricks, k=n))
    return {"q": {"a": row(25), "b": bricks[0] * 3 + "N" + bricks[1], "c": "A" * 21_000, "d": "AC"} | {f"x{i}": bricks[2] for i in range(300)}, "s": {"a": row(9), "b": "T" * 9000}, "u": {"a": row(5)} | {f"x{i}": comp(bricks[2]) for i in range(300)}}


def test_no_key_is_exchanged(spark, texts):
    c = contigs_of(spark, texts)
    frames = [S.strata(c, "q", ["s", "u"], 61, 4), S.strata_ladder(c, "q", ["s", "u"], [21, 101]), ladder.census(c, "q", [16, 201]), ladder.survival(c, "q", ["s", "u"], [16, 201])]
    for df in frames:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(key" not in plan and "key#" not in plan


@pytest.mark.parametrize("k", [1, 4, 16, 32, 33, 2100])
def test_runs_are_their_kmers(spark, texts, k):
    from helixlake.operators.runs import dealt, presence, spectra

    c, subjects = contigs_of(spark, texts), ["s", "u"]
    every = kmers(c, k)
    held = every.groupBy("key").agg(F.sum((F.col("genome") == "q").cast("long")).alias("full"), *[F.max(F.col("genome") == s).cast("int").alias(s) for s in subjects])
    want = every.filter("genome = 'q'").join(held, "key").selectExpr("contig_id", "lpos", "pos", "s + 2 * u as pres", "full as mult_full")
    got = presence(pieces(c, [k]), "q", subjects, [k]).drop("k")
    assert want.exceptAll(got).count() == got.exceptAll(want).count() == 0 and got.count() > 0
    assert spectra(c, [k], ["q", "s", "u"]).drop("k").exceptAll(spectrum(every)).count() == 0
    size = dealt(pieces(c, [k]), [k], subjects).agg(F.sum(F.length("head") + F.length("s"))).first()[0]
    assert size <= 3.5 * every.filter("genome <> 'q'").count()  # bytes a k-mer; a key alone has 8 or 16


def test_raster_of_blocks(spark, texts):
    c, ks = contigs_of(spark, texts), [16, 33, 90, 400]
    want = ladder.survival_raster(ladder.survival(c, "q", ["s", "u"], ks), 7)
    got = ladder.raster_of_blocks(ladder.survival_blocks(c, "q", ["s", "u"], ks, 7), 7)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_buckets_of_keys_grow_with_the_genomes(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(keytables, "BUCKET_KEYS", 20_000, raising=False)
    c = contigs_of(spark, texts)
    keytables.write_keys(c, 31, ["q", "s", "u"], "keys_growing", f"file://{tmp_path}/keys", 4)
    plan = keytables.strata_from_keys(spark, "keys_growing", c, "q", ["s"], 31)._jdf.queryExecution().executedPlan().toString()
    bases = sum(len(s) for g in texts.values() for s in g.values())
    assert f"out of {-(-bases // 20_000)}" in plan and bases > 100_000
    spark.sql("drop table keys_growing")


@pytest.mark.parametrize("stride", [1, 5])
def test_cells_are_painted_positions(spark, texts, stride):
    from helixlake.operators.intervals import paint
    from helixlake.operators.summaries import cube

    c = contigs_of(spark, texts)
    ids = [r.contig_id for r in c.filter("genome = 'q' and len > 9000").select("contig_id").collect()]
    painted = [(ids[0], 0, 3, "SD"), (ids[0], 3, 9001, "ct"), (ids[0], 9001, 9002, "SD"), (ids[1], 4095, 4097, "hor"), (ids[1], 5000, 30_000, "rDNA")]
    painted = spark.createDataFrame(painted, "contig_id long, start long, end long, class string")
    got = S.painted_cells(c, "q", ["s", "u"], [21, 101], painted, stride)
    want = cube(paint(S.strata_ladder(c, "q", ["s", "u"], [21, 101], stride), painted), "k")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select("k", "class", "pres", "mult", "n").collect()))
    marks = {r["class"]: r.n for r in got.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    assert {"unique", "SD", "ct", "hor", "rDNA"} >= set(marks) and marks["ct"] > 0 and marks["rDNA"] > 0


@pytest.mark.parametrize("name", ["q_lineage_patterns", "q_by_multiplicity", "q_alignment_concordance", "q_random_curve", "q_random_control"])
def test_positions_are_counted_where_they_are(spark, name):
    import __spark_entry__ as entry
    from tests.conftest import DATA

    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "mult_full#" not in plan  # no row for each position
    assert not any("lpos#" in x for x in plan.splitlines() if "Join" in x)
