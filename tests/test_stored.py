"""Key tables and packed runs: the same answers from what was written once, and what is read for them."""

import uuid

import pytest
from pyspark.sql import functions as F

from helixlake.operators import keytables, packed
from helixlake.operators import strata as S
from tests.test_kmers import contigs_of, mosaic


@pytest.fixture(scope="module")
def c(spark):
    return contigs_of(spark, mosaic(11, {"q": [15, 0, 4, 9], "s1": [8, 3], "s2": [7], "s3": [6]}))


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def unbroadcast(spark):
    """As with tables too large to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("k", [19, 44])
def test_runs_from_key_tables(spark, c, tmp_path, k, unbroadcast):
    name = f"keys_{uuid.uuid4().hex}"
    table = keytables.write_keys(c, k, ["q", "s1", "s2", "s3"], name, f"file://{tmp_path}/keys", buckets=8)
    assert set(table.columns) == {"genome", "key", "n"} | ({"key2"} if k > 32 else set())
    for subjects, stride in ((["s1", "s2", "s3"], 1), (["s3"], 6), ([], 2)):
        again = keytables.strata_from_keys(spark, name, c.filter("genome = 'q'"), "q", subjects, k, stride)
        assert rows(again) == rows(S.strata(c, "q", subjects, k, stride))
        # the only exchanges are those of the query's bases and positions
        plan = again._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Exchange hashpartitioning") == 2 and plan.count("REPARTITION_BY_NUM") == 1
        side = plan[plan.index("HashAggregate") :].replace("BroadcastExchange", "")
        assert "Exchange" not in side and "Bucketed: true" in side
    spark.sql(f"drop table {name}")


@pytest.mark.parametrize("stride,block", [(1, 64), (3, 100), (7, 65_536), (50, 16)])
def test_packed_runs_are_dense(spark, c, tmp_path, stride, block):
    run = S.strata(c, "q", ["s1", "s2"], 19, stride)
    path = f"file://{tmp_path}/packed"
    packed.write_packed(packed.pack(run, c, "q", stride, block), path, "q", 19, stride)
    packed.write_packed(packed.pack(run.filter("1 = 0"), c, "q", stride, block), path, "q", 20, stride)
    blocks = packed.read_packed(spark, path, "q", 19, stride)
    want = rows(S.dense(run, c, "q", stride).select("contig_id", "lpos", "pres", "mult"))
    assert rows(packed.unpack(blocks, stride)) == want
    assert packed.unpack(packed.read_packed(spark, path, "q", 20, stride), stride).agg(F.sum("mult"), F.count("*")).first() == (0, len(want))
    for contig, a, b in ((0, 0, 10_000), (0, 130, 131), (0, 90, 210), (3, 63, 129), (1, 0, 5), (9, 0, 5), (2, 5, 5)):
        got = rows(packed.region(blocks, contig, a, b, stride, block)) if a < b else []
        assert got == [x for x in want if x[0] == contig and a <= x[1] < b]


def test_a_region_reads_its_files_only(spark, c, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = f"file://{tmp_path}/packed"
        packed.write_packed(packed.pack(S.strata(c, "q", ["s1"], 19), c, "q", 1, 32), path, "q", 19)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    blocks = packed.read_packed(spark, path, "q", 19)
    some = packed.region(blocks, 3, 100, 140, 1, 32)
    assert some.count() == 40
    some.collect()
    scan = some._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    read = scan.metrics().apply("numOutputRows").value()
    assert 0 < read < 0.5 * blocks.count()
