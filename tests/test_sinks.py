from pyspark.sql import functions as F

from helixlake.operators import strata as S
from helixlake.sources import sinks
from tests.test_kmers import contigs_of, mosaic


def test_round_trips(spark, tmp_path):
    c = contigs_of(spark, mosaic(3, {"q": [9, 4], "s1": [5], "s2": [6, 2]}))
    for k in (21, 33):
        sinks.write_strata(S.strata(c, "q", ["s1", "s2"], k), str(tmp_path / "s"), "q", k)
    sinks.write_strata(S.strata(c, "q", ["s1", "s2"], 21), str(tmp_path / "s"), "q", 21)
    for k in (21, 33):
        rows = S.strata(c, "q", ["s1", "s2"], k)
        back = sinks.read_strata(spark, str(tmp_path / "s"), "q", k)
        assert sorted(map(tuple, back.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    stats = S.subject_stats(c, "q", ["s1", "s2"], 21)
    sinks.write_table(stats, str(tmp_path / "t"), compress=True)
    assert sorted(map(tuple, sinks.read_table(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, stats.collect()))
    sinks.write_json(S.run_meta(c, "q", ["s1", "s2"], 21), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().k == 21


def test_what_is_written_in_ranges_is_computed_once(spark, tmp_path):
    from helixlake.operators import packed

    def counted(df):
        seen = spark.sparkContext.accumulator(0)

        def count(batches):
            for b in batches:
                seen.add(len(b))
                yield b

        return seen, df.repartition(3).mapInArrow(count, df.schema)

    seen, rows = counted(spark.range(1000).selectExpr("id div 300 as contig_id", "id % 300 as lpos", "id as pos", "1 as pres", "2 as mult", "2L as mult_full"))
    sinks.write_strata(rows, f"file://{tmp_path}/strata", "q", 21, length=1000)
    back = sinks.read_strata(spark, f"file://{tmp_path}/strata", "q", 21)
    assert seen.value == 1000 and back.select("pos").distinct().count() == back.count() == 1000
    ranges = back.groupBy(F.input_file_name()).agg(F.min("pos").alias("a"), F.max("pos").alias("b")).sort("a").collect()
    assert len(ranges) > 1 and all(x.b < y.a for x, y in zip(ranges, ranges[1:]))
    seen, blocks = counted(spark.range(50).selectExpr("id as contig_id", "0L as block", "0L as first", "1L as n", "X'01' as pres", "X'02' as mult"))
    packed.write_packed(blocks, f"file://{tmp_path}/packed", "q", 21)
    assert seen.value == 50 and packed.read_packed(spark, f"file://{tmp_path}/packed", "q", 21).count() == 50
