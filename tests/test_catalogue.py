"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

NAMES = ["q_contig_index", "q_kmer_stride", "q_strata_dense_stride4", "q_small_query", "q_class_sharing", "q_window_pyramid", "q_census", "q_segments", "q_merge_gap", "q_label_class", "q_array_table", "q_random_genome", "q_alignment_exact", "q_fasta_round_trip", "q_strata_round_trip", "q_table_round_trip", "q_json_round_trip", "q_bed_round_trip", "q_alignment_concordance", "q_spotlight_regions", "q_level_offsets", "q_chrom_filter", "q_random_curve", "q_segment_kind"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    r = db.execute(entry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    key = lambda z: tuple((v is None, str(v)) for v in z)
    got = sorted((tuple(x[c] for c in cols) for x in df.collect()), key=key)
    want = sorted((tuple(x[names.index(c)] for c in cols) for x in r.fetchall()), key=key)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert len(entry.oracle_sql()) >= 45 and set(entry.oracle_sql()) <= set(entry.queries())
