"""Survival in passes: long k are asked only where short ones were shared."""

import random

import pytest

from helixlake.operators import ladder, runs
from tests.test_kmers import comp, contigs_of


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    fresh = lambda n: "".join(r.choices("ACGT", k=n))
    common, edge = fresh(900), fresh(60)
    return {"q": {"a": fresh(3970) + common + fresh(5000), "b": fresh(700) + comp(common)[:300] + "N" + common[:200] + edge, "c": fresh(30)}, "s": {"a": common + fresh(2000) + edge, "b": fresh(4080) + edge}, "u": {"a": comp(common[100:800]) + fresh(900)}}


def test_long_rungs_only_where_short_ones_are_shared(spark, texts, monkeypatch):
    c, ks, seen = contigs_of(spark, texts), [12, 16, 20, 33, 90, 400], []
    monkeypatch.setattr(ladder, "alive", lambda *a, f=runs.alive: seen.append(f(*a)) or seen[-1])
    monkeypatch.setattr(runs, "PASS", 1 << 12)
    got = sorted(map(tuple, ladder.survival(c, "q", ["s", "u"], ks).collect()))
    n = seen[0].selectExpr("sum(n)").first()[0]
    assert 0 < n < 0.4 * sum(len(s) for g in texts.values() for s in g.values())
    monkeypatch.setattr(ladder, "FULL", 99)
    assert got == sorted(map(tuple, ladder.survival(c, "q", ["s", "u"], ks).collect())) and len(seen) == 1
    assert max(x[3] for x in got if x[3] < 255) == 6


def test_counts_of_blocks(spark, texts, monkeypatch):
    c, ks = contigs_of(spark, texts), [12, 16, 20, 90]
    want = ladder.survival(c, "q", ["s", "u"], ks).groupBy("contig_id", "subject", "surv").count().collect()
    monkeypatch.setattr(ladder, "LAID", 1)  # a block at a time
    got = ladder.survival_counts(c, "q", ["s", "u"], ks).groupBy("contig_id", "subject", "surv").agg({"n": "sum"}).collect()
    assert sorted(map(tuple, want)) == sorted(map(tuple, got))
