"""Buckets of k-mers counted in parts, and what dealing them out holds."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from helixlake.operators import runs
from helixlake.operators import strata as S
from helixlake.operators.kmers import pieces
from tests.test_kmers import comp, contigs_of


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    bricks = ["".join(r.choices("ACGT", k=300)) for _ in range(20)]
    row = lambda n: "".join(comp(x) if r.random() < 0.4 else x for x in r.choices(bricks, k=n))
    return {"q": {"a": row(20), "b": bricks[0] * 2 + "N" + bricks[1], "c": "A" * 5000, "d": "AC"}, "hg002": {"a": row(6), "b": "T" * 900}, "u": {"a": row(3)}}


@pytest.mark.parametrize("k", [16, 101])
def test_large_buckets_are_counted_in_parts(spark, texts, k, monkeypatch):
    c = contigs_of(spark, texts)
    want = S.strata(c, "q", ["hg002", "u"], k).collect()
    held = []

    class Held(runs.Bucket):
        def __init__(self, k, rows):
            super().__init__(k, rows)
            held.append(int(self.n.sum()))

    cut = pieces(c, [k])
    dealt = runs.dealt(cut, [k], ["q"], places=True).unionByName(runs.dealt(cut, [k], ["hg002", "u"])).toArrow()
    one = dealt.set_column(1, "bucket", pa.array([0] * len(dealt), pa.int32())).combine_chunks().to_batches()
    monkeypatch.setattr(runs, "COUNTED", 1000)
    monkeypatch.setattr(runs, "Bucket", Held)
    got = pa.Table.from_batches(runs._counting(runs._presence(1))(one)).to_pylist()
    assert sorted((r["contig_id"], r["lpos"], r["pos"], r["pres"], r["mult_full"]) for r in got) == sorted((r.contig_id, r.lpos, r.pos, r.pres, r.mult_full) for r in want)
    assert len(held) > 5 and max(held) < sum(held) / 2


def test_dealing_holds_little():
    r = np.random.default_rng(1)
    texts = [bytes(r.choice(np.frombuffer(b"ACGT", np.uint8), 4000)) for _ in range(600)]
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(["q"] * n), pa.array(range(n)), pa.array([0] * n), pa.array([0] * n), pa.array(texts, pa.binary())], names=["genome", "contig_id", "a", "base", "f"])
    run = runs._deal((31,), 4000, ("q",), False, 256, None)
    tracemalloc.start()
    out = sum(b.nbytes for b in run([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out > 2_000_000 and peak < 50 << 20, (out, peak)
