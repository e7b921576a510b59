"""Cells of a ladder of k in passes: what is exchanged at a time is bounded."""

from helixlake.operators import runs
from helixlake.operators import strata as S
from tests.test_kmers import contigs_of
from tests.test_passes import texts  # noqa: F401


def test_cells_in_passes(spark, texts, monkeypatch):  # noqa: F811
    c, ks, made = contigs_of(spark, texts), [16, 21, 101], []
    want = sorted(map(tuple, S.cells(c, "q", ["s", "u"], ks, 8).collect()))
    monkeypatch.setattr(runs, "PASS", 1 << 12)
    monkeypatch.setattr(S, "stage", lambda df, name, f=S.stage: made.append(name) or f(df, name))
    assert want == sorted(map(tuple, S.cells(c, "q", ["s", "u"], ks, 8).collect())) and made == ["cells"] * 3
