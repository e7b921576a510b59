"""Fill-in-the-middle against a plain version, and exact restoration."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixlake.llm import middles, queries
from tests.conftest import DATA

P, S, M = middles.SENTINELS


def plain(text, doc_id, percent=100, spm=50, seed=7):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(x in text for x in (P, S, M)) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    return (n, "spm", len(pre), len(mid), S + suf + P + pre + M + mid) if h4 % 100 < spm else (n, "psm", len(pre), len(mid), P + pre + S + suf + M + mid)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_against_plain_version(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op11_fill_in_middle(spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        n, form, a, b, out = plain(texts[r.doc_id], r.doc_id)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, a, b, sha(out), sha(texts[r.doc_id]))
    assert {r.form for r in rows} >= {"psm", "spm"}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<PSM>ab\n\r日👍", max_size=40), st.integers(-3, 50), st.sampled_from([0, 40, 100]), st.sampled_from([0, 50, 100]))
def test_one_text(text, doc_id, percent, spm):
    import regex

    got = middles.rearrange(text, str(doc_id), regex.compile(middles.LINE), 7, percent, spm, middles.SENTINELS)
    assert got == plain(text, doc_id, percent, spm)
    assert middles.rebuild(got[4], got[1]) == text


def test_edges_and_other_columns(spark, edge, none):
    out = middles.fill_in_middle(edge.withColumn("form", edge.lang), percent=70, digests=True)
    back = middles.restore(out)
    before = sorted((str(r.doc_id), r.text or "") for r in edge.collect())
    assert sorted((str(r.doc_id), r.restored) for r in back.collect()) == before
    for r in out.collect():
        assert r["bucket"] == "kept" and r.output_sha256 == sha(r.output)
    assert set(edge.columns) - {"text", "n"} <= set(out.columns) and len(out.columns) == len(set(out.columns))
    got = {(str(r.doc_id), r.n) for r in out.collect()}
    assert ("3", 0) in got and ("4", 0) in got and ("7", 3) in got
    assert middles.fill_in_middle(none).count() == 0


def test_other_units_and_sentinels(spark):
    df = spark.createDataFrame([(i, "one two  three" * (i % 4)) for i in range(40)], "doc_id long, text string")
    out = middles.fill_in_middle(df, unit=r"\S+\s*|\s+", seed=3, sentinels=("[pre]", "{suf}", "(mid)")).collect()
    for r in out:
        assert middles.rebuild(r.output, r.form, ("[pre]", "{suf}", "(mid)")) == "one two  three" * (r.doc_id % 4)
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "<S<", "<M>"), ("", "<S>", "<M>"), ("a", "ab", "c")):
        with pytest.raises(ValueError):
            middles.check_sentinels(bad)


def test_damaged_outputs_are_refused():
    for output, form in ((f"{P}a{S}b", "psm"), (f"{S}a{M}b", "spm"), (f"x{P}{S}{M}", "psm")):
        with pytest.raises(ValueError):
            middles.rebuild(output, form)
