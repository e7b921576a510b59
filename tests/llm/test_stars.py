"""Links inside buckets by few candidate pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixlake.llm import stars


def _grouped(spark, monkeypatch, selective):
    """Groups of 300 numbers of one bucket, linked within 100, and the names and rows of what was staged on the way."""
    staged, made = [], stars.stage
    monkeypatch.setattr(stars, "stage", lambda df, name="t": staged.append((name, df._jdf.queryExecution().optimizedPlan().toString(), out := made(df, name), out.count())) or out)
    monkeypatch.setattr(stars, "unstage", lambda df: None)
    rows = spark.createDataFrame([(0, (i * 7919) % 100_003, i) for i in range(300)], "bucket int, member long, trait long").withColumn("bucket", F.col("bucket").cast("long"))
    texts = lambda ids: ids.join(rows.select(F.col("member").alias("id"), F.col("trait").cast("string").alias("text")), "id")
    near = lambda a, b: F.abs(a - b) <= 100
    features = lambda column: [np.array([int(x)]) for x in column.to_pylist()]
    linked = lambda a, b: abs(int(a[0]) - int(b[0])) <= 100
    buckets, traits = (rows.select("bucket", "member"), rows.select("member", "trait")) if selective else (rows, None)
    out = stars.link_buckets(buckets, near, texts, features, linked, traits).collect()
    assert len(out) == 300 and {r.comp for r in out} == {min(r.node for r in out)}
    return staged


def test_members_of_a_bucket_meet_by_few_pairs(spark, monkeypatch):
    staged = _grouped(spark, monkeypatch, True)
    assert sum(n for name, *_, n in staged if name in ("stars", "pairs")) < 3000  # 300 members make 24,950 pairs within 100


def test_buckets_are_not_joined_with_their_own_sums(spark, monkeypatch):
    for name, plan, *_ in _grouped(spark, monkeypatch, False):
        assert name not in ("met", "rest") or "bucket" not in "".join(x for x in plan.splitlines() if "Join" in x)


@pytest.mark.parametrize("held", [1024, 64])
def test_near_members_meet_without_pairs(spark, monkeypatch, held):
    """900 members of one bucket, most of them near each other but linked only in threes: rows stay in proportion to members."""
    made, real = {}, stars.stage

    def counted(df, name="t"):
        made[name] = made.get(name, 0) + (out := real(df, name)).count()
        return out

    monkeypatch.setattr(stars, "stage", counted)
    monkeypatch.setattr(stars, "HELD", held, raising=False)
    near, word = lambda a, b: F.abs(a - b) <= 500, lambda i: (i * 7919) % 900
    rows = spark.createDataFrame([(0, i + 1, word(i)) for i in range(900)], "bucket long, member long, trait long")
    texts = lambda ids: ids.join(rows.select(F.col("member").alias("id"), F.col("trait").cast("string").alias("text")), "id")
    features = lambda column: [np.array([int(x)]) for x in column.to_pylist()]
    linked = lambda a, b: a[0] // 3 == b[0] // 3
    sketches = stars.Sketches(lambda t: [t], lambda found: np.array(found).reshape(-1, 1), lambda a, b: np.abs(a - b)[:, 0] <= 500)
    out = stars.link_buckets(rows.select("bucket", "member"), near, texts, features, linked, rows.select("member", "trait"), sketches).collect()
    want = {}
    for i in range(900):
        want.setdefault(word(i) // 3, []).append(i + 1)
    assert {r.node: r.comp for r in out} == {m: min(x) for x in want.values() for m in x}
    assert "pairs" not in made and made["members"] <= 900 and made["near"] <= 900 * -(-900 // held)
