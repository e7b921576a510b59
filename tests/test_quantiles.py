"""Quantiles by counts against numpy, interpolation included."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixlake.operators import quantiles


def table(seed):
    r = random.Random(seed)
    out = [("few", float(r.randint(0, 4))) for _ in range(57)] + [("one", 3.5), ("same", 2.0), ("same", 2.0), (None, 1.0), (None, 4.0), ("nulls", None)]
    out += [("skewed", r.random() ** 9 * 1e6) for _ in range(400)] + [("wide", r.choice([-1e12, 0.0, 1e-9, 7.0])) for _ in range(33)] + [("few", None)] * 5
    return out


@pytest.mark.parametrize("q", [0, 0.25, 0.5, 0.99, 1])
@pytest.mark.parametrize("bins", [1, 7, 4096])
def test_exact(spark, q, bins):
    rows = table(3)
    want = {g: float(np.quantile([v for h, v in rows if h == g and v is not None], q)) for g in {h for h, v in rows if v is not None}}
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r["quantile"] for r in quantiles.quantile(df, ["g"], F.col("v"), q, bins).collect()}
    assert set(got) == set(want) and all(got[g] == pytest.approx(want[g], rel=1e-12, abs=1e-12) for g in want)


def test_of_counts_and_without_groups(spark):
    values = [1, 1, 1, 2, 5, 5, 9]
    counts = spark.createDataFrame([(v, values.count(v)) for v in set(values)], "v int, n long")
    for q in (0, 0.3, 0.5, 0.9):
        assert quantiles.of_counts(counts, [], "v", q).first()[0] == pytest.approx(np.quantile(values, q))
        rows = spark.createDataFrame([(v,) for v in values], "v int")
        assert quantiles.quantile(rows, [], F.col("v"), q).first()[0] == pytest.approx(np.quantile(values, q))
    assert quantiles.quantile(rows.filter("v > 99"), ["v"], F.col("v"), 0.5).count() == 0
    with pytest.raises(ValueError):
        quantiles.quantile(rows, ["v"], F.col("v"), 2)
