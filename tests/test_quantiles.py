"""Exact quantiles against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.operators import quantiles
from hearthline.operators.quantiles import exact_quantiles

SHARES = [0.0, 0.33, 0.5, 0.66, 1.0]


@pytest.mark.parametrize("bins", [1024, 3])
def test_equals_numpy(spark, monkeypatch, bins):
    """Few values and many, ties, values far apart, one value, none."""
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = np.random.default_rng(1)
    columns = {"uniform": rng.random(501), "ties": rng.integers(0, 4, 300).astype(float), "far": np.exp(rng.normal(size=200) * 9), "signs": np.concatenate([-(10.0 ** np.arange(0, 30)), 10.0 ** np.arange(0, 31)]), "one": np.array([7.0]), "two": np.array([-1e308, 1e308])}
    rows = [(name, float(x)) for name, xs in columns.items() for x in xs] + [("none", None), ("uniform", None)]
    got = exact_quantiles(spark.createDataFrame(rows, "feature string, x double").repartition(5), SHARES)
    assert set(got) == set(columns)
    for name, xs in columns.items():
        s = np.sort(xs)
        for share, x in zip(SHARES, got[name]):
            at = (len(s) - 1) * share
            low, high, part = int(np.floor(at)), int(np.ceil(at)), at - np.floor(at)
            assert x == (1 - part) * s[low] + part * s[high]
            assert np.isclose(x, np.quantile(xs, share), rtol=1e-12, atol=0) or name in ("two", "signs")


def test_ten_million_distinct_values(spark):
    n = 10_000_000
    rows = spark.range(n).select(F.lit("x").alias("feature"), (F.col("id") * 7919 % n / 3.0).alias("x"))
    got = exact_quantiles(rows, [0.33, 0.5, 0.66])["x"]
    assert np.allclose(got, np.quantile(np.arange(n) / 3.0, [0.33, 0.5, 0.66]), rtol=1e-14)


def test_no_rows(spark):
    assert exact_quantiles(spark.createDataFrame([], "feature string, x double"), SHARES) == {}
