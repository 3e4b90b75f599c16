"""Quantiles by selection against NumPy's."""

import numpy as np
import pytest

from tessera.functions import stats as S


@pytest.mark.parametrize("q", [0.25, 0.8])
def test_quantile_by_group(spark, q):
    rng = np.random.default_rng(1)
    groups = {
        "even": rng.normal(size=3001).tolist(), "skewed": (10 ** rng.uniform(-300, 300, 2000)).tolist(), "ties": rng.integers(0, 4, 2500).astype(float).tolist(), "one": [3.0],
        "same": [1.5] * 900, "huge": [-1.7e308, 1.7e308, *rng.normal(size=700).tolist()], "tiny": [5e-324 * k for k in range(500)], "few": [2.0, 1.0, None, float("nan"), float("inf")],
    }
    rows = [(g, 1, v) for g, own in groups.items() for v in own] + [("none", 1, None), ("none", 1, float("-inf"))]
    df = spark.createDataFrame(rows, "g string, _v int, x double").repartition(5)
    want = {g: np.quantile([v for v in own if v is not None and np.isfinite(v)], q) for g, own in groups.items()}
    for held in (S.HELD, 40):
        got = {r.g: r.quantile for r in S.quantile(df, "x", q, ["g"], held).collect()}
        assert got == {g: pytest.approx(v, rel=1e-12) for g, v in want.items()}


def test_quantile_of_all(spark):
    x = np.random.default_rng(2).gamma(2, 3, 5000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for q in (0.0, 0.999, 1.0):
        assert S.quantile(df, "x", q, held=64).first()[0] == pytest.approx(np.quantile(x, q), rel=1e-12)
        assert S.quantile(df, "x", q).first()[0] == pytest.approx(np.quantile(x, q), rel=1e-12)
    assert S.quantile(df.limit(0), "x", 0.5).count() == 0
