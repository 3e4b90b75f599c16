"""Joins whose sides grow with the spots are exchanges, whatever the size of their files."""

from __future__ import annotations

from tessera.operators import domains as D


def test_pairs_are_not_sent(spark):
    m = spark.createDataFrame([("a", "p", 1, 1.0), ("b", "p", 2, 1.0)], "domain string, program string, spot long, value double")
    e = spark.createDataFrame([(1, 2), (2, 1)], "u long, v long")
    for t in (D.pairs(m, e), D.sides(m, e)):
        assert "Broadcast" not in t._jdf.queryExecution().executedPlan().toString()
