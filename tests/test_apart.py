"""Domains that neither touch nor overlap, and how far apart they are."""

from __future__ import annotations

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators import domains as D
from tessera.operators import spatial as P


@pytest.mark.parametrize("tied", [1.5, 0.4])
def test_apart(spark, tied):
    """All pairs out of the graph that are near enough, against a plain count; on a full lattice none is left to compare."""
    rng = random.Random(8)
    points = [(k, float(k % 12), float(k // 12)) if tied == 1.5 else (k, rng.uniform(0, 12), rng.uniform(0, 12)) for k in range(144)]
    rows = [(f"D{g}", *points[k]) for g in range(30) for k in sorted(rng.sample(range(144), 4))]
    b = spark.createDataFrame(rows, "group string, spot long, x double, y double")
    p = spark.createDataFrame(points, "spot long, x double, y double")
    edges = P.within(p, p, tied).select(F.col("spot").alias("u"), F.col("other").alias("v"))
    graph = D.pairs(b.withColumnRenamed("group", "domain"), edges).cache()
    held = {(r.i, r.j) for r in graph.collect()}
    of = {}
    for g, _, x, y in rows:
        of.setdefault(g, []).append((x, y))
    one = lambda a, b: sum(sorted(min(math.dist(s, t) for t in of[b]) for s in of[a])[:3]) / 3
    want = {(a, b): min(one(a, b), one(b, a)) for a in of for b in of if a < b and (a, b) not in held}
    want = {k: round(v, 9) for k, v in want.items() if v <= 1.5}
    got = {(r.i, r.j): round(r.distance, 9) for r in D.apart(b, edges, graph, 1.5).collect()}
    assert {k: v for k, v in got.items() if v <= 1.5} == want and not held & set(got)
    near = spark.read.parquet(max(Path(spark.conf.get("spark.checkpoint.dir")).glob("near-*"), key=lambda p: p.stat().st_mtime).as_posix()).count()
    assert bool(want) == bool(near) == (tied < 1)
