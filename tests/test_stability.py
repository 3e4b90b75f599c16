"""Cosines of candidates in blocks, and what is measured on them."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators import gss as G
from tessera.operators import spatial as P


def lattice(spark, n, rng):
    odd = {3: None, 4: [0.0] * 8, 5: [math.nan] * 8, 6: [math.inf] * 8, 7: [1.0, 2.0], 8: [1.0, None] * 4, 9: [], 10: [1e-200] * 8}
    rows = [(k, float(k % 25), float(k // 25), odd.get(k, [rng.gauss(0, 1) for _ in range(8)])) for k in range(n)]
    return spark.createDataFrame(rows, "spot long, x double, y double, vec array<double>").repartition(3).cache()


def test_cosines_of_blocks(spark):
    """With squares, with crowded ones and without places: as the expression has them, also of odd vectors; absent ones drop pairs."""
    s = lattice(spark, 300, random.Random(4))
    near = P.nearest(s.select("spot", "x", "y"), 12, 2.0).select("spot", "other", "d2").cache()
    held = s.where("spot <> 77")
    a, b = held.select("spot", F.col("vec").alias("va")), held.select(F.col("spot").alias("other"), F.col("vec").alias("vb"))
    want = {(r.spot, r.other): str(r.sim) for r in near.join(a, "spot").join(b, "other").select("spot", "other", F.round(X.cosine("va", "vb"), 9).alias("sim")).collect()}
    for t, size in ((held, 40), (held, 3), (held.drop("x", "y"), 40), (held.withColumn("x", F.lit(1.0)).withColumn("y", F.lit(2.0)), 40)):
        got = G.cosines(near, t, size=size).collect()
        assert len(got) == len(want) and {(r.spot, r.other): str(r.sims[0]) for r in got} == want
    assert {"nan", "None", "0.0"} < set(want.values())


def test_vectors_travel_once(spark):
    """A vector goes to the blocks that want it, not to each of its pairs in each repeat."""
    s = lattice(spark, 2500, random.Random(5))
    near = P.nearest(s.select("spot", "x", "y"), 24, 3.0)
    sent = []
    G.cosines(near, s, lambda t: (sent.append(t), G.noisy(t, 2, 0.02, 1, plain=True))[1], 3, size=512)
    assert 2500 < sent[0].count() < 2 * 2500  # 24 pairs a spot, by both ends and three versions, would be 360,000


def test_neighbour_stability(spark):
    """As sets of top neighbours that are chosen for each repeat by itself."""
    s = lattice(spark, 500, random.Random(6))
    near = P.nearest(s.select("spot", "x", "y"), 24, 3.0).select("spot", "other", "d2").cache()
    every = near.select(F.col("spot").alias("u"), F.col("other").alias("v"))
    tops = lambda t: G.choose_neighbours(near, every, t, 12).select("spot", F.col("other").alias("gene"))
    noise, base = G.noisy(s.select("spot", "vec"), 2, 0.3, 7), tops(s)
    one, two = ({r.spot: r.jaccard for r in G.top_set_stability(base, tops(noise.where(f"repeat = {k}").select("spot", "vec"))).collect()} for k in (1, 2))
    got = {r.spot: r.stability for r in G.neighbour_stability(G.cosines(near, s, lambda t: G.noisy(t, 2, 0.3, 7, plain=True), 3), 12, 2).collect()}
    assert len(got) == 500 and got == {k: (v + two[k]) / 2 for k, v in one.items()} and min(got.values()) < 1
