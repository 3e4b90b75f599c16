"""Neighbours by cosine and hybrid graphs against plain versions."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row

from tessera.operators import graph as H
from tessera.operators import neighbours as B
from tessera.operators import spatial as P

SCHEMA = "sample string, spot long, vec array<double>, key string, cell int"


def clustered(rng, n, dimension=12):
    middle = rng.normal(size=(8, dimension))
    return (middle[rng.integers(8, size=n)] + rng.normal(size=(n, dimension)) * 0.25).tolist()


def plain(rows, k):
    out = []
    fine = [(s, i, np.array(v, float)) for s, i, v in rows if v is not None and None not in v and np.isfinite(v).all() and any(v)]
    unit = {(s, i): v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for s, i, v in fine}
    for s, i, _ in fine:
        found = sorted((-round(float(unit[s, i] @ unit[t, j]), 9), j) for t, j, _ in fine if s == t and i != j)[:k]
        out += [(s, i, j, round(-sim, 6), slot + 1) for slot, (sim, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block, pivots", [(1024, 512), (8, 6), (8, 1)])
def test_cosine_nearest(spark, monkeypatch, block, pivots):
    monkeypatch.setattr(B, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [("ab"[k % 2], k, v) for k, v in enumerate(clustered(rng, 260))]
    rows += [("a", 1000 + k, rows[0][2]) for k in range(60)] + [("b", 2000 + k, [2 * x for x in rows[1][2]]) for k in range(9)]
    rows += [("c", 1, rows[0][2]), ("d", 1, rows[0][2]), ("d", 2, rows[1][2]), ("a", 3000, None), ("a", 3001, [0.0] * 12), ("a", 3002, [math.nan] * 12), ("b", 3003, [1e-200 * x for x in rows[5][2]]), ("b", 3004, [1e200 * x for x in rows[5][2]])]
    rows += [("a", 3005, [-x for x in rows[0][2]])]
    table = spark.createDataFrame([(*x, "clash", 1) for x in rows], SCHEMA).repartition(3)
    looks = []
    got = B.cosine_nearest(table, 5, ["sample"], pivots, looks)
    assert sorted((r.sample, r.spot, r.other, round(r.sim, 6), r.slot) for r in got.collect()) == plain(rows, 5)
    assert looks[0] < 0.75 * looks[1] or pivots == 1
    assert B.cosine_nearest(table.limit(0), 5, ["sample"]).count() == 0


def test_a_vector_goes_to_a_block_once():
    """Its bytes stood beside each cell it searches; now beside each block, which holds many cells, and in small frames."""
    rows = [Row(cell=c, low=[0.0] * 3, high=[3.2] * 3, many=n, n=n) for c, n in enumerate([3, 3, 20, 1, 2])]
    shape = B._Shape(rows, 8)
    assert shape.block.tolist() == [0, 0, 1, 4, 4] and shape.parts.tolist() == [1, 1, 3, 1, 1] and shape.sides == 4
    u = np.eye(5)
    f = pd.DataFrame({"key": [hashlib.md5(x.tobytes()).digest() for x in u] * 200, "u": [x.tobytes() for x in u] * 200, "least": -1.0})
    frames = list(B._asking(u, {(): shape}, [], 1, True)([f]))
    assert max(map(len, frames)) <= 256 * 5 and sum(map(len, frames)) <= 1000 * 5
    assert all(g.groupby(level=0)["block"].nunique().max() <= 5 for g in frames)


def test_cosine_nearest_without_samples(spark):
    rng = np.random.default_rng(3)
    rows = [("", k, v) for k, v in enumerate(clustered(rng, 150, 40))]
    got = B.cosine_nearest(spark.createDataFrame([x[1:] for x in rows], "spot long, vec array<float>"), 200)
    assert got.groupBy("spot").count().where("count = 149").count() == 150  # fewer others than asked for: all of them


@pytest.mark.parametrize("mode", ["spatial_knn", "radius", "hybrid"])
@pytest.mark.parametrize("weighted, reduce", [(False, "max"), (True, "mean")])
def test_hybrid_graph(spark, mode, weighted, reduce):
    rng = np.random.default_rng(5)
    xy = rng.random((60, 2)) * 8
    vec = clustered(rng, 60)
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "spot long, x double, y double")
    near = H.stored(P.nearest(points, 6, 2.0), "near")
    every = H.stored(B.cosine_nearest(spark.createDataFrame(list(enumerate(vec)), "spot long, vec array<double>"), 9), "expression")
    got = {(r.u, r.v): (round(r.w_spatial, 6), round(r.w_expr, 6), r.kind) for r in B.hybrid_edges(near, B.gated(every, near, points, mode), weighted, reduce).collect()}
    apart = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    knn = {(a, int(b)) for a in range(60) for b in [b for b in np.lexsort((np.arange(60), np.round(apart[a], 12))) if b != a][:6]}
    dist = [apart[e] for e in knn]
    radius = np.quantile(dist, 0.9)
    found = {(s, j): sim for _, s, j, sim, _ in plain([("", k, v) for k, v in enumerate(vec)], 9)}
    keep = {"spatial_knn": lambda e: e in knn, "radius": lambda e: apart[e] <= radius, "hybrid": lambda e: e in knn or apart[e] <= radius}[mode]
    weights = {}
    for e in knn:
        for way in (e, e[::-1]):
            weights.setdefault(way, ([], []))[0].append(math.exp(-0.5 * (apart[e] / np.median(dist)) ** 2) if weighted else 1.0)
    for e, sim in found.items():
        for way in (e, e[::-1]) if keep(e) else ():
            weights.setdefault(way, ([], []))[1].append(min(1, max(0, (sim + 1) / 2)))
    one = lambda x: round(float(np.mean(x) if reduce == "mean" else max(x)), 6) if x else 0.0
    assert {e: x[:2] for e, x in got.items()} == {e: (pytest.approx(one(s), abs=2e-6), pytest.approx(one(x), abs=2e-6)) for e, (s, x) in weights.items()}
    assert all(x[2] == ("both" if x[0] and x[1] else "spatial_only" if x[0] else "expr_only" if x[1] else "none") for x in got.values())
    with pytest.raises(ValueError):
        B.gated(every, near, points, "nothing")
