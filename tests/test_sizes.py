"""Steps that once grew faster than their input, and ties that rounding once decided."""

from __future__ import annotations

import math
import random
import re
from pathlib import Path

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import stats as S
from tessera.operators import atlas as A
from tessera.operators import gss as G
from tessera.operators import programs as M
from tessera.operators import spatial as P
from tessera.operators import templates as L


def test_anchor_of_tied_roles(spark):
    """A role's mean is the same whatever the order of its sum, so the first of tied roles is the anchor."""
    values, names, rows = [0.1, 0.2, 0.3, 0.4, 0.7, 0.6, 0.9], [f"s{k}" for k in range(30)], []
    for k, s in enumerate(names):  # two roles have equal values, each in an order of its own, so their sums differ in the last bit
        rng = random.Random(k)
        one, two = (rng.sample(values, len(values)) for _ in "12")
        rows += [(s, f"D{i}", "P0", x, y, 0.0, 0.0) for i, (x, y) in enumerate(zip(one, two, strict=True))]
    d = spark.createDataFrame(rows, "sample string, domain string, program string, scaffold_like double, interface_like double, node_like double, companion_like double").coalesce(1)
    n = spark.createDataFrame([(s, "N", 3, 0.5, 0.5, 1, 1) for s in names], "sample string, niche string, member_count long, confidence double, cohesion double, pair_count long, cross_edges long")
    pairs = spark.createDataFrame([(s, "N", "P0", "P0") for s in names], "sample string, niche string, left string, right string")
    got = A.assembly_matrix(n, d.select("sample", F.lit("N").alias("niche"), "domain", "program"), d, pairs).select("dominant_pair").distinct().collect()
    assert [r[0] for r in got] == ["↔".join([A.STRIP_ROLES[0]] * 2)]


def test_directed_distance_of_large_groups(spark):
    """Groups are compared whole or by grid cells with the same distances, also where a's spots are far from b's."""
    rng = random.Random(3)
    at = {"a": (0, 40), "b": (30, 60), "c": (500, 510), "d": (7, 7)}
    rows = [(g, 1000 * k + i, float(rng.randint(low, high)), float(rng.randint(low, high))) for k, (g, (low, high)) in enumerate(at.items()) for i in range(60)]
    members = spark.createDataFrame(rows, "group string, spot long, x double, y double")
    pairs = spark.createDataFrame([(a, b) for a in at for b in at if a != b], "a string, b string")
    whole, cells = ({(r.a, r.b): round(r.distance, 9) for r in P.directed_distance(pairs, members, 0.4, every=n).collect()} for n in (10_000, 0))
    assert cells == whole and len(whole) == 12
    for (a, b), d in whole.items():
        near = sorted(min(math.hypot(x - u, y - v) for h, _, u, v in rows if h == b) for g, _, x, y in rows if g == a)[:24]
        assert d == round(sum(near) / 24, 9)


def test_directed_distance_meets_few_pairs(spark):
    """Spots of large groups don't meet all of the other group."""
    rows = [(g, 10_000 * k + i, float(i % 25), float(i // 25 + 0.5 * k)) for k, g in enumerate("ab") for i in range(2500)]
    members = spark.createDataFrame(rows, "group string, spot long, x double, y double")
    d = P.directed_distance(spark.createDataFrame([("a", "b")], "a string, b string"), members, 0.4)
    assert d.first().distance == 0.5
    assert P.ALL_PAIRS < 2500 * 2500
    assert spark.read.parquet(max(Path(spark.conf.get("spark.checkpoint.dir")).glob("found-*"), key=lambda p: p.stat().st_mtime).as_posix()).count() == 2500


def test_ranks_by_ranges(spark):
    """Percentile ranks and row numbers are those of windows, and no window holds a group."""
    rows = [("a" if k % 3 else None, float(k * 7 % 50) if k % 11 else None, k) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, v double, k long")
    got = S.percentile_rank(df, "v", ["g"], "p")
    w = Window.partitionBy("g")
    plain = df.withColumn("p", (F.rank().over(w.orderBy("v")) + (F.count(F.lit(1)).over(Window.partitionBy("g", "v")) - 1) / 2) / F.count(F.lit(1)).over(w))
    assert sorted(got.select("k", "p").collect()) == sorted(plain.select("k", "p").collect())
    n = S.numbered(df, ["g"], [F.col("v"), F.col("k")], "n")
    assert sorted(n.select("k", "n").collect()) == sorted(df.select("k", F.row_number().over(w.orderBy("v", "k")).alias("n")).collect())
    assert "_part" in got._jdf.queryExecution().analyzed().toString()  # windows are over parts of a group


def test_ranks_under_any_names(spark):
    """The columns that ranking and numbering work with are never those of the table or the result."""
    df = spark.createDataFrame([(k % 3, k * 7 % 10, k) for k in range(40)], "_at int, _n int, _part long")
    df = df.withColumns({"__before": F.lit(1), "_k0": F.lit(2), "_row_all": F.lit(3)})
    w = Window.partitionBy("_at")
    for name in ("_at", "_part", "_before", "_own", "_row", "_r"):
        got = S.numbered(df, ["_at"], [F.col("_n"), F.col("_part")], name) if name != "_at" else S.numbered(df.withColumnRenamed("_at", "g"), ["g"], [F.col("_n"), F.col("_part")], name)
        plain = F.row_number().over(w.orderBy("_n", "_part"))
        want = df.withColumn(name, plain) if name != "_at" else df.withColumn("_at_", plain).withColumnRenamed("_at", "g").withColumnRenamed("_at_", "_at")
        assert sorted(got.columns) == sorted(want.columns) and sorted(got.select(*want.columns).collect()) == sorted(want.collect())
    rank = S.percentile_rank(df, "_n", ["_at"], "_r")
    want = df.withColumn("_r", (F.rank().over(w.orderBy("_n")) + (F.count(F.lit(1)).over(Window.partitionBy("_at", "_n")) - 1) / 2) / F.count(F.lit(1)).over(w))
    assert rank.columns == want.columns and sorted(rank.collect()) == sorted(want.collect())


def test_activation_exchanges_cells_only(spark):
    """What cells and programs make is added up where it is made."""
    rng = random.Random(5)
    cells = spark.createDataFrame([(s, f"g{g}", float(rng.randint(1, 9))) for s in range(50) for g in range(12)], "spot long, gene string, value double")
    weights = spark.createDataFrame([(f"p{p}", f"g{g}", 1 / (1 + p + g)) for p in range(6) for g in range(12)], "program string, gene string, weight double")
    a = M.activate(cells, weights)
    want = {}
    for c in cells.collect():
        for w in weights.collect():
            if c.gene == w.gene:
                want[w.program, c.spot] = want.get((w.program, c.spot), 0) + c.value * w.weight
    assert {(r.program, r.spot): round(r.activation, 9) for r in a.collect()} == {k: round(v, 9) for k, v in want.items()}
    assert a._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1  # before it was two
    assert {r.program for r in M.thresholds(a).collect()} == {f"p{p}" for p in range(6)}


def test_least_squares_leave_out_rows_that_rest():
    """Rows are solved as each by itself, however many come together."""
    rng = np.random.default_rng(7)
    h = np.abs(rng.normal(size=(6, 30))) * (rng.random((6, 30)) < 0.5)
    x = np.abs(rng.normal(size=(300, 6))) @ h + 0.1 * rng.random((300, 30))
    g, a = x @ h.T, h @ h.T
    w = L.nonnegative(g, a)
    slope = w @ a - g
    assert (w >= 0).all() and (slope > -1e-6).all() and np.abs(w * slope).max() < 1e-6
    assert np.abs(w - np.concatenate([L.nonnegative(g[k : k + 1], a) for k in range(300)])).max() < 1e-7


def test_scores_exchange_no_names(spark):
    """A neighbour's cells travel once, as arrays of numbers: nothing is exchanged by spot and gene, and scores are as before."""
    rng = random.Random(8)
    cells = [(k, f"g{g}", float(rng.randint(1, 5))) for k in range(12) for g in rng.sample(range(9), 4)]
    ways = [(k, (k + d) % 13) for k in range(13) for d in (1, 2, 5)]  # spot 12 has no cells
    scored = G.scores(spark.createDataFrame(cells, "spot long, gene string, value double"), spark.createDataFrame(ways, "spot long, other long"), 13, 9)
    assert not re.search(r"hashpartitioning\(spot#\d+L?, gene", scored._jdf.queryExecution().executedPlan().toString())
    value = {(k, g): v for k, g, v in cells}
    dense = {k: [value.get((k, f"g{g}"), 0.0) for g in range(9)] for k in range(13)}
    logs = {k: [math.log(sum(y < x for y in row) + (sum(y == x for y in row) + 1) / 2) for x in row] for k, row in dense.items()}
    want = {}
    for k in range(13):
        near = [o for s, o in ways if s == k]
        for g in range(9):
            have, overall = sum(dense[o][g] > 0 for o in near) / 3, sum(dense[o][g] > 0 for o in range(13)) / 13
            if have:
                raw = (sum(logs[o][g] for o in near) / 3 - sum(logs[o][g] for o in range(13)) / 13) / math.log(2) * min(1, have / overall)
                want[k, f"g{g}"] = round(2 ** max(raw, 0) - 1, 9)
    assert {(r.spot, r.gene): round(r.score, 9) for r in scored.collect()} == want
