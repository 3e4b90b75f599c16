"""Assignments and linkage against trying everything."""

import time
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import annotate, atlas, graph


@pytest.mark.parametrize("k", range(1, 8))
def test_assignment_is_the_first_of_the_best(k):
    rng = np.random.default_rng(k)
    for most in (2, 5, 1000):
        for _ in range(12):
            gain = rng.integers(0, most, (k, k))
            want = max(permutations(range(k)), key=lambda to: (sum(gain[b, a] for b, a in enumerate(to)), [-a for a in to]))
            assert atlas.assignment(gain) == list(want)


def test_assignment_of_many():
    """A permutation hidden in noise, and no swap of two rows gains."""
    rng = np.random.default_rng(3)
    gain = rng.integers(0, 50, (200, 200))
    to = np.array(atlas.assignment(gain))
    assert sorted(to) == list(range(200))
    now = gain[np.arange(200), to]
    swapped = gain[:, to]
    assert (swapped + swapped.T <= now[:, None] + now[None]).all()
    hidden = rng.permutation(200)
    gain[np.arange(200), hidden] += 100
    assert atlas.assignment(gain) == hidden.tolist()


def plain_linkage(sim, least):
    groups = [[k] for k in range(len(sim))]
    while len(groups) > 1:
        best, a, b = max((sim[np.ix_(x, y)].mean(), -i, -j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        if best < least:
            break
        groups[-a] += groups.pop(-b)
    return {k: min(x) for x in groups for k in x}


@pytest.mark.parametrize("n, least", [(1, 0.5), (2, 0.4), (30, 0.45), (45, 0.5), (45, 0.9), (45, 0.0)])
def test_linkage(n, least):
    rng = np.random.default_rng(n)
    centre = rng.integers(0, 6, n)
    s = rng.random((n, n)) * 0.5 + 0.5 * (centre[:, None] == centre[None])
    s = (s + s.T) / 2
    assert dict(enumerate(annotate.linkage(s, least))) == plain_linkage(s, least)


def test_linkage_of_many():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 40, 2000)
    s = rng.random((2000, 2000)) * 0.2 + 0.8 * (centre[:, None] == centre[None])
    begun = time.time()
    root = np.array(annotate.linkage((s + s.T) / 2, 0.6))
    assert time.time() - begun < 10 and all(len(set(root[centre == c])) == 1 for c in range(40)) and len(set(root)) == 40


@pytest.mark.parametrize("here", [250_000, 60, 0])
@pytest.mark.parametrize("names", [False, True])
def test_components_of_groups(spark, here, names):
    """Groups whose edges one task joins, groups that go by rounds, spots without edges, and edges to no node."""
    rng = np.random.default_rng(2)
    name = (lambda k: f"d{k:04d}") if names else int
    kind = "string" if names else "long"
    nodes = [(g, name(k)) for g in "abc" for k in range(120)]
    edges = [("a", int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [("b", k, k + 1) for k in range(0, 100)] + [("c", 3, 900), ("c", 900, 5), ("c", 1, 2)]
    both = [(g, name(x), name(y)) for g, a, b in edges for x, y in ((a, b), (b, a)) if a != b]
    frame = spark.createDataFrame(both, f"g string, u {kind}, v {kind}")
    got = {(r.g, r.spot): r.component for r in graph.components(spark.createDataFrame(nodes, f"g string, spot {kind}"), frame, here).collect()}
    want = {x: x[1] for x in nodes}
    moved = True
    while moved:
        moved = False
        for g, a, b in both:
            if (g, a) in want and (g, b) in want and want[g, a] > want[g, b]:
                want[g, a], moved = want[g, b], True
    assert got == want
    one = {r.spot: r.component for r in graph.components(spark.createDataFrame([(x[1],) for x in nodes if x[0] == "a"], f"spot {kind}"), frame.where("g = 'a'").drop("g"), here).collect()}
    assert one == {k: c for (g, k), c in want.items() if g == "a"}


@pytest.mark.parametrize("n, items, least", [(60, 12, 0.6), (90, 30, 0.35), (40, 3, 1.0)])
def test_linked_terms(spark, n, items, least):
    """Only terms that are alike meet, and the groups are those of all pairs, ties by the first names."""
    rng = np.random.default_rng(n)
    sets = {(f"s{k % 2}", f"t{k}"): {int(x) for x in rng.choice(items, rng.integers(1, 7 if items > 3 else 4))} | {100 + k // 5} for k in range(n)}
    rows = spark.createDataFrame([(*key, x) for key, v in sets.items() for x in v], "source string, term string, item long")
    got = {(r.source, r.term): r.group for r in annotate.linked(rows, least).collect()}
    whole, alike = {}, {}
    for source in ("s0", "s1"):
        names = sorted(t for s, t in sets if s == source)
        like = lambda a, b, s=source: round(round(len(sets[s, a] & sets[s, b]) / len(sets[s, a] | sets[s, b]) * 1e9))
        sim = np.array([[like(a, b) for b in names] for a in names], dtype=np.float64)
        whole |= {(source, names[k]): names[x] for k, x in plain_linkage(sim, round(least * 1e9)).items()}
        alike |= {(source, a, b): like(a, b) for a in names for b in names if a < b and like(a, b) >= round(least * 1e9)}
    assert got == whole and len(set(got.values())) < n
    members = rows.groupBy("source", "term").agg(F.sort_array(F.collect_list("item")).alias("items")).withColumn("group", F.col("term"))
    assert {(r.source, r.a, r.b): r.total for r in annotate.alike(members, least).collect()} == alike


def test_linked_terms_of_a_deep_tree_stay_few_pairs(spark):
    """Terms of one tree share its root, so all of them met; no pair below the cut is made now."""
    up = spark.createDataFrame([(k, k // 3) for k in range(1, 400)], "term long, parent long")
    sets = annotate.ancestors(up).select(F.lit("s").alias("source"), F.col("term").cast("string").alias("term"), F.col("ancestor").alias("item"))
    members = sets.groupBy("source", "term").agg(F.sort_array(F.collect_list("item"), False).alias("items")).withColumn("group", F.col("term"))
    assert 0 < annotate.alike(members, 0.6).count() < 400 * 399 // 2 // 20
