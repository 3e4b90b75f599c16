"""The bounded similarity join against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators import profiles as C
from tessera.plans import cohort

SCHEMA = "sample string, object string, component array<double>, role array<double>, confidence double, block int"


def plain(rows, top):
    like = lambda a, b: round(max(0.0, min(1.0, 1 - sum(abs(x - y) for x, y in zip(a, b)) / len(a))), 9) if a else 0.0
    by_a, by_b = {}, {}
    for a in rows:
        for b in rows:
            if a[0] != b[0]:
                c, r = like(a[2], b[2]), like(a[3], b[3])
                s = round(max(0.0, min(1.0, (0.65 * c + 0.35 * r) * math.sqrt(a[4] * b[4]))), 9)
                by_a.setdefault(a[:2], []).append((-s, -c, -r, *b[:2]))
                by_b.setdefault(b[:2], []).append((-s, -c, -r, *a[:2]))
    rank_b = {(k, x[3:]): n + 1 for k, found in by_b.items() for n, x in enumerate(sorted(found))}
    return {(*k, *x[3:]): (round(-x[0], 7), n + 1, rank_b[x[3:], k]) for k, found in by_a.items() for n, x in enumerate(sorted(found)[:top])}


@pytest.mark.parametrize("components, roles, n, top", [(3, 2, 300, 3), (1, 4, 90, 5), (2, 0, 60, 1)])
def test_comparable(spark, components, roles, n, top):
    rng = random.Random(n)
    rows = [(f"s{rng.randrange(4)}", f"o{k}", [rng.randrange(8) / 7 for _ in range(components)], [rng.randrange(5) / 4 for _ in range(roles)], rng.choice([0.0, 0.2, 0.5, 0.9, 1.0])) for k in range(n)]
    rows += [("s0", f"copy{k}", *rows[0][2:]) for k in range(30)]
    looks = []
    got = C.comparable(spark.createDataFrame([(*x, 7) for x in rows], SCHEMA), top, looks=looks).collect()
    assert {(r.sample_a, r.object_a, r.sample_b, r.object_b): (round(r.similarity, 7), r.rank_a, r.rank_b) for r in got} == plain(rows, top)
    assert looks[1] == len(rows) ** 2 and looks[0] == sum(looks[2:])


def test_comparable_of_few(spark):
    one = [("a", "x", [0.5], [0.5], 1.0, 0), ("a", "y", [0.5], [0.5], 1.0, 0)]
    assert C.comparable(spark.createDataFrame(one, SCHEMA), 3).count() == 0  # no other sample
    assert C.comparable(spark.createDataFrame([], SCHEMA), 3).count() == 0
    two = C.comparable(spark.createDataFrame([*one, ("b", "z", [0.5], [0.5], 1.0, 0)], SCHEMA), 3).collect()
    assert {(r.object_a, r.object_b, r.rank_a, r.rank_b) for r in two} == {("x", "z", 1, 1), ("y", "z", 1, 2), ("z", "x", 1, 1), ("z", "y", 2, 1)}


def test_few_pairs_are_met(spark):
    """Of the profiles of the tables less than a quarter of all pairs; a ninth of all stands before some kept pair in its order."""
    looks = []
    C.comparable(cohort._profiles(spark, "/root/testdata/sf0.1"), 3, looks=looks).count()
    assert looks[0] < 0.25 * looks[1]


def test_comparable_in_small_pieces(spark, monkeypatch):
    """Pairs are counted in blocks and never rows: sides, hubs and cells of any size give the same, also with nulls in arrays."""
    for name, size in (("SIDE", 40), ("HUBS", 7), ("CELLS", 64)):
        monkeypatch.setattr(C, name, size)
    rng = random.Random(5)
    rows = [(f"s{rng.randrange(3)}", f"o{k}", [rng.randrange(4) / 3, rng.randrange(8) / 7], [rng.randrange(3) / 2], rng.choice([0.3, 0.5, 1.0])) for k in range(150)]
    got = C.comparable(spark.createDataFrame([(*x, 7) for x in rows], SCHEMA), 3).collect()
    assert {(r.sample_a, r.object_a, r.sample_b, r.object_b): (round(r.similarity, 7), r.rank_a, r.rank_b) for r in got} == plain(rows, 3)
    odd = [("a", "x", [0.5, 0.5], [0.5], 1.0, 0), ("b", "y", [0.5, None], [0.5], 1.0, 0), ("b", "z", [0.1, 0.9], [None], 1.0, 0), ("b", "w", [0.4, 0.5], [0.5], None, 0)]
    got = {(r.object_a, r.object_b): (r.component_similarity, r.role_similarity) for r in C.comparable(spark.createDataFrame(odd, SCHEMA), 3).collect()}
    a, b = (spark.createDataFrame(odd, SCHEMA).select(*[F.col(c).alias(f"{c}_{k}") for c in ("sample", "object", "component", "role", "confidence")]) for k in "ab")
    both = a.join(b, F.col("sample_a") != F.col("sample_b")).where("confidence_a IS NOT NULL AND confidence_b IS NOT NULL")
    like = both.select("object_a", "object_b", *[F.round(X.l1_similarity(f"{c}_a", f"{c}_b"), 9).alias(c) for c in ("component", "role")])
    assert got == {(r.object_a, r.object_b): (r.component, r.role) for r in like.collect()}


def test_nine_digits_as_spark(spark):
    x = [0.0, 1.0, 0.1234567895, 0.1234567885, 0.0009765625, 0.00000000049999, 1 / 3, 2 / 7, 0.9999999995, 0.5 - 2**-54]
    want = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, x double").orderBy("k").select(F.round("x", 9)).collect()]
    assert C._nine(np.array(x)).tolist() == want
