"""The boundary of alpha complexes against all triangles with an empty circle."""

import numpy as np
import pytest

from tessera.operators import domains as D


def plain(points, radius):
    """Edges of just one triangle whose circle is empty and smaller than the radius."""
    n, used = len(points), {}
    for i in range(n):
        for j in range(i):
            for k in range(j):
                a, b, c = points[i], points[j], points[k]
                d = 2 * ((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
                if abs(d) < 1e-12:
                    continue
                p, q = b - a, c - a
                o = a + np.array([q[1] * (p @ p) - p[1] * (q @ q), p[0] * (q @ q) - q[0] * (p @ p)]) / d
                r2 = ((o - a) ** 2).sum()
                if r2 < radius**2 and (((points - o) ** 2).sum(1) > r2 * (1 - 1e-9)).all():
                    for e in ((i, j), (i, k), (j, k)):
                        used[tuple(sorted(e))] = used.get(tuple(sorted(e)), 0) + 1
    return {e for e, m in used.items() if m == 1}


@pytest.mark.parametrize("radius", [0.5, 1.1, 4.0])
def test_alpha_boundary(spark, radius):
    rng = np.random.default_rng(1)
    groups = {"a": rng.random((45, 2)) * 5, "b": rng.normal(size=(30, 2)), "c": rng.random((2, 2)), "d": np.array([[0.0, 0], [1, 0], [2, 0]])}
    rows = [(g, k, float(x), float(y)) for g, p in groups.items() for k, (x, y) in enumerate(p)]
    got = {(r.domain, r.u, r.v) for r in D.alpha_boundary(spark.createDataFrame(rows, "domain string, spot long, x double, y double"), radius).collect()}
    assert got == {(g, *e) for g, p in groups.items() for e in plain(p, radius)} and got


def test_alpha_boundary_of_a_lattice(spark):
    """A square of spots with a hole has the sides of both as its boundary."""
    at = [(x, y) for x in range(7) for y in range(7) if not (x == 3 and y == 3)]
    rows = [("d", k, float(x), float(y)) for k, (x, y) in enumerate(at)]
    got = {tuple(sorted((at[r.u], at[r.v]))) for r in D.alpha_boundary(spark.createDataFrame(rows, "domain string, spot long, x double, y double"), 0.9).collect()}
    outer = {tuple(sorted(((a, s), (a + 1, s)))) for a in range(6) for s in (0, 6)} | {tuple(sorted(((s, a), (s, a + 1)))) for a in range(6) for s in (0, 6)}
    hole = {tuple(sorted(e)) for e in (((2, 3), (3, 2)), ((3, 2), (4, 3)), ((4, 3), (3, 4)), ((3, 4), (2, 3)))}
    assert got == outer | hole
