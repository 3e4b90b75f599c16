"""Centroid clustering of whole-numbered vectors with grouped lower bounds."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, small_batches, stored

CENTROIDS, ROUNDS, DIMENSION, SCALE, SEED = 40, 5, 64, 256, 2
#: Centroids of a group in the mean.
GROUP = 10
#: Up to this size of components, products of vectors of up to 128 of them are exact in doubles. A vector with larger ones is held as text.
SMALL = 1 << 22
#: Bounds are doubles and are moved by this share of themselves (and by it) to the safe side, so rounding can never skip a centroid.
SLACK = 1e-9
_STATE = "vec_id long, v binary, cluster int, upper double, lower binary, distance string, limb int, n long, sums array<long>, looked long"


def _packed(x: np.ndarray) -> bytes:
    """Small vectors as 32-bit integers, others as decimal text."""
    return x.astype("<i4").tobytes() if max(map(abs, x.tolist()), default=0) <= SMALL else ",".join(map(str, x.tolist())).encode() + b","


def _whole(x: float, scale: int) -> int:
    """floor(scale * x) without loss, however large."""
    y = scale * x
    return math.floor(y) if math.isfinite(y) else scale * int(x)


def _prepare(dimension: int, scale: int):
    """(vec_id, v): vectors of the right length without null or non-finite components, as whole numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for vec_id, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not x.is_valid or len(x.values) != dimension or x.values.null_count:
                    continue
                x = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    y = np.floor(x * scale) if np.abs(x).max(initial=0) * scale <= SMALL else np.array([_whole(c, scale) for c in x.tolist()], object)
                    ids.append(vec_id)
                    out.append(_packed(y))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return run


def _vectors(column: list[bytes], dimension: int) -> tuple[np.ndarray, bool]:
    """A matrix of doubles that hold whole numbers, or of Python integers if some vector is large; and whether it is the former."""
    if all(x[-1:] != b"," for x in column):
        return np.frombuffer(b"".join(column), "<i4").reshape(len(column), dimension).astype(np.float64), True
    return np.array([_numbers(x) for x in column], object).reshape(len(column), dimension), False


def _numbers(x: bytes) -> list[int]:
    """The components of a packed vector. Text ends with a comma; the last byte of a small 32-bit integer is 0 or 255."""
    return list(map(int, x[:-1].split(b","))) if x[-1:] == b"," else np.frombuffer(x, "<i4").tolist()


@dataclass
class Centroids:
    """Centroids as exact integers, the group of each, and how far each group and centroid moved last."""

    points: list[list[int]]
    group: np.ndarray
    moved: np.ndarray

    @classmethod
    def start(cls, points: list[list[int]], size: int = GROUP) -> Centroids:
        """Groups of centroids that lie near each other, made once by a few rounds of clustering the centroids themselves."""
        most = max(1, *(abs(c) for p in points for c in p))
        x = np.array([[c / most for c in p] for p in points])
        k = max(1, -(-len(points) // size))
        centre, group = x[:: max(1, len(x) // k)][:k].copy(), np.zeros(len(x), np.int64)
        for _ in range(5):
            group = ((x[:, None] - centre[None]) ** 2).sum(-1).argmin(1)
            for g in np.unique(group):
                centre[g] = x[group == g].mean(0)
        _, group = np.unique(group, return_inverse=True)
        return cls(points, group, np.zeros(len(points)))

    def after(self, points: list[list[int]]) -> Centroids:
        far = [math.sqrt(min(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), 1 << 1000)) for p, q in zip(self.points, points, strict=True)]
        return Centroids(points, self.group, np.array(far) * (1 + SLACK))

    def small(self) -> bool:
        return all(abs(c) <= SMALL for p in self.points for c in p)


def _squares(x: np.ndarray, rows: np.ndarray, c: np.ndarray, exact: bool) -> np.ndarray:
    """Exact squared distances of some rows from all of c: by products of doubles where these are exact."""
    x = x[rows]
    if exact:
        return (x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)[None]
    return np.array([[sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for q in c] for p in x.tolist()], object).reshape(len(x), len(c))


def _root(squares: np.ndarray) -> np.ndarray:
    """Square roots as doubles; what has no double is infinite, which as an upper bound rules out nothing."""
    return np.sqrt(squares.astype(np.float64)) if squares.dtype != object else np.array([math.sqrt(min(s, 1 << 1000)) if s < 1 << 1000 else math.inf for s in squares.ravel()], np.float64).reshape(squares.shape)


def assign(x: np.ndarray, exact: bool, old: np.ndarray, upper: np.ndarray, lower: np.ndarray, to: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """One round over some vectors: cluster, upper bound, lower bounds by group, and how many distances were worked out.

    upper is at least the distance from the centroid of old, lower at most that from the nearest other centroid of each
    group, both before the centroids moved. A vector whose upper bound lies below all lower bounds keeps its cluster
    (global filter); for the others the distance from their own centroid is worked out, and those groups whose lower bound
    is not above it are scanned whole (group filter). old is -1 at first: all groups are scanned.
    """
    groups = to.group.max() + 1
    points = np.array(to.points, np.float64 if exact else object).reshape(len(to.points), -1)
    fresh = old < 0
    drift = np.array([to.moved[to.group == g].max() for g in range(groups)])
    upper = np.where(fresh, np.inf, (upper + to.moved[np.maximum(old, 0)]) * (1 + SLACK) + SLACK)
    size = np.where(np.isfinite(lower), np.abs(lower), 0)
    lower = np.where(fresh[:, None], -np.inf, lower - drift[None] - (size + drift[None]) * SLACK - SLACK)
    cluster, looked = old.copy(), 0
    row = np.flatnonzero(lower.min(axis=1) <= upper)
    if not len(row):
        return cluster, upper, lower, looked
    best = np.full(len(row), None, object) if not exact else np.full(len(row), np.inf)
    seen = ~fresh[row]
    for c in np.unique(old[row][seen]):  # exact distance from the own centroid
        at = np.flatnonzero(old[row] == c)
        best[at] = _squares(x, row[at], points[c : c + 1], exact)[:, 0]
        looked += len(at)
    own = np.full(len(row), np.inf)
    own[seen] = _root(best[seen])
    upper[row] = own * (1 + SLACK) + SLACK
    mine = old[row].copy()
    scan = lower[row] <= upper[row][:, None]
    scan[~seen] = True
    for g in range(groups):
        at = np.flatnonzero(scan[:, g])
        if not len(at):
            continue
        members = np.flatnonzero(to.group == g)
        d = _squares(x, row[at], points[members], exact)
        looked += d.size
        where = d.argmin(axis=1) if exact else np.array([min(range(len(members)), key=lambda j, r=r: (r[j], j)) for r in d], np.int64)
        least, name = d[np.arange(len(at)), where], members[where]
        had = best[at]
        if exact:
            better = (least < had) | ((least == had) & (name < mine[at]))
        else:
            better = np.array([h is None or s < h or (s == h and m < o) for s, h, m, o in zip(least, had, name.tolist(), mine[at].tolist(), strict=True)], bool)
        # what lies nearest in this group besides the winner, who stands for the time being outside
        roots = _root(d)
        roots[np.arange(len(at)), where] = np.where(better, np.inf, roots[np.arange(len(at)), where])
        held = to.group[np.maximum(mine[at], 0)] == g
        inside = np.flatnonzero(held & (mine[at] >= 0) & ~better)  # the winner so far is of this group: not one of the others
        if len(inside):
            roots[inside, np.searchsorted(members, mine[at][inside])] = np.inf
        lower[row[at], g] = roots.min(axis=1) * (1 - SLACK) - SLACK
        # the loser of this change was outside and is now one of the others in its own group
        lost = np.flatnonzero(better & (mine[at] >= 0))
        gone = mine[at][lost]
        r, h = row[at][lost], to.group[gone]
        lower[r, h] = np.minimum(lower[r, h], _root(np.asarray(had[lost])) * (1 - SLACK) - SLACK)
        best[at[better]], mine[at[better]] = least[better], name[better]
    cluster[row] = mine
    upper[row] = _root(best) * (1 + SLACK) + SLACK
    return cluster, upper, lower, looked


def _limbs(total: np.ndarray) -> list[list[int]]:
    """Whole numbers as longs; where one is too large, all are cut into limbs of 32 bits, the last with the sign."""
    limbs = 1 if all(-1 << 63 <= t < 1 << 63 for t in total) else max(-(-(abs(t).bit_length() + 1) // 32) for t in total)
    return [[t >> 32 * k & 0xFFFFFFFF if k < limbs - 1 else t >> 32 * k for t in total] for k in range(limbs)]


def _round(to: Centroids, dimension: int, last: bool):
    """Assigns vectors and gives them out with their new bounds; at the end, one row a cluster and limb with the task's sums."""
    groups = int(to.group.max()) + 1
    small = to.small()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, many, evaluated = {}, {}, 0
        for batch in batches:
            n, raw = batch.num_rows, batch.column(1).to_pylist()
            if not n:
                continue
            x, exact = _vectors(raw, dimension)
            if exact and not small:
                x, exact = np.array([_numbers(r) for r in raw], object).reshape(n, dimension), False
            old, upper = np.array(batch.column(2).to_pylist(), np.int64), np.array(batch.column(3).to_pylist(), np.float64)
            lower = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float64).reshape(n, groups) if old[0] >= 0 else np.zeros((n, groups))
            cluster, upper, lower, looked = assign(x, exact, old, upper, lower, to)
            evaluated += looked
            distance = none = [None] * n
            if last:
                points = np.array(to.points, np.float64 if exact else object).reshape(len(to.points), -1)
                if exact:
                    distance = [str(int(s)) for s in ((x - points[cluster]) ** 2).sum(axis=1)]
                else:
                    distance = [str(sum((a - b) ** 2 for a, b in zip(p, q, strict=True))) for p, q in zip(x.tolist(), points[cluster].tolist(), strict=True)]
            else:
                for c in np.unique(cluster).tolist():
                    own = x[cluster == c]
                    part = own.sum(axis=0).astype(np.int64).astype(object) if exact else own.sum(axis=0)
                    total[c], many[c] = total.get(c, 0) + part, many.get(c, 0) + len(own)
            yield _table(batch.column(0).to_pylist(), raw, cluster.tolist(), upper.tolist(), [r.tobytes() for r in lower], distance, none, none, none, none)
        sums = [(c, k, many[c] if k == 0 else 0, part) for c in total for k, part in enumerate(_limbs(total[c].tolist()))]
        none = [None] * (len(sums) + 1)
        yield _table(none, none, [s[0] for s in sums] + [None], none, none, none, *([s[k] for s in sums] + [None] for k in (1, 2, 3)), [*none[1:], evaluated])

    return run


def _table(*columns: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.float64(), pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
    names = [c.split()[0] for c in _STATE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)


def _moved(state: DataFrame, points: list[list[int]]) -> list[list[int]]:
    """Floors of the means by component; a centroid without vectors stays. What comes to the driver is as long as the centroids."""
    tally = state.where("sums IS NOT NULL").select("cluster", "limb", "n", F.posexplode("sums").alias("at", "s"))
    rows = tally.groupBy("cluster", "limb", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
    total, many = {}, {}
    for r in rows:
        total[r.cluster, r.at] = total.get((r.cluster, r.at), 0) + (int(r.s) << 32 * r.limb)
        if r.limb == 0:
            many[r.cluster] = r.n
    return [[total[c, at] // many[c] for at in range(len(p))] if c in many else p for c, p in enumerate(points)]


def cluster(embeddings: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = SEED, size: int = GROUP, looks: list[int] | None = None) -> DataFrame:
    """For each vector that is kept: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256.

    Kept are rows of embeddings (vec_id, embedding) with exactly dimension components, none null or non-finite; component
    x counts as floor(scale * x). The first centroids are the vectors with the least SHA-256 of seed:vec_id (of equal ones
    the least vector), fewer if there are fewer rows. A round assigns each vector to the nearest centroid (of equal ones
    the first) and moves each centroid that has vectors to the floor of their mean. All of it is exact, in whole numbers of
    any size; a distance or sum that no long can hold is null. Repeated rows are vectors of their own, a null id counts as
    an empty one, an empty table gives an empty one, and other columns have no part.

    Method: centroids are put into groups once. Each vector carries an upper bound of the distance from its centroid and
    one lower bound a group; bounds move as far as centroids did. See assign() for the two filters. The vectors with their
    bounds are one table a round in the shared folder, the one before is deleted; sums of the new clusters are rows of the
    same table, so a round reads vectors once and exchanges centroids' sums only. looks gets the number of distances that each
    round worked out, if given.
    """
    small_batches(embeddings.sparkSession)
    base = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    state = stored(base.mapInArrow(_prepare(dimension, scale), "vec_id long, v binary"), "vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = [_numbers(bytes(r.v)) for r in state.orderBy(name, "v").limit(centroids).collect()]
    if not first:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    to = Centroids.start(first, size)
    base, state = state, state.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(b"").alias("lower"))
    for k in range(rounds + 1):
        made = stored(state.mapInArrow(_round(to, dimension, k == rounds), _STATE), "bounds")
        discard(base)
        if looks is not None:
            looks.append(made.agg(F.sum("looked")).first()[0] or 0)
        base, state = made, made.where("v IS NOT NULL").select("vec_id", "v", "cluster", "upper", "lower")
        if k < rounds:
            to = to.after(_moved(made, to.points))
    final = made.where("v IS NOT NULL").select("vec_id", "cluster", F.col("distance").try_cast("decimal(38,0)").alias("distance"))
    parts = {r.cluster: r for r in final.groupBy("cluster").agg(F.sum("distance").alias("s"), F.count(F.lit(1)).alias("n"), F.count("distance").alias("known")).collect()}
    fits = lambda x: int(x) if x is not None and x < 1 << 63 else None
    total = {c: r.s if r.known == r.n else None for c, r in parts.items()}
    every = None if None in total.values() else sum(total.values())
    rows = [(c, fits(total.get(c, 0)), hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for c, p in enumerate(to.points)]
    told = embeddings.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    out = final.join(F.broadcast(told), "cluster")
    return out.select("vec_id", "cluster", F.col("distance").try_cast("long").alias("distance"), "cluster_inertia", F.lit(fits(every)).cast("long").alias("inertia"), "centroid_sha256")


def oracle_sql(centroids: int = CENTROIDS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = SEED) -> str:
    """The rounds written out one after the other, every vector against every centroid."""
    square = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    nearest = "n{k} AS MATERIALIZED (SELECT v.r, arg_min(c.c, (" + square + ", c.c)) AS c, min(" + square + ") AS d FROM v, c{k} AS c GROUP BY v.r)"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS HUGEINT)) AS x FROM embeddings"
        f" WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS INTEGER) AS c, x FROM v ORDER BY c LIMIT {centroids})",
    ]
    for k in range(rounds):
        parts.append(nearest.format(k=k))
        parts.append(f"s{k} AS (SELECT c, i, CAST(floor(sum(x[i]) / count(*)) AS HUGEINT) AS m FROM n{k} JOIN v USING (r), range(1, {dimension + 1}) AS t(i) GROUP BY c, i)")
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c, coalesce(any_value(m.x), any_value(o.x)) AS x FROM c{k} AS o LEFT JOIN (SELECT c, list(m ORDER BY i) AS x FROM s{k} GROUP BY c) AS m USING (c) GROUP BY c)")
    parts.append(nearest.format(k=rounds))
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256 FROM n{rounds} JOIN v USING (r) JOIN c{rounds} AS k USING (c)"
    )
