"""Exact nearest neighbours by cosine in many dimensions, and graphs that unite them with neighbours in the plane."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.functions import stats as S
from tessera.operators import spatial
from tessera.operators.graph import stored

#: Pivots at most: that many vectors come to the driver and go to every task.
PIVOTS = 512
#: Distinct vectors of a block at least and at most, in the mean; a larger table has larger blocks, as a vector goes once to each.
BLOCK, LARGE = 1024, 16_384
#: Pivots that each cell knows the least and largest angle of its vectors to, besides its own.
ANGLES = 16
#: Similarities count to so many digits, so equal vectors tie and ties go by spot; what rounding can hide is below SLACK.
DIGITS, SLACK = 9, 4e-9


def _units(frames):
    """(by..., spot, key, u) of vectors that have a direction: their unit vectors' bytes, and a digest of them."""
    for f in frames:
        vec = [None if v is None else np.asarray(v, np.float64) for v in f["vec"]]
        fine = [v is not None and len(v) > 0 and bool(np.isfinite(v).all() and v.any()) for v in vec]
        f, vec = f[fine].drop(columns="vec"), [v for v, ok in zip(vec, fine, strict=True) if ok]
        u = [(y := np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))) / np.linalg.norm(y) + 0.0 for v in vec]
        yield f.assign(key=[hashlib.md5(x.tobytes()).digest() for x in u], u=[x.tobytes() for x in u])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _angles(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ pivots.T, -1, 1))


def _located(pivots: np.ndarray):
    """Adds the nearest pivot as cell, the angle to it, and those to the first ANGLES pivots."""
    def run(frames):
        for f in (x for x in frames if len(x)):
            a = _angles(_matrix(f["u"]), pivots)
            cell = a.argmin(axis=1)
            yield f.assign(cell=cell.astype(np.int32), angles=np.column_stack([a[np.arange(len(f)), cell], a[:, :ANGLES]]).tolist())

    return run


def _most(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest cosine that a vector at angles a from pivots can have with one at angles low to high from them."""
    return np.cos(np.maximum(0, np.maximum(a - high, low - a) - 1e-9))


class _Shape:
    """The cells of one sample: least and largest angle to their own pivot and the first ones, spots and vectors; and blocks of
    them. Cells stand in one block until it is full; one with more vectors than a block is dealt over several by hash."""

    def __init__(self, rows: list, size: int):
        self.cell, self.low, self.high = np.array([r.cell for r in rows]), np.array([r.low for r in rows], np.float64), np.array([r.high for r in rows], np.float64)
        self.many, self.n = np.array([r.many for r in rows], np.float64), np.array([r.n for r in rows], np.int64)
        self.block, self.parts, last, held = np.zeros(len(rows), np.int64), np.maximum(1, -(-self.n // size)), -1, size
        for k, n in enumerate(self.n):
            if held + n > size:
                last, held = last + 1, 0
            self.block[k], held = last, held + n
            last += int(self.parts[k]) - 1
        self.at = {int(c): k for k, c in enumerate(self.cell)}
        self.sides = max(1, -(-int(self.n.sum()) // size))

    def most(self, a: np.ndarray) -> np.ndarray:
        """The largest cosine that vectors at angles a from all pivots can have with one of each cell."""
        most = _most(a[:, self.cell], self.low[:, 0], self.high[:, 0])
        for k in range(self.low.shape[1] - 1):
            most = np.minimum(most, _most(a[:, k, None], self.low[:, k + 1], self.high[:, k + 1]))
        return most


def _dealt(key: bytes, n: int, salt: int) -> int:
    return int.from_bytes(key[salt : salt + 6], "little") % n


def _keys(f: pd.DataFrame, by: list[str]) -> list[tuple]:
    return list(zip(*(f[c] for c in by), strict=True)) if by else [()] * len(f)


def _asking(pivots: np.ndarray, shape: dict, by: list[str], wanted: int, later: bool):
    """(by..., key, u, least, block, side, cells, pairs): the cells each vector searches, by the blocks that hold them, and how many
    vectors those cells have. At first the cells that come nearest, until they hold wanted spots; later all others whose nearest
    possible vector is as near as the least similarity found so far."""
    def run(frames):
        for f in (frame.iloc[k : k + 256] for frame in frames for k in range(0, len(frame), 256)):
            rows, blocks, sides, cells, pairs = [], [], [], [], []
            a, keys = _angles(_matrix(f["u"]), pivots), _keys(f, by)
            least = f["least"].to_numpy(np.float64) if later else np.full(len(f), -2.0)
            names = f["key"].tolist()
            for key in set(keys):
                s, mine = shape[key], [k for k, x in enumerate(keys) if x == key]
                for k, most in zip(mine, s.most(a[mine]), strict=True):
                    order = np.argsort(-most, kind="stable")
                    first = int(np.searchsorted(np.cumsum(s.many[order]), wanted)) + 1
                    own = order[first:][most[order[first:]] >= least[k] - SLACK] if later else order[:first]
                    held: dict = {}
                    for c in own.tolist():
                        for part in range(int(s.parts[c])):
                            held.setdefault(int(s.block[c]) + part, []).append(c)
                    for block, some in held.items():
                        rows.append(k)
                        blocks.append(block)
                        sides.append(_dealt(names[k], s.sides, 0))
                        cells.append(s.cell[some].tolist())
                        pairs.append(int(sum(s.n[c] for c in some if s.block[c] == block)))
            if rows:
                yield f.iloc[rows][[*by, "key", "u"]].assign(least=least[rows], block=np.array(blocks, np.int32), side=np.array(sides, np.int32), cells=cells, pairs=np.array(pairs, np.int64))

    return run


def _asked(shape: dict, by: list[str]):
    """(by..., cell, u, ids, block, side): each vector in its block, for every side of those that search."""
    def run(frames):
        for f in (frame.iloc[k : k + 256] for frame in frames for k in range(0, len(frame), 256)):
            rows, blocks, sides = [], [], []
            for k, (key, name, cell) in enumerate(zip(_keys(f, by), f["key"], f["cell"], strict=True)):
                s = shape[key]
                at = s.at[cell]
                rows += [k] * s.sides
                blocks += [int(s.block[at]) + _dealt(name, int(s.parts[at]), 8)] * s.sides
                sides += range(s.sides)
            yield f.iloc[rows][[*by, "cell", "u", "ids"]].assign(block=np.array(blocks, np.int32), side=np.array(sides, np.int32))

    return run


def _best(q: pd.DataFrame, p: pd.DataFrame, wanted: int) -> pd.DataFrame:
    """The wanted best (similarity, spot) of each query among those of a block's cells it searches, that reach its least similarity."""
    found: list[tuple] = []
    if len(q) and len(p):
        p = p.iloc[np.argsort(p["cell"].to_numpy(), kind="stable")]
        u, v, cells = _matrix(q["u"]), _matrix(p["u"]), p["cell"].to_numpy()
        first, least = np.array([x[0] for x in p["ids"]]), q["least"].to_numpy(np.float64) - SLACK
        asks = np.repeat(np.arange(len(q)), [len(x) for x in q["cells"]])
        goal = np.concatenate([np.asarray(x) for x in q["cells"]])
        order = np.argsort(goal, kind="stable")
        asks, goal = asks[order], goal[order]
        for cell in np.unique(cells):
            low, high = np.searchsorted(cells, [cell, cell + 1])
            mine = asks[slice(*np.searchsorted(goal, [cell, cell + 1]))]
            step = max(1, (1 << 22) // (high - low))
            for rows in (mine[k : k + step] for k in range(0, len(mine), step)):
                s = u[rows] @ v[low:high].T
                bar = least[rows]
                if high - low > wanted and (open_ := np.flatnonzero(bar < -1)).size:
                    bar[open_] = np.partition(s[open_], -wanted, axis=1)[:, -wanted] - SLACK
                i, j = np.nonzero(s >= bar[:, None])
                found.append((rows[i], np.round(s[i, j], DIGITS), j + low))
    if not found:
        return pd.DataFrame({"key": [], "other": np.array([], np.int64), "sim": np.array([], np.float64)})
    row, sim, col = (np.concatenate(x) for x in zip(*found, strict=True))

    def cut(row, *columns):
        keep = np.arange(len(row)) - np.searchsorted(row, row) < wanted
        return [x[keep] for x in (row, *columns)]

    order = np.lexsort((first[col], -sim, row))
    row, sim, col = cut(row[order], sim[order], col[order])
    ids = p["ids"].to_numpy()[col]
    many = np.array([len(x) for x in ids], np.int64)
    row, sim, other = np.repeat(row, many), np.repeat(sim, many), np.concatenate(ids) if len(ids) else np.array([], np.int64)
    order = np.lexsort((other, -sim, row))
    row, sim, other = cut(row[order], sim[order], other[order])
    return pd.DataFrame({"key": q["key"].to_numpy()[row], "other": other.astype(np.int64), "sim": sim})


def _search(asking: DataFrame, asked: DataFrame, by: list[str], wanted: int) -> DataFrame:
    """(by..., key, other, sim) of vectors in the cells they name. A group holds a block of vectors and one of those that search it,
    whatever a cell's size, and a vector goes to a block once, however many of its cells it searches."""
    kinds = {f.name: f.dataType.simpleString() for f in asking.schema.fields}
    group = [*by, "block", "side"]

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _best(left, right, wanted).assign(**dict(zip(by, key, strict=False)))[[*by, "key", "other", "sim"]]

    schema = "".join(f"{c} {kinds[c]}, " for c in by) + "key binary, other long, sim double"
    return asking.drop("pairs").groupBy(*group).cogroup(asked.groupBy(*group)).applyInPandas(run, schema)


def cosine_nearest(vectors: DataFrame, k: int, by: list[str] | None = None, pivots: int = PIVOTS, looks: list[int] | None = None) -> DataFrame:
    """(by..., spot, other, sim, slot): the k most similar others of each spot within by, ties by spot; exact.

    vectors are (by..., spot, vec), all of one length. Similarities are rounded to DIGITS digits. Null, zero and non-finite
    vectors have no direction: they have no neighbours and are nobody's. A spot with fewer than k others has those.

    Method: pivots, some of the distinct vectors, cut the sphere into cells; a cell knows the angles to its pivot that its
    vectors have at least and at most. The triangle inequality of angles bounds how similar a cell's vectors can be to a
    spot. Each distinct vector first searches the most promising cells that hold k others; the k-th similarity found
    rules out most other cells, and the rest are searched. Equal vectors search once, and are found by their k + 1 first
    spots. looks, if given, gets how many distinct vectors were compared, and how many pairs there are.
    """
    by, wanted = by or [], k + 1
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    head = "".join(f"{c} {kind[c]}, " for c in by)
    base = vectors.select(*by, F.col("spot").cast("long").alias("spot"), F.col("vec").cast("array<double>").alias("vec"))
    base = stored(base.mapInPandas(_units, f"{head}spot long, key binary, u binary"), "units")
    first = Window.partitionBy(*by, "key").orderBy("spot")
    distinct = base.withColumn("i", F.row_number().over(first)).where(F.col("i") <= wanted)
    distinct = distinct.groupBy(*by, "key").agg(F.sort_array(F.collect_list("spot")).alias("ids"), F.first("u").alias("u"))
    distinct = stored(distinct, "distinct")
    n = distinct.count()
    out = f"{head}spot long, other long, sim double, slot long"
    if n == 0:
        return vectors.sparkSession.createDataFrame([], out)
    some = distinct.orderBy(F.xxhash64("key"), "key").limit(max(1, min(pivots, math.isqrt(n)))).select("u").collect()
    axes = _matrix([bytes(r.u) for r in some])
    points = stored(distinct.mapInPandas(_located(axes), f"{head}key binary, ids array<long>, u binary, cell int, angles array<double>"), "points")
    angle = points.select(*by, "cell", F.posexplode("angles").alias("i", "a")).groupBy(*by, "cell", "i").agg(F.min("a").alias("low"), F.max("a").alias("high"))
    angle = angle.groupBy(*by, "cell").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("x"))
    shapes = points.groupBy(*by, "cell").agg(F.sum(F.size("ids")).alias("many"), F.count(F.lit(1)).alias("n"))
    same = shapes["cell"].eqNullSafe(angle["cell"])
    for c in by:
        same = same & shapes[c].eqNullSafe(angle[c])
    shapes = shapes.join(angle, same).select(*[shapes[c] for c in (*by, "cell", "many", "n")], F.col("x.low").alias("low"), F.col("x.high").alias("high"))
    cells: dict = {}
    for r in shapes.collect():  # a row for each pivot and sample at most
        cells.setdefault(tuple(r[c] for c in by), []).append(r)
    size = min(max(LARGE, BLOCK), max(BLOCK, n // 16))
    shape = {key: _Shape(sorted(rows, key=lambda r: r.cell), size) for key, rows in cells.items()}
    ask = f"{head}key binary, u binary, least double, block int, side int, cells array<int>, pairs long"
    asked = points.select(*by, "key", "cell", "u", "ids").mapInPandas(_asked(shape, by), f"{head}cell int, u binary, ids array<long>, block int, side int")
    order = Window.partitionBy(*by, "key").orderBy(F.desc("sim"), "other")
    top = lambda found: found.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= wanted)
    near = points.select(*by, "key", "u").mapInPandas(_asking(axes, shape, by, wanted, False), ask)
    one = stored(top(_search(near, asked, by, wanted)).drop("slot"), "first")
    reached = one.groupBy(*by, "key").agg(F.when(F.count(F.lit(1)) >= wanted, F.min("sim")).otherwise(-2.0).alias("least"))
    more = points.select(*by, "key", "u").join(reached, [*by, "key"]).mapInPandas(_asking(axes, shape, by, wanted, True), ask)
    both = stored(top(one.unionByName(_search(more, asked, by, wanted))).drop("slot"), "best")
    if looks is not None:
        looks += [near.unionByName(more).agg(F.sum("pairs")).first()[0], points.groupBy(*by).count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]]
    own = Window.partitionBy(*by, "spot").orderBy(F.desc("sim"), "other")
    found = base.select(*by, "spot", "key").join(both, [*by, "key"]).where("spot <> other").withColumn("slot", F.row_number().over(own).cast("long"))
    return found.where(F.col("slot") <= k).select(*by, "spot", "other", "sim", "slot")


def gated(expression: DataFrame, near: DataFrame, points: DataFrame, mode: str, radius: float | None = None) -> DataFrame:
    """The expression neighbours (spot, other, sim) that are also near in the plane: among the neighbours near (spot, other), within
    radius, or either (hybrid). Without a radius it is the 0.9 quantile of the positive distances of near, which has d2 for that."""
    if mode not in ("spatial_knn", "radius", "hybrid"):
        raise ValueError(f"no such gate: {mode}")
    held = near.select("spot", "other", F.lit(True).alias("held"))
    e = expression.join(held, ["spot", "other"], "left")
    if mode == "spatial_knn":
        return e.where("held").drop("held")
    if not radius or radius <= 0:
        found = S.quantile(near.where("d2 > 0").select(F.sqrt("d2").alias("d")), "d", 0.9).first()
        radius = found[0] if found else 0.0
    a, b = points.select("spot", "x", "y"), points.select(F.col("spot").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    apart = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
    inside = (apart <= radius) & F.lit(radius > 0)
    return e.join(a, "spot").join(b, "other").where(inside | F.col("held") if mode == "hybrid" else inside).select(*expression.columns)


def hybrid_edges(near: DataFrame, expression: DataFrame, weighted: bool = False, reduce: str = "max") -> DataFrame:
    """(u, v, w_spatial, w_expr, kind): the edges of both graphs in both directions.

    near are (spot, other, d2) with the weight 1, or with weighted that of a Gaussian as wide as their median distance;
    expression are (spot, other, sim) with (sim + 1) / 2. An edge that a graph has twice has the larger weight, or the mean;
    one that it lacks has 0. kind says which weights are positive: both, spatial_only, expr_only or none.
    """
    width = None
    if weighted and (found := S.quantile(near.where("d2 > 0").select(F.sqrt("d2").alias("d")), "d", 0.5).first()):
        width = found[0]
    s = near.select("spot", "other", (X.gaussian_weight(F.sqrt("d2"), F.lit(max(width or 1.0, 1e-6))) if weighted else F.lit(1.0)).alias("w_spatial"), F.lit(None).cast("double").alias("w_expr"))
    e = expression.select("spot", "other", F.lit(None).cast("double").alias("w_spatial"), X.clamp01((F.col("sim") + 1) / 2).alias("w_expr"))
    every = s.unionByName(e)
    every = every.select(F.col("spot").alias("u"), F.col("other").alias("v"), "w_spatial", "w_expr").unionByName(every.select(F.col("other").alias("u"), F.col("spot").alias("v"), "w_spatial", "w_expr"))
    one = F.avg if reduce == "mean" else F.max
    g = every.groupBy("u", "v").agg(*[F.coalesce(one(c), F.lit(0.0)).alias(c) for c in ("w_spatial", "w_expr")])
    has = [F.col(c) > 0 for c in ("w_spatial", "w_expr")]
    return g.withColumn("kind", F.when(has[0] & has[1], "both").when(has[0], "spatial_only").when(has[1], "expr_only").otherwise("none"))


def expression_graph(points: DataFrame, vectors: DataFrame, k: int = 11, k_expr: int = 15, radius: float = 2.0, mode: str = "spatial_knn", weighted: bool = False) -> DataFrame:
    """hybrid_edges of the k nearest spots in the plane and the k_expr most similar ones, gated by the former. radius is where the search begins."""
    near = stored(spatial.nearest(points, k, radius), "near")
    return hybrid_edges(near, gated(cosine_nearest(vectors, k_expr), near, points, mode), weighted)
