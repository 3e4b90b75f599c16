"""Neighbours in the plane by grid cells, and what is measured on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import stats as S
from tessera.operators.graph import spread, stored


def _cells(points: DataFrame, width, name: str) -> DataFrame:
    return points.withColumn(f"{name}x", F.floor(F.col("x") / width)).withColumn(f"{name}y", F.floor(F.col("y") / width))


def within(points: DataFrame, others: DataFrame, radius: float, by: list[str] | None = None) -> DataFrame:
    """(by..., spot, other, d2) for all pairs no further apart than radius, a spot and itself left out.

    Points meet in the 3 by 3 cells of side radius around them, an equality join; no pair is looked at twice.
    """
    by = by or []
    near = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i AS i, j AS j))))"))
    a = _cells(spread(points.select(*by, "spot", "x", "y")), radius, "c").select("*", near.alias("n"))
    a = a.select(*by, "spot", "x", "y", (F.col("cx") + F.col("n.i")).alias("cx"), (F.col("cy") + F.col("n.j")).alias("cy"))
    b = _cells(others.select(*by, F.col("spot").alias("other"), "x", "y"), radius, "c").withColumnsRenamed({"x": "ox", "y": "oy"})
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    # both sides are exchanged: by the size of its file Spark would send one of them, ninefold, by way of the driver to all tasks
    pairs = a.hint("merge").join(b, [*by, "cx", "cy"]).withColumn("d2", dx * dx + dy * dy)
    return pairs.where((F.col("d2") <= radius * radius) & (F.col("spot") != F.col("other"))).select(*by, "spot", "other", "d2")


def nearest(points: DataFrame, k: int, radius: float, by: list[str] | None = None, rounds: int = 40) -> DataFrame:
    """(by..., spot, other, d2, slot): the k nearest others of each spot, ties by other; exact.

    A search radius that doubles: spots that found k others within it are done, as nothing outside can be nearer; the
    rest search again, until the radius covers the whole extent. Only spots still open take part in a later round.
    """
    by = by or []
    w = Window.partitionBy(*by, "spot").orderBy("d2", "other")
    box = points.agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
    far = ((box.w or 0) ** 2 + (box.h or 0) ** 2) ** 0.5
    open_, done = points, None
    for _ in range(rounds):
        found = within(open_, points, radius, by).withColumn("slot", F.row_number().over(w).cast("long")).where(F.col("slot") <= k)
        if radius > far:
            return found if done is None else done.unionByName(found)
        full = found.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by, "spot"))).where(F.col("_n") == k).drop("_n")
        full = stored(full, "nearest")
        done = full if done is None else done.unionByName(full)
        open_ = stored(open_.join(full.select(*by, "spot").distinct(), [*by, "spot"], "left_anti"), "open")
        if open_.isEmpty():
            return done
        radius *= 2
    raise ValueError("the radius is too small for the extent")


def spacing(neighbours: DataFrame, quantile: float = 0.5) -> DataFrame:
    """One row: a quantile of the distance to the nearest other."""
    first = neighbours.where("d2 > 0").groupBy("spot").agg(F.sqrt(F.min("d2")).alias("d"))
    return S.quantile(first, "d", quantile).agg(F.max("quantile").alias("spacing"))


def neighbour_qc(points: DataFrame, neighbours: DataFrame, radius: float) -> DataFrame:
    """By spot: mean distance, mean and variance of similarity, share within radius; a spot without neighbours has 0."""
    q = neighbours.groupBy("spot").agg(
        F.avg(F.sqrt("d2")).alias("locality"), F.avg("sim").alias("sim_mean"), F.var_pop("sim").alias("sim_var"), F.avg(F.when(F.col("d2") <= radius * radius, 1.0).otherwise(0.0)).alias("within"),
    )
    names = ("locality", "sim_mean", "sim_var", "within")
    return points.select("spot").join(q, "spot", "left").select("spot", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def continuity(labels: DataFrame, neighbours: DataFrame) -> DataFrame:
    """One row: the mean share of neighbours that have a spot's label."""
    other = labels.select(F.col("spot").alias("other"), F.col("label").alias("l2"))
    own = neighbours.join(labels, "spot").join(other, "other").groupBy("spot").agg(F.avg(F.when(F.col("label") == F.col("l2"), 1.0).otherwise(0.0)).alias("s"))
    return own.agg(F.avg("s").alias("continuity"))


#: Products of two groups' sizes up to which all their pairs are compared.
ALL_PAIRS = 10_000


def directed_distance(pairs: DataFrame, members: DataFrame, share: float = 0.1, least: int = 3, every: int = ALL_PAIRS) -> DataFrame:
    """(a, b, distance) for each pair of groups: the mean over the smallest nearest distances from a to b.

    members are (group, spot, x, y) of boundary spots. max(least, share of the spots of a) distances count. Small groups are
    compared whole. Of larger ones a's spots look for b's in grid cells, within a radius that doubles until as many as count
    have found one: those further away are not among the smallest. Equal distances are counted, so no task holds a pair.
    """
    members = stored(members.select("group", "spot", "x", "y"), "members")
    shape = members.groupBy("group").agg(F.count_distinct("spot").alias("n"), F.count(F.lit(1)).alias("rows"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    # about one spot of b a cell at first
    wide = F.greatest(F.sqrt(F.col("w") * F.col("h") / F.col("rows")), F.greatest("w", "h") / F.col("rows"))
    shape = stored(shape.select("group", "n", "rows", F.when(wide > 0, wide).otherwise(1.0).alias("radius")), "shapes")
    sized = pairs.select("a", "b").distinct().join(shape.select(F.col("group").alias("a"), "n", F.col("rows").alias("ra")), "a").join(shape.select(F.col("group").alias("b"), F.col("rows").alias("rb"), "radius"), "b")
    sized = stored(sized.select("a", "b", F.greatest(F.lit(least), F.ceil(share * F.col("n"))).alias("need"), "n", "radius", (F.col("ra") * F.col("rb") > every).alias("large")), "sized")
    src = members.select(F.col("group").alias("a"), "spot", "x", "y")
    dst = members.select(F.col("group").alias("b"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    nearest_of = lambda met: met.groupBy("a", "b", "spot").agg(F.min(dx * dx + dy * dy).alias("d2"))
    found = nearest_of(sized.where("NOT large").select("a", "b").join(src, "a").join(dst, "b"))
    open_ = sized.where("large").select("a", "b", "radius", F.least("need", "n").alias("wanted"))
    if not open_.isEmpty():
        near = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i AS i, j AS j))))"))
        asked = stored(open_.select("a", "b", "radius").join(src, "a"), "asked")
        while True:
            cells = spread(asked).select("*", near.alias("c")).select("a", "b", "spot", "x", "y", "radius", (F.floor(F.col("x") / F.col("radius")) + F.col("c.i")).alias("cx"), (F.floor(F.col("y") / F.col("radius")) + F.col("c.j")).alias("cy"))
            told = dst.join(asked.select("b", "radius").distinct(), "b")
            told = told.select("b", "radius", "ox", "oy", F.floor(F.col("ox") / F.col("radius")).alias("cx"), F.floor(F.col("oy") / F.col("radius")).alias("cy"))
            met = cells.hint("merge").join(told, ["b", "radius", "cx", "cy"]).where(dx * dx + dy * dy <= F.col("radius") * F.col("radius"))
            here = stored(nearest_of(spread(met.select("a", "b", "spot", "x", "y", "ox", "oy"), "a", "b", "spot")), "found")
            found = found.unionByName(here)
            seen = here.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_seen"))
            left = open_.join(seen, ["a", "b"], "left").withColumn("wanted", F.col("wanted") - F.coalesce("_seen", F.lit(0))).drop("_seen")
            open_ = stored(left.where("wanted > 0").withColumn("radius", 2 * F.col("radius")), "open")
            if open_.isEmpty():
                break
            rest = asked.drop("radius").join(here.select("a", "b", "spot"), ["a", "b", "spot"], "left_anti")
            asked = stored(rest.join(open_.select("a", "b", "radius"), ["a", "b"]), "asked")
    many = S.running(found.groupBy("a", "b", "d2").agg(F.count(F.lit(1)).alias("_n")), ["a", "b"], [F.col("d2")], F.col("_n"), "_upto")
    many = many.join(sized.select("a", "b", "need"), ["a", "b"]).withColumn("_n", F.least("_n", F.col("need") - F.col("_upto"))).where("_n > 0")
    return many.groupBy("a", "b").agg((F.sum(F.sqrt("d2") * F.col("_n")) / F.sum("_n")).alias("distance"))
