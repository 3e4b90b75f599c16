"""Spatial domains: geometry, reliability, graph and merge proposals, over members (domain, program, spot, value)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators import spatial
from tessera.operators.graph import components, stored


def sides(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(domain, spot, v, inside) for every edge that leaves a member spot."""
    own = members.select("domain", F.col("spot").alias("v"), F.lit(True).alias("inside"))
    # both grow with the spots; files of them are small, and Spark would send their rows by way of the driver to all tasks
    met = members.select("domain", "spot").hint("merge").join(edges.withColumnRenamed("u", "spot"), "spot")
    return met.hint("merge").join(own, ["domain", "v"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def geometry(members: DataFrame, edges: DataFrame, points: DataFrame) -> DataFrame:
    """Size, edges inside (counted once) and over the boundary (per spot inside), density, centroid and shape."""
    s = sides(members, edges)
    e = s.groupBy("domain").agg(F.count_if(F.col("inside") & (F.col("spot") < F.col("v"))).alias("internal"), F.count_if(~F.col("inside")).alias("boundary"))
    inner = s.where("inside").groupBy("domain", "spot").agg(F.count(F.lit(1)).alias("degree"))
    leaf = members.select("domain", "spot").hint("merge").join(inner, ["domain", "spot"], "left").groupBy("domain").agg(F.avg(F.when(F.coalesce("degree", F.lit(0)) <= 1, 1.0).otherwise(0.0)).alias("leaf_ratio"))
    place = members.hint("merge").join(points, "spot").groupBy("domain").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("vxy"),
    )
    d = place.hint("merge").join(e, "domain", "left").hint("merge").join(leaf, "domain").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("internal", "boundary")})
    half, root = (F.col("vx") + F.col("vy")) / 2, F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, 2) + F.col("vxy") * F.col("vxy"))
    edge = F.greatest(F.lit(1.0), F.col("boundary").cast("double"))
    return d.select(
        "domain", "n", "cx", "cy", "internal", "boundary",
        F.when(F.col("n") > 1, F.col("internal") / (F.col("n") * (F.col("n") - 1) / 2)).otherwise(0.0).alias("density"),
        X.clamp01(4 * math.pi * F.col("n") / (edge * edge)).alias("compactness"),
        (F.col("boundary") / F.greatest(F.lit(1), F.col("boundary") + F.col("internal"))).alias("boundary_ratio"), "leaf_ratio",
        F.when(F.col("n") < 3, 1.0).otherwise(F.sqrt((half + root + 1e-12) / (F.greatest(half - root, F.lit(0.0)) + 1e-12))).alias("elongation"),
    )


def prominence(members: DataFrame, values: DataFrame, edges: DataFrame, quantile: float = 0.8) -> DataFrame:
    """Peak, its height over a quantile of the active values outside (once per edge), and the mean against them.

    values are (program, spot, value) of all active spots; a domain without active spots outside is held against their
    median, and its mean against their mean.
    """
    own = members.groupBy("domain", "program").agg(F.max("value").alias("peak"), F.avg("value").alias("mean"))
    out = values.select("program", F.col("spot").alias("v"), F.col("value").alias("out"))
    s = sides(members, edges).where("NOT inside").hint("merge").join(own.select("domain", "program"), "domain").hint("merge").join(out, ["program", "v"])
    q = s.groupBy("domain").agg(F.percentile("out", F.lit(quantile)).alias("q"), F.avg("out").alias("m"))
    every = values.groupBy("program").agg(F.percentile("value", F.lit(0.5)).alias("q0"), F.avg("value").alias("m0"))
    d = own.hint("merge").join(q, "domain", "left").join(every, "program")
    low, mean = F.coalesce("q", "q0"), F.coalesce("m", "m0")
    return d.select("domain", "program", "peak", "mean", F.greatest(F.lit(0.0), F.col("peak") - low).alias("prominence"), (F.col("mean") / (mean + 1e-8)).alias("ratio"), (F.col("mean") - mean).alias("delta"))


def confidence_weight(confidence, gamma: float = 1.0, floor: float = 0.05):
    return F.pow(F.greatest(F.lit(floor), F.least(F.lit(1.0), confidence)), F.lit(gamma))


def reliability(domains: DataFrame, quantile: float = 0.9, density_scale: float = 0.15, low: float = 0.05) -> DataFrame:
    """confidence * sqrt(prominence) * sqrt(density), each on a scale of 0 to 1; prominence by a quantile of all positive ones."""
    scale = domains.where("prominence > 0").agg(F.percentile("prominence", F.lit(quantile)).alias("s")).first().s or 1.0
    prom = X.clamp01(F.col("prominence") / max(1e-8, scale))
    dense = X.clamp01(F.col("density") / density_scale)
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))) * F.sqrt(prom) * F.sqrt(dense)
    return domains.withColumn("reliability", F.greatest(F.lit(low), F.least(F.lit(1.0), raw)))


def pairs(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(i, j, shared, overlap) for domains that touch over spot edges (each edge once) or have spots in common."""
    m = members.select("domain", "spot")
    half = edges.where("u < v")
    a, b = m.select(F.col("domain").alias("a"), F.col("spot").alias("u")), m.select(F.col("domain").alias("b"), F.col("spot").alias("v"))
    touch = half.hint("merge").join(a, "u").hint("merge").join(b, "v").where("a <> b").groupBy(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.count(F.lit(1)).alias("shared"))
    both = m.select(F.col("domain").alias("i"), "spot").hint("merge").join(m.select(F.col("domain").alias("j"), "spot"), "spot").where("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("overlap"))
    out = touch.hint("merge").join(both, ["i", "j"], "full")
    return out.select("i", "j", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("overlap", F.lit(0)).alias("overlap"))


def domain_graph(members: DataFrame, edges: DataFrame, shape: DataFrame) -> DataFrame:
    """Pairs with the overlap as a share of the union and the distance of centroids."""
    a = shape.select(F.col("domain").alias("i"), F.col("n").alias("ni"), F.col("cx").alias("xi"), F.col("cy").alias("yi"))
    b = shape.select(F.col("domain").alias("j"), F.col("n").alias("nj"), F.col("cx").alias("xj"), F.col("cy").alias("yj"))
    p = pairs(members, edges).hint("merge").join(a, "i").hint("merge").join(b, "j")
    return p.select("i", "j", "shared", (F.col("overlap") / F.greatest(F.lit(1), F.col("ni") + F.col("nj") - F.col("overlap"))).alias("spatial_overlap"), F.hypot(F.col("xi") - F.col("xj"), F.col("yi") - F.col("yj")).alias("distance"), F.col("shared").cast("double").alias("edge_weight"))


def merge_groups(domains: DataFrame, members: DataFrame, edges: DataFrame, shared: int = 2, distance: float = 3.0, peak: float = 1.3, prom: float = 1.5) -> DataFrame:
    """(domain, merged) for domains of one program that would be merged: near, touching and alike in height."""
    s = domains.select("domain", "program", "cx", "cy", "peak", "prominence")
    a, b = (s.select(*[F.col(c).alias(f"{c}_{k}") for c in s.columns]) for k in "ij")
    # each of the two sides of an edge counts, as both may lie in either domain
    p = pairs(members, edges).hint("merge").join(a, F.col("i") == F.col("domain_i")).hint("merge").join(b, F.col("j") == F.col("domain_j")).where("program_i = program_j")
    ratio = lambda c: F.when((F.col(f"{c}_i") > 0) & (F.col(f"{c}_j") > 0), F.greatest(f"{c}_i", f"{c}_j") / F.least(f"{c}_i", f"{c}_j")).otherwise(float("inf"))
    ok = (F.col("shared") >= shared) & (F.hypot(F.col("cx_i") - F.col("cx_j"), F.col("cy_i") - F.col("cy_j")) <= distance) & (ratio("peak") <= peak) & (ratio("prominence") <= prom)
    e = p.where(ok).select(F.col("i").alias("u"), F.col("j").alias("v"))
    e = stored(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), "merges")
    joined = components(e.select(F.col("u").alias("spot")).distinct(), e)
    return joined.select(F.col("spot").alias("domain"), F.col("component").alias("merged"))


def boundary_spots(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Member spots with a neighbour outside; of a domain with fewer than three such all its spots."""
    out = sides(members, edges).where("NOT inside").select("domain", "spot").distinct().withColumn("edge", F.lit(True))
    m = members.select("domain", "spot").join(out, ["domain", "spot"], "left")
    w = Window.partitionBy("domain")
    few = F.count("edge").over(w) < F.least(F.lit(3), F.count(F.lit(1)).over(w))
    return m.withColumn("few", few).where("edge OR few").select("domain", "spot")


def apart(boundary: DataFrame, edges: DataFrame, graph: DataFrame, epsilon: float) -> DataFrame:
    """(i, j, distance) for pairs of domains that are not in graph, (i, j, ...), and may be epsilon apart or less: the smaller of
    their directed distances.

    boundary are (group, spot, x, y). A directed distance is a mean of distances between spots, so a pair without spots that
    are epsilon apart is further away. Domains whose spots meet over edges, (u, v) in both directions, touch: they are in
    graph, so these pairs of spots need not meet again with all their domains.
    """
    spots = boundary.select("spot", "x", "y").distinct()
    reach = spatial.within(spots, spots, epsilon * (1 + 1e-9))  # a mean may be rounded down
    reach = stored(reach.hint("merge").join(edges.select(F.col("u").alias("spot"), F.col("v").alias("other")), ["spot", "other"], "left_anti"), "reach")
    a, o = boundary.select(F.col("group").alias("a"), "spot"), boundary.select(F.col("group").alias("b"), F.col("spot").alias("other"))
    near = reach.hint("merge").join(a, "spot").hint("merge").join(o, "other").where("a < b").select("a", "b").distinct()
    near = stored(near.hint("merge").join(graph.select(F.col("i").alias("a"), F.col("j").alias("b")), ["a", "b"], "left_anti"), "near")
    ways = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = spatial.directed_distance(ways, boundary)
    return found.groupBy(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.min("distance").alias("distance"))


def neighbour_features(graph: DataFrame, programs: DataFrame) -> DataFrame:
    """By domain: neighbours, share of another program, shared boundary against the largest of all."""
    g = graph.select("i", "j", "shared").unionByName(graph.select(F.col("j").alias("i"), F.col("i").alias("j"), "shared"))
    own, other = programs.select(F.col("domain").alias("i"), F.col("program").alias("p")), programs.select(F.col("domain").alias("j"), F.col("program").alias("q"))
    d = g.join(own, "i").join(other, "j").groupBy("i").agg(F.count_distinct("j").alias("neighbours"), F.avg(F.when(F.col("p") != F.col("q"), 1.0).otherwise(0.0)).alias("mixed"), F.sum("shared").alias("b"))
    most = d.agg(F.max("b")).first()[0] or 1
    return d.select(F.col("i").alias("domain"), "neighbours", "mixed", (F.col("b") / most).alias("contact"))


def owners(members: DataFrame) -> DataFrame:
    """(spot, domain, domains): the first domain that has a spot, and how many have it."""
    w = Window.partitionBy("spot")
    m = members.select("spot", "domain").withColumn("rn", F.row_number().over(w.orderBy("domain"))).withColumn("domains", F.count(F.lit(1)).over(w))
    return m.where("rn = 1").select("spot", "domain", "domains")


def alpha_boundary(points: DataFrame, radius: float) -> DataFrame:
    """(domain, u, v): the boundary of each domain's alpha complex, as pairs of its spots, u before v.

    points are (domain, spot, x, y). An edge is on the boundary if just one of the two circles of the radius through its
    ends is empty of the domain's other spots: then it belongs to one triangle whose own circle is smaller. So no
    triangulation is made: ends meet in grid cells, and circles meet the spots that may lie in them, as joins. Spots on a
    circle, as on a lattice, are not in it; of spots at one place each has its edges; a domain without three spots that
    are near enough has none.
    """
    pairs = spatial.within(points, points, 2 * radius, ["domain"]).where("spot < other AND d2 > 0")
    a = points.select("domain", "spot", F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = points.select("domain", F.col("spot").alias("other"), F.col("x").alias("bx"), F.col("y").alias("by"))
    e = pairs.join(a, ["domain", "spot"]).join(b, ["domain", "other"])
    off = F.sqrt(F.greatest(F.lit(0.0), radius * radius / F.col("d2") - 0.25))  # of the edge's length, from its middle
    centre = [F.struct(F.lit(s).alias("side"), ((F.col("ax") + F.col("bx")) / 2 - s * off * (F.col("by") - F.col("ay"))).alias("cx"), ((F.col("ay") + F.col("by")) / 2 + s * off * (F.col("bx") - F.col("ax"))).alias("cy")) for s in (-1, 1)]
    circles = stored(e.select("domain", F.col("spot").alias("u"), F.col("other").alias("v"), F.explode(F.array(*centre)).alias("c")).select("domain", "u", "v", "c.*"), "circles")
    near = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i AS i, j AS j))))"))
    cells = circles.select("*", near.alias("n")).select("domain", "u", "v", "side", "cx", "cy", (F.floor(F.col("cx") / radius) + F.col("n.i")).alias("gx"), (F.floor(F.col("cy") / radius) + F.col("n.j")).alias("gy"))
    held = points.select("domain", "spot", "x", "y", F.floor(F.col("x") / radius).alias("gx"), F.floor(F.col("y") / radius).alias("gy"))
    inside = F.pow(F.col("x") - F.col("cx"), F.lit(2)) + F.pow(F.col("y") - F.col("cy"), F.lit(2)) < radius * radius * (1 - 1e-9)
    full = cells.join(held, ["domain", "gx", "gy"]).where(inside & (F.col("spot") != F.col("u")) & (F.col("spot") != F.col("v"))).select("domain", "u", "v", "side").distinct()
    empty = circles.join(full, ["domain", "u", "v", "side"], "left_anti")
    return empty.groupBy("domain", "u", "v").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
