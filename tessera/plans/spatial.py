"""Registered queries over neighbourhoods, graphs and local scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.stats import top_k
from tessera.operators import graph as H
from tessera.operators import gss as L
from tessera.operators import neighbours as B
from tessera.operators import spatial as P
from tessera.plans.basic import r
from tessera.sources import views as V

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


_KNN = ", k AS (SELECT * FROM (SELECT a.spot, b.spot AS other, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2, row_number() OVER (PARTITION BY a.spot ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.spot) AS slot FROM {0} a JOIN {0} b ON a.spot <> b.spot) WHERE slot <= {1})"


def grid(spark, sf):
    """Edges of the users' lattice with its diagonals, in both directions."""
    return P.within(V.users(spark, sf), V.users(spark, sf), 1.5).select(F.col("spot").alias("u"), F.col("other").alias("v"))


@query(V.duck("spots", _KNN.format("spots", 8) + " SELECT spot, other, d2, slot FROM k"))
def j11_nearest(spark, sf):
    return P.nearest(V.spots(spark, sf), 8, 2.0).select("spot", "other", "d2", "slot")


@query(V.duck("spots", " SELECT a.spot, b.spot AS other, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM spots a JOIN spots b ON a.spot <> b.spot AND a.sample = b.sample AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 5.76"))
def j12_radius(spark, sf):
    s = V.spots(spark, sf)
    return P.within(s, s, 2.4, ["sample"]).select("spot", "other", "d2")


@query(V.duck("active users", ", m AS (SELECT program AS g, a.spot, x, y FROM active a JOIN users u ON a.spot = u.spot WHERE program LIKE '%|1' OR program LIKE '%|2'), n AS (SELECT a.g AS a, b.g AS b, a.spot, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d2 FROM m a JOIN m b ON a.g <> b.g GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY d2, spot) AS i, count(*) OVER (PARTITION BY a, b) AS n FROM n) SELECT a, b, round(avg(sqrt(d2)), 6) AS distance FROM k WHERE i <= greatest(3, ceil(0.4 * n)) GROUP BY a, b"))
def j13_directed_distance(spark, sf):
    a = V.active(spark, sf).where("program LIKE '%|1' OR program LIKE '%|2'").join(V.users(spark, sf), "spot").withColumnRenamed("program", "group")
    g = a.select("group").distinct()
    pairs = g.select(F.col("group").alias("a")).join(F.broadcast(g.select(F.col("group").alias("b"))), F.col("a") != F.col("b"))  # programs are few
    return P.directed_distance(pairs, a.select("group", "spot", "x", "y"), 0.4).withColumn("distance", r("distance"))


@query(V.duck("spots", _KNN.format("spots", 8) + ", l AS (SELECT k.*, CASE WHEN a.sample = b.sample THEN 1.0 ELSE 0.5 END::DOUBLE AS sim FROM k JOIN spots a ON k.spot = a.spot JOIN spots b ON k.other = b.spot) SELECT s.spot, round(coalesce(avg(sqrt(d2)), 0), 6) AS locality, round(coalesce(avg(sim), 0), 6) AS sim_mean, round(coalesce(var_pop(sim), 0), 6) AS sim_var, round(coalesce(avg(CASE WHEN d2 <= 1 THEN 1.0::DOUBLE ELSE 0 END), 0), 6) AS within FROM spots s LEFT JOIN l ON s.spot = l.spot GROUP BY s.spot"))
def a23_neighbour_qc(spark, sf):
    s = V.spots(spark, sf)
    label = s.select("spot", "sample")
    k = P.nearest(s, 8, 2.0).join(label, "spot").join(label.select(F.col("spot").alias("other"), F.col("sample").alias("s2")), "other")
    q = P.neighbour_qc(s, k.withColumn("sim", F.when(F.col("sample") == F.col("s2"), 1.0).otherwise(0.5)), 1.0)
    return q.select("spot", *[r(c).alias(c) for c in q.columns[1:]])


@query(V.duck("spots", _KNN.format("spots", 8) + ", f AS (SELECT spot, sqrt(min(d2)) AS d FROM k GROUP BY spot), c AS (SELECT k.spot, avg(CASE WHEN a.sample = b.sample THEN 1.0::DOUBLE ELSE 0 END) AS s FROM k JOIN spots a ON k.spot = a.spot JOIN spots b ON k.other = b.spot GROUP BY k.spot) SELECT (SELECT quantile_cont(d, 0.5) FROM f) AS spacing, (SELECT round(avg(s), 6) FROM c) AS continuity"))
def a24_a25_spacing_continuity(spark, sf):
    s = V.spots(spark, sf)
    k = H.stored(P.nearest(s, 8, 2.0), "knn")
    one = P.spacing(k).withColumn("j", F.lit(1)).join(P.continuity(s.select("spot", F.col("sample").alias("label")), k).withColumn("j", F.lit(1)), "j")
    return one.select("spacing", r("continuity").alias("continuity"))


@query(V.duck("grid", ", h AS (SELECT u, v FROM grid UNION SELECT a.u, b.v FROM grid a JOIN grid b ON a.v = b.u WHERE a.u <> b.v) SELECT u, count(*) AS n, sum(v)::BIGINT AS total FROM h GROUP BY u"))
def g0_g1_reach(spark, sf):
    return H.reach(H.both_ways(grid(spark, sf)), 2).groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query(V.duck("active grid", ", e AS (SELECT a.program, g.u, g.v FROM grid g JOIN active a ON g.u = a.spot JOIN active b ON g.v = b.spot AND a.program = b.program), c(program, spot, component) AS (SELECT program, spot, spot FROM active UNION SELECT e.program, e.v, c.component FROM c JOIN e ON e.program = c.program AND e.u = c.spot AND c.component < e.v) SELECT program, spot, min(component) AS component FROM c GROUP BY 1, 2", recursive=True))
def g3_components(spark, sf):
    a = V.active(spark, sf).select("program", "spot")
    return H.components(a, H.stored(_inner(a, grid(spark, sf)), "inner"))


def _inner(a, edges):
    """Edges between active spots of a program."""
    return a.withColumnRenamed("spot", "u").join(edges, "u").join(a.withColumnRenamed("spot", "v"), ["program", "v"]).select("program", "u", "v")


@query(V.duck("active grid", ", e AS (SELECT a.program, g.u, g.v FROM grid g JOIN active a ON g.u = a.spot JOIN active b ON g.v = b.spot AND a.program = b.program), c(program, spot, component) AS (SELECT program, spot, spot FROM active UNION SELECT e.program, e.v, c.component FROM c JOIN e ON e.program = c.program AND e.u = c.spot AND c.component < e.v), m AS (SELECT program, spot, min(component) AS component FROM c GROUP BY 1, 2), z AS (SELECT program, component, count(*) AS n FROM m GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY program ORDER BY n DESC, component) AS i, sum(n) OVER (PARTITION BY program) AS t FROM z) SELECT program, count(*) AS components, round(sum(n) FILTER (i = 1) / any_value(t), 6) AS largest, round(sum(n) FILTER (i <= 2) / any_value(t), 6) AS top2, round(sum(n) FILTER (i <= 3) / any_value(t), 6) AS top3 FROM k GROUP BY program", recursive=True))
def g4_component_shares(spark, sf):
    z = g3_components(spark, sf).groupBy("program", "component").agg(F.count(F.lit(1)).alias("n"))
    k = top_k(z, ["program"], [F.desc("n"), "component"], 1 << 60, "i")
    part = lambda m: r(F.sum(F.when(F.col("i") <= m, F.col("n"))) / F.sum("n"))
    return k.groupBy("program").agg(F.count(F.lit(1)).alias("components"), part(1).alias("largest"), part(2).alias("top2"), part(3).alias("top3"))


_SMOOTH = ", ".join(f"s{k + 1} AS (SELECT a.program, a.spot, CASE WHEN avg(b.value) IS NULL THEN a.value ELSE (1 - 0.6::DOUBLE) * a.value + 0.6::DOUBLE * avg(b.value) END AS value FROM s{k} a LEFT JOIN grid g ON a.spot = g.u LEFT JOIN s{k} b ON g.v = b.spot AND a.program = b.program GROUP BY a.program, a.spot, a.value)" for k in range(5))


@query(V.duck("active grid", f", s0 AS (SELECT * FROM active), {_SMOOTH} SELECT program, spot, round(value, 3) AS value FROM s5"))
def g5_smooth(spark, sf):
    return H.smooth(V.active(spark, sf), H.stored(grid(spark, sf), "grid")).withColumn("value", r("value", 3))


@query(V.duck("active grid", ", p AS (SELECT a.program, a.spot, coalesce(arg_max(b.spot, (b.value, -b.spot)) FILTER (b.value > a.value + 1e-8), a.spot) AS parent FROM active a LEFT JOIN grid g ON a.spot = g.u LEFT JOIN active b ON g.v = b.spot AND a.program = b.program GROUP BY a.program, a.spot), w(program, spot, root) AS (SELECT program, spot, parent FROM p UNION SELECT w.program, w.spot, p.parent FROM w JOIN p ON w.program = p.program AND w.root = p.spot) SELECT w.program, w.spot, w.root FROM w JOIN p ON w.program = p.program AND w.root = p.spot WHERE p.parent = p.spot", recursive=True))
def g6_watershed(spark, sf):
    return H.watershed(V.active(spark, sf), H.stored(grid(spark, sf), "grid"))


@query()
def g7_merge_small_basins(spark, sf):
    a = V.active(spark, sf)
    g = H.stored(grid(spark, sf), "grid")
    return H.merge_small_basins(H.watershed(a, g).join(a, ["program", "spot"]), g)


@query(V.duck("active grid", ", h2 AS (SELECT u, v FROM grid UNION SELECT a.u, b.v FROM grid a JOIN grid b ON a.v = b.u WHERE a.u <> b.v), e AS (SELECT a.program, g.u, g.v FROM h2 g JOIN active a ON g.u = a.spot JOIN active b ON g.v = b.spot AND a.program = b.program), c(program, spot, component) AS (SELECT program, spot, spot FROM active UNION SELECT e.program, e.v, c.component FROM c JOIN e ON e.program = c.program AND e.u = c.spot AND c.component < e.v) SELECT program, spot, min(component) AS component FROM c GROUP BY 1, 2", recursive=True))
def g8_bridge_gaps(spark, sf):
    return H.bridge_gaps(g3_components(spark, sf), H.stored(grid(spark, sf), "grid"), 1)


@query()
def g10_articulation(spark, sf):
    m = g3_components(spark, sf).select(F.concat_ws("/", "program", F.col("component").cast("string")).alias("domain"), "spot")
    return H.articulation_share(m, H.stored(grid(spark, sf), "grid")).withColumn("ratio", r("ratio"))


_SIM = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)"
_LAT = ", lat AS (SELECT vec_id AS spot, (vec_id % 25)::DOUBLE AS x, (vec_id // 25)::DOUBLE AS y, embedding, label FROM embeddings)"


def latent(spark, sf):
    e = V.load(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("spot"), (F.col("vec_id") % 25).cast("double").alias("x"), F.floor(F.col("vec_id") / 25).cast("double").alias("y"), F.col("embedding").alias("vec"), "label")


def _chosen(spark, sf):
    s = latent(spark, sf)
    near = H.stored(P.nearest(s.select("spot", "x", "y"), 24, 3.0), "candidates")
    ties = H.both_ways(near.where("slot <= 4").select(F.col("spot").alias("u"), F.col("other").alias("v")))
    return L.choose_neighbours(near.select("spot", "other", "d2"), H.reach(ties, 2), s, 12)


_CHOSEN = _LAT + _KNN.format("lat", 24) + f", t AS (SELECT spot AS u, other AS v FROM k WHERE slot <= 4 UNION SELECT other, spot FROM k WHERE slot <= 4), h AS (SELECT u, v FROM t UNION SELECT a.u, b.v FROM t a JOIN t b ON a.v = b.u WHERE a.u <> b.v), m AS (SELECT k.spot, k.other, k.d2, CASE WHEN h.u IS NULL THEN 1 ELSE 0 END AS tier, {_SIM} AS sim FROM k LEFT JOIN h ON k.spot = h.u AND k.other = h.v JOIN lat a ON k.spot = a.spot JOIN lat b ON k.other = b.spot), ch AS (SELECT * FROM (SELECT spot, other, d2, sim, row_number() OVER (PARTITION BY spot ORDER BY tier, CASE WHEN tier = 0 THEN -sim ELSE d2 END, other) AS slot FROM m) WHERE slot <= 12)"


@query("WITH " + _CHOSEN.lstrip(", ") + " SELECT spot, other, d2, round(sim, 6) AS sim, slot FROM ch")
def g2_choose_neighbours(spark, sf):
    return _chosen(spark, sf).withColumn("sim", r("sim"))


_GSS = ", ng AS (SELECT count(DISTINCT gene) AS g FROM names), ns AS (SELECT count(*) AS n FROM spots), dense AS (SELECT s.spot, q.gene, coalesce(e.value, 0) AS value FROM spots s CROSS JOIN (SELECT DISTINCT gene FROM names) q LEFT JOIN names e ON e.spot = s.spot AND e.gene = q.gene), rk AS (SELECT spot, gene, value, rank() OVER (PARTITION BY spot ORDER BY value) + (count(*) OVER (PARTITION BY spot, value) - 1) / 2.0::DOUBLE AS rank FROM dense), gl AS (SELECT gene, avg(ln(rank)) AS background, avg(CASE WHEN value > 0 THEN 1.0::DOUBLE ELSE 0 END) AS overall FROM rk GROUP BY gene), lo AS (SELECT k.spot, rk.gene, avg(ln(rank)) AS region, avg(CASE WHEN value > 0 THEN 1.0::DOUBLE ELSE 0 END) AS have FROM k JOIN rk ON k.other = rk.spot GROUP BY 1, 2), sc AS (SELECT spot, lo.gene, round(2 ** greatest((region - background) / ln(2) * least(1, have / overall), 0) - 1, 6) AS score FROM lo JOIN gl ON lo.gene = gl.gene WHERE overall > 0)"


@query(V.duck("names spots", _KNN.format("spots", 8) + _GSS + " SELECT spot, gene, score, rank_in_spot FROM (SELECT *, row_number() OVER (PARTITION BY spot ORDER BY score DESC, gene) AS rank_in_spot FROM sc WHERE score > 0) WHERE rank_in_spot <= 20"))
def flagship_gss(spark, sf):
    """Neighbours, ranks with zeros, geometric means, scores and the top genes of each spot."""
    s, e = V.spots(spark, sf), V.names(spark, sf)
    e = H.stored(e, "cells")
    scored = L.scores(e, P.nearest(s, 8, 2.0), s.count(), e.select("gene").distinct().count())
    return L.sparsify(scored, 20).select("spot", "gene", "score", "rank_in_spot")


@query()
def b1_stability(spark, sf):
    """Neighbour sets under noise on the latent vectors: the mean Jaccard of five repeats by spot."""
    s = latent(spark, sf)
    near = P.nearest(s.select("spot", "x", "y"), 24, 3.0)
    sims = L.cosines(near, s, lambda v: L.noisy(v, 5, 0.02, 2024, plain=True), 6)
    return L.neighbour_stability(sims, 12, 5).withColumn("stability", r("stability"))


_NEAR = (
    ", sims AS (SELECT a.spot, b.spot AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS sim FROM lat a JOIN lat b ON a.spot <> b.spot),"
    " en AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spot ORDER BY sim DESC, other) AS slot FROM sims) WHERE slot <= {})"
)


@query("WITH " + _LAT.lstrip(", ") + _NEAR.format(15) + " SELECT spot, other, round(sim, 6) AS sim, slot FROM en")
def m2_expression_neighbours(spark, sf):
    """The 15 most similar spots of each in 64 dimensions."""
    return B.cosine_nearest(latent(spark, sf), 15).withColumn("sim", r("sim"))


_HYBRID = (
    ", w AS (SELECT spot AS u, other AS v, exp(-0.5 * d2 / {width}) AS s, NULL::DOUBLE AS e FROM k UNION ALL SELECT spot, other, NULL, greatest(0, least(1, (sim + 1) / 2)) FROM en SEMI JOIN k USING (spot, other)),"
    " g AS (SELECT u, v, coalesce(max(s), 0) AS w_spatial, coalesce(max(e), 0) AS w_expr FROM (SELECT * FROM w UNION ALL SELECT v, u, s, e FROM w) GROUP BY u, v)"
    " SELECT u, v, round(w_spatial, 6) AS w_spatial, round(w_expr, 6) AS w_expr, CASE WHEN w_spatial > 0 AND w_expr > 0 THEN 'both' WHEN w_spatial > 0 THEN 'spatial_only' WHEN w_expr > 0 THEN 'expr_only' ELSE 'none' END AS kind FROM g"
)


@query("WITH " + _LAT.lstrip(", ") + _KNN.format("lat", 11) + _NEAR.format(15) + _HYBRID.format(width="(SELECT power(median(sqrt(d2)), 2) FROM k WHERE d2 > 0)"))
def m2_a26_hybrid_edges(spark, sf):
    """11 nearest spots in the plane, weighted, and those of the 15 most similar spots that are among them."""
    s = latent(spark, sf)
    return B.expression_graph(s.select("spot", "x", "y"), s.select("spot", "vec"), weighted=True).withColumns({c: r(c) for c in ("w_spatial", "w_expr")})
