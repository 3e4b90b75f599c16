"""Registered queries over domains and niches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import domains as D
from tessera.operators import graph as H
from tessera.operators import niches as N
from tessera.operators import spatial as P
from tessera.plans.basic import r
from tessera.plans.spatial import _inner, grid
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


def _members(spark, sf, quantile=0.6):
    """Domains: connected active spots of a program, by program and smallest spot."""
    a = H.stored(V.active(spark, sf, quantile), "active")
    g = H.stored(grid(spark, sf), "grid")
    c = H.components(a.select("program", "spot"), H.stored(_inner(a.select("program", "spot"), g), "inner"))
    m = c.join(a, ["program", "spot"]).select(F.concat_ws("/", "program", F.col("component").cast("string")).alias("domain"), "program", "spot", "value")
    return H.stored(m, "members"), g, a


def _domains(spark, sf, quantile=0.6):
    m, g, a = _members(spark, sf, quantile)
    d = D.geometry(m, g, V.users(spark, sf)).join(D.prominence(m, a, g), "domain")
    d = d.withColumn("confidence", D.confidence_weight(F.length("program") / 10.0))
    return H.stored(D.reliability(d), "domains"), m, g


_MEM = ", e AS (SELECT a.program, g.u, g.v FROM grid g JOIN active a ON g.u = a.spot JOIN active b ON g.v = b.spot AND a.program = b.program), c(program, spot, component) AS (SELECT program, spot, spot FROM active UNION SELECT e.program, e.v, c.component FROM c JOIN e ON e.program = c.program AND e.u = c.spot AND c.component < e.v), m AS (SELECT a.program || '/' || min(component)::VARCHAR AS domain, a.program, a.spot, a.value FROM c JOIN active a ON c.program = a.program AND c.spot = a.spot GROUP BY a.program, a.spot, a.value), sd AS (SELECT m.domain, m.spot, g.v, o.spot IS NOT NULL AS inside FROM m JOIN grid g ON m.spot = g.u LEFT JOIN m o ON o.domain = m.domain AND o.spot = g.v)"
_GEO = ", ed AS (SELECT domain, count(*) FILTER (inside AND spot < v) AS internal, count(*) FILTER (NOT inside) AS boundary FROM sd GROUP BY domain), lf AS (SELECT m.domain, avg(CASE WHEN coalesce(k.n, 0) <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS leaf_ratio FROM m LEFT JOIN (SELECT domain, spot, count(*) AS n FROM sd WHERE inside GROUP BY 1, 2) k ON m.domain = k.domain AND m.spot = k.spot GROUP BY m.domain), pl AS (SELECT domain, any_value(program) AS program, count(*) AS n, avg(x) AS cx, avg(y) AS cy, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS vxy FROM m JOIN users USING (spot) GROUP BY domain), geo AS (SELECT domain, program, n, cx, cy, internal, boundary, CASE WHEN n > 1 THEN internal / (n * (n - 1) / 2) ELSE 0 END AS density, greatest(0, least(1, 4 * pi() * n / greatest(1.0::DOUBLE, boundary) ** 2)) AS compactness, boundary / greatest(1, boundary + internal) AS boundary_ratio, leaf_ratio, CASE WHEN n < 3 THEN 1 ELSE sqrt(((vx + vy) / 2 + sqrt(((vx - vy) / 2) ** 2 + vxy ** 2) + 1e-12) / (greatest((vx + vy) / 2 - sqrt(((vx - vy) / 2) ** 2 + vxy ** 2), 0) + 1e-12)) END AS elongation FROM pl JOIN ed USING (domain) JOIN lf USING (domain))"
_PROM = ", own AS (SELECT domain, program, max(value) AS peak, avg(value) AS mean FROM m GROUP BY 1, 2), q AS (SELECT sd.domain, quantile_cont(a.value, 0.8) AS q, avg(a.value) AS mo FROM sd JOIN own ON own.domain = sd.domain JOIN active a ON a.program = own.program AND a.spot = sd.v WHERE NOT inside GROUP BY 1), al AS (SELECT program, quantile_cont(value, 0.5) AS q0, avg(value) AS m0 FROM active GROUP BY 1), pr AS (SELECT own.domain, own.program, peak, mean, greatest(0, peak - coalesce(q, q0)) AS prominence, mean / (coalesce(mo, m0) + 1e-8) AS ratio, mean - coalesce(mo, m0) AS delta FROM own LEFT JOIN q ON own.domain = q.domain JOIN al ON own.program = al.program)"
_REL = ", sc AS (SELECT coalesce(quantile_cont(prominence, 0.9), 1) AS s FROM pr WHERE prominence > 0), rel AS (SELECT geo.*, peak, prominence, greatest(0.05, least(1, greatest(0.05, least(1, length(geo.program) / 10)) * sqrt(least(1, prominence / s)) * sqrt(least(1, density / 0.15)))) AS reliability FROM geo JOIN pr ON geo.domain = pr.domain, sc)"
_PAIRS = ", tc AS (SELECT least(a.domain, b.domain) AS i, greatest(a.domain, b.domain) AS j, count(*) AS shared FROM grid g JOIN m a ON g.u = a.spot JOIN m b ON g.v = b.spot WHERE g.u < g.v AND a.domain <> b.domain GROUP BY 1, 2), ov AS (SELECT a.domain AS i, b.domain AS j, count(*) AS overlap FROM m a JOIN m b ON a.spot = b.spot AND a.domain < b.domain GROUP BY 1, 2), pp AS (SELECT coalesce(tc.i, ov.i) AS i, coalesce(tc.j, ov.j) AS j, coalesce(shared, 0) AS shared, coalesce(overlap, 0) AS overlap FROM tc FULL JOIN ov ON tc.i = ov.i AND tc.j = ov.j)"


@query(V.duck("active grid", _MEM + _GEO + " SELECT domain, n, round(cx, 6) AS cx, round(cy, 6) AS cy, internal, boundary, round(density, 6) AS density, round(compactness, 6) AS compactness, round(boundary_ratio, 6) AS boundary_ratio, round(leaf_ratio, 6) AS leaf_ratio, round(least(elongation, 1000), 2) AS elongation FROM geo", True))
def a11_a12_geometry(spark, sf):
    m, g, _ = _members(spark, sf)
    # spots on a line have no width: from 1,000 on the ratio is that of rounding errors
    d = D.geometry(m, g, V.users(spark, sf)).withColumn("elongation", F.least(F.lit(1000.0), "elongation"))
    return d.select("domain", "n", *[r(c).alias(c) for c in ("cx", "cy")], "internal", "boundary", *[r(c).alias(c) for c in ("density", "compactness", "boundary_ratio", "leaf_ratio")], r("elongation", 2).alias("elongation"))


@query(V.duck("active grid", _MEM + _PROM + " SELECT domain, program, round(peak, 6) AS peak, round(mean, 8) AS mean, round(prominence, 8) AS prominence, round(ratio, 8) AS ratio, round(delta, 8) AS delta FROM pr", True))
def a13_prominence(spark, sf):
    m, g, a = _members(spark, sf)
    d = D.prominence(m, a, g)
    return d.select("domain", "program", r("peak").alias("peak"), *[r(c, 8).alias(c) for c in ("mean", "prominence", "ratio", "delta")])


@query(V.duck("active grid", _MEM + _GEO + _PROM + _REL + " SELECT domain, round(reliability, 5) AS reliability FROM rel", True))
def f7_f8_reliability(spark, sf):
    return _domains(spark, sf)[0].select("domain", r("reliability", 5).alias("reliability"))


@query(V.duck("active grid", _MEM + _GEO + _PAIRS + " SELECT i, j, shared, round(overlap / greatest(1, a.n + b.n - overlap), 6) AS spatial_overlap, round(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2), 6) AS distance, shared::DOUBLE AS edge_weight FROM pp JOIN geo a ON a.domain = i JOIN geo b ON b.domain = j", True))
def g12_j9_j10_domain_graph(spark, sf):
    m, g, _ = _members(spark, sf)
    return D.domain_graph(m, g, D.geometry(m, g, V.users(spark, sf))).withColumns({c: r(c) for c in ("spatial_overlap", "distance")})


@query()
def g11_merge_groups(spark, sf):
    """Basins of the watershed, which touch, as domains."""
    a = H.stored(V.active(spark, sf), "active")
    g = H.stored(grid(spark, sf), "grid")
    m = H.watershed(a, g).hint("merge").join(a, ["program", "spot"]).select(F.concat_ws("/", "program", F.col("root").cast("string")).alias("domain"), "program", "spot", "value")
    m = H.stored(m, "basins")
    d = D.geometry(m, g, V.users(spark, sf)).hint("merge").join(D.prominence(m, a, g), "domain")
    return D.merge_groups(d, m, g)


@query(V.duck("active grid", _MEM + ", b AS (SELECT DISTINCT domain, spot FROM sd WHERE NOT inside), n AS (SELECT m.domain, count(b.spot) AS k, count(*) AS n FROM m LEFT JOIN b ON m.domain = b.domain AND m.spot = b.spot GROUP BY 1) SELECT m.domain, m.spot FROM m JOIN n ON m.domain = n.domain LEFT JOIN b ON m.domain = b.domain AND m.spot = b.spot WHERE b.spot IS NOT NULL OR k < least(3, n)", True))
def g13_boundary_spots(spark, sf):
    m, g, _ = _members(spark, sf)
    return D.boundary_spots(m, g)


@query(V.duck("active grid", _MEM + _PAIRS + ", g2 AS (SELECT i, j, shared FROM pp UNION ALL SELECT j, i, shared FROM pp), pg AS (SELECT DISTINCT domain, program FROM m), f AS (SELECT i, count(DISTINCT j) AS neighbours, avg(CASE WHEN a.program <> b.program THEN 1.0::DOUBLE ELSE 0 END) AS mixed, sum(shared) AS b FROM g2 JOIN pg a ON a.domain = i JOIN pg b ON b.domain = j GROUP BY i) SELECT i AS domain, neighbours, round(mixed, 6) AS mixed, round(b / (SELECT max(b) FROM f), 6) AS contact FROM f", True))
def a14_neighbour_features(spark, sf):
    m, g, _ = _members(spark, sf)
    p = D.pairs(m, g)
    return D.neighbour_features(p, m.select("domain", "program").distinct()).withColumns({c: r(c) for c in ("mixed", "contact")})


@query(V.duck("active grid", _MEM + " SELECT spot, min(domain) AS domain, count(*) AS domains FROM m GROUP BY spot", True))
def a28_owners(spark, sf):
    return D.owners(_members(spark, sf)[0])


@query(V.duck("active grid", _MEM + ", z AS (SELECT program, domain, count(*) AS n FROM m GROUP BY 1, 2) SELECT program, count(*) AS domains, count(*) FILTER (n >= 5) AS kept, count(*) FILTER (n < 5) AS rejected, round(max(n) / sum(n), 6) AS largest_share, CASE WHEN count(*) = 1 THEN 'single_domain' WHEN max(n) / sum(n) >= 0.6 THEN 'one_dominant' ELSE 'fragmented' END AS split FROM z GROUP BY program", True))
def a15_a16_program_domains(spark, sf):
    z = _members(spark, sf)[0].groupBy("program", "domain").agg(F.count(F.lit(1)).alias("n"))
    s = z.groupBy("program").agg(F.count(F.lit(1)).alias("domains"), F.count_if(F.col("n") >= 5).alias("kept"), F.count_if(F.col("n") < 5).alias("rejected"), (F.max("n") / F.sum("n")).alias("s"))
    return s.select("program", "domains", "kept", "rejected", r("s").alias("largest_share"), F.when(F.col("domains") == 1, "single_domain").when(F.col("s") >= 0.6, "one_dominant").otherwise("fragmented").alias("split"))


@query(V.duck("active grid", _MEM + ", z AS (SELECT domain, any_value(program) AS program, count(*) AS n FROM m GROUP BY 1) SELECT domain, format('D{:06d}', row_number() OVER (ORDER BY program, n DESC, domain)) AS domain_id FROM z", True))
def w16_domain_ids(spark, sf):
    """Numbers over all domains: ranks inside programs plus the counts of the programs before."""
    from pyspark.sql import Window

    z = _members(spark, sf)[0].groupBy("domain", "program").agg(F.count(F.lit(1)).alias("n"))
    k = z.withColumn("rn", F.row_number().over(Window.partitionBy("program").orderBy(F.desc("n"), "domain")))
    # one row a program stands for all its domains, so the running sum over programs stays small
    p = z.groupBy("program").agg(F.count(F.lit(1)).alias("c")).withColumn("one", F.lit(1))
    base = p.withColumn("base", F.coalesce(F.sum("c").over(Window.partitionBy("one").orderBy("program").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return k.join(base.select("program", "base"), "program").select("domain", F.format_string("D%06d", F.col("base") + F.col("rn")).alias("domain_id"))


_ALPHA = (
    ", pt AS (SELECT DISTINCT m.domain, m.spot, u.x, u.y FROM m JOIN users u ON u.spot = m.spot), pr AS (SELECT a.domain, a.spot AS u, b.spot AS v, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS zy, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2"
    " FROM pt a JOIN pt b ON a.domain = b.domain AND a.spot < b.spot), ci AS (SELECT domain, u, v, s, (ax + bx) / 2 - s * sqrt(greatest(0, 1.07::DOUBLE * 1.07 / d2 - 0.25)) * (zy - ay) AS cx, (ay + zy) / 2 + s * sqrt(greatest(0, 1.07::DOUBLE * 1.07 / d2 - 0.25)) * (bx - ax) AS cy"
    " FROM pr, (VALUES (-1), (1)) t(s) WHERE d2 > 0 AND d2 <= 4 * 1.07 * 1.07), fu AS (SELECT DISTINCT ci.domain, u, v, s FROM ci JOIN pt ON pt.domain = ci.domain AND pt.spot <> u AND pt.spot <> v WHERE (x - cx) ** 2 + (y - cy) ** 2 < 1.07::DOUBLE * 1.07 * (1 - 1e-9))"
    " SELECT domain, u, v FROM ci ANTI JOIN fu USING (domain, u, v, s) GROUP BY domain, u, v HAVING count(*) = 1"
)


@query(V.duck("active grid", _MEM + _ALPHA, True))
def g25_alpha_boundary(spark, sf):
    """The outlines of all domains, triangles of circles up to 1.07 spacings."""
    m, _, _ = _members(spark, sf)
    return D.alpha_boundary(m.select("domain", "spot").distinct().join(V.users(spark, sf), "spot"), 1.07)


def _edges(spark, sf, quantile=0.6, epsilon=1.5):
    d, m, g = _domains(spark, sf, quantile)
    graph = H.stored(D.domain_graph(m, g, d), "graph")
    b = D.boundary_spots(m, g).join(V.users(spark, sf), "spot").withColumnRenamed("domain", "group")
    dist = D.apart(b, g, graph, epsilon)
    return N.edges(graph, d.select("domain", "program", "boundary", "reliability"), dist, epsilon), d


_EDGE = ", gr AS (SELECT i, j, shared, overlap / greatest(1, a.n + b.n - overlap) AS so FROM pp JOIN geo a ON a.domain = i JOIN geo b ON b.domain = j), bb AS (SELECT DISTINCT domain, spot FROM sd WHERE NOT inside), bn AS (SELECT m.domain, count(bb.spot) AS k, count(*) AS n FROM m LEFT JOIN bb ON m.domain = bb.domain AND m.spot = bb.spot GROUP BY 1), bs AS (SELECT m.domain, m.spot, u.x, u.y FROM m JOIN bn ON m.domain = bn.domain LEFT JOIN bb ON m.domain = bb.domain AND m.spot = bb.spot JOIN users u ON m.spot = u.spot WHERE bb.spot IS NOT NULL OR k < least(3, bn.n)), nn AS (SELECT a.domain AS a, b.domain AS b, a.spot, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d2 FROM bs a JOIN bs b ON a.domain <> b.domain GROUP BY 1, 2, 3), nk AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY d2, spot) AS q, count(*) OVER (PARTITION BY a, b) AS n FROM nn), dd AS (SELECT a, b, avg(sqrt(d2)) AS d, min(d2) AS least FROM nk WHERE q <= greatest(3, ceil(0.1 * n)) GROUP BY a, b), di AS (SELECT least(a, b) AS i, greatest(a, b) AS j, min(d) AS distance FROM dd GROUP BY 1, 2 HAVING min(least) <= 4), al2 AS (SELECT i, j, shared, so, 0.0::DOUBLE AS distance FROM gr UNION ALL SELECT di.i, di.j, 0, 0, di.distance FROM di LEFT JOIN gr ON gr.i = di.i AND gr.j = di.j WHERE gr.i IS NULL), e1 AS (SELECT al2.*, a.program AS program_i, b.program AS program_j, so > 0 AS oc, shared >= 1 AND NOT so > 0 AS bc, sqrt(a.reliability * b.reliability) AS er, least(1, shared / greatest(1.0::DOUBLE, least(a.boundary, b.boundary))) AS ratio FROM al2 JOIN rel a ON a.domain = i JOIN rel b ON b.domain = j), e2 AS (SELECT *, NOT oc AND NOT bc AND distance <= 1.5 AS pc, 0.5::DOUBLE + 0.5::DOUBLE * er AS f FROM e1), e3 AS (SELECT *, ratio / (ratio + 0.25) * f AS contact, so * f AS overlap, CASE WHEN pc THEN (1.5 - distance) / 1.5 * f ELSE 0 END AS soft FROM e2 WHERE oc OR bc OR pc), e4 AS (SELECT *, (contact + 2 * overlap + soft) / 4 AS es FROM e3), th AS (SELECT greatest(0.08, quantile_cont(contact, 0.8) FILTER (bc AND contact > 0)) AS tc, greatest(0.08, quantile_cont(overlap, 0.8) FILTER (oc)) AS tov FROM e4), ie AS (SELECT e4.*, (bc AND contact >= tc) OR (oc AND overlap >= tov) AS st FROM e4, th)"


@query(V.duck("active grid", _MEM + _GEO + _PROM + _REL + _PAIRS + _EDGE + " SELECT i, j, program_i, program_j, bc AS boundary_contact, oc AS overlap_contact, pc AS proximity_contact, round(er, 5) AS edge_reliability, round(es, 5) AS edge_strength, st AS is_strong FROM ie", True))
def g14_f5_interaction_edges(spark, sf):
    e, _ = _edges(spark, sf)
    return e.withColumns({"edge_reliability": r("edge_reliability", 5), "edge_strength": r("edge_strength", 5)})


@query()
def g15_w9_seeds(spark, sf):
    e = H.stored(N.prepared(_edges(spark, sf)[0]), "prepared")
    return N.seeds(e).select("component", "edge_key", r("seed_score").alias("seed_score"), "seed_rank")


def _structures(spark, sf):
    e = H.stored(N.prepared(_edges(spark, sf)[0]), "prepared")
    return e, H.stored(N.structures(e, H.stored(N.seeds(e), "seeds")), "structures")


@query()
def g16_g20_niches(spark, sf):
    """Backbones, members, the basic filter and near copies, end to end."""
    s = N.deduplicate(H.stored(N.basic_filter(_structures(spark, sf)[1]), "filtered"), ["component"])
    return s.select(
        "component", "pattern", "member_count", "backbone_count", "program_count", "pairs", "cross_edges", "strong_edges", r("contact_fraction").alias("contact_fraction"), r("overlap_fraction").alias("overlap_fraction"),
        r("proximity_fraction").alias("proximity_fraction"), "seed_keys", "context_nodes", "region_edges", "consistent_edges", r("confidence").alias("confidence"), "fail_reason", "passed",
    )


@query()
def g19_memberships(spark, sf):
    """The members of all structures, and how each came in."""
    return N.memberships(_structures(spark, sf)[1])


@query()
def b2_random_baseline(spark, sf):
    """Structures, and how often 24 rearranged graphs have one alike; all of them, as few of these tables' pass the filter."""
    e, s = _structures(spark, sf)
    return N.random_baseline(e, s, every=True).select("component", "pattern", r("random_rate").alias("random_rate"), r("non_random_score").alias("non_random_score"), "random_passed")


@query()
def b2_null_model(spark, sf):
    e = H.stored(N.prepared(_edges(spark, sf)[0]), "prepared")
    return N.shuffled(e, 7).groupBy("pair_key").agg(F.count(F.lit(1)).alias("n"))


@query(V.duck("active grid", _MEM + ", mem AS (SELECT 'N' || (spot % 5)::VARCHAR AS niche, domain FROM (SELECT domain, any_value(program) AS program, min(spot) AS spot FROM m GROUP BY 1)), ov AS (SELECT a.domain AS i, b.domain AS j, count(*) AS overlap FROM m a JOIN m b ON a.spot = b.spot AND a.domain < b.domain GROUP BY 1, 2) SELECT a.niche, count(*) AS edges, sum(overlap)::BIGINT AS overlap FROM ov JOIN mem a ON a.domain = i JOIN mem b ON b.domain = j AND a.niche = b.niche GROUP BY 1", True))
def j7_internal_edges(spark, sf):
    m, _, _ = _members(spark, sf)
    mem = m.groupBy("domain").agg(F.min("spot").alias("s")).select(F.concat(F.lit("N"), (F.col("s") % 5).cast("string")).alias("niche"), "domain")
    ov = m.select(F.col("domain").alias("i"), "spot").join(m.select(F.col("domain").alias("j"), "spot"), "spot").where("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("overlap"))
    both = ov.join(mem.withColumnRenamed("domain", "i"), "i").join(mem.withColumnRenamed("domain", "j"), ["j", "niche"])
    return both.groupBy("niche").agg(F.count(F.lit(1)).alias("edges"), F.sum("overlap").alias("overlap"))


