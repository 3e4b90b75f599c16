"""Registered queries over sources, joins, profiles, comparisons and catalogues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import stats as S
from tessera.operators import profiles as C
from tessera.plans.basic import r
from tessera.sources import tables as T
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


_EV = "SELECT p_brand AS object, p_partkey % 5 AS sample_no, least(1, p_size / 60.0::DOUBLE) AS coverage, (p_partkey % 17) / 17.0::DOUBLE AS hotspot, (p_partkey % 13) / 13.0::DOUBLE AS peakiness, (p_partkey % 11) / 11.0::DOUBLE AS entropy, (p_partkey % 7) / 7.0::DOUBLE AS main, (p_partkey % 5) / 5.0::DOUBLE AS boundary, (p_partkey % 3) / 3.0::DOUBLE AS purity, (p_partkey % 19) / 19.0::DOUBLE AS density, p_partkey FROM part"


def _evidence(spark, sf):
    k = F.col("p_partkey")
    part = lambda n: (k % n) / float(n)
    return V.load(spark, sf, "part").select(F.col("p_brand").alias("object"), (k % 5).alias("sample_no"), F.least(F.lit(1.0), F.col("p_size") / 60.0).alias("coverage"), part(17).alias("hotspot"), part(13).alias("peakiness"), part(11).alias("entropy"), part(7).alias("main"), part(5).alias("boundary"), part(3).alias("purity"), part(19).alias("density"), "p_partkey")


_TRI = lambda x, a, b, c: f"CASE WHEN {x} <= {a} OR {x} >= {c} THEN 0 WHEN {x} <= {b} THEN ({x} - {a}) / ({b}::DOUBLE - {a}) ELSE ({c} - {x}) / ({c}::DOUBLE - {b}) END"
_ROLE = f"WITH ev AS ({_EV}), a AS (SELECT *, 1 - exp(-coverage / 0.18) AS broad, 0.6 * hotspot + 0.4 * peakiness AS high, {_TRI('coverage', 0.03, 0.15, 0.42)} AS moderate, least(boundary, 1 - purity) AS core FROM ev), b AS (SELECT *, greatest(0, least(1, 0.70 * core + 0.30 * (0.65 * moderate + 0.35 * ({_TRI('hotspot', 0.18, 0.42, 0.72)})) - 0.20 * greatest(broad, high))) AS interface_like, greatest(0, least(1, 0.35 * broad + 0.25 * entropy + 0.20 * (1 - hotspot) + 0.20 * density)) AS scaffold_like, greatest(0, least(1, 0.35 * high + 0.25 * peakiness + 0.20 * exp(-coverage / 0.12) + 0.20 * main)) AS node_like FROM a), ro AS (SELECT *, greatest(0, least(1, 0.35 * moderate + 0.20 * ({_TRI('hotspot', 0.10, 0.32, 0.58)}) + 0.25 * (1 - greatest(peakiness, hotspot)) + 0.20 * (1 - greatest(interface_like, node_like)))) AS companion_like FROM b)"


@query(_ROLE + " SELECT p_partkey, round(interface_like, 6) AS interface_like, round(scaffold_like, 6) AS scaffold_like, round(node_like, 6) AS node_like, round(companion_like, 6) AS companion_like FROM ro")
def r11_role_scores(spark, sf):
    return C.role_scores(_evidence(spark, sf)).select("p_partkey", *[r(c).alias(c) for c in C.ROLES])


@query(_ROLE + ", lg AS (UNPIVOT (SELECT sample_no AS sample, p_partkey AS object, coverage + 0.1 AS mass, 0.2 + 0.8 * entropy AS confidence, interface_like, scaffold_like, node_like, companion_like FROM ro) ON interface_like, scaffold_like, node_like, companion_like INTO NAME axis VALUE score), tt AS (SELECT sample, sum(mass) / 4 AS m, sum(mass * confidence) / 4 AS mc FROM lg GROUP BY sample) SELECT sample, axis, round(sum(score * mass / m * CASE WHEN axis = 'node_like' THEN 0.72 ELSE 1 END), 6) AS burden, round(sum(score * mass * confidence / mc * CASE WHEN axis = 'node_like' THEN 0.72 ELSE 1 END), 6) AS weighted FROM lg JOIN tt USING (sample) GROUP BY 1, 2")
def a9_a10_burden(spark, sf):
    p = C.role_scores(_evidence(spark, sf)).withColumn("sample", F.col("sample_no")).withColumn("object", F.col("p_partkey"))
    scores = p.unpivot(["sample", "object"], list(C.ROLES), "axis", "score")
    w = p.select("sample", "object", (F.col("coverage") + 0.1).alias("mass"), (0.2 + 0.8 * F.col("entropy")).alias("confidence"))
    return C.burden(scores, w).withColumns({c: r(c) for c in ("burden", "weighted")})


@query("WITH rk AS (SELECT p_type AS object, p_name AS gene, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_name) AS rank FROM part GROUP BY 1, 2), ax AS (SELECT DISTINCT p_brand AS axis, p_name AS gene FROM part WHERE p_size <= 6), sz AS (SELECT axis, least(20, count(*)) AS most FROM ax GROUP BY 1), bs AS (SELECT object, axis, greatest(0, least(1, sum((20 - rank + 1) / 20) / any_value(most))) AS base FROM rk JOIN ax USING (gene) JOIN sz USING (axis) WHERE rank <= 20 GROUP BY 1, 2), pk AS (SELECT a.*, coalesce((SELECT max(b.base) FROM bs b WHERE b.object = a.object AND b.axis <> a.axis), 0) AS peer FROM bs a) SELECT object, axis, round(base, 6) AS base, round(greatest(0, least(1, base - 0.3 * greatest(0, least(1, (base - 0.2) / 0.8)) * greatest(0, least(1, (peer - 0.2) / 0.8)))), 6) AS score FROM pk")
def r10_component_scores(spark, sf):
    p = V.load(spark, sf, "part")
    n = p.groupBy(F.col("p_type").alias("object"), F.col("p_name").alias("gene")).agg(F.count(F.lit(1)).alias("n"))
    ranked = S.top_k(n, ["object"], [F.desc("n"), "gene"], 20)
    axes = p.where("p_size <= 6").select(F.col("p_brand").alias("axis"), F.col("p_name").alias("gene")).distinct()
    return C.component_scores(ranked, axes).withColumns({c: r(c) for c in ("base", "score")})


@query(f"WITH ev AS ({_EV}), n AS (SELECT p_partkey, hotspot, peakiness, entropy, main, boundary, purity, density, (main >= 0.25)::INT + (boundary >= 0.20)::INT + (purity >= 0.25)::INT AS sources FROM ev) SELECT p_partkey, round(greatest(0, least(1, (0.30 * hotspot + 0.20 * peakiness + 0.15 * entropy + 0.15 * main + 0.10 * purity + 0.05 * boundary + 0.05 * density) * CASE sources WHEN 0 THEN 0.35 WHEN 1 THEN 0.70 ELSE 1 END)), 6) AS confidence, sources = 0 OR (sources = 1 AND density < 0.45) AS low_information FROM n")
def r12_profile_confidence(spark, sf):
    e = _evidence(spark, sf).selectExpr("p_partkey", "hotspot AS program_confidence", "peakiness AS evidence", "entropy AS support", "main AS gene_depth", "boundary AS annotation_depth", "purity AS topology_depth", "density AS axis_strength")
    return C.confidence(e).select("p_partkey", r("confidence").alias("confidence"), "low_information")


_PROF = "SELECT 'S' || (s_nationkey % 4) AS sample, s_name AS object, [(s_suppkey % 7) / 7.0::DOUBLE, (s_suppkey % 5) / 5.0::DOUBLE, (s_suppkey % 3) / 3.0::DOUBLE] AS c, [(s_suppkey % 11) / 11.0::DOUBLE, (s_suppkey % 2) / 2.0::DOUBLE] AS o, least(1, greatest(0.1, s_acctbal / 10000)) AS conf FROM supplier"
_SIMS = lambda x, n: f"greatest(0, least(1, 1 - ({' + '.join(f'abs(a.{x}[{k}] - b.{x}[{k}])' for k in range(1, n + 1))}) / {n}))"
_CMP = f"WITH pf AS ({_PROF}), pr AS (SELECT a.sample AS sample_a, a.object AS object_a, b.sample AS sample_b, b.object AS object_b, round({_SIMS('c', 3)}, 9) AS cs, round({_SIMS('o', 2)}, 9) AS rs, sqrt(a.conf * b.conf) AS cf FROM pf a JOIN pf b ON a.sample <> b.sample), sm AS (SELECT *, round(greatest(0, least(1, (0.65::DOUBLE * cs + 0.35::DOUBLE * rs) * cf)), 9) AS similarity FROM pr), rk AS (SELECT *, row_number() OVER (PARTITION BY sample_a, object_a ORDER BY similarity DESC, cs DESC, rs DESC, sample_b, object_b) AS rank_a, row_number() OVER (PARTITION BY sample_b, object_b ORDER BY similarity DESC, cs DESC, rs DESC, sample_a, object_a) AS rank_b FROM sm)"


def _profiles(spark, sf):
    k = F.col("s_suppkey")
    return V.load(spark, sf, "supplier").select(F.concat(F.lit("S"), (F.col("s_nationkey") % 4).cast("string")).alias("sample"), F.col("s_name").alias("object"), F.array((k % 7) / 7.0, (k % 5) / 5.0, (k % 3) / 3.0).alias("component"), F.array((k % 11) / 11.0, (k % 2) / 2.0).alias("role"), F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.col("s_acctbal") / 10000)).alias("confidence"))


@query(_CMP + " SELECT sample_a, object_a, sample_b, object_b, round(similarity, 6) AS similarity, round(cs, 6) AS component_similarity, round(rs, 6) AS role_similarity, rank_a, rank_b FROM rk WHERE rank_a <= 3")
def j14_j15_w8_comparable(spark, sf):
    return C.comparable(_profiles(spark, sf), 3).withColumns({c: r(c) for c in ("similarity", "component_similarity", "role_similarity")})


@query(_CMP + ", th AS (SELECT *, row_number() OVER (PARTITION BY sample_a, sample_b ORDER BY similarity DESC, object_a, object_b) AS i FROM rk WHERE rank_a <= 3), sc AS (SELECT sample_a, sample_b, round(0.6 * avg(similarity) + 0.4 * max(similarity), 9) AS score FROM th WHERE i <= 3 GROUP BY 1, 2) SELECT sample_a, sample_b, round(score, 6) AS score, row_number() OVER (PARTITION BY sample_a ORDER BY score DESC, sample_b) AS rank FROM sc")
def r15_w17_nearest_samples(spark, sf):
    return C.nearest_samples(C.comparable(_profiles(spark, sf), 3)).withColumn("score", r("score"))


@query("WITH o AS (SELECT c_nationkey % 5 AS sample, 'C' || c_custkey AS object, c_mktsegment || '__' || (c_custkey % 40) AS pattern, c_acctbal / 10000 AS share FROM customer) SELECT pattern, count(DISTINCT sample) AS samples, count(*) AS objects, CASE WHEN count(DISTINCT sample) >= 3 THEN 'stable_recurrent' WHEN count(DISTINCT sample) >= 2 THEN 'conditional_variant' ELSE 'sample_specific' END AS stability, array_to_string(list_sort(list(DISTINCT object))[1:5], ',') AS representatives, round(avg(share), 10) AS share FROM o GROUP BY pattern")
def a18_catalogue(spark, sf):
    c = V.load(spark, sf, "customer")
    o = c.select((F.col("c_nationkey") % 5).alias("sample"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("object"), F.concat_ws("__", "c_mktsegment", (F.col("c_custkey") % 40).cast("string")).alias("pattern"), (F.col("c_acctbal") / 10000).alias("share"))
    return C.catalogue(o, 5).withColumn("share", r("share", 10))


_CH = "WITH mb AS (SELECT DISTINCT o_orderstatus AS sample, o_orderpriority AS program, 'D' || (o_custkey % 30) AS domain, 'N' || (o_custkey % 9) AS niche FROM orders)"


@query(_CH + " SELECT program || '__' || 'd' || (substr(domain, 2)::INT % 4) || '__' || 'n' || (substr(niche, 2)::INT % 3) AS chain, count(DISTINCT sample) AS samples, count(*) AS objects FROM mb GROUP BY 1 HAVING count(DISTINCT sample) >= 2 AND count(*) >= 5")
def j16_a19_chains(spark, sf):
    m = V.load(spark, sf, "orders").select(F.col("o_orderstatus").alias("sample"), F.col("o_orderpriority").alias("program"), F.concat(F.lit("D"), (F.col("o_custkey") % 30).cast("string")).alias("domain"), F.concat(F.lit("N"), (F.col("o_custkey") % 9).cast("string")).alias("niche")).distinct()
    number = lambda c, n: (F.substring(c, 2, 9).cast("int") % n).cast("string")
    programs = m.select("sample", "program").distinct().withColumn("program_pattern", F.col("program"))
    domains = m.select("sample", "domain").distinct().withColumn("domain_pattern", F.concat(F.lit("d"), number("domain", 4)))
    niches = m.select("sample", "niche").distinct().withColumn("niche_pattern", F.concat(F.lit("n"), number("niche", 3)))
    return C.chains(m, programs, domains, niches)


@query("WITH v AS (SELECT c_nationkey AS object, c_mktsegment AS axis, sum(greatest(0, c_acctbal)) AS value FROM customer GROUP BY 1, 2), p AS (SELECT *, value / sum(value) OVER (PARTITION BY object) AS p FROM v), k AS (SELECT *, row_number() OVER (PARTITION BY object ORDER BY p DESC, axis DESC) AS i, max(p) OVER (PARTITION BY object) AS m FROM p) SELECT object, string_agg(axis || ':' || CASE WHEN p >= 0.45 THEN 'major' ELSE 'support' END, '+' ORDER BY axis) AS signature FROM k WHERE p >= 0.20 OR (i = 1 AND m < 0.20) GROUP BY object")
def f16_signatures(spark, sf):
    v = V.load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("object"), F.col("c_mktsegment").alias("axis")).agg(F.sum(F.greatest(F.lit(0.0), "c_acctbal")).alias("value"))
    return C.reduced_signature(v)


@query(f"WITH ev AS ({_EV}) SELECT p_partkey, CASE WHEN hotspot >= 0.65 THEN 'block' WHEN p_partkey % 9 >= 5 AND hotspot < 0.35 THEN 'fragmented' ELSE 'mixed' END AS block, CASE WHEN boundary >= 0.5 AND purity < 0.35 THEN 'boundary' WHEN purity >= 0.35 THEN 'mixed_neighbor' ELSE 'neutral' END AS boundary, CASE WHEN main >= 0.65 OR p_partkey % 6 >= 4 THEN 'bridge_prone' WHEN main >= 0.30 OR (p_partkey % 6 >= 2 AND entropy >= 0.35) THEN 'bridge_capable' ELSE 'non_bridge' END AS bridge FROM ev")
def f17_deployment_states(spark, sf):
    e, c = _evidence(spark, sf), F.col
    return e.select("p_partkey", C.block_state(c("p_partkey") % 9, c("hotspot")).alias("block"), C.boundary_state(c("boundary"), c("purity")).alias("boundary"), C.bridge_state(c("main"), c("p_partkey") % 6, c("entropy")).alias("bridge"))


_PCT = lambda c: f"(rank() OVER (PARTITION BY program ORDER BY {c}) + (count(*) OVER (PARTITION BY program, {c}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY program)"


@query(f"WITH d AS (SELECT c_custkey AS domain, c_nationkey AS program, c_acctbal AS peak, c_custkey % 10 AS prominence, c_custkey % 7 AS mean FROM customer), s AS (SELECT domain, 0.4 * {_PCT('peak')} + 0.4 * {_PCT('prominence')} + 0.2 * {_PCT('mean')} AS score FROM d) SELECT domain, round(score, 10) AS score, CASE WHEN round(score, 12) >= 0.67 THEN 'strong' WHEN round(score, 12) < 0.33 THEN 'weak' ELSE 'moderate' END AS label FROM s")
def w12_salience(spark, sf):
    d = V.load(spark, sf, "customer").select(F.col("c_custkey").alias("domain"), F.col("c_nationkey").alias("program"), F.col("c_acctbal").alias("peak"), (F.col("c_custkey") % 10).alias("prominence"), (F.col("c_custkey") % 7).alias("mean"))
    return C.salience(d).withColumn("score", r("score", 10))


@query("WITH f AS (SELECT event_type AS t, user_id % 3 AS sample FROM events), k AS (SELECT 'program' AS level, CASE WHEN count(DISTINCT sample) >= 3 THEN 'stable_recurrent' WHEN count(DISTINCT sample) >= 2 THEN 'conditional_variant' ELSE 'sample_specific' END AS stability FROM f GROUP BY t), g AS (SELECT * FROM (VALUES ('program'), ('niche')) a(level), (VALUES ('stable_recurrent'), ('conditional_variant'), ('sample_specific')) b(stability)) SELECT g.level, g.stability, count(k.level) AS n FROM g LEFT JOIN k ON g.level = k.level AND g.stability = k.stability GROUP BY 1, 2")
def r18_triage_grid(spark, sf):
    f = V.load(spark, sf, "events").groupBy("event_type").agg(F.count_distinct(F.col("user_id") % 3).alias("n"))
    return C.triage_grid(f.select(F.lit("program").alias("level"), C.stability_class(F.col("n"), 3).alias("stability")), ("program", "niche"))


@query(V.duck("spots", ", mb AS (SELECT DISTINCT o_custkey AS spot, o_orderstatus AS domain FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus <> 'F') SELECT s.spot, x, y, coalesce(domain, '') AS domain, CASE WHEN domain IS NULL THEN 'background' WHEN domain = 'O' THEN 'open' ELSE 'unlabelled' END AS label FROM spots s LEFT JOIN mb ON s.spot = mb.spot"))
def j17_r21_viewer(spark, sf):
    m = V.load(spark, sf, "orders").where("o_orderpriority LIKE '1%' AND o_orderstatus <> 'F'").select(F.col("o_custkey").alias("spot"), F.col("o_orderstatus").alias("domain")).distinct()
    labels = spark.sql("SELECT 'O' AS domain, 'open' AS label")
    return C.viewer(V.spots(spark, sf), m, labels)


@query("SELECT p_brand AS term, any_value('d') AS description, array_to_string(list_sort(list(DISTINCT upper(p_name))), ',') AS genes FROM part WHERE p_size <= 10 GROUP BY 1")
def s5_gene_set_text(spark, sf):
    """Gene sets written as text lines and parsed back."""
    p = V.gene_sets(spark, sf).groupBy("term").agg(F.concat_ws("\t", F.first("term"), F.lit("d"), F.array_join(F.collect_list("gene"), "\t")).alias("value"))
    return T.gene_sets(p.select("value", F.lit(1).alias("pos"))).select("term", "description", F.array_join(F.array_sort("genes"), ",").alias("genes"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def s9_j1_j5_semi_joins(spark, sf):
    c = V.load(spark, sf, "customer")
    allow = spark.sql("SELECT explode(array('BUILDING', 'MACHINERY')) AS c_mktsegment")
    kept = T.allowed(c, "c_mktsegment", allow)
    return T.one_to_one(kept.withColumnRenamed("c_nationkey", "n_nationkey"), V.load(spark, sf, "nation"), "n_nationkey").select("c_custkey", "n_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def j6_anti_join(spark, sf):
    o = V.load(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return V.load(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("WITH a AS (SELECT n_nationkey AS k, n_name AS name, 1 AS x FROM nation WHERE n_nationkey < 15), b AS (SELECT n_nationkey AS k, 'right' AS name FROM nation WHERE n_nationkey >= 10) SELECT coalesce(a.k, b.k) AS k, x, b.name FROM a FULL JOIN b ON a.k = b.k")
def j2_j3_overriding_merge(spark, sf):
    n = V.load(spark, sf, "nation")
    a = n.where("n_nationkey < 15").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.lit(1).alias("x"))
    return T.overriding(a, n.where("n_nationkey >= 10").select(F.col("n_nationkey").alias("k"), F.lit("right").alias("name")), "k")


@query("WITH s AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 8000) SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT * FROM s) OR l_partkey IN (SELECT * FROM s)")
def j8_either_end(spark, sf):
    li = V.load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    s = V.load(spark, sf, "supplier").where("s_acctbal > 8000").select("s_suppkey")
    ends = [li.join(s, F.col(c) == F.col("s_suppkey"), "left_semi") for c in ("l_suppkey", "l_partkey")]
    return ends[0].unionByName(ends[1]).select("l_orderkey", "l_linenumber").distinct()


@query(V.duck("expression", " SELECT count(*) AS rows, count(*) FILTER (value IS NULL OR isnan(value)) AS not_finite, count(*) FILTER (value < 0) AS negative, count(*) FILTER (value <> floor(value)) AS not_whole, count(*) FILTER (gene IS NULL OR gene = '') AS no_gene FROM expression"))
def s1_expectations(spark, sf):
    return T.expectations(V.expression(spark, sf))


@query("WITH m AS (SELECT o_custkey AS k, o_orderpriority AS axis, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT k, axis AS anchor, round(v, 2) AS v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(v, 2) DESC, axis) AS i FROM m) WHERE i = 1")
def w13_w14_leading_anchor(spark, sf):
    m = V.load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("axis")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return S.top_k(m, ["k"], [F.desc("v"), "axis"], 1, "i").select("k", F.col("axis").alias("anchor"), "v")


@query("WITH t AS (SELECT c_nationkey AS k, list_sort(list(DISTINCT c_mktsegment)) AS a FROM customer WHERE c_acctbal > 0 GROUP BY 1), u AS (SELECT s_nationkey AS k, list(DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END) AS b FROM supplier GROUP BY 1) SELECT k, array_to_string(list_filter(a, lambda x: list_contains(b, x)), ',') AS shared FROM t JOIN u USING (k)")
def u4_shared_axes(spark, sf):
    t = V.load(spark, sf, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias("a"))
    u = V.load(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.collect_set(F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY")).alias("b"))
    return t.join(u, "k").select("k", F.array_join(F.filter("a", lambda x: F.array_contains("b", x)), ",").alias("shared"))


@query("SELECT r_name, count(*) AS customers, mode(c_mktsegment ORDER BY c_mktsegment) IS NOT NULL AS has_mode, round(avg(c_acctbal), 3) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def r16_r20_section_summary(spark, sf):
    c, n, g = (V.load(spark, sf, t) for t in ("customer", "nation", "region"))
    j = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(g), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.count(F.lit(1)).alias("customers"), F.mode("c_mktsegment").isNotNull().alias("has_mode"), F.round(F.avg("c_acctbal"), 3).alias("mean"))


@query()
def m13_clusters(spark, sf):
    """K-means with the best of several seeds; labels in the order of their first member."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = V.load(spark, sf, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features")).cache()
    best = min((KMeans(k=5, seed=s, maxIter=15).fit(e) for s in range(3)), key=lambda m: m.summary.trainingCost)
    got = best.transform(e).select("vec_id", F.col("prediction").alias("p"))
    first = got.groupBy("p").agg(F.min("vec_id").alias("m"), F.count(F.lit(1)).alias("n"))
    names = first.withColumn("one", F.lit(1)).withColumn("label", F.row_number().over(Window.partitionBy("one").orderBy("m")))  # five rows
    return got.join(F.broadcast(names), "p").select("vec_id", "label", "n")
