"""Registered queries over labels, texts and ontologies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators import annotate as A
from tessera.plans.basic import r
from tessera.plans.cohort import _EV, _evidence
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


@query(f"WITH ev AS ({_EV}), h AS (SELECT p_partkey, list_filter([CASE WHEN p_partkey % 6 >= 5 THEN 'fragmented' END, CASE WHEN hotspot >= 0.9 OR peakiness >= 0.9 THEN 'branching' END, CASE WHEN 4 * entropy >= 2.5 THEN 'elongated' END, CASE WHEN main <= 0.3 AND (boundary >= 0.6 OR purity <= 0.2) THEN 'diffuse' END], lambda x: x IS NOT NULL) AS h FROM ev) SELECT p_partkey, coalesce(h[1], 'compact') AS morphology, array_to_string(h, '|') AS hits FROM h")
def f17_morphology(spark, sf):
    s = _evidence(spark, sf).selectExpr("p_partkey", "CASE WHEN p_partkey % 6 >= 5 THEN 2 ELSE 1 END AS components", "hotspot AS leaf_ratio", "peakiness AS articulation", "4 * entropy AS elongation", "boundary AS boundary_ratio", "main AS density", "purity AS compactness")
    return A.morphology(s, leaf=0.9, cut=0.9).select("p_partkey", "morphology", "hits")


@query("WITH t AS (SELECT p_brand AS program, p_type AS term, sum(p_size)::DOUBLE AS score FROM part GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY program ORDER BY score DESC, term) AS i FROM t), n AS (SELECT program, string_agg(term, '|' ORDER BY i) AS terms, max(score) AS best FROM k WHERE i <= 3 GROUP BY 1), d AS (SELECT c_custkey AS domain, 'Brand#' || (c_nationkey + 3) AS program FROM customer) SELECT domain, coalesce(terms, 'unannotated') AS terms, coalesce(best, 0) AS best FROM d LEFT JOIN n USING (program)")
def r7_propagated_terms(spark, sf):
    t = V.load(spark, sf, "part").groupBy(F.col("p_brand").alias("program"), F.col("p_type").alias("term")).agg(F.sum("p_size").cast("double").alias("score"))
    d = V.load(spark, sf, "customer").select(F.col("c_custkey").alias("domain"), F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 3).cast("string")).alias("program"))
    return A.propagated_terms(d, t)


_IF = "WITH m AS (SELECT c_nationkey AS niche, c_custkey AS domain, c_mktsegment AS label FROM customer), e AS (SELECT c_custkey AS i, c_custkey + s AS j, 1.0::DOUBLE + s AS strength FROM customer, (VALUES (1), (5), (9), (25)) t(s)), k AS (SELECT a.niche, least(a.label, b.label) || ' - ' || greatest(a.label, b.label) AS interface, count(*) AS n, sum(strength) AS strength FROM e JOIN m a ON a.domain = i JOIN m b ON b.domain = j AND b.niche = a.niche GROUP BY 1, 2)"


@query(_IF + " SELECT niche, interface, n, strength, round(strength / sum(strength) OVER (PARTITION BY niche), 8) AS share FROM k")
def r8_interfaces(spark, sf):
    c = V.load(spark, sf, "customer")
    m = c.select(F.col("c_nationkey").alias("niche"), F.col("c_custkey").alias("domain"), F.col("c_mktsegment").alias("label"))
    e = c.select(F.col("c_custkey").alias("i"), F.explode(F.array(*[F.lit(s) for s in (1, 5, 9, 25)])).alias("s")).select("i", (F.col("i") + F.col("s")).alias("j"), (1.0 + F.col("s")).alias("strength"))
    return A.interfaces(e, m).withColumn("share", r("share", 8))


@query("WITH n AS (SELECT c_nationkey AS k, c_mktsegment AS l, count(*) AS n FROM customer GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY k) AS p, row_number() OVER (PARTITION BY k ORDER BY n DESC, l) AS i FROM n) SELECT k, string_agg(l, ';' ORDER BY i) AS labels FROM p WHERE i <= 3 GROUP BY k")
def r8_composition(spark, sf):
    v = V.load(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("l"))
    t = A.composition(v, "k", "l")
    return t.select("k", F.array_join(F.transform(F.split("text", ";"), lambda x: F.split(x, ":")[0]), ";").alias("labels"))


@query("WITH g AS (SELECT p_name AS gene, count(DISTINCT p_brand) / 25 AS support_share FROM part GROUP BY 1), w AS (SELECT p_type AS program, p_name AS gene, count(*)::DOUBLE AS weight FROM part GROUP BY 1, 2), s AS (SELECT program, sum(CASE WHEN regexp_matches(upper(gene), '^(A|B|C)') THEN weight ELSE 0 END) / sum(weight) AS b, sum(CASE WHEN support_share >= 0.8 THEN weight ELSE 0 END) / sum(weight) AS h FROM w JOIN g USING (gene) GROUP BY 1) SELECT program, round(b, 8) AS blacklist_share, round(h, 8) AS housekeeping_share, array_to_string(list_filter([CASE WHEN b >= 0.3 THEN 'blacklist' END, CASE WHEN h >= 0.3 THEN 'housekeeping' END], lambda x: x IS NOT NULL), '|') AS flags FROM s")
def m11_confounders(spark, sf):
    p = V.load(spark, sf, "part")
    g = p.groupBy(F.col("p_name").alias("gene")).agg((F.count_distinct("p_brand") / 25).alias("support_share"))
    w = p.groupBy(F.col("p_type").alias("program"), F.col("p_name").alias("gene")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return A.confounders(w, g, F.upper("gene").rlike("^(A|B|C)")).withColumns({c: r(c, 8) for c in ("blacklist_share", "housekeeping_share")})


_TREE = "WITH RECURSIVE p AS (SELECT s_suppkey AS term, s_suppkey // 3 AS parent FROM supplier WHERE s_suppkey > 0 UNION SELECT s_suppkey, s_suppkey // 7 FROM supplier WHERE s_suppkey > 6), a(term, ancestor) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT a.term, p.parent FROM a JOIN p ON a.ancestor = p.term)"


def _ancestors(spark, sf):
    s = V.load(spark, sf, "supplier").select(F.col("s_suppkey").alias("term"))
    up = lambda n: F.floor(F.col("term") / n).cast("long").alias("parent")
    return A.ancestors(s.where("term > 0").select("term", up(3)).unionByName(s.where("term > 6").select("term", up(7))).distinct())


@query(_TREE + " SELECT term, count(*) AS n, sum(ancestor)::BIGINT AS total FROM a GROUP BY term")
def g26_ancestors(spark, sf):
    return _ancestors(spark, sf).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("ancestor").alias("total"))


@query()
def g26_linked_terms(spark, sf):
    """Terms by the Jaccard of their ancestors, grouped by average linkage."""
    a = _ancestors(spark, sf)
    sets = a.select(F.concat(F.lit("s"), (F.col("term") % 4).cast("string")).alias("source"), F.col("term").cast("string").alias("term"), F.col("ancestor").alias("item"))
    return A.linked(sets, 0.6)


@query("WITH c AS (SELECT label, list_transform(range(1, 65), lambda i: avg(embedding[i]::DOUBLE)) AS m FROM embeddings GROUP BY label) SELECT 1 AS x FROM c LIMIT 1")
def m15_scaling(spark, sf):
    e = V.load(spark, sf, "embeddings")
    c = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    d = c.alias("x").join(c.alias("y"), "i").where("x.label < y.label").groupBy(F.col("x.label").alias("a"), F.col("y.label").alias("b")).agg(F.sqrt(F.sum(F.pow(F.col("x.v") - F.col("y.v"), 2))).alias("d"))
    return spark.createDataFrame([(int(n), round(x, 4), round(y, 4)) for n, x, y in A.scaling(d)], "label int, x double, y double")


ORACLE.pop("m15_scaling")


@query("SELECT page_id, length(trim(regexp_replace(regexp_replace(lower(url), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS n, least(1, (contains(lower(html), '<p')::INT + contains(lower(html), '<script')::INT + contains(lower(html), '<nav')::INT) / 2.0::DOUBLE) AS score FROM pages")
def f9_f10_text_scores(spark, sf):
    p = V.load(spark, sf, "pages")
    return p.select("page_id", F.length(X.text_token("url")).alias("n"), X.keyword_score(F.lower("html"), ["<p", "<script", "<nav"], 2).alias("score"))


@query("WITH g AS (SELECT p_brand AS program, list(p_name ORDER BY n DESC, p_name)[1:20] AS genes FROM (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1) SELECT program, round(list_sum(list_transform(['alpha', 'blue', 'green', 'red'], lambda m: CASE WHEN list_position(genes, m) > 0 THEN (20 - list_position(genes, m) + 1) / 20 ELSE 0 END)) / 4, 8) AS score FROM g")
def f11_marker_rank(spark, sf):
    n = V.load(spark, sf, "part").groupBy("p_brand", "p_name").agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy(F.col("p_brand").alias("program")).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "p_name"))), lambda x: x["p_name"]), 1, 20).alias("genes"))
    return g.select("program", r(X.marker_rank_score("genes", ["alpha", "blue", "green", "red"], 20), 8).alias("score"))


@query("SELECT c_nationkey AS k, '{' || string_agg('\"' || s || '\":' || n, ',' ORDER BY s) || '}' AS json FROM (SELECT c_nationkey, c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1")
def f18_sorted_json(spark, sf):
    n = V.load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("k").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n"))))).alias("json"))


@query("WITH t AS (SELECT s_nationkey AS k, s_suppkey, CASE WHEN s_acctbal > 5000 THEN 1 WHEN s_acctbal > 0 THEN 2 ELSE 3 END AS tier FROM supplier) SELECT k, s_suppkey FROM (SELECT *, min(tier) OVER (PARTITION BY k) AS m FROM t) WHERE tier = m")
def p19_tiered_selection(spark, sf):
    from pyspark.sql import Window

    tier = F.when(F.col("s_acctbal") > 5000, 1).when(F.col("s_acctbal") > 0, 2).otherwise(3)
    t = V.load(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", tier.alias("tier"))
    return t.withColumn("m", F.min("tier").over(Window.partitionBy("k"))).where("tier = m").select("k", "s_suppkey")
