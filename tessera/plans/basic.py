"""Registered queries over genes, scalars, statistics, windows and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.functions import stats as S
from tessera.operators import genes as G
from tessera.operators import graph as H
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


def r(c, n: int = 6):
    return F.round(c, n)


_ACT = """, s AS (SELECT count(*) AS n FROM customer), th AS (SELECT gene, greatest(0.001, quantile_cont(value, 0.8)) AS threshold FROM expression WHERE value > 0 GROUP BY gene),
ac AS (SELECT e.gene, th.threshold, count(*) FILTER (value >= threshold) AS support, sum(value) AS total, sum(value) FILTER (value >= threshold) AS high FROM expression e JOIN th ON e.gene = th.gene WHERE value > 0 GROUP BY 1, 2),
a2 AS (SELECT gene, threshold, support, total / n AS mean, high / support AS mon, CASE WHEN n > support THEN (total - high) / (n - support) ELSE 0 END AS moff, ln(1 + n / (1.0::DOUBLE + support)) AS idf, n FROM ac, s),
act AS (SELECT gene, threshold, support, mean, greatest(0, (mon - moff) / (mon + moff + 1e-8)) AS contrast, idf, n FROM a2),
g1 AS (SELECT * FROM act WHERE support BETWEEN greatest(5, ceil(0.01 * n)) AND floor(0.8 * n)), g2 AS (SELECT * FROM g1 WHERE mean >= (SELECT quantile_cont(mean, 0.2) FROM g1)),
g3 AS (SELECT * FROM g2 WHERE contrast >= (SELECT quantile_cont(contrast, 0.1) FROM g2))"""


@query(V.duck("expression", _ACT + " SELECT gene, round(threshold, 6) AS threshold, support, round(mean, 6) AS mean, round(contrast, 6) AS contrast, round(idf, 6) AS idf FROM act"))
def a4_gene_activity(spark, sf):
    n = V.spots(spark, sf).count()
    a = G.activity(V.expression(spark, sf), n)
    return a.select("gene", r("threshold").alias("threshold"), "support", r("mean").alias("mean"), r("contrast").alias("contrast"), r("idf").alias("idf"))


@query(V.duck("expression", _ACT + " SELECT * FROM (SELECT e.spot, e.gene, e.value, row_number() OVER (PARTITION BY e.spot ORDER BY e.value DESC, e.gene) AS rank_in_spot, support, round(idf, 6) AS idf FROM expression e JOIN g3 ON e.gene = g3.gene WHERE value > 0) WHERE rank_in_spot <= 5"))
def p8_gene_qc_top(spark, sf):
    e, n = H.stored(V.expression(spark, sf), "cells"), V.spots(spark, sf).count()  # read once for each gate
    return G.top_genes(e, G.gated(H.stored(G.activity(e, n), "activity"), n), 5).withColumn("idf", r("idf"))


@query(V.duck("expression", "SELECT gene, count(*) FILTER (value > 0) AS n FROM expression GROUP BY gene HAVING count(*) FILTER (value > 0) >= 300"))
def p1_min_cells(spark, sf):
    e = V.expression(spark, sf)
    return G.min_cells(e, 300).groupBy("gene").agg(F.count_if(F.col("value") > 0).alias("n"))


@query(V.duck("expression", "SELECT spot, gene, round(ln(1 + value / sum(value) OVER (PARTITION BY spot) * 10000), 6) AS value FROM expression"))
def p2_log_normalise(spark, sf):
    return G.log_normalise(V.expression(spark, sf)).select("spot", "gene", r("value").alias("value"))


@query(V.duck("expression", ", n AS (SELECT count(*) AS n FROM customer), v AS (SELECT gene, round(greatest(0, sum(value * value) / n - (sum(value) / n) ** 2), 6) AS variance FROM expression, n GROUP BY gene, n) SELECT * FROM (SELECT gene, variance, row_number() OVER (ORDER BY variance DESC, gene) AS rank FROM v) WHERE rank <= 20"))
def p3_p4_variable_genes(spark, sf):
    return G.variable_genes(V.expression(spark, sf), V.spots(spark, sf).count(), 20)


@query("SELECT p_name, count(*) AS n, bool_or(upper(p_name) IN ('MALAT1', 'NEAT1', 'XIST')) AS exact, bool_or(regexp_matches(upper(p_name), '^(MT-|RPL|RPS|B|S)')) AS prefix FROM part WHERE NOT lower(p_name) LIKE 'mt-%' GROUP BY p_name")
def p5_p7_blacklist(spark, sf):
    p = V.load(spark, sf, "part").where(~F.lower("p_name").startswith("mt-"))
    name = F.col("p_name")
    prefixed = G.blacklisted(name, ("MT-", "RPL", "RPS", "B", "S"), ())
    return p.groupBy("p_name").agg(F.count(F.lit(1)).alias("n"), F.bool_or(G.blacklisted(name, (), ("MALAT1", "NEAT1", "XIST"))).alias("exact"), F.bool_or(prefixed).alias("prefix"))


@query("WITH q AS (SELECT c_custkey AS k, CASE WHEN c_acctbal > 5000 THEN 'valid' ELSE 'invalid' END AS validity, CASE c_mktsegment WHEN 'BUILDING' THEN 'default_use' WHEN 'MACHINERY' THEN 'review_only' ELSE 'rejected' END AS routing FROM customer), s AS (SELECT k FROM q WHERE validity = 'valid' AND routing IN ('default_use', 'review_only')) SELECT k FROM s UNION ALL SELECT k FROM q WHERE NOT EXISTS (SELECT 1 FROM s)")
def p10_qc_selection(spark, sf):
    c = V.load(spark, sf, "customer")
    routing = F.when(F.col("c_mktsegment") == "BUILDING", "default_use").when(F.col("c_mktsegment") == "MACHINERY", "review_only").otherwise("rejected")
    q = c.select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 5000, "valid").otherwise("invalid").alias("validity"), routing.alias("routing"))
    s = q.where((F.col("validity") == "valid") & F.col("routing").isin("default_use", "review_only"))
    return s.select("k") if not s.isEmpty() else q.select("k")


@query("SELECT c_custkey AS k, CASE WHEN c_acctbal IS NULL THEN 'missing' WHEN c_acctbal < 0 THEN 'rejected' WHEN c_mktsegment = 'BUILDING' AND c_acctbal >= 8000 THEN 'review_included' WHEN c_mktsegment = 'BUILDING' THEN 'review_excluded' ELSE 'default' END AS status, c_acctbal >= 0 AND (c_mktsegment <> 'BUILDING' OR c_acctbal >= 8000) AS eligible FROM customer")
def p11_eligibility(spark, sf):
    c, bal, b = V.load(spark, sf, "customer"), F.col("c_acctbal"), F.col("c_mktsegment") == "BUILDING"
    status = F.when(bal.isNull(), "missing").when(bal < 0, "rejected").when(b & (bal >= 8000), "review_included").when(b, "review_excluded").otherwise("default")
    return c.select(F.col("c_custkey").alias("k"), status.alias("status"), status.isin("default", "review_included").alias("eligible"))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), -1.0) AS k, coalesce(try_cast(event_type AS DOUBLE), 0.0) AS none, event_type NOT IN ('', '0', 'false') AS loose, event_type IN ('1', 'true', 'yes') AS strict FROM events")
def p13_coercion(spark, sf):
    e = V.load(spark, sf, "events")
    return e.select("event_id", X.number_or(F.get_json_object("props", "$.k"), -1.0).alias("k"), X.number_or("event_type", 0.0).alias("none"), X.truth_loose("event_type").alias("loose"), X.truth_strict("event_type").alias("strict"))


@query("SELECT s_suppkey, array_to_string(list_sort(list_filter([CASE WHEN s_acctbal < 1000 THEN 'low_balance' END, CASE WHEN s_nationkey < 5 THEN 'far' END, CASE WHEN s_suppkey % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)), ';') AS reasons FROM supplier")
def p12_p14_p15_reasons(spark, sf):
    s = V.load(spark, sf, "supplier")
    why = X.reasons(low_balance=F.col("s_acctbal") < 1000, far=F.col("s_nationkey") < 5, even=F.col("s_suppkey") % 2 == 0)
    return s.select("s_suppkey", F.array_join(why, ";").alias("reasons"))


@query(V.duck("activation", ", m AS (SELECT a.*, greatest(1e-6, 0.01 * quantile_cont(value, 0.5) OVER (PARTITION BY program)) AS f, row_number() OVER (PARTITION BY program ORDER BY value DESC, spot) AS rn FROM activation a), c AS (SELECT *, count(*) FILTER (value > f * 120) OVER (PARTITION BY program) AS n FROM m) SELECT program, spot FROM c WHERE CASE WHEN n >= 20 THEN value > f * 120 ELSE rn <= 20 END"))
def p17_active_mask(spark, sf):
    a = V.activation(spark, sf)
    floor = a.groupBy("program").agg(F.greatest(F.lit(1e-6), 0.01 * F.percentile("value", F.lit(0.5))).alias("f"))
    w = Window.partitionBy("program")
    m = a.join(floor, "program").withColumn("on", F.col("value") > F.col("f") * 120).withColumn("rn", F.row_number().over(w.orderBy(F.desc("value"), "spot"))).withColumn("n", F.count_if("on").over(w))
    return m.where(F.when(F.col("n") >= 20, F.col("on")).otherwise(F.col("rn") <= 20)).select("program", "spot")


@query(V.duck("activation", " SELECT program, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90 FROM activation GROUP BY program"))
def a1_quantiles(spark, sf):
    q = S.quantiles(V.activation(spark, sf), "value", "program")
    return q.select("program", *[r(c).alias(c) for c in q.columns[1:]])


@query(V.duck("activation", ", p AS (SELECT program, value / sum(value) OVER (PARTITION BY program) AS p FROM activation WHERE value > 0), c AS (SELECT program, p, row_number() OVER (PARTITION BY program ORDER BY p DESC) AS rn, count(*) OVER (PARTITION BY program) AS n FROM p) SELECT program, round(-sum(p * ln(p)) / ln(greatest(2, any_value(n))), 6) AS entropy, round(sum(p * p), 6) AS herfindahl, round(sum(p) FILTER (rn <= 10), 6) AS top10, round(sum(p) FILTER (rn <= ceil(0.2 * n)), 6) AS hotspot FROM c GROUP BY program"))
def a6_a7_concentration(spark, sf):
    a = V.activation(spark, sf).where("value > 0")
    w = Window.partitionBy("program")
    p = a.withColumn("p", F.col("value") / F.sum("value").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("value")))).withColumn("n", F.count(F.lit(1)).over(w))
    c = p.groupBy("program").agg(r(F.sum(F.col("p") * F.col("p"))).alias("herfindahl"), r(F.sum(F.when(F.col("rn") <= 10, F.col("p")))).alias("top10"), r(F.sum(F.when(F.col("rn") <= F.ceil(0.2 * F.col("n")), F.col("p")))).alias("hotspot"))
    return S.entropy(a, "value", ["program"]).withColumn("entropy", r("entropy")).join(c, "program")


@query("SELECT c_mktsegment AS segment, round(CASE WHEN sum(greatest(c_acctbal, 0)) > 0 THEN sum(c_nationkey * greatest(c_acctbal, 0)) / sum(greatest(c_acctbal, 0)) ELSE avg(c_nationkey) END, 6) AS mean FROM customer GROUP BY 1")
def a8_weighted_mean(spark, sf):
    c = V.load(spark, sf, "customer").withColumn("w", F.greatest("c_acctbal", F.lit(0.0)))
    return c.groupBy(F.col("c_mktsegment").alias("segment")).agg(r(S.weighted_mean("c_nationkey", "w")).alias("mean"))


@query("SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey), 6) AS share FROM customer GROUP BY 1, 2")
def a16_a17_value_counts(spark, sf):
    c = V.load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", r(F.col("n") / F.sum("n").over(Window.partitionBy("nation"))))


_PAIR = V.duck("names", ", n AS (SELECT count(*)::DOUBLE AS n FROM customer), g AS (SELECT DISTINCT gene FROM names), k AS (SELECT * FROM names), s AS (SELECT gene, sum(value) AS s, sum(value * value) AS ss FROM k GROUP BY gene), c AS (SELECT a.gene AS a, b.gene AS b, sum(a.value * b.value) AS sab FROM k a JOIN k b ON a.spot = b.spot AND a.gene < b.gene GROUP BY 1, 2) SELECT a, b, round(greatest(0, least(1, (sab / n - x.s / n * y.s / n) / sqrt((x.ss / n - (x.s / n) ** 2) * (y.ss / n - (y.s / n) ** 2)))), 6) AS corr FROM c JOIN s x ON c.a = x.gene JOIN s y ON c.b = y.gene, n")


@query(_PAIR)
def a20_dense_correlation(spark, sf):
    """Pairs meet through the spots they share; single sums carry the rest, so absent cells cost nothing."""
    e, n = V.names(spark, sf), F.lit(float(V.spots(spark, sf).count()))
    k = e
    s = k.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    c = k.alias("a").join(k.alias("b"), "spot").where("a.gene < b.gene").groupBy(F.col("a.gene").alias("a"), F.col("b.gene").alias("b")).agg(F.sum(F.col("a.value") * F.col("b.value")).alias("sab"))
    x, y = s.select(F.col("gene").alias("a"), F.col("s").alias("sa"), F.col("ss").alias("saa")), s.select(F.col("gene").alias("b"), F.col("s").alias("sb"), F.col("ss").alias("sbb"))
    v = (F.col("sab") / n - F.col("sa") / n * F.col("sb") / n) / F.sqrt((F.col("saa") / n - F.pow(F.col("sa") / n, 2)) * (F.col("sbb") / n - F.pow(F.col("sb") / n, 2)))
    return c.join(x, "a").join(y, "b").select("a", "b", r(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))).alias("corr"))


@query("WITH t AS (SELECT c_mktsegment AS segment, c_acctbal AS a, c_nationkey AS b FROM customer), k AS (SELECT segment, rank() OVER (PARTITION BY segment ORDER BY a) + (count(*) OVER (PARTITION BY segment, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY segment ORDER BY b) + (count(*) OVER (PARTITION BY segment, b) - 1) / 2.0::DOUBLE AS rb FROM t) SELECT segment, round(corr(ra, rb), 6) AS spearman FROM k GROUP BY segment")
def a21_spearman(spark, sf):
    c = V.load(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("a"), F.col("c_nationkey").alias("b"))
    k = c.withColumn("ra", S.average_rank(["segment"], F.col("a"))).withColumn("rb", S.average_rank(["segment"], F.col("b")))
    return k.groupBy("segment").agg(r(F.corr("ra", "rb")).alias("spearman"))


@query("WITH t AS (SELECT label AS a, CASE WHEN vec_id % 3 = 0 THEN label ELSE (vec_id % 10)::INT END AS b FROM embeddings), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM t GROUP BY 1, 2), k AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS bb, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS l, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS r, (SELECT sum(n) FROM c) AS n) SELECT round((bb - l * r / (n * (n - 1) / 2)) / ((l + r) / 2 - l * r / (n * (n - 1) / 2)), 6) AS ari FROM k")
def a22_adjusted_rand(spark, sf):
    e = V.load(spark, sf, "embeddings").select(F.col("label").alias("a"), F.when(F.col("vec_id") % 3 == 0, F.col("label")).otherwise((F.col("vec_id") % 10).cast("int")).alias("b"))
    return S.adjusted_rand(e, "a", "b").select(r("ari").alias("ari"))


@query(V.duck("expression", ", n AS (SELECT count(DISTINCT gene) AS n FROM expression) SELECT spot, gene, n - count(*) OVER (PARTITION BY spot) + rank() OVER (PARTITION BY spot ORDER BY value) + (count(*) OVER (PARTITION BY spot, value) - 1) / 2.0::DOUBLE AS rank FROM expression, n WHERE value > 0"))
def w1_rank_with_zeros(spark, sf):
    e = V.expression(spark, sf)
    return G.ranks_with_zeros(e, e.select("gene").distinct().count()).select("spot", "gene", F.col("rank").cast("double").alias("rank"))


@query("SELECT c_custkey AS k, (rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY c_mktsegment) AS pct FROM customer")
def w2_percentile_rank(spark, sf):
    c = V.load(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment", "c_nationkey")
    return S.percentile_rank(c, "c_nationkey", ["c_mktsegment"], "pct").select("k", "pct")


@query(V.duck("expression", ", k AS (SELECT *, row_number() OVER (PARTITION BY spot ORDER BY value DESC, gene) AS rank_in_spot FROM expression) SELECT spot, count(*) AS n, string_agg(gene, ',' ORDER BY gene) AS top50 FROM k WHERE rank_in_spot <= 20 GROUP BY spot"))
def w3_w5_top_sets(spark, sf):
    k = S.top_k(V.expression(spark, sf), ["spot"], [F.desc("value"), "gene"], 20)
    return k.groupBy("spot").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("gene")), ",").alias("top50"))


@query(V.duck("expression", ", q AS (SELECT *, quantile_cont(value, 0.9) OVER (PARTITION BY spot) AS q, row_number() OVER (PARTITION BY spot ORDER BY value DESC, gene) AS rn FROM expression WHERE value > 0) SELECT spot, gene, round(value / sum(value) OVER (PARTITION BY spot), 6) AS value FROM q WHERE value >= q OR rn <= 8"))
def w6_w7_quantile_encoded(spark, sf):
    return G.quantile_encoded(V.expression(spark, sf), "spot", "gene", 0.9, 8).select("spot", "gene", r("value").alias("value"))


@query(V.duck("activation", ", k AS (SELECT *, sum(value) OVER (PARTITION BY program) AS total, coalesce(sum(value) OVER (PARTITION BY program ORDER BY value DESC, spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM activation) SELECT program, spot, value FROM k WHERE b < 0.8 * total"))
def w10_cumulative_cut(spark, sf):
    return S.cumulative_cut(V.activation(spark, sf), "value", ["program"], [F.desc("value"), "spot"], 0.8).select("program", "spot", "value")


@query("WITH p AS (SELECT c_custkey AS k, c_nationkey AS g, (c_custkey * 37 % 1000 + 1) / 1001.0::DOUBLE AS p FROM customer), a AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p, k) AS i, count(*) OVER (PARTITION BY g) AS n FROM p) SELECT k, round(least(1, min(p * n / i) OVER (PARTITION BY g ORDER BY i DESC ROWS UNBOUNDED PRECEDING)), 6) AS fdr FROM a")
def w11_benjamini_hochberg(spark, sf):
    c = V.load(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("g"), ((F.col("c_custkey") * 37 % 1000 + 1) / F.lit(1001.0)).alias("p"))
    return S.benjamini_hochberg(c, "p", ["g"]).select("k", r("fdr").alias("fdr"))


@query("WITH t AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), g AS (SELECT *, sum(CASE WHEN b IS NULL OR b <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM t) SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, count(*) AS n FROM g GROUP BY 1, 2")
def w15_run_lengths(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = V.load(spark, sf, "events").withColumn("b", F.lag("event_type").over(w))
    g = e.withColumn("run", F.sum(F.when(F.col("b").isNull() | (F.col("b") != F.col("event_type")), 1).otherwise(0)).over(w))
    return g.groupBy("user_id", "run").agg(F.any_value("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))


@query("WITH o AS (SELECT p_brand, list_sort(list(DISTINCT p_name)) AS s FROM part WHERE p_size <= 10 GROUP BY 1) SELECT a.p_brand AS a, b.p_brand AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM o a JOIN o b ON a.p_brand < b.p_brand")
def u1_jaccard(spark, sf):
    """Brands are 25, so every pair is wanted; sets meet through an ordered self join."""
    o = V.gene_sets(spark, sf).groupBy("term").agg(F.collect_set("gene").alias("s"))
    a, b = o.select(F.col("term").alias("a"), F.col("s").alias("sa")), o.select(F.col("term").alias("b"), F.col("s").alias("sb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", r(X.jaccard("sa", "sb")).alias("jaccard"))


@query("SELECT * FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def u5_u6_first_rows(spark, sf):
    return S.top_k(V.load(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"], 1, "rn").drop("ts")


@query("SELECT r_name AS name, 'region' AS kind, NULL::INT AS parent FROM region UNION ALL SELECT n_name, 'nation', n_regionkey FROM nation EXCEPT ALL SELECT n_name, 'nation', n_regionkey FROM nation WHERE n_regionkey = 0")
def u2_u3_union_except(spark, sf):
    reg, nat = V.load(spark, sf, "region"), V.load(spark, sf, "nation")
    a = reg.select(F.col("r_name").alias("name"), F.lit("region").alias("kind"))
    b = nat.select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"), F.col("n_regionkey").alias("parent"))
    return a.unionByName(b, allowMissingColumns=True).exceptAll(b.where("parent = 0").select("name", "kind", "parent"))


@query("SELECT event_id, round(greatest(0, least(1, value / 100)), 6) AS clamp, round(1 - exp(-greatest(value, 0) / 50), 6) AS sat, round(CASE WHEN value <= 0 OR value >= 200 THEN 0 WHEN value <= 80 THEN value / 80 ELSE (200 - value) / 120 END, 6) AS tri, round(value / (value + 0.25), 6) AS rat, round(exp(-0.5 * (value / 60) ** 2), 6) AS gauss, round(2 ** greatest(log2((value + 1) / 20) * least(1, greatest(0, value / 150)), 0) - 1, 6) AS proj FROM events")
def f1_f5_scalars(spark, sf):
    e, v = V.load(spark, sf, "events"), F.col("value")
    return e.select("event_id", r(X.clamp01(v / 100)).alias("clamp"), r(X.saturating(v, 50)).alias("sat"), r(X.triangular(v, 0, 80, 200)).alias("tri"), r(X.rational(v)).alias("rat"), r(X.gaussian_weight(v, F.lit(60.0))).alias("gauss"), r(X.project(v + 1, F.lit(20.0), v / 150)).alias("proj"))


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || '/' || p_brand), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS token, least(p_brand, p_type) || '|' || greatest(p_brand, p_type) AS key, least(1, (CASE WHEN contains(lower(p_name), 'al') THEN 1 ELSE 0 END + CASE WHEN contains(lower(p_name), 'e') THEN 1 ELSE 0 END) / 3.0::DOUBLE)::DOUBLE AS score FROM part")
def f9_f13_strings(spark, sf):
    p = V.load(spark, sf, "part")
    return p.select("p_partkey", X.text_token(F.concat_ws("/", "p_name", "p_brand")).alias("token"), X.unordered_key("p_brand", "p_type").alias("key"), X.keyword_score(F.lower("p_name"), ["al", "e", "al"]).alias("score"))


@query(V.duck("activation", " SELECT program, substr(sha1(program || '|' || array_to_string(list_sort(list(spot)), '|')), 1, 16) AS key FROM activation GROUP BY program"))
def f14_stable_key(spark, sf):
    a = V.activation(spark, sf).groupBy("program").agg(F.collect_list("spot").alias("s"))
    return a.select("program", X.stable_key(F.col("program"), spots=F.col("s")).alias("key"))


@query("WITH c AS (SELECT c_nationkey AS k, count(*) FILTER (c_mktsegment = 'BUILDING') / count(*) AS b, count(*) FILTER (c_mktsegment = 'MACHINERY') / count(*) AS m FROM customer GROUP BY 1) SELECT k, 'building=' || printf('%.3f', b) || ';machinery=' || printf('%.3f', m) AS strip, printf('%.3f', b)::DOUBLE AS building FROM c")
def f15_strips(spark, sf):
    seg = F.col("c_mktsegment")
    c = V.load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg((F.count_if(seg == "BUILDING") / F.count(F.lit(1))).alias("b"), (F.count_if(seg == "MACHINERY") / F.count(F.lit(1))).alias("m"))
    s = c.select("k", X.strip(F.create_map(F.lit("building"), "b", F.lit("machinery"), "m"), ["building", "machinery"]).alias("strip"))
    return s.select("k", "strip", X.parse_strip("strip")["building"].alias("building"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, round(greatest(0, least(1, 1 - list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]))) / len(a.embedding))), 6) AS l1 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def f20_vector_similarity(spark, sf):
    e = V.load(spark, sf, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(b, "a").select("a", "b", r(X.cosine("x", "y")).alias("cosine"), r(X.l1_similarity("x", "y")).alias("l1"))
