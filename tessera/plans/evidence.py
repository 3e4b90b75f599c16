"""Registered queries over stage inputs, program evidence, ranked genes, texts and axis overviews."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators import evidence as E
from tessera.operators import graph as H
from tessera.operators import niches as N
from tessera.operators import spatial as P
from tessera.plans.basic import r
from tessera.plans.spatial import grid
from tessera.sources import arrays as Y
from tessera.sources import bundles as B
from tessera.sources import commits as K
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


def _folder(spark) -> str:
    return f"{H.shared_dir(spark)}/bundles-{uuid.uuid4().hex}"


@query("SELECT n_nationkey AS k, n_name AS name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1, 2")
def s7_text_tables(spark, sf):
    """Tables written as TSV and CSV, read back by schema; an absent one is None."""
    at = _folder(spark)
    V.load(spark, sf, "nation").select("n_nationkey", "n_name").write.csv(f"{at}/nation.tsv", header=True, sep="\t")
    V.load(spark, sf, "customer").select("c_custkey", "c_nationkey").write.csv(f"{at}/customer.csv", header=True)
    nation, customer = B.read_table(spark, f"{at}/nation.tsv", "n_nationkey long, n_name string"), B.read_table(spark, f"{at}/customer.csv", "c_custkey long, c_nationkey long")
    assert B.read_table(spark, f"{at}/absent.csv", "a int") is None
    return nation.join(customer, nation.n_nationkey == customer.c_nationkey, "left").groupBy(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).agg(F.count("c_custkey").alias("n"))


@query("SELECT s_suppkey::VARCHAR AS program, s_name AS summary, s_acctbal > 0 AS available FROM supplier")
def s8_optional_records(spark, sf):
    """Annotation records written as JSON and read by key; an absent file gives no rows."""
    at, schema = _folder(spark), "program string, summary string, available boolean"
    s = V.load(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("program"), F.col("s_name").alias("summary"), (F.col("s_acctbal") > 0).alias("available"))
    s.withColumn("program", F.concat(F.lit(" "), "program")).write.json(f"{at}/annotation.json")
    empty, told = B.read_records(spark, f"{at}/absent.json", schema, "program")
    assert not told["available"]
    rows = spark.read.schema(schema).json(f"{at}/annotation.json").withColumn("pos", F.monotonically_increasing_id())
    return B.last_record(rows.withColumn("program", F.trim("program")), "program", "pos").unionByName(empty)


@query("""WITH a AS (SELECT p_brand AS axis_id, max(p_type) AS axis_name, max(p_size)::DOUBLE AS w1, min(p_size)::DOUBLE AS w2 FROM part GROUP BY 1),
b AS (SELECT p_brand AS axis_id, max(p_size) * 2.0::DOUBLE AS w2 FROM part WHERE p_size > 45 GROUP BY 1)
SELECT a.axis_id, CASE WHEN b.axis_id IS NULL THEN axis_name ELSE 'own' END AS axis_name, w1, coalesce(b.w2, a.w2) AS w2, b.w2 AS w3 FROM a LEFT JOIN b USING (axis_id)""")
def s6_merged_axes(spark, sf):
    p = V.load(spark, sf, "part")
    none = F.create_map().cast("map<string,double>")
    a = p.groupBy(F.col("p_brand").alias("axis_id")).agg(F.max("p_type").alias("axis_name"), F.create_map(F.lit("w1"), F.max("p_size").cast("double"), F.lit("w2"), F.min("p_size").cast("double")).alias("weights")).withColumn("gating", none)
    b = p.where("p_size > 45").groupBy(F.col("p_brand").alias("axis_id")).agg((F.max("p_size") * 2.0).alias("w")).select("axis_id", F.lit("own").alias("axis_name"), F.create_map(F.lit("w2"), "w", F.lit("w3"), "w").alias("weights"), none.alias("gating"))
    return B.merged_axes(a, b).select("axis_id", "axis_name", *[F.try_element_at("weights", F.lit(w)).alias(w) for w in ("w1", "w2", "w3")])


@query("SELECT c_mktsegment AS sample, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1")
def s10_s11_bundles(spark, sf):
    """Bundles by sample: listed, filtered, located from a stage beside them, gathered; a broken one is told and left out."""
    root, c = _folder(spark), V.load(spark, sf, "customer")
    samples = sorted(x[0] for x in c.select("c_mktsegment").distinct().collect())
    for s in samples:
        c.where(F.col("c_mktsegment") == s).select("c_custkey", "c_acctbal").write.parquet(f"{root}/{s}/representation_bundle/profile.parquet")
    c.select("c_name").limit(1).write.parquet(f"{root}/ZZZ/representation_bundle/profile.parquet")
    found = B.listed(spark, root, "representation_bundle", "profile.parquet", {*samples, "ZZZ"} - {"MACHINERY"})
    assert B.locate(spark, f"{root}/{samples[0]}/program_bundle", "representation_bundle").endswith("/representation_bundle")
    rows, errors = B.gathered(spark, found, "profile.parquet", {"c_custkey": "long", "c_acctbal": "double"})
    assert [e["sample"] for e in errors] == ["ZZZ"]
    return rows.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), r(F.sum("c_acctbal"), 2).alias("total"))


@query(V.duck("activation users", " SELECT a.program, count(*) AS spots, max(o.idx) AS last, round(sum(a.value), 2) AS mass FROM activation a JOIN (SELECT spot, row_number() OVER (ORDER BY spot) - 1 AS idx FROM users) o USING (spot) GROUP BY 1"))
def s16_stage_inputs(spark, sf):
    """A program bundle written to the shared folder, checked and joined to its canonical spot order."""
    at, a = _folder(spark), V.activation(spark, sf)
    a.write.parquet(f"{at}/activation.parquet")
    a.select("program", F.lit("g").alias("gene")).distinct().write.parquet(f"{at}/programs.parquet")
    u = V.users(spark, sf).select("spot")
    n = u.count()
    order = u.withColumn("idx", F.expr("row_number() OVER (ORDER BY spot) - 1"))
    order.write.parquet(f"{at}/spots.parquet")
    x = B.assemble(spark, at, n, need_qc=False)
    return x.activation.join(x.order, "spot").groupBy("program").agg(F.count(F.lit(1)).alias("spots"), F.max("idx").alias("last"), r(F.sum("value"), 2).alias("mass"))


@query("SELECT o_custkey AS k, min_by(o_orderpriority, o_orderkey) FILTER (o_orderpriority NOT LIKE '1%') AS priority, min_by(o_totalprice, o_orderkey) FILTER (o_totalprice > 100000) AS price FROM orders GROUP BY 1")
def p18_first_present(spark, sf):
    o = V.load(spark, sf, "orders")
    rows = o.select(F.col("o_custkey").alias("k"), "o_orderkey", F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("price"))
    return B.first_present(rows, ["k"], "o_orderkey")


_ACTIVE_EDGES = """, e AS (SELECT a.program, g.u, g.v FROM grid g JOIN active a ON g.u = a.spot JOIN active b ON g.v = b.spot AND a.program = b.program),
c(program, spot, component) AS (SELECT program, spot, spot FROM active UNION SELECT e.program, e.v, c.component FROM c JOIN e ON e.program = c.program AND e.u = c.spot AND c.component < e.v),
m AS (SELECT program, spot, min(component) AS component FROM c GROUP BY 1, 2), z AS (SELECT program, component, count(*) AS n FROM m GROUP BY 1, 2),
k AS (SELECT program, count(*) AS component_count, max(n) AS largest, sum(n) AS n FROM z GROUP BY 1), dg AS (SELECT u AS spot, count(*) AS d FROM grid GROUP BY 1),
ins AS (SELECT program, u AS spot, count(*) AS i FROM e GROUP BY 1, 2),
pu AS (SELECT a.program, a.spot, coalesce(coalesce(i, 0) / d, 0.0) AS share FROM active a LEFT JOIN dg USING (spot) LEFT JOIN ins ON a.program = ins.program AND a.spot = ins.spot),
tp AS (SELECT program, avg(share) AS purity, avg(CASE WHEN share > 0 AND share < 1 THEN 1.0::DOUBLE ELSE 0 END) AS boundary_fraction FROM pu GROUP BY 1)"""


@query(V.duck("active grid", _ACTIVE_EDGES + " SELECT k.program, component_count, round(boundary_fraction, 6) AS boundary_fraction, round(purity * largest / n, 6) AS local_purity FROM k JOIN tp USING (program)", recursive=True))
def a27_topology(spark, sf):
    t = E.topology(H.stored(V.active(spark, sf).select("program", "spot"), "active"), H.stored(grid(spark, sf), "grid"))
    return t.select("program", "component_count", r("boundary_fraction").alias("boundary_fraction"), r("local_purity").alias("local_purity"))


@query(V.duck("active grid", _ACTIVE_EDGES + """, rk AS (SELECT *, row_number() OVER (PARTITION BY program ORDER BY value DESC, spot) AS i, count(*) OVER (PARTITION BY program) AS n FROM active),
o AS (SELECT program, count(*) AS active_spot_count, sum(value) AS mass, sum(value) FILTER (i <= ceil(n * 0.2::DOUBLE)) / sum(value) AS hot FROM rk GROUP BY 1)
SELECT o.program, active_spot_count, round(mass, 2) AS activation_mass, round(hot, 6) AS activation_hotspot_share, round(mass / active_spot_count, 6) AS activation_mean_active, round(active_spot_count / (SELECT count(*) FROM users), 6) AS activation_coverage,
component_count, round(boundary_fraction, 6) AS boundary_fraction, round(purity * largest / k.n, 6) AS local_purity, round(1.0::DOUBLE / component_count, 6) AS component_density FROM o JOIN k USING (program) JOIN tp USING (program)""", recursive=True))
def r9_program_evidence(spark, sf):
    a = H.stored(V.active(spark, sf), "active")
    e = E.program_evidence(a, H.stored(grid(spark, sf), "grid"), V.users(spark, sf).count())
    plain = ("program", "active_spot_count", "component_count")
    return e.select(*[c if c in plain else r(c, 2 if c == "activation_mass" else 6).alias(c) for c in e.columns])


_WEIGHTS = "w AS (SELECT p_brand AS program, p_name AS gene, sum(p_size - 25)::DOUBLE AS weight FROM part GROUP BY 1, 2)"


def _weights(spark, sf):
    return V.load(spark, sf, "part").groupBy(F.col("p_brand").alias("program"), F.col("p_name").alias("gene")).agg(F.sum(F.col("p_size") - 25).cast("double").alias("weight"))


@query(f"""WITH {_WEIGHTS}, k AS (SELECT *, row_number() OVER (PARTITION BY program ORDER BY abs(weight) DESC, gene) AS rank, sum(abs(weight)) OVER (PARTITION BY program) AS t FROM w),
n AS (SELECT program, string_agg(gene, '|' ORDER BY rank) FILTER (rank <= 3) AS top3_genes, string_agg(gene, '|' ORDER BY rank) FILTER (rank <= 10) AS top10_genes FROM k GROUP BY 1)
SELECT program, gene, weight, rank, round(abs(weight) / t, 9) AS gene_contribution, top3_genes, top10_genes FROM k JOIN n USING (program)""")
def r2_ranked_genes(spark, sf):
    return E.ranked_genes(_weights(spark, sf), (3, 10)).withColumn("gene_contribution", r("gene_contribution", 9))


@query("""WITH t AS (SELECT DISTINCT p_brand AS term, p_name AS gene FROM part), u AS (SELECT DISTINCT p_name AS gene FROM part WHERE p_size <= 30), i AS (SELECT * FROM t SEMI JOIN u USING (gene)),
s AS (SELECT term, count(*) AS term_size FROM i GROUP BY 1 HAVING count(*) BETWEEN 5 AND 45) SELECT term, gene, term_size FROM i JOIN s USING (term)""")
def r3_bounded_terms(spark, sf):
    p = V.load(spark, sf, "part")
    return E.bounded_terms(p.select(F.col("p_brand").alias("term"), F.col("p_name").alias("gene")), p.where("p_size <= 30").select(F.col("p_name").alias("gene")), 5, 45)


@query(V.duck("names", ", q AS (SELECT spot, median(value) AS c, avg(value) AS m FROM names WHERE value > 0 GROUP BY 1) SELECT n.spot, gene, round(value / (value + greatest(1e-8, CASE WHEN c > 0 THEN c ELSE m END)), 6) AS value FROM names n JOIN q USING (spot) WHERE value > 0"))
def f3_saturated(spark, sf):
    e = V.names(spark, sf).where("value > 0")
    q = e.groupBy("spot").agg(F.percentile("value", F.lit(0.5)).alias("c"), F.avg("value").alias("m"))
    return e.join(q, "spot").select("spot", "gene", r(X.saturated("value", "c", "m")).alias("value"))


@query(V.duck("users", ", k AS (SELECT a.spot, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS distance FROM users a JOIN users b ON a.spot <> b.spot GROUP BY 1) SELECT 'spot_spacing' AS rule, round(1.5::DOUBLE * quantile_cont(distance, 0.5), 6) AS epsilon FROM k UNION ALL SELECT 'fixed_default_q25', round(quantile_cont(distance, 0.25), 6) FROM k UNION ALL SELECT 'distance_quantile', round(quantile_cont(distance, 0.9), 6) FROM k UNION ALL SELECT 'fixed', 2.0"))
def f6_epsilon(spark, sf):
    u = V.users(spark, sf)
    near = H.stored(P.nearest(u, 1, 1.0), "near")
    d = near.select("distance") if "distance" in near.columns else near.select(F.sqrt("d2").alias("distance"))
    found = [N.epsilon(d, "spot_spacing", d.agg(F.percentile("distance", F.lit(0.5))).first()[0]), N.epsilon(d, "fixed"), N.epsilon(d, "quantile", quantile=0.9), N.epsilon(d, "fixed", fixed=2.0)]
    return spark.createDataFrame([(rule, round(float(e), 6)) for e, rule in found], "rule string, epsilon double")


@query(r"""WITH g AS (SELECT p_brand AS program, CASE p_size % 5 WHEN 0 THEN 'LINC' || p_size WHEN 1 THEN 'HBA' || p_size WHEN 2 THEN 'C1orf' || p_size ELSE upper(p_name) END AS gene, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
s AS (SELECT program, avg(regexp_matches(gene, '^(AC|AL|AP|LINC|LOC|RP[0-9]|CTD|DEPRECATED_|MIR|SNORD|SNORA|RNU|C\d+orf\d+|[A-Z]\d{5,}(?:\.\d+)?)')::INT) FILTER (i <= 20) AS odd20,
avg(regexp_matches(gene, '^(AC|AL|AP|LINC|LOC|RP[0-9]|CTD|DEPRECATED_|MIR|SNORD|SNORA|RNU|C\d+orf\d+|[A-Z]\d{5,}(?:\.\d+)?)')::INT) FILTER (i <= 5) AS odd5, avg(regexp_matches(gene, '^(HBA|HBB|HBD|HBG|HBM|HBQ)')::INT) FILTER (i <= 10) AS blood FROM g GROUP BY 1)
SELECT program, round(greatest(0, least(1, 1 - 0.75 * odd20 - odd5 - 0.5 * blood)), 6) AS score, round(odd20, 6) AS odd20, round(odd5, 6) AS odd5, round(blood, 6) AS haemoglobin10 FROM s""")
def f12_symbol_quality(spark, sf):
    p, k = V.load(spark, sf, "part"), F.col("p_size") % 5
    size = F.col("p_size").cast("string")
    gene = F.when(k == 0, F.concat(F.lit("LINC"), size)).when(k == 1, F.concat(F.lit("HBA"), size)).when(k == 2, F.concat(F.lit("C1orf"), size)).otherwise(F.upper("p_name"))
    g = p.groupBy(F.col("p_brand").alias("program")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", gene.alias("gene")))), lambda x: x["gene"]).alias("genes"))
    q = g.select("program", X.symbol_quality("genes").alias("q"))
    return q.select("program", *[r(F.col("q")[c]).alias(c) for c in ("score", "odd20", "odd5", "haemoglobin10")])


_AXES = "s AS (SELECT c_nationkey AS k, c_mktsegment AS axis, round(avg(c_acctbal) / 10000, 6) AS score FROM customer GROUP BY 1, 2), a AS (SELECT *, dense_rank() OVER (ORDER BY axis) - 1 AS pos, row_number() OVER (PARTITION BY k ORDER BY score DESC, axis) AS rank, greatest(0, score) / nullif(sum(greatest(0, score)) OVER (PARTITION BY k), 0) AS p FROM s)"


def _axis_scores(spark, sf):
    s = V.load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("axis")).agg(r(F.avg("c_acctbal") / 10000).alias("score"))
    axes = s.select("axis").distinct().withColumn("pos", F.expr("row_number() OVER (ORDER BY axis) - 1"))  # a row an axis
    return s.join(F.broadcast(axes), "axis")


@query(f"""WITH {_AXES} SELECT k, max_by(axis, score * 1000000 - pos * 0.001) AS leading, string_agg(axis, ',' ORDER BY pos) FILTER (score >= 0.45) AS supported,
round(coalesce(-sum(CASE WHEN p > 0 THEN p * ln(p) END) / ln(greatest(2, count(*))), 0), 6) AS spread, string_agg(axis || ':' || (score >= 0.45)::VARCHAR || ':' || rank, ',' ORDER BY pos) AS overview FROM a GROUP BY 1""")
def r14_r19_support_profile(spark, sf):
    p = E.support_profile(_axis_scores(spark, sf), ["k"], 0.45)
    text = F.array_join(F.transform("overview", lambda x: F.concat_ws(":", x["axis"], x["supported"].cast("string"), x["rank"].cast("string"))), ",")
    return p.select("k", "leading", F.nullif(F.array_join("supported", ","), F.lit("")).alias("supported"), r("spread").alias("spread"), text.alias("overview"))


@query(f"""WITH {_AXES}, g AS (SELECT k, list(axis ORDER BY pos) FILTER (score >= 0.45) AS axes, max_by(axis, score * 1000000 - pos * 0.001) AS first FROM a GROUP BY 1), h AS (SELECT k, coalesce(axes, []) AS axes, first FROM g)
SELECT k, CASE len(axes) WHEN 0 THEN '' WHEN 1 THEN axes[1] ELSE array_to_string(axes[:len(axes) - 1], ', ') || ' and ' || axes[len(axes)] END AS phrase,
'Component support ' || CASE WHEN len(axes) = 1 THEN 'is concentrated around `' || first || '`, with limited co-support elsewhere.' WHEN len(axes) = 2 THEN 'is co-supported by `' || axes[1] || '` and `' || axes[2] || '`, rather than concentrated on a single axis.'
WHEN len(axes) > 2 THEN 'is distributed across multiple supported axes (' || array_to_string(list_transform(axes, lambda x: '`' || x || '`'), ', ') || '), indicating a mixed state.' ELSE 'remains broad but weak, without a strongly consolidated axis.' END AS text FROM h""")
def f19_texts(spark, sf):
    p = E.support_profile(_axis_scores(spark, sf), ["k"], 0.45)
    n = F.size("supported")
    state = F.when(n == 1, "focused").when(n == 2, "co_supported").when(n > 2, "mixed").otherwise("weak")
    p = p.withColumn("label", F.lit(" component")).withColumn("state", state)
    return p.select("k", X.phrase("supported").alias("phrase"), X.state_text("label", "leading", "supported", "state").alias("text"))


@query("""WITH g AS (SELECT p_brand AS program, p_name AS gene, max(p_size)::DOUBLE AS weight, min(p_size) AS m, max(p_retailprice) AS a FROM part GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY program ORDER BY weight DESC, gene) AS rank, CASE m % 4 WHEN 0 THEN 'scaffold' WHEN 1 THEN 'support' WHEN 2 THEN 'context' ELSE 'other' END AS role, m % 3 = 0 AS con, greatest(0, least(1, a / 2000)) AS al FROM g),
h AS (SELECT *, weight / sum(weight) OVER (PARTITION BY program) AS w FROM k WHERE rank <= 12),
s AS (SELECT program, sum(w) FILTER (rank <= 5) AS head, coalesce(sum(w) FILTER (role = 'scaffold'), 0) AS sc, coalesce(sum(w) FILTER (role = 'support'), 0) AS su, coalesce(sum(w) FILTER (role = 'context'), 0) AS cx, coalesce(sum(w) FILTER (role IN ('context', 'other')), 0) AS di, coalesce(sum(w) FILTER (con), 0) AS co, sum(w * al) / sum(w) AS am FROM h GROUP BY 1)
SELECT program, round(head, 6) AS head_mass, round(sc, 6) AS scaffold_mass, round(su, 6) AS support_mass, round(cx, 6) AS context_mass, round(di, 6) AS dilution, round(co, 6) AS contributor_mass, round(am, 6) AS alignment_mean, round(0.30 * head + 0.25 * (1 - di) + 0.25 * co + 0.20 * am, 6) AS coherence FROM s""")
def m8_axis_coherence(spark, sf):
    from tessera.functions.stats import top_k

    g = V.load(spark, sf, "part").groupBy(F.col("p_brand").alias("program"), F.col("p_name").alias("gene")).agg(F.max("p_size").cast("double").alias("weight"), F.min("p_size").alias("m"), F.max("p_retailprice").alias("a"))
    k = F.col("m") % 4
    role = F.when(k == 0, "scaffold").when(k == 1, "support").when(k == 2, "context").otherwise("other")
    g = top_k(g, ["program"], [F.desc("weight"), "gene"], 1 << 31).withColumn("role", role).withColumn("contributes", F.col("m") % 3 == 0).withColumn("alignment", F.col("a") / 2000)
    out = E.axis_coherence(g)
    return out.select("program", *[r(c).alias(c) for c in out.columns if c != "program"])


@query("""WITH h AS (SELECT c_mktsegment AS program, c_nationkey::BIGINT AS gene, least(1, avg(c_acctbal) / 9000) AS alignment FROM customer WHERE c_nationkey < 10 GROUP BY 1, 2),
p AS (SELECT a.program, a.gene AS a, b.gene AS b, greatest(0, 1 - abs(a.alignment - b.alignment) * 6 - (a.gene + b.gene) % 3 * 0.3::DOUBLE) AS corr FROM h a JOIN h b ON a.program = b.program AND a.gene < b.gene),
l AS (SELECT program, a AS u, b AS v FROM p WHERE corr >= 0.25 UNION ALL SELECT program, b, a FROM p WHERE corr >= 0.25), c(program, gene, component) AS (SELECT program, gene, gene FROM h UNION SELECT l.program, l.v, c.component FROM c JOIN l ON l.program = c.program AND l.u = c.gene AND c.component < l.v),
m AS (SELECT program, gene, min(component) AS component FROM c GROUP BY 1, 2), z AS (SELECT program, component, count(*) AS n FROM m GROUP BY 1, 2), sh AS (SELECT program, count(*) AS component_count, max(n) / sum(n) AS largest FROM z GROUP BY 1),
bp AS (SELECT program, avg(corr) AS mc, avg((corr < 0.15)::INT) AS lo FROM p GROUP BY 1), al AS (SELECT program, stddev_pop(alignment) AS d FROM h GROUP BY 1)
SELECT program, round(greatest(0, least(1, 0.35 * mc + 0.30 * largest + 0.20 * greatest(0, least(1, 1 - d / 0.35)) + 0.15 * (1 - lo))), 6) AS score, round(mc, 6) AS mean_corr, round(lo, 6) AS low_share, component_count, round(largest, 6) AS largest, round(d, 6) AS dispersion FROM sh JOIN bp USING (program) JOIN al USING (program)""".replace("WITH h", "WITH RECURSIVE h", 1))
def m8_head_consistency(spark, sf):
    h = V.load(spark, sf, "customer").where("c_nationkey < 10").groupBy(F.col("c_mktsegment").alias("program"), F.col("c_nationkey").cast("long").alias("gene")).agg(F.least(F.lit(1.0), F.avg("c_acctbal") / 9000).alias("alignment"))
    h = H.stored(h, "heads")
    b = h.select("program", F.col("gene").alias("b"), F.col("alignment").alias("y"))
    p = h.join(b, "program").where("gene < b").select("program", F.col("gene").alias("a"), "b", F.greatest(F.lit(0.0), 1 - F.abs(F.col("alignment") - F.col("y")) * 6 - (F.col("gene") + F.col("b")) % 3 * 0.3).alias("corr"))
    out = E.head_consistency(p, h)
    return out.select("program", "component_count", *[r(c).alias(c) for c in out.columns if c not in ("program", "component_count")])


@query("SELECT c_nationkey AS k, CASE WHEN s >= 0.45 AND n >= 3 AND t <= 0.60 THEN 'high' WHEN s >= 0.25 AND n >= 1 AND t <= 0.80 THEN 'medium' ELSE 'low' END AS reliability FROM (SELECT c_nationkey, avg(c_acctbal) / 10000 AS s, count(*) FILTER (c_acctbal > 9000) AS n, max(c_acctbal) / sum(c_acctbal) FILTER (c_acctbal > 0) AS t FROM customer GROUP BY 1)")
def r19_reliability(spark, sf):
    bal = F.col("c_acctbal")
    s = V.load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg((F.avg(bal) / 10000).alias("s"), F.count_if(bal > 9000).alias("n"), (F.max(bal) / F.sum(F.when(bal > 0, bal))).alias("t"))
    return s.select("k", X.reliability_class("s", "n", "t").alias("reliability"))


@query("SELECT n_name AS name, count(c_custkey) AS customers, round(sum(c_acctbal), 2) AS balance, true AS whole FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def s12_s13_committed_bundle(spark, sf):
    """Two tables committed at once, then once more while the second write fails: the first stays, whole by its digests."""
    at = _folder(spark)
    nation, customer = V.load(spark, sf, "nation").select("n_nationkey", "n_name"), V.load(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    K.commit(spark, at, {"nation": nation, "customer": customer}, {"nation": "tsv"})
    try:
        K.commit(spark, at, {"nation": nation.limit(0), "customer": customer.withColumn("c_acctbal", F.raise_error(F.lit("a write that fails")).cast("double"))})
    except PySparkException:
        pass
    b = K.bundle(spark, at)
    whole = b.checked().agg(F.min("whole")).first()[0]
    both = b.table("nation").join(b.table("customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    return both.groupBy(F.col("n_name").alias("name")).agg(F.count("c_custkey").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.lit(whole).alias("whole"))


@query("SELECT c_mktsegment AS sample, 'market.' || c_mktsegment || '.programs.csv' AS file, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def s14_export_tree(spark, sf):
    """Bundles of all samples exported as text, read back by the catalogue."""
    at, c = _folder(spark), V.load(spark, sf, "customer")
    for (sample,) in sorted(c.select("c_mktsegment").distinct().collect()):
        own = c.where(F.col("c_mktsegment") == sample).select("c_custkey", "c_acctbal")
        own.write.parquet(f"{at}/in/market/{sample}/program_bundle/programs.parquet")
        own.write.parquet(f"{at}/in/market/{sample}/program_bundle/qc/programs.parquet")
    told = K.export(spark, f"{at}/in", f"{at}/out", {"program": {"programs.parquet", "qc/programs.parquet", "absent.json"}})
    paths = [r.export for r in told.collect()]
    rows = spark.read.schema("c_custkey long, c_acctbal double").csv(paths, header=True).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    sample = F.element_at(F.split("file", r"\."), 2)
    return rows.groupBy(sample.alias("sample"), "file").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT vec_id - (SELECT min(vec_id) FROM embeddings) AS idx, len(embedding) AS width, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def s4_array_scan(spark, sf):
    """The latent matrix as array files, read back by row ranges."""
    e, at = V.load(spark, sf, "embeddings"), _folder(spark)
    first = e.agg(F.min("vec_id")).first()[0]
    Y.write_npy(e.select((F.col("vec_id") - F.lit(first)).alias("idx"), F.col("embedding").alias("values")), f"{at}/latent", 4)
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return Y.read_npy(spark, f"{at}/latent").select("idx", F.size("values").alias("width"), F.round(total, 4).alias("total"))
