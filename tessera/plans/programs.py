"""Registered queries over gene programs and their annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import programs as M
from tessera.operators import templates as L
from tessera.plans.basic import r
from tessera.plans.spatial import latent
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


def _weights(spark, sf):
    """Brands as programs: a gene weighs its share of the brand's small parts."""
    p = V.load(spark, sf, "part").where("p_size <= 20").groupBy(F.col("p_brand").alias("program"), F.col("p_name").alias("gene")).agg(F.sum("p_size").alias("n"))
    from pyspark.sql import Window

    return p.select("program", "gene", (F.col("n") / F.sum("n").over(Window.partitionBy("program"))).alias("weight"))


_W = ", wt AS (SELECT p_brand AS program, p_name AS gene, sum(p_size) / sum(sum(p_size)) OVER (PARTITION BY p_brand) AS weight FROM part WHERE p_size <= 20 GROUP BY 1, 2), ac AS (SELECT program, spot, sum(value * weight) AS activation FROM names JOIN wt USING (gene) GROUP BY 1, 2)"


@query(V.duck("names", _W + " SELECT program, spot, round(activation, 10) AS activation, row_number() OVER (PARTITION BY spot ORDER BY round(activation, 9) DESC, program) AS rank_in_spot FROM ac WHERE activation > 0"))
def m7_activation(spark, sf):
    return M.activate(V.names(spark, sf), _weights(spark, sf)).withColumn("activation", r("activation", 10))


@query(V.duck("names", _W + " SELECT program, round(greatest(0.001, quantile_cont(activation, 0.6)), 6) AS full, round(greatest(0.001, quantile_cont(activation, 0.85)), 6) AS core FROM ac GROUP BY program"))
def m7_thresholds(spark, sf):
    return M.thresholds(M.activate(V.names(spark, sf), _weights(spark, sf))).withColumns({c: r(c) for c in ("full", "core")})


@query("WITH wt AS (SELECT p_brand AS program, p_name AS gene, sum(p_size) / sum(sum(p_size)) OVER (PARTITION BY p_brand) AS weight FROM part WHERE p_size <= 20 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY program ORDER BY weight DESC, gene) AS rn FROM wt), f AS (SELECT * FROM k WHERE weight > 0.02 OR length(gene) / 100.0 > 0.15 OR rn <= 10) SELECT program, gene, round(weight / sum(weight) OVER (PARTITION BY program), 6) AS weight FROM f")
def m9_refine(spark, sf):
    w = _weights(spark, sf).withColumn("alignment", F.length("gene") / 100.0)
    return M.refine(w).withColumn("weight", r("weight"))


@query("WITH s AS (SELECT p_brand AS program, count(DISTINCT p_name) AS genes, count(*) AS spots, count(*) / 1000 AS coverage, count(*) FILTER (p_size <= 10) / count(*) AS largest FROM part GROUP BY 1), f AS (SELECT *, array_to_string(list_sort(list_filter([CASE WHEN genes < 20 THEN 'few_genes' END, CASE WHEN spots < 10 THEN 'few_spots' END, CASE WHEN coverage < 0.02 THEN 'low_coverage' END, CASE WHEN largest < 0.2 THEN 'scattered' END], lambda x: x IS NOT NULL)), '|') AS reasons FROM s) SELECT program, genes, reasons, CASE WHEN reasons = '' THEN 'valid' ELSE 'invalid' END AS validity, CASE WHEN reasons <> '' THEN 'rejected' WHEN largest >= 0.5 THEN 'default_use' ELSE 'review_only' END AS routing, round(0.6 * largest + 0.4 * (0.35 + 0.55 * (rank() OVER (ORDER BY largest) + (count(*) OVER (PARTITION BY largest) - 1) / 2.0::DOUBLE) / count(*) OVER ()), 6) AS confidence FROM f")
def p16_m10_decide(spark, sf):
    s = V.load(spark, sf, "part").groupBy(F.col("p_brand").alias("program")).agg(F.count_distinct("p_name").alias("genes"), F.count(F.lit(1)).alias("spots"), (F.count(F.lit(1)) / 1000).alias("coverage"), (F.count_if(F.col("p_size") <= 10) / F.count(F.lit(1))).alias("largest"))
    return M.stretched(M.decide(s), "largest").select("program", "genes", "reasons", "validity", "routing", r("confidence").alias("confidence"))


_ORA = V.duck("gene_sets", ", pg AS (SELECT DISTINCT p_type AS program, p_name AS gene FROM part WHERE p_size > 35), un AS (SELECT DISTINCT p_name AS gene FROM part), nn AS (SELECT count(*) AS n FROM un), sp AS (SELECT program, count(*) AS ps FROM pg GROUP BY 1), st AS (SELECT term, count(*) AS ts FROM gene_sets GROUP BY 1), hh AS (SELECT program, term, count(*) AS overlap FROM pg JOIN gene_sets USING (gene) GROUP BY 1, 2 HAVING count(*) >= 5), h2 AS (SELECT hh.*, ps, ts, n, least(1, list_sum(list_transform(range(overlap, least(ts, ps) + 1), lambda i: exp(lgamma(ts + 1) - lgamma(i + 1) - lgamma(ts - i + 1) + lgamma(n - ts + 1) - lgamma(ps - i + 1) - lgamma(n - ts - ps + i + 1) - lgamma(n + 1) + lgamma(ps + 1) + lgamma(n - ps + 1))))) AS p FROM hh JOIN sp USING (program) JOIN st USING (term), nn), h3 AS (SELECT *, row_number() OVER (PARTITION BY program ORDER BY round(p, 12)) AS i, count(*) OVER (PARTITION BY program) AS m, greatest(0, log2(overlap * n / (ts * ps))) AS effect FROM h2), h4 AS (SELECT *, least(1, min(round(p, 12) * m / i) OVER (PARTITION BY program ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM h3), ora AS (SELECT program, term, overlap, ps AS program_size, ts AS term_size, p AS p_value, fdr, effect, effect * (1 + greatest(0, -log10(greatest(1e-12, least(1, fdr))))) * sqrt(overlap) AS score, fdr <= 0.2 AND effect > 0 AS is_significant FROM h4)")


def _ora(spark, sf):
    p = V.load(spark, sf, "part")
    programs = p.where("p_size > 35").select(F.col("p_type").alias("program"), F.col("p_name").alias("gene")).distinct()
    return M.over_representation(programs, V.gene_sets(spark, sf), p.select(F.col("p_name").alias("gene")).distinct())


@query(_ORA + " SELECT program, term, overlap, program_size, term_size, round(p_value, 8) AS p_value, round(fdr, 8) AS fdr, round(effect, 6) AS effect, round(score, 6) AS score, is_significant FROM ora")
def r4_j18_over_representation(spark, sf):
    h = _ora(spark, sf)
    return h.select("program", "term", "overlap", "program_size", "term_size", r("p_value", 8).alias("p_value"), r("fdr", 8).alias("fdr"), r("effect").alias("effect"), r("score").alias("score"), "is_significant")


@query(_ORA + " SELECT program, round(CASE WHEN max(score) > 0 THEN greatest(0, least(1, 0.45 * (1 - exp(-max(score) / 6)) + 0.35 * max(score) / sum(score) FILTER (score > 0) + 0.20 * least(1, count(*) FILTER (is_significant) / 2))) ELSE 0 END, 6) AS confidence FROM ora GROUP BY program")
def r6_summary_confidence(spark, sf):
    return M.summary_confidence(_ora(spark, sf)).withColumn("confidence", r("confidence"))


@query()
def g24_trimmed_terms(spark, sf):
    h = _ora(spark, sf).withColumn("is_significant", F.col("effect") > 0)
    return M.trimmed_terms(h, V.gene_sets(spark, sf))


@query("WITH c AS (SELECT (vec_id % 3)::BIGINT AS run, label::BIGINT AS component, vec_id % 40 AS gene FROM embeddings GROUP BY 1, 2, 3), f AS (SELECT 'P' || (vec_id % 7) AS program, vec_id % 40 AS gene FROM embeddings WHERE label < 5 GROUP BY 1, 2), na AS (SELECT program, count(*) AS na FROM f GROUP BY 1), nb AS (SELECT run, component, count(*) AS nb FROM c GROUP BY 1, 2), j AS (SELECT program, run, component, round(count(*) / (any_value(na) + any_value(nb) - count(*)), 9) AS jaccard FROM f JOIN c USING (gene) JOIN na USING (program) JOIN nb USING (run, component) GROUP BY 1, 2, 3) SELECT program, run, component, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY program, run ORDER BY jaccard DESC, component) AS i FROM j) WHERE i = 1")
def j19_b3_best_matches(spark, sf):
    e = V.load(spark, sf, "embeddings")
    c = e.select((F.col("vec_id") % 3).alias("run"), F.col("label").cast("long").alias("component"), (F.col("vec_id") % 40).alias("gene")).distinct()
    f = e.where("label < 5").select(F.concat(F.lit("P"), (F.col("vec_id") % 7).cast("string")).alias("program"), (F.col("vec_id") % 40).alias("gene")).distinct()
    return M.best_matches(f, c)


def _samples(spark, sf):
    """(sample, spot, gene, value): the spots' cells, market segments as samples."""
    return V.names(spark, sf).join(V.spots(spark, sf).select("spot", "sample"), "spot")


@query()
def m5_factorisation(spark, sf):
    """Ranks 12, 16 and 24 of every sample's evidence: first and last loss, steps, and how many weights are positive."""
    blocks, genes, sizes = L.matrix_blocks(L.encode(_samples(spark, sf)))
    state = L.fitted(blocks, sizes, [0, 1, 2], rounds=40)
    n = L.weights(state, genes).groupBy("sample", "run").agg(F.count_if(F.col("weight") > 0).alias("positive"), F.count_distinct("component").alias("k"))
    loss = L.losses(state)
    return loss.join(n, ["sample", "run"]).select("sample", "run", "k", "positive", F.size("losses").alias("steps"), r(loss.losses[0], 4).alias("first"), r(F.element_at("losses", -1), 4).alias("last"))


@query()
def m5_m6_templates(spark, sf):
    """Templates of every sample by reruns and consensus, each gene with its tier."""
    t, g, _ = L.discover(L.encode(_samples(spark, sf)), rounds=40, least_genes=5)
    t = t.select("sample", "program", "runs", "run_support", "members", "genes", "scaffold", r("evidence", 4).alias("evidence"))
    return g.select("sample", "program", "gene", r("weight", 4).alias("weight"), r("frequency", 4).alias("frequency"), "tier").join(t, ["sample", "program"])


@query()
def g22_redundancy(spark, sf):
    a = M.activate(V.names(spark, sf), _weights(spark, sf)).where("rank_in_spot <= 5")
    spots = a.groupBy("program").agg(F.collect_set("spot").alias("spots"))
    genes = _weights(spark, sf).where("weight >= 0.02").groupBy("program").agg(F.collect_set("gene").alias("genes"), F.max("weight").alias("confidence"))
    return M.redundant(genes.join(spots, "program").select("program", "confidence", "genes", "spots"), 0.1, 0.05)


@query()
def m1_pca(spark, sf):
    return M.pca(latent(spark, sf), 5).select("spot", F.transform("pc", lambda x: F.round(F.abs(x), 4)).alias("pc"))


@query("""WITH e AS (SELECT label, vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT label, i, avg(x) AS mean, greatest(0, 1 - stddev_pop(x)) AS hinge, count(*) AS n FROM e GROUP BY 1, 2),
c AS (SELECT a.label, a.i, b.i AS j, covar_pop(a.x, b.x) AS cov FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY 1, 2, 3),
k AS (SELECT label, sum(cov * cov) AS off FROM c GROUP BY 1)
SELECT m.label, any_value(m.n) AS n, round(avg(hinge), 6) AS hinge, round(2 * any_value(off) / count(*), 6) AS off_diagonal FROM m JOIN k USING (label) GROUP BY 1""")
def m4_latent_losses(spark, sf):
    """Variance hinge and off-diagonal covariance of all latent dimensions by label."""
    return M.latent_losses(V.load(spark, sf, "embeddings").select("label", "embedding")).select("label", "n", r("hinge").alias("hinge"), r("off_diagonal").alias("off_diagonal"))


@query(V.duck("names", ", lab AS (SELECT DISTINCT event_type AS program, user_id AS spot FROM events WHERE value > 200), nb AS (SELECT program, count(*)::DOUBLE AS active, (SELECT count(*) FROM customer) - count(*)::DOUBLE AS inactive FROM lab GROUP BY 1), tt AS (SELECT gene, sum(value) AS t FROM names GROUP BY 1), ii AS (SELECT program, gene, sum(value) AS s FROM names JOIN lab USING (spot) GROUP BY 1, 2) SELECT program, gene, round(s / active - CASE WHEN inactive > 0 THEN (t - s) / inactive ELSE 0 END, 6) AS contrast FROM ii JOIN tt USING (gene) JOIN nb USING (program)"))
def r5_raw_contrast(spark, sf):
    from tessera.operators.genes import raw_contrast

    lab = V.load(spark, sf, "events").where("value > 200").select(F.col("event_type").alias("program"), F.col("user_id").alias("spot")).distinct()
    n = V.spots(spark, sf).count()
    nb = lab.groupBy("program").agg(F.count(F.lit(1)).cast("double").alias("active")).withColumn("inactive", n - F.col("active"))
    return raw_contrast(V.names(spark, sf), lab, nb).withColumn("contrast", r("contrast"))


@query("WITH t AS (SELECT p_brand AS program, p_type AS term, count(*)::DOUBLE AS score FROM part GROUP BY 1, 2) SELECT program, round(sum(score) FILTER (term = (SELECT min(term) FROM t)), 6) AS first_term, round(sum(score), 6) AS total, count(DISTINCT term) AS terms FROM t GROUP BY program")
def m16_term_matrix(spark, sf):
    """The program by term matrix in its long form, over all terms there are: absent cells are zeros and cost nothing."""
    t = V.load(spark, sf, "part").groupBy(F.col("p_brand").alias("program"), F.col("p_type").alias("term")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    first = t.agg(F.min("term").alias("first"))
    own = F.sum(F.when(F.col("term") == F.col("first"), F.col("score")))
    return t.crossJoin(F.broadcast(first)).groupBy("program").agg(F.coalesce(own, F.lit(0.0)).alias("first_term"), F.sum("score").alias("total"), F.count("term").alias("terms"))


