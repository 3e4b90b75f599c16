"""Evidence for programs: activation and topology, ranked genes, terms inside the universe, heads and axis overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.functions.stats import top_k
from tessera.operators import graph as H


def topology(active: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(program, component_count, boundary_fraction, local_purity) of active (program, spot) over neighbours (u, v).

    A spot's purity is the share of its neighbours that are active, 0 without neighbours; it lies on the boundary if some
    and not all are. local_purity is the mean purity times the largest component's share of the spots.
    """
    near = neighbours.where("u <> v").select("u", "v").distinct()
    ends = active.select("program", F.col("spot").alias("v"), F.lit(1).alias("on"))
    degree = near.groupBy("u").agg(F.count(F.lit(1)).alias("degree"))
    inner = H.stored(active.withColumnRenamed("spot", "u").join(near, "u").join(ends, ["program", "v"]).select("program", "u", "v"), "inner")
    own = inner.groupBy("program", F.col("u").alias("spot")).agg(F.count(F.lit(1)).alias("inside"))
    spots = active.join(own, ["program", "spot"], "left").join(degree.withColumnRenamed("u", "spot"), "spot", "left")
    share = F.coalesce(F.col("inside"), F.lit(0)) / F.col("degree")
    edge = spots.groupBy("program").agg(
        F.avg(F.coalesce(share, F.lit(0.0))).alias("purity"), F.avg(F.when((share > 0) & (share < 1), 1.0).otherwise(0.0)).alias("boundary_fraction"), F.count(F.lit(1)).alias("n")
    )
    size = H.components(active, inner.unionByName(inner.select("program", F.col("v").alias("u"), F.col("u").alias("v"))).distinct()).groupBy("program", "component").agg(F.count(F.lit(1)).alias("size"))
    part = size.groupBy("program").agg(F.count(F.lit(1)).alias("component_count"), F.max("size").alias("largest"))
    return part.join(edge, "program").select("program", "component_count", X.clamp01("boundary_fraction").alias("boundary_fraction"), X.clamp01(F.col("purity") * F.col("largest") / F.col("n")).alias("local_purity"))


def program_evidence(activation: DataFrame, neighbours: DataFrame, total_spots: int, hotspot: float = 0.20) -> DataFrame:
    """Mass, coverage, mean, hotspot share and topology of each program's activation (program, spot, value).

    The hotspot share is that of the strongest ceil(hotspot * n) spots; negative values count as 0.
    """
    w = Window.partitionBy("program")
    a = activation.withColumn("value", F.greatest(F.lit(0.0), F.coalesce(F.col("value").cast("double"), F.lit(0.0))))
    ranked = a.withColumn("i", F.row_number().over(w.orderBy(F.desc("value"), "spot"))).withColumn("n", F.count(F.lit(1)).over(w))
    top = F.sum(F.when(F.col("i") <= F.ceil(F.col("n") * F.lit(hotspot)), F.col("value")).otherwise(0.0))
    mass = F.sum("value")
    own = ranked.groupBy("program").agg(F.count_distinct("spot").alias("active_spot_count"), mass.alias("activation_mass"), F.when(mass > 0, top / mass).otherwise(0.0).alias("activation_hotspot_share"))
    own = own.withColumn("activation_mean_active", F.col("activation_mass") / F.col("active_spot_count")).withColumn("activation_coverage", F.col("active_spot_count") / F.lit(max(1, total_spots)))
    shape = topology(activation.select("program", "spot").distinct(), neighbours)
    return own.join(shape, "program", "left").withColumn("component_density", 1.0 / F.greatest(F.lit(1), F.col("component_count")))


def ranked_genes(weights: DataFrame, scales: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    """(program, gene, weight) with rank by weight without sign, its share of the program (equal shares where all weights
    are 0), and the names of the first genes for each scale, joined by bars."""
    size = F.abs(F.coalesce("weight", F.lit(0.0)))
    w = Window.partitionBy("program")
    ranked = top_k(weights.withColumn("size", size), ["program"], [F.desc("size"), "gene"], 1 << 31)
    total = F.sum("size").over(w)
    out = ranked.withColumn("gene_contribution", F.when(total > 0, F.col("size") / total).otherwise(1.0 / F.count(F.lit(1)).over(w)))
    first = ranked.where(F.col("rank") <= max(scales)).groupBy("program").agg(F.array_sort(F.collect_list(F.struct("rank", "gene"))).alias("g"))
    names = [F.array_join(F.transform(F.slice("g", 1, n), lambda x: x["gene"]), "|").alias(f"top{n}_genes") for n in scales]
    return out.join(first.select("program", *names), "program").drop("size")


def bounded_terms(terms: DataFrame, universe: DataFrame, least: int = 5, most: int = 500) -> DataFrame:
    """(term, gene, term_size): genes in the universe, of terms with least to most of them (most not below least)."""
    inside = terms.select("term", "gene").distinct().join(universe.select("gene").distinct(), "gene", "left_semi")
    size = inside.groupBy("term").agg(F.count(F.lit(1)).alias("term_size")).where(F.col("term_size").between(least, max(least, most)))
    return inside.join(size, "term").select("term", "gene", "term_size")


def axis_coherence(genes: DataFrame, top: int = 12) -> DataFrame:
    """How far a program's first genes lie on its axis: shares of weight by role, alignment, and their score.

    genes has program, gene, rank, weight, role (scaffold, support, context or other), contributes (boolean) and alignment.
    Weights that sum to 0 count as equal; the first five genes are the head.
    """
    w = Window.partitionBy("program")
    head = genes.where(F.col("rank") <= top)
    total = F.sum("weight").over(w)
    head = head.withColumn("w", F.when(total > 0, F.col("weight") / total).otherwise(1.0 / F.count(F.lit(1)).over(w)))
    part = lambda rule: X.clamp01(F.sum(F.when(rule, F.col("w")).otherwise(0.0)))
    out = head.groupBy("program").agg(
        part(F.col("rank") <= 5).alias("head_mass"), part(F.col("role") == "scaffold").alias("scaffold_mass"), part(F.col("role") == "support").alias("support_mass"),
        part(F.col("role") == "context").alias("context_mass"), part(~F.col("role").isin("scaffold", "support")).alias("dilution"), part(F.col("contributes")).alias("contributor_mass"),
        (F.sum(F.col("w") * X.clamp01("alignment")) / F.sum("w")).alias("alignment_mean"),
    )
    score = 0.30 * F.col("head_mass") + 0.25 * (1 - F.col("dilution")) + 0.25 * F.col("contributor_mass") + 0.20 * F.col("alignment_mean")
    return out.withColumn("coherence", X.clamp01(score))


def head_consistency(pairs: DataFrame, heads: DataFrame, link: float = 0.25, low: float = 0.15, spread: float = 0.35) -> DataFrame:
    """How well a program's head genes (program, gene, alignment), at most ten, go together.

    pairs (program, a, b, corr), a < b, have the correlations of the head's pairs, negative ones as 0; genes with link or
    more are joined. Heads of fewer than two genes score 0.
    """
    fine = pairs.withColumn("corr", F.greatest(F.lit(0.0), "corr"))
    by_pair = fine.groupBy("program").agg(F.avg("corr").alias("mean_corr"), F.avg(F.when(F.col("corr") < low, 1.0).otherwise(0.0)).alias("low_share"))
    linked = fine.where(F.col("corr") >= link).select("program", F.col("a").alias("u"), F.col("b").alias("v"))
    both = H.stored(linked.unionByName(linked.select("program", F.col("v").alias("u"), F.col("u").alias("v"))), "linked")
    parts = H.components(heads.select("program", F.col("gene").alias("spot")), both).groupBy("program", "component").agg(F.count(F.lit(1)).alias("size"))
    shape = parts.groupBy("program").agg(F.count(F.lit(1)).alias("component_count"), (F.max("size") / F.sum("size")).alias("largest"), F.sum("size").alias("n"))
    align = heads.groupBy("program").agg(F.stddev_pop("alignment").alias("dispersion"))
    out = shape.join(by_pair, "program", "left").join(align, "program")
    real = (F.col("n") >= 2) & F.col("mean_corr").isNotNull()
    cohesion = X.clamp01(1 - F.col("dispersion") / spread)
    score = X.clamp01(0.35 * F.col("mean_corr") + 0.30 * F.col("largest") + 0.20 * cohesion + 0.15 * (1 - F.col("low_share")))
    return out.select(
        "program", F.when(real, score).otherwise(0.0).alias("score"), F.when(real, F.col("mean_corr")).otherwise(0.0).alias("mean_corr"), F.when(real, F.col("low_share")).otherwise(1.0).alias("low_share"),
        "component_count", F.when(real, F.col("largest")).otherwise(0.0).alias("largest"), F.when(real, F.col("dispersion")).otherwise(1.0).alias("dispersion"),
    )


def support_profile(scores: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """For scores (by..., axis, pos, score), pos the axis's place in the catalogue: how the support is spread over axes.

    overview lists axis, score, whether it is supported and its rank (by score, then name), in the order of the catalogue;
    supported are the axes at threshold or more in that order; leading is the first axis with the highest score; spread is
    the entropy of the positive scores over that of all axes.
    """
    w = Window.partitionBy(*by)
    total = F.sum(F.greatest(F.lit(0.0), "score")).over(w)
    s = scores.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "axis"))).withColumn("p", F.greatest(F.lit(0.0), "score") / F.nullif(total, F.lit(0.0)))
    item = F.struct("pos", "axis", "score", (F.col("score") >= threshold).alias("supported"), "rank")
    entropy = -F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p"))) / F.log(F.greatest(F.lit(2), F.count(F.lit(1))))
    out = s.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("overview"), X.clamp01(F.coalesce(entropy, F.lit(0.0))).alias("spread"), F.max_by("axis", F.struct("score", -F.col("pos"))).alias("leading"))
    supported = F.transform(F.filter("overview", lambda x: x["supported"]), lambda x: x["axis"])
    return out.select(*by, "leading", supported.alias("supported"), "spread", F.transform("overview", lambda x: F.struct(x["axis"].alias("axis"), x["score"].alias("score"), x["supported"].alias("supported"), x["rank"].alias("rank"))).alias("overview"))
