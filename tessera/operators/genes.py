"""Filters and summaries of sparse (spot, gene, value) tables; absent cells are 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stats import average_rank, top_k


def min_cells(cells: DataFrame, least: int = 1) -> DataFrame:
    keep = cells.groupBy("gene").agg(F.count_if(F.col("value") > 0).alias("n")).where(F.col("n") >= least)
    return cells.join(keep.select("gene"), "gene", "left_semi")


def log_normalise(cells: DataFrame, target: float = 1e4) -> DataFrame:
    """log(1 + value * target / spot total); spots without counts give 0."""
    total = F.sum("value").over(Window.partitionBy("spot"))
    return cells.withColumn("value", F.when(total > 0, F.log1p(F.col("value") / total * target)).otherwise(0.0))


def variable_genes(cells: DataFrame, n_spots: int, top: int) -> DataFrame:
    """Genes by population variance over all spots, largest first."""
    mean, square = F.sum("value") / n_spots, F.sum(F.col("value") * F.col("value")) / n_spots
    v = cells.groupBy("gene").agg(F.greatest(F.lit(0.0), square - mean * mean).alias("variance"))
    v = v.withColumn("variance", F.round("variance", 6))
    return top_k(v.withColumn("_one", F.lit(1)), ["_one"], [F.desc("variance"), "gene"], top).drop("_one")


def blacklisted(gene, prefixes: tuple[str, ...], exact: tuple[str, ...]):
    """Whether a gene name, in upper case, begins with or is one of the given."""
    upper = F.upper(gene)
    by_prefix = upper.rlike("^(" + "|".join(prefixes) + ")") if prefixes else F.lit(False)
    return upper.isin(*exact) | by_prefix if exact else by_prefix


def activity(cells: DataFrame, n_spots: int, quantile: float = 0.8, floor: float = 0.001) -> DataFrame:
    """By gene: threshold of its stored values, support, mean over all spots, contrast of active against inactive, idf."""
    some = cells.where("value > 0")
    threshold = some.groupBy("gene").agg(F.greatest(F.lit(floor), F.percentile("value", F.lit(quantile))).alias("threshold"))
    both = some.join(threshold, "gene")
    on = F.col("value") >= F.col("threshold")
    s = both.groupBy("gene", "threshold").agg(
        F.count_if(on).alias("support"), F.sum("value").alias("total"), F.sum(F.when(on, F.col("value"))).alias("high"),
    )
    inactive = n_spots - F.col("support")
    mean_on = F.col("high") / F.col("support")
    mean_off = F.when(inactive > 0, (F.col("total") - F.col("high")) / inactive).otherwise(0.0)
    contrast = F.greatest(F.lit(0.0), (mean_on - mean_off) / (mean_on + mean_off + 1e-8))
    return s.select("gene", "threshold", "support", (F.col("total") / n_spots).alias("mean"), contrast.alias("contrast"), F.log1p(n_spots / (1.0 + F.col("support"))).alias("idf"))


def gated(genes: DataFrame, n_spots: int, low: int = 5, low_share: float = 0.01, high_share: float = 0.8, mean_q: float = 0.2, contrast_q: float = 0.1) -> DataFrame:
    """Support band, then the mean gate, then the contrast gate, each on what is left; a gate that leaves nothing is skipped.

    A band without genes drops its upper bound, then asks for support 1; if that fails too it is an error.
    """
    import math

    least, most = max(low, math.ceil(low_share * n_spots)), math.floor(high_share * n_spots)
    sup = F.col("support")
    n = genes.agg(F.count_if(sup.between(least, most)).alias("a"), F.count_if(sup >= least).alias("b"), F.count_if(sup >= 1).alias("c")).first()
    if n.a:
        genes = genes.where(sup.between(least, most))
    elif n.b:
        genes = genes.where(sup >= least)
    elif n.c:
        genes = genes.where(sup >= 1)
    else:
        raise ValueError("no gene has support")
    for column, q in (("mean", mean_q), ("contrast", contrast_q)):
        bound = genes.agg(F.percentile(column, F.lit(q))).first()[0]
        left = genes.where(F.col(column) >= bound)
        genes = left if not left.isEmpty() else genes
    return genes


def top_genes(cells: DataFrame, genes: DataFrame, top: int) -> DataFrame:
    """The top genes of each spot among genes that passed, by value and then name."""
    ranked = top_k(cells.where("value > 0").join(genes.select("gene", "support", "idf"), "gene"), ["spot"], [F.desc("value"), "gene"], top, "rank_in_spot")
    return ranked.select("spot", "gene", "value", "rank_in_spot", "support", "idf")


def ranks_with_zeros(cells: DataFrame, n_genes: int) -> DataFrame:
    """Average ranks of each spot's stored values as if the absent genes stood there with 0."""
    some = cells.where("value > 0")
    zeros = n_genes - F.count(F.lit(1)).over(Window.partitionBy("spot"))
    return some.withColumn("zeros", zeros).withColumn("rank", F.col("zeros") + average_rank(["spot"], F.col("value")))


def quantile_encoded(cells: DataFrame, by: str, item: str, quantile: float, least: int) -> DataFrame:
    """Each row's values at its quantile or above, at least the largest few, scaled to sum 1."""
    q = cells.where("value > 0").groupBy(by).agg(F.percentile("value", F.lit(quantile)).alias("q"))
    w = Window.partitionBy(by)
    ranked = cells.where("value > 0").join(q, by).withColumn("_r", F.row_number().over(w.orderBy(F.desc("value"), item)))
    return ranked.where((F.col("value") >= F.col("q")) | (F.col("_r") <= least)).withColumn("value", F.col("value") / F.sum("value").over(w)).drop("q", "_r")


def raw_contrast(cells: DataFrame, labels: DataFrame, n_by: DataFrame) -> DataFrame:
    """By program and gene: mean over active spots less the mean over the others, absent cells as 0.

    labels are (program, spot) of active spots; n_by is (program, active, inactive).
    """
    total = cells.groupBy("gene").agg(F.sum("value").alias("all"))
    inside = cells.join(labels, "spot").groupBy("program", "gene").agg(F.sum("value").alias("inside"))
    both = inside.join(total, "gene").join(n_by, "program")
    return both.select("program", "gene", (F.col("inside") / F.col("active") - F.when(F.col("inactive") > 0, (F.col("all") - F.col("inside")) / F.col("inactive")).otherwise(0.0)).alias("contrast"))
