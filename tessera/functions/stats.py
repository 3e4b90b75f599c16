"""Exact quantiles, rank statistics and cuts over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import stored

QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90)


def quantiles(df: DataFrame, value: str, *by: str) -> DataFrame:
    """p10 to p90 of the finite values by linear interpolation; a group without one gets zeros."""
    fine = F.when(~F.isnan(value) & (F.abs(F.col(value)) != float("inf")), F.col(value))
    q = df.groupBy(*by).agg(F.percentile(fine, F.array(*[F.lit(x) for x in QUANTILES])).alias("q"))
    return q.select(*by, *[F.coalesce(F.col("q")[k], F.lit(0.0)).alias(f"p{round(100 * x)}") for k, x in enumerate(QUANTILES)])


#: Values of a group that one task may sort, and bins that a longer group is cut into by a pass.
HELD, BINS = 100_000, 4096
#: Rows of a table that may be sent to all tasks.
SENT_ROWS = 100_000


def quantile(df: DataFrame, value: str, q: float, by: list[str] | None = None, held: int = HELD) -> DataFrame:
    """(by..., quantile): the exact quantile of the finite values by linear interpolation, for groups of any size.

    Groups of at most held values are sorted. In a longer one the two order statistics around the quantile are selected: a
    pass counts the values by BINS bins between the least and the greatest, the bin that holds the wanted rank becomes the
    next range, and so on until its values are few or all equal. A pass exchanges bins, and values only if the groups are too
    many to be sent to all tasks.
    """
    by = by or []
    fine = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v) AND abs(_v) < double('Infinity')")
    n = fine.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")).where("_n > 0")
    most = n.agg(F.max("_n")).first()[0] or 0
    if most <= held:
        return fine.groupBy(*by).agg(F.percentile("_v", F.lit(q)).alias("quantile")).where("quantile IS NOT NULL")
    at = F.col("_n").cast("double") - 1
    at = F.lit(float(q)) * at
    ranks = F.array_distinct(F.array(F.floor(at), F.ceil(at)))
    place = n.select(*by, at.alias("_at"), F.explode(ranks).alias("_k"), "_low", "_high", F.lit(0).cast("long").alias("_before"), F.col("_n").alias("_size"))
    place = stored(place, "places")
    for step in range(100):
        if place.where((F.col("_low") < F.col("_high")) & (F.col("_size") > held)).isEmpty():
            break
        open_ = place.where((F.col("_low") < F.col("_high")) & (F.col("_size") > held))
        # two passes by magnitude, which tell octaves and parts of one; then evenly, in halves, so that no range overflows
        low, high, v = (_magnitude(F.col(c)) if step < 2 else F.col(c) / 2 for c in ("_low", "_high", "_v"))
        share = F.when(high > low, (v - low) / (high - low)).otherwise(F.when(F.col("_v") > F.col("_low"), 1.0).otherwise(0.0))
        inside = _beside(fine, open_, by).where(F.col("_v").between(F.col("_low"), F.col("_high"))).withColumn("_bin", F.least(F.lit(BINS - 1), F.floor(share * BINS)))
        key = [*by, "_k"]
        bins = inside.groupBy(*key, "_at", "_before", "_bin").agg(F.count(F.lit(1)).alias("_size"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        upto = F.sum("_size").over(Window.partitionBy(*key).orderBy("_bin"))
        found = bins.withColumn("_to", F.col("_before") + upto).where("_to > _k AND _to - _size <= _k").select(*by, "_at", "_k", "_low", "_high", (F.col("_to") - F.col("_size")).alias("_before"), "_size")
        place = stored(place.where((F.col("_low") == F.col("_high")) | (F.col("_size") <= held)).unionByName(found), "places")
    few = _beside(fine, place.where("_low < _high"), by).where(F.col("_v").between(F.col("_low"), F.col("_high")))
    order = F.row_number().over(Window.partitionBy(*by, "_k").orderBy("_v"))
    picked = few.withColumn("_r", F.col("_before") + order - 1).where("_r = _k").select(*by, "_at", "_k", "_v")
    both = picked.unionByName(place.where("_low = _high").select(*by, "_at", "_k", F.col("_low").alias("_v")))
    weight = F.when(F.floor("_at") == F.ceil("_at"), 1.0).otherwise(1 - F.abs(F.col("_at") - F.col("_k")))
    return both.groupBy(*by).agg(F.sum(weight * F.col("_v")).alias("quantile"))


def _magnitude(v: Column) -> Column:
    """A number that grows with v by one for each doubling, from the least double on."""
    size = F.when(v == 0, 0.0).otherwise(F.log2(F.abs(v)) + 1075)
    return F.when(v < 0, -size).otherwise(size)


def _beside(values: DataFrame, places: DataFrame, by: list[str]) -> DataFrame:
    """Values with the places of their group: at most two, which go to all tasks unless there are very many groups."""
    small = places.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    return values.join(F.broadcast(places) if small else places, by) if by else values.join(F.broadcast(places))


def average_rank(by: list[str], order: Column) -> Column:
    """Rank from 1 with the mean for ties."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(order)) + (F.count(F.lit(1)).over(w.partitionBy(*by, order)) - 1) / 2


def _apart(df: DataFrame, *names: str) -> str:
    """A prefix that no column of df and none of names begins with: what follows it is nobody else's name."""
    prefix = "_"
    while any(c.startswith(prefix) for c in (*df.columns, *names)):
        prefix += "_"
    return prefix


def running(df: DataFrame, by: list[str], order: list, amount: Column, name: str) -> DataFrame:
    """df with name: the sum of amount over the rows of a group that come before a row, and name_all, that over all its rows.

    Groups may have any size: rows are dealt by ranges of by and order, a range adds up its own, and the sums of the ranges
    before are added. Equal rows by order come to one range, so they should be few. Columns of df may have any names but
    name and name_all.
    """
    own = _apart(df, name)
    part, at, sums, before = (own + c for c in ("part", "at", "sums", "before"))
    t = stored(df.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()), "ranges")
    w, inside = Window.partitionBy(*by), Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = t.groupBy(*by, part).agg(F.sum(amount).alias(sums))
    earlier = F.sum(sums).over(w.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    keys = [f"{own}by{i}" for i in range(len(by))]
    parts = parts.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(part).alias(at), F.coalesce(earlier, F.lit(0)).alias(before), F.sum(sums).over(w).alias(f"{name}_all"))
    same = F.col(part) == F.col(at)
    for c, k in zip(by, keys, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    out = t.withColumn(name, F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(parts, same)
    return out.withColumn(name, F.col(name) + F.col(before)).drop(part, at, before, *keys)


def numbered(df: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    """Row numbers from 1 within groups of any size."""
    own = _apart(df, name) + "row"
    return running(df, by, order, F.lit(1), own).withColumn(name, F.col(own) + 1).drop(own, f"{own}_all")


def percentile_rank(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Average rank over the group's size: over 0, up to 1. No task holds a group: its values are counted and ranked by ranges."""
    own, keys = _apart(df, name), [*by, value]
    n, r = own + "n", own + "r"
    many = running(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)), by, [F.col(value)], F.col(n), r)
    many = many.select(*[F.col(c).alias(f"{own}k{i}") for i, c in enumerate(keys)], ((F.col(r) + 1 + (F.col(n) - 1) / 2) / F.col(f"{r}_all")).alias(name))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"{own}k{i}"))
    return df.join(many, same).drop(*[f"{own}k{i}" for i in range(len(keys))])


def benjamini_hochberg(df: DataFrame, p: str, by: list[str], name: str = "fdr") -> DataFrame:
    """Step-up adjusted p-values by group."""
    up = Window.partitionBy(*by).orderBy(F.col(p))
    ranked = df.withColumn("_r", F.row_number().over(up)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    down = Window.partitionBy(*by).orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(name, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(down))).drop("_r", "_n")


def cumulative_cut(df: DataFrame, score: str, by: list[str], order: list, share: float) -> DataFrame:
    """The leading rows of each group that make up a share of its score, the crossing row included."""
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum(score).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return df.withColumn("_before", before).withColumn("_all", F.sum(score).over(w)).where(F.col("_before") < share * F.col("_all")).drop("_before", "_all")


def entropy(df: DataFrame, value: str, by: list[str], name: str = "entropy") -> DataFrame:
    """Entropy of the positive values as shares, over the logarithm of how many there are (2 at least)."""
    some = df.where(F.col(value) > 0)
    share = F.col(value) / F.sum(value).over(Window.partitionBy(*by))
    out = some.withColumn("_p", share).groupBy(*by).agg((-F.sum(F.col("_p") * F.log("_p"))).alias("_h"), F.count(F.lit(1)).alias("_n"))
    return out.select(*by, (F.col("_h") / F.log(F.greatest(F.lit(2), F.col("_n")).cast("double"))).alias(name))


def top_k(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered."""
    # the filter stands right on the row number, so that Spark drops what is past k before it exchanges a group
    first = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return (first.where(F.col(name) <= k) if k < 1 << 31 else first).withColumn(name, F.col(name).cast("long"))


def weighted_mean(value: str, weight: str) -> Column:
    """An aggregate; the plain mean where no weight is positive."""
    total = F.sum(weight)
    return F.when(total > 0, F.sum(F.col(value) * F.col(weight)) / total).otherwise(F.avg(value))


def correlation(df: DataFrame, a: str, b: str, n: Column, by: list[str], name: str) -> DataFrame:
    """Pearson's, 0 to 1, over n cells of which those that are not rows are 0 on both sides; 0 without variance."""
    s = df.groupBy(*by).agg(F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(F.col(a) * F.col(a)).alias("saa"), F.sum(F.col(b) * F.col(b)).alias("sbb"), F.sum(F.col(a) * F.col(b)).alias("sab"))
    va, vb = F.col("saa") / n - F.pow(F.col("sa") / n, 2), F.col("sbb") / n - F.pow(F.col("sb") / n, 2)
    value = (F.col("sab") / n - F.col("sa") / n * F.col("sb") / n) / F.sqrt(va * vb)
    return s.select(*by, F.when((va > 1e-16) & (vb > 1e-16), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).otherwise(0.0).alias(name))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labellings of the rows."""
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2)
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = cells.agg(pairs("n").alias("both"), F.sum("n").alias("n"))
    left = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs("n").alias("left"))
    right = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs("n").alias("right"))
    every = one.join(left).join(right)  # a row each
    expected = F.col("left") * F.col("right") / (F.col("n") * (F.col("n") - 1) / 2)
    most = (F.col("left") + F.col("right")) / 2
    return every.select(F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"))
