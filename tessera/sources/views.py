"""The model's tables as projections of the star-schema tables, in Spark and as DuckDB views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spot, gene, value): quantity by customer and brand|type; absent pairs are 0."""
    line, orders, part = (load(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(part, line.l_partkey == part.p_partkey)
    return joined.groupBy(F.col("o_custkey").alias("spot"), F.concat_ws("|", "p_brand", "p_type").alias("gene")).agg(F.sum("l_quantity").alias("value"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spot, gene, value) with part names as genes."""
    line, orders, part = (load(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(part, line.l_partkey == part.p_partkey)
    return joined.groupBy(F.col("o_custkey").alias("spot"), F.col("p_name").alias("gene")).agg(F.sum("l_quantity").alias("value"))


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spot, x, y, sample): customers on a lattice of 25 columns; the market segment is the sample."""
    c = load(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("spot"), (F.col("c_custkey") % 25).cast("double").alias("x"), F.floor(F.col("c_custkey") / 25).cast("double").alias("y"), F.col("c_mktsegment").alias("sample"))


def activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(program, spot, value): event values by type|day of month modulo 7 and user."""
    e = load(spark, sf_dir, "events")
    program = F.concat_ws("|", "event_type", (F.dayofmonth("ts") % 7).cast("string"))
    return e.groupBy(program.alias("program"), F.col("user_id").alias("spot")).agg(F.sum(F.round("value", 2)).alias("value")).withColumn("value", F.round("value", 2))


def gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, gene): small parts of each brand."""
    p = load(spark, sf_dir, "part").where("p_size <= 10")
    return p.select(F.col("p_brand").alias("term"), F.col("p_name").alias("gene")).distinct()


def active(spark: SparkSession, sf_dir: str, quantile: float = 0.6) -> DataFrame:
    """(program, spot, value) above a quantile of its program."""
    a = activation(spark, sf_dir)
    q = a.groupBy("program").agg(F.percentile("value", F.lit(quantile)).alias("q"))
    return a.join(q, "program").where("value > q").drop("q")


#: The same tables in DuckDB.
DUCK = {
    "expression": "SELECT o_custkey AS spot, p_brand || '|' || p_type AS gene, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "names": "SELECT o_custkey AS spot, p_name AS gene, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "spots": "SELECT c_custkey AS spot, (c_custkey % 25)::DOUBLE AS x, (c_custkey // 25)::DOUBLE AS y, c_mktsegment AS sample FROM customer",
    "activation": "SELECT event_type || '|' || (day(ts) % 7)::VARCHAR AS program, user_id AS spot, round(sum(round(value, 2)), 2) AS value FROM events GROUP BY 1, 2",
    "gene_sets": "SELECT DISTINCT p_brand AS term, p_name AS gene FROM part WHERE p_size <= 10",
    "active": "SELECT program, spot, value FROM (SELECT a.*, quantile_cont(value, 0.6) OVER (PARTITION BY program) AS q FROM activation a) WHERE value > q",
    "users": "SELECT DISTINCT user_id AS spot, (user_id % 25)::DOUBLE AS x, (user_id // 25)::DOUBLE AS y FROM events",
    "grid": "SELECT a.spot AS u, b.spot AS v FROM users a JOIN users b ON a.spot <> b.spot AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1",
}
_NEEDS = {"active": ["activation"], "grid": ["users"]}  # in the order they are wanted


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spot, x, y) of the spots of activation."""
    u = load(spark, sf_dir, "events").select(F.col("user_id").alias("spot")).distinct()
    return u.select("spot", (F.col("spot") % 25).cast("double").alias("x"), F.floor(F.col("spot") / 25).cast("double").alias("y"))


def duck(names: str, body: str, recursive: bool = False) -> str:
    """body with the named views before it as common table expressions."""
    wanted: list[str] = []
    for n in names.split():
        wanted += [x for x in [*_NEEDS.get(n, []), n] if x not in wanted]
    return "WITH " + "RECURSIVE " * recursive + ", ".join(f"{n} AS ({DUCK[n]})" for n in wanted) + ("," if body.lstrip().startswith(",") else " ") + body.lstrip().lstrip(",")
