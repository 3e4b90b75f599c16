"""Reading and writing of stage tables: contracts, gene-set text, allow-lists, bundles and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def gene_sets(lines: DataFrame) -> DataFrame:
    """(term, description, genes) from tab-separated lines (value, pos): lines of fewer than three fields are left out, genes
    are distinct in upper case, and of lines with one term the last stays."""
    f = F.split("value", "\t")
    rows = lines.where(F.size(f) >= 3).select(f[0].alias("term"), f[1].alias("description"), F.array_distinct(F.filter(F.transform(F.slice(f, 3, 1 << 30), lambda g: F.upper(F.trim(g))), lambda g: g != "")).alias("genes"), "pos")
    return rows.groupBy("term").agg(F.max_by(F.struct("description", "genes"), "pos").alias("s")).select("term", "s.description", "s.genes")


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    return gene_sets(spark.read.text(path).withColumn("pos", F.monotonically_increasing_id()))


def allowed(df: DataFrame, key: str, allow: DataFrame) -> DataFrame:
    """Rows whose key is on the list (column key); a key on the list that no row has is an error."""
    unknown = [r[0] for r in allow.join(df.select(key), key, "left_anti").limit(5).collect()]
    if unknown:
        raise ValueError(f"unknown: {', '.join(map(str, unknown))}")
    return df.join(allow.select(key).distinct(), key, "left_semi")


def overriding(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A full outer join in which the right side's columns stand for equal ones of the left."""
    return left.drop(*[c for c in right.columns if c != key and c in left.columns]).join(right, key, "full")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join that is an error if a key stands twice on the right."""
    if not right.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
    return left.join(right, key, "left")


def expectations(cells: DataFrame) -> DataFrame:
    """One row: what a table of expression values should be, in counts of rows that are not."""
    v = F.col("value")
    return cells.agg(F.count(F.lit(1)).alias("rows"), F.count_if(v.isNull() | F.isnan(v)).alias("not_finite"), F.count_if(v < 0).alias("negative"), F.count_if(v != F.floor(v)).alias("not_whole"), F.count_if(F.col("gene").isNull() | (F.col("gene") == "")).alias("no_gene"))


def promote(df: DataFrame, path: str, **options: str) -> None:
    """Writes beside path and renames, so that readers see the old table or the new one."""
    spark = df.sparkSession
    tmp, old = (f"{path}.{k}-{uuid.uuid4().hex}" for k in ("tmp", "old"))
    df.write.options(**options).parquet(tmp)
    jvm = spark.sparkContext._jvm
    p = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(p(path))
    if had and not fs.rename(p(path), p(old)):
        raise OSError(f"{path} could not be set aside")
    if not fs.rename(p(tmp), p(path)):
        if had:
            fs.rename(p(old), p(path))
        raise OSError(f"{path} could not be written")
    if had:
        fs.delete(p(old), True)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A bounded table as text; numbers with four digits after the point, bars in cells as slashes. More rows than most are an error."""
    cells = [F.coalesce(F.format_string("%.4f", F.col(c).cast("double")) if t in ("double", "float") else F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("/")), F.lit("")).alias(c) for c, t in df.dtypes]
    rows = df.select(*cells).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; export the table as text instead")
    line = lambda x: "| " + " | ".join(x) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(list(r)) for r in rows)])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def export_csv(df: DataFrame, path: str, rows: int | None = None) -> None:
    """As CSV with a header; rows keeps the first so many, as a preview."""
    (df.limit(rows) if rows else df).write.option("header", True).csv(path)
