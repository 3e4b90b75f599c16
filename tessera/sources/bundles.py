"""Stage inputs: optional tables, catalogues with overrides, location and listing of bundles, and their assembly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import require


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at path, in any store that Spark reads."""
    p, fs = _path(spark, path)
    return fs.exists(p)


def read_table(spark: SparkSession, path: str, schema: str, kind: str | None = None) -> DataFrame | None:
    """A table of text with a header by its kind (csv or tsv; else by the path's ending); None where there is none.

    The schema is given and not guessed, so the text is read once; a header that differs from it is an error.
    """
    if not exists(spark, path):
        return None
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in ("csv", "tsv"):
        return None
    return spark.read.schema(schema).csv(path, header=True, sep="\t" if kind == "tsv" else ",", enforceSchema=False)


def read_records(spark: SparkSession, path: str, schema: str, key: str, required: bool = False) -> tuple[DataFrame, dict]:
    """A JSON list of records by their trimmed key, of equal keys the last; and whether it was there.

    Records without the key are left out. Where there is no file the table is empty, or it is an error if required.
    """
    if not exists(spark, path):
        if required:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema), {"available": False, "path": path, "reason": "missing"}
    rows = spark.read.schema(schema).json(path, multiLine=True).withColumn("pos", F.monotonically_increasing_id())
    return last_record(rows.withColumn(key, F.trim(key)).where(F.coalesce(key, F.lit("")) != ""), key, "pos"), {"available": True, "path": path, "reason": "loaded"}


def last_record(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last by order, without order."""
    kept = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*kept), order).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in kept])


def first_present(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """For each group the first value by order of each column that is neither null nor NaN."""
    kinds = dict(rows.dtypes)
    kept = [c for c in rows.columns if c not in (*by, order)]

    def present(c: str):
        fine = F.col(c).isNotNull()
        return fine & ~F.isnan(c) if kinds[c] in ("double", "float") else fine

    return rows.groupBy(*by).agg(*[F.min_by(c, F.when(present(c), F.col(order))).alias(c) for c in kept])


def merged_axes(common: DataFrame, special: DataFrame, key: str = "axis_id", deep: tuple[str, ...] = ("gating", "weights")) -> DataFrame:
    """A catalogue with the records of another laid over it: a value that is there replaces the common one, in the map
    columns deep entry by entry. Both have the same columns; records of either alone stay."""
    require(common, key, *deep)
    a, b = common.alias("a"), special.alias("b")
    none = F.create_map().cast

    def column(c: str):
        old, new = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c not in deep:
            return F.coalesce(new, old).alias(c)
        kind = common.schema[c].dataType
        old, new = F.coalesce(old, none(kind)), F.coalesce(new, none(kind))
        kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
        return F.map_concat(kept, new).alias(c)

    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*[column(c) for c in common.columns])


def locate(spark: SparkSession, bundle: str, name: str, override: str | None = None, manifest: dict | None = None) -> str:
    """Where a stage's input bundle is: the override (an error if absent), else the manifest's path, else beside bundle."""
    if override:
        if not exists(spark, override):
            raise FileNotFoundError(f"the given {name} does not exist: {override}")
        return override
    told = str((manifest or {}).get("inputs", {}).get(f"{name}_path") or "").strip()
    if told and exists(spark, told):
        return told
    beside = f"{bundle.rstrip('/').rsplit('/', 1)[0]}/{name}"
    if exists(spark, beside):
        return beside
    raise FileNotFoundError(f"no {name} beside {bundle}; give its path")


def listed(spark: SparkSession, root: str, name: str, marker: str, samples: set[str] | None = None) -> list[str]:
    """Paths root/<sample>/<name> of all bundles that have the marker file, by sample, of the given samples alone."""
    p, fs = _path(spark, root)
    if not fs.exists(p):
        return []
    found = [x.getPath().toString() for x in fs.listStatus(p) if x.isDirectory()]
    found = [x for x in sorted(found) if not samples or x.rsplit("/", 1)[-1] in samples]
    return [f"{x}/{name}" for x in found if exists(spark, f"{x}/{name}/{marker}")]


def gathered(spark: SparkSession, bundles: list[str], table: str, columns: dict[str, str]) -> tuple[DataFrame, list[dict]]:
    """One table from all bundles, with the sample by path; bundles that lack the table or a column are told and left out."""
    parts, errors = [], []
    for path in bundles:
        sample = path.rsplit("/", 2)[-2]
        try:
            df = require(spark.read.parquet(f"{path}/{table}"), *columns)
            parts.append(df.select(F.lit(sample).alias("sample"), *[F.col(c).cast(t).alias(c) for c, t in columns.items()]))
        except Exception as e:  # whatever is wrong with one bundle must not stop the others
            errors.append({"sample": sample, "path": f"{path}/{table}", "error": str(e).split("\n")[0]})
    schema = "sample string, " + ", ".join(f"{c} {t}" for c, t in columns.items())
    out = spark.createDataFrame([], schema)
    for df in parts:
        out = out.unionByName(df)
    return out, errors


@dataclass(frozen=True)
class StageInputs:
    """Tables of one stage, and the canonical order of its spots."""

    programs: DataFrame
    activation: DataFrame
    qc: DataFrame | None
    order: DataFrame


def assemble(spark: SparkSession, bundle: str, n_neighbours: int | None = None, need_qc: bool = True) -> StageInputs:
    """The inputs of the domain stage from a program bundle: programs, activation, quality table and spot order.

    Programs, activation and order are required files, the quality table if need_qc; columns are checked. The order
    numbers every spot once, with as many spots as the neighbour table has rows if that is given, and every active spot
    must be in it.
    """
    def table(name: str, *columns: str, required: bool = True) -> DataFrame | None:
        if not exists(spark, f"{bundle}/{name}.parquet"):
            if required:
                raise FileNotFoundError(f"{bundle}/{name}.parquet")
            return None
        return require(spark.read.parquet(f"{bundle}/{name}.parquet"), *columns)

    programs, activation = table("programs", "program", "gene"), table("activation", "program", "spot", "value")
    qc, order = table("qc", "program", required=need_qc), table("spots", "spot", "idx")
    n, distinct, low, high = order.agg(F.count(F.lit(1)), F.count_distinct("spot"), F.min("idx"), F.max("idx")).first()
    if n != distinct or n and (low, high) != (0, n - 1):
        raise ValueError("spots are not numbered from 0, each once")
    if n_neighbours is not None and n != n_neighbours:
        raise ValueError(f"{n} spots, but {n_neighbours} rows of neighbours")
    if not activation.join(order, "spot", "left_anti").isEmpty():
        raise ValueError("activation has unknown spots")
    return StageInputs(programs, activation, qc, order)
