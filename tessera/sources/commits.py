"""Bundles of tables that appear at once, what they hold by digest, and their export as texts."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.bundles import _path, exists
from tessera.sources.tables import digests, markdown

MANIFEST = "manifest.json"
#: Kinds of tables in a bundle, and of files in an export.
KINDS = ("parquet", "json", "csv", "tsv")
TEXTS, FIGURES = ("json", "tsv", "csv", "md", "txt"), ("png", "jpg", "jpeg", "pdf", "svg")
#: What an export never holds, by folder, name and beginning of a name.
NEVER_IN, NEVER, NEVER_AS = {"qc", "qc_tables", "__pycache__"}, {".ds_store", "manifest.json", "qc_report.json"}, ("qc_",)


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and renamed over what was there, in one step."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    tmp = f"{path}.{uuid.uuid4().hex}"
    p, fs = _path(spark, tmp)
    out = fs.create(p)
    out.write(bytearray(text.encode()))
    out.close()
    overwrite = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(p, jvm.org.apache.hadoop.fs.Path(path), overwrite)


def _write(df: DataFrame, path: str, kind: str) -> None:
    if kind not in KINDS:
        raise ValueError(f"no such kind of table: {kind}")
    w = df.write
    if kind in ("csv", "tsv"):
        w.csv(path, header=True, sep="\t" if kind == "tsv" else ",")
    else:
        w.format(kind).save(path)


def _read(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.csv(path, header=True, sep="\t" if kind == "tsv" else ",") if kind in ("csv", "tsv") else reader.format(kind).load(path)


@dataclass(frozen=True)
class Bundle:
    """What a manifest names: its tables are read from the version that it was written with."""

    spark: SparkSession
    root: str
    manifest: dict

    def table(self, name: str) -> DataFrame:
        t = self.manifest["tables"].get(name)
        if t is None:
            raise KeyError(f"no table {name} in {self.root}")
        return _read(self.spark, f"{self.root}/{self.manifest['version']}/{name}", t["kind"], t["schema"])

    def checked(self) -> DataFrame:
        """(table, sha256, found, whole): the tables' digests as committed and as they are."""
        rows = [(name, t["sha256"]) for name, t in self.manifest["tables"].items()]
        told = self.spark.createDataFrame(rows, "table string, sha256 string")
        found = _digest(self.spark, f"{self.root}/{self.manifest['version']}").select("table", F.col("sha256").alias("found"))
        return told.join(found, "table", "left").withColumn("whole", F.coalesce(F.col("sha256") == F.col("found"), F.lit(False)))


def _digest(spark: SparkSession, at: str) -> DataFrame:
    """(table, files, bytes, sha256) under a version: of each table the digest of its files' digests, in the order of their names."""
    files = digests(spark, at).where(~F.col("path").rlike(r"/[._][^/]*$"))
    name = F.element_at(F.split(F.substring_index("path", at.rstrip("/").rsplit("/", 1)[-1] + "/", -1), "/"), 1)
    one = F.concat_ws(" ", F.substring_index("path", "/", -1), "sha256")
    return files.groupBy(name.alias("table")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(one)), "\n"), 256).alias("sha256"))


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], kinds: dict[str, str] | None = None, meta: dict | None = None) -> Bundle:
    """Writes tables as a new version of the bundle at root; readers see all of them or none.

    Tables go to a folder of their own, are hashed there, and the manifest, which names the folder, their kinds, schemas and digests, is put
    in place last, in one step. Whatever fails before leaves the old manifest, and so the old tables, as they were.
    """
    version = f"v-{uuid.uuid4().hex}"
    kinds = kinds or {}
    for name, df in tables.items():
        _write(df, f"{root}/{version}/{name}", kinds.get(name, "parquet"))
    found = {r.table: r for r in _digest(spark, f"{root}/{version}").collect()}
    told = {
        name: {"kind": kinds.get(name, "parquet"), "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "files": found[name].files, "bytes": found[name].bytes, "sha256": found[name].sha256}
        for name, df in tables.items()
    }
    manifest = {"version": version, "tables": told, "meta": meta or {}}
    _put(spark, f"{root}/{MANIFEST}", json.dumps(manifest, indent=1, sort_keys=True))
    return Bundle(spark, root, manifest)


def bundle(spark: SparkSession, root: str) -> Bundle:
    """The committed bundle at root; an error if none was ever committed."""
    if not exists(spark, f"{root}/{MANIFEST}"):
        raise FileNotFoundError(f"{root}/{MANIFEST}")
    return Bundle(spark, root, json.loads(_text(spark, f"{root}/{MANIFEST}")))


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Deletes the versions that the manifest does not name: old ones and those of failed writes. No one may be writing or reading them."""
    held = bundle(spark, root).manifest["version"]
    p, fs = _path(spark, root)
    gone = [x.getPath() for x in fs.listStatus(p) if x.isDirectory() and x.getPath().getName().startswith("v-") and x.getPath().getName() != held]
    for x in gone:
        fs.delete(x, True)
    return sorted(x.getName() for x in gone)


def json_markdown(title: str, value) -> str:
    """A JSON value as headings and lists."""
    def lines(v, level: int) -> list[str]:
        if isinstance(v, dict):
            flat = [f"- **{k}**: {scalar(x)}" for k, x in v.items() if not isinstance(x, (dict, list))]
            return flat + [y for k, x in v.items() if isinstance(x, (dict, list)) for y in ["", f"{'#' * min(level, 6)} {k}", "", *lines(x, level + 1)]]
        if isinstance(v, list):
            return [y for k, x in enumerate(v) for y in ([f"- {scalar(x)}"] if not isinstance(x, (dict, list)) else ["", f"{'#' * min(level, 6)} {k + 1}", "", *lines(x, level + 1)])]
        return [f"- {scalar(v)}"] if v is not None else []

    def scalar(x) -> str:
        return "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x)

    body = lines(value, 2)
    return "\n".join([f"# {title}", "", *(body or ["No content."]), ""])


def export(spark: SparkSession, source: str, target: str, rules: dict[str, set[str]], groups: set[str] | None = None, samples: set[str] | None = None, kind: str = "csv", rows: int | None = None) -> DataFrame:
    """Texts of the bundles source/<group>/<sample>/<stage>_bundle, and the catalogue of what was written.

    rules has the files of each stage that may go, by their path in the bundle; folders and files of quality control and
    manifests never go. Tables become text of the given kind with rows at most if told, JSON becomes Markdown, other files
    are copied. A name is <group>.<sample>.<path>, with __ for the slashes. The catalogue (group, sample, stage, kind,
    source, export) is also written beside, as export_catalog.tsv; an earlier export of a sample is replaced.
    """
    if kind not in ("csv", "tsv"):
        raise ValueError(f"no such kind of text: {kind}")
    found = []
    for group, at in _folders(spark, source, groups):
        for sample, here in _folders(spark, at, samples):
            tasks = [(stage, path, full) for stage in rules if exists(spark, f"{here}/{stage}_bundle") for path, full in _allowed(spark, f"{here}/{stage}_bundle", rules[stage])]
            out = f"{target}/{group}/{sample}"
            if tasks and exists(spark, out):
                p, fs = _path(spark, out)
                fs.delete(p, True)
            found += [(group, sample, stage, *_exported(spark, path, full, f"{out}/{stage}/{group}.{sample}.{path.replace('/', '__')}", kind, rows)) for stage, path, full in tasks]
    catalogue = spark.createDataFrame(sorted(found), "group string, sample string, stage string, kind string, source string, export string")
    catalogue.coalesce(1).write.mode("overwrite").csv(f"{target}/export_catalog.tsv", header=True, sep="\t")
    return catalogue


def _folders(spark: SparkSession, at: str, selected: set[str] | None) -> list[tuple[str, str]]:
    p, fs = _path(spark, at)
    names = sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory())
    return [(n, f"{at}/{n}") for n in names if not selected or n in selected]


def _allowed(spark: SparkSession, at: str, rules: set[str]) -> list[tuple[str, str]]:
    out = []
    for path in sorted(rules):
        parts = path.lower().split("/")
        end = parts[-1].rsplit(".", 1)[-1]
        never = NEVER_IN & set(parts) or parts[-1] in NEVER or (end not in FIGURES and parts[-1].startswith(NEVER_AS))
        if not never and end in (*TEXTS, *FIGURES, "parquet") and exists(spark, f"{at}/{path}"):
            out.append((path, f"{at}/{path}"))
    return out


def _exported(spark: SparkSession, path: str, full: str, to: str, kind: str, rows: int | None) -> tuple[str, str, str]:
    stem, end = to.rsplit(".", 1)
    if end in ("parquet", "tsv"):
        df = spark.read.parquet(full) if end == "parquet" else spark.read.csv(full, header=True, sep="\t")
        df = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
        as_ = kind if end == "parquet" else "csv"
        _write(df.limit(rows) if rows else df, f"{stem}.{as_}", as_)
        return "table", full, f"{stem}.{as_}"
    if end == "json":
        _put_new(spark, f"{stem}.md", json_markdown(path.rsplit("/", 1)[-1].rsplit(".", 1)[0], json.loads(_text(spark, full))))
        return "table", full, f"{stem}.md"
    p, fs = _path(spark, full)
    q, to_fs = _path(spark, to)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to_fs, q, False, spark.sparkContext._jsc.hadoopConfiguration())
    return "figure" if end in FIGURES else "table" if end == "csv" else "document", full, to


def _put_new(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _path(spark, path.rsplit("/", 1)[0])
    fs.mkdirs(p)
    _put(spark, path, text)


def put_markdown(df: DataFrame, path: str, most: int = 1000) -> None:
    """A bounded table as a Markdown file; one with more rows is an error, not a part of it."""
    _put_new(df.sparkSession, path, markdown(df, most))
