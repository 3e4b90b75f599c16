"""Committed bundles, their export, and array files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import arrays as Y
from tessera.sources import commits as C


def test_a_bundle_appears_at_once(spark, tmp_path):
    root = f"{tmp_path}/bundle"
    with pytest.raises(FileNotFoundError):
        C.bundle(spark, root)
    one = {"programs": spark.range(5).withColumn("name", F.concat(F.lit("p,"), "id")), "notes": spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double"), "map": spark.range(3)}
    b = C.commit(spark, root, one, {"notes": "tsv", "map": "json"}, {"seed": 2024})
    assert C.bundle(spark, root).manifest == b.manifest and b.manifest["meta"] == {"seed": 2024}
    for name, df in one.items():
        assert sorted(map(str, b.table(name).collect())) == sorted(map(str, df.collect())) and b.table(name).schema.simpleString() == df.schema.simpleString()
    assert b.checked().where("whole").count() == 3
    with pytest.raises(Exception, match="broken"):  # the second table fails while it is written
        C.commit(spark, root, {"programs": spark.range(9), "notes": spark.range(9).select(F.raise_error(F.lit("broken")).alias("x"))})
    with pytest.raises(ValueError):
        C.commit(spark, root, {"programs": spark.range(9)}, {"programs": "npz"})
    still = C.bundle(spark, root)
    assert still.manifest == b.manifest and still.table("programs").count() == 5
    two = C.commit(spark, root, {"programs": spark.range(7)})
    assert C.bundle(spark, root).table("programs").count() == 7 and b.table("programs").count() == 5  # an open reader keeps its version
    assert b.manifest["version"] in C.vacuum(spark, root) and C.bundle(spark, root).table("programs").count() == 7
    with pytest.raises(KeyError):
        two.table("notes")
    part = next(p for p in (tmp_path / "bundle" / two.manifest["version"] / "programs").glob("part-*"))
    (part.parent / f".{part.name}.crc").unlink()  # else the store itself refuses to read it
    part.write_bytes(part.read_bytes()[:-1] + b"x")
    assert [r.whole for r in two.checked().collect()] == [False]


RULES = {"program": {"programs.parquet", "notes/hits.tsv", "meta.json", "qc/x.parquet", "qc_plot.png", "plot/a.png", "qc_report.json"}, "niche": {"members.parquet"}, "domain": {"none.parquet"}}


def test_export(spark, tmp_path):
    source, target = tmp_path / "in", f"{tmp_path}/out"
    for group, sample in (("g1", "s1"), ("g1", "s2"), ("g2", "s3")):
        at = f"{source}/{group}/{sample}/program_bundle"
        spark.range(4).withColumn("list", F.array("id")).write.parquet(f"{at}/programs.parquet")
        spark.range(2).write.parquet(f"{at}/qc/x.parquet")
        spark.range(2).write.parquet(f"{at}/secret.parquet")
        for name, text in {"notes/hits.tsv": "a\tb\n1\tx,y\n", "meta.json": json.dumps({"n": 3, "on": True, "in": {"k": None}, "of": [1, {"z": 2}]}), "qc_plot.png": "q", "plot/a.png": "p", "qc_report.json": "{}"}.items():
            path = source / group / sample / "program_bundle" / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
    spark.range(3).write.parquet(f"{source}/g1/s1/niche_bundle/members.parquet")
    got = C.export(spark, str(source), target, RULES, {"g1"}, rows=2)
    want = {("g1", s, "program", k, f"{target}/g1/{s}/program/g1.{s}.{n}") for s in ("s1", "s2") for k, n in (("table", "programs.csv"), ("table", "notes__hits.csv"), ("table", "meta.md"), ("figure", "plot__a.png"), ("figure", "qc_plot.png"))}
    want.add(("g1", "s1", "niche", "table", f"{target}/g1/s1/niche/g1.s1.members.csv"))
    assert {(r.group, r.sample, r.stage, r.kind, r.export) for r in got.collect()} == want
    assert spark.read.csv(f"{target}/export_catalog.tsv", header=True, sep="\t").count() == len(want)
    table = spark.read.csv(f"{target}/g1/s1/program/g1.s1.programs.csv", header=True).collect()
    assert len(table) == 2 and table[0]["list"] == f"[{table[0].id}]"
    assert spark.read.csv(f"{target}/g1/s1/program/g1.s1.notes__hits.csv", header=True).first() == ("1", "x,y")
    text = open(f"{target}/g1/s1/program/g1.s1.meta.md").read()
    assert text.startswith("# meta\n\n- **n**: 3\n- **on**: true\n\n## in\n\n- **k**: null\n\n## of\n\n- 1\n\n### 2\n\n- **z**: 2\n")
    assert C.export(spark, str(source), target, RULES, None, {"s3"}, "tsv").count() == 5
    assert C.json_markdown("t", None) == "# t\n\nNo content.\n"
    with pytest.raises(ValueError):
        C.put_markdown(spark.range(11), f"{tmp_path}/m.md", 10)
    C.put_markdown(spark.range(2), f"{tmp_path}/m.md")
    assert open(f"{tmp_path}/m.md").read() == "| id |\n| --- |\n| 0 |\n| 1 |"


@pytest.mark.parametrize("array", [np.arange(30, dtype="<i8").reshape(10, 3), np.linspace(0, 1, 7, dtype="f4"), np.array(["a", "bcd", "é"]), np.array([[True, False]] * 5), np.arange(12, dtype=">i4").reshape(4, 3), np.zeros((3, 0)), np.array([b"x", b"yz"])])
def test_npy(spark, tmp_path, monkeypatch, array):
    path = f"{tmp_path}/x.npy"
    np.save(path, array)
    got = Y.read_npy(spark, path).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(len(array)))
    want = [x.decode() if isinstance(x, bytes) else x for x in array.tolist()]
    assert [list(r["values"]) if array.ndim == 2 else r["values"] for r in got] == want


def test_npy_in_parts(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(1).normal(size=(1000, 16)).astype("f4")
    np.save(f"{tmp_path}/x.npy", x)
    monkeypatch.setattr(Y, "PART_BYTES", 64 * 150)
    parts = Y._Reader(f"{tmp_path}/x.npy").partitions()
    assert [(p.low, p.high) for p in parts] == [(k, min(k + 150, 1000)) for k in range(0, 1000, 150)]
    df = Y.read_npy(spark, f"{tmp_path}/x.npy")
    Y.write_npy(df, f"{tmp_path}/y", 3)
    again = Y.read_npy(spark, f"{tmp_path}/y")
    assert sorted(map(str, again.collect())) == sorted(map(str, df.collect())) and len(list((tmp_path / "y").glob("*.npy"))) == 3


def test_npy_that_is_no_table(spark, tmp_path):
    for name, x in {"o": np.array([{}], object), "f": np.asfortranarray(np.zeros((3, 2))), "d": np.zeros((2, 2, 2)), "c": np.zeros(3, complex)}.items():
        np.save(f"{tmp_path}/{name}.npy", x)
        with pytest.raises(Exception, match="objects|column|dimensions|complex"):
            Y.read_npy(spark, f"{tmp_path}/{name}.npy").collect()
    with pytest.raises(Exception, match="gaps"):
        Y.write_npy(spark.createDataFrame([(0, 1.0), (2, 1.0)], "idx long, values double"), f"{tmp_path}/g", 1)
