"""NumPy array files as tables: row ranges as partitions, read by bytes."""

from __future__ import annotations

import io
import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of a partition in the mean, and rows of a batch.
PART_BYTES, BATCH_ROWS = 32 << 20, 1024
INDEX = "index.json"
#: Spark's types of NumPy's, by kind and bytes; texts are U and S of any length.
_TYPES = {"b1": "boolean", "i1": "byte", "i2": "short", "i4": "int", "i8": "long", "u1": "short", "u2": "int", "u4": "long", "f4": "float", "f8": "double"}


def _kind(dtype: np.dtype) -> str:
    name = "string" if dtype.kind in "US" else _TYPES.get(f"{dtype.kind}{dtype.itemsize}")
    if name is None:
        raise ValueError(f"arrays of {dtype} can't be read as a table")
    return name


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def header(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, dtype, where the data begins) of an array file; one that holds objects or lies column by column is an error."""
    store, at = _open(path)
    with store.open_input_file(at) as f:
        head = io.BytesIO(f.read(1 << 16))
    version = np.lib.format.read_magic(head)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if dtype.hasobject:
        raise ValueError(f"{path} holds Python objects")
    if fortran and len(shape) > 1:
        raise ValueError(f"{path} lies column by column")
    if len(shape) not in (1, 2):
        raise ValueError(f"{path} has {len(shape)} dimensions; tables have one or two")
    return shape, dtype, head.tell()


def _files(path: str) -> list[tuple[str, int]]:
    """(file, number of its first row): the file itself, or those that a folder's index names."""
    store, at = _open(path)
    if store.get_file_info(at).type != fs.FileType.Directory:
        return [(path, 0)]
    with store.open_input_file(f"{at}/{INDEX}") as f:
        return [(f"{path}/{x['file']}", x["first"]) for x in json.loads(f.read())]


@dataclass
class _Rows(InputPartition):
    path: str
    first: int
    low: int
    high: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Rows]:
        out = []
        for path, first in _files(self.path):
            shape, dtype, _ = header(path)
            step = max(1, PART_BYTES // max(1, dtype.itemsize * int(np.prod(shape[1:]))))
            out += [_Rows(path, first, low, min(low + step, shape[0])) for low in range(0, shape[0], step)]
        return out

    def read(self, part: _Rows):
        shape, dtype, at = header(part.path)
        width = int(np.prod(shape[1:]))
        store, name = _open(part.path)
        with store.open_input_file(name) as f:
            f.seek(at + part.low * width * dtype.itemsize)
            for low in range(part.low, part.high, BATCH_ROWS):
                n = min(BATCH_ROWS, part.high - low)
                x = np.frombuffer(f.read(n * width * dtype.itemsize), dtype)
                if len(x) != n * width:
                    raise ValueError(f"{part.path} ends before its shape does")
                flat = pa.array([v.decode() if isinstance(v, bytes) else v for v in x.tolist()], pa.string()) if dtype.kind in "US" else pa.array(x.astype(dtype.newbyteorder("=")), _arrow(dtype))
                values = flat if len(shape) == 1 else pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, low + n) + part.first, pa.int64()), values], names=["idx", "values"])


def _arrow(dtype: np.dtype) -> pa.DataType:
    return {"boolean": pa.bool_(), "byte": pa.int8(), "short": pa.int16(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64()}[_kind(dtype)]


@dataclass
class _Written(WriterCommitMessage):
    file: str
    first: int
    rows: int


class _Writer(DataSourceWriter):
    """A file of each task; the index, which names them in the order of their rows, comes last, so a failed task leaves nothing behind that is read."""

    def __init__(self, path: str, dtype: str):
        self.path, self.dtype = path, dtype

    def write(self, rows) -> _Written:
        held = [(r[0], r[1]) for r in rows]
        if not held:
            return _Written("", 0, 0)
        ids = np.array([k for k, _ in held])
        order = np.argsort(ids)
        ids = ids[order]
        if (np.diff(ids) != 1).any():
            raise ValueError("a task's rows are not numbered without gaps")
        x = np.array([held[k][1] for k in order], self.dtype)
        store, at = _open(self.path)
        store.create_dir(at)
        name = f"part-{ids[0]:012d}-{uuid.uuid4().hex}.npy"
        with store.open_output_stream(f"{at}/{name}") as f:
            out = io.BytesIO()
            np.lib.format.write_array(out, np.ascontiguousarray(x), allow_pickle=False)
            f.write(out.getvalue())
        return _Written(name, int(ids[0]), len(ids))

    def commit(self, messages) -> None:
        good = sorted((m.first, m.rows, m.file) for m in messages if m is not None and m.rows)
        if any(a + n != b for (a, n, _), (b, _, _) in zip(good, good[1:], strict=False)) or good and good[0][0]:
            raise ValueError("rows are not numbered from 0 without gaps")
        store, at = _open(self.path)
        store.create_dir(at)
        with store.open_output_stream(f"{at}/{INDEX}") as f:
            f.write(json.dumps([{"file": name, "first": first} for first, _, name in good]).encode())

    def abort(self, messages) -> None:
        store, at = _open(self.path)
        for m in messages:
            if m is not None and m.rows:
                store.delete_file(f"{at}/{m.file}")


class NpySource(DataSource):
    """spark.read.format("npy").load(path): (idx, values) of a file, or of a folder that format("npy") has written."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"{self.options['path']} has no rows")
        shape, dtype, _ = header(files[0][0])
        return f"idx long, values {_kind(dtype)}" if len(shape) == 1 else f"idx long, values array<{_kind(dtype)}>"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        kind = schema["values"].dataType.simpleString()
        kind = kind.removeprefix("array<").removesuffix(">")
        return _Writer(self.options["path"], {"float": "f4", "double": "f8", "int": "i4", "bigint": "i8", "smallint": "i2", "tinyint": "i1", "boolean": "b1", "string": "U"}[kind])


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(idx, values): the rows of an array by number; values are arrays if there are two dimensions. Each partition reads its own bytes."""
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").load(path)


def write_npy(df: DataFrame, path: str, parts: int) -> None:
    """Writes (idx, values) as array files in a folder, parts of them, by ranges of idx, which numbers the rows from 0."""
    df.sparkSession.dataSource.register(NpySource)
    ranged = df.select("idx", "values").repartitionByRange(parts, "idx")
    ranged.write.format("npy").mode("append").save(path)
