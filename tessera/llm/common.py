"""Shared storage and Arrow helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numeric step handles at a time (one longer text is one step).
STEP_BYTES = 2 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, one of our own if driver and executors
    are one process, else an error, as a folder of the driver's machine would not be shared."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str, files: int | None = None, compression: str = "snappy") -> DataFrame:
    """Writes df once into the shared folder and reads it back, which cuts lineage and survives lost executors.

    files bounds how many files it takes: for tables known to be small, so that they are not cut into splinters. The last
    step that makes df then has as many tasks, so it must be a light one.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote. Nothing that is still to be evaluated may read them."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows in this session, unless it asks for fewer: a batch of texts is held whole,
    on both sides, by each of an executor's workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with at most limit bytes of text (or one row), with their flat text."""
    for batch in batches:
        data, at = flat(batch.column(batch.schema.get_field_index(column)))
        low, n = 0, batch.num_rows
        while low < n:
            high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
            yield batch.slice(low, high - low), data[at[low] : at[high]], at[low : high + 1] - at[low]
            low = high
    give_back()


def give_back() -> None:
    """Returns what Arrow and the C library hold free to the system: an idle worker shares the executor's memory with others."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def binaries(parts: list[np.ndarray]) -> pa.Array:
    """A binary column of the arrays' bytes."""
    return pa.array([x.tobytes() for x in parts], pa.binary())


#: Bits of the tables that are sent to every task: half a MiB, whatever they stand for.
TABLE_BITS = 1 << 22


def bit_table(keys: DataFrame, column: str = "h") -> bytes:
    """A bit for the low bits of each 64-bit number in a column, TABLE_BITS in all: it rules out most other numbers."""
    bit = F.col(column).bitwiseAND(F.lit(TABLE_BITS - 1))
    rows = keys.groupBy(F.shiftright(bit, 15).alias("part")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    filled = bytearray(TABLE_BITS // 8)
    for r in rows:
        filled[r.part * 4096 : r.part * 4096 + 4096] = r.bits
    return bytes(filled)


def in_table(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which 64-bit numbers a bit_table (as an array of bytes) may hold."""
    return (bits[(numbers & np.uint64(TABLE_BITS - 1)).astype(np.int64) >> 3] >> (numbers & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from all columns (capitals don't count)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
