"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and exact reranking."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import clusters
from tessera.llm.common import stored

LEAST_COSINE = 0.98
#: The rotation is learned from at most this many vectors, those with the smallest hashes of vec_id.
SAMPLE = 8192
ROUNDS = 40
BITS = 64
#: Tables at least, whatever the number of vectors: with keys one bit away on both sides, codes that differ in
#: 3 * TABLES - 1 bits are sure to meet. Longer keys would make shorter lists, but fewer tables.
TABLES = 5
#: Two codes further apart are not candidates, unless more flips are measured at the least cosine: in isotropic vectors
#: 4 of 64 bits differ in the mean (deviation 2).
APART = 16
#: Deviations above the mean up to which flipped bits are expected.
DEVIATIONS = 5


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two, so that products of tiny or huge components neither vanish nor overflow; no digit is lost."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def learn(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean and a projection (dimension, bits): principal directions, rotated so that signs lose the least.

    Few vectors have no mean taken off, as it would stand between near ones and turn all their signs apart.
    """
    dim = sample.shape[1]
    bits = min(BITS, dim)
    if len(sample) <= bits:
        return np.zeros(dim), np.linalg.qr(np.random.default_rng(3).normal(size=(dim, bits)))[0]
    mean = sample.mean(axis=0)
    _, _, axes = np.linalg.svd(sample - mean, full_matrices=False)
    axes = axes[:bits].T
    flat = (sample - mean) @ axes
    turn = np.linalg.qr(np.random.default_rng(3).normal(size=(bits, bits)))[0]
    for _ in range(ROUNDS):
        u, _, w = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
        turn = (u @ w).T
    return mean, axes @ turn


def flips(sample: np.ndarray, mean: np.ndarray, axes: np.ndarray, least: float) -> int:
    """Bits in which the codes of two vectors at cosine least are expected to differ at most.

    Measured on the sample's unit vectors, each with a partner in a random direction of the projection's own space.
    """
    side = np.random.default_rng(5).normal(size=(len(sample), axes.shape[1])) @ axes.T
    side -= (side * sample).sum(axis=1, keepdims=True) * sample
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-300)
    other = least * sample + np.sqrt(max(0.0, 1 - least * least)) * side
    n = (((sample - mean) @ axes >= 0) != ((other - mean) @ axes >= 0)).sum(axis=1)
    return min(axes.shape[1], int(np.ceil(n.mean() + DEVIATIONS * n.std())))


def layout(apart: int) -> tuple[int, int]:
    """(tables, width): codes that differ in apart bits are sure to meet, and in 3 * TABLES - 1 at any rate."""
    tables = max(TABLES, -(-(apart + 1) // 3))
    return tables, BITS // tables


def _matrix(column: pa.Array) -> tuple[list[np.ndarray | None], np.ndarray]:
    """Vectors as doubles, and which of them can be compared: not null, no null or non-finite component, not zero."""
    out, fine = [], np.zeros(len(column), bool)
    for k, x in enumerate(column):
        values = None if not x.is_valid else x.values
        if values is None or values.null_count or not len(values):
            out.append(None)
            continue
        v = values.to_numpy(zero_copy_only=False).astype(np.float64)
        out.append(v)
        fine[k] = bool(np.isfinite(v).all() and (v != 0).any())
    return out, fine


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors, fine = _matrix(batch.column(2))
        labels = batch.column(1).to_pylist()
        keys, raw = [], []
        for v, ok, label in zip(vectors, fine, labels, strict=True):
            good = ok and label is not None
            raw.append(v.tobytes() if good else None)
            keys.append(hashlib.blake2b(f"{label}/{len(v)}/".encode() + (v + 0.0).tobytes(), digest_size=16).digest() if good else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "label", "v", "raw"])


def _coded(models: dict[int, tuple[np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.frombuffer(x) for x in batch.column(batch.schema.get_field_index("raw")).to_pylist()]
            codes = np.zeros(len(raw), np.int64)
            for dim in {len(x) for x in raw}:
                own = [k for k, x in enumerate(raw) if len(x) == dim]
                x = np.stack([raw[k] for k in own])
                x = _scaled(x)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                mean, axes = models.get(dim) or learn(np.zeros((0, dim)))
                sign = np.zeros((len(own), BITS), np.uint8)
                sign[:, : axes.shape[1]] = (x - mean) @ axes >= 0
                codes[own] = np.packbits(sign, axis=1, bitorder="little").view("<i8").ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in raw], pa.int32()), pa.array(codes), pa.array([x.tobytes() for x in codes], pa.binary())], names=["v", "label", "dim", "code", "sketch"])

    return run


def _near(apart: int):
    """Which codes differ from one in apart bits at most."""
    return lambda codes, one: np.bitwise_count(codes ^ one).sum(axis=-1, dtype=np.uint8) <= apart


def _counted(held: dict[str, list], least: float) -> dict[str, list]:
    """For one unit: a spanning forest of its links, and for each vector how many rows it is linked with."""
    x = _scaled(np.stack([np.frombuffer(r) for r in held["raw"]]))
    own, many = np.array(held["own"]), np.array(held["many"])
    _, i, j = held["unit"]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = u @ u.T
    for a, b in np.argwhere(np.abs(cosine - least) < 1e-12).tolist():  # in plain order where the last digit decides
        cosine[a, b] = np.dot(x[a], x[b]) / np.sqrt(np.dot(x[a], x[a]) * np.dot(x[b], x[b]))
    link = cosine >= least
    np.fill_diagonal(link, False)
    if i != j:
        link &= own[:, None] != own[None, :]
    n = link @ many
    a, b = np.nonzero(np.tril(link))
    forest = clusters.joined(len(x), zip(a.tolist(), b.tolist(), strict=True))
    some = np.flatnonzero(n).tolist()
    v = held["v"]
    return {"a": [v[k] for k in some] + [v[k] for k, _ in forest], "b": [None] * len(some) + [v[k] for _, k in forest], "n": [int(n[k]) for k in some] + [None] * len(forest)}


def links(embeddings: DataFrame, least: float = LEAST_COSINE, block: int = clusters.BLOCK, longest: int = clusters.LIST) -> DataFrame:
    """For each row of embeddings (vec_id, embedding, label): vec_id, n_links, component_id and kept.

    Rows are linked when labels are equal and the cosine is least or more. Rows with a null label, or a vector that is
    null, empty, zero or has null or non-finite components, are linked with nothing; so are vectors of different length.

    Method: signs of a learned rotation give each distinct vector a 64-bit code. The code is cut into the keys of TABLES
    tables, or of more where the flips measured at the least cosine ask for it, never of fewer for the sake of size. A
    vector stands in each table under its key and all keys one bit away, so any two codes that differ by 2 bits or fewer
    in some key meet. Within a list all pairs not yet joined are compared, and those whose codes differ in APART bits (or
    the measured flips) at most are joined to clusters; a list longer than longest is dealt in pairs of blocks. Inside a
    cluster all pairs are decided with the original vectors in double precision, in pairs of blocks; equal vectors are
    one row with a count. Recall is that of the tables; tests measure it.
    """
    base = stored(embeddings.select("vec_id", "label", "embedding").mapInArrow(_prepare, f"vec_id long, label {embeddings.schema['label'].dataType.simpleString()}, v binary, raw binary"), "vectors")
    fine = base.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many"), F.first("label").alias("label"), F.first("raw").alias("raw"))
    fine = stored(fine, "distinct")
    sample: dict[int, list[np.ndarray]] = {}
    for r in fine.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("raw").collect():
        x = _scaled(np.frombuffer(r.raw))
        sample.setdefault(len(x), []).append(x / np.linalg.norm(x))
    models = {dim: learn(np.stack(x)) for dim, x in sample.items()}
    expected = max((flips(np.stack(x), *models[dim], least) for dim, x in sample.items()), default=0)
    tables, width = layout(expected)
    near = _near(max(APART, expected))
    coded = fine.select("v", "label", "raw").mapInArrow(_coded(models), f"v binary, label {fine.schema['label'].dataType.simpleString()}, dim int, code long, sketch binary")
    key = lambda t: F.shiftrightunsigned("code", t * width).bitwiseAND(F.lit((1 << width) - 1))
    posts = F.array(*[F.struct(F.lit(t).alias("t"), k.alias("k")) for t in range(tables) for k in (key(t), *(key(t).bitwiseXOR(F.lit(1 << x)) for x in range(width)))])
    rows = coded.select("v", "sketch", "label", "dim", F.explode(posts).alias("p")).select(F.xxhash64("label", "dim", "p.t", "p.k").alias("token"), "v", "sketch")
    crowded = stored(rows.groupBy("token").count().where(F.col("count") > longest).select("token"), "crowded")
    some = not crowded.isEmpty()
    short = (rows.join(crowded, "token", "left_anti") if some else rows).select("token", "v", "sketch").repartition("token").sortWithinPartitions("token")
    candidates = short.mapInArrow(clusters.in_lists(near, 1), "a binary, b binary")
    if some:
        lists = clusters.blocks(rows.join(crowded, "token", "left_semi").select("v", "sketch", F.col("token").alias("c")), longest)
        candidates = candidates.unionByName(clusters.by_unit(lists, clusters.in_blocks(near, 1), "a binary, b binary", ["v", "sketch"]))
    members = stored(clusters.components(candidates.distinct()), "members")
    dealt = clusters.blocks(fine.select("v", "raw", "many").join(members, "v"), block)
    found = stored(clusters.by_unit(dealt, lambda held: _counted(held, least), "a binary, b binary, n long", ["v", "raw", "many", "own"]), "links")
    counts = found.where("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("n"))
    joined = clusters.components(found.where("n IS NULL").select("a", "b"))
    named = fine.select("v", "rep", "many").join(joined, "v", "left").withColumn("c", F.coalesce("c", "v"))
    smallest = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "c").join(counts, F.col("v") == F.col("a"), "left").select("v", "component_id", (F.coalesce("n", F.lit(0).cast("long")) + F.col("many") - 1).alias("n_links"))
    out = base.select("vec_id", "v").join(named, "v", "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
