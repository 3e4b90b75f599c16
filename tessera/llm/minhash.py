"""MinHash near-duplicates through an inverted join on signature coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import clusters
from tessera.llm.common import binaries, discard, flat, small_batches, steps, stored, unused
from tessera.llm.words import SPACED, digest, mix, shingles, words

COORDINATES = 64
#: Sets with this many equal coordinates are sure to meet: at 0.75 a pair has fewer with a chance of 1.4e-6.
SURE = 31
#: Postings a document: its smallest (coordinate, value) hashes in an order that is the same for all documents. Of two
#: sets with SURE in common, so many on each side cannot all be the others, whatever the order.
PREFIX = COORDINATES - SURE + 1
#: Of 64 coordinates compared by two bits each, 0.75 similar sets agree on 52 (deviation 3.1).
AGREE = 37
#: Sets of one block of a cluster at most; their bytes are bounded, too.
BLOCK = 1024
#: Pairs that more sets than this have come last in the order, so only sets with little else post them; PREFIX holds for
#: any order, so this changes how long lists get and no result.
HOT = clusters.LIST

_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(0, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDINATES minima for each set; empty sets must not be among them."""
    if not sets:
        return np.zeros((0, COORDINATES), np.uint32)
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate(([0], np.cumsum([len(x) for x in sets])[:-1]))
    return np.stack([np.minimum.reduceat(values * a + b, at) for a, b in zip(_A, _B, strict=True)], axis=1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, at in steps(batches):
        sets = shingles(*words(data, at, SPACED))
        full = np.array([len(x) for x in sets])
        signatures: list[bytes | None] = [None] * len(sets)
        for k, x in zip(np.flatnonzero(full).tolist(), _signatures([x for x in sets if len(x)]), strict=True):
            signatures[k] = x.tobytes()
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(2), pa.array(full, pa.int64()), pa.array([digest(x) for x in sets], pa.binary()), pa.array(signatures, pa.binary())],
            names=["doc_id", "text_key", "n_shingles", "v", "signature"],
        )


def _named(column: pa.Array) -> np.ndarray:
    """64-bit names of the (coordinate, value) pairs of signatures, a row for each."""
    data, at = flat(column)
    values = data.view("<u4").reshape(len(at) - 1, COORDINATES)
    return mix(values.astype(np.uint64) | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)))


def _counted(buckets: int):
    """(bucket, n): how many pairs of a task's signatures fall into each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount((_named(batch.column(0)) & np.uint64(buckets - 1)).astype(np.int64).ravel(), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["bucket", "n"])

    return run


def _loads(posted: DataFrame, n: int) -> np.ndarray:
    """Upper bounds, by bucket of the pair's name, of how many of n sets have a pair, in powers of two: at most 4 MiB."""
    buckets = 1 << min(22, max(16, (n - 1).bit_length()))
    rows = posted.select("signature").mapInArrow(_counted(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    # one byte a bucket: the exponent of the least power of two that is not below the count
    rows = rows.select("bucket", F.ceil(F.log2("n")).cast("byte").alias("power")).toArrow()
    power = np.zeros(buckets, np.uint8)
    power[rows.column("bucket").to_numpy()] = rows.column("power").to_numpy()
    return power


def _power_of(n: int) -> int:
    """The greatest exponent of a power of two that is not above n."""
    return n.bit_length() - 1


def _posts(power: np.ndarray, longest: int):
    """PREFIX postings (token, v, sketch) of each set, with long where the token's list may be longer than longest."""
    late = np.maximum(power.astype(np.int64) - _power_of(HOT), 0).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                rows = batch.slice(low, 2048)
                named = _named(rows.column(1))
                bucket = (named & np.uint64(len(power) - 1)).astype(np.int64)
                first = np.argsort(late[bucket] << np.uint64(58) | named >> np.uint64(6), axis=1)[:, :PREFIX]
                bits = (mix(named) & np.uint64(3)).astype(np.uint8).reshape(len(named), -1, 4)
                packed = bits[:, :, 0] | bits[:, :, 1] << 2 | bits[:, :, 2] << 4 | bits[:, :, 3] << 6
                each = np.repeat(np.arange(rows.num_rows), first.shape[1])
                at = pa.array(each)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.take_along_axis(named, first, 1).ravel().view(np.int64)), rows.column(0).take(at), binaries(list(packed)).take(at),
                     pa.array(power[np.take_along_axis(bucket, first, 1).ravel()] > _power_of(longest))],
                    names=["token", "v", "sketch", "long"],
                )

    return run


def _agree(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Which sketches, rows of two 64-bit numbers, have AGREE coordinates or more in common with one."""
    other = sketches ^ one
    other |= other >> np.uint64(1)
    other &= np.uint64(0x5555555555555555)
    differ = np.bitwise_count(other)
    return differ[..., 0] + differ[..., 1] <= COORDINATES - AGREE


def _linked(held: dict[str, list], share: float) -> dict[str, list]:
    """A spanning forest of the links among the sets of one unit, from exact intersections."""
    sets = [np.frombuffer(x, np.uint64) for x in held["shingles"]]
    n, size = len(sets), np.array([x.nbytes // 8 for x in sets])
    near = lambda both, a, b: 100 * both >= share * (size[a] + size[b] - both)
    if n <= 8:
        every = ((a, b) for a in range(n) for b in range(a) if near(len(np.intersect1d(sets[a], sets[b], assume_unique=True)), a, b))
        links = clusters.joined(n, every)
    else:
        column = np.unique(np.concatenate(sets), return_inverse=True)[1]
        row = np.repeat(np.arange(n), size)
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        often = np.bincount(column)
        keep = (often > 1)[column]
        column, row = (np.cumsum(often > 1) - 1)[column[keep]], row[keep]
        both = np.zeros((n, n), np.float32)
        ends = np.searchsorted(column, np.arange(0, int(column[-1]) + 2049 if len(column) else 1, 2048))
        for k, (low, high) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            part = np.zeros((n, 2048), np.float32)
            part[row[low:high], column[low:high] - k * 2048] = 1
            both += part @ part.T
        a, b = np.nonzero(np.tril(100 * both >= share * (size[:, None] + size[None, :] - both), -1))
        links = clusters.joined(n, zip(a.tolist(), b.tolist(), strict=True))
    return {"a": [held["v"][a] for a, _ in links], "b": [held["v"][b] for _, b in links]}


def _some_shingles(bits: bytes, count: int):
    """Shingle sets of the rows whose hashed key a Bloom filter holds; false hits go at the join that follows."""
    filled = np.frombuffer(bits, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = batch.column(batch.schema.get_field_index("h")).to_numpy().view(np.uint64) % np.uint64(count)
                yield batch.filter(pa.array((filled[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1).astype(bool)))

        for _, data, at in steps(kept()):
            sets = shingles(*words(data, at, SPACED))
            yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in sets], pa.binary()), binaries(sets)], names=["v", "shingles"])

    return run


def _bloom(keys: DataFrame, n: int) -> tuple[bytes, int]:
    """A bit for each 64-bit key h, in at most 4 MiB however many keys there are."""
    count = min(1 << 25, max(1 << 15, 1 << (8 * n).bit_length()))
    at = F.pmod(F.col("h"), F.lit(1 << 25))  # a power of two: its low bits are those of any smaller one
    at = F.pmod(at, F.lit(count))
    rows = keys.groupBy(F.floor(at / 32768).alias("part")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(32768))).alias("bits")).collect()
    filled = bytearray(count // 8)
    for r in rows:
        filled[r.part * 4096 : r.part * 4096 + 4096] = r.bits
    return bytes(filled), count


def near_duplicates(docs: DataFrame, share: int = 75, block: int = BLOCK, longest: int = clusters.LIST) -> DataFrame:
    """Groups of near-duplicate texts: doc_id, n_shingles, component_id, kept and text_key for each row of docs.

    Two texts are linked when their sets of distinct five-word shingles have share percent of their union in common.
    Method: every distinct set posts itself under PREFIX of its (coordinate, value) pairs, the first in one global order;
    sets with SURE of 64 equal coordinates meet for certain. Within a posting list all pairs not yet joined are compared,
    and those that agree on AGREE coordinates or more are joined to clusters. A list longer than longest is dealt in pairs
    of blocks, so no task holds it. A cluster is then decided on full sets, in blocks of bounded bytes: first every block
    by itself and with the cluster's least member; then, where that leaves parts, every pair not both in the largest part.

    Equal sets are one vertex. Null, empty and blank texts have n_shingles 0 and component_id = doc_id. Repeated rows
    stay rows, and a null doc_id is not kept unless nothing else tells it from its group. Only doc_id and text are read.
    """
    small_batches(docs.sparkSession)
    base = stored(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(_sketch, "doc_id long, text_key long, n_shingles long, v binary, signature binary"), "sketch")
    sets = base.where("n_shingles > 0").groupBy("v").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"))
    posted = stored(sets, "sets")
    n = posted.count()
    few = 1 + n // clusters.FILE_ROWS
    power = _loads(posted, n)
    rows = posted.select("v", "signature").mapInArrow(_posts(power, longest), "token long, v binary, sketch binary, long boolean")
    short = rows.where("NOT long").select("token", "v", "sketch")
    some = (power > _power_of(longest)).any()
    if some:  # the table only bounds a list's length; the few (or, in very large inputs, all) that may be long are counted
        maybe = rows.where("long").select("token", "v", "sketch")
        crowded = stored(maybe.groupBy("token").count().where(F.col("count") > longest).select("token"), "crowded", few)
        short = short.unionByName(maybe.join(crowded, "token", "left_anti").select("token", "v", "sketch"))
    candidates = short.repartition("token").sortWithinPartitions("token").mapInArrow(clusters.in_lists(_agree, 2), "a binary, b binary")
    if some:
        dealt = clusters.blocks(maybe.join(crowded, "token", "left_semi").select("v", "sketch", F.col("token").alias("c")), longest)
        candidates = candidates.unionByName(clusters.by_unit(dealt, clusters.in_blocks(_agree, 2), "a binary, b binary", ["v", "sketch"]))
    members = stored(clusters.components(candidates, few).join(posted.select("v", "rep"), "v"), "members", few)
    keyed = members.select(F.xxhash64("rep").alias("h"))
    bits, count = _bloom(keyed, members.count())
    wanted = docs.select("text", F.xxhash64(F.col("doc_id").cast("long")).alias("h")).mapInArrow(_some_shingles(bits, count), "v binary, shingles binary")
    full = wanted.join(members.select("v", "c"), "v").groupBy("v", "c").agg(F.first("shingles").alias("shingles"))
    full = stored(full.withColumn("bytes", F.octet_length("shingles")), "full")
    decided = lambda dealt: clusters.by_unit(dealt, lambda held: _linked(held, share), "a binary, b binary", ["v", "shingles"])
    near = clusters.hubs(full, block, "bytes")
    links = stored(decided(near).repartition(few), "links")
    # clusters of several blocks: what the blocks by themselves have not joined is compared with all the rest
    apart, more = near.where("nb > 1").select("v", "c").distinct(), links
    if not apart.isEmpty():
        parts = clusters.components(links.join(apart.select(F.col("v").alias("a")), "a", "left_semi"), few).select("v", F.col("c").alias("part"))
        left = full.join(apart.select("v"), "v", "left_semi").join(parts, "v", "left").withColumn("part", F.coalesce("part", "v"))
        more = links.unionByName(decided(clusters.across(left, block, "bytes")))
    found = clusters.components(more, few)
    discard(members, links, full)
    grouped = posted.select("v", "rep").join(found, "v", "left").select("v", "rep", F.coalesce("c", "v").alias("c"))
    smallest = grouped.groupBy("c").agg(F.min("rep").alias("component_id"))
    names = grouped.join(smallest, "c").select("v", "component_id")
    out = base.select("doc_id", "text_key", "n_shingles", "v").join(names, "v", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "text_key")


def keep_one(docs: DataFrame, share: int = 75) -> DataFrame:
    """The rows of docs without all but one document of each near-duplicate group; of repeated rows one stays.

    Rows without words are their own groups and stay. Rows without doc_id go when their group has a row with one.
    """
    key, bad = unused(docs.columns, "key", "gone")
    named = lambda text: F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text.cast("string")).cast("binary"))
    gone = near_duplicates(docs, share).where("NOT kept AND n_shingles > 0 AND (doc_id IS NOT NULL OR component_id IS NOT NULL)")
    gone = stored(gone.select(named(F.col("text_key")).alias(bad)).distinct(), "gone", 1 + docs.count() // clusters.FILE_ROWS)
    # both steps deal the texts by the same key, so they are exchanged once
    left = docs.withColumn(key, named(F.xxhash64(F.coalesce("text", F.lit(""))))).repartition(key)
    return left.join(gone, F.col(key) == F.col(bad), "left_anti").dropDuplicates([key]).drop(key)
