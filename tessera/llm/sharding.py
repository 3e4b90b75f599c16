"""Uniform shuffles with exact shard sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARDS = 40
SEED = 20240229
#: Logical partitions, each a unit of the first permutation: about this many rows in one, and no more than MOST_PARTS.
PART_ROWS = 20_000
MOST_PARTS = 1 << 14
#: Rows in a block of the second permutation, about.
BLOCK_ROWS = 20_000


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of drawn are good. Inversion that steps outward from the mode, so a draw costs about the deviation."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(_log_choose(good, mode) + _log_choose(bad, drawn - mode) - _log_choose(good + bad, drawn))
    u = rng.random() - p
    up = down = mode
    p_up = p_down = p
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows that each partition sends to each shard, drawn as a uniform permutation would send them.

    Both lists have the same sum. Row after row: a partition's rows are dealt to the shards' places still free.
    """
    rng, free, out = random.Random(seed), list(shards), []
    for n in parts:
        left, open_, row = n, sum(free), []
        for k, places in enumerate(free):
            got = hypergeometric(rng, places, open_ - places, left)
            row.append(got)
            open_ -= places
            left -= got
            free[k] -= got
        out.append(row)
    return out


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, text_key, shard and slot for each row of docs: a uniform shuffle.

    Shard sizes differ by one at most; the larger ones come first. Rows lie in logical partitions by a hash of doc_id and
    text, so neither a repeated doc_id nor a repeated text alone makes a large one, and the result doesn't depend on how the input is split and a lost task gives the same rows again. The matrix of
    counts is drawn on the driver from the partitions' counts, at most MOST_PARTS of them. A row's place in its
    partition, in a random order, decides its shard; a second random order, ranked in blocks by the leading part of its
    key, gives the slot, from 0 and without gaps. Rows with one doc_id, or none, are told apart by the MD5 of the
    text; equal rows are interchangeable. Null counts as no bytes. An empty table gives no rows.
    """
    n = docs.count()
    count = max(1, min(MOST_PARTS, -(-n // PART_ROWS)))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    part = F.pmod(F.xxhash64(F.lit(seed), key, F.coalesce("text", F.lit(""))), F.lit(count))
    sizes = {r.part: r["count"] for r in docs.select(part.alias("part")).groupBy("part").count().collect()}
    wanted = [n // shards + (k < n % shards) for k in range(shards)]
    ends = []
    for row in communication_matrix([sizes.get(p, 0) for p in range(count)], wanted, seed):
        total, own = 0, []
        for x in row:
            total += x
            own.append(total)
        ends.append(own)
    spark = docs.sparkSession
    # a few numbers for each partition, as rows of one literal
    matrix = spark.sql("SELECT posexplode(from_json(:m, 'array<array<bigint>>')) AS (part, ends)", args={"m": json.dumps(ends)})
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("text_key"), part.cast("int").alias("part"))
    order = f"xxhash64({seed} + 1, coalesce(CAST(doc_id AS STRING), 'null'), text_key), doc_id, text_key"
    ranked = rows.withColumn("place", F.expr(f"row_number() OVER (PARTITION BY part ORDER BY {order})"))
    dealt = ranked.join(F.broadcast(matrix), "part").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("place"))))
    again = F.xxhash64(F.lit(seed + 2), key, "text_key", F.col("place"))
    blocks = max(1, -(-n // (shards * BLOCK_ROWS)))
    dealt = dealt.withColumn("again", again).withColumn("block", F.pmod(F.shiftrightunsigned("again", 20), F.lit(blocks)))
    held = dealt.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("rows"))
    base = held.withColumn("base", F.expr("sum(rows) OVER (PARTITION BY shard ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
    base = base.select("shard", "block", F.coalesce("base", F.lit(0).cast("long")).alias("base"))
    placed = dealt.withColumn("at", F.expr("row_number() OVER (PARTITION BY shard, block ORDER BY again, doc_id, text_key, part)"))
    return placed.join(base, ["shard", "block"]).select("doc_id", "size", "text_crc32", "text_key", "shard", (F.col("base") + F.col("at") - 1).alias("slot"))
