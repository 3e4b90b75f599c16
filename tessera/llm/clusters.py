"""Connected components by star contraction, and exact all-pairs work inside clusters in bounded blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, flat, give_back, stored

#: Members of one block of a cluster; a task holds two blocks at a time.
BLOCK = 256
#: Bytes of members' weight in one block, about; a single member may be larger.
BLOCK_BYTES = 4 << 20
#: A vertex with more than this share (1 / HUB) of the rows is met without an exchange by it.
HUB = 1000
#: Edges, counted first, that one task joins by itself in some 20 MB.
HERE = 250_000
#: Edges in one file, about.
FILE_ROWS = 20_000
#: Longest posting list that one task compares by itself; longer ones are dealt in pairs of blocks of this many rows.
LIST = 4096


def _lowered(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """For rows (u, v): each row with m, the least of u and all its v; and the (u, m) by themselves.

    Minima are combined before the exchange. A vertex with more than most rows gets its minimum by broadcast, so that its
    rows need not meet in one task; with most a fixed share of all rows, few vertices can have so many.
    """
    low = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    hot = F.broadcast(low.where(F.col("n") > most).select("u", F.col("m").alias("hot")))
    split = rows.join(hot, "u", "left")
    rest = split.where(F.col("hot").isNull()).drop("hot").join(low.where(F.col("n") <= most).select("u", "m"), "u")
    return split.where(F.col("hot").isNotNull()).select("u", "v", F.col("hot").alias("m")).unionByName(rest.select("u", "v", "m")), low.select("u", "m")


def _joined_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, c) for the vertices of edges that one task holds: roots take the least root they meet until none changes."""
    rows = list(batches)
    if not sum(x.num_rows for x in rows):
        return
    ends = pa.chunked_array([x.column(k) for k in (0, 1) for x in rows])
    names = ends.unique()
    names = names.take(pc.sort_indices(names))
    u, v = np.split(pc.index_in(ends, value_set=names).to_numpy(), 2)
    low, last = np.arange(len(names)), None
    while last is None or (low != last).any():
        last, least = low.copy(), np.minimum(low[u], low[v])
        np.minimum.at(low, last[u], least)
        np.minimum.at(low, last[v], least)
        while (low[low] != low).any():
            low = low[low]
    yield pa.RecordBatch.from_arrays([names, names.take(pa.array(low))], names=["v", "c"])


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(v, c) for every vertex of edges (a, b): c is the smallest vertex reachable. files: of the first table of edges.

    Alternates large-star and small-star steps until the edges are stars; each round is written to the shared folder, in
    as many files as its edges ask for. A vertex with more than 1 / HUB of the edges is hot; there are 2 * HUB at most.
    Up to HERE edges need no rounds: one task joins them, with the same result.
    """
    def round_(e: DataFrame, n: int) -> DataFrame:
        most = n // HUB
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rows, _ = _lowered(both, most)
        large = rows.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        rows, low = _lowered(large, most)
        small = rows.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", files)
    now, last = mark(e), None
    if now[0] <= HERE:
        out = stored(e.coalesce(1).mapInArrow(_joined_here, f"v {e.dtypes[0][1]}, c {e.dtypes[0][1]}"), "components")
        discard(e)
        return out
    while now != last:
        new = stored(round_(e, now[0]), "stars", 1 + now[0] // FILE_ROWS)
        discard(e)
        e = new
        now, last = mark(e), now
    return e.select(F.col("u").alias("v"), F.col("v").alias("c")).unionByName(e.select(F.col("v").alias("u"), F.col("v").alias("c")).distinct().withColumnRenamed("u", "v"))


def blocks(members: DataFrame, block: int = BLOCK, weight: str | None = None) -> DataFrame:
    """Deals members (v, c, ...) of clusters into pairs of blocks: adds i, j (i <= j) and own, the row's block.

    A cluster of n members has ceil(n / block) blocks, or as many as keep a block's weight (bytes) near BLOCK_BYTES; each
    pair of blocks is a unit of work of its own, in which every pair of members of the cluster meets at least once.
    """
    dealt = _numbered(members, ["c"], block, weight)
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"))))
    return dealt.withColumn("p", pair).select("*", "p.i", "p.j").drop("p", "nb")


def _numbered(members: DataFrame, by: list[str], block: int, weight: str | None) -> DataFrame:
    """Adds nb, the blocks of a row's group, and own, the row's block."""
    heavy = F.sum(F.col(weight) if weight else F.lit(0)) / F.lit(BLOCK_BYTES)
    sizes = members.groupBy(*by).agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(block), heavy)).cast("int").alias("nb"))
    return members.join(sizes, by).withColumn("own", F.pmod(F.xxhash64("v"), F.col("nb")).cast("int"))


def hubs(members: DataFrame, block: int = BLOCK, weight: str | None = None) -> DataFrame:
    """Deals members (v, c, ...) of clusters into blocks that are a unit each (i = j = own); adds nb, the blocks of the
    cluster, too. Every block also has the cluster's least member, so that what is like it is joined at once."""
    dealt = _numbered(members, ["c"], block, weight)
    centre = F.explode(F.when(F.col("v") == F.col("c"), F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array("own")))
    return dealt.withColumn("own", centre).withColumn("i", F.col("own")).withColumn("j", F.col("own"))


def across(members: DataFrame, block: int = BLOCK, weight: str | None = None) -> DataFrame:
    """Deals members (v, c, part, ...) of clusters, whose parts are joined already, into pairs of blocks so that all pairs
    meet of which not both are in the cluster's largest part; adds i, j and own. Clusters of one part have no units."""
    count = members.groupBy("c", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("c").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count(F.lit(1)).alias("parts"))
    split = members.join(count.where("parts > 1").drop("parts"), "c").withColumn("side", F.when(F.col("part") == F.col("main"), 0).otherwise(1)).drop("main")
    dealt = _numbered(split, ["c", "side"], block, weight)
    both = dealt.groupBy("c").agg(F.max(F.when(F.col("side") == 0, F.col("nb"))).alias("nb_main"), F.max(F.when(F.col("side") == 1, F.col("nb"))).alias("nb_rest"))
    dealt = dealt.join(both, "c").withColumn("own", F.col("own") + F.col("side") * F.col("nb_main"))
    other = F.when(F.col("side") == 0, F.sequence(F.col("nb_main"), F.col("nb_main") + F.col("nb_rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("nb_main") + F.col("nb_rest") - 1))
    pair = F.explode(F.transform(other, lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"))))
    return dealt.withColumn("p", pair).select("*", "p.i", "p.j").drop("p", "nb", "nb_main", "nb_rest", "side")


def by_unit(dealt: DataFrame, work: Callable[[dict[str, list]], dict[str, list]], schema: str, columns: list[str]) -> DataFrame:
    """Runs work on the rows of each (c, i, j) in turn; a partition streams its units one after the other and holds one."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {x: [] for x in columns}
        out: dict[str, list] = {x: [] for x in names}

        def close() -> None:
            if len(held["v"]) > 1:
                for x, y in work(held | {"unit": key}).items():
                    out[x] += y

        for batch in batches:
            keys = list(zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("c", "i", "j")), strict=True))
            rows = {x: batch.column(batch.schema.get_field_index(x)) for x in columns}
            for k, own in enumerate(keys):
                if own != key:
                    close()
                    key, held = own, {x: [] for x in columns}
                    if len(out[names[0]]) > 50_000:
                        yield pa.RecordBatch.from_pydict(out, schema=arrow)
                        for x in out.values():
                            x.clear()
                for x in rows:
                    held[x].append(rows[x][k].as_py())
        close()
        yield pa.RecordBatch.from_pydict(out, schema=arrow)
        give_back()

    arrow = pa.schema([(f.split()[0], {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}[f.split()[1]]) for f in schema.split(", ")])
    ordered = dealt.select("c", "i", "j", *columns).repartition("c", "i", "j").sortWithinPartitions("c", "i", "j")
    return ordered.mapInArrow(run, schema)


def joined(n: int, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that join two parts of 0..n-1 not yet joined: a spanning forest."""
    root = np.arange(n).tolist()

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def forest(codes: np.ndarray, agree: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Joins all rows that agree, directly or through others, after comparing every pair not joined before."""
    left, out, ahead = np.arange(len(codes)), [], []
    while len(left) or ahead:
        if not ahead:
            ahead, left = [int(left[0])], left[1:]
        pivot = ahead.pop()
        if len(left):
            near = agree(codes[left], codes[pivot])
            if near.any():
                found = left[near].tolist()
                out += [(pivot, x) for x in found]
                ahead += found
                left = left[~near]
    return out


def in_lists(agree: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int):
    """For mapInArrow over rows (token, v, code) sorted by token: the pairs (a, b) that join the rows of each list.

    A code is width 64-bit numbers. Only one list is held at a time, so lists must be bounded; see in_blocks.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    inner = pa.schema([("token", pa.int64()), ("v", pa.binary()), ("code", pa.binary())])

    def pairs(rows: pa.RecordBatch) -> pa.RecordBatch:
        token, codes = rows.column(0).to_numpy(), flat(rows.column(2))[0].view("<u8").reshape(-1, width)
        start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        size = np.diff(np.append(start, len(token)))
        two = start[size == 2]
        two = two[agree(codes[two], codes[two + 1])]
        a, b = two.tolist(), (two + 1).tolist()
        for at, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            for x, y in forest(codes[at : at + n], agree):
                a.append(at + x)
                b.append(at + y)
        v = rows.column(1)
        return pa.RecordBatch.from_arrays([v.take(pa.array(a, pa.int64())), v.take(pa.array(b, pa.int64()))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.RecordBatch.from_arrays(batch.columns, schema=inner)
            rows = pa.Table.from_batches([held, own] if held else [own]).combine_chunks().to_batches()[0]
            token = rows.column(0).to_numpy()
            whole = int(np.searchsorted(token, token[-1]))  # the last list may go on in the next batch
            if whole:
                yield pairs(rows.slice(0, whole))
            held = rows.slice(whole)
        if held:
            yield pairs(held)

    return run


def in_blocks(agree: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int):
    """The same for the units of by_unit, with the codes in the column sketch: lists of any length."""
    def work(held: dict[str, list]) -> dict[str, list]:
        found = forest(np.frombuffer(b"".join(held["sketch"]), "<u8").reshape(-1, width), agree)
        return {"a": [held["v"][x] for x, _ in found], "b": [held["v"][y] for _, y in found]}

    return work
