"""Operators on spot graphs: edges (u, v) in both directions, iterated as joins."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, one of our own if driver and
    executors are one process, else an error."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df in as many parts as the session's exchanges have, before a step that makes many rows of one: files that compress
    well are read by one task, and small exchanges are joined into one."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions once, without loops."""
    e = edges.where("u <> v").select("u", "v")
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def reach(edges: DataFrame, hops: int) -> DataFrame:
    """(u, v) for all v that u reaches in 1 to hops steps, itself left out; hops below 1 count as 1."""
    found = last = edges
    for _ in range(max(1, hops) - 1):
        step = edges.select(F.col("u").alias("v"), F.col("v").alias("w"))
        last = last.join(step, "v").select("u", F.col("w").alias("v")).where("u <> v").distinct()
        found = found.unionByName(last).distinct()
    return found


#: Edges of a group that one task joins by itself.
HERE = 250_000


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of edges, and for each the smallest that it is joined with: least labels spread and jump until none changes."""
    names, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while True:
        new = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return names, names[label]
        label = new


def components(nodes: DataFrame, edges: DataFrame, here: int = HERE) -> DataFrame:
    """(by..., spot, component): the smallest spot reachable; edges have the columns by, u, v in both directions.

    Edges of different by never meet. Those of one, up to here of them, are joined by one task after one exchange; larger
    graphs by rounds of joins. Spots without edges are their own components; edges to spots that are no nodes join nothing.
    """
    by = [c for c in nodes.columns if c != "spot"]
    kind = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    end = nodes.select(*by, F.col("spot").alias("u"))
    ties = edges.where("u < v").hint("merge").join(end, [*by, "u"], "left_semi").hint("merge").join(end.withColumnRenamed("u", "v"), [*by, "v"], "left_semi")
    ties = stored(ties.select(*by, "u", "v").distinct(), "ties")
    large = ties.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > here).select(*by, F.lit(True).alias("_large"))
    large = stored(large, "large")
    some = not large.isEmpty()
    schema = "".join(f"{c} {kind[c]}, " for c in by) + f"spot {kind['spot']}, component {kind['spot']}"

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        spot, component = joined(group["u"].to_numpy(), group["v"].to_numpy())
        return pd.DataFrame({**{c: [k] * len(spot) for c, k in zip(by, key, strict=False)}, "spot": spot, "component": component})

    if some and not by:
        found = _rounds(nodes, both_ways(ties), by)
    else:
        rest = ties.join(large, by, "left_anti") if some else ties
        found = rest.withColumn("_all", F.lit(True)).groupBy(*by or ["_all"]).applyInPandas(one, schema)
        if some:
            big = ties.join(large, by, "left_semi")
            both = big.unionByName(big.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
            found = found.unionByName(_rounds(nodes.join(large, by, "left_semi"), stored(both, "ways"), by))
    found = found.withColumnRenamed("component", "_c")
    return stored(nodes.hint("merge").join(found, [*by, "spot"], "left").select(*by, "spot", F.coalesce("_c", "spot").alias("component")), "components")


def _rounds(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Smallest labels spread over edges and then jump over their own labels, so chains take a number of rounds that grows
    with the logarithm of their length."""
    def mark(d: DataFrame):
        return d.agg(F.bit_xor(F.xxhash64(*by, "spot", "component"))).first()[0]

    now = stored(nodes.withColumn("component", F.col("spot")), "components")
    last = mark(now)
    while True:
        near = edges.join(now.withColumnRenamed("spot", "v"), [*by, "v"]).groupBy(*by, F.col("u").alias("spot")).agg(F.min("component").alias("m"))
        spread = now.join(near, [*by, "spot"], "left").select(*by, "spot", F.least("component", "m").alias("component"))
        jump = spread.select(*by, F.col("spot").alias("component"), F.col("component").alias("next"))
        new = stored(spread.join(jump, [*by, "component"]).select(*by, "spot", F.col("next").alias("component")), "components")
        seen = mark(new)
        if seen == last:
            return new
        now, last = new, seen


def smooth(values: DataFrame, edges: DataFrame, alpha: float = 0.6, steps: int = 5) -> DataFrame:
    """Jacobi steps (1 - alpha) x + alpha * mean of the neighbours that have a value; one without stays as it is."""
    by = [c for c in values.columns if c not in ("spot", "value")]
    for _ in range(steps):
        near = edges.join(values.withColumnRenamed("spot", "v"), "v").groupBy(*by, F.col("u").alias("spot")).agg(F.avg("value").alias("m"))
        values = stored(values.join(near, [*by, "spot"], "left").select(*by, "spot", F.when(F.col("m").isNull(), F.col("value")).otherwise((1 - alpha) * F.col("value") + alpha * F.col("m")).alias("value")), "smooth")
    return values


def watershed(values: DataFrame, edges: DataFrame, epsilon: float = 1e-8) -> DataFrame:
    """(by..., spot, root): the peak that steepest ascent from a spot ends in.

    The parent is the neighbour with the largest value above the spot's own by more than epsilon, of equal ones the
    first; pointers then double until all point at peaks.
    """
    by = [c for c in values.columns if c not in ("spot", "value")]
    other = values.select(*by, F.col("spot").alias("v"), F.col("value").alias("up"))
    # by exchange: files of spots are small, and Spark would send their rows by way of the driver to all tasks
    best = edges.hint("merge").join(values.withColumnRenamed("spot", "u"), "u").hint("merge").join(other, [*by, "v"]).where(F.col("up") > F.col("value") + epsilon)
    parent = best.groupBy(*by, F.col("u").alias("spot")).agg(F.max_by("v", F.struct("up", -F.col("v"))).alias("p"))
    now = stored(values.hint("merge").join(parent, [*by, "spot"], "left").select(*by, "spot", F.coalesce("p", "spot").alias("root")), "roots")
    while True:
        jump = now.select(*by, F.col("spot").alias("root"), F.col("root").alias("next"))
        new = stored(now.hint("merge").join(jump, [*by, "root"]).select(*by, "spot", F.col("next").alias("root")), "roots")
        if new.hint("merge").join(now.withColumnRenamed("root", "was"), [*by, "spot"]).where("root <> was").isEmpty():
            return new
        now = new


def merge_small_basins(basins: DataFrame, edges: DataFrame, most: int = 3, mass: float = 0.0) -> DataFrame:
    """(program, spot, root) after small basins have joined the adjacent basin with the largest peak, then size.

    basins are (program, spot, root, value). Each merge decides the next, in the order of roots, so a program is one
    group; its edges come along as pairs of roots that touch.
    """
    other = basins.select("program", F.col("spot").alias("v"), F.col("root").alias("other"))
    touch = basins.join(edges.withColumnRenamed("u", "spot"), "spot").join(other, ["program", "v"]).where("root <> other").select("program", "root", "other").distinct()
    size = basins.groupBy("program", "root").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"), F.sum("value").alias("mass"))
    rows = size.join(touch.groupBy("program", "root").agg(F.collect_set("other").alias("near")), ["program", "root"], "left")

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        state = {r.root: [int(r.n), float(r.peak), float(r.mass), set() if r.near is None else set(r.near)] for r in group.itertuples()}
        to = {x: x for x in state}
        changed = True
        while changed:
            changed = False
            for x in sorted(state):
                if x not in state:
                    continue
                n, peak, m, near = state[x]
                if (n <= most or m <= mass) and near:
                    y = max(near, key=lambda z: (state[z][1], state[z][0], -z))
                    state[y][0] += n
                    state[y][1] = max(state[y][1], peak)
                    state[y][2] += m
                    state[y][3] = (state[y][3] | near) - {x, y}
                    for z in near - {y}:
                        state[z][3] = (state[z][3] - {x}) | {y}
                    del state[x]
                    for a, b in to.items():
                        if b == x:
                            to[a] = y
                    changed = True
        return pd.DataFrame({"program": group.program.iloc[0], "root": list(to), "merged": list(to.values())})

    kind = {f.name: f.dataType.simpleString() for f in basins.schema.fields}
    new = rows.groupBy("program").applyInPandas(merged, f"program {kind['program']}, root {kind['root']}, merged {kind['root']}")
    return basins.join(new, ["program", "root"]).select("program", "spot", F.col("merged").alias("root"))


def bridge_gaps(parts: DataFrame, edges: DataFrame, gap: int = 2) -> DataFrame:
    """(program, spot, component) with components joined that are gap + 1 hops apart or nearer.

    parts are (program, spot, component). The hop-limited reach is joined on both ends, then components are joined as
    a graph of their own.
    """
    far = reach(edges, gap + 1)
    other = parts.select("program", F.col("spot").alias("v"), F.col("component").alias("c2"))
    links = parts.join(far.withColumnRenamed("u", "spot"), "spot").join(other, ["program", "v"]).where("component <> c2").select("program", F.col("component").alias("u"), F.col("c2").alias("v")).distinct()
    names = components(parts.select("program", F.col("component").alias("spot")).distinct(), stored(links, "links"))
    return parts.join(names.select("program", F.col("spot").alias("component"), F.col("component").alias("to")), ["program", "component"]).select("program", "spot", F.col("to").alias("component"))


def articulation_share(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(domain, n, ratio): the share of a domain's spots without which it falls apart; an iterative depth-first search."""
    other = members.select("domain", F.col("spot").alias("v"))
    inner = members.join(edges.withColumnRenamed("u", "spot"), "spot").join(other, ["domain", "v"]).groupBy("domain", "spot").agg(F.collect_list("v").alias("near"))
    rows = members.join(inner, ["domain", "spot"], "left")

    def ratio(group: pd.DataFrame) -> pd.DataFrame:
        near = {r.spot: [] if r.near is None else sorted(r.near) for r in group.itertuples()}
        order, low, cut, clock = {}, {}, set(), 0
        for root in sorted(near):
            if root in order:
                continue
            order[root] = low[root] = clock = clock + 1
            stack, children = [(root, None, iter(near[root]))], 0
            while stack:
                u, up, rest = stack[-1]
                v = next(rest, None)
                if v is None:
                    stack.pop()
                    if stack:
                        w = stack[-1][0]
                        low[w] = min(low[w], low[u])
                        if w != root and low[u] >= order[w]:
                            cut.add(w)
                elif v not in order:
                    order[v] = low[v] = clock = clock + 1
                    children += u == root
                    stack.append((v, u, iter(near[v])))
                elif v != up:
                    low[u] = min(low[u], order[v])
            if children > 1:
                cut.add(root)
        return pd.DataFrame({"domain": [group.domain.iloc[0]], "n": [len(near)], "ratio": [len(cut) / len(near)]})

    return rows.groupBy("domain").applyInPandas(ratio, f"domain {members.schema['domain'].dataType.simpleString()}, n long, ratio double")


def union_edges(spatial: DataFrame, expression: DataFrame) -> DataFrame:
    """(u, v, weight, kind): edges of either graph in both directions, the larger weight, and where an edge is from."""
    def ways(e: DataFrame, kind: int) -> DataFrame:
        e = e.select("u", "v", "weight").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))
        return e.where("u <> v").withColumn("k", F.lit(kind))

    g = ways(spatial, 1).unionByName(ways(expression, 2)).groupBy("u", "v").agg(F.max("weight").alias("weight"), F.bit_or("k").alias("k"))
    return g.select("u", "v", "weight", F.when(F.col("k") == 1, "spatial").when(F.col("k") == 2, "expression").otherwise("both").alias("kind"))


