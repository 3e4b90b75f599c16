"""Gene templates: non-negative factorisations of many samples by blocks of spots, reruns, clusters and consensus."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import stats as S
from tessera.operators.graph import stored

#: Spots of a block in the mean, and of a slice of it that is dense at a time; an eighth of these with more than FEW_GENES.
ROWS, SLICE, FEW_GENES = 4096, 1024, 1024
#: Bytes of states that are sent to all tasks; larger ones are joined by exchange.
SENT_BYTES = 64 << 20
SWEEPS = 500
_PART = "sample string, run int, block long, payload binary"


def _bounded(df: DataFrame) -> None:
    """Arrow batches of few bytes, as a row is a block or a state."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    if int(conf.get(name).removesuffix("b")) > 32 << 20:
        conf.set(name, str(32 << 20))


def matrix_blocks(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, genes, sizes) of cells (sample, spot, gene, value); without the column sample they are of one, named all.

    A block holds about ROWS spots of a sample as a sparse matrix: (sample, block, spots, payload). genes are (sample, gene,
    at), numbered by name; sizes (sample, spots, genes).
    """
    _bounded(cells)
    c = cells if "sample" in cells.columns else cells.withColumn("sample", F.lit("all"))
    c = stored(c.select(F.col("sample").cast("string").alias("sample"), "spot", "gene", F.col("value").cast("double").alias("value")).where("value > 0"), "cells")
    names = c.select("sample", "gene").distinct()
    genes = stored(names.withColumn("at", F.row_number().over(Window.partitionBy("sample").orderBy("gene")) - 1), "genes")
    spots = c.select("sample", "spot").distinct().groupBy("sample").agg(F.count(F.lit(1)).alias("spots"))
    sizes = stored(spots.join(genes.groupBy("sample").agg(F.count(F.lit(1)).alias("genes")), "sample"), "sizes")

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["spot", "at"])
        spot, first = np.unique(group["spot"].to_numpy(), return_index=True)
        payload = pickle.dumps((np.append(first, len(group)), group["at"].to_numpy(np.int32), group["value"].to_numpy(np.float64), int(group["genes"].iloc[0])))
        return pd.DataFrame({"sample": [group["sample"].iloc[0]], "block": [int(group["block"].iloc[0])], "spots": [spot.tolist()], "payload": [payload]})

    kind = c.schema["spot"].dataType.simpleString()
    dealt = c.join(sizes, "sample").withColumn("block", F.pmod(F.xxhash64("spot"), F.ceil(F.col("spots") / F.when(F.col("genes") <= FEW_GENES, ROWS).otherwise(max(1, ROWS // 8))))).join(genes, ["sample", "gene"])
    blocks = dealt.select("sample", "block", "spot", "at", "value", "genes").groupBy("sample", "block").applyInPandas(packed, f"sample string, block long, spots array<{kind}>, payload binary")
    return stored(blocks, "blocks"), genes, sizes


def _slices(block: tuple) -> Iterator[np.ndarray]:
    """The dense rows of a block, some at a time."""
    ends, at, value, genes = block
    rows = SLICE if genes <= FEW_GENES else max(1, SLICE // 8)
    for low in range(0, len(ends) - 1, rows):
        own = ends[low : low + rows + 1]
        x = np.zeros((len(own) - 1, genes))
        x[np.repeat(np.arange(len(own) - 1), np.diff(own)), at[own[0] : own[-1]]] = value[own[0] : own[-1]]
        yield x


def nonnegative(g: np.ndarray, a: np.ndarray, l1: float = 0.0, l2: float = 0.0) -> np.ndarray:
    """Rows x >= 0 with the least x a x / 2 - g x + l1 sum(x) + l2 x x / 2, component by component until nothing moves.

    Rows are independent, so one that no longer moves is left out of further sweeps.
    """
    a = a + l2 * np.eye(len(a))
    # a component is one run of memory, not a stride
    done, at = np.zeros((g.shape[1], len(g))), np.arange(len(g))
    x, b = done.copy(), np.ascontiguousarray(g.T) - l1
    most = 1e-300
    for sweep in range(SWEEPS):
        moved = np.zeros(len(at))
        for j in range(len(a)):
            if a[j, j] > 0:
                new = np.maximum(0, x[j] + (b[j] - a[j] @ x) / a[j, j])
                np.maximum(moved, np.abs(new - x[j]), out=moved)
                x[j] = new
        most = max(most, float(x.max(initial=0)))
        still = moved > 1e-11 * most
        if not still.any():
            break
        if sweep % 4 == 3 and still.sum() < 0.8 * len(at):
            done[:, at[~still]] = x[:, ~still]
            at, x, b = at[still], x[:, still], b[:, still]
    done[:, at] = x
    return np.ascontiguousarray(done.T)


# Steps of a factorisation: what a block adds to the sums, and what a state becomes of them.
def _power(x: np.ndarray, s: dict) -> dict:
    return {"z": x.T @ (x @ s["q"])}


def _powered(s: dict, t: dict) -> dict:
    return s | {"q": np.linalg.qr(t["z"])[0]}


def _spectrum(x: np.ndarray, s: dict) -> dict:
    y = x @ s["q"]
    return {"c": y.T @ y, "total": x.sum()}


def _spectral(s: dict, t: dict) -> dict:
    size, axes = np.linalg.eigh(t["c"])
    order = np.argsort(-size)[: s["k"]]
    v = s["q"] @ axes[:, order]
    v *= np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    return {c: s[c] for c in s if c != "q"} | {"v": v, "s": np.sqrt(np.maximum(size[order], 0)), "mean": t["total"] / (s["n"] * s["g"])}


def _signs(x: np.ndarray, s: dict) -> dict:
    u = x @ s["v"] / np.maximum(s["s"], 1e-12)
    return {"up": (np.maximum(u, 0) ** 2).sum(axis=0), "down": (np.maximum(-u, 0) ** 2).sum(axis=0)}


def _started(s: dict, t: dict) -> dict:
    """The factors of the larger signed part of each singular pair; zeros become the matrix's mean."""
    h = np.zeros((s["k"], s["g"]))
    for j in range(min(s["k"], s["v"].shape[1])):
        v = s["v"][:, j]
        up, down = np.maximum(v, 0), np.maximum(-v, 0)
        sides = [(np.sqrt(t[side][j]) * np.linalg.norm(y), y) for side, y in (("up", up), ("down", down))]
        share, y = sides[0] if sides[0][0] >= sides[1][0] else sides[1]
        h[j] = np.sqrt(s["s"][0]) * np.abs(v) if j == 0 else np.sqrt(s["s"][j] * share) * y / max(np.linalg.norm(y), 1e-300)
    h[h < 1e-12] = s["mean"]
    return {c: s[c] for c in s if c not in ("v", "s", "mean")} | {"h": h, "start": h}


def _loadings(x: np.ndarray, s: dict) -> tuple[np.ndarray, np.ndarray]:
    g = x @ s["h"].T
    return nonnegative(g, s["h"] @ s["h"].T), g


def _grams(x: np.ndarray, s: dict) -> dict:
    w, g = _loadings(x, s)
    return {"ww": w.T @ w, "wx": w.T @ x, "xx": (x * x).sum(), "wg": (w * g).sum()}


def _fitted(s: dict, t: dict) -> dict:
    """The other half of a step. A penalty that leaves nothing is made a tenth, and from 1e-6 on nothing, from the same start."""
    h = s["h"]
    l1, l2 = s["n"] * s["alpha"] * s["ratio"], s["n"] * s["alpha"] * (1 - s["ratio"])
    loss = float(t["xx"] / 2 - t["wg"] + (t["ww"] * (h @ h.T)).sum() / 2 + l1 * h.sum() + l2 * (h * h).sum() / 2)
    losses = [*s["losses"], loss]
    if len(losses) > s["rounds"] or (len(losses) > 1 and losses[-2] - loss <= s["tolerance"] * losses[-2]):
        return s | {"losses": losses, "done": True}
    new = nonnegative(t["wx"].T, t["ww"], l1, l2).T
    if not new.any() and s["alpha"] > 0:
        return s | {"alpha": s["alpha"] / 10 if s["alpha"] > 1e-6 else 0.0, "h": s["start"], "losses": []}
    return s | {"h": new, "losses": losses}


def _open(state: DataFrame) -> tuple[int, bool]:
    """How many states are open, and whether they may be sent to all tasks."""
    n, size = state.where("NOT done").agg(F.count(F.lit(1)), F.sum(F.octet_length("payload"))).first()
    return n, (size or 0) <= SENT_BYTES


def _pass(blocks: DataFrame, state: DataFrame, work: Callable, finish: Callable, small: bool) -> DataFrame:
    """One reading of the blocks for all open states (sample, run, done, payload): sums of what work gives, then finish.

    Sums are added in the order of blocks, so reruns are equal. What is exchanged for a state is the sums of each block.
    """
    open_ = state.where("NOT done").select("sample", "run", F.col("payload").alias("state"))
    both = blocks.select("sample", "block", "payload").join(F.broadcast(open_) if small else open_, "sample")

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                s, total = pickle.loads(r["state"]), {}
                for x in _slices(pickle.loads(r["payload"])):
                    for c, v in work(x, s).items():
                        total[c] = total.get(c, 0) + v
                yield pa.RecordBatch.from_pylist([{"sample": r["sample"], "run": r["run"], "block": r["block"], "payload": pickle.dumps(total)}], _arrow)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, s, total = None, None, {}

        def row():
            new = s if s["done"] else finish(s, total)
            return pa.RecordBatch.from_pylist([{"sample": key[0], "run": key[1], "done": new["done"], "payload": pickle.dumps(new)}], _done)

        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                if (r["sample"], r["run"]) != key:
                    if key:
                        yield row()
                    key, s, total = (r["sample"], r["run"]), pickle.loads(r["payload"]), {}  # a state comes before its blocks
                    continue
                for c, v in pickle.loads(r["payload"]).items():
                    total[c] = total.get(c, 0) + v
        if key:
            yield row()

    own = state.select("sample", "run", F.lit(-1).cast("long").alias("block"), "payload")
    every = own.unionByName(both.mapInArrow(worked, _PART)).repartition("sample", "run").sortWithinPartitions("sample", "run", "block")
    return stored(every.mapInArrow(finished, "sample string, run int, done boolean, payload binary"), "state")


_arrow = pa.schema([("sample", pa.string()), ("run", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])
_done = pa.schema([("sample", pa.string()), ("run", pa.int32()), ("done", pa.bool_()), ("payload", pa.binary())])


def fitted(blocks: DataFrame, sizes: DataFrame, runs: list[int], ranks: tuple[int, ...] = (12, 16, 24), seed: int = 2024, rounds: int = 400, alpha: float = 1e-4, ratio: float = 0.3, tolerance: float = 1e-4) -> DataFrame:
    """(sample, run, done, payload): the factors h of each run and sample, by alternating least squares.

    The rank of run r is ranks[r mod their number], at most the lesser side of the sample's matrix; its start are the
    non-negative parts of singular pairs from a randomised subspace iteration with the seed seed + 17 r. In a step each block works out its spots' loadings for the
    factors at hand, to the end, and gives the Gram matrices; factors then follow from their sums, with the penalty alpha
    (times the spots; ratio of it on sums, the rest on squares). The penalised loss never rises; a step that lowers it by
    tolerance of itself or less is the last. No task holds more of a sample than a block, and the factors of one run.
    """
    def first(frames):
        for f in frames:
            rows = []
            for sample, n, g in zip(f["sample"], f["spots"], f["genes"], strict=True):
                for run in runs:
                    k = max(1, min(ranks[run % len(ranks)], n, g))
                    q = np.random.default_rng(seed + 17 * run).normal(size=(g, min(n, g, k + 10)))
                    s = {"k": k, "n": int(n), "g": int(g), "alpha": alpha, "ratio": ratio, "rounds": rounds, "tolerance": tolerance, "losses": [], "done": False, "q": np.linalg.qr(q)[0]}
                    rows.append((sample, run, False, pickle.dumps(s)))
            yield pd.DataFrame(rows, columns=["sample", "run", "done", "payload"])

    state = stored(sizes.select("sample", "spots", "genes").mapInPandas(first, "sample string, run int, done boolean, payload binary"), "state")
    small = _open(state)[1]  # the factors' starts, which the next steps narrow
    for work, finish in (*[(_power, _powered)] * 4, (_spectrum, _spectral), (_signs, _started)):
        state = _pass(blocks, state, work, finish, small)
    while (found := _open(state))[0]:
        state = _pass(blocks, state, _grams, _fitted, found[1])
    return state


def weights(state: DataFrame, genes: DataFrame) -> DataFrame:
    """(sample, run, component, gene, weight) of fitted factors, as they are."""
    def rows(frames):
        for f in frames:
            for sample, run, payload in zip(f["sample"], f["run"], f["payload"], strict=True):
                h = pickle.loads(payload)["h"]
                k, g = h.shape
                yield pd.DataFrame({"sample": sample, "run": run, "component": np.repeat(np.arange(k), g), "at": np.tile(np.arange(g, dtype=np.int32), k), "weight": h.ravel()})

    return state.select("sample", "run", "payload").mapInPandas(rows, "sample string, run int, component int, at int, weight double").join(genes, ["sample", "at"]).drop("at")


def losses(state: DataFrame) -> DataFrame:
    """(sample, run, losses): the penalised loss before each step."""
    def rows(frames):
        for f in frames:
            yield f[["sample", "run"]].assign(losses=[pickle.loads(p)["losses"] for p in f["payload"]])

    return state.select("sample", "run", "payload").mapInPandas(rows, "sample string, run int, losses array<double>")


def usage(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """(sample, block, run, spots, k, payload): the loadings of each block's spots, a row a block and run."""
    kind = blocks.schema["spots"].dataType.simpleString()
    s = state.select("sample", "run", F.col("payload").alias("state"))
    small = (s.agg(F.sum(F.octet_length("state"))).first()[0] or 0) <= SENT_BYTES

    def rows(frames):
        for f in frames:
            out = []
            for r in f.itertuples():
                one = pickle.loads(r.state)
                w = np.concatenate([_loadings(x, one)[0] for x in _slices(pickle.loads(r.payload))])
                out.append((r.sample, r.block, r.run, r.spots, w.shape[1], w.tobytes()))
            yield pd.DataFrame(out, columns=["sample", "block", "run", "spots", "k", "payload"])

    return blocks.join(F.broadcast(s) if small else s, "sample").mapInPandas(rows, f"sample string, block long, run int, spots {kind}, k int, payload binary")


def factorise(cells: DataFrame, runs: int, ranks: tuple[int, ...], seed: int = 2024, rounds: int = 60) -> DataFrame:
    """(run, component, gene, weight) of several factorisations without a penalty, for each sample if cells have the column; a component's weights sum to 1."""
    blocks, genes, sizes = matrix_blocks(cells)
    w = weights(fitted(blocks, sizes, list(range(runs)), ranks, seed, rounds, alpha=0.0), genes)
    total = F.sum("weight").over(Window.partitionBy("sample", "run", "component"))
    w = w.withColumn("weight", F.col("weight") / F.greatest(total, F.lit(1e-12)))
    return w if "sample" in cells.columns else w.drop("sample")


def template_genes(w: DataFrame, by: list[str], quantile: float = 0.8, share: float = 0.2, least: int = 15, most: int = 300) -> DataFrame:
    """The genes of each component at the quantile of its positive weights or above; if these are few, the heaviest least of
    them, or share of all positive ones; at most most."""
    some = w.where("weight > 0")
    q = some.groupBy(*by).agg(F.percentile("weight", F.lit(quantile)).alias("q"), F.greatest(F.lit(least), F.ceil(share * F.count(F.lit(1)))).alias("few"))
    return S.top_k(some, by, [F.desc("weight"), "gene"], most, "rank").join(q, by).where((F.col("weight") >= F.col("q")) | (F.col("rank") <= F.col("few"))).drop("q", "few")


def leaders(nodes: DataFrame, pairs: DataFrame, by: list[str], best: list[Column]) -> DataFrame:
    """(by..., id, leader): greedy clusters in the order of place, by rounds.

    nodes are (by..., id, place), pairs (by..., id, other, ...) for all matches of an id with one of an earlier place, in
    which best orders the choice among leaders. Taken one by one, an id leads if no earlier leader matches it, else it
    joins the best of those. In rounds: one whose earlier matches have all joined others leads, one with an earlier leader
    joins; as many rounds as the longest chain of matches that decide each other.
    """
    key = [*by, "id"]
    earlier = stored(pairs.select(*key, "other").distinct(), "earlier")
    state = stored(nodes.select(*key, F.lit(None).cast("boolean").alias("leads")), "state")
    while not state.where("leads IS NULL").isEmpty():
        other = state.select(*by, F.col("id").alias("other"), F.col("leads").alias("other_leads"))
        open_ = state.where("leads IS NULL").select(*key)
        told = open_.join(earlier, key, "left").join(other, [*by, "other"], "left")
        told = told.groupBy(*key).agg(F.bool_or(F.coalesce("other_leads", F.lit(False))).alias("joins"), F.bool_or(F.col("other").isNotNull() & F.col("other_leads").isNull()).alias("waits"))
        decided = told.select(*key, F.when(F.col("joins"), False).when(~F.col("waits"), True).alias("leads"))
        state = stored(state.where("leads IS NOT NULL").unionByName(decided), "state")
    heads = state.where("leads").select(*by, F.col("id").alias("other"))
    joined = pairs.join(heads, [*by, "other"]).join(state.where("NOT leads").select(*key), key)
    chosen = joined.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*best))).where("_n = 1").select(*key, F.col("other").alias("leader"))
    return chosen.unionByName(state.where("leads").select(*key, F.col("id").alias("leader")))


def encode(cells: DataFrame, quantile: float = 0.8, least: float = 1e-4, few: int = 8) -> DataFrame:
    """Cells of evidence: each spot's values saturate at their median, the salient ones stay and sum to 1.

    Salient are values at the spot's quantile or above (and least), but few of them at least, the largest first.
    """
    by = [c for c in ("sample", "spot") if c in cells.columns]
    some = cells.where("value > 0")
    sat = some.join(some.groupBy(*by).agg(F.percentile("value", F.lit(0.5)).alias("_c")), by).withColumn("value", F.col("value") / (F.col("value") + F.greatest(F.col("_c"), F.lit(1e-8)))).drop("_c")
    w = Window.partitionBy(*by)
    bound = sat.groupBy(*by).agg(F.greatest(F.lit(least), F.percentile("value", F.lit(quantile))).alias("_q"))
    ranked = sat.join(bound, by).withColumn("_n", F.row_number().over(w.orderBy(F.desc("value"), "gene"))).withColumn("_many", F.count_if(F.col("value") >= F.col("_q")).over(w))
    kept = ranked.where((F.col("value") >= F.col("_q")) | ((F.col("_many") < few) & (F.col("_n") <= few))).drop("_q", "_n", "_many")
    return kept.withColumn("value", F.col("value") / F.sum("value").over(w))


def _supported(used: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(sample, run, component, spot, usage) of positive loadings."""
    def rows(frames):
        for f in frames:
            for r in f.itertuples():
                w = np.frombuffer(r.payload).reshape(-1, r.k)
                at, component = np.nonzero(w)
                yield pd.DataFrame({"sample": r.sample, "run": r.run, "component": component.astype(np.int32), "spot": np.asarray(r.spots)[at], "usage": w[at, component]})

    kind = used.schema["spots"].dataType.elementType.simpleString()
    out = used.select("sample", "run", "spots", "k", "payload").mapInPandas(rows, f"sample string, run int, component int, spot {kind}, usage double")
    return out if kept is None else out.join(kept, ["sample", "run", "component"], "left_semi")


def supports(used: DataFrame, by: list[str], quantile: float = 0.75) -> DataFrame:
    """(by..., support): how many spots' usage is at the quantile of the positive ones or above; used are (by..., spot, usage)."""
    q = used.groupBy(*by).agg(F.percentile("usage", F.lit(quantile)).alias("_q"))
    return used.join(q, by).groupBy(*by).agg(F.count_if(F.col("usage") >= F.col("_q")).alias("support"))


def _labels(used: DataFrame, kept: DataFrame) -> DataFrame:
    """(sample, run, spot, label): the kept component that a spot uses most, the first of equal ones; -1 where a run keeps none."""
    many = kept.groupBy("sample", "run").agg(F.sort_array(F.collect_list("component")).alias("kept"))

    def rows(frames):
        for f in frames:
            for r in f.itertuples():
                w = np.frombuffer(r.payload).reshape(-1, r.k)
                own = np.asarray([] if r.kept is None else r.kept, int)
                label = own[w[:, own].argmax(axis=1)] if len(own) else np.full(len(w), -1)
                yield pd.DataFrame({"sample": r.sample, "run": r.run, "spot": r.spots, "label": label.astype(np.int32)})

    kind = used.schema["spots"].dataType.elementType.simpleString()
    return used.join(many, ["sample", "run"], "left").select("sample", "run", "spots", "k", "payload", "kept").mapInPandas(rows, f"sample string, run int, spot {kind}, label int")


def agreement(labels: DataFrame) -> DataFrame:
    """(sample, run, ari): the adjusted Rand index of each run's labels with those of the run before."""
    before = labels.select("sample", (F.col("run") + 1).alias("run"), "spot", F.col("label").alias("other"))
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2)
    cells = stored(labels.join(before, ["sample", "run", "spot"]).groupBy("sample", "run", "label", "other").agg(F.count(F.lit(1)).cast("double").alias("n")), "cells")
    key = ["sample", "run"]
    one = cells.groupBy(*key).agg(pairs("n").alias("both"), F.sum("n").alias("n"))
    for c in ("label", "other"):
        one = one.join(cells.groupBy(*key, c).agg(F.sum("n").alias("n")).groupBy(*key).agg(pairs("n").alias(f"_{c}")), key)
    expected, most = F.col("_label") * F.col("_other") / F.greatest(F.lit(1.0), F.col("n") * (F.col("n") - 1) / 2), (F.col("_label") + F.col("_other")) / 2
    return one.select(*key, F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"))


def correlations(used: DataFrame, sizes: DataFrame, kept: DataFrame, least: float) -> DataFrame:
    """(sample, id, other, correlation) for pairs of kept components of a sample whose usage correlates by least or more; other comes
    earlier by run and component. Each block gives its Gram matrix; a sample's are added up."""
    many = kept.groupBy("sample", "run").agg(F.sort_array(F.collect_list("component")).alias("kept"))

    def grams(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("run")
        w = np.concatenate([np.frombuffer(r.payload).reshape(-1, r.k)[:, np.asarray(r.kept, int)] for r in f.itertuples()], axis=1)
        names = [(r.run, int(c)) for r in f.itertuples() for c in r.kept]
        return pd.DataFrame({"sample": [key[0]], "block": [key[1]], "payload": [pickle.dumps((names, w.T @ w, w.sum(axis=0)))]})

    def added(frames):
        held: dict[str, list] = {}
        n = {}
        for f in frames:
            for r in f.itertuples():
                names, gram, total = pickle.loads(r.payload)
                n[r.sample] = r.n
                if r.sample in held:
                    held[r.sample][1] += gram
                    held[r.sample][2] += total
                else:
                    held[r.sample] = [names, gram, total]
        for sample, (names, gram, total) in held.items():
            cov = gram / n[sample] - np.outer(total, total) / n[sample] ** 2
            sd = np.sqrt(np.maximum(np.diag(cov), 0))
            fine = sd > 1e-8
            c = np.clip(np.where(fine[:, None] & fine[None], cov / np.maximum(np.outer(sd, sd), 1e-300), 0), 0, 1)
            a, b = np.nonzero(np.tril(c >= least, -1))
            name = lambda k: f"{names[k][0]:04d}/{names[k][1]:04d}"  # noqa: B023, E731
            yield pd.DataFrame({"sample": sample, "id": [name(k) for k in a], "other": [name(k) for k in b], "correlation": c[a, b]})

    parts = used.join(many, ["sample", "run"]).groupBy("sample", "block").applyInPandas(grams, "sample string, block long, payload binary")
    parts = parts.join(sizes.select("sample", F.col("spots").alias("n")), "sample").repartition("sample").sortWithinPartitions("sample", "block")
    return parts.mapInPandas(added, "sample string, id string, other string, correlation double")


def discover(cells: DataFrame, runs: int = 8, ranks: tuple[int, ...] = (12, 16, 24), seed: int = 2024, rounds: int = 400, least_runs: int = 6, stable: int = 2, match: float = 0.99, least_support: int = 20,
             least_genes: int = 15, most_genes: int = 300, correlation: float = 0.85, strict: float = 0.92, overlap: float = 0.30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(templates, genes, runs) of each sample of cells (sample, spot, gene, value), by reruns and consensus.

    Runs go on until, after least_runs of them, the labels of stable runs in a row agree with those of the run before
    (adjusted Rand index of match or more). A component is a candidate if enough spots use it. Candidates in order of run
    and component are clustered by their leaders: alike are those whose usage correlates by strict, or by correlation with
    genes that overlap; the best by 0.65 correlation and 0.35 overlap. A cluster that a fifth of the runs have is a template: its genes
    are those of a quarter of its runs, by mean weight; scaffold from 0.60 of them, support from 0.40, else context.
    """
    blocks, genes, sizes = matrix_blocks(cells)
    open_, parts, last = sorted(r.sample for r in sizes.select("sample").collect()), [], None
    done: dict[str, int] = dict.fromkeys(open_, 0)
    told: dict[str, list[tuple[int, float]]] = {s: [] for s in open_}
    for batch in [list(range(min(least_runs, runs))), *[[r] for r in range(least_runs, runs)]]:
        if not open_:
            break
        here = F.col("sample").isin(open_)
        state = fitted(blocks.where(here), sizes.where(here), batch, ranks, seed, rounds)
        used = stored(usage(blocks.where(here), state), "usage")
        chosen = stored(template_genes(weights(state, genes), ["sample", "run", "component"], least=least_genes, most=most_genes), "chosen")
        held = supports(_supported(used), ["sample", "run", "component"]).join(sizes, "sample")
        kept = held.where(F.col("support") >= F.greatest(F.lit(least_support), F.ceil(0.01 * F.col("spots")))).select("sample", "run", "component")
        kept = stored(kept.join(chosen, ["sample", "run", "component"], "left_semi"), "kept")
        labels = stored(_labels(used, kept), "labels")
        both = labels if last is None else labels.unionByName(last)
        for r in agreement(both).orderBy("sample", "run").collect():  # a row a sample and run
            told[r.sample].append((r.run, r.ari))
        last = labels.where(F.col("run") == batch[-1])
        parts.append((used, chosen, kept))
        for s in open_:
            done[s] += len(batch)
        ends = lambda s: done[s] >= max(2, least_runs) and all(a >= match for _, a in told[s][-stable:]) and len(told[s]) >= stable
        open_ = [s for s in open_ if not ends(s)]
    used, chosen, kept = (_union([p[k] for p in parts]) for k in range(3))
    spark = cells.sparkSession
    ran = spark.createDataFrame([(s, n, [float(a) for _, a in told[s]]) for s, n in done.items()], "sample string, runs int, ari array<double>")
    name = F.concat(F.lpad(F.col("run").cast("string"), 4, "0"), F.lit("/"), F.lpad(F.col("component").cast("string"), 4, "0"))
    members = stored(chosen.join(kept, ["sample", "run", "component"], "left_semi").withColumn("id", name), "members")
    members = members.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("sample", "id")))
    sets = members.groupBy("sample", "id").agg(F.collect_set("gene").alias("genes"))
    other = sets.select("sample", F.col("id").alias("other"), F.col("genes").alias("others"))
    pairs = correlations(used, sizes, kept, min(correlation, strict)).join(sets, ["sample", "id"]).join(other, ["sample", "other"])
    common = F.size(F.array_intersect("genes", "others"))
    pairs = pairs.withColumn("overlap", common / (F.size("genes") + F.size("others") - common)).where((F.col("correlation") >= strict) | ((F.col("correlation") >= correlation) & (F.col("overlap") >= overlap)))
    pairs = stored(pairs.select("sample", "id", "other", (0.65 * F.col("correlation") + 0.35 * F.col("overlap")).alias("score")), "pairs")
    lead = stored(leaders(sets.select("sample", "id"), pairs, ["sample"], [F.desc("score"), "other"]), "leaders")
    return *_consensus(members, used, lead, ran, sizes, least_genes, most_genes), ran


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _consensus(members: DataFrame, used: DataFrame, lead: DataFrame, ran: DataFrame, sizes: DataFrame, few: int, most: int, core: float = 0.60, support: float = 0.40, edge: float = 0.25, least: float = 0.20) -> tuple[DataFrame, DataFrame]:
    key = ["sample", "leader"]
    run = F.substring_index("id", "/", 1)
    size = lead.groupBy(*key).agg(F.count_distinct(run).alias("run_support"), F.count(F.lit(1)).alias("members"))
    size = size.join(ran.select("sample", "runs"), "sample").withColumn("run_share", F.col("run_support") / F.col("runs")).where(F.col("run_share") >= least)
    g = members.join(lead, ["sample", "id"]).join(size.select(*key, "run_support"), key).groupBy(*key, "gene", "run_support").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("sum"))
    g = g.withColumns({"frequency": F.col("n") / F.col("run_support"), "weight": F.col("sum") / F.col("n")})
    w = Window.partitionBy(*key)
    g = g.withColumn("_any", F.max("frequency").over(w) >= edge).withColumn("_heavy", F.row_number().over(w.orderBy(F.desc("sum"), "gene")))
    g = S.top_k(g.where((F.col("frequency") >= edge) | (~F.col("_any") & (F.col("_heavy") <= few))), key, [F.desc("weight"), "gene"], most, "rank")
    g = g.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= few).withColumn("weight", F.col("weight") / F.sum("weight").over(w))
    some = F.max(F.col("frequency") >= core).over(w)
    scaffold = F.when(some, F.col("frequency") >= core).otherwise(F.col("rank") <= few)
    g = stored(g.withColumn("tier", F.when(scaffold, "scaffold").when(F.col("frequency") >= max(support, edge), "support").otherwise("context")).select(*key, "gene", "weight", "frequency", "rank", "tier"), "genes")
    mine = lead.select("sample", "leader", run.cast("int").alias("run"), F.substring_index("id", "/", -1).cast("int").alias("component")).join(size.select(*key, "members"), key)
    mean = _supported(used).join(mine, ["sample", "run", "component"]).groupBy(*key, "members", "spot").agg((F.sum("usage") / F.col("members")).alias("usage")).drop("members")
    spread = supports(stored(mean, "mean"), key)
    tiers = g.groupBy(*key).agg(F.count(F.lit(1)).alias("genes"), F.sum(F.col("weight") * F.col("weight")).alias("focus"), *[F.count_if(F.col("tier") == t).alias(t) for t in ("scaffold", "support", "context")])
    t = size.join(tiers, key).join(spread.withColumnRenamed("support", "spots_on"), key).join(sizes.select("sample", "spots"), "sample").withColumn("spot_share", F.col("spots_on") / F.col("spots"))
    t = t.withColumn("evidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.40 * F.col("run_share") + 0.35 * F.col("spot_share") + 0.25 * F.col("focus"))))
    program = F.format_string("P%04d", F.row_number().over(Window.partitionBy("sample").orderBy("leader")) - 1)
    t = t.select(*key, program.alias("program"), "runs", "run_support", "run_share", "members", "genes", "scaffold", "support", "context", "focus", "spot_share", "evidence")
    return t, g.join(t.select(*key, "program"), key)
