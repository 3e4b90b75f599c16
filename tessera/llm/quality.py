"""Text quality: random-indexing word vectors, pooled by document, and a two-layer network with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, small_batches, steps
from tessera.llm.words import ALPHANUMERIC, _power, mix

#: Word vectors: components, and non-zero ones of a word's random index vector.
DIMENSIONS, NONZERO = 32, 4
#: Words on each side that are a word's context.
REACH = 2
#: Rows of the table of word vectors, a parameter of the model: words are dealt to them by hash, every word of every text has one,
#: and words that share one share a vector. The table goes to every task, so this bounds it (16 MB of single precision for two readings).
BUCKETS = 1 << 16
#: Rows of the table that go together when the tasks' tables are added up.
BLOCK = 64
#: The network is fitted on at most this many labelled rows, those with the smallest hashes.
SAMPLE = 20_000
HIDDEN, EPOCHS, STEP_ROWS, RATE, DECAY = 32, 60, 128, 0.01, 1e-3
#: One labelled row in so many is kept from fitting, for the temperature.
CALIBRATION = 5
#: A word's weight is COMMON / (COMMON + its share of all words), which mutes frequent ones.
COMMON = 1e-3
#: Words whose vectors are held at a time.
HELD = 1 << 18
_rng = np.random.Generator(np.random.PCG64(12))
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_KIND = np.where(ALPHANUMERIC, 1, 2).astype(np.int8)
_KIND[[*range(33), 127]] = 0


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table rows of all tokens in order, and n + 1 token offsets of the texts. Tokens are runs of letters and digits (and all that
    is not ASCII) and runs of other visible characters; capitals count."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    kind = _KIND[data]
    edge = np.ones(n + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[at] = True
    edge = np.flatnonzero(edge)
    some = kind[edge[:-1]] > 0
    start, end = edge[:-1][some], edge[1:][some]
    power, inverse = _power(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_VALUE[data] * power[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(start, at)


@lru_cache(1)
def _index() -> tuple[np.ndarray, np.ndarray]:
    """The random index vectors: places and signs of the non-zero components of each table row."""
    rng = np.random.Generator(np.random.PCG64(2012))
    return rng.integers(0, DIMENSIONS, (BUCKETS, NONZERO)), rng.integers(0, 2, (BUCKETS, NONZERO), dtype=np.int32) * np.int32(2) - np.int32(1)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, n, v) of a task's texts: how often the words of a block of table rows stand there, and the sums of the index
    vectors of what stands around them. What follows is turned by one place, so that order tells."""
    where, sign = _index()
    table, count = np.zeros(BUCKETS * DIMENSIONS, np.int32), np.zeros(BUCKETS, np.int64)
    for _, data, at in steps(batches):
        row, token_at = tokens(data, at)
        owner = np.repeat(np.arange(len(at) - 1), np.diff(token_at))
        count += np.bincount(row, minlength=BUCKETS)
        for low in range(0, len(row), HELD):
            for d in range(1, REACH + 1):
                a, b = row[low : low + HELD], row[low + d : low + HELD + d]
                same = owner[low : low + len(b)][: len(a)] == owner[low + d : low + d + len(b)][: len(a)]
                a, b = a[: len(b)][same], b[: len(a)][same]
                np.add.at(table, (a[:, None] * DIMENSIONS + (where[b] + 1) % DIMENSIONS).ravel(), sign[b].ravel())
                np.add.at(table, (b[:, None] * DIMENSIONS + where[a]).ravel(), sign[a].ravel())
    some = np.flatnonzero(count.reshape(-1, BLOCK).any(axis=1))
    v, n = table.reshape(-1, BLOCK * DIMENSIONS), count.reshape(-1, BLOCK)
    for low in range(0, len(some), 128):
        part = some[low : low + 128]
        yield _blocks(part, n[part], v[part].astype(np.int64))
    give_back()


def _blocks(names: np.ndarray, n: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([x.tobytes() for x in n], pa.binary()), pa.array([x.tobytes() for x in v], pa.binary())], names=["block", "n", "v"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums by block of all rows of a partition, which come one batch after the other."""
    total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for block, n, v in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if block not in total:
                total[block] = np.zeros(BLOCK, np.int64), np.zeros(BLOCK * DIMENSIONS, np.int64)
            total[block][0][:] += np.frombuffer(n, np.int64)
            total[block][1][:] += np.frombuffer(v, np.int64)
    if total:
        yield _blocks(np.array(list(total)), np.stack([x[0] for x in total.values()]), np.stack([x[1] for x in total.values()]))


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, weights) by table row, from all words of all texts: unit context vectors, and weights that mute frequent words.

    Sums are of whole numbers, so neither the order of rows nor how they lie in partitions changes a bit. A task sends its
    table in blocks, whatever it read; BUCKETS rows come to the driver.
    """
    small_batches(docs.sparkSession)
    schema = "block int, n binary, v binary"
    vectors, count = np.zeros((BUCKETS, DIMENSIONS)), np.zeros(BUCKETS, np.int64)
    for r in docs.select("text").mapInArrow(_contexts, schema).repartition("block").mapInArrow(_added, schema).collect():
        at = slice(r.block * BLOCK, (r.block + 1) * BLOCK)
        count[at], vectors[at] = np.frombuffer(r.n, np.int64), np.frombuffer(r.v, np.int64).reshape(BLOCK, DIMENSIONS)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors /= np.where(length > 0, length, 1)
    return vectors.astype(np.float32), (COMMON / (COMMON + count / max(1, count.sum()))).astype(np.float32)


def pooled(data: np.ndarray, at: np.ndarray, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each text the mean of its words' vectors, plain and weighted; texts without words are zero. Each text's sum is its own."""
    row, token_at = tokens(data, at)
    out = np.zeros((len(at) - 1, 2 * DIMENSIONS))
    mass = np.zeros((len(at) - 1, 2))
    low = 0
    while low < len(token_at) - 1:  # so many whole texts at a time, or part after part of a long one
        high = max(low + 1, int(np.searchsorted(token_at, token_at[low] + HELD, "right")) - 1)
        some = low + np.flatnonzero(np.diff(token_at[low : high + 1]))
        if len(some):
            for a in range(int(token_at[low]), int(token_at[high]), HELD):
                own = row[a : min(a + HELD, int(token_at[high]))]
                first = token_at[some] - a if high > low + 1 else np.zeros(1, np.int64)
                v, w = vectors[own].astype(np.float64), weights[own].astype(np.float64)
                out[some, :DIMENSIONS] += np.add.reduceat(v, first, axis=0)
                out[some, DIMENSIONS:] += np.add.reduceat(v * w[:, None], first, axis=0)
                mass[some, 0] += np.diff(np.append(first, len(own)))
                mass[some, 1] += np.add.reduceat(w, first)
        low = high
    mass = np.where(mass > 0, mass, 1)
    out[:, :DIMENSIONS] /= mass[:, :1]
    out[:, DIMENSIONS:] /= mass[:, 1:]
    return out


@dataclass
class Network:
    """tanh over a hidden layer, one logit; features are centred and scaled, and the logit is divided by the temperature."""

    centre: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        x = (x - self.centre) / self.spread
        # products row by row as sums over columns: the result for a text does not depend on the texts beside it
        return np.round(np.einsum("nh,h->n", np.tanh(np.einsum("nd,dh->nh", x, a) + b), c) + d, 9)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500))), 6)


def gradients(weights: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean log loss of centred features x for labels y, and its gradient by each of the weights."""
    a, b, c, d = weights
    h = np.tanh(x @ a + b)
    z = h @ c + d
    loss = float(np.mean(np.logaddexp(0, z) - y * z))
    dz = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(y)
    dh = dz[:, None] * c * (1 - h * h)
    return loss, [x.T @ dh, dh.sum(0), h.T @ dz, np.array(dz.sum())]


def fit(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> Network:
    """Fits the network by Adam on four in CALIBRATION rows, then the temperature on the rest. Without rows every score is 0.5."""
    rng = np.random.Generator(np.random.PCG64(7))
    dim = x.shape[1]
    weights = [rng.normal(0, dim**-0.5, (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    if not len(y):
        return Network(np.zeros(dim), np.ones(dim), [*weights[:2], np.zeros(HIDDEN), weights[3]])
    held = np.arange(len(y)) % CALIBRATION == CALIBRATION - 1
    net = Network(x[~held].mean(0), np.maximum(x[~held].std(0), 1e-6), weights)
    own, label = (x[~held] - net.centre) / net.spread, y[~held].astype(np.float64)
    first, second, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        order, rate = rng.permutation(len(label)), RATE * (1 - epoch / epochs)
        for low in range(0, len(order), STEP_ROWS):
            part, t = order[low : low + STEP_ROWS], t + 1
            _, slope = gradients(weights, own[part], label[part])
            for k, g in enumerate(slope):
                g = g + DECAY * weights[k]
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    net.weights = weights
    if held.any():
        net.temperature = temperature(net.logits(x[held]), y[held])
    return net


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits, from 1/20 to 20, with the least log loss: golden section over its logarithm."""
    loss = lambda t: float(np.mean(np.logaddexp(0, logits / np.exp(t)) - y * logits / np.exp(t)))
    low, high, part = -np.log(20), np.log(20), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _pool(vectors: np.ndarray, weights: np.ndarray, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in steps(batches):
            x = pooled(data, at, vectors, weights)
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in carried), pa.array([r.tobytes() for r in x], pa.binary())], names=[*carried, "pooled"])

    return run


def learn(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, weights: np.ndarray, sample: int = SAMPLE) -> Network:
    """The network from the rows of docs whose doc_id labels rate, at most sample of them (by hash), outside the held-out fold.

    Labels of one doc_id that differ count as their mean, and a half is 1; rows without doc_id or quality teach nothing.
    Both the labels and the rows that meet them are taken by hash, so what is joined by broadcast and what comes to the
    driver has sample rows at most.
    """
    told = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold() != 1)).groupBy(F.col("doc_id").alias("own"))
    told = told.agg((F.avg("quality") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64(F.lit(12), "own"), "own").limit(sample)
    texts = docs.select(F.col("doc_id").alias("own"), "text").join(F.broadcast(told), "own")
    kind = texts.schema["own"].dataType.simpleString()
    found = texts.mapInArrow(_pool(vectors, weights, ["own", "y"]), f"own {kind}, y int, pooled binary")
    rows = found.orderBy(F.xxhash64(F.lit(12), "own"), "own", "pooled").limit(sample).collect()
    x = np.array([np.frombuffer(r.pooled, np.float64) for r in rows]).reshape(len(rows), 2 * DIMENSIONS)
    return fit(x, np.array([r.y for r in rows], np.int64))


def fold(column: str = "doc_id"):
    """0 to 2 from the CRC-32 of the id as text; 1 is held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3


def score(docs: DataFrame, labels: DataFrame, carried: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """The carried columns of docs (doc_id, unless told) with score and predicted.

    score is the calibrated chance of label 1, from 0 to 1; predicted is 1 from 0.5 on. Word vectors come from all texts,
    labels only from outside the held-out fold, and a score from the text alone: equal texts score alike. Null texts count
    as empty, and texts without words have the score of a zero vector. Without labels every score is 0.5, an empty table
    gives an empty one, repeated rows are each scored, and texts are taken whole, however long. Columns of docs or labels
    by other names have no part.
    """
    small_batches(docs.sparkSession)
    carried = carried or ["doc_id"]
    if {"score", "predicted"} & {c.lower() for c in carried}:
        raise ValueError("score and predicted are names of results")
    vectors, weights = word_vectors(docs)
    net = learn(docs, labels, vectors, weights, sample)
    pool = _pool(vectors, weights, carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pool(batches):
            x = np.frombuffer(b"".join(batch.column(len(carried)).to_pylist()), np.float64).reshape(batch.num_rows, -1)
            p = net.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*carried, "score", "predicted"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carried) + ", score double, predicted int"
    return docs.select(*carried, *[] if "text" in carried else ["text"]).mapInArrow(run, schema)
