"""Stupid-backoff scores of documents from n-gram count tables partitioned by hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, small_batches, steps, stored
from tessera.llm.words import _ODD, SPACED, mix, words

ORDER = 3
ALPHA = 0.4
#: An n-gram of two words or more that is seen less often than this backs off. A text's own n-grams are in the counts, so
#: with 1 nothing would ever back off; 2 asks for one other place.
LEAST = 2
#: Bytes of text in a block, whose n-grams are counted before any exchange (a longer text is a block by itself).
BLOCK_BYTES = 3 << 20
#: Bytes of text for each part of the count tables; a part has about 3 * PART_BYTES / 7 distinct n-grams of each block's.
PART_BYTES = 2 << 20

#: Tasks of an exchange at most; beyond it a task has several parts, one after the other.
MOST_TASKS = 50_000

_ROW = "block long, part long, n long, size int, a binary, b binary, c binary"
_ARROW = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("size", pa.int32()), *((x, pa.binary()) for x in "abc")])


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The width low bytes of 64-bit numbers, byte by byte, so that equal high bytes stand together."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8)[: n * width].reshape(width, n).T
    return out.view("<u8").ravel()


def _squeezed(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _plain(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, codec="zstd", asbytes=True)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes], np.ndarray, np.ndarray]]:
    """(block, doc_ids, texts, word hashes, word offsets) of blocks of whole texts.

    A block's number depends on its task, its place there and its words, so that a second reading of the same texts gives
    the same blocks, and one that differs gives others.
    """
    task, place = TaskContext.get().partitionId(), 0
    ids, texts, hashes, counts, size = [], [], [], [], 0

    def block():
        h, at = np.concatenate(hashes), np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        name = mix(np.array([task << 32 | place], np.uint64) + mix(h + np.arange(len(h), dtype=np.uint64)).sum() + np.uint64(len(ids)))
        return int(name.view(np.int64)[0]), ids, texts, h, at

    for rows, data, at in steps(batches, limit=BLOCK_BYTES // 2):
        h, word_at = words(data, at, SPACED)
        ids += rows.column(rows.schema.get_field_index("doc_id")).to_pylist()
        texts.append((data.tobytes(), np.diff(at)))
        hashes.append(h)
        counts.append(np.diff(word_at))
        size += len(data)
        if size >= BLOCK_BYTES // 2:
            yield block()
            ids, texts, hashes, counts, size, place = [], [], [], [], 0, place + 1
    if ids:
        yield block()


def _grams(h: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """For n from 1 to order: 64-bit names of the n-grams that end at each word; those that would begin before their text
    are not real (see _real)."""
    out, total = [], np.zeros(len(h), np.uint64)
    for n in range(1, order + 1):
        total[n - 1 :] += h[: len(h) - n + 1] * _ODD[n]
        out.append(mix(total + _ODD[n + 20]))
    return out


def _place(at: np.ndarray) -> np.ndarray:
    """Each word's number in its text, from 0."""
    n = np.diff(at)
    return np.arange(at[-1]) - np.repeat(at[:-1], n)


def _cells(names: np.ndarray, parts: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(part, low, high, 48 bits below the part) of the runs of sorted names; parts are ranges of names of equal width."""
    wide = np.uint64(parts)
    low, high = names & np.uint64(0xFFFFFFFF), names >> np.uint64(32)
    part = (high * wide + (low * wide >> np.uint64(32)) >> np.uint64(32)).astype(np.int64)
    below = names * wide >> np.uint64(16)
    start = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1)) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(part)], strict=False):
        yield int(part[a]), a, b, below[a:b]


def _counted(order: int, parts: int):
    """Rows by block and part: the block's distinct n-grams in the part, in order, and how often each stands in the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, h, at in _blocks(batches):
            place = _place(at)
            names, count = np.unique(np.concatenate([g[place >= n] for n, g in enumerate(_grams(h, at, order))]), return_counts=True)
            rows = []
            for part, a, b, below in _cells(names, parts):
                data = _planes(np.diff(below, prepend=np.uint64(0)), 6) + _planes(count[a:b], 4)
                rows.append((block, part, b - a, len(data), _squeezed(data), None, None))
                if len(rows) >= 512:
                    yield _packed(rows)
                    rows = []
            yield _packed(rows)
        give_back()

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows sorted by part: the same rows, with the counts of all blocks in place of the block's own."""
    held: list[tuple] = []

    def close() -> pa.RecordBatch:
        names, counts = [], []
        for _, _, n, size, a in held:
            data = _plain(a, size)
            names.append(np.cumsum(_numbers(data, n, 6), dtype=np.uint64))
            counts.append(_numbers(data[6 * n :], n, 4).astype(np.int64))
        _, at = np.unique(np.concatenate(names), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)[at]
        rows, low = [], 0
        for block, part, n, _, _ in held:
            rows.append((block, part, n, 8 * n, _squeezed(_planes(total[low : low + n], 8)), None, None))
            low += n
        return _packed(rows)

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(4)]
        for k, row in enumerate(zip(*columns, strict=True)):
            if held and row[1] != held[0][1]:
                yield close()
                held.clear()
            held.append((*row, batch.column(4)[k].as_py()))
    if held:
        yield close()
    give_back()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block with its texts, their lengths and doc_ids (a null one marked)."""
    for block, ids, texts, h, _ in _blocks(batches):
        data = b"".join(x for x, _ in texts)
        own = np.array([0 if x is None else x for x in ids], "<i8").tobytes() + np.array([x is None for x in ids]).tobytes()
        yield _packed([(block, -1, len(ids), len(data), _squeezed(data), np.concatenate([x for _, x in texts]).astype("<i8").tobytes(), own)])


def _scored(order: int, alpha: float, least: int):
    """For rows sorted by block, the texts first and then the counts by part: (doc_id, n_words, score, single) by document.

    score lacks the number of words in the corpus: single says how many words of the text are to be divided by it.
    """
    def close(texts: tuple, counts: list[tuple]) -> pa.RecordBatch:
        _, _, n, size, a, b, c = texts
        data = np.frombuffer(_plain(a, size), np.uint8)
        h, at = words(data, np.concatenate(([0], np.cumsum(np.frombuffer(b, "<i8")))), SPACED)
        place, grams = _place(at), _grams(h, at, order)
        real = [place >= k for k in range(order)]
        names, where = np.unique(np.concatenate([g[x] for g, x in zip(grams, real, strict=True)]), return_inverse=True)
        total = np.concatenate([_numbers(_plain(r[4], r[3]), r[2], 8) for r in counts]).astype(np.int64) if counts else np.zeros(0, np.int64)
        if len(total) != len(names):
            raise ValueError("the texts were not the same when they were read again; write them to a table first")
        held, low = [], 0
        for x in real:
            own = np.zeros(len(h), np.int64)
            m = int(x.sum())
            own[x] = total[where[low : low + m]]
            held.append(own)
            low += m
        score, done, factor = np.zeros(len(h)), np.zeros(len(h), bool), np.log10(alpha)
        most = np.minimum(place + 1, order)  # the longest n-gram that ends here
        for k in range(order, 1, -1):
            seen = ~done & (held[k - 1] >= least)
            some = np.flatnonzero(seen)
            score[some] = np.log10(held[k - 1][some] / held[k - 2][some - 1]) + factor * (most[some] - k)
            done |= seen
        some = np.flatnonzero(~done)
        score[some] = np.log10(held[0][some]) + factor * (most[some] - 1)
        doc = np.repeat(np.arange(n), np.diff(at))
        ids, none = np.frombuffer(c, "<i8", n), np.frombuffer(c, bool, n, 8 * n)
        sums, single = np.bincount(doc, weights=score, minlength=n), np.bincount(doc[~done], minlength=n)
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=none), pa.array(np.diff(at)), pa.array(sums), pa.array(single)], names=["doc_id", "n_words", "score", "single"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, counts = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = tuple(batch.column(x)[k].as_py() for x in range(7))
                if texts and row[0] != texts[0]:
                    yield close(texts, counts)
                    texts, counts = None, []
                if row[1] < 0:
                    texts = row
                elif texts:
                    counts.append(row)
                else:
                    raise ValueError("the texts were not the same when they were read again; write them to a table first")
        if texts:
            yield close(texts, counts)
        give_back()

    return run


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, log_score (base 10, of the whole text) and mean_log_score for each row of docs.

    Words are runs of characters other than ASCII white space, A to Z in lower case. A word w after a context of
    order - 1 words, or of as many as its text has before it, scores count(context w) / count(context) when
    count(context w) is at least `least`, else alpha times its score after the context without the first word; without a
    context, count(w) / words of the corpus. Counts are over all rows, the scored text included. Null, empty and blank
    texts have 0 words and score 0, mean null; an empty table gives no rows. Repeated rows count as often as they stand
    there. Only doc_id and text are read, and a null doc_id stays null.

    Relational: a block of texts is exploded into its n-grams, which are counted there first. The distinct ones go to the
    parts of the count table, ranges of their hashes, where the counts of all blocks are added, and the sums come back to
    the blocks in the same order. However often an n-gram stands in the corpus, it is one entry a block, so no key is hot.
    The texts are read twice and must come in the same partitions and order both times, as a table's do; if not, it is an
    error. 48 bits below the part tell the n-grams of a part apart.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // PART_BYTES))
    tasks = min(parts, MOST_TASKS)  # as many as there are parts, so that no task has many of them by chance
    entries = docs.mapInArrow(_counted(order, parts), _ROW)
    sums = entries.repartition(tasks, "part").sortWithinPartitions("part", "block").mapInArrow(_added, _ROW)
    both = docs.mapInArrow(_texts, _ROW).unionByName(sums).repartition(tasks, "block").sortWithinPartitions("block", "part")
    found = stored(both.mapInArrow(_scored(order, alpha, least), "doc_id long, n_words long, score double, single long"), "scores")
    total = max(1, found.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0])
    out = found.select("doc_id", "n_words", (F.col("score") - F.col("single") * F.lit(float(np.log10(total)))).alias("log_score"))
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


#: The same scores in DuckDB's SQL, for order 3, alpha 0.4 and least 2.
ORACLE = r"""WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
t AS (
  SELECT r, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v, CASE WHEN i > 2 THEN ws[i - 2] END AS u
  FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
n AS (SELECT count(*) AS n FROM t),
c1 AS (SELECT w, count(*) AS c FROM t GROUP BY w),
c2 AS (SELECT v, w, count(*) AS c FROM t WHERE v IS NOT NULL GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS c FROM t WHERE u IS NOT NULL GROUP BY u, v, w),
s AS (
  SELECT t.r, sum(CASE
    WHEN c3.c >= 2 THEN log10(c3.c / b.c)
    WHEN c2.c >= 2 THEN log10(c2.c / a.c) + CASE WHEN t.u IS NULL THEN 0 ELSE log10(0.4::DOUBLE) END
    ELSE log10(c1.c / n.n) + log10(0.4::DOUBLE) * ((t.v IS NOT NULL)::INT + (t.u IS NOT NULL)::INT) END) AS s
  FROM t JOIN c1 ON t.w = c1.w LEFT JOIN c2 ON t.v = c2.v AND t.w = c2.w LEFT JOIN c3 ON t.u = c3.u AND t.v = c3.v AND t.w = c3.w
  LEFT JOIN c1 a ON t.v = a.w LEFT JOIN c2 b ON t.u = b.v AND t.v = b.w, n GROUP BY t.r)
SELECT doc_id, len(ws)::BIGINT AS n_words, round(coalesce(s, 0), 3) AS log_score, CASE WHEN len(ws) > 0 THEN round(s / len(ws), 4) END AS mean_log_score
FROM d LEFT JOIN s ON d.r = s.r"""
