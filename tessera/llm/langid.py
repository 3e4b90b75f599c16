"""Language identification by hyperdimensional letter n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, steps

DIMENSIONS = 512
GRAM = 3
SEED = 8
#: Prototypes go to the driver and to every task: DIMENSIONS numbers for each language, so languages are bounded.
MOST_LANGUAGES = 2000
#: Texts are handled in steps of this many bytes.
STEP = 1 << 18
SCALE = 1 << 20
#: Counts (texts by n-grams) held at a time.
CELLS = 1 << 21


@lru_cache(1)
def _folded() -> np.ndarray:
    """For each code point its lower-case form if it is a letter, else 0."""
    out = np.zeros(0x110000, np.int64)
    for x in range(0x110000):
        if (c := chr(x)).isalpha():
            out[x] = ord(c.lower()[0])
    return out


@lru_cache(100_000)
def _letter(code: int) -> np.ndarray:
    """A random vector of -1 and 1 for each letter; 0 is the gap between words."""
    return np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, DIMENSIONS, dtype=np.int8) * np.int8(2) - np.int8(1)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, their bundled n-gram vectors at unit length, and whether a row has a letter."""
    fold = _folded()
    for rows, data, at in steps(batches, limit=STEP):
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        n = len(texts)
        out, some = np.zeros((n, DIMENSIONS), np.float32), np.zeros(n, bool)
        # a gap before and after each text: no n-gram reaches over two texts without one
        codes = fold[np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)]
        ends = np.cumsum([1, *(len(x) + 1 for x in texts)])
        owner = np.repeat(np.arange(-1, n), np.diff(np.concatenate(([0], ends))))
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
        codes, owner = codes[keep], owner[keep]
        some[np.unique(owner[codes > 0])] = True
        letters, code = np.unique(codes, return_inverse=True)
        gaps = code == (0 if letters[0] == 0 else -1)
        k = len(letters)
        if some.any():
            gram = np.zeros(len(code) - GRAM + 1, np.int64)
            for j in range(GRAM):
                gram = gram * k + code[j : len(code) - GRAM + 1 + j]
            of = owner[1 : len(code) - GRAM + 2]  # the middle letter's text
            real = ~gaps[1 : len(code) - GRAM + 2] & (of >= 0)
            gram, of = gram[real], of[real]
            if k**GRAM <= 1 << 22:
                names = np.flatnonzero(np.bincount(gram, minlength=1))
                number = np.zeros(int(names[-1]) + 1, np.int64)
                number[names] = np.arange(len(names))
                number = number[gram]
            else:
                names, number = np.unique(gram, return_inverse=True)
            table = np.stack([_letter(int(x)) for x in letters])
            for low in range(0, len(names), 1 << 14):  # in parts, so that many alphabets take no more memory
                part = names[low : low + (1 << 14)]
                bound = np.ones((len(part), DIMENSIONS), np.int8)
                rest = part
                for j in range(GRAM):
                    bound *= np.roll(table, j, axis=1)[rest % k]
                    rest = rest // k
                own = (number >= low) & (number < low + len(part)) if len(names) > 1 << 14 else slice(None)
                row, cell, bound = of[own], number[own] - low, bound.astype(np.float32)
                some_rows = max(1, CELLS // len(part))  # and so many texts at a time, however short they are
                for a in range(0, n, some_rows):
                    b = min(n, a + some_rows)
                    x, y = np.searchsorted(row, (a, b))
                    counts = np.bincount((row[x:y] - a) * len(part) + cell[x:y], minlength=(b - a) * len(part))
                    out[a:b] += counts.reshape(b - a, -1).astype(np.float32) @ bound
        length = np.linalg.norm(out, axis=1, keepdims=True)
        out /= np.where(length > 0, length, 1)
        yield rows, out, some


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for rows, vectors, some in _vectors(batches):
        lang = rows.column(rows.schema.get_field_index("lang")).to_pylist()
        for name in {x for x, y in zip(lang, some, strict=True) if y}:
            own = np.array([x == name for x in lang]) & some
            totals[name] = totals.get(name, 0) + np.rint(vectors[own].astype(np.float64) * SCALE).astype(np.int64).sum(axis=0)
    if totals:
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([x.tolist() for x in totals.values()], pa.list_(pa.int64()))], names=["lang", "total"])


def learn(labelled: DataFrame) -> dict[str, list[float]]:
    """Unit prototypes by language from all rows (text, lang) with a language and a letter; sums are whole numbers, so the order of rows doesn't matter."""
    parts = labelled.where(F.col("lang").isNotNull()).select("text", "lang").mapInArrow(_bundled, "lang string, total array<long>")
    cells = parts.select("lang", F.posexplode("total").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    rows = cells.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("total")).limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; the prototypes would not be small")
    out = {}
    for r in rows:
        total = np.array(r.total, np.float64)
        if norm := np.linalg.norm(total):
            out[r.lang] = (total / norm).tolist()
    return dict(sorted(out.items()))


def predict(docs: DataFrame, prototypes: dict[str, list[float]], carried: list[str]) -> DataFrame:
    """The carried columns of docs with lang_pred and score, the cosine (below 0: 0) with the nearest prototype.

    Texts that are null or have no letter, and all texts when nothing was learned, are `und` with score 0. Equal
    cosines go to the language that comes first in the alphabet. A text is taken whole, however long.
    """
    names, matrix = list(prototypes), np.array(list(prototypes.values()), np.float32).reshape(len(prototypes), DIMENSIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, vectors, some in _vectors(batches):
            if names:
                cosine = np.round((vectors @ matrix.T).astype(np.float64), 6)
                best = cosine.argmax(axis=1)
                score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
            else:
                best, score, some = np.zeros(len(some), int), np.zeros(len(some)), np.zeros(len(some), bool)
            lang = [names[b] if s else "und" for b, s in zip(best.tolist(), some, strict=True)]
            columns = [rows.column(rows.schema.get_field_index(x)) for x in carried]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(np.where(some, score, 0.0))], names=[*carried, "lang_pred", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carried) + ", lang_pred string, score double"
    return docs.select(*carried, *[] if "text" in carried else ["text"]).mapInArrow(run, schema)


def fold(column: str = "doc_id"):
    """0 to 3 from the CRC-32 of the id as text; 2 is held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4


def identify(docs: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """Learns from the labelled rows outside the held-out fold and predicts every row.

    A null doc_id has no fold: such a row is predicted and not learned from.
    """
    small_batches(docs.sparkSession)
    prototypes = learn(docs.where(fold() != 2))
    return predict(docs, prototypes, carried or ["doc_id"])
