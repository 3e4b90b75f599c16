"""Benchmark decontamination through a distributed positional inverted index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bit_table, discard, in_table, small_batches, steps, stored, unused
from tessera.llm.words import ALPHANUMERIC, words

WINDOW = 13
#: Words on each side of a window's rarest term within which all its other terms make a proximity match.
REACH = 2 * WINDOW
#: Documents in one file of what is contaminated, at most.
FILE_ROWS = 250_000
#: Windows of an item that go together, and such runs that are searched in a segment at a time.
RUN, CHUNK = 64, 128
#: Bytes of runs, counted first, that may be sent to every task in place of an exchange of the index.
SENT_BYTES = 32 << 20
#: Places of rarest terms, or pairs of a document and a window, that are looked at at a time.
PLACES = 1 << 18


def build_index(docs: DataFrame) -> DataFrame:
    """Segments of a positional inverted index over whole texts, one row each.

    A segment holds the documents of one step of text: doc_ids, lengths (words by document), the sorted distinct terms,
    the end of each term's postings, and the postings, which are word positions in the segment in ascending order. The
    positions of two documents are at least two apart. Every word is posted. doc_id may be text or binary; else it is a long.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for rows, data, at in steps(batches):
            hashes, word_at = words(data, at, ALPHANUMERIC)
            length = np.diff(word_at)
            place = np.arange(len(hashes)) + np.repeat(np.arange(len(length)), length)
            order = np.argsort(hashes, kind="stable")
            hashes, place = hashes[order], place[order]
            first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
            ends = np.append(first[1:], len(hashes))[: len(first)]
            one = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
            ids = rows.column(rows.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment], pa.int64()), pa.array([ids.to_pylist()], pa.list_(ids.type)), one(length, "<i4"), one(hashes[first], "<u8"), one(ends, "<i4"), one(place, "<i4")],
                names=["segment", "doc_ids", "lengths", "terms", "ends", "postings"],
            )
            segment += 1

    kind = _kind(docs)
    return docs.select(F.col("doc_id").cast(kind).alias("doc_id"), "text").mapInArrow(run, f"segment long, doc_ids array<{kind}>, lengths binary, terms binary, ends binary, postings binary")


def _kind(docs: DataFrame) -> str:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return kind if kind in ("string", "binary") else "long"


def _runs(size: int):
    """(run, item, terms) of the words of items, as hashes: RUN windows that follow one another, or fewer at an item's end.

    The words that windows share are there once; the last size - 1 words of a run begin the next one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in steps(batches, limit=1 << 20):
            hashes, word_at = words(data, at, ALPHANUMERIC)
            ids = rows.column(rows.schema.get_field_index("item")).to_pylist()
            name, item, terms = [], [], []
            for own, low, high in zip(ids, word_at[:-1].tolist(), word_at[1:].tolist(), strict=True):
                for k in range(low, max(low + 1, high - size + 1) if high > low else low, RUN):
                    item.append(own)
                    terms.append(hashes[k : min(high, k + RUN + size - 1)].astype("<u8").tobytes())
                    name.append(int.from_bytes(hashlib.blake2b(terms[-1] + repr(own).encode(), digest_size=8).digest(), "little", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(item, pa.string()), pa.array(terms, pa.binary())], names=["run", "item", "terms"])

    return run


def _segment_terms(bits: bytes):
    """(term, segment, n) of the terms of segments that a table of bits may hold: how often each stands there."""
    filled = np.frombuffer(bits, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, terms, ends in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                terms, ends = np.frombuffer(terms, "<u8"), np.frombuffer(ends, "<i4").astype(np.int64)
                keep = in_table(filled, terms)
                yield pa.RecordBatch.from_arrays([pa.array(terms[keep].view(np.int64)), pa.array(np.full(keep.sum(), segment, np.int64)), pa.array(np.diff(ends, prepend=0)[keep])], names=["term", "segment", "n"])

    return run


class Windows:
    """The distinct windows of some runs as term numbers in a table: one row a window, -1 beyond a short one's words.

    items are the names of the items; the numbers of those that hold window k are owner[first[k] : first[k + 1]].
    """

    def __init__(self, items: list[str], terms: list[bytes], size: int = WINDOW):
        length = np.array([len(x) // 8 for x in terms], np.int64)
        many = np.maximum(1, length - size + 1)
        self.items, owner = np.unique(np.array(items, object), return_inverse=True)
        self.terms, number = np.unique(np.frombuffer(b"".join(terms), "<u8"), return_inverse=True)
        part = np.repeat(np.minimum(length, size), many)
        first = np.repeat(np.cumsum(length) - length - (np.cumsum(many) - many), many) + np.arange(many.sum())
        at = np.arange(int(part.max()))
        table = np.where(at < part[:, None], number[np.minimum(first[:, None] + at, len(number) - 1)], -1)
        self.table, which = np.unique(table, axis=0, return_inverse=True)
        self.size = (self.table >= 0).sum(axis=1)
        held = np.unique(np.stack((which.ravel(), np.repeat(owner, many)), axis=1), axis=0)
        self.owner, self.first = held[:, 1], np.searchsorted(held[:, 0], np.arange(len(self.table) + 1))

    def held(self, docs: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The distinct pairs of a document and an item that holds one of its windows, as docs * items + item."""
        n = len(self.items)
        out = np.zeros(0, np.int64)
        pairs = np.unique(docs * np.int64(len(self.table)) + rows)
        docs, rows = pairs // len(self.table), pairs % len(self.table)
        many = self.first[rows + 1] - self.first[rows]
        before = np.concatenate(([0], np.cumsum(many)))
        for low in range(0, int(before[-1]), PLACES):
            g = np.arange(low, min(low + PLACES, int(before[-1])))
            k = np.searchsorted(before, g, "right") - 1
            out = np.unique(np.concatenate((out, docs[k] * n + self.owner[self.first[rows[k]] + g - before[k]])))
        return out


def searched(terms: np.ndarray, ends: np.ndarray, postings: np.ndarray, base: np.ndarray, windows: Windows, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Exact occurrences in a segment as rows of windows and start positions, and proximity matches as rows and positions
    of the rarest term.

    For each window the list of its rarest term gives the places. Exact: the offset is taken off, and the other lists,
    rarest first, keep the starts that they have at their own offsets. Proximity: the other lists, in the same order, keep
    the places of the rarest term that they have a posting near, at most reach words away in the same document. base has
    the first position of each document, and the end. PLACES places are taken at a time, of however many windows or of a
    part of one's list, so what is held does not grow with how often a term stands in the segment.
    """
    n = len(windows.terms)
    at = np.searchsorted(terms, windows.terms)
    here = (at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == windows.terms) if len(terms) else np.zeros(n, bool)
    starts = np.concatenate(([0], ends)).astype(np.int64)
    low = np.where(here, starts[np.minimum(at, len(terms))], 0)
    count = np.where(here, starts[np.minimum(at + 1, len(terms))] - low, 0)
    table = windows.table
    size = np.where(table >= 0, count[table], np.iinfo(np.int64).max)
    row = np.flatnonzero(size.min(axis=1) > 0)
    if not len(row):
        return
    order = np.argsort(size[row], axis=1, kind="stable")
    rare = table[row, order[:, 0]]
    before = np.concatenate(([0], np.cumsum(count[rare])))
    key = (np.repeat(np.arange(len(terms)), np.diff(starts)) << 32) | postings
    number = np.where(here, at, 0) << 32
    for begin in range(0, int(before[-1]), PLACES):
        g = np.arange(begin, min(begin + PLACES, int(before[-1])))
        which = np.searchsorted(before, g, "right") - 1
        place = postings[low[rare][which] + g - before[which]].astype(np.int64)
        exact, start = which, place - order[which, 0]
        doc = np.searchsorted(base, place, "right") - 1
        near, first, last = which, np.maximum(place - reach, base[doc]), np.minimum(place + reach, base[doc + 1] - 1)
        for k in range(1, table.shape[1]):
            col = order[exact, k]
            term = table[row[exact], col]
            want = number[np.maximum(term, 0)] | (start + col).clip(0)
            found = np.searchsorted(key, want)
            keep = (term < 0) | ((key[np.minimum(found, len(key) - 1)] == want) & (start >= 0))
            exact, start = exact[keep], start[keep]
            term = table[row[near], order[near, k]]
            own = number[np.maximum(term, 0)]
            keep = (term < 0) | (np.searchsorted(key, own | last, "right") > np.searchsorted(key, own | first))
            near, first, last, place = near[keep], first[keep], last[keep], place[keep]
        keep = start >= 0
        yield row[exact[keep]], start[keep], row[near], place


def search(*args) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All that searched() finds, at once."""
    parts = list(searched(*args)) or [(np.zeros(0, np.int64),) * 4]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _hits(size: int, reach: int):
    """(segment, ordinal, spans, items, near) by document with a match in one chunk of windows: merged spans of hit words as
    pairs of numbers, the items with exact occurrences and those with proximity matches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                base = np.concatenate(([0], np.cumsum(np.frombuffer(r["lengths"], "<i4").astype(np.int64) + 1)))
                windows = Windows([x["item"] for x in r["windows"]], [x["terms"] for x in r["windows"]], size)
                step = np.zeros(base[-1] + 1, np.int32)
                held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
                for row, start, near_row, place in searched(np.frombuffer(r["terms"], "<u8"), np.frombuffer(r["ends"], "<i4"), np.frombuffer(r["postings"], "<i4"), base, windows, reach):
                    np.add.at(step, start, 1)
                    np.add.at(step, start + windows.size[row], -1)
                    for which, (rows, at) in enumerate(((row, start), (near_row, place))):
                        held[which] = np.union1d(held[which], windows.held(np.searchsorted(base, at, "right") - 1, rows))
                hit = np.cumsum(step) > 0
                edge = np.flatnonzero(np.diff(hit, prepend=False))
                own = {d: ([], [], []) for d in np.unique(np.concatenate(held) // len(windows.items)).tolist()}
                for d, s, e in zip((np.searchsorted(base, edge[::2], "right") - 1).tolist(), edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    own[d][0].append({"s": s, "e": e})
                for which, pairs in enumerate(held, 1):
                    for x in pairs.tolist():
                        own[x // len(windows.items)][which].append(windows.items[x % len(windows.items)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["segment"]] * len(own), pa.int64()), pa.array(list(own), pa.int64()), pa.array([x[0] for x in own.values()], _SPANS), *(pa.array([x[w] for x in own.values()], pa.list_(pa.string())) for w in (1, 2))],
                    names=["segment", "ordinal", "spans", "items", "near"],
                )

    return run


_SPANS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def _ordinals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for segment, ids, lengths in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([segment] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(ids, batch.schema.field(1).type.value_type), pa.array(np.frombuffer(lengths, "<i4").astype(np.int64))], names=["segment", "ordinal", "doc_id", "n_words"])


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, reach: int = REACH, chunk: int = CHUNK) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit, items and near_items (sorted item ids as text).

    A word is hit when it lies in an occurrence of a window: size consecutive words of a benchmark item, or all words of
    a shorter one. items have a window that occurs; near_items have one of whose rarest term some place has all its other
    terms within reach words, in any order: a proximity match, which every exact one is as long as reach is not below size.
    Null and empty texts have no words and no hits, items without words have no windows, repeated rows and repeated items
    are each taken as they are, and an empty benchmark hits nothing.

    The index of all words is written to the shared folder once. The benchmark is never collected: runs of its windows are
    joined to the segments that have some window's rarest term in the corpus, and searched there, chunk runs at a time.
    """
    small_batches(docs.sparkSession)
    index = stored(build_index(docs), "index", compression="zstd")
    few = 1 + index.count() // 256
    every = index.select("segment", "doc_ids", "lengths").mapInArrow(_ordinals, f"segment long, ordinal long, doc_id {_kind(docs)}, n_words long")
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
    runs = stored(items.mapInArrow(_runs(size), "run long, item string, terms binary").dropDuplicates(["run"]), "runs", few)
    posted = runs.select("run", "terms").mapInArrow(_apart(size), "run long, place int, n int, term long")
    terms = posted.select("term").distinct()
    lists = index.select("segment", "terms", "ends").mapInArrow(_segment_terms(bit_table(terms, "term")), "term long, segment long, n long")
    lists = stored(lists.join(terms, "term", "left_semi").repartition(few), "lists")
    often = lists.groupBy("term").agg(F.sum("n").alias("often"))
    rare = posted.join(often, "term").groupBy("run", "place", "n").agg(F.min(F.struct("often", "term")).alias("rare"), F.count(F.lit(1)).alias("known"))
    # a window has a place in the segments that have its rarest term; one with an unknown term has none
    met = rare.where("known = n").select("run", F.col("rare.term").alias("term")).distinct().join(lists.select("term", "segment"), "term").select("run", "segment").distinct()
    parts = met.groupBy("segment").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).alias("parts"))
    dealt = met.join(parts, "segment").withColumn("part", F.pmod(F.xxhash64("run"), F.col("parts"))).join(runs, "run")
    packed = dealt.groupBy("segment", "part").agg(F.sum(F.octet_length("terms") + 64).alias("bytes"), F.collect_list(F.struct("item", "terms")).alias("windows"))
    packed = stored(packed, "packed", few)
    discard(runs, lists)
    small = (packed.agg(F.sum("bytes")).first()[0] or 0) <= SENT_BYTES
    both = index.join(F.broadcast(packed) if small else packed, "segment").select("segment", "lengths", "terms", "ends", "postings", "windows")
    found = both.mapInArrow(_hits(size, reach), "segment long, ordinal long, spans array<struct<s:long,e:long>>, items array<string>, near array<string>")
    cover = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda x, y: F.struct((x["n"] + F.greatest(F.lit(0).cast("long"), y["e"] - F.greatest(y["s"], x["to"]))).alias("n"), F.greatest(x["to"], y["e"]).alias("to")),
    )
    names = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    found = stored(found.groupBy("segment", "ordinal").agg(cover["n"].alias("n_hit"), names("items").alias("items"), names("near").alias("near_items")), "found")
    discard(packed)
    none = F.array().cast("array<string>")
    out = every.join(found, ["segment", "ordinal"], "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))
    out = stored(out, "matches")
    discard(index, found)
    return out


def _apart(size: int):
    """(run, place, n, term) for the n distinct terms of each window of runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.frombuffer(data, "<u8")
                own = [np.unique(h[k : k + size]).view(np.int64) for k in range(max(1, len(h) - size + 1))]
                n = [len(x) for x in own]
                place, many, term = np.repeat(np.arange(len(own)), n).astype(np.int32), np.repeat(n, n).astype(np.int32), np.concatenate(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(term), name)), pa.array(place), pa.array(many), pa.array(term)], names=["run", "place", "n", "term"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = 20) -> DataFrame:
    """matches() with the rule: contaminated when some word is hit and share * n_hit >= n_words."""
    return matches(docs, benchmark, size).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns, whatever these are called.

    Rows are judged by their text alone, so a null or repeated doc_id changes nothing; null and empty texts stay.
    """
    key, bad = unused(docs.columns, "key", "bad")
    name = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))  # 128 bits, so that no other text's fate is met by chance
    told = contaminated(docs.select(name.alias("doc_id"), "text"), benchmark)
    found = stored(told.where("contaminated").select(F.col("doc_id").alias(bad)).distinct(), "contaminated", 1 + docs.count() // FILE_ROWS)
    keyed = docs.withColumn(key, name)
    return keyed.join(found, F.col(key) == F.col(bad), "left_anti").select(*docs.columns)


def items_sha256(items: str = "items"):
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)
