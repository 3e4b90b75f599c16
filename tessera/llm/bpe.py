"""Byte-level BPE by merge replay over the distinct words of a block of the corpus."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import small_batches, steps

#: Distinct words whose ids a worker keeps from block to block; beyond it all are dropped and encoded again when met.
MOST_WORDS = 300_000
#: Bytes of text in a block, whose new distinct words are replayed together.
BLOCK_BYTES = 8 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


class MergeTable:
    """Ranks by pair of tokens: every way to split a token into two tokens is a pair that joins to it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.text = {r: t for t, r in ranks.items()}
        self.byte = np.array([ranks[bytes([x])] for x in range(256)], np.int64)
        found = [(ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        found.sort()
        self.pairs = dict(found)
        self.keys = np.array([k for k, _ in found] + [1 << 62], np.int64)
        self.joins = np.array([r for _, r in found] + [-1], np.int64)

    def rank(self, a: int, b: int) -> int:
        """The token that joins a and b, which is also the rank of the merge; -1 for none."""
        return self.pairs.get(a << 32 | b, -1)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.joins[at], -1)


def replay(words: list[bytes], table: MergeTable) -> list[bytes]:
    """Token ids of each word as little-endian 32-bit numbers: all merges in the order of their ranks, over all words at once.

    The words stand one after the other in one array. An index has the places of every pair that some merge joins; a
    merge takes all its places in one step and looks up again only the pairs on their two sides. Inside a word the
    lowest rank decides and then the leftmost place. So words where places of one merge overlap, or where a merge makes
    a pair of lower rank, are replayed by themselves, place by place.
    """
    size = np.array([len(w) for w in words], np.int64)
    token = table.byte[np.frombuffer(b"".join(words), np.uint8)]
    n = len(token)
    word = np.repeat(np.arange(len(words)), size)
    before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
    ends = np.cumsum(size)
    before[(ends - size)[size > 0]] = -1
    after[ends[size > 0] - 1] = -1
    now = np.full(n, -1, np.int64)
    inner = np.flatnonzero(after >= 0)
    now[inner] = table.ranks(token[inner], token[inner + 1])
    odd = np.zeros(len(words), bool)
    start = np.flatnonzero(now >= 0)
    start = start[np.argsort(now[start], kind="stable")]
    names, at = np.unique(now[start], return_index=True)
    places: dict[int, list] = {r: x for r, x in zip(names.tolist(), np.split(start, at[1:]), strict=True)} if len(start) else {}
    order = list(places)
    heapify(order)
    while order:
        r = heappop(order)
        p = np.unique(places.pop(r))
        p = p[(now[p] == r) & ~odd[word[p]]]
        over = p[1:][p[1:] == after[p[:-1]]]
        if len(over):
            odd[word[over]] = True
            p = p[~odd[word[p]]]
        if not len(p):
            continue
        old, j = token[p], after[p]
        k = after[j]
        token[p], token[j], now[j], after[p] = r, -1, -1, k
        right = k >= 0
        before[k[right]] = p[right]
        touching = np.flatnonzero(k[:-1] == p[1:])
        if len(touching):
            passing = table.ranks(np.full(len(touching), r), old[touching + 1])
            odd[word[p[touching[(passing >= 0) & (passing < r)]]]] = True
        left = before[p]
        a = np.concatenate((p[right], left[left >= 0]))
        now[p] = -1
        now[a] = new = table.ranks(token[a], token[after[a]])
        odd[word[a[(new >= 0) & (new < r)]]] = True
        real = new > r
        for x, i in zip(new[real].tolist(), a[real].tolist(), strict=True):
            if x in places:
                if not isinstance(places[x], list):
                    places[x] = places[x].tolist()
                places[x].append(i)
            else:
                places[x] = [i]
                heappush(order, x)
    live = token >= 0
    flat = token[live].astype("<u4").tobytes()
    cut = [0, *(np.cumsum(np.bincount(word[live], minlength=len(words))) * 4).tolist()]
    out = [flat[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
    for x in np.flatnonzero(odd).tolist():
        out[x] = np.array(_replay_one(words[x], table), "<u4").tobytes()
    return out


def _replay_one(word: bytes, table: MergeTable) -> list[int]:
    """The same for one word, its places in a heap by rank and then from the left."""
    token = table.byte[np.frombuffer(word, np.uint8)].tolist()
    n = len(token)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    order = [(r, i) for i in range(n - 1) if (r := table.rank(token[i], token[i + 1])) >= 0]
    heapify(order)
    while order:
        r, i = heappop(order)
        j = after[i]
        if token[i] < 0 or j < 0 or table.rank(token[i], token[j]) != r:
            continue
        k = after[j]
        token[i], token[j], after[i] = r, -1, k
        if k >= 0:
            before[k] = i
            if (new := table.rank(r, token[k])) >= 0:
                heappush(order, (new, i))
        if (h := before[i]) >= 0 and (new := table.rank(token[h], r)) >= 0:
            heappush(order, (new, h))
    return [t for t in token if t >= 0]


_workers: dict[tuple, tuple] = {}


def _worker(path: str, pattern: str) -> tuple:
    """What a Python worker keeps from task to task: the table, the splitter, and ids and decoded bytes by word."""
    if (path, pattern) not in _workers:
        _workers[path, pattern] = MergeTable(read_ranks(path)), regex.compile(pattern), {}, {}
    return _workers[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, carried: list[str], ids: bool = True) -> DataFrame:
    """The carried columns of docs with the ids of the whole text (null: empty), n_tokens, ids_sha256 and decoded_sha256.

    Each match of pattern is a word. A task takes blocks of its texts, replays the merges over the distinct words of a
    block that it has not met, and puts the texts together from the words; nothing is exchanged. decoded_sha256 is over
    the bytes that the ids stand for. Without ids the column of ids is left out. The rank file must be at path on every
    executor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, split, known, plain = _worker(path, pattern)
        for rows, data, at in steps(batches, limit=BLOCK_BYTES):
            raw = data.tobytes()
            texts = [split.findall(raw[a:b].decode("utf-8", "replace")) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            new = list(set().union(*texts).difference(known))
            if len(known) + len(new) > MOST_WORDS:
                known.clear()
                plain.clear()
                new = list(set().union(*texts))
            for w, own in zip(new, replay([w.encode() for w in new], table), strict=True):
                known[w] = own
                plain[w] = b"".join([table.text[t] for t in np.frombuffer(own, "<u4").tolist()])
            n, digests, decoded, all_ids = [], [], [], []
            for text in texts:
                joined = b"".join([known[w] for w in text])
                n.append(len(joined) // 4)
                digests.append(hashlib.sha256(joined).hexdigest())
                decoded.append(hashlib.sha256(b"".join([plain[w] for w in text])).hexdigest())
                if ids:
                    all_ids.append(np.frombuffer(joined, "<u4").astype(np.int32))
            columns = [rows.column(rows.schema.get_field_index(x)) for x in carried]
            names = [*carried, "n_tokens", "ids_sha256", "decoded_sha256"]
            columns += [pa.array(n, pa.int64()), pa.array(digests), pa.array(decoded)]
            if ids:
                ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    small_batches(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carried) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(*dict.fromkeys([*carried, "text"])).mapInArrow(run, schema)


def decode(ids: list[int], ranks: dict[bytes, int]) -> bytes:
    """The bytes that the ids stand for."""
    text = {r: t for t, r in ranks.items()}
    return b"".join([text[x] for x in ids])
