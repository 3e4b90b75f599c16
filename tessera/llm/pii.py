"""Personal data: patterns, and terms that disclose a protected entity by corpus co-occurrence."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bit_table, discard, in_table, small_batches, steps, stored, unused
from tessera.llm.words import ALPHANUMERIC, words

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns of the contract.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_email, _email_first = re.compile(EMAIL), re.compile(r"(?<![A-Za-z0-9._%+-])" + EMAIL)
_ip, _card, _phone, _long = re.compile(r"(?<![0-9])" + IP), re.compile(CARD), re.compile(PHONE), re.compile(r"[0-9][\x20-]?[0-9]")
_word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_digits = re.compile(r"[^0-9]+")

#: Words on each side of an entity that may disclose it.
REACH = 8
#: Documents for each file of the small tables.
FILE_ROWS = 250_000
#: Different surroundings in which a term must stand by an entity before its estimate counts.
SUPPORT = 3
#: A term discloses an entity when at least this share of its different surroundings has the entity ...
DISCLOSURE = 0.8
#: ... and knowing it takes at least this many bits off the uncertainty about the entity.
BITS = 4.0


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        v = int(x) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all base matches, by start and then in the order of KINDS.

    Leftmost and non-overlapping within a kind; a match that fails its test is dropped and the search goes on after it.
    Runs of local-part characters and of digits are entered at their first character only, as a later one finds the
    same end, so no text takes quadratic time.
    """
    out = []
    if "@" in text:
        at, last = 0, text.rindex("@")
        while at <= last:
            m = _email.match(text, at) if at else None
            m = m or _email_first.search(text, at)
            if not m:
                break
            out.append((m.start(), m.end(), 0))
            at = m.end()
    if _long.search(text) or "." in text and any(x in text for x in "0123456789"):
        for m in _ip.finditer(text):
            if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _card.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits.sub("", m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _phone.finditer(text):
            if 10 <= len(_digits.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _folded(text: str) -> str:
    """ASCII capitals in lower case; as many code points as before."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _outside(places: list[tuple[int, int]], spans: list[tuple[int, int, str]]) -> list[bool]:
    """Which places, sorted by start, overlap no span."""
    out, k, reach = [], 0, 0
    for a, b in places:
        while k < len(spans) and spans[k][0] < b:
            reach = max(reach, spans[k][1])
            k += 1
        out.append(reach <= a)
    return out


def _neighbours(text: str, spans: list[tuple[int, int, str]], hashes: np.ndarray) -> list[tuple]:
    """(entity, term, surroundings) for the words near each base span; digits and single letters tell nothing."""
    folded, out = _folded(text), []
    found = [(m.start(), m.end()) for m in _word.finditer(folded)]
    starts, outside = [a for a, _ in found], _outside(found, spans)
    numbers = hashes.view(np.int64)
    for s, e, kind in spans:
        low, high = bisect_left(starts, s), bisect_left(starts, e)
        near = [k for k in (*range(max(0, low - REACH), low), *range(high, min(len(found), high + REACH))) if outside[k]]
        entity, around = _hash(f"{kind}:{folded[s:e]}".encode()), _hash(numbers[near].tobytes())
        out += [(entity, int(numbers[k]), around) for k in near if found[k][1] - found[k][0] > 1 and not text[found[k][0] : found[k][1]].isdigit()]
    return out


_FOUND = "key string, n_words long, base array<struct<start:long,stop:long,kind:string>>, near array<struct<entity:long,term:long,around:long>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())]))
_NEAR = pa.list_(pa.struct([(x, pa.int64()) for x in ("entity", "term", "around")]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans of each text; only texts that have some give rows for the estimates."""
    for rows, data, at in steps(batches):
        raw, keys, base, near = data.tobytes(), [], [], []
        hashes, word_at = words(data, at, ALPHANUMERIC)
        for d, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            text = raw[a:b].decode("utf-8", "replace")
            spans = base_spans(text)
            keys.append(hashlib.md5(raw[a:b]).hexdigest())
            base.append([{"start": s, "stop": e, "kind": k} for s, e, k in spans])
            own = _neighbours(text, spans, hashes[word_at[d] : word_at[d + 1]]) if spans else ()
            near.append([dict(zip(("entity", "term", "around"), x, strict=True)) for x in own])
        yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(keys), pa.array(np.diff(word_at)), pa.array(base, _SPAN), pa.array(near, _NEAR)], names=[*rows.schema.names[:-1], "key", "n_words", "base", "near"])


def _occurrences(bits: bytes):
    """(key, term, surroundings, start, stop) of the words in all texts that a table of bits may hold and that overlap no
    base span."""
    filled = np.frombuffer(bits, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, at in steps(batches):
            raw, out = data.tobytes(), []
            hashes, word_at = words(data, at, ALPHANUMERIC)
            maybe = np.flatnonzero(in_table(filled, hashes))
            owner = np.searchsorted(word_at, maybe, "right") - 1
            numbers = hashes.view(np.int64)
            for d in np.unique(owner).tolist():
                text = raw[at[d] : at[d + 1]].decode("utf-8", "replace")
                found = [(m.start(), m.end()) for m in _word.finditer(_folded(text))]
                outside, key, own = _outside(found, base_spans(text)), hashlib.md5(raw[at[d] : at[d + 1]]).hexdigest(), numbers[word_at[d] : word_at[d + 1]]
                for k in (maybe[owner == d] - word_at[d]).tolist():
                    if outside[k]:
                        out.append((key, int(own[k]), _hash(own[max(0, k - REACH) : k + REACH + 1].tobytes()), *found[k]))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), *[pa.int64()] * 4), strict=True)], names=["key", "term", "around", "start", "stop"])

    return run


def disclosing(found: DataFrame, docs: DataFrame) -> DataFrame | None:
    """(key, terms): by text, the spans of every place of a term that gives some entity away; None if there is none.

    Counts are over different surroundings, so copies of a passage count once. p = P(entity | term) comes from how often
    the term stands in surroundings with and without the entity in the whole corpus, the gain in bits is
    log2(p / P(entity)), with P(entity) the share of the corpus's words that stand near the entity. A term stands alone at
    least as often as beside any entity.
    """
    near = found.where(F.size("near") > 0).select(F.explode("near").alias("x")).select("x.*").distinct()
    pair = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= SUPPORT)
    # surroundings of any entity bound a term's count from below, which already rules out all common words
    beside = near.groupBy("term").agg(F.count_distinct("around").alias("beside"))
    few = 1 + found.count() // FILE_ROWS
    pair = stored(pair.join(beside, "term").where(F.col("together") >= DISCLOSURE * F.col("beside")), "pairs", few)
    if pair.isEmpty():
        discard(pair)
        return None
    terms = pair.select("term").distinct()
    places = docs.select("text").mapInArrow(_occurrences(bit_table(terms, "term")), "key string, term long, around long, start long, stop long")
    places = stored(places.join(terms, "term", "left_semi").distinct(), "places", few)
    seen = places.select("term", "around").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("alone"))
    entity = near.select("entity", "around").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("here"))
    words_in_all = found.agg(F.sum("n_words")).first()[0]
    p = F.least(F.lit(1.0), F.col("together") / F.greatest("alone", "beside"))
    by_chance = F.least(F.lit(1.0), F.col("here") * F.lit(2.0 * REACH + 1) / F.lit(float(words_in_all)))
    told = pair.join(seen, "term").join(entity, "entity").where((p >= DISCLOSURE) & (F.log2(p / by_chance) >= BITS))
    told = places.join(told.select("term").distinct(), "term", "left_semi")
    told = told.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "stop", F.lit("term").alias("kind")))).alias("terms"))
    out = stored(told, "terms", few)
    discard(pair, places)
    return out


def _terms(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Base spans (doc_id, key, base) of each row, and the spans of disclosing terms (key, terms) by text."""
    small_batches(docs.sparkSession)
    found = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, "doc_id long, " + _FOUND), "spans")
    return found, disclosing(found, docs)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, terms) for each row of docs: base spans, and spans of disclosing terms wherever they stand.

    Null and empty texts have no spans. Spans are in code points. Repeated rows each get their spans; an empty table gives
    no rows; other columns are not read. A term inside a base span is not marked again. key is the MD5 of the text.
    """
    found, terms = _terms(docs)
    none = F.array().cast("array<struct<start:bigint,stop:bigint,kind:string>>")
    if terms is None:
        return found.select("doc_id", "key", "base", none.alias("terms"))
    return found.join(terms, "key", "left").select("doc_id", "key", "base", F.coalesce("terms", none).alias("terms"))


def spelled(spans: str):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, the digest of the base spans, all spans as text and their number.

    One row for each row of docs, repeated ones included. Null and empty texts have no spans: counts are 0, spans is empty
    and base_sha256 that of nothing. Where spans start together, base kinds come first, in the order of KINDS.
    """
    place = F.array(*[F.lit(x) for x in (*KINDS, "term")])

    def order(x):
        return F.struct(x["start"].alias("start"), F.array_position(place, x["kind"]).alias("o"), x["stop"].alias("stop"), x["kind"].alias("kind"))

    found = find(docs).withColumn("every", F.array_sort(F.transform(F.concat("base", "terms"), order)))

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(spelled("base").cast("binary"), 256).alias("base_sha256"), spelled("every").alias("spans"),
        F.size("terms").cast("long").alias("n_term"), F.size("every").cast("long").alias("n_spans"),
    )


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each run of overlapping spans becomes the names of its kinds; a disclosing term becomes [TERM]."""
    out, at = [], 0
    runs: list[list] = []
    for s, e, k in sorted(spans):
        if runs and s < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
            runs[-1][2] |= {k}
        else:
            runs.append([s, e, {k}])
    for s, e, kinds in runs:
        out += [text[at:s], "[" + "|".join(sorted(k.upper() for k in kinds)) + "]"]
        at = e
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with base spans replaced by their kinds and disclosing terms generalised in text, and n_chars of the new text.

    Null texts stay null and empty ones empty; every other column, whatever its name, and the number of rows stay.
    """
    names, fields = docs.columns, {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    key, terms = unused(names, "key", "terms")
    found, told = _terms(docs)
    discard(found)
    rows, some = docs, told is not None
    if some:
        rows = docs.withColumn(key, F.md5(F.coalesce("text", F.lit("")).cast("binary"))).join(told.select(F.col("key").alias(key), F.col("terms").alias(terms)), key, "left")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, _, _ in steps(batches):
            texts = step.column(step.schema.get_field_index("text")).to_pylist()
            more = step.column(step.schema.get_field_index(terms)).to_pylist() if some else [None] * len(texts)
            new = [x if x is None else redacted(x, base_spans(x) + [(t["start"], t["stop"], "term") for t in own or ()]) for x, own in zip(texts, more, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if x == "text" else step.column(step.schema.get_field_index(x)) for x in names], names=names)

    out = rows.select(*names, *[terms] * some).mapInArrow(clean, ", ".join(f"`{c}` {fields[c]}" for c in names))
    return out.withColumn("n_chars", F.length("text").cast(fields["n_chars"])) if "n_chars" in names else out
