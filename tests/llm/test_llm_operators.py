"""Each operator against a plain version of its contract, over texts chosen to be awkward."""

import collections
import hashlib
import json
import random
import re
import time
import uuid
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tessera.llm import bpe, clusters, decontam, langid, licenses, lm, minhash, pii, quotes, sharding, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, v string, digest string, token string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    out = [None, "", " \n\t ", "one", "two words", "a b c d", "A B C D E", "a b c d e", "é É ß 日本語 🙂", "!!!!", "x" * 30000, "to " * 4000]
    base = [rng.choice(vocabulary) for _ in range(200)]
    for k in range(40):  # near copies, some over and some under the threshold
        own = list(base)
        for _ in range(k // 4):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        out.append(" ".join(own))
    out += [" ".join(base)] * 5 + ["  ".join(base).upper()]
    out += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    out += ["Mail a.b@c.de or +1 (555) 010-9999, card 4111 1111 1111 1111, host 10.0.0.256 and 10.0.0.25.7", "x@y.z_w@q.org"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ("en", "de", None)[k % 3], "s", None, "clash", "clash", "clash") for k, t in enumerate(texts())]
    rows += [rows[20], rows[20], (None, "null id " + texts()[20], "en", None, 1, None, None, None), (7, "another text with the same id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return tuple((x is not None, str(x)) for x in r)


def shingle_set(text):
    w = (text or "").translate(LOW).encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("block", [256, 7])
def test_minhash(docs, empty, block):
    rows = docs.select("doc_id", "text").collect()
    sets = [shingle_set(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(k)] = min(least.get(find(k), 1 << 60), r.doc_id)
    want = sorted(((r.doc_id, len(s), least.get(find(k)) if s else r.doc_id, r.doc_id is not None and (not s or r.doc_id == least[find(k)])) for k, (r, s) in enumerate(zip(rows, sets))), key=key)
    got = sorted((tuple(r)[:4] for r in minhash.near_duplicates(docs, block=block).collect()), key=key)
    assert got == want
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in want if r[3]}


@pytest.mark.parametrize("longest", [4096, 8])
def test_minhash_long_lists(spark, longest):
    """Near copies made of passages that very many unlike texts share are found wherever they stand in the lists."""
    rng = random.Random(5)
    passages = [" ".join(f"p{k}w{rng.randrange(10**6)}" for _ in range(40)) for k in range(6)]
    rows = []
    for k in range(150):
        a, b = rng.sample(passages, 2)
        own = [f"d{k}w{j}" for j in range(60)]
        rows.append((2 * k, f"{a} {' '.join(own)} {b}"))
        if k % 5 == 0:
            own[rng.randrange(60)] = "changed"
            rows.append((2 * k + 1, f"{a} {' '.join(own)} {b}"))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), longest=longest).collect()}
    assert got == {k: k - k % 2 for k, _ in rows}


def test_minhash_hot_template(spark, monkeypatch):
    """A text that is a template of very many sets and a third more of its own is in the template's group."""
    monkeypatch.setattr(minhash, "HOT", 16)
    rng = random.Random(6)
    template = [f"t{k}" for k in range(300)]
    rows = []
    for k in range(120):
        own = list(template)
        own[rng.randrange(300)] = f"v{k}"
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, " ".join(template + [f"d{k}w{j}" for j in range(97)])) for k in range(80)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame([(500, " ".join(template)), *rows], "doc_id long, text string")).collect()}
    assert set(got.values()) == {0}


@pytest.mark.parametrize("here", [250_000, 0])
def test_components(spark, monkeypatch, here):
    monkeypatch.setattr(clusters, "HERE", here)
    monkeypatch.setattr(clusters, "HUB", 20)
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000 + k, 2500) for k in range(90)] + [(2500, 1050)]
    got = {r.v: r.c for r in clusters.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(root)}
    assert clusters.components(spark.createDataFrame([], "a long, b long")).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize(("chunk", "run", "sent"), [(128, 64, 1 << 20), (2, 3, 0)])
def test_decontamination(spark, docs, empty, monkeypatch, chunk, run, sent):
    monkeypatch.setattr(decontam, "RUN", run)
    monkeypatch.setattr(decontam, "SENT_BYTES", sent)
    t = texts()
    long = WORD.findall(t[30])
    mixed = long[70:78][::-1] + long[78:83]
    items = [(1, " ".join(long[20:60])), (2, "a b c d"), (10, " ".join(long[40:53])), (4, None), (5, ""), (6, "zz yy xx"), (7, " ".join(long[20:60]).upper()), (8, " ".join(mixed)), (9, "d c b"), (None, "a b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOW)) if item is not None else []
        for win in [w[i : i + 13] for i in range(len(w) - 12)] if len(w) >= 13 else [w] if w else []:
            found.setdefault(tuple(win), set()).add(str(item))
    rows = docs.collect()
    all_words = [WORD.findall((r.text or "").translate(LOW)) for r in rows]
    want = []
    for r, w in zip(rows, all_words):
        hit, own, near = set(), set(), set()
        for n in {len(x) for x in found}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in found:
                    hit |= set(range(i, i + n))
                    own |= found[tuple(w[i : i + n])]
        for win, names in found.items():
            if set(win) <= set(w) and any(set(win) <= set(w[max(0, p - decontam.REACH) : p + decontam.REACH + 1]) for p in range(len(w))):
                near |= names
        want.append((r.doc_id, len(w), len(hit), sorted(own), near))
    got = [tuple(r) for r in decontam.matches(docs, bench, chunk=chunk).collect()]
    assert sorted((g[:4] for g in got), key=key) == sorted((x[:4] for x in want), key=key)
    spread = {x[0]: x[4] for x in want}
    for i, _, _, own, near in got:  # every exact match is near, and a near one has all terms around some place
        assert set(own) <= set(near)
        if i is not None and i > 10:
            assert set(near) <= spread[i]
    by_id = {g[0]: g for g in got}
    assert "8" in by_id[30][4] and "8" not in by_id[30][3]
    assert decontam.matches(empty, bench).count() == 0
    none = decontam.contaminated(docs, bench.limit(0)).collect()
    assert len(none) == docs.count() and not any(r.contaminated for r in none)
    bad = {r.text for r, (_, n, h, _, _) in zip(rows, want) if h and 20 * h >= n}
    own = docs.withColumn("_key", licenses.F.lit(1)).withColumn("key", licenses.F.lit(2)).withColumn("bad", licenses.F.lit(3))
    left = decontam.clean(own, bench)
    assert left.columns == own.columns
    assert sorted(map(key, left.select(docs.columns).collect())) == sorted(key(r) for r in rows if r.text not in bad)


def test_proximity():
    terms, ends, postings = np.array([3, 5, 9], np.uint64), np.array([2, 4, 5]), np.array([0, 50, 3, 90, 52], np.int32)
    search = lambda *t: decontam.search(terms, ends, postings, np.array([0, 40, 100]), decontam.Windows(["x"], [np.array(t, "<u8").tobytes()]), 3)
    assert [x.tolist() for x in search(3, 9)] == [[], [], [0], [52]]
    assert [x.tolist() for x in search(5, 3)] == [[], [], [0], [3]] and [x.tolist() for x in search(3, 5, 9)] == [[]] * 4
    assert [x.tolist() for x in search(3, 7)] == [[]] * 4 and [x.tolist() for x in search(9,)] == [[0], [52], [0], [52]]


PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(text):
    out = []
    for k, (name, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[name]
            if good:
                out.append((m.start(), k, m.end(), name))
    return [(s, e, n) for s, _, e, n in sorted(out)]


def test_pii_spans():
    rng = random.Random(3)
    for _ in range(20000):
        text = "".join(rng.choice("a1.@-+ 4_%()2é,00") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == plain_spans(text)
    pii.base_spans("a@" + "b" * 200000 + " x@y " + "1" * 100000 + "1." * 50000 + "+1(" * 50000)  # in linear time


def disclosed(rows):
    """Spans of disclosing terms by document: the estimates in plain loops."""
    near, alone, total, places = collections.defaultdict(set), collections.defaultdict(set), 0, collections.defaultdict(list)
    for k, text in rows:
        base, w = plain_spans(text), [(m.start(), m.end()) for m in WORD.finditer((text or "").translate(LOW))]
        total += len(w)
        low = [text[a:b].translate(LOW) for a, b in w]
        free = [not any(a < e and b > s for s, e, _ in base) for a, b in w]
        for i, (a, b) in enumerate(w):
            if free[i]:
                alone[low[i]].add(tuple(low[max(0, i - 8) : i + 9]))
                places[low[i]].append((k, a, b))
        for s, e, kind in base:
            before, after = [i for i, x in enumerate(w) if x[0] < s][-8:], [i for i, x in enumerate(w) if x[0] >= e][:8]
            around = [i for i in before + after if free[i]]
            for i in around:
                if len(low[i]) > 1 and not low[i].isdigit():
                    near[kind + text[s:e].translate(LOW), low[i]].add(tuple(low[j] for j in around))
    out, here, beside = {k: [] for k, _ in rows}, collections.defaultdict(set), collections.defaultdict(set)
    for (entity, term), x in near.items():
        here[entity] |= x
        beside[term] |= x
    told = set()
    for (entity, term), x in near.items():
        p = min(1.0, len(x) / max(len(alone[term]), len(beside[term])))
        if len(x) >= pii.SUPPORT and p >= pii.DISCLOSURE and np.log2(p / min(1.0, len(here[entity]) * 17 / total)) >= pii.BITS:
            told.add(term)
    for term in told:
        for k, a, b in places[term]:
            out[k].append((a, b, "term"))
    return out


def test_pii_many_spans():
    """A text with very many addresses takes time in proportion."""
    text = " ".join(f"host 10.{k % 256}.{k // 256}.7 up" for k in range(20000))
    began = time.time()
    out = list(pii._scan(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})])))
    assert len(out[0].column(3)[0]) == 20000 and time.time() - began < 20


def test_pii(spark, docs, empty):
    want = sorted((r.doc_id, ",".join(f"{k}:{s}:{e}" for s, e, k in plain_spans(r.text))) for r in docs.where("doc_id IS NOT NULL").collect())
    assert sorted((r.doc_id, r.spans) for r in pii.digest(docs).collect() if r.doc_id is not None) == want
    assert pii.digest(empty).count() == 0 and pii.sanitise(empty).count() == 0
    # a nickname that stands by one address and nowhere else, against words that stand everywhere
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(rng.sample(words, 6)) + " Zorblax Jo@Example.org " + " ".join(rng.sample(words, 6)), 0) for k in range(6)]
    rows += [(100 + k, " ".join(rng.sample(words, 9)) + f" u{k}@example.org " + " ".join(rng.sample(words, 9)), 0) for k in range(200)]
    rows += [(1000, "ZORBLAX alone", 13), (1001, " ".join(words), 0)]
    told = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    found = {r.doc_id: r for r in pii.digest(told).collect()}
    assert all(found[k].n_term == 1 and "term:" in found[k].spans for k in range(6))
    assert all(found[k].n_term == (k == 1000) for k in found if k >= 100)
    plain = disclosed([(r[0], r[1]) for r in rows])
    assert {k: found[k].spans for k in found} == {k: ",".join(f"{n}:{s}:{e}" for s, e, n in sorted(plain_spans(t) + plain[k])) for k, t, _ in rows}
    clean = {r.doc_id: r for r in pii.sanitise(told.withColumn("key", licenses.F.lit(1)).withColumn("TERMS", licenses.F.lit(2)).withColumn("_key", licenses.F.lit(3))).collect()}
    assert clean[0].key == 1 and clean[0].TERMS == 2 and clean[0]._key == 3
    assert "zorblax" not in clean[0].text.lower() and "[EMAIL]" in clean[0].text and "[TERM]" in clean[0].text and clean[0].n_chars == len(clean[0].text)
    assert clean[1000].text == "[TERM] alone" and clean[1001].text == " ".join(words)


def test_bpe(docs, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.encode(docs, path, public_tokenizers.PATTERN, ["doc_id", "text"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids) and bpe.decode(ids, ranks) == (r.text or "").encode()
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode(empty, path, public_tokenizers.PATTERN, ["doc_id"]).count() == 0


def test_bpe_random_words():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    words = ["".join(rng.choice(s) for _ in range(rng.randint(1, 40))) for s in ("ab", "then ", "éàüß", "0123456789", "あいう漢字", "aA!? \n") for _ in range(400)]
    for w, own in zip(words, bpe.replay([w.encode() for w in words], bpe.MergeTable(ranks)), strict=True):
        assert np.frombuffer(own, "<u4").tolist() == library._encode_single_piece(w.encode())


def test_language(spark, docs, empty):
    rng = random.Random(4)
    kinds = {"x": ["the", "and", "ing", "ion"], "y": ["sch", "ung", "ein", "ach"], "z": ["ção", "mente", "ñar", "que"]}
    rows = [(k, " ".join("".join(rng.choice(kinds[s]) for _ in range(2)) for _ in range(rng.randint(3, 60))), s) for k in range(600) for s in [rng.choice("xyz")]]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {k: s for k, _, s in rows}
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 50 and sum(r.lang_pred == want[r.doc_id] for r in held) / len(held) > 0.98
    out = langid.identify(docs, ["doc_id", "text", "v"]).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in out)
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).withColumn("lang", docs.v.substr(99, 1).cast("string")).where("text IS NULL")).collect()} == {"und"}


def test_sharding(docs, empty):
    rows = sharding.shard(docs, 7).collect()
    assert len(rows) == docs.count()
    counts = collections.Counter(r.shard for r in rows)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    for r in rows:
        assert r.size >= 16
    by_id = {r.doc_id: r for r in rows}
    text = {r.doc_id: (r.text or "").encode() for r in docs.where("doc_id > 10").collect()}
    assert all(by_id[k].text_crc32 == zlib.crc32(t) and by_id[k].size == len(t) + 16 for k, t in text.items())
    again = sharding.shard(docs.repartition(2), 7).collect()
    assert sorted(map(key, again)) == sorted(map(key, rows))
    assert sharding.shard(empty, 7).count() == 0


def test_hypergeometric():
    rng = random.Random(1)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(20000)]
    assert abs(np.mean(draws) - 6) < 0.05 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.12
    m = sharding.communication_matrix([5, 0, 12, 83], [34, 33, 33], 3)
    assert [sum(r) for r in m] == [5, 0, 12, 83] and [sum(c) for c in zip(*m)] == [34, 33, 33]


def test_uniform_shuffle(spark):
    """Over seeds, a row's shard and slot are close to uniform."""
    d = spark.range(40).selectExpr("id AS doc_id", "'t' AS text")
    seen = np.zeros((40, 4))
    for seed in range(12):
        for r in sharding.shard(d, 4, seed).collect():
            seen[r.doc_id, r.shard] += 1
    assert seen.sum(axis=0).tolist() == [120.0] * 4 and seen.max() <= 10


def test_licenses(spark, empty):
    mit = licenses.MIT
    rows = [(1, mit), (2, "Copyright (c) 2020 Jo\n\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENCE")), (3, "Released under the MIT Licence\nmore"), (4, "nothing"), (5, None), (6, ""), (7, mit + " and more"), (8, "© 1999 X\n" + licenses.ISC), (1, mit)]
    got = [(r.doc_id, r.license_id, r.notice_ids) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", licenses.F.lit("clash"))).collect()]
    want = [(1, "MIT", []), (1, "MIT", []), (2, "MIT", []), (3, None, ["MIT"]), (4, None, []), (5, None, []), (6, None, []), (7, None, []), (8, "ISC", [])]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert licenses.scan(empty).count() == 0
    own = spark.createDataFrame([("own", "My licence."), ("blank", " "), ("other", "my License")], "license_id string, text string")
    assert licenses.scan(spark.createDataFrame([(1, "MY LICENSE!")], "doc_id long, text string"), own).first().license_id == "other"


def test_license_texts(spark, tmp_path):
    """Whole licences in other typography, and a folder of texts as the catalogue."""
    odd = lambda t: "/*\n * Copyright (C) 2001-2024 Some One <a@b.c>\n */\n" + "\n".join(" * " + x for x in t.replace("copyright holder", "copyright owner").replace("license", "licence").replace("unlicence", "unlicense").replace('"', "'").split("\n"))
    rows = [(k, odd(t)) for k, (_, t) in enumerate(licenses.KNOWN)] + [(100, licenses.BSD_3.replace("endorse", "praise"))] + [(200 + k, "Released under the MIT License.\nx") for k in range(40)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].license_id == i for k, (i, _) in enumerate(licenses.KNOWN)) and got[100].license_id is None
    assert all(got[200 + k].notice_ids == ["MIT"] for k in range(40))
    (tmp_path / "GPL-9.9.txt").write_text("The long\nlicence.")
    (tmp_path / "Other").write_text("Another one.")
    own = licenses.read_catalogue(spark, str(tmp_path))
    got = licenses.scan(spark.createDataFrame([(1, "THE LONG LICENSE"), (2, "another  one"), (3, "else")], "doc_id long, text string"), own).collect()
    assert sorted((r.doc_id, r.license_id) for r in got if r.license_id) == [(1, "GPL-9.9"), (2, "Other")]


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    many = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0.0, 0.02, 0.05, 0.1, 0.15)] + [np.repeat(base[:1], 300, axis=0) + rng.normal(size=(300, 16)) * 0.02])
    rows = [(k, [float(x) for x in np.float32(v)], int(k % 2)) for k, v in enumerate(many)]
    rows += [(9000, None, 0), (9001, [0.0] * 16, 0), (9002, [float("nan")] * 16, 0), (9003, [None, 1.0], 0), (9004, rows[0][1], None), (9005, rows[0][1], 0), (9005, rows[0][1], 0), (9006, [1.0, 0.0], 0), (9007, [], 1), (9008, [float(x) * 1e30 for x in rows[0][1]], 0)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumnRenamed("x", "v")
    good = [(k, np.array(r[1], np.float64)) for k, r in enumerate(rows) if r[2] is not None and r[1] and None not in r[1] and np.isfinite(np.float32(r[1])).all() and any(r[1])]
    n, root = collections.Counter(), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in good:
        for b, y in good:
            if a < b and rows[a][2] == rows[b][2] and len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                n[a] += 1
                n[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    want = sorted((r[0], n[k], rows[find(k)][0], r[0] == rows[find(k)][0]) for k, r in enumerate(rows))
    for block, longest in ((256, 4096), (20, 16)):
        got = sorted(tuple(r) for r in vectors.links(e, block=block, longest=longest).collect())
        assert sum(r[1] for r in got) >= 0.99 * sum(n.values())  # the index may miss links; here it should not
        assert got == want
    assert vectors.links(e.limit(0)).count() == 0


def test_vectors_of_many(spark):
    """Pairs near the least cosine are found among many vectors as among few, with a common mean too."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = unit(rng.normal(size=(1, 64))) * 0.75
    x = unit(unit(rng.normal(size=(20_000, 64))) + mean)
    side = rng.normal(size=(4000, 64))
    side = unit(side - (side * x[:4000]).sum(axis=1, keepdims=True) * x[:4000])
    y = 0.9805 * x[:4000] + np.sqrt(1 - 0.9805**2) * side
    table = pa.table({"vec_id": np.concatenate((np.arange(20_000), 100_000 + np.arange(4000))), "label": np.zeros(24_000, np.int32), "embedding": np.concatenate((x, y)).tolist()})
    got = {r.vec_id: r.component_id for r in vectors.links(spark.createDataFrame(table)).collect()}
    assert sum(got[100_000 + k] != k for k in range(4000)) == 0


def test_vectors_of_two(spark):
    x = np.random.default_rng(1).normal(size=32)
    e = spark.createDataFrame([(1, x.tolist(), 0), (2, (x + 0.001).tolist(), 0)], "vec_id long, embedding array<double>, label int")
    assert [r.component_id for r in vectors.links(e).collect()] == [1, 1]


def test_vector_tables():
    assert vectors.layout(0) == (5, 12) and all(3 * vectors.layout(k)[0] > k and vectors.layout(k)[0] * vectors.layout(k)[1] <= 64 for k in range(65))


def test_backoff(spark, docs, empty, monkeypatch):
    split = re.compile(r"[^\x20\x09-\x0D]+")
    rows = docs.select("doc_id", "text").collect()
    w = [split.findall((r.text or "").translate(LOW)) for r in rows]
    count = collections.Counter(tuple(d[i : i + n]) for d in w for n in (1, 2, 3, 4) for i in range(len(d) - n + 1))
    tokens = sum(map(len, w))

    def one(context, x, least):
        if not context:
            return count[x,] / tokens
        if count[*context, x] >= least:
            return count[*context, x] / count[context]
        return 0.4 * one(context[1:], x, least)

    for part, block, order, least in ((2 << 20, 8 << 20, 3, 2), (20_000, 10_000, 3, 2), (20_000, 10_000, 2, 1), (9_000, 70_000, 4, 3)):  # one part and block, and many
        monkeypatch.setattr(lm, "PART_BYTES", part)
        monkeypatch.setattr(lm, "BLOCK_BYTES", block)
        total = [sum(np.log10(one(tuple(d[max(0, i - order + 1) : i]), d[i], least)) for i in range(len(d))) for d in w]
        want = sorted(((r.doc_id, len(d), t) for r, d, t in zip(rows, w, total)), key=key)
        got = sorted(((r.doc_id, r.n_words, r.log_score) for r in lm.score(docs, order, least=least).collect()), key=key)
        assert [g[:2] for g in got] == [x[:2] for x in want]
        assert np.allclose(sorted(g[2] for g in got), sorted(x[2] for x in want), atol=1e-5)
    assert lm.score(empty).count() == 0


def test_backoff_of_changing_texts(spark):
    """Texts that differ at the second reading are an error and no wrong score."""
    def other(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f"a {uuid.uuid4()}" for _ in range(b.num_rows)])], names=["doc_id", "text"])

    changing = spark.range(100).mapInArrow(other, "doc_id long, text string")
    with pytest.raises(Exception, match="not the same"):
        lm.score(changing).collect()


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Shall we meet?\nOn Monday."), (1, 1, "v", "> Shall  we MEET?\nYes."), (1, 2, "w", "> On Monday.\nNo, Tuesday."), (1, 3, "u", ">> Shall we meet?\n> Yes.\nGood."), (1, 4, "v", "> never said\nHm."),
        (2, 0, "u", None), (2, 1, "v", ""), (2, 1, "v", ""), (3, 5, None, "> > a\nb"), (None, 1, "u", "x"), (4, None, "u", "x"),
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("hash", licenses.F.lit(1)).withColumn("level", licenses.F.lit(1))
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(d).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 0), (2, 1), (3, 5)}
    assert [got[1, k].reply_to for k in range(5)] == [None, 0, 0, 1, 3]
    assert [got[1, k].n_linked for k in range(5)] == [0, 1, 1, 2, 0] and got[1, 3].max_level == 2 and got[3, 5].max_level == 2
    assert got[1, 3].clean_text == "Good." and got[1, 2].clean_text == "No, Tuesday." and got[2, 1].clean_text == ""
    for c in (1, 2, 3):
        own = [r for k, r in got.items() if k[0] == c]
        assert sorted(r.position for r in own) == list(range(1, len(own) + 1))
        at = {r.turn: r.position for r in own}
        assert all(r.reply_to is None or r.root == r.turn or at[r.reply_to] < r.position for r in own)
    assert quotes.conversations(d.limit(0)).count() == 0


def test_quotes_of_repeated_lines(spark):
    """A line said in several turns counts for each of them, against plain counting."""
    rng = random.Random(3)
    rows = [(1, 0, "A\nB"), (1, 1, "A"), (1, 2, "> A\n> B\nown")]
    for c in range(2, 12):
        for t in range(14):
            quoted = [">" * rng.randint(1, 2) + " " + rng.choice("hhhabcdz") for _ in range(rng.randint(0, 3))]
            rows.append((c, t, "\n".join(quoted + [rng.choice("hhhabcde") for _ in range(rng.randint(1, 3))])))
    said, asked = {}, {}
    for c, t, text in rows:
        for x in text.split("\n"):
            if x[0] == ">":
                own = asked.setdefault((c, t), {})
                own[x[-1]] = min(own.get(x[-1], 9), x.count(">"))
            elif x != "own":
                said.setdefault((c, t), set()).add(x)
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 2].reply_to == 0
    for c, t, _ in rows:
        own, votes = asked.get((c, t), {}), []
        for s in range(t):
            if both := set(own) & said.get((c, s), set()):
                votes.append((-min(own[x] for x in both), len(both), s))
        assert got[c, t].reply_to == (max(votes)[2] if votes else t - 1 if t else None)
        assert got[c, t].n_linked == sum(any(x in said.get((c, s), set()) for s in range(t)) for x in own)


def groups(rows):
    """For (doc_id, text): the group of near-duplicates of each row, by comparing all pairs."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(rows))]


CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, row int, terms int, key int, _key int, gone int, bad int, was int"


def awkward():
    rows = [(k, t, ("en", "de", None)[k % 3], "s", len(t or ""), 0.5, "clash", 1, 2, 3, 4, 5, 6, 7) for k, t in enumerate(texts())]
    return [*rows, rows[30], rows[30], (7, "another text with the same id " + texts()[60], "en", *rows[0][3:]), (None, None, None, *rows[0][3:])]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(awkward(), CLASH).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, texts()[60])], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def stage(k):
    import corpus_pipeline

    return corpus_pipeline.STAGES[k][1]


def test_stage_language(spark, folder):
    """Against letters, prototypes and cosines worked out text by text."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stage(0)(spark, docs, folder)
    assert out.columns == docs.columns and stage(0)(spark, docs.limit(0), folder).count() == 0
    plain = plain_languages([(r.doc_id, r.text, r.lang) for r in docs.collect()])
    want = [(*r[:2], p[0], *r[3:]) for r, p in zip(docs.collect(), plain, strict=True) if p[0] != "und" and p[1] >= 0.02]
    assert sorted(map(key, out.collect())) == sorted(map(key, want))


def plain_languages(rows):
    """(lang_pred, score, lead over the next) by row: vectors of letters, permuted, bound and bundled one n-gram after the other."""
    def vector(text):
        out, codes = np.zeros(langid.DIMENSIONS), [0]
        for c in text or "":
            codes.append(ord(c.lower()[0]) if c.isalpha() else 0)
        codes.append(0)
        codes = [c for k, c in enumerate(codes) if c or not k or codes[k - 1]]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            if b:
                out += langid._letter(c).astype(float) * np.roll(langid._letter(b), 1) * np.roll(langid._letter(a), 2)
        return out / np.linalg.norm(out) if out.any() else out

    every = [vector(t) for _, t, _ in rows]
    total = {}
    for (i, t, lang), v in zip(rows, every):
        if lang is not None and i is not None and zlib.crc32(str(i).encode()) % 4 != 2 and any(c.isalpha() for c in t or ""):
            total[lang] = total.get(lang, 0) + v
    names = sorted(total)
    out = []
    for (_, t, _), v in zip(rows, every):
        cosine = [round(float(v @ (total[n] / np.linalg.norm(total[n]))), 5) for n in names]
        best = int(np.argmax(cosine))
        margin = cosine[best] - max([c for k, c in enumerate(cosine) if k != best], default=-1)
        out.append((names[best], max(0.0, cosine[best]), margin) if any(c.isalpha() for c in t or "") else ("und", 0.0, 1))
    return out


def test_language_vectors(spark, docs):
    """Predictions and scores against the plain version, in one step and in many."""
    rows = docs.select("doc_id", "text", "lang").collect()
    want = plain_languages(rows)
    got = langid.identify(docs, ["doc_id", "text", "lang"]).collect()
    by_row = lambda x: key(x[:2])
    both = zip(sorted(((r.doc_id, r.text, r.lang_pred, r.score) for r in got), key=by_row), sorted(((r.doc_id, r.text, *p) for r, p in zip(rows, want)), key=by_row), strict=True)
    for (i, t, lang, s), (j, u, plain, score, lead) in both:
        assert (i, t) == (j, u) and abs(s - score) < 1e-4 and (lang == plain or lead < 1e-4)


def test_stage_near_duplicates(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.collect()
    out = stage(1)(spark, docs, folder)
    assert out.columns == docs.columns
    group = groups([(r.doc_id, r.text) for r in rows])
    left, want = {}, []
    for r, g in zip(rows, group):
        if shingle_set(r.text):
            left[g] = min(left.get(g, (1 << 60, "")), (r.doc_id, r.text))
        elif (r.doc_id, r.text or "") not in want:
            want.append((r.doc_id, r.text or ""))
    assert sorted(key((r.doc_id, r.text or "")) for r in out.collect()) == sorted(map(key, [*want, *left.values()]))


def test_stage_personal_data(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.collect()
    out = stage(3)(spark, docs, folder)
    assert out.columns == docs.columns
    terms = disclosed([(k, r.text) for k, r in enumerate(rows)])
    want = []
    for k, r in enumerate(rows):
        text = r.text if r.text is None else pii.redacted(r.text, plain_spans(r.text) + terms[k])
        want.append((*r[:1], text, *r[2:4], None if text is None else len(text), *r[5:]))
    assert sorted(map(key, out.collect())) == sorted(map(key, want))
    assert pii.redacted("ab x@y.z cd", [(3, 8, "email"), (4, 6, "term")]) == "ab [EMAIL|TERM] cd"


def test_pipeline(spark, folder):
    """Every stage works on what the one before kept: the result against stages in plain Python."""
    import corpus_pipeline

    rows = [r[:5] for r in awkward()]
    plain = plain_languages([r[:3] for r in rows])
    rows = [r for r, p in zip(rows, plain, strict=True) if p[0] != "und" and p[1] >= 0.02]
    left = {}
    for r, g in zip(rows, groups([r[:2] for r in rows])):
        left[g] = min(left.get(g, r[:2]), r[:2])
    windows = WORD.findall(texts()[60].translate(LOW))
    windows = {tuple(windows[i : i + 13]) for i in range(max(1, len(windows) - 12))}
    kept = []
    for i, t in left.values():
        w, hit = WORD.findall(t.translate(LOW)), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(w)):
            kept.append((i, t))
    terms = disclosed(list(enumerate(t for _, t in kept)))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = [(i, library.encode_ordinary(pii.redacted(t, plain_spans(t) + terms[k]))) for k, (i, t) in enumerate(kept)]
    out = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.ids) for r in out) == sorted(want)
    assert len(out) < len(awkward()) and 60 not in {r.doc_id for r in out}
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID"


def test_registered():
    from tessera.llm import queries

    assert {int(m[1]) for q in queries.QUERIES if (m := re.match(r"op(\d+)_", q))} == set(range(1, 14)) and "pipeline" in queries.QUERIES
    for name in ("licenses.py", "sharding.py", "fim.py"):  # native main paths, and one that is so by choice
        source = (Path(queries.__file__).parent / name).read_text()
        assert not re.search(r"pandas|pyarrow|mapIn|applyIn|\.rdd|udf", source), name
    assert json.dumps(sorted(queries.ORACLE))


def test_one_word_texts(spark):
    """A long text of one word against items of that word: every place of every window is a match, of which few are held at a time."""
    import tracemalloc

    n = 700_000  # 2 MiB of text, all of one segment
    word = np.array([77], "<u8")
    windows = decontam.Windows(["x", "y", "y"], [np.repeat(word, 76).tobytes()] * 2 + [np.repeat(word, 5).tobytes()])
    assert len(windows.table) == 2  # equal windows are searched once
    tracemalloc.start()
    begun, seen = time.time(), 0
    for row, _, near, _ in decontam.searched(word, np.array([n]), np.arange(n, dtype=np.int32), np.array([0, n + 1]), windows, decontam.REACH):
        seen += len(row)
        assert len(near) <= decontam.PLACES
    assert seen == n - 12 + n - 4 and time.time() - begun < 10
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    docs = spark.createDataFrame([(1, "to " * n), (2, "to be " * 100_000), (3, "to go")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "to " * 76), (2, "be to " * 38), (3, "to to " * 40)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.matches(docs, bench).collect()}
    assert got == {1: (n, n, ["1", "3"]), 2: (200_000, 200_000, ["2"]), 3: (2, 0, [])}


def test_decontamination_by_slices(spark, docs, monkeypatch):
    """However few places are taken at a time, the result is the same."""
    t = texts()
    bench = spark.createDataFrame([(1, t[30]), (2, "to " * 20), (3, "a b c d"), (4, "to " * 9)], "item_id long, text string")
    want = sorted(map(str, decontam.matches(docs, bench).collect()))
    monkeypatch.setattr(decontam, "PLACES", 64)
    assert sorted(map(str, decontam.matches(docs, bench).collect())) == want


@pytest.mark.parametrize("size", [1e-200, 1e-310, 1e200])
def test_vectors_of_any_size(spark, size):
    """Components whose squares vanish or overflow link as the same vectors at usual size do."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(100, 16))
    near = np.concatenate([base, base[:50] + rng.normal(size=(50, 16)) * 0.05, base[:5]])
    frame = lambda x: spark.createDataFrame([(k, v, 0) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    want = sorted(map(tuple, vectors.links(frame(near)).collect()))
    assert sum(r[1] for r in want) > 50
    assert sorted(map(tuple, vectors.links(frame(near * size)).collect())) == want
    mixed = sorted(map(tuple, vectors.links(frame(np.concatenate([near[:100] * size, near[100:]]))).collect()))
    assert mixed == want
