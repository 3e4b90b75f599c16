"""Clustering, quality and fill-in-the-middle against plain versions of their contracts, over awkward rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import fim, quality, yinyang

DOCS = "doc_id long, text string, lang string, n long, form string, score double, y int"
WHITE = "\t\n\x0b\x0c\r "


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def awkward():
    rng = random.Random(3)
    out = [None, "", " ", " \n\t ", "one", "two words", " lead", "trail  ", "a b c", "é 日本語 🙂🙂 x", "x" * 50000, "to " * 9000, "has <P> in it", "<S>", "ends <M", "<", "a\x00b\x1fc d"]
    out += ["".join(rng.choice("ab<>PSM \n🙂é") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return out


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text)
    h = [int(sha(f"42:{'' if doc_id is None else doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def test_fim(spark):
    rows = [(k, t, "en", 1, "clash", 0.5, 3) for k, t in enumerate(awkward())] + [(None, "null id and some words", None, None, None, None, None)] * 2
    rows += [(k, "the same words again and again", "x", None, None, None, None) for k in range(1000, 1060)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix, r.middle, r.suffix, r.output) for r in fim.transform(docs).collect()), key=str)
    assert got == sorted(((r[0], *plain_fim(r[0], r[1])) for r in rows), key=str)
    assert {g[2] for g in got} == {"plain", "spm", "psm"}
    want = {(k, n, f, None if p is None else len(p), None if m is None else len(m), sha(o), sha(t or "")) for k, t, *_ in rows for n, f, p, m, _, o in [plain_fim(k, t)]}
    assert set(map(tuple, fim.digest(docs).collect())) == want
    assert fim.transform(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.transform(docs, ["doc_id", "form"])


@pytest.mark.parametrize(
    "grammar, plain",
    [
        ("token", r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+"), ("word", r"[^ \t-\r]+|[ \t-\r]+"), ("line", r"[^\n]*\n|[^\n]+"), ("character", r"(?s:.)"),
        ("letters", "[0-9A-Za-z]+|[^0-9A-Za-z]+"), ("sentence", r"(?:[^.!?\n]|[.!?\n](?![ \t-\r]))*(?:[.!?\n](?=[ \t-\r])|\Z)"),
    ],
)
def test_units(spark, grammar, plain):
    texts = [*awkward(), "Is it? Yes. No.\nWell ... 3.5 is\n\n so. "]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("text", fim.units(fim.F.col("text"), grammar).alias("u")).collect()
    for r in got:
        assert list(r.u) == [x for x in re.findall(plain, r.text or "") if x]
        assert "".join(r.u) == (r.text or "")


def plain_clusters(rows, centroids=40, rounds=5, dimension=64):
    kept = [(k, [math.floor(256 * c) if abs(c) < 1e300 else 256 * int(c) for c in v]) for k, v in rows if v is not None and len(v) == dimension and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (sha(f"2:{'' if r[0] is None else r[0]}"), np.array(r[1], "<i4").tobytes() if max(map(abs, r[1])) < 1 << 22 else b""))
    points = [v for _, v in order[:centroids]]
    square = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q))
    for k in range(rounds + 1):
        own = [min(range(len(points)), key=lambda c: (square(v, points[c]), c)) for _, v in kept]
        if k < rounds:
            points = [[sum(col) // own.count(c) for col in zip(*(v for (_, v), o in zip(kept, own) if o == c))] if c in own else p for c, p in enumerate(points)]
    d = [square(v, points[o]) for (_, v), o in zip(kept, own)]
    fits = lambda x: x if x < 1 << 63 else None
    return [(k, o, fits(x), fits(sum(e for e, q in zip(d, own) if q == o)), fits(sum(d)), sha(",".join(map(str, points[o])))) for (k, _), o, x in zip(kept, own, d)]


def vectors(rng, n, dimension=64):
    middle = rng.normal(0, 0.1, (12, dimension))
    rows = [(k, (middle[rng.integers(12)] + rng.normal(0, 0.03, dimension)).tolist()) for k in range(n)]
    return rows + [(n + k, rows[0][1]) for k in range(n // 3)] + [rows[1]] * 5


@pytest.mark.parametrize("large", [False, True])
def test_clusters(spark, large):
    rng = np.random.default_rng(1)
    rows = vectors(rng, 300 if not large else 50)
    rows += [(None, rows[2][1]), (9000, None), (9001, []), (9002, [0.1] * 63), (9003, [*[0.1] * 63, None]), (9004, [*[0.1] * 63, math.inf]), (9005, [*[0.1] * 63, math.nan]), (9006, [0.0] * 64), (9007, [-0.0] * 64)]
    if large:
        rows += [(9100, [1e200] * 64), (9101, [1e306, *[0.5] * 63]), (9102, [20000.0, *[-0.5] * 63]), (9103, [-3e4] * 64), (9104, [-1e200] * 64)]
    table = spark.createDataFrame([(k, v, 1, 2, "x") for k, v in rows], "vec_id long, embedding array<double>, cluster int, upper int, v string").repartition(4)
    looks = []
    got = sorted(map(tuple, yinyang.cluster(table, looks=looks).collect()), key=str)
    assert got == sorted(plain_clusters(rows), key=str)
    if not large:
        assert sum(looks[1:]) < 0.8 * 5 * len(got) * 40, "the filters leave out distances"
    assert yinyang.cluster(table.limit(0)).count() == 0


def test_few_vectors_and_ties(spark):
    """Fewer vectors than centroids, equal vectors that are centroids several times over, and distances that tie."""
    rng = np.random.default_rng(2)
    rows = [(k, (rng.integers(-2, 3, 64) / 256).tolist()) for k in range(30)] + [(100 + k, [0.0] * 64) for k in range(5)]
    got = yinyang.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, got.collect())) == sorted(plain_clusters(rows))
    rows = [(k, (np.eye(4)[k % 4] * (k % 3) / 256).tolist()) for k in range(400)]
    got = yinyang.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dimension=4, centroids=25, size=4)
    assert sorted(map(tuple, got.collect())) == sorted(plain_clusters(rows, 25, dimension=4))


def test_bounds_hold():
    """After each round the upper bound is no less than the own distance, and each lower bound no more than any other centroid's of the group."""
    rng = np.random.default_rng(4)
    x = rng.integers(-40, 40, (500, 8)).astype(np.float64)
    to = yinyang.Centroids.start(x[:30].astype(int).tolist(), 6)
    own, upper, lower = np.full(500, -1), np.zeros(500), np.zeros((500, int(to.group.max()) + 1))
    for _ in range(8):
        own, upper, lower, _ = yinyang.assign(x, True, own, upper, lower, to)
        d = np.sqrt(((x[:, None] - np.array(to.points)[None]) ** 2).sum(-1))
        assert (own == d.argmin(1)).all() and (upper >= d[np.arange(500), own]).all()
        d[np.arange(500), own] = np.inf
        for g in range(lower.shape[1]):
            assert (lower[:, g] <= d[:, to.group == g].min(axis=1)).all()
        to = to.after([np.floor(x[own == c].mean(0)).astype(int).tolist() if (own == c).any() else p for c, p in enumerate(to.points)])


def marked(rng, k):
    good = k % 3 > 0
    vocabulary = ["ba", "na", "do", "ri", "mel", "tas", "kon"]
    words = ["".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 60))]
    return " ".join(words if good else [w + rng.choice(["###", "&&&"]) for w in words]), int(good)


def test_quality(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(900):
        text, y = marked(rng, k)
        rows.append((k, text, "en", 1, "s", 0.0, 9))
        labels.append((k, y, 0, "text"))
    odd = [(5000, None), (5001, ""), (5002, " \n "), (5003, rows[4][1]), (5004, "é日本 🙂"), (5005, "!!!"), (5006, "word " * 150000), (None, rows[3][1])]
    docs = spark.createDataFrame([*rows, *((k, t, None, None, None, None, None) for k, t in odd), rows[7], rows[7]], DOCS).repartition(4)
    told = spark.createDataFrame([*labels, (None, 1, 0, ""), (5003, None, 0, ""), (7, 0, 0, ""), (12345678, 1, 0, "")], "doc_id long, quality int, toxic int, text string")
    got = quality.score(docs, told).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    held = [k for k in range(900) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([by[k].predicted == labels[k][1] for k in held]) > 0.97
    assert by[5003].score == by[4].score and by[None].score == by[3].score and by[5000].score == by[5001].score == by[5002].score
    # neither partitions nor the labels of the held-out fold have a part
    wrong = told.withColumn("quality", fim.F.when(quality.fold() == 1, 1 - fim.F.col("quality")).otherwise(fim.F.col("quality")))
    again = quality.score(docs.repartition(2), wrong).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert quality.score(docs.limit(0), told).count() == 0
    assert {r.score for r in quality.score(docs.limit(20), told.limit(0)).collect()} == {0.5}


def test_word_vectors(spark):
    """Word vectors are those of plain counting: the turned index vectors of what follows, plus those of what comes before."""
    texts = ["the cat sat", "the cat ran away fast", "a dog", "", None, "the\ncat,, sat"]
    vectors, weights = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    where, sign = quality._index()
    name = lambda w: int(quality.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0])
    want, count = {}, {}
    for t in texts:
        w = [name(x) for x in re.findall(r"[0-9A-Za-z]+|[^0-9A-Za-z\s]+", t or "")]
        for i, a in enumerate(w):
            count[a] = count.get(a, 0) + 1
            v = want.setdefault(a, np.zeros(quality.DIMENSIONS))
            for j in range(max(0, i - quality.REACH), min(len(w), i + quality.REACH + 1)):
                for p, s in zip(where[w[j]], sign[w[j]]):
                    if j != i:
                        v[(p + (j > i)) % quality.DIMENSIONS] += s
    for a, v in want.items():
        assert np.allclose(vectors[a], v / max(np.linalg.norm(v), 1e-12), atol=1e-6)
        assert math.isclose(weights[a], quality.COMMON / (quality.COMMON + count[a] / sum(count.values())), rel_tol=1e-5)


def test_pooling_takes_texts_whole(monkeypatch):
    rng = np.random.default_rng(0)
    vectors, weights = rng.normal(size=(quality.BUCKETS, quality.DIMENSIONS)).astype(np.float32), rng.random(quality.BUCKETS).astype(np.float32)
    texts = [b"", b"one", b"a b c d e f g " * 9, b"", b"x y", b" ", b"p q r " * 50, b""]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    want = quality.pooled(data, at, vectors, weights)
    row, token_at = quality.tokens(data, at)
    for k in range(len(texts)):
        own = row[token_at[k] : token_at[k + 1]]
        mean = vectors[own].astype(float).mean(0) if len(own) else np.zeros(quality.DIMENSIONS)
        assert np.allclose(want[k, : quality.DIMENSIONS], mean)
    for held in (1, 7, 64):
        monkeypatch.setattr(quality, "HELD", held)
        assert np.allclose(quality.pooled(data, at, vectors, weights), want)


def test_network_gradient_and_temperature():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 6)), rng.integers(0, 2, 40).astype(float)
    weights = [rng.normal(size=(6, 5)), rng.normal(size=5), rng.normal(size=5), np.array(0.3)]
    _, slope = quality.gradients(weights, x, y)
    for k, w in enumerate(weights):
        for at in np.ndindex(w.shape):
            up, down = [v.copy() for v in weights], [v.copy() for v in weights]
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert abs((quality.gradients(up, x, y)[0] - quality.gradients(down, x, y)[0]) / 2e-6 - slope[k][at]) < 1e-6
    z = rng.normal(0, 1, 20000)
    y = rng.random(20000) < 1 / (1 + np.exp(-z))
    assert abs(quality.temperature(4 * z, y) - 4) < 0.3
