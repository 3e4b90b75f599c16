"""Factorisation by blocks, greedy clusters by rounds, and discovery, each against a plain version."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import stats as S
from tessera.operators import programs as M
from tessera.operators import templates as L

CELLS = "sample string, spot long, gene string, value double, at int, run int"


def programs_in(rng, sample, n, groups, genes=40):
    """Cells of spots that each show one or two groups of genes."""
    out = []
    for s in range(n):
        on = {s % groups, rng.randrange(groups)} if s % 3 == 0 else {s % groups}
        for g in range(genes):
            if g % groups in on and rng.random() < 0.8 or rng.random() < 0.05:
                out.append((sample, s, f"g{g:03d}", float(rng.randint(1, 9)), 0, 0))
    return out


def plain_factors(x, k, seed, rounds, alpha, ratio=0.3, tolerance=1e-4):
    """The same alternating least squares on the whole matrix at once."""
    n, g = x.shape
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(g, min(n, g, k + 10))))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    size, axes = np.linalg.eigh((x @ q).T @ (x @ q))
    order = np.argsort(-size)[:k]
    v, s = q @ axes[:, order], np.sqrt(np.maximum(size[order], 0))
    v *= np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    u = x @ v / s
    h = np.zeros((k, g))
    h[0] = np.sqrt(s[0]) * np.abs(v[:, 0])
    for j in range(1, k):
        sides = [(np.linalg.norm(np.maximum(z * u[:, j], 0)) * np.linalg.norm(np.maximum(z * v[:, j], 0)), np.maximum(z * v[:, j], 0)) for z in (1, -1)]
        share, y = sides[0] if sides[0][0] >= sides[1][0] else sides[1]
        h[j] = np.sqrt(s[j] * share) * y / np.linalg.norm(y)
    h[h < 1e-12] = x.mean()
    losses, l1, l2 = [], n * alpha * ratio, n * alpha * (1 - ratio)
    while True:
        w = L.nonnegative(x @ h.T, h @ h.T)
        losses.append(((x - w @ h) ** 2).sum() / 2 + l1 * h.sum() + l2 * (h * h).sum() / 2)
        if len(losses) > rounds or (len(losses) > 1 and losses[-2] - losses[-1] <= tolerance * losses[-2]):
            return w, h, losses
        h = L.nonnegative((w.T @ x).T, w.T @ w, l1, l2).T


@pytest.mark.parametrize("alpha, sent", [(0.0, 64 << 20), (1e-4, 0)])
def test_factors(spark, monkeypatch, alpha, sent):
    monkeypatch.setattr(L, "ROWS", 16)
    monkeypatch.setattr(L, "SLICE", 5)
    monkeypatch.setattr(L, "SENT_BYTES", sent)
    rng = random.Random(1)
    rows = programs_in(rng, "a", 90, 4) + programs_in(rng, "b", 50, 3, 30)
    blocks, genes, sizes = L.matrix_blocks(spark.createDataFrame(rows, CELLS).repartition(3))
    assert blocks.count() > 6
    state = L.fitted(blocks, sizes, [0, 1], (4, 3), rounds=25, alpha=alpha)
    loss = {(r.sample, r.run): r.losses for r in L.losses(state).collect()}
    held = defaultdict(dict)
    for r in L.weights(state, genes).collect():
        held[r.sample, r.run][r.component, r.gene] = r.weight
    loadings = {(r.sample, r.run, spot): np.frombuffer(bytes(r.payload)).reshape(-1, r.k)[i] for r in L.usage(blocks, state).collect() for i, spot in enumerate(r.spots)}
    for sample in "ab":
        own = [r for r in rows if r[0] == sample]
        spots, names = sorted({r[1] for r in own}), sorted({r[2] for r in own})
        x = np.zeros((len(spots), len(names)))
        for r in own:
            x[spots.index(r[1]), names.index(r[2])] = r[3]
        for run, k in ((0, 4), (1, 3)):
            w, h, losses = plain_factors(x, k, 2024 + 17 * run, 25, alpha)
            got = np.array([[held[sample, run][c, g] for g in names] for c in range(k)])
            assert np.allclose(got, h, atol=1e-6 * h.max()) and np.allclose(loss[sample, run], losses, rtol=1e-9)
            assert np.allclose([loadings[sample, run, s] for s in spots], w, atol=1e-6 * w.max())
            assert all(b <= a * (1 + 1e-9) for a, b in zip(loss[sample, run], loss[sample, run][1:]))


def test_penalty_that_leaves_nothing(spark):
    """A penalty under which all factors vanish is made smaller until some stay."""
    rows = programs_in(random.Random(2), "a", 40, 3, 12)
    blocks, genes, sizes = L.matrix_blocks(spark.createDataFrame([(r[0], r[1], r[2], r[3] * 1e-4) for r in rows], "sample string, spot long, gene string, value double"))
    assert L.weights(L.fitted(blocks, sizes, [0], (3,), rounds=5, alpha=1.0), genes).where("weight > 0").count() > 0


def test_nonnegative_least_squares():
    rng = np.random.default_rng(3)
    b, g = rng.random((9, 5)), rng.normal(size=(30, 5))
    a = b.T @ b
    x = L.nonnegative(g, a, 0.1, 0.2)
    slope = x @ (a + 0.2 * np.eye(5)) - g + 0.1
    assert (x >= 0).all() and (slope >= -1e-7).all() and np.abs(x * slope).max() < 1e-7  # the optimum's conditions


@pytest.mark.parametrize("seed, chain", [(1, False), (2, False), (3, True)])
def test_leaders(spark, seed, chain):
    rng = random.Random(seed)
    nodes = [(s, f"{k:03d}") for s in "ab" for k in range(40)]
    pairs = [(s, f"{a:03d}", f"{b:03d}", rng.randint(1, 4) / 4) for s in "ab" for a in range(40) for b in range(a) if (a - b == 1 if chain else rng.random() < 0.08)]
    got = {(r.sample, r.id): r.leader for r in L.leaders(spark.createDataFrame(nodes, "sample string, id string"), spark.createDataFrame(pairs, "sample string, id string, other string, score double"), ["sample"], [F.desc("score"), "other"]).collect()}
    want, score = {}, {(s, a, b): v for s, a, b, v in pairs}
    for s, a in nodes:
        near = [(-score[s, a, b], b) for t, b in nodes if t == s and (s, a, b) in score and want.get((s, b)) == b]
        want[s, a] = min(near)[1] if near else a
    assert got == want


def test_redundant(spark):
    rng = random.Random(4)
    rows = [("ab"[k % 2], f"p{k:02d}", rng.randint(1, 5) / 5, rng.sample([f"g{x}" for x in range(14)], 6), rng.sample(range(12), 7)) for k in range(50)] + [("a", "none", 0.5, [], [1])]
    rows += [(s, f"copy of {p}", 0.1, g, on) for s, p, _, g, on in rows[:4]]
    got = {(r.sample, r.program): (r.status, r.primary) for r in M.redundant(spark.createDataFrame(rows, "sample string, program string, confidence double, genes array<string>, spots array<int>"), 0.3, 0.5).collect()}
    jac, want, kept = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)), {}, []
    for r in sorted(rows, key=lambda r: (-r[2], r[1])):
        hit = next(((k[1], jac(r[4], k[4])) for k in kept if k[0] == r[0] and jac(r[3], k[3]) >= 0.3 and jac(r[4], k[4]) >= 0.5), None)
        if hit is None:
            kept.append(r)
        want[r[:2]] = ("retained_primary", r[1]) if hit is None else ("merged_duplicate" if hit[1] >= 0.8 else "redundant_variant", hit[0])
    assert got == want and {s for s, _ in want.values()} == {"retained_primary", "merged_duplicate", "redundant_variant"}


def test_encode(spark):
    rng = random.Random(5)
    rows = [("a", s, f"g{g:02d}", float(rng.choice([0, 1, 2, 5, 9])), 0, 0) for s in range(20) for g in range(rng.choice([0, 3, 12, 30]))]
    got = {(r.spot, r.gene): r.value for r in L.encode(spark.createDataFrame(rows, CELLS)).collect()}
    want = {}
    for s in range(20):
        own = {r[2]: r[3] for r in rows if r[1] == s and r[3] > 0}
        if own:
            sat = {g: v / (v + np.median(list(own.values()))) for g, v in own.items()}
            keep = [g for g, v in sat.items() if v >= max(1e-4, np.quantile(list(sat.values()), 0.8))]
            keep = keep if len(keep) >= min(8, len(sat)) else sorted(sat, key=lambda g: (-sat[g], g))[:8]
            want |= {(s, g): sat[g] / sum(sat[h] for h in keep) for g in keep}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def _rand(a, b):
    pairs = lambda v: sum(n * (n - 1) / 2 for n in v)
    count = lambda v: list(np.unique(v, return_counts=True)[1]) if v else []
    both, left, right, n = pairs(count([f"{x}/{y}" for x, y in zip(a, b)])), pairs(count(list(a))), pairs(count(list(b))), len(a) * (len(a) - 1) / 2
    most, expected = (left + right) / 2, left * right / n
    return 1.0 if most == expected else (both - expected) / (most - expected)


def plain_discovery(used, weights, n_spots, runs_wanted, least_runs=3, few=4, least=8):
    """Discovery for one sample from its factors: (runs, {(leader's gene, frequency, tier)} by template, evidence)."""
    h, w = defaultdict(dict), {}
    for r in weights:
        h[r.run, r.component][r.gene] = r.weight
    for r in used:
        x = np.frombuffer(bytes(r.payload)).reshape(-1, r.k)
        for c in range(r.k):
            w.setdefault((r.run, c), {}).update(zip(r.spots, x[:, c]))
    cand, labels, good = [], [], 0
    for run in range(runs_wanted):
        own = []
        for key in sorted(k for k in h if k[0] == run):
            pos = sorted(((v, g) for g, v in h[key].items() if v > 0), key=lambda x: (-x[0], x[1]))
            if not pos:
                continue
            cut, need = np.quantile([v for v, _ in pos], 0.8), max(few, int(np.ceil(0.2 * len(pos))))
            genes = {g: v for k, (v, g) in enumerate(pos[:300]) if v >= cut or k < need}
            use = np.array(list(w[key].values()))
            support = int((use >= np.quantile(use[use > 0], 0.75)).sum()) if (use > 0).any() else 0
            if support >= max(least, int(np.ceil(0.01 * n_spots))):
                total = sum(genes.values())
                own.append((key, {g: v / total for g, v in genes.items()}))
        cand += own
        labels.append([max(range(len(own)), key=lambda c: (w[own[c][0]][s], -c)) if own else -1 for s in sorted(next(iter(w.values())))])
        if run:
            good = good + 1 if _rand(labels[-2], labels[-1]) >= 0.99 else 0
        if run + 1 >= least_runs and good >= 2:
            break
    runs, heads, members = len(labels), [], {}
    spots = sorted(next(iter(w.values())))
    vec = {k: np.array([w[k][s] for s in spots] + [0.0] * (n_spots - len(spots))) for k, _ in cand}
    for key, genes in cand:
        best = None
        for k, (other, theirs) in enumerate(heads):
            c = max(0.0, np.corrcoef(vec[key], vec[other])[0, 1]) if vec[key].std() > 1e-8 and vec[other].std() > 1e-8 else 0.0
            o = len(set(genes) & set(theirs)) / len(set(genes) | set(theirs))
            if (c >= 0.92 or (c >= 0.85 and o >= 0.3)) and (best is None or 0.65 * c + 0.35 * o > best[0] + 1e-12):
                best = (0.65 * c + 0.35 * o, k)
        if best is None:
            heads.append((key, genes))
        members.setdefault(heads[best[1]][0] if best else key, []).append((key, genes))
    out = {}
    for lead, own in members.items():
        support = len({k[0] for k, _ in own})
        if support / runs < 0.2:
            continue
        n, total = defaultdict(int), defaultdict(float)
        for _, genes in own:
            for g, v in genes.items():
                n[g] += 1
                total[g] += v
        keep = [g for g in n if n[g] / support >= 0.25]
        if len(keep) < few:
            continue
        tier = {g: "scaffold" if n[g] / support >= 0.6 else "support" if n[g] / support >= 0.4 else "context" for g in keep}
        mean = {g: total[g] / n[g] for g in keep}
        share = {g: v / sum(mean.values()) for g, v in mean.items()}
        use = sum(vec[k] for k, _ in own) / len(own)
        on = (use >= np.quantile(use[use > 0], 0.75)).sum() / n_spots
        out[lead] = ({g: (round(share[g], 9), n[g] / support, tier[g]) for g in keep}, round(min(1, 0.4 * support / runs + 0.35 * on + 0.25 * sum(v * v for v in share.values())), 9))
    return runs, out


def test_discovery(spark, monkeypatch):
    monkeypatch.setattr(L, "ROWS", 32)
    rng = random.Random(7)
    rows = programs_in(rng, "a", 120, 4) + programs_in(rng, "b", 100, 3, 30)
    cells = spark.createDataFrame(rows, CELLS)
    t, g, ran = L.discover(cells, runs=5, ranks=(4, 5), rounds=20, least_runs=3, least_support=8, least_genes=4)
    genes, info, runs = defaultdict(dict), {}, {r.sample: r.runs for r in ran.collect()}
    for r in g.collect():
        genes[r.sample, r.leader][r.gene] = (round(r.weight, 9), r.frequency, r.tier)
    for r in t.collect():
        info[r.sample, r.leader] = round(r.evidence, 9)
        assert r.genes == len(genes[r.sample, r.leader]) == r.scaffold + r.support + r.context
    blocks, names, sizes = L.matrix_blocks(cells)
    state = L.fitted(blocks, sizes, list(range(5)), (4, 5), rounds=20)
    used, w = L.usage(blocks, state).collect(), L.weights(state, names).collect()
    for s, n in (("a", 120), ("b", 100)):
        many, want = plain_discovery([r for r in used if r.sample == s], [r for r in w if r.sample == s], n, 5)
        key = lambda k: f"{k[0]:04d}/{k[1]:04d}"
        assert runs[s] == many and {k: v for k, v in genes.items() if k[0] == s} == {(s, key(k)): v[0] for k, v in want.items()}
        assert {k: v for k, v in info.items() if k[0] == s} == {(s, key(k)): pytest.approx(v[1], abs=1e-8) for k, v in want.items()}
    assert len(info) >= 6


def test_agreement_is_the_adjusted_rand_index(spark):
    rng = random.Random(8)
    labels = {run: [rng.randrange(3) for _ in range(60)] for run in range(3)} | {3: [0] * 60, 4: [0] * 60}
    frame = spark.createDataFrame([("a", run, k, x) for run, v in labels.items() for k, x in enumerate(v)], "sample string, run int, spot long, label int")
    got = {r.run: r.ari for r in L.agreement(frame).collect()}
    assert got == {run: pytest.approx(_rand(labels[run - 1], labels[run])) for run in range(1, 5)}
    one = spark.createDataFrame(list(zip(labels[0], labels[1])), "a int, b int")
    assert S.adjusted_rand(one, "a", "b").first().ari == pytest.approx(got[1])
