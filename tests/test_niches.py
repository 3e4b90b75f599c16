"""Niche structures against a plain version of the rule, which works out every open edge's gain anew at each step."""

import random
from collections import defaultdict, namedtuple

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph as H
from tessera.operators import niches as N
from tessera.plans import regions as R

SF = "/root/testdata/sf0.001"
EDGES = "i string, j string, program_i string, program_j string, boundary_contact boolean, overlap_contact boolean, proximity_contact boolean, edge_reliability double, edge_strength double, is_strong boolean"
Edge = namedtuple("Edge", "key pair i j pi pj cross strong weak strength reliability")


def plain_edges(rows):
    return [Edge(r.edge_key, r.pair_key, r.i, r.j, r.program_i, r.program_j, r.cross, r.is_strong, r.proximity_contact, r.edge_strength, r.edge_reliability) for r in rows]


def region(component, seed):
    """(inner domains, context domains, the edges in which the backbone grows)."""
    base = {x for e in component if {e.i, e.j} & {seed.i, seed.j} for x in (e.i, e.j)}
    links = defaultdict(set)
    for e in component:
        if (e.i in base) != (e.j in base):
            links[e.j if e.i in base else e.i].add(e.i if e.i in base else e.j)
    inside = [e for e in component if e.i in base and e.j in base]
    other = lambda x: {e.j if e.i == x else e.i for e in inside if x in (e.i, e.j)}
    at = lambda x: {e.pair for e in inside if x in (e.i, e.j)}
    kept = [e for e in inside if e.pair == seed.pair or {e.pi, e.pj} & {seed.pi, seed.pj} or (other(e.i) - {e.j} and other(e.j) - {e.i} and len(at(e.i) | at(e.j) | {e.pair}) >= 2)]
    return base, {x for x, y in links.items() if len(y) >= 2}, kept


def gain(c, chosen, edges, core, programs, pairs):
    """(gain, carries on) of one edge, or none where it may not be taken; all of the rule's conditions, one after the other."""
    ends = {c.i, c.j}
    rim = {y for e in edges for x, y in ((e.i, e.j), (e.j, e.i)) if x in core and y not in core}
    around = core | ends | rim
    local = [e for e in edges if e.i in around and e.j in around]
    if c.pair in pairs:
        if not ends <= core:
            return None
    else:
        support = sum(e.pair == c.pair for e in local)
        informative = support >= 2 and not {c.pi, c.pj} <= programs
        touching = [e for e in local if {e.i, e.j} & ends]
        kinds = {e.pair for e in touching}
        skeleton = c.pair in kinds and len(pairs | kinds) >= 2 and len(touching) >= 2 and bool(kinds - pairs)
        if not (informative or skeleton):
            return None
    own = [e for e in edges if (e in chosen or e == c) and e.i in core | ends and e.j in core | ends]
    kinds = {e.pair for e in own}
    shares = any({c.pi, c.pj} & {e.pi, e.pj} for e in chosen)
    new_pair = c.pair not in pairs and shares and len(kinds) >= 2 and len({e.pair for e in own if {e.i, e.j} & core}) >= 2
    new_program = False
    if new_pair:
        for p in {c.pi, c.pj} - programs:
            held = [(e, x) for e in edges for x, q in ((e.i, e.pj), (e.j, e.pi)) if x in core and q == p]
            new_program |= len({x for _, x in held}) >= 2 or any(e.pair in pairs for e, _ in held)
    stable = lambda some, nodes: len(some) >= 2 and len({x for e in some for x in (e.i, e.j)} & nodes) >= 2
    before = [e for e in chosen if e.pair == c.pair]
    lifted = c.pair in pairs and not stable(before, core) and stable([*before, c], core | ends)
    surplus = (1.0 if len(before) >= 3 else 0.5) if c.pair in pairs and stable(before, core) else 0.0
    repeats = sum(e.pair in pairs for e in edges if {e.i, e.j} & ends)
    dense = 0.0 if new_pair or new_program else 1.0 if repeats >= 3 else 0.5 if repeats >= 2 else 0.0
    carries = new_program or lifted
    if new_pair and not carries:
        touching = [e for e in own if {e.i, e.j} & ends]
        carries = len(kinds) >= 2 and any(e.pair in pairs for e in touching) and len({x for e in touching for x in (e.i, e.j)} & core) >= 2
    return 1.0 * new_pair + 0.8 * new_program + 0.4 * lifted - 0.5 * surplus - 0.3 * dense, carries


def grow(edges, seed):
    ranks = lambda v: pd.Series(v).rank(pct=True)
    rank = dict(zip((e.key for e in edges), (0.65 * ranks([e.strength for e in edges]) + 0.35 * ranks([e.reliability for e in edges])).clip(0, 1)))
    chosen, core, programs, pairs = [seed], {seed.i, seed.j}, {seed.pi, seed.pj}, {seed.pair}
    while True:
        open_ = [e for e in edges if e not in chosen and {e.i, e.j} & core]
        best = [(-g[0], -rank[c.key], c.key, g[1], c) for c in open_ if (g := gain(c, chosen, edges, core, programs, pairs)) and g[0] > 0]
        if not best or not min(best, key=lambda x: x[:3])[3]:
            return chosen, core, pairs
        c = min(best, key=lambda x: x[:3])[4]
        chosen, core, programs, pairs = [*chosen, c], core | {c.i, c.j}, programs | {c.pi, c.pj}, pairs | {c.pair}


def attach(every, core, pairs, area):
    program = {x: p for e in every for x, p in ((e.i, e.pi), (e.j, e.pj))}
    own, held, soft = {program[x] for x in core}, set(core), set()
    for _ in range(2):
        new = {}
        for x in area - held:
            touch = [(e, e.j if e.i == x else e.i) for e in every if x in (e.i, e.j) and (e.j if e.i == x else e.i) in held]
            strong, loose, around = [(e, y) for e, y in touch if e.strong], {y for e, y in touch if e.weak}, {program[y] for _, y in touch}
            anchors = {y for _, y in strong} & core
            if not touch or any(e.cross and e.pair not in pairs and not {e.pi, e.pj} & own for e, _ in strong):
                continue
            if not (anchors or len(loose) >= 2 or len(around) >= 2) or (not strong and (len(loose) < 2 or len(around) < 2)):
                continue
            if program[x] not in own and len(around) < 2 and not anchors:
                continue
            new[x] = not strong
        if not new:
            break
        held |= set(new)
        soft |= {x for x, s in new.items() if s}
    return held, soft


def plain(rows, seeded):
    """{(component, pattern): (seeds, members, backbone, keys, soft, context)} with all rules applied one start after the other."""
    every = plain_edges(rows)
    by_key, out = {e.key: e for e in every}, {}
    firm = [e for e in every if e.cross and e.strong]
    for name in {s.component for s in seeded}:
        starts, seen = [], set()
        for s in sorted((s for s in seeded if s.component == name), key=lambda s: s.seed_rank):
            if s.pair_key not in seen and len(starts) < 3:
                seen.add(s.pair_key)
                starts.append(by_key[s.edge_key])
        part, before = {starts[0].i}, set()
        while part != before:
            before = part
            part = part | {x for e in firm if {e.i, e.j} & part for x in (e.i, e.j)}
        for seed in starts:
            base, context, edges = region([e for e in firm if e.i in part], seed)
            chosen, core, pairs = grow(edges, seed)
            local = [e for e in every if e.i in base | context and e.j in base | context]
            members, soft = attach(local, core, pairs, (base | context) - core)
            text = lambda x: ";".join(sorted(x))
            key = name, "::".join((text(core), text(pairs), text(e.key for e in chosen)))
            inner = [e for e in every if e.i in members and e.j in members]
            found = (1, text(members), text(soft), text(context), len(edges), len(inner), sum(e.cross for e in inner), sum(e.strong for e in inner))
            if key in out and len(members) <= out[key][1].count(";") + 1:
                found = out[key]
            out[key] = (out[key][0] + 1 if key in out else 1, *found[1:])
    return out


def got(s):
    return {(r.component, r.pattern): (r.seeds, r.member_nodes, r.soft_nodes, r.context_nodes, r.consistent_edges, r.internal_edges, r.cross_edges, r.strong_edges) for r in s.collect()}


def random_graph(spark, rng, domains, programs, n):
    name = lambda k: f"d{k:03d}"
    rows, seen = [], set()
    for _ in range(n):
        a, b = sorted(rng.sample(range(domains), 2))
        if (a, b) not in seen:
            seen.add((a, b))
            strong = rng.random() < 0.6
            rows.append((name(a), name(b), f"p{a % programs}", f"p{b % programs}", strong, False, not strong and rng.random() < 0.8, rng.randint(1, 9) / 10, rng.randint(1, 9) / 10, strong))
    return H.stored(N.prepared(spark.createDataFrame(rows, EDGES)), "graph")


@pytest.mark.parametrize("seed, domains, programs, n", [(1, 40, 5, 120), (2, 60, 9, 110), (3, 25, 4, 150), (4, 50, 12, 260)])
def test_structures(spark, seed, domains, programs, n):
    e = random_graph(spark, random.Random(seed), domains, programs, n)
    s = H.stored(N.seeds(e, 0.3), "seeds")
    assert got(N.structures(e, s)) == plain(e.collect(), s.collect())


def test_structures_of_the_tables(spark):
    """All activation of the smallest tables."""
    e = H.stored(N.prepared(R._edges(spark, SF)[0]), "prepared")
    s = H.stored(N.seeds(e), "seeds")
    made = got(N.structures(e, s))
    assert made and made == plain(e.collect(), s.collect())


def test_structures_of_rearranged_graphs(spark):
    """Edges that are the same in all graphs come to the regions alone, with the same structures as if each graph had them."""
    e = random_graph(spark, random.Random(6), 60, 6, 400)
    whole = H.stored(N.prepared(N.rearranged(e, 4, 2), ("iteration",)), "whole")
    x = H.stored(N.prepared(N.dealt(e, 4, 2), ("iteration",)), "dealt")
    by = ("iteration",)
    assert x.count() < whole.count() and not x.where("eligible").isEmpty()
    want = got(N.structures(whole, H.stored(N.seeds(whole, by=by), "seeds")))
    assert len({k[0][:6] for k in want}) == 4 and got(N.structures(x, H.stored(N.seeds(x, by=by), "seeds"), rest=e.where("NOT eligible"))) == want
    assert N.rearranged(e, 0, 2).isEmpty()


def test_memberships(spark):
    e = random_graph(spark, random.Random(5), 40, 6, 160)
    s = H.stored(N.structures(e, N.seeds(e, 0.2)), "structures")
    m = N.memberships(s)
    assert m.count() == s.agg(F.sum("member_count")).first()[0]
    rows = m.join(s.select("component", "pattern", "seed", "backbone_nodes", "soft_nodes"), ["component", "pattern"]).collect()
    for r in rows:
        core, soft = r.domain in r.backbone_nodes.split(";"), r.domain in r.soft_nodes.split(";")
        want = f"seed:{r.seed}" if r.domain in r.seed.split("||") else "backbone" if core else "member_collection:mixed" if soft else "member_collection:attached"
        assert (r.is_backbone, r.by_proximity, r.provenance) == (core, soft, want)
    assert N.memberships(s.limit(0)).count() == N.structures(e.limit(0), N.seeds(e.limit(0))).count() == 0
