"""Niches: interaction edges of domains, seeds, canonical structures, their filter and their duplicates."""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.functions import stats as S
from tessera.operators.graph import HERE, components, stored

#: Weights of an edge's gain in a backbone: new pair, new program, better supported pair, redundancy, dense repeats.
GAIN = (1.0, 0.8, 0.4, 0.5, 0.3)


def epsilon(distances: DataFrame, mode: str = "spot_spacing", spacing: float | None = None, fixed: float | None = None, multiplier: float = 1.5, quantile: float = 0.25) -> tuple[float, str]:
    """The contact distance for edges with a column distance, and the rule it comes from.

    spot_spacing: a multiple of the spots' spacing, which must be positive; fixed: the given one, or the lower quartile of
    the distances; else a quantile of the distances. Distances that are negative or not finite don't count; without any it
    is 0.
    """
    fine = distances.where("distance >= 0 AND distance < double('Infinity')")
    q = _one(S.quantile(fine, "distance", 0.25 if mode == "fixed" else min(1.0, max(0.0, quantile))))
    if q is None:
        return 0.0, "empty_distance"
    if mode == "spot_spacing":
        if not spacing or not 0 < spacing < float("inf"):
            raise ValueError("spot_spacing needs the spacing of the spots")
        return max(0.0, multiplier * spacing), "spot_spacing"
    if mode == "fixed":
        return (float(q), "fixed_default_q25") if fixed is None else (max(0.0, fixed), "fixed")
    return float(q), "distance_quantile"


def _one(q: DataFrame) -> float | None:
    row = q.first()
    return None if row is None else row[0]


def edges(graph: DataFrame, domains: DataFrame, near: DataFrame, epsilon: float, blend: float = 0.5) -> DataFrame:
    """Interaction edges with strengths.

    graph is (i, j, shared, spatial_overlap); near is (i, j, distance) for pairs that neither touch nor overlap; domains
    are (domain, program, boundary, reliability). Contact is given up where domains overlap, and nearness where they
    touch or overlap. Strong edges reach the 0.8 quantile of their kind, and 0.08.
    """
    a = domains.select(F.col("domain").alias("i"), F.col("program").alias("program_i"), F.col("boundary").alias("bi"), F.col("reliability").alias("ri"))
    b = domains.select(F.col("domain").alias("j"), F.col("program").alias("program_j"), F.col("boundary").alias("bj"), F.col("reliability").alias("rj"))
    g = graph.select("i", "j", "shared", "spatial_overlap", F.lit(0.0).alias("distance"))
    g = g.unionByName(near.select("i", "j", F.lit(0).cast("long").alias("shared"), F.lit(0.0).alias("spatial_overlap"), "distance"))
    e = g.join(a, "i").join(b, "j")
    e = e.withColumn("overlap_contact", F.col("spatial_overlap") > 0).withColumn("boundary_contact", (F.col("shared") >= 1) & ~F.col("overlap_contact"))
    soft = F.when(F.col("boundary_contact") | F.col("overlap_contact") | (F.col("distance") > epsilon), 0.0).otherwise((epsilon - F.col("distance")) / epsilon)
    e = e.withColumn("proximity_contact", ~F.col("boundary_contact") & ~F.col("overlap_contact") & (F.col("distance") <= epsilon)).withColumn("soft", soft)
    e = e.where("boundary_contact OR overlap_contact OR proximity_contact")
    ratio = X.clamp01(F.col("shared") / F.greatest(F.lit(1.0), F.least("bi", "bj").cast("double")))
    e = e.withColumn("edge_reliability", F.sqrt(F.col("ri") * F.col("rj"))).withColumn("f", (1 - blend) + blend * F.col("edge_reliability"))
    e = e.withColumn("contact", X.clamp01(X.rational(ratio) * F.col("f"))).withColumn("overlap", X.clamp01(F.col("spatial_overlap") * F.col("f"))).withColumn("soft", X.clamp01(F.col("soft") * F.col("f")))
    e = stored(e.withColumn("edge_strength", (F.col("contact") + 2 * F.col("overlap") + F.col("soft")) / 4), "interactions")
    c, o = _one(S.quantile(e.where("boundary_contact AND contact > 0"), "contact", 0.8)), _one(S.quantile(e.where("overlap_contact"), "overlap", 0.8))
    bound = lambda v: float("inf") if v is None else max(0.08, v)
    strong = (F.col("boundary_contact") & (F.col("contact") >= bound(c))) | (F.col("overlap_contact") & (F.col("overlap") >= bound(o)))
    return e.select("i", "j", "program_i", "program_j", "boundary_contact", "overlap_contact", "proximity_contact", "edge_reliability", "edge_strength", strong.alias("is_strong"))


def prepared(e: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds keys, cross and the seed score: 0.65 strength rank and 0.35 reliability rank among strong edges of two programs.

    Ranks are within by, the columns that tell graphs apart.
    """
    e = e.withColumn("edge_key", X.unordered_key("i", "j", "||")).withColumn("pair_key", X.unordered_key("program_i", "program_j")).withColumn("cross", F.col("program_i") != F.col("program_j"))
    e = e.withColumn("eligible", F.col("cross") & F.col("is_strong"))
    for value, name in (("edge_strength", "rs"), ("edge_reliability", "rr")):
        e = S.percentile_rank(e, value, [*by, "eligible"], name)
    return e.withColumn("seed_score", F.when(F.col("eligible"), X.clamp01(0.65 * F.col("rs") + 0.35 * F.col("rr"))).otherwise(0.0)).drop("rs", "rr")


#: Columns of dealt edges: numbers of their domains, in the order of names. A task joins more edges of numbers than of names.
_NUMBERS, HERE_NUMBERS = ("number_i", "number_j"), 2_000_000


def seeds(e: DataFrame, quantile: float = 0.6, most: int = 12, by: tuple[str, ...] = ()) -> DataFrame:
    """The best seeds of each component of the graph of eligible edges: (component, edge_key, seed_score, seed_rank).

    The least score of a seed is a quantile of the scores within by. Domains of different by have different names.
    """
    good = stored(e.where("eligible").withColumn("_of", F.concat_ws("|", *by)), "eligible")
    bounds = S.quantile(good, "seed_score", quantile, ["_of"]).withColumnRenamed("quantile", "_bound")
    a, b = _NUMBERS if _NUMBERS[0] in e.columns else ("i", "j")
    ways = good.select(*by, F.col(a).alias("u"), F.col(b).alias("v")).unionByName(good.select(*by, F.col(b).alias("u"), F.col(a).alias("v")))
    part = components(ways.select(*by, F.col("u").alias("spot")).distinct(), stored(ways, "ways"), HERE if a == "i" else HERE_NUMBERS)
    s = good.join(bounds, "_of").where("seed_score >= _bound").drop("_of", "_bound").join(part.withColumnRenamed("spot", a), [*by, a])
    s = S.top_k(s, [*by, "component"], [F.desc("seed_score"), F.desc("edge_strength"), F.desc("edge_reliability"), "edge_key"], most, "seed_rank")
    if a == "i":
        return s
    s = stored(s, "seeds")
    names = good.select(*by, F.col(a).alias("component"), F.col("i").alias("_name")).unionByName(good.select(*by, F.col(b).alias("component"), F.col("j").alias("_name")))
    names = names.join(s.select(*by, "component").distinct(), [*by, "component"], "left_semi").distinct()
    return s.join(names, [*by, "component"]).withColumn("component", F.col("_name")).drop("_name", *_NUMBERS)


def diverse(seeded: DataFrame, most: int = 3) -> DataFrame:
    """Of a component's seeds, in order of rank, the first of each pair of programs, and of these most."""
    first = S.top_k(seeded, ["component", "pair_key"], ["seed_rank"], 1, "_of_pair").drop("_of_pair")
    return S.top_k(first, ["component"], ["seed_rank"], most, "start")


def regions(e: DataFrame, starts: DataFrame, rest: DataFrame | None = None) -> DataFrame:
    """The edges around each start, with its key as seed and whether their ends are inner ones (in_i, in_j).

    Inner domains are a start's two ends and those that eligible edges join to them; context domains lie outside and are
    joined by eligible edges to two inner ones or more. Edges are all those of e between these domains, eligible or not.
    With rest, e are graphs that dealt() makes, and edges are those of rest too, which each of the graphs has.
    """
    good = e.where("eligible").select("i", "j")
    ways = stored(good.select(F.col("i").alias("u"), F.col("j").alias("v")).unionByName(good.select(F.col("j").alias("u"), F.col("i").alias("v"))), "ways")
    ends = starts.select(F.col("edge_key").alias("seed"), F.explode(F.array("i", "j")).alias("node"))
    inner = stored(ends.unionByName(ends.join(ways, ends.node == ways.u).select("seed", F.col("v").alias("node"))).distinct(), "inner")
    rim = inner.join(ways, inner.node == ways.u).groupBy("seed", F.col("v").alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    nodes = inner.withColumn("in", F.lit(True)).unionByName(rim.join(inner, ["seed", "node"], "left_anti").select("seed", "node", F.lit(False).alias("in")))
    nodes = stored(nodes, "regions")
    side = lambda c, node="node": nodes.select("seed", F.expr(node).alias(c), F.col("in").alias(f"in_{c}"))
    found = e.drop(*_NUMBERS).join(side("i"), "i").join(side("j"), ["seed", "j"])
    if rest is None:
        return found
    other = rest.join(side("i", _PLAIN), "i").join(side("j", _PLAIN), ["seed", "j"]).withColumn("iteration", F.substring("seed", 1, 6).cast("int"))
    other = other.withColumns({c: _named(F.col("iteration"), c) for c in ("i", "j")}).withColumn("edge_key", X.unordered_key("i", "j", "||"))
    return found.unionByName(other)


#: A domain's name without the graph that it is in.
_PLAIN = "substring(node, 8)"


class _Region:
    """The edges around one start, and the backbone and members that grow from it.

    The backbone gains most, step by step: 1.0 for an edge of a new pair of programs, 0.8 more if it brings a program that two domains
    of the backbone or more have an edge to, or 0.4 for a second edge of a known pair, less 0.3 or 0.15 where three or
    two edges at its ends have known pairs. That is what the rule comes to on eligible edges alone: an open edge of a new
    pair always has a selected one beside it, so it stands in a local skeleton of two pairs, and always carries on the
    pattern; further edges of a pair gain nothing. So an edge's gain changes only by the events in _enter and _meet, which
    put the edges concerned into a queue anew; an edge whose gain fell meanwhile goes back when its turn comes.
    """

    def __init__(self, edges: list, seed: str):
        self.edges = edges
        self.program = {x: p for e in edges for x, p in ((e.i, e.program_i), (e.j, e.program_j))}
        self.inner = {x for e in edges for x, inside in ((e.i, e.in_i), (e.j, e.in_j)) if inside}
        firm = [e for e in edges if e.eligible and e.in_i and e.in_j]
        start = next(e for e in firm if e.edge_key == seed)
        near, pairs = defaultdict(set), defaultdict(set)
        for e in firm:
            near[e.i].add(e.j)
            near[e.j].add(e.i)
            pairs[e.i].add(e.pair_key)
            pairs[e.j].add(e.pair_key)
        own = {start.program_i, start.program_j}

        def fits(e) -> bool:
            """Shares a program with the seed, or both ends have further edges and two pairs or more meet there."""
            return bool({e.program_i, e.program_j} & own) or bool(near[e.i] - {e.j} and near[e.j] - {e.i} and len(pairs[e.i] | pairs[e.j]) >= 2)

        self.kept, self.firm_count = [e for e in firm if fits(e)], len(firm)
        rank = lambda c: pd.Series([getattr(e, c) for e in self.kept]).rank(method="average", pct=True)
        self.rank = dict(zip((e.edge_key for e in self.kept), (0.65 * rank("edge_strength") + 0.35 * rank("edge_reliability")).clip(0, 1), strict=True))
        self.at, self.of_pair = defaultdict(list), defaultdict(list)
        for e in self.kept:
            self.at[e.i].append(e)
            self.at[e.j].append(e)
            self.of_pair[e.pair_key].append(e)
        self.nodes, self.programs, self.keys, self.pairs = set(), set(), set(), Counter()
        self.anchors, self.repeats, self.queue = defaultdict(set), Counter(), []
        self._take(start)
        while self.queue:
            low, _, _, c = heapq.heappop(self.queue)
            gain = self.gain(c)
            if gain == -low:
                self._take(c)
            else:
                self._offer(c)

    def gain(self, c) -> float:
        if c.edge_key in self.keys:
            return 0.0
        if c.pair_key not in self.pairs:
            return GAIN[0] + GAIN[1] * any(len(self.anchors[p]) >= 2 for p in {c.program_i, c.program_j} - self.programs)
        if self.pairs[c.pair_key] > 1 or not {c.i, c.j} <= self.nodes:
            return 0.0
        n = self.repeats[c.i] + self.repeats[c.j] - 1  # c stands at both ends
        return GAIN[2] - GAIN[4] * (1.0 if n >= 3 else 0.5 if n == 2 else 0.0)

    def _offer(self, c) -> None:
        if (gain := self.gain(c)) > 0:
            heapq.heappush(self.queue, (-gain, -self.rank[c.edge_key], c.edge_key, c))

    def _take(self, c) -> None:
        self.keys.add(c.edge_key)
        self.programs |= {c.program_i, c.program_j}
        self.pairs[c.pair_key] += 1
        if self.pairs[c.pair_key] == 1:
            self._meet(c.pair_key)
        for x in (c.i, c.j):
            if x not in self.nodes:
                self._enter(x)

    def _meet(self, pair: str) -> None:
        """A pair is known from now on: its edges count as repeats, and those between domains of the backbone may be its second."""
        for e in self.of_pair[pair]:
            self.repeats[e.i] += 1
            self.repeats[e.j] += 1
            if e.i in self.nodes and e.j in self.nodes:
                self._offer(e)

    def _enter(self, x: str) -> None:
        """A domain joins: its edges are open, and it is an anchor of the programs at their other ends."""
        self.nodes.add(x)
        for e in self.at[x]:
            p = e.program_j if e.i == x else e.program_i
            if x in self.anchors[p]:
                continue
            self.anchors[p].add(x)
            if len(self.anchors[p]) == 2 and p not in self.programs:
                for y in self.anchors[p]:
                    for f in self.at[y]:
                        if p in (f.program_i, f.program_j):
                            self._offer(f)
        for e in self.at[x]:
            self._offer(e)

    def members(self, rounds: int = 2) -> dict[str, bool]:
        """The backbone's domains and those of the region that join them, with whether they do so by nearness alone."""
        at = defaultdict(list)
        for e in self.edges:
            at[e.i].append((e, e.j))
            at[e.j].append((e, e.i))
        own = {self.program[x] for x in self.nodes}
        held, soft = set(self.nodes), {}
        for _ in range(rounds):
            new = set()
            for x in set(self.program) - held:
                touch = [(e, y) for e, y in at[x] if y in held]
                strong, loose = [(e, y) for e, y in touch if e.is_strong], {y for e, y in touch if e.proximity_contact}
                if any(e.cross and e.pair_key not in self.pairs and not {e.program_i, e.program_j} & own for e, _ in strong):
                    continue
                around, anchored = {self.program[y] for _, y in touch}, any(y in self.nodes for _, y in strong)
                if not touch or not (anchored or len(loose) >= 2 or len(around) >= 2):
                    continue
                if not strong and (len(loose) < 2 or len(around) < 2):
                    continue
                if self.program[x] not in own and len(around) < 2 and not anchored:
                    continue
                new.add(x)
                soft[x] = not strong
            if not new:
                break
            held |= new
        return {x: soft.get(x, False) for x in held}

    def row(self, seed) -> dict:
        members = self.members()
        inner = [e for e in self.edges if e.i in members and e.j in members]
        mean = lambda c: math.fsum(getattr(e, c) for e in inner) / len(inner)
        text = lambda x: ";".join(sorted(x))
        return {
            "component": seed.component, "pattern": "::".join(map(text, (self.nodes, self.pairs, self.keys))), "seeds": 1, "member_count": len(members), "backbone_count": len(self.nodes),
            "program_count": len({self.program[x] for x in members}), "pairs": text(self.pairs), "backbone_nodes": text(self.nodes), "member_nodes": text(members), "backbone_keys": text(self.keys),
            "strong_keys": text(e.edge_key for e in inner if e.is_strong), "cross_edges": sum(e.cross for e in inner), "strong_edges": sum(e.is_strong for e in inner), "internal_edges": len(inner),
            "contact_fraction": mean("boundary_contact"), "overlap_fraction": mean("overlap_contact"), "proximity_fraction": mean("proximity_contact"), "mean_strength": mean("edge_strength"),
            "mean_reliability": mean("edge_reliability"), "seed": seed.seed, "seed_rank": seed.seed_rank, "seed_keys": seed.seed, "soft_nodes": text(x for x, near in members.items() if near),
            "context_nodes": text(set(self.program) - self.inner), "region_edges": self.firm_count, "consistent_edges": len(self.kept),
        }


_STRUCTURE = (
    "component string, pattern string, seeds long, member_count long, backbone_count long, program_count long, pairs string, backbone_nodes string, member_nodes string, backbone_keys string, strong_keys string, "
    "cross_edges long, strong_edges long, internal_edges long, contact_fraction double, overlap_fraction double, proximity_fraction double, mean_strength double, mean_reliability double, seed string, seed_rank long, "
    "seed_keys string, soft_nodes string, context_nodes string, region_edges long, consistent_edges long"
)


def structures(e: DataFrame, seeded: DataFrame, most: int = 3, rest: DataFrame | None = None) -> DataFrame:
    """One row for each canonical structure of a component, grown from diverse seeds.

    e is prepared, seeded as seeds() gives it. Each start grows by itself inside its region (see regions and _Region), so a
    group holds the edges around one start, not a component. Starts that come to the same backbone are one row: that with
    the most members, of equal ones the seed of the best rank; seeds counts them and seed_keys names them. region_edges
    counts the eligible edges of the inner domains, consistent_edges those that fit the seed, in which the backbone grows.
    """
    starts = stored(diverse(seeded, most), "starts")
    told = starts.select(F.col("edge_key").alias("seed"), "component", "seed_rank")
    near = regions(e, starts, rest).join(told, "seed")

    def grown(group: pd.DataFrame) -> pd.DataFrame:
        every = list(group.itertuples(index=False))
        return pd.DataFrame([_Region(every, every[0].seed).row(every[0])])

    rows = stored(near.groupBy("seed").applyInPandas(grown, _STRUCTURE), "grown")
    w = Window.partitionBy("component", "pattern")
    every = rows.withColumns({"seeds": F.count(F.lit(1)).over(w), "seed_keys": F.array_join(F.array_sort(F.collect_list("seed").over(w)), ";")})
    return S.top_k(every, ["component", "pattern"], [F.desc("member_count"), "seed_rank"], 1, "_first").drop("_first")


def memberships(s: DataFrame) -> DataFrame:
    """(component, pattern, domain, is_backbone, by_proximity, provenance) for the members of structures: seed ends, backbone, attached or mixed."""
    has = lambda c, x: F.array_contains(F.split(c, ";"), x)
    m = s.select("component", "pattern", "seed", "backbone_nodes", "soft_nodes", F.explode(F.split("member_nodes", ";")).alias("domain"))
    m = m.withColumns({"is_backbone": has("backbone_nodes", m.domain), "by_proximity": has("soft_nodes", m.domain)})
    ends = F.array_contains(F.split("seed", r"\|\|"), m.domain)
    why = F.when(ends, F.concat(F.lit("seed:"), "seed")).when(F.col("is_backbone"), "backbone").when(F.col("by_proximity"), "member_collection:mixed").otherwise("member_collection:attached")
    return m.select("component", "pattern", "domain", "is_backbone", "by_proximity", why.alias("provenance"))


def basic_filter(s: DataFrame) -> DataFrame:
    """Adds confidence, fail_reason (in the order of the rules) and passed."""
    n = F.size(F.filter(F.split("pairs", ";"), lambda x: x != ""))
    third = lambda c: X.clamp01(F.col(c) / 3.0)
    conf = X.clamp01(0.30 * X.clamp01("mean_strength") + 0.30 * X.clamp01("mean_reliability") + 0.15 * third("cross_edges") + 0.15 * X.clamp01(n / F.greatest(F.lit(1), "program_count")) + 0.10 * X.clamp01(F.size(F.split("backbone_keys", ";")) / F.lit(3.0)))
    s = s.withColumn("confidence", conf)
    same = (F.col("internal_edges") - F.col("cross_edges")) / F.greatest(F.lit(1), "internal_edges")
    rules = [
        ("insufficient_program_count", F.col("program_count") < 2), ("missing_strong_backbone", (F.col("backbone_count") < 2) | (F.col("strong_edges") <= 0)), ("cross_program_support_insufficient", F.col("cross_edges") < 1),
        ("backbone_program_pair_richness_too_low", n < 1), ("mean_edge_reliability_too_low", F.col("mean_reliability") < 0.2), ("proximity_only_pattern", (F.col("strong_edges") <= 0) & (F.col("proximity_fraction") >= 1)),
        ("same_program_dominance_too_high", same > 0.6), ("large_structure_backbone_pair_thin", (F.col("member_count") >= 4) & (n / F.col("member_count") < 0.2)), ("interaction_confidence_too_low", F.col("confidence") < 0.2),
    ]
    why = F.array_join(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules])), ";")
    return s.withColumn("fail_reason", why).withColumn("passed", F.col("fail_reason") == "")


def deduplicate(s: DataFrame, by: list[str], margin: float = 0.03) -> DataFrame:
    """Rows that are no near copies of a better row: a scan in order of a score, against the rows kept so far, by group."""
    names = s.columns

    def kept(group: pd.DataFrame) -> pd.DataFrame:
        parts = lambda c: group[c].map(lambda x: frozenset(filter(None, x.split(";"))))
        share = (parts("pairs").map(len) / group.program_count.clip(lower=1)).clip(0, 1)
        group = group.assign(_score=(0.55 * group.confidence + 0.30 * group.mean_reliability + 0.15 * share).clip(0, 1), **{"_" + c: parts(c) for c in ("backbone_keys", "backbone_nodes", "strong_keys", "pairs")})
        group = group.sort_values(["_score", "confidence", "strong_edges", "member_count", "pattern"], ascending=[False] * 4 + [True])
        jac = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
        out: list = []
        for row in group.itertuples(index=False, name=None):
            r = dict(zip(group.columns, row, strict=True))
            copy = False
            for k in out:
                keys, core, strong, pair = (jac(r["_" + c], k["_" + c]) for c in ("backbone_keys", "backbone_nodes", "strong_keys", "pairs"))
                near = keys >= 0.8 and core >= 0.8 and (strong >= 0.75 or pair >= 0.75) and r["_score"] + margin < k["_score"]
                copy |= r["pattern"] == k["pattern"] or (core >= 0.999 and pair >= 0.999 and (strong >= 0.95 or keys >= 0.95)) or near
            if not copy:
                out.append(r)
        return pd.DataFrame(out)[names]

    return s.groupBy(*by).applyInPandas(kept, s.schema)


def shuffled(e: DataFrame, seed: int) -> DataFrame:
    """A null model: the second ends of eligible edges in another order, within each group of edges; loops are left out."""
    good = stored(e.where("eligible"), "eligible")
    a = S.numbered(good, ["program_j"], [F.col("edge_key")], "p")
    b = S.numbered(good.select("program_j", F.col("j").alias("to"), F.xxhash64(F.lit(seed), "j").alias("_h")), ["program_j"], [F.col("_h"), F.col("to")], "p").drop("_h")
    return a.join(b, ["program_j", "p"]).where("i <> to").withColumn("j", F.col("to")).drop("p", "to").withColumn("edge_key", X.unordered_key("i", "j", "||")).dropDuplicates(["edge_key"])


def _named(run: Column, c: str) -> Column:
    """A domain's name in a rearranged graph: seven characters tell the graph, which _PLAIN leaves out."""
    return F.concat_ws("#", F.lpad(run.cast("string"), 6, "0"), c)


def dealt(e: DataFrame, iterations: int, seed: int) -> DataFrame:
    """iterations graphs of the eligible edges of e in one table, told apart by the column iteration and by a prefix of their
    domains' names, as rearranged() has them.

    In each the second ends of all eligible edges are dealt anew over these edges, with their programs. Edges that become
    loops go, and of edges that become one the one with the least old key stays. The order comes from hashes, so reruns are
    equal. Edges are numbered by ranges, so no task holds a graph's. Domains have numbers too, in the order of names.
    """
    good = S.numbered(e.where("eligible").withColumn("_all", F.lit(0)), ["_all"], [F.col("edge_key")], "_at").drop("_all")
    names = good.select(F.lit(0).alias("_all"), F.explode(F.array("i", "j")).alias("_name")).distinct()
    names = stored(S.numbered(names, ["_all"], [F.col("_name")], "_number").drop("_all"), "names")
    for c, number in zip(("i", "j"), _NUMBERS, strict=True):
        good = good.join(names.withColumnsRenamed({"_name": c, "_number": number}), c)
    good = stored(good, "eligible")
    ends = _runs(good.select(F.col("j").alias("to"), F.col("program_j").alias("to_program"), F.col(_NUMBERS[1]).alias("to_number"), "edge_key"), iterations).withColumn("_h", F.xxhash64(F.lit(seed), "iteration", "edge_key"))
    ends = S.numbered(ends, ["iteration"], [F.col("_h"), F.col("edge_key")], "_at").drop("_h", "edge_key")
    out = ends.join(good.drop("j", "program_j", _NUMBERS[1], *_KEYS), "_at").where("i <> to").withColumnsRenamed({"to": "j", "to_program": "program_j", "to_number": _NUMBERS[1]})
    out = out.withColumns({"_a": F.least(*_NUMBERS), "_b": F.greatest(*_NUMBERS)})
    out = S.top_k(out, ["iteration", "_a", "_b"], ["_at"], 1, "_first").drop("_first", "_a", "_b", "_at")  # numbered by old keys
    return out.withColumns({c: _named(F.col("iteration"), c) for c in ("i", "j")})


#: What prepared() adds.
_KEYS = ("edge_key", "pair_key", "cross", "eligible", "seed_score")


def _runs(e: DataFrame, iterations: int) -> DataFrame:
    every = F.sequence(F.lit(0), F.lit(max(1, iterations) - 1))
    return e.withColumn("iteration", F.explode(every)).where(F.col("iteration") < iterations)


def rearranged(e: DataFrame, iterations: int, seed: int) -> DataFrame:
    """The graphs that dealt() makes with the other edges of e, which stay as they are in each."""
    rest = _runs(e.where("NOT eligible").drop(*_KEYS), iterations)
    return dealt(e, iterations, seed).drop(*_NUMBERS).unionByName(rest.withColumns({c: _named(F.col("iteration"), c) for c in ("i", "j")}))


def random_baseline(e: DataFrame, observed: DataFrame, iterations: int = 24, seed: int = 3024, overlap: float = 0.50,
                    backbone: int = 1, programs: int = 1, least: float = 0.70, every: bool = False) -> DataFrame:
    """observed with random_rate, non_random_score and random_passed: how often rearranged graphs have a structure alike.

    e is prepared, observed are structures that pass the basic filter. A rearranged structure that passes (any, with every) is alike where
    the Jaccard of the backbones' program pairs is overlap or more, and the counts of backbone edges and of programs
    differ by no more than given. All iterations grow at once, as they are components of one table. That has the edges that
    are dealt; the others, the same in all iterations, only come to the regions in which structures grow.
    """
    x = stored(prepared(stored(dealt(e, iterations, seed), "dealt"), ("iteration",)), "rearranged")
    found = structures(x, stored(seeds(x, by=("iteration",)), "seeds"), rest=e.where("NOT eligible"))
    found = found if every else basic_filter(found).where("passed")

    def tokens(s: DataFrame, name: str, *keys) -> DataFrame:
        pairs = F.filter(F.split("pairs", ";"), lambda p: p != "")
        edges = F.size(F.filter(F.split("backbone_keys", ";"), lambda k: k != ""))
        s = s.select(*keys, F.array_distinct(pairs).alias("p"), F.struct(F.size(F.array_distinct(pairs)).alias("pairs"), edges.alias("edges"), F.col("program_count").alias("programs")).alias(name))
        return s.select("*", F.explode("p").alias("token")).drop("p")

    o = stored(observed, "observed")
    a = tokens(o, "a", "component", "pattern")
    b = tokens(stored(found, "random"), "b", F.substring_index("component", "#", 1).alias("iteration"), F.col("pattern").alias("other"))
    met = a.join(b, "token").groupBy("component", "pattern", "iteration", "other").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.count(F.lit(1)).alias("n"))
    alike = met.where(
        (F.col("n") / (F.col("a.pairs") + F.col("b.pairs") - F.col("n")) >= overlap) & (F.abs(F.col("a.edges") - F.col("b.edges")) <= backbone)
        & (F.abs(F.col("a.programs") - F.col("b.programs")) <= programs)
    )
    hits = alike.groupBy("component", "pattern").agg(F.count_distinct("iteration").alias("_hits"))
    o = o.join(hits, ["component", "pattern"], "left").withColumn("random_rate", F.coalesce("_hits", F.lit(0)) / F.lit(float(max(1, iterations)))).drop("_hits")
    return o.withColumn("non_random_score", X.clamp01(1 - F.col("random_rate"))).withColumn("random_passed", F.col("non_random_score") >= least)
