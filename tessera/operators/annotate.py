"""Labels and interpretations on top of domains, niches and programs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.functions import stats as S


def morphology(shapes: DataFrame, leaf: float = 0.25, cut: float = 0.25, long: float = 2.5, loose: float = 0.6, thin: float = 0.3, compact: float = 0.2) -> DataFrame:
    """Adds morphology, the first rule that holds, and hits, all of them; shapes have components, leaf_ratio, articulation, elongation, boundary_ratio, density, compactness."""
    diffuse = (F.col("density") <= thin) & ((F.col("boundary_ratio") >= loose) | (F.col("compactness") <= compact))
    rules = [("fragmented", F.col("components") >= 2), ("branching", (F.col("leaf_ratio") >= leaf) | (F.col("articulation") >= cut)), ("elongated", F.col("elongation") >= long), ("diffuse", diffuse)]
    hits = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))
    return shapes.withColumn("_h", hits).withColumn("morphology", F.coalesce(F.get("_h", F.lit(0)), F.lit("compact"))).withColumn("hits", F.array_join("_h", "|")).drop("_h")


def propagated_terms(domains: DataFrame, terms: DataFrame, top: int = 3) -> DataFrame:
    """(domain, terms, best): a domain takes the leading terms of its program; one without any is unannotated."""
    t = S.top_k(terms, ["program"], [F.desc("score"), "term"], top)
    names = t.groupBy("program").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), "|").alias("terms"), F.max("score").alias("best"))
    return domains.select("domain", "program").join(names, "program", "left").select("domain", F.coalesce("terms", F.lit("unannotated")).alias("terms"), F.coalesce("best", F.lit(0.0)).alias("best"))


def interfaces(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(niche, interface, n, strength, share): pairs of labels in contact inside a niche.

    edges are (i, j, strength), members (niche, domain, label). Both ends must be members of the same niche.
    """
    a = members.select("niche", F.col("domain").alias("i"), F.col("label").alias("li"))
    b = members.select("niche", F.col("domain").alias("j"), F.col("label").alias("lj"))
    e = edges.join(a, "i").join(b, ["niche", "j"]).groupBy("niche", X.unordered_key("li", "lj", " - ").alias("interface")).agg(F.count(F.lit(1)).alias("n"), F.sum("strength").alias("strength"))
    return e.withColumn("share", F.col("strength") / F.sum("strength").over(Window.partitionBy("niche")))


def composition(values: DataFrame, by: str, label: str, most: int = 3) -> DataFrame:
    """(by, text): the commonest labels with their shares, ties by name."""
    n = values.groupBy(by, label).agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(by)))
    t = S.top_k(n, [by], [F.desc("n"), label], most)
    part = F.struct("rank", F.format_string("%s:%.2f", label, "p").alias("t"))
    return t.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), ";").alias("text"))


def confounders(programs: DataFrame, genes: DataFrame, blacklisted, share: float = 0.3) -> DataFrame:
    """(program, blacklist_share, housekeeping_share, flags): programs that listed or ubiquitous genes carry."""
    j = programs.join(genes, "gene")
    s = j.groupBy("program").agg(F.sum(F.when(blacklisted, F.col("weight")).otherwise(0.0)).alias("b"), F.sum(F.when(F.col("support_share") >= 0.8, F.col("weight")).otherwise(0.0)).alias("h"), F.sum("weight").alias("w"))
    s = s.select("program", (F.col("b") / F.col("w")).alias("blacklist_share"), (F.col("h") / F.col("w")).alias("housekeeping_share"))
    return s.withColumn("flags", F.array_join(X.reasons(blacklist=F.col("blacklist_share") >= share, housekeeping=F.col("housekeeping_share") >= share), "|"))


def ancestors(parents: DataFrame, rounds: int = 64) -> DataFrame:
    """(term, ancestor) with the term itself, over (term, parent); a cycle ends when nothing new is found."""
    from tessera.operators.graph import stored

    nodes = parents.select("term").unionByName(parents.select(F.col("parent").alias("term"))).distinct()
    found = stored(nodes.withColumn("ancestor", F.col("term")), "ancestors")
    n = found.count()
    for _ in range(rounds):
        step = found.join(parents.withColumnRenamed("term", "ancestor"), "ancestor").select("term", F.col("parent").alias("ancestor"))
        found = stored(found.unionByName(step).distinct(), "ancestors")
        if (m := found.count()) == n:
            break
        n = m
    return found


def linkage(sim: np.ndarray, least: float) -> list[int]:
    """For each item of a small matrix the first one of its group: average linkage, cut where the mean similarity falls under least.

    By chains of nearest neighbours: a chain goes on to the most similar group until two are each other's, which merge. With
    averages that gives the same tree as taking the best pair of all each time, in quadratic time.
    """
    n = len(sim)
    sim, size, root, alive = sim.astype(np.float64), np.ones(n), np.arange(n), np.ones(n, bool)
    np.fill_diagonal(sim, -np.inf)
    chain: list[int] = []
    for _ in range(n - 1):
        while True:
            if not chain:
                chain = [int(np.flatnonzero(alive)[0])]
            own = chain[-1]
            near = int(sim[own].argmax())
            if len(chain) > 1 and sim[own, chain[-2]] >= sim[own, near]:
                near = chain[-2]
                break
            chain.append(near)
        a, b = sorted(chain[-2:])
        del chain[-2:]
        if sim[a, b] >= least:
            root[root == b] = a
        # what merges below the cut keeps its groups apart, but is one group for the rest of the tree
        mixed = (size[a] * sim[a] + size[b] * sim[b]) / (size[a] + size[b])
        sim[a], sim[:, a] = mixed, mixed
        sim[a, a], sim[b], sim[:, b], alive[b] = -np.inf, -np.inf, -np.inf, False
        size[a] += size[b]
    return root.tolist()


#: Similarities are whole numbers of this part, so sums of them are exact and equal means tie.
PART = 1_000_000_000


def _overlaps(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """pairs (source, a, b) of groups with total, the similarities of all their terms in whole parts; members are (source, term, group, items)."""
    left, right = (members.select("source", F.col("group").alias(c), F.col("items").alias(f"items_{c}")) for c in "ab")
    m = F.size(F.array_intersect("items_a", "items_b"))
    one = F.round(m / (F.size("items_a") + F.size("items_b") - m) * PART).cast("long")
    return pairs.join(left, ["source", "a"]).join(right, ["source", "b"]).groupBy("source", "a", "b").agg(F.sum(one).alias("total"))


def alike(members: DataFrame, least: float) -> DataFrame:
    """(source, a, b, total): pairs of terms of one source, a before b, whose sets have a Jaccard of least or more, in whole parts.

    members are (source, term, group, items), items distinct and the rare ones first. Two sets as similar as that meet in the
    first items of both: what comes after the place where they first meet has to hold the rest of what they must share.
    """
    if least <= 0:
        raise ValueError("every pair is alike")
    near = least - 2 / PART
    p = members.select("source", "term", F.size("items").alias("n"), F.posexplode(F.expr(f"slice(items, 1, size(items) - int(ceil({near!r} * size(items) - 1e-6)) + 1)")).alias("i", "item"))
    x, y = (p.select("source", "item", *[F.col(c).alias(f"{c}_{k}") for c in ("term", "n", "i")]) for k in "ab")
    left = F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b"))
    met = x.join(y, ["source", "item"]).where((F.col("term_a") < F.col("term_b")) & (left >= near / (1 + near) * (F.col("n_a") + F.col("n_b")) - 1e-6))
    found = _overlaps(met.select("source", F.col("term_a").alias("a"), F.col("term_b").alias("b")).distinct(), members)
    return found.where(F.col("total") >= round(least * PART))


def linked(sets: DataFrame, least: float) -> DataFrame:
    """(source, term, group): average linkage of the terms of a source by the Jaccard of their sets, cut where the mean falls
    under least. sets are (source, term, item); a group is named by its first term.

    The best pair merges first, of equal ones that with the first names. Pairs that are each other's best merge in one round,
    which gives the same tree, as a merged group is never nearer to a third than both its halves were. Only groups that have
    two terms alike can merge, so means are kept for those alone; what a merged group lacks for its mean is counted then.
    """
    from tessera.operators.graph import stored

    often = sets.groupBy("item").agg(F.count_distinct("term").alias("often"))
    items = F.transform(F.array_sort(F.collect_set(F.struct("often", "item"))), lambda x: x["item"])
    members = stored(sets.join(often, "item").groupBy("source", "term").agg(items.alias("items")).select("source", "term", F.col("term").alias("group"), "items"), "members")
    links = stored(alike(members, least), "links")
    cut = round(least * PART)
    while True:
        n = members.groupBy("source", "group").agg(F.count(F.lit(1)).alias("n"))
        sized = links.join(n.select("source", F.col("group").alias("a"), F.col("n").alias("na")), ["source", "a"]).join(n.select("source", F.col("group").alias("b"), F.col("n").alias("nb")), ["source", "b"])
        links = stored(sized.withColumn("live", F.col("total") >= cut * F.col("na") * F.col("nb")), "sized")
        mean = (F.col("total") / (F.col("na") * F.col("nb"))).alias("mean")
        live = links.where("live")
        ways = live.select("source", F.col("a").alias("own"), F.col("b").alias("other"), mean).unionByName(live.select("source", F.col("b").alias("own"), F.col("a").alias("other"), mean))
        best = ways.groupBy("source", "own").agg(F.min(F.struct((-F.col("mean")).alias("m"), "other"))["other"].alias("other"))
        back = best.select("source", F.col("other").alias("own"), F.col("own").alias("other"))
        merges = stored(best.join(back, ["source", "own", "other"]).where("own < other").select("source", F.col("own").alias("to"), F.col("other").alias("group")), "merges")
        if merges.isEmpty():
            return members.select("source", "term", "group")
        to = {c: merges.select("source", F.col("group").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab"}
        moved = links.join(to["a"], ["source", "a"], "left").join(to["b"], ["source", "b"], "left")
        ends = [F.coalesce(f"to_{c}", c).alias(f"to_{c}") for c in "ab"]
        moved = moved.select("source", "a", "b", "total", "live", *ends).where("to_a <> to_b")
        moved = moved.select("source", "a", "b", "total", "live", F.least("to_a", "to_b").alias("u"), F.greatest("to_a", "to_b").alias("v"))
        moved = stored(moved, "moved")
        # pairs of parts that a wanted pair of groups has and that no link holds
        wanted = moved.where("live").select("source", "u", "v").distinct()
        parts = merges.select("source", F.col("to").alias("whole"), F.explode(F.array("to", "group")).alias("part"))
        halves = wanted
        for whole, part in (("u", "pu"), ("v", "pv")):
            halves = halves.join(parts.select("source", F.col("whole").alias(whole), F.col("part").alias(part)), ["source", whole], "left").withColumn(part, F.coalesce(part, whole))
        halves = halves.select("source", "u", "v", F.least("pu", "pv").alias("a"), F.greatest("pu", "pv").alias("b"))
        lacking = stored(halves.join(moved.select("source", "a", "b"), ["source", "a", "b"], "left_anti"), "lacking")
        more = lacking.join(_overlaps(lacking.select("source", "a", "b"), members), ["source", "a", "b"]).select("source", "u", "v", "total")
        known = moved.join(wanted, ["source", "u", "v"], "left_semi").select("source", "u", "v", "total")
        links = known.unionByName(more).groupBy("source", F.col("u").alias("a"), F.col("v").alias("b")).agg(F.sum("total").alias("total"))
        members = stored(members.join(merges, ["source", "group"], "left").select("source", "term", F.coalesce("to", "group").alias("group"), "items"), "members")


def scaling(distances: DataFrame, k: int = 2, most: int = 2000) -> list[tuple]:
    """Classical scaling of a small distance table (a, b, d): (name, coordinates) for each name; more than most is an error."""
    rows = distances.limit(most * most + 1).collect()
    names = sorted({r.a for r in rows} | {r.b for r in rows})
    if len(names) > most:
        raise ValueError(f"more than {most} names")
    at = {n: i for i, n in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    for r in rows:
        d[at[r.a], at[r.b]] = d[at[r.b], at[r.a]] = r.d
    centre = np.eye(len(names)) - 1 / max(1, len(names))
    values, vectors = np.linalg.eigh(-0.5 * centre @ (d**2) @ centre)
    top = np.argsort(values)[::-1][:k]
    out = vectors[:, top] * np.sqrt(np.maximum(values[top], 0))
    out *= np.where(out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])] < 0, -1, 1) if len(names) else 1
    return [(n, *map(float, out[i])) for n, i in at.items()]
