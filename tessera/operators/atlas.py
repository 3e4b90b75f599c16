"""Profiles of domains and niches, the niche assembly matrix, heads by axis, stage diagnostics and matched labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.functions import stats as S
from tessera.operators.profiles import ROLES

#: The order of role axes in strips and anchors.
STRIP_ROLES = ("scaffold_like", "interface_like", "node_like", "companion_like")


def _saturating(x, scale: Column) -> Column:
    return X.clamp01(1 - F.exp(-F.greatest(x, F.lit(0.0)) / scale))


def domain_profiles(domains: DataFrame, programs: DataFrame, components: list[str]) -> DataFrame:
    """One row per domain: the scores of its program on each axis, adjusted by the domain's own shape, and a confidence.

    domains are (sample, domain, program, qc_pass, spots, density, boundary_ratio, elongation, pieces, reliability,
    mixed), programs (sample, program, confidence, the component axes, the four roles). Nulls count as 0, pieces as 1.
    A domain whose program has no row has 0 on every axis. Scales are upper quartiles over the domains of a sample.
    """
    numbers = ("spots", "density", "boundary_ratio", "elongation", "reliability", "mixed")
    d = domains.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers})
    d = d.withColumns({"pieces": F.coalesce(F.col("pieces").cast("double"), F.lit(1.0)), "qc_pass": F.coalesce("qc_pass", F.lit(False))})
    upper = lambda c, least: F.greatest(F.percentile(c, F.lit(0.75)), F.lit(least))
    scales = d.groupBy("sample").agg(
        upper("spots", 1.0).alias("_spots"), upper("density", 1e-6).alias("_density"),
        upper("boundary_ratio", 1e-6).alias("_boundary"), upper("elongation", 1.5).alias("_elongation"),
    )
    axes = [*components, *ROLES]
    source = programs.select("sample", "program", F.col("confidence").alias("source_confidence"), *axes)
    d = d.join(scales, "sample").join(source, ["sample", "program"], "left")
    d = d.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("source_confidence", *axes)})
    d = d.withColumns({
        "size_support": _saturating(F.col("spots"), F.col("_spots")),
        "compact_support": _saturating(F.col("density"), F.col("_density")),
        "boundary_support": _saturating(F.col("boundary_ratio"), F.col("_boundary")),
        "elongated_support": X.clamp01(F.greatest(F.col("elongation") - 1, F.lit(0.0)) / F.greatest(F.col("_elongation") - 1, F.lit(1e-6))),
        "mixed": X.clamp01("mixed"),
    })
    size, compact, reliable, mixed = (F.col(c) for c in ("size_support", "compact_support", "reliability", "mixed"))
    confidence = 0.45 * F.col("source_confidence") + 0.35 * reliable + 0.10 * size + 0.10 * compact
    own = {
        "scaffold_like": 0.70 * F.col("scaffold_like") + 0.15 * size + 0.10 * compact + 0.05 * reliable,
        "interface_like": 0.65 * F.col("interface_like") + 0.15 * F.col("boundary_support") + 0.15 * mixed + 0.05 * F.col("elongated_support"),
        "node_like": 0.70 * F.col("node_like") + 0.15 * X.clamp01(1 - size) + 0.10 * compact + 0.05 * X.clamp01(1 / F.greatest("pieces", F.lit(1.0))),
        "companion_like": 0.70 * F.col("companion_like") + 0.15 * X.clamp01(1 - 0.7 * size) + 0.10 * (1 - mixed) + 0.05 * (1 - size),
    }
    eligible = F.col("qc_pass") & (F.trim(F.coalesce("program", F.lit(""))) != "")
    return d.select(
        "sample", "domain", "program", "qc_pass", eligible.alias("eligible"), "spots", "source_confidence",
        "size_support", "compact_support", "boundary_support", "elongated_support", X.clamp01(confidence).alias("confidence"),
        *[X.clamp01(F.col(c) * (0.97 + 0.03 * reliable)).alias(c) for c in components], *[X.clamp01(own[c]).alias(c) for c in ROLES],
    )


def niche_profiles(niches: DataFrame, members: DataFrame, domains: DataFrame, edges: DataFrame, components: list[str],
                   supported: float = 0.15) -> DataFrame:
    """One row per niche with members: how it is organised, its scores on each axis, its mixes and a confidence.

    niches are (sample, niche, member_count, backbone_count, program_count, contact, overlap, proximity, reliability,
    interaction, passed), members (sample, niche, domain, backbone), domains as from domain_profiles, edges (sample, i, j,
    strength) once per pair. Members weigh by spots and confidence, backbone ones 1.15 times; alike where all weigh 0.
    """
    axes = [*components, *ROLES]
    m = members.join(domains.select("sample", "domain", "spots", "confidence", *axes), ["sample", "domain"], "left")
    m = m.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("spots", "confidence", *axes)})
    weight = F.greatest("spots", F.lit(0.0)) * F.greatest("confidence", F.lit(0.0))
    m = m.withColumn("_w", weight * F.when(F.col("backbone"), 1.15).otherwise(1.0))
    sums = [a for c in axes for a in (F.sum(F.col("_w") * F.col(c)).alias("_w" + c), F.avg(c).alias("_m" + c))]
    over = [a for c in components for a in (
        F.sum(F.when(F.col(c) >= supported, F.col("_w")).otherwise(0.0)).alias("_ws" + c),
        F.avg(F.when(F.col(c) >= supported, 1.0).otherwise(0.0)).alias("_ms" + c),
    )]
    held = m.groupBy("sample", "niche").agg(
        F.sum("_w").alias("_w"), F.max("_w").alias("_top"), F.count(F.lit(1)).alias("_n"), F.avg("confidence").alias("_confidence"), *sums, *over,
    )
    pairs = members.select("sample", "niche", "domain").distinct()
    inner = edges.join(pairs.withColumnRenamed("domain", "i"), ["sample", "i"]).join(pairs.withColumnRenamed("domain", "j"), ["sample", "niche", "j"])
    tied = inner.groupBy("sample", "niche").agg(F.count(F.lit(1)).alias("member_edges"), F.avg("strength").alias("mean_strength"))
    n = niches.join(held, ["sample", "niche"]).join(tied, ["sample", "niche"], "left")
    n = n.withColumns({"member_edges": F.coalesce("member_edges", F.lit(0)), "mean_strength": F.coalesce("mean_strength", F.lit(0.0))})
    n = n.withColumns({c: X.clamp01(c) for c in ("contact", "overlap", "proximity")})
    count, some = F.col("member_count").cast("double"), F.col("_w") > 0
    shared = lambda a, b: F.when(some, F.col(a) / F.greatest("_w", F.lit(1e-8))).otherwise(b)
    n = n.withColumns({
        "density": F.when(count > 1, X.clamp01(F.col("member_edges") / F.greatest(count * (count - 1) / 2, F.lit(1.0)))).otherwise(0.0),
        "backbone_fraction": X.clamp01(F.col("backbone_count") / F.greatest(count, F.lit(1.0))),
        "multi_program": F.when(count > 0, X.clamp01(F.col("program_count") / F.greatest(count, F.lit(1.0)))).otherwise(0.0),
        "dominant_share": shared("_top", 1 / F.col("_n")),
    }).withColumn("balance", X.clamp01(1 - F.col("dominant_share")))
    n = n.withColumn("_tie", X.clamp01(0.6 * X.clamp01("mean_strength") + 0.4 * F.col("density")))
    n = n.withColumns({
        "cohesion": X.clamp01(0.40 * F.col("_tie") + 0.25 * F.col("backbone_fraction") + 0.20 * X.clamp01("reliability") + 0.15 * X.saturating(count, 5.0)),
        "interface": X.clamp01(0.40 * F.col("contact") + 0.20 * F.col("proximity") + 0.20 * F.col("balance") + 0.20 * F.col("multi_program")),
        "node": X.clamp01(0.45 * F.col("dominant_share") + 0.30 * X.clamp01(1 - X.saturating(count, 4.0)) + 0.25 * X.clamp01(1 - F.col("density"))),
        "companion": X.clamp01(0.35 * F.col("balance") + 0.25 * X.clamp01(1 - F.col("backbone_fraction")) + 0.20 * X.clamp01(1 - F.col("_tie")) + 0.20 * F.col("overlap")),
        "niche_confidence": X.clamp01(0.45 * F.col("interaction") + 0.30 * F.col("_confidence") + 0.15 * X.saturating(count, 6.0) + 0.10 * X.clamp01("reliability")),
    })
    signal = dict(zip(("scaffold_like", "interface_like", "node_like", "companion_like"), ("cohesion", "interface", "node", "companion")))
    base = {c: shared("_w" + c, F.col("_m" + c)) for c in axes}
    spread = {c: X.clamp01(shared("_ws" + c, F.col("_ms" + c))) for c in components}
    boost = {c: X.clamp01(0.55 * spread[c] + 0.25 * F.col("balance") + 0.20 * F.col("multi_program")) for c in components}
    n = n.withColumns({c: X.clamp01(0.82 * base[c] + 0.18 * base[c] * boost[c]) for c in components} | {c: X.clamp01(0.78 * base[c] + 0.22 * F.col(signal[c])) for c in ROLES})

    def mix(of: list[str]) -> tuple[Column, Column]:
        """The axes from the strongest on, and the evenness of their strengths."""
        best = F.transform(F.array_sort(F.array(*[F.struct((-F.col(c)).alias("s"), F.lit(c).alias("a")) for c in of])), lambda x: x["a"])
        total = F.greatest(sum((F.col(c) for c in of), F.lit(0.0)), F.lit(1e-8))
        part = [F.when(F.col(c) > 0, -F.col(c) / total * F.log(F.col(c) / total)).otherwise(0.0) for c in of]
        return best, X.clamp01(sum(part, F.lit(0.0)) / F.log(F.lit(float(max(2, len(of))))))

    (component, component_mix), (role, role_mix) = mix(components), mix(list(ROLES))
    return n.select(
        "sample", "niche", "member_count", "program_count", "member_edges", "mean_strength", "density", "backbone_fraction", "dominant_share", "balance",
        "cohesion", "interface", "node", "companion", "niche_confidence", (F.col("passed") & (F.col("niche_confidence") > 0)).alias("eligible"), *axes,
        component_mix.alias("component_diversity"), role_mix.alias("role_diversity"),
        F.get(component, F.lit(0)).alias("dominant_component"), F.coalesce(F.get(component, F.lit(1)), F.lit("")).alias("secondary_component"),
        F.get(role, F.lit(0)).alias("dominant_role"), F.get(role, F.lit(1)).alias("secondary_role"),
    )


def contact_hint(first, second, programs, pairs, cross) -> Column:
    """How the parts of a niche touch, from its role pairs and counts."""
    first, second, programs, pairs, cross = (F.col(c) for c in (first, second, programs, pairs, cross))
    # fixed values: names and thresholds of the kinds of contact
    return (
        F.when(first.contains("scaffold_like") & first.contains("interface_like"), "scaffold_attached_interface").when(first.contains("node_like"), "node_focal")
        .when((pairs >= 4) | (cross >= 6), "mixed_mesh").when((programs <= 2) & (pairs <= 1), "compact_contact")
        .when((second != "") & (second == first), "parallel_contact").when(programs >= 4, "diffuse_contact").otherwise("edge_contact")
    )


def assembly_matrix(niches: DataFrame, members: DataFrame, domains: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per niche: strips of its programs and roles, its two commonest role pairs and a hint of its contacts.

    niches are (sample, niche, member_count, confidence, cohesion, pair_count, cross_edges), members (sample, niche, domain,
    program), domains (sample, domain, program, the four roles), pairs (sample, niche, left, right) of backbone programs.
    Programs stand in a strip by their first domain in the sample; a program's role is the first of its highest means, which
    count to nine digits, as the last ones of a sum depend on its order.
    Shares have three digits, ties up.
    """
    order = domains.groupBy("sample", "program").agg(F.min("domain").alias("first"))
    order = order.groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "program"))), lambda x: x["program"]).alias("order"))
    m = members.join(domains.select("sample", "domain", *STRIP_ROLES), ["sample", "domain"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in STRIP_ROLES})
    by_program = m.groupBy("sample", "niche", "program").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in STRIP_ROLES])
    mean = lambda c: F.round(F.col(c) / F.col("n"), 9)
    anchor = F.coalesce(*[F.when(mean(c) == F.greatest(*map(mean, STRIP_ROLES)), F.lit(c)) for c in STRIP_ROLES])
    by_program = by_program.withColumn("anchor", anchor)
    roles = F.create_map(*[x for c in STRIP_ROLES for x in (F.lit(c), F.round(F.round(F.sum(c) / F.sum("n"), 9), 3))])  # whatever the order of the sum
    whole = by_program.groupBy("sample", "niche").agg(
        F.map_from_entries(F.collect_list(F.struct("program", "n"))).alias("counts"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("programs"), roles.alias("roles"),
    )
    of = by_program.select("sample", "niche", "program", "anchor")
    label = F.concat_ws("↔", F.least("a", "b"), F.greatest("a", "b"))
    named = pairs.join(of.toDF("sample", "niche", "left", "a"), ["sample", "niche", "left"]).join(of.toDF("sample", "niche", "right", "b"), ["sample", "niche", "right"])
    seen = named.groupBy("sample", "niche", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    ranked = seen.groupBy("sample", "niche").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "label"))).alias("ranked"))  # ten labels at most
    n = niches.join(whole, ["sample", "niche"], "left").join(ranked, ["sample", "niche"], "left").join(order, "sample", "left")
    at = lambda i: F.coalesce(F.get("ranked", F.lit(i))["label"], F.lit(""))
    n = n.withColumns({"dominant_pair": at(0), "secondary_pair": at(1), "programs": F.coalesce("programs", F.lit(0))})
    share = lambda p: F.coalesce(F.try_element_at("counts", p) / F.col("total"), F.lit(0.0))
    strip = F.array_join(F.transform("order", lambda p: F.concat(p, F.lit("="), F.format_string("%.3f", F.round(share(p), 3)))), ";")
    n = n.withColumn("roles", F.coalesce("roles", F.create_map(F.lit(""), F.lit(0.0))))
    return n.select(
        "sample", "niche", "member_count", "confidence", "cohesion", "programs", F.coalesce(strip, F.lit("")).alias("program_strip"),
        X.strip("roles", list(STRIP_ROLES)).alias("role_strip"), "dominant_pair", "secondary_pair",
        contact_hint("dominant_pair", "secondary_pair", "programs", "pair_count", "cross_edges").alias("contact_hint"),
    )


def top_by_axis(profiles: DataFrame, axes: list[str], weight: str, top: int) -> DataFrame:
    """(sample, axis, rank, object, score, contribution): the objects that add most to each axis of a sample."""
    p = profiles.unpivot(["sample", "object", "confidence", weight] if weight != "confidence" else ["sample", "object", "confidence"], axes, "axis", "score")
    p = p.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("contribution", F.col("score") * F.coalesce(weight, F.lit(0.0)))
    p = S.top_k(p, ["sample", "axis"], [F.desc("contribution"), F.desc("score"), F.desc("confidence"), "object"], top)
    return p.select("sample", "axis", "rank", "object", "score", "contribution")


def top_pairs(pairs: DataFrame, top: int = 5) -> DataFrame:
    """The first few pairs of each pair of samples by similarity, then by its parts, then by name."""
    order = [F.desc("similarity"), F.desc("component_similarity"), F.desc("role_similarity"), "object_a", "object_b"]
    return S.top_k(pairs, ["sample_a", "sample_b"], order, top)


def stage_diagnostics(candidate: DataFrame, refined: DataFrame, refinement: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """Programs of any of three stages: in which they exist, what refinement did, both measures and how they moved.

    candidate and refined are (key, measures), refinement (key, status, pruned, before, after). A measure that one stage
    has not is null there, and so is its delta. Keys stand once in each table.
    """
    def named(df: DataFrame, stage: str) -> DataFrame:
        return df.select(key, F.lit(True).alias(f"{stage}_exists"), *[F.col(c).alias(f"{stage}_{c}") for c in measures])

    both = named(candidate, "candidate").join(named(refined, "refined"), key, "full")
    every = both.join(refinement.select(key, "status", "pruned", "before", "after"), key, "full")
    return every.select(
        key, *[F.coalesce(f"{s}_exists", F.lit(False)).alias(f"{s}_exists") for s in ("candidate", "refined")],
        F.coalesce("status", F.lit("missing")).alias("status"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pruned", "before", "after")],
        *[f"{s}_{c}" for c in measures for s in ("candidate", "refined")], *[(F.col(f"refined_{c}") - F.col(f"candidate_{c}")).alias(f"delta_{c}") for c in measures],
    )


def assignment(gain: np.ndarray) -> list[int]:
    """The column of each row, each once, with the largest sum of whole-numbered gains; of equal ones the first in order.

    Rows are added one by one, each along the shortest path of reduced costs to a free column; the duals then mark the cells
    that any best assignment can use, and rows in turn take the first of these that leaves the others one.
    """
    cost = int(gain.max(initial=0)) - gain.astype(np.int64)
    n = len(cost)
    of_row, of_column = np.full(n, -1), np.full(n, -1)
    u, v = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for start in range(n):
        far, last, done = np.full(n, np.iinfo(np.int64).max), np.full(n, -1), np.zeros(n, bool)
        row, base, end = start, 0, -1
        while end < 0:
            reach = base + cost[row] - u[row] - v
            nearer = ~done & (reach < far)
            far[nearer], last[nearer] = reach[nearer], row
            c = int(np.where(done, np.iinfo(np.int64).max, far).argmin())
            done[c], base = True, far[c]
            row, end = int(of_column[c]), c if of_column[c] < 0 else -1
        u[start] += base
        for c in np.flatnonzero(done):
            v[c] -= base - far[c]
            if of_column[c] >= 0:
                u[of_column[c]] += base - far[c]
        c = end
        while c >= 0:
            row = int(last[c])
            of_column[c], of_row[row], c = row, c, int(of_row[row])
    tight = cost - u[:, None] - v[None] == 0

    def moved(row: int, column: int, fixed: int) -> bool:
        """Gives row the column, if the row that has it finds another way to the one that becomes free."""
        free, holder = int(of_row[row]), int(of_column[column])
        came, queue = {free: -1}, [free]  # columns reached from the free one, and the row that would take each
        for c in queue:
            for r in np.flatnonzero(tight[:, c]):
                d = int(of_row[r])
                if r > fixed and d not in came:
                    came[d] = c
                    queue.append(d)
        if column not in came:
            return False
        c, r = column, holder
        while c != free:
            to = came[c]
            of_row[r], nxt = to, int(of_column[to])
            of_column[to], c, r = r, to, nxt
        of_row[row], of_column[column] = column, row
        return True

    for row in range(n):
        for column in np.flatnonzero(tight[row]):
            if column == of_row[row] or (of_column[column] > row and moved(row, int(column), row)):
                break
    return of_row.tolist()


def matched_labels(labels: DataFrame, k: int) -> DataFrame:
    """Adds matched: label_b renamed to the values of label_a so that most rows agree; both run from 0 to k - 1.

    The table of counts, k by k, comes to the driver.
    """
    n = np.zeros((k, k), np.int64)
    for x in labels.groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("n")).collect():
        n[x.label_b, x.label_a] = x.n
    return labels.withColumn("matched", F.array(*[F.lit(a) for a in assignment(n)])[F.col("label_b").cast("int")])


def recommended_k(scores: DataFrame) -> DataFrame:
    """The k with the best improvement less its penalty, three with a bonus of 0.02; the smallest of equal ones."""
    s = scores.withColumn("score", F.col("improvement") - F.col("penalty") + F.when(F.col("k") == 3, 0.02).otherwise(0.0))
    return s.orderBy(F.desc("score"), "k").limit(1).select("k", "score")
