"""Registered queries over domain and niche profiles, assemblies, heads by axis, diagnostics and matched labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import atlas as A
from tessera.plans import basic
from tessera.sources import views as V

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_COMPONENTS = ["alpha", "beta"]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


#: The model's tables over customers: a customer is a domain, its segment the sample, its key modulo 23 the program.
_DOMAINS = {
    "sample": "c_mktsegment", "domain": "concat('D', c_custkey)", "program": "concat('P', c_custkey % 23)", "qc_pass": "c_acctbal > 0", "spots": "c_custkey % 37 + 1",
    "density": "c_custkey % 13 / 13.0D", "boundary_ratio": "c_custkey % 11 / 11.0D", "elongation": "1 + c_custkey % 7 / 4.0D", "pieces": "1 + c_custkey % 3",
    "reliability": "c_custkey % 17 / 17.0D", "mixed": "c_custkey % 5 / 5.0D",
}
_PROGRAMS = {
    "confidence": "p % 9 / 9.0D", "alpha": "p % 4 / 4.0D", "beta": "p % 6 / 6.0D", "scaffold_like": "p % 5 / 5.0D", "interface_like": "p % 7 / 7.0D",
    "node_like": "p % 3 / 3.0D", "companion_like": "p % 8 / 8.0D",
}
_NICHES = {
    "contact": "q % 5 / 5.0D", "overlap": "q % 3 / 3.0D", "proximity": "q % 4 / 4.0D", "reliability": "q % 6 / 6.0D", "interaction": "q % 7 / 7.0D", "passed": "q % 9 <> 0",
    "confidence": "q % 8 / 8.0D", "cohesion": "q % 4 / 4.0D", "cross_edges": "q % 8",
}


def r(c):
    """Six digits by way of nine, so that a sum a last bit below a tie rounds like the tie."""
    return basic.r(basic.r(c, 9))


def _round(x: str, name: str) -> str:
    """The same in DuckDB."""
    return f"round(({x})::DECIMAL(18, 9), 6)::DOUBLE AS {name}"


def _expr(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {c}" for c, e in columns.items()]


def _duck(columns: dict[str, str]) -> str:
    return ", ".join(_expr(columns)).replace("0D", "0::DOUBLE")


def _domains(spark, sf):
    return V.load(spark, sf, "customer").selectExpr(*_expr(_DOMAINS))


def _programs(spark, sf):
    """Programs of a sample, but for the last, so that its domains have none."""
    p = V.load(spark, sf, "customer").selectExpr("c_mktsegment AS sample", "c_custkey % 23 AS p").distinct().where("p <> 22")
    return p.selectExpr("sample", "concat('P', p) AS program", *_expr(_PROGRAMS))


def _members(spark, sf):
    c = V.load(spark, sf, "customer")
    one = c.selectExpr("c_mktsegment AS sample", "c_custkey % 40 AS q", "c_custkey")
    two = c.where("c_custkey % 5 = 0").selectExpr("c_mktsegment AS sample", "c_custkey * 7 % 40 AS q", "c_custkey")
    return one.unionByName(two).distinct().selectExpr(
        "sample", "q", "concat('N', q) AS niche", "concat('D', c_custkey) AS domain", "concat('P', c_custkey % 23) AS program", "c_custkey % 4 = 0 AS backbone",
    )


def _niches(members):
    n = members.groupBy("sample", "niche", "q").agg(F.count(F.lit(1)).alias("member_count"), F.count_if("backbone").alias("backbone_count"), F.count_distinct("program").alias("program_count"))
    return n.selectExpr("sample", "niche", "member_count", "backbone_count", "program_count", *_expr(_NICHES))


def _domain_profiles(spark, sf):
    return A.domain_profiles(_domains(spark, sf), _programs(spark, sf), _COMPONENTS)


_CLAMP = lambda x: f"greatest(0, least(1, {x}))"
_PROFILE = f"""WITH dm AS (SELECT {_duck(_DOMAINS)} FROM customer),
pg AS (SELECT sample, concat('P', p) AS program, {_duck(_PROGRAMS)} FROM (SELECT DISTINCT c_mktsegment AS sample, c_custkey % 23 AS p FROM customer) WHERE p <> 22),
sc AS (SELECT sample, greatest(quantile_cont(spots, 0.75), 1) AS s1, greatest(quantile_cont(density, 0.75), 1e-6) AS s2, greatest(quantile_cont(boundary_ratio, 0.75), 1e-6) AS s3,
  greatest(quantile_cont(elongation, 0.75), 1.5) AS s4 FROM dm GROUP BY 1),
jn AS (SELECT dm.*, coalesce(pg.confidence, 0) AS source_confidence, {", ".join(f"coalesce({c}, 0) AS _{c}" for c in list(_PROGRAMS)[1:])},
  1 - exp(-spots / s1) AS size_support, 1 - exp(-density / s2) AS compact_support, 1 - exp(-boundary_ratio / s3) AS boundary_support,
  {_CLAMP('greatest(elongation - 1, 0) / (s4 - 1)')} AS elongated_support FROM dm JOIN sc USING (sample) LEFT JOIN pg USING (sample, program)),
dp AS (SELECT *, {_CLAMP('0.45 * source_confidence + 0.35 * reliability + 0.10 * size_support + 0.10 * compact_support')} AS confidence,
  {_CLAMP('_alpha * (0.97 + 0.03 * reliability)')} AS alpha, {_CLAMP('_beta * (0.97 + 0.03 * reliability)')} AS beta,
  {_CLAMP('0.70 * _scaffold_like + 0.15 * size_support + 0.10 * compact_support + 0.05 * reliability')} AS scaffold_like,
  {_CLAMP('0.65 * _interface_like + 0.15 * boundary_support + 0.15 * mixed + 0.05 * elongated_support')} AS interface_like,
  {_CLAMP('0.70 * _node_like + 0.15 * (1 - size_support) + 0.10 * compact_support + 0.05 / pieces')} AS node_like,
  {_CLAMP('0.70 * _companion_like + 0.15 * (1 - 0.7 * size_support) + 0.10 * (1 - mixed) + 0.05 * (1 - size_support)')} AS companion_like FROM jn)"""
_AXES = [*_COMPONENTS, *A.ROLES]
_SHAPE = ["source_confidence", "size_support", "compact_support", "boundary_support", "elongated_support", "confidence"]


@query(f"{_PROFILE} SELECT sample, domain, program, qc_pass, qc_pass AS eligible, {', '.join(_round(c, c) for c in [*_SHAPE, *_AXES])} FROM dp")
def r13_domain_profiles(spark, sf):
    p = _domain_profiles(spark, sf)
    return p.select("sample", "domain", "program", "qc_pass", "eligible", *[r(c).alias(c) for c in [*_SHAPE, *_AXES]])


_MEMBERS = """, mb AS (SELECT sample, q, concat('N', q) AS niche, concat('D', k) AS domain, concat('P', k % 23) AS program, k % 4 = 0 AS backbone FROM (
  SELECT c_mktsegment AS sample, c_custkey % 40 AS q, c_custkey AS k FROM customer UNION SELECT c_mktsegment, c_custkey * 7 % 40, c_custkey FROM customer WHERE c_custkey % 5 = 0)),
nc AS (SELECT sample, niche, q, count(*) AS member_count, count(*) FILTER (backbone) AS backbone_count, count(DISTINCT program) AS program_count FROM mb GROUP BY 1, 2, 3)"""
_MIX = lambda of: f"(SELECT list(a ORDER BY s DESC, a) FROM (VALUES {', '.join(f'({c}, {chr(39)}{c}{chr(39)})' for c in of)}) v(s, a))"
_EVEN = lambda of: f"-({' + '.join(f'CASE WHEN {c} > 0 THEN {c} / ({chr(43).join(of)}) * ln({c} / ({chr(43).join(of)})) ELSE 0 END' for c in of)}) / ln({len(of)})"
_ORGANISED = ["mean_strength", "density", "backbone_fraction", "dominant_share", "balance", "cohesion", "interface", "node", "companion", "niche_confidence"]
_SIGNAL = {"scaffold_like": "cohesion", "interface_like": "interface", "node_like": "node", "companion_like": "companion"}


@query(f"""{_PROFILE}{_MEMBERS}, eg AS (SELECT a.c_mktsegment AS sample, concat('D', a.c_custkey) AS i, concat('D', b.c_custkey) AS j, a.c_custkey % 10 / 10.0::DOUBLE AS strength
  FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 40 AND a.c_mktsegment = b.c_mktsegment),
td AS (SELECT a.sample, a.niche, count(*) AS member_edges, avg(strength) AS mean_strength FROM eg JOIN mb a ON a.domain = i JOIN mb b ON b.domain = j AND a.niche = b.niche GROUP BY 1, 2),
wt AS (SELECT mb.sample, mb.niche, dp.*, spots * confidence * CASE WHEN backbone THEN 1.15::DOUBLE ELSE 1 END AS w FROM mb JOIN dp USING (domain)),
wn AS (SELECT *, CASE WHEN sum(w) OVER n > 0 THEN w / sum(w) OVER n ELSE 1.0::DOUBLE / count(*) OVER n END AS v FROM wt WINDOW n AS (PARTITION BY sample, niche)),
hd AS (SELECT sample, niche, max(v) AS dominant_share, 1 - max(v) AS balance, avg(confidence) AS cf, {', '.join(f'sum(v * {c}) AS b_{c}' for c in _AXES)},
  {', '.join(f'sum(CASE WHEN {c} >= 0.15 THEN v ELSE 0 END) AS s_{c}' for c in _COMPONENTS)} FROM wn GROUP BY 1, 2),
o1 AS (SELECT nc.*, hd.* EXCLUDE (sample, niche), {_duck({c: e for c, e in _NICHES.items() if c not in ('confidence', 'cohesion')})}, coalesce(member_edges, 0) AS member_edges, coalesce(mean_strength, 0) AS mean_strength,
  CASE WHEN member_count > 1 THEN {_CLAMP('coalesce(member_edges, 0) / (member_count * (member_count - 1) / 2.0::DOUBLE)')} ELSE 0 END AS density,
  backbone_count / member_count AS backbone_fraction, program_count / member_count AS multi FROM nc JOIN hd USING (sample, niche) LEFT JOIN td USING (sample, niche)),
o2 AS (SELECT *, {_CLAMP('0.6 * mean_strength + 0.4 * density')} AS tie FROM o1),
o3 AS (SELECT *, {_CLAMP('0.40 * tie + 0.25 * backbone_fraction + 0.20 * reliability + 0.15 * (1 - exp(-member_count / 5.0::DOUBLE))')} AS cohesion,
  {_CLAMP('0.40 * contact + 0.20 * proximity + 0.20 * balance + 0.20 * multi')} AS interface, {_CLAMP('0.45 * dominant_share + 0.30 * exp(-member_count / 4.0::DOUBLE) + 0.25 * (1 - density)')} AS node,
  {_CLAMP('0.35 * balance + 0.25 * (1 - backbone_fraction) + 0.20 * (1 - tie) + 0.20 * overlap')} AS companion,
  {_CLAMP('0.45 * interaction + 0.30 * cf + 0.15 * (1 - exp(-member_count / 6.0::DOUBLE)) + 0.10 * reliability')} AS niche_confidence FROM o2),
o4 AS (SELECT *, {', '.join(f'{_CLAMP(f"0.82 * b_{c} + 0.18 * b_{c} * {_CLAMP(f"0.55 * s_{c} + 0.25 * balance + 0.20 * multi")}")} AS {c}' for c in _COMPONENTS)},
  {', '.join(f'{_CLAMP(f"0.78 * b_{c} + 0.22 * {s}")} AS {c}' for c, s in _SIGNAL.items())} FROM o3)
SELECT sample, niche, member_count, program_count, member_edges, {', '.join(_round(c, c) for c in [*_ORGANISED, *_AXES])}, passed AND niche_confidence > 0 AS eligible,
  {_round(_EVEN(_COMPONENTS), 'component_diversity')}, {_round(_EVEN(A.ROLES), 'role_diversity')}, {_MIX(_COMPONENTS)}[1] AS dominant_component, {_MIX(_COMPONENTS)}[2] AS secondary_component,
  {_MIX(A.ROLES)}[1] AS dominant_role, {_MIX(A.ROLES)}[2] AS secondary_role FROM o4""")
def r13_niche_profiles(spark, sf):
    m = _members(spark, sf)
    c = V.load(spark, sf, "customer")
    ends = c.selectExpr("c_mktsegment AS sample", "c_custkey AS k").join(c.selectExpr("c_mktsegment AS sample", "c_custkey - 40 AS k"), ["sample", "k"])
    edges = ends.selectExpr("sample", "concat('D', k) AS i", "concat('D', k + 40) AS j", "k % 10 / 10.0D AS strength")
    n = A.niche_profiles(_niches(m), m, _domain_profiles(spark, sf), edges, _COMPONENTS)
    return n.withColumns({x: r(x) for x in [*_ORGANISED, *_AXES, "component_diversity", "role_diversity"]})


_MEAN = lambda c: f"round(avg(coalesce({c}, 0)), 9)"


@query(f"""WITH dm AS (SELECT {_duck(_DOMAINS)}, c_custkey % 5 / 5.0::DOUBLE AS scaffold_like, c_custkey % 7 / 7.0::DOUBLE AS interface_like, c_custkey % 3 / 3.0::DOUBLE AS node_like,
  c_custkey % 8 / 8.0::DOUBLE AS companion_like FROM customer WHERE c_custkey % 29 <> 0){_MEMBERS},
n AS (SELECT sample, niche, member_count, {_duck({c: _NICHES[c] for c in ('confidence', 'cohesion', 'cross_edges')})} FROM nc),
od AS (SELECT sample, list(program ORDER BY f, program) AS od FROM (SELECT sample, program, min(domain) AS f FROM dm GROUP BY 1, 2) GROUP BY 1),
mr AS (SELECT mb.sample, mb.niche, mb.program, {', '.join(f'coalesce({c}, 0) AS {c}' for c in A.STRIP_ROLES)} FROM mb LEFT JOIN dm USING (sample, domain)),
bp AS (SELECT sample, niche, program, count(*) AS n, {', '.join(f'sum({c}) / count(*) AS {c}' for c in A.STRIP_ROLES)} FROM mr GROUP BY 1, 2, 3),
an AS (SELECT *, CASE greatest({', '.join(A.STRIP_ROLES)}) {' '.join(f"WHEN {c} THEN '{c}'" for c in A.STRIP_ROLES)} END AS anchor FROM bp),
rl AS (SELECT sample, niche, count(DISTINCT program) AS programs, count(*) AS total, {" || ';' || ".join(f"'{c}=' || round({_MEAN(c)}::DECIMAL(18, 9), 3)::VARCHAR" for c in A.STRIP_ROLES)} AS role_strip FROM mr GROUP BY 1, 2),
ps AS (SELECT DISTINCT c_mktsegment AS sample, concat('N', c_custkey % 40) AS niche, concat('P', c_custkey % 23) AS l, concat('P', (c_custkey + 40) % 23) AS r FROM customer),
pn AS (SELECT sample, niche, count(*) AS pair_count FROM ps GROUP BY 1, 2),
lb AS (SELECT ps.sample, ps.niche, least(a.anchor, b.anchor) || '↔' || greatest(a.anchor, b.anchor) AS label, count(*) AS n FROM ps JOIN an a ON a.sample = ps.sample AND a.niche = ps.niche AND a.program = l
  JOIN an b ON b.sample = ps.sample AND b.niche = ps.niche AND b.program = r GROUP BY 1, 2, 3),
tp AS (SELECT sample, niche, list(label ORDER BY n DESC, label) AS t FROM lb GROUP BY 1, 2),
st AS (SELECT rl.sample, rl.niche, string_agg(u.p || '=' || round(coalesce(an.n / total, 0)::DECIMAL(18, 9), 3)::VARCHAR, ';' ORDER BY u.i) AS program_strip FROM rl JOIN
  (SELECT sample, unnest(od) AS p, unnest(range(len(od))) AS i FROM od) u ON u.sample = rl.sample LEFT JOIN an ON an.sample = rl.sample AND an.niche = rl.niche AND an.program = u.p GROUP BY 1, 2),
al AS (SELECT n.*, programs, program_strip, role_strip, coalesce(t[1], '') AS dominant_pair, coalesce(t[2], '') AS secondary_pair, coalesce(pair_count, 0) AS pair_count
  FROM n JOIN rl USING (sample, niche) JOIN st USING (sample, niche) LEFT JOIN pn USING (sample, niche) LEFT JOIN tp USING (sample, niche))
SELECT sample, niche, member_count, round(confidence, 6) AS confidence, round(cohesion, 6) AS cohesion, programs, program_strip, role_strip, dominant_pair, secondary_pair,
  CASE WHEN contains(dominant_pair, 'scaffold_like') AND contains(dominant_pair, 'interface_like') THEN 'scaffold_attached_interface' WHEN contains(dominant_pair, 'node_like') THEN 'node_focal'
  WHEN pair_count >= 4 OR cross_edges >= 6 THEN 'mixed_mesh' WHEN programs <= 2 AND pair_count <= 1 THEN 'compact_contact' WHEN secondary_pair <> '' AND secondary_pair = dominant_pair THEN 'parallel_contact'
  WHEN programs >= 4 THEN 'diffuse_contact' ELSE 'edge_contact' END AS contact_hint FROM al""")
def r17_assembly_matrix(spark, sf):
    roles = {"scaffold_like": 5, "interface_like": 7, "node_like": 3, "companion_like": 8}
    d = V.load(spark, sf, "customer").where("c_custkey % 29 <> 0").selectExpr(*_expr(_DOMAINS), *[f"c_custkey % {k} / {k}.0D AS {c}" for c, k in roles.items()])
    pairs = V.load(spark, sf, "customer").selectExpr("c_mktsegment AS sample", "concat('N', c_custkey % 40) AS niche", "concat('P', c_custkey % 23) AS left", "concat('P', (c_custkey + 40) % 23) AS right").distinct()
    m = _members(spark, sf)
    n = _niches(m).join(pairs.groupBy("sample", "niche").agg(F.count(F.lit(1)).alias("pair_count")), ["sample", "niche"], "left").fillna(0, ["pair_count"])
    return A.assembly_matrix(n, m, d, pairs).withColumns({"confidence": r("confidence"), "cohesion": r("cohesion")})


@query(f"""{_PROFILE}, lg AS (UNPIVOT (SELECT sample, domain AS object, confidence, {', '.join(_AXES)} FROM dp) ON {', '.join(_AXES)} INTO NAME axis VALUE score),
rk AS (SELECT *, score * confidence AS contribution, row_number() OVER (PARTITION BY sample, axis ORDER BY round(score * confidence, 9) DESC, round(score, 9) DESC, round(confidence, 9) DESC, object) AS rank FROM lg)
SELECT sample, axis, rank, object, {_round('score', 'score')}, {_round('contribution', 'contribution')} FROM rk WHERE rank <= 5""")
def w17_top_by_axis(spark, sf):
    p = _domain_profiles(spark, sf).withColumnRenamed("domain", "object")
    return A.top_by_axis(p, _AXES, "confidence", 5).withColumns({"score": r("score"), "contribution": r("contribution")})


_STAGES = """WITH c AS (SELECT p_brand AS program, count(*) AS size, avg(p_size) AS focus FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1),
d AS (SELECT p_brand AS program, count(*) AS size, avg(p_size) AS focus FROM part WHERE p_size > 10 AND p_brand <> 'Brand#12' GROUP BY 1),
f AS (SELECT p_brand AS program, CASE WHEN max(p_size) > 45 THEN 'refined' ELSE 'kept' END AS status, count(*) FILTER (p_size <= 10) AS pruned, count(*) AS before, count(*) FILTER (p_size > 10) AS after
  FROM part WHERE p_brand <> 'Brand#13' GROUP BY 1)"""


@query(f"""{_STAGES} SELECT program, c.program IS NOT NULL AS candidate_exists, d.program IS NOT NULL AS refined_exists, coalesce(status, 'missing') AS status, coalesce(pruned, 0) AS pruned,
  coalesce(before, 0) AS before, coalesce(after, 0) AS after, c.size AS candidate_size, d.size AS refined_size, round(c.focus, 6) AS candidate_focus, round(d.focus, 6) AS refined_focus,
  d.size - c.size AS delta_size, round(d.focus - c.focus, 6) AS delta_focus FROM c FULL JOIN d USING (program) FULL JOIN f USING (program)""")
def m12_stage_diagnostics(spark, sf):
    p = V.load(spark, sf, "part").withColumn("program", F.col("p_brand"))
    stage = lambda x: x.groupBy("program").agg(F.count(F.lit(1)).alias("size"), F.avg("p_size").alias("focus"))
    few = F.col("p_size") <= 10
    moved = p.where("p_brand <> 'Brand#13'").groupBy("program").agg(
        F.when(F.max("p_size") > 45, "refined").otherwise("kept").alias("status"), F.count_if(few).alias("pruned"), F.count(F.lit(1)).alias("before"), F.count_if(~few).alias("after"),
    )
    got = A.stage_diagnostics(stage(p.where("p_brand <> 'Brand#11'")), stage(p.where(~few & (F.col("p_brand") != "Brand#12"))), moved, "program", ["size", "focus"])
    return got.withColumns({c: r(c) for c in ("candidate_focus", "refined_focus", "delta_focus")})


@query("""WITH l AS (SELECT c_custkey AS spot, c_nationkey % 4 AS label_a, (c_nationkey + 1 + (c_custkey % 3 = 0)::INT) % 4 AS label_b FROM customer),
c AS (SELECT label_a, label_b, count(*) AS n FROM l GROUP BY 1, 2), g AS (SELECT range AS i FROM range(4)),
p AS (SELECT w.i AS p0, x.i AS p1, y.i AS p2, z.i AS p3 FROM g w, g x, g y, g z WHERE len(list_distinct([w.i, x.i, y.i, z.i])) = 4),
s AS (SELECT p0, p1, p2, p3, sum(n) AS n FROM p JOIN c ON label_a = [p0, p1, p2, p3][label_b + 1] GROUP BY ALL), b AS (SELECT * FROM s ORDER BY n DESC, p0, p1, p2, p3 LIMIT 1)
SELECT spot, label_a, label_b, [p0, p1, p2, p3][label_b + 1] AS matched FROM l, b""")
def m13_matched_labels(spark, sf):
    l = V.load(spark, sf, "customer").selectExpr("c_custkey AS spot", "c_nationkey % 4 AS label_a", "(c_nationkey + 1 + int(c_custkey % 3 = 0)) % 4 AS label_b")  # noqa: E741
    return A.matched_labels(l, 4)


@query("""WITH s AS (SELECT c_nationkey % 6 + 2 AS k, avg(c_acctbal) / 1e4 AS improvement, 0.1::DOUBLE * (c_nationkey % 6) AS penalty FROM customer GROUP BY 1, 3)
SELECT k, round(improvement - penalty + CASE k WHEN 3 THEN 0.02 ELSE 0 END, 6) AS score FROM s ORDER BY improvement - penalty + CASE k WHEN 3 THEN 0.02 ELSE 0 END DESC, k LIMIT 1""")
def m13_recommended_k(spark, sf):
    c = V.load(spark, sf, "customer").selectExpr("c_nationkey % 6 AS g", "c_acctbal")
    s = c.groupBy("g").agg((F.avg("c_acctbal") / 1e4).alias("improvement")).selectExpr("g + 2 AS k", "improvement", "0.1D * g AS penalty")
    return A.recommended_k(s).withColumn("score", r("score"))
