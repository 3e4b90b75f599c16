"""Hand-computed cases and properties of the library's operators, and a sample of queries against their SQL twins."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.functions import exprs as X
from tessera.functions import stats as S
from tessera.operators import atlas as A
from tessera.operators import domains as D
from tessera.operators import genes as G
from tessera.operators import graph as H
from tessera.operators import niches as N
from tessera.operators import programs as M
from tessera.operators import spatial as P
from tessera.operators import templates as L
from tessera.sources import bundles as B
from tessera.sources import tables as T

SF = "/root/testdata/sf0.001"
TWINS = ["p8_gene_qc_top", "flagship_gss", "j11_nearest", "g6_watershed", "r4_j18_over_representation", "j14_j15_w8_comparable", "w10_cumulative_cut", "f20_vector_similarity", "u2_u3_union_except",
         "a27_topology", "m4_latent_losses", "f19_texts", "s6_merged_axes", "m8_head_consistency",
         "r13_domain_profiles", "r13_niche_profiles", "r17_assembly_matrix", "w17_top_by_axis", "m12_stage_diagnostics", "m13_matched_labels", "m13_recommended_k"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", TWINS)
def test_twin(spark, name):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    d = __spark_entry__.queries()[name](spark, SF)
    names = sorted(d.columns)
    got = [tuple(plain(r[n]) for n in names) for r in d.collect()]
    q = c.sql(__spark_entry__.oracle_sql()[name])
    want = [tuple(plain(row[q.columns.index(n)]) for n in names) for row in q.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_entry(spark):
    d = __spark_entry__.entry(spark)
    assert d.columns == ["spot", "gene", "score", "rank_in_spot"] and d.count() > 0


def test_registered():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_jaccard(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    assert one(spark, X.jaccard(a(), a())) == 1.0 and one(spark, X.jaccard(a(), a(), 0.0)) == 0.0
    assert one(spark, X.jaccard(a("p"), a())) == 0.0 and one(spark, X.jaccard(a("p", "q"), a("q", "p"))) == 1.0


def test_scalars(spark):
    assert one(spark, X.clamp01(F.lit(float("nan")))) == 0.0
    assert one(spark, X.triangular(F.lit(0.2), 0, 0.4, 1)) == pytest.approx(0.5)
    assert one(spark, X.truth_loose(F.lit("maybe"))) and not one(spark, X.truth_strict(F.lit("maybe")))
    assert one(spark, X.number_or(F.lit("inf"), 2.0)) == 2.0 and one(spark, X.number_or(F.lit("x"), 2.0)) == 2.0
    assert one(spark, X.parse_strip(X.strip(F.create_map(F.lit("a"), F.lit(0.12345)), ["a", "b"]))) == {"a": 0.123, "b": 0.0}
    assert one(spark, X.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(0.0)))) == 0.0


def test_texts(spark):
    t = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    assert [one(spark, X.phrase(t(*v))) for v in ((), ("a",), ("a", " ", "b"), ("a", "b", "c"))] == ["", "a", "a and b", "a, b and c"]
    q = one(spark, X.symbol_quality(t("LINC1", "ACTB", "HBA1", "TP53", "")))
    assert (q.odd5, q.haemoglobin10) == (0.5, 0.25) and q.score == pytest.approx(max(0, 1 - 0.375 - 0.5 - 0.125))


def test_log_factorial(spark):
    for n in (0, 1, 15, 16, 2001, 10**7):
        assert one(spark, M.log_factorial(F.lit(n))) == pytest.approx(math.lgamma(n + 1), rel=1e-13, abs=1e-11)


def test_over_representation_of_a_large_universe(spark):
    """20,000 genes: the hypergeometric tail against sums of exact binomials."""
    genes = spark.range(20_000).selectExpr("id AS gene")
    programs, terms = genes.where("gene < 100").selectExpr("'p' AS program", "gene"), genes.where("gene % 9 = 0 OR gene > 19900").selectExpr("'t' AS term", "gene")
    h = M.over_representation(programs, terms, genes).first()
    t, p, k = terms.count(), 100, h.overlap
    want = sum(math.comb(t, i) * math.comb(20_000 - t, p - i) for i in range(k, p + 1)) / math.comb(20_000, p)
    assert k == 12 and h.p_value == pytest.approx(want, rel=1e-8)


def test_epsilon(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (5.0,), (-1.0,), (float("inf"),), (float("nan"),)], "distance double")
    assert N.epsilon(d, "fixed") == (1.75, "fixed_default_q25") and N.epsilon(d, "fixed", fixed=-1.0) == (0.0, "fixed")
    assert N.epsilon(d, "spot_spacing", 2.0) == (3.0, "spot_spacing") and N.epsilon(d, "quantile", quantile=2.0) == (5.0, "distance_quantile")
    assert N.epsilon(d.limit(0)) == (0.0, "empty_distance")
    with pytest.raises(ValueError):
        N.epsilon(d, "spot_spacing")


def test_stage_inputs(spark, tmp_path):
    at = str(tmp_path)
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{at}/b/{name}.parquet")
    with pytest.raises(FileNotFoundError):
        B.assemble(spark, f"{at}/b")
    write("programs", [("p", "g")], "program string, gene string")
    write("activation", [("p", 7, 1.0)], "program string, spot long, value double")
    write("spots", [(7, 0), (8, 1)], "spot long, idx long")
    with pytest.raises(FileNotFoundError, match="qc"):
        B.assemble(spark, f"{at}/b")
    assert B.assemble(spark, f"{at}/b", 2, need_qc=False).qc is None
    with pytest.raises(ValueError, match="neighbours"):
        B.assemble(spark, f"{at}/b", 3, need_qc=False)
    write("spots", [(8, 0), (9, 1)], "spot long, idx long")
    with pytest.raises(ValueError, match="unknown spots"):
        B.assemble(spark, f"{at}/b", need_qc=False)
    write("spots", [(7, 0), (7, 1)], "spot long, idx long")
    with pytest.raises(ValueError, match="each once"):
        B.assemble(spark, f"{at}/b", need_qc=False)
    assert B.locate(spark, f"{at}/x", "b") == f"{at}/b" and B.locate(spark, f"{at}/x", "c", manifest={"inputs": {"c_path": f"{at}/b"}}) == f"{at}/b"
    for told in ({"override": f"{at}/none"}, {}):
        with pytest.raises(FileNotFoundError):
            B.locate(spark, f"{at}/x", "c", **told)
    assert B.listed(spark, f"{at}/none", "b", "m") == []
    (tmp_path / "a.json").write_text('[{"k": " x ", "v": 1}, {"k": "x", "v": 2}, {"k": ""}, {"v": 3}]')
    rows, told = B.read_records(spark, f"{at}/a.json", "k string, v int", "k")
    assert [tuple(r) for r in rows.collect()] == [("x", 2)] and told["available"]
    with pytest.raises(FileNotFoundError):
        B.read_records(spark, f"{at}/none.json", "k string", "k", required=True)


def test_statistics(spark):
    q = S.quantiles(spark.createDataFrame([("g", v) for v in (1.0, 2.0, 4.0, 10.0)] + [("n", float("nan"))], "g string, v double"), "v", "g")
    assert {r.g: r.p75 for r in q.collect()} == {"g": 5.5, "n": 0.0}
    p = S.benjamini_hochberg(spark.createDataFrame([("g", v) for v in (0.01, 0.02, 0.03, 0.5)], "g string, p double"), "p", ["g"])
    assert [round(r.fdr, 6) for r in p.orderBy("p").collect()] == [0.04, 0.04, 0.04, 0.5]
    k = S.percentile_rank(spark.createDataFrame([(1,), (1,), (3,)], "v int").withColumn("g", F.lit(0)), "v", ["g"], "p")
    assert sorted(r.p for r in k.collect()) == [0.5, 0.5, 1.0]
    c = S.cumulative_cut(spark.createDataFrame([("g", v, i) for i, v in enumerate((5.0, 3.0, 1.0, 1.0))], "g string, s double, i int"), "s", ["g"], [F.desc("s"), "i"], 0.8)
    assert c.count() == 2
    a = S.adjusted_rand(spark.createDataFrame([(k % 3, (k % 3 + 1) % 3) for k in range(30)], "a int, b int"), "a", "b")
    assert a.first().ari == 1.0


def test_ranks_with_zeros(spark):
    cells = spark.createDataFrame([("s", "a", 2.0), ("s", "b", 2.0), ("s", "c", 5.0), ("s", "d", 0.0)], "spot string, gene string, value double")
    assert {r.gene: r["rank"] for r in G.ranks_with_zeros(cells, 6).collect()} == {"a": 4.5, "b": 4.5, "c": 6.0}


def lattice(spark, n=5):
    return spark.createDataFrame([(x + n * y, float(x), float(y)) for x in range(n) for y in range(n)], "spot long, x double, y double")


def test_nearest(spark):
    rng = random.Random(2)
    pts = [(k, rng.random() * 100, rng.random() * 3) for k in range(120)] + [(500, 1e4, 0.0)]
    got = {(r.spot, r.slot): r.other for r in P.nearest(spark.createDataFrame(pts, "spot long, x double, y double"), 3, 0.5).collect()}
    for s, x, y in pts:
        want = sorted(((a - x) ** 2 + (b - y) ** 2, o) for o, a, b in pts if o != s)[:3]
        assert [got[s, k + 1] for k in range(3)] == [o for _, o in want]


def path(spark, n):
    return spark.createDataFrame([(k, k + 1) for k in range(n - 1)] + [(k + 1, k) for k in range(n - 1)], "u long, v long")


def test_graph(spark):
    e = path(spark, 5)
    m = spark.createDataFrame([("d", k) for k in range(5)], "domain string, spot long")
    assert H.articulation_share(m, e).first().ratio == pytest.approx(0.6)
    tri = spark.createDataFrame([(a, b) for a in range(3) for b in range(3) if a != b], "u long, v long")
    assert H.articulation_share(m.where("spot < 3"), tri).first().ratio == 0
    nodes = spark.createDataFrame([("p", k) for k in (0, 1, 4)], "program string, spot long")
    parts = H.components(nodes, spark.createDataFrame([("p", 0, 1), ("p", 1, 0)], "program string, u long, v long"))
    assert {r.spot: r.component for r in parts.collect()} == {0: 0, 1: 0, 4: 4}
    near = H.bridge_gaps(parts, path(spark, 6), 2)  # three hops from 1 to 4
    assert {r.component for r in near.collect()} == {0}
    far = H.bridge_gaps(parts, path(spark, 6), 1)
    assert {r.component for r in far.collect()} == {0, 4}
    peaks = spark.createDataFrame([("p", k, v) for k, v in enumerate((3.0, 2.0, 1.0, 2.0, 4.0))], "program string, spot long, value double")
    roots = H.watershed(peaks, e)
    assert {r.spot: r.root for r in roots.collect()} == {0: 0, 1: 0, 2: 0, 3: 4, 4: 4}
    small = H.merge_small_basins(roots.join(peaks, ["program", "spot"]), e, most=2)
    assert {r.root for r in small.collect()} == {0}  # the smaller basin joins the other
    flat = H.smooth(spark.createDataFrame([("p", 0, 1.0), ("p", 9, 5.0)], "program string, spot long, value double"), e, steps=2)
    assert {r.spot: r.value for r in flat.collect()} == {0: 1.0, 9: 5.0}


def test_domains(spark):
    pts = lattice(spark)
    edges = P.within(pts, pts, 1.1).select(F.col("spot").alias("u"), F.col("other").alias("v"))
    m = spark.createDataFrame([("a", "p", k, 1.0) for k in (0, 1, 5, 6)] + [("b", "q", k, 1.0) for k in (6, 7)], "domain string, program string, spot long, value double")
    g = {r.domain: r for r in D.geometry(m, edges, pts).collect()}
    assert (g["a"].n, g["a"].internal, g["a"].boundary) == (4, 4, 4) and g["a"].density == pytest.approx(4 / 6) and g["a"].elongation == pytest.approx(1.0)
    p = D.pairs(m, edges).first()
    assert (p.i, p.j, p.shared, p.overlap) == ("a", "b", 3, 1)
    assert {(r.spot, r.domain) for r in D.owners(m).collect() if r.spot == 6} == {(6, "a")}


def test_niche(spark):
    """A strong triangle of three programs grows from a seed; a domain that only weak edges lead to lies outside its region."""
    def edge(i, j, pi, pj, strong, strength):
        return (i, j, pi, pj, strong, False, not strong, 0.8, strength, strong)

    rows = [edge("d1", "d2", "A", "B", True, 0.9), edge("d2", "d3", "B", "C", True, 0.8), edge("d1", "d3", "A", "C", True, 0.7), edge("d3", "d4", "C", "A", False, 0.1), edge("d2", "d4", "B", "A", False, 0.1)]
    e = spark.createDataFrame(rows, "i string, j string, program_i string, program_j string, boundary_contact boolean, overlap_contact boolean, proximity_contact boolean, edge_reliability double, edge_strength double, is_strong boolean")
    e = N.prepared(e)
    s = N.basic_filter(N.structures(e, N.seeds(e, 0.0)))
    best = max(s.collect(), key=lambda r: r.backbone_count)
    assert best.backbone_nodes == "d1;d2;d3" and best.member_nodes == "d1;d2;d3" and best.passed
    assert N.deduplicate(s.unionByName(s), ["component"]).count() <= s.count()


def test_over_representation(spark):
    universe = spark.createDataFrame([(f"g{k}",) for k in range(20)], "gene string")
    programs = spark.createDataFrame([("p", f"g{k}") for k in (0, 1, 10, 11)], "program string, gene string")
    terms = spark.createDataFrame([("t", f"g{k}") for k in range(5)], "term string, gene string")
    r = M.over_representation(programs, terms, universe, least=1).first()
    assert r.overlap == 2 and r.p_value == pytest.approx(1 - 3640 / 4845)


def test_factorisation(spark):
    rng = random.Random(1)
    cells = [(s, f"g{k}", float(rng.randint(1, 5))) for s in range(30) for k in range(12) if (s < 15) == (k < 6)]
    w = L.factorise(spark.createDataFrame(cells, "spot long, gene string, value double"), 2, (2,), rounds=40)
    got = {(r.run, r.component, r.gene): r.weight for r in w.collect()}
    assert min(got.values()) >= 0
    for run in range(2):
        for c in range(2):
            left = sum(got[run, c, f"g{k}"] for k in range(6))
            assert left < 0.05 or left > 0.95


def test_tables(spark, tmp_path):
    lines = spark.createDataFrame([("T1\td\tabc\tABC\tx", 1), ("bad\tline", 2), ("T1\te\tq", 3)], "value string, pos int")
    assert [tuple(r) for r in T.gene_sets(lines).collect()] == [("T1", "e", ["Q"])]
    with pytest.raises(ValueError):
        T.allowed(spark.range(3), "id", spark.createDataFrame([(7,)], "id long"))
    with pytest.raises(ValueError):
        T.one_to_one(spark.range(3), spark.createDataFrame([(1,), (1,)], "id long"), "id")
    for n in (3, 5):
        T.promote(spark.range(n), f"{tmp_path}/t")
        assert spark.read.parquet(f"{tmp_path}/t").count() == n
    assert len(list(tmp_path.iterdir())) == 1
    assert T.markdown(spark.createDataFrame([(1.0, "a|b")], "x double, y string")).split("\n")[2] == "| 1.0000 | a/b |"
    assert T.digests(spark, f"{tmp_path}/t").count() >= 1


def test_partition_count_changes_nothing(spark):
    q = __spark_entry__.queries()["g6_watershed"]
    a = sorted(map(tuple, q(spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(map(tuple, q(spark, SF).collect())) == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")


def test_term_matrix_of_many_terms(spark, tmp_path):
    from tessera.plans import programs as plans

    spark.range(1200).selectExpr("IF(id < 3, 'a', 'b') AS p_brand", "format_string('%05d', id) AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(tuple(r) for r in plans.m16_term_matrix(spark, str(tmp_path)).collect()) == [("a", 1.0, 3.0, 3), ("b", 0.0, 1197.0, 1197)]


def _graph(spark, n=24, programs=4):
    rng = random.Random(5)
    rows = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(5 * n)) if a != b}
    rows = [(f"d{a:02}", f"d{b:02}", f"p{a % programs}", f"p{b % programs}", True, False, rng.random() < 0.5, rng.random(), rng.random(), rng.random() < 0.8) for a, b in sorted(rows)]
    return N.prepared(spark.createDataFrame(rows, "i string, j string, program_i string, program_j string, boundary_contact boolean, overlap_contact boolean, proximity_contact boolean, "
                                                  "edge_reliability double, edge_strength double, is_strong boolean")).cache()


def test_rearranged_graphs(spark):
    """Every iteration deals the same second ends, without loops or double edges, each with its own program."""
    e = _graph(spark)
    x = N.rearranged(e, 3, 7).collect()
    good, rest = [r for r in e.collect() if r.eligible], [r for r in e.collect() if not r.eligible]
    program = {r.j: r.program_j for r in good}
    seen = []
    for k in range(3):
        mine = [r for r in x if r.iteration == k]
        assert all(r.i.startswith(f"{k:06}#") and r.j.startswith(f"{k:06}#") for r in mine)
        plain_rows = [(r.i[7:], r.j[7:], r.program_j, r.edge_strength) for r in mine]
        kept = {r.edge_strength for r in rest}
        assert sorted(p for p in plain_rows if p[3] in kept) == sorted((r.i, r.j, r.program_j, r.edge_strength) for r in rest)
        dealt = [p for p in plain_rows if p[3] not in kept]
        assert all(a != b and program[b] == q for a, b, q, _ in dealt)
        assert len({frozenset(p[:2]) for p in dealt}) == len(dealt) <= len(good)
        seen.append(sorted(dealt))
    assert seen[0] != seen[1] != seen[2]
    assert sorted(map(str, N.rearranged(e, 3, 7).collect())) == sorted(map(str, x))


def test_random_baseline(spark):
    """Rates of structures against a plain count over the same rearranged structures."""
    e = _graph(spark)
    s = N.structures(e, H.stored(N.seeds(e), "seeds"))
    got = {(r.component, r.pattern): r for r in N.random_baseline(e, s, iterations=4, seed=9, every=True).collect()}
    x = H.stored(N.prepared(N.rearranged(e, 4, 9), ("iteration",)), "x")
    other = N.structures(x, H.stored(N.seeds(x, by=("iteration",)), "seeds")).collect()
    pairs, edges = lambda r: set(r.pairs.split(";")), lambda r: len(r.backbone_keys.split(";"))
    rows = s.collect()
    assert rows and other and len(got) == len(rows)
    for r in rows:
        hits = {o.component[:6] for o in other if len(pairs(r) & pairs(o)) / len(pairs(r) | pairs(o)) >= 0.5 and abs(edges(r) - edges(o)) <= 1 and abs(r.program_count - o.program_count) <= 1}
        g = got[r.component, r.pattern]
        assert g.random_rate == len(hits) / 4 and g.random_passed == (1 - len(hits) / 4 >= 0.7)


def test_profiles_of_empty_and_missing(spark):
    """A domain without a program's row has no axes, a niche without members no row, and weightless members count alike."""
    d = spark.sql("SELECT 's' AS sample, 'd' AS domain, 'p' AS program, CAST(NULL AS boolean) AS qc_pass, CAST(NULL AS double) AS spots, 0D AS density, 0D AS boundary_ratio, 0D AS elongation, "
                  "CAST(NULL AS double) AS pieces, 0D AS reliability, 0D AS mixed")
    p = spark.createDataFrame([], "sample string, program string, confidence double, a double, b double, " + ", ".join(f"{c} double" for c in A.ROLES))
    got = A.domain_profiles(d, p, ["a", "b"])
    one = got.first()
    assert (one.qc_pass, one.eligible, one.a, one.size_support, one.confidence) == (False, False, 0, 0, 0)
    n = spark.sql("SELECT 's' AS sample, x AS niche, 2L AS member_count, 1L AS backbone_count, 1L AS program_count, 0D AS contact, 0D AS overlap, 0D AS proximity, 0D AS reliability, 0D AS interaction, "
                  "true AS passed FROM VALUES ('n'), ('empty') AS t(x)")
    m = spark.sql("SELECT 's' AS sample, 'n' AS niche, x AS domain, false AS backbone FROM VALUES ('d'), ('unknown') AS t(x)")
    e = spark.createDataFrame([], "sample string, i string, j string, strength double")
    rows = A.niche_profiles(n, m, got, e, ["a", "b"]).collect()
    assert [r.niche for r in rows] == ["n"] and rows[0].dominant_share == 0.5 and rows[0].member_edges == 0
    assert A.domain_profiles(d.limit(0), p, ["a", "b"]).count() == 0
