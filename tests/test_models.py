"""Iterative and resampling operators against brute force, and properties that must hold."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from carrierlake.operators import contingency, expression, fdr, haplotypes, ld, ranking, ranktests, regression, resampling, survival


def test_bh_small_case(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.005), (5, None)], "k int, p double")
    got = {r.k: r.fdr for r in fdr.bh_fdr(df.withColumn("f", F.lit("x")), "p", ["f"]).collect()}
    assert got[5] is None
    assert [got[k] for k in (1, 2, 3, 4)] == pytest.approx([0.02, 0.04, 0.04, 0.02])


def test_bh_hot_family_and_ties(spark):
    """A family holding most rows with a third of them tied at 1.0; any partitioning gives the same."""
    rng = np.random.default_rng(1)
    rows = [("hot", i, float(p)) for i, p in enumerate(np.where(rng.random(3000) < 0.33, 1.0, rng.random(3000) ** 4))]
    rows += [("one", 0, 0.3)] + [("two", i, p) for i, p in enumerate((0.2, 1e-320))]
    df = spark.createDataFrame(rows, "f string, k int, p double")
    got = {(r.f, r.k): r.fdr for r in fdr.bh_fdr(df, "p", ["f"]).collect()}
    again = {(r.f, r.k): r.fdr for r in fdr.bh_fdr(df.repartition(7), "p", ["f"]).collect()}
    assert got == again and len(got) == len(rows)
    p = np.array([r[2] for r in rows if r[0] == "hot"])
    order = np.argsort(-p)
    want = np.empty(len(p))
    want[order] = np.minimum.accumulate(p[order] * len(p) / np.arange(len(p), 0, -1))
    assert np.allclose([got[("hot", i)] for i in range(len(p))], np.minimum(want, 1))
    assert got[("one", 0)] == 0.3


def test_ranks_and_quantiles_by_brute_force(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.integers(-5, 5, 500), rng.normal(0, 1e6, 300), [0.0, -0.0, 1e-12, -1e-12, 1e300]])
    df = spark.createDataFrame([("k", float(v)) for v in values], "k string, v double")
    ranks = {r.v: r.avg_rank for r in ranking.value_ranks(df, ["k"], "v").collect()}
    for v in set(values):
        assert ranks[v] == (np.sum(values < v) + 1 + np.sum(values <= v)) / 2
    row = ranking.quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.975}).first()
    assert [row.a, row.b, row.c] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.975])))


def test_fisher_symmetry(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(int(x) for x in rng.integers(0, 60, 4)) for _ in range(60)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    one = contingency.fisher_2x2(df, ("a", "b", "c", "d"), "p")
    both = contingency.fisher_2x2(contingency.fisher_2x2(one, ("c", "d", "a", "b"), "q"), ("b", "a", "d", "c"), "r").collect()
    for r in both:
        n1, n2, m = r.a + r.b, r.c + r.d, r.a + r.c
        pmf = {k: math.comb(n1, k) * math.comb(n2, m - k) for k in range(max(0, m - n2), min(n1, m) + 1)}
        want = sum(v for v in pmf.values() if v <= pmf[r.a] * (1 + 1e-7)) / sum(pmf.values())
        assert r.p == pytest.approx(want, rel=1e-9) and r.q == pytest.approx(r.p) and r.r == pytest.approx(r.p)


def test_chi_square_modes(spark):
    rows = [("k", a, g, n) for a, g, n in (("t", "WT", 10), ("t", "Het_ALT", 20), ("c", "WT", 30), ("c", "Het_ALT", 15))]
    df = spark.createDataFrame(rows, "k string, arm string, g string, n int")
    plain = contingency.chi_square(df, ["k"], "arm", "g").first()
    table = np.array([[10, 20], [30, 15]], float)
    e = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    assert plain.statistic == pytest.approx(((table - e) ** 2 / e).sum()) and plain.dof == 1
    yates = contingency.chi_square(df, ["k"], "arm", "g", yates=True).first()
    assert yates.statistic == pytest.approx(((np.abs(table - e) - 0.5) ** 2 / e).sum())
    half = contingency.chi_square(df, ["k"], "arm", "g", empty_columns="half").first()
    full = np.hstack([table, [[0], [0]]]) + 0.5
    e = full.sum(1, keepdims=True) * full.sum(0) / full.sum()
    assert half.dof == 2 and half.statistic == pytest.approx(((full - e) ** 2 / e).sum())


def newton(x, y, firth=False):
    beta = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ beta))
        inverse = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)
        score = y - p
        if firth:
            score = score + np.einsum("ni,ij,nj->n", x, inverse, x) * p * (1 - p) * (0.5 - p)
        beta = beta + inverse @ (x.T @ score)
    return beta, np.sqrt(np.diag(inverse))


def logit_data(seed, n=300):
    rng = np.random.default_rng(seed)
    x, age, bmi = rng.integers(0, 3, n), rng.normal(60, 10, n), rng.normal(25, 4, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(-0.5 + 0.6 * x + 0.03 * (age - 60))))).astype(int)
    return x, age, bmi, y


def test_logit_adjusted_against_newton(spark):
    rows, want = [], {}
    for key in range(3):
        x, age, bmi, y = logit_data(key)
        if key == 2:
            bmi = np.full_like(bmi, 25.0)  # a constant covariate must drop out
        rows += [(key, int(a), float(b), float(c), int(d)) for a, b, c, d in zip(x, age, bmi, y)]
        z = [np.ones_like(age), x] + [(v - v.mean()) / v.std() for v in (age, bmi) if v.std() > 0]
        beta, se = newton(np.column_stack(z), y)
        want[key] = (beta[1], se[1])
    df = spark.createDataFrame(rows, "k int, x int, age double, bmi double, y int")
    for r in regression.logit_by_key(df, ["k"], "y", "x", ["age", "bmi"]).collect():
        assert (r.beta, r.se) == pytest.approx(want[r.k], rel=1e-6) and r.converged


def test_firth_is_finite_under_separation(spark):
    x = np.array([0] * 12 + [1] * 6)
    y = np.array([0] * 12 + [1] * 6)
    df = spark.createDataFrame([("k", int(a), int(b)) for a, b in zip(x, y)], "k string, x int, y int")
    r = regression.firth_by_key(df, ["k"], "y", "x", passes=60).first()
    assert r.beta == pytest.approx(newton(np.column_stack([np.ones(18), x]), y, firth=True)[0][1], rel=1e-4)
    plain = regression.logit_by_key(df, ["k"], "y", "x", min_events=1).first()
    assert plain.clipped


def efron(t, e, x):
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        r = np.exp(x @ beta)
        g, h = np.zeros_like(beta), np.zeros((len(beta),) * 2)
        for time in np.unique(t[e == 1]):
            risk, dead = t >= time, (t == time) & (e == 1)
            d = dead.sum()
            g += x[dead].sum(0)
            for l in range(d):
                w = r * risk - l / d * r * dead
                m = (w[:, None] * x).sum(0) / w.sum()
                g -= m
                h += (w[:, None, None] * x[:, :, None] * x[:, None, :]).sum(0) / w.sum() - np.outer(m, m)
        beta = beta + np.linalg.solve(h, g)
    return beta, np.sqrt(np.diag(np.linalg.inv(h)))


def test_cox_against_efron(spark):
    rng = np.random.default_rng(5)
    n = 120
    x = np.column_stack([rng.integers(0, 2, n), rng.normal(0, 1, n)]).astype(float)
    t = np.ceil(rng.exponential(8 / np.exp(0.5 * x[:, 0] + 0.2 * x[:, 1])))
    e = (rng.random(n) < 0.7).astype(int)
    df = spark.createDataFrame([("k", float(a), int(b), float(c), float(d)) for a, b, c, d in zip(t, e, x[:, 0], x[:, 1])], "k string, t double, e int, x double, z double")
    r = survival.cox_by_key(df, ["k"], "t", "e", ["x", "z"]).first()
    beta, se = efron(t, e, x)
    assert (r.beta, r.se) == pytest.approx((beta[0], se[0]), rel=1e-6)


def test_three_group_logrank_matches_two(spark):
    rng = np.random.default_rng(6)
    rows = [("k", int(rng.integers(1, 20)), int(rng.random() < 0.6), "abc"[int(rng.integers(0, 3))]) for _ in range(150)]
    df = spark.createDataFrame(rows, "k string, t int, e int, g string")
    r = survival.logrank_by_key(df, ["k"], "t", "e", "g", ["a", "b", "c"]).first()
    assert r.observed_0 + r.observed_1 + r.observed_2 == sum(x[2] for x in rows)
    assert r.expected_0 + r.expected_1 + r.expected_2 == pytest.approx(sum(x[2] for x in rows))
    same = survival.logrank_by_key(df, ["k"], "t", "e", "g", ["c", "a", "b"]).first()
    assert r.statistic == pytest.approx(same.statistic) and 0 <= r.p_value <= 1


def test_ld_block_case(spark):
    r2 = {(1, 2): 0.9, (1, 3): 0.85, (2, 3): 0.9, (3, 4): 0.9, (1, 4): 0.2, (2, 4): 0.9}
    pairs = spark.createDataFrame([("r", i, j, v) for (i, j), v in r2.items()], "region string, i int, j int, r2 double")
    loci = spark.createDataFrame([("r", i) for i in range(1, 5)], "region string, i int")
    assert [(b.start, b.end, b.size) for b in ld.ld_blocks(pairs, loci, "region").collect()] == [(1, 3, 3)]


def greedy(r2, n, threshold=0.8, most=12):
    blocks, i = [], 0
    while i < n - 1:
        for j in range(min(n - 1, i + most - 1), i, -1):
            if all(r2.get((a, b), 0) >= threshold for a, b in itertools.combinations(range(i, j + 1), 2)):
                blocks.append((i, j))
                break
        else:
            i += 1
            continue
        i = j + 1
    return blocks


def test_ld_blocks_by_brute_force(spark):
    """Long linked stretches (more loci than one block may hold) and noisy ones."""
    rng = np.random.default_rng(7)
    rows, loci, want = [], [], {}
    for name, noise in (("clean", 0.0), ("noisy", 0.15), ("loose", 0.5)):
        r2 = {(i, j): 0.2 if rng.random() < noise else 0.95 for i in range(70) for j in range(i + 1, min(i + 12, 70))}
        rows += [(name, i, j, v) for (i, j), v in r2.items()]
        loci += [(name, i) for i in range(70)]
        want |= {name: greedy(r2, 70)}
    got = ld.ld_blocks(spark.createDataFrame(rows, "region string, i int, j int, r2 double"), spark.createDataFrame(loci, "region string, i int"), "region")
    found = {}
    for b in got.collect():
        found.setdefault(b.region, []).append((b.start, b.end))
    assert {k: sorted(v) for k, v in found.items()} == want


def test_haplotype_counts_case(spark):
    alleles = spark.createDataFrame([("s", "r", 1, 0, 1), ("s", "r", 2, 1, 1), ("gap", "r", 1, 0, 0)], "sample string, region string, site int, a1 int, a2 int")
    sites = spark.createDataFrame([("r", 1), ("r", 2)], "region string, site int")
    haps = haplotypes.sample_haplotypes(alleles, sites)
    assert {(r.hap, r.freq) for r in haplotypes.haplotype_counts(haps, ["region"]).collect()} == {("01", 0.5), ("11", 0.5)}


def test_em_against_brute_force(spark):
    rng = np.random.default_rng(8)
    pool = ["000", "110", "011", "101"]
    people = [(pool[a], pool[b]) for a, b in rng.choice(4, (200, 2), p=[0.5, 0.25, 0.15, 0.1])]
    genos = ["".join(str(int(a) + int(b)) for a, b in zip(*pair)) for pair in people]
    freq = {h: 1 / 8 for h in map("".join, itertools.product("01", repeat=3))}
    for _ in range(200):
        expected = dict.fromkeys(freq, 0.0)
        for g in genos:
            fits = [(a, b) for a in freq for b in freq if all(int(x) + int(y) == int(z) for x, y, z in zip(a, b, g))]
            total = sum(freq[a] * freq[b] for a, b in fits)
            for a, b in fits:
                expected[a] += freq[a] * freq[b] / total
                expected[b] += freq[a] * freq[b] / total
        freq = {h: v / (2 * len(genos)) for h, v in expected.items()}
    df = spark.createDataFrame([(i, "r", g) for i, g in enumerate(genos)], "sample int, region string, g string")
    got = {r.hap: r.freq for r in haplotypes.em_haplotypes(df, passes=25, tolerance=1e-9, display=0.01).collect()}
    assert got == pytest.approx({h: v for h, v in freq.items() if v >= 0.01}, abs=1e-3)


def test_permutation_tail_matches_draws(spark):
    df = spark.createDataFrame([(1, 9, 11, 4, 26), (2, 3, 17, 5, 25)], "k int, a int, b int, c int, d int")
    for r in resampling.permutation_difference(df, ["k"], ("a", "b", "c", "d"), 20000).collect():
        assert r.p_permutation == pytest.approx(r.p_exact, abs=0.012)


def test_poisson_bootstrap_spread(spark):
    rng = np.random.default_rng(9)
    x, noise = rng.normal(0, 1, 400), rng.normal(0, 1, 400)
    df = spark.createDataFrame([(i, float(a), float(2 * a + b)) for i, (a, b) in enumerate(zip(x, noise))], "i int, x double, y double").withColumn("k", F.lit("k"))
    r = resampling.bootstrap_slope(df, ["k"], F.col("i"), "x", "y", 200).first()
    half = 1.96 / math.sqrt(400)
    assert r.original_slope == pytest.approx(2, abs=0.15) and r.high - r.low == pytest.approx(2 * half, rel=0.3) and not r.crosses_zero


def test_mediation_adjusted_against_least_squares(spark):
    rng = np.random.default_rng(10)
    x, c = rng.integers(0, 3, 200).astype(float), rng.normal(50, 5, 200)
    m = 0.7 * x + 0.1 * c + rng.normal(0, 1, 200)
    y = 0.5 * m + 0.3 * x + rng.normal(0, 1, 200)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(zip(x, c, m, y))], "i int, x double, c double, m double, y double").withColumn("k", F.lit("k"))
    r = resampling.mediation(df, ["k"], F.col("i"), "x", "m", "y", ["c"], 40).first()
    one = np.ones(200)
    a = np.linalg.lstsq(np.column_stack([one, x, c]), m, rcond=None)[0][1]
    both = np.linalg.lstsq(np.column_stack([one, x, c, m]), y, rcond=None)[0]
    assert (r.a, r.b, r.direct) == pytest.approx((a, both[3], both[1]), rel=1e-6)


def test_permanova_identity_and_p(spark):
    rng = np.random.default_rng(11)
    rows = [(i, "ab"[i % 2], float(rng.gamma(2 + 4 * (i % 2), 1)), float(rng.gamma(2, 1)), float(rng.gamma(2, 1))) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, g string, p double, q double, r double").withColumn("k", F.lit("k"))
    r = expression.clr_permanova(df, ["k"], "i", "g", ["p", "q", "r"], 99).first()
    assert r.between_ss + r.within_ss == pytest.approx(r.total_ss) and r.p_value == pytest.approx(0.01)


def test_sparse_rank_test_equals_dense(spark):
    rng = np.random.default_rng(12)
    values = [(i, "v", float(rng.integers(0, 9))) for i in range(120)]
    carriers = [(int(i), "e") for i in rng.choice(120, 40, replace=False)]
    v = spark.createDataFrame(values, "sample int, var string, value double")
    c = spark.createDataFrame(carriers, "sample int, exposure string")
    sparse = ranktests.carrier_rank_tests(v, c, ["var"], "exposure").first()
    dense = ranktests.mann_whitney(v.join(c, "sample", "left").withColumn("f", F.col("exposure").isNotNull()), ["var"], "value", "f").first()
    assert (sparse.u, sparse.p_value, sparse.n1, sparse.n2) == pytest.approx((dense.u, dense.p_value, dense.n1, dense.n2))


def test_exact_test_of_huge_and_extreme_tables(spark):
    n = 3 * 10**9
    rows = [(n, n + 10**5, n, n - 10**5), (330, 0, 0, 330), (0, 0, 0, 0), (5, 0, 3, 0), (None, 1, 1, 1)]
    got = [r.p for r in contingency.fisher_2x2(spark.createDataFrame(rows, "a bigint, b bigint, c bigint, d bigint"), ("a", "b", "c", "d"), "p").orderBy("a", "b").collect()]
    z = (n / (2 * n + 10**5) - n / (2 * n - 10**5)) / math.sqrt(0.25 / n)
    assert got[0] is None and got[1] == 1.0 and got[2] == 1.0
    assert got[3] == pytest.approx(2 / math.comb(660, 330), rel=1e-10)
    assert got[4] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-3)


def test_difference_tails_by_brute_force():
    from carrierlake.functions.pvalues import difference_tails

    rng = np.random.default_rng(13)
    for _ in range(200):
        a, b, c, d = (int(x) for x in rng.integers(0, 25, 4))
        n1, n2, m = a + b, c + d, a + c
        if not n1 or not n2:
            continue
        pmf = {k: math.comb(n1, k) * math.comb(n2, m - k) for k in range(max(0, m - n2), min(n1, m) + 1)}
        gap = abs(a * n2 - c * n1)
        low = sum(v for k, v in pmf.items() if k * n2 < (m - k) * n1 and abs(k * n2 - (m - k) * n1) >= gap) / sum(pmf.values())
        high = sum(v for k, v in pmf.items() if k * n2 >= (m - k) * n1 and abs(k * n2 - (m - k) * n1) >= gap) / sum(pmf.values())
        assert difference_tails(a, b, c, d) == pytest.approx((low, high), rel=1e-9, abs=1e-14)


def test_tails_at_large_degrees_of_freedom():
    from carrierlake.functions.pvalues import beta_lower, gamma_upper

    for dof in (1e3, 1e6, 1e8, 1e9):
        skew = 2 / math.sqrt(2 * math.pi) / 3 / math.sqrt(dof / 2)  # the median lies below the mean
        assert gamma_upper(np.array([dof / 2]), np.array([dof / 2]))[0] == pytest.approx(0.5 - skew / 2, abs=3e-5)
        assert beta_lower(np.array([dof / 2]), np.array([0.5]), np.array([dof / (dof + 4)]))[0] == pytest.approx(math.erfc(math.sqrt(2)), rel=4 / dof + 2e-3)


def test_nan_takes_no_part_in_ranks(spark):
    rows = [("k", float(i), i % 2 == 0) for i in range(30)]
    clean = ranktests.mann_whitney(spark.createDataFrame(rows, "k string, v double, f boolean"), ["k"], "v", "f").first()
    dirty = spark.createDataFrame(rows + [("k", float("nan"), True), ("k", None, False)] * 5, "k string, v double, f boolean")
    assert ranktests.mann_whitney(dirty, ["k"], "v", "f").first() == clean
    assert sum(r.avg_rank is None for r in ranking.attach_ranks(dirty, ["k"], "v").collect()) == 10


def test_control_only_and_missing(spark):
    """A variant only a control carries has a row in every comparison; an unusable call leaves one denominator only."""
    from carrierlake.operators import compare, variants

    samples = spark.createDataFrame([(1, "A", "Tumour"), (2, "B", "Tumour"), (3, "A", "Healthy"), (4, "B", "Healthy")], "sample int, cohort string, tissue string")
    calls = spark.createDataFrame([(3, "v", 2), (1, "w", 1)], "sample int, variant string, dosage int")
    missing = spark.createDataFrame([(2, "w"), (4, "v")], "sample int, variant string")
    got = {(r.comparison, r.variant): r for r in compare.genotype_counts(calls, samples, missing=missing).collect()}
    assert set(got) == {(c, v) for c in ("A", "B", "All") for v in "vw"}
    v, w = got["B", "v"], got["All", "w"]
    assert (v.case_callable, v.case_het + v.case_hom, v.control_callable, v.control_hom, v.control_wt) == (1, 0, 1, 1, 0)
    assert (w.case_callable, w.case_het, w.case_wt, w.control_callable) == (1, 1, 0, 2)
    screen = compare.case_vs_control(calls, samples, ["variant"], ["comparison"], min_total=1)
    status = {(r.comparison, r.variant): r.variant_status for r in variants.status_direction(screen).collect()}
    assert status["B", "v"] == "normal_only" and status["A", "w"] == "tumour_only"


def test_unsettled_dose_fits_fall_back(spark):
    columns = ["case_wt", "case_het", "case_hom", "control_wt", "control_het", "control_hom"]
    counts = spark.createDataFrame([("fit", 40, 20, 9, 60, 15, 4), ("tiny", 1, 1, 0, 2, 0, 0)], "v string, " + ", ".join(f"{c} bigint" for c in columns))
    got = {r.v: r for r in regression.dose_risk(counts, ["v"]).collect()}
    assert got["fit"].model == "penalised" and 1 < got["fit"].odds_ratio < 4
    assert got["tiny"].model == "exact" and 0 <= got["tiny"].p_value <= 1


def test_regions_of_too_many_sites_fail(spark):
    long = spark.createDataFrame([("s", "r", "1" * 13)], "sample string, region string, g string")
    with pytest.raises(Exception, match="at most 12 sites"):
        haplotypes.em_haplotypes(long)
