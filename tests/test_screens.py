"""Screens with implicit zeros against dense fits, sample pairs against all pairs, kernels against the draws they replace."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from carrierlake.functions.draws import draw_matrix, with_uniform
from carrierlake.operators import expression, ranktests, regression, screens, similarity, survival
from carrierlake.sources import text


def test_screen_equals_dense_fits(spark):
    """Two covariates with nulls, two outcomes, a hot exposure that most samples carry, samples without any call."""
    rng = np.random.default_rng(8)
    samples = [(i, int(rng.integers(0, 9)) if i % 9 else None, int(rng.integers(0, 6)) if i % 7 else None) for i in range(600)]
    doses = {(i, v): int(rng.choice([1, 2])) for i in range(0, 590) for v, rate in (("hot", 0.7), ("b", 0.2), ("c", 0.05)) if rng.random() < rate}
    y = {(i, o): int(rng.random() < 1 / (1 + np.exp(1 - 0.4 * doses.get((i, "b"), 0) - 0.1 * (a or 0)))) for i, a, _ in samples for o in ("p", "q")}
    outcomes = spark.createDataFrame([(i, o, y[i, o], a, b) for i, a, b in samples for o in ("p", "q")] + [(7, "p", None, 1, 1)], "sample int, var string, y int, age int, bmi int")
    carriers = spark.createDataFrame([(i, v, d) for (i, v), d in doses.items()] + [(3, "hot", 0)], "sample int, variant string, dosage int")
    got = {(r["var"], r.variant, r.model): r for r in screens.carrier_screen(carriers, outcomes, "variant", ["var"], "y", screens.risk_models()).collect()}
    assert len(got) == 2 * 3 * 6
    dense = spark.createDataFrame([(o, v, y[i, o], doses.get((i, v), 0), a, b) for i, a, b in samples for o in ("p", "q") for v in ("hot", "b", "c")], "var string, variant string, y int, dose int, age int, bmi int")
    frames = {
        "unadjusted": (dense.withColumn("x", (F.col("dose") > 0).cast("int")), []), "age": (dense.withColumn("x", (F.col("dose") > 0).cast("int")), ["age"]),
        "age_bmi": (dense.withColumn("x", (F.col("dose") > 0).cast("int")), ["age", "bmi"]), "het_vs_wt": (dense.where("dose < 2").withColumn("x", F.col("dose")), []),
        "hom_vs_wt": (dense.where("dose <> 1").withColumn("x", (F.col("dose") / 2).cast("int")), []), "trend": (dense.withColumn("x", F.col("dose")), []),
    }
    for model, (frame, own) in frames.items():
        for r in regression.logit_by_key(frame, ["var", "variant"], "y", "x", own, min_events=1).collect():
            g = got[r["var"], r.variant, model]
            assert (g.n, g.events, g.converged) == (r.n, r.events, r.converged)
            assert g.beta == pytest.approx(r.beta, abs=1e-6) and g.se == pytest.approx(r.se, rel=1e-5) and g.p_value == pytest.approx(r.p_value, abs=1e-6)


def test_screen_edges(spark):
    outcomes = spark.createDataFrame([(i, i % 2, 5) for i in range(20)], "sample int, y int, age int")
    carriers = spark.createDataFrame([(i, "all", 1) for i in range(20)] + [(i, "some", 1 + i % 2) for i in range(8)] + [(99, "none", 1)], "sample int, variant string, dosage int")
    models = screens.clinical_models(bmi="age")
    rows = screens.carrier_screen(carriers, outcomes, "variant", [], "y", models).collect()
    assert {r.variant for r in rows} == {"some"} and len({round(r.beta, 6) for r in rows}) == 1  # a constant covariate changes nothing
    assert screens.carrier_screen(carriers.limit(0), outcomes, "variant", [], "y", models).count() == 0
    assert screens.carrier_screen(carriers, outcomes.limit(0), "variant", [], "y", models).count() == 0


def planted(rng, n=120, loci=60):
    sets = {}
    for i in range(n):
        kept = rng.choice(loci, 40, replace=False)
        sets[i] = {int(k): rng.choice(["Het_ALT", "Hom_ALT", "WT"]) for k in kept}
    for i in range(0, 30):  # one or two loci missing, or one genotype changed
        copy = dict(sets[i])
        keys = list(copy)
        if i % 3 == 0:
            copy.pop(keys[0])
        elif i % 3 == 1:
            copy.pop(keys[0]), copy.pop(keys[1])
        else:
            copy[keys[0]] = "WT" if copy[keys[0]] != "WT" else "Het_ALT"
        sets[1000 + i] = copy
    for i in range(40, 50):
        sets[2000 + i] = dict(sets[i])
    return sets


@pytest.mark.parametrize("block", [4, 256])
def test_near_identical_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity.candidate_pairs, "__defaults__", (similarity.BANDS, similarity.PER_BAND, block))
    sets = planted(np.random.default_rng(3))
    calls = spark.createDataFrame([(s, k, c) for s, own in sets.items() for k, c in own.items()], "sample int, locus int, call string")
    classes = calls.select("locus", F.lit("common").alias("frequency_class")).distinct()
    unique = {}
    for s in sorted(sets):
        unique.setdefault(frozenset(sets[s].items()), s)
    want = {}
    for (a, x), (b, y) in itertools.combinations(sorted((s, k) for k, s in unique.items()), 2):
        if len(a_ := x & y) / len(x | y) >= 0.9:
            want[a, b] = len(a_)
    rows = similarity.near_identical(calls, classes).collect()
    assert {(r.sample_1, r.sample_2): r.exact_all for r in rows} == want and len(want) >= 30
    assert all(r.copies_1 == (2 if 40 <= r.sample_1 < 50 else 1) for r in rows)


def test_candidates_need_no_full_pairing(spark):
    sets = planted(np.random.default_rng(4), n=300)
    calls = spark.createDataFrame([(s, k, c) for s, own in sets.items() for k, c in own.items()], "sample int, locus int, call string")
    pairs = similarity.candidate_pairs(calls)
    assert 30 <= pairs.count() < 0.05 * len(sets) ** 2 / 2
    assert "CartesianProduct" not in pairs._jdf.queryExecution().toString() and "NestedLoop" not in pairs._jdf.queryExecution().toString()


def test_one_common_signature_is_split(spark):
    """Three hundred samples of one genotype in one bucket: every pair once, from blocks."""
    calls = spark.createDataFrame([(s, k, "WT") for s in range(60) for k in range(5)], "sample int, locus int, call string")
    assert similarity.candidate_pairs(calls, bands=2, per_band=2, block=7).count() == 60 * 59 // 2


def test_draws_are_the_same_in_numpy(spark):
    ids = [0, 1, 7, 2**31, 2**40 + 5, -3]
    rows = with_uniform(spark.createDataFrame([(i, p) for i in ids for p in (1, 2, 499)], "id bigint, p int"), "u", [F.col("p"), F.col("id")], 42).collect()
    draws = draw_matrix([np.array([1, 2, 499])[:, None], np.array(ids)[None, :]], 42) / 2.0**32
    for r in rows:
        assert draws[[1, 2, 499].index(r.p), ids.index(r.id)] == r.u


def test_cox_moves_on_where_a_set_is_missing(spark):
    rng = np.random.default_rng(6)
    rows = [(k, float(rng.integers(1, 60)), int(rng.random() < 0.6), int(rng.random() < 0.5), float(rng.normal()) if k != "none" else None, float(rng.normal()) if k == "both" else None) for k in ("both", "one", "none") for _ in range(80)]
    df = spark.createDataFrame(rows, "k string, t double, e int, x int, age double, bmi double")
    got = {r.k: r for r in survival.cox_with_fallback(df, ["k"], "t", "e", "x", [["age", "bmi"], ["age"], []]).collect()}
    assert {k: r.adjustment for k, r in got.items()} == {"both": "age+bmi", "one": "age", "none": "unadjusted"} and all(r.n_total == 80 for r in got.values())
    alone = survival.cox_by_key(df.where("k = 'one'"), ["k"], "t", "e", ["x", "age"]).first()
    assert got["one"].beta == pytest.approx(alone.beta, abs=1e-9)


def test_pca_per_key_equals_eigen_solve(spark):
    rng = np.random.default_rng(3)
    rows = [(k, i, *map(float, rng.normal(size=3) @ rng.normal(size=(3, 3))), 7.0) for k in ("a", "b") for i in range(30)] + [("few", 0, 1.0, 2.0, 3.0, 7.0), ("a", 99, None, 1.0, 1.0, 7.0)]
    df = spark.createDataFrame(rows, "k string, id int, x double, y double, z double, same double")
    got = expression.pca_by_key(df, ["k"], ["x", "y", "z", "same"], 2).toPandas()
    assert set(got.k) == {"a", "b"} and 99 not in set(got.id)
    for k in ("a", "b"):
        own = got[got.k == k].sort_values("id")
        data = own[["x", "y", "z"]].to_numpy()
        data = (data - data.mean(0)) / data.std(0, ddof=1)
        values, vectors = np.linalg.eigh(np.corrcoef(data.T))
        vectors = vectors[:, ::-1] * np.where(vectors[0, ::-1] < 0, -1, 1)
        assert np.allclose(own[["pc1", "pc2"]], data @ vectors[:, :2], atol=1e-9)
        assert np.allclose(own[["explained1", "explained2"]].iloc[0], values[::-1][:2] / 3, atol=1e-12)


def test_pass_only_repeats_passing_rows(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, ok boolean")
    got = sorted((r.variant, r.id) for r in expression.with_pass_only(df, "ok").collect())
    assert got == [("all", 1), ("all", 2), ("all", 3), ("pass", 1)]


def test_panel_layout_names_every_column(spark):
    lines = ["track name=x", "Chrom\tStart\tEnd\tName\trsID\tGene\tPool_1\tgene\tPool-1\r", "1\t5\t9\ta\tr\tg\tp\tq\tr\ts", "2\t5\t9"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    names = text.panel_layout(df)
    assert names == [*text.PANEL_COLUMNS, "pool_1", "gene_2", "pool_1_2", "extra_4"]
    got = {r.chr: r for r in text.parse_panel(df, extras=names[6:]).collect()}
    assert got["chr1"].pool_1_2 == "r" and got["chr1"].extra_4 == "s" and got["chr2"].pool_1 is None and len(got) == 2
    empty = df.where("false")
    assert text.panel_layout(empty) == text.PANEL_COLUMNS and text.parse_panel(empty).count() == 0


def test_typed_association_edges(spark):
    """Ties on one side, small groups, odd answers and too few samples."""
    values = spark.createDataFrame([(i, "g", float(i % 7)) for i in range(24)] + [(i, "flat", 1.0) for i in range(24)] + [(30, "g", None)], "sample int, feature string, value double")
    answers = [(i, "num", "continuous", str(i % 5)) for i in range(24)] + [(0, "num", "continuous", "x")]
    answers += [(i, "bin", "binary", "2" if i > 20 else str(i % 2)) for i in range(24)] + [(i, "cat", "nominal", "abc"[i % 3] if i < 22 else "z") for i in range(24)] + [(i, "short", "continuous", str(i)) for i in range(9)]
    outcomes = spark.createDataFrame(answers, "sample int, outcome string, kind string, answer string")
    got = {(r.feature, r.outcome): r for r in ranktests.typed_association(values, outcomes, ["feature"], ["feature"]).collect()}
    assert {k for k in got if k[0] == "g"} == {("g", "num"), ("g", "bin"), ("g", "cat")}
    assert got["g", "num"].n == 24 and got["g", "bin"].n == 21 and got["g", "cat"].n == 22
    assert ("flat", "num") not in got and ("flat", "cat") not in got and all(r.fdr >= r.p_value for r in got.values())
    none = ranktests.typed_association(values.where("false"), outcomes, ["feature"], ["feature"])
    assert none.count() == 0


def test_keys_without_a_finite_hazard_are_known_before_any_pass(spark):
    rows = [("all_in_arm", 1, 1), ("all_in_arm", 0, 0), ("all_in_arm", 0, 1), ("both", 1, 1), ("both", 1, 0), ("none", 0, 1), ("none", 0, 0)]
    df = spark.createDataFrame(rows, "k string, e int, x int")
    assert [r.k for r in survival.estimable(df, ["k"], "e", "x").collect()] == ["both"]


def test_a_constant_side_has_no_rank_correlation(spark):
    df = spark.createDataFrame([("flat", 1.0, float(i)) for i in range(5)] + [("rise", float(i), float(i)) for i in range(5)], "k string, x double, y double")
    got = {r.k: (r.rho, r.p_value) for r in ranktests.spearman(df, ["k"], "x", "y").collect()}
    assert got == {"flat": (None, None), "rise": (1.0, 0.0)}
