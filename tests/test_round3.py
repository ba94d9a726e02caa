"""Cases of the third review: each failed before its change."""

import random
import time

import pytest
from pyspark.sql import functions as F

from carrierlake import session
from carrierlake.functions.sequence import sequence_metrics
from carrierlake.operators import burden, compare, harmonise, intervals, resampling, similarity, survival, variants
from carrierlake.plans import clinical
from carrierlake.sources import text


def test_empty_arms_and_null_cells_have_no_permutation_test(spark):
    rows = [(1, 9, 11, 4, 26), (2, 0, 0, 4, 6), (3, 3, 4, 0, 0), (4, None, 1, 2, 3)]
    df = spark.createDataFrame(rows, "k int, a int, b int, c int, d int")
    got = resampling.permutation_difference(df, ["k"], ("a", "b", "c", "d"), 200).collect()
    assert [r.k for r in got] == [1] and 0 < got[0].p_exact <= 1


def test_harmonise_clinical_has_every_column(spark):
    texts = ["MSI-H", "MSS", "stable", "unstable", "dMMR", "pMMR", "?", "intact"]
    got = spark.createDataFrame([(x,) for x in texts], "raw string").select(harmonise.msi_status(F.col("raw")).alias("v")).collect()
    assert [r.v for r in got] == ["MSI", "MSS", "MSS", "MSI", "MSI", "MSS", None, "MSS"]
    assert "msi" in clinical.CASES and "msi" in clinical.RULES


def test_km_counts_durations_of_zero(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 0, 0), ("a", 3, 1), ("a", 5, 0), ("a", None, 1)], "k string, t int, e int")
    got = {r.t: (r.at_risk, r.events, r.survival) for r in survival.km_table(df, ["k"], "t", "e").collect()}
    assert {t: v[:2] for t, v in got.items()} == {0: (4, 1), 3: (2, 1), 5: (1, 0)}
    assert [got[t][2] for t in (0, 3, 5)] == pytest.approx([0.75, 0.375, 0.375])


def brute_metrics(s, window=20):
    size, w = len(s), min(window, len(s))
    def stretch(k):
        return max(map(len, "".join("1" if s[i] == s[i + k] else "0" for i in range(size - k)).split("0")))
    gc = [sum(x in "GC" for x in s[i : i + w]) * 100.0 / w for i in range(size - w + 1)]
    stem = lambda i: s[i : i + 6][::-1].translate(str.maketrans("ACGT", "TGCA"))
    g, c = s.count("G"), s.count("C")
    return (
        (g + c) * 100.0 / size, (g - c) / (g + c) if g + c else 0.0, max(gc), min(gc), stretch(1) + 1,
        max((stretch(k) + k) // k * k if stretch(k) >= k else 0 for k in (2, 3)), any(stem(i) in s[i + 6 :] for i in range(size - 11)),
    )


def test_sequence_metrics_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["A", "AC", "ACA", "GGG", "ACGTN", "A" * 12, "ACGTACGTACGT", "AAACCCGGGTTT", "AAACCCXGGGTTT", "ATATATA", "ÉÑACGTÉÑ😀ACGT"]
    texts += ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ACGT", "AC", "ACGTN") for n in (11, 12, 13, 20, 21, 60, 400) for _ in range(4)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, "", None])], "i int, s string")
    got = {r.i: tuple(r)[1:] for r in rows.select("i", sequence_metrics(F.col("s")).alias("m")).select("i", "m.*").collect()}
    assert [got[i] for i in range(len(texts))] == [brute_metrics(x) for x in texts]
    assert got[len(texts)] == got[len(texts) + 1] == (None,) * 7


def test_sequence_metrics_of_a_long_text_takes_seconds(spark):
    """Before, each window and each stem read the whole text."""
    rng = random.Random(6)
    text = "".join(rng.choice("AC") for _ in range(400_000))
    begin = time.time()
    got = spark.createDataFrame([(text,)], "s string").select(sequence_metrics(F.col("s")).alias("m")).first().m
    assert time.time() - begin < 30 and not got.hairpin and got.gc_pct == text.count("C") * 100.0 / len(text)


def test_targets_by_class_against_all_pairs(spark):
    """Repeated and null keys, several rs ids, targets of one id with two spans and rs ids; no row per pair is needed."""
    rng = random.Random(8)
    name = lambda: f"rs{rng.randrange(6)}"
    v = [(rng.choice([None, *range(60)]), rng.choice("AB"), rng.randrange(0, 60) * 10, rng.choice(["A", "ACG", "-"]), [name() for _ in range(rng.randrange(3))]) for _ in range(120)]
    t = [(rng.choice([None, *range(25)]), rng.choice("AB"), (p := rng.randrange(0, 600)), p + rng.randrange(40), rng.choice(["", " ", None, name()]), rng.choice(["x", "y", "z", None])) for _ in range(50)]
    variants = spark.createDataFrame(v, "key int, chrom string, pos bigint, ref string, rsids array<string>")
    targets = spark.createDataFrame(t, "target_id int, chrom string, t_first bigint, t_last bigint, rsid string, label string")
    pairs, kinds = set(), {}
    for key, chrom, pos, ref, rsids in v:
        for target, tc, first, last, rsid, label in t:
            rsid = (rsid or "").strip()
            span, rs = chrom == tc and first <= pos + max(len(ref.replace("-", "")), 1) - 1 and pos <= last, rsid in rsids
            if key is not None and (span or rs):
                pairs.add((key, target, label))
                kind = kinds.setdefault(key, [False, False, False])
                kind[:] = kind[0] or span, kind[1] or rs, kind[2] or (span and not rsid)
    matched, links = intervals.match_variants_to_targets(variants, targets)
    assert {tuple(r) for r in links.pairs().collect()} == pairs
    rows = matched.collect()
    assert len(rows) == len(v)
    for r in rows:
        span, rs, bare = kinds.get(r.key, (False, False, False))
        assert r.match_type == {(1, 1): "both", (1, 0): "interval", (0, 1): "rsID", (0, 0): "none"}[span, rs] and r.extra_finding == (not (rs or bare))
        assert r.target_labels == "; ".join(sorted({label for key, _, label in pairs if key == r.key and label}))
    for r in intervals.targets_summary(targets, links).collect():
        keys = sorted({key for key, target, _ in pairs if target == r.target_id and target is not None})
        assert r.n_variants == len(keys) and r.examples == "; ".join(sorted(map(str, keys[:5]))) and r.any_variant == bool(keys)


def test_samples_that_are_not_alike_do_not_meet(spark):
    """Random sets over few tokens, as many samples have: minwise bands let a pair in a thousand meet, parts next to none, and lose none that are alike."""
    rng = random.Random(9)
    base = [frozenset(rng.sample(range(200), rng.randrange(9, 70))) for _ in range(700)]
    changed = [x ^ set(rng.sample(range(200), rng.randrange(1, 5))) for x in base[:120]]
    sets = dict(enumerate({*base, *map(frozenset, changed)}))
    calls = spark.createDataFrame([(i, x, "WT") for i, own in sets.items() for x in own], "sample int, locus int, call string")
    alike = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) * 10 >= 9 * len(sets[i] | sets[j])}
    got = {tuple(r) for r in similarity.candidate_pairs(calls, threshold=0.9).collect()}
    assert len(alike) > 30 and alike <= got and len(got) < 2 * len(changed)


def test_a_filter_on_parsed_calls_splits_a_line_once(spark):
    """Pushed below the fields, the filter of one chromosome used to split the line at each of its mentions."""
    lines = [f"{c}\t{p}\t.\tC\tG\t30\t{f}\tDP={d}\tGT:AF\t0/1:0.5\r" for p, (c, f, d) in enumerate([("7", "PASS", 60), ("chr7", "PASS", 50), ("7", "LOW", 60), ("8", "PASS", 60), ("7", "PASS", 49)])]
    calls = text.parse_calls(spark.createDataFrame([(x,) for x in lines], "value string"), ["Allele"])
    got = text.simple_snvs(text.passing_sites(calls), "chr7")
    assert sorted((r.CHROM, r.POS, r.DP) for r in got.collect()) == [("chr7", 0, 60), ("chr7", 1, 50)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(replace(") == 1


def dealt(df) -> bool:
    return "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_task_do_not_grow_with_the_files(spark, tmp_path, monkeypatch):
    """More bytes of input than the shuffle partitions hold: rows are dealt into more, with the same pairs and carriers."""
    rng = random.Random(3)
    rows = sorted({(rng.randrange(300), f"v{rng.randrange(9)}", rng.choice("CGT")) for _ in range(2000)})
    spark.createDataFrame(rows, "sample int, v string, alt string").write.parquet(f"{tmp_path}/rows")
    table = spark.read.parquet(f"{tmp_path}/rows")
    samples = spark.range(300).select(F.col("id").cast("int").alias("sample"), F.lit("a").alias("cohort"), F.when(F.col("id") % 2 == 0, "Tumour").otherwise("Healthy").alias("tissue"))
    held = {}
    for sample, v, _ in rows:
        held.setdefault(sample, set()).add(v)
    pairs = {}
    for own in held.values():
        for a in own:
            for b in own:
                if a < b:
                    pairs[a, b] = pairs.get((a, b), 0) + 1
    assert not dealt(burden.co_carried_pairs(table, "v", 3))
    monkeypatch.setattr(session, "SPREAD_BYTES", 64)
    got = burden.co_carried_pairs(table, "v", 3)
    assert dealt(got) and {(r["first"], r["second"]): r.n for r in got.collect()} == {k: n for k, n in pairs.items() if n >= 3}
    asked = []
    monkeypatch.setattr(compare, "spread", lambda *tables: asked.append([c for _, c in tables]) or session.spread(*tables))
    hot = compare.hotspots(table, samples, ["v"], "alt").where("comparison = 'All'").collect()
    assert asked == [[["sample"], ["sample"]]]
    assert {r.v: r.case_carriers + r.control_carriers for r in hot} == {f"v{i}": sum(f"v{i}" in own for own in held.values()) for i in range(9)}


def test_annotations_are_expanded_once(spark):
    """Five aggregates read the written rows; each used to repeat the joins that made them."""
    rows = [(1, s, "a", 60, 0.5, 0.02, "", "-", ".", "missense_variant", "", f"t{s}", s) for s in (1, 2, 2)]
    names = "key int, sample int, cohort string, dp int, af double, f double, PICK string, CANONICAL string, MANE_SELECT string, Consequence string, IMPACT string, Feature string, o int"
    out = variants.collapse_annotations(spark.createDataFrame(rows, names), "key", "o", "f")
    files = out.inputFiles()
    assert files and all("/carrierlake-" in f for f in files)
    r = out.first()
    assert (r.n_samples, r.n_transcript_rows, r.common, r.transcript, r.impact, r.basis) == (2, 3, True, "t1", "MODERATE", "worst_available_transcript")
