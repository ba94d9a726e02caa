"""Small hand cases whose values follow from the written rule."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from carrierlake.functions import annotation, clinical, genotype, keys
from carrierlake.functions.pvalues import beta_lower, gamma_upper, log_factorial, normal_two_sided
from carrierlake.operators import contingency, coverage, decisions, expression, intervals, ld, ranktests, regression, similarity, variants
from carrierlake.sources import tables, text


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v")).alias("r")).collect()]


def test_norm_chrom(spark):
    assert column(spark, ["17", "chrx", "MT", None], keys.norm_chrom) == ["chr17", "chrX", "chrM", ""]


def test_parse_gt(spark):
    assert column(spark, ["0|1", "1/1", "./.", "1/2"], lambda c: genotype.parse_gt(c)["dosage"]) == [1, 2, None, None]
    assert column(spark, ["1/2"], lambda c: genotype.parse_gt(c, strict=False)["dosage"]) == [3]


def test_classify_genotype(spark):
    calls = ["0/0", "0/1", "1/1", "1/2", "./.", None]
    got = column(spark, calls, lambda c: genotype.classify_genotype(c, F.lit(60)))
    assert got == ["WT", "Het_ALT", "Hom_ALT", "Other_ALT_model", "No_call", "No_call"]
    assert column(spark, ["0/1"], lambda c: genotype.classify_genotype(c, F.lit(0))) == ["No_call"]
    assert column(spark, ["Het_ALT"], lambda c: genotype.threshold_status(c, F.lit(49))) == ["Below_DP_threshold"]


def test_allele_depths(spark):
    assert tuple(column(spark, ["30,8,2"], lambda c: genotype.allele_depths(c, F.lit(40)))[0]) == (30, 10, 0.25)
    assert tuple(column(spark, ["x,2"], lambda c: genotype.allele_depths(c, F.lit(40)))[0]) == (None, None, None)


def test_common_mask(spark):
    df = spark.createDataFrame([(0.01, None), (None, 0.02), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(keys.common_mask(0.01, F.col("a"), F.col("b"))).collect()] == [False, True, False]


def test_consequence(spark):
    worst = column(spark, ["intron_variant&splice_region_variant", None], annotation.worst_consequence)
    assert worst == ["splice_region_variant", ""]
    assert column(spark, worst, annotation.functional_class) == ["splice_site", ""]
    assert column(spark, worst, annotation.infer_impact) == ["LOW", ""]


def test_allelic_balance(spark):
    got = column(spark, [0.20, 0.45, 0.30], lambda c: genotype.allelic_balance(F.lit("0/1"), c), "double")
    assert got == ["POOR", "OPTIMAL", "ACCEPTABLE"]


def test_clip_overlap(spark):
    runs = spark.createDataFrame([("s", "chr1", 50, 120, 0), ("s", "chr1", 120, 150, 10), ("s", "chr1", 150, 300, 500)], "sample string, chr string, start long, end long, depth int")
    target = spark.createDataFrame([("chr1", "a", 100, 200)], "chr string, amplicon_id string, t_start long, t_end long")
    row = intervals.clip_overlap(runs, target).first()
    assert (row.zero_bases, row.pct_zero, row.low_bases, row.pct_low, row.covered_bases) == (20, 20.0, 50, 50.0, 100)


def test_overlap_of_very_different_lengths(spark):
    """Long runs over short targets and the reverse meet once, at any level."""
    spans = [(i, i * 37, i * 37 + (3 ** (i % 14))) for i in range(60)]
    left = spark.createDataFrame([("c", *s) for s in spans], "chr string, a long, s long, e long")
    right = spark.createDataFrame([("c", i, i * 911, i * 911 + 2 ** (i % 21)) for i in range(60)], "chr string, b long, t long, u long")
    got = {(r.a, r.b) for r in intervals.overlaps(left, right, "chr", ("s", "e"), ("t", "u")).collect()}
    rows = intervals.overlaps(left, right, "chr", ("s", "e"), ("t", "u")).count()
    want = {(a, i) for a, s, e in spans for i in range(60) if s <= i * 911 + 2 ** (i % 21) and i * 911 <= e}
    assert got == want and rows == len(want)


def test_closed_interval_end(spark):
    points = spark.createDataFrame([("chr17", 39908800), ("chr17", 39908801)], "chrom string, pos long")
    spans = spark.createDataFrame([("chr17", 39908600, 39908800, "w")], "chrom string, start long, end long, label string")
    got = intervals.point_in_interval(points, spans, "chrom", "pos", "start", "end", "label").orderBy("pos").collect()
    assert [(r.in_interval, r.labels) for r in got] == [(True, "w"), (False, None)]


def test_weighted_mean_coverage(spark):
    depth = spark.createDataFrame([("s", "a", 100, 50.0), ("s", "b", 300, 250.0)], "sample string, target string, length long, depth double")
    counts = spark.createDataFrame([("s", 10, 8, 4)], "sample string, total_reads long, mapped_reads long, on_target_reads long")
    row = coverage.sample_qc(depth, counts).first()
    assert (row.mean_cov, row.uniformity_100x, row.worst_target, row.mapped_pct, row.on_target_pct) == (200.0, 50.0, "a", 80.0, 50.0)
    assert coverage.qc_status(coverage.sample_qc(depth, counts)).first().fail_reasons == ["total_reads", "mapped_pct", "on_target_pct", "uniformity_100x"]


def test_odds_ratio_and_fisher(spark):
    df = spark.createDataFrame([(5, 0, 3, 4), (3, 1, 1, 3)], "a int, b int, c int, d int")
    ratio = contingency.odds_ratio(*[F.col(x) for x in "abcd"])
    assert df.select(ratio["odds_ratio"]).first()[0] == pytest.approx(14.142857, abs=1e-6)
    p = {r.a: r.p_value for r in contingency.fisher_2x2(df, ("a", "b", "c", "d")).collect()}
    assert p[3] == pytest.approx(34 / 70)


@pytest.mark.parametrize(
    "rule,cases",
    [
        (clinical.yes_no, {"Sí": "Yes", "NEG": "No", "1.0": "Yes", "?": None}),
        (clinical.bmi, {"60 kg; 168 cm": 21.26, "73 kg": None, "Sobrepeso": None, "27,5": 27.5}),
        (clinical.numeric_midpoint, {"20-25%": 22.5, ">50%": 50.0, "6,2": 6.2}),
        (clinical.figo_stage, {"FIGO 1A": "IA", "Stage IIIC1": "IIIC1", "x": None}),
        (clinical.parse_date, {"13/02/2020": datetime.date(2020, 2, 13), "02/13/2020": datetime.date(2020, 2, 13), "03/04/2020": datetime.date(2020, 4, 3)}),
    ],
)
def test_clinical_rules(spark, rule, cases):
    assert column(spark, list(cases), rule) == list(cases.values())


def test_coverage_gate(spark):
    rows = [("a", 10, 10, 0.49, 0.9, 0.9), ("b", 10, 10, 0.72, 0.65, 0.71), ("c", 10, 10, 0.60, 0.65, 0.71)]
    df = spark.createDataFrame(rows, "sample string, n_targets int, n_with_reads int, share_deep double, share_soft double, share_strict double")
    assert [r.risk_level for r in expression.coverage_risk(df).orderBy("sample").collect()] == ["High", "Low", "Moderate"]
    flags = spark.createDataFrame([(9999.0, None), (60000.0, 91.0), (60000.0, 95.0), (None, None)], "r double, q double")
    assert [r[0] for r in flags.select(expression.machine_flag(F.col("r"), F.col("q"))).collect()] == ["Hard_fail", "Warning", "Pass", "Unmatched"]


def test_published_tails():
    assert normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert gamma_upper(0.5, 3.841459 / 2) == pytest.approx(0.05, abs=1e-6)
    assert gamma_upper(5.0, 18.307038 / 2) == pytest.approx(0.05, abs=1e-6)
    t, dof = 2.228139, 10.0
    assert beta_lower(dof / 2, 0.5, dof / (dof + t * t)) == pytest.approx(0.05, abs=1e-6)


def test_log_factorial(spark):
    df = spark.range(0, 400).selectExpr("id", f"{log_factorial('id')} AS v")
    assert all(abs(r.v - math.lgamma(r.id + 1)) < 1e-10 for r in df.collect())


def test_parse_panel(spark):
    lines = ["track name=x", "17\t10\t20\ta1\trs5\tG\r", "chr17 10 20 a1 rs5 G", "chrX\t5\t9", "short\t1"]
    got = text.parse_panel(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("chr").collect()
    assert [(r.chr, r.start, r.start_1based, r.gene) for r in got] == [("chr17", 10, 11, "G"), ("chrX", 5, 6, None)]


def test_reader_files(spark, tmp_path):
    (tmp_path / "S1.depth.tsv").write_text("1\t0\t10\t5\n1\t10\t20\t0\n")
    assert {(r.sample, r.depth) for r in text.read_depth(spark, str(tmp_path / "*.tsv"), pattern=r"([^/.]+)[^/]*$").collect()} == {("S1", 5.0), ("S1", 0.0)}
    (tmp_path / "panel.txt").write_text("sample\tpop\tgender\nA\tGBR\t2\nA\tGBR\t2\nB\tFIN\tmale\n")
    assert {tuple(r) for r in text.read_reference_panel(spark, str(tmp_path / "panel.txt")).select("sample", "pop", "sex").collect()} == {("A", "GBR", "female"), ("B", "FIN", "male")}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.vcf").write_text(
        '##INFO=<ID=CSQ,Description="Format: Allele|Consequence">\n#CHROM\n17\t7\t.\tC\tA,T\t50\tPASS\tDP=60;CSQ=A|stop_gained\tGT:AO:RO\t0/1:30,1:30\n'
    )
    rows = text.read_variant_calls(spark, str(tmp_path / "c")).orderBy("ALT").collect()
    assert [(r.CHROM, r.POS, r.ALT, r.DP, r.AF, r.GT, r.Consequence) for r in rows] == [("chr17", 7, "A", 60, 0.5, "0/1", "stop_gained"), ("chr17", 7, "T", 60, 1 / 31, "0/1", None)]
    out = spark.range(3)
    tables.write_tables({"t": out}, str(tmp_path / "out"))
    assert tables.read_or_default(spark, str(tmp_path / "out" / "t"), "id bigint").count() == 3
    assert tables.read_or_default(spark, str(tmp_path / "none"), "id bigint").count() == 0


def test_titv_and_classes(spark):
    calls = spark.createDataFrame([("s", "A", "G"), ("s", "C", "T"), ("s", "A", "C"), ("s", "AT", "A")], "sample string, ref string, alt string")
    row = variants.titv(calls, ["ref", "alt"], ["sample"]).first()
    assert (row.ti, row.tv, row.skipped, row.ratio, row.status) == (2, 1, 1, 2.0, "OPTIMAL")


def test_pair_classes(spark):
    rows = [(True, True, 1.0), (True, False, 1.0), (False, False, 1.0), (False, False, 0.995), (False, False, 0.5)]
    df = spark.createDataFrame(rows, "c boolean, d boolean, concordance_all double")
    got = [r.classification.split("_")[0:3] for r in similarity.classify_pairs(df, "c", "d").collect()]
    assert got == [["SAME", "CODE", "EXACT"], ["SAME", "CODE", "DISTINCT"], ["DIFFERENT", "CODE", "IDENTICAL"], ["DIFFERENT", "CODE", "NEAR"], ["DISTINCT", "SAMPLES"]]


def test_late_date_forms(spark):
    from carrierlake.functions import clinical

    cases = {"2020/01/05": (2020, 1, 5), "5 Mar 2020": (2020, 3, 5), "05-march-2020": (2020, 3, 5), "20200105": (2020, 1, 5), "19991231": (1999, 12, 31), "99999999": None, "5 Foo 2020": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.d for r in df.select("t", clinical.parse_date(F.col("t")).alias("d")).collect()}
    assert got == {k: v and datetime.date(*v) for k, v in cases.items()}


def test_call_files_of_two_header_orders(spark, tmp_path):
    from carrierlake.sources import text

    head = '##INFO=<ID=CSQ,Number=.,Type=String,Description="x Format: {}">\n#CHROM\n'
    (tmp_path / "a.vcf").write_text(head.format("Allele|Consequence|SYMBOL") + "1\t10\t.\tCA\tC\t30\tPASS\tDP=60;CSQ=-|frameshift|G1\n")
    (tmp_path / "b.vcf").write_text(head.format("Allele|SYMBOL|Consequence|Extra") + "1\t20\t.\tC\tCT,G\t30\tPASS\tDP=60;CSQ=T|G2|insertion|e,Z|G3|odd|\n")
    rows = {(r.POS, r.ALT, r.Allele): (r.SYMBOL, r.Consequence, r.Extra) for r in text.read_variant_calls(spark, str(tmp_path / "*.vcf")).collect()}
    assert rows == {
        (10, "C", "-"): ("G1", "frameshift", None), (20, "CT", "T"): ("G2", "insertion", "e"), (20, "CT", "Z"): ("G3", "odd", None), (20, "G", None): (None, None, None),
    }


def test_decision_table_takes_the_first_row_and_keeps_other_texts(spark):
    """First row that holds; blank and placeholder texts decide nothing; sources that are not given leave their outputs out."""
    texts = ["MSI", "no loss", "unstable ", "", None, "NaN"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, `msi text` string")
    out = decisions.coded(decisions.decide(df, decisions.CLINICAL_TABLE, {"msi": "msi text"}))
    assert out.columns == ["i", "msi text", "canon__msi_status__rule", "canon__msi_status", "canon__msi_flag"]
    got = [(r["canon__msi_status__rule"], r["canon__msi_status"], r["canon__msi_flag"]) for r in out.orderBy("i").collect()]
    assert got == [(2, "Unstable", 1), (3, "no loss", None), (2, "Unstable", 1), (None, None, None), (None, None, None), (None, None, None)]
    with pytest.raises(ValueError):
        decisions.decide(df, [decisions.Row("x", "msi", "like", ("a",), "b")], {"msi": "msi text"})


def test_dose_spearman_equals_the_dense_one(spark):
    """Closed form of the zero-dose group against Spearman over all samples, with ties, nulls and an exposure of every sample."""
    values = [(s, "y", float(s * 7 % 10) if s % 11 else None) for s in range(80)]
    doses = [(s, "rare", 1 + s % 2) for s in range(0, 80, 9)] + [(s, "all", 1 + s % 2) for s in range(80)] + [(s, "two", 2) for s in (3, 5, 8, 13)]
    v = spark.createDataFrame(values, "sample int, var string, value double")
    d = spark.createDataFrame(doses, "sample int, hap string, dosage int")
    got = {r.hap: (r.n, r.rho, r.p_value) for r in ranktests.dose_spearman(v, d, ["var"], "hap").collect()}
    grid = v.crossJoin(d.select("hap").distinct()).join(d, ["sample", "hap"], "left").fillna(0, ["dosage"])
    for r in ranktests.spearman(grid, ["hap"], "dosage", "value").collect():
        assert got.pop(r.hap) == pytest.approx((r.n, r.rho, r.p_value))
    assert not got


def test_source_ordinals_do_not_depend_on_partitions(spark, tmp_path):
    """Three files: rows are numbered through them in path order, before and after filters and with small splits."""
    path = str(tmp_path / "rows")
    spark.range(0, 90, numPartitions=3).select("id", (F.col("id") % 4).cast("string").alias("chrom")).write.parquet(path)
    whole = {r.id: r.ordinal for r in tables.with_ordinal(spark.read.parquet(path)).collect()}
    assert sorted(whole.values()) == list(range(90)) and [whole[i] for i in range(90)] == list(range(90))
    kept = tables.with_ordinal(spark.read.parquet(path)).where("id > 40").repartition(7)
    assert {r.id: r.ordinal for r in kept.collect()} == {i: i for i in range(41, 90)}
    placed = {r.id: r.place for r in tables.ordered_places(tables.with_ordinal(spark.read.parquet(path)), "chrom").collect()}
    assert placed == {i: i // 4 + 1 for i in range(90)}
    assert tables.with_ordinal(spark.read.parquet(path)).limit(0).columns == ["id", "chrom", "ordinal"]


def test_linkage_by_distance_equals_the_window_join(spark):
    """All pairs within reach, loci of one position included; nulls are not called; sample numbers with gaps."""
    rows = [(s, "r", f"L{i}", 100 * (i // 2), (s // 64 + s * i + i) % 3 if (s + i) % 5 else None) for s in range(0, 300, 3) for i in range(6)]
    df = spark.createDataFrame(rows, "sample bigint, region string, locus string, pos int, dosage int")
    got = {(r.i, r.j): (r.n_shared, r.r2) for r in ld.ld_by_distance(df, "region", "locus", "pos", "sample", 100).collect()}
    near = {(f"L{i}", f"L{j}") for i in range(6) for j in range(i + 1, 6) if j // 2 - i // 2 <= 1}
    assert set(got) == near
    placed = df.where("dosage is not null").withColumn("i", F.substring("locus", 2, 1).cast("int"))
    for r in ld.ld_r2(placed, "region", "i", 6).collect():
        pair = (f"L{r.i}", f"L{r.j}")
        if pair in near:
            assert got[pair] == (r.n_shared, pytest.approx(r.r2))
    assert ld.ld_by_distance(df.limit(0), "region", "locus", "pos", "sample", 100).count() == 0


def test_penalised_doses_equal_the_general_fit(spark):
    """The kernel over six counts against the row-wise fit; no case, one dose and few samples are left out."""
    rows = [(1, 30, 12, 4, 40, 9, 1), (2, 25, 6, 0, 30, 11, 2), (3, 0, 0, 0, 40, 9, 1), (4, 9, 0, 0, 30, 0, 0), (5, 1, 1, 0, 1, 0, 0)]
    counts = spark.createDataFrame(rows, "k int, " + ", ".join(f"{a}_{g} long" for a in ("case", "control") for g in ("wt", "het", "hom")))
    got = {r.k: r for r in regression.dose_firth(counts, ["k"]).collect()}
    general = regression.firth_by_key(regression.dose_rows(counts, ["k"]), ["k"], "case", "dosage", weight="n")
    expected = {r.k: r for r in general.where("k < 3").collect()}
    assert set(got) == {1, 2} == set(expected)
    for k, r in got.items():
        assert r.converged and (r.odds_ratio, r.ci_low, r.p_value) == pytest.approx((expected[k].odds_ratio, expected[k].ci_low, expected[k].p_value), rel=1e-5)
