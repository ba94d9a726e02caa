"""Expression, gate, compositional and resampling queries over supplier and customer purchases."""

from pyspark.sql import functions as F

from carrierlake.functions.draws import uniform_sql
from carrierlake.operators import expression, ranktests, resampling
from carrierlake.plans.association import PART_CELLS, part_cells
from carrierlake.plans.registry import bh_sql, log_choose, normal_sql, query, rounded, student_sql, with_sql
from carrierlake.plans.statistics import U_SQL

EXPR = """ex AS (SELECT l_suppkey AS sample, p_brand AS feature, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
HOUSE = ["Brand#1", "Brand#2"]


def supplier_expression(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("l_suppkey").alias("sample"), F.col("p_brand").alias("feature")
    ).agg(F.sum("l_quantity").alias("value"))


@query(
    "normalise_expression",
    f"""WITH {EXPR}, f AS (SELECT sample, sum(value) AS size, exp(avg(CASE WHEN feature IN ('Brand#1', 'Brand#2') THEN ln(1 + value) END)) - 1 AS hk FROM ex GROUP BY 1)
    SELECT sample, feature, value, round(value / size * 1e6, 6) AS cpm, round(value / hk, 6) AS ratio FROM ex JOIN f USING (sample)""",
)
def _normalise(t):
    return rounded(expression.normalise_expression(supplier_expression(t), HOUSE))


@query(
    "expression_summary",
    f"""WITH {EXPR} SELECT feature, count(*) AS n, round(median(value), 6) AS median, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd,
      round(avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_zero FROM ex GROUP BY 1""",
)
def _summary(t):
    return rounded(expression.expression_summary(supplier_expression(t), ["feature"]))


@query(
    "composite_z",
    f"""WITH {EXPR}, m AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM ex WHERE feature IN ('Brand#3', 'Brand#4', 'Brand#5') GROUP BY 1)
    SELECT sample, round(avg((value - m) / s), 6) AS score, count(*) AS n_features FROM ex JOIN m USING (feature) GROUP BY 1 HAVING count(*) >= 2""",
)
def _z(t):
    return rounded(expression.composite_z(supplier_expression(t), ["Brand#3", "Brand#4", "Brand#5"]))


@query("usage_counts", "SELECT l_returnflag, l_linestatus, count(l_suppkey) AS n_rows, count(DISTINCT l_suppkey) AS n_samples FROM lineitem GROUP BY 1, 2")
def _usage(t):
    return expression.usage_counts(t.lineitem, ["l_returnflag", "l_linestatus"], "l_suppkey")


PARTS = """pt AS (SELECT sample, cohort, tissue, sum(l_quantity) FILTER (l_returnflag = 'A') AS a, sum(l_quantity) FILTER (l_returnflag = 'N') AS n, sum(l_quantity) FILTER (l_returnflag = 'R') AS r
    FROM purchases JOIN samples USING (sample) GROUP BY 1, 2, 3)"""


def flag_parts(t):
    part = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    return t.purchases().join(t.samples(), "sample").groupBy("sample", "cohort", "tissue").agg(part("A").alias("a"), part("N").alias("n"), part("R").alias("r"))


@query(
    "composition_features",
    with_sql("samples purchases", "").rstrip() + f""", {PARTS}, s AS (SELECT *, CASE WHEN coalesce(a, n, r) IS NOT NULL THEN coalesce(a, 0) + coalesce(n, 0) + coalesce(r, 0) END AS tot,
      CASE WHEN coalesce(a, n) IS NOT NULL THEN coalesce(a, 0) + coalesce(n, 0) END AS top FROM pt)
    SELECT sample, tot AS f_total, round(CASE WHEN tot > 0 THEN top / tot END, 6) AS f_fraction, round(log2((top + 1e-6) / (r + 1e-6)), 6) AS f_log2 FROM s""",
)
def _composition(t):
    out = expression.composition_features(flag_parts(t), ["a", "n", "r"], ["a", "n"], "f")
    return rounded(out.select("sample", "f_total", "f_fraction", "f_log2"))


TARGETS = """tg AS (SELECT l_suppkey AS sample, p_brand AS target, sum(l_quantity) / 10 AS mean_depth, CASE WHEN count(*) > 3 THEN count(*) * 5 END AS reads
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
  cov AS (SELECT sample, count(*) AS n_targets, count(*) FILTER (mean_depth > 0) AS n_covered, count(reads) AS n_with_reads,
    avg(CASE WHEN mean_depth >= 20 THEN 1.0 ELSE 0.0 END) AS share_deep, avg(CASE WHEN coalesce(reads, 0) >= 75 THEN 1.0 ELSE 0.0 END) AS share_soft,
    avg(CASE WHEN coalesce(reads, 0) >= 100 THEN 1.0 ELSE 0.0 END) AS share_strict, min(reads) AS min_reads, avg(mean_depth) AS panel_mean_depth FROM tg GROUP BY 1),
  rk AS (SELECT *, CASE WHEN n_with_reads < n_targets OR share_deep < 0.5 OR share_soft < 0.6 THEN 'High' WHEN share_strict < 0.7 OR share_deep < 0.7 THEN 'Moderate' ELSE 'Low' END AS risk_level FROM cov),
  gate AS (SELECT rk.*, s_nationkey % 5 AS grp, s_suppkey % 11 <> 0 AS matched, s_suppkey % 13 <> 0 AS baseline, s_suppkey % 17 <> 0 AS file_present, s_suppkey % 19 <> 0 AS index_present,
      s_suppkey % 7 <> 0 AS complete, CASE s_suppkey % 3 WHEN 0 THEN 'BED missing' WHEN 1 THEN 'no index' ELSE 'stopped' END AS note FROM rk JOIN supplier ON s_suppkey = sample),
  dec AS (SELECT *, CASE WHEN NOT matched THEN 'Unmatched to master' WHEN NOT baseline THEN 'No baseline file' WHEN NOT file_present THEN 'Missing matched file' WHEN NOT index_present THEN 'File/index failure'
      WHEN NOT complete AND note = 'BED missing' THEN 'Missing/invalid design context' WHEN NOT complete AND note = 'no index' THEN 'File/index failure' WHEN NOT complete THEN 'QC incomplete'
      WHEN n_with_reads < n_targets THEN 'Missing/invalid read-count context' ELSE '' END AS reason FROM gate),
  fin AS (SELECT *, CASE WHEN reason <> '' THEN 'Excluded' WHEN risk_level IN ('High', 'Moderate') THEN 'Exploratory' ELSE 'Analysis-ready' END AS final_status FROM dec)"""


def panel(t):
    targets = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("sample"), F.col("p_brand").alias("target")).agg(
        (F.sum("l_quantity") / 10).alias("mean_depth"), F.when(F.count(F.lit(1)) > 3, F.count(F.lit(1)) * 5).alias("reads")
    )
    return expression.coverage_risk(expression.panel_coverage(targets))


def gate(t):
    k = F.col("s_suppkey")
    context = t.supplier.select(
        k.alias("sample"), (F.col("s_nationkey") % 5).cast("string").alias("grp"), (k % 11 != 0).alias("matched"), (k % 13 != 0).alias("baseline"), (k % 17 != 0).alias("file_present"),
        (k % 19 != 0).alias("index_present"), (k % 7 != 0).alias("complete"), F.when(k % 3 == 0, "BED missing").when(k % 3 == 1, "no index").otherwise("stopped").alias("note"),
    )
    return expression.gate_decision(panel(t).join(context, "sample"))


SHARES = ", ".join(f"round({c}, 6) AS {c}" for c in ("share_deep", "share_soft", "share_strict", "panel_mean_depth"))


@query("panel_coverage", f"WITH {TARGETS} SELECT sample, n_targets, n_covered, n_with_reads, {SHARES}, min_reads, risk_level FROM rk")
def _panel(t):
    return rounded(panel(t))


@query("gate_decision", f"WITH {TARGETS} SELECT sample, risk_level, reason, final_status FROM fin")
def _gate(t):
    return gate(t).select("sample", "risk_level", "reason", "final_status")


@query(
    "manifest_summary",
    f"""WITH {TARGETS} SELECT coalesce(grp::VARCHAR, 'Overall') AS grp, count(*) AS total, count(*) FILTER (final_status = 'Analysis-ready') AS passed, count(*) FILTER (final_status = 'Exploratory') AS exploratory_only,
      count(*) FILTER (final_status = 'Excluded') AS excluded, round(count(*) FILTER (final_status = 'Analysis-ready') * 100.0 / count(*)::DOUBLE, 6) AS pass_pct FROM fin GROUP BY ROLLUP (grp)""",
)
def _manifest(t):
    return rounded(expression.manifest_summary(gate(t), "grp"))


@query("exclusion_reasons", f"WITH {TARGETS} SELECT grp::VARCHAR AS grp, reason, count(*) AS n FROM fin WHERE reason <> '' GROUP BY 1, 2")
def _reasons(t):
    return expression.exclusion_reasons(gate(t), "grp")


@query(
    "machine_flag",
    """WITH m AS (SELECT o_custkey AS sample, CASE WHEN o_custkey % 9 > 0 THEN sum(o_totalprice) / 10 END AS reads, CASE WHEN o_custkey % 9 > 0 THEN 80 + o_custkey % 20 END AS q20 FROM orders GROUP BY 1)
    SELECT sample, CASE WHEN reads IS NULL AND q20 IS NULL THEN 'Unmatched' WHEN reads < 10000 OR q20 < 85 THEN 'Hard_fail' WHEN reads < 50000 OR q20 < 92 THEN 'Warning' ELSE 'Pass' END AS flag FROM m""",
)
def _machine(t):
    known = F.col("o_custkey") % 9 > 0
    m = t.orders.groupBy("o_custkey").agg((F.sum("o_totalprice") / 10).alias("r")).select(
        F.col("o_custkey").alias("sample"), F.when(known, F.col("r")).alias("reads"), F.when(known, 80 + F.col("o_custkey") % 20).alias("q20")
    )
    return m.select("sample", expression.machine_flag(F.col("reads"), F.col("q20")).alias("flag"))


CLR = with_sql("samples purchases", "").rstrip() + f""", {PARTS}, ok AS (SELECT *, a + n + r AS t FROM pt WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL AND a + n + r > 0),
  lg AS (SELECT *, ln(a / t + 1e-6) AS la, ln(n / t + 1e-6) AS ln_, ln(r / t + 1e-6) AS lr FROM ok),
  cl AS (SELECT cohort, sample, tissue, la - (la + ln_ + lr) / 3 AS c0, ln_ - (la + ln_ + lr) / 3 AS c1, lr - (la + ln_ + lr) / 3 AS c2 FROM lg)"""


@query("clr", CLR + " SELECT sample, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2 FROM cl")
def _clr(t):
    return rounded(expression.clr(flag_parts(t).select("sample", "a", "n", "r"), ["a", "n", "r"]).select("sample", "c0", "c1", "c2"))


B_PERM = 499


@query(
    "clr_permanova",
    CLR + f""", tot AS (SELECT cohort, count(*) AS n, sum(c0 * c0 + c1 * c1 + c2 * c2) - (sum(c0) ** 2 + sum(c1) ** 2 + sum(c2) ** 2) / count(*) AS total_ss, count(*) FILTER (tissue = 'Healthy') AS nh FROM cl GROUP BY 1),
      dr AS (SELECT cl.*, b, {uniform_sql(['b', 'sample'], 42)} AS u FROM cl, range(1, {B_PERM + 1}) q(b)),
      pl AS (SELECT *, row_number() OVER (PARTITION BY cohort, b ORDER BY u, sample) AS place FROM dr),
      sh AS (SELECT pl.*, CASE WHEN place <= nh THEN 'Healthy' ELSE 'Tumour' END AS g FROM pl JOIN tot USING (cohort)),
      al AS (SELECT cohort, 0 AS b, tissue AS g, c0, c1, c2 FROM cl UNION ALL SELECT cohort, b, g, c0, c1, c2 FROM sh),
      gs AS (SELECT cohort, b, g, count(*) AS k, sum(c0) AS s0, sum(c1) AS s1, sum(c2) AS s2 FROM al GROUP BY 1, 2, 3),
      bs AS (SELECT cohort, b, sum((s0 ** 2 + s1 ** 2 + s2 ** 2) / k) - (sum(s0) ** 2 + sum(s1) ** 2 + sum(s2) ** 2) / sum(k) AS bss, count(*) AS n_groups FROM gs GROUP BY 1, 2),
      ob AS (SELECT cohort, bss AS obs, n_groups FROM bs WHERE b = 0), ht AS (SELECT cohort, count(*) FILTER (bss >= obs - 1e-9 * total_ss) AS hits FROM bs JOIN ob USING (cohort) JOIN tot USING (cohort) WHERE b > 0 GROUP BY 1)
    SELECT cohort, n, n_groups, round(obs, 6) AS between_ss, round(total_ss - obs, 6) AS within_ss, round(total_ss, 6) AS total_ss,
      round((obs / (n_groups - 1)) / ((total_ss - obs) / (n - n_groups)), 6) AS pseudo_f, round((hits + 1) / {B_PERM + 1}.0::DOUBLE, 6) AS p_value FROM tot JOIN ob USING (cohort) JOIN ht USING (cohort)""",
)
def _permanova(t):
    return rounded(expression.clr_permanova(flag_parts(t), ["cohort"], "sample", "tissue", ["a", "n", "r"], B_PERM))


@query(
    "top_shift",
    with_sql("samples purchases", "").rstrip() + f""", {PARTS}, s AS (SELECT cohort, regr_slope(a, (tissue = 'Tumour')::INT) AS a, regr_slope(n, (tissue = 'Tumour')::INT) AS n, regr_slope(r, (tissue = 'Tumour')::INT) AS r FROM pt GROUP BY 1)
    SELECT cohort, CASE greatest(abs(a), abs(n), abs(r)) WHEN abs(a) THEN 'a' WHEN abs(n) THEN 'n' ELSE 'r' END AS top_part,
      round(CASE greatest(abs(a), abs(n), abs(r)) WHEN abs(a) THEN a WHEN abs(n) THEN n ELSE r END, 6) AS top_slope FROM s""",
)
def _shift(t):
    dosed = flag_parts(t).withColumn("dose", (F.col("tissue") == "Tumour").cast("double"))
    return rounded(expression.top_shift(dosed, ["cohort"], "dose", ["a", "n", "r"]))


@query(
    "qc_pca",
    """WITH x AS (SELECT o_custkey AS sample, avg(o_totalprice) AS spend, count(*)::DOUBLE AS n FROM orders GROUP BY 1), c AS (SELECT corr(spend, n) AS r, avg(spend) AS ms, stddev_samp(spend) AS ss, avg(n) AS mn, stddev_samp(n) AS sn FROM x),
      z AS (SELECT sample, r, (spend - ms) / ss AS a, (n - mn) / sn AS b FROM x, c)
    SELECT sample, round((a + sign(r) * b) / sqrt(2), 4) AS pc1, round((a - sign(r) * b) / sqrt(2), 4) AS pc2, round((1 + abs(r)) / 2, 6) AS explained1, round((1 - abs(r)) / 2, 6) AS explained2 FROM z""",
)
def _pca(t):
    metrics = t.orders.groupBy(F.col("o_custkey").alias("sample")).agg(F.avg("o_totalprice").alias("spend"), F.count(F.lit(1)).cast("double").alias("n"))
    scores, explained = expression.qc_pca(metrics, ["spend", "n"], 2)
    return rounded(scores.select("sample", "pc1", "pc2"), 4).select("*", *[F.round(F.lit(v), 6).alias(f"explained{i + 1}") for i, v in enumerate(explained)])


@query(
    "qc_pca_pass_only",
    """WITH x AS (SELECT o_custkey AS sample, avg(o_totalprice) AS spend, count(*)::DOUBLE AS n FROM orders GROUP BY 1), v AS (SELECT 'all' AS variant, * FROM x UNION ALL SELECT 'pass', * FROM x WHERE n >= 8),
      c AS (SELECT variant, corr(spend, n) AS r, avg(spend) AS ms, stddev_samp(spend) AS ss, avg(n) AS mn, stddev_samp(n) AS sn FROM v GROUP BY 1 HAVING count(*) >= 4),
      z AS (SELECT variant, sample, r, (spend - ms) / ss AS a, (n - mn) / sn AS b FROM v JOIN c USING (variant))
    SELECT variant, sample, round((a + sign(r) * b) / sqrt(2), 4) AS pc1, round((a - sign(r) * b) / sqrt(2), 4) AS pc2, round((1 + abs(r)) / 2, 6) AS explained1, round((1 - abs(r)) / 2, 6) AS explained2 FROM z""",
)
def _pca_pass(t):
    metrics = t.orders.groupBy(F.col("o_custkey").alias("sample")).agg(F.avg("o_totalprice").alias("spend"), F.count(F.lit(1)).cast("double").alias("n"))
    rows = expression.with_pass_only(metrics.withColumn("passed", F.col("n") >= 8), "passed")
    out = expression.pca_by_key(rows, ["variant"], ["spend", "n"])
    return out.select("variant", "sample", *[F.round(c, 4).alias(c) for c in ("pc1", "pc2")], *[F.round(c, 6).alias(c) for c in ("explained1", "explained2")])


RHO_P = f"CASE WHEN n > 2 AND abs(rho) < 1 THEN round({student_sql('rho * sqrt((n - 2) / (1 - rho * rho))', '(n - 2)')}, 6) WHEN n > 2 AND rho IS NOT NULL THEN 0.0 END AS p_value"

LAYERS = """ly AS (SELECT p_brand AS gene, l_suppkey AS sample, sum(l_quantity) FILTER (l_returnflag = 'A') AS x, sum(l_quantity) FILTER (l_returnflag = 'R') AS y
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), lv AS (SELECT * FROM ly WHERE x IS NOT NULL AND y IS NOT NULL),
  lr AS (SELECT gene, rank() OVER (PARTITION BY gene ORDER BY x) + (count(*) OVER (PARTITION BY gene, x) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY gene ORDER BY y) + (count(*) OVER (PARTITION BY gene, y) - 1) / 2.0 AS ry FROM lv)"""


@query("layer_concordance", f"WITH {LAYERS}, c AS (SELECT gene, count(*) AS n, corr(rx, ry) AS rho FROM lr GROUP BY 1) SELECT gene, n, round(rho, 6) AS rho, {RHO_P} FROM c")
def _layers(t):
    side = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    df = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("gene"), "l_suppkey").agg(side("A").alias("x"), side("R").alias("y"))
    return rounded(ranktests.spearman(df, ["gene"], "x", "y"))


@query(
    "gene_vs_clinical",
    with_sql("samples", "").rstrip() + f""", {EXPR}, j AS (SELECT feature, outcome, value, y FROM ex JOIN (SELECT s_suppkey AS sample, 'balance' AS outcome, s_acctbal AS y FROM supplier
        UNION ALL SELECT s_suppkey, 'nation', s_nationkey::DOUBLE FROM supplier) USING (sample)),
      r AS (SELECT feature, outcome, rank() OVER (PARTITION BY feature, outcome ORDER BY value) + (count(*) OVER (PARTITION BY feature, outcome, value) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY feature, outcome ORDER BY y) + (count(*) OVER (PARTITION BY feature, outcome, y) - 1) / 2.0 AS ry FROM j)
, c AS (SELECT feature, outcome, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY 1, 2)
    SELECT feature, outcome, n, round(rho, 6) AS rho, {RHO_P} FROM c""",
)
def _gene_clinical(t):
    outcomes = t.supplier.select(F.col("s_suppkey").alias("sample"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation")).unpivot(
        ["sample"], ["balance", "nation"], "outcome", "y"
    )
    joined = supplier_expression(t).join(outcomes, "sample")
    return rounded(ranktests.spearman(joined, ["feature", "outcome"], "value", "y"))


CHI_TAIL = f"""CASE n_groups WHEN 2 THEN {normal_sql('sqrt(h)')} WHEN 3 THEN exp(-h / 2) ELSE {normal_sql('sqrt(h)')} + sqrt(2 * h / pi()) * exp(-h / 2) END"""
RANKS = "rank() OVER (PARTITION BY cohort, feature, outcome ORDER BY {c}) + (count(*) OVER (PARTITION BY cohort, feature, outcome, {c}) - 1) / 2.0"
TIES = "(SELECT cohort, feature, outcome, sum(c * c * c - c)::DOUBLE AS ties, sum(c)::DOUBLE AS m FROM (SELECT cohort, feature, outcome, value, count(*) AS c FROM {src} GROUP BY ALL) GROUP BY ALL)"
FIELDS = "cohort, feature, outcome"


@query(
    "endpoint_vs_clinical",
    f"""WITH {EXPR}, su AS (SELECT s_suppkey AS sample, 'c' || s_nationkey % 2 AS cohort, s_acctbal::VARCHAR AS balance, CASE WHEN s_nationkey = 3 THEN '2' WHEN s_acctbal > 4000 THEN '1' ELSE '0' END AS rich,
        CASE WHEN s_nationkey = 24 THEN 'rare' WHEN s_nationkey = 5 THEN NULL ELSE 'n' || s_nationkey % 3 END AS nation FROM supplier),
      an AS (SELECT sample, cohort, unnest([{{'outcome': 'balance', 'answer': balance}}, {{'outcome': 'rich', 'answer': rich}}, {{'outcome': 'nation', 'answer': nation}}], recursive := true) FROM su),
      j AS (SELECT cohort, feature, outcome, value, answer FROM ex JOIN an USING (sample) WHERE answer IS NOT NULL), ok AS (SELECT {FIELDS} FROM j GROUP BY ALL HAVING count(*) >= 10),
      sp AS (SELECT {FIELDS}, count(*) AS n, corr(rx, ry) AS rho FROM (SELECT *, {RANKS.format(c='value')} AS rx, {RANKS.format(c='answer::DOUBLE')} AS ry FROM j WHERE outcome = 'balance') GROUP BY ALL),
      bi AS (SELECT * FROM j WHERE outcome = 'rich' AND answer IN ('0', '1')),
      mw AS (SELECT {FIELDS}, count(*) FILTER (answer = '1') AS n1, count(*) FILTER (answer = '0') AS n2, sum(r) FILTER (answer = '1') - count(*) FILTER (answer = '1') * (count(*) FILTER (answer = '1') + 1) / 2.0 AS u,
        median(value) FILTER (answer = '1') - median(value) FILTER (answer = '0') AS gap FROM (SELECT *, {RANKS.format(c='value')} AS r FROM bi) GROUP BY ALL),
      mz AS (SELECT *, {U_SQL} AS z FROM mw JOIN {TIES.format(src='bi')} USING ({FIELDS}) WHERE n1 >= 5 AND n2 >= 5),
      no AS (SELECT * FROM j WHERE outcome = 'nation' QUALIFY count(*) OVER (PARTITION BY {FIELDS}, answer) >= 3),
      kq AS (SELECT {FIELDS}, count(*) AS n_groups, sum(rg * rg / ng)::DOUBLE AS q FROM (SELECT {FIELDS}, answer, count(*) AS ng, sum(r) AS rg FROM (SELECT *, {RANKS.format(c='value')} AS r FROM no) GROUP BY ALL) GROUP BY ALL),
      kh AS (SELECT *, (12 / (m * (m + 1)) * q - 3 * (m + 1)) / (1 - ties / (m * m * m - m)) AS h FROM kq JOIN {TIES.format(src='no')} USING ({FIELDS}) WHERE n_groups >= 2),
      al AS (SELECT {FIELDS}, 'continuous' AS kind, 'Spearman' AS test, n, rho AS effect, {student_sql('rho * sqrt((n - 2) / (1 - rho * rho))', '(n - 2)')} AS p_value FROM sp WHERE n >= 10
        UNION ALL SELECT {FIELDS}, 'binary', 'Mann-Whitney', n1 + n2, gap, {normal_sql('z')} FROM mz UNION ALL SELECT {FIELDS}, 'nominal', 'Kruskal-Wallis', m::BIGINT, h, {CHI_TAIL} FROM kh),
      kept AS (SELECT al.* FROM al JOIN ok USING ({FIELDS}) WHERE effect IS NOT NULL), q AS ({bh_sql('kept', 'p_value', 'cohort', 'fdr')})
    SELECT {FIELDS}, kind, test, n, round(effect, 6) AS effect, round(p_value, 6) AS p_value, round(fdr, 4) AS fdr FROM q""",
)
def _endpoint_clinical(t):
    nation = F.col("s_nationkey")
    answers = t.supplier.select(
        F.col("s_suppkey").alias("sample"), F.concat(F.lit("c"), nation % 2).alias("cohort"), F.col("s_acctbal").cast("string").alias("balance"),
        F.when(nation == 3, "2").when(F.col("s_acctbal") > 4000, "1").otherwise("0").alias("rich"),
        F.when(nation == 24, " rare ").when(nation == 5, F.lit(None)).otherwise(F.concat(F.lit("n"), nation % 3)).alias("nation"),
    )
    values = supplier_expression(t).join(answers.select("sample", "cohort"), "sample")
    kinds = F.create_map(*[F.lit(x) for x in ("balance", "continuous", "rich", "binary", "nation", "nominal")])
    outcomes = answers.unpivot(["sample"], ["balance", "rich", "nation"], "outcome", "answer").withColumn("kind", kinds[F.col("outcome")])
    out = ranktests.typed_association(values, outcomes, ["cohort", "feature"], ["cohort"])
    return rounded(out.withColumn("fdr", F.round("fdr", 4)))


@query(
    "isoform_vs_gene",
    f"""WITH {EXPR}, iso AS (SELECT l_suppkey AS sample, p_type AS feature, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
      r AS (SELECT a.feature AS feature_a, b.feature AS feature_b, rank() OVER (PARTITION BY a.feature, b.feature ORDER BY a.value) + (count(*) OVER (PARTITION BY a.feature, b.feature, a.value) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY a.feature, b.feature ORDER BY b.value) + (count(*) OVER (PARTITION BY a.feature, b.feature, b.value) - 1) / 2.0 AS ry FROM iso a JOIN ex b USING (sample)),
      c AS (SELECT feature_a, feature_b, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY 1, 2 HAVING count(*) >= 10),
      t AS (SELECT feature_a, feature_b, n, rho, CASE WHEN abs(rho) >= 1 THEN 0.0 ELSE {student_sql('rho * sqrt((n - 2) / (1 - rho * rho))', '(n - 2)')} END AS p_value FROM c),
      q AS ({bh_sql('t', 'p_value', 'feature_a', 'fdr')})
    SELECT feature_a, feature_b, n, round(rho, 6) AS rho, round(p_value, 6) AS p_value, round(fdr, 4) AS fdr FROM q""",
)
def _isoform(t):
    iso = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("sample"), F.col("p_type").alias("feature")).agg(F.sum("l_quantity").alias("value"))
    out = ranktests.feature_pairs(iso, supplier_expression(t), [], ["feature_a"])
    return rounded(out.withColumn("fdr", F.round("fdr", 4)))


# --- resampling ---------------------------------------------------------------------------------

DRAWS = 10_000
PMF = f"exp({log_choose('n1', 'k')} + {log_choose('n2', '(m - k)')} - {log_choose('(n1 + n2)', 'm')})"


TAILS = f"""WITH {PART_CELLS}, mm AS (SELECT key, a + b AS n1, c + d AS n2, a + c AS m, a, b, c, d, a::DOUBLE / (a + b) - c::DOUBLE / (c + d) AS gap FROM cells WHERE a + b > 0 AND c + d > 0),
      tl AS (SELECT *, list_sum(list_transform(range(greatest(0, m - n2)::BIGINT, least(n1, m)::BIGINT + 1), lambda k: CASE WHEN k::DOUBLE / n1 - (m - k)::DOUBLE / n2 < 0 AND abs(k::DOUBLE / n1 - (m - k)::DOUBLE / n2) >= abs(gap) - 1e-12 THEN {PMF} ELSE 0.0 END)) AS lo,
        list_sum(list_transform(range(greatest(0, m - n2)::BIGINT, least(n1, m)::BIGINT + 1), lambda k: CASE WHEN k::DOUBLE / n1 - (m - k)::DOUBLE / n2 >= 0 AND abs(k::DOUBLE / n1 - (m - k)::DOUBLE / n2) >= abs(gap) - 1e-12 THEN {PMF} ELSE 0.0 END)) AS hi FROM mm),
      dr AS (SELECT key, count(*) FILTER (u < lo OR u >= 1 - hi) AS hits FROM (SELECT key, lo, hi, {uniform_sql(['key', 'rep'], 42)} AS u FROM tl, range(1, {DRAWS + 1}) q(rep)) GROUP BY 1)"""


@query(
    "permutation_difference",
    TAILS + f"""
    SELECT key, round(gap, 6) AS observed_difference, hits, round(hits / {DRAWS}.0::DOUBLE, 6) AS p_permutation, round(least(1.0, lo + hi), 6) AS p_exact,
      round(2 * (asin(sqrt(a::DOUBLE / (a + b))) - asin(sqrt(c::DOUBLE / (c + d)))), 6) AS cohens_h FROM tl JOIN dr USING (key)""",
)
def _permutation(t):
    return rounded(resampling.permutation_difference(part_cells(t).drop("family"), ["key"], ("a", "b", "c", "d"), DRAWS))


@query(
    "permutation_agreement",
    f"""{TAILS} SELECT CASE WHEN hits / {DRAWS}.0::DOUBLE < 0.05 THEN 'significant' ELSE 'not_significant' END AS p_permutation,
      CASE WHEN least(1.0, lo + hi) < 0.05 THEN 'significant' ELSE 'not_significant' END AS p_exact, count(*) AS n FROM tl JOIN dr USING (key) GROUP BY 1, 2""",
)
def _agreement(t):
    tested = resampling.permutation_difference(part_cells(t).drop("family"), ["key"], ("a", "b", "c", "d"), DRAWS)
    return resampling.agreement(tested.where("p_exact is not null"), "p_permutation", "p_exact")


REPS = 200
WEIGHT = " + ".join(f"(u >= {e!r})::INT" for e in resampling.POISSON)
CUSTOMER = """cu AS (SELECT sample, cohort, (tissue = 'Tumour')::INT::DOUBLE AS x, count(DISTINCT o_orderkey)::DOUBLE AS m, sum(l_quantity) AS y FROM purchases JOIN samples USING (sample) GROUP BY 1, 2, 3)"""
CUSTOMER_SQL = with_sql("samples purchases", "").rstrip() + ", " + CUSTOMER
WEIGHTED = f"wt AS (SELECT *, {WEIGHT} AS w FROM (SELECT cu.*, b, {uniform_sql(['b', 'sample'], 42)} AS u FROM cu, range(1, {REPS + 1}) q(b)))"


def customers(t):
    return t.purchases().groupBy("sample").agg(F.countDistinct("o_orderkey").cast("double").alias("m"), F.sum("l_quantity").alias("y")).join(t.samples(), "sample").withColumn(
        "x", (F.col("tissue") == "Tumour").cast("double")
    )


@query(
    "bootstrap_slope",
    CUSTOMER_SQL + f""", {WEIGHTED}, sl AS (SELECT cohort, b, (sum(w) * sum(w * m * y) - sum(w * m) * sum(w * y)) / (sum(w) * sum(w * m * m) - sum(w * m) ** 2) AS slope FROM wt WHERE w > 0 GROUP BY 1, 2),
      o AS (SELECT cohort, count(*) AS n, regr_slope(y, m) AS original_slope FROM cu GROUP BY 1)
    SELECT cohort, any_value(n) AS n, round(any_value(original_slope), 6) AS original_slope, avg((sign(slope) = sign(original_slope))::INT) AS sign_concordance, count(*) AS replicates,
      round(median(slope), 6) AS median_slope, round(quantile_cont(slope, 0.025), 6) AS low, round(quantile_cont(slope, 0.975), 6) AS high,
      NOT (quantile_cont(slope, 0.025) > 0 OR quantile_cont(slope, 0.975) < 0) AS crosses_zero FROM sl JOIN o USING (cohort) GROUP BY 1""",
)
def _bootstrap(t):
    return rounded(resampling.bootstrap_slope(customers(t), ["cohort"], F.col("sample"), "m", "y", REPS))


def _cov(p: str, q: str) -> str:
    return f"(sum(w * {p} * {q}) - sum(w * {p}) * sum(w * {q}) / sum(w))"


@query(
    "mediation",
    CUSTOMER_SQL + f""", {WEIGHTED}, al AS (SELECT cohort, 0 AS b, 1 AS w, x, m, y FROM cu UNION ALL SELECT cohort, b, w, x, m, y FROM wt WHERE w > 0),
      mo AS (SELECT cohort, b, count(*) AS n, {_cov('x', 'x')} AS xx, {_cov('m', 'm')} AS mm, {_cov('x', 'm')} AS xm, {_cov('x', 'y')} AS xy, {_cov('m', 'y')} AS my FROM al GROUP BY 1, 2),
      ef AS (SELECT *, xm / xx AS a, (my * xx - xy * xm) / (xx * mm - xm * xm) AS bb, (xy * mm - my * xm) / (xx * mm - xm * xm) AS direct, xy / xx AS total FROM mo WHERE xx > 1e-9 AND xx * mm - xm * xm > 1e-9 * xx * mm)
    SELECT p.cohort, p.n, round(p.a, 4) AS a, round(p.bb, 4) AS b, round(p.direct, 4) AS direct, round(p.total, 4) AS total, round(p.a * p.bb, 4) AS indirect, d.replicates, d.lo AS indirect_low, d.hi AS indirect_high
    FROM (SELECT * FROM ef WHERE b = 0) p JOIN (SELECT cohort, count(*) AS replicates, round(quantile_cont(a * bb, 0.025), 4) AS lo, round(quantile_cont(a * bb, 0.975), 4) AS hi FROM ef WHERE b > 0 GROUP BY 1) d USING (cohort)""",
)
def _mediation(t):
    return rounded(resampling.mediation(customers(t), ["cohort"], F.col("sample"), "x", "m", "y", (), REPS), 4)


@query("mediation_adjusted")
def _mediation_adjusted(t):
    people = customers(t).join(t.customer.select(F.col("c_custkey").alias("sample"), F.col("c_nationkey").alias("age"), F.col("c_acctbal").alias("bmi")), "sample")
    return rounded(resampling.mediation(people, ["cohort"], F.col("sample"), "x", "m", "y", ["age", "bmi"], REPS), 4)
