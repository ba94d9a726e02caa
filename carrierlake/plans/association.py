"""Comparisons, exact tests, FDR and genotype cascades over the cohort stand-ins."""

from pyspark.sql import functions as F

from carrierlake.functions.keys import neg_log10_p
from carrierlake.functions.pvalues import normal_p
from carrierlake.operators import compare, contingency, fdr
from carrierlake.plans.registry import bh_sql, fisher_sql, normal_sql, query, rounded, with_sql

ODDS_SQL = """CASE WHEN {a} = 0 OR {b} = 0 OR {c} = 0 OR {d} = 0
    THEN (({a} + 0.5) * ({d} + 0.5)) / (({b} + 0.5) * ({c} + 0.5)) ELSE ({a} * {d})::DOUBLE / ({b} * {c}) END"""
SE_SQL = """CASE WHEN {a} = 0 OR {b} = 0 OR {c} = 0 OR {d} = 0
    THEN sqrt(1 / ({a} + 0.5) + 1 / ({b} + 0.5) + 1 / ({c} + 0.5) + 1 / ({d} + 0.5))
    ELSE sqrt(1.0 / {a} + 1.0 / {b} + 1.0 / {c} + 1.0 / {d}) END"""


def cells_sql(template: str, a: str, b: str, c: str, d: str) -> str:
    return template.format(a=a, b=b, c=c, d=d)


SCREEN = ("case_carriers", "case_rest", "control_carriers", "control_rest")
SCREEN_CTES = """samples purchases calls arms"""
SCREEN_SQL = f"""carriers AS (
    SELECT comparison, variant, sum(is_case)::BIGINT AS case_carriers, sum(1 - is_case)::BIGINT AS control_carriers
    FROM arms JOIN calls USING (sample) GROUP BY 1, 2),
  sizes AS (SELECT comparison, sum(is_case)::BIGINT AS case_n, sum(1 - is_case)::BIGINT AS control_n FROM arms GROUP BY 1),
  cells AS (SELECT *, case_n - case_carriers AS case_rest, control_n - control_carriers AS control_rest
    FROM carriers JOIN sizes USING (comparison)),
  tested AS (SELECT *, {fisher_sql(*SCREEN)} AS p_raw, {cells_sql(ODDS_SQL, *SCREEN)} AS odds,
    {cells_sql(SE_SQL, *SCREEN)} AS se FROM cells)"""


@query(
    "case_vs_control",
    with_sql(SCREEN_CTES, "")
    + ", " + SCREEN_SQL
    + f""", adjusted AS ({bh_sql('tested', 'p_raw', 'comparison', 'q')})
    SELECT comparison, variant, case_carriers, case_rest, control_carriers, control_rest,
      round(odds, 6) AS odds_ratio, round(exp(ln(odds) - 1.96 * se), 6) AS ci_low,
      round(exp(ln(odds) + 1.96 * se), 6) AS ci_high, round(p_raw, 6) AS p_value, round(q, 6) AS fdr,
      round(-log10(p_raw), 6) AS neg_log10_p FROM adjusted""",
)
def _screen(t):
    out = compare.case_vs_control(t.calls(), t.samples(), ["variant"], ["comparison"])
    return rounded(
        out.select(
            "comparison", "variant", *SCREEN, "odds_ratio", "ci_low", "ci_high", "p_value", "fdr",
            neg_log10_p(F.col("p_value")).alias("neg_log10_p"),
        )
    )


@query(
    "genotype_counts",
    with_sql(
        "samples purchases calls arms counts",
        """SELECT comparison, variant, case_wt::BIGINT AS case_wt, case_het, case_hom,
      control_wt::BIGINT AS control_wt, control_het, control_hom,
      round((case_het + 2 * case_hom) / case_callable::DOUBLE, 6) AS case_dose,
      round((control_het + 2 * control_hom) / control_callable::DOUBLE, 6) AS control_dose,
      round((case_het + case_hom) * 100.0 / case_callable::DOUBLE, 6) AS case_carrier_pct,
      round((control_het + control_hom) * 100.0 / control_callable::DOUBLE, 6) AS control_carrier_pct,
      round((case_het + 2 * case_hom) / case_callable::DOUBLE - (control_het + 2 * control_hom) / control_callable::DOUBLE, 6)
        AS dose_difference,
      CASE WHEN (case_het + 2 * case_hom) / case_callable::DOUBLE - (control_het + 2 * control_hom) / control_callable::DOUBLE > 1e-9
        THEN 'Higher_in_case'
        WHEN (case_het + 2 * case_hom) / case_callable::DOUBLE - (control_het + 2 * control_hom) / control_callable::DOUBLE < -1e-9
        THEN 'Lower_in_case' ELSE 'No_difference' END AS direction FROM geno""",
    ),
)
def _genotype_counts(t):
    out = compare.genotype_counts(t.calls(), t.samples())
    return rounded(out.drop("case_callable", "control_callable"))


@query(
    "carrier_frequency",
    with_sql(
        "samples purchases calls",
        """SELECT cohort, tissue, variant, count(DISTINCT c.sample) AS carrier_count, any_value(n) AS total_samples,
      round(count(DISTINCT c.sample) * 100.0 / any_value(n), 6) AS carrier_pct
      FROM calls c JOIN samples USING (sample)
      JOIN (SELECT cohort, tissue, count(DISTINCT sample) AS n FROM samples GROUP BY 1, 2) USING (cohort, tissue)
      GROUP BY 1, 2, 3""",
    ),
)
def _carrier_frequency(t):
    rows = t.calls().join(t.samples(), "sample")
    return rounded(
        compare.carrier_frequency(rows, "sample", ["cohort", "tissue", "variant"], ["cohort", "tissue"], t.samples())
    )


@query(
    "pooled_control_arms",
    with_sql(
        "samples arms",
        """SELECT comparison, sum(is_case)::BIGINT AS case_n, sum(1 - is_case)::BIGINT AS control_n
      FROM arms GROUP BY 1""",
    ),
)
def _arms(t):
    return compare.arm_sizes(t.samples()).select("comparison", "case_n", "control_n")


# One 2x2 table per part: returned and open lines of the part against those of all other parts.
PART_CELLS = """cells AS (SELECT l_partkey AS key, p_brand AS family,
    count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS a,
    count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS b,
    count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O') AS c,
    count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') AS d
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def part_cells(t):
    returned, still_open = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    return (
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_partkey").alias("key"), F.col("p_brand").alias("family"))
        .agg(
            F.count_if(returned & still_open).alias("a"),
            F.count_if(returned & ~still_open).alias("b"),
            F.count_if(~returned & still_open).alias("c"),
            F.count_if(~returned & ~still_open).alias("d"),
        )
    )


@query(
    "odds_ratio",
    f"""WITH {PART_CELLS}, x AS (SELECT *, {cells_sql(ODDS_SQL, 'a', 'b', 'c', 'd')} AS o,
      {cells_sql(SE_SQL, 'a', 'b', 'c', 'd')} AS se FROM cells)
    SELECT key, a, b, c, d, round(o, 6) AS odds_ratio, round(exp(ln(o) - 1.96 * se), 6) AS ci_low,
      round(exp(ln(o) + 1.96 * se), 6) AS ci_high,
      CASE WHEN a = 0 OR b = 0 OR c = 0 OR d = 0 THEN 'Haldane-Anscombe' ELSE 'Sample' END AS method FROM x""",
)
def _odds(t):
    cells = part_cells(t).drop("family")
    ratio = contingency.odds_ratio(*[F.col(x) for x in "abcd"])
    return rounded(cells.select("*", ratio.alias("r")).select("key", *"abcd", "r.*"))


@query(
    "fisher_2x2",
    f"WITH {PART_CELLS} SELECT key, a, b, c, d, round({fisher_sql('a', 'b', 'c', 'd')}, 6) AS p_value FROM cells",
)
def _fisher(t):
    return rounded(contingency.fisher_2x2(part_cells(t).drop("family"), ("a", "b", "c", "d")))


@query(
    "bh_fdr",
    f"""WITH {PART_CELLS}, tested AS (SELECT key, family, {fisher_sql('a', 'b', 'c', 'd')} AS p FROM cells)
    SELECT key, family, round(p, 6) AS p, round(fdr, 6) AS fdr FROM ({bh_sql('tested', 'p', 'family', 'fdr')})""",
)
def _bh(t):
    tested = contingency.fisher_2x2(part_cells(t), ("a", "b", "c", "d"), "p")
    return rounded(fdr.bh_fdr(tested.select("key", "family", "p"), "p", ["family"]))


@query(
    "block_fdr",
    f"""WITH {PART_CELLS}, tested AS (SELECT key, family, CASE WHEN key % 3 = 0 THEN 'Singleton::' || key
        ELSE 'Block' || (key % 3) END AS block, {fisher_sql('a', 'b', 'c', 'd')} AS p FROM cells),
      inside AS ({bh_sql('tested', 'p', 'family, block', 'block_fdr')}),
      slim AS (SELECT key, family, block, p, block_fdr FROM inside),
      both_fdr AS ({bh_sql('slim', 'p', 'family', 'group_fdr')})
    SELECT key, family, block, round(block_fdr, 6) AS block_fdr, round(group_fdr, 6) AS group_fdr,
      count(*) OVER (PARTITION BY family, block) AS block_tests FROM both_fdr""",
)
def _block_fdr(t):
    tested = contingency.fisher_2x2(part_cells(t), ("a", "b", "c", "d"), "p").select(
        "key", "family", F.when(F.col("key") % 3 != 0, F.concat(F.lit("Block"), F.col("key") % 3)).alias("block"), "p"
    )
    return rounded(fdr.block_fdr(tested, "p", ["family"], "block", "key").drop("p"))


SPREAD_SQL = """(({t0} + {c0}) * pow(0 - mean, 2) + ({t1} + {c1}) * pow(1 - mean, 2) + ({t2} + {c2}) * pow(2 - mean, 2))"""
TREND_CTES = """trends AS (SELECT *, CASE WHEN var > 0 THEN num / sqrt(var) END AS z FROM (SELECT *,
      (case_het + 2 * case_hom) - (case_het + control_het + 2 * (case_hom + control_hom)) * nt::DOUBLE / n AS num,
      nt::DOUBLE * nc * ((case_wt + control_wt) * mean * mean + (case_het + control_het) * pow(1 - mean, 2)
        + (case_hom + control_hom) * pow(2 - mean, 2)) / (n::DOUBLE * (n - 1)) AS var
    FROM (SELECT *, case_callable AS nt, control_callable AS nc, case_callable + control_callable AS n,
      (case_het + control_het + 2 * (case_hom + control_hom)) / (case_callable + control_callable)::DOUBLE AS mean FROM geno)))"""


@query(
    "trend_test",
    with_sql("samples purchases calls arms counts", "").rstrip()
    + f""", {TREND_CTES}
    SELECT comparison, variant, round(z, 6) AS trend_z, round({normal_sql('z')}, 6) AS trend_p FROM trends""",
)
def _trend(t):
    counts = compare.genotype_counts(t.calls(), t.samples())
    names = ("wt", "het", "hom")
    z = contingency.trend([F.col(f"case_{x}") for x in names], [F.col(f"control_{x}") for x in names])
    out = counts.select("comparison", "variant", z.alias("trend_z"))
    return rounded(out.withColumn("trend_p", normal_p("trend_z")))


CHI_SQL = """(SELECT {keys}, sum(pow(o - r * c / n, 2) / (r * c / n)) AS chi, min(r * c / n) AS least_e, any_value(n) AS n
    FROM (SELECT *, sum(o) OVER (PARTITION BY {keys}, {row}) AS r, sum(o) OVER (PARTITION BY {keys}, {col}) AS c,
      sum(o) OVER (PARTITION BY {keys}) AS n FROM {source}) GROUP BY {keys})"""
GRID_SQL = """grid AS (SELECT k.cohort, r.tissue, p.pr AS priority, coalesce(x.n, 0)::DOUBLE AS o
    FROM (SELECT DISTINCT cohort FROM samples) k, (SELECT DISTINCT tissue FROM samples) r,
      (SELECT DISTINCT o_orderpriority AS pr FROM orders) p
    LEFT JOIN (SELECT cohort, tissue, o_orderpriority AS pr, count(*) AS n FROM orders
      JOIN samples ON o_custkey = sample GROUP BY 1, 2, 3) x
      ON x.cohort = k.cohort AND x.tissue = r.tissue AND x.pr = p.pr)"""


@query(
    "chi_square",
    with_sql("samples", "").rstrip()
    + f""", {GRID_SQL}, tested AS {CHI_SQL.format(keys='cohort', row='tissue', col='priority', source='grid')}
    SELECT cohort, round(chi, 6) AS statistic, 4.0::DOUBLE AS dof, round(least_e, 6) AS expected_min,
      n::BIGINT AS n, least_e < 5 AS sparse, round(exp(-chi / 2) * (1 + chi / 2), 6) AS p_value FROM tested""",
)
def _chi(t):
    cells = (
        t.orders.join(t.samples(), F.col("o_custkey") == F.col("sample"))
        .groupBy("cohort", "tissue", F.col("o_orderpriority").alias("priority"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return rounded(contingency.chi_square(cells, ["cohort"], "tissue", "priority"))


@query(
    "chi_square_yates",
    f"""WITH {PART_CELLS}, m AS (SELECT *, a + b + c + d AS n, abs(a * d - b * c)::DOUBLE AS g,
        (a + b)::DOUBLE * (c + d) * (a + c) * (b + d) AS prod FROM cells),
      s AS (SELECT *, n * pow(greatest(g - least(n / 2.0, g), 0), 2) / prod AS x FROM m WHERE prod > 0)
    SELECT key, n, round(x, 6) AS statistic, round({normal_sql('sqrt(x)')}, 6) AS p_value FROM s""",
)
def _yates(t):
    cells = t.lineitem.groupBy(
        F.col("l_partkey").alias("key"), (F.col("l_returnflag") == "R").alias("r"), F.col("l_linestatus").alias("s")
    ).agg(F.count(F.lit(1)).alias("n"))
    out = contingency.chi_square(cells, ["key"], "r", "s", yates=True)
    return rounded(out.where("statistic is not null").select("key", "n", "statistic", "p_value"))


HET = ("case_het", "case_wt", "control_het", "control_wt")
HOM = ("case_hom", "case_wt", "control_hom", "control_wt")
TWO = "(CASE WHEN case_wt + control_wt > 0 THEN 1 ELSE 0 END + CASE WHEN case_het + control_het > 0 THEN 1 ELSE 0 END + CASE WHEN case_hom + control_hom > 0 THEN 1 ELSE 0 END)"


def _chi3_sql() -> str:
    parts = []
    for x in ("wt", "het", "hom"):
        for arm, size in (("case", "nt"), ("control", "nc")):
            e = f"({size}::DOUBLE * (case_{x} + control_{x}) / n)"
            parts.append(f"pow({arm}_{x} - {e}, 2) / {e}")
    return " + ".join(parts)


@query(
    "genotype_test",
    with_sql("samples purchases calls arms counts", "").rstrip()
    + f""", {TREND_CTES}, cascade AS (SELECT *, {TWO} AS classes,
      least(case_wt + control_wt, case_het + control_het, case_hom + control_hom)::DOUBLE * least(nt, nc) / n AS least_e
      FROM trends), tests AS (SELECT *,
      CASE WHEN classes = 3 THEN {_chi3_sql()} END AS chi,
      CASE WHEN case_het + control_het > 0 AND case_wt + control_wt > 0 THEN {fisher_sql(*HET)} END AS het_p,
      CASE WHEN case_hom + control_hom > 0 AND case_wt + control_wt > 0 THEN {fisher_sql(*HOM)} END AS hom_p,
      CASE WHEN classes = 2 AND case_wt + control_wt = 0 THEN {fisher_sql('case_het', 'case_hom', 'control_het', 'control_hom')}
        WHEN classes = 2 AND case_het + control_het = 0 THEN {fisher_sql('case_wt', 'case_hom', 'control_wt', 'control_hom')}
        WHEN classes = 2 THEN {fisher_sql('case_wt', 'case_het', 'control_wt', 'control_het')} END AS exact_p,
      CASE WHEN classes >= 2 THEN {normal_sql('z')} END AS trend_p FROM cascade),
    final AS (SELECT *, CASE WHEN classes = 3 AND least_e >= 5 THEN exp(-chi / 2) ELSE exact_p END AS dist_p FROM tests)
    SELECT comparison, variant, classes AS classes_observed, round(chi, 6) AS chi2,
      CASE WHEN classes = 3 THEN round(least_e, 6) END AS expected_min,
      CASE WHEN classes < 2 THEN 'Skipped' WHEN classes = 2 THEN 'Fisher exact on reduced 2x2 genotype table'
        WHEN least_e < 5 THEN 'Skipped sparse 2x3 genotype table'
        ELSE 'Pearson chi-square on 2x3 genotype table' END AS method,
      round(z, 6) AS trend_z, round(dist_p, 6) AS distribution_p, round(trend_p, 6) AS trend_p,
      round(CASE WHEN het_p IS NOT NULL THEN {cells_sql(ODDS_SQL, *HET)} END, 6) AS het_or, round(het_p, 6) AS het_p,
      round(CASE WHEN hom_p IS NOT NULL THEN {cells_sql(ODDS_SQL, *HOM)} END, 6) AS hom_or, round(hom_p, 6) AS hom_p,
      round(least(dist_p, trend_p, het_p, hom_p), 6) AS best_p FROM final""",
)
def _genotype_test(t):
    counts = compare.genotype_counts(t.calls(), t.samples())
    names = ("wt", "het", "hom")
    columns = ["comparison", "variant"] + [f"{arm}_{x}" for arm in ("case", "control") for x in names]
    out = contingency.genotype_test(
        counts.select(*columns), [f"case_{x}" for x in names], [f"control_{x}" for x in names]
    )
    return rounded(out.drop(*columns[2:], "primary_p", "primary_source"))


@query(
    "callable_genotype_counts",
    with_sql("samples purchases arms", "").rstrip()
    + """, mi AS (SELECT DISTINCT sample, p_partkey AS variant FROM purchases WHERE l_discount >= 0.09),
    cl AS (SELECT sample, p_partkey AS variant, least(count(DISTINCT l_orderkey), 2) AS dosage FROM purchases GROUP BY 1, 2),
    un AS (SELECT * FROM cl ANTI JOIN mi USING (sample, variant) UNION ALL SELECT sample, variant, NULL FROM mi),
    sz AS (SELECT comparison, sum(is_case)::BIGINT AS case_n, sum(1 - is_case)::BIGINT AS control_n FROM arms GROUP BY 1),
    ct AS (SELECT comparison, variant, any_value(case_n) - count(*) FILTER (is_case = 1 AND dosage IS NULL) AS case_callable,
      any_value(control_n) - count(*) FILTER (is_case = 0 AND dosage IS NULL) AS control_callable,
      count(*) FILTER (is_case = 1 AND dosage = 1) AS case_het, count(*) FILTER (is_case = 1 AND dosage = 2) AS case_hom,
      count(*) FILTER (is_case = 0 AND dosage = 1) AS control_het, count(*) FILTER (is_case = 0 AND dosage = 2) AS control_hom
      FROM un JOIN arms USING (sample) JOIN sz USING (comparison) GROUP BY 1, 2)
    SELECT *, case_callable - case_het - case_hom AS case_wt, control_callable - control_het - control_hom AS control_wt,
      CASE WHEN case_het + case_hom > 0 AND control_het + control_hom > 0 THEN 'shared' WHEN case_het + case_hom > 0 THEN 'tumour_only'
        WHEN control_het + control_hom > 0 THEN 'normal_only' ELSE 'uncalled' END AS variant_status FROM ct""",
)
def _callable_counts(t):
    """Parts as variants: many are carried by controls only; lines of high discount stand for calls that are not usable."""
    rows = t.purchases().select("sample", F.col("p_partkey").alias("variant"), "l_orderkey", "l_discount")
    missing = rows.where("l_discount >= 0.09").select("sample", "variant").distinct()
    dosage = F.when(F.min("l_orderkey") == F.max("l_orderkey"), 1).otherwise(2).alias("dosage")
    calls = rows.groupBy("sample", "variant").agg(dosage).join(missing, ["sample", "variant"], "left_anti")
    out = compare.genotype_counts(calls, t.samples(), missing=missing)
    case, control = F.col("case_het") + F.col("case_hom"), F.col("control_het") + F.col("control_hom")
    status = F.when((case > 0) & (control > 0), "shared").when(case > 0, "tumour_only").when(control > 0, "normal_only").otherwise("uncalled")
    names = ["callable", "wt", "het", "hom"]
    return out.select("comparison", "variant", *[f"{arm}_{x}" for arm in ("case", "control") for x in names], status.alias("variant_status"))
