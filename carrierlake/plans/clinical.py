"""Messy clinical text spelled from order and customer numbers, and typed outcome tests."""

from pyspark.sql import functions as F

from carrierlake.functions import clinical as rules
from carrierlake.operators import burden, compare, harmonise, similarity
from carrierlake.plans.association import ODDS_SQL, PART_CELLS, TREND_CTES, cells_sql
from carrierlake.plans.registry import bh_sql, fisher_sql, normal_sql, query, rounded, with_sql

N = 8
# Per spelling: the text of each rule for case k (n is a number from the row) and the value it must give.
CASES = {
    "yes_no": [("' Sí'", "'Yes'"), ("'NEG'", "'No'"), ("'1.0'", "'Yes'"), ("'?'", "NULL"), ("'yes'", "'Yes'"), ("'Positiva '", "'Yes'"), ("'0'", "'No'"), ("'-'", "'No'")],
    "first_number": [("n || ' años'", "n"), ("'~' || n", "n"), ("n || ',5'", "n + 0.5"), ("'none'", "NULL"), ("'>=' || n", "n"), ("n || '-12'", "n"), ("'a'", "NULL"), ("'G' || n", "n")],
    "bmi": [("n || ' kg; 168 cm'", "CASE WHEN n < 25 THEN n WHEN n >= 29 THEN round(n / (1.68 * 1.68), 2) END"), ("'73 kg'", "NULL"), ("'Sobrepeso'", "NULL"), ("'27,5'", "27.5"), ("'x'", "NULL"),
            ("n || '.25'", "CASE WHEN n BETWEEN 10 AND 69 THEN n + 0.25 END"), ("'18?'", "18.0"), ("''", "NULL")],
    "bmi_category": [("'Sobrepeso'", "'Overweight'"), ("'obesidad I'", "'Obese'"), ("'bajo peso'", "'Underweight'"), ("'27,5'", "'Overweight'"), ("'NR'", "NULL"), ("'22'", "'Normal'"), ("'31.0'", "'Obese'"), ("'70 kg'", "NULL")],
    "weight_kg": [("n || ' kg'", "CASE WHEN n BETWEEN 25 AND 250 THEN n END"), ("'73,5KG'", "73.5"), ("'300 kg'", "NULL"), ("'60'", "NULL"), ("'x'", "NULL"), ("'50 kg; 160 cm'", "50.0"), ("'SOBREPESO'", "NULL"), ("'20 kg'", "NULL")],
    "midpoint": [("'20-25%'", "22.5"), ("'>50%'", "50.0"), ("'6,2'", "6.2"), ("n || ' - ' || (n + 3)", "n + 1.5"), ("'1900-01-20'", "21.0"), ("'none'", "NULL"), ("'<=' || n", "n"), ("'01/05/1900'", "6.0")],
    "ki67": [("'0,25'", "25.0"), ("'30'", "30.0"), ("'20-40'", "30.0"), ("'ND'", "NULL"), ("'1'", "1.0"), ("'150'", "NULL"), ("'pending'", "NULL"), ("'12.34'", "12.3")],
    "receptor_status": [("'Negative'", "'Negative'"), ("'POS 80%'", "'Positive'"), ("'90'", "'Positive'"), ("'0.5'", "'Negative'"), ("'N/A'", "NULL"), ("'positivo'", "'Positive'"), ("'250'", "NULL"), ("'focal'", "'Positive'")],
    "p53_status": [("'wild type'", "'Normal'"), ("'overexpressed 90'", "'Aberrant'"), ("'9'", "'Normal'"), ("'10'", "'Aberrant'"), ("'0.05'", "'Normal'"), ("'0.5'", "'Aberrant'"), ("'ND'", "NULL"), ("'lost'", "'Aberrant'")],
    "grade": [("'G3'", "3"), ("'GRADO 2'", "2"), ("'1'", "1"), ("'G5'", "NULL"), ("'x'", "NULL"), ("'high 4'", "4"), ("'2/3'", "2"), ("''", "NULL")],
    "figo": [("'FIGO 1A'", "'IA'"), ("'Stage IIIC1'", "'IIIC1'"), ("'x'", "NULL"), ("'4b'", "'IVB'"), ("'estadio II'", "'II'"), ("'III-C2'", "'IIIC2'"), ("'5'", "NULL"), ("'iv'", "'IV'")],
    "date": [("'13/02/2020'", "'2020-02-13'"), ("'02/13/2020'", "'2020-02-13'"), ("'03/04/2020'", "'2020-04-03'"), ("'2021-7-9'", "'2021-07-09'"), ("'43831'", "'2020-01-01'"), ("'05-06-2019'", "'2019-06-05'"), ("'soon'", "NULL"), ("'31/31/2020'", "NULL")],
    "chemo": [("'AC x4 + taxol'", "'Yes'"), ("'tamoxifeno'", "'No'"), ("'no consta'", "NULL"), ("'QT + RT'", "'Yes'"), ("'x'", "NULL"), ("'Radioterapia'", "'No'"), ("'quimio'", "'Yes'"), ("''", "NULL")],
    "volume": [("'2 x 3 x 4'", "24.0"), ("'1,5x2'", "3.0"), ("'7'", "NULL"), ("n || ' × 2'", "n * 2"), ("'x'", "NULL"), ("'2x2x2x9'", "8.0"), ("'big'", "NULL"), ("'10X10'", "100.0")],
    "clean": [("'aÃ±os'", "'años'"), ("' x '", "'x'"), ("'Ã©xito'", "'éxito'"), ("'plain'", "'plain'"), ("'NAN'", "NULL"), ("'null'", "NULL"), ("'Sí'", "'Sí'"), ("'N/A'", "NULL")],
    "msi": [("'MSI-H'", "'MSI'"), ("'MSS'", "'MSS'"), ("'stable'", "'MSS'"), ("'unstable'", "'MSI'"), ("'dMMR'", "'MSI'"), ("'pMMR'", "'MSS'"), ("'?'", "NULL"), ("'intact'", "'MSS'")],
}
RULES = {
    "yes_no": rules.yes_no, "first_number": rules.first_number, "bmi": rules.bmi, "bmi_category": rules.bmi_category, "weight_kg": rules.weight_kg, "midpoint": rules.numeric_midpoint,
    "ki67": rules.ki67_percent, "receptor_status": lambda c: rules.receptor(c)["status"], "p53_status": lambda c: rules.p53(c)["status"], "grade": rules.grade, "figo": rules.figo_stage,
    "date": lambda c: rules.parse_date(c).cast("string"), "chemo": lambda c: rules.treatment_flags(c)["chemotherapy"], "volume": rules.tumour_volume, "clean": rules.meaningful,
    "msi": harmonise.msi_status,
}
KINDS = {"first_number": "DOUBLE", "bmi": "DOUBLE", "weight_kg": "DOUBLE", "midpoint": "DOUBLE", "ki67": "DOUBLE", "grade": "INTEGER", "volume": "DOUBLE"}


def case_sql(name: str, side: int) -> str:
    options = " ".join(f"WHEN {k} THEN {pair[side]}" for k, pair in enumerate(CASES[name]))
    return f"CASE o_orderkey % {N} {options} END"


def messy(t):
    text = {name: F.expr(case_sql(name, 0)).alias(f"raw_{name}") for name in CASES}
    return t.orders.withColumn("n", F.col("o_custkey") % 90 + 10).select("o_orderkey", *text.values())


@query(
    "harmonise_clinical",
    "SELECT o_orderkey, " + ", ".join(f"({case_sql(name, 1)})::{KINDS.get(name, 'VARCHAR')} AS {name}" for name in CASES) + " FROM (SELECT *, o_custkey % 90 + 10 AS n FROM orders)",
)
def _harmonise(t):
    out = harmonise.harmonise_clinical(messy(t), {name: (f"raw_{name}", rule) for name, rule in RULES.items()})
    return rounded(out.select("o_orderkey", *CASES))


@query(
    "canonicalise",
    """WITH x AS (SELECT o_orderkey, o_orderkey % 4 AS k FROM orders)
    SELECT o_orderkey, CASE k WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' WHEN 2 THEN 'Yes' END AS canon__exitus, CASE k WHEN 0 THEN 'first' WHEN 1 THEN 'second' WHEN 2 THEN 'second' END AS canon__exitus__source,
      NULL::VARCHAR AS canon__absent, NULL::VARCHAR AS canon__absent__source, CASE k WHEN 0 THEN 'Dead' WHEN 1 THEN 'Alive' WHEN 2 THEN 'Dead' END AS vital, CASE k WHEN 3 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'Yes' END AS recurrence FROM x""",
)
def _canonicalise(t):
    k = F.col("o_orderkey") % 4
    pick = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), k.cast("int"))
    raw = t.orders.select("o_orderkey", pick("Sí", "N/A", "", "null").alias("first"), pick("no", "NEG", "1", "nan").alias("Second_col"))
    raw = raw.withColumnRenamed("Second_col", "second")
    out = harmonise.canonicalise(raw, {"exitus": (["FIRST", "missing_one", "second"], rules.yes_no), "absent": (["nothing"], None)})
    return out.select(
        "o_orderkey", "canon__exitus", "canon__exitus__source", "canon__absent", "canon__absent__source", harmonise.vital_from_flag(F.col("canon__exitus")).alias("vital"),
        harmonise.event_flag(F.col("canon__exitus"), F.lit("2020-01-01").cast("date")).alias("recurrence"),
    )


@query(
    "canon_coverage",
    """SELECT 'canon__exitus' AS "column", count(*) FILTER (o_orderkey % 4 < 3) AS filled, 2::BIGINT AS n_sources, round(count(*) FILTER (o_orderkey % 4 < 3) * 100.0 / count(*)::DOUBLE, 6) AS pct_filled FROM orders""",
)
def _coverage(t):
    k = F.col("o_orderkey") % 4
    raw = t.orders.select(F.when(k == 0, "Sí").otherwise("N/A").alias("first"), F.when(k == 3, "nan").otherwise("no").alias("second"))
    return rounded(harmonise.canon_coverage(harmonise.canonicalise(raw, {"exitus": (["first", "second"], rules.yes_no)})))


@query(
    "derived_flags",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 2 = 0 AND o_orderstatus = 'F' THEN 'Yes' WHEN o_orderkey % 2 = 1 OR o_custkey % 2 = 1 OR o_orderstatus = 'O' THEN 'No' END AS triple_negative,
      CASE WHEN o_orderkey % 5 = 0 THEN 'Pre' WHEN o_custkey % 90 >= 50 THEN 'Post' ELSE 'Pre' END AS menopause, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 7)::DOUBLE WHEN o_custkey > 0 AND o_custkey / 30.44 < 600 THEN round(o_custkey / 30.44, 6) END AS months,
      CASE WHEN o_orderkey % 3 = 0 THEN 'months' WHEN o_custkey > 0 AND o_custkey / 30.44 < 600 THEN 'derived_from_dates' END AS months__source FROM orders""",
)
def _flags(t):
    sign = lambda c: F.when(c, "Negative").otherwise("Positive")
    er, pr = sign(F.col("o_orderkey") % 2 == 0), sign(F.col("o_custkey") % 2 == 0)
    her2 = F.when(F.col("o_orderstatus") == "F", "Negative").when(F.col("o_orderstatus") == "O", "Positive")
    df = t.orders.select(
        "o_orderkey", harmonise.triple_negative(er, pr, her2).alias("triple_negative"),
        harmonise.menopause(F.when(F.col("o_orderkey") % 5 == 0, "Premenopausal"), F.col("o_custkey") % 90).alias("menopause"),
        F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 7).cast("double")).alias("months"),
        F.lit("2000-01-01").cast("date").alias("d1"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("o_custkey").cast("int")).alias("d2"),
    )
    return rounded(harmonise.fill_months(df, "months", "d1", "d2").drop("d1", "d2"))


@query(
    "ordinal_levels",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 3.3 WHEN 2 THEN 4.0 END::DOUBLE AS figo, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 4.0 END::DOUBLE AS risk,
      CASE WHEN o_custkey % 60 < 20 THEN NULL WHEN o_custkey % 60 < 25 THEN 'Normal' WHEN o_custkey % 60 < 30 THEN 'Overweight' ELSE 'Obese' END AS bmi_class FROM orders""",
)
def _ordinal(t):
    k = F.get(F.array(*[F.lit(x) for x in ("IA", "iiic1", " IV", "x")]), (F.col("o_orderkey") % 4).cast("int"))
    risk = F.when(F.col("o_orderstatus") == "F", "low").when(F.col("o_orderstatus") == "O", "High")
    return t.orders.select(
        "o_orderkey", rules.ordinal(k, rules.FIGO_LEVELS).alias("figo"), rules.ordinal(risk, rules.RISK_LEVELS).alias("risk"), rules.bmi_class(F.col("o_custkey") % 60).alias("bmi_class")
    )


@query(
    "class_summary",
    with_sql("samples", "").rstrip() + """, b AS (SELECT cohort, tissue, CASE WHEN sample % 60 < 20 THEN 'Unavailable' WHEN sample % 60 < 25 THEN 'Normal' WHEN sample % 60 < 30 THEN 'Overweight' ELSE 'Obese' END AS c FROM samples),
      k AS (SELECT cohort, tissue, count(*) AS n_samples, [count(*) FILTER (c = 'Normal'), count(*) FILTER (c = 'Overweight'), count(*) FILTER (c = 'Obese'), count(*) FILTER (c = 'Unavailable')] AS v FROM b GROUP BY 1, 2)
    SELECT cohort, tissue, n_samples, class, n, round(n * 100.0 / n_samples::DOUBLE, 6) AS pct FROM (SELECT cohort, tissue, n_samples, unnest(['Normal', 'Overweight', 'Obese', 'Unavailable']) AS class, unnest(v) AS n FROM k)""",
)
def _class_summary(t):
    return rounded(harmonise.class_summary(t.samples(), ["cohort", "tissue"], rules.bmi_class(F.col("sample") % 60), ["Normal", "Overweight", "Obese"]))


# --- exposures against typed outcomes -------------------------------------------------------------

OUT = """oc AS (SELECT c_custkey AS sample, CASE WHEN c_acctbal > 5000 THEN 'Yes' ELSE 'No' END AS rich, (c_nationkey % 4)::VARCHAR AS zone, c_acctbal AS bal FROM customer),
  tot AS (SELECT count(*) AS n, count(*) FILTER (rich = 'Yes') AS ty FROM oc)"""
OUT_SQL = with_sql("purchases calls", "").rstrip() + ", " + OUT


def outcomes(t):
    wide = t.customer.select(
        F.col("c_custkey").alias("sample"), F.when(F.col("c_acctbal") > 5000, "Yes").otherwise("No").alias("rich"), (F.col("c_nationkey") % 4).cast("string").alias("zone"), F.col("c_acctbal").cast("string").alias("bal")
    )
    kind = F.create_map(*[F.lit(x) for x in ("rich", "binary", "zone", "nominal", "bal", "continuous")])
    return wide.unpivot(["sample"], ["rich", "zone", "bal"], "var", "value").withColumn("type", F.try_element_at(kind, F.col("var")))


@query(
    "clinical_association",
    OUT_SQL + f""", b AS (SELECT variant, count(*) FILTER (rich = 'Yes') AS a, count(*) FILTER (rich = 'No') AS b, any_value(ty) - count(*) FILTER (rich = 'Yes') AS c, any_value(n - ty) - count(*) FILTER (rich = 'No') AS d
        FROM calls JOIN oc USING (sample), tot GROUP BY 1),
      rk AS (SELECT sample, rank() OVER (ORDER BY bal) + (count(*) OVER (PARTITION BY bal) - 1) / 2.0 AS r FROM oc), tie AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*) AS c FROM oc GROUP BY bal)),
      u AS (SELECT variant, count(*) AS n1, any_value(n) - count(*) AS n2, sum(r) - count(*) * (count(*) + 1) / 2.0 AS u, any_value(ties) AS ties FROM calls JOIN rk USING (sample), tot, tie GROUP BY 1),
      z AS (SELECT *, CASE WHEN abs(u - n1 * n2 / 2.0) > 0.5 THEN (abs(u - n1 * n2 / 2.0) - 0.5) / sqrt(n1::DOUBLE * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)))) ELSE 0.0 END AS z FROM u),
      zc AS (SELECT variant, zone, count(*)::DOUBLE AS k FROM calls JOIN oc USING (sample) GROUP BY 1, 2), zt AS (SELECT zone, count(*)::DOUBLE AS t FROM oc GROUP BY 1),
      zz AS (SELECT v.variant, zt.zone, coalesce(k, 0) AS k, t, sum(coalesce(k, 0)) OVER (PARTITION BY v.variant) AS n1, sum(t) OVER (PARTITION BY v.variant) AS n FROM (SELECT DISTINCT variant FROM zc) v CROSS JOIN zt LEFT JOIN zc ON zc.variant = v.variant AND zc.zone = zt.zone),
      cq AS (SELECT variant, sum((k - n1 * t / n) ** 2 / (n1 * t / n) + (t - k - (n - n1) * t / n) ** 2 / ((n - n1) * t / n)) AS x FROM zz GROUP BY 1)
    SELECT variant, 'rich' AS var, 'binary' AS type, NULL::DOUBLE AS statistic, round({cells_sql(ODDS_SQL, 'a', 'b', 'c', 'd')}, 6) AS effect, round({fisher_sql('a', 'b', 'c', 'd')}, 6) AS p_value FROM b
    UNION ALL SELECT variant, 'bal', 'continuous', round(u, 6)::DOUBLE, round(1 - 2 * u / (n1::DOUBLE * n2), 6), round({normal_sql('z')}, 6) FROM z
    UNION ALL SELECT variant, 'zone', 'nominal', round(x, 6), NULL, round({normal_sql('sqrt(x)')} + sqrt(2 / pi()) * sqrt(x) * exp(-x / 2), 6) FROM cq""",
)
def _association(t):
    return rounded(harmonise.clinical_association(t.calls(), outcomes(t), "variant"))


DOSE = """geno AS (SELECT variant, any_value(ty) AS case_callable, any_value(n - ty) AS control_callable, count(*) FILTER (rich = 'Yes' AND dosage = 1) AS case_het, count(*) FILTER (rich = 'Yes' AND dosage = 2) AS case_hom,
      any_value(ty) - count(*) FILTER (rich = 'Yes') AS case_wt, count(*) FILTER (rich = 'No' AND dosage = 1) AS control_het, count(*) FILTER (rich = 'No' AND dosage = 2) AS control_hom,
      any_value(n - ty) - count(*) FILTER (rich = 'No') AS control_wt FROM calls JOIN oc USING (sample), tot GROUP BY 1)"""
HET, HOM = ("case_het", "case_wt", "control_het", "control_wt"), ("case_hom", "case_wt", "control_hom", "control_wt")


@query(
    "dose_association",
    OUT_SQL + f""", {DOSE}, {TREND_CTES} SELECT variant, 'rich' AS var, case_wt, case_het, case_hom, control_wt, control_het, control_hom, round(z, 6) AS trend_z, round({normal_sql('z')}, 6) AS trend_p,
      round({cells_sql(ODDS_SQL, *HET)}, 6) AS het_or, round({fisher_sql(*HET)}, 6) AS het_p, round({cells_sql(ODDS_SQL, *HOM)}, 6) AS hom_or, round({fisher_sql(*HOM)}, 6) AS hom_p FROM trends""",
)
def _dose(t):
    binary = outcomes(t).where("type = 'binary'").select("sample", "var", "value")
    out = harmonise.dose_association(t.calls(), binary, "variant")
    return rounded(out.select("variant", "var", *[f"{a}_{g}" for a in ("case", "control") for g in ("wt", "het", "hom")], "trend_z", "trend_p", "het_or", "het_p", "hom_or", "hom_p"))


CONTRAST = "CASE WHEN {alt} > 0 THEN {alt} * 100.0 / ({alt} + {ref})::DOUBLE ELSE 0.0 END"


def tested_sql(source: str) -> str:
    """CTEs over (comparison, case_carriers, control_carriers, case_n, control_n): exact p, odds ratio, FDR per comparison as ``adj``."""
    cells = ("case_carriers", "(case_n - case_carriers)", "control_carriers", "(control_n - control_carriers)")
    return f""", ts AS (SELECT *, {fisher_sql(*cells)} AS p, {cells_sql(ODDS_SQL, *cells)} AS o FROM {source}), adj AS ({bh_sql('ts', 'p', 'comparison', 'q')})"""


@query(
    "contrast_from_counts",
    with_sql("samples purchases calls arms counts", "").rstrip() + f""", x AS (SELECT *, case_het + case_hom AS ca, control_het + control_hom AS na FROM geno WHERE case_het + case_hom + control_het + control_hom > 0 AND case_wt + control_wt > 0)
    SELECT comparison, variant, 'carrier' AS contrast, round({fisher_sql('ca', 'case_wt', 'na', 'control_wt')}, 6) AS p_value, round({cells_sql(ODDS_SQL, 'ca', 'case_wt', 'na', 'control_wt')}, 6) AS odds_ratio,
      round(ca * 100.0 / case_callable::DOUBLE - na * 100.0 / control_callable::DOUBLE, 6) AS difference_pct FROM x""",
)
def _contrast(t):
    counts = compare.genotype_counts(t.calls(), t.samples())
    out = compare.contrast_from_counts(counts, "carrier")
    return rounded(out.select("comparison", "variant", "contrast", "p_value", "odds_ratio", "difference_pct"))


@query(
    "mask_burden",
    with_sql("samples purchases arms", "").rstrip() + """, mk AS (SELECT DISTINCT sample, unnest(list_filter([CASE WHEN p_size > 40 THEN 'large' END, CASE WHEN p_type = 'PROMO' THEN 'promo' END, CASE WHEN p_retailprice > 1500 THEN 'costly' END, 'any'], lambda x: x IS NOT NULL)) AS mask FROM purchases)
, mm AS (SELECT a.comparison, mask, sum(is_case)::BIGINT AS case_carriers, sum(1 - is_case)::BIGINT AS control_carriers, any_value(case_n) AS case_n, any_value(control_n) AS control_n FROM arms a JOIN mk USING (sample)
      JOIN (SELECT comparison, sum(is_case)::BIGINT AS case_n, sum(1 - is_case)::BIGINT AS control_n FROM arms GROUP BY 1) s ON s.comparison = a.comparison GROUP BY 1, 2)"""
    + tested_sql("mm")
    + """ SELECT comparison, mask, case_carriers, control_carriers, case_n, control_n, round(o, 6) AS odds_ratio, round(p, 6) AS p_value, round(q, 6) AS fdr FROM adj""",
)
def _masks(t):
    masks = {"large": F.col("p_size") > 40, "promo": F.col("p_type") == "PROMO", "costly": F.col("p_retailprice") > 1500, "any": F.lit(True)}
    out = compare.mask_burden(t.purchases(), t.samples(), masks)
    return rounded(out.select("comparison", "mask", "case_carriers", "control_carriers", "case_n", "control_n", "odds_ratio", "p_value", "fdr"))


@query(
    "hotspots",
    with_sql("samples purchases arms", "").rstrip() + """, al AS (SELECT p_brand, p_size, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS alleles FROM purchases GROUP BY 1, 2), d AS (SELECT DISTINCT sample, p_brand, p_size FROM purchases)
, sz AS (SELECT comparison, sum(is_case)::BIGINT AS case_n, sum(1 - is_case)::BIGINT AS control_n FROM arms GROUP BY 1),
    hh AS (SELECT comparison, p_brand, p_size, sum(is_case)::BIGINT AS case_carriers, sum(1 - is_case)::BIGINT AS control_carriers, any_value(alleles) AS alleles, count(*) >= 2 AS recurrent,
      any_value(case_n) AS case_n, any_value(control_n) AS control_n
    FROM d JOIN arms USING (sample) JOIN al USING (p_brand, p_size) JOIN sz USING (comparison) GROUP BY 1, 2, 3)"""
    + tested_sql("hh")
    + """ SELECT comparison, p_brand, p_size, case_carriers, control_carriers, alleles, recurrent, round(o, 6) AS odds_ratio, round(p, 6) AS p_value, round(q, 6) AS fdr FROM adj""",
)
def _hotspots(t):
    out = compare.hotspots(t.purchases(), t.samples(), ["p_brand", "p_size"], "p_type")
    return rounded(out.select("comparison", "p_brand", "p_size", "case_carriers", "control_carriers", "alleles", "recurrent", "odds_ratio", "p_value", "fdr"))


def rare(t):
    return t.purchases().select("sample", F.col("p_partkey").alias("variant"), F.col("p_brand").alias("gene"))


RARE = with_sql("samples purchases", "").rstrip()


@query(
    "sample_burden",
    RARE + """ SELECT s.sample, count(DISTINCT p_partkey) AS n_variants, count(DISTINCT p_brand) AS n_genes, count(DISTINCT p_partkey) > 0 AS any_rare, count(DISTINCT p_partkey) > 1 AS multiple_rare
      FROM samples s LEFT JOIN purchases p ON p.sample = s.sample GROUP BY 1""",
)
def _burden(t):
    return burden.sample_burden(rare(t), t.samples())


@query("gene_burden", RARE + " SELECT sample, p_brand AS gene, count(DISTINCT p_partkey) AS n_variants FROM purchases GROUP BY 1, 2")
def _gene_burden(t):
    return burden.gene_burden(rare(t))


@query(
    "exposure_catalogue",
    RARE + """, x AS (SELECT sample, p_partkey, 'variant' AS exposure_type, p_partkey::VARCHAR AS exposure FROM purchases UNION ALL SELECT sample, p_partkey, 'gene', p_brand FROM purchases UNION ALL SELECT sample, p_partkey, 'any', 'any_rare' FROM purchases)
    SELECT exposure_type, exposure, count(DISTINCT sample) AS n_carriers, count(DISTINCT p_partkey) AS n_components FROM x GROUP BY 1, 2 HAVING count(DISTINCT sample) >= 3""",
)
def _catalogue(t):
    return burden.exposure_catalogue(rare(t), 3)


@query("variant_catalogue", RARE + " SELECT p_partkey AS variant, p_brand AS gene, count(DISTINCT sample) AS n_carriers, count(*) AS n_rows FROM purchases GROUP BY 1, 2")
def _variant_catalogue(t):
    return burden.variant_catalogue(rare(t))


@query(
    "strata",
    with_sql("purchases calls", "").rstrip() + """, st AS (SELECT o_custkey AS sample, o_orderpriority AS stratum, bool_or(o_orderstatus = 'F') AS exposed FROM orders GROUP BY 1, 2),
      sz AS (SELECT stratum, count(*) FILTER (exposed) AS n_exposed, count(*) AS n_samples FROM st GROUP BY 1)
    SELECT stratum, variant, count(*) AS n_carriers, any_value(n_exposed) AS n_exposed FROM calls JOIN st USING (sample) JOIN sz USING (stratum) WHERE exposed AND n_exposed >= 15 GROUP BY 1, 2""",
)
def _strata(t):
    strata = t.orders.groupBy(F.col("o_custkey").alias("sample"), F.col("o_orderpriority").alias("stratum")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("exposed"))
    sizes, rows = harmonise.in_strata(t.calls(), strata)
    counts = rows.groupBy("stratum", "variant").agg(F.count(F.lit(1)).alias("n_carriers"))
    return counts.join(sizes.select("stratum", "n_exposed"), "stratum")


# --- sample identity --------------------------------------------------------------------------------


@query(
    "identity_groups",
    """WITH g AS (SELECT user_id AS code, event_type AS et, string_agg(DISTINCT day::VARCHAR, ',' ORDER BY day::VARCHAR) AS dig FROM (SELECT *, date_part('day', ts) // 16 AS day FROM events) GROUP BY 1, 2),
      s AS (SELECT code, code || ':' || et AS sample, dig FROM g), r AS (SELECT code, dig, count(*) AS group_size, min(sample) AS root FROM s GROUP BY 1, 2),
      o AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY root)::INT AS group_order, count(*) OVER (PARTITION BY code) AS n_groups FROM r)
    SELECT sample, s.code, group_order, group_size, n_groups, group_size > 1 AS collapsed_alias, CASE WHEN n_groups = 1 THEN s.code::VARCHAR ELSE s.code || '_run' || group_order END AS analysis_id FROM s JOIN o USING (code, dig)""",
)
def _identity(t):
    day = F.floor(F.dayofmonth("ts") / 16)
    rows = t.events.select(F.concat_ws(":", "user_id", "event_type").alias("sample"), day.alias("locus"), F.lit("x").alias("call"), F.col("user_id").alias("code")).distinct()
    digests = similarity.genotype_digest(rows)
    return similarity.identity_groups(digests, rows.select("sample", "code").distinct(), "code")


PAIRS = with_sql("purchases calls", "").rstrip() + """, pr AS (SELECT a.c_custkey AS sample_1, b.c_custkey AS sample_2 FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1),
  cl AS (SELECT sample, variant AS locus, CASE dosage WHEN 1 THEN 'Het_ALT' ELSE 'Hom_ALT' END AS status, CASE WHEN right(variant, 1) IN ('1', '2', '3') THEN 'common' WHEN right(variant, 1) IN ('4', '5', '6') THEN 'rare' ELSE 'mixed' END AS cls FROM calls),
  lf AS (SELECT pr.*, locus, status, cls FROM pr JOIN cl ON sample = sample_1), rt AS (SELECT pr.*, locus, status, cls FROM pr JOIN cl ON sample = sample_2),
  jn AS (SELECT sample_1, sample_2, locus, lf.status AS s1, rt.status AS s2, coalesce(lf.cls, rt.cls) AS cls FROM lf FULL JOIN rt USING (sample_1, sample_2, locus)),
  mt AS (SELECT sample_1, sample_2, """ + ", ".join(
    f"count(*) FILTER (s1 IS NOT NULL AND s2 IS NOT NULL{c}) AS comparable_{n}, count(*) FILTER (s1 = s2{c}) AS exact_{n}" for n, c in (("all", ""), ("common", " AND cls = 'common'"), ("rare", " AND cls = 'rare'"))
) + """, count(*) FILTER (s1 IS NOT NULL AND s2 IS NOT NULL AND cls = 'common') AS shared_common, count(*) FILTER (cls = 'common') AS union_common,
    count(*) FILTER (s1 IS NOT NULL AND s2 IS NOT NULL AND cls = 'rare') AS shared_rare, count(*) FILTER (cls = 'rare') AS union_rare FROM jn GROUP BY 1, 2)"""


@query(
    "pairwise_concordance",
    PAIRS + """ SELECT *, """ + ", ".join(f"round(CASE WHEN comparable_{n} > 0 THEN exact_{n} / comparable_{n}::DOUBLE END, 6) AS concordance_{n}" for n in ("all", "common", "rare"))
    + ", " + ", ".join(f"round(CASE WHEN union_{n} > 0 THEN shared_{n} / union_{n}::DOUBLE END, 6) AS jaccard_{n}" for n in ("common", "rare"))
    + """, CASE WHEN sample_1 % 2 = 0 AND sample_1 % 3 > 0 THEN 'SAME_CODE_DISTINCT_GENOTYPE_KEEP_SEPARATE' WHEN sample_1 % 2 = 0 THEN 'SAME_CODE_EXACT_ALIAS_WITHIN_CURRENT_RULE'
      WHEN exact_all = comparable_all AND comparable_all > 0 THEN 'DIFFERENT_CODE_IDENTICAL_REVIEW_ONLY_KEEP_SEPARATE' WHEN comparable_all > 0 AND exact_all / comparable_all::DOUBLE >= 0.99 THEN 'DIFFERENT_CODE_NEAR_IDENTICAL_REVIEW_ONLY_KEEP_SEPARATE'
      ELSE 'DISTINCT_SAMPLES' END AS classification FROM mt""",
)
def _pairs(t):
    pairs = t.customer.select(F.col("c_custkey").alias("sample_1"), (F.col("c_custkey") + 1).alias("sample_2")).join(t.customer.select(F.col("c_custkey").alias("sample_2")), "sample_2")
    calls = t.calls().select("sample", F.col("variant").alias("locus"), F.when(F.col("dosage") == 1, "Het_ALT").otherwise("Hom_ALT").alias("status"))
    last = F.right(F.col("p_brand"), F.lit(1))
    classes = t.part.select(F.col("p_brand").alias("locus"), F.when(last.isin("1", "2", "3"), "common").when(last.isin("4", "5", "6"), "rare").otherwise("mixed").alias("frequency_class")).distinct()
    out = similarity.pair_concordance(pairs, calls, classes)
    flagged = out.withColumn("_code", F.col("sample_1") % 2 == 0).withColumn("_digest", F.col("sample_1") % 3 == 0)
    return rounded(similarity.classify_pairs(flagged, "_code", "_digest").drop("_code", "_digest"))
