"""Screens of logistic models per exposure, families of genotype tests, and sample pairs found by signature."""

from pyspark.sql import functions as F

from carrierlake.operators import compare, contingency, screens, similarity
from carrierlake.plans.association import ODDS_SQL, cells_sql
from carrierlake.plans.registry import ORACLES, bh_sql, effect_sql, fisher_sql, logit_sql, normal_sql, query, rounded, with_sql
from carrierlake.session import cut_lineage

# --- logistic screens -----------------------------------------------------------------------------

PEOPLE = """pe AS (SELECT s.sample, (tissue = 'Tumour')::INT AS cancer, (c_acctbal > 5000)::INT AS rich, CASE WHEN s.sample % 7 > 0 THEN c_nationkey END AS age,
    CASE WHEN s.sample % 5 > 0 THEN s.sample % 30 END AS bmi FROM samples s JOIN customer ON c_custkey = s.sample),
  dv AS (SELECT v.variant, pe.*, coalesce(dosage, 0) AS dose FROM pe CROSS JOIN (SELECT DISTINCT variant FROM calls) v LEFT JOIN calls c ON c.sample = pe.sample AND c.variant = v.variant)"""
CODES = {screens.CARRIER: "(dose > 0)::INT", screens.HET: "CASE WHEN dose < 2 THEN dose END", screens.HOM: "CASE WHEN dose <> 1 THEN dose / 2 END", screens.DOSE: "dose"}
SCALES = {"age": "(age - 12) / 7.0", "bmi": "(bmi - 15) / 9.0"}


def people(t):
    joined = t.samples().join(t.customer.select(F.col("c_custkey").alias("sample"), "c_acctbal", "c_nationkey"), "sample")
    return joined.select(
        "sample", (F.col("tissue") == "Tumour").cast("int").alias("cancer"), (F.col("c_acctbal") > 5000).cast("int").alias("rich"),
        F.when(F.col("sample") % 7 > 0, F.col("c_nationkey")).alias("age"), F.when(F.col("sample") % 5 > 0, F.col("sample") % 30).alias("bmi"),
    )


def screen_sql(models: dict, outcomes: dict[str, str], var: bool) -> str:
    """Dense version: every sample under every variant, one recursive fit per model over outcome and variant."""
    rows = " UNION ALL ".join(f"SELECT variant, '{name}' AS var, {column} AS y, age, bmi, dose FROM dv" for name, column in outcomes.items())
    ctes, parts = [f"al AS ({rows})"], []
    for name, (codes, own) in models.items():
        features = ["1.0", *[SCALES[c] for c in own], f"({CODES[codes]})::DOUBLE"]
        p, given = len(features), "".join(f" AND {c} IS NOT NULL" for c in own)
        ctes.append(f"s_{name} AS (SELECT variant, var, {', '.join(f'{f} AS f{i}' for i, f in enumerate(features))}, count(*) AS n, sum(y) AS e FROM al WHERE {CODES[codes]} IS NOT NULL{given} GROUP BY ALL)")
        ctes.append(
            f"g_{name} AS (SELECT variant, var, sum(n)::BIGINT AS n, sum(e)::BIGINT AS events, (sum(n) FILTER (f{p - 1} > 0))::BIGINT AS carriers FROM s_{name} GROUP BY 1, 2 "
            f"HAVING sum(n) >= 6 AND sum(e) >= 1 AND sum(n) - sum(e) >= 1 AND sum(n) FILTER (f{p - 1} > 0) >= 1 AND sum(n) FILTER (f{p - 1} = 0) >= 1)"
        )
        ctes.append(f"k_{name} AS (SELECT s.* FROM s_{name} s SEMI JOIN g_{name} USING (variant, var))")
        ctes.append(logit_sql(f"fit_{name}", f"k_{name}", "variant, var", p))
        parts.append(f"SELECT var, variant, '{name}' AS model, carriers, n, events, b{p - 1} AS b, v FROM fit_{name} JOIN g_{name} USING (variant, var) WHERE pass = 15")
    ctes.append(f"ft AS MATERIALIZED (SELECT *, {effect_sql('odds_ratio')}, {normal_sql('b / sqrt(v)')} AS p_raw FROM ({' UNION ALL '.join(parts)}) WHERE abs(b) < 10)")
    ctes.append(f"ad AS ({bh_sql('ft', 'p_raw', 'var, model', 'q')})")
    columns = ("var, " if var else "") + "variant, model, carriers, n, events, beta, se, round(exp(b), 9) AS odds_ratio, ci_low, ci_high, clipped, converged, p_value, round(q, 4) AS fdr"
    return with_sql("samples purchases calls", "").rstrip().replace("WITH", "WITH RECURSIVE", 1) + f", {PEOPLE}, " + ", ".join(ctes) + f" SELECT {columns} FROM ad"


def settled(df):
    # odds ratios of plain models are fractions of small numbers, which lie on ties of few digits
    digits = {c: 9 if c == "odds_ratio" else 4 for c, kind in df.dtypes if kind == "double"}
    return df.where("converged and not clipped").select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in df.columns])


@query("risk_screen", screen_sql(screens.risk_models(), {"cancer": "cancer"}, False))
def _risk(t):
    """Six models per variant."""
    return settled(screens.carrier_screen(t.calls(), people(t), "variant", [], "cancer", screens.risk_models()))


@query("clinical_adjusted", screen_sql(screens.clinical_models(), {"rich": "rich", "cancer": "cancer"}, True))
def _clinical(t):
    """Binary outcomes of carriers, alone and under each covariate set."""
    outcomes = people(t).unpivot(["sample", "age", "bmi"], ["rich", "cancer"], "var", "y")
    return settled(screens.carrier_screen(t.calls(), outcomes, "variant", ["var"], "y", screens.clinical_models()))


# --- families of genotype tests ---------------------------------------------------------------------

TESTS = ORACLES["genotype_test"].rsplit("SELECT comparison, variant, classes AS classes_observed", 1)[0].rstrip()
FAMILY = ("primary", "distribution", "trend", "het", "hom")


@query(
    "genotype_families",
    TESTS + """, fm AS MATERIALIZED (SELECT comparison, variant, coalesce(dist_p, trend_p) AS primary_p, CASE WHEN dist_p IS NOT NULL THEN 'distribution' WHEN trend_p IS NOT NULL THEN 'trend' END AS primary_source,
      dist_p AS distribution_p, trend_p, het_p, hom_p FROM final), """ + ", ".join(f"q_{f} AS ({bh_sql('fm', f'{f}_p', 'comparison', 'q')})" for f in FAMILY)
    + " SELECT fm.comparison, fm.variant, fm.primary_source, round(fm.primary_p, 5) AS primary_p, " + ", ".join(f"round(q_{f}.q, 5) AS {f}_fdr" for f in FAMILY)
    + " FROM fm " + " ".join(f"LEFT JOIN q_{f} ON q_{f}.comparison = fm.comparison AND q_{f}.variant = fm.variant" for f in FAMILY),
)
def _families(t):
    counts = compare.genotype_counts(t.calls(), t.samples())
    names = ("wt", "het", "hom")
    tests = contingency.genotype_test(counts, [f"case_{x}" for x in names], [f"control_{x}" for x in names])
    out = contingency.genotype_families(tests, ["comparison"])
    return rounded(out.select("comparison", "variant", "primary_source", "primary_p", *[f"{f}_fdr" for f in FAMILY]), 5)


def contrast_sql(alt: str) -> str:
    cells = (f"case_{alt}", "case_wt", f"control_{alt}", "control_wt")
    return f"""SELECT comparison, variant, '{alt}' AS contrast, CASE WHEN right(variant, 1) <> '5' THEN left(variant, 7) ELSE 'Singleton::' || variant END AS block, {fisher_sql(*cells)} AS p_value,
      {cells_sql(ODDS_SQL, *cells)} AS odds FROM geno WHERE case_{alt} + control_{alt} > 0 AND case_wt + control_wt > 0"""


@query(
    "contrast_classes",
    with_sql("samples purchases calls arms counts", "").rstrip() + f""", x AS MATERIALIZED ({contrast_sql('het')} UNION ALL {contrast_sql('hom')}),
      b1 AS ({bh_sql('x', 'p_value', 'contrast, comparison, block', 'block_fdr', '* EXCLUDE (q_raw)')}), b2 AS ({bh_sql('b1', 'p_value', 'contrast, comparison', 'group_fdr')})
    SELECT comparison, variant, contrast, block, round(p_value, 5) AS p_value, round(odds, 5) AS odds_ratio, round(block_fdr, 5) AS block_fdr, round(group_fdr, 5) AS group_fdr,
      count(*) OVER (PARTITION BY contrast, comparison, block) AS block_tests FROM b2""",
)
def _contrast_classes(t):
    """Het and Hom against wild type, corrected inside linkage blocks and over each comparison; variants that end in 5 have no block."""
    counts = compare.genotype_counts(t.calls(), t.samples())
    placed = counts.withColumn("block", F.when(~F.col("variant").endswith("5"), F.substring("variant", 1, 7)))
    out = [compare.contrast_from_counts(placed, alt, ["comparison"], "block") for alt in ("het", "hom")]
    columns = ["comparison", "variant", "contrast", "block", "p_value", "odds_ratio", "block_fdr", "group_fdr", "block_tests"]
    return rounded(out[0].select(*columns).unionByName(out[1].select(*columns)), 5)


# --- sample pairs -----------------------------------------------------------------------------------

LOCI = """ca AS (SELECT o_custkey AS sample, p_brand || '/' || p_size % 4 AS locus, CASE WHEN count(DISTINCT l_orderkey) > 1 THEN 'Hom_ALT' ELSE 'Het_ALT' END AS call FROM purchases GROUP BY 1, 2),
  ed AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY locus) AS place FROM ca),
  tk AS (SELECT sample, locus, call FROM ca UNION ALL SELECT sample + 10000000, locus, call FROM ed WHERE sample % 10 = 0 AND place > 1 UNION ALL SELECT sample + 20000000, locus, call FROM ed WHERE sample % 10 = 3
    UNION ALL SELECT sample + 30000000, locus, CASE WHEN place > 1 THEN call WHEN call = 'Het_ALT' THEN 'Hom_ALT' ELSE 'Het_ALT' END FROM ed WHERE sample % 10 = 5),
  dg AS (SELECT sample, string_agg(locus || call, ',' ORDER BY locus) AS dig, count(*) AS n FROM tk GROUP BY 1), rp AS (SELECT min(sample) AS sample, any_value(n) AS n, count(*) AS copies FROM dg GROUP BY dig),
  rt AS (SELECT tk.*, CASE WHEN right(locus, 1) IN ('0', '1') THEN 'common' WHEN right(locus, 1) = '2' THEN 'rare' ELSE 'mixed' END AS cls FROM tk SEMI JOIN rp USING (sample)),
  sh AS (SELECT a.sample AS sample_1, b.sample AS sample_2, count(*) AS shared FROM rt a JOIN rt b ON a.locus = b.locus AND a.call = b.call AND a.sample < b.sample GROUP BY 1, 2),
  cl AS (SELECT sample_1, sample_2, x.copies AS copies_1, y.copies AS copies_2, shared / (x.n + y.n - shared)::DOUBLE AS jaccard FROM sh JOIN rp x ON x.sample = sample_1 JOIN rp y ON y.sample = sample_2
    WHERE shared / (x.n + y.n - shared)::DOUBLE >= 0.9),
  lf AS (SELECT cl.*, locus, call, cls FROM cl JOIN rt ON sample = sample_1), rg AS (SELECT sample_1, sample_2, locus, call, cls FROM cl JOIN rt ON sample = sample_2),
  jn AS (SELECT sample_1, sample_2, lf.call AS s1, rg.call AS s2, coalesce(lf.cls, rg.cls) AS cls FROM lf FULL JOIN rg USING (sample_1, sample_2, locus))"""


def planted_calls(t):
    """Calls at 100 loci, with replicates of three kinds: one locus missing, exact, one genotype changed."""
    from pyspark.sql import Window

    call = F.when(F.min("l_orderkey") == F.max("l_orderkey"), "Het_ALT").otherwise("Hom_ALT").alias("call")
    # Read five times by each use below: written once.
    own = cut_lineage(t.purchases().groupBy("sample", F.concat("p_brand", F.lit("/"), (F.col("p_size") % 4).cast("string")).alias("locus")).agg(call))
    edited = own.withColumn("place", F.row_number().over(Window.partitionBy("sample").orderBy("locus")))
    kind = F.col("sample") % 10
    shift = lambda n, rows: rows.select((F.col("sample") + n).alias("sample"), "locus", "call")
    other = F.when(F.col("place") > 1, F.col("call")).when(F.col("call") == "Het_ALT", "Hom_ALT").otherwise("Het_ALT")
    missing, exact = shift(10_000_000, edited.where((kind == 0) & (F.col("place") > 1))), shift(20_000_000, edited.where(kind == 3))
    return own.unionByName(missing).unionByName(exact).unionByName(shift(30_000_000, edited.where(kind == 5).withColumn("call", other)))


@query(
    "near_identical",
    with_sql("purchases", "").rstrip() + f""", {LOCI}, mt AS (SELECT sample_1, sample_2, """ + ", ".join(
        f"count(*) FILTER (s1 IS NOT NULL AND s2 IS NOT NULL{c}) AS comparable_{n}, count(*) FILTER (s1 = s2{c}) AS exact_{n}" for n, c in (("all", ""), ("common", " AND cls = 'common'"), ("rare", " AND cls = 'rare'"))
    ) + """ FROM jn GROUP BY 1, 2)
    SELECT sample_1, sample_2, copies_1, copies_2, round(jaccard, 6) AS jaccard, comparable_all, exact_all, comparable_common, exact_common, comparable_rare, exact_rare,
      round(exact_all / comparable_all::DOUBLE, 6) AS concordance_all FROM cl JOIN mt USING (sample_1, sample_2)""",
)
def _near_identical(t):
    calls = planted_calls(t)
    last = F.right(F.col("locus"), F.lit(1))
    classes = calls.select("locus", F.when(last.isin("0", "1"), "common").when(last == "2", "rare").otherwise("mixed").alias("frequency_class")).distinct()
    out = similarity.near_identical(calls, classes)
    counts = [f"{x}_{n}" for n in ("all", "common", "rare") for x in ("comparable", "exact")]
    return rounded(out.select("sample_1", "sample_2", "copies_1", "copies_2", "jaccard", *counts, "concordance_all"))
