"""Call catalogues, summaries, annotation collapse and landscape tables over order lines as calls."""

from pyspark.sql import functions as F

from carrierlake.functions import genotype
from carrierlake.operators import compare, fdr, variants
from carrierlake.plans.association import SCREEN_CTES, SCREEN_SQL
from carrierlake.plans.fields import CALL_TEXT, CLASS_SQL, TERM_TABLE, TERMS, call_text
from carrierlake.plans.registry import bh_sql, query, rounded, with_sql
from carrierlake.session import spread

CALLS = with_sql("samples", "").rstrip() + f""", {CALL_TEXT}, called AS (SELECT * FROM calltext JOIN samples USING (sample))"""


def called(t):
    return call_text(t).join(t.samples(), "sample")


@query(
    "union_catalogue_variants",
    CALLS
    + """, d AS (SELECT chrom, pos, ref, alt, sample, row_number() OVER (PARTITION BY chrom, pos, ref, alt ORDER BY sample) AS rn
      FROM (SELECT DISTINCT chrom, pos, ref, alt, sample FROM called)),
      e AS (SELECT chrom, pos, ref, alt, string_agg(sample::VARCHAR, '; ' ORDER BY sample::VARCHAR) AS example_samples FROM d WHERE rn <= 6 GROUP BY 1, 2, 3, 4)
    SELECT chrom, pos, ref, alt, count(DISTINCT sample) AS n_samples, any_value(example_samples) AS example_samples,
      string_agg(DISTINCT cohort, '; ' ORDER BY cohort) AS cohorts, string_agg(DISTINCT tissue, '; ' ORDER BY tissue) AS tissues
    FROM called JOIN e USING (chrom, pos, ref, alt) GROUP BY 1, 2, 3, 4""",
)
def _catalogue(t):
    return variants.union_catalogue(called(t))[1]


@query(
    "union_catalogue_loci",
    CALLS
    + """, d AS (SELECT chrom, pos, ref, sample, row_number() OVER (PARTITION BY chrom, pos, ref ORDER BY sample) AS rn
      FROM (SELECT DISTINCT chrom, pos, ref, sample FROM called)),
      e AS (SELECT chrom, pos, ref, string_agg(sample::VARCHAR, '; ' ORDER BY sample::VARCHAR) AS example_samples FROM d WHERE rn <= 6 GROUP BY 1, 2, 3)
    SELECT chrom, pos, ref, count(DISTINCT sample) AS n_samples_any, string_agg(DISTINCT alt, ',' ORDER BY alt) AS alt_list, count(DISTINCT alt) AS n_alt,
      any_value(example_samples) AS example_samples, count(DISTINCT alt) > 1 AS multi_allelic FROM called JOIN e USING (chrom, pos, ref) GROUP BY 1, 2, 3""",
)
def _loci(t):
    return variants.union_catalogue(called(t))[0]


LONG = CALLS + f""", long AS (SELECT *, CASE WHEN raw_class = 'No_call' THEN 'No_call' WHEN dp < 50 THEN 'Below_DP_threshold' ELSE raw_class END AS status
    FROM (SELECT *, {CLASS_SQL} AS raw_class FROM called))"""
STATUS_SQL = ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s.lower()}" for s in variants.STATUSES)


def long_calls(t):
    return with_status(called(t))


def with_status(calls):
    raw = genotype.classify_genotype(F.col("gt"), F.col("dp"))
    return calls.withColumn("status", genotype.threshold_status(raw, F.col("dp")))


@query(
    "locus_summary",
    LONG
    + f""", d AS (SELECT chrom, pos, sample, row_number() OVER (PARTITION BY chrom, pos ORDER BY sample) AS rn
      FROM (SELECT DISTINCT chrom, pos, sample FROM long WHERE status IN ('Het_ALT', 'Hom_ALT', 'Other_ALT_model'))),
      e AS (SELECT chrom, pos, string_agg(sample::VARCHAR, '; ' ORDER BY sample::VARCHAR) AS carrier_samples FROM d WHERE rn <= 8 GROUP BY 1, 2)
    SELECT chrom, pos, count(DISTINCT sample) AS n_samples, {STATUS_SQL}, round(avg(dp), 2) AS mean_dp, median(dp)::DOUBLE AS median_dp,
      coalesce(any_value(carrier_samples), '') AS carrier_samples FROM long LEFT JOIN e USING (chrom, pos) GROUP BY 1, 2""",
)
def _locus_summary(t):
    return variants.locus_summary(long_calls(t), ["chrom", "pos"])


@query(
    "carriers_long",
    LONG + " SELECT DISTINCT chrom, pos, sample, status FROM long WHERE status IN ('Het_ALT', 'Hom_ALT', 'Other_ALT_model')",
)
def _carriers_long(t):
    return variants.carriers_long(long_calls(t), ["chrom", "pos"])


@query(
    "sample_summary",
    LONG + f""" SELECT sample, cohort, tissue, count(DISTINCT p_partkey) AS n_loci, {STATUS_SQL}, round(avg(dp), 2) AS mean_dp, median(dp)::DOUBLE AS median_dp
      FROM long GROUP BY 1, 2, 3""",
)
def _sample_summary(t):
    """Calls and samples are dealt by sample once, for the join and the aggregate."""
    calls, samples = spread((call_text(t), ["sample"]), (t.samples(), ["sample"]))
    return variants.sample_summary(with_status(calls.join(samples, "sample")), "p_partkey", ["sample", "cohort", "tissue"])


@query("cell_totals", LONG + " SELECT status, count(*) AS cells FROM long GROUP BY 1")
def _cells(t):
    return variants.cell_totals(long_calls(t))


GRID = with_sql("purchases calls", "").rstrip()


@query(
    "complete_grid_loci",
    GRID + """ SELECT p_brand AS variant, coalesce(n, 0) AS called, (SELECT count(*) FROM customer) - coalesce(n, 0) AS missing
      FROM (SELECT DISTINCT p_brand FROM part) LEFT JOIN (SELECT variant AS p_brand, count(*) AS n FROM calls GROUP BY 1) USING (p_brand)""",
)
def _grid_loci(t):
    loci = t.part.select(F.col("p_brand").alias("variant"))
    return variants.grid_completion(t.samples(), loci, t.calls(), "sample", "variant")["locus"]


@query(
    "complete_grid_samples",
    GRID + """ SELECT c_custkey AS sample, coalesce(n, 0) AS called, (SELECT count(DISTINCT p_brand) FROM part) - coalesce(n, 0) AS missing
      FROM customer LEFT JOIN (SELECT sample AS c_custkey, count(*) AS n FROM calls GROUP BY 1) USING (c_custkey)""",
)
def _grid_samples(t):
    loci = t.part.select(F.col("p_brand").alias("variant"))
    return variants.grid_completion(t.samples(), loci, t.calls(), "sample", "variant")["sample"]


# Transcript rows: one per order line, the line's supplier decides the flags.
TRANSCRIPTS = CALLS + f""", {TERM_TABLE}, tx AS (SELECT called.*, l_suppkey, l_linenumber, l_tax,
      CASE WHEN l_suppkey % 3 = 0 THEN 'YES' ELSE '' END AS pick, CASE WHEN l_suppkey % 2 = 0 THEN 'YES' ELSE '-' END AS canonical,
      CASE WHEN l_suppkey % 5 = 0 THEN 'NM_1' ELSE '.' END AS mane, a.term || '&' || b.term AS consequence, least(a.rank, b.rank) AS term_rank,
      CASE WHEN l_linenumber = 1 THEN '' ELSE ['HIGH', 'MODERATE', 'LOW', 'MODIFIER'][l_suppkey % 4 + 1] END AS impact,
      'ENST' || l_suppkey AS feature, l_orderkey * 1000000 + l_suppkey * 10000 + l_quantity::INT * 100 + l_linenumber AS ordinal
    FROM (SELECT o_custkey AS sample, p_partkey, l_orderkey, l_suppkey, l_linenumber, l_quantity, l_tax, p_size, (l_quantity * 2)::INT AS dp,
        l_discount * 10 AS af FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) called
      JOIN terms a ON a.rank = p_size % 27 JOIN terms b ON b.rank = l_suppkey % 27),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY pick <> 'YES', canonical <> 'YES', mane = '.',
      CASE impact WHEN 'HIGH' THEN 0 WHEN 'MODERATE' THEN 1 WHEN 'LOW' THEN 2 WHEN 'MODIFIER' THEN 3 ELSE 99 END,
      CASE WHEN term_rank = 26 THEN 999 ELSE term_rank END, ordinal) AS rn FROM tx),
    rep AS (SELECT *, CASE WHEN pick = 'YES' THEN 'picked_transcript' WHEN canonical = 'YES' THEN 'canonical_transcript'
      WHEN mane <> '.' THEN 'mane_transcript' ELSE 'worst_available_transcript' END AS basis FROM ranked WHERE rn = 1)"""


def transcripts(t):
    table = F.array(*[F.lit(x) for x in TERMS])
    k = F.col("l_suppkey")
    impact = F.get(F.array(*[F.lit(x) for x in ("HIGH", "MODERATE", "LOW", "MODIFIER")]), (k % 4).cast("int"))
    return t.purchases().join(t.samples(), "sample").select(
        "sample", "cohort", "p_partkey", (F.col("l_quantity") * 2).cast("int").alias("dp"), (F.col("l_discount") * 10).alias("af"), "l_tax",
        F.when(k % 3 == 0, "YES").otherwise("").alias("PICK"), F.when(k % 2 == 0, "YES").otherwise("-").alias("CANONICAL"),
        F.when(k % 5 == 0, "NM_1").otherwise(".").alias("MANE_SELECT"),
        F.concat_ws("&", F.get(table, F.col("p_size") % 27), F.get(table, (k % 27).cast("int"))).alias("Consequence"),
        F.when(F.col("l_linenumber") == 1, "").otherwise(impact).alias("IMPACT"), F.concat(F.lit("ENST"), k).alias("Feature"),
        (F.col("l_orderkey") * 1000000 + k * 10000 + F.col("l_quantity").cast("int") * 100 + F.col("l_linenumber")).alias("ordinal"),
    )


@query(
    "representative_row",
    TRANSCRIPTS + " SELECT p_partkey, consequence AS Consequence, impact AS IMPACT, feature AS Feature, basis FROM rep",
)
def _representative(t):
    return variants.representative_row(transcripts(t), ["p_partkey"], ["Consequence", "IMPACT", "Feature"], "ordinal")


@query(
    "collapse_annotations",
    TRANSCRIPTS
    + """, per AS (SELECT p_partkey, sample, avg(dp) AS dp, avg(af) AS af FROM tx GROUP BY 1, 2),
      m AS (SELECT p_partkey, count(sample) AS n_samples, avg(dp) AS mean_dp, avg(af) AS mean_af FROM per GROUP BY 1),
      c AS (SELECT p_partkey, count(*) AS n_transcript_rows, max(l_tax) AS max_frequency, string_agg(DISTINCT cohort, '; ' ORDER BY cohort) AS cohorts,
        string_agg(DISTINCT consequence, '; ' ORDER BY consequence) AS consequences FROM tx JOIN samples USING (sample) GROUP BY 1)
    SELECT p_partkey, n_samples, round(mean_dp, 9) AS mean_dp, round(mean_af, 9) AS mean_af, n_transcript_rows, max_frequency, max_frequency >= 0.01 AS common,
      cohorts, consequences, term AS worst_term, class AS functional_class, CASE WHEN rep.impact = '' THEN tier ELSE rep.impact END AS impact,
      rep.feature AS transcript, basis FROM m JOIN c USING (p_partkey) JOIN rep USING (p_partkey) JOIN terms ON terms.rank = rep.term_rank""",
)
def _collapse(t):
    return rounded(variants.collapse_annotations(transcripts(t), "p_partkey", "ordinal", "l_tax"), 9)


@query(
    "titv",
    CALLS
    + """, d AS (SELECT DISTINCT cohort, sample, chrom, pos, ref, alt FROM called),
      k AS (SELECT cohort, count(*) FILTER (ref || alt IN ('AG', 'GA', 'CT', 'TC')) AS ti,
        count(*) FILTER (ref <> alt AND ref || alt NOT IN ('AG', 'GA', 'CT', 'TC')) AS tv, count(*) FILTER (ref = alt) AS skipped FROM d GROUP BY 1)
    SELECT cohort, ti, tv, skipped, round(ti / tv::DOUBLE, 6) AS ratio, CASE WHEN tv = 0 THEN 'FAIL_NO_TV' WHEN ti / tv::DOUBLE < 1.5 THEN 'FAIL'
      WHEN ti / tv::DOUBLE > 3 THEN 'WARN' WHEN ti / tv::DOUBLE BETWEEN 2.0 AND 2.1 THEN 'OPTIMAL' ELSE 'ACCEPTABLE' END AS status FROM k""",
)
def _titv(t):
    return rounded(variants.titv(called(t), ["chrom", "pos", "ref", "alt", "sample"], ["cohort"]))


@query(
    "allelic_balance",
    CALLS
    + """, q AS (SELECT cohort, gt IN ('0/1', '1/2') AS het, CASE WHEN gt NOT IN ('0/1', '1/2') OR af IS NULL THEN 'NO_DATA' WHEN af < 0.25 OR af > 0.75 THEN 'POOR'
        WHEN af BETWEEN 0.4 AND 0.6 THEN 'OPTIMAL' ELSE 'ACCEPTABLE' END AS q FROM called),
      k AS (SELECT cohort, count(*) FILTER (het) AS n_het, count(*) FILTER (q = 'OPTIMAL') AS n_optimal, count(*) FILTER (q = 'ACCEPTABLE') AS n_acceptable,
        count(*) FILTER (q = 'POOR') AS n_poor, count(*) FILTER (q = 'NO_DATA') AS n_no_data FROM q GROUP BY 1)
    SELECT *, round(n_poor * 100.0 / n_het::DOUBLE, 6) AS pct_flagged, n_poor * 100.0 / n_het::DOUBLE > 20 AS warn FROM k""",
)
def _balance(t):
    quality = genotype.allelic_balance(F.col("gt"), F.col("af"))
    return rounded(variants.balance_summary(called(t), ["cohort"], quality))


@query(
    "batch_cv",
    CALLS
    + """, per AS (SELECT cohort, tissue, sample, count(*) AS n FROM called GROUP BY 1, 2, 3),
      k AS (SELECT cohort, tissue, count(*) AS n_samples, avg(n) AS mean, coalesce(stddev_samp(n), 0) AS sd, min(n) AS least, max(n) AS most, median(n) AS median FROM per GROUP BY 1, 2)
    SELECT cohort, tissue, n_samples, round(mean, 6) AS mean, round(sd, 6) AS sd, least, most, round(median, 6) AS median, round(sd * 100 / mean, 6) AS cv_pct,
      CASE WHEN sd * 100 / mean < 15 THEN 'EXCELLENT' WHEN sd * 100 / mean < 30 THEN 'ACCEPTABLE' WHEN sd * 100 / mean < 50 THEN 'HIGH VARIATION'
        ELSE 'VERY HIGH VAR' END AS band FROM k""",
)
def _batch(t):
    return rounded(variants.batch_cv(called(t), ["cohort", "tissue"]))


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(
    "crosstab",
    with_sql("purchases", "SELECT p_brand, " + ", ".join(f"count(*) FILTER (p_type = '{x}') AS \"{x}\"" for x in TYPES) + " FROM purchases GROUP BY 1"),
)
def _crosstab(t):
    return variants.crosstab(t.purchases(), "p_brand", "p_type", TYPES)


@query(
    "crosstab_unique",
    with_sql("purchases", "SELECT p_brand, " + ", ".join(f"count(DISTINCT p_partkey) FILTER (p_type = '{x}') AS \"{x}\"" for x in TYPES) + " FROM purchases GROUP BY 1"),
)
def _crosstab_unique(t):
    return variants.crosstab(t.purchases(), "p_brand", "p_type", TYPES, ["p_partkey"])


LANDSCAPE = with_sql("samples purchases calls", "").rstrip() + """, sz AS (SELECT cohort, tissue, count(*) AS n_callable FROM samples GROUP BY 1, 2),
    cnt AS (SELECT cohort, tissue, variant, any_value(n_callable) AS n_callable, any_value(n_callable) - count(*) AS n_wt, count(*) FILTER (dosage = 1) AS n_het,
      count(*) FILTER (dosage = 2) AS n_hom FROM calls JOIN samples USING (sample) JOIN sz USING (cohort, tissue) GROUP BY 1, 2, 3),
    ann AS (SELECT p_brand AS variant, max(p_size) AS top_size, avg(p_size) / 1000.0 AS af FROM part GROUP BY 1),
    land AS (SELECT cnt.*, n_wt * 100.0 / n_callable::DOUBLE AS wt_pct, n_het * 100.0 / n_callable::DOUBLE AS het_pct, n_hom * 100.0 / n_callable::DOUBLE AS hom_pct,
      (n_het + n_hom) * 100.0 / n_callable::DOUBLE AS carrier_pct, CASE WHEN af > 0.0255 THEN 'Established_SNP' ELSE 'Lower_Frequency_Mutation' END AS variant_class,
      top_size, af FROM cnt LEFT JOIN ann USING (variant))"""


def landscape(t):
    samples = t.samples()
    sizes = samples.groupBy("cohort", "tissue").agg(F.count(F.lit(1)).alias("n_callable"))
    counts = (
        t.calls().join(samples, "sample").groupBy("cohort", "tissue", "variant")
        .agg(F.count_if(F.col("dosage") == 1).alias("n_het"), F.count_if(F.col("dosage") == 2).alias("n_hom"))
        .join(sizes, ["cohort", "tissue"])
        .select("cohort", "tissue", "variant", "n_callable", (F.col("n_callable") - F.col("n_het") - F.col("n_hom")).alias("n_wt"), "n_het", "n_hom")
    )
    notes = t.part.groupBy(F.col("p_brand").alias("variant")).agg(F.max("p_size").alias("top_size"), (F.avg("p_size") / 1000.0).alias("af"))
    return variants.landscape_summary(counts, notes, F.col("af"), 0.0255)


LAND_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in ("wt_pct", "het_pct", "hom_pct", "carrier_pct", "af"))


@query("landscape_summary", LANDSCAPE + f" SELECT cohort, tissue, variant, n_callable, n_wt, n_het, n_hom, {LAND_ROUND}, variant_class, top_size FROM land")
def _landscape(t):
    return rounded(landscape(t))


@query(
    "genotype_points",
    LANDSCAPE
    + """ SELECT cohort, tissue, variant, 'WT' AS genotype, n_wt AS count, round(wt_pct, 6) AS pct FROM land
      UNION ALL SELECT cohort, tissue, variant, 'Het', n_het, round(het_pct, 6) FROM land UNION ALL SELECT cohort, tissue, variant, 'Hom', n_hom, round(hom_pct, 6) FROM land""",
)
def _points(t):
    return rounded(variants.genotype_points(landscape(t)))


@query(
    "label_ranking",
    LANDSCAPE + " SELECT variant, round(max(carrier_pct), 6) AS top_pct FROM land WHERE top_size >= 50 GROUP BY 1",
)
def _ranking(t):
    return rounded(variants.label_ranking(landscape(t), "variant", F.col("top_size") >= 50))


STATUS = with_sql(SCREEN_CTES, "").rstrip() + ", " + SCREEN_SQL + f""", adjusted AS ({bh_sql('tested', 'p_raw', 'comparison', 'q')}),
    sd AS (SELECT *, CASE WHEN case_carriers > 0 AND control_carriers > 0 THEN 'shared' WHEN case_carriers > 0 THEN 'tumour_only' ELSE 'normal_only' END AS variant_status,
      case_carriers * 100.0 / case_n::DOUBLE - control_carriers * 100.0 / control_n::DOUBLE AS gap FROM adjusted),
    dir AS (SELECT *, CASE WHEN gap < -1e-9 THEN 'Lower in tumour' WHEN gap > 1e-9 THEN 'Higher in tumour' ELSE 'Same frequency' END AS direction FROM sd)"""


def directed(t):
    tests = compare.case_vs_control(t.calls(), t.samples(), ["variant"], ["comparison"])
    return variants.status_direction(tests)


@query("status_direction", STATUS + " SELECT comparison, variant, variant_status, round(gap, 6) AS difference_pct, direction FROM dir")
def _direction(t):
    return rounded(directed(t).select("comparison", "variant", "variant_status", "difference_pct", "direction"))


@query(
    "status_summary",
    STATUS
    + """, b AS (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY p_raw, variant) AS rn FROM dir)
    SELECT comparison, count(*) FILTER (variant_status = 'tumour_only') AS tumour_only, count(*) FILTER (variant_status = 'normal_only') AS normal_only,
      count(*) FILTER (variant_status = 'shared') AS shared, count(*) FILTER (variant_status = 'shared' AND direction = 'Lower in tumour') AS shared_lower,
      count(*) FILTER (variant_status = 'shared' AND direction = 'Higher in tumour') AS shared_higher, count(*) FILTER (p_raw < 0.05) AS raw_hits,
      count(*) FILTER (q < 0.05) AS fdr_hits, max(CASE WHEN rn = 1 THEN variant END) AS best_key, round(max(CASE WHEN rn = 1 THEN p_raw END), 6) AS best_p,
      round(max(CASE WHEN rn = 1 THEN q END), 6) AS best_fdr, max(CASE WHEN rn = 1 THEN direction END) AS best_direction FROM b GROUP BY 1""",
)
def _status_summary(t):
    return rounded(variants.status_summary(directed(t), "comparison", "variant", "p_value", "fdr"))


@query(
    "qc_sensitivity",
    with_sql("samples", "").rstrip().replace("FROM customer", "FROM customer SEMI JOIN (SELECT o_custkey AS c_custkey FROM orders GROUP BY 1 HAVING count(*) >= 8) USING (c_custkey)")
    + ", " + with_sql("purchases calls arms counts", "")[5:].rstrip()
    + """ SELECT comparison, variant, case_callable::BIGINT AS case_callable, control_callable::BIGINT AS control_callable,
      round((case_het + case_hom) * 100.0 / case_callable::DOUBLE, 6) AS case_carrier_pct,
      round((control_het + control_hom) * 100.0 / control_callable::DOUBLE, 6) AS control_carrier_pct FROM geno""",
)
def _sensitivity(t):
    good = t.orders.groupBy(F.col("o_custkey").alias("sample")).agg(F.count(F.lit(1)).alias("n")).where("n >= 8").select("sample")
    kept = t.samples().join(good, "sample", "left_semi")
    out = compare.genotype_counts(t.calls(), kept)
    return rounded(out.select("comparison", "variant", "case_callable", "control_callable", "case_carrier_pct", "control_carrier_pct"))


def _direction_sql(d: str) -> str:
    return f"CASE WHEN {d} < -1e-9 THEN 'Lower in tumour' WHEN {d} > 1e-9 THEN 'Higher in tumour' WHEN {d} IS NOT NULL THEN 'Same frequency' ELSE 'Not estimable' END"


@query(
    "qc_sensitivity_change",
    with_sql("samples purchases calls arms", "").rstrip() + f""", hq AS (SELECT o_custkey AS sample FROM orders GROUP BY 1 HAVING count(*) >= 12),
      am AS (SELECT *, sample IN (SELECT sample FROM hq) AS high FROM arms),
      sz AS (SELECT comparison, {', '.join(f"count(*) FILTER (is_case = {v}{c}) AS {arm}_n{x}" for arm, v in (('case', 1), ('control', 0)) for x, c in (('', ''), ('_high', ' AND high')))} FROM am GROUP BY 1),
      ct AS (SELECT comparison, variant, {', '.join(f"count(*) FILTER (is_case = {v}{c}) AS {arm}_k{x}" for arm, v in (('case', 1), ('control', 0)) for x, c in (('', ''), ('_high', ' AND high')))}
        FROM am JOIN calls USING (sample) GROUP BY 1, 2),
      pc AS (SELECT comparison, variant, case_n, case_n_high, control_n, control_n_high, {', '.join(f"{arm}_k{x} * 100.0 / nullif({arm}_n{x}, 0)::DOUBLE AS {arm}_pct{x}" for x in ('', '_high') for arm in ('case', 'control'))}
        FROM sz LEFT JOIN ct USING (comparison) WHERE variant IS NOT NULL),
      df AS (SELECT *, case_pct - control_pct AS d, case_pct_high - control_pct_high AS dh FROM pc)
    SELECT comparison, variant, case_n, case_n_high, control_n, control_n_high, round(case_pct, 6) AS case_pct, round(control_pct, 6) AS control_pct, round(d, 6) AS difference_pct, {_direction_sql('d')} AS direction,
      round(case_pct_high, 6) AS case_pct_high, round(control_pct_high, 6) AS control_pct_high, round(dh, 6) AS difference_pct_high, {_direction_sql('dh')} AS direction_high,
      CASE WHEN d IS NOT NULL AND dh IS NOT NULL THEN {_direction_sql('d')} = {_direction_sql('dh')} END AS agrees FROM df""",
)
def _sensitivity_change(t):
    good = t.orders.groupBy(F.col("o_custkey").alias("sample")).agg(F.count(F.lit(1)).alias("n")).where("n >= 12").select("sample")
    return rounded(variants.qc_sensitivity(t.calls(), t.samples(), good))


@query(
    "locus_class",
    """WITH x AS (SELECT p_name, bool_and(p_retailprice > 1000) AS a, bool_or(p_retailprice > 1000) AS o FROM part GROUP BY 1)
    SELECT p_name, CASE WHEN a THEN 'common' WHEN NOT o THEN 'rare' ELSE 'mixed' END AS frequency_class FROM x""",
)
def _locus_class(t):
    return variants.locus_class(t.part, "p_name", "p_retailprice", 1000.0)


#: All loci of the table.
LOCI = [10 * i + j for i in range(1, 6) for j in range(1, 6)]


@query(
    "pivot_wide",
    with_sql("purchases calls", "SELECT sample, " + ", ".join(f"max(CASE WHEN variant = 'Brand#{b}' THEN dosage END) AS \"Brand#{b}\"" for b in LOCI) + " FROM calls GROUP BY 1"),
)
def _pivot_wide(t):
    return variants.pivot_wide(t.calls(), ["sample"], "variant", [f"Brand#{b}" for b in LOCI], "dosage")
