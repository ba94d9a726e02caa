"""Roll-ups over result tables built from line, order and part aggregates."""

from pyspark.sql import functions as F

from carrierlake.operators import evidence
from carrierlake.operators.compare import carrier_frequency, genotype_counts
from carrierlake.plans.registry import query, rounded, with_sql

RES = """ra AS (SELECT p_brand AS key, l_returnflag AS context, min(l_discount) + avg(l_tax) AS p, avg(l_tax) * 1.3 AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
  rb AS (SELECT p_brand AS key, l_linestatus AS context, avg(l_tax) AS p, avg(l_tax) * 1.26 AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
  res AS (SELECT *, 'a' AS source FROM ra UNION ALL SELECT *, 'b' FROM rb)"""
ALPHA = 0.04


def results(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    a = rows.groupBy(F.col("p_brand").alias("key"), F.col("l_returnflag").alias("context")).agg((F.min("l_discount") + F.avg("l_tax")).alias("p"), (F.avg("l_tax") * 1.3).alias("q"))
    b = rows.groupBy(F.col("p_brand").alias("key"), F.col("l_linestatus").alias("context")).agg(F.avg("l_tax").alias("p"), (F.avg("l_tax") * 1.26).alias("q"))
    return evidence.stack_results({"a": a, "b": b})


@query(
    "significant_overview",
    f"""WITH {RES} SELECT key, count(*) AS n_rows, count(DISTINCT source) AS n_sources, round(min(p), 6) AS best_p, round(min(q), 6) AS best_fdr, bool_or(q < {ALPHA}) AS any_fdr,
      string_agg(DISTINCT context, '; ' ORDER BY context) AS contexts FROM res WHERE p < {ALPHA} OR q < {ALPHA} GROUP BY 1""",
)
def _overview(t):
    return rounded(evidence.significant_overview(results(t), "key", "context", "p", "q", ALPHA))


@query(
    "signal_bridge",
    """SELECT c_mktsegment AS cohort, coalesce(g, 0) AS genetic_hits, coalesce(c, 0) AS clinical_hits FROM (SELECT c_mktsegment, count(*) AS g FROM customer WHERE c_acctbal < 0 GROUP BY 1)
      FULL JOIN (SELECT c_mktsegment, count(*) AS c FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1) USING (c_mktsegment)""",
)
def _bridge(t):
    people = t.customer.withColumnRenamed("c_mktsegment", "cohort")
    clinical = people.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("o_custkey") == F.col("c_custkey"))
    return evidence.signal_bridge(people.where("c_acctbal < 0"), clinical, ["cohort"])


@query(
    "priority_table",
    """WITH e AS (SELECT DISTINCT l_partkey AS key, CASE WHEN l_quantity >= 49 THEN 'primary' WHEN l_discount >= 0.1 THEN 'clinical' WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 'rna' WHEN l_linenumber = 7 THEN 'mapping' END AS s FROM lineitem)
    SELECT key, bool_or(s = 'primary') AS "primary", bool_or(s = 'clinical') AS clinical, bool_or(s = 'rna') AS rna, bool_or(s = 'mapping') AS mapping,
      bool_or(s = 'primary')::INT * 8 + bool_or(s = 'clinical')::INT * 4 + bool_or(s = 'rna')::INT * 2 + bool_or(s = 'mapping')::INT AS priority_rank FROM e WHERE s IS NOT NULL GROUP BY 1""",
)
def _priority(t):
    source = (
        F.when(F.col("l_quantity") >= 49, "primary").when(F.col("l_discount") >= 0.1, "clinical")
        .when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1), "rna").when(F.col("l_linenumber") == 7, "mapping")
    )
    rows = t.lineitem.select(F.col("l_partkey").alias("key"), source.alias("s")).where("s is not null")
    return evidence.priority_table(rows, "key", "s", {"primary": 8, "clinical": 4, "rna": 2, "mapping": 1})


@query(
    "evidence_score",
    """WITH f AS (SELECT p_partkey, p_size % 2 = 0 AS a, p_size % 3 = 0 AS c, p_size % 5 = 0 AS r, p_partkey % 4 = 0 AS h, p_partkey % 6 = 0 AS f, p_partkey % 7 = 0 AS w, p_size % 4 AS s, p_size % 3 AS e FROM part)
    SELECT p_partkey, (a::INT * 3 + c::INT * 2 + r::INT * 2 + h::INT * 2 + s + f::INT - w::INT * 2)::INT AS score, CASE WHEN (r AND (s > 0 OR f)) OR (a AND s > 0) THEN 'Supports observed project association'
      WHEN (a OR c OR h) AND (s > 0 OR f OR e > 0) THEN 'Novel but biologically plausible' WHEN a OR c OR h THEN 'Weak / indirect / inconsistent annotation' ELSE 'Without a confirmed project association' END AS label FROM f""",
)
def _score(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    flags = t.part.select(
        "p_partkey", (s % 2 == 0).alias("primary"), (s % 3 == 0).alias("clinical"), (s % 5 == 0).alias("rna"), (k % 4 == 0).alias("key_haplotype"), (k % 6 == 0).alias("functional"),
        (k % 7 == 0).alias("caution"), (s % 4).alias("strong"), (s % 3).alias("exact"),
    )
    return evidence.evidence_score(flags).select("p_partkey", "score", "label")


LINKS = """hp AS (SELECT l_returnflag AS comparison, p_type AS region, p_name AS hap_id, avg(l_quantity) / 25.5 AS o FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
  me AS (SELECT DISTINCT p_type AS region, p_name AS hap_id, p_brand AS snp, CASE WHEN p_size % 2 = 0 THEN 'ALT' ELSE 'REF' END AS allele FROM part),
  sn AS (SELECT l_returnflag AS comparison, p_brand AS snp, avg(l_quantity) / 25.5 AS o FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
  li AS (SELECT comparison, snp, region, hap_id, allele, CASE WHEN sn.o > 1 THEN 'Tumour-enriched' WHEN sn.o < 1 THEN 'Healthy-enriched' ELSE 'Balanced' END AS observed,
      CASE WHEN hp.o = 1 THEN 'Balanced' WHEN (hp.o > 1) = (allele = 'ALT') THEN 'Tumour-enriched' ELSE 'Healthy-enriched' END AS expected FROM hp JOIN me USING (region, hap_id) JOIN sn USING (comparison, snp)),
  lk AS (SELECT *, CASE WHEN expected = 'Balanced' OR observed = 'Balanced' THEN 'Ambiguous' WHEN expected = observed THEN 'Consistent' ELSE 'Discordant' END AS consistency FROM li)"""


def links(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    ratio = (F.avg("l_quantity") / 25.5).alias("odds_ratio")
    haps = rows.groupBy(F.col("l_returnflag").alias("comparison"), F.col("p_type").alias("region"), F.col("p_name").alias("hap_id")).agg(ratio)
    members = t.part.select(
        F.col("p_type").alias("region"), F.col("p_name").alias("hap_id"), F.col("p_brand").alias("snp"), F.when(F.col("p_size") % 2 == 0, "ALT").otherwise("REF").alias("allele")
    ).distinct()
    snps = rows.groupBy(F.col("l_returnflag").alias("comparison"), F.col("p_brand").alias("snp")).agg(ratio)
    return evidence.haplotype_snp_links(haps, members, snps), snps


@query("haplotype_snp_links", f"WITH {LINKS} SELECT comparison, snp, region, hap_id, allele, expected, observed, consistency FROM lk")
def _links(t):
    return links(t)[0].drop("hap_effect")


@query(
    "link_rollup",
    f"""WITH {LINKS}, c AS (SELECT comparison, snp, count(*) AS n_links, count(DISTINCT region) AS n_regions, count(*) FILTER (consistency = 'Consistent') AS n_consistent,
        count(*) FILTER (consistency = 'Discordant') AS n_discordant, count(*) FILTER (consistency = 'Ambiguous') AS n_ambiguous FROM lk GROUP BY 1, 2)
    SELECT *, CASE WHEN n_links = 0 THEN 'No haplotype link' WHEN n_discordant = 0 THEN 'Linked, no conflict' ELSE 'Linked with conflict' END AS mapping_status FROM c""",
)
def _rollup(t):
    return evidence.link_rollup(*links(t))


GENO = with_sql("samples purchases calls arms counts", "").rstrip()
PCT = {f"{arm}_{g}": f"({arm}_{g} * 100.0 / {arm}_callable::DOUBLE)" for arm in ("case", "control") for g in ("het", "hom")}
HET_GAP, HOM_GAP = f"({PCT['case_het']} - {PCT['control_het']})", f"({PCT['case_hom']} - {PCT['control_hom']})"


@query(
    "dosage_shift",
    GENO + f""" SELECT comparison, variant, CASE WHEN abs({HET_GAP}) >= 5 AND abs({HOM_GAP}) >= 5 THEN 'Het and Hom shift' WHEN {HET_GAP} >= 5 THEN 'Het higher in case' WHEN {HET_GAP} <= -5 THEN 'Het lower in case'
      WHEN {HOM_GAP} >= 5 THEN 'Hom higher in case' WHEN {HOM_GAP} <= -5 THEN 'Hom lower in case' ELSE 'No clear shift' END AS shift FROM geno""",
)
def _shift(t):
    counts = genotype_counts(t.calls(), t.samples())
    pct = lambda arm, g: F.col(f"{arm}_{g}") * 100.0 / F.col(f"{arm}_callable")
    return counts.select("comparison", "variant", evidence.dosage_shift(pct("case", "het"), pct("control", "het"), pct("case", "hom"), pct("control", "hom")).alias("shift"))


@query(
    "cohort_consistency",
    """WITH q AS (SELECT p_name AS key, l_returnflag AS c, min(l_tax) + avg(l_discount) AS f FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
      w AS (SELECT key, min(f) FILTER (c = 'A') AS "A", min(f) FILTER (c = 'N') AS "N", min(f) FILTER (c = 'R') AS "R" FROM q GROUP BY 1),
      h AS (SELECT *, coalesce("A" <= 0.05, false) AS ha, coalesce("N" <= 0.05, false) AS hn, coalesce("R" <= 0.05, false) AS hr FROM w)
    SELECT key, round("A", 6) AS "A", round("N", 6) AS "N", round("R", 6) AS "R", ha::INT + hn::INT AS n_cohorts, CASE WHEN ha AND hn THEN 'Shared across cohorts' WHEN ha THEN 'A-driven' WHEN hn THEN 'N-driven'
      WHEN hr THEN 'Global only' ELSE 'Not significant' END AS consistency FROM h""",
)
def _consistency(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_name").alias("key"), F.col("l_returnflag").alias("c")).agg(
        (F.min("l_tax") + F.avg("l_discount")).alias("f")
    )
    return rounded(evidence.cohort_consistency(rows, ["key"], "c", "f", ["A", "N"], "R"))


FREQ = with_sql("samples purchases calls", "").rstrip() + """, fq AS (SELECT cohort, variant, count(*) / any_value(n)::DOUBLE AS f FROM calls JOIN samples USING (sample) JOIN (SELECT cohort, count(*) AS n FROM samples GROUP BY 1) USING (cohort) GROUP BY 1, 2),
    cm AS (SELECT s.cohort, s.variant, s.f AS study, r.f AS reference, s.f - r.f AS d FROM fq s LEFT JOIN (SELECT * FROM fq WHERE cohort = 'BUILDING') r USING (variant) WHERE s.cohort <> 'BUILDING'),
    al AS (SELECT *, CASE WHEN d IS NULL THEN 'Not assessed' WHEN abs(d) < 1e-9 THEN 'Matched to reference' WHEN d > 0 THEN 'Higher in study' ELSE 'Lower in study' END AS direction,
      CASE WHEN d IS NULL THEN 'Non-comparable' WHEN abs(d) <= 0.03 THEN 'Similar to reference' ELSE 'Divergent from reference' END AS alignment FROM cm)"""


def external(t):
    rows = t.calls().join(t.samples(), "sample")
    freq = carrier_frequency(rows, "sample", ["cohort", "variant"], ["cohort"], t.samples()).select("cohort", "variant", (F.col("carrier_count") / F.col("total_samples")).alias("f"))
    building = freq.where("cohort = 'BUILDING'").drop("cohort")
    return evidence.external_comparison(freq.where("cohort <> 'BUILDING'"), building, ["variant"], "f", 0.03)


@query("external_comparison", FREQ + " SELECT cohort, variant, round(study, 6) AS study, round(reference, 6) AS reference, round(d, 6) AS delta, direction, alignment FROM al")
def _external(t):
    return rounded(external(t))


@query("status_counts", FREQ + " SELECT cohort, alignment, count(*) AS n FROM al GROUP BY 1, 2")
def _status(t):
    return evidence.status_counts(external(t), ["cohort"], "alignment")


@query(
    "shortlist",
    """WITH r AS (SELECT p_name AS id, p_brand AS rs, p_partkey::VARCHAR AS source, p_retailprice / 1000000 AS p FROM part), n AS (SELECT p_name AS id, min(p_type) AS v FROM part WHERE p_size > 48 GROUP BY 1),
      m AS (SELECT p_brand AS rs, min(p_type) AS v FROM part WHERE p_size > 48 GROUP BY 1), j AS (SELECT r.*, coalesce(n.v, m.v) AS consequence, CASE WHEN n.v IS NOT NULL THEN 'id' WHEN m.v IS NOT NULL THEN 'rs' END AS matched_on
        FROM r LEFT JOIN n USING (id) LEFT JOIN m USING (rs) WHERE p < 0.0015)
    SELECT id, consequence, matched_on, count(DISTINCT source) AS n_sources, round(min(p), 9) AS best_p FROM j WHERE regexp_matches(consequence, 'ECONOMY|LARGE') GROUP BY 1, 2, 3""",
)
def _shortlist(t):
    rows = t.part.select(F.col("p_name").alias("id"), F.col("p_brand").alias("rs"), F.col("p_partkey").cast("string").alias("source"), (F.col("p_retailprice") / 1000000).alias("p"))
    notes = t.part.where("p_size > 48").select(F.col("p_name").alias("id"), F.col("p_brand").alias("rs"), F.col("p_type").alias("consequence"))
    return rounded(evidence.shortlist(rows, notes, "ECONOMY|LARGE", ["id", "rs"], "p", 0.0015), 9)


@query(
    "inventory",
    with_sql("purchases", "SELECT p_type, count(*) AS n_rows, count(DISTINCT sample) AS n_samples, count(DISTINCT p_partkey) AS n_variables FROM purchases GROUP BY 1"),
)
def _inventory(t):
    return evidence.inventory(t.purchases(), "p_type", "sample", "p_partkey")
