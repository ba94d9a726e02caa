"""Linkage, blocks and haplotypes over brands (five regions of five sites) and size thresholds."""

from pyspark.sql import functions as F

from carrierlake.operators import haplotypes, ld
from carrierlake.plans.association import ODDS_SQL, cells_sql
from carrierlake.plans.registry import bh_sql, fisher_sql, query, rounded, with_sql
from carrierlake.plans.statistics import FIRTH

# Threshold loci: allele 1 is set when the smallest part of finished orders is at most the
# threshold, allele 2 the same for open orders, so neighbouring thresholds are linked.
LADDER = """low AS (SELECT o_custkey AS sample, min(p_size) FILTER (o_orderstatus = 'F') AS m1, min(p_size) FILTER (o_orderstatus = 'O') AS m2
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1),
  ladder AS (SELECT low.sample, cohort AS region, i::INT AS i, ((m1 <= i)::INT + (m2 <= i)::INT)::DOUBLE AS x
    FROM low JOIN samples USING (sample), range(1, 51) r(i) WHERE m1 IS NOT NULL AND m2 IS NOT NULL),
  pairs AS (SELECT a.region, a.i, b.i AS j, count(*) AS n_shared,
      CASE WHEN count(*) >= 3 AND var_pop(a.x) > 1e-12 AND var_pop(b.x) > 1e-12 THEN corr(a.x, b.x) ** 2 END AS r2
    FROM ladder a JOIN ladder b ON a.sample = b.sample AND b.i > a.i AND b.i <= a.i + 11 GROUP BY 1, 2, 3)"""
BLOCKS = """loci AS (SELECT DISTINCT region, i FROM ladder),
  span AS (SELECT l.region, l.i, e.i AS e, (SELECT count(*) FROM pairs p WHERE p.region = l.region AND p.i >= l.i AND p.j <= e.i AND r2 >= 0.8 - 1e-9) AS linked
    FROM loci l JOIN loci e ON e.region = l.region AND e.i BETWEEN l.i AND l.i + 11),
  reach AS (SELECT region, i, max(e) AS e FROM span WHERE linked = (e - i + 1) * (e - i) // 2 GROUP BY 1, 2),
  walk AS (SELECT region, i, e FROM reach WHERE i = 1 UNION ALL SELECT r.region, r.i, r.e FROM walk w JOIN reach r
    ON r.region = w.region AND r.i = CASE WHEN w.e > w.i THEN w.e + 1 ELSE w.i + 1 END),
  blocks AS (SELECT region, i AS start, e AS fin, e - i + 1 AS size FROM walk WHERE e > i)"""
LADDER_SQL = with_sql("samples", "").rstrip().replace("WITH", "WITH RECURSIVE", 1) + ", " + LADDER


def ladder(t):
    smallest = lambda s: F.min(F.when(F.col("o_orderstatus") == s, F.col("p_size")))
    low = t.purchases().groupBy("sample").agg(smallest("F").alias("m1"), smallest("O").alias("m2")).dropna()
    dose = (F.col("m1") <= F.col("i")).cast("int") + (F.col("m2") <= F.col("i")).cast("int")
    return (
        low.join(t.samples().select("sample", F.col("cohort").alias("region")), "sample")
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(50))))
        .select("sample", "region", "i", dose.alias("dosage"))
    )


def ladder_pairs(t):
    return ld.ld_r2(ladder(t), "region", "i", ld.MAX_BLOCK - 1)


def ladder_blocks(t):
    loci = t.samples().select(F.col("cohort").alias("region")).distinct().withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(50))))
    return ld.ld_blocks(ld.cut_lineage(ladder_pairs(t)), loci, "region")


@query("ld_r2", LADDER_SQL + " SELECT region, i, j, n_shared, round(r2, 6) AS r2 FROM pairs")
def _ld(t):
    return rounded(ladder_pairs(t))


# Every eleventh call is missing; positions grow with the threshold, in uneven steps. Whole sums, so that ties of rounding agree.
NEAR = """cl AS (SELECT *, i * 1000 + i % 7 * 100 AS pos FROM ladder WHERE (sample + i) % 11 > 0),
  near AS (SELECT a.region, a.i, b.i AS j, count(*) AS n_shared, CASE WHEN count(*) >= 3 AND var_pop(a.x) > 1e-12 AND var_pop(b.x) > 1e-12 THEN (count(*) * sum(a.x * b.x) - sum(a.x) * sum(b.x)) ** 2
      / ((count(*) * sum(a.x * a.x) - sum(a.x) ** 2) * (count(*) * sum(b.x * b.x) - sum(b.x) ** 2)) END AS r2
    FROM cl a JOIN cl b ON a.sample = b.sample AND b.pos > a.pos AND b.pos - a.pos <= 20000 GROUP BY 1, 2, 3)"""


def near_pairs(t):
    calls = ladder(t).where((F.col("sample") + F.col("i")) % 11 > 0).withColumn("pos", F.col("i") * 1000 + F.col("i") % 7 * 100)
    return ld.ld_by_distance(calls, "region", "i", "pos", "sample", 20_000)


@query("ld_by_distance", LADDER_SQL + ", " + NEAR + " SELECT region, i, j, n_shared, round(r2, 6) AS r2 FROM near")
def _near(t):
    return rounded(near_pairs(t))


@query(
    "partners_by_distance",
    LADDER_SQL + ", " + NEAR + """, both_ways AS (SELECT region, i, j FROM near WHERE r2 >= 0.8 - 1e-9 UNION ALL SELECT region, j, i FROM near WHERE r2 >= 0.8 - 1e-9)
    SELECT region, i, count(*) AS n_partners, string_agg(j::VARCHAR, ', ' ORDER BY j) AS partners FROM both_ways GROUP BY 1, 2""",
)
def _near_partners(t):
    return ld.partner_lists(near_pairs(t), "region")


@query("ld_blocks", LADDER_SQL + ", " + BLOCKS + ' SELECT region, start, fin AS "end", size FROM blocks')
def _blocks(t):
    return ladder_blocks(t)


@query(
    "block_members",
    LADDER_SQL + ", " + BLOCKS + """ SELECT region, 'Block' || start AS block, u.i::INT AS i, (u.i - start + 1)::INT AS snp_order, size
      FROM blocks, LATERAL (SELECT unnest(range(start, fin + 1)) AS i) u""",
)
def _members(t):
    return ld.block_members(ladder_blocks(t), "region")


@query(
    "region_definitions",
    LADDER_SQL + ", " + BLOCKS + """ SELECT region, 'Block' || start AS block, start AS first, fin AS last, size::BIGINT AS n_members,
      array_to_string(list_transform(range(start, fin + 1), lambda x: 'site' || x), '; ') AS members FROM blocks""",
)
def _regions(t):
    members = ld.block_members(ladder_blocks(t), "region").withColumn("name", F.concat(F.lit("site"), F.col("i")))
    return ld.region_definitions(members, ["region", "block"], "i", "name")


@query(
    "ld_partners",
    LADDER_SQL + """, l AS (SELECT region, i, j AS partner FROM pairs WHERE r2 >= 0.8 - 1e-9 UNION ALL SELECT region, j, i FROM pairs WHERE r2 >= 0.8 - 1e-9)
      SELECT region, i, count(*) AS n_partners, string_agg(partner::VARCHAR, ', ' ORDER BY partner) AS partners FROM l GROUP BY 1, 2""",
)
def _partners(t):
    return ld.partner_lists(ladder_pairs(t), "region")


BLOCK_TESTS = """tests AS (SELECT p_brand AS block, l_returnflag AS comparison, p_type AS gene, p_partkey AS key, avg(l_discount) * 10 AS p,
    avg(l_tax) * 12 AS fdr, avg(l_quantity) AS effect FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4)"""


def block_tests(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("p_brand").alias("block"), F.col("l_returnflag").alias("comparison"), F.col("p_type").alias("gene"), F.col("p_partkey").alias("key")
    ).agg((F.avg("l_discount") * 10).alias("p"), (F.avg("l_tax") * 12).alias("fdr"), F.avg("l_quantity").alias("effect"))


@query(
    "ld_block_summary",
    f"""WITH {BLOCK_TESTS} SELECT comparison, block, count(*) AS n_tests, round(min(p), 6) AS min_p, round(min(fdr), 6) AS min_fdr,
      count(*) FILTER (p < 0.4000001) AS n_nominal, count(*) FILTER (fdr < 0.4000001) AS n_fdr, round(min(effect), 6) AS min_effect, round(max(effect), 6) AS max_effect FROM tests GROUP BY 1, 2""",
)
def _block_summary(t):
    return rounded(ld.block_summary(block_tests(t), ["comparison"], "block", "p", "fdr", "effect", 0.4000001))


@query(
    "block_rollup",
    f"""WITH {BLOCK_TESTS} SELECT block, count(DISTINCT key) AS n_keys, count(*) AS n_rows, round(min(p), 6) AS best_p, count(DISTINCT gene) AS n_genes,
      count(DISTINCT key) FILTER (comparison = 'A') AS "A", count(DISTINCT key) FILTER (comparison = 'N') AS "N", count(DISTINCT key) FILTER (comparison = 'R') AS "R"
      FROM tests WHERE p < 0.4000001 GROUP BY 1""",
)
def _rollup(t):
    rows = block_tests(t).where("p < 0.4000001")
    return rounded(ld.block_rollup(rows, "block", "comparison", ["A", "N", "R"], "gene", "key", "p"))


# --- haplotypes ---------------------------------------------------------------------------------

HAPS = """sites AS (SELECT DISTINCT ((substr(p_brand, 7)::INT - 1) // 5 + 1)::VARCHAR AS region, ((substr(p_brand, 7)::INT - 1) % 5 + 1)::VARCHAR AS site FROM part),
  haps AS (SELECT sample, region, string_agg(a1::VARCHAR, '' ORDER BY site) AS h1, string_agg(a2::VARCHAR, '' ORDER BY site) AS h2
    FROM (SELECT sample, ((substr(locus, 7)::INT - 1) // 5 + 1)::VARCHAR AS region, ((substr(locus, 7)::INT - 1) % 5 + 1)::VARCHAR AS site, a1, a2 FROM phased) GROUP BY 1, 2
    HAVING count(*) = 5),
  cop AS (SELECT sample, region, 1 AS copy, h1 AS hap FROM haps UNION ALL SELECT sample, region, 2, h2 FROM haps),
  hc AS (SELECT region, hap, count(*) AS n FROM cop GROUP BY 1, 2),
  ref AS (SELECT region, hap, n, callable, n / (2.0 * callable)::DOUBLE AS freq, 'H' || row_number() OVER (PARTITION BY region ORDER BY n DESC, hap) AS hap_id
    FROM hc JOIN (SELECT region, count(*) AS callable FROM haps GROUP BY 1) USING (region))"""
HAP_SQL = with_sql("samples purchases phased", "").rstrip() + ", " + HAPS


def place(brand):
    """Region and site of a brand: five consecutive brand numbers make one region."""
    number = F.substring(brand, 7, 3).cast("int") - 1
    return F.floor(number / 5 + 1).cast("string").alias("region"), (number % 5 + 1).cast("string").alias("site")


def sites(t):
    return t.part.select(*place("p_brand")).distinct()


def haps(t, site_table=None):
    alleles = t.phased().select("sample", *place("locus"), "a1", "a2")
    return haplotypes.sample_haplotypes(alleles, sites(t) if site_table is None else site_table)


@query("sample_haplotypes", HAP_SQL + " SELECT sample, region, h1, h2 FROM haps")
def _haps(t):
    return haps(t)


@query("haplotype_counts", HAP_SQL + " SELECT region, hap, n, callable, round(freq, 6) AS freq, hap_id FROM ref")
def _counts(t):
    return rounded(haplotypes.haplotype_counts(haps(t), ["region"]))


@query(
    "haplotype_content",
    HAP_SQL + """ SELECT region, hap, CASE WHEN NOT contains(hap, '1') THEN 'Reference-like' ELSE array_to_string(
      list_filter(list_transform(range(1, 6), lambda i: CASE WHEN substr(hap, i, 1) = '1' THEN region || i END), lambda x: x IS NOT NULL), '; ') END AS content FROM ref""",
)
def _content(t):
    names = sites(t).groupBy("region").agg(F.sort_array(F.collect_list(F.concat("region", "site"))).alias("names"))
    counts = haplotypes.haplotype_counts(haps(t), ["region"])
    return counts.join(names, "region").select("region", "hap", haplotypes.variant_content(F.col("hap"), F.col("names")).alias("content"))


@query(
    "haplotype_carriers",
    HAP_SQL + " SELECT sample, region, hap, count(*)::INT AS dosage, any_value(hap_id) AS hap_id FROM cop JOIN ref USING (region, hap) GROUP BY 1, 2, 3",
)
def _carriers(t):
    rows = haps(t)
    return haplotypes.haplotype_carriers(rows, haplotypes.haplotype_counts(rows, ["region"]))


@query(
    "reconcile_backbone",
    HAP_SQL + """ SELECT region, substr(hap, 1, 1) || substr(hap, 3, 1) || substr(hap, 5, 1) AS hap, sum(n)::BIGINT AS n, round(sum(freq), 6) AS freq FROM ref GROUP BY 1, 2""",
)
def _reconcile(t):
    every = sites(t).withColumn("place", F.col("site").cast("int"))
    own = sites(t).where(F.col("site").isin("1", "3", "5"))
    return rounded(haplotypes.reconcile_backbone(haplotypes.haplotype_counts(haps(t), ["region"]), every, own))


PAIR = """pr AS (SELECT x.sample, cohort, tissue, x.a1::VARCHAR || y.a1 AS h1, x.a2::VARCHAR || y.a2 AS h2, x.a1 + x.a2 AS d1, y.a1 + y.a2 AS d2
    FROM phased x JOIN phased y USING (sample) JOIN samples USING (sample) WHERE x.locus = 'Brand#11' AND y.locus = 'Brand#12'),
  gp AS (SELECT *, unnest([cohort || '_' || tissue, CASE WHEN tissue = 'Healthy' THEN 'Healthy_All' ELSE 'Tumour_All' END, 'All_Samples']) AS group_label FROM pr),
  fr AS (SELECT group_label, hap, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY group_label)::DOUBLE AS freq,
    sum(count(*)) OVER (PARTITION BY group_label) AS total FROM (SELECT group_label, unnest([h1, h2]) AS hap FROM gp) GROUP BY 1, 2)"""
PAIR_SQL = with_sql("samples purchases phased", "").rstrip() + ", " + PAIR


def pair(t):
    two = sites(t).where("region = '3' AND site IN ('1', '2')")
    return haps(t, two).join(t.samples(), "sample")


@query("pattern_frequencies", PAIR_SQL + " SELECT group_label, hap, n, round(freq, 6) AS freq FROM fr")
def _pattern(t):
    return rounded(haplotypes.pattern_frequencies(pair(t)))


@query(
    "pattern_carriers",
    PAIR_SQL + """ SELECT group_label, count(*) AS callable, count(*) FILTER (d1 > 0) AS carry_first, count(*) FILTER (d2 > 0) AS carry_second,
      count(*) FILTER (d1 > 0 AND d2 > 0) AS carry_both_sites, count(*) FILTER ('11' IN (h1, h2)) AS carry_11, count(*) FILTER ('10' IN (h1, h2)) AS carry_10,
      count(*) FILTER ('01' IN (h1, h2)) AS carry_01, round(count(*) FILTER (d1 > 0 AND d2 > 0) / count(*) FILTER (d1 > 0)::DOUBLE, 6) AS p_second_given_first,
      round(count(*) FILTER (d1 > 0 AND d2 > 0) / count(*) FILTER (d2 > 0)::DOUBLE, 6) AS p_first_given_second FROM gp GROUP BY 1""",
)
def _pattern_carriers(t):
    return rounded(haplotypes.pattern_carriers(pair(t)))


@query(
    "conditional_genotypes",
    PAIR_SQL + """ SELECT group_label, ['WT', 'Het', 'Hom'][d1 + 1] AS gt1, ['WT', 'Het', 'Hom'][d2 + 1] AS gt2, count(*) AS n,
      round(count(*) / sum(count(*)) OVER (PARTITION BY group_label, d1)::DOUBLE, 6) AS row_share FROM gp GROUP BY group_label, d1, d2""",
)
def _conditional(t):
    return rounded(haplotypes.conditional_genotypes(pair(t)))


@query("sample_patterns", PAIR_SQL + " SELECT group_label, h1 || ' + ' || h2 AS pattern, count(*) AS n FROM gp GROUP BY 1, 2")
def _sample_patterns(t):
    return haplotypes.sample_patterns(pair(t))


@query(
    "rollup_groups",
    PAIR_SQL.replace("pr AS", "unused AS (SELECT 1), pr AS", 1) + " SELECT group_label, count(*) AS n FROM gp GROUP BY 1",
)
def _rollup_groups(t):
    return haplotypes.with_rollup_groups(pair(t)).groupBy("group_label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "direct_deltas",
    PAIR_SQL + f""", w AS (SELECT hap, max(n) FILTER (group_label = 'Tumour_All') AS a, max(freq) FILTER (group_label = 'Tumour_All') AS fa, max(n) FILTER (group_label = 'Healthy_All') AS c,
        max(freq) FILTER (group_label = 'Healthy_All') AS fc FROM fr GROUP BY 1),
      tot AS (SELECT max(total) FILTER (group_label = 'Tumour_All') AS ta, max(total) FILTER (group_label = 'Healthy_All') AS tc FROM fr),
      tested AS (SELECT *, {fisher_sql('a', '(ta - a)', 'c', '(tc - c)')} AS p FROM w, tot), adj AS ({bh_sql('tested', 'p', '', 'q')})
    SELECT hap, a AS n_left, c AS n_right, round(fa, 6) AS freq_left, round(fc, 6) AS freq_right, round(fa - fc, 6) AS delta, round(p, 6) AS p_value, round(q, 6) AS fdr,
      (SELECT sign(max(fa - fc) FILTER (hap = '10')) * sign(max(fa - fc) FILTER (hap = '01')) < 0 FROM w) AS inverse_pattern FROM adj""",
)
def _deltas(t):
    return rounded(haplotypes.direct_deltas(haplotypes.pattern_frequencies(pair(t)), "Tumour_All", "Healthy_All"))


ASSOC = """hs AS (SELECT * FROM haps JOIN samples USING (sample)),
  cs AS (SELECT c.comparison, region, sum((tissue = 'Tumour')::INT)::BIGINT AS case_callable, sum((tissue = 'Healthy')::INT)::BIGINT AS control_callable
    FROM hs JOIN (SELECT DISTINCT cohort AS comparison FROM samples UNION ALL SELECT 'All') c ON tissue = 'Healthy' OR c.comparison IN ('All', cohort) GROUP BY 1, 2),
  dz AS (SELECT sample, region, hap_id, count(*) AS dosage FROM cop JOIN ref USING (region, hap) WHERE n >= 3 GROUP BY 1, 2, 3),
  ct AS (SELECT c.comparison, region, hap_id, sum((tissue = 'Tumour')::INT)::BIGINT AS case_carriers, sum((tissue = 'Healthy')::INT)::BIGINT AS control_carriers,
      sum(CASE WHEN tissue = 'Tumour' THEN dosage ELSE 0 END)::BIGINT AS case_copies, sum(CASE WHEN tissue = 'Healthy' THEN dosage ELSE 0 END)::BIGINT AS control_copies
    FROM dz JOIN samples USING (sample) JOIN (SELECT DISTINCT cohort AS comparison FROM samples UNION ALL SELECT 'All') c ON tissue = 'Healthy' OR c.comparison IN ('All', cohort)
    GROUP BY 1, 2, 3),
  cl AS (SELECT *, case_callable - case_carriers AS case_rest, control_callable - control_carriers AS control_rest FROM ct JOIN cs USING (comparison, region)
    WHERE case_callable >= 3 AND control_callable >= 3)"""
ARMS = ("case_carriers", "case_rest", "control_carriers", "control_rest")
ASSOC_SQL = HAP_SQL + ", " + ASSOC + f""", tested AS (SELECT *, {fisher_sql(*ARMS)} AS p, {cells_sql(ODDS_SQL, *ARMS)} AS o FROM cl), adj AS ({bh_sql('tested', 'p', 'comparison, region', 'q')})"""


def hap_tests(t):
    rows = haps(t)
    return haplotypes.haplotype_association(rows, t.samples(), haplotypes.haplotype_counts(rows, ["region"]))


@query(
    "haplotype_association",
    ASSOC_SQL + """ SELECT comparison, region, hap_id, case_carriers, case_rest, control_carriers, control_rest, round(case_copies / (2.0 * case_callable)::DOUBLE, 6) AS case_freq,
      round(control_copies / (2.0 * control_callable)::DOUBLE, 6) AS control_freq, round(o, 6) AS odds_ratio, round(p, 6) AS p_value, round(q, 6) AS fdr FROM adj""",
)
def _hap_association(t):
    return rounded(hap_tests(t).select("comparison", "region", "hap_id", *ARMS, "case_freq", "control_freq", "odds_ratio", "p_value", "fdr"))


# The penalised fit of the statistics queries in half steps, which settle in small arms too.
HALF_STEPS = FIRTH[FIRTH.index("fit AS"):].rsplit("SELECT variant, n", 1)[0].replace("b0 + (i00", "b0 + 0.5 * (i00").replace("b1 + (i01", "b1 + 0.5 * (i01").replace("pass < 40", "pass < 120")


@query(
    "haplotype_dose_risk",
    ASSOC_SQL.replace("WITH", "WITH RECURSIVE", 1) + """, cells AS (SELECT comparison || '|' || region || '|' || hap_id AS variant, comparison, region, hap_id, case_callable + control_callable AS n, case_callable AS events,
      case_rest + control_rest AS n0, 2 * case_carriers - case_copies + 2 * control_carriers - control_copies AS n1, case_copies - case_carriers + control_copies - control_carriers AS n2,
      case_rest AS y0, 2 * case_carriers - case_copies AS y1, case_copies - case_carriers AS y2 FROM adj), """ + HALF_STEPS
    + """ SELECT comparison, region, hap_id, round(exp(b1), 3) AS dose_or, 'penalised' AS dose_model FROM fit JOIN cells USING (variant) WHERE pass = 120""",
)
def _hap_dose_risk(t):
    return rounded(haplotypes.with_dose_risk(hap_tests(t)).select("comparison", "region", "hap_id", "dose_or", "dose_model"), 3)


@query(
    "best_per_region",
    ASSOC_SQL + """, b AS (SELECT *, row_number() OVER (PARTITION BY comparison, region ORDER BY round(p, 12), hap_id) AS rn FROM adj)
    SELECT comparison, region, count(*) AS n_tests, count(*) FILTER (p < 0.05) AS n_nominal, max(CASE WHEN rn = 1 THEN hap_id END) AS best_name, round(min(p), 6) AS best_p FROM b GROUP BY 1, 2""",
)
def _best(t):
    tests = hap_tests(t).withColumn("p_value", F.round("p_value", 12))
    return rounded(haplotypes.best_per_region(tests, ["comparison", "region"], "p_value", "hap_id"))


@query(
    "frequency_with_other",
    HAP_SQL + """, k AS (SELECT region, CASE WHEN row_number() OVER (PARTITION BY region ORDER BY n DESC, hap) <= 5 THEN hap ELSE 'Other' END AS hap, n FROM ref)
    SELECT region, hap, sum(n)::BIGINT AS n, round(sum(n) / sum(sum(n)) OVER (PARTITION BY region)::DOUBLE, 6) AS share FROM k GROUP BY 1, 2""",
)
def _other(t):
    return rounded(haplotypes.frequency_with_other(haplotypes.haplotype_counts(haps(t), ["region"]), ["region"], 5))


@query(
    "haplotypes_with_sites",
    HAP_SQL + " SELECT region, substr(hap, 2, 1) || substr(hap, 4, 1) AS pattern, count(*) AS n_haplotypes, sum(n)::BIGINT AS n, round(sum(freq), 6) AS freq FROM ref GROUP BY 1, 2",
)
def _with_sites(t):
    return rounded(haplotypes.haplotypes_with_sites(haplotypes.haplotype_counts(haps(t), ["region"]), [2, 4], ["region"]))


@query(
    "top_mass",
    HAP_SQL + " SELECT region, round(sum(freq), 6) AS top_mass FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY n DESC, hap) AS rn FROM ref) WHERE rn <= 5 GROUP BY 1",
)
def _top_mass(t):
    return rounded(haplotypes.top_mass(haplotypes.haplotype_counts(haps(t), ["region"]), ["region"]))


# Pairs of alleles that add up to the dosages; a region's passes go on while its largest change is 1e-7 or more.
EM = """gn AS (SELECT region, g, count(*)::DOUBLE AS w FROM (SELECT region, array_to_string(list_transform(range(1, len(h1) + 1), lambda i: (h1[i]::INT + h2[i]::INT)::VARCHAR), '') AS g FROM haps) GROUP BY 1, 2),
  hp AS (SELECT array_to_string(list_transform(range(0, 5), lambda i: ((c >> i) & 1)::VARCHAR), '') AS h1 FROM range(0, 32) r(c)),
  pr AS (SELECT *, w / count(*) OVER (PARTITION BY region, g) AS e FROM (SELECT *, array_to_string(list_transform(range(1, 6), lambda i: (g[i]::INT - h1[i]::INT)::VARCHAR), '') AS h2 FROM gn, hp) WHERE regexp_matches(h2, '^[01]+$') AND h1 <= h2),
  cp AS (SELECT region, 2 * sum(w) AS copies FROM gn GROUP BY 1),
  em AS (SELECT region, 0 AS pass, hap, sum(e) / any_value(copies) AS f, 1.0::DOUBLE AS gap FROM (SELECT region, unnest([h1, h2]) AS hap, e FROM pr) JOIN cp USING (region) GROUP BY 1, 3
    UNION ALL SELECT region, pass + 1, hap, f, max(abs(f - old)) OVER (PARTITION BY region) FROM (
      SELECT region, pass, u.hap AS hap, any_value(u.old) AS old, sum(e) / any_value(copies) AS f FROM (
        SELECT pr.region, a.pass, copies, unnest([{'hap': h1, 'old': a.f}, {'hap': h2, 'old': b.f}]) AS u, w * a.f * b.f / sum(a.f * b.f) OVER (PARTITION BY pr.region, g) AS e
        FROM pr JOIN cp ON cp.region = pr.region JOIN em a ON a.region = pr.region AND a.hap = h1 JOIN em b ON b.region = pr.region AND b.hap = h2 WHERE a.pass < 50 AND a.gap >= 1e-7)
      GROUP BY region, pass, u.hap))
  SELECT region, hap, round(f, 6) AS freq, gap < 1e-7 AS converged FROM (SELECT * FROM em QUALIFY pass = max(pass) OVER (PARTITION BY region)) WHERE f >= 0.005"""


@query("em_haplotypes", HAP_SQL.replace("WITH", "WITH RECURSIVE", 1) + ", " + EM)
def _em(t):
    digits = F.array_join(
        F.transform(F.sequence(F.lit(1), F.length("h1")), lambda i: (F.substring("h1", i, F.lit(1)).cast("int") + F.substring("h2", i, F.lit(1)).cast("int")).cast("string")), ""
    )
    return rounded(haplotypes.em_haplotypes(haps(t).select("sample", "region", digits.alias("g"))))


SPLIT = """sp AS (SELECT region, tissue, hap, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY region, tissue) AS f FROM cop JOIN samples USING (sample) GROUP BY 1, 2, 3),
  fj AS (SELECT region, hap, coalesce(a.f, 0) AS p, coalesce(b.f, 0) AS q FROM (SELECT * FROM sp WHERE tissue = 'Tumour') a FULL JOIN (SELECT * FROM sp WHERE tissue = 'Healthy') b USING (region, hap))"""


def split_frequencies(t):
    rows = haps(t).join(t.samples(), "sample")
    counts = haplotypes.haplotype_counts(rows, ["region", "tissue"])
    return counts.where("tissue = 'Tumour'").drop("tissue"), counts.where("tissue = 'Healthy'").drop("tissue")


@query(
    "frequency_concordance",
    HAP_SQL + ", " + SPLIT + """ SELECT region, round(sum(least(p, q)), 6) AS shared_mass, round(sqrt(greatest(sum(
        (CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + (CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2, 0)), 6) AS js_distance,
      round(max(abs(p - q)), 6) AS max_difference, count(*) FILTER (p > 0 AND q > 0) AS n_shared, count(*) AS n_items FROM fj GROUP BY 1""",
)
def _concordance(t):
    return rounded(haplotypes.frequency_concordance(*split_frequencies(t), ["region"]))


@query(
    "frequency_checks",
    HAP_SQL + """, sp AS (SELECT region, tissue, hap, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY region, tissue) AS f FROM cop JOIN samples USING (sample) GROUP BY 1, 2, 3),
      fj AS (SELECT region, hap, a.f AS p, b.f AS q FROM (SELECT * FROM sp WHERE tissue = 'Tumour') a FULL JOIN (SELECT * FROM sp WHERE tissue = 'Healthy') b USING (region, hap))
    SELECT region, hap, round(p, 6) AS recomputed, round(q, 6) AS stored, round(abs(p - q), 6) AS abs_delta,
      CASE WHEN abs(p - q) IS NULL THEN 'Missing_side' WHEN abs(p - q) <= 0.02 THEN 'Match' ELSE 'Mismatch' END AS verdict FROM fj""",
)
def _checks(t):
    return rounded(haplotypes.frequency_checks(*split_frequencies(t), ["region", "hap"], "freq", 0.02))


@query(
    "block_overlap",
    """WITH a AS (SELECT p_brand AS block_a, p_partkey AS item FROM part), b AS (SELECT p_name AS block_b, p_partkey AS item FROM part),
      s AS (SELECT block_a, block_b, count(*) AS n_shared FROM a JOIN b USING (item) GROUP BY 1, 2),
      j AS (SELECT *, n_shared / (size_a + size_b - n_shared)::DOUBLE AS jac FROM s JOIN (SELECT block_a, count(*) AS size_a FROM a GROUP BY 1) USING (block_a)
        JOIN (SELECT block_b, count(*) AS size_b FROM b GROUP BY 1) USING (block_b))
    SELECT block_a, block_b, n_shared, size_a, size_b, round(jac, 6) AS jaccard, jac = 1 AS exact,
      row_number() OVER (PARTITION BY block_a ORDER BY jac DESC, block_b DESC) = 1 AS best_partner FROM j""",
)
def _overlap(t):
    a = t.part.select(F.col("p_brand").alias("block_a"), F.col("p_partkey").alias("item"))
    b = t.part.select(F.col("p_name").alias("block_b"), F.col("p_partkey").alias("item"))
    return rounded(haplotypes.block_overlap(a, b, "block_a", "block_b", "item"))
