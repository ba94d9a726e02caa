"""Range joins and depth roll-ups over ship days, event runs and purchase depths."""

from pyspark.sql import Window, functions as F

from carrierlake.operators import coverage, intervals
from carrierlake.plans.registry import query, rounded, with_sql

EPOCH = "1992-01-01"


def ship_intervals(t):
    """Closed day span per supplier and part bought more than once; the brand is the label."""
    day = F.datediff("l_shipdate", F.lit(EPOCH).cast("date")).cast("bigint")
    return (
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_suppkey").alias("chrom"), "l_partkey", F.col("p_brand").alias("label"))
        .agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )


def ship_points(t):
    day = F.datediff("l_shipdate", F.lit(EPOCH).cast("date")).cast("bigint")
    return t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("chrom"), day.alias("pos"))


SPANS = """spans AS (SELECT l_suppkey AS chrom, l_partkey, any_value(p_brand) AS label,
    min(datediff('day', DATE '1992-01-01', l_shipdate::DATE)) AS first, max(datediff('day', DATE '1992-01-01', l_shipdate::DATE)) AS last
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING count(*) > 1)"""
POINTS = """points AS (SELECT l_orderkey, l_suppkey AS chrom, datediff('day', DATE '1992-01-01', l_shipdate::DATE) AS pos
    FROM lineitem)"""


@query(
    "point_in_interval",
    f"""WITH {SPANS}, {POINTS}, hit AS (SELECT p.chrom, p.pos, string_agg(DISTINCT label, '; ' ORDER BY label) AS labels
      FROM (SELECT DISTINCT chrom, pos FROM points) p JOIN spans s ON s.chrom = p.chrom AND p.pos BETWEEN s.first AND s.last GROUP BY 1, 2)
    SELECT l_orderkey, chrom, pos, labels, labels IS NOT NULL AS in_interval FROM points LEFT JOIN hit USING (chrom, pos)""",
)
def _point_in_interval(t):
    out = intervals.point_in_interval(ship_points(t), ship_intervals(t), "chrom", "pos", "first", "last", "label")
    return out.select("l_orderkey", "chrom", "pos", "labels", "in_interval")


@query(
    "smallest_region",
    f"""WITH {SPANS}, {POINTS}, hit AS (SELECT p.chrom, p.pos, l_partkey AS region, row_number() OVER (PARTITION BY p.chrom, p.pos
        ORDER BY s.last - s.first, s.first, l_partkey) AS rn
      FROM (SELECT DISTINCT chrom, pos FROM points) p JOIN spans s ON s.chrom = p.chrom AND p.pos BETWEEN s.first AND s.last)
    SELECT l_orderkey, chrom, pos, region FROM points LEFT JOIN (SELECT * FROM hit WHERE rn = 1) USING (chrom, pos)""",
)
def _smallest_region(t):
    out = intervals.smallest_region(ship_points(t), ship_intervals(t), "chrom", "pos", "first", "last", "l_partkey")
    return out.select("l_orderkey", "chrom", "pos", "region")


def depth_runs(t):
    """Half-open runs between a user's events of one day; the last run ends with the day."""
    second = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 1000000
    events = t.events.select(
        F.col("user_id").alias("sample"), F.floor(second).alias("start"), F.floor("value").alias("depth"), "event_id"
    ).withColumn("day", F.floor(F.col("start") / 86400))
    following = Window.partitionBy("sample", "day").orderBy("start", "event_id")
    end = F.coalesce(F.lead("start").over(following), (F.col("day") + 1) * 86400)
    return events.withColumn("end", end).where("end > start").select(
        F.lit("chr1").alias("chr"), "sample", "start", "end", "depth"
    )


def hour_targets(t):
    """The first hour of every quarter day in which anything happened."""
    second = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 1000000
    quarter = F.floor(second / 21600)
    return t.events.select(quarter.alias("q")).distinct().select(
        F.lit("chr1").alias("chr"),
        F.concat(F.lit("amp"), F.col("q")).alias("amplicon_id"),
        (F.col("q") * 21600).alias("t_start"),
        (F.col("q") * 21600 + 3600).alias("t_end"),
    )


CELLS = """runs AS (SELECT sample, start, depth, coalesce(lead(start) OVER (PARTITION BY sample, day ORDER BY start, event_id), (day + 1) * 86400) AS fin
    FROM (SELECT *, start // 86400 AS day FROM (SELECT event_id, user_id AS sample, floor(value)::BIGINT AS depth,
      (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000 AS start FROM events))),
  amps AS (SELECT DISTINCT ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000) // 21600 AS q FROM events),
  cells AS (SELECT sample, 'amp' || q AS amplicon_id, q * 21600 AS t_start, 3600::BIGINT AS length_bp,
      sum(least(fin, q * 21600 + 3600) - greatest(start, q * 21600))::BIGINT AS covered_bases,
      sum(CASE WHEN depth = 0 THEN least(fin, q * 21600 + 3600) - greatest(start, q * 21600) ELSE 0 END)::BIGINT AS zero_bases,
      sum(CASE WHEN depth < 50 THEN least(fin, q * 21600 + 3600) - greatest(start, q * 21600) ELSE 0 END)::BIGINT AS low_bases
    FROM runs JOIN amps ON start < q * 21600 + 3600 AND fin > q * 21600 AND fin > start GROUP BY 1, 2, 3)"""


def depth_cells(t):
    return intervals.clip_overlap(depth_runs(t), hour_targets(t), low=50.0)


@query(
    "clip_overlap",
    f"""WITH {CELLS} SELECT sample, amplicon_id, t_start, length_bp, covered_bases, zero_bases, low_bases,
      round(zero_bases * 100.0 / length_bp::DOUBLE, 6) AS pct_zero, round(low_bases * 100.0 / length_bp::DOUBLE, 6) AS pct_low FROM cells""",
)
def _clip(t):
    return rounded(depth_cells(t).drop("chr", "t_end"))


COHORT_CELLS = CELLS + """, cc AS (SELECT *, CASE WHEN sample % 2 = 0 THEN 'A' ELSE 'B' END AS cohort,
    zero_bases * 100.0 / length_bp::DOUBLE AS pz, low_bases * 100.0 / length_bp::DOUBLE AS pl FROM cells)"""
REPORT = """count(*) AS {n}, round(avg(pz), 6) AS mean_pct_zero, round(max(pz), 6) AS max_pct_zero, count(*) FILTER (zero_bases > 0) AS n_any_zero,
    round(avg(pl), 6) AS mean_pct_low, round(max(pl), 6) AS max_pct_low, count(*) FILTER (low_bases > 0) AS n_any_low,
    sum(zero_bases)::BIGINT AS total_zero, sum(low_bases)::BIGINT AS total_low,
    CASE WHEN avg(pz) > 2 THEN 'FAIL_ZERO' WHEN avg(pl) > 60 THEN 'WARN_LOW' ELSE 'PASS' END AS flag"""


def _report(t, name):
    cells = depth_cells(t).withColumn("cohort", F.when(F.col("sample") % 2 == 0, "A").otherwise("B"))
    return coverage.zero_coverage_report(cells, zero_limit=2.0, low_limit=60.0)[name]


@query("zero_coverage_amplicons", f"WITH {COHORT_CELLS} SELECT cohort, amplicon_id, {REPORT.format(n='n_samples')} FROM cc GROUP BY 1, 2")
def _zero_amp(t):
    return rounded(_report(t, "amplicon"))


@query("zero_coverage_samples", f"WITH {COHORT_CELLS} SELECT cohort, sample, {REPORT.format(n='n_amplicons')} FROM cc GROUP BY 1, 2")
def _zero_sample(t):
    return rounded(_report(t, "sample"))


@query(
    "zero_coverage_problems",
    f"""WITH {COHORT_CELLS} SELECT cohort, sample, amplicon_id, zero_bases, low_bases, round(pz, 6) AS pct_zero, round(pl, 6) AS pct_low,
      CASE WHEN pz > 2 THEN 'FAIL_ZERO' ELSE 'WARN_LOW' END AS flag FROM cc WHERE pz > 2 OR pl > 60""",
)
def _zero_problem(t):
    return rounded(
        _report(t, "problem").select("cohort", "sample", "amplicon_id", "zero_bases", "low_bases", "pct_zero", "pct_low", "flag")
    )


def panel_variants(t):
    return t.part.select(
        F.col("p_partkey").alias("key"),
        F.col("p_brand").alias("chrom"),
        (F.col("p_size") * 100).cast("bigint").alias("pos"),
        F.col("p_type").alias("ref"),
        F.array(F.concat(F.lit("rs"), F.col("p_partkey") % 97)).alias("rsids"),
    )


def panel_targets(t):
    return intervals.shuffled(t.supplier, t.part, F.col("s_suppkey") == F.col("p_partkey")).select(
        F.col("s_suppkey").alias("target_id"),
        F.col("p_brand").alias("chrom"),
        (F.col("p_size").cast("bigint") * 100 - 50).alias("t_first"),
        (F.col("p_size").cast("bigint") * 100 + 250).alias("t_last"),
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("rs"), F.col("s_suppkey") % 97)).otherwise("").alias("rsid"),
        F.col("s_name").alias("label"),
    )


HITS = """v AS (SELECT p_partkey AS key, p_brand AS chrom, p_size * 100 AS pos, length(p_type) AS len, 'rs' || (p_partkey % 97) AS rs FROM part),
  tg AS (SELECT s_suppkey AS target_id, p_brand AS chrom, p_size * 100 - 50 AS t_first, p_size * 100 + 250 AS t_last,
    CASE WHEN s_suppkey % 2 = 0 THEN 'rs' || (s_suppkey % 97) END AS rsid, s_name AS label FROM supplier JOIN part ON s_suppkey = p_partkey),
  hits AS (SELECT key, target_id, label, (v.chrom = tg.chrom AND t_first <= pos + len - 1 AND t_last >= pos) AS by_span,
      coalesce(rs = rsid, false) AS by_rs, rsid IS NULL AND v.chrom = tg.chrom AND t_first <= pos + len - 1 AND t_last >= pos AS bare
    FROM v JOIN tg ON (v.chrom = tg.chrom AND t_first <= pos + len - 1 AND t_last >= pos) OR rs = rsid),
  f AS (SELECT key, bool_or(by_span) AS span, bool_or(by_rs) AS rs, bool_or(bare) AS bare,
    string_agg(DISTINCT label, '; ' ORDER BY label) AS labels FROM hits GROUP BY 1)"""


@query(
    "match_variants_to_targets",
    f"""WITH {HITS} SELECT v.key, CASE WHEN span AND f.rs THEN 'both' WHEN span THEN 'interval' WHEN f.rs THEN 'rsID' ELSE 'none' END AS match_type,
      CASE WHEN f.rs OR bare THEN 'Explicitly represented in panel' WHEN span THEN 'Within target interval only'
        ELSE 'Outside panel design' END AS match_status,
      NOT coalesce(f.rs OR bare, false) AS extra_finding, coalesce(labels, '') AS target_labels FROM v LEFT JOIN f USING (key)""",
)
def _match(t):
    matched, _ = intervals.match_variants_to_targets(panel_variants(t), panel_targets(t))
    return matched.select("key", "match_type", "match_status", "extra_finding", "target_labels")


@query(
    "targets_summary",
    f"""WITH {HITS}, n AS (SELECT target_id, count(DISTINCT key) AS n_variants FROM hits GROUP BY 1),
      e AS (SELECT target_id, string_agg(key::VARCHAR, '; ' ORDER BY key::VARCHAR) AS examples FROM (
        SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY key) AS rn FROM (SELECT DISTINCT target_id, key FROM hits)) WHERE rn <= 5 GROUP BY 1)
    SELECT target_id, label, coalesce(n_variants, 0) AS n_variants, coalesce(examples, '') AS examples,
      coalesce(n_variants, 0) > 0 AS any_variant, round(s_acctbal, 2) AS audit
    FROM tg LEFT JOIN n USING (target_id) LEFT JOIN e USING (target_id) LEFT JOIN supplier ON s_suppkey = target_id""",
)
def _targets(t):
    _, links = intervals.match_variants_to_targets(panel_variants(t), panel_targets(t))
    audit = t.supplier.select(F.col("s_suppkey").alias("target_id"), F.round("s_acctbal", 2).alias("audit"))
    out = intervals.targets_summary(panel_targets(t), links, audit, ["target_id"])
    return out.select("target_id", "label", "n_variants", "examples", "any_variant", "audit")


def purchase_depth(t):
    """Depth of a target (brand) in a sample: units bought; the length is the summed part size."""
    return t.purchases().groupBy("sample", F.col("p_brand").alias("target")).agg(
        F.sum("l_quantity").alias("depth"), F.sum(F.col("p_size").cast("bigint")).alias("length")
    )


def read_counts(t):
    status = F.col("o_orderstatus")
    price = F.floor("o_totalprice")
    return t.orders.groupBy(F.col("o_custkey").alias("sample")).agg(
        F.sum(price).alias("total_reads"),
        F.sum(F.when(status != "P", price).otherwise(0)).alias("mapped_reads"),
        F.sum(F.when(status == "F", price).otherwise(0)).alias("on_target_reads"),
    )


DEPTH = """depth AS (SELECT sample, p_brand AS target, sum(l_quantity) AS depth, sum(p_size)::BIGINT AS length FROM purchases GROUP BY 1, 2)"""
QC = """reads AS (SELECT o_custkey AS sample, sum(floor(o_totalprice))::BIGINT AS total_reads,
    sum(CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice) ELSE 0 END)::BIGINT AS mapped_reads,
    sum(CASE WHEN o_orderstatus = 'F' THEN floor(o_totalprice) ELSE 0 END)::BIGINT AS on_target_reads FROM orders GROUP BY 1),
  qc AS (SELECT sample, total_reads, CASE WHEN total_reads > 0 THEN mapped_reads * 100.0 / total_reads::DOUBLE END AS mapped_pct,
      CASE WHEN mapped_reads > 0 THEN on_target_reads * 100.0 / mapped_reads::DOUBLE END AS on_target_pct, mean_cov, uniformity_100x, worst_target
    FROM reads LEFT JOIN (SELECT sample, sum(length * depth) / sum(length) AS mean_cov,
      avg(CASE WHEN depth >= 100 THEN 1.0 ELSE 0.0 END) * 100 AS uniformity_100x FROM depth GROUP BY 1) USING (sample)
    LEFT JOIN (SELECT sample, target AS worst_target FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY depth, target) AS rn FROM depth)
      WHERE rn = 1) USING (sample))"""
LIMITS = {"total_reads": 2000000, "mapped_pct": 60, "on_target_pct": 40, "mean_cov": 45, "uniformity_100x": 5}
REASONS = ", ".join(f"CASE WHEN {c} IS NULL OR {c} < {v} THEN '{c}' END" for c, v in LIMITS.items())
STATUS = f"""st AS (SELECT *, CASE WHEN len(fail_reasons) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
    SELECT *, list_filter([{REASONS}], lambda x: x IS NOT NULL) AS fail_reasons FROM qc JOIN samples USING (sample)))"""


def sample_status(t):
    qc = coverage.sample_qc(purchase_depth(t), read_counts(t))
    return coverage.qc_status(qc, LIMITS).join(t.samples(), "sample")


@query(
    "sample_qc",
    with_sql("purchases", "").rstrip() + f""", {DEPTH}, {QC} SELECT sample, total_reads, round(mapped_pct, 6) AS mapped_pct,
      round(on_target_pct, 6) AS on_target_pct, round(mean_cov, 6) AS mean_cov, round(uniformity_100x, 6) AS uniformity_100x, worst_target FROM qc""",
)
def _sample_qc(t):
    return rounded(coverage.sample_qc(purchase_depth(t), read_counts(t)))


BASE_QC = with_sql("samples purchases", "").rstrip() + f", {DEPTH}, {QC}, {STATUS}"


@query("qc_status", BASE_QC + " SELECT sample, status, array_to_string(fail_reasons, ';') AS fail_reasons FROM st")
def _status(t):
    return sample_status(t).select("sample", "status", F.array_join("fail_reasons", ";").alias("fail_reasons"))


@query(
    "qc_pass_summary",
    BASE_QC
    + """ SELECT coalesce(cohort, 'Overall') AS cohort, count(*) AS n_samples, count(*) FILTER (status = 'PASS') AS n_pass,
    round(count(*) FILTER (status = 'PASS') * 100.0 / count(*)::DOUBLE, 6) AS pass_pct FROM st GROUP BY ROLLUP (cohort)""",
)
def _pass(t):
    return rounded(coverage.qc_pass_summary(sample_status(t), "cohort"))


@query(
    "failure_incidence",
    BASE_QC
    + """, e AS (SELECT cohort, unnest(fail_reasons) AS reason FROM st)
    SELECT cohort, reason, count(*) AS n FROM (SELECT * FROM e UNION ALL SELECT 'Overall', reason FROM e) GROUP BY 1, 2""",
)
def _incidence(t):
    return coverage.failure_incidence(sample_status(t), "cohort")


@query(
    "failure_combinations",
    BASE_QC
    + """ SELECT cohort, array_to_string(list_sort(fail_reasons), ' + ') AS combination, count(*) AS n FROM st
    WHERE len(fail_reasons) > 0 GROUP BY 1, 2""",
)
def _combos(t):
    return coverage.failure_combinations(sample_status(t), "cohort")


def cohort_depth(t):
    return purchase_depth(t).join(t.samples(), "sample")


DEPTH_BASE = with_sql("samples purchases", "").rstrip() + f", {DEPTH}, cd AS (SELECT * FROM depth JOIN samples USING (sample))"
AUDIT = """audit AS (SELECT target, cohort, avg(CASE WHEN depth < 30 THEN 1.0 ELSE 0.0 END) * 100 AS fail_pct, avg(depth) AS mean_depth,
    median(depth) AS median_depth FROM (SELECT target, cohort, depth FROM cd UNION ALL SELECT target, 'Global', depth FROM cd) GROUP BY 1, 2)"""


@query(
    "technical_audit",
    DEPTH_BASE + f""", {AUDIT} SELECT target, cohort, round(fail_pct, 6) AS fail_pct, round(mean_depth, 6) AS mean_depth,
      round(median_depth, 6) AS median_depth FROM audit""",
)
def _audit(t):
    return rounded(coverage.technical_audit(cohort_depth(t), 30.0))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "failure_pivot",
    DEPTH_BASE + f", {AUDIT} SELECT target, "
    + ", ".join(f"round(max(CASE WHEN cohort = '{c}' THEN fail_pct END), 6) AS \"{c}\"" for c in SEGMENTS)
    + " FROM audit GROUP BY 1",
)
def _pivot(t):
    return rounded(coverage.failure_pivot(coverage.technical_audit(cohort_depth(t), 30.0), SEGMENTS))


@query(
    "worst_cohort",
    DEPTH_BASE + f""", {AUDIT}, w AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY fail_pct DESC, cohort) AS rn,
      count(*) OVER (PARTITION BY target) AS n, count(*) FILTER (fail_pct > 0) OVER (PARTITION BY target) AS f FROM audit WHERE cohort <> 'Global')
    SELECT target, cohort AS worst_cohort, round(fail_pct, 6) AS worst_fail_pct, CASE WHEN f = 0 THEN 'none' WHEN f = n THEN 'everywhere'
      WHEN f = 1 THEN 'one_cohort' ELSE 'several_cohorts' END AS pattern FROM w WHERE rn = 1""",
)
def _worst(t):
    return rounded(coverage.worst_cohort(coverage.technical_audit(cohort_depth(t), 30.0)))


@query(
    "coverage_audit",
    DEPTH_BASE + """ SELECT sample, count(*) AS n_targets, count(depth) AS n_numeric, count(*) FILTER (depth = 0) AS n_zero,
      round(min(depth), 6) AS lowest_depth, count(*) FILTER (depth < 50) AS n_below_floor FROM depth GROUP BY 1""",
)
def _cov_audit(t):
    return rounded(coverage.coverage_audit(purchase_depth(t)))


@query(
    "recurrent_failures",
    DEPTH_BASE + """ SELECT target, count(*) FILTER (depth < 50) AS n_below, count(*) AS n_samples FROM depth GROUP BY 1
      HAVING count(*) FILTER (depth < 50) > 0 ORDER BY n_below DESC, target LIMIT 15""",
)
def _recurrent(t):
    return coverage.recurrent_failures(purchase_depth(t))
