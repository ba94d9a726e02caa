"""Catalogues, summaries and quality of variant calls; annotation collapse and landscape tables."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from carrierlake.operators import compare
from carrierlake.functions import annotation
from carrierlake.functions.genotype import is_het, substitution_class
from carrierlake.functions.keys import null_if_token
from carrierlake.operators.ranking import known, quantiles, top_k
from carrierlake.session import cut_lineage

STATUSES = ["WT", "Het_ALT", "Hom_ALT", "Below_DP_threshold", "No_call", "Other_ALT_model"]


#: What ``collapse_annotations`` reads beside its key, order and frequency.
COLLAPSED = ["sample", "cohort", "dp", "af", "PICK", "CANONICAL", "MANE_SELECT", "IMPACT", "Consequence", "Feature"]


def first_examples(df: DataFrame, keys: list[str], value: str, k: int, out: str) -> DataFrame:
    """The first ``k`` distinct values per key as one joined string; never more than k are gathered."""
    distinct = df.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    return (
        top_k(distinct, keys, [F.col(value)], k)
        .groupBy(*keys)
        .agg(F.array_join(F.array_sort(F.collect_list(F.col(value).cast("string"))), "; ").alias(out))
    )


def joined_levels(df: DataFrame, keys: list[str], value: str, out: str, sep: str = "; ") -> DataFrame:
    """Distinct values of a short vocabulary (cohort, tissue, allele) joined per key."""
    return (
        df.select(*keys, value).where(F.col(value).isNotNull()).distinct()
        .groupBy(*keys)
        .agg(F.array_join(F.array_sort(F.collect_list(F.col(value).cast("string"))), sep).alias(out))
    )


def union_catalogue(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Locus and variant catalogues from rows (chrom, pos, ref, alt, sample, cohort, tissue)."""
    locus, variant = ["chrom", "pos", "ref"], ["chrom", "pos", "ref", "alt"]
    variants = (
        calls.groupBy(*variant).agg(F.countDistinct("sample").alias("n_samples"))
        .join(first_examples(calls, variant, "sample", 6, "example_samples"), variant, "left")
        .join(joined_levels(calls, variant, "cohort", "cohorts"), variant, "left")
        .join(joined_levels(calls, variant, "tissue", "tissues"), variant, "left")
    )
    alts = calls.select(*variant).distinct().groupBy(*locus).agg(
        F.array_join(F.array_sort(F.collect_list("alt")), ",").alias("alt_list"), F.count(F.lit(1)).alias("n_alt")
    )
    loci = (
        calls.groupBy(*locus).agg(F.countDistinct("sample").alias("n_samples_any"))
        .join(alts, locus)
        .join(first_examples(calls, locus, "sample", 6, "example_samples"), locus, "left")
        .withColumn("multi_allelic", F.col("n_alt") > 1)
    )
    return loci, variants


def status_counts(prefix: str = "n_") -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(prefix + s.lower()) for s in STATUSES]


def locus_summary(long: DataFrame, locus: list[str], examples: int = 8) -> DataFrame:
    """Status counts, mean and median depth per locus and the first carrier samples."""
    carriers = long.where(F.col("status").isin("Het_ALT", "Hom_ALT", "Other_ALT_model"))
    base = long.groupBy(*locus).agg(
        F.countDistinct("sample").alias("n_samples"), *status_counts(), F.round(F.avg("dp"), 2).alias("mean_dp")
    )
    median = quantiles(long.select(*locus, "dp"), locus, "dp", {"median_dp": 0.5}).drop("n")
    return base.join(median, locus, "left").join(
        first_examples(carriers, locus, "sample", examples, "carrier_samples"), locus, "left"
    ).fillna({"carrier_samples": ""})


def carriers_long(long: DataFrame, locus: list[str]) -> DataFrame:
    """All carriers, one row each: the complete list stays a table, however many there are."""
    return long.where(F.col("status").isin("Het_ALT", "Hom_ALT", "Other_ALT_model")).select(*locus, "sample", "status").distinct()


def sample_summary(long: DataFrame, locus: str, keys: list[str]) -> DataFrame:
    """Loci, status counts, mean and median depth per sample, in one aggregate: rows dealt by some of the keys stay where they are.

    The median is exact: a sample keeps one count per distinct depth. Where a key is null there is no median.
    """
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    summary = long.groupBy(*keys).agg(
        F.countDistinct(locus).alias("n_loci"), *status_counts(), F.round(F.avg("dp"), 2).alias("mean_dp"),
        F.percentile(F.when(known("dp"), F.col("dp").cast("double")), 0.5).alias("median_dp"),
    )
    return summary.withColumn("median_dp", F.when(whole, F.col("median_dp")))


def cell_totals(long: DataFrame) -> DataFrame:
    return long.groupBy("status").agg(F.count(F.lit(1)).alias("cells"))


def grid_completion(samples: DataFrame, loci: DataFrame, calls: DataFrame, sample: str, locus: str) -> dict[str, DataFrame]:
    """The sample x locus grid in sparse form: called and missing cells per locus and per sample.

    Every missing cell is a ``./.``; their number follows from the two totals, so the dense
    grid, which is the product of both tables, is never produced.
    """
    known = calls.select(sample, locus).distinct().join(samples.select(sample).distinct(), sample, "left_semi").join(
        loci.select(locus).distinct(), locus, "left_semi"
    )
    n_samples = samples.select(F.countDistinct(sample).alias("_total"))
    n_loci = loci.select(F.countDistinct(locus).alias("_total"))

    def side(table: DataFrame, key: str, total: DataFrame) -> DataFrame:
        counts = known.groupBy(key).agg(F.count(F.lit(1)).alias("called"))
        size = total.first()[0]
        return (
            table.select(key).distinct().join(counts, key, "left").fillna({"called": 0})
            .withColumn("missing", F.lit(size).cast("bigint") - F.col("called"))
        )

    return {"locus": side(loci, locus, n_samples), "sample": side(samples, sample, n_loci)}


def representative_row(df: DataFrame, keys: list[str], fields: list[str], ordinal: str) -> DataFrame:
    """One transcript row per key: PICK, CANONICAL, MANE, impact, consequence, then input order."""
    pick, canonical = annotation.yes_flag(F.col("PICK")), annotation.yes_flag(F.col("CANONICAL"))
    mane = null_if_token(F.col("MANE_SELECT")).isNotNull()
    rank = F.struct(
        (~pick).alias("r1"), (~canonical).alias("r2"), (~mane).alias("r3"),
        annotation.impact_rank(F.col("IMPACT")).alias("r4"),
        annotation.consequence_rank(annotation.worst_consequence(F.col("Consequence"))).alias("r5"),
        F.col(ordinal).alias("r6"),
    )
    basis = (
        F.when(pick, "picked_transcript").when(canonical, "canonical_transcript").when(mane, "mane_transcript")
        .otherwise("worst_available_transcript")
    )
    row = F.struct(*fields, basis.alias("basis"))
    best = df.groupBy(*keys).agg(F.min_by(row, rank).alias("_row"))
    return best.select(*keys, "_row.*")


def collapse_annotations(df: DataFrame, key: str, ordinal: str, frequency: str, threshold: float = 0.01) -> DataFrame:
    """One record per variant from transcript-expanded rows: sample-level means first, then the variant.

    The rows are written once: five aggregates read them, and would each repeat the joins that expand them.
    """
    df = cut_lineage(df.select(key, ordinal, frequency, *[c for c in COLLAPSED if c not in (key, ordinal, frequency)]))
    per_sample = df.groupBy(key, "sample").agg(F.avg("dp").alias("dp"), F.avg("af").alias("af"))
    means = per_sample.groupBy(key).agg(
        F.count("sample").alias("n_samples"), F.avg("dp").alias("mean_dp"), F.avg("af").alias("mean_af")
    )
    totals = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_transcript_rows"), F.max(frequency).alias("max_frequency"))
    rep = representative_row(df, [key], ["Consequence", "IMPACT", "Feature"], ordinal)
    worst = annotation.worst_consequence(F.col("Consequence"))
    impact = F.coalesce(F.nullif(F.upper(F.trim("IMPACT")), F.lit("")), annotation.infer_impact(worst))
    return (
        means.join(totals, key)
        .join(rep, key)
        .join(joined_levels(df, [key], "cohort", "cohorts"), key, "left")
        .join(joined_levels(df, [key], "Consequence", "consequences"), key, "left")
        .select(
            key, "n_samples", "mean_dp", "mean_af", "n_transcript_rows", "max_frequency",
            F.coalesce(F.col("max_frequency") >= threshold, F.lit(False)).alias("common"),
            "cohorts", "consequences", worst.alias("worst_term"),
            annotation.functional_class(worst).alias("functional_class"), impact.alias("impact"),
            F.col("Feature").alias("transcript"), "basis",
        )
    )


def titv(calls: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """Transitions, transversions, ratio and band over distinct calls."""
    distinct = calls.select(*group, *[k for k in keys if k not in group]).distinct()
    kind = substitution_class(F.col("ref"), F.col("alt"))
    counts = distinct.groupBy(*group).agg(
        F.count_if(kind == "ti").alias("ti"), F.count_if(kind == "tv").alias("tv"),
        F.count_if(kind.isNull()).alias("skipped"),
    )
    ratio = F.try_divide(F.col("ti").cast("double"), F.col("tv").cast("double"))
    return counts.withColumn("ratio", ratio).withColumn(
        "status",
        F.when(F.col("tv") == 0, "FAIL_NO_TV")
        .when(F.col("ratio") < 1.5, "FAIL")
        .when(F.col("ratio") > 3.0, "WARN")
        .when(F.col("ratio").between(2.0, 2.1), "OPTIMAL")
        .otherwise("ACCEPTABLE"),
    )


def balance_summary(calls: DataFrame, group: list[str], quality: Column, warn_pct: float = 20.0) -> DataFrame:
    """Classes of heterozygous balance per group and the share flagged."""
    out = calls.withColumn("_q", quality).groupBy(*group).agg(
        F.count_if(is_het(F.col("gt"))).alias("n_het"),
        *[F.count_if(F.col("_q") == q).alias("n_" + q.lower()) for q in ("OPTIMAL", "ACCEPTABLE", "POOR", "NO_DATA")],
    )
    share = F.try_divide(F.col("n_poor") * 100.0, F.col("n_het"))
    return out.withColumn("pct_flagged", share).withColumn("warn", F.coalesce(share > warn_pct, F.lit(False)))


def batch_cv(calls: DataFrame, group: list[str], sample: str = "sample") -> DataFrame:
    """Spread of variants per sample inside each group."""
    per = calls.groupBy(*group, sample).agg(F.count(F.lit(1)).alias("n"))
    stats = per.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg("n").alias("mean"),
        F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("sd"), F.min("n").alias("least"), F.max("n").alias("most"),
    )
    median = quantiles(per.select(*group, F.col("n").alias("v")), group, "v", {"median": 0.5}).drop("n")
    cv = F.coalesce(F.try_divide(F.col("sd") * 100.0, F.col("mean")), F.lit(0.0))
    return stats.join(median, group).withColumn("cv_pct", cv).withColumn(
        "band",
        F.when(cv < 15, "EXCELLENT").when(cv < 30, "ACCEPTABLE").when(cv < 50, "HIGH VARIATION").otherwise("VERY HIGH VAR"),
    )


def crosstab(df: DataFrame, row: str, column: str, levels: list[str], unique: list[str] | None = None) -> DataFrame:
    """Counts of two labels with every level present; ``unique`` counts distinct keys instead of rows."""
    source = df if unique is None else df.select(row, column, *unique).distinct()
    return source.groupBy(row).pivot(column, levels).agg(F.count(F.lit(1))).fillna(0)


def landscape_summary(counts: DataFrame, annotations: DataFrame, frequency: Column, threshold: float) -> DataFrame:
    """Carrier and genotype percentages per cohort, tissue and variant with the class of the variant.

    ``counts``: cohort, tissue, variant, n_callable, n_wt, n_het, n_hom.
    """
    share = lambda c: F.try_divide(F.col(c) * 100.0, F.col("n_callable"))
    common = F.coalesce(frequency > threshold, F.lit(False))
    return counts.join(annotations, "variant", "left").select(
        *counts.columns,
        *[share(f"n_{g}").alias(f"{g}_pct") for g in ("wt", "het", "hom")],
        F.try_divide((F.col("n_het") + F.col("n_hom")) * 100.0, F.col("n_callable")).alias("carrier_pct"),
        F.when(common, "Established_SNP").otherwise("Lower_Frequency_Mutation").alias("variant_class"),
        *[c for c in annotations.columns if c != "variant"],
    )


def genotype_points(summary: DataFrame) -> DataFrame:
    """Long (genotype, count, percentage) rows of the landscape."""
    rows = F.inline(F.array(*[
        F.struct(F.lit(g.upper() if g == "wt" else g.capitalize()).alias("genotype"),
                 F.col(f"n_{g}").alias("count"), F.col(f"{g}_pct").alias("pct"))
        for g in ("wt", "het", "hom")
    ]))
    return summary.select("cohort", "tissue", "variant", rows)


def label_ranking(summary: DataFrame, label: str, condition: Column) -> DataFrame:
    """Labels by their highest carrier percentage; the first row is the stand-out label."""
    ranked = summary.where(condition & F.col(label).isNotNull()).groupBy(label).agg(F.max("carrier_pct").alias("top_pct"))
    return ranked.orderBy(F.desc("top_pct"), F.asc(label))


def status_direction(tests: DataFrame) -> DataFrame:
    """Add shared / one-arm status and the direction of the frequency difference."""
    case, control = F.col("case_carriers"), F.col("control_carriers")
    gap = F.try_divide(case * 100.0, F.col("case_n")) - F.try_divide(control * 100.0, F.col("control_n"))
    return tests.withColumn(
        "variant_status",
        F.when((case > 0) & (control > 0), "shared").when(case > 0, "tumour_only").otherwise("normal_only"),
    ).withColumn("difference_pct", gap).withColumn(
        "direction",
        F.when(gap.isNull(), "Not estimable").when(gap < -1e-9, "Lower in tumour").when(gap > 1e-9, "Higher in tumour")
        .otherwise("Same frequency"),
    )


def status_summary(tests: DataFrame, family: str, key: str, p: str, q: str) -> DataFrame:
    """Per family: status and direction counts, significant counts and the best hit."""
    shared = F.col("variant_status") == "shared"
    best = F.min(F.struct(F.col(p).isNull().alias("n"), F.col(p).alias("p"), F.col(key).alias("k"),
                          F.col("direction").alias("d"), F.col(q).alias("q")))
    out = tests.groupBy(family).agg(
        F.count_if(F.col("variant_status") == "tumour_only").alias("tumour_only"),
        F.count_if(F.col("variant_status") == "normal_only").alias("normal_only"),
        F.count_if(shared).alias("shared"),
        F.count_if(shared & (F.col("direction") == "Lower in tumour")).alias("shared_lower"),
        F.count_if(shared & (F.col("direction") == "Higher in tumour")).alias("shared_higher"),
        F.count_if(F.col(p) < 0.05).alias("raw_hits"),
        F.count_if(F.col(q) < 0.05).alias("fdr_hits"),
        best.alias("_b"),
    )
    return out.select(
        *[c for c in out.columns if c != "_b"], F.col("_b.k").alias("best_key"), F.col("_b.p").alias("best_p"),
        F.col("_b.q").alias("best_fdr"), F.col("_b.d").alias("best_direction"),
    )


def locus_class(df: DataFrame, locus: str, frequency: str, threshold: float = 0.01) -> DataFrame:
    """common when every allele of the locus is common, rare when none is, else mixed."""
    common = F.coalesce(F.col(frequency) > threshold, F.lit(False))
    grouped = df.groupBy(locus).agg(F.bool_and(common).alias("_all"), F.bool_or(common).alias("_any"))
    return grouped.select(
        locus, F.when(F.col("_all"), "common").when(~F.col("_any"), "rare").otherwise("mixed").alias("frequency_class")
    )


def pivot_wide(df: DataFrame, rows: list[str], column: str, levels: list, value: str) -> DataFrame:
    """Wide export of a long table; the levels are given, so no extra pass finds them."""
    return df.groupBy(*rows).pivot(column, levels).agg(F.first(value))


def qc_sensitivity(calls: DataFrame, samples: DataFrame, high_qc: DataFrame, key: str = "variant") -> DataFrame:
    """Carrier percentages of every comparison in all samples and in those of high quality, side by side.

    ``high_qc``: sample, one row each. Both sets are counted in one pass over the carriers. ``direction`` compares cases with controls
    (a difference up to 1e-9 is none); it is not estimable where an arm has no sample left. ``agrees`` is null in that case.
    """
    marked = samples.join(high_qc.select("sample", F.lit(1).alias("_high")), "sample", "left").withColumn("_high", F.coalesce("_high", F.lit(0)))
    of = lambda name: [F.count(F.lit(1)).alias(name), F.sum("_high").alias(f"{name}_high")]
    carriers = calls.select("sample", key).distinct().join(marked, "sample").groupBy("cohort", "tissue", key).agg(*of("carriers"))
    sizes = marked.groupBy("cohort", "tissue").agg(*of("n"))
    comparisons = compare.arm_sizes(samples)
    table = compare.pooled_arms(carriers, [key], ["carriers", "carriers_high"], comparisons).join(compare.pooled_arms(sizes, [], ["n", "n_high"], comparisons), "comparison")
    columns = []
    for suffix in ("", "_high"):
        case, control = (F.try_divide(F.col(f"{arm}_carriers{suffix}") * 100.0, F.col(f"{arm}_n{suffix}")) for arm in ("case", "control"))
        delta = case - control
        way = F.when(delta < -1e-9, "Lower in tumour").when(delta > 1e-9, "Higher in tumour").when(delta.isNotNull(), "Same frequency").otherwise("Not estimable")
        columns += [case.alias(f"case_pct{suffix}"), control.alias(f"control_pct{suffix}"), delta.alias(f"difference_pct{suffix}"), way.alias(f"direction{suffix}")]
    sides = [F.col(f"{arm}_n{suffix}") for arm in ("case", "control") for suffix in ("", "_high")]
    known = F.col("difference_pct").isNotNull() & F.col("difference_pct_high").isNotNull()
    return table.select("comparison", key, *sides, *columns).withColumn("agrees", F.when(known, F.col("direction") == F.col("direction_high")))
