"""Case-control comparisons: arms, carrier and genotype counts, burden, screening.

Healthy samples of every cohort form one pooled control arm. Counting happens once per
(cohort, tissue, key); the comparisons are then sums of those small counts, so a control
sample is never copied once per comparison.
"""

from pyspark.sql import Column, DataFrame, functions as F

from carrierlake.operators.contingency import fisher_2x2, odds_ratio
from carrierlake.operators.fdr import bh_fdr, block_fdr
from carrierlake.session import cut_lineage, spread

CASE, CONTROL, EVERY = "Tumour", "Healthy", "All"


def pooled_arms(
    counts: DataFrame, keys: list[str], values: list[str], sizes: DataFrame, cohort: str = "cohort", tissue: str = "tissue"
) -> DataFrame:
    """Sum per-(cohort, tissue, key) counts into ``case_*`` and ``control_*`` per comparison.

    Comparisons are those of ``sizes``: every cohort with cases, and ``All``. Controls are all healthy samples in each, so a key that
    only controls carry has a row in every comparison, with zero cases. Control counts are summed over cohorts before they are
    repeated, and both sides meet in one aggregate.
    """
    arm = F.when(F.col(tissue) == CASE, "case").when(F.col(tissue) == CONTROL, "control")
    small = counts.withColumn("_arm", arm).where(F.col("_arm").isNotNull()).withColumn(
        "_cohort", F.when(F.col("_arm") == "case", F.col(cohort))
    )
    small = small.groupBy("_arm", "_cohort", *keys).agg(*[F.sum(v).alias(v) for v in values])
    every = sizes.agg(F.collect_set("comparison").alias("_every")).withColumn("_one", F.lit(1))  # one row, the few comparisons
    own = F.when(F.col("_arm") == "case", F.array(F.col("_cohort"), F.lit(EVERY))).otherwise(F.col("_every"))
    rows = small.withColumn("_one", F.lit(1)).join(F.broadcast(every), "_one").withColumn("comparison", F.explode(own))
    of = lambda a, v: F.coalesce(F.sum(F.when(F.col("_arm") == a, F.col(v))), F.lit(0)).alias(f"{a}_{v}")
    return rows.groupBy("comparison", *keys).agg(*[of(a, v) for a in ("case", "control") for v in values])


def arm_sizes(samples: DataFrame, value: Column | None = None, name: str = "n") -> DataFrame:
    """Samples per comparison and arm: one row per cohort and one for ``All``.

    The per-cohort counts are a handful of rows, so they pass through one global aggregate.
    """
    sizes = samples.groupBy("cohort", "tissue").agg((F.count(F.lit(1)) if value is None else value).alias("_n"))
    is_case = F.col("tissue") == CASE
    folded = sizes.groupBy().agg(
        F.sum(F.when(F.col("tissue") == CONTROL, F.col("_n"))).alias(f"control_{name}"),
        F.sum(F.when(is_case, F.col("_n"))).alias("_all"),
        F.collect_list(F.when(is_case, F.struct("cohort", "_n"))).alias("_cohorts"),
    )
    every = F.struct(F.lit(EVERY).alias("cohort"), F.col("_all").alias("_n"))
    return folded.select(
        f"control_{name}", F.explode(F.concat("_cohorts", F.array(every))).alias("_row")
    ).select(
        F.col("_row.cohort").alias("comparison"), F.col("_row._n").alias(f"case_{name}"), f"control_{name}"
    )


def carrier_frequency(
    rows: DataFrame, sample: str, group: list[str], denominator: list[str], universe: DataFrame | None = None
) -> DataFrame:
    """Distinct carriers per group as a percentage of the distinct samples of its denominator group.

    ``universe`` is the frame before non-carriers were dropped; by default ``rows`` itself.
    """
    totals = (universe if universe is not None else rows).groupBy(*denominator).agg(
        F.countDistinct(sample).alias("total_samples")
    )
    carriers = rows.groupBy(*group).agg(F.countDistinct(sample).alias("carrier_count"))
    return carriers.join(totals, denominator, "left").withColumn(
        "carrier_pct", F.col("carrier_count") / F.col("total_samples") * 100.0
    )


def genotype_counts(calls: DataFrame, samples: DataFrame, variant: str = "variant", missing: DataFrame | None = None) -> DataFrame:
    """WT/Het/Hom per comparison, arm and variant with doses, difference and direction.

    ``calls`` holds ``(sample, variant, dosage)`` of carriers; a callable sample without a row is
    wild type, so the dense sample x variant table is never built. ``missing`` holds (sample, variant) without a usable call (no call,
    or below the depth limit): they leave the denominators of that variant only.
    """
    called = calls.select("sample", variant, "dosage")
    if missing is not None:
        called = called.unionByName(missing.select("sample", variant, F.lit(None).cast("int").alias("dosage")).distinct())
    carriers = (
        called.join(samples, "sample")
        .groupBy("cohort", "tissue", variant)
        .agg(
            F.count_if(F.col("dosage") == 1).alias("het"),
            F.count_if(F.col("dosage") == 2).alias("hom"),
            F.count_if(F.col("dosage").isNull()).alias("missing"),
        )
    )
    sized = arm_sizes(samples, name="callable")
    full = pooled_arms(carriers, [variant], ["het", "hom", "missing"], sized).join(sized, "comparison")
    for arm in ("case", "control"):
        full = full.withColumn(f"{arm}_callable", F.coalesce(F.col(f"{arm}_callable"), F.lit(0)) - F.col(f"{arm}_missing")).drop(f"{arm}_missing")
        n, het, hom = (F.col(f"{arm}_{x}") for x in ("callable", "het", "hom"))
        full = full.withColumn(f"{arm}_wt", n - het - hom).withColumn(
            f"{arm}_dose", F.try_divide((het + 2 * hom).cast("double"), n.cast("double"))
        ).withColumn(f"{arm}_carrier_pct", F.try_divide((het + hom) * 100.0, n.cast("double")))
    gap = F.col("case_dose") - F.col("control_dose")
    return full.withColumn("dose_difference", gap).withColumn("direction", dose_direction(gap))


def dose_direction(gap: Column, tolerance: float = 1e-9) -> Column:
    return (
        F.when(gap > tolerance, "Higher_in_case").when(gap < -tolerance, "Lower_in_case").otherwise("No_difference")
    )


def case_vs_control(
    carriers: DataFrame, samples: DataFrame, key: list[str], family: list[str],
    min_total: int = 3, min_case: int = 0,
) -> DataFrame:
    """Carrier screen: counts per comparison and key, odds ratio, exact p, FDR in ``family``.

    ``carriers`` holds ``(sample, *key)``, one row per carrying sample and key or more.
    """
    distinct = carriers.select("sample", *key).distinct().join(samples, "sample")
    counts = distinct.groupBy("cohort", "tissue", *key).agg(F.count(F.lit(1)).alias("carriers"))
    sizes = arm_sizes(samples)
    table = pooled_arms(counts, key, ["carriers"], sizes).join(sizes, "comparison")
    gated = table.where(
        (F.col("case_carriers") + F.col("control_carriers") >= min_total) & (F.col("case_carriers") >= min_case)
    )
    cells = gated.withColumn("case_rest", F.col("case_n") - F.col("case_carriers")).withColumn(
        "control_rest", F.col("control_n") - F.col("control_carriers")
    )
    names = ("case_carriers", "case_rest", "control_carriers", "control_rest")
    ratio = odds_ratio(*[F.col(x) for x in names])
    # The small table of tests is written once, so the scan behind it runs once.
    tested = fisher_2x2(cut_lineage(cells), names).select("*", ratio.alias("_or")).select("*", "_or.*").drop("_or")
    return bh_fdr(tested, "p_value", family)


def screened(counts: DataFrame, keys: list[str], samples: DataFrame) -> DataFrame:
    """Carrier counts per (cohort, tissue, key) as comparisons with odds ratio, exact p and FDR over the keys of a comparison."""
    sizes = arm_sizes(samples)
    table = pooled_arms(counts, keys, ["carriers"], sizes).join(sizes, "comparison")
    cells = table.withColumn("_cr", F.col("case_n") - F.col("case_carriers")).withColumn("_nr", F.col("control_n") - F.col("control_carriers"))
    names = ("case_carriers", "_cr", "control_carriers", "_nr")
    tested = fisher_2x2(cut_lineage(cells), names).withColumn("odds_ratio", odds_ratio(*[F.col(x) for x in names])["odds_ratio"])
    return bh_fdr(tested.drop("_cr", "_nr"), "p_value", ["comparison"])


def contrast_from_counts(counts: DataFrame, alt: str, family: list[str] | None = None, block: str | None = None, member: str = "variant") -> DataFrame:
    """Exact contrast of one genotype class (or ``carrier``) with WT from a stored count table.

    With ``family``, p values are adjusted inside it; with ``block`` too, inside each linkage block and over the family (``member`` names
    a test that has no block).
    """
    if alt == "carrier":
        case, control = F.col("case_het") + F.col("case_hom"), F.col("control_het") + F.col("control_hom")
    else:
        case, control = F.col(f"case_{alt}"), F.col(f"control_{alt}")
    cells = counts.select(
        "*", case.alias("_ca"), F.col("case_wt").alias("_cr"), control.alias("_na"), F.col("control_wt").alias("_nr")
    ).where((F.col("_ca") + F.col("_na") > 0) & (F.col("_cr") + F.col("_nr") > 0))
    names = ("_ca", "_cr", "_na", "_nr")
    share = lambda x, y: F.try_divide(F.col(x) * 100.0, (F.col(x) + F.col(y)).cast("double"))
    tested = (
        fisher_2x2(cells, names)
        .withColumn("odds_ratio", odds_ratio(*[F.col(x) for x in names])["odds_ratio"])
        .withColumn("difference_pct", share("_ca", "_cr") - share("_na", "_nr"))
        .withColumn("contrast", F.lit(alt))
        .drop(*names)
    )
    if block is not None:
        return block_fdr(tested, "p_value", family or [], block, member)
    return tested if family is None else bh_fdr(tested, "p_value", family)


def mask_burden(rows: DataFrame, samples: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """Carrier samples per comparison under each named mask, tested, from one pass over the rows."""
    entries = F.array(*[F.when(cond, F.lit(name)) for name, cond in masks.items()])
    hit = rows.select("sample", F.explode(F.array_compact(entries)).alias("mask")).distinct()
    counts = hit.join(samples, "sample").groupBy("cohort", "tissue", "mask").agg(F.count(F.lit(1)).alias("carriers"))
    return screened(counts, ["mask"], samples)


def hotspots(rows: DataFrame, samples: DataFrame, position: list[str], allele: str, min_carriers: int = 2) -> DataFrame:
    """Distinct carriers per comparison and position over all alleles, tested, with the observed alleles."""
    dealt, known = spread((rows.select("sample", *position, allele), ["sample"]), (samples, ["sample"]))
    distinct = dealt.distinct().join(known, "sample")
    alleles = distinct.select(*position, allele).distinct().groupBy(*position).agg(
        F.array_join(F.array_sort(F.collect_list(F.col(allele).cast("string"))), ",").alias("alleles")
    )
    people = distinct.select("sample", "cohort", "tissue", *position).distinct()
    counts = people.groupBy("cohort", "tissue", *position).agg(F.count(F.lit(1)).alias("carriers"))
    table = screened(counts, position, samples)
    return table.join(alleles, position).withColumn(
        "recurrent", F.col("case_carriers") + F.col("control_carriers") >= min_carriers
    )
