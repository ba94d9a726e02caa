"""Sequencing depth roll-ups: sample QC, target failure audits, status incidence."""

from pyspark.sql import Column, DataFrame, functions as F

from carrierlake.operators.ranking import quantiles

# Lower limits of the sample QC.
QC_LIMITS = {"total_reads": 120000, "mapped_pct": 90, "on_target_pct": 75, "mean_cov": 200, "uniformity_100x": 95}


def sample_qc(depth: DataFrame, counts: DataFrame, floor: float = 100.0) -> DataFrame:
    """Length-weighted mean depth, share of targets at the floor, worst target and mapped shares.

    ``depth``: sample, target, length, depth. ``counts``: sample, total_reads, mapped_reads,
    on_target_reads.
    """
    worst = F.min(F.struct("depth", "target"))["target"]
    per_sample = depth.groupBy("sample").agg(
        (F.sum(F.col("length") * F.col("depth")) / F.sum("length")).alias("mean_cov"),
        (F.avg((F.col("depth") >= floor).cast("double")) * 100.0).alias("uniformity_100x"),
        worst.alias("worst_target"),
    )
    return counts.join(per_sample, "sample", "left").select(
        "sample",
        "total_reads",
        F.try_divide(F.col("mapped_reads") * 100.0, F.col("total_reads")).alias("mapped_pct"),
        F.try_divide(F.col("on_target_reads") * 100.0, F.col("mapped_reads")).alias("on_target_pct"),
        "mean_cov",
        "uniformity_100x",
        "worst_target",
    )


def qc_status(df: DataFrame, limits: dict[str, float] = QC_LIMITS) -> DataFrame:
    """PASS or FAIL with the array of limits missed."""
    reasons = F.array_compact(
        F.array(*[F.when(F.col(c).isNull() | (F.col(c) < limit), F.lit(c)) for c, limit in limits.items()])
    )
    return df.withColumn("fail_reasons", reasons).withColumn(
        "status", F.when(F.size("fail_reasons") == 0, "PASS").otherwise("FAIL")
    )


def coverage_flag(pct_zero: Column, pct_low: Column, zero_limit: float, low_limit: float) -> Column:
    return F.when(pct_zero > zero_limit, "FAIL_ZERO").when(pct_low > low_limit, "WARN_LOW").otherwise("PASS")


def zero_coverage_report(
    cells: DataFrame, zero_limit: float = 5.0, low_limit: float = 20.0, qc: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Amplicon, sample and problem tables from (cohort, sample, amplicon) cells of the overlap step."""
    measures = lambda n: [
        F.count(F.lit(1)).alias(n),
        F.avg("pct_zero").alias("mean_pct_zero"),
        F.max("pct_zero").alias("max_pct_zero"),
        F.count_if(F.col("zero_bases") > 0).alias("n_any_zero"),
        F.avg("pct_low").alias("mean_pct_low"),
        F.max("pct_low").alias("max_pct_low"),
        F.count_if(F.col("low_bases") > 0).alias("n_any_low"),
        F.sum("zero_bases").alias("total_zero"),
        F.sum("low_bases").alias("total_low"),
    ]
    flag = coverage_flag(F.col("mean_pct_zero"), F.col("mean_pct_low"), zero_limit, low_limit).alias("flag")
    amplicon = cells.groupBy("cohort", "amplicon_id").agg(*measures("n_samples")).select("*", flag)
    sample = cells.groupBy("cohort", "sample").agg(*measures("n_amplicons")).select("*", flag)
    problem = cells.where((F.col("pct_zero") > zero_limit) | (F.col("pct_low") > low_limit)).withColumn(
        "flag", F.when(F.col("pct_zero") > zero_limit, "FAIL_ZERO").otherwise("WARN_LOW")
    )
    if qc is not None:
        sample, problem = sample.join(qc, "sample", "left"), problem.join(qc, "sample", "left")
    return {"amplicon": amplicon, "sample": sample, "problem": problem}


def technical_audit(depth: DataFrame, floor: float, target: str = "target", cohort: str = "cohort") -> DataFrame:
    """Failure share, mean and median depth per target, overall and per cohort (long form)."""
    failed = (F.col("depth") < floor).cast("double")
    measures = [(F.avg(failed) * 100.0).alias("fail_pct"), F.avg("depth").alias("mean_depth")]
    overall = depth.groupBy(target).agg(*measures).withColumn(cohort, F.lit("Global"))
    each = depth.groupBy(target, cohort).agg(*measures)
    keyed = depth.select(target, cohort, "depth")
    medians = quantiles(keyed, [target, cohort], "depth", {"median_depth": 0.5}).unionByName(
        quantiles(keyed, [target], "depth", {"median_depth": 0.5}).withColumn(cohort, F.lit("Global"))
    )
    return overall.unionByName(each).join(medians.drop("n"), [target, cohort], "left")


def failure_pivot(audit: DataFrame, cohorts: list[str], target: str = "target", cohort: str = "cohort") -> DataFrame:
    """One row per target, one failure column per cohort."""
    return audit.groupBy(target).pivot(cohort, cohorts).agg(F.first("fail_pct"))


def qc_pass_summary(samples: DataFrame, group: str) -> DataFrame:
    """Samples, passes and pass share per group, plus an Overall row."""
    return (
        samples.rollup(group)
        .agg(
            F.count(F.lit(1)).alias("n_samples"),
            F.count_if(F.col("status") == "PASS").alias("n_pass"),
            F.grouping(group).alias("_all"),
        )
        .withColumn(group, F.when(F.col("_all") == 1, "Overall").otherwise(F.col(group)))
        .withColumn("pass_pct", F.col("n_pass") * 100.0 / F.col("n_samples"))
        .drop("_all")
    )


def failure_incidence(samples: DataFrame, group: str) -> DataFrame:
    """How often each reason occurs, per group and Overall."""
    exploded = samples.select(group, F.explode("fail_reasons").alias("reason"))
    return (
        exploded.select(F.explode(F.array(F.col(group), F.lit("Overall"))).alias(group), "reason")
        .groupBy(group, "reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def failure_combinations(samples: DataFrame, group: str) -> DataFrame:
    """How often each sorted set of reasons occurs."""
    combo = F.array_join(F.array_sort("fail_reasons"), " + ")
    return (
        samples.where(F.size("fail_reasons") > 0).groupBy(group, combo.alias("combination")).agg(F.count(F.lit(1)).alias("n"))
    )


def coverage_audit(depth: DataFrame, floor: float = 50.0) -> DataFrame:
    """Per sample: targets, readable depths, zeros, lowest depth and targets under the floor."""
    return depth.groupBy("sample").agg(
        F.count(F.lit(1)).alias("n_targets"),
        F.count("depth").alias("n_numeric"),
        F.count_if(F.col("depth") == 0).alias("n_zero"),
        F.min("depth").alias("lowest_depth"),
        F.count_if(F.col("depth") < floor).alias("n_below_floor"),
    )


def recurrent_failures(depth: DataFrame, floor: float = 50.0, k: int = 15, target: str = "target") -> DataFrame:
    """The targets with the most samples under the floor."""
    counts = depth.groupBy(target).agg(
        F.count_if(F.col("depth") < floor).alias("n_below"), F.count(F.lit(1)).alias("n_samples")
    )
    return counts.where("n_below > 0").orderBy(F.desc("n_below"), F.asc(target)).limit(k)


def worst_cohort(audit: DataFrame, target: str = "target", cohort: str = "cohort") -> DataFrame:
    """Cohort with the highest failure share per target, ties by name, and the pattern of the target."""
    rows = audit.where(F.col(cohort) != "Global")
    best = F.min(F.struct((-F.col("fail_pct")).alias("neg"), F.col(cohort)))
    out = rows.groupBy(target).agg(
        best.alias("_best"), F.count_if(F.col("fail_pct") > 0).alias("n_failing"), F.count(F.lit(1)).alias("n_cohorts")
    )
    return out.select(
        target,
        F.col(f"_best.{cohort}").alias("worst_cohort"),
        (-F.col("_best.neg")).alias("worst_fail_pct"),
        F.when(F.col("n_failing") == 0, "none")
        .when(F.col("n_failing") == F.col("n_cohorts"), "everywhere")
        .when(F.col("n_failing") == 1, "one_cohort")
        .otherwise("several_cohorts")
        .alias("pattern"),
    )
