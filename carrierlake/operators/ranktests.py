"""Rank tests per key, computed from counts of distinct values rather than from rows."""

from pyspark.sql import Column, DataFrame, functions as F

from carrierlake.functions.pvalues import chi_square_p, normal_p, student_p
from carrierlake.operators.fdr import bh_fdr
from carrierlake.operators.ranking import known, quantiles, running_totals, value_ranks
from carrierlake.session import cut_lineage



def mann_whitney(df: DataFrame, keys: list[str], value: str, flag: str, min_arm: int = 1) -> DataFrame:
    """Carrier against rest per key: U, tie-corrected normal p with continuity, medians, quartiles,
    rank-biserial effect. ``flag`` is boolean; rows with a null value or flag are left out.
    """
    valid = df.where(known(value) & F.col(flag).isNotNull())
    distinct = valid.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(flag)).alias("_n1")
    )
    ranked = running_totals(distinct, keys, value, {"rows": F.col("_n")})
    rank = F.col("rows_upto") - (F.col("_n") - 1) / 2.0
    cubes = F.pow(F.col("_n").cast("double"), F.lit(3.0)) - F.col("_n")
    sums = ranked.groupBy(*keys).agg(
        F.sum("_n1").alias("n1"), F.sum("_n").alias("_all"), F.sum(F.col("_n1") * rank).alias("_r1"), F.sum(cubes).alias("_ties")
    )
    tested = _u_statistic(sums.withColumn("n2", F.col("_all") - F.col("n1")).where((F.col("n1") >= min_arm) & (F.col("n2") >= min_arm)))
    probs = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    split = quantiles(valid.select(*keys, flag, value), [*keys, flag], value, probs)
    wide = split.groupBy(*keys).agg(
        *[F.max(F.when(F.col(flag) == side, F.col(q))).alias(f"{q}_{name}") for side, name in ((True, "carrier"), (False, "rest")) for q in probs]
    )
    return tested.join(wide, keys)


def _u_statistic(sums: DataFrame) -> DataFrame:
    """From n1, n2, rank sum ``_r1``, total ``_all`` and tie term ``_ties``."""
    n1, n2, n = F.col("n1").cast("double"), F.col("n2").cast("double"), F.col("_all").cast("double")
    u = F.col("_r1") - n1 * (n1 + 1) / 2.0
    variance = n1 * n2 / 12.0 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1)))
    z = F.greatest(F.try_divide(F.abs(u - n1 * n2 / 2.0) - 0.5, F.sqrt(variance)), F.lit(0.0))
    keep = [c for c in sums.columns if not c.startswith("_")]
    return sums.select(*keep, u.alias("u"), (1 - 2 * u / (n1 * n2)).alias("rank_biserial"), z.alias("_z")).select(
        *keep, "u", "rank_biserial", normal_p("_z").alias("p_value")
    )


def carrier_rank_tests(values: DataFrame, carriers: DataFrame, outcome: list[str], exposure: str, value: str = "value", min_arm: int = 3) -> DataFrame:
    """Mann-Whitney of every exposure against every outcome from carrier rows only.

    The outcome is ranked once; an exposure's rank sum needs just its carriers, and the rest
    follows from the totals, so samples x exposures x outcomes is never built.
    """
    ranks = value_ranks(values, outcome, value)
    cubes = F.pow(F.col("ties").cast("double"), F.lit(3.0)) - F.col("ties")
    totals = ranks.groupBy(*outcome).agg(F.max("n").alias("_all"), F.sum(cubes).alias("_ties"))
    rows = values.where(F.col(value).isNotNull()).join(carriers.select("sample", exposure).distinct(), "sample")
    # Carriers per distinct value first, so that the rank table meets counts and not rows.
    counted = rows.groupBy(exposure, *outcome, value).agg(F.count(F.lit(1)).alias("_k"))
    sums = (
        counted.join(ranks.select(*outcome, value, "avg_rank"), [*outcome, value])
        .groupBy(exposure, *outcome)
        .agg(F.sum("_k").alias("n1"), F.sum(F.col("_k") * F.col("avg_rank")).alias("_r1"))
        .join(totals, outcome)
        .withColumn("n2", F.col("_all") - F.col("n1"))
        .where((F.col("n1") >= min_arm) & (F.col("n2") >= min_arm))
    )
    return _u_statistic(sums)


def dose_spearman(values: DataFrame, carriers: DataFrame, outcome: list[str], exposure: str, dose: str = "dosage", value: str = "value", least: int = 3) -> DataFrame:
    """Spearman of dose against outcome per exposure, from carrier rows only.

    Samples without a carrier row have dose 0 and are one tie group. Centred outcome ranks add up to zero, so the group's share is minus
    the carriers' rank sum; its own rank, and the spread of the dose ranks, follow from its size. The outcome is ranked once for all
    exposures. Kept where at least two dose classes have ``least`` samples and four samples take part.
    """
    ranks = value_ranks(values, outcome, value)
    cubes = F.pow(F.col("ties").cast("double"), F.lit(3.0)) - F.col("ties")
    totals = ranks.groupBy(*outcome).agg(F.max("n").cast("double").alias("_n"), F.sum(cubes).alias("_ties"))
    centred = ranks.select(*outcome, value, (F.col("avg_rank") - (F.col("n") + 1) / 2.0).alias("_ry"))
    rows = values.where(known(value)).join(carriers.select("sample", exposure, dose), "sample")
    counted = rows.groupBy(exposure, *outcome, dose, value).agg(F.count(F.lit(1)).cast("double").alias("_k"))
    per_dose = cut_lineage(counted.join(centred, [*outcome, value]).groupBy(exposure, *outcome, dose).agg(F.sum("_k").alias("_m"), F.sum(F.col("_k") * F.col("_ry")).alias("_r")))
    # One row per copy number and key; the zero group starts the order.
    ordered = running_totals(per_dose, [exposure, *outcome], dose, {"rows": F.col("_m")}).join(totals, outcome)
    zero = F.col("_n") - F.col("rows_total")
    rank = zero + F.col("rows_upto") - (F.col("_m") - 1) / 2.0 - (F.col("_n") + 1) / 2.0
    ground = (zero - F.col("_n")) / 2.0
    sums = ordered.select("*", zero.alias("_zero"), rank.alias("_rx"), ground.alias("_rz")).groupBy(exposure, *outcome).agg(
        F.first("_n").alias("_n"), F.first("_ties").alias("_ties"), F.first("_zero").alias("_zero"), F.first("_rz").alias("_rz"),
        F.sum((F.col("_rx") - F.col("_rz")) * F.col("_r")).alias("_xy"), F.sum(F.col("_m") * F.col("_rx") * F.col("_rx")).alias("_xx"), F.count_if(F.col("_m") >= least).alias("_classes"),
    )
    n = F.col("_n")
    spread = (F.col("_xx") + F.col("_zero") * F.col("_rz") * F.col("_rz")) * (n * n * n - n - F.col("_ties")) / 12.0
    rho = clamped(F.try_divide(F.col("_xy"), F.sqrt(spread)))
    enough = (F.col("_classes") + F.when(F.col("_zero") >= least, 1).otherwise(0) >= 2) & (n >= 4)
    out = sums.where(enough).select(exposure, *outcome, n.cast("bigint").alias("n"), rho.alias("rho")).where(F.col("rho").isNotNull())
    return out.withColumn("p_value", correlation_p("rho", "n"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, min_n: int = 3) -> DataFrame:
    """Rank correlation per key with its Student p; null when either side is constant."""
    valid = df.where(known(x, y))
    cells = valid.groupBy(*keys, x, y).agg(F.count(F.lit(1)).cast("double").alias("_w"))

    def ranks(column: str, out: str) -> DataFrame:
        distinct = cells.groupBy(*keys, column).agg(F.sum("_w").alias("_n"))
        ranked = running_totals(distinct, keys, column, {"rows": F.col("_n")})
        centre = (F.col("rows_total") + 1) / 2.0
        return ranked.select(*keys, column, (F.col("rows_upto") - (F.col("_n") - 1) / 2.0 - centre).alias(out))

    joined = cells.join(ranks(x, "_rx"), [*keys, x]).join(ranks(y, "_ry"), [*keys, y])
    w = F.col("_w")
    sums = joined.groupBy(*keys).agg(
        F.sum(w).alias("_n"), F.sum(w * F.col("_rx") * F.col("_ry")).alias("_xy"),
        F.sum(w * F.col("_rx") * F.col("_rx")).alias("_xx"), F.sum(w * F.col("_ry") * F.col("_ry")).alias("_yy"),
    )
    rho = clamped(F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy"))))
    out = sums.where(F.col("_n") >= min_n).select(*keys, F.col("_n").cast("bigint").alias("n"), rho.alias("rho"))
    return out.withColumn("p_value", correlation_p("rho", "n"))


def clamped(r: Column) -> Column:
    """A correlation kept between -1 and 1; null stays null (``least`` alone would skip it)."""
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def correlation_p(r: str, n: str):
    """Student p of a correlation; 0 for a perfect one."""
    dof = F.col(n) - 2.0
    t = F.col(r) * F.sqrt(F.try_divide(dof, 1 - F.col(r) * F.col(r)))
    return F.when((F.abs(F.col(r)) >= 1) & (dof > 0), F.lit(0.0)).when(dof > 0, student_p(t, dof))


def kruskal(df: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """H with tie correction per key over any number of groups."""
    valid = df.where(known(value) & F.col(group).isNotNull())
    cells = valid.groupBy(*keys, value, group).agg(F.count(F.lit(1)).alias("_k"))
    distinct = cells.groupBy(*keys, value).agg(F.sum("_k").alias("_n"))
    ranked = running_totals(distinct, keys, value, {"rows": F.col("_n")})
    rank = (F.col("rows_upto") - (F.col("_n") - 1) / 2.0).alias("_rank")
    cubes = F.pow(F.col("_n").cast("double"), F.lit(3.0)) - F.col("_n")
    ties = ranked.groupBy(*keys).agg(F.sum(cubes).alias("_ties"), F.max("rows_total").cast("double").alias("_all"))
    per_group = (
        cells.join(ranked.select(*keys, value, rank), [*keys, value])
        .groupBy(*keys, group)
        .agg(F.sum("_k").alias("_ng"), F.sum(F.col("_k") * F.col("_rank")).alias("_rg"))
    )
    sums = per_group.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("_rg") * F.col("_rg") / F.col("_ng")).alias("_q")
    ).join(ties, keys)
    n = F.col("_all")
    h = F.try_divide(12.0 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1), 1 - F.col("_ties") / (n * n * n - n))
    out = sums.where("n_groups >= 2").select(*keys, n.cast("bigint").alias("n"), "n_groups", h.alias("h"))
    return out.withColumn("p_value", chi_square_p(F.col("h"), F.col("n_groups") - 1.0))


def typed_association(values: DataFrame, outcomes: DataFrame, keys: list[str], family: list[str], least: int = 10, min_arm: int = 5, min_group: int = 3) -> DataFrame:
    """Every measured value against every outcome by the outcome's declared kind, with one FDR per ``family``.

    ``values``: sample, keys, value. ``outcomes``: sample, outcome, kind, answer (text). Continuous answers go to Spearman, binary ones (0 or
    1, others are left out) to Mann-Whitney with the difference of medians as effect, nominal ones to Kruskal-Wallis over groups of at
    least ``min_group`` samples. A pair needs ``least`` samples with both sides known, a binary one ``min_arm`` on each side. Pairs whose
    test is undefined (one side constant) are left out. ``n`` counts the samples that entered the test.
    """
    pair = [*keys, "outcome"]
    answered = outcomes.where(F.col("answer").isNotNull()).select("sample", "outcome", "kind", "answer")
    rows = cut_lineage(values.where(known("value")).join(answered, "sample").select(*pair, "kind", F.col("value").cast("double").alias("value"), "answer"))
    enough = rows.groupBy(*pair).agg(F.count(F.lit(1)).alias("_known")).where(F.col("_known") >= least).select(*pair)
    of = lambda kind: rows.where(F.col("kind") == kind)
    number = F.col("answer").try_cast("double")
    named = lambda df, kind, test, n, effect: df.select(*pair, F.lit(kind).alias("kind"), F.lit(test).alias("test"), n.cast("bigint").alias("n"), effect.alias("effect"), "p_value")
    ranked = spearman(of("continuous").withColumn("_y", number), pair, "value", "_y", least)
    split = mann_whitney(of("binary").where(number.isin(0.0, 1.0)).withColumn("_yes", number == 1), pair, "value", "_yes", min_arm)
    trimmed = of("nominal").withColumn("answer", F.trim("answer"))
    sizes = trimmed.groupBy(*pair, "answer").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") >= min_group)
    grouped = kruskal(trimmed.join(sizes.select(*pair, "answer"), [*pair, "answer"]), pair, "value", "answer")
    tested = (
        named(ranked, "continuous", "Spearman", F.col("n"), F.col("rho"))
        .unionByName(named(split, "binary", "Mann-Whitney", F.col("n1") + F.col("n2"), F.col("median_carrier") - F.col("median_rest")))
        .unionByName(named(grouped, "nominal", "Kruskal-Wallis", F.col("n"), F.col("h")))
    )
    return bh_fdr(cut_lineage(tested.where(F.col("effect").isNotNull()).join(enough, pair)), "p_value", family)


def feature_pairs(a: DataFrame, b: DataFrame, keys: list[str], family: list[str], least: int = 10) -> DataFrame:
    """Spearman of every feature of ``a`` with every feature of ``b`` over common samples, with one FDR per ``family``.

    Both sides: sample, keys, feature, value. The pairs are the result (features of a times features of b); their rows are counted per
    (pair, value, value) before anything is ranked. A feature is not paired with itself.
    """
    left = a.where(known("value")).select("sample", *keys, F.col("feature").alias("feature_a"), F.col("value").alias("_x"))
    right = b.where(known("value")).select("sample", *keys, F.col("feature").alias("feature_b"), F.col("value").alias("_y"))
    rows = left.join(right, ["sample", *keys]).where(F.col("feature_a") != F.col("feature_b"))
    tested = spearman(rows, [*keys, "feature_a", "feature_b"], "_x", "_y", least)
    return bh_fdr(cut_lineage(tested.where(F.col("rho").isNotNull())), "p_value", family)
