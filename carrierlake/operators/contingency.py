"""Tests on count tables: odds ratio, Fisher, chi-square, trend and the genotype cascade.

All of them read a table with one row per test, so their cost follows the number of tests,
not the number of samples.
"""

from pyspark.sql import Column, DataFrame, functions as F

from carrierlake.functions.pvalues import chi_square_p, fisher_p, normal_p
from carrierlake.operators.fdr import bh_fdr
from carrierlake.session import cut_lineage


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Struct ``(odds_ratio, ci_low, ci_high, method)``: 0.5 on every cell if any is zero."""
    zero = (a == 0) | (b == 0) | (c == 0) | (d == 0)
    shift = F.when(zero, 0.5).otherwise(0.0)
    w, x, y, z = (v + shift for v in (a, b, c, d))
    ratio = (w * z) / (x * y)
    se = F.sqrt(1 / w + 1 / x + 1 / y + 1 / z)
    return F.struct(
        ratio.alias("odds_ratio"),
        F.exp(F.ln(ratio) - 1.96 * se).alias("ci_low"),
        F.exp(F.ln(ratio) + 1.96 * se).alias("ci_high"),
        F.when(zero, "Haldane-Anscombe").otherwise("Sample").alias("method"),
    )


def fisher_2x2(df: DataFrame, cells: tuple[str, str, str, str], out: str = "p_value") -> DataFrame:
    """Two-sided exact p for every row, where the row is: nothing is shuffled, and tables that repeat in an Arrow batch are computed once.

    Rows with a null cell have a null p. Cost per table grows with the root of the cells, not with the support.
    """
    return df.withColumn(out, fisher_p(*[F.col(c).cast("bigint") for c in cells]))


def chi_square(
    cells: DataFrame,
    keys: list[str],
    row: str,
    column: str,
    count: str = "n",
    yates: bool = False,
    empty_columns: str = "drop",
) -> DataFrame:
    """Pearson test per key from a long cell table; absent cells count as zero.

    ``sum((o - e)^2 / e)`` needs only the present cells: it equals ``N * (sum o^2 / (r c) - 1)``.
    Yates applies to 2x2 only and uses the same closed form of that table. With
    ``empty_columns="half"`` a missing class of a three-class table adds 0.5 to every cell.
    """
    base = cells.where(F.col(count) > 0).groupBy(*keys, row, column).agg(F.sum(count).cast("double").alias("_o"))
    if empty_columns == "half":
        base = _half_filled(base, keys, row, column)
    rows = base.groupBy(*keys, row).agg(F.sum("_o").alias("_r"))
    cols = base.groupBy(*keys, column).agg(F.sum("_o").alias("_c"))
    shape_r = rows.groupBy(*keys).agg(F.sum("_r").alias("_n"), F.count(F.lit(1)).alias("_nr"), F.min("_r").alias("_rmin"))
    shape_c = cols.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nc"), F.min("_c").alias("_cmin"))
    joined = base.join(rows, [*keys, row]).join(cols, [*keys, column])
    part = joined.groupBy(*keys).agg(
        F.sum(F.col("_o") * F.col("_o") / (F.col("_r") * F.col("_c"))).alias("_q"),
        F.max(F.col("_o")).alias("_omax"),
        F.max(F.struct("_o", "_r", "_c")).alias("_top"),
    )
    wide = part.join(shape_r, keys).join(shape_c, keys)
    dof = ((F.col("_nr") - 1) * (F.col("_nc") - 1)).cast("double")
    plain = F.col("_n") * (F.col("_q") - 1.0)
    statistic = plain
    if yates:
        # A 2x2 table follows from one cell and its margins: |ad - bc| = |n o - r c|.
        o, r, c, n = F.col("_top._o"), F.col("_top._r"), F.col("_top._c"), F.col("_n")
        gap = F.abs(n * o - r * c)
        shrunk = gap - F.least(n / 2.0, gap)
        margins = r * (n - r) * c * (n - c)
        statistic = F.when(dof == 1, F.try_divide(n * F.pow(shrunk, F.lit(2.0)), margins)).otherwise(plain)
    tested = (F.col("_nr") >= 2) & (F.col("_nc") >= 2)
    out = wide.select(
        *keys,
        F.when(tested, F.greatest(statistic, F.lit(0.0))).alias("statistic"),
        F.when(tested, dof).alias("dof"),
        F.when(tested, F.col("_rmin") * F.col("_cmin") / F.col("_n")).alias("expected_min"),
        F.col("_n").cast("bigint").alias("n"),
    )
    return out.select(
        "*",
        (F.col("expected_min") < 5).alias("sparse"),
        chi_square_p("statistic", "dof").alias("p_value"),
    )


def _half_filled(base: DataFrame, keys: list[str], row: str, column: str) -> DataFrame:
    """Every (row level, column level) cell of the three genotype classes plus 0.5 where one class is absent."""
    levels = base.groupBy(*keys).agg(
        F.countDistinct(column).alias("_seen"), F.sort_array(F.collect_set(row)).alias("_rows")
    )
    lifted = levels.where(F.col("_seen") < 3).select(*keys, F.explode("_rows").alias(row))
    classes = F.explode(F.array(F.lit("WT"), F.lit("Het_ALT"), F.lit("Hom_ALT")))
    grid = lifted.select(*keys, row, classes.alias(column)).withColumn("_o", F.lit(0.5))
    return base.unionByName(grid).groupBy(*keys, row, column).agg(F.sum("_o").alias("_o"))


def trend(case: list[Column], control: list[Column]) -> Column:
    """Cochran-Armitage z with scores 0, 1, 2 and the n-1 variance; null when not estimable."""
    case = [c.cast("double") for c in case]
    control = [c.cast("double") for c in control]
    totals = [a + b for a, b in zip(case, control)]
    n, n_case, n_control = sum(totals[1:], totals[0]), sum(case[1:], case[0]), sum(control[1:], control[0])
    weighted = totals[1] + 2.0 * totals[2]
    mean = F.try_divide(weighted, n)
    numerator = (case[1] + 2.0 * case[2]) - F.try_divide(weighted * n_case, n)
    spread = sum((t * F.pow(F.lit(float(s)) - mean, F.lit(2.0)) for s, t in list(enumerate(totals))[1:]),
                 totals[0] * F.pow(mean, F.lit(2.0)))
    variance = F.try_divide(n_case * n_control * spread, n * (n - 1))
    levels = sum(((t > 0).cast("int") for t in totals[1:]), (totals[0] > 0).cast("int"))
    usable = (n > 1) & (n_case > 0) & (n_control > 0) & (levels >= 2) & (variance > 0)
    return F.when(usable, numerator / F.sqrt(variance))


def genotype_test(df: DataFrame, case: list[str], control: list[str]) -> DataFrame:
    """Cascade per row of WT/Het/Hom counts in two arms.

    Fewer than two classes: skipped. Two classes: exact test on the reduced table. Three:
    Pearson unless the smallest expectation is below 5. Adds the trend test, Het and Hom
    against WT, and the smallest of the p values.
    """
    t, c = [F.col(x) for x in case], [F.col(x) for x in control]
    seen = [(x + y) > 0 for x, y in zip(t, c)]
    n_seen = sum((s.cast("int") for s in seen[1:]), seen[0].cast("int"))
    first = lambda arm: F.when(seen[0], arm[0]).otherwise(arm[1])
    last = lambda arm: F.when(seen[2], arm[2]).otherwise(arm[1])
    two = n_seen == 2
    n = sum((x + y for x, y in zip(t[1:], c[1:])), t[0] + c[0]).cast("double")
    nt, nc = sum(t[1:], t[0]).cast("double"), sum(c[1:], c[0]).cast("double")
    pieces, least = F.lit(0.0), None
    for x, y in zip(t, c):
        col_total = (x + y).cast("double")
        pieces = pieces + F.coalesce(F.try_divide(x * x, nt * col_total) + F.try_divide(y * y, nc * col_total), F.lit(0.0))
        least = col_total if least is None else F.least(least, col_total)
    expected_min = F.try_divide(least * F.least(nt, nc), n)
    base = df.select(
        "*",
        n_seen.alias("classes_observed"),
        F.when(two, first(t)).alias("_a"), F.when(two, last(t)).alias("_b"),
        F.when(two, first(c)).alias("_c"), F.when(two, last(c)).alias("_d"),
        F.when((n_seen == 3) & (nt > 0) & (nc > 0), n * (pieces - 1.0)).alias("chi2"),
        F.when(n_seen == 3, expected_min).alias("expected_min"),
        trend(t, c).alias("trend_z"),
        *[v.alias(f"_{name}{i}") for name, k in (("het", 1), ("hom", 2))
          for i, v in enumerate(_contrast(t, c, k))],
    )
    step = fisher_2x2(cut_lineage(base), ("_a", "_b", "_c", "_d"), "_exact")
    step = fisher_2x2(step, tuple(f"_het{i}" for i in range(4)), "het_p")
    step = fisher_2x2(step, tuple(f"_hom{i}" for i in range(4)), "hom_p")
    sparse = F.col("expected_min") < 5
    method = (
        F.when(F.col("classes_observed") < 2, "Skipped")
        .when(F.col("classes_observed") == 2, "Fisher exact on reduced 2x2 genotype table")
        .when(sparse, "Skipped sparse 2x3 genotype table")
        .otherwise("Pearson chi-square on 2x3 genotype table")
    )
    out = step.select(
        *df.columns, "classes_observed", "chi2", "expected_min", method.alias("method"), "trend_z",
        F.coalesce(
            F.col("_exact"), F.when(~sparse, chi_square_p(F.col("chi2"), F.lit(2.0)))
        ).alias("distribution_p"),
        normal_p("trend_z").alias("trend_p"),
        odds_ratio(*[F.col(f"_het{i}") for i in range(4)])["odds_ratio"].alias("het_or"),
        "het_p",
        odds_ratio(*[F.col(f"_hom{i}") for i in range(4)])["odds_ratio"].alias("hom_or"),
        "hom_p",
    )
    primary = F.coalesce("distribution_p", "trend_p")
    source = F.when(F.col("distribution_p").isNotNull(), "distribution").when(F.col("trend_p").isNotNull(), "trend")
    return out.withColumn("best_p", F.least("distribution_p", "trend_p", "het_p", "hom_p")).withColumn("primary_p", primary).withColumn("primary_source", source)


#: Families of p values that are corrected apart, each inside the caller's groups.
FAMILIES = ("primary", "distribution", "trend", "het", "hom")


def genotype_families(tests: DataFrame, group: list[str]) -> DataFrame:
    """``genotype_test`` results with one FDR column per family of p values, inside each group."""
    out = cut_lineage(tests)
    for name in FAMILIES:
        out = cut_lineage(bh_fdr(out, f"{name}_p", group, f"{name}_fdr"))  # each step reads its input several times
    return out


def _contrast(case: list[Column], control: list[Column], k: int) -> list[Column]:
    usable = (case[k] + control[k] > 0) & (case[0] + control[0] > 0)
    return [F.when(usable, v) for v in (case[k], case[0], control[k], control[0])]
