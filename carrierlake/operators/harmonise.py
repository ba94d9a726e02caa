"""Clinical tables: canonical columns with provenance, derived flags, typed outcomes and their tests."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from carrierlake.functions import clinical
from carrierlake.functions.keys import coalesce_with_source
from carrierlake.operators import ranktests
from carrierlake.operators.contingency import chi_square, fisher_2x2, genotype_test, odds_ratio
from carrierlake.operators.fdr import bh_fdr
from carrierlake.session import cut_lineage

Rule = Callable[[Column], Column]


def harmonise_clinical(df: DataFrame, rules: dict[str, tuple[str, Rule]]) -> DataFrame:
    """Every rule of the table in one projection: ``{output: (input column, rule)}``."""
    return df.select("*", *[rule(F.col(source)).alias(name) for name, (source, rule) in rules.items()])


def canonicalise(df: DataFrame, mapping: dict[str, tuple[list[str], Rule | None]]) -> DataFrame:
    """``canon__X`` from the first meaningful source, ``canon__X__source`` for where it came from.

    Sources absent from the table are skipped, so one mapping serves tables with drift.
    """
    present = {c.lower(): c for c in df.columns}
    fields = []
    for name, (sources, rule) in mapping.items():
        found = [present[s.lower()] for s in sources if s.lower() in present]
        if not found:
            fields += [F.lit(None).cast("string").alias(f"canon__{name}"), F.lit(None).cast("string").alias(f"canon__{name}__source")]
            continue
        value, source = coalesce_with_source(found, clinical.meaningful)
        fields += [(value if rule is None else rule(value)).alias(f"canon__{name}"), source.alias(f"canon__{name}__source")]
    return df.select("*", *fields)


def canon_coverage(df: DataFrame) -> DataFrame:
    """Filled rows and sources used per canonical column, one pass."""
    names = [c for c in df.columns if c.startswith("canon__") and not c.endswith("__source")]
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[e for i, c in enumerate(names) for e in (F.count(c).alias(f"f{i}"), F.countDistinct(f"{c}__source").alias(f"s{i}"))])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"f{i}").alias("filled"), F.col(f"s{i}").alias("n_sources"), (F.col(f"f{i}") * 100.0 / F.col("_n")).alias("pct_filled")) for i, c in enumerate(names)]
    return counts.select(F.inline(F.array(*rows)))


def triple_negative(er: Column, pr: Column, her2: Column) -> Column:
    """Yes when all three are negative, No when any is positive, else null."""
    every = (er == "Negative") & (pr == "Negative") & (her2 == "Negative")
    some = F.coalesce(er == "Positive", F.lit(False)) | F.coalesce(pr == "Positive", F.lit(False)) | F.coalesce(her2 == "Positive", F.lit(False))
    return F.when(F.coalesce(every, F.lit(False)), "Yes").when(some, "No")


def msi_status(c: Column) -> Column:
    """MSI or MSS by the words of a free text; ``decisions.decide`` maps whole texts to its own categories."""
    s = F.upper(clinical.clean_text(c))
    return F.when(s.contains("MSI-H") | s.contains("UNSTABLE") | s.contains("DMMR") | s.contains("LOSS"), "MSI").when(
        s.contains("MSS") | s.contains("STABLE") | s.contains("PMMR") | s.contains("INTACT"), "MSS"
    )


def vital_from_flag(exitus: Column) -> Column:
    """Vital status where a sheet has only the death flag; status texts go through ``decisions.decide``."""
    flag = clinical.yes_no(exitus)
    return F.when(flag == "Yes", "Dead").when(flag == "No", "Alive")


def event_flag(flag: Column, date: Column) -> Column:
    """Recurrence, metastasis and the like: the flag, else Yes when the event has a date."""
    return F.coalesce(clinical.yes_no(flag), F.when(date.isNotNull(), "Yes"))


def menopause(status: Column, age: Column, limit: float = 50.0) -> Column:
    """Text first (pre / post), else by age."""
    s = F.lower(clinical.clean_text(status))
    return F.when(s.contains("pre"), "Pre").when(s.contains("post"), "Post").when(age >= limit, "Post").when(age < limit, "Pre")


def fill_months(df: DataFrame, months: str, start: str, end: str) -> DataFrame:
    """Fill missing months from two dates and mark where they came from."""
    derived = clinical.months_between_dates(F.col(start), F.col(end))
    source = F.when(F.col(months).isNotNull(), F.lit(months)).when(derived.isNotNull(), "derived_from_dates")
    return df.withColumn(f"{months}__source", source).withColumn(months, F.coalesce(F.col(months), derived))


def class_summary(samples: DataFrame, group: list[str], value: Column, levels: list[str]) -> DataFrame:
    """Counts per group and class with every class present, availability included."""
    labelled = samples.withColumn("_c", F.coalesce(value, F.lit("Unavailable")))
    counts = labelled.groupBy(*group).agg(F.count(F.lit(1)).alias("n_samples"), *[F.count_if(F.col("_c") == level).alias(f"_l{i}") for i, level in enumerate([*levels, "Unavailable"])])
    rows = F.inline(F.array(*[F.struct(F.lit(level).alias("class"), F.col(f"_l{i}").alias("n")) for i, level in enumerate([*levels, "Unavailable"])]))
    return counts.select(*group, "n_samples", rows).withColumn("pct", F.col("n") * 100.0 / F.col("n_samples"))


# --- association of exposures with typed outcomes -------------------------------------------------


def outcome_cells(carriers: DataFrame, outcomes: DataFrame, exposure: str) -> DataFrame:
    """Cells (exposure, var, carrier, value, n) from carrier rows only; the rest follows from the totals."""
    totals = outcomes.groupBy("var", "value").agg(F.count(F.lit(1)).alias("_t"))
    distinct = carriers.select("sample", exposure).distinct()
    hit = outcomes.join(distinct, "sample").groupBy(exposure, "var", "value").agg(F.count(F.lit(1)).alias("_k"))
    # Every level of a variable an exposure touches, so that a level without carriers keeps its rest.
    seen = hit.select(exposure, "var").distinct().join(totals, "var").join(hit, [exposure, "var", "value"], "left")
    k = F.coalesce("_k", F.lit(0))
    sides = F.inline(F.array(F.struct(F.lit("carrier").alias("side"), k.alias("n")), F.struct(F.lit("rest").alias("side"), (F.col("_t") - k).alias("n"))))
    return seen.select(exposure, "var", "value", sides)


def clinical_association(carriers: DataFrame, outcomes: DataFrame, exposure: str, min_arm: int = 3, min_events: int = 1) -> DataFrame:
    """Every exposure against every outcome by its declared type.

    ``outcomes``: sample, var, type, value (text). Continuous goes to rank tests, binary (Yes/No)
    to the odds ratio with exact p, nominal to chi-square; one job per type over all keys.
    """
    valid = outcomes.where(F.col("value").isNotNull())
    kind = lambda t: valid.where(F.col("type") == t)
    numeric = kind("continuous").select("sample", "var", F.col("value").try_cast("double").alias("value"))
    continuous = ranktests.carrier_rank_tests(numeric, carriers, ["var"], exposure, min_arm=min_arm).select(
        exposure, "var", F.lit("continuous").alias("type"), F.col("u").alias("statistic"), F.col("rank_biserial").alias("effect"), "p_value"
    )
    cells = outcome_cells(carriers, kind("binary").select("sample", "var", "value"), exposure)
    count = lambda side, value: F.sum(F.when((F.col("side") == side) & (F.col("value") == value), F.col("n")).otherwise(0))
    table = cells.groupBy(exposure, "var").agg(
        count("carrier", "Yes").alias("a"), count("carrier", "No").alias("b"), count("rest", "Yes").alias("c"), count("rest", "No").alias("d")
    ).where((F.col("a") + F.col("c") >= min_events) & (F.col("a") + F.col("b") >= min_arm) & (F.col("c") + F.col("d") >= min_arm))
    names = ("a", "b", "c", "d")
    binary = fisher_2x2(table, names).select(
        exposure, "var", F.lit("binary").alias("type"), F.lit(None).cast("double").alias("statistic"), odds_ratio(*[F.col(x) for x in names])["odds_ratio"].alias("effect"), "p_value"
    )
    nominal_cells = outcome_cells(carriers, kind("nominal").select("sample", "var", "value"), exposure)
    nominal = chi_square(nominal_cells, [exposure, "var"], "side", "value").where("statistic is not null").select(
        exposure, "var", F.lit("nominal").alias("type"), "statistic", F.lit(None).cast("double").alias("effect"), "p_value"
    )
    return continuous.unionByName(binary).unionByName(nominal)


def dose_association(calls: DataFrame, outcomes: DataFrame, exposure: str) -> DataFrame:
    """Dose counts per binary outcome: trend z plus Het and Hom against WT, from carrier rows only.

    ``outcomes``: sample, var, value (Yes/No).
    """
    totals = outcomes.groupBy("var").agg(F.count_if(F.col("value") == "Yes").alias("_ty"), F.count_if(F.col("value") == "No").alias("_tn"))
    hits = outcomes.join(calls.select("sample", exposure, "dosage"), "sample").groupBy(exposure, "var").agg(
        *[F.count_if((F.col("value") == v) & (F.col("dosage") == d)).alias(f"{arm}_{g}") for v, arm in (("Yes", "case"), ("No", "control")) for d, g in ((1, "het"), (2, "hom"))]
    )
    table = hits.join(totals, "var").select(
        exposure, "var", (F.col("_ty") - F.col("case_het") - F.col("case_hom")).alias("case_wt"), "case_het", "case_hom",
        (F.col("_tn") - F.col("control_het") - F.col("control_hom")).alias("control_wt"), "control_het", "control_hom",
    )
    names = ("wt", "het", "hom")
    return genotype_test(table, [f"case_{x}" for x in names], [f"control_{x}" for x in names])


def dose_cells(carriers: DataFrame, outcomes: DataFrame, exposure: str) -> DataFrame:
    """Cells (exposure, var, dosage, value, n) from carrier rows; the dose of 0 follows from the totals."""
    totals = outcomes.groupBy("var", "value").agg(F.count(F.lit(1)).alias("_t"))
    hit = outcomes.join(carriers.select("sample", exposure, "dosage"), "sample").groupBy(exposure, "var", "value", "dosage").agg(F.count(F.lit(1)).alias("n"))
    taken = hit.groupBy(exposure, "var", "value").agg(F.sum("n").alias("_k"))
    rest = hit.select(exposure, "var").distinct().join(totals, "var").join(taken, [exposure, "var", "value"], "left")
    zero = rest.select(exposure, "var", "value", F.lit(0).alias("dosage"), (F.col("_t") - F.coalesce("_k", F.lit(0))).alias("n"))
    return hit.select(exposure, "var", "value", F.col("dosage").cast("int").alias("dosage"), "n").unionByName(zero.where("n > 0"))


def haplotype_dose(carriers: DataFrame, outcomes: DataFrame, exposure: str, least: int = 3) -> DataFrame:
    """Dose 0 / 1 / 2 of every haplotype against typed outcomes: Spearman for continuous ones, chi-square of dose by level for the others.

    ``carriers``: sample, exposure, dosage above 0, one row per sample and exposure. ``outcomes``: sample, var, type, value (text), of
    callable samples only: every one without a carrier row has dose 0. A dose class of fewer than ``least`` samples leaves the chi-square
    table; a continuous outcome needs two classes of that size. FDR runs over all tests of a type.
    """
    called = carriers.where("dosage > 0")
    valid = outcomes.where(F.col("value").isNotNull())
    numeric = valid.where(F.col("type") == "continuous").select("sample", "var", F.col("value").try_cast("double").alias("value"))
    continuous = ranktests.dose_spearman(numeric, called, ["var"], exposure, least=least).select(
        exposure, "var", F.lit("continuous").alias("type"), "n", F.col("rho").alias("statistic"), "p_value"
    )
    cells = cut_lineage(dose_cells(called, valid.where(F.col("type") != "continuous").select("sample", "var", "value"), exposure))
    sizes = cells.groupBy(exposure, "var", "dosage").agg(F.sum("n").alias("_size")).where(F.col("_size") >= least)
    large = cells.join(sizes, [exposure, "var", "dosage"])
    types = valid.select("var", "type").distinct()
    levels = chi_square(large, [exposure, "var"], "dosage", "value").where("statistic is not null")
    nominal = levels.join(types, "var").select(exposure, "var", "type", F.col("n").cast("bigint").alias("n"), "statistic", "p_value")
    # The adjustment reads the tests several times: one written row per test instead of as many fits.
    return bh_fdr(cut_lineage(continuous.unionByName(nominal)), "p_value", ["type"], "fdr")


def in_strata(carriers: DataFrame, strata: DataFrame, least: int = 15) -> tuple[DataFrame, DataFrame]:
    """Stratum sizes and the carrier rows repeated per stratum their sample belongs to.

    ``strata``: sample, stratum, exposed (boolean). Strata with fewer exposed samples are left out;
    the other operators then run with the stratum as one more key.
    """
    sizes = strata.groupBy("stratum").agg(F.count_if("exposed").alias("n_exposed"), F.count(F.lit(1)).alias("n_samples")).withColumn("used", F.col("n_exposed") >= least)
    members = strata.where("exposed").join(sizes.where("used").select("stratum"), "stratum").select("sample", "stratum")
    return sizes, carriers.join(members, "sample")
