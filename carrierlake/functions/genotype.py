"""Genotype strings, depth fields and call-level quality classes."""

from pyspark.sql import Column, functions as F

MISSING_CALLS = ["", ".", "./.", ".|."]


def parse_gt(gt: Column, strict: bool = True) -> Column:
    """Struct ``(a1, a2, callable, phased, dosage)`` of a diploid call.

    Strict keeps only alleles 0 and 1 and is null otherwise; loose sums the allele indexes.
    """
    text = F.trim(gt)
    part = F.split(text, "[/|]")
    first, second = F.get(part, F.lit(0)).try_cast("int"), F.get(part, F.lit(1)).try_cast("int")
    usable = (F.size(part) == 2) & first.isNotNull() & second.isNotNull()
    if strict:
        usable = usable & first.between(0, 1) & second.between(0, 1)
    usable = F.coalesce(usable & ~text.isin(MISSING_CALLS), F.lit(False))
    return F.struct(
        F.when(usable, first).alias("a1"),
        F.when(usable, second).alias("a2"),
        usable.alias("callable"),
        F.coalesce(usable & text.contains("|"), F.lit(False)).alias("phased"),
        F.when(usable, first + second).alias("dosage"),
    )


def classify_genotype(gt: Column, depth: Column) -> Column:
    """No_call / WT / Het_ALT / Hom_ALT / Other_ALT_model."""
    text = F.trim(gt)
    alleles = F.transform(F.split(text, "[/|]"), lambda a: a.try_cast("int"))
    no_call = (
        text.isNull()
        | text.isin(MISSING_CALLS)
        | depth.isNull()
        | (depth <= 0)
        | F.exists(alleles, lambda a: a.isNull())
    )
    n_alt = F.size(F.filter(alleles, lambda a: a > 0))
    return (
        F.when(no_call, "No_call")
        .when(n_alt == 0, "WT")
        .when(n_alt == 1, "Het_ALT")
        .when((F.size(F.array_distinct(alleles)) == 1) & (F.get(alleles, F.lit(0)) > 0), "Hom_ALT")
        .otherwise("Other_ALT_model")
    )


def threshold_status(raw_class: Column, depth: Column, callable_depth: int = 50) -> Column:
    return (
        F.when(raw_class == "No_call", "No_call")
        .when(depth.isNull() | (depth < callable_depth), "Below_DP_threshold")
        .otherwise(raw_class)
    )


def allele_depths(ad: Column, depth: Column) -> Column:
    """Struct ``(ref_depth, alt_depth, alt_fraction)`` of a comma list, null when unreadable."""
    pieces = F.filter(F.transform(F.split(F.trim(ad), ","), lambda x: F.trim(x)), lambda x: ~x.isin("", "."))
    numbers = F.transform(pieces, lambda x: x.try_cast("int"))
    readable = (F.size(numbers) > 0) & ~F.exists(numbers, lambda x: x.isNull())
    ref = F.when(readable, F.get(numbers, F.lit(0)))
    alt = F.when(
        readable,
        F.aggregate(F.slice(numbers, 2, F.greatest(F.size(numbers), F.lit(1))), F.lit(0), lambda acc, x: acc + x),
    )
    return F.struct(
        ref.alias("ref_depth"),
        alt.alias("alt_depth"),
        F.when(depth > 0, F.try_divide(alt.cast("double"), depth.cast("double"))).alias("alt_fraction"),
    )


def observed_fraction(alt_obs: Column, ref_obs: Column) -> Column:
    """Alternate fraction from the two observation counts."""
    return F.try_divide(alt_obs.cast("double"), (alt_obs + ref_obs).cast("double"))


def is_het(gt: Column) -> Column:
    part = F.split(F.regexp_replace(gt, r"\|", "/"), "/")
    return F.coalesce(
        (F.size(part) == 2) & (F.get(part, F.lit(0)) != F.get(part, F.lit(1))) & ~F.array_contains(part, "."),
        F.lit(False),
    )


def allelic_balance(gt: Column, fraction: Column, low: float = 0.25, high: float = 0.75) -> Column:
    """Quality class of a heterozygous call; every other call is NO_DATA."""
    return (
        F.when(~is_het(gt) | fraction.isNull(), "NO_DATA")
        .when((fraction < low) | (fraction > high), "POOR")
        .when(fraction.between(0.40, 0.60), "OPTIMAL")
        .otherwise("ACCEPTABLE")
    )


def substitution_class(ref: Column, alt: Column) -> Column:
    """``ti``, ``tv`` or null for anything that is not a single-base substitution."""
    r, a = F.upper(ref), F.upper(alt)
    bases = ["A", "C", "G", "T"]
    purine = lambda x: x.isin("A", "G")
    snv = r.isin(bases) & a.isin(bases) & (r != a)
    return F.when(snv & (purine(r) == purine(a)), "ti").when(snv, "tv")
