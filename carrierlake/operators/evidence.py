"""Roll-ups of result tables: overviews, priorities, links, consistency, external comparison."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from carrierlake.operators.joins import prioritised_match


def stack_results(tables: dict[str, DataFrame]) -> DataFrame:
    """Result tables under each other with their source name."""
    parts = [table.withColumn("source", F.lit(name)) for name, table in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def significant_overview(results: DataFrame, key: str, context: str, p: str, fdr: str, alpha: float = 0.05) -> DataFrame:
    """Contexts (a short vocabulary), best p and FDR, and flags per key over all significant rows."""
    kept = results.where((F.col(p) < alpha) | (F.col(fdr) < alpha))
    base = kept.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("source").alias("n_sources"), F.min(p).alias("best_p"),
        F.min(fdr).alias("best_fdr"), F.bool_or(F.coalesce(F.col(fdr) < alpha, F.lit(False))).alias("any_fdr"),
    )
    contexts = kept.select(key, context).distinct().groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_list(context)), "; ").alias("contexts")
    )
    return base.join(contexts, key)


def signal_bridge(genetic: DataFrame, clinical: DataFrame, keys: list[str]) -> DataFrame:
    """Genetic hits beside clinical hits per cohort and endpoint."""
    g = genetic.groupBy(*keys).agg(F.count(F.lit(1)).alias("genetic_hits"))
    c = clinical.groupBy(*keys).agg(F.count(F.lit(1)).alias("clinical_hits"))
    return g.join(c, keys, "full_outer").fillna(0, ["genetic_hits", "clinical_hits"])


def priority_table(evidence: DataFrame, key: str, source: str, weights: dict[str, int]) -> DataFrame:
    """One row per key: which sources name it and their bit-weighted rank."""
    flags = [F.bool_or(F.col(source) == s).alias(s) for s in weights]
    flagged = evidence.groupBy(key).agg(*flags)
    rank = sum((F.col(s).cast("int") * w for s, w in list(weights.items())[1:]), F.col(next(iter(weights))).cast("int") * next(iter(weights.values())))
    return flagged.withColumn("priority_rank", rank)


def evidence_score(df: DataFrame) -> DataFrame:
    """Score and label from the flags primary, clinical, rna, key_haplotype, functional, caution and the
    counts strong, exact."""
    points = lambda c, w: F.col(c).cast("int") * w
    score = (
        points("primary", 3) + points("clinical", 2) + points("rna", 2) + points("key_haplotype", 2) + F.col("strong")
        + points("functional", 1) - points("caution", 2)
    )
    strong = F.col("strong") > 0
    signal = F.col("primary") | F.col("clinical") | F.col("key_haplotype")
    label = (
        F.when((F.col("rna") & (strong | F.col("functional"))) | (F.col("primary") & strong), "Supports observed project association")
        .when(signal & (strong | F.col("functional") | (F.col("exact") > 0)), "Novel but biologically plausible")
        .when(signal, "Weak / indirect / inconsistent annotation")
        .otherwise("Without a confirmed project association")
    )
    return df.withColumn("score", score).withColumn("label", label)


def effect_label(ratio: Column) -> Column:
    return F.when(ratio > 1, "Tumour-enriched").when(ratio < 1, "Healthy-enriched").otherwise("Balanced")


def haplotype_snp_links(haplotypes: DataFrame, members: DataFrame, snps: DataFrame) -> DataFrame:
    """Expected against observed direction for every member site of a tested haplotype.

    ``haplotypes``: comparison, region, hap_id, odds_ratio. ``members``: region, hap_id, snp,
    allele (ALT or REF). ``snps``: comparison, snp, odds_ratio.
    """
    observed = snps.select("comparison", "snp", effect_label(F.col("odds_ratio")).alias("observed"))
    linked = (
        haplotypes.select("comparison", "region", "hap_id", effect_label(F.col("odds_ratio")).alias("hap_effect"))
        .join(members, ["region", "hap_id"]).join(observed, ["comparison", "snp"])
    )
    opposite = F.when(F.col("hap_effect") == "Tumour-enriched", "Healthy-enriched").when(F.col("hap_effect") == "Healthy-enriched", "Tumour-enriched").otherwise("Balanced")
    expected = F.when(F.col("allele") == "ALT", F.col("hap_effect")).otherwise(opposite)
    call = (
        F.when((F.col("expected") == "Balanced") | (F.col("observed") == "Balanced"), "Ambiguous")
        .when(F.col("expected") == F.col("observed"), "Consistent").otherwise("Discordant")
    )
    return linked.withColumn("expected", expected).withColumn("consistency", call)


def link_rollup(links: DataFrame, snps: DataFrame) -> DataFrame:
    """Per comparison and SNP: linked haplotypes, counts by call and mapping status; unlinked SNPs stay."""
    counts = links.groupBy("comparison", "snp").agg(
        F.count(F.lit(1)).alias("n_links"), F.countDistinct("region").alias("n_regions"),
        *[F.count_if(F.col("consistency") == c).alias("n_" + c.lower()) for c in ("Consistent", "Discordant", "Ambiguous")],
    )
    names = ["n_links", "n_regions", "n_consistent", "n_discordant", "n_ambiguous"]
    status = F.when(F.col("n_links") == 0, "No haplotype link").when(F.col("n_discordant") == 0, "Linked, no conflict").otherwise("Linked with conflict")
    return snps.select("comparison", "snp").distinct().join(counts, ["comparison", "snp"], "left").fillna(0, names).withColumn("mapping_status", status)


def dosage_shift(case_het: Column, control_het: Column, case_hom: Column, control_hom: Column, points: float = 5.0) -> Column:
    """Which genotype class moves by at least the given percentage points."""
    het, hom = case_het - control_het, case_hom - control_hom
    word = lambda gap, name: F.when(gap >= points, f"{name} higher in case").when(gap <= -points, f"{name} lower in case")
    both = (F.abs(het) >= points) & (F.abs(hom) >= points)
    return F.when(both, "Het and Hom shift").otherwise(F.coalesce(word(het, "Het"), word(hom, "Hom"), F.lit("No clear shift")))


def cohort_consistency(tests: DataFrame, keys: list[str], comparison: str, fdr: str, cohorts: list[str], every: str = "All", alpha: float = 0.05) -> DataFrame:
    """Shared, one-cohort or global-only significance from the FDR of each comparison."""
    wide = tests.groupBy(*keys).pivot(comparison, [*cohorts, every]).agg(F.min(fdr))
    hit = lambda c: F.coalesce(F.col(f"`{c}`") <= alpha, F.lit(False))
    n = sum((hit(c).cast("int") for c in cohorts[1:]), hit(cohorts[0]).cast("int"))
    one = F.coalesce(*[F.when(hit(c), F.lit(f"{c}-driven")) for c in cohorts])
    label = F.when(n >= 2, "Shared across cohorts").when(n == 1, one).when(hit(every), "Global only").otherwise("Not significant")
    return wide.withColumn("n_cohorts", n).withColumn("consistency", label)


def external_comparison(study: DataFrame, reference: DataFrame, keys: list[str], value: str, limit: float = 0.10) -> DataFrame:
    """Study minus reference frequency with direction and alignment."""
    joined = study.withColumnRenamed(value, "study").join(reference.select(*keys, F.col(value).alias("reference")), keys, "left")
    gap = F.col("study") - F.col("reference")
    return joined.select(
        "*", gap.alias("delta"),
        F.when(gap.isNull(), "Not assessed").when(F.abs(gap) < 1e-9, "Matched to reference").when(gap > 0, "Higher in study").otherwise("Lower in study").alias("direction"),
        F.when(gap.isNull(), "Non-comparable").when(F.abs(gap) <= limit, "Similar to reference").otherwise("Divergent from reference").alias("alignment"),
    )


def status_counts(df: DataFrame, keys: list[str], status: str) -> DataFrame:
    return df.groupBy(*keys, status).agg(F.count(F.lit(1)).alias("n"))


def shortlist(results: DataFrame, annotation: DataFrame, pattern: str, keys: list[str], p: str, alpha: float = 0.05) -> DataFrame:
    """Significant rows whose annotation, found by the first key that hits, matches the pattern; one row per id."""
    noted = prioritised_match(results.where(F.col(p) < alpha), annotation, keys[0], keys, "consequence")
    return noted.where(F.col("consequence").rlike(pattern)).groupBy(keys[0], "consequence", "matched_on").agg(
        F.countDistinct("source").alias("n_sources"), F.min(p).alias("best_p")
    )


def inventory(tables: DataFrame, group: str, sample: str, variable: str) -> DataFrame:
    """Rows, samples and variables per source."""
    return tables.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(sample).alias("n_samples"), F.countDistinct(variable).alias("n_variables")
    )
