"""Phased haplotype strings, carriers, frequencies, association and external comparison."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from carrierlake.operators import compare
from carrierlake.operators.contingency import fisher_2x2, odds_ratio
from carrierlake.operators.fdr import bh_fdr
from carrierlake.operators.ranking import share_of, top_k
from carrierlake.operators.regression import dose_risk
from carrierlake.session import cut_lineage

#: Sites of one region: strings and pair expansions grow with it, so a larger region is an error, never cut short.
MAX_SITES = 12


def bounded_sites(n: Column) -> Column:
    """n, or an error where a region has more than MAX_SITES sites."""
    return F.when(n > MAX_SITES, F.raise_error(F.concat(F.lit(f"a region may have at most {MAX_SITES} sites, not "), n.cast("string"))).cast("bigint")).otherwise(n)


def sample_haplotypes(alleles: DataFrame, sites: DataFrame, region: str = "region") -> DataFrame:
    """The two strings of every sample with all sites of the region called.

    ``alleles``: sample, region, site, a1, a2 (null = missing). ``sites``: region, site. A region
    holds a dozen sites at most, which bounds what is gathered per sample.
    """
    size = sites.groupBy(region).agg(bounded_sites(F.countDistinct("site")).alias("_size"))
    called = alleles.where(F.col("a1").isNotNull() & F.col("a2").isNotNull()).join(sites.distinct(), [region, "site"], "left_semi")
    strings = called.groupBy("sample", region).agg(
        F.array_sort(F.collect_list(F.struct("site", "a1", "a2"))).alias("_s"), F.count(F.lit(1)).alias("_n")
    )
    text = lambda a: F.array_join(F.transform("_s", lambda s: s[a].cast("string")), "")
    return strings.join(size, region).where("_n = _size").select("sample", region, text("a1").alias("h1"), text("a2").alias("h2"))


def copies(haps: DataFrame, region: str = "region") -> DataFrame:
    """One row per chromosome copy."""
    keep = [c for c in haps.columns if c not in ("h1", "h2")]
    return haps.select(*keep, F.posexplode(F.array("h1", "h2")).alias("copy", "hap")).withColumn("copy", F.col("copy") + 1)


def haplotype_counts(haps: DataFrame, keys: list[str], prefix: str = "H") -> DataFrame:
    """Copies, frequency and rank id per haplotype; ids go by count, ties by string."""
    counted = copies(haps).groupBy(*keys, "hap").agg(F.count(F.lit(1)).alias("n"))
    totals = haps.groupBy(*keys).agg(F.count(F.lit(1)).alias("callable"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc("hap")))
    return counted.join(totals, keys).select(
        *keys, "hap", "n", "callable", (F.col("n") / (2.0 * F.col("callable"))).alias("freq"),
        F.concat(F.lit(prefix), place.cast("string")).alias("hap_id"),
    )


def variant_content(hap: Column, names: Column) -> Column:
    """Names of the sites carrying 1, or Reference-like; ``names`` is the ordered site list."""
    chosen = F.filter(
        F.transform(names, lambda x, i: F.when(F.substring(hap, i + 1, F.lit(1)) == "1", x)), lambda x: x.isNotNull()
    )
    return F.when(F.size(chosen) == 0, "Reference-like").otherwise(F.array_join(chosen, "; "))


def haplotype_carriers(haps: DataFrame, reference: DataFrame, region: str = "region") -> DataFrame:
    """Dosage 1 or 2 of each reference haplotype in each callable sample.

    Only carriers are rows: dosage 0 is every other callable sample of the region, so samples x
    haplotypes is never built.
    """
    dosed = copies(haps).groupBy("sample", region, "hap").agg(F.count(F.lit(1)).cast("int").alias("dosage"))
    return dosed.join(reference.select(region, "hap", "hap_id"), [region, "hap"])


def reconcile_backbone(reference: DataFrame, reference_sites: DataFrame, own_sites: DataFrame, region: str = "region") -> DataFrame:
    """Reference strings cut down to the sites both panels have, frequencies added up."""
    kept = reference_sites.join(own_sites.select(region, "site").distinct(), [region, "site"], "left_semi").groupBy(region).agg(
        F.sort_array(F.collect_list("place")).alias("_kept")
    )
    string = F.array_join(F.transform("_kept", lambda i: F.substring(F.col("hap"), i, F.lit(1))), "")
    return reference.join(kept, region).select(region, string.alias("hap"), "n", "freq").groupBy(region, "hap").agg(
        F.sum("n").alias("n"), F.sum("freq").alias("freq")
    )


# --- two-site patterns ---------------------------------------------------------------------


def with_rollup_groups(df: DataFrame, group: str = "group_label") -> DataFrame:
    """Rows under their own group and under Healthy_All or Tumour_All, and All_Samples."""
    labels = F.array(
        F.concat_ws("_", "cohort", "tissue"), F.when(F.col("tissue") == "Healthy", "Healthy_All").otherwise("Tumour_All"), F.lit("All_Samples")
    )
    return df.withColumn(group, F.explode(labels))


def pattern_frequencies(pairs: DataFrame) -> DataFrame:
    """Copies per two-site code and group. ``pairs``: sample, cohort, tissue, h1, h2 of two sites.

    Copies are counted per original group before the roll-up groups are added.
    """
    counted = copies(pairs).groupBy("cohort", "tissue", "hap").agg(F.count(F.lit(1)).alias("n"))
    grouped = with_rollup_groups(counted).groupBy("group_label", "hap").agg(F.sum("n").alias("n"))
    totals = grouped.groupBy("group_label").agg(F.sum("n").alias("_all"))
    return grouped.join(totals, "group_label").select("group_label", "hap", "n", (F.col("n") / F.col("_all")).alias("freq"))


def pattern_carriers(pairs: DataFrame) -> DataFrame:
    """Callable samples and carriers of each site and of each two-site code per group."""
    dose = lambda i: F.substring("h1", i, 1).cast("int") + F.substring("h2", i, 1).cast("int")
    has = lambda code: (F.col("h1") == code) | (F.col("h2") == code)
    per = pairs.groupBy("cohort", "tissue").agg(
        F.count(F.lit(1)).alias("callable"),
        F.count_if(dose(1) > 0).alias("carry_first"), F.count_if(dose(2) > 0).alias("carry_second"),
        F.count_if((dose(1) > 0) & (dose(2) > 0)).alias("carry_both_sites"),
        F.count_if(has("11")).alias("carry_11"), F.count_if(has("10")).alias("carry_10"), F.count_if(has("01")).alias("carry_01"),
    )
    names = [c for c in per.columns if c not in ("cohort", "tissue")]
    summed = with_rollup_groups(per).groupBy("group_label").agg(*[F.sum(c).alias(c) for c in names])
    return summed.withColumn("p_second_given_first", F.try_divide(F.col("carry_both_sites").cast("double"), F.col("carry_first").cast("double"))).withColumn(
        "p_first_given_second", F.try_divide(F.col("carry_both_sites").cast("double"), F.col("carry_second").cast("double"))
    )


def conditional_genotypes(pairs: DataFrame) -> DataFrame:
    """Samples per genotype pair and group with the share inside the first site's genotype."""
    label = lambda i: F.get(
        F.array(F.lit("WT"), F.lit("Het"), F.lit("Hom")), F.substring("h1", i, 1).cast("int") + F.substring("h2", i, 1).cast("int")
    )
    counted = pairs.groupBy("cohort", "tissue", label(1).alias("gt1"), label(2).alias("gt2")).agg(F.count(F.lit(1)).alias("n"))
    grouped = with_rollup_groups(counted).groupBy("group_label", "gt1", "gt2").agg(F.sum("n").alias("n"))
    totals = grouped.groupBy("group_label", "gt1").agg(F.sum("n").alias("_all"))
    return grouped.join(totals, ["group_label", "gt1"]).select("group_label", "gt1", "gt2", "n", (F.col("n") / F.col("_all")).alias("row_share"))


def sample_patterns(pairs: DataFrame) -> DataFrame:
    """Samples per pair of copies and group."""
    counted = pairs.groupBy("cohort", "tissue", F.concat_ws(" + ", "h1", "h2").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    return with_rollup_groups(counted).groupBy("group_label", "pattern").agg(F.sum("n").alias("n"))


def direct_deltas(frequencies: DataFrame, left: str, right: str) -> DataFrame:
    """Frequency difference of two groups per code, exact p on copies with FDR, inverse-pattern flag.

    The flag marks codes 10 and 01 moving in opposite directions.
    """
    totals = frequencies.groupBy("group_label").agg(F.sum("n").alias("_all"))
    rows = frequencies.join(totals, "group_label")
    wide = rows.groupBy("hap").agg(
        *[
            F.coalesce(F.max(F.when(F.col("group_label") == g, F.col(c))), F.lit(0)).alias(f"{c}_{side}")
            for side, g in (("left", left), ("right", right)) for c in ("n", "freq", "_all")
        ]
    )
    cells = wide.withColumn("_rl", F.col("_all_left") - F.col("n_left")).withColumn("_rr", F.col("_all_right") - F.col("n_right"))
    tested = bh_fdr(fisher_2x2(cells, ("n_left", "_rl", "n_right", "_rr")), "p_value", [])
    out = tested.withColumn("delta", F.col("freq_left") - F.col("freq_right"))
    moves = out.groupBy().agg(
        F.max(F.when(F.col("hap") == "10", F.col("delta"))).alias("d10"), F.max(F.when(F.col("hap") == "01", F.col("delta"))).alias("d01")
    ).select((F.signum("d10") * F.signum("d01") < 0).alias("_inverse")).first()
    flag = bool(moves["_inverse"]) if moves and moves["_inverse"] is not None else False
    return out.select("hap", "n_left", "n_right", "freq_left", "freq_right", "delta", "p_value", "fdr", F.lit(flag).alias("inverse_pattern"))


# --- association and summaries ---------------------------------------------------------------


def haplotype_association(
    haps: DataFrame, samples: DataFrame, reference: DataFrame, region: str = "region", min_copies: int = 3, min_arm: int = 3
) -> DataFrame:
    """Carrier test of each haplotype per comparison among callable samples, FDR over the region."""
    dosed = haplotype_carriers(haps, reference.where(F.col("n") >= min_copies), region).join(samples, "sample")
    counts = dosed.groupBy("cohort", "tissue", region, "hap_id").agg(
        F.count(F.lit(1)).alias("carriers"), F.sum("dosage").alias("copies")
    )
    sizes = haps.join(samples, "sample").groupBy("cohort", "tissue", region).agg(F.count(F.lit(1)).alias("callable"))
    comparisons = compare.arm_sizes(samples)
    table = compare.pooled_arms(counts, [region, "hap_id"], ["carriers", "copies"], comparisons).join(
        compare.pooled_arms(sizes, [region], ["callable"], comparisons), ["comparison", region]
    )
    cells = table.where((F.col("case_callable") >= min_arm) & (F.col("control_callable") >= min_arm)).select(
        "*", (F.col("case_callable") - F.col("case_carriers")).alias("case_rest"),
        (F.col("control_callable") - F.col("control_carriers")).alias("control_rest"),
        (F.col("case_copies") / (2.0 * F.col("case_callable"))).alias("case_freq"),
        (F.col("control_copies") / (2.0 * F.col("control_callable"))).alias("control_freq"),
    )
    names = ("case_carriers", "case_rest", "control_carriers", "control_rest")
    tested = fisher_2x2(cut_lineage(cells), names).withColumn("odds_ratio", odds_ratio(*[F.col(c) for c in names])["odds_ratio"])
    return bh_fdr(tested, "p_value", ["comparison", region])


def with_dose_risk(tests: DataFrame, region: str = "region") -> DataFrame:
    """Add the dose model of every carrier test: odds ratio per copy with its interval and p, and which fit of the chain gave it.

    Dose counts follow from carriers and copies (a carrier of two copies counts twice), so no sample is read again.
    """
    keys = ["comparison", region, "hap_id"]
    tests = cut_lineage(tests)
    doses = [
        column.alias(f"{arm}_{name}") for arm in ("case", "control") for name, column in (
            ("wt", F.col(f"{arm}_callable") - F.col(f"{arm}_carriers")), ("het", 2 * F.col(f"{arm}_carriers") - F.col(f"{arm}_copies")),
            ("hom", F.col(f"{arm}_copies") - F.col(f"{arm}_carriers")),
        )
    ]
    risk = dose_risk(tests.select(*keys, *doses), keys)
    named = {"odds_ratio": "dose_or", "ci_low": "dose_ci_low", "ci_high": "dose_ci_high", "p_value": "dose_p", "model": "dose_model"}
    return tests.join(risk.select(*keys, *[F.col(a).alias(b) for a, b in named.items()]), keys, "left")


def best_per_region(tests: DataFrame, keys: list[str], p: str, name: str) -> DataFrame:
    """Tests, significant count and best haplotype per region."""
    best = F.min(F.struct(F.col(p).isNull().alias("missing"), F.col(p).alias("p"), F.col(name).alias("name")))
    return tests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_tests"), F.count_if(F.col(p) < 0.05).alias("n_nominal"), best["name"].alias("best_name"), best["p"].alias("best_p")
    )


def frequency_with_other(counts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Top haplotypes per group and one Other bucket, as shares of the group."""
    top = top_k(counts, keys, [F.desc("n"), F.asc("hap")], k).select(*keys, "hap", F.lit(True).alias("_kept"))
    labelled = counts.join(top, [*keys, "hap"], "left").withColumn("hap", F.when(F.col("_kept"), F.col("hap")).otherwise("Other"))
    return share_of(labelled.groupBy(*keys, "hap").agg(F.sum("n").alias("n")), keys, "n")


def haplotypes_with_sites(counts: DataFrame, places: list[int], keys: list[str]) -> DataFrame:
    """Copies and summed frequency by the pattern of the chosen places in the string."""
    pattern = F.concat(*[F.substring("hap", p, 1) for p in places])
    return counts.groupBy(*keys, pattern.alias("pattern")).agg(
        F.count(F.lit(1)).alias("n_haplotypes"), F.sum("n").alias("n"), F.sum("freq").alias("freq")
    )


def top_mass(counts: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """Summed frequency of the k most frequent haplotypes."""
    return top_k(counts, keys, [F.desc("n"), F.asc("hap")], k).groupBy(*keys).agg(F.sum("freq").alias("top_mass"))


# --- unphased estimation -----------------------------------------------------------------------


def em_haplotypes(genotypes: DataFrame, region: str = "region", passes: int = 50, tolerance: float = 1e-7, display: float = 0.005) -> DataFrame:
    """Haplotype frequencies from unphased dosage strings by expectation-maximisation.

    ``genotypes``: sample, region, g (one digit 0, 1 or 2 per site, MAX_SITES at most). ``converged`` is a region's own: false where ``passes`` ran out.
    Equal strings are one weighted row; a string with h heterozygous sites expands to 2^(h-1) pairs
    once, and a pass is one join with the frequency table and two aggregates.
    """
    distinct = genotypes.where(~F.col("g").contains("9")).groupBy(region, "g").agg(F.count(F.lit(1)).cast("double").alias("w"))
    distinct = distinct.where(bounded_sites(F.length("g").cast("bigint")) >= 0)
    hets = F.length(F.regexp_replace("g", "[^1]", ""))
    choices = F.sequence(F.lit(0), F.pow(F.lit(2.0), F.greatest(hets - 1, F.lit(0)).cast("double")).cast("int") - 1)
    digits = F.filter(F.split("g", ""), lambda d: d != "")
    expanded = distinct.select("*", F.explode(choices).alias("_c"), digits.alias("_d"))
    # The first heterozygous site is fixed; bit m of the choice sets the m-th later one.
    seen = lambda i: F.size(F.filter(F.slice("_d", 1, i), lambda d: d == "1"))

    def allele(d: Column, i: Column, flip: bool) -> Column:
        order = seen(i + 1) - 2
        bit = F.when(order < 0, F.lit(0)).otherwise(
            (F.floor(F.col("_c") / F.pow(F.lit(2.0), order.cast("double"))) % 2).cast("int")
        )
        het = bit if not flip else 1 - bit
        return F.when(d == "0", "0").when(d == "2", "1").otherwise(het.cast("string"))

    pairs = cut_lineage(expanded.select(
        region, "g", "w", "_c",
        F.array_join(F.transform("_d", lambda d, i: allele(d, i, False)), "").alias("h1"),
        F.array_join(F.transform("_d", lambda d, i: allele(d, i, True)), "").alias("h2"),
    ))
    total = pairs.select(region, "g", "w").distinct().groupBy(region).agg((2 * F.sum("w")).alias("_copies"))
    both = F.explode(F.array("h1", "h2")).alias("hap")
    share = pairs.join(pairs.groupBy(region, "g").agg(F.count(F.lit(1)).alias("_m")), [region, "g"])
    freq = cut_lineage(
        share.select(region, both, (F.col("w") / F.col("_m")).alias("_e")).groupBy(region, "hap").agg(F.sum("_e").alias("_e"))
        .join(total, region).select(region, "hap", (F.col("_e") / F.col("_copies")).alias("f"))
    )
    done = None
    for left in reversed(range(passes)):
        f1 = freq.select(region, F.col("hap").alias("h1"), F.col("f").alias("f1"))
        f2 = freq.select(region, F.col("hap").alias("h2"), F.col("f").alias("f2"))
        joint = pairs.join(f1, [region, "h1"]).join(f2, [region, "h2"]).withColumn("_q", F.col("f1") * F.col("f2"))
        norm = joint.groupBy(region, "g").agg(F.sum("_q").alias("_z"))
        new = (
            joint.join(norm, [region, "g"]).select(region, both, F.try_divide(F.col("w") * F.col("_q"), F.col("_z")).alias("_e"))
            .groupBy(region, "hap").agg(F.sum("_e").alias("_e")).join(total, region)
            .select(region, "hap", (F.col("_e") / F.col("_copies")).alias("f"))
            .join(freq.withColumnRenamed("f", "_old"), [region, "hap"])
        )
        gaps = new.groupBy(region).agg(F.max(F.abs(F.col("f") - F.col("_old"))).alias("_gap"))
        judged = cut_lineage(new.drop("_old").join(gaps.select(region, (F.col("_gap") < tolerance).alias("converged")), region))
        # Regions at rest leave with their frequencies; only the others take part in the next pass.
        rest = judged if left == 0 else judged.where("converged")
        done = rest if done is None else done.unionByName(rest)
        freq = judged.where(~F.col("converged")).drop("converged")
        if left == 0 or freq.isEmpty():
            break
    return done.where(F.col("f") >= display).withColumnRenamed("f", "freq")


# --- comparison with another panel --------------------------------------------------------------


def frequency_concordance(a: DataFrame, b: DataFrame, keys: list[str], item: str = "hap") -> DataFrame:
    """Shared mass, Jensen-Shannon distance (base 2), largest difference and shared items."""
    p, q = F.coalesce("_p", F.lit(0.0)), F.coalesce("_q", F.lit(0.0))
    both = a.select(*keys, item, F.col("freq").alias("_p")).join(b.select(*keys, item, F.col("freq").alias("_q")), [*keys, item], "full_outer")
    mid = (p + q) / 2.0
    term = lambda x: F.when(x > 0, x * F.log2(x / mid)).otherwise(0.0)
    return both.groupBy(*keys).agg(
        F.sum(F.least(p, q)).alias("shared_mass"),
        F.sqrt(F.greatest(F.sum(term(p) + term(q)) / 2.0, F.lit(0.0))).alias("js_distance"),
        F.max(F.abs(p - q)).alias("max_difference"),
        F.count_if((p > 0) & (q > 0)).alias("n_shared"), F.count(F.lit(1)).alias("n_items"),
    )


def block_overlap(a: DataFrame, b: DataFrame, block_a: str, block_b: str, item: str) -> DataFrame:
    """Jaccard overlap and exact match of all blocks sharing an item, and the best partner of each.

    Blocks without a common item have overlap 0 and no row.
    """
    sa = a.groupBy(block_a).agg(F.countDistinct(item).alias("size_a"))
    sb = b.groupBy(block_b).agg(F.countDistinct(item).alias("size_b"))
    shared = a.select(block_a, item).distinct().join(b.select(block_b, item).distinct(), item).groupBy(block_a, block_b).agg(
        F.count(F.lit(1)).alias("n_shared")
    )
    jaccard = F.col("n_shared") / (F.col("size_a") + F.col("size_b") - F.col("n_shared"))
    scored = shared.join(sa, block_a).join(sb, block_b).withColumn("jaccard", jaccard)
    best = scored.groupBy(block_a).agg(F.max_by(F.col(block_b), F.struct("jaccard", block_b)).alias("_best"))
    return scored.join(best, block_a).select(
        block_a, block_b, "n_shared", "size_a", "size_b", "jaccard", (F.col("jaccard") == 1).alias("exact"),
        (F.col(block_b) == F.col("_best")).alias("best_partner"),
    )


def frequency_checks(recomputed: DataFrame, stored: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Recomputed against stored frequency with the absolute difference and a verdict."""
    joined = recomputed.select(*keys, F.col(value).alias("recomputed")).join(stored.select(*keys, F.col(value).alias("stored")), keys, "full_outer")
    delta = F.abs(F.col("recomputed") - F.col("stored"))
    return joined.withColumn("abs_delta", delta).withColumn(
        "verdict", F.when(delta.isNull(), "Missing_side").when(delta <= tolerance, "Match").otherwise("Mismatch")
    )
