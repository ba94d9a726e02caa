"""Linkage between loci, blocks of linked loci, and block roll-ups."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from carrierlake.session import cut_lineage

MAX_BLOCK = 12
TIE = 1e-9  # a value at the threshold counts, whatever its last bit


def ld_r2(calls: DataFrame, region: str, order: str, window: int, min_shared: int = 3) -> DataFrame:
    """Squared correlation of dosages for loci at most ``window`` places apart in their region.

    ``calls``: sample, region, order number, dosage (absent = not called). Each call looks up
    its followers by (sample, place), so a sample yields ``window`` rows per call, never all
    pairs, and the lookup key is unique.
    """
    base = calls.select("sample", region, F.col(order).cast("int").alias("i"), F.col("dosage").cast("double").alias("x"))
    ahead = base.withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("i") + window)))
    partner = base.select("sample", region, F.col("i").alias("j"), F.col("x").alias("y"))
    x, y = F.col("x"), F.col("y")
    sums = ahead.join(partner, ["sample", region, "j"]).groupBy(region, "i", "j").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
    )
    return _correlated(sums, [region, "i", "j"], min_shared)


def _correlated(sums: DataFrame, keys: list[str], min_shared: int) -> DataFrame:
    """Shared samples and r2 from n, sx, sy, sxx, syy, sxy; null with few samples or a constant side."""
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    r2 = F.when((n >= min_shared) & (vx > 0) & (vy > 0), F.try_divide(cov * cov, vx * vy))
    return sums.select(*keys, n.cast("bigint").alias("n_shared"), r2.alias("r2"))


def loci_within(
    loci: DataFrame, region: str, locus: str, pos: str, distance: int, same: list[str] = [], values: list[str] = []  # noqa: B006
) -> DataFrame:
    """(region, i, j) of distinct loci at most ``distance`` base pairs apart, each pair once, i before j by (position, locus).

    Bins are as wide as the distance, so partners lie in a locus's own bin or the next: each locus is looked up twice. Where loci have rows
    per ``same``, only rows that agree in it meet; ``values`` come along as ``_x`` and ``_y``.
    """
    tagged = lambda tag: [*same, *[F.col(c).alias(f"{c}_{tag}") for c in values]]
    base = loci.select(region, F.col(locus).alias("i"), F.col(pos).cast("bigint").alias("_p"), *same, *values)
    bin_of = F.floor(F.col("_p") / F.lit(max(distance, 1)))
    here = base.select(region, "i", "_p", *tagged("x"), F.explode(F.array(bin_of, bin_of + 1)).alias("_bin"))
    there = base.select(region, F.col("i").alias("j"), F.col("_p").alias("_q"), *tagged("y"), bin_of.alias("_bin"))
    later = (F.col("_q") > F.col("_p")) | ((F.col("_q") == F.col("_p")) & (F.col("j") > F.col("i")))
    both = here.join(there, [region, *same, "_bin"]).where(later & (F.col("_q") - F.col("_p") <= distance))
    return both.select(region, "i", "j", *same, *[f"{c}_{tag}" for tag in "xy" for c in values])


def dosage_planes(calls: DataFrame, region: str, locus: str, number: str) -> DataFrame:
    """Sixty-four samples in three words per locus: called, dosage 1, dosage 2.

    ``number`` is a non-negative integer of the sample; gaps cost words, not results. One row per (sample, locus); rows with a null
    number or dosage are not called.
    """
    valid = calls.where(F.col(number).isNotNull() & F.col("dosage").isNotNull())
    bit = F.expr(f"shiftleft(1L, CAST(`{number}` % 64 AS INT))")
    plane = lambda test: F.bit_or(F.when(test, bit).otherwise(F.lit(0).cast("bigint")))
    return valid.groupBy(region, locus, F.floor(F.col(number) / 64).alias("word")).agg(
        plane(F.lit(True)).alias("called"), plane(F.col("dosage") == 1).alias("one"), plane(F.col("dosage") == 2).alias("two")
    )


def ld_by_distance(calls: DataFrame, region: str, locus: str, pos: str, number: str, distance: int, min_shared: int = 3) -> DataFrame:
    """r2 of all loci at most ``distance`` base pairs apart in their region, however many lie between them.

    ``calls``: region, locus, pos, a sample number and dosage 0, 1 or 2 (absent = not called). Pairs meet as words of 64 samples, and all
    six sums of a pair are bit counts of ANDs, so a pair costs a sixty-fourth of the join by sample. A word goes to its two bins of
    positions, not to each of its partners. Pairs without a common sample are left out.
    """
    planes = dosage_planes(calls, region, locus, number)
    loci = cut_lineage(calls.select(region, locus, pos).distinct())  # written, so its true size decides how it is joined
    placed = cut_lineage(planes.join(loci, [region, locus]))
    met = loci_within(placed, region, locus, pos, distance, ["word"], ["called", "one", "two"])
    count = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.col(b)))
    total = lambda c: F.sum(c).cast("double")
    sums = met.groupBy(region, "i", "j").agg(
        total(count("called_x", "called_y")).alias("n"),
        total(count("one_x", "called_y") + 2 * count("two_x", "called_y")).alias("sx"), total(count("called_x", "one_y") + 2 * count("called_x", "two_y")).alias("sy"),
        total(count("one_x", "called_y") + 4 * count("two_x", "called_y")).alias("sxx"), total(count("called_x", "one_y") + 4 * count("called_x", "two_y")).alias("syy"),
        total(count("one_x", "one_y") + 2 * count("one_x", "two_y") + 2 * count("two_x", "one_y") + 4 * count("two_x", "two_y")).alias("sxy"),
    )
    return _correlated(sums.where("n > 0"), [region, "i", "j"], min_shared)


def ld_blocks(
    pairs: DataFrame, loci: DataFrame, region: str, threshold: float = 0.8, least: int = 2, most: int = MAX_BLOCK
) -> DataFrame:
    """Greedy left-to-right blocks in which every pair reaches the threshold.

    ``pairs``: region, i, j, r2 with i < j. ``loci``: region, i. A block cannot cross two
    neighbours below the threshold, so each stretch between such breaks is independent and the
    walk starts afresh at its first locus. Inside a stretch the walk is a chain of jumps
    ``i -> end + 1``; the starts reached are found by doubling the jumps, so a stretch of any
    length takes a logarithmic number of joins instead of one task.
    """
    near = pairs.where((F.col("j") - F.col("i") < most) & (F.col("r2") >= threshold - TIE))
    # Coherent reach of i: the largest j such that every pair inside i..j is linked. Row i has
    # links to i+1..i+m without gap; the reach is the running minimum of those over the rows.
    links = near.groupBy(region, "i").agg(F.sort_array(F.collect_list((F.col("j") - F.col("i")).cast("int"))).alias("steps"))
    run = F.size(F.filter(F.col("steps"), lambda s: F.array_position(F.col("steps"), s) == s))
    base = loci.select(region, F.col("i").cast("int").alias("i")).distinct().join(
        links.select(region, "i", run.alias("run")), [region, "i"], "left"
    ).select(region, "i", F.coalesce("run", F.lit(0)).alias("run"))
    # reach(i) = min over m <= reach of (m + run(m)); at most ``most`` followers matter.
    follow = base.select(region, F.col("i").alias("m"), (F.col("i") + F.col("run")).alias("stop"))
    spread = base.withColumn("m", F.explode(F.sequence(F.col("i"), F.col("i") + most - 1)))
    stops = spread.join(follow, [region, "m"]).groupBy(region, "i").agg(
        F.sort_array(F.collect_list(F.struct("m", "stop"))).alias("seen")
    )
    reach = F.aggregate(
        "seen", F.col("i") + most - 1,
        lambda end, s: F.when(s["m"] <= end, F.least(end, s["stop"])).otherwise(end),
    )
    step = stops.select(region, "i", reach.alias("end"))
    jump = step.select(
        region, "i", "end",
        F.when(F.col("end") - F.col("i") + 1 >= least, F.col("end") + 1).otherwise(F.col("i") + 1).alias("next"),
    )
    linked_before = pairs.where((F.col("j") == F.col("i") + 1) & (F.col("r2") >= threshold - TIE)).select(region, F.col("j").alias("i"))
    jump = cut_lineage(jump)
    starts = jump.join(linked_before, [region, "i"], "left_anti").select(region, "i")
    reached = _reachable(jump.select(region, "i", "next"), starts, region)
    blocks = jump.join(reached, [region, "i"], "left_semi").where(F.col("end") - F.col("i") + 1 >= least)
    return blocks.select(
        region, F.col("i").alias("start"), "end", (F.col("end") - F.col("i") + 1).alias("size"),
    )


def _reachable(jump: DataFrame, starts: DataFrame, region: str) -> DataFrame:
    """Loci visited from the starts along ``next``, by doubling jumps until nothing is added."""
    reached, hop, size = cut_lineage(starts), jump, -1
    while True:
        added = reached.join(hop, [region, "i"]).select(region, F.col("next").alias("i"))
        reached = cut_lineage(reached.union(added).distinct())
        count = reached.count()
        if count == size:
            return reached
        size = count
        onward = hop.select(region, F.col("i").alias("next"), F.col("next").alias("_after"))
        hop = cut_lineage(hop.join(onward, [region, "next"]).select(region, "i", F.col("_after").alias("next")))


def block_members(blocks: DataFrame, region: str) -> DataFrame:
    """Membership rows with the order number inside the block."""
    exploded = blocks.withColumn("i", F.explode(F.sequence("start", "end")))
    return exploded.select(
        region, F.concat(F.lit("Block"), F.col("start")).alias("block"), "i", (F.col("i") - F.col("start") + 1).alias("snp_order"), "size"
    )


def region_definitions(members: DataFrame, region: list[str], pos: str, name: str) -> DataFrame:
    """Span, size and ordered member list per region; regions are blocks, so lists are short."""
    return members.groupBy(*region).agg(
        F.min(pos).alias("first"), F.max(pos).alias("last"), F.count(F.lit(1)).alias("n_members"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, name))), lambda s: s[name].cast("string")), "; ").alias("members"),
    )


def block_summary(tests: DataFrame, group: list[str], block: str, p: str, fdr: str, effect: str, alpha: float = 0.05) -> DataFrame:
    """Tests, best p and FDR, significant counts and effect range per block."""
    return tests.groupBy(*group, block).agg(
        F.count(F.lit(1)).alias("n_tests"), F.min(p).alias("min_p"), F.min(fdr).alias("min_fdr"),
        F.count_if(F.col(p) < alpha).alias("n_nominal"), F.count_if(F.col(fdr) < alpha).alias("n_fdr"),
        F.min(effect).alias("min_effect"), F.max(effect).alias("max_effect"),
    )


def partner_lists(pairs: DataFrame, region: str, threshold: float = 0.8) -> DataFrame:
    """Linked partners per locus as one string, of the pairs given: those of ``ld_r2``'s window or ``ld_by_distance``'s reach."""
    linked = pairs.where(F.col("r2") >= threshold - TIE)
    both = linked.select(region, "i", F.col("j").alias("partner")).union(linked.select(region, "j", F.col("i").alias("partner")))
    return both.groupBy(region, "i").agg(
        F.count(F.lit(1)).alias("n_partners"),
        F.array_join(F.transform(F.array_sort(F.collect_list("partner")), lambda v: v.cast("string")), ", ").alias("partners"),
    )


def block_rollup(rows: DataFrame, block: str, comparison: str, comparisons: list[str], gene: str, key: str, p: str) -> DataFrame:
    """Significant rows per block: size, genes, best p and one distinct-key count per comparison."""
    base = rows.groupBy(block).agg(
        F.countDistinct(key).alias("n_keys"), F.count(F.lit(1)).alias("n_rows"), F.min(p).alias("best_p"),
        F.countDistinct(gene).alias("n_genes"),
    )
    wide = rows.groupBy(block).pivot(comparison, comparisons).agg(F.countDistinct(key)).fillna(0)
    return base.join(wide, block)
