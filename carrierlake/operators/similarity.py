"""Sample identity: genotype digests, alias groups and pair concordance."""

from pyspark.sql import DataFrame, Window, functions as F

from carrierlake.session import cut_lineage

CALLABLE = ["WT", "Het_ALT", "Hom_ALT", "Other_ALT_model"]
NON_REFERENCE = ["Het_ALT", "Hom_ALT", "Other_ALT_model"]


def genotype_digest(calls: DataFrame, sample: str = "sample") -> DataFrame:
    """Order-free digest of all (locus, call) rows of a sample plus their number.

    Two independent 64-bit sums of row hashes: partial aggregates, no list of loci is gathered.
    """
    part = lambda seed: F.sum(F.pmod(F.xxhash64("locus", "call", F.lit(seed)), F.lit(2**61 - 1)).cast("decimal(20,0)"))
    return calls.groupBy(sample).agg(
        F.count(F.lit(1)).alias("n_loci"), F.sha2(F.concat_ws("|", part(1).cast("string"), part(2).cast("string"), F.count(F.lit(1)).cast("string")), 256).alias("digest")
    )


def identity_groups(digests: DataFrame, codes: DataFrame, code: str, sample: str = "sample") -> DataFrame:
    """Runs of one code with equal digests become one analysis id; distinct genotypes stay apart.

    Groups are formed per (code, digest) first, so copies of one sample are one row when the
    groups of a code are numbered.
    """
    joined = digests.join(codes.select(sample, code), sample)
    groups = joined.groupBy(code, "digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(sample).alias("root"))
    per_code = groups.groupBy(code).agg(F.count(F.lit(1)).alias("n_groups"))
    order = F.row_number().over(Window.partitionBy(code).orderBy("root"))
    numbered = groups.withColumn("group_order", order).join(per_code, code)
    analysis = F.when(F.col("n_groups") == 1, F.col(code).cast("string")).otherwise(F.concat_ws("_run", F.col(code).cast("string"), "group_order"))
    return joined.join(numbered, [code, "digest"]).select(
        sample, code, "group_order", "group_size", "n_groups", (F.col("group_size") > 1).alias("collapsed_alias"), analysis.alias("analysis_id")
    )


def pair_concordance(pairs: DataFrame, calls: DataFrame, classes: DataFrame) -> DataFrame:
    """Concordance of candidate sample pairs over all, common and rare loci, and non-reference overlap.

    ``pairs``: sample_1, sample_2. ``calls``: sample, locus, status. ``classes``: locus,
    frequency_class. The work is pairs x loci of a sample; no pair is made here.
    """
    rows = calls.join(classes, "locus", "left").withColumn("frequency_class", F.coalesce("frequency_class", F.lit("mixed")))
    side = lambda i: rows.select(F.col("sample").alias(f"sample_{i}"), "locus", F.col("status").alias(f"s{i}"), F.col("frequency_class").alias(f"c{i}"))
    keys = ["sample_1", "sample_2"]
    left = pairs.select(*keys).join(side(1), "sample_1")
    right = pairs.select(*keys).join(side(2), "sample_2")
    both = left.join(right, [*keys, "locus"], "full_outer").withColumn("cls", F.coalesce("c1", "c2"))
    use = F.coalesce(F.col("s1").isin(CALLABLE) & F.col("s2").isin(CALLABLE), F.lit(False))
    same = use & (F.col("s1") == F.col("s2"))
    n1, n2 = (F.coalesce(F.col(s).isin(NON_REFERENCE), F.lit(False)) for s in ("s1", "s2"))
    inside = lambda name: F.lit(True) if name == "all" else F.col("cls") == name
    counts = [e for name in ("all", "common", "rare") for e in (
        F.count_if(use & inside(name)).alias(f"comparable_{name}"), F.count_if(same & inside(name)).alias(f"exact_{name}"))]
    counts += [e for name in ("common", "rare") for e in (
        F.count_if(n1 & n2 & inside(name)).alias(f"shared_{name}"), F.count_if((n1 | n2) & inside(name)).alias(f"union_{name}"))]
    out = both.groupBy(*keys).agg(*counts)
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return out.select(
        "*", *[ratio(f"exact_{n}", f"comparable_{n}").alias(f"concordance_{n}") for n in ("all", "common", "rare")],
        *[ratio(f"shared_{n}", f"union_{n}").alias(f"jaccard_{n}") for n in ("common", "rare")],
    )


def classify_pairs(pairs: DataFrame, same_code: str, same_digest: str) -> DataFrame:
    code, digest = F.coalesce(F.col(same_code), F.lit(False)), F.coalesce(F.col(same_digest), F.lit(False))
    label = (
        F.when(code & ~digest, "SAME_CODE_DISTINCT_GENOTYPE_KEEP_SEPARATE")
        .when(code & digest, "SAME_CODE_EXACT_ALIAS_WITHIN_CURRENT_RULE")
        .when(F.col("concordance_all") == 1.0, "DIFFERENT_CODE_IDENTICAL_REVIEW_ONLY_KEEP_SEPARATE")
        .when(F.col("concordance_all") >= 0.99, "DIFFERENT_CODE_NEAR_IDENTICAL_REVIEW_ONLY_KEEP_SEPARATE")
        .otherwise("DISTINCT_SAMPLES")
    )
    return pairs.withColumn("classification", label)


#: Bands of a signature and hashes per band: sets of Jaccard 0.9 share no band once in about 10^8 pairs, sets of 0.2 share one in 700.
BANDS, PER_BAND = 24, 6
#: Members of a bucket that meet in one task.
BLOCK = 256


#: Differences up to which a signature takes two of d + 2 parts; beyond, one of d + 1.
PAIRED_PARTS = 5
#: Differences beyond which the number of parts goes up in steps of a quarter.
EVERY_NUMBER = 16


def _parts_table(calls: DataFrame, threshold: float) -> DataFrame:
    """(sample, size, band, key): sets with a Jaccard similarity of ``threshold`` or more share at least one (band, key), without exception.

    Sets of n and m tokens at the threshold differ in at most d = (n + m)(1 - t)/(1 + t) tokens. Tokens are dealt to d + 2 parts by hash, so
    at least two parts hold no difference (one of d + 1). Each sample files itself under every d a partner of allowed size can give.
    A key covers about ten tokens or more, so samples that are not alike rarely share one. Rows of ``calls`` are distinct.
    """
    sizes = calls.groupBy("sample").agg(F.count(F.lit(1)).alias("size"))
    gap = 1 - threshold
    differences = F.sequence(F.floor(F.col("size") * gap - 1e-9), F.floor(F.col("size") * gap / threshold + 1e-9))
    step = lambda d: F.ceil(EVERY_NUMBER * F.pow(F.lit(1.25), F.ceil(F.log(d / F.lit(float(EVERY_NUMBER))) / F.log(F.lit(1.25)) - 1e-9)))
    band = lambda d: F.when(d <= EVERY_NUMBER, d).otherwise(F.greatest(d, step(d)))
    filed = sizes.where("size > 0").withColumn("band", F.explode(F.array_distinct(F.transform(differences, band))))
    parts = F.col("band") + F.when(F.col("band") <= PAIRED_PARTS, 2).otherwise(1)
    dealt = calls.select("sample", F.xxhash64("locus", "call").alias("_t")).join(filed, "sample").withColumn("_part", F.pmod(F.xxhash64("_t", "band"), parts))
    digests = dealt.groupBy("sample", "size", "band", "_part").agg(F.xxhash64(F.bit_xor(F.xxhash64("_t", F.lit(1))), F.count(F.lit(1))).alias("_d"))
    whole = digests.groupBy("sample", "size", "band").agg(F.map_from_entries(F.collect_list(F.struct("_part", "_d"))).alias("_m"))
    every = F.sequence(F.lit(0).cast("bigint"), parts - 1)
    digest = lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0).cast("bigint"))
    one = F.transform(every, lambda i: F.xxhash64(F.col("band"), i, digest(i)))
    two = F.flatten(F.transform(every, lambda i: F.transform(F.filter(every, lambda j: j > i), lambda j: F.xxhash64(F.col("band"), i, j, digest(i), digest(j)))))
    return whole.select("sample", "size", "band", F.explode(F.when(F.col("band") <= PAIRED_PARTS, two).otherwise(one)).alias("key"))


def candidate_pairs(calls: DataFrame, bands: int = BANDS, per_band: int = PER_BAND, block: int = BLOCK, *, threshold: float | None = None) -> DataFrame:
    """Pairs (sample_1 < sample_2) whose (locus, call) sets may be alike.

    With a ``threshold`` every pair of that Jaccard similarity is among them: sets that agree in parts (see ``_parts_table``) and whose sizes
    allow it. Without, sets that agree in a band of their minwise signatures, which is one aggregate. A bucket of many members is cut into
    blocks, and each pair of blocks meets by itself, so one common signature doesn't fill a task; the pairs of a bucket still grow with its
    square, so equal genotypes should be one row (``representatives``).
    """
    if threshold is None:
        token = F.xxhash64("locus", "call")
        least = [F.min(F.xxhash64(F.col("_t"), F.lit(i))).alias(f"m{i}") for i in range(bands * per_band)]
        signed = calls.select("sample", token.alias("_t")).groupBy("sample").agg(*least)
        own = [F.struct(F.lit(b).alias("band"), F.xxhash64(*[f"m{b * per_band + i}" for i in range(per_band)]).alias("key")) for b in range(bands)]
        filed = signed.select("sample", F.lit(1).cast("bigint").alias("size"), F.inline(F.array(*own)))
    else:
        filed = _parts_table(calls, threshold)
    buckets = cut_lineage(filed)
    sizes = buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")
    crowded = buckets.join(sizes, ["band", "key"]).withColumn("_parts", F.ceil(F.col("_m") / block).cast("int"))
    placed = crowded.withColumn("_part", F.pmod(F.xxhash64("sample"), F.col("_parts")).cast("int")).drop("_m")
    left = placed.select("band", "key", F.col("sample").alias("_a"), F.col("size").alias("_n"), F.col("_part").alias("_i"), F.explode(F.sequence(F.col("_part"), F.col("_parts") - 1)).alias("_j"))
    right = placed.select("band", "key", F.col("sample").alias("_b"), F.col("size").alias("_o"), F.col("_part").alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_part"))).alias("_i"))
    met = left.join(right, ["band", "key", "_i", "_j"]).where((F.col("_i") < F.col("_j")) | (F.col("_a") < F.col("_b")))
    if threshold is not None:
        met = met.where(F.least("_n", "_o") >= F.greatest("_n", "_o") * threshold - 1e-9)
    return met.select(F.least("_a", "_b").alias("sample_1"), F.greatest("_a", "_b").alias("sample_2")).distinct()


def representatives(digests: DataFrame) -> DataFrame:
    """(sample, n_loci, copies): the least sample of each genotype digest, for all samples that share it."""
    return digests.groupBy("digest").agg(F.min("sample").alias("sample"), F.first("n_loci").alias("n_loci"), F.count(F.lit(1)).alias("copies"))


def near_identical(calls: DataFrame, classes: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Pairs of different genotypes whose call sets have a Jaccard similarity of ``threshold`` or more, with their concordances.

    Nothing is passed in: candidates agree in parts, which no such pair can fail to do, and are then scored exactly. ``calls``: sample, locus, call. One sample stands for
    those of equal genotype; ``representatives`` says which.
    """
    rows = cut_lineage(calls.select("sample", "locus", "call").distinct())
    chosen = cut_lineage(representatives(genotype_digest(rows)))
    own = cut_lineage(rows.join(chosen.select("sample"), "sample", "left_semi"))
    pairs = cut_lineage(candidate_pairs(own, threshold=threshold))
    size = lambda i: chosen.select(F.col("sample").alias(f"sample_{i}"), F.col("n_loci").alias(f"n_{i}"), F.col("copies").alias(f"copies_{i}"))
    keys = ["sample_1", "sample_2"]
    tokens = own.select("sample", "locus", "call")
    shared = (
        pairs.join(tokens.withColumnRenamed("sample", "sample_1"), "sample_1").join(tokens.withColumnRenamed("sample", "sample_2"), ["sample_2", "locus", "call"])
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("shared")).join(size(1), "sample_1").join(size(2), "sample_2")
    )
    jaccard = F.col("shared") / (F.col("n_1") + F.col("n_2") - F.col("shared"))
    close = cut_lineage(shared.withColumn("jaccard", jaccard).where(F.col("jaccard") >= threshold).select(*keys, "copies_1", "copies_2", "jaccard"))
    return close.join(pair_concordance(close.select(*keys), own.withColumnRenamed("call", "status"), classes), keys)
