"""Chromosome labels, variant keys, vocabulary maps and preference chains."""

from pyspark.sql import Column, functions as F

# Spellings that mean "no value".
MISSING_TOKENS = ["", ".", "na", "n/a", "nan", "none", "null", "-"]

# Tissue vocabulary.
TISSUE_LABELS = {
    "Tumor": "Tumour",
    "Tumour": "Tumour",
    "Normal": "Healthy",
    "Healthy": "Healthy",
    "Control": "Healthy",
}


def null_if_token(c: Column, tokens: list[str] = MISSING_TOKENS) -> Column:
    """Trimmed text, null when it is one of the spellings of missing."""
    text = F.trim(c.cast("string"))
    return F.when(~F.lower(text).isin(tokens), text)


def norm_chrom(c: Column) -> Column:
    """``17`` -> ``chr17``, ``chrx`` -> ``chrX``, ``MT`` -> ``chrM``; blank for null."""
    text = F.trim(c.cast("string"))
    suffix = F.regexp_replace(text, "(?i)^chr", "")
    upper = F.upper(suffix)
    return (
        F.when(text.isNull() | F.lower(text).isin("", "nan"), "")
        .when(upper.isin("M", "MT"), "chrM")
        .when(upper.isin("X", "Y"), F.concat(F.lit("chr"), upper))
        .otherwise(F.concat(F.lit("chr"), suffix))
    )


def chrom_rank(c: Column) -> Column:
    """Sort key: autosomes by number, then X, Y, M, then anything else by name."""
    suffix = F.upper(F.regexp_replace(norm_chrom(c), "^chr", ""))
    rank = (
        F.when(suffix.rlike("^[0-9]+$"), suffix.try_cast("int"))
        .when(suffix == "X", 1_000_001)
        .when(suffix == "Y", 1_000_002)
        .when(suffix == "M", 1_000_003)
        .otherwise(1_000_004)
    )
    return F.struct(rank.alias("rank"), suffix.alias("name"))


def map_labels(c: Column, mapping: dict[str, str] = TISSUE_LABELS) -> Column:
    """Vocabulary lookup on trimmed text; labels outside the map stay as they are."""
    text = F.trim(c)
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, text), text)


def coalesce_with_source(columns: list[str], meaningful=null_if_token) -> tuple[Column, Column]:
    """First meaningful value and the name of the column that supplied it."""
    values = [meaningful(F.col(name)) for name in columns]
    source = F.coalesce(*[F.when(v.isNotNull(), F.lit(n)) for v, n in zip(values, columns)])
    return F.coalesce(*values), source


def combine_frequency(exome: Column, genome: Column) -> tuple[Column, Column]:
    """One allele frequency from two sources, plus where it came from."""
    source = F.when(exome.isNotNull(), "Exome_NFE").when(genome.isNotNull(), "Genome_NFE").otherwise("Missing")
    return F.coalesce(exome, genome), source


def common_mask(threshold: float, *frequencies: Column) -> Column:
    """True when any frequency is strictly above the threshold; null counts as false."""
    flag = F.lit(False)
    for frequency in frequencies:
        flag = flag | F.coalesce(frequency.try_cast("double") > threshold, F.lit(False))
    return flag


def rare_mask(threshold: float, *frequencies: Column, include_missing: bool = True) -> Column:
    """Complement of :func:`common_mask`; rows without any frequency are optional."""
    rare = ~common_mask(threshold, *frequencies)
    return rare if include_missing else rare & F.coalesce(*frequencies).isNotNull()


def first_rsid(c: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(c.cast("string"), "(?i)(rs[0-9]+)", 1), F.lit("")))


def all_rsids(c: Column) -> Column:
    """Distinct ids in the text, lower case and sorted."""
    found = F.regexp_extract_all(F.lower(c.cast("string")), F.lit("(rs[0-9]+)"), 1)
    return F.array_sort(F.array_distinct(found))


def locus_key(chrom: Column, pos: Column, ref: Column) -> Column:
    """``chr:pos:REF``, null when any part is missing."""
    label = F.nullif(norm_chrom(chrom), F.lit(""))
    parts = [label, pos.try_cast("bigint").cast("string"), null_if_token(F.upper(ref), ["", "nan", "none"])]
    return F.when(_all_present(parts), F.concat_ws(":", *parts))


def variant_key(chrom: Column, pos: Column, ref: Column, alt: Column, existing: Column | None = None) -> Column:
    """Existing key first, else ``chr:pos:REF:ALT``; null when any part is missing."""
    tail = null_if_token(F.upper(alt), ["", "nan", "none"])
    head = locus_key(chrom, pos, ref)
    built = F.when(head.isNotNull() & tail.isNotNull(), F.concat_ws(":", head, tail))
    return built if existing is None else F.coalesce(null_if_token(existing, ["", "nan", "none"]), built)


def _all_present(parts: list[Column]) -> Column:
    flag = F.lit(True)
    for part in parts:
        flag = flag & part.isNotNull()
    return flag


def neg_log10_p(p: Column, floor: float = 1e-300) -> Column:
    return -F.log10(F.greatest(p, F.lit(floor)))


def display_label(rsid: Column, gene: Column, pos: Column, key: Column) -> Column:
    """rs id, else ``gene:pos``, else the raw key."""
    gene_text = null_if_token(gene)
    by_gene = F.when(
        gene_text.isNotNull() & pos.isNotNull(), F.concat_ws(":", gene_text, pos.cast("string"))
    )
    return F.coalesce(null_if_token(rsid), by_gene, key)


def extract_code(c: Column, patterns: list[tuple[str, str]]) -> Column:
    """First matching pattern wins; its group 1 is rendered with the given format."""
    options = []
    for pattern, template in patterns:
        hit = F.regexp_extract(c, pattern, 1)
        options.append(F.when(c.rlike(pattern) & (hit != ""), F.format_string(template, hit.try_cast("bigint"))))
    return F.coalesce(*options)


def interval_label(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
