"""Consequence terms, impact tiers and predictor text."""

from pyspark.sql import Column, functions as F

from carrierlake.functions.keys import null_if_token

# Consequence terms from most to least severe, with impact tier and report class.
CONSEQUENCES = [
    ("transcript_ablation", "HIGH", "other"),
    ("splice_acceptor_variant", "HIGH", "splice_site"),
    ("splice_donor_variant", "HIGH", "splice_site"),
    ("stop_gained", "HIGH", "nonsense"),
    ("frameshift_variant", "HIGH", "frameshift"),
    ("stop_lost", "HIGH", "other"),
    ("start_lost", "HIGH", "other"),
    ("transcript_amplification", "HIGH", "other"),
    ("inframe_insertion", "MODERATE", "other"),
    ("inframe_deletion", "MODERATE", "other"),
    ("missense_variant", "MODERATE", "missense"),
    ("protein_altering_variant", "MODERATE", "other"),
    ("splice_donor_5th_base_variant", "LOW", "splice_site"),
    ("splice_region_variant", "LOW", "splice_site"),
    ("splice_polypyrimidine_tract_variant", "LOW", "splice_site"),
    ("synonymous_variant", "LOW", "synonymous"),
    ("start_retained_variant", "LOW", "other"),
    ("stop_retained_variant", "LOW", "other"),
    ("5_prime_UTR_variant", "MODIFIER", "utr"),
    ("3_prime_UTR_variant", "MODIFIER", "utr"),
    ("non_coding_transcript_exon_variant", "MODIFIER", "other"),
    ("intron_variant", "MODIFIER", "intronic"),
    ("upstream_gene_variant", "MODIFIER", "regulatory"),
    ("downstream_gene_variant", "MODIFIER", "regulatory"),
    ("regulatory_region_variant", "MODIFIER", "regulatory"),
    ("intergenic_variant", "MODIFIER", "intergenic"),
]
IMPACTS = ["HIGH", "MODERATE", "LOW", "MODIFIER"]
UNKNOWN_RANK = 999


def _lookup(key: Column, table: dict) -> Column:
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(literal, key)


def consequence_rank(term: Column) -> Column:
    ranks = {name: i for i, (name, _, _) in enumerate(CONSEQUENCES)}
    return F.coalesce(_lookup(term, ranks), F.lit(UNKNOWN_RANK))


def consequence_terms(text: Column) -> Column:
    """Terms in order of appearance, blanks and repeats dropped."""
    parts = F.transform(F.split(F.coalesce(null_if_token(text), F.lit("")), "[,&]"), lambda t: F.trim(t))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def worst_consequence(text: Column) -> Column:
    """Most severe term; the first one wins among equals; blank for no term."""
    ranked = F.transform(
        consequence_terms(text),
        lambda t, i: F.struct(consequence_rank(t).alias("rank"), i.alias("place"), t.alias("term")),
    )
    return F.coalesce(F.array_min(ranked)["term"], F.lit(""))


def functional_class(term: Column) -> Column:
    table = {name: label for name, _, label in CONSEQUENCES}
    return F.when(term == "", "").otherwise(F.coalesce(_lookup(term, table), F.lit("other")))


def infer_impact(term: Column) -> Column:
    table = {name: tier for name, tier, _ in CONSEQUENCES}
    return F.when(term == "", "").otherwise(F.coalesce(_lookup(term, table), F.lit("MODIFIER")))


def impact_rank(impact: Column) -> Column:
    table = {name: i for i, name in enumerate(IMPACTS)}
    return F.coalesce(_lookup(F.upper(F.trim(impact)), table), F.lit(99))


def parse_predictor(raw: Column, fallback: Column, labels: list[str], letters: dict[str, str]) -> Column:
    """Class named in the raw text, else the first known letter of the fallback codes."""
    text = F.lower(F.coalesce(null_if_token(raw), F.lit("")))
    named = F.coalesce(*[F.when(text.contains(label), F.lit(label)) for label in labels])
    tokens = F.regexp_extract_all(
        F.upper(F.coalesce(null_if_token(fallback), F.lit(""))), F.lit("([A-Z]+)"), 1
    )
    known = F.filter(tokens, lambda t: t.isin(list(letters)))
    return F.coalesce(named, _lookup(F.get(known, F.lit(0)), letters), F.lit(""))


def sift_class(raw: Column, fallback: Column) -> Column:
    """The earliest of the two words in the text decides."""
    text = F.lower(F.coalesce(null_if_token(raw), F.lit("")))
    first = F.nullif(F.regexp_extract(text, "(deleterious|tolerated)", 1), F.lit(""))
    return F.coalesce(first, parse_predictor(F.lit(""), fallback, ["deleterious"], {"D": "deleterious", "T": "tolerated"}))


def polyphen_class(raw: Column, fallback: Column) -> Column:
    return parse_predictor(
        raw,
        fallback,
        ["probably_damaging", "possibly_damaging", "benign"],
        {"D": "probably_damaging", "P": "possibly_damaging", "B": "benign"},
    )


def yes_flag(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c)).isin("YES", "Y", "TRUE", "1"), F.lit(False))
