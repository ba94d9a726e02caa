"""Rare-variant burden: per-sample counts, gene flags, co-carried pairs, exposure catalogue."""

from pyspark.sql import DataFrame, functions as F

from carrierlake.session import spread


def sample_burden(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Distinct variants and genes per sample with any / multiple flags; samples without rows get zero.

    ``rows``: sample, variant, gene.
    """
    counts = rows.groupBy("sample").agg(F.countDistinct("variant").alias("n_variants"), F.countDistinct("gene").alias("n_genes"))
    return samples.select("sample").join(counts, "sample", "left").fillna(0, ["n_variants", "n_genes"]).select(
        "*", (F.col("n_variants") > 0).alias("any_rare"), (F.col("n_variants") > 1).alias("multiple_rare")
    )


def gene_burden(rows: DataFrame) -> DataFrame:
    """Distinct variants per sample and gene."""
    return rows.groupBy("sample", "gene").agg(F.countDistinct("variant").alias("n_variants"))


def co_carried_pairs(rows: DataFrame, variant: str, least: int) -> DataFrame:
    """Unordered variant pairs carried together by at least ``least`` samples.

    Variants under the threshold on their own cannot reach it in a pair and leave before the
    self-join; the join is reduced by partial counts. What is kept is dealt by sample once, for both sides.
    """
    distinct = rows.select("sample", variant).distinct()
    frequent = distinct.groupBy(variant).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(variant)
    (kept,) = spread((distinct.join(frequent, variant, "left_semi"), ["sample"]))
    a, b = kept.select("sample", F.col(variant).alias("first")), kept.select("sample", F.col(variant).alias("second"))
    return a.join(b, "sample").where("first < second").groupBy("first", "second").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def exposure_catalogue(rows: DataFrame, least: int = 1) -> DataFrame:
    """Long exposures: single variants, genes, and the any / multiple flags, with carriers."""
    exposures = F.inline(F.array(
        F.struct(F.lit("variant").alias("exposure_type"), F.col("variant").cast("string").alias("exposure")),
        F.struct(F.lit("gene").alias("exposure_type"), F.col("gene").cast("string").alias("exposure")),
        F.struct(F.lit("any").alias("exposure_type"), F.lit("any_rare").alias("exposure")),
    ))
    long = rows.select("sample", "variant", exposures)
    return long.groupBy("exposure_type", "exposure").agg(
        F.countDistinct("sample").alias("n_carriers"), F.countDistinct("variant").alias("n_components")
    ).where(F.col("n_carriers") >= least)


def variant_catalogue(rows: DataFrame) -> DataFrame:
    return rows.groupBy("variant", "gene").agg(F.countDistinct("sample").alias("n_carriers"), F.count(F.lit(1)).alias("n_rows"))
