"""Benjamini-Hochberg correction in any family."""

from pyspark.sql import DataFrame, Window, functions as F

from carrierlake.operators.ranking import known, value_band, value_ranks
from carrierlake.session import cut_lineage


def bh_fdr(df: DataFrame, p: str, family: list[str], out: str = "fdr") -> DataFrame:
    """Adjusted p per family; null p stays null and does not count; a single test is unchanged.

    Works on distinct (family, p), so tied p values (for example a third of all tests at 1.0)
    are one row, and the running minimum is taken per band with the later bands' minimum added.
    """
    ranked = value_ranks(df, family, p).select(
        *family,
        p,
        value_band(F.col(p)).alias("_band"),
        (F.col(p) * F.col("n") / (F.col("n_before") + F.col("ties"))).alias("_q"),
    )
    later = Window.partitionBy(*family).orderBy(F.col("_band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bands = (
        ranked.groupBy(*family, "_band")
        .agg(F.min("_q").alias("_least"))
        .withColumn("_later", F.min("_least").over(later))
        .drop("_least")
    )
    inside = (
        Window.partitionBy(*family, "_band").orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    )
    adjusted = ranked.join(bands, [*family, "_band"]).select(
        *family, p, F.least(F.lit(1.0), F.min("_q").over(inside), F.col("_later")).alias(out)
    )
    # tests of one tied p are a side that Spark's skew join can split; null p values meet no join
    found = df.where(known(p)).join(adjusted, [*family, p])
    return found.unionByName(df.where(~known(p)).withColumn(out, F.lit(None).cast("double")))


def block_fdr(
    df: DataFrame, p: str, group: list[str], block: str, key: str, out: str = "block_fdr", legacy: str = "group_fdr"
) -> DataFrame:
    """FDR inside each block and over the whole group; a key without block is its own block."""
    placed = df.withColumn(block, F.coalesce(F.col(block), F.concat(F.lit("Singleton::"), F.col(key).cast("string"))))
    sizes = placed.groupBy(*group, block).agg(F.count(F.lit(1)).alias("block_tests"))
    both = bh_fdr(cut_lineage(bh_fdr(cut_lineage(placed), p, [*group, block], out)), p, group, legacy)
    return both.join(sizes, [*group, block])
