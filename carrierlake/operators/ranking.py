"""Running totals, ranks and quantiles over keys of any size.

A window over one key puts that key's rows into one task, so a key holding a third of the
data would stall the job. Here every (key, value) is first reduced to one row, the ordered
axis is cut into bands by a monotone function of the value, and the window runs per
(key, band); only the band totals, a few thousand rows per key at most, are ordered per key.
The result is exact: the bands decide where work happens, not what is computed.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

BANDS_PER_OCTAVE = 16


def value_band(value: Column, per_octave: int = BANDS_PER_OCTAVE) -> Column:
    """Monotone band number on a signed logarithmic axis; zero is its own band."""
    magnitude = F.abs(value.cast("double"))
    step = F.floor((F.log2(magnitude) + 1100.0) * per_octave) + 1
    return F.when(magnitude > 0, F.signum(value.cast("double")).cast("bigint") * step).otherwise(F.lit(0).cast("bigint"))


def known(*columns: str) -> Column:
    """Rows that take part in an order: no column is null or NaN."""
    tests = [F.col(c).isNotNull() & ~F.isnan(F.col(c).try_cast("double")).eqNullSafe(True) for c in columns]
    return reduce(lambda a, b: a & b, tests)


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, Column],
    band: Column | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add ``<name>_upto`` (inclusive running sum along ``order``) and ``<name>_total`` per key.

    ``df`` must hold one row per (keys, order); see ``known`` for nulls and NaN.
    """
    by = [*keys, "_band"]
    names = list(sums)
    base = df.select(
        "*", (value_band(F.col(order)) if band is None else band).alias("_band"),
        *[expr.alias(f"_v_{name}") for name, expr in sums.items()],
    )
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    across = Window.partitionBy(*keys).orderBy(way("_band"))
    whole = Window.partitionBy(*keys)
    bands = (
        base.groupBy(*by)
        .agg(*[F.sum(f"_v_{n}").alias(f"_b_{n}") for n in names])
        .select(
            *by,
            *[
                F.coalesce(
                    F.sum(f"_b_{n}").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
                ).alias(f"_before_{n}")
                for n in names
            ],
            *[F.sum(f"_b_{n}").over(whole).alias(f"{n}_total") for n in names],
        )
    )
    inside = Window.partitionBy(*by).orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    joined = base.join(bands, by) if by else base
    for n in names:
        joined = joined.withColumn(f"{n}_upto", F.col(f"_before_{n}") + F.sum(f"_v_{n}").over(inside))
    return joined.drop("_band", *[f"_v_{n}" for n in names], *[f"_before_{n}" for n in names])


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per distinct (keys, value): ties, rows before, key size and the average rank."""
    distinct = (
        df.where(known(value))
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("ties"))
    )
    ranked = running_totals(distinct, keys, value, {"rows": F.col("ties")})
    return ranked.select(
        *keys,
        value,
        "ties",
        (F.col("rows_upto") - F.col("ties")).alias("n_before"),
        F.col("rows_total").alias("n"),
        (F.col("rows_upto") - (F.col("ties") - 1) / 2.0).alias("avg_rank"),
    )


def attach_ranks(df: DataFrame, keys: list[str], value: str, out: str = "avg_rank") -> DataFrame:
    """Average rank of every row inside its key; rows without a value get null and meet no join.

    Rows of one value are a side that Spark's skew join can split; the ranks are one row per value.
    """
    ranks = value_ranks(df, keys, value).select(*keys, value, F.col("avg_rank").alias(out))
    ranked = df.where(known(value)).join(ranks, [*keys, value])
    return ranked.unionByName(df.where(~known(value)).withColumn(out, F.lit(None).cast("double")))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per key, plus the number of values ``n``."""
    ranked = value_ranks(df, keys, value)
    picks = []
    for name, q in probs.items():
        place = (F.col("n") - 1) * F.lit(q)
        low, high = F.floor(place), F.ceil(place)
        holds = lambda i: (F.col("n_before") <= i) & (i < F.col("n_before") + F.col("ties"))
        picks += [
            F.max(F.when(holds(low), F.col(value).cast("double"))).alias(f"_{name}_low"),
            F.max(F.when(holds(high), F.col(value).cast("double"))).alias(f"_{name}_high"),
            F.max(place - low).alias(f"_{name}_part"),
        ]
    picked = ranked.groupBy(*keys).agg(F.max("n").alias("n"), *picks)
    return picked.select(
        *keys,
        "n",
        *[
            (
                F.col(f"_{name}_low")
                + (F.col(f"_{name}_high") - F.col(f"_{name}_low")) * F.col(f"_{name}_part")
            ).alias(name)
            for name in probs
        ],
    )


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "place") -> DataFrame:
    """First ``k`` rows per key; Spark trims each partition to ``k`` before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def share_of(df: DataFrame, keys: list[str], value: str, out: str = "share") -> DataFrame:
    """Value as a share of its key's sum; totals come from an aggregate, not from a window."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    return df.join(totals, keys).withColumn(out, F.try_divide(F.col(value), F.col("_total"))).drop("_total")
