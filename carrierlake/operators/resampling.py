"""Permutation and bootstrap results from hashed draws, reproducible on any partitioning."""

from collections.abc import Iterator

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from carrierlake.functions.draws import draw_matrix, with_uniform
from carrierlake.functions.pvalues import difference_tails_p
from carrierlake.operators.ranking import quantiles
from carrierlake.operators.regression import _key_schema
from carrierlake.session import cut_lineage

#: Least eigenvalue of the predictors' correlations, below which they count as dependent.
SINGULAR = 1e-12
# Cumulative Poisson(1) probabilities: a draw's weight is the number of them not above it.
POISSON = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(j + 1)) for j in range(13)]


def hypergeometric_tails(df: DataFrame, cells: tuple[str, str, str, str]) -> DataFrame:
    """Exact probability of a difference in proportions at least as large, below and above; a table with a null cell or an empty arm has none and no row."""
    names = ["_fa", "_fb", "_fc", "_fd"]
    keyed = df.select("*", *[F.col(c).cast("bigint").alias(n) for c, n in zip(cells, names)])

    n1, n2 = F.col("_fa") + F.col("_fb"), F.col("_fc") + F.col("_fd")
    tails = (
        keyed.select(*names).dropna().distinct().where((n1 > 0) & (n2 > 0))
        .withColumn("observed_difference", F.try_divide(F.col("_fa").cast("double"), n1) - F.try_divide(F.col("_fc").cast("double"), n2))
        .withColumn("_t", difference_tails_p(*names)).select(*names, "observed_difference", F.col("_t.low").alias("tail_low"), F.col("_t.high").alias("tail_high"))
    )
    return keyed.join(tails, names).drop(*names)


def permutation_difference(
    df: DataFrame, keys: list[str], cells: tuple[str, str, str, str], draws: int = 10000, seed: int = 42, plus_one: bool = False
) -> DataFrame:
    """Permutation p of a difference in carrier proportions, with the exact tail and Cohen's h.

    Shuffling labels makes the case carriers hypergeometric. A uniform draw is as extreme as the
    observed table exactly when it falls into one of the two tails, so a replicate is one
    comparison and no array is shuffled. ``keys`` are integers; each test has its own draws.
    """
    tails = hypergeometric_tails(df, cells).withColumn("hits", _hits(draws, seed)(*[F.col(k) for k in keys], "tail_low", "tail_high"))
    a, b, c, d = (F.col(x) for x in cells)
    angle = lambda x, y: F.asin(F.sqrt(F.try_divide(x, x + y)))
    shift = 1 if plus_one else 0
    return tails.select(
        *keys, "observed_difference", "hits", ((F.col("hits") + shift) / F.lit(float(draws + shift))).alias("p_permutation"),
        F.least(F.lit(1.0), F.col("tail_low") + F.col("tail_high")).alias("p_exact"), (2 * (angle(a, b) - angle(c, d))).alias("cohens_h"),
    )


def _hits(draws: int, seed: int):
    """Draws of each test that fall into one of its tails, counted where the test is: no replicate becomes a row."""

    @F.pandas_udf("bigint")
    def count(*columns: pd.Series) -> pd.Series:
        keys, low, high = [c.to_numpy(np.int64) for c in columns[:-2]], columns[-2].to_numpy(float), columns[-1].to_numpy(float)
        out, replicates = np.zeros(len(low), np.int64), np.arange(1, draws + 1)
        for a in range(0, len(low), 64):
            at = slice(a, a + 64)
            u = draw_matrix([*[k[at, None] for k in keys], replicates[None, :]], seed) / 2.0**32
            out[at] = ((u < low[at, None]) | (u >= 1 - high[at, None])).sum(axis=1)
        return pd.Series(out)

    return count


def agreement(df: DataFrame, p: str, q: str, alpha: float = 0.05) -> DataFrame:
    """Do two tests agree at a level: counts of the four outcomes."""
    side = lambda c: F.when(F.col(c) < alpha, "significant").otherwise("not_significant")
    return df.groupBy(side(p).alias(p), side(q).alias(q)).agg(F.count(F.lit(1)).alias("n"))


def _weights(df: DataFrame, row_id: Column, replicates: int, seed: int) -> DataFrame:
    """Every row under every replicate with a Poisson(1) weight; a weight of 0 adds nothing to a sum.

    The Poisson bootstrap needs no row numbering and no join, so a group of any size spreads over tasks.
    """
    exploded = df.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = with_uniform(exploded, "_u", [F.col("_b"), row_id], seed)
    weight = F.lit(0)
    for edge in POISSON:
        weight = weight + (F.col("_u") >= edge).cast("int")
    return drawn.withColumn("_w", weight.cast("double")).drop("_u")


def bootstrap_slope(df: DataFrame, keys: list[str], row_id: Column, x: str, y: str, replicates: int = 200, seed: int = 42) -> DataFrame:
    """Slope of y on x per key with bootstrap median, 95 % interval and sign agreement."""
    valid = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_x", F.col(x).cast("double")).withColumn("_y", F.col(y).cast("double"))
    w = F.col("_w")
    sums = _weights(valid, row_id, replicates, seed).groupBy(*keys, "_b").agg(
        F.sum(w).alias("n"), F.sum(w * F.col("_x")).alias("sx"), F.sum(w * F.col("_y")).alias("sy"),
        F.sum(w * F.col("_x") * F.col("_x")).alias("sxx"), F.sum(w * F.col("_x") * F.col("_y")).alias("sxy"),
    )
    spread = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    # One row per key and replicate, read several times below: written once.
    slopes = cut_lineage(
        sums.where(spread > 1e-12).select(*keys, ((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / spread).alias("slope"))
    )
    original = valid.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("_y", "_x").alias("original_slope"))
    signs = slopes.join(original, keys).groupBy(*keys).agg(
        F.avg((F.signum("slope") == F.signum("original_slope")).cast("double")).alias("sign_concordance"), F.count(F.lit(1)).alias("replicates")
    )
    spans = quantiles(slopes, keys, "slope", {"median_slope": 0.5, "low": 0.025, "high": 0.975}).drop("n")
    return original.join(signs, keys).join(spans, keys).withColumn("crosses_zero", ~((F.col("low") > 0) | (F.col("high") < 0)))


def mediation(
    df: DataFrame, keys: list[str], row_id: Column, x: str, m: str, y: str, covariates: list[str] = (), replicates: int = 200, seed: int = 42
) -> DataFrame:
    """Indirect effect a*b of x on y through m, direct and total effects, bootstrap interval.

    Only the moment matrix of a (key, replicate) reaches the solve. Replicates whose predictors are dependent have no effects and take no part.
    """
    names = [x, *covariates, m, y]
    valid = df.dropna(subset=names).select(*keys, row_id.alias("_id"), *[F.col(c).cast("double").alias(f"z{i + 1}") for i, c in enumerate(names)])
    k = len(names) + 1
    z = lambda i: F.lit(1.0) if i == 0 else F.col(f"z{i}")
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    original = valid.withColumn("_b", F.lit(0)).withColumn("_w", F.lit(1.0))
    rows = _weights(valid, F.col("_id"), replicates, seed).select(*original.columns).unionByName(original)
    moments = rows.groupBy(*keys, "_b").agg(*[F.sum(F.col("_w") * z(i) * z(j)).alias(f"m{i}_{j}") for i, j in cells])
    schema = _key_schema(moments, [*keys, "_b"]) + ", n double, a double, b double, direct double, total double"
    fits = cut_lineage(moments.mapInPandas(_mediation_batch(k, [*keys, "_b"]), schema)).where((F.col("a") * F.col("b")).isNotNull())
    point = fits.where("_b = 0").select(*keys, F.col("n").cast("bigint").alias("n"), "a", "b", "direct", "total", (F.col("a") * F.col("b")).alias("indirect"))
    draws = fits.where("_b > 0").select(*keys, (F.col("a") * F.col("b")).alias("v"))
    return point.join(quantiles(draws, keys, "v", {"indirect_low": 0.025, "indirect_high": 0.975}).withColumnRenamed("n", "replicates"), keys)


def _mediation_batch(k: int, keep: list[str]):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            full = np.zeros((len(frame), k, k))
            for i in range(k):
                for j in range(i, k):
                    full[:, i, j] = full[:, j, i] = frame[f"m{i}_{j}"].to_numpy(float)

            def fit(predictors: list[int], target: int) -> np.ndarray:
                gram = full[:, predictors][:, :, predictors]
                found = np.einsum("nij,nj->ni", np.linalg.pinv(gram, hermitian=True), full[:, predictors, target])
                # a replicate without spread in a predictor has no slope; columns of length one make the test independent of units
                length = np.sqrt(np.einsum("nii->ni", gram))
                unit = gram / np.where(length > 0, length, 1.0)[:, :, None] / np.where(length > 0, length, 1.0)[:, None, :]
                found[np.linalg.eigvalsh(unit)[:, 0] < SINGULAR] = np.nan
                return found

            base = list(range(k - 2))
            out = frame[keep].copy()
            out["n"] = full[:, 0, 0]
            out["a"] = fit(base, k - 2)[:, 1]
            both = fit(base + [k - 2], k - 1)
            out["b"], out["direct"] = both[:, -1], both[:, 1]
            out["total"] = fit(base, k - 1)[:, 1]
            yield out

    return step
