"""Reproducible draws: a 32-bit mix of integer keys, the same on any partitioning."""

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

MASK = 0xFFFFFFFF
# Multipliers of a well-known 32-bit integer finaliser.
FIRST, SECOND = 0x21F0AAAD, 0x735A2D97


def with_uniform(df: DataFrame, out: str, keys: list[Column], seed: int) -> DataFrame:
    """Add a uniform in [0, 1) that depends only on the integer keys and the seed."""
    step = df.withColumn("_h", F.lit(seed & MASK).cast("bigint"))
    for key in keys:
        step = (
            step.withColumn("_h", F.col("_h").bitwiseXOR(key.cast("bigint").bitwiseAND(F.lit(MASK).cast("bigint"))))
            .withColumn("_h", _shift_mix(16, FIRST))
            .withColumn("_h", _shift_mix(15, SECOND))
            .withColumn("_h", F.col("_h").bitwiseXOR(F.shiftright("_h", 15)))
        )
    # Never null, so no null filter is derived from it and pushed down into the mixing steps,
    # where each step would be written out twice.
    return step.withColumn(out, F.coalesce(F.col("_h") / float(2**32), F.lit(0.0))).drop("_h")


def _shift_mix(shift: int, multiplier: int) -> Column:
    mixed = F.col("_h").bitwiseXOR(F.shiftright("_h", shift)) * F.lit(multiplier).cast("bigint")
    return mixed.bitwiseAND(F.lit(MASK).cast("bigint"))


def uniform_sql(keys: list[str], seed: int) -> str:
    """The same draw as a SQL expression, for the oracle."""

    def fold(h: str, key: str) -> str:
        a = f"xor({h}, ({key})::BIGINT & {MASK})"
        step = lambda x, s, m: f"list_transform([{x}], lambda v: (xor(v, v >> {s}) * {m}) & {MASK})[1]"
        b = step(step(a, 16, FIRST), 15, SECOND)
        return f"list_transform([{b}], lambda v: xor(v, v >> 15))[1]"

    return f"({reduce(fold, keys, f'{seed & MASK}::BIGINT')} / 4294967296.0)"


def draw_matrix(keys: list[np.ndarray], seed: int) -> np.ndarray:
    """The same draws as 32-bit numbers (uint64) in numpy; keys are integer arrays that broadcast against each other."""
    h = np.uint64(seed & MASK)
    for key in keys:
        h = h ^ (key.astype(np.int64).astype(np.uint64) & np.uint64(MASK))
        for shift, multiplier in ((16, FIRST), (15, SECOND)):
            h = ((h ^ (h >> np.uint64(shift))) * np.uint64(multiplier)) & np.uint64(MASK)
        h = h ^ (h >> np.uint64(15))
    return h
