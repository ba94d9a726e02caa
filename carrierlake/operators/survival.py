"""Survival per key: product-limit curve, log-rank, proportional hazards."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from carrierlake.functions.pvalues import chi_square_p
from carrierlake.operators.ranking import known, running_totals
from carrierlake.operators.regression import _effects, _iterate, _key_schema, _pairs
from carrierlake.session import cut_lineage


def observed(df: DataFrame, time: str, event: str) -> DataFrame:
    """Rows with an event flag and a duration above zero."""
    return df.where(known(time) & (F.col(time) > 0) & F.col(event).isNotNull())


def km_table(df: DataFrame, keys: list[str], time: str, event: str) -> DataFrame:
    """Survival steps per key: at risk, events, survival after each time; a duration of zero is a step like any other."""
    at = df.where(known(time) & F.col(event).isNotNull()).groupBy(*keys, time).agg(
        F.count(F.lit(1)).alias("leaving"), F.sum(F.col(event).cast("bigint")).alias("events")
    )
    risk = running_totals(at, keys, time, {"risk": F.col("leaving")}, descending=True).drop("risk_total")
    factor = F.when(F.col("events") < F.col("risk_upto"), F.ln(1 - F.col("events") / F.col("risk_upto"))).otherwise(F.lit(-1e6))
    steps = running_totals(risk, keys, time, {"log_s": factor})
    survival = F.when(F.col("log_s_upto") <= -1e5, 0.0).otherwise(F.exp("log_s_upto"))
    return steps.select(*keys, time, F.col("risk_upto").alias("at_risk"), "events", survival.alias("survival"))


def logrank_by_key(df: DataFrame, keys: list[str], time: str, event: str, group: str, levels: list[str]) -> DataFrame:
    """Observed and expected events per group and the log-rank chi-square of two or more groups."""
    k = len(levels)
    member = lambda i: F.col(group) == levels[i]
    died = F.col(event) == 1
    at = observed(df, time, event).where(F.col(group).isin(levels)).groupBy(*keys, time).agg(
        F.count_if(died).alias("d"),
        *[F.count_if(member(i)).alias(f"l{i}") for i in range(k)],
        *[F.count_if(member(i) & died).alias(f"d{i}") for i in range(k)],
    )
    sums = {f"n{i}": F.col(f"l{i}") for i in range(k)}
    risk = running_totals(at, keys, time, sums, descending=True).where("d > 0")
    n = [F.col(f"n{i}_upto").cast("double") for i in range(k)]
    total = sum(n[1:], n[0])
    d = F.col("d").cast("double")
    spread = F.when(total > 1, d * (total - d) / (total * total * (total - 1))).otherwise(0.0)
    cells = risk.groupBy(*keys).agg(
        *[F.sum(f"d{i}").alias(f"observed_{i}") for i in range(k)],
        *[F.sum(d * n[i] / total).alias(f"expected_{i}") for i in range(k)],
        *[F.sum(spread * n[i] * ((total if i == j else F.lit(0.0)) - n[j])).alias(f"h{i}_{j}") for i, j in _pairs(k)],
    )
    kept = [f"{x}_{i}" for x in ("observed", "expected") for i in range(k)]
    schema = _key_schema(cells, keys) + ", " + ", ".join(
        f"{c} {'bigint' if c.startswith('observed') else 'double'}" for c in kept
    ) + ", statistic double"
    solved = cells.mapInPandas(_logrank_batch(k, keys + kept), schema)
    return solved.withColumn("p_value", chi_square_p(F.col("statistic"), F.lit(float(k - 1))))


def _logrank_batch(k: int, keep: list[str]):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            gap = np.stack([(frame[f"observed_{i}"] - frame[f"expected_{i}"]).to_numpy(float) for i in range(k - 1)], axis=1)
            cov = np.zeros((len(frame), k - 1, k - 1))
            for i, j in _pairs(k - 1):
                cov[:, i, j] = cov[:, j, i] = frame[f"h{i}_{j}"].to_numpy(float)
            out = frame[keep].copy()
            out["statistic"] = np.einsum("ni,nij,nj->n", gap, np.linalg.pinv(cov, hermitian=True), gap)
            yield out

    return step


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in ("s0", "s1", "q0", "q1", "q2")]))
def efron_sums(d: pd.Series, r: pd.Series, e: pd.Series) -> pd.DataFrame:
    """Sums over l < d of f^m / (r - f e)^n with f = l / d: s0, s1 for n = 1 and m = 0, 1; q0, q1, q2 for n = 2."""
    rows = []
    for deaths, risk, event in zip(d.to_numpy(float), r.to_numpy(float), e.to_numpy(float)):
        total = np.zeros(5)
        for begin in range(0, int(deaths), 1 << 16):
            f = np.arange(begin, min(begin + (1 << 16), int(deaths))) / deaths
            one = 1 / (risk - f * event)
            two = one * one
            total += [one.sum(), (f * one).sum(), two.sum(), (f * two).sum(), (f * f * two).sum()]
        rows.append(total)
    return pd.DataFrame(np.array(rows).reshape(-1, 5), columns=["s0", "s1", "q0", "q1", "q2"])


def cox_by_key(
    df: DataFrame, keys: list[str], time: str, event: str, x: list[str], penalty: float = 0.0, min_events: int = 3,
    passes: int = 25, tolerance: float = 1e-8,
) -> DataFrame:
    """Proportional hazards per key with Efron ties; the first entry of ``x`` is reported.

    A pass aggregates to (key, time), takes reverse running risk-set sums, sums over tied deaths in Arrow batches of (key, time)
    rows and adds gradient and Hessian cells per key. Durations must be above zero.
    """
    k = len(x)
    valid = observed(df, time, event).where(known(*x)).select(
        *keys, F.col(time).cast("double").alias("_t"), F.col(event).cast("int").alias("_e"),
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)],
    )
    moments = valid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_e").alias("events"), F.min("x0").alias("_lo"), F.max("x0").alias("_hi"),
        *[F.avg(f"x{i}").alias(f"_m{i}") for i in range(k)],
    ).where((F.col("events") >= min_events) & (F.col("_hi") > F.col("_lo")))
    centred = valid.join(moments.select(*keys, *[f"_m{i}" for i in range(k)]), keys).select(
        *keys, "_t", "_e", *[(F.col(f"x{i}") - F.col(f"_m{i}")).alias(f"x{i}") for i in range(k)]
    )
    data = cut_lineage(centred.groupBy(*keys, "_t", "_e", *[f"x{i}" for i in range(k)]).agg(F.count(F.lit(1)).cast("double").alias("_w")))
    start = moments.select(*keys, *[F.lit(0.0).alias(f"b{i}") for i in range(k)])
    dead = F.col("_e") == 1

    def sums(active: DataFrame) -> DataFrame:
        betas = active.select(*keys, *[f"b{i}" for i in range(k)])
        score = sum((F.col(f"b{i}") * F.col(f"x{i}") for i in range(1, k)), F.col("b0") * F.col("x0"))
        rows = data.join(betas, keys).withColumn("_r", F.col("_w") * F.exp(score))
        weights = {"s": F.col("_r")}
        weights |= {f"s{i}": F.col("_r") * F.col(f"x{i}") for i in range(k)}
        weights |= {f"s{i}_{j}": F.col("_r") * F.col(f"x{i}") * F.col(f"x{j}") for i, j in _pairs(k)}
        at = rows.groupBy(*keys, "_t").agg(
            *[F.sum(e).alias(f"a_{name}") for name, e in weights.items()],
            *[F.sum(F.when(dead, e).otherwise(0.0)).alias(f"e_{name}") for name, e in weights.items()],
            F.sum(F.when(dead, F.col("_w")).otherwise(0.0)).alias("_d"),
            *[F.sum(F.when(dead, F.col("_w") * F.col(f"x{i}")).otherwise(0.0)).alias(f"_dx{i}") for i in range(k)],
        )
        risk = running_totals(at, keys, "_t", {f"r_{name}": F.col(f"a_{name}") for name in weights}, descending=True).where("_d > 0")
        # the l-th of d tied deaths sees r - (l / d) e of every sum; over l these are linear in three power sums of 1 / (r - (l / d) e)
        tied = risk.withColumn("_p", efron_sums(F.col("_d"), F.col("r_s_upto"), F.col("e_s")))
        s0, s1, q0, q1, q2 = (F.col(f"_p.{c}") for c in ("s0", "s1", "q0", "q1", "q2"))
        r, e = (lambda name: F.col(f"r_{name}_upto")), (lambda name: F.col(f"e_{name}"))
        mean = lambda i: r(f"s{i}") * s0 - e(f"s{i}") * s1
        square = lambda i, j: r(f"s{i}") * r(f"s{j}") * q0 - (r(f"s{i}") * e(f"s{j}") + e(f"s{i}") * r(f"s{j}")) * q1 + e(f"s{i}") * e(f"s{j}") * q2
        return (
            tied.groupBy(*keys)
            .agg(
                F.sum("_d").alias("_w"),
                *[F.sum(F.col(f"_dx{i}") - mean(i)).alias(f"g{i}") for i in range(k)],
                *[F.sum(r(f"s{i}_{j}") * s0 - e(f"s{i}_{j}") * s1 - square(i, j)).alias(f"h{i}_{j}") for i, j in _pairs(k)],
            )
            .join(betas, keys)
        )

    fitted = _iterate(start, sums, keys, k, passes, tolerance, penalty)
    return _effects(fitted.join(moments.select(*keys, "n", "events"), keys), keys, "b0", "v0", "hazard_ratio")


def estimable(df: DataFrame, keys: list[str], event: str, x: str) -> DataFrame:
    """Keys whose hazard ratio of ``x`` can be finite: not all events lie at the largest, or all at the smallest value of ``x``.

    Where they do, the partial likelihood rises without end in the coefficient of ``x``, whatever the covariates.
    """
    dead = F.col(event) == 1
    ends = df.groupBy(*keys).agg(
        F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.min(F.when(dead, F.col(x))).alias("_from"), F.max(F.when(dead, F.col(x))).alias("_to")
    )
    return ends.where((F.col("_from") < F.col("_hi")) & (F.col("_to") > F.col("_lo"))).select(*keys)


def cox_with_fallback(df: DataFrame, keys: list[str], time: str, event: str, x: str, sets: list[list[str]], min_rows: int = 6, **options) -> DataFrame:
    """``cox_by_key`` under the first covariate set that a key supports; ``adjustment`` names it.

    ``sets`` are tried in order, the last one usually empty. A key moves on where fewer than ``min_rows`` rows know the whole set, or where its
    fit does not settle; a key that no set fits is left out. Without a penalty, keys that are not ``estimable`` move on before any pass. Rows with the set complete are those of the fit (``n`` of ``n_total``).
    """
    needed = list(dict.fromkeys(c for own in sets for c in own))
    rows = cut_lineage(observed(df, time, event).where(known(x)).select(*keys, time, event, x, *needed))
    complete = [known(*own) if own else F.lit(True) for own in sets]
    sizes = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"), *[F.count_if(c).alias(f"_n{i}") for i, c in enumerate(complete)]))
    after = lambda level: F.coalesce(*[F.when((F.col(f"_n{i}") >= min_rows) & (F.lit(i) > level), F.lit(i)) for i in range(len(sets))])
    state, done = sizes.withColumn("_level", after(F.lit(-1))).where("_level is not null"), None
    label = F.element_at(F.array(*[F.lit("+".join(own) or "unadjusted") for own in sets]), F.col("_level") + 1)
    for _ in sets:
        state = cut_lineage(state)
        if state.isEmpty():
            break
        # all keys in one fit, whatever their set: a covariate outside it is constant, and a constant keeps its coefficient at 0
        placed = rows.join(state.select(*keys, "_level"), keys).where(F.get(F.array(*complete), F.col("_level")))
        used = lambda c: F.col("_level").isin([i for i, own in enumerate(sets) if c in own])
        given = placed.select(*keys, time, event, x, *[F.when(used(c), F.col(c).cast("double")).otherwise(0.0).alias(c) for c in needed])
        if not options.get("penalty"):
            given = cut_lineage(given)
            given = given.join(estimable(given, keys, event, x), keys)
        fit = cut_lineage(cox_by_key(given, keys, time, event, [x, *needed], **options).where("converged and not clipped"))
        settled = fit.join(state.select(*keys, "n_total", label.alias("adjustment")), keys)
        done = settled if done is None else done.unionByName(settled)
        state = state.join(fit.select(*keys), keys, "left_anti").withColumn("_level", after(F.col("_level"))).where("_level is not null")
    return done
