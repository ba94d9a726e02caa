"""Logistic screens of many exposures against binary outcomes, with covariates, from carrier rows only.

Samples of equal covariates form one cell of an outcome. The cells of all samples are a small table that every exposure shares; an exposure
adds only its own carriers per cell, and the rest of a cell is what the carriers leave. Newton's method runs over these counts, so the
sample x exposure table never exists, no pass shuffles anything, and several models of one exposure are masks over the same counts.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from carrierlake.operators.fdr import bh_fdr
from carrierlake.operators.ranking import known
from carrierlake.operators.regression import CLIP, _effects, _key_schema
from carrierlake.session import cut_lineage

#: Cells of all outcomes together that a task holds; covariates that make more need rounding.
MOST_CELLS = 200_000
#: Counts (exposures x cells x doses) that one step of the kernel holds.
AT_ONCE = 1_000_000

#: A model is what dose 0, 1 and 2 count as (None: left out) and its covariates.
CARRIER, HET, HOM, DOSE = (0.0, 1.0, 1.0), (0.0, 1.0, None), (0.0, None, 1.0), (0.0, 1.0, 2.0)
Model = tuple[tuple[float | None, ...], list[str]]


def risk_models(age: str = "age", bmi: str = "bmi") -> dict[str, Model]:
    """Carriers alone, with age, with age and BMI; each genotype against wild type; the dose."""
    return {
        "unadjusted": (CARRIER, []), "age": (CARRIER, [age]), "age_bmi": (CARRIER, [age, bmi]),
        "het_vs_wt": (HET, []), "hom_vs_wt": (HOM, []), "trend": (DOSE, []),
    }


def clinical_models(age: str = "age", bmi: str = "bmi") -> dict[str, Model]:
    """Carriers alone and under each covariate set."""
    return {"unadjusted": (CARRIER, []), "age": (CARRIER, [age]), "bmi": (CARRIER, [bmi]), "age_bmi": (CARRIER, [age, bmi])}


def newton(n: np.ndarray, e: np.ndarray, x: np.ndarray, z: np.ndarray, passes: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(effects of x, their variances, unsettled) of many fits over shared rows: ``n`` and events ``e`` (fits, rows), x and covariates z per row."""
    f = np.column_stack([np.ones(len(x)), x, z])
    p = f.shape[1]
    squares = (f[:, :, None] * f[:, None, :]).reshape(len(f), p * p)
    beta, variance = np.zeros((len(n), p)), np.zeros(len(n))
    active, diagonal = np.arange(len(n)), np.arange(p)
    for _ in range(passes):
        q = 1.0 / (1.0 + np.exp(-(beta[active] @ f.T)))
        gradient = (e[active] - n[active] * q) @ f
        hessian = ((n[active] * q * (1 - q)) @ squares).reshape(-1, p, p)
        hessian[:, diagonal, diagonal] += hessian[:, diagonal, diagonal] <= 1e-12  # a constant covariate keeps its coefficient at 0
        inverse = np.linalg.pinv(hessian, rcond=1e-13, hermitian=True)
        new = np.clip(beta[active] + np.clip(np.einsum("nij,nj->ni", inverse, gradient), -5.0, 5.0), -CLIP, CLIP)
        moved = np.abs(new - beta[active]).max(axis=1) > tolerance
        beta[active], variance[active] = new, inverse[:, 1, 1]
        active = active[moved]
        if not len(active):
            break
    unsettled = np.zeros(len(n), bool)
    unsettled[active] = True
    return beta[:, 1], variance, unsettled


def scaled(columns: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Covariates with mean 0 and spread 1 over all samples; a constant one becomes 0."""
    if not columns.shape[1]:
        return columns
    mean = (columns * weight[:, None]).sum(axis=0) / weight.sum()
    spread = np.sqrt(((columns - mean) ** 2 * weight[:, None]).sum(axis=0) / weight.sum())
    return np.where(spread > 0, (columns - mean) / np.where(spread > 0, spread, 1.0), 0.0)


def carrier_screen(
    carriers: DataFrame, outcomes: DataFrame, exposure: str, keys: list[str], y: str, models: dict[str, Model],
    min_rows: int = 6, min_events: int = 1, min_carriers: int = 1, passes: int = 25, tolerance: float = 1e-8,
) -> DataFrame:
    """Odds ratio, interval, p and FDR per (keys, exposure, model).

    ``carriers``: sample, exposure, dosage (1 or 2; the largest counts); a sample without a row has dose 0. ``outcomes``: sample, keys, ``y`` (0 or 1)
    and the covariates, one row per sample and outcome; rows without ``y`` take no part, rows without a covariate only in models without
    it. Fits without enough rows, carriers, or events and non-events, or without both exposed and unexposed rows, are left out. Fits
    that don't settle have no p value. FDR runs inside (keys, model).
    """
    covariates = sorted({c for _, own in models.values() for c in own})
    place = {c: i for i, c in enumerate(covariates)}
    values = [F.when(known(c), F.col(c).cast("double")).alias(c) for c in covariates]
    rows = outcomes.where(F.col(y).isin(0, 1)).select("sample", *keys, F.col(y).cast("int").alias("_y"), *values)
    # a hash skips nulls, so which values are missing is hashed too
    cell = F.xxhash64(*covariates, *[F.col(c).isNull() for c in covariates]) if covariates else F.lit(0).cast("bigint")
    rows = cut_lineage(rows.withColumn("_cell", cell))
    totals = cut_lineage(rows.groupBy(*keys, "_cell", *covariates).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("e")))
    if totals.count() > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells of equal covariates: round them")
    shared: dict[tuple, list] = {}
    for r in totals.orderBy(*keys, "_cell").collect():
        shared.setdefault(tuple(r[k] for k in keys), []).append((r["_cell"], r.n, r.e, [np.nan if r[c] is None else r[c] for c in covariates]))
    cells = {k: (np.array([c[0] for c in v]), *(np.array([c[i] for c in v], float) for i in (1, 2)), np.array([c[3] for c in v], float).reshape(len(v), -1)) for k, v in shared.items()}
    if any(len(np.unique(c[0])) < len(c[0]) for c in cells.values()):
        raise ValueError("two cells of covariates have one hash")
    common = rows.sparkSession.sparkContext.broadcast(cells)  # MOST_CELLS
    dosed = carriers.where(F.col("dosage").isin(1, 2)).groupBy("sample", exposure).agg(F.max("dosage").cast("int").alias("dosage"))
    hits = rows.join(dosed, "sample").groupBy(*keys, exposure, "_cell", "dosage").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("e"))
    # two entries per cell at most, so a list has a bound whatever the carriers
    lists = hits.groupBy(*keys, exposure).agg(F.collect_list(F.struct("_cell", "dosage", "n", "e")).alias("_hits"))
    by = [*keys, exposure]
    schema = _key_schema(lists, by) + ", model string, carriers bigint, n bigint, events bigint, b1 double, v1 double, active boolean"

    def fits(n: np.ndarray, e: np.ndarray, columns: np.ndarray, weight: np.ndarray, codes: tuple, own: list[str]):
        used = ~np.isnan(columns[:, [place[c] for c in own]]).any(axis=1)
        doses = [d for d, c in enumerate(codes) if c is not None]
        x = np.tile([codes[d] for d in doses], used.sum())
        z = np.repeat(scaled(columns[used][:, [place[c] for c in own]], weight[used]), len(doses), axis=0)
        n, e = (a[:, used][:, :, doses].reshape(len(a), -1) for a in (n, e))
        total, events, exposed = n.sum(axis=1), e.sum(axis=1), n[:, x > 0].sum(axis=1)
        good = (total >= min_rows) & (events >= max(min_events, 1)) & (total - events >= 1) & (exposed >= max(min_carriers, 1)) & (exposed < total)
        at = np.flatnonzero(good)
        return at, exposed[at], total[at], events[at], *newton(n[at], e[at], x, z, passes, tolerance)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*[batch.column(k).to_pylist() for k in keys]) if keys else [()] * batch.num_rows):
                groups.setdefault(key, []).append(i)
            for key, members in groups.items():
                ids, n0, e0, columns = common.value[key]
                step = max(1, AT_ONCE // (3 * len(ids)))
                for a in range(0, len(members), step):
                    part = members[a : a + step]
                    n, e = np.zeros((len(part), len(ids), 3)), np.zeros((len(part), len(ids), 3))
                    for j, i in enumerate(part):
                        found = batch.column("_hits")[i].values
                        cell, dose = np.searchsorted(ids, found.field("_cell").to_numpy()), found.field("dosage").to_numpy()
                        n[j, cell, dose], e[j, cell, dose] = found.field("n").to_numpy(), found.field("e").to_numpy()
                    n[:, :, 0], e[:, :, 0] = n0 - n.sum(axis=2), e0 - e.sum(axis=2)
                    for name, (codes, own) in models.items():
                        at, exposed, total, events, beta, variance, unsettled = fits(n, e, columns, n0, codes, own)
                        where = pa.array(np.array(part)[at])
                        numbers = [pa.array(v.astype(np.int64)) for v in (exposed, total, events)]
                        columns_out = [*[batch.column(c).take(where) for c in by], pa.array([name] * len(at)), *numbers, pa.array(beta), pa.array(variance), pa.array(unsettled)]
                        yield pa.RecordBatch.from_arrays(columns_out, names=[*by, "model", "carriers", "n", "events", "b1", "v1", "active"])

    fitted = _effects(lists.mapInArrow(solve, schema), [*by, "model", "carriers"], "b1", "v1", "odds_ratio")
    fitted = cut_lineage(fitted.withColumn("p_value", F.when(F.col("converged") & ~F.col("clipped"), F.col("p_value"))))
    return bh_fdr(fitted, "p_value", [*keys, "model"])
