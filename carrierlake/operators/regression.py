"""Regressions per key. Data is reduced by Spark aggregates to moment sums; only the sums of a
key, a handful of numbers, meet the small dense solve."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from carrierlake.functions.pvalues import normal_p, student_p
from carrierlake.operators.contingency import fisher_2x2, odds_ratio
from carrierlake.session import cut_lineage

CLIP = 20.0


def dose_regression(
    values: DataFrame, carriers: DataFrame, outcome: list[str], exposure: str, min_n: int = 8, min_carriers: int = 3
) -> DataFrame:
    """Least squares of a value on dosage for every exposure and outcome, from carrier rows only.

    A sample with a value and no carrier row has dose 0. Values are centred per outcome before
    they are squared, so the sums do not cancel.
    """
    means = values.groupBy(*outcome).agg(F.avg("value").alias("_mean"))
    centred = values.where(F.col("value").isNotNull()).join(means, outcome).withColumn("_y", F.col("value") - F.col("_mean"))
    base = centred.groupBy(*outcome).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("_sy"), F.sum(F.col("_y") * F.col("_y")).alias("_syy"),
        F.max("_mean").alias("_mean"),
    )
    x = F.col("dosage").cast("double")
    dosed = (
        centred.drop("_mean").join(carriers.select("sample", exposure, "dosage").where("dosage > 0"), "sample")
        .groupBy(exposure, *outcome)
        .agg(
            F.count_if(F.col("dosage") == 1).alias("n_dose1"), F.count_if(F.col("dosage") == 2).alias("n_dose2"),
            F.sum(x).alias("_sx"), F.sum(x * x).alias("_sxx"), F.sum(x * F.col("_y")).alias("_sxy"),
        )
    )
    n = F.col("n").cast("double")
    sxx = F.col("_sxx") - F.col("_sx") * F.col("_sx") / n
    sxy = F.col("_sxy") - F.col("_sx") * F.col("_sy") / n
    syy = F.col("_syy") - F.col("_sy") * F.col("_sy") / n
    gated = dosed.join(base, outcome).where(
        (F.col("n") >= min_n) & (F.col("n_dose1") + F.col("n_dose2") >= min_carriers) & (sxx > 1e-12) & (syy > 1e-12)
    )
    slope = sxy / sxx
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sxy / F.sqrt(sxx * syy)))
    out = gated.select(
        exposure, *outcome, "n", (F.col("n") - F.col("n_dose1") - F.col("n_dose2")).alias("n_dose0"), "n_dose1", "n_dose2",
        slope.alias("slope"), (F.col("_mean") + (F.col("_sy") - slope * F.col("_sx")) / n).alias("intercept"), r.alias("r"),
        F.sqrt((1 - r * r) * syy / sxx / (n - 2)).alias("se"),
    )
    t = F.try_divide(F.col("slope"), F.col("se"))
    return out.withColumn("p_value", student_p(t, F.col("n") - 2.0)).withColumn(
        "direction", F.when(F.col("slope") > 0, "Higher_with_dosage").otherwise("Lower_with_dosage")
    )


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _square(frame: pd.DataFrame, k: int, prefix: str) -> np.ndarray:
    out = np.zeros((len(frame), k, k))
    for i, j in _pairs(k):
        out[:, i, j] = out[:, j, i] = frame[f"{prefix}{i}_{j}"].to_numpy(float)
    return out


def _vector(frame: pd.DataFrame, k: int, prefix: str) -> np.ndarray:
    return np.stack([frame[f"{prefix}{i}"].to_numpy(float) for i in range(k)], axis=1)


def _newton_batch(k: int, keep: list[str], tolerance: float, penalty: float):
    """Arrow batch step over per-key sums: solve, move, flag convergence."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            beta, grad, hess = _vector(frame, k, "b"), _vector(frame, k, "g"), _square(frame, k, "h")
            grad = grad - penalty * frame["_w"].to_numpy(float)[:, None] * beta
            diagonal = np.arange(k)
            # A constant covariate is a zero column: a unit pivot keeps its coefficient at 0.
            flat = hess[:, diagonal, diagonal] <= 1e-12
            hess[:, diagonal, diagonal] += penalty * frame["_w"].to_numpy(float)[:, None] + flat * 1.0
            # One bad key must not fail the batch: a singular system takes the pseudo-inverse.
            inverse = np.linalg.pinv(hess, rcond=1e-13, hermitian=True)
            move = np.clip(np.einsum("nij,nj->ni", inverse, grad), -5.0, 5.0)
            new = np.clip(beta + move, -CLIP, CLIP)
            out = frame[keep].copy()
            for i in range(k):
                out[f"b{i}"], out[f"v{i}"] = new[:, i], inverse[:, i, i]
            out["active"] = np.abs(new - beta).max(axis=1) > tolerance
            yield out

    return step


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in keys)


def _iterate(start: DataFrame, sums, keys: list[str], k: int, passes: int, tolerance: float, penalty: float) -> DataFrame:
    """Newton passes over all keys at once; converged keys leave the later passes."""
    schema = _key_schema(start, keys) + ", " + ", ".join(f"b{i} double, v{i} double" for i in range(k)) + ", active boolean"
    active, done = start, None
    for _ in range(passes):
        moved = cut_lineage(sums(active).mapInPandas(_newton_batch(k, keys, tolerance, penalty), schema))
        finished = moved.where(~F.col("active"))
        done = finished if done is None else done.unionByName(finished)
        active = moved.where("active")
        if active.isEmpty():
            break
    return done.unionByName(active)


def _design(df: DataFrame, keys: list[str], y: str, x: str, covariates: list[str], weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Weighted distinct rows ``y, x1.., _w`` with z-scored covariates, and the per-key gates."""
    valid = df.dropna(subset=[y, x, *covariates]).withColumn("_n", F.lit(1) if weight is None else F.col(weight)).where("_n > 0")
    weighted = valid.groupBy(*keys, F.col(y).cast("double").alias("_y"), F.col(x).cast("double").alias("x1"), *covariates).agg(
        F.sum("_n").cast("double").alias("_w")
    )
    if weight is not None and covariates:
        raise ValueError("covariates need one row per sample")
    moments = valid.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.sum(F.col(y).cast("double") * F.col("_n")).alias("events"),
        F.min(F.col(x).cast("double")).alias("_xlo"), F.max(F.col(x).cast("double")).alias("_xhi"),
        *[e for c in covariates for e in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))],
    )
    scaled = weighted.join(moments.select(*keys, *[f"_{p}_{c}" for c in covariates for p in "ms"]), keys) if covariates else weighted
    z = [
        F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)).alias(f"x{i + 2}")
        for i, c in enumerate(covariates)
    ]
    return scaled.select(*keys, "_y", F.lit(1.0).alias("x0"), "x1", *z, "_w"), moments


def logit_by_key(
    df: DataFrame, keys: list[str], y: str, x: str, covariates: list[str] = (), min_events: int = 10, min_rows: int = 6,
    passes: int = 25, tolerance: float = 1e-8, firth: bool = False, weight: str | None = None,
) -> DataFrame:
    """Logistic regression of a binary outcome on ``x`` per key: odds ratio, interval, p.

    With ``weight`` (and no covariates) a row stands for so many samples, so a count table is enough.

    Every pass is one aggregate of gradient and Hessian cells over all unfinished keys. With
    ``firth`` the score carries the hat-value correction, which costs a second aggregate.
    """
    covariates = list(covariates)
    k = 2 + len(covariates)
    data, moments = _design(df, keys, y, x, covariates, weight)
    gated = moments.where(
        (F.col("n") >= min_rows) & (F.least(F.col("events"), F.col("n") - F.col("events")) >= (0 if firth else 1))
        & (F.col("events") >= min_events) & (F.col("_xhi") > F.col("_xlo"))
    ).select(*keys, "n", "events")
    data = cut_lineage(data.join(gated.select(*keys), keys, "left_semi"))
    start = gated.select(*keys, *[F.lit(0.0).alias(f"b{i}") for i in range(k)])
    eta = sum((F.col(f"b{i}") * F.col(f"x{i}") for i in range(1, k)), F.col("b0") * F.col("x0"))

    def sums(active: DataFrame) -> DataFrame:
        betas = active.select(*keys, *[f"b{i}" for i in range(k)])
        rows = data.join(betas, keys).withColumn("_p", 1.0 / (1.0 + F.exp(-eta)))
        var = F.col("_w") * F.col("_p") * (1 - F.col("_p"))
        cells = [F.sum(var * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i, j in _pairs(k)]
        residual = F.col("_y") - F.col("_p")
        if firth:
            hessian = rows.groupBy(*keys).agg(*cells)
            schema = _key_schema(hessian, keys) + ", " + ", ".join(f"i{i}_{j} double" for i, j in _pairs(k))
            inverse = hessian.mapInPandas(_inverse_batch(k, keys), schema)
            rows = rows.join(inverse, keys)
            hat = sum(
                (F.col(f"i{i}_{j}") * F.col(f"x{i}") * F.col(f"x{j}") * (1.0 if i == j else 2.0) for i, j in _pairs(k)), F.lit(0.0)
            ) * F.col("_p") * (1 - F.col("_p"))
            residual = residual + hat * (0.5 - F.col("_p"))
        grads = [F.sum(F.col("_w") * residual * F.col(f"x{i}")).alias(f"g{i}") for i in range(k)]
        keep = [F.max(f"b{i}").alias(f"b{i}") for i in range(k)]
        return rows.groupBy(*keys).agg(F.sum("_w").alias("_w"), *grads, *cells, *keep)

    fitted = _iterate(start, sums, keys, k, passes, tolerance, 0.0)
    return _effects(fitted.join(gated, keys), keys, "b1", "v1", "odds_ratio")


def _inverse_batch(k: int, keys: list[str]):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            inverse = np.linalg.pinv(_square(frame, k, "h"), rcond=1e-13, hermitian=True)
            out = frame[keys].copy()
            for i, j in _pairs(k):
                out[f"i{i}_{j}"] = inverse[:, i, j]
            yield out

    return step


def _effects(df: DataFrame, keys: list[str], beta: str, variance: str, ratio: str) -> DataFrame:
    b, se = F.col(beta), F.sqrt(F.greatest(F.col(variance), F.lit(0.0)))
    out = df.select(
        *keys, "n", F.col("events").cast("bigint").alias("events"), b.alias("beta"), se.alias("se"), F.exp(b).alias(ratio),
        F.exp(b - 1.96 * se).alias("ci_low"), F.exp(b + 1.96 * se).alias("ci_high"), (F.abs(b) >= CLIP).alias("clipped"),
        (~F.col("active")).alias("converged"), F.try_divide(b, se).alias("_z"),
    )
    return out.withColumn("p_value", normal_p("_z")).drop("_z")


def adjusted_models(df: DataFrame, keys: list[str], y: str, x: str, models: dict[str, list[str]], **options) -> DataFrame:
    """The same outcome under several covariate sets, one row per key and model."""
    out = None
    for name, covariates in models.items():
        fit = logit_by_key(df, keys, y, x, covariates, **options).withColumn("model", F.lit(name))
        out = fit if out is None else out.unionByName(fit)
    return out


def dose_rows(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Six weighted rows (case, dosage, n) per key from a genotype count table; wild type is dose 0."""
    cells = [
        F.struct(F.lit(int(arm == "case")).alias("case"), F.lit(dose).alias("dosage"), F.col(f"{arm}_{g}").alias("n"))
        for arm in ("case", "control") for dose, g in enumerate(("wt", "het", "hom"))
    ]
    return counts.select(*keys, F.inline(F.array(*cells)))


def _penalised_doses(keys: list[str], passes: int, tolerance: float):
    """Kernel: penalised logistic fit of every row's six counts, all rows of a batch at once; a step that lowers the likelihood is halved."""
    dose = np.arange(3.0)

    def parts(n, y, beta):
        eta = beta[:, :1] + beta[:, 1:] * dose
        p = 1.0 / (1.0 + np.exp(-eta))
        w = n * p * (1 - p)
        h00, h01, h11 = w.sum(1), (w * dose).sum(1), (w * dose * dose).sum(1)
        det = h00 * h11 - h01 * h01
        likelihood = (y * eta - n * np.logaddexp(0.0, eta)).sum(1) + 0.5 * np.log(det)
        return p, h11 / det, -h01 / det, h00 / det, likelihood

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            y = frame[["case_wt", "case_het", "case_hom"]].to_numpy(float)
            n = y + frame[["control_wt", "control_het", "control_hom"]].to_numpy(float)
            beta, at = np.zeros((len(frame), 2)), np.arange(len(frame))
            with np.errstate(all="ignore"):
                for i in range(passes):
                    p, i00, i01, i11, now = parts(n[at], y[at], beta[at])
                    hat = p * (1 - p) * (i00[:, None] + 2 * i01[:, None] * dose + i11[:, None] * dose * dose)
                    score = y[at] - n[at] * p + n[at] * hat * (0.5 - p)
                    u0, u1 = score.sum(1), (score * dose).sum(1)
                    step = np.clip(np.stack([i00 * u0 + i01 * u1, i01 * u0 + i11 * u1], 1), -5.0, 5.0)
                    if i >= 10:  # what has not settled by now swings around its maximum
                        step /= 2
                    for _ in range(12):
                        worse = ~(parts(n[at], y[at], beta[at] + step)[4] >= now - 1e-12)
                        if not worse.any():
                            break
                        step[worse] /= 2
                    beta[at] += step
                    at = at[np.abs(step).max(1) >= tolerance]
                    if not len(at):
                        break
                variance = parts(n, y, beta)[3]
            settled = np.ones(len(frame), bool)
            settled[at] = False
            out = frame[keys].copy()
            out["beta"], out["variance"], out["converged"] = beta[:, 1], variance, settled
            yield out

    return fit


def dose_firth(counts: DataFrame, keys: list[str], passes: int = 200, tolerance: float = 1e-8, min_rows: int = 6) -> DataFrame:
    """Penalised dose effect per row of a genotype count table; no pass needs a shuffle, a row's six counts are the whole fit.

    Rows with fewer than ``min_rows`` samples, without a case or with one dose only are left out.
    """
    total = lambda g: F.col(f"case_{g}") + F.col(f"control_{g}")
    classes = sum(((total(g) > 0).cast("int") for g in ("het", "hom")), (total("wt") > 0).cast("int"))
    cases = F.col("case_wt") + F.col("case_het") + F.col("case_hom")
    usable = counts.where((total("wt") + total("het") + total("hom") >= min_rows) & (cases >= 1) & (classes >= 2))
    fitted = usable.mapInPandas(_penalised_doses(keys, passes, tolerance), _key_schema(usable, keys) + ", beta double, variance double, converged boolean")
    b, se = F.col("beta"), F.sqrt("variance")
    return fitted.select(
        *keys, F.exp(b).alias("odds_ratio"), F.exp(b - 1.96 * se).alias("ci_low"), F.exp(b + 1.96 * se).alias("ci_high"),
        normal_p(F.try_divide(b, se)).alias("p_value"), "converged", (F.abs(b) >= CLIP).alias("clipped"),
    )


def dose_risk(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Dose effect per key by a chain of fits: penalised, else ordinary where that does not settle, else the exact carrier test.

    The row says in ``model`` which one it is.
    """
    rows = cut_lineage(dose_rows(counts, keys))
    columns = [*keys, "odds_ratio", "ci_low", "ci_high", "p_value", "model"]
    penalised = dose_firth(counts, keys).withColumn("model", F.lit("penalised"))
    settled = cut_lineage(penalised.where("converged and not clipped and not isnan(p_value)").select(*columns))
    left = rows.join(settled.select(*keys), keys, "left_anti")
    ordinary = logit_by_key(left, keys, "case", "dosage", min_events=1, weight="n").withColumn("model", F.lit("ordinary"))
    ordinary = cut_lineage(ordinary.where("converged and not clipped and not isnan(p_value)").select(*columns))
    rest = counts.join(settled.unionByName(ordinary).select(*keys), keys, "left_anti")
    cells = rest.select(*keys, *[c.alias(n) for n, c in zip("abcd", (F.col("case_het") + F.col("case_hom"), F.col("case_wt"), F.col("control_het") + F.col("control_hom"), F.col("control_wt")))])
    ratio = odds_ratio(*[F.col(c) for c in "abcd"])
    exact = fisher_2x2(cells, tuple("abcd")).select(*keys, ratio.alias("_r"), "p_value", F.lit("exact").alias("model")).select(*keys, "_r.odds_ratio", "_r.ci_low", "_r.ci_high", "p_value", "model")
    return settled.unionByName(ordinary).unionByName(exact)


def firth_by_key(df: DataFrame, keys: list[str], y: str, x: str, **options) -> DataFrame:
    """Penalised logistic fit; keys whose fit does not settle are left to the caller's exact test."""
    return logit_by_key(df, keys, y, x, (), min_events=options.pop("min_events", 1), firth=True, **options)
