"""Tail probabilities as Arrow batches of numpy arithmetic over the small per-test tables."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, StructType

_SMALL = ", ".join(f"{math.lgamma(n + 1)!r}D" for n in range(17))


def log_factorial(n: str) -> str:
    """SQL text of ln n!: exact table up to 16, Stirling's series beyond (error below 1e-13)."""
    stirling = (
        f"({n} + 0.5D) * ln(double({n})) - {n} + {0.5 * math.log(2 * math.pi)!r}D"
        f" + (1D / 12 - (1D / 360 - 1D / 1260 / ({n}) / ({n})) / ({n}) / ({n})) / ({n})"
    )
    return f"CASE WHEN {n} <= 16 THEN get(array({_SMALL}), int({n})) ELSE {stirling} END"


def _steps(*shape: np.ndarray) -> int:
    """Terms that the expansions below need at most: they grow with the root of the largest parameter."""
    return int(5_000 + 40 * math.sqrt(max(float(np.max(v, initial=0.0)) for v in shape)))


_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(z) / math.sqrt(2.0))


def gamma_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    out[x <= 0] = 1.0
    series = (x > 0) & (x < a + 1)
    if series.any():
        s, y = a[series], x[series]
        term = 1.0 / s
        total, k = term.copy(), s.copy()
        for _ in range(_steps(s, y)):
            k += 1
            term = term * y / k
            total += term
            if np.all(np.abs(term) < np.abs(total) * 1e-16):
                break
        else:
            raise ArithmeticError("incomplete gamma series did not converge")
        out[series] = 1.0 - total * np.exp(-y + s * np.log(y) - _lgamma(s))
    fraction = x >= a + 1
    if fraction.any():
        s, y = a[fraction], x[fraction]
        tiny = 1e-300
        b = y + 1 - s
        c = np.full(s.shape, 1 / tiny)
        d = 1 / b
        h = d.copy()
        for i in range(1, _steps(s, y)):
            an = -i * (i - s)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
            if np.all(np.abs(step - 1) < 2e-15):
                break
        else:
            raise ArithmeticError("incomplete gamma fraction did not converge")
        out[fraction] = h * np.exp(-y + s * np.log(y) - _lgamma(s))
    return out


def beta_lower(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) by its continued fraction."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(
            _lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)
        ) / p
        c = np.ones_like(y)
        d = 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, _steps(p, q)):
            for num in (
                m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
                -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)),
            ):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                step = d * c
                h = h * step
            if np.all(np.abs(step - 1) < 2e-15):
                break
        else:
            raise ArithmeticError("incomplete beta fraction did not converge")
    value = np.where(y <= 0, 0.0, front * h)
    return np.where(flip, 1 - value, value)


def _stirling_error(n: float) -> float:
    """ln n! less Stirling's leading terms."""
    if n < 16:
        return 0.0 if n == 0 else math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n / n) / n / n) / n / n) / n


def _deviance(x: float, m: float) -> float:
    """x ln(x / m) + m - x without cancellation near x = m."""
    if abs(x - m) >= 0.1 * (x + m):
        return x * math.log(x / m) + m - x if x > 0 else m
    v = (x - m) / (x + m)
    total, term, j = (x - m) * v, 2 * x * v, 1
    while True:
        term *= v * v
        more = total + term / (2 * j + 1)
        if more == total:
            return total
        total, j = more, j + 1


def _log_binomial(k: float, n: float, p: float) -> float:
    """ln of the binomial probability by saddle-point terms, which keep their digits for any n."""
    if k == 0:
        return n * math.log1p(-p)
    if k == n:
        return n * math.log(p)
    head = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - _deviance(k, n * p) - _deviance(n - k, n * (1 - p))
    return head - 0.5 * (math.log(2 * math.pi) + math.log(k) + math.log1p(-k / n))


class Hypergeometric:
    """Probabilities of the first cell of a 2x2 table (a, b; c, d) with its margins fixed."""

    def __init__(self, a: int, b: int, c: int, d: int):
        self.r1, self.r2, self.c1 = a + b, c + d, a + c
        self.low, self.high, self.n = max(0, self.c1 - self.r2), min(self.r1, self.c1), a + b + c + d
        self.share = self.c1 / self.n if self.n else 0.0
        self.bottom = _log_binomial(self.c1, self.n, self.share) if self.low < self.high else 0.0

    def log_p(self, k: int) -> float:
        if self.low == self.high:
            return 0.0
        return _log_binomial(k, self.r1, self.share) + _log_binomial(self.c1 - k, self.r2, self.share) - self.bottom

    def tail(self, k: int, step: int) -> float:
        """Probability of k, k + step, ... by ratios of neighbours, until they no longer change the sum."""
        if not self.low <= k <= self.high:
            return 0.0
        top = self.log_p(k)
        if top < -745:
            return 0.0
        r1, r2, c1 = self.r1, self.r2, self.c1
        total, last, size, at = 1.0, 1.0, 256, float(k)
        room = self.high - k if step > 0 else k - self.low
        while room > 0:
            j = at + step * np.arange(min(size, room), dtype=float)
            ratio = (r1 - j) * (c1 - j) / ((j + 1) * (r2 - c1 + j + 1)) if step > 0 else j * (r2 - c1 + j) / ((r1 - j + 1) * (c1 - j + 1))
            terms = last * np.cumprod(ratio)
            total += float(terms.sum())
            last, at, room = float(terms[-1]), float(j[-1]) + step, room - len(j)
            if last <= total * 1e-18:
                break
            size = min(2 * size, 1 << 16)
        return math.exp(top) * total


def fisher_two_sided(a: int, b: int, c: int, d: int, tie: float = 1e-7) -> float:
    """Sum of hypergeometric probabilities not above the observed one.

    The observed probability has a closed form. Tails are summed outward from the observed cell and from its mirror, which bisection
    finds: a few standard deviations of terms, whatever the cells.
    """
    table = Hypergeometric(a, b, c, d)
    limit = table.log_p(a) + tie
    mode = min(max((table.r1 + 1) * (table.c1 + 1) // (table.n + 2), table.low), table.high)
    if table.log_p(mode) <= limit:
        return 1.0
    below = a < mode
    near, far = (mode, table.high + 1) if below else (table.low - 1, mode)
    while far - near > 1:
        middle = (near + far) // 2
        if (table.log_p(middle) <= limit) == below:
            far = middle
        else:
            near = middle
    return min(1.0, table.tail(a, -1 if below else 1) + table.tail(far if below else near, 1 if below else -1))


def difference_tails(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """Probability of a difference of shares at least as large as the observed one: below zero, and from zero up."""
    table = Hypergeometric(a, b, c, d)
    n1, n2, m = table.r1, table.r2, table.c1
    gap = abs(a * n2 - c * n1) * (1 - 1e-12)  # differences times n1 n2: k n2 - (m - k) n1
    low_cell = math.floor((m * n1 - gap) / (n1 + n2))
    if low_cell * (n1 + n2) >= m * n1:
        low_cell -= 1  # a difference of zero is not below zero
    return table.tail(min(low_cell, table.high), -1), table.tail(max(math.ceil((m * n1 + gap) / (n1 + n2)), table.low), 1)


@F.pandas_udf(StructType().add("low", DoubleType()).add("high", DoubleType()))
def difference_tails_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([difference_tails(*map(int, row)) for row in zip(a, b, c, d)], columns=["low", "high"])


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided exact p of the table (a, b; c, d); null where a cell is null. Repeated tables of a batch are computed once."""
    cells = pd.DataFrame({"a": a, "b": b, "c": c, "d": d})
    whole = cells.notna().all(axis=1).to_numpy()
    out = np.full(len(cells), np.nan)
    if whole.any():
        tables, place = np.unique(cells[whole].to_numpy().astype(np.int64), axis=0, return_inverse=True)
        out[whole] = np.array([fisher_two_sided(*map(int, row)) for row in tables])[place.ravel()]
    return pd.Series(out, dtype="float64").where(whole, other=None)


def _batched(kernel, *series: pd.Series) -> pd.Series:
    arrays = [s.to_numpy(dtype=float) for s in series]
    keep = np.all([np.isfinite(a) for a in arrays], axis=0)
    out = np.full(len(series[0]), np.nan)
    if keep.any():
        out[keep] = kernel(*[a[keep] for a in arrays])
    return pd.Series(out, dtype="float64").where(keep, other=None)


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided normal tail."""
    return _batched(normal_two_sided, z)


@F.pandas_udf(DoubleType())
def chi_square_p(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper chi-square tail."""
    return _batched(lambda x, k: gamma_upper(k / 2, x / 2), statistic, dof)


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided Student tail."""
    return _batched(lambda v, k: beta_lower(k / 2, np.full_like(k, 0.5), k / (k + v * v)), t, dof)


def null_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)
