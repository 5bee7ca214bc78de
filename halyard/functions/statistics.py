"""Tests on small aligned vectors, and the distributions they need. They run on what aggregates have left: a value for each group or
method, never on rows of a table."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

NAN = float("nan")


@dataclass(frozen=True)
class Result:
    statistic: float
    pvalue: float
    n: int


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return NAN if math.isnan(t) else beta_share(df / 2, 0.5, df / (df + t * t))


def t_from_sums(n: int, mean: float, std: float) -> Result:
    """Paired t-test from the differences' count, mean and sample deviation."""
    if n < 2:
        return Result(NAN, NAN, n)
    if std == 0:
        return Result(NAN if mean == 0 else math.copysign(math.inf, mean), NAN if mean == 0 else 0.0, n)
    t = mean / (std / math.sqrt(n))
    return Result(t, t_two_sided(t, n - 1), n)


def paired_ttest(a: np.ndarray, b: np.ndarray) -> Result:
    a, b = np.asarray(a, float), np.asarray(b, float)
    if a.shape != b.shape:
        raise ValueError(f"shapes {a.shape} and {b.shape} differ")
    d = a - b
    return t_from_sums(len(d), float(d.mean()) if len(d) else NAN, float(d.std(ddof=1)) if len(d) > 1 else NAN)


def average_ranks(x: np.ndarray) -> np.ndarray:
    """From 1; ties share the mean of their places."""
    x = np.asarray(x, float)
    values, back, counts = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(counts)
    return (last - (counts - 1) / 2)[back] if len(values) else x


def wilcoxon(differences: np.ndarray) -> Result:
    """Signed ranks of the finite differences; zeros are left out. Exact for up to 50 without ties or zeros, else the normal form
    with its variance corrected for ties."""
    d = np.asarray(differences, float)
    d = d[np.isfinite(d)]
    n = len(d)
    if not n or np.allclose(d, 0):
        return Result(NAN, NAN, n)
    some = d[d != 0]
    m = len(some)
    size = np.abs(some)
    ranks = average_ranks(size)
    plus = float(ranks[some > 0].sum())
    least = min(plus, m * (m + 1) / 2 - plus)
    _, ties = np.unique(size, return_counts=True)
    return Result(least, signed_rank_p(least, m, n, float((ties**3 - ties).sum())), n)


def signed_rank_p(least: float, m: int, n: int, ties: float) -> float:
    """Two-sided p of the smaller rank sum of m differences that aren't zero, of n: exact for up to 50 if none is zero or tied (ties: the
    sum of t ** 3 - t over ties), else of the normal form."""
    if not m:
        return NAN
    if m <= 50 and m == n and not ties:
        ways = [1]
        for r in range(1, m + 1):
            ways = [(ways[k] if k < len(ways) else 0) + (ways[k - r] if k >= r else 0) for k in range(len(ways) + r)]
        return min(1.0, 2 * sum(ways[: int(least) + 1]) / 2**m)
    spread = math.sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48)
    return min(1.0, math.erfc(abs((least - m * (m + 1) / 4) / spread) / math.sqrt(2))) if spread else NAN


#: Trials from which on a binomial tail is summed in doubles, and successes under which it is summed in integers whatever the trials.
LARGE, FEW = 1000, 16


def _stirling_error(n: int) -> float:
    """ln n! less Stirling's formula, for n of FEW or more."""
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n


def fair_tail(least: int, n: int) -> float:
    """The chance of at most least heads, which is no more than half of n, among n tosses. Of many tosses the largest term is taken by
    Stirling's formula with its error and the smaller ones by their ratios until they no longer count: some sqrt(n) of them."""
    if n <= LARGE or least < FEW:
        term = total = 1
        for k in range(1, least + 1):
            term = term * (n - k + 1) // k
            total += term
        return total / 2**n
    x = (2 * least - n) / n
    deviance = n / 2 * ((1 + x) * math.log1p(x) + (1 - x) * math.log1p(-x))
    error = _stirling_error(n) - _stirling_error(least) - _stirling_error(n - least)
    ratio = total = 1.0
    for k in range(least, 0, -1):
        ratio *= k / (n - k + 1)
        total += ratio
        if ratio < 1e-18 * total:
            break
    return total * math.sqrt(n / (2 * math.pi * least * (n - least))) * math.exp(error - deviance)


def mcnemar(first_only: int, second_only: int, n: int) -> Result:
    """Exact, from the numbers of discordant pairs."""
    both = first_only + second_only
    if not both:
        return Result(0.0, 1.0, n)
    return Result(float(first_only - second_only), min(1.0, 2 * fair_tail(min(first_only, second_only), both)), n)


def williams(r_xy: float, r_xz: float, r_yz: float, n: int) -> Result:
    """Whether two correlations with one variable differ."""
    if n < 4 or any(map(math.isnan, (r_xy, r_xz, r_yz))):
        return Result(NAN, NAN, n)
    left = 1 - r_xy**2 - r_xz**2 - r_yz**2 + 2 * r_xy * r_xz * r_yz
    under = 2 * (n - 1) / (n - 3) * left + (r_xy + r_xz) ** 2 / 4 * (1 - r_yz) ** 3
    if under <= 0:
        return Result(NAN, NAN, n)
    t = (r_xy - r_xz) * math.sqrt((n - 1) * (1 + r_yz) / under)
    return Result(t, t_two_sided(t, n - 3), n)


def bootstrap(values: np.ndarray, level: float = 0.95, resamples: int = 10_000, seed: int = 0) -> tuple[float, float, float]:
    """Mean and percentile interval of the finite values' resampled means, drawn in blocks of bounded size."""
    v = np.asarray(values, float)
    v = v[np.isfinite(v)]
    if not len(v):
        return NAN, NAN, NAN
    rng = np.random.default_rng(seed)
    block = max(1, (1 << 20) // len(v))
    means = np.concatenate([v[rng.integers(0, len(v), (min(block, resamples - at), len(v)))].mean(1) for at in range(0, resamples, block)])
    low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return float(v.mean()), float(low), float(high)


def holm(pvalues: list[float]) -> list[float]:
    """Step-down adjusted; NaN stays and doesn't count."""
    p = np.asarray(pvalues, float)
    out = np.full(len(p), NAN)
    real = np.flatnonzero(np.isfinite(p))
    order = real[np.argsort(p[real], kind="stable")]
    out[order] = np.minimum(1, np.maximum.accumulate(p[order] * np.arange(len(order), 0, -1))) if len(order) else p[order]
    return out.tolist()


def pearson(x: np.ndarray, y: np.ndarray, floor: int = 2) -> float:
    """NaN for fewer than floor pairs or a constant side."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(x) < floor:
        return NAN
    x, y = x - x.mean(), y - y.mean()
    scale = math.sqrt(float(x @ x) * float(y @ y))
    return float(x @ y) / scale if scale > 0 else NAN


def spearman(x: np.ndarray, y: np.ndarray, floor: int = 2) -> float:
    return pearson(average_ranks(x), average_ranks(y), floor)


def wasserstein(a: np.ndarray, b: np.ndarray, least: int = 64) -> float:
    """Mean distance of matched quantiles, as many as the larger sample has, least at least."""
    if not len(a) or not len(b):
        return NAN
    q = np.linspace(0, 1, max(len(a), len(b), least))
    return float(np.abs(np.quantile(a, q) - np.quantile(b, q)).mean())
