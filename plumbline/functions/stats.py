"""Statistics over aggregated counts.

Spark reduces any number of item rows to a few counts per comparison. What is left here runs on
those count rows: column algebra where it suffices, vectorised Arrow functions otherwise.

Percentile intervals use the exact resampling distribution. Resampling n paired items with
replacement makes (wins, losses) multinomial, so the distribution of the mean difference can be
computed from its characteristic function; no random draws are needed, and no seed.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# ---- fixed values -------------------------------------------------------------------------
ALPHA = 0.05
MARGIN = 0.03
RESAMPLES = 10_000
POLICY_RESAMPLES = 4_000
EXACT_BELOW_DISCORDANT = 25
CLASSES = ("win", "tie", "loss")
KAPPA_GATE = 0.6
KAPPA_BANDS = ((0.0, "worse than chance"), (0.2, "slight"), (0.4, "fair"), (0.6, "moderate"), (0.8, "substantial"))
KAPPA_TOP_BAND = "almost perfect"
Z_ALPHA_HALF = 1.959963984540054
Z_POWER_80 = 0.8416212335729143
# -------------------------------------------------------------------------------------------


# ---- percentile intervals -----------------------------------------------------------------

def _difference_distribution(n: int, up: int, down: int) -> tuple[int, np.ndarray]:
    """(lowest value, probabilities) of #up - #down among n items drawn with replacement."""
    p_up, p_down = up / n, down / n
    mean = up - down
    sd = math.sqrt(max(0.0, n * (p_up + p_down - (p_up - p_down) ** 2)))
    if sd == 0.0:
        return mean, np.ones(1)
    half = int(12 * sd) + 40
    size = 1 << (2 * half + 1).bit_length()
    theta = 2.0 * np.pi * np.arange(size) / size
    theta = np.where(theta > np.pi, theta - 2.0 * np.pi, theta)
    step = (p_up + p_down) * (-2.0 * np.sin(theta / 2.0) ** 2) + 1j * (p_up - p_down) * np.sin(theta)
    with np.errstate(divide="ignore"):
        phi = np.exp(n * np.log1p(step) - 1j * mean * theta)
    pmf = np.clip(np.fft.fft(phi).real / size, 0.0, None)
    pmf = np.roll(pmf, half)[: 2 * half + 1]
    return mean - half, pmf


def _percentile_counts(n: int, up: int, down: int, alpha: float, resamples: int) -> tuple[int, int]:
    """Bounds, in items, at the sorted-draw positions a percentile interval uses."""
    lowest, pmf = _difference_distribution(n, up, down)
    cdf = np.cumsum(pmf)
    cdf /= cdf[-1]
    low_at = int((alpha / 2) * resamples) / resamples
    high_at = min(resamples - 1, int((1 - alpha / 2) * resamples)) / resamples
    last = len(cdf) - 1
    low = min(last, int(np.searchsorted(cdf, low_at, side="right")))
    high = min(last, int(np.searchsorted(cdf, high_at, side="right")))
    clamp = lambda v: max(-n, min(n, lowest + v))
    return clamp(low), clamp(high)


def paired_interval(n: Column, up: Column, down: Column, alpha: float = ALPHA, resamples: int = RESAMPLES) -> Column:
    """STRUCT(low, high): percentile bounds, in items, of the paired difference."""

    @F.pandas_udf("struct<low:bigint,high:bigint>")
    def bounds(n_: pd.Series, up_: pd.Series, down_: pd.Series) -> pd.DataFrame:
        rows = [
            (None, None) if pd.isna(a) or a <= 0 else _percentile_counts(int(a), int(b), int(c), alpha, resamples)
            for a, b, c in zip(n_, up_, down_)
        ]
        return pd.DataFrame(rows, columns=["low", "high"]).astype("Int64")

    return bounds(n.cast("bigint"), up.cast("bigint"), down.cast("bigint"))


def rate_interval(successes: Column, n: Column, alpha: float = ALPHA, resamples: int = POLICY_RESAMPLES) -> Column:
    """STRUCT(low, high): percentile bounds, in items, of one success count."""
    return paired_interval(n, successes, F.lit(0), alpha, resamples)


# ---- McNemar ------------------------------------------------------------------------------

def exact_mcnemar_p(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p-value; doubles are exact below 50 discordant pairs."""
    n = b + c
    terms = F.aggregate(
        F.sequence(F.lit(0), F.least(b, c).cast("int")),
        F.struct(F.lit(0.0).alias("tail"), F.lit(1.0).alias("ways")),
        lambda acc, i: F.struct(
            (acc["tail"] + acc["ways"]).alias("tail"),
            (acc["ways"] * (n - i).cast("double") / (i + 1).cast("double")).alias("ways"),
        ),
    )
    p = F.lit(2.0) * terms["tail"] / F.pow(F.lit(2.0), n.cast("double"))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), p))


@F.pandas_udf(T.DoubleType())
def chi2_survival(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom."""
    return x.map(lambda v: None if pd.isna(v) else math.erfc(math.sqrt(v / 2.0)))


@F.pandas_udf(T.DoubleType())
def _exact_p_any_size(b: pd.Series, c: pd.Series) -> pd.Series:
    def tail(x: float, y: float) -> float:
        n, k = int(x + y), int(min(x, y))
        if n == 0:
            return 1.0
        i = np.arange(k + 1)
        log_ways = math.lgamma(n + 1) - np.array([math.lgamma(j + 1) + math.lgamma(n - j + 1) for j in i])
        return float(min(1.0, 2.0 * np.exp(log_ways - n * math.log(2.0)).sum()))

    return pd.Series([tail(x, y) for x, y in zip(b, c)])


def yates_statistic(b: Column, c: Column) -> Column:
    n = b + c
    gap = F.abs(b - c).cast("double") - 1.0
    return F.when(n == 0, F.lit(0.0)).otherwise(gap * gap / n)


def mcnemar_method(b: Column, c: Column) -> Column:
    return F.when(b + c < EXACT_BELOW_DISCORDANT, F.lit("exact")).otherwise(F.lit("chi2"))


def mcnemar_p(b: Column, c: Column, force: str | None = None) -> Column:
    """p-value by the method the discordant count calls for, or by the forced one."""
    if force == "exact":
        return _exact_p_any_size(b.cast("double"), c.cast("double"))
    chi2 = F.least(F.lit(1.0), chi2_survival(yates_statistic(b, c)))
    if force == "chi2":
        return chi2
    if force is not None:
        raise ValueError(f"unknown method {force!r}; expected 'exact' or 'chi2'")
    small = b + c < EXACT_BELOW_DISCORDANT
    exact = exact_mcnemar_p(F.when(small, b).otherwise(0), F.when(small, c).otherwise(0))
    return F.when(small, exact).otherwise(chi2)


# ---- decisions ----------------------------------------------------------------------------

def classify_interval(low: Column, high: Column, margin: Column | float) -> Column:
    """Outcome of an interval against a practical margin; only a whole interval decides."""
    m = margin if isinstance(margin, Column) else F.lit(float(margin))
    problem = F.when(m < 0, F.lit("margin must be non-negative")).when(low > high, F.lit("malformed interval"))
    return (
        F.when(problem.isNotNull(), F.raise_error(problem).cast("string"))
        .when(high < -m, F.lit("REGRESSION"))
        .when(low > m, F.lit("IMPROVEMENT"))
        .when((low >= -m) & (high <= m), F.lit("EQUIVALENT"))
        .when(low.isNotNull(), F.lit("INCONCLUSIVE"))
    )


def required_items(effect: Column, discordant_rate: Column) -> Column:
    """Items needed to see ``effect`` at 5 % and 80 % power: the squared quantiles times the variance of a difference, over effect squared.

    An effect as large as the discordant rate needs no planning; impossible rates give NULL.
    """
    quantiles = Z_ALPHA_HALF + Z_POWER_80
    plannable = (effect > 0) & (discordant_rate > 0) & (discordant_rate <= 1)
    per_item = F.lit(quantiles * quantiles) * discordant_rate
    return F.when(plannable, F.when(effect >= discordant_rate, F.lit(0)).otherwise(F.ceil(per_item / (effect * effect)))).cast("bigint")


def interpret_kappa(kappa: Column) -> Column:
    word = None
    for upper, name in KAPPA_BANDS:
        word = (F if word is None else word).when(kappa < upper, F.lit(name))
    return word.otherwise(F.when(kappa.isNotNull(), F.lit(KAPPA_TOP_BAND)))


# ---- exact bounds of a rate ---------------------------------------------------------------

def _beta_tail(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b), by its continued fraction, elementwise."""
    flip = x > (a + 1.0) / (a + b + 2.0)
    x_, a_, b_ = np.where(flip, 1.0 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    lgamma = np.vectorize(math.lgamma)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore", under="ignore"):
        front = np.exp(lgamma(a_ + b_) - lgamma(a_) - lgamma(b_) + a_ * np.log(x_) + b_ * np.log1p(-x_)) / a_
        tiny = 1e-300
        c = np.ones_like(x_)
        d = 1.0 - (a_ + b_) * x_ / (a_ + 1.0)
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 200_000):
            for num in (
                m * (b_ - m) * x_ / ((a_ + 2 * m - 1) * (a_ + 2 * m)),
                -(a_ + m) * (a_ + b_ + m) * x_ / ((a_ + 2 * m) * (a_ + 2 * m + 1)),
            ):
                d = 1.0 + num * d
                d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1.0 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.all(np.abs(d * c - 1.0) < 1e-15):
                break
        else:
            raise ArithmeticError("the continued fraction of the beta tail did not settle")
        value = np.where(x_ <= 0.0, 0.0, front * h)
    return np.where(flip, 1.0 - value, value)


def _exact_upper(k: np.ndarray, n: np.ndarray, alpha: float) -> np.ndarray:
    """p at which P(X <= k) falls to alpha/2, i.e. the beta quantile, by bisection."""
    lo, hi = np.zeros(len(k)), np.ones(len(k))
    inside = k < n
    a, b = k + 1.0, np.where(inside, n - k, 1.0)
    for _ in range(60):
        mid = (lo + hi) / 2.0
        above = 1.0 - _beta_tail(mid, a, b) > alpha / 2.0
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.where(inside, hi, 1.0)


def exact_bounds(k: Column, n: Column, alpha: float = ALPHA) -> Column:
    """STRUCT(low, high): Clopper-Pearson bounds of k events in n trials, 8 decimals."""

    @F.pandas_udf("struct<low:double,high:double>")
    def bounds(k_: pd.Series, n_: pd.Series) -> pd.DataFrame:
        events, trials = k_.to_numpy(dtype=float), n_.to_numpy(dtype=float)
        ok = (trials > 0) & (events >= 0) & (events <= trials)
        if not ok.all():
            raise ValueError("exact bounds need 0 <= events <= trials and trials > 0")
        high = _exact_upper(events, trials, alpha)
        low = np.where(events == 0, 0.0, 1.0 - _exact_upper(trials - events, trials, alpha))
        return pd.DataFrame({"low": np.round(low, 8), "high": np.round(high, 8)})

    return bounds(k.cast("double"), n.cast("double"))


def min_trials(target: Column, alpha: float = ALPHA) -> Column:
    """Fewest event-free trials that could show a rate at or below ``target``."""
    return F.ceil(F.lit(math.log(alpha / 2.0)) / F.log1p(-target)).cast("bigint")


# ---- kappa --------------------------------------------------------------------------------

def _kappa_of(counts: np.ndarray) -> np.ndarray:
    """Cohen's kappa of arrays of nine cells in (rater one, rater two) order."""
    table = counts.reshape(-1, 3, 3).astype(float)
    n = table.sum(axis=(1, 2))
    with np.errstate(divide="ignore", invalid="ignore"):
        observed = np.trace(table, axis1=1, axis2=2) / n
        expected = (table.sum(axis=2) * table.sum(axis=1)).sum(axis=1) / (n * n)
        kappa = (observed - expected) / (1.0 - expected)
    return np.where((n == 0) | (np.abs(1.0 - expected) < 1e-12), 0.0, kappa)


def _hash_uniforms(seed: str, n: int) -> np.ndarray:
    digests = b"".join(hashlib.md5(f"{seed}|{block}".encode()).digest() for block in range(-(-n // 4)))
    return np.frombuffer(digests, ">u4")[:n] / 4294967296.0


def _poisson_quantile(mean: int, u: np.ndarray) -> np.ndarray:
    """Poisson quantiles of uniforms, from probabilities within 12 standard deviations of the mean."""
    if mean == 0:
        return np.zeros(len(u), np.int64)
    reach = 12.0 * math.sqrt(mean)
    first = max(0, math.floor(mean - reach))
    k = np.arange(first + 1, math.ceil(mean + reach) + 21)
    start = first * math.log(mean) - mean - math.lgamma(first + 1)
    logs = start + np.concatenate(([0.0], np.cumsum(math.log(mean) - np.log(k))))
    return first + np.searchsorted(np.cumsum(np.exp(logs)), u, side="right")


def kappa_interval(cells: Column, seed_text: Column, alpha: float = ALPHA, resamples: int | None = None) -> Column:
    """STRUCT(low, high): percentile interval of kappa, redrawing the nine cells.

    Every cell is drawn from a Poisson distribution around its count, at a uniform read off a hash of (seed text, cell,
    draw): a row's interval does not depend on its task, and SQL can repeat it. One md5 serves four draws.
    """
    draws = resamples or RESAMPLES

    @F.pandas_udf("struct<low:double,high:double>")
    def bounds(cells_: pd.Series, seeds: pd.Series) -> pd.DataFrame:
        out = []
        for counts, seed in zip(cells_, seeds):
            counts = np.asarray(counts, dtype=np.int64)
            n = int(counts.sum())
            if n < 2:
                out.append((0.0, 0.0))
                continue
            redrawn = [_poisson_quantile(int(m), _hash_uniforms(f"{seed}|{i}", draws)) for i, m in enumerate(counts)]
            kappas = np.sort(_kappa_of(np.stack(redrawn, axis=1)))
            low = kappas[int((alpha / 2) * draws)]
            high = kappas[min(draws - 1, int((1 - alpha / 2) * draws))]
            out.append((round(float(low), 4), round(float(high), 4)))
        return pd.DataFrame(out, columns=["low", "high"])

    return bounds(cells, seed_text)
