"""One-sided exact (Clopper-Pearson) bounds, evaluated on already aggregated counts.

Spark has no inverse incomplete beta function, so a vectorised Arrow function finds where the log of the
binomial tail meets the log of its target: Newton steps inside a bracket that shrinks with every step,
and a halving wherever a step leaves it. It runs on report rows (one per slice or threshold), never on
raw data. A bound whose tail or root does not settle is null, which fails the certificate.
"""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 200
DEPTHS = tuple(64 * 4**k for k in range(8))
SETTLED = 1e-13


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, from its tail to its head.

    It is cut at a depth, then at four times the depth, until both agree; NaN where they never do.
    """
    value, last = np.full(x.shape, np.nan), np.full(x.shape, np.nan)
    open_ = np.arange(x.size)
    for depth in DEPTHS:
        p, q, y = a[open_], b[open_], x[open_]
        tail = np.zeros(y.shape)
        for m in range(depth, 0, -1):
            low = p + 2.0 * m
            tail = m * (q - m) * y / ((low - 1.0) * low) / (1.0 + tail)
            tail = -(p + m - 1.0) * (p + q + m - 1.0) * y / ((low - 2.0) * (low - 1.0)) / (1.0 + tail)
        now = 1.0 / (1.0 + tail)
        done = np.abs(now - last[open_]) <= SETTLED * np.abs(now)
        value[open_[done]] = now[done]
        last[open_] = now
        open_ = open_[~done]
        if not open_.size:
            break
    return value


def log_beta_tails(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the regularised incomplete beta function I_x(a, b) for 0 < x < 1, and its slope in x."""
    norm = np.array([lgamma(p + q) - lgamma(p) - lgamma(q) for p, q in zip(a, b)])
    near = x < (a + 1.0) / (a + b + 2.0)
    p, q, y = np.where(near, a, b), np.where(near, b, a), np.where(near, x, 1.0 - x)
    front = norm + a * np.log(x) + b * np.log1p(-x)
    with np.errstate(invalid="ignore", divide="ignore"):
        part = front + np.log(_fraction(p, q, y)) - np.log(p)
        value = np.where(near, part, np.log1p(-np.exp(np.minimum(part, 0.0))))
        slope = np.exp(front - np.log(x) - np.log1p(-x) - value)
    return value, slope


def tail_root(probability: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with I_x(a, b) = probability; NaN where it does not settle."""
    target = np.log(probability)
    low, high = np.zeros_like(a), np.ones_like(a)
    x, out = a / (a + b), np.full(a.shape, np.nan)
    open_ = np.arange(a.size)
    for _ in range(STEPS):
        at = np.clip(x[open_], 1e-300, 1.0 - 1e-16)
        value, slope = log_beta_tails(a[open_], b[open_], at)
        under = value < target
        low[open_], high[open_] = np.where(under, at, low[open_]), np.where(under, high[open_], at)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            step = at - (value - target) / slope
        inside = (step > low[open_]) & (step < high[open_])
        following = np.where(inside, step, (low[open_] + high[open_]) / 2.0)
        settled = (np.abs(following - at) <= 4e-16 + 1e-14 * at) & np.isfinite(value)
        out[open_[settled]] = following[settled]
        x[open_] = following
        open_ = open_[~settled & np.isfinite(value)]
        if not open_.size:
            break
    return out


def bounds(successes: np.ndarray, totals: np.ndarray, confidence: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds; NaN where the counts are not valid or a bound does not settle."""
    k, n = successes.astype(float), totals.astype(float)
    lower, upper = np.full(k.shape, np.nan), np.full(k.shape, np.nan)
    valid = (n > 0) & (k >= 0) & (k <= n)
    lower[valid & (k == 0)] = 0.0
    upper[valid & (k == n)] = 1.0
    some = valid & (k > 0)
    if some.any():
        lower[some] = tail_root(1.0 - confidence, k[some], n[some] - k[some] + 1.0)
    some = valid & (k < n)
    if some.any():
        upper[some] = tail_root(confidence, k[some] + 1.0, n[some] - k[some])
    return lower, upper


def exact_bounds(successes: Column, total: Column, confidence: float = 0.95) -> Column:
    """Struct(lower, upper); null fields for invalid counts."""

    @F.pandas_udf("lower double, upper double")
    def evaluate(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        lower, upper = bounds(k.fillna(-1).to_numpy(), n.fillna(0).to_numpy(), confidence)
        return pd.DataFrame({"lower": lower, "upper": upper}).astype(object).where(lambda d: d.notna(), None)

    return evaluate(successes.cast("long"), total.cast("long"))
