"""Numerical functions that Spark has no built-in for (no erf, no skew normal). They run on the driver or
on distinct values only; see ``paths.effective_lengths``."""

from __future__ import annotations

import math

import numpy as np

from pathquant.config import COMPARE_PRECISION

SQRT_2PI = math.sqrt(2 * math.pi)
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(40)
_erfc = np.vectorize(math.erfc, otypes=[float])


def normal_pdf(z):
    return np.exp(-0.5 * np.square(z)) / SQRT_2PI


def normal_cdf(z):
    return 0.5 * _erfc(-np.asarray(z, dtype=float) / math.sqrt(2))


def log_normal_pdf(x, mean, sd):
    return -np.log(sd) - 0.5 * math.log(2 * math.pi) - 0.5 * np.square((np.asarray(x, dtype=float) - mean) / sd)


def log_normal_cdf(z):
    """Accurate far into the lower tail, by the continued fraction of Mills' ratio."""
    z = np.asarray(z, dtype=float)
    tail = z < -8
    safe = np.where(tail, 0.0, z)
    upper = np.log1p(-0.5 * _erfc(np.maximum(safe, 0) / math.sqrt(2)))
    lower = np.log(np.maximum(normal_cdf(np.minimum(safe, 0)), 1e-300))
    x = np.where(tail, -z, 10.0)
    ratio = x.copy()
    for k in range(60, 0, -1):
        ratio = x + k / ratio
    far = -0.5 * np.square(x) - math.log(SQRT_2PI) - np.log(ratio)
    return np.where(tail, far, np.where(z > 0, upper, lower))


def owens_t(h, a):
    """(1 / 2 pi) times the integral over x from 0 to a of exp(-h^2 (1 + x^2) / 2) / (1 + x^2).

    For |a| > 1 the range is folded to [0, 1]: T(h, a) + T(a h, 1 / a) = (P(h) + P(ah)) / 2 - P(h) P(ah), a > 0.
    """
    h, a = np.broadcast_arrays(np.asarray(h, dtype=float), np.asarray(a, dtype=float))
    h, size, sign = np.abs(h), np.abs(a), np.sign(a)

    def inner(h, a):
        edges = np.linspace(0, 1, 9)
        total = np.zeros_like(h)
        for low, high in zip(edges[:-1], edges[1:]):
            x = a[..., None] * (low + (high - low) * (_NODES + 1) / 2)
            value = np.exp(-0.5 * np.square(h)[..., None] * (1 + x * x)) / (1 + x * x)
            total = total + (value * _WEIGHTS).sum(axis=-1) * a * (high - low) / 2
        return total / (2 * math.pi)

    small = inner(h, np.minimum(size, 1.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        turned = inner(np.where(size > 1, h * size, 0.0), np.where(size > 1, 1 / np.maximum(size, 1), 0.0))
    p, q = normal_cdf(h), normal_cdf(h * size)
    large = 0.5 * (p + q) - p * q - turned
    return sign * np.where(size > 1, large, small)


def skew_normal_pdf(x, loc, scale, shape):
    z = (np.asarray(x, dtype=float) - loc) / scale
    return 2 / scale * normal_pdf(z) * normal_cdf(shape * z)


def log_skew_normal_pdf(x, loc, scale, shape):
    z = (np.asarray(x, dtype=float) - loc) / scale
    return math.log(2) - np.log(scale) - math.log(SQRT_2PI) - 0.5 * np.square(z) + log_normal_cdf(shape * z)


def skew_normal_cdf(x, loc, scale, shape):
    z = (np.asarray(x, dtype=float) - loc) / scale
    return normal_cdf(z) - 2 * owens_t(z, shape)


def truncated_skew_normal_mean(loc, scale, shape, low, high):
    """Mean of the skew normal distribution cut to [low, high]."""
    u, v = (np.asarray(low, dtype=float) - loc) / scale, (np.asarray(high, dtype=float) - loc) / scale
    root = math.sqrt(1 + shape * shape)
    # the density's derivative is -z f(z) + 2 shape phi(z) phi(shape z), which integrates in closed form
    part = skew_normal_pdf(u, 0, 1, shape) - skew_normal_pdf(v, 0, 1, shape)
    part = part + 2 / SQRT_2PI * shape / root * (normal_cdf(v * root) - normal_cdf(u * root))
    with np.errstate(divide="ignore", invalid="ignore"):
        return loc + scale * part / (skew_normal_cdf(v, 0, 1, shape) - skew_normal_cdf(u, 0, 1, shape))


def truncated_normal_mean(mean, sd, low, high):
    u, v = (np.asarray(low, dtype=float) - mean) / sd, (np.asarray(high, dtype=float) - mean) / sd
    with np.errstate(divide="ignore", invalid="ignore"):
        return mean + sd * (normal_pdf(u) - normal_pdf(v)) / (normal_cdf(v) - normal_cdf(u))


def golden_section_maximum(f, low: float, high: float, tolerance: float) -> float:
    """Maximiser of a unimodal function on [low, high], within the tolerance."""
    ratio = (math.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = f(a), f(b)
    while high - low > tolerance:
        if fa < fb:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = f(b)
        else:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = f(a)
    return (low + high) / 2


def add_log(x: float, y: float) -> float:
    """Log of the sum of two numbers given by their logs."""
    top, low = max(x, y), min(x, y)
    return top if low == -math.inf else top + math.log1p(math.exp(low - top))


def log_sum_exp(values: np.ndarray, axis=None) -> np.ndarray:
    top = np.max(values, axis=axis, keepdims=True)
    out = top + np.log(np.sum(np.exp(values - top), axis=axis, keepdims=True))
    return np.squeeze(out, axis=axis) if axis is not None else out.item()


def same(a: float, b: float) -> bool:
    """Equal but for rounding."""
    return a == b or abs(a - b) < abs(min(a, b)) * COMPARE_PRECISION


def permutations(values, exact: bool = False) -> float:
    """Orderings of a multiset. Without exact, n! / (n - u + 1)! for u distinct values: right if one value repeats at most."""
    n, distinct = len(values), len(set(values))
    if exact:
        out = math.factorial(n)
        for v in set(values):
            out //= math.factorial(list(values).count(v))
        return float(out)
    return math.factorial(n) / math.factorial(n - distinct + 1)


def phred_to_prob(q: float) -> float:
    return 10 ** (-q / 10)


def prob_to_phred(p: float) -> float:
    return -10 * math.log10(p)


def clamp_int(value: float) -> int:
    """Rounded half away from zero, within 32 bits."""
    value = min(max(value, -(2.0**31)), 2.0**31 - 1)
    return int(math.copysign(math.floor(abs(value) + 0.5), value))
