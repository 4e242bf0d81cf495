"""Special functions without scipy: beta distribution, golden section."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny, c, d, out = 1e-300, 1.0, 0.0, 1.0
    for i in range(300):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        out *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (out - 1)


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(mid, a, b) < p else (lo, mid)
    return (lo + hi) / 2


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers, by Stirling's series eight further on."""
    z = x + 8
    series = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3)) - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def beta_cdfs(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """beta_cdf() of many at once."""
    swap = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    x = np.clip(x, 1e-300, 1.0)
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-np.minimum(x, 1 - 1e-16))) / a
    c, d, out = np.ones_like(x), np.ones_like(x), np.ones_like(x)
    d = 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < 1e-300, 1e-300, 1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 150):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            out = out * c * d
        if np.all(np.abs(1 - c * d) < 1e-9):
            break
    p = np.clip(front * out, 0.0, 1.0)
    return np.where(swap, 1 - p, p)


def beta_quantiles(p: float, a: np.ndarray, b: np.ndarray, tol: float = 1e-7) -> np.ndarray:
    """beta_quantile() of many at once: Newton steps, halved intervals where they lead out; what has settled stays."""
    lo, hi, x = np.zeros(len(a)), np.ones(len(a)), a / (a + b)
    norm = log_gamma(a + b) - log_gamma(a) - log_gamma(b)
    on = np.arange(len(a))
    for _ in range(50):
        off = beta_cdfs(x[on], a[on], b[on]) - p
        lo[on], hi[on] = np.where(off < 0, x[on], lo[on]), np.where(off < 0, hi[on], x[on])
        slope = np.exp(np.clip(norm[on] + (a[on] - 1) * np.log(np.maximum(x[on], 1e-300)) + (b[on] - 1) * np.log(np.maximum(1 - x[on], 1e-300)), -700, 700))
        new = x[on] - off / np.maximum(slope, 1e-300)
        new = np.where((new > lo[on]) & (new < hi[on]), new, (lo[on] + hi[on]) / 2)
        moved = np.abs(new - x[on]) >= tol
        x[on] = new
        on = on[moved]
        if not len(on):
            break
    return x


def golden_section(f: Callable[[float], float], lo: float, hi: float, tol: float = 1e-4) -> float:
    """The place of the least value of a unimodal function."""
    g = (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    while hi - lo > tol:
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = f(b)
    return (lo + hi) / 2


def golden_sections(f: Callable[[np.ndarray], np.ndarray], lo: float, hi: float, n: int, tol: float = 1e-4) -> np.ndarray:
    """golden_section() of n functions over one interval; f gives the values of all at a place each."""
    g = (math.sqrt(5) - 1) / 2
    lo, hi, width = np.full(n, lo), np.full(n, hi), hi - lo
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    while width > tol:
        left = fa < fb
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
        width *= g
        place = np.where(left, hi - g * (hi - lo), lo + g * (hi - lo))
        new = f(place)
        a, b, fa, fb = np.where(left, place, b), np.where(left, a, place), np.where(left, new, fb), np.where(left, fa, new)
    return (lo + hi) / 2


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p of a 2 x 2 table: all tables as likely as this one or less."""
    n, r, s = a + b + c + d, a + b, a + c
    lg = math.lgamma
    fixed = lg(r + 1) + lg(n - r + 1) + lg(s + 1) + lg(n - s + 1) - lg(n + 1)
    logp = lambda x: fixed - lg(x + 1) - lg(r - x + 1) - lg(s - x + 1) - lg(n - r - s + x + 1)
    own = logp(a)
    return min(1.0, sum(math.exp(q) for x in range(max(0, r + s - n), min(r, s) + 1) if (q := logp(x)) <= own + 1e-7))
