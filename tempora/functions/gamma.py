"""The regularised upper incomplete gamma function and its inverse, on arrays."""

from __future__ import annotations

import math

import numpy as np


def _log_gamma(k: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(x) for x in np.ravel(k)]).reshape(np.shape(k))


def upper(k: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Q(k, x): the share of a gamma distribution of shape k and scale 1 above x."""
    k, x = np.broadcast_arrays(np.asarray(k, float), np.asarray(x, float))
    out = np.ones(k.shape)
    low = (x > 0) & (x < k + 1)
    if low.any():
        a, y = k[low], x[low]
        term = total = 1 / a
        for n in range(1, 2000):
            term = term * y / (a + n)
            total = total + term
            if (np.abs(term) < 1e-16 * np.abs(total)).all():
                break
        out[low] = 1 - np.clip(total * np.exp(-y + a * np.log(y) - _log_gamma(a)), 0, 1)
    high = x >= k + 1
    if high.any():
        a, y = k[high], x[high]
        b = y + 1 - a
        c, d = np.full(a.shape, 1e300), 1 / b
        h = d
        for i in range(1, 2000):
            an = -i * (i - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[high] = np.clip(np.exp(-y + a * np.log(y) - _log_gamma(a)) * h, 0, 1)
    return out


def upper_inverse(k: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The x with upper(k, x) = q, by bisection; 0 for q >= 1."""
    k, q = np.broadcast_arrays(np.asarray(k, float), np.asarray(q, float))
    lo, hi = np.zeros(k.shape), np.maximum(k, 1.0)
    for _ in range(200):
        small = upper(k, hi) > q
        if not small.any():
            break
        hi = np.where(small, hi * 2, hi)
    for _ in range(200):
        mid = (lo + hi) / 2
        above = upper(k, mid) > q
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.where(q >= 1, 0.0, (lo + hi) / 2)


def taily_raw(mean: np.ndarray, var: np.ndarray, hits: np.ndarray, every: np.ndarray, corpus: tuple[float, float, float], n_c: float) -> np.ndarray:
    """Expected documents of each shard among the best n_c, before they are scaled to that sum; corpus: mean, variance and
    number of documents with all terms of all shards together.

    Without variance in the corpus, a shard's hits count; without documents that have all terms, or without variance
    in the shard, its mean does.
    """
    of_all, spread, all_n = corpus
    if spread < 1e-10:
        return hits.astype(float)
    if all_n < 1e-10:
        return mean.astype(float)
    cut = float(upper_inverse(np.array([of_all**2 / spread]), np.array([min(1.0, n_c / all_n)]))[0]) * spread / of_all
    flat = var < 1e-10
    safe = np.where(flat, 1.0, var)
    m = np.maximum(mean, 1e-12)
    return np.where(flat, mean, every * upper(m * m / safe, cut / (safe / m)))
