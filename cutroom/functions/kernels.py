"""Numeric kernels over a decoded frame or stretch of samples; spectra.py and pictures.py have those of sound and motion."""

from __future__ import annotations

import numpy as np


def laplacian_variance(gray: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian of an image; 0 for images without an inside."""
    g = gray.astype(float)
    if min(g.shape) < 3:
        return 0.0
    inner = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(inner.var())


def waveform_peaks(samples: np.ndarray, buckets: int) -> np.ndarray:
    """Least and greatest sample of equal stretches, two numbers a stretch."""
    edges = np.linspace(0, len(samples), buckets + 1).astype(int)
    return np.array([(samples[a:b].min(), samples[a:b].max()) if b > a else (0, 0) for a, b in zip(edges[:-1], edges[1:], strict=True)]).ravel()
