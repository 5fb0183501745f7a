"""Alpha-stable random variates by the Chambers-Mallows-Stuck method, in numpy and as a column."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def check(alpha: float, beta: float, c: float) -> None:
    if not 0 < alpha <= 2:
        raise ValueError("alpha lies in (0, 2]")
    if not -1 <= beta <= 1:
        raise ValueError("beta lies in [-1, 1]")
    if not c > 0:
        raise ValueError("c is positive")


def stable(alpha: float, beta: float = 0.0, c: float = 1.0, mu: float = 0.0, size=None, rng: np.random.Generator | None = None, convention: str = "limit") -> np.ndarray:
    """Variates of scale c and shift mu.

    At alpha 2 the law is normal with standard deviation sqrt(2) * c, the limit of the
    general case; ``convention="reference"`` takes c squared instead.
    """
    check(alpha, beta, c)
    rng = rng or np.random.default_rng()
    if alpha == 2:
        return rng.normal(mu, c * c if convention == "reference" else math.sqrt(2) * c, size)
    angle = rng.uniform(-math.pi / 2, math.pi / 2, size)
    wait = rng.exponential(1.0, size)
    if alpha == 1:
        if beta == 0:
            return c * np.tan(angle) + mu
        tilt = math.pi / 2 + beta * angle
        x = 2 / math.pi * (tilt * np.tan(angle) - beta * np.log(math.pi / 2 * wait * np.cos(angle) / tilt))
        return c * x + mu + 2 / math.pi * beta * c * math.log(c)
    skew = beta * math.tan(math.pi * alpha / 2)
    turn, stretch = math.atan(skew) / alpha, (1 + skew * skew) ** (1 / (2 * alpha))
    x = stretch * np.sin(alpha * (angle + turn)) / np.cos(angle) ** (1 / alpha) * (np.cos(angle - alpha * (angle + turn)) / wait) ** ((1 - alpha) / alpha)
    return c * x + mu


def stable_column(u1: Column, u2: Column, alpha: float, beta: float = 0.0, c: float = 1.0, mu: float = 0.0) -> Column:
    """A variate from two uniform columns in (0, 1), such as ``F.rand(seed)``; stays in generated code."""
    check(alpha, beta, c)
    angle = (u1 - 0.5) * math.pi
    wait = -F.ln(u2)
    if alpha == 2:
        return 2 * c * F.sqrt(wait) * F.sin(angle) + mu
    if alpha == 1:
        if beta == 0:
            return c * F.tan(angle) + mu
        tilt = F.lit(math.pi / 2) + beta * angle
        x = 2 / math.pi * (tilt * F.tan(angle) - beta * F.ln(math.pi / 2 * wait * F.cos(angle) / tilt))
        return c * x + (mu + 2 / math.pi * beta * c * math.log(c))
    skew = beta * math.tan(math.pi * alpha / 2)
    turn, stretch = math.atan(skew) / alpha, (1 + skew * skew) ** (1 / (2 * alpha))
    x = stretch * F.sin(alpha * (angle + turn)) / F.pow(F.cos(angle), F.lit(1 / alpha)) * F.pow(F.cos(angle - alpha * (angle + turn)) / wait, F.lit((1 - alpha) / alpha))
    return c * x + mu
