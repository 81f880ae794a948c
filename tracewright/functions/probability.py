"""Probability as Column expressions: normal distribution, mixtures, emission and transition scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col

# The coefficients of formula 7.1.26 of Abramowitz and Stegun.
A1, A2, A3, A4, A5, P = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429, 0.3275911

SIGMA_M = 4.07  # of GPS errors, before one is learned
BETA = 2.0
FLOOR = 1e-150
BIN = 2  # degrees or metres
ROOT_2PI = math.sqrt(2 * math.pi)


def normal_cdf(x) -> Column:
    x = col(x)
    z = F.abs(x) / math.sqrt(2.0)
    t = F.lit(1.0) / (F.lit(1.0) + z * P)
    y = F.lit(1.0) - ((((t * A5 + A4) * t + A3) * t + A2) * t + A1) * t * F.exp(-z * z)
    return (F.lit(1.0) + F.when(x < 0, -y).otherwise(y)) * 0.5


def normal_density(x) -> Column:
    return F.exp(-col(x) * col(x) / 2) / ROOT_2PI


def positive_mass(mu, sigma) -> Column:
    """The share of a normal distribution above zero."""
    return F.lit(1.0) - normal_cdf(-col(mu) / col(sigma))


def logistic(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def emission(dist, sigma: float | Column = SIGMA_M) -> Column:
    """Density of an observation at a distance from a road."""
    z = col(dist) / sigma
    return F.exp(-(z * z) * 0.5) / (F.lit(ROOT_2PI) * sigma)


def detour_density(detour, beta: float = BETA) -> Column:
    """Density of the difference between the way on roads and the straight line."""
    return F.exp(-F.abs(col(detour)) / beta) / beta


def travel_time_preference(seconds) -> Column:
    return F.lit(1.0) / F.greatest(col(seconds), F.lit(1.0))


def mixture(x, val0, sig1, s1, sig2, mu2) -> Column:
    """Density of a half-normal and a truncated normal part; ``val0`` is the mass at zero, which isn't in it."""
    x, val0, sig1, s1, sig2, mu2 = map(col, (x, val0, sig1, s1, sig2, mu2))
    half = s1 / positive_mass(F.lit(0.0), sig1) / (sig1 * ROOT_2PI)
    rest = (F.lit(1.0) - val0 - s1) / positive_mass(mu2, sig2) / (sig2 * ROOT_2PI)
    return half * F.exp(-x * x / (sig1 * sig1 * 2)) + rest * F.exp(-(x - mu2) * (x - mu2) / (sig2 * sig2 * 2))
