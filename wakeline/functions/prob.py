"""Probability surfaces and log-space helpers as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the transition surface: time and distance scales.
SECONDS, KM = 551.0, 7.0
# Fixed values of the match surface: limits, base level, and (weight, decay, centre x, centre y) of each bump.
MATCH_SECONDS, MATCH_KM, MATCH_BASE = 120.0, 2.0, 0.57
BUMPS = [(1.0, 6, -0.2, -0.2), (0.0002, 10, 1.0, 1.0), (0.06, 100, 0.0, 0.0), (0.08, 20, 0.4, 0.4), (0.12, 25, 0.25, 0.25), (0.10, 20, 0.1, 0.1), (-0.6, 15, 1.0, 0.0), (-0.6, 15, 0.0, 1.0)]
FLOOR, RESERVED = 1e-300, 0.05


def transition(seconds: Column, km: Column) -> Column:
    """Signed seconds and kilometres to a probability: 0 backwards in time, 1 where either is unknown."""
    p = F.exp(-2.0 * seconds / SECONDS - 2.0 * km / KM)
    return F.when(seconds < 0, 0.0).when((seconds + km).isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))


def match(seconds: Column, km: Column) -> Column:
    """Probability that two reports are one event; 0 beyond 120 s or 2 km."""
    x, y = seconds / MATCH_SECONDS, km / MATCH_KM
    total = F.lit(MATCH_BASE)
    for weight, decay, cx, cy in BUMPS:
        total = total + weight * F.exp(-decay * (F.pow(x - cx, 2) + F.pow(y - cy, 2)))
    return F.when((seconds > MATCH_SECONDS) | (km > MATCH_KM), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def transition_of(seconds: np.ndarray, km: np.ndarray) -> np.ndarray:
    """``transition`` over arrays, NaN where unknown."""
    p = np.exp(np.minimum(0.0, -2.0 * seconds / SECONDS - 2.0 * km / KM))
    return np.where(seconds < 0, 0.0, np.where(np.isnan(p), 1.0, p))


def match_of(seconds: np.ndarray, km: np.ndarray) -> np.ndarray:
    """``match`` over arrays, NaN where unknown."""
    x, y = seconds / MATCH_SECONDS, km / MATCH_KM
    out = np.zeros(np.broadcast(x, y).shape)
    near = (seconds <= MATCH_SECONDS) & (km <= MATCH_KM)
    x, y = x[near], y[near]
    total = np.full(len(x), MATCH_BASE)
    for weight, decay, cx, cy in BUMPS:
        total = total + weight * np.exp(-decay * ((x - cx) ** 2 + (y - cy) ** 2))
    out[near] = np.clip(total, 0.0, 1.0)
    return out


def share(p: Column, total: Column) -> Column:
    """A share of the outgoing mass, with a part reserved for the end."""
    return F.when(total == 0, 0.0).otherwise(p / total * (1 - RESERVED))


def log(p: Column) -> Column:
    return F.log(p + F.lit(FLOOR))
