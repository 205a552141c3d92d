"""Log-likelihood ratios and log odds, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HAZARD, ALARM = 1e-3, 0.999
ALARM_LOG_ODDS = math.log(ALARM / (1 - ALARM))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logit(p: Column) -> Column:
    return F.ln(p) - F.log1p(-p)


def gaussian(x: Column, healthy, changed, sd: Column) -> Column:
    return (changed - healthy) / sd * ((x - (healthy + changed) / 2) / sd)


def student_t(x: Column, healthy: Column, changed: Column, scale: Column, degrees: Column) -> Column:
    a, b = (x - changed) / scale, (x - healthy) / scale
    return -(degrees + 1) / 2 * (F.log1p(a * a / degrees) - F.log1p(b * b / degrees))


def bernoulli(hit: Column, healthy: float, changed: float) -> Column:
    return F.when(hit, math.log(changed / healthy)).otherwise(math.log1p(-changed) - math.log1p(-healthy))


def binomial(k: Column, n: Column, healthy: float, changed: float) -> Column:
    return k * math.log(changed / healthy) + (n - k) * (math.log1p(-changed) - math.log1p(-healthy))


def mean_of_two(a: Column, b: Column) -> Column:
    """log((e^a + e^b) / 2), shifted by the larger."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))) - math.log(2)
