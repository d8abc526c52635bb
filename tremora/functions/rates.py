"""Column builders for rates, probabilities, energy and the triggering kernel."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tremora.fixed import DAY_US, RATE_ORIGIN_US, YEAR_DAYS


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def poisson_probability(rate_per_year: Column, horizon_days) -> Column:
    h = horizon_days if isinstance(horizon_days, Column) else F.lit(float(horizon_days))
    return -F.expm1(-(rate_per_year * (h / F.lit(YEAR_DAYS))))


def yearly_rate(probability: Column, horizon_days: float, floor: float, ceiling: float = 0.999) -> Column:
    """Inverse of `poisson_probability` after clipping the probability."""
    return -F.ln(F.lit(1.0) - clip(probability, floor, ceiling)) / F.lit(horizon_days / YEAR_DAYS)


def extrapolated_rate(count: Column, years: Column, b: float, m0: float, mc: float) -> Column:
    """Yearly rate of M>=m0 from counts of M>=mc under the frequency-magnitude law."""
    return count.cast("double") / years * F.lit(10.0 ** (-b * (m0 - mc)))


def elapsed_years(t_us: Column) -> Column:
    years = (t_us - F.lit(RATE_ORIGIN_US)).cast("double") / F.lit(float(DAY_US)) / F.lit(YEAR_DAYS)
    return F.greatest(years, F.lit(1.0))


def energy(mag: Column) -> Column:
    return F.pow(F.lit(10.0), F.lit(1.5) * mag)


def log_energy(energy_sum: Column) -> Column:
    return F.log10(F.lit(1.0) + F.coalesce(energy_sum, F.lit(0.0)))


def days_between(later_us: Column, earlier_us: Column) -> Column:
    return (later_us - earlier_us).cast("double") / F.lit(float(DAY_US))


def productivity(mag: Column, k: Column, alpha: Column, m0: float) -> Column:
    return k * F.exp(alpha * (mag - F.lit(m0)))


def decay(lag_days: Column, c: Column, p: Column) -> Column:
    return F.pow(lag_days + c, -p)


def decay_integral(span_days: Column, c: Column, p: Column) -> Column:
    """Integral of the decay from 0 to the span; logarithmic where p is one."""
    q = F.lit(1.0) - p
    flat = F.abs(q) < 1e-8
    power = (F.pow(span_days + c, q) - F.pow(c, q)) / F.when(~flat, q)
    return F.when(flat, F.ln((span_days + c) / c)).otherwise(power)


@dataclass(frozen=True)
class Triggering:
    """Parameters of the triggering intensity; times in days."""

    mu: float
    k: float
    alpha: float
    c: float
    p: float
    m0: float

    def valid(self) -> bool:
        return self.mu > 0 and self.k >= 0 and self.c > 0 and self.p > 0 and self.alpha >= 0

    def kernel(self, mag: Column, lag_days: Column) -> Column:
        size = productivity(mag, F.lit(self.k), F.lit(self.alpha), self.m0)
        return size * decay(lag_days, F.lit(self.c), F.lit(self.p))


def branching_ratio(k: Column, alpha: Column, c: Column, p: Column, b: float) -> Column:
    """Mean number of direct followers of an event; NULL where it has no finite value (p <= 1, or alpha not below b ln 10)."""
    beta = F.lit(b * math.log(10.0))
    finite = (p > 1) & (alpha < beta)
    sizes = beta / F.when(finite, beta - alpha)
    return k * sizes * F.pow(c, F.lit(1.0) - p) / F.when(finite, p - 1)


def gamma_tail(shape: float, x: Column) -> Column:
    """Upper tail of the gamma law of `shape` > 0 beyond x (1 for x <= 0, NULL for NULL): the regularised incomplete gamma function.

    Up to shape + 1 by the power series of the lower tail, beyond by the continued fraction of the upper one. Both are evaluated from
    the far end inwards, so that a fixed number of terms, which grows with the root of the shape, leaves out less than a double resolves.
    """
    terms = 60 + math.ceil(12 * math.sqrt(shape))
    x, steps = x.cast("double"), F.sequence(F.lit(terms), F.lit(1), F.lit(-1))
    density = F.exp(F.lit(shape) * F.ln(x) - x - F.lit(math.lgamma(shape)))
    series = F.aggregate(steps, F.lit(1.0), lambda inner, k: F.lit(1.0) + inner * x / (k + F.lit(shape)))
    fraction = F.aggregate(steps, x + F.lit(2 * terms + 1 - shape), lambda inner, k: x + (2 * k - 1) - F.lit(shape) - k * (k - F.lit(shape)) / inner)
    return F.when(x <= 0, F.lit(1.0)).when(x < shape + 1, F.lit(1.0) - density * series / F.lit(shape)).otherwise(density / fraction)


def chi_square_tail(statistic: Column, df: int) -> Column:
    """P-value of a chi-square statistic with `df` degrees of freedom."""
    return gamma_tail(df / 2, statistic / F.lit(2.0))
