"""Numeric, time and position expressions. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
DAY_US = 86_400e6


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clamp(x, lo: float = 0.0, hi: float = 1.0) -> Column:
    """x held within [lo, hi]; null stays null."""
    return F.when(_c(x).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), _c(x))))


def half_life_decay(age_days, half_life: float = 180.0) -> Column:
    return F.when(_c(age_days) <= 0, F.lit(1.0)).otherwise(F.pow(F.lit(0.5), _c(age_days) / half_life))


def age_days(ts, now, missing: float = 365.0) -> Column:
    """Days from ts to now with fractions, at least 0; `missing` for a null ts."""
    days = (F.unix_micros(_c(now)) - F.unix_micros(_c(ts))) / F.lit(DAY_US)
    return F.when(_c(ts).isNull(), F.lit(missing)).otherwise(F.greatest(F.lit(0.0), days))  # greatest() would skip the null


def shrink(observed, weight, prior, strength: float = 6.0) -> Column:
    """Bayesian average of an observed mean and a prior."""
    return F.when(_c(weight) > 0, (_c(observed) * _c(weight) + _c(prior) * strength) / (_c(weight) + strength)).otherwise(_c(prior))


def log_saturation(x, full: float) -> Column:
    """ln(1 + x) relative to ln(1 + full), within [0, 1]."""
    return clamp(F.log1p(_c(x).cast("double")) / F.log1p(F.lit(float(full))))


def haversine_m(lat1, lng1, lat2, lng2) -> Column:
    a, b, c, d = map(_c, (lat1, lng1, lat2, lng2))
    h = F.pow(F.sin(F.radians(c - a) / 2), 2) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * F.pow(F.sin(F.radians(d - b) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def truthy(x) -> Column:
    """Null where the value is 0 or NaN."""
    return F.nullif(F.nanvl(_c(x).cast("double"), F.lit(0.0)), F.lit(0.0))
