"""Scalar expressions: clocks, money, geometry, calendar features, probabilities, text masks and keys."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: mean radius of the earth in kilometres.
EARTH_RADIUS_KM = 6371.0088
#: Fixed value: seconds by which the display clock runs ahead of the causal clock.
DISPLAY_OFFSET_SECONDS = 220_924_800
DAYS_PER_YEAR = 365.2425


def event_seconds(value: Column) -> Column:
    """Whole seconds of a numeric or text clock; null where it is not a finite whole number in the 64-bit range."""
    number = value.try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) >= F.lit(2.0**63)) | (F.floor(number) != number), None).otherwise(value.try_cast("decimal(20,0)").try_cast("bigint"))


def timestamp_seconds(value: Column) -> Column:
    """Seconds since the epoch of a timestamp without zone, read as UTC, whatever the session's zone is."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.date_trunc("SECOND", value).cast("timestamp_ntz"))


def cents(amount: Column) -> Column:
    """Money as whole cents, ties to even; null for null and non-finite amounts."""
    return F.when(F.isnan(amount) | (F.abs(amount) == float("inf")), None).otherwise(F.rint(amount * 100).cast("bigint"))


def cents_valid(amount: Column) -> Column:
    """Whether an amount is finite and has at most two decimals (within 1e-9)."""
    c = cents(amount)
    return F.coalesce(c.isNotNull() & (F.abs(amount - c / F.lit(100.0)) <= 1e-9), F.lit(False))


def coordinates_valid(lat: Column, lon: Column) -> Column:
    inside = lambda x, most: ~F.isnan(x) & (F.abs(x) <= most)
    return F.coalesce(inside(lat, 90) & inside(lon, 180), F.lit(False))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; the difference in longitude is wrapped, so that crossing the antimeridian is short."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    d_lat = a2 - a1
    d_lon = F.pmod(F.radians(lon2) - F.radians(lon1) + math.pi, F.lit(2 * math.pi)) - math.pi
    a = F.pow(F.sin(d_lat / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(d_lon / 2), 2)
    a = F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def cyclical(value: Column, period: int) -> tuple[Column, Column]:
    angle = value * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def age_years(at: Column, birth: Column) -> Column:
    """Whole days between two dates in mean years."""
    return F.datediff(at, birth) / F.lit(DAYS_PER_YEAR)


def causal_seconds(display: Column) -> Column:
    """The causal clock of a display time."""
    return timestamp_seconds(display) - DISPLAY_OFFSET_SECONDS


def clip(value: Column, low: float | Column, high: float | Column) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.least(F.greatest(value, as_column(low)), as_column(high))


def logit(p: Column, eps: float = 1e-7) -> Column:
    p = clip(p, eps, 1 - eps)
    return F.ln(p / (1 - p))


def sigmoid(z: Column, most: float = 40.0) -> Column:
    return 1 / (1 + F.exp(-clip(z, -most, most)))


def safe_ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def mask_tail(text: Column, shown: int = 4) -> Column:
    """Bullets and the last characters; bullets alone where the text is not longer than these."""
    dots = "•" * 4
    return F.when(F.length(text) > shown, F.concat(F.lit(dots), F.right(text, F.lit(shown)))).otherwise(F.lit(dots))


def plain(value: Column) -> Column:
    """NaN as null."""
    return F.when(F.isnan(value), None).otherwise(value)


def row_key(columns: list[str], position: Column) -> Column:
    """SHA-256 of the JSON of all fields in the order of their names, and the row's position."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)], position.alias("position")), {"ignoreNullFields": "false"}).cast("binary"), 256)


def drift_status(psi: Column, warning: float = 0.10, critical: float = 0.25) -> Column:
    return F.when(psi >= critical, "critical").when(psi >= warning, "warning").otherwise("stable")
