"""Thermodynamic, angular and calendar expressions on columns; NULL in gives NULL out, NaN is taken as NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veranico.session import null_if_nan

# Constants of the saturation vapour pressure formulas, (factor, a, b) in the unit named.
SATURATION = {
    "magnus_hpa": (6.112, 17.62, 243.12),
    "bolton_hpa": (6.112, 17.67, 243.5),
    "bolton_kpa": (0.6112, 17.67, 243.5),
    "tetens_kpa": (0.6108, 17.27, 237.3),
}


def _c(c: Column | str) -> Column:
    return null_if_nan(c)


def saturation_pressure(t_c: Column | str, variant: str = "bolton_hpa") -> Column:
    """Saturation vapour pressure at a temperature in degrees Celsius."""
    factor, a, b = SATURATION[variant]
    t = _c(t_c)
    return factor * F.exp(a * t / (t + b))


def _bounded(rh: Column, out_of_range: str) -> Column:
    if out_of_range == "clip":
        return F.when(rh < 0, 0.0).when(rh > 100, 100.0).otherwise(rh)
    return F.when(rh.between(0, 100), rh)


def relative_humidity(t_c: Column | str, td_c: Column | str, variant: str = "bolton_hpa", out_of_range: str = "null") -> Column:
    """Relative humidity in percent from temperature and dew point; out of 0..100 becomes NULL or is clipped."""
    return _bounded(saturation_pressure(td_c, variant) / saturation_pressure(t_c, variant) * 100, out_of_range)


def vpd_from_dewpoint(t_c: Column | str, td_c: Column | str, variant: str = "bolton_hpa") -> Column:
    """Vapour pressure deficit, not below 0."""
    d = saturation_pressure(t_c, variant) - saturation_pressure(td_c, variant)
    return F.when(d < 0, 0.0).otherwise(d)


def vpd_from_humidity(t_c: Column | str, rh: Column | str, variant: str = "tetens_kpa") -> Column:
    """Vapour pressure deficit from relative humidity, which is clipped to 0..100."""
    return saturation_pressure(t_c, variant) * (1 - _bounded(_c(rh), "clip") / 100)


def dewpoint_from_pressure(ea: Column, variant: str = "tetens_kpa") -> Column:
    """Dew point of a vapour pressure above 0."""
    factor, a, b = SATURATION[variant]
    g = F.log(F.when(ea > 0, ea) / factor)
    return b * g / (a - g)


def dewpoint_from_humidity(t_c: Column | str, rh: Column | str, variant: str = "tetens_kpa") -> Column:
    """Dew point from temperature and relative humidity above 0."""
    return dewpoint_from_pressure(saturation_pressure(t_c, variant) * _bounded(_c(rh), "clip") / 100, variant)


def wetbulb_stull(t_c: Column | str, rh: Column | str, out_of_range: str = "null") -> Column:
    """Wet-bulb temperature by Stull (2011), for humidities of 1..100 percent."""
    t, h = _c(t_c), _c(rh)
    h = F.when(h < 1, 1.0).when(h > 100, 100.0).otherwise(h) if out_of_range == "clip" else F.when(h.between(1, 100), h)
    return t * F.atan(0.151977 * F.sqrt(h + 8.313659)) + F.atan(t + h) - F.atan(h - 1.676331) + 0.00391838 * F.pow(h, F.lit(1.5)) * F.atan(0.023101 * h) - 4.686035


def wind_speed(u: Column | str, v: Column | str) -> Column:
    return F.sqrt(_c(u) * _c(u) + _c(v) * _c(v))


def positive_z(value: Column | str, mean: Column | str, std: Column | str, clip: float = 5.0, reverse: bool = False) -> Column:
    """Positive part of the clipped z-score; 0 where below the mean, NULL where the scatter is at most 1e-6."""
    s = _c(std)
    z = (_c(mean) - _c(value)) / s if reverse else (_c(value) - _c(mean)) / s
    return F.when(s > 1e-6, F.when(z < 0, 0.0).when(z > clip, clip).otherwise(z))


def composite_severity(*parts: tuple[Column, float]) -> Column:
    """Weighted sum of severities, NULL if one is."""
    total = F.lit(0.0)
    for column, weight in parts:
        total = total + column * weight
    return total


def safe_div(num: Column | str, den: Column | str) -> Column:
    """NULL unless the denominator is above 0."""
    d = _c(den)
    return F.when(d > 0, _c(num) / d)


def noleap_doy(day: Column | str) -> Column:
    """Day of year 1..365 without 29 February, which gives NULL."""
    d = F.col(day) if isinstance(day, str) else day
    y = F.year(d)
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(~((F.month(d) == 2) & (F.dayofmonth(d) == 29)), F.dayofyear(d) - F.when(leap & (F.month(d) > 2), 1).otherwise(0))


def noleap_index(day: Column | str) -> Column:
    """A day number in which 28 February and 1 March are neighbours in every year."""
    d = F.col(day) if isinstance(day, str) else day
    return F.year(d) * 365 + noleap_doy(d)


def wrap_longitude(lon: Column | str) -> Column:
    """Longitude in -180..180."""
    return F.pmod(_c(lon) + 180, F.lit(360.0)) - 180


def cosine_weight(lat: Column | str) -> Column:
    return F.cos(F.radians(_c(lat)))


def cell_area_km2(lat: Column | str, dlat: float = 0.25, dlon: float = 0.25, radius_km: float = 6371.0) -> Column:
    """Area of a cell of a regular grid on a sphere."""
    y = _c(lat)
    return F.abs(F.sin(F.radians(y + dlat / 2)) - F.sin(F.radians(y - dlat / 2))) * (radius_km * radius_km * dlon * 0.017453292519943295)


def normal_tail(z: Column) -> Column:
    """Two-sided normal p-value, by the polynomial 7.1.26 of Abramowitz and Stegun (error below 1.5e-7)."""
    x = F.abs(z) / 1.4142135623730951
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)
