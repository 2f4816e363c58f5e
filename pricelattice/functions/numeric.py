"""Numeric functions: units, geometry, agronomy, hash noise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Adaptive grid constants.
TARGET_POINTS, MIN_STEP_DEG, MIN_RADIUS_KM, MAX_RADIUS_KM, KM_PER_DEG = 150, 0.005, 1.0, 5.0, 111.0


def mj_to_kwh(c: Column) -> Column:
    return F.round(c / 3.6, 4)


def hpa_to_kpa(c: Column) -> Column:
    return F.round(c / 10, 4)


def soil_m3_to_mm(c: Column) -> Column:
    return F.round(c * 70, 3)


def array_mean(c: Column, digits: int = 4) -> Column:
    """Mean of the non-null items; null when there is none."""
    items = F.filter(c, lambda x: x.isNotNull())
    total = F.aggregate(items, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(items) > 0, F.round(total / F.size(items), digits))


def first_item(c: Column) -> Column:
    return F.try_element_at(c, F.lit(1))


def ordered_pair(lo: Column, hi: Column, digits: int = 2) -> tuple[Column, Column]:
    return F.round(F.least(lo, hi), digits), F.round(F.greatest(lo, hi), digits)


def valid_prices(lo: Column, hi: Column) -> Column:
    return F.coalesce((lo > 0) & (hi > 0), F.lit(False))


def safe_ratio(num: Column, den: Column) -> Column:
    return F.when(F.coalesce(den, F.lit(0)) == 0, F.lit(0.0)).otherwise(num / den)


def markup(retail: Column, wholesale: Column) -> Column:
    return F.when(wholesale > 0, (retail - wholesale) / wholesale)


def unit_noise(*keys: Column, amplitude: float = 0.05, seed: int = 42) -> Column:
    """1 + u with u uniform in [-amplitude, amplitude): a hash of the keys, the same on every run and engine layout."""
    u = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return 1 + (u * 2 - 1) * amplitude


def final_price(c: Column) -> Column:
    """At least 0.01, two digits; null stays null (greatest() alone would skip it)."""
    return F.when(c.isNotNull(), F.round(F.greatest(c, F.lit(0.01)), 2))


def bbox_area_km2(south: Column, north: Column, west: Column, east: Column) -> Column:
    return (north - south) * KM_PER_DEG * (east - west) * KM_PER_DEG * F.cos(F.radians((north + south) / 2))


def grid_step_km(area: Column) -> Column:
    return F.greatest(F.lit(MIN_STEP_DEG * KM_PER_DEG), F.sqrt(F.greatest(area, F.lit(0.01)) / TARGET_POINTS))


def grid_radius_km(step_km: Column) -> Column:
    return F.round(F.least(F.lit(MAX_RADIUS_KM), F.greatest(F.lit(MIN_RADIUS_KM), step_km)), 2)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def saturation_kpa(t: Column) -> Column:
    """Saturation vapour pressure at a temperature."""
    return 0.6108 * F.exp(17.27 * t / (t + 237.3))


def extraterrestrial_mj(lat_deg: Column, day_of_year: Column) -> Column:
    """Radiation above the air in MJ per square metre and day, from the sun's declination and the length of the day (0 in polar night)."""
    turn = 2 * math.pi / 365 * day_of_year
    lat, tilt = F.radians(lat_deg), 0.409 * F.sin(turn - 1.39)
    sunset = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.tan(lat) * F.tan(tilt))))
    beam = sunset * F.sin(lat) * F.sin(tilt) + F.cos(lat) * F.cos(tilt) * F.sin(sunset)
    return F.greatest(24 * 60 / math.pi * 0.0820 * (1 + 0.033 * F.cos(turn)) * beam, F.lit(0.0))


def net_longwave_mj(tmax: Column, tmin: Column, ea: Column, short: Column, clear_sky: Column) -> Column:
    """Net outgoing long-wave radiation. Cloudiness is the short-wave radiation's part of that under a clear sky, at most 1 (1 too where
    there is none, in polar night)."""
    part = F.when(clear_sky > 0, F.least(short / clear_sky, F.lit(1.0))).otherwise(1.0)
    heat = 4.903e-9 * (F.pow(tmax + 273.16, 4) + F.pow(tmin + 273.16, 4)) / 2
    return heat * (0.34 - 0.14 * F.sqrt(ea)) * (1.35 * part - 0.35)


def net_radiation_mj(tmax: Column, tmin: Column, ea: Column, short: Column, lat_deg: Column, day_of_year: Column, elevation_m: float = 0.0) -> Column:
    """Short wave less 23 percent reflected, less net long wave."""
    clear_sky = (0.75 + 2e-5 * elevation_m) * extraterrestrial_mj(lat_deg, day_of_year)
    return 0.77 * short - net_longwave_mj(tmax, tmin, ea, short, clear_sky)


def wind_at_2m(wind10: Column) -> Column:
    """Wind at 2 m from wind at 10 m by the logarithmic profile."""
    return wind10 * 4.87 / math.log(67.8 * 10 - 5.42)


def penman_monteith(tmax: Column, tmin: Column, tmean: Column, ea: Column, wind2: Column, net: Column, ps_kpa: Column) -> Column:
    """Reference evapotranspiration in mm per day by the FAO-56 equation, without ground heat flux; not below 0."""
    es = (saturation_kpa(tmax) + saturation_kpa(tmin)) / 2
    slope = 4098 * saturation_kpa(tmean) / F.pow(tmean + 237.3, 2)
    gamma = 0.000665 * ps_kpa
    return F.greatest((0.408 * slope * net + gamma * 900 / (tmean + 273) * wind2 * (es - ea)) / (slope + gamma * (1 + 0.34 * wind2)), F.lit(0.0))


def fao56_et0(tmax: Column, tmin: Column, tmean: Column, rh: Column, wind10: Column, rad_kwh: Column, ps_kpa: Column, lat_deg: Column, day_of_year: Column, elevation_m: float = 0.0) -> Column:
    """penman_monteith() from a weather row: mean humidity in percent, wind at 10 m, radiation in kWh, place and day. Null where an input
    is (greatest() alone would skip it)."""
    ea = rh / 100 * (saturation_kpa(tmax) + saturation_kpa(tmin)) / 2
    net = net_radiation_mj(tmax, tmin, ea, rad_kwh * 3.6, lat_deg, day_of_year, elevation_m)
    known = tmax.isNotNull() & tmin.isNotNull() & tmean.isNotNull() & rh.isNotNull() & wind10.isNotNull() & rad_kwh.isNotNull() & ps_kpa.isNotNull() & lat_deg.isNotNull() & day_of_year.isNotNull()
    return F.when(known, penman_monteith(tmax, tmin, tmean, ea, wind_at_2m(wind10), net, ps_kpa))
