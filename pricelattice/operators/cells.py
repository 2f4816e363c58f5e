"""Hierarchical cells of the sphere, in which neighbours exist at every latitude and across the date line.

A level cuts the latitudes into 2^level bands of equal height. Each band is cut along the longitudes into a power of two of cells that are
at least as wide as a band is high on the band's pole side; the bands at the poles are one cell. A cell's number holds its level, band and
place; the cells of the next finer level lie whole in it. cover() gives the cells that a circle touches, so a search within a radius is an
equi-join of points by their cell and sites by their cover.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pricelattice.functions.numeric import haversine_km

KM_PER_DEG, MAX_LEVEL = math.pi / 180 * 6371.0088, 24


def level_for(radius_km: float) -> int:
    """The finest level whose bands are at least as high as the radius."""
    return max(0, min(MAX_LEVEL, math.floor(math.log2(180 / max(radius_km / KM_PER_DEG * (1 + 1e-6), 1e-9)))))


def finest_level(radius_km: Column, least: int, most: int) -> Column:
    """level_for() of each row's radius, between two levels."""
    degrees = F.greatest(radius_km / KM_PER_DEG * (1 + 1e-6), F.lit(1e-9))
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.log2(180 / degrees)).cast("int")))


def _bands(level: int | Column) -> float | Column:
    """The number of a level's bands."""
    return F.pow(F.lit(2.0), level) if isinstance(level, Column) else 2.0**level


def _bits(band: Column, level: int | Column) -> Column:
    """A band has 2^bits cells."""
    high = 180 / _bands(level)
    edge = F.greatest(F.abs(band * high - 90), F.abs((band + 1) * high - 90))
    return F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.cos(F.radians(edge)), F.lit(1e-12)) * 360 / high))).cast("int")


def _band(lat: Column, level: int | Column) -> Column:
    top = _bands(level) - 1 if isinstance(level, Column) else F.lit(2**level - 1)
    return F.greatest(F.lit(0), F.least(top, F.floor((lat + 90) * (_bands(level) / 180)))).cast("bigint")


def _cell(band: Column, place: Column, level: int | Column) -> Column:
    top = F.shiftleft(level.cast("bigint"), 58) if isinstance(level, Column) else F.lit(level << 58)
    return top + F.shiftleft(band, 29) + place


def _turn(lon: Column) -> Column:
    """Degrees from the date line eastwards, from 0 to below 360."""
    return F.pmod(lon + 180, F.lit(360.0))


def placed(lat: Column, lon: Column) -> Column:
    """Whether a point has a place on the sphere."""
    return F.coalesce(lat.between(-90, 90) & lon.isNotNull() & ~F.isnan(lon), F.lit(False))


def cell(lat: Column, lon: Column, level: int | Column) -> Column:
    """Number of the cell of a point; null where it has no place."""
    band = _band(lat, level)
    n = F.pow(F.lit(2.0), _bits(band, level))
    place = F.least(F.floor(_turn(lon) / 360 * n), n - 1).cast("bigint")
    return F.when(placed(lat, lon), _cell(band, place, level))


def parent(number: Column, level: int) -> Column:
    """The cell of the next coarser level that holds a cell of `level`."""
    band, place = F.shiftright(number, 29).bitwiseAND(F.lit((1 << 29) - 1)), number.bitwiseAND(F.lit((1 << 29) - 1))
    above = F.floor(band / 2).cast("bigint")
    fewer = _bits(band, level) - _bits(above, level - 1)
    return _cell(above, F.floor(place / F.pow(F.lit(2.0), fewer)).cast("bigint"), level - 1)


def cover(lat: Column, lon: Column, radius_km: float | Column, level: int | Column) -> Column:
    """Array of the cells of a level that the circle around a point touches (more cells at the edge may be in it)."""
    if isinstance(radius_km, Column):
        r = F.least(F.lit(180.0), radius_km / KM_PER_DEG * (1 + 1e-9) + 1e-9)
        sine = F.sin(F.radians(F.least(r, F.lit(90.0))))
    else:
        r = min(180.0, radius_km / KM_PER_DEG * (1 + 1e-9) + 1e-9)
        sine = math.sin(math.radians(min(r, 90.0)))
    polar = (lat + r >= 90) | (lat - r <= -90)
    wide = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), sine / F.cos(F.radians(lat))))) + 1e-9)

    def row(band: Column) -> Column:
        n = F.pow(F.lit(2.0), _bits(band, level)).cast("bigint")
        west, east = F.floor((_turn(lon) - wide) / 360 * n), F.floor((_turn(lon) + wide) / 360 * n)
        every = polar | (east - west + 1 >= n)
        places = F.sequence(F.when(every, F.lit(0)).otherwise(west).cast("bigint"), F.when(every, n - 1).otherwise(east).cast("bigint"))
        return F.transform(places, lambda p: _cell(band, F.pmod(p, n), level))

    return F.when(placed(lat, lon), F.flatten(F.transform(F.sequence(_band(lat - r, level), _band(lat + r, level)), row)))


def sites_within(points: DataFrame, sites: DataFrame, radius_km: float, site_id: str) -> DataFrame:
    """Every point (columns of `points`, which has lat and lon) beside every site within the radius: site_id, distance_km."""
    level = level_for(radius_km)
    p = points.withColumn("_cell", cell(F.col("lat"), F.col("lon"), level))
    s = sites.select(F.col(site_id), F.col("lat").alias("_slat"), F.col("lon").alias("_slon"), F.explode(cover(F.col("lat"), F.col("lon"), radius_km, level)).alias("_cell"))
    d = haversine_km(F.col("lat"), F.col("lon"), F.col("_slat"), F.col("_slon"))
    return p.join(s, "_cell").withColumn("distance_km", d).filter(F.col("distance_km") <= radius_km).drop("_cell", "_slat", "_slon")


#: Levels below that of the radius at which the nearest site's distance is bounded, and the steps in which counts go down.
FINER, DOWN, BROADCAST_LEVEL = 10, (2, 4, 6), 10


@F.arrow_udf(DoubleType())
def settled_km(lat1: pa.Array, lon1: pa.Array, lat2: pa.Array, lon2: pa.Array) -> pa.Array:
    """haversine_km() by the system's own sine, cosine and arc sine, which SQL engines use: the JVM's differ in the last digit, which
    tells apart, or makes equal, what is equally far."""
    out = []
    for p, q, s, t in zip(lat1.to_pylist(), lon1.to_pylist(), lat2.to_pylist(), lon2.to_pylist(), strict=True):
        a = math.sin(math.radians(s - p) / 2) ** 2 + math.cos(math.radians(p)) * math.cos(math.radians(s)) * math.sin(math.radians(t - q) / 2) ** 2
        out.append(2 * 6371.0088 * math.asin(math.sqrt(min(1.0, a))))
    return pa.array(out, pa.float64())


def nearest_within(points: DataFrame, sites: DataFrame, radius_km: float, site_id: str) -> DataFrame:
    """lat, lon, site_id, distance_km: the nearest site within the radius of each different place of points; of equally near ones the
    least id.

    A place's own cells, from the radius's level down, hold sites or not. The distance to one site of each bounds that to the nearest, so a
    place asks only the cells that a circle of this bound touches, at the level of its size: few sites, however dense they are.
    """
    coarse = level_for(radius_km)
    fine = min(MAX_LEVEL, coarse + FINER)
    own = F.explode(F.transform(F.sequence(F.lit(coarse), F.lit(fine)), lambda v: cell(F.col("lat"), F.col("lon"), v))).alias("_cell")
    ok = placed(F.col("lat"), F.col("lon"))
    p = points.filter(ok).select("lat", "lon").distinct()
    s = sites.filter(ok).groupBy("lat", "lon").agg(F.min(site_id).alias("_id")).select(F.struct("_id", F.col("lat").alias("_slat"), F.col("lon").alias("_slon")).alias("_s"), own)
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("_s._slat"), F.col("_s._slon"))
    one = s.groupBy("_cell").agg(F.min("_s").alias("_s"))
    bound = p.select("lat", "lon", own).join(one, "_cell", "left").groupBy("lat", "lon").agg(F.min(km).alias("_bound"))
    bound = bound.select("lat", "lon", (F.least(F.coalesce("_bound", F.lit(radius_km)), F.lit(radius_km)) * (1 + 1e-9) + 1e-6).alias("_reach"))
    bound = bound.withColumn("_level", finest_level(F.col("_reach"), coarse, fine))
    asked = bound.select("lat", "lon", "_reach", F.explode(cover(F.col("lat"), F.col("lon"), F.col("_reach"), F.col("_level"))).alias("_cell"))
    met = asked.join(s, "_cell").withColumn("_km", km).filter(F.col("_km") <= F.col("_reach"))
    # What is equally far but for rounding is settled by the system's arithmetic.
    least = F.min("_km").over(Window.partitionBy("lat", "lon"))
    last = met.withColumn("_least", least).filter(F.col("_km") <= F.col("_least") * (1 + 1e-9) + 1e-6)
    last = last.withColumn("_exact", settled_km("lat", "lon", F.col("_s._slat"), F.col("_s._slon"))).filter(F.col("_exact") <= radius_km)
    return last.groupBy("lat", "lon").agg(F.min(F.struct("_exact", "_s._id")).alias("_m")).select("lat", "lon", F.col("_m._id").alias(site_id), F.col("_m._exact").alias("distance_km"))


def counts_within(points: DataFrame, sites: DataFrame, radius_km: float, site_id: str, name: str) -> DataFrame:
    """site_id and the number of points within the radius of each site that has any.

    Cells that lie whole in a site's circle give their number of points; only those that its edge may cut are looked into, by finer cells,
    and the points of the finest cells on the edge one by one. Points of one place are counted once.
    """
    ok = placed(F.col("lat"), F.col("lon"))
    top = level_for(radius_km)
    levels = sorted({min(MAX_LEVEL, top + d) for d in DOWN})
    places = points.filter(ok).groupBy("lat", "lon").agg(F.count("*").alias("_n"))
    # Sites are few bytes and their pairs many: deal them, or one task would hold a small file's.
    tasks = 8 * sites.sparkSession.sparkContext.defaultParallelism
    s = sites.filter(ok).groupBy(site_id, "lat", "lon").agg(F.count("*").alias("_times")).repartition(tasks, site_id, "lat", "lon").select(site_id, "_times", F.col("lat").alias("_slat"), F.col("lon").alias("_slon"))
    at = s.withColumn("_up", F.explode(cover(F.col("_slat"), F.col("_slon"), radius_km, levels[0])))
    whole, before = [], levels[0]
    for level in levels:
        own, above = cell(F.col("lat"), F.col("lon"), level).alias("_cell"), cell(F.col("lat"), F.col("lon"), before).alias("_up")
        edges = [f(c).alias(f"_{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))]
        held = places.groupBy(own, above).agg(F.sum("_n").alias("_n"), *edges)
        held = held.withColumns({"_clat": (F.col("_min_lat") + F.col("_max_lat")) / 2, "_clon": (F.col("_min_lon") + F.col("_max_lon")) / 2})
        # A circle around the cell's points: the farthest corner, where they lie within a quarter turn of its middle; else it is looked into.
        corner = lambda edge: haversine_km(F.col("_clat"), F.col("_clon"), F.col(edge), F.col("_max_lon"))
        small = (F.col("_max_lon") - F.col("_min_lon") <= 90) & (F.col("_max_lat") - F.col("_min_lat") <= 45)
        held = held.withColumn("_crad", F.when(small, F.greatest(corner("_min_lat"), corner("_max_lat")) * (1 + 1e-9) + 1e-6).otherwise(720 * KM_PER_DEG)).drop("_min_lat", "_max_lat", "_min_lon", "_max_lon")
        met = at.join(F.broadcast(held) if level <= BROADCAST_LEVEL else held, "_up")
        met = met.withColumn("_d", haversine_km(F.col("_slat"), F.col("_slon"), F.col("_clat"), F.col("_clon"))).filter(F.col("_d") <= radius_km + F.col("_crad"))
        whole.append(met.filter(F.col("_d") + F.col("_crad") <= radius_km).select(site_id, (F.col("_n") * F.col("_times")).alias(name)))
        at = met.filter(F.col("_d") + F.col("_crad") > radius_km).select(site_id, "_times", "_slat", "_slon", F.col("_cell").alias("_up"))
        before = level
    last = at.join(places.withColumn("_up", cell(F.col("lat"), F.col("lon"), levels[-1])), "_up")
    last = last.filter(haversine_km(F.col("lat"), F.col("lon"), F.col("_slat"), F.col("_slon")) <= radius_km).select(site_id, (F.col("_n") * F.col("_times")).alias(name))
    for w in whole:
        last = last.unionByName(w)
    return last.groupBy(site_id).agg(F.sum(name).alias(name))
