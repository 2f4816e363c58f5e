"""Places: coordinates and bounding boxes from answers of geocoders, grids ordered from a centre."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: a box with a shorter side is a village point, not the border of a district.
LEAST_SIDE_DEG = 0.02


def choose_place(requests: DataFrame, known: DataFrame, suggestions: DataFrame) -> DataFrame:
    """requests (city, district, ...) with lat, lon and place_source.

    A known place (city, district, lat, lon; one row each) wins. Else the first suggestion (city, district as asked; rank, found_city,
    found_district, lat, lon) of equal names in any case; else the first of all; else nulls. Suggestions combine before their shuffle.
    """
    keys = ["city", "district"]
    equal = (F.lower("found_district") == F.lower("district")) & (F.lower("found_city") == F.lower("city"))
    order = F.struct(F.when(equal, 0).otherwise(1).alias("pass"), F.col("rank"))
    best = suggestions.groupBy(*keys).agg(F.min_by(F.struct("lat", "lon"), order).alias("_s"))
    own = known.select(*keys, F.struct("lat", "lon").alias("_k"))
    j = requests.join(own, keys, "left").join(best, keys, "left")
    source = F.when(F.col("_k").isNotNull(), "known").when(F.col("_s").isNotNull(), "suggested")
    at = F.coalesce("_k", "_s")
    return j.withColumns({"lat": at["lat"], "lon": at["lon"], "place_source": source}).drop("_k", "_s")


def choose_bbox(requests: DataFrame, results: DataFrame, least_side: float = LEAST_SIDE_DEG) -> DataFrame:
    """requests (city, district, ...) with bbox [south, north, west, east], null where no result has a box of two sides that long.

    results (city, district as asked; rank, class, type, display_name, boundingbox array of text): administrative borders whose name begins
    with the district come first, then other administrative borders, then the rest, each in order of rank. A box that is no four numbers
    is none.
    """
    keys = ["city", "district"]
    box = F.transform(F.slice("boundingbox", 1, 4), lambda x: x.try_cast("double"))
    fine = (F.size(box) == 4) & (box[1] - box[0] >= least_side) & (box[3] - box[2] >= least_side)
    border = (F.col("class") == "boundary") & (F.col("type") == "administrative")
    named = F.lower("display_name").startswith(F.lower("district"))
    which = F.when(border & named, 1).when(border, 2).otherwise(3)
    best = results.filter(fine).groupBy(*keys).agg(F.min_by(box, F.struct(which.alias("pass"), F.col("rank"))).alias("bbox"))
    return requests.join(best, keys, "left")


def from_centre(points: DataFrame, keys: list[str], lat0: str, lon0: str) -> DataFrame:
    """visit: the place of each point (lat, lon) of its keys by distance from (lat0, lon0); ties go south to north, then west to east."""
    dy, dx = F.col("lat") - F.col(lat0), F.col("lon") - F.col(lon0)
    return points.withColumn("visit", F.row_number().over(Window.partitionBy(*keys).orderBy(dy * dy + dx * dx, "lat", "lon")))
