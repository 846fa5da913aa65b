"""Elevation refresh of places and projection of height posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upland.functions.geo import CITY_CENTRE, tm_forward
from upland.operators.raster import sample_nearest


def refresh_elevations(places: DataFrame, heights: DataFrame, key: str = "slug", z: int = 15) -> DataFrame:
    """Each place with its old and new height and whether it changes; a place off the raster keeps its old one."""
    s = sample_nearest(places, heights, z, "_ground")
    new = F.coalesce(F.col("_ground").cast("double"), F.col("elevation"))
    return s.select(key, F.col("elevation").alias("old"), new.alias("new"), (~F.col("elevation").eqNullSafe(new)).alias("changed"))


def project_posts(posts: DataFrame, lng: str = "lng", lat: str = "lat", centre=CITY_CENTRE) -> DataFrame:
    """Height posts (or anchors, or view points) with their place e, n in the local metric frame."""
    e, n = tm_forward(lng, lat, centre)
    return posts.select("*", e.alias("e"), n.alias("n"))
