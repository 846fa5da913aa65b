"""Rasters as pixel tables: one row per pixel, joined by integer keys."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upland.functions.geo import CITY_LAT, M_PER_DEG_LAT, M_PER_DEG_LNG, col, pixel_xy


def terrarium_m(r="r", g="g", b="b") -> Column:
    """Metres of a height pixel held in three bytes."""
    return col(r) * 256.0 + col(g) + col(b) / 256.0 - 32768.0


def read_heights(pixels: DataFrame) -> DataFrame:
    """Pixel table (z, x, y, px, py, r, g, b) to z, gx, gy (position in the whole zoom level) and height."""
    return pixels.select("z", (F.col("x") * 256 + F.col("px")).cast("long").alias("gx"),
                         (F.col("y") * 256 + F.col("py")).cast("long").alias("gy"), terrarium_m().alias("height"))


SIDE = 64                      # pixels along a block
CROWD = 1_000_000              # points that one copy of a block answers, about


def sample_bilinear(points: DataFrame, heights: DataFrame, key: list[str], z: int = 14, out: str = "ground") -> DataFrame:
    """Ground height of each point (lng, lat) from its four surrounding pixels: `key` and `out`; a point without all four
    has no row.

    Pixels are dealt to blocks of SIDE by SIDE with one row and column of overlap, so a point meets one block and is
    shuffled once. A block's pixels come before its points, which stream past them; a block with very many points is held
    in several copies."""
    u, v = pixel_xy("lng", "lat", z)
    block = lambda c: F.floor(c / SIDE).cast("long")
    at = points.select(*key, u.alias("_u"), v.alias("_v")).withColumn("_bx", block(F.floor("_u"))).withColumn("_by", block(F.floor("_v")))
    copies = at.groupBy("_bx", "_by").agg(F.ceil(F.count("*") / CROWD).alias("_copies"))
    gx, gy = F.col("gx"), F.col("gy")
    edge = lambda c: F.pmod(c, F.lit(SIDE)) == 0
    home = lambda x, y: F.struct(x.alias("_bx"), y.alias("_by"))
    bx, by = block(gx), block(gy)
    homes = F.filter(F.array(home(bx, by), F.when(edge(gx), home(bx - 1, by)), F.when(edge(gy), home(bx, by - 1)), F.when(edge(gx) & edge(gy), home(bx - 1, by - 1))), lambda h: h.isNotNull())
    pixels = heights.where((F.col("z") == z) & F.col("height").isNotNull()).select("gx", "gy", "height", F.explode(homes).alias("_h")).select("gx", "gy", "height", "_h.*")
    pixels = pixels.join(copies, ["_bx", "_by"]).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    asked = at.join(copies.where("_copies > 1"), ["_bx", "_by"], "left").withColumn("_copy", F.pmod(F.xxhash64(*key), F.coalesce("_copies", F.lit(1))))
    where = ["_bx", "_by", "_copy"]
    rows = pixels.select(*where, F.lit(0).alias("_row"), gx.cast("double").alias("_u"), gy.cast("double").alias("_v"), F.col("height").cast("double").alias("_z")).unionByName(
        asked.select(*where, F.lit(1).alias("_row"), "_u", "_v", *key), allowMissingColumns=True)
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, *where).sortWithinPartitions(*where, "_row").select(*where, "_row", "_u", "_v", "_z", *key)
    schema = T.StructType([*points.select(*key).schema.fields, T.StructField(out, T.DoubleType())])
    return rows.mapInArrow(lambda batches: _sampled(batches, key, out), schema)


def _sampled(batches: Iterator[pa.RecordBatch], key: list[str], out: str) -> Iterator[pa.RecordBatch]:
    """Heights of the points of each block, its pixels first."""
    now, grid = None, None
    for batch in batches:
        bx, by, copy, role, u, v = (batch.column(i).to_numpy() for i in range(6))
        cuts = (np.flatnonzero(np.any([np.diff(c) != 0 for c in (bx, by, copy, role)], axis=0)) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, len(bx)]):
            if lo == hi:
                continue
            if (bx[lo], by[lo], copy[lo]) != now:
                now, grid = (bx[lo], by[lo], copy[lo]), np.full((SIDE + 1, SIDE + 1), np.nan)
            x, y = u[lo:hi] - bx[lo] * SIDE, v[lo:hi] - by[lo] * SIDE
            i, j = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
            if role[lo] == 0:
                grid[i, j] = batch.column(6).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                continue
            fx, fy = x - i, y - j
            ground = (1 - fx) * (1 - fy) * grid[i, j] + fx * (1 - fy) * grid[i + 1, j] + (1 - fx) * fy * grid[i, j + 1] + fx * fy * grid[i + 1, j + 1]
            has = pa.array(~np.isnan(ground))
            columns = [batch.column(7 + k).slice(lo, hi - lo) for k in range(len(key))]
            yield pa.RecordBatch.from_arrays([c.filter(has) for c in [*columns, pa.array(ground)]], names=[*key, out])


def sample_nearest(points: DataFrame, heights: DataFrame, z: int = 15, out: str = "ground") -> DataFrame:
    """Whole metres of the pixel a point falls in; points outside the raster keep null."""
    u, v = pixel_xy("lng", "lat", z)
    asked = points.select("*", F.floor(u).cast("long").alias("gx"), F.floor(v).cast("long").alias("gy"))
    h = heights.where(F.col("z") == z).select("gx", "gy", F.bround("height").cast("long").alias(out))
    return asked.join(h, ["gx", "gy"], "left").drop("gx", "gy")


def block_average(heights: DataFrame, step: int) -> DataFrame:
    """Mean of step x step pixel blocks, at block positions."""
    return heights.groupBy("z", F.floor(F.col("gx") / step).cast("long").alias("bx"), F.floor(F.col("gy") / step).cast("long").alias("by")).agg(
        F.avg("height").alias("height"))


def slope_deg(east_hi, east_lo, north_hi, north_lo, half_deg: float = 2e-5) -> Column:
    """Ground slope from four samples half_deg east, west, north and south of a place."""
    dx = (col(east_hi) - col(east_lo)) / F.lit(2 * half_deg * M_PER_DEG_LNG * math.cos(math.radians(CITY_LAT)))
    dy = (col(north_hi) - col(north_lo)) / F.lit(2 * half_deg * M_PER_DEG_LAT)
    return F.degrees(F.atan(F.hypot(dx, dy)))


def slopes(points: DataFrame, heights: DataFrame, key: list[str], z: int = 14, half_deg: float = 2e-5) -> DataFrame:
    """key + slope_deg: the four samples are one bilinear pass over shifted copies of the points."""
    shifts = [("eh", half_deg, 0.0), ("el", -half_deg, 0.0), ("nh", 0.0, half_deg), ("nl", 0.0, -half_deg)]
    moved = points.select(*key, F.explode(F.array(*[F.struct(F.lit(n).alias("_s"), (F.col("lng") + dx).alias("lng"), (F.col("lat") + dy).alias("lat"))
                                                     for n, dx, dy in shifts])).alias("_m")).select(*key, "_m.*")
    h = sample_bilinear(moved, heights, [*key, "_s"], z)
    wide = h.groupBy(*key).agg(*[F.max(F.when(F.col("_s") == n, F.col("ground"))).alias(n) for n, *_ in shifts])
    return wide.select(*key, slope_deg("eh", "el", "nh", "nl", half_deg).alias("slope_deg"))


def grid_centre(header_west: float, header_north: float, dx: float, dy: float, row="row", column="col") -> tuple[Column, Column]:
    """lng, lat of a grid cell's centre."""
    return F.lit(header_west) + (col(column) + 0.5) * F.lit(dx), F.lit(header_north) - (col(row) + 0.5) * F.lit(dy)
