"""Buildings: heights, footing on the ground, roof and wall keys, detail classes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upland.functions.geo import col, tm_forward
from upland.functions.ids import crc_of, hash8, weighted_pick
from upland.operators import lines as L
from upland.operators import rings as G
from upland.operators.quantiles import exact_quantiles
from upland.operators.raster import sample_bilinear
from upland.session import written

# Storey height, the centre's radius, size limits, roof weights, and which kinds count as commercial.
STOREY_M = 3.2
CENTRE_M = 600.0
SMALLEST_M2 = 4.0
FAR_MIN_M2, FAR_BOX_M2 = 60.0, 200.0
NEAR_ROOT, NEAR_CAP, FAR_ROOT, FAR_CAP = 15, 700, 13, 4000
ROOFS = [("rust", 32), ("red", 10), ("blue", 15), ("green", 13), ("teal", 10), ("sheet", 12), ("orange", 8)]
WALLS = 4
COMMERCIAL = ("commercial", "retail", "hotel", "office", "apartments", "hospital", "school", "university",
              "college", "public", "civic", "government", "church", "cathedral", "dormitory")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number_or_null(text) -> Column:
    t = F.trim(col(text))
    return F.when(t.rlike(NUMBER), t.cast("double"))


def height_m(height, levels, building, has_name, area, centre_m, oid) -> Column:
    """Mapped height, else mapped levels, else a rule on kind, place, size, name and the id's hash."""
    area, centre_m = col(area), col(centre_m)
    tagged = number_or_null(F.replace(F.lower(col(height)), F.lit("m"), F.lit("")))
    storeys = number_or_null(levels)
    guess = F.when(F.coalesce(col(building).isin(*COMMERCIAL), F.lit(False)), 3.0).otherwise(2.5)
    guess = guess + F.when(centre_m < CENTRE_M, 1.0).when(centre_m < 1500, 0.5).otherwise(0.0)
    guess = F.when(area > 600, guess + 1.0).when(area < 40, F.least(guess, F.lit(1.5))).otherwise(guess)
    guess = guess + F.when(col(has_name), 0.5).otherwise(0.0) + (crc_of(oid) % 5 - 2) * 0.5
    rounded = F.least(F.lit(10.0), F.greatest(F.lit(1.0), F.bround(guess)))
    mapped = F.when(storeys.isNotNull(), F.greatest(F.lit(1.0), storeys) * STOREY_M)   # greatest skips nulls
    return F.coalesce(tagged, mapped, rounded * STOREY_M)


def storeys_by_size(height, levels, area, oid, lo: float, hi: float) -> Column:
    """The second rule: mapped height, else whole mapped levels, else lo..hi storeys by footprint and a hash."""
    tagged = number_or_null(F.regexp_replace(F.coalesce(col(height), F.lit("")), "m$", ""))
    mapped = F.floor(number_or_null(levels)) * STOREY_M
    k = F.least(F.lit(1.0), F.log10(F.greatest(col(area), F.lit(50.0)) / 50.0) / 1.6)
    guess = F.bround(F.lit(lo) + F.lit(hi - lo) * (F.lit(0.7) * k + F.lit(0.3) * (hash8(oid) % 100) / 100.0))
    return F.coalesce(tagged, mapped, guess * STOREY_M)


def roof_key(top_m, centre_m, oid) -> Column:
    return F.when((col(centre_m) < CENTRE_M) | (col(top_m) >= 4 * STOREY_M), F.lit("flat")).otherwise(weighted_pick(ROOFS, crc_of(oid)))


def wall_key(oid) -> Column:
    return (crc_of(F.concat(col(oid), F.lit("w"))) % WALLS).cast("int")


def rectangle_fill(ring) -> Column:
    """Area of a ring over that of its least rotated rectangle, from the ring's hull."""

    @F.pandas_udf("double")
    def least_rectangle(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xs, ys):
            h = G._hull(np.column_stack([x, y]))
            if len(h) < 3:
                out.append(0.0)
                continue
            d = np.roll(h, -1, 0) - h
            d = d / np.hypot(d[:, 0], d[:, 1])[:, None]
            a, b = h @ d.T, h @ np.column_stack([-d[:, 1], d[:, 0]]).T
            out.append(float((np.ptp(a, 0) * np.ptp(b, 0)).min()))
        return pd.Series(out)

    g = col(ring)
    x0, y0 = g[0]["x"], g[0]["y"]
    rect = least_rectangle(F.transform(g, lambda p: p["x"] - x0), F.transform(g, lambda p: p["y"] - y0))
    return G.area(g) / F.greatest(rect, F.lit(1e-9))


def footing(buildings: DataFrame, heights: DataFrame, key: str, to_lnglat) -> DataFrame:
    """key, low, mean: the ground at a building's corners and about every 8 m of its outline (at least four places).
    All points of the city are sampled in one pass over the height table."""
    b = buildings.select(key, "ring", G.perimeter("ring").alias("_len"))
    b = b.withColumn("_n", F.greatest(F.lit(4), F.floor(F.col("_len") / 8).cast("int")))
    outline = L.points_along(L.segments(b, key, "ring"), F.col("_len") / F.col("_n"), steps="_n").select(key, F.col("step").cast("int").alias("i"), "x", "y")
    corners = b.select(key, F.posexplode("ring").alias("i", "p")).select(key, (-1 - F.col("i")).alias("i"), "p.x", "p.y")
    lng, lat = to_lnglat("x", "y")
    pts = outline.unionByName(corners).select(key, "i", lng.alias("lng"), lat.alias("lat"))
    ground = sample_bilinear(pts, heights, [key, "i"])
    return ground.groupBy(key).agg(F.min("ground").alias("low"), F.avg("ground").alias("mean"))


def prepare(buildings: DataFrame, exclusions: DataFrame, centre: tuple[float, float], key: str = "oid") -> DataFrame:
    """Buildings (planar ring, edges and box) of at least 4 m2 that touch no exclusion ring, with area and distance to the
    city centre from the outline."""
    # what an outline alone decides is worked out once for all buildings of that outline
    one = buildings.groupBy("edges").agg(F.min(key).alias("_same"), *[F.first(c).alias(c) for c in ("ring", *"wsen")])
    one = written(one.select("_same", "edges", *"wsen", G.area("ring").alias("area")).where(F.col("area") >= SMALLEST_M2))
    kept = G.drop_touching(one.select("_same", "edges", "w", "s", "e", "n"), exclusions).select("_same")
    inside = G.contains("edges", F.lit(centre[0]), F.lit(centre[1]))
    away = F.when(inside, F.lit(0.0)).otherwise(G.distance_to("edges", F.lit(centre[0]), F.lit(centre[1])))
    one = one.join(kept, "_same").select("edges", "area", F.explode(F.array(away)).alias("centre_m"))
    return buildings.join(one, "edges").select(*buildings.columns, "area", "centre_m")


def massing(prepared: DataFrame, foot: DataFrame, key: str = "oid") -> DataFrame:
    """The attribute table tiles are made from: height, ground, roof, wall, and how each detail level draws it. Needs
    t_height, t_levels, building, t_name and roof_shape columns."""
    b = prepared.join(foot, key)
    b = b.withColumn("height", height_m("t_height", "t_levels", "building", F.col("t_name").isNotNull(), "area", "centre_m", key))
    b = b.withColumn("fill", rectangle_fill("ring"))
    gable = ((F.col("centre_m") >= CENTRE_M) & (F.col("height") < 4 * STOREY_M) & (F.col("area") <= 300) & (F.col("fill") >= 0.85)
             & ~F.coalesce(F.col("roof_shape") == "flat", F.lit(False)))
    far = (F.when(F.col("area") < FAR_MIN_M2, "none").when(F.col("area") < FAR_BOX_M2, "roof").otherwise("box"))
    shape = F.when(F.col("area") < FAR_MIN_M2, F.lit(None)).when(F.col("fill") >= 0.7, "rectangle").otherwise("hull")
    return b.withColumn("roof", roof_key("height", "centre_m", key)).withColumn("wall", wall_key(key)).withColumn(
        "roof_form", F.when(gable, "gable").otherwise("flat")).withColumn("far", far).withColumn("far_shape", shape)


def median_storeys(buildings: DataFrame) -> DataFrame:
    """Median height in storeys inside and outside the centre's radius."""
    placed = buildings.select((F.col("centre_m") < CENTRE_M).alias("central"), (F.col("height") / STOREY_M).alias("storeys"))
    return exact_quantiles(placed, ["central"], "storeys", [0.5], ["storeys"])


def lod_gap(fine: DataFrame, coarse: DataFrame, key: str, stretch: float) -> DataFrame:
    """Percentiles of how much lower the coarse ground lies under buildings, on the stretched terrain."""
    g = fine.select(key, F.col("low").alias("_a")).join(coarse.select(key, F.col("low").alias("_b")), key)
    gap = F.greatest(F.lit(0.0), F.col("_a") - F.col("_b")) * stretch
    return exact_quantiles(g.select(gap.alias("gap")), [], "gap", [0.5, 0.95, 0.99], ["p50", "p95", "p99"]).drop("n")


def coarse_heights(heights: DataFrame, step: int) -> DataFrame:
    """Heights whose pixels carry the mean of their step x step block."""
    from upland.operators.raster import block_average
    block = block_average(heights, step)
    keyed = heights.withColumn("bx", F.floor(F.col("gx") / step).cast("long")).withColumn("by", F.floor(F.col("gy") / step).cast("long")).drop("height")
    return keyed.join(block, ["z", "bx", "by"]).select("z", "gx", "gy", "height")


def ring_lnglat_to_metric(rings) -> Column:
    """A ring of lon/lat structs in the city's local metric frame."""
    def one(p):
        e, n = tm_forward(p["lon"], p["lat"])
        return F.struct(e.alias("x"), n.alias("y"))
    return F.transform(col(rings), one)
