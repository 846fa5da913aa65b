"""Plants: where trees, shrubs and rocks stand, which species, how tall."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upland.functions.geo import (CITY_LAT, M_PER_DEG_LAT, M_PER_DEG_LNG, WEB_MERCATOR_C, col, planar_xy, segment_distance, tile_north, tile_west)
from upland.functions.ids import pick_by_share, unit_hash
from upland.operators import raster as R
from upland.operators import rings as G
from upland.operators.cells import box_join
from upland.plans.landcover import CROP, FOREST, GRASS, LAWN, NONE, ROCK, SCRUB, WATER
from upland.session import written

# Plants per hectare (trees, shrubs, rocks) by zone or class, clearances, species heights and zone weights.
KINDS = ("tree", "shrub", "rock")
DENSITY = {"forest": (34.0, 5.0, 1.5), "urban": (20.0, 3.0, 0.5), NONE: (2.5, 1.0, 0.0), GRASS: (1.5, 4.0, 1.0), LAWN: (2.5, 6.0, 0.0),
           SCRUB: (4.0, 70.0, 3.0), CROP: (0.6, 1.0, 0.0), ROCK: (1.0, 12.0, 30.0)}
STEEP_DEG, STEEP_ROCKS = 30.0, 4.0
CLEAR_M, FOREST_M = 1.2, 25.0
PATH_WIDTH = {"footway": 2.0, "path": 1.5, "cycleway": 2.0, "steps": 2.0, "bridleway": 2.0, "pedestrian": 6.0, "track": 3.5, "corridor": 2.0}
HEIGHTS = {
    "benguet_pine": (12.0, 26.0), "alnus": (8.0, 14.0), "eucalyptus": (14.0, 24.0), "agoho": (12.0, 20.0), "cypress": (7.0, 13.0),
    "norfolk_pine": (12.0, 24.0), "balete": (10.0, 17.0), "maple": (7.0, 12.0), "paperbark": (7.0, 12.0), "african_tulip": (8.0, 14.0),
    "pink_shower": (7.0, 12.0), "coral_tree": (6.0, 10.0), "bottlebrush": (4.0, 7.0), "calliandra": (3.0, 5.0), "shrub": (0.8, 1.8),
    "shrub_dry": (0.8, 1.6), "rock": (0.6, 1.6), "person": (1.5, 1.78)}
ZONES = {
    "forest": [("benguet_pine", 55), ("alnus", 13), ("eucalyptus", 8), ("agoho", 5), ("cypress", 5), ("balete", 6), ("african_tulip", 3), ("maple", 5)],
    "urban": [("benguet_pine", 16), ("alnus", 10), ("eucalyptus", 7), ("african_tulip", 9), ("bottlebrush", 8), ("calliandra", 6), ("coral_tree", 5),
              ("paperbark", 6), ("norfolk_pine", 8), ("cypress", 9), ("maple", 5), ("balete", 6), ("pink_shower", 5)],
    "park": [("benguet_pine", 24), ("cypress", 8), ("norfolk_pine", 8), ("bottlebrush", 10), ("african_tulip", 10), ("pink_shower", 9), ("balete", 8),
             ("eucalyptus", 8), ("alnus", 7), ("maple", 4), ("coral_tree", 4)],
    "median": [("alnus", 6), ("maple", 2), ("bottlebrush", 2)]}
MEDIAN_TREE_M, MEDIAN_SHRUB_M = (4.0, 6.0), (0.7, 1.0)


def _densities(i: int) -> Column:
    """Plants of kind i a hectare, from the site's cover: forest or urban for tree cover, else its class."""
    cover = F.create_map(*[F.lit(x) for k, v in DENSITY.items() for x in (str(k), v[i])])
    return F.coalesce(cover[F.col("cover")], F.lit(0.0))


def _highest(i: int) -> Column:
    """The most a cell's class can hold of kind i, whatever stands near it and however steep it is."""
    extra = STEEP_ROCKS if KINDS[i] == "rock" else 0.0
    top = {c: v[i] + (extra if c != NONE else 0.0) for c, v in DENSITY.items() if not isinstance(c, str)}
    top[FOREST] = max(DENSITY["forest"][i], DENSITY["urban"][i]) + extra
    m = F.create_map(*[F.lit(x) for kv in top.items() for x in kv])
    return F.coalesce(m[F.col("cls")], F.lit(0.0))


def cell_hectares(dx: float, dy: float) -> float:
    return dx * M_PER_DEG_LNG * math.cos(math.radians(CITY_LAT)) * dy * M_PER_DEG_LAT / 1e4


def candidates(grid: DataFrame, west: float, north: float, dx: float, dy: float) -> DataFrame:
    """One place per land cell (row, col, cls): jittered inside the cell by hash: site_id, row, col, cls, lng, lat, x, y."""
    u = lambda a: unit_hash(F.lit("plant"), F.lit(a), "row", "col")
    lng = F.lit(west) + (F.col("col") + u("x")) * F.lit(dx)
    lat = F.lit(north) - (F.col("row") + u("y")) * F.lit(dy)
    c = grid.where(F.col("cls") != WATER).select(F.concat_ws(":", "row", "col").alias("site_id"), "row", "col", "cls", lng.alias("lng"), lat.alias("lat"))
    x, y = planar_xy("lng", "lat")
    return c.select("*", x.alias("x"), y.alias("y"))


def obstacles(buildings: DataFrame, segs: DataFrame, rings: DataFrame | None = None) -> DataFrame:
    """Buildings, road pieces (with their `clear` width) and rings as one table: edges, whether they close an area, how far
    they reach, and the box of what they keep free."""
    def table(df, edges, area, reach, w, s, e, n):
        return df.select(edges.alias("oedges"), F.lit(area).alias("oarea"), reach.cast("double").alias("reach"), (w - reach).alias("ow"), (s - reach).alias("os"), (e + reach).alias("oe"), (n + reach).alias("on_"))

    c = F.col
    piece = F.array(F.struct("ax", "ay", "bx", "by"))
    out = table(buildings.dropDuplicates(["edges"]), c("edges"), True, F.lit(CLEAR_M), c("w"), c("s"), c("e"), c("n"))
    out = out.unionByName(table(segs.select("ax", "ay", "bx", "by", "clear").distinct(), piece, False, c("clear"), F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by")))
    if rings is not None:
        out = out.unionByName(table(rings.dropDuplicates(["edges"]), c("edges"), True, F.lit(0.0), c("west"), c("south"), c("east"), c("north")))
    return out


def clear_sites(sites: DataFrame, buildings: DataFrame, segs: DataFrame, rings: DataFrame | None = None, key: str = "site_id") -> DataFrame:
    """Sites off buildings (1.2 m), roads (segments with a `clear` width) and rings: one anti-join, stopping at the first
    obstacle."""
    x, y = F.col("x"), F.col("y")
    hit = (F.col("oarea") & G.contains("oedges", "x", "y")) | ((F.col("reach") > 0) & (G.distance_to("oedges", "x", "y") <= F.col("reach")))
    sites = sites.select(key, *[c for c in sites.columns if c != key])
    return box_join(sites, obstacles(buildings, segs, rings), [x, y, x, y], [F.col(c) for c in ("ow", "os", "oe", "on_")], hit, "left_anti")


def near_buildings(sites: DataFrame, buildings: DataFrame, m: float = FOREST_M, key: str = "site_id") -> DataFrame:
    """Keys of sites within m of a building."""
    x, y = F.col("x"), F.col("y")
    near = F.when(G.contains("edges", "x", "y"), 0.0).otherwise(G.distance_to("edges", "x", "y"))
    box = [F.col("w") - m, F.col("s") - m, F.col("e") + m, F.col("n") + m]
    return box_join(sites.select(key, "x", "y"), buildings.select("edges", "w", "s", "e", "n").dropDuplicates(["edges"]), [x, y, x, y], box, near <= m, "left_semi").select(key)


def plant_sites(grid: DataFrame, header: tuple[float, float, float, float], heights: DataFrame | None, buildings: DataFrame, segs: DataFrame,
                rings: DataFrame | None = None, parks: DataFrame | None = None) -> DataFrame:
    """All generated plants: site_id, kind, cls, cover, zone, species, height, lng, lat, x, y.

    A cell holds a plant of a kind when its hash is under density x cell area, so the result does not depend on
    partitioning and any tile can be rebuilt alone. Only cells that win the draw at the highest density of their class go
    through the obstacle joins."""
    west, north, dx, dy = header
    ha = cell_hectares(dx, dy)
    c = candidates(grid, west, north, dx, dy)
    draws = F.array(*[F.struct(F.lit(k).alias("kind"), _highest(i).alias("most"), unit_hash(F.lit("keep"), F.lit(k), "row", "col").alias("u")) for i, k in enumerate(KINDS)])
    c = c.withColumn("_d", F.filter(draws, lambda d: d["u"] < d["most"] * F.lit(ha))).where(F.size("_d") > 0)
    c = clear_sites(c, buildings, segs, rings)
    close = near_buildings(c.where(F.col("cls") == FOREST), buildings).withColumn("_near", F.lit(True))
    c = c.join(close, "site_id", "left")
    cover = F.when(F.col("cls") == FOREST, F.when(F.col("_near"), "urban").otherwise("forest")).otherwise(F.col("cls").cast("string"))
    c = c.withColumn("cover", cover).drop("_near")
    if heights is not None:
        s = R.slopes(c.select("site_id", "lng", "lat"), heights, ["site_id"])
        c = c.join(s, "site_id", "left").withColumn("steep", F.coalesce(F.col("slope_deg") > STEEP_DEG, F.lit(False))).drop("slope_deg")
    else:
        c = c.withColumn("steep", F.lit(False))
    if parks is not None:
        inside = G.points_in_polygons(c.select("site_id", "x", "y"), parks, "left_semi").select("site_id").withColumn("_park", F.lit(True))
        c = c.join(inside, "site_id", "left").withColumn("in_park", F.coalesce("_park", F.lit(False))).drop("_park")
    else:
        c = c.withColumn("in_park", F.lit(False))
    c = c.withColumn("d", F.explode("_d")).drop("_d").withColumn("kind", F.col("d.kind"))
    density = F.when(F.col("kind") == "tree", _densities(0)).when(F.col("kind") == "shrub", _densities(1)).otherwise(
        _densities(2) + F.when(F.col("steep") & (F.col("cls") != NONE), STEEP_ROCKS).otherwise(0.0))
    return dress(c.where(F.col("d.u") < density * F.lit(ha)).drop("d"))


def zone_of(in_park, cover, cls) -> Column:
    return F.when(col(in_park), "park").when(col(cover) == "forest", "forest").when(col(cls).isin(LAWN, GRASS), "park").otherwise("urban")


def dress(sites: DataFrame) -> DataFrame:
    """Zone, species and height by hash of the site and kind."""
    u = unit_hash(F.lit("species"), "kind", "site_id")
    zone = zone_of("in_park", "cover", "cls")
    tree = None
    for z in ("forest", "urban", "park"):
        p = pick_by_share(ZONES[z], u)
        tree = F.when(zone == z, p) if tree is None else tree.when(zone == z, p)
    species = F.when(F.col("kind") == "tree", tree).when(F.col("kind") == "shrub", F.when(F.col("cls").isin(SCRUB, ROCK), "shrub_dry").otherwise("shrub")).otherwise("rock")
    s = sites.withColumn("zone", F.when(F.col("kind") == "tree", zone)).withColumn("species", species)
    return s.withColumn("height", plant_height("species", unit_hash(F.lit("height"), "kind", "site_id"), (F.col("kind") == "rock") & (F.col("cls") == ROCK)))


def plant_height(species, u, on_rock) -> Column:
    """More young plants than old; outcrops on bare rock are larger."""
    lo = F.create_map(*[F.lit(x) for k, (a, _) in HEIGHTS.items() for x in (k, a)])[col(species)]
    hi = F.create_map(*[F.lit(x) for k, (_, b) in HEIGHTS.items() for x in (k, b)])[col(species)]
    h = lo + (hi - lo) * F.pow(col(u), F.lit(1.3))
    return F.when(col(on_rock), h * 1.8).otherwise(h)


def row_trees(rows: DataFrame, code: str = "code") -> DataFrame:
    """Trees every 8 m along mapped tree rows."""
    from upland.operators.lines import points_along, segments
    return points_along(segments(rows, code), 8.0).select(F.concat_ws(":", code, "step").alias("site_id"), "x", "y")


def union_sites(*parts: DataFrame) -> DataFrame:
    """All site kinds together by column name; missing columns are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def site_records(sites: DataFrame, stretch: float = 1.0) -> DataFrame:
    """Sites (tile z, x, y, lng, lat, ground, height) to whole-number records: east and north of the tile's centre in 1/80 m
    from -400 m, ground in 1/20 m above the tile's lowest, height in 1/8 m; all clipped to their ranges. The lowest ground
    of a tile is an aggregate joined back, so no tile is gathered."""
    clat = (tile_north("y", "z") + tile_north(F.col("y") + 1, "z")) / 2
    clng = (tile_west("x", "z") + tile_west(F.col("x") + 1, "z")) / 2
    k = F.lit(WEB_MERCATOR_C) * F.cos(F.radians(clat))
    my = lambda c: F.asinh(F.tan(F.radians(col(c)))) / F.lit(2 * math.pi)
    east, north = (F.col("lng") - clng) / 360 * k, (my("lat") - my(clat)) * k
    low = sites.groupBy("z", "x", "y").agg((F.floor(F.min(F.col("ground") * stretch) * 20) / 20).alias("e0"))
    clip = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c.cast("int")))
    s = sites.join(low, ["z", "x", "y"])
    return s.select("*", clip(F.bround((east + 400) * 80), 0, 65535).alias("rx"), clip(F.bround((north + 400) * 80), 0, 65535).alias("ry"),
                    clip(F.bround((F.col("ground") * stretch - F.col("e0")) * 20), 0, 65535).alias("re"), clip(F.bround(F.col("height") * 8), 1, 255).alias("rh"))


def tree_candidates(box: DataFrame, buildings: DataFrame, segs: DataFrame) -> DataFrame:
    """Tree places on a jittered 30 m grid inside boxes (w, s, e, n), at least 8 m from any building or road."""
    from upland.plans.districts import jitter_grid
    g = jitter_grid(box, 30.0, 15.0, "pines", []).dropDuplicates(["i", "j"]).withColumn("site_id", F.concat_ws(":", "i", "j"))
    x, y = F.col("x"), F.col("y")
    near = F.when(G.contains("edges", "x", "y"), 0.0).otherwise(G.distance_to("edges", "x", "y"))
    bb = [F.col("w") - 8, F.col("s") - 8, F.col("e") + 8, F.col("n") + 8]
    free = box_join(g.select("site_id", "i", "j", "x", "y"), buildings.select("edges", "w", "s", "e", "n").dropDuplicates(["edges"]), [x, y, x, y], bb, near <= 8.0, "left_anti")
    sb = [F.least("ax", "bx") - 8, F.least("ay", "by") - 8, F.greatest("ax", "bx") + 8, F.greatest("ay", "by") + 8]
    return box_join(free, segs.select("ax", "ay", "bx", "by").distinct(), [x, y, x, y], sb, segment_distance("x", "y", "ax", "ay", "bx", "by") <= 8.0, "left_anti")


def standing_trees(places: DataFrame, heights: DataFrame, to_lnglat, reach: float = 6.0, lowest: float = 1200.0) -> DataFrame:
    """Candidates (site_id, x, y) that stand: above 1,200 m, with a chance that grows with the slope to 6 m east and north
    (a fifth on the flat, all at 30 degrees). Adds ground and slope_deg."""
    places = written(places)            # read several times below: a plan that holds their joins once for each reading fills the driver
    shifts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, a, b in (("o", 0.0, 0.0), ("e", reach, 0.0), ("n", 0.0, reach))])
    moved = places.select("site_id", "x", "y", F.explode(shifts).alias("m")).select("site_id", F.col("m.k").alias("k"), (F.col("x") + F.col("m.a")).alias("x"), (F.col("y") + F.col("m.b")).alias("y"))
    lng, lat = to_lnglat("x", "y")
    h = R.sample_bilinear(moved.select("site_id", "k", lng.alias("lng"), lat.alias("lat")), heights, ["site_id", "k"])
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("ground")))
    z = h.groupBy("site_id").agg(at("o").alias("ground"), at("e").alias("ze"), at("n").alias("zn"))
    z = z.withColumn("slope_deg", F.degrees(F.atan(F.hypot(F.col("ze") - F.col("ground"), F.col("zn") - F.col("ground")) / reach)))
    chance = F.least(F.lit(1.0), F.greatest(F.lit(0.2), F.col("slope_deg") / 30.0))
    kept = z.where((F.col("ground") > lowest) & (unit_hash(F.lit("stand"), "site_id") < chance))
    return places.join(kept.select("site_id", "ground", "slope_deg"), "site_id")
