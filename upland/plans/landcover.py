"""Land cover: a class raster on a doubled grid, overridden by mapped areas."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upland.functions.geo import CITY_LAT, M_PER_DEG_LNG, M_PER_DEG_LAT, col, segment_distance
from upland.operators import rings as G
from upland.operators.raster import grid_centre

# The classes, the raster's codes and the tag rules (the last matching rule wins).
NONE, FOREST, GRASS, LAWN, SCRUB, CROP, ROCK, WATER = range(8)
RASTER_CLASS = {10: FOREST, 20: SCRUB, 30: GRASS, 40: CROP, 50: NONE, 60: ROCK, 70: ROCK, 80: WATER, 90: GRASS, 95: FOREST, 100: GRASS}
AREA_RULES = [
    (FOREST, {"landuse": ("forest",), "natural": ("wood",)}),
    (GRASS, {"natural": ("grassland", "heath"), "landuse": ("meadow", "greenfield")}),
    (SCRUB, {"natural": ("scrub", "shrubbery")}),
    (CROP, {"landuse": ("farmland", "orchard", "allotments", "plant_nursery")}),
    (LAWN, {"leisure": ("garden", "pitch", "playground", "golf_course"),
            "landuse": ("grass", "village_green", "recreation_ground", "cemetery", "flowerbed")}),
    (ROCK, {"natural": ("bare_rock", "scree", "rock", "stone")}),
]
RANK = {c: i for i, (c, _) in enumerate(AREA_RULES)}
CLIFF_HALF_M = 3.0


def raster_class(code) -> Column:
    m = F.create_map(*[F.lit(x) for kv in RASTER_CLASS.items() for x in kv])
    return F.coalesce(m[col(code).cast("int")], F.lit(NONE))


def area_class(tags="tags") -> Column:
    """Class of a mapped area; null when no rule fits."""
    out = None
    for c, rule in reversed(AREA_RULES):
        hit = F.lit(False)
        for k, values in rule.items():
            hit = hit | F.coalesce(col(tags)[k].isin(*values), F.lit(False))
        out = F.when(hit, F.lit(c)) if out is None else out.when(hit, F.lit(c))
    return out


def doubled(grid: DataFrame) -> DataFrame:
    """Each cell as its four half-size cells."""
    half = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    return grid.withColumn("_h", half).withColumn("row", F.col("row") * 2 + F.col("_h.a")).withColumn("col", F.col("col") * 2 + F.col("_h.b")).drop("_h")


def override(base, ranks) -> Column:
    """Final class of a cell from its base class and the ranks of the areas over it: water stays; built-up land may turn
    only to lawn or rock; otherwise the highest-ranked area wins."""
    b, r = col(base), col(ranks)
    allowed = F.when(b == NONE, F.filter(r, lambda x: x.isin(RANK[LAWN], RANK[ROCK]))).otherwise(r)
    top = F.array_max(allowed)
    back = F.create_map(*[F.lit(v) for c, i in RANK.items() for v in (i, c)])
    return F.when((b == WATER) | top.isNull(), b).otherwise(back[top])


def classify(grid: DataFrame, areas: DataFrame, west: float, north: float, dx: float, dy: float, cliffs: DataFrame | None = None) -> DataFrame:
    """Grid (row, col, cls) with `final`, from areas (cls as acls, edges and box in lng/lat) and cliff segments
    (ax, ay, bx, by in lng/lat) 3 m to each side. The grid is regular, so a shape names its own cells; nothing is searched.
    The set of ranks per cell has at most six members, so it is collected
    as a set that combines map-side."""
    rank = F.create_map(*[F.lit(v) for c, i in RANK.items() for v in (c, i)])
    lng, lat = grid_centre(west, north, dx, dy)

    def covered(shapes: DataFrame, box) -> DataFrame:
        """Each shape with the grid cells whose centres its box (west, south, east, north) holds."""
        w, s_, e, n_ = box
        span = lambda lo, hi: F.explode(F.when(lo <= hi, F.sequence(lo.cast("long"), hi.cast("long"))))
        first, last = F.floor((n_ - F.lit(north)) / F.lit(-dy) - 0.5), F.ceil((s_ - F.lit(north)) / F.lit(-dy) - 0.5)
        rows = shapes.withColumn("row", span(first, last))
        left, right = F.floor((w - F.lit(west)) / F.lit(dx) - 0.5), F.ceil((e - F.lit(west)) / F.lit(dx) - 0.5)
        return rows.withColumn("col", span(left, right)).withColumn("lng", lng).withColumn("lat", lat)

    shapes = areas.select(F.col("acls"), "edges", "west", "south", "east", "north").dropDuplicates(["acls", "edges"])
    over = covered(shapes, [F.col(c) for c in ("west", "south", "east", "north")]).where(G.contains("edges", "lng", "lat"))
    hits = over.select("row", "col", rank[F.col("acls")].alias("_k"))
    if cliffs is not None:
        kx, ky = M_PER_DEG_LNG * math.cos(math.radians(CITY_LAT)), M_PER_DEG_LAT
        px, py = CLIFF_HALF_M / kx, CLIFF_HALF_M / ky
        m = lambda c, k: F.col(c) * F.lit(k)
        d = segment_distance(m("lng", kx), m("lat", ky), m("ax", kx), m("ay", ky), m("bx", kx), m("by", ky))
        box = [F.least("ax", "bx") - px, F.least("ay", "by") - py, F.greatest("ax", "bx") + px, F.greatest("ay", "by") + py]
        rock = covered(cliffs.select("ax", "ay", "bx", "by"), box).where(d <= CLIFF_HALF_M)
        hits = hits.union(rock.select("row", "col", F.lit(RANK[ROCK]).alias("_k")))
    sets = hits.groupBy("row", "col").agg(F.collect_set("_k").alias("_ranks"))
    types = dict(grid.dtypes)
    sets = sets.withColumn("row", F.col("row").cast(types["row"])).withColumn("col", F.col("col").cast(types["col"]))
    out = grid.select("row", "col", "cls", lng.alias("lng"), lat.alias("lat")).join(sets, ["row", "col"], "left")
    return out.withColumn("final", override("cls", F.coalesce("_ranks", F.array().cast("array<int>")))).drop("_ranks")


def shares(grid: DataFrame, cls: str) -> DataFrame:
    """Cells and share per class. The total comes from the per-class counts, a handful of rows, not a second scan."""
    n = grid.groupBy(cls).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_t"), F.lit(1).alias("_one"))
    return n.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").select(cls, "n", (F.col("n") / F.col("_t")).alias("share"))
