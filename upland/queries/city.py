"""City jobs: buildings, land cover, plants, roads, districts, routes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from upland.functions import geo, ids
from upland.operators import lines as L
from upland.operators import tracks
from upland.operators import rings as G
from upland.plans import districts as DI
from upland.plans import flora as FL
from upland.plans import landcover as LC
from upland.plans import massing as M
from upland.plans import refresh as RF
from upland.plans import roads as RD
from upland.plans import route_qa as Q
from upland.queries import query
from upland.queries.spatial import DIST, PVEN, RING, _H, _P15, points, pven, rings
from upland.queries.tables import (BLD, DEST, GRID, GRID_D, GRID_N, GRID_W, K, PATH, PPATH, ROAD, SEG, bilinear_sql, hav_km, height_sql, lat, lng, px_sql, py_sql, r, rnd, with_)
from upland.operators.cellgroups import connected_masks
from upland.operators.cover import layered_masks
from upland.session import written

# ------------------------------------------------------------ buildings


def crc_sql(text):
    """CRC-32 of ASCII text, bit by bit."""
    step = "lambda a, z: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)"
    zeros = "[" + ", ".join(["0::BIGINT"] * 8) + "]"
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: list_reduce(list_prepend(xor(c, b), {zeros}), {step})), 4294967295::BIGINT)")


def sha8(text):
    return f"CAST(('0x' || substr(sha256({text}), 1, 8)) AS BIGINT)"


CX, CY = 120.6, 16.4
CENTRE_X, CENTRE_Y = (CX + 180) / 360 * K, math.asinh(math.tan(math.radians(CY))) / (2 * math.pi) * K
_CD = f"sqrt(pow(greatest(abs(cx - {CENTRE_X!r}::DOUBLE) - side / 2, 0), 2) + pow(greatest(abs(cy - {CENTRE_Y!r}::DOUBLE) - side / 2, 0), 2))"
_COM = ", ".join(f"'{c}'" for c in M.COMMERCIAL)
BH = f"""bh AS (SELECT *, CASE WHEN t_height IS NOT NULL THEN CAST(replace(t_height, ' m', '') AS DOUBLE) WHEN t_levels IS NOT NULL THEN greatest(1, CAST(t_levels AS DOUBLE)) * 3.2::DOUBLE
  ELSE least(10, greatest(1, round_even(g, 0))) * 3.2::DOUBLE END AS height FROM (SELECT *, CASE WHEN area > 600 THEN g0 + 1 WHEN area < 40 THEN least(g0, 1.5) ELSE g0 END + CASE WHEN t_name IS NOT NULL THEN 0.5 ELSE 0 END + (crc % 5 - 2) * 0.5 AS g FROM
  (SELECT *, CASE WHEN building IN ({_COM}) THEN 3.0 ELSE 2.5 END + CASE WHEN cd < 600 THEN 1.0 WHEN cd < 1500 THEN 0.5 ELSE 0.0 END AS g0 FROM (SELECT *, side * side AS area, {_CD} AS cd, {crc_sql('oid')} AS crc FROM bld))))"""
_CUM = []
_t = 0
for _n, _w in M.ROOFS:
    _t += _w
    _CUM.append((_n, _t))
_ROOF = "CASE WHEN cd < 600 OR height >= 12.8 THEN 'flat' " + " ".join(f"WHEN crc % {_t} < {u} THEN '{n}'" for n, u in _CUM) + " END"


def prepared(t, with_rings=True):
    ex = rings(t, False).withColumnRenamed("edges", "redges").where(F.lit(with_rings))
    return M.prepare(t.bld.withColumn("roof_shape", F.when(F.col("bid") % 9 == 0, "flat")), ex, (CENTRE_X, CENTRE_Y))


@query("E29_building_height", with_(BLD, BH) + f"SELECT bid, {rnd('height', 4)} AS height FROM bh")
def _(t):
    b = prepared(t, False)
    h = M.height_m("t_height", "t_levels", "building", F.col("t_name").isNotNull(), "area", "centre_m", "oid")
    return b.select("bid", r(h, 4).alias("height"))


@query("E30_storeys_by_size", with_(BLD) + f"""SELECT bid, {rnd("CASE WHEN t_height IS NOT NULL THEN CAST(replace(t_height, ' m', '') AS DOUBLE) WHEN t_levels IS NOT NULL THEN floor(CAST(t_levels AS DOUBLE)) * 3.2::DOUBLE ELSE round_even(3 + 4 * (0.7::DOUBLE * least(1, log10(greatest(side * side, 50) / 50) / 1.6) + 0.3::DOUBLE * (" + sha8('oid') + " % 100) / 100.0::DOUBLE), 0) * 3.2::DOUBLE END", 4)} AS height FROM bld""")
def _(t):
    return t.bld.select("bid", r(M.storeys_by_size("t_height", "t_levels", G.area("ring"), "oid", 3, 7), 4).alias("height"))


@query("E31_weighted_pick", with_(BLD) + f"SELECT bid, {_ROOF.split('THEN ' + chr(39) + 'flat' + chr(39))[0][:0]}CASE " + " ".join(f"WHEN crc % {_t} < {u} THEN '{n}'" for n, u in _CUM) + f" END AS roof, CAST({crc_sql('wid')} % 4 AS INTEGER) AS wall FROM (SELECT bid, {crc_sql('oid')} AS crc, oid || 'w' AS wid FROM bld)")
def _(t):
    return t.bld.select("bid", ids.weighted_pick(M.ROOFS, ids.crc_of("oid")).alias("roof"), M.wall_key("oid").alias("wall"))


_FOOT = f"""spot AS (SELECT bid, cx, cy, side, k * 4 * side / n AS t FROM (SELECT *, CAST(greatest(4, floor(4 * side / 8)) AS BIGINT) AS n FROM bld), (SELECT unnest(range(0, 40)) AS k) WHERE k < n),
 outl AS (SELECT bid, cx, cy, side, least(3, floor(t / side)) AS e, t - least(3, floor(t / side)) * side AS q FROM spot),
 pt AS (SELECT bid, cx - side / 2 + CASE e WHEN 0 THEN q WHEN 1 THEN side WHEN 2 THEN side - q ELSE 0 END AS x, cy - side / 2 + CASE e WHEN 0 THEN 0 WHEN 1 THEN q WHEN 2 THEN side ELSE side - q END AS y FROM outl
  UNION ALL SELECT bid, cx + a * side / 2, cy + b * side / 2 FROM bld, (VALUES (-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)) c(a, b)),
 ll AS (SELECT bid, x / {K!r}::DOUBLE * 360 - 180 AS lng, degrees(atan(sinh(y / {K!r}::DOUBLE * {2 * math.pi!r}::DOUBLE))) AS lat FROM pt),
 foot AS (SELECT bid, min(g) AS low, avg(g) AS mean FROM (SELECT bid, {bilinear_sql('lng', 'lat')} AS g FROM ll) GROUP BY bid)"""


def ground(t, fields=("x", "y")):
    """Height pixels around the buildings' corners and centres, wide enough for their whole outline."""
    a, b = geo.planar_lnglat("cx", "cy")
    return t.heights(t.bld.select(a.alias("lng"), b.alias("lat")), reach=6)


@query("A11_footing", with_(BLD, _FOOT) + f"SELECT bid, {rnd('low', 3)} AS low, {rnd('mean', 3)} AS mean FROM foot")
def _(t):
    return M.footing(t.bld, ground(t), "bid", geo.planar_lnglat).select("bid", r("low", 3).alias("low"), r("mean", 3).alias("mean"))


@query("A12_median_storeys", with_(BLD, BH, RING) + f"SELECT cd < 600 AS central, {rnd('quantile_cont(height, 0.5) / 3.2::DOUBLE', 4)} AS storeys, count(*) AS n FROM bh WHERE NOT EXISTS (SELECT 1 FROM ringp WHERE abs(cx - rx) <= h + side / 2 AND abs(cy - ry) <= h + side / 2) GROUP BY 1")
def _(t):
    b = prepared(t)
    b = b.withColumn("height", M.height_m("t_height", "t_levels", "building", F.col("t_name").isNotNull(), "area", "centre_m", "oid"))
    return M.median_storeys(b).select("central", r("storeys", 4).alias("storeys"), "n")


@query("A13_lod_gap")
def _(t):
    h = ground(t)
    fine = M.footing(t.bld, h, "bid", geo.planar_lnglat)
    coarse = M.footing(t.bld, M.coarse_heights(h, 4), "bid", geo.planar_lnglat)
    return M.lod_gap(fine, coarse, "bid", 1.35).select(*[r(c, 3).alias(c) for c in ("p50", "p95", "p99")])


@query("P1_massing", with_(BLD, BH, RING, _FOOT) + f"""SELECT bid, {rnd('height', 3)} AS height, {rnd('low', 2)} AS low, {_ROOF} AS roof, CAST({crc_sql("(oid || 'w')")} % 4 AS INTEGER) AS wall, CASE WHEN cd >= 600 AND height < 12.8 AND area <= 300 AND bid % 9 <> 0 THEN 'gable' ELSE 'flat' END AS roof_form,
 CASE WHEN area < 60 THEN 'none' WHEN area < 200 THEN 'roof' ELSE 'box' END AS far FROM bh JOIN foot USING (bid) WHERE area >= 4 AND NOT EXISTS (SELECT 1 FROM ringp WHERE abs(cx - rx) <= h + side / 2 AND abs(cy - ry) <= h + side / 2)""")
def _(t):
    foot = M.footing(t.bld, ground(t), "oid", geo.planar_lnglat)
    return M.massing(prepared(t), foot).select("bid", r("height", 3).alias("height"), r("low", 2).alias("low"), "roof", "wall", "roof_form", "far")


# ---------------------------------------------------------------- land cover

_BASE = "CASE code " + " ".join(f"WHEN {k} THEN {v}" for k, v in LC.RASTER_CLASS.items()) + " ELSE 0 END"
_NROW = "(SELECT max(o_orderkey) // 128 + 1 FROM orders)"
AREA = """ar AS (SELECT p_partkey AS aid, CAST([1, 2, 4, 5, 3, 6][CAST(1 + p_partkey % 6 AS INTEGER)] AS INTEGER) AS acls, {w}::DOUBLE + ((p_partkey * 37) % 128) * 0.0001::DOUBLE AS ax, {n}::DOUBLE - ((p_partkey * 53) % 110) * 0.0001::DOUBLE AS ay,
  (1 + p_size % 4) * 0.00013::DOUBLE AS hx, (1 + p_size % 3) * 0.00013::DOUBLE AS hy FROM part)""".format(w=GRID_W, n=GRID_N)


def areas(t):
    d = t._view(AREA.replace("[1, 2, 4, 5, 3, 6][CAST(1 + p_partkey % 6 AS INTEGER)]", "element_at(array(1, 2, 4, 5, 3, 6), CAST(1 + p_partkey % 6 AS INT))"), part=t.raw("part"))
    hx, hy = F.col("hx"), F.col("hy")
    ring = F.array(*[F.struct((F.col("ax") + a * hx).alias("x"), (F.col("ay") + b * hy).alias("y")) for a, b in [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]])
    return d.withColumn("edges", G.edges(ring)).select("aid", "acls", "edges", (F.col("ax") - hx).alias("west"), (F.col("ay") - hy).alias("south"), (F.col("ax") + hx).alias("east"), (F.col("ay") + hy).alias("north"))


_FINAL = """CASE WHEN base = 7 THEN 7 WHEN base = 0 THEN CASE WHEN top2 >= 5 THEN 6 WHEN top2 = 4 THEN 3 ELSE 0 END WHEN top IS NULL THEN base ELSE [1, 2, 4, 5, 3, 6][CAST(top + 1 AS INTEGER)] END"""
_CELL = f"""cell AS (SELECT "row", "col", {_BASE} AS base, {GRID_W}::DOUBLE + ("col" + 0.5) * {GRID_D}::DOUBLE AS lng, {GRID_N}::DOUBLE - ("row" + 0.5) * {GRID_D}::DOUBLE AS lat FROM grid),
 over AS (SELECT "row", "col", max(k) AS top, max(k) FILTER (WHERE k >= 4) AS top2 FROM (SELECT "row", "col", CASE acls WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 3 WHEN 3 THEN 4 ELSE 5 END AS k FROM cell JOIN ar ON abs(lng - ax) < hx AND abs(lat - ay) < hy) GROUP BY 1, 2)"""


def base_grid(t):
    return t.grid.select("row", "col", LC.raster_class("code").alias("cls"))


@query("E40_cover_class", with_(GRID) + f"""SELECT "row", "col", CAST({_BASE} AS INTEGER) AS cls FROM grid""")
def _(t):
    return base_grid(t)


@query("E40_area_class", "SELECT cls, count(*) AS n FROM (SELECT CAST(CASE WHEN k2 = 'bare_rock' THEN 6 WHEN k1 = 'garden' THEN 3 WHEN k0 = 'grass' THEN 3 WHEN k0 = 'orchard' THEN 5 WHEN k2 = 'scrub' THEN 4 WHEN k0 = 'meadow' THEN 2 WHEN k0 = 'forest' OR k2 = 'wood' THEN 1 END AS INTEGER) AS cls FROM (SELECT ['forest', 'meadow', 'grass', 'orchard', 'none'][CAST(1 + p_partkey % 5 AS INTEGER)] AS k0, ['garden', 'park', 'track'][CAST(1 + p_partkey % 3 AS INTEGER)] AS k1, ['bare_rock', 'scrub', 'wood', 'x', 'y', 'z', 'w'][CAST(1 + p_partkey % 7 AS INTEGER)] AS k2 FROM part)) GROUP BY cls")
def _(t):
    of = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (1 + F.col("p_partkey") % n).cast("int"))
    tags = F.create_map(F.lit("landuse"), of(["forest", "meadow", "grass", "orchard", "none"], 5), F.lit("leisure"), of(["garden", "park", "track"], 3), F.lit("natural"), of(["bare_rock", "scrub", "wood", "x", "y", "z", "w"], 7))
    return t.raw("part").select(LC.area_class(tags).alias("cls")).groupBy("cls").agg(F.count("*").alias("n"))


@query("J19_classify_cells", with_(GRID, AREA, _CELL) + f"""SELECT "row", "col", CAST({_FINAL} AS INTEGER) AS cls FROM cell LEFT JOIN over USING ("row", "col")""")
def _(t):
    return LC.classify(base_grid(t), areas(t), GRID_W, GRID_N, GRID_D, GRID_D).select("row", "col", F.col("final").alias("cls"))


_CELL2 = _CELL.replace("FROM grid)", 'FROM (SELECT "row" * 2 + a AS "row", "col" * 2 + b AS "col", code FROM grid, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b)))').replace(f"{GRID_D}::DOUBLE", f"{GRID_D / 2!r}::DOUBLE")


@query("P3_landcover", with_(GRID, AREA, _CELL2) + f"""SELECT CAST(cls AS INTEGER) AS cls, count(*) AS n FROM (SELECT {_FINAL} AS cls FROM cell LEFT JOIN over USING ("row", "col")) GROUP BY 1""")
def _(t):
    d = LC.classify(LC.doubled(base_grid(t)), areas(t), GRID_W, GRID_N, GRID_D / 2, GRID_D / 2)
    return d.groupBy(F.col("final").alias("cls")).agg(F.count("*").alias("n"))


# -------------------------------------------------------------- plants

_U = lambda *parts: f"(CAST({sha8('concat_ws(' + chr(39) + '|' + chr(39) + ', ' + ', '.join(parts) + ')')} AS DOUBLE) / 4294967296.0::DOUBLE)"
SITE = f"""site0 AS (SELECT "row", "col", {_BASE} AS cls, "row" || ':' || "col" AS site_id, {GRID_W}::DOUBLE + ("col" + {_U("'plant'", "'x'", '"row"', '"col"')}) * {GRID_D}::DOUBLE AS lng, {GRID_N}::DOUBLE - ("row" + {_U("'plant'", "'y'", '"row"', '"col"')}) * {GRID_D}::DOUBLE AS lat FROM grid),
 site1 AS (SELECT *, {px_sql('lng')} AS x, {py_sql('lat')} AS y FROM site0 WHERE cls <> 7)"""
_SQ = "sqrt(pow(greatest(abs(x - cx) - side / 2, 0), 2) + pow(greatest(abs(y - cy) - side / 2, 0), 2))"
# obstacles moved beside the grid, so that plants and buildings do meet
NBLD = f"""nb AS (SELECT bid, side, {px_sql(f'({GRID_W}::DOUBLE + (bid * 37 % 128) * 0.0001::DOUBLE)')} AS cx, {py_sql(f'({GRID_N}::DOUBLE - (bid * 53 % 110) * 0.0001::DOUBLE)')} AS cy FROM bld)"""
_CLEAR = f"NOT EXISTS (SELECT 1 FROM nb WHERE {_SQ} <= 1.2) AND NOT EXISTS (SELECT 1 FROM (SELECT *, 3.1::DOUBLE + 1.2 AS clear FROM seg) WHERE {DIST} <= clear)"


def near_blds(t):
    x, y = geo.planar_xy(F.lit(GRID_W) + (F.col("bid") * 37 % 128) * F.lit(0.0001), F.lit(GRID_N) - (F.col("bid") * 53 % 110) * F.lit(0.0001))
    h = F.col("side") / 2
    b = t.bld.select("bid", "oid", "side", x.alias("cx"), y.alias("cy"))
    ring = F.array(*[F.struct((F.col("cx") + a * h).alias("x"), (F.col("cy") + c * h).alias("y")) for a, c in [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]])
    return b.withColumn("ring", ring).withColumn("edges", G.edges("ring")).select("*", (F.col("cx") - h).alias("w"), (F.col("cy") - h).alias("s"), (F.col("cx") + h).alias("e"), (F.col("cy") + h).alias("n"))


def clear_segs(t):
    return t.segs.withColumn("clear", F.lit(3.1) + F.lit(1.2))


@query("J24_clear_sites", with_(GRID, BLD, NBLD, SEG, SITE) + f"SELECT site_id FROM site1 WHERE {_CLEAR}")
def _(t):
    c = FL.candidates(base_grid(t), GRID_W, GRID_N, GRID_D, GRID_D)
    return FL.clear_sites(c, near_blds(t), clear_segs(t)).select("site_id")


def _dens(i):
    return "CASE cover " + " ".join(f"WHEN '{k}' THEN {v[i]}::DOUBLE" for k, v in FL.DENSITY.items()) + " ELSE 0 END"


def _share(weights, u):
    total, upto, out = sum(w for _, w in weights), 0, ""
    for n, w in weights:
        upto += w
        out += f" WHEN {u} * {float(total)}::DOUBLE < {float(upto)}::DOUBLE THEN '{n}'"
    return f"CASE{out} ELSE '{weights[-1][0]}' END"


_HA = FL.cell_hectares(GRID_D, GRID_D)
_LO = "CASE species " + " ".join(f"WHEN '{k}' THEN {a}::DOUBLE" for k, (a, _) in FL.HEIGHTS.items()) + " END"
_HI = "CASE species " + " ".join(f"WHEN '{k}' THEN {b}::DOUBLE" for k, (_, b) in FL.HEIGHTS.items()) + " END"
PLANT = f"""cov AS (SELECT *, CASE WHEN cls = 1 THEN CASE WHEN EXISTS (SELECT 1 FROM nb WHERE {_SQ} <= 25) THEN 'urban' ELSE 'forest' END ELSE CAST(cls AS VARCHAR) END AS cover FROM site1 WHERE {_CLEAR}),
 drawn AS (SELECT *, CASE kind WHEN 'tree' THEN {_dens(0)} WHEN 'shrub' THEN {_dens(1)} ELSE {_dens(2)} END AS density, {_U("'keep'", 'kind', '"row"', '"col"')} AS u FROM cov, (VALUES ('tree'), ('shrub'), ('rock')) k(kind)),
 won AS (SELECT *, CASE WHEN kind = 'tree' THEN CASE WHEN cover = 'forest' THEN 'forest' WHEN cls IN (3, 2) THEN 'park' ELSE 'urban' END END AS zone, {_U("'species'", 'kind', 'site_id')} AS su FROM drawn WHERE u < density * {_HA!r}::DOUBLE),
 plant AS (SELECT *, CASE WHEN kind = 'rock' AND cls = 6 THEN h * 1.8 ELSE h END AS height FROM (SELECT *, {_LO} + ({_HI} - {_LO}) * pow({_U("'height'", 'kind', 'site_id')}, 1.3) AS h FROM
  (SELECT *, CASE WHEN kind = 'shrub' THEN CASE WHEN cls IN (4, 6) THEN 'shrub_dry' ELSE 'shrub' END WHEN kind = 'rock' THEN 'rock' WHEN zone = 'forest' THEN {_share(FL.ZONES['forest'], 'su')} WHEN zone = 'urban' THEN {_share(FL.ZONES['urban'], 'su')} ELSE {_share(FL.ZONES['park'], 'su')} END AS species FROM won)))"""


@query("P4_plant_sites", with_(GRID, BLD, NBLD, SEG, SITE, PLANT) + f"SELECT site_id, kind, cover, zone, species, {rnd('height', 4)} AS height FROM plant")
def _(t):
    p = FL.plant_sites(base_grid(t), (GRID_W, GRID_N, GRID_D, GRID_D), None, near_blds(t), clear_segs(t))
    return p.select("site_id", "kind", "cover", "zone", "species", r("height", 4).alias("height"))


@query("E41_species", with_(GRID, BLD, NBLD, SEG, SITE, PLANT) + f"SELECT species, count(*) AS n, {rnd('max(height)', 3)} AS tallest FROM plant GROUP BY species")
def _(t):
    p = FL.plant_sites(base_grid(t), (GRID_W, GRID_N, GRID_D, GRID_D), None, near_blds(t), clear_segs(t))
    return p.groupBy("species").agg(F.count("*").alias("n"), r(F.max("height"), 3).alias("tallest"))


_T16 = lambda c, d: (f"CAST(floor(({c} + 180) / 360 * 65536) AS BIGINT)", f"CAST(floor((1 - asinh(tan(radians({d}))) / {math.pi!r}::DOUBLE) / 2 * 65536) AS BIGINT)")
_TLAT = lambda y: f"degrees(atan(sinh({math.pi!r}::DOUBLE * (1 - 2 * ({y}) / 65536.0::DOUBLE))))"


@query("E42_site_records", f"""WITH {_H(0)}, p AS (SELECT id, lng, lat, {_T16('lng', 'lat')[0]} AS x, {_T16('lng', 'lat')[1]} AS y, {bilinear_sql('lng', 'lat')} AS g FROM h),
 q AS (SELECT *, floor(min(g * 1.35) OVER (PARTITION BY x, y) * 20) / 20 AS e0, ({_TLAT('y')} + {_TLAT('y + 1')}) / 2 AS clat, ((x / 65536.0::DOUBLE * 360 - 180) + ((x + 1) / 65536.0::DOUBLE * 360 - 180)) / 2 AS clng FROM p)
SELECT id, CAST(greatest(0, least(65535, round_even(((lng - clng) / 360 * ({geo.WEB_MERCATOR_C}::DOUBLE * cos(radians(clat))) + 400) * 80, 0))) AS INTEGER) AS rx, CAST(greatest(0, least(65535, round_even((g * 1.35 - e0) * 20, 0))) AS INTEGER) AS re, CAST(greatest(1, least(255, round_even((4 + id % 40) * 8, 0))) AS INTEGER) AS rh FROM q""")
def _(t):
    from upland.operators.raster import sample_bilinear
    p = points(t)
    p = p.join(sample_bilinear(p, t.heights(p), ["id"]), "id")
    p = p.select("id", "lng", "lat", "ground", F.lit(16).alias("z"), geo.tile_x("lng", F.lit(16)).alias("x"), geo.tile_y("lat", F.lit(16)).alias("y"), (4.0 + F.col("id") % 40).alias("height"))
    return FL.site_records(p, 1.35).select("id", "rx", "re", "rh")


@query("U3_site_kinds", with_(GRID, BLD, NBLD, SEG, SITE, PLANT) + f"""SELECT kind, count(*) AS n FROM (SELECT kind FROM plant UNION ALL SELECT 'row_tree' FROM (SELECT code, sum(len) AS total FROM seg GROUP BY code), (SELECT unnest(range(0, 200)) AS k) WHERE k * 8 < total) GROUP BY kind""")
def _(t):
    p = FL.plant_sites(base_grid(t), (GRID_W, GRID_N, GRID_D, GRID_D), None, near_blds(t), clear_segs(t))
    rows = FL.row_trees(t.planar_lines).withColumn("kind", F.lit("row_tree"))
    return FL.union_sites(p.select("site_id", "kind", "x", "y"), rows.select("site_id", "kind", "x", "y")).groupBy("kind").agg(F.count("*").alias("n"))


@query("P13_tree_candidates", with_(BLD, SEG) + f"""SELECT i, j, {rnd('x', 3)} AS x, {rnd('y', 3)} AS y FROM (SELECT DISTINCT i, j, i * 30.0::DOUBLE + ({_U("'pines'", "'x'", 'i', 'j')} * 2 - 1) * 15 AS x, j * 30.0::DOUBLE + ({_U("'pines'", "'y'", 'i', 'j')} * 2 - 1) * 15 AS y FROM
 (SELECT DISTINCT CAST(ceil((cx - 60) / 30) AS BIGINT) + a AS i, CAST(ceil((cy - 60) / 30) AS BIGINT) + b AS j FROM bld, (SELECT unnest(range(0, 5)) AS a), (SELECT unnest(range(0, 5)) AS b) WHERE (ceil((cx - 60) / 30) + a) * 30 < cx + 60 AND (ceil((cy - 60) / 30) + b) * 30 < cy + 60)) s
 WHERE NOT EXISTS (SELECT 1 FROM bld WHERE {_SQ} <= 8) AND NOT EXISTS (SELECT 1 FROM seg WHERE {DIST} <= 8)""")
def _(t):
    box = t.bld.select((F.col("cx") - 60).alias("w"), (F.col("cy") - 60).alias("s"), (F.col("cx") + 60).alias("e"), (F.col("cy") + 60).alias("n"))
    return FL.tree_candidates(box, t.bld, t.segs).select("i", "j", r("x", 3).alias("x"), r("y", 3).alias("y"))


@query("P13_standing_trees")
def _(t):
    box = t.bld.select((F.col("cx") - 60).alias("w"), (F.col("cy") - 60).alias("s"), (F.col("cx") + 60).alias("e"), (F.col("cy") + 60).alias("n"))
    p = FL.tree_candidates(box, t.bld, t.segs)
    a, b = geo.planar_lnglat("cx", "cy")
    h = t.heights(t.bld.select(a.alias("lng"), b.alias("lat")), reach=12)
    return FL.standing_trees(p, h, geo.planar_lnglat, lowest=900.0).select("site_id", r("ground", 3).alias("ground"), r("slope_deg", 2).alias("slope"))


# ------------------------------------------------------- roads

_KIND = "regexp_replace(highway, '_link$', '')"
_LN = "CASE WHEN regexp_matches(coalesce(split_part(lanes, ';', 1), ''), '^[+-]?[0-9]+$') THEN CAST(split_part(lanes, ';', 1) AS INTEGER) ELSE CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RD.DEFAULT_LANES.items()) + " ELSE 2 END END"
_MW = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RD.MIN_WIDTH.items()) + " ELSE 3.0 END"
RT = f"""rt AS (SELECT *, greatest(lane_count * 3.1::DOUBLE, {_MW}) / 2 AS half, kind IN ('motorway', 'trunk', 'primary', 'secondary', 'tertiary') AS marked FROM (SELECT *, CAST({_LN} AS INTEGER) AS lane_count FROM (SELECT *, {_KIND} AS kind FROM road)))"""


def road_table(t):
    return RD.road_table(t.roads)


@query("E34_road_width", with_(ROAD, RT) + f"SELECT code, kind, lane_count, {rnd('half * 2', 4)} AS width FROM rt")
def _(t):
    return road_table(t).select("code", "kind", "lane_count", r(F.col("half") * 2, 4).alias("width"))


@query("E35_surface_keys", with_(ROAD, RT) + "SELECT code, CASE WHEN kind IN ('trunk', 'primary') THEN 'hex' WHEN kind IN ('secondary', 'tertiary') THEN 'brick' ELSE 'concrete' END AS paving, coalesce(surface = 'concrete', FALSE) AS concrete, CASE WHEN code % 4 = 0 THEN 'earth' WHEN code % 4 = 1 THEN 'gravel' WHEN code % 4 = 2 THEN 'setts' ELSE 'paving' END AS walk, CASE code % 5 WHEN 0 THEN 'stop' WHEN 1 THEN 'R' WHEN 2 THEN 'HM' WHEN 3 THEN 'W' ELSE 'R' END AS sign, CASE WHEN code % 3 = 0 THEN 8.0::DOUBLE WHEN code % 3 = 1 THEN 2.7 ELSE 1.8 END AS wall FROM rt")
def _(t):
    c = F.col("code")
    walk = F.element_at(F.array(*[F.lit(v) for v in ("dirt", "gravel", "sett", "asphalt")]), (c % 4 + 1).cast("int"))
    sign = F.element_at(F.array(F.lit(None).cast("string"), *[F.lit(v) for v in ("PH:R1-2", "PH:HM3;X", "W2", "Q1")]), (c % 5 + 1).cast("int"))
    wall = RD.wall_size(F.when(c % 3 == 2, "wall").otherwise("retaining_wall"), F.when(c % 3 == 0, "12 m"))
    return road_table(t).select("code", "paving", "concrete", RD.walk_surface(walk, F.lit("footway")).alias("walk"), RD.sign_class(F.when(c % 5 == 0, "stop"), sign).alias("sign"), wall["height"].alias("wall"))


_EG = lambda c, d: bilinear_sql(c, d)


@query("E36_steps", with_(PATH) + f"""SELECT code, CAST(least(greatest(1, greatest(round_even(abs(g1 - g0) / 0.17, 0), ceil(m / 0.5))), floor(m / 0.2) + 1) AS INTEGER) AS steps FROM (SELECT code, {rnd('sum(leg)', 6)} AS m, max(CASE WHEN i = 0 THEN g END) AS g0, max(CASE WHEN onward IS NULL THEN g END) AS g1, count(*) AS n FROM
 (SELECT *, {_EG('lng', 'lat')} AS g, CASE WHEN onward IS NOT NULL THEN {hav_km('lng', 'lat', 'onward', 'up', 6371000.0)} END AS leg FROM (SELECT *, lead(lng) OVER w AS onward, lead(lat) OVER w AS up FROM path WINDOW w AS (PARTITION BY code ORDER BY i))) GROUP BY code) WHERE n >= 2""")
def _(t):
    from upland.operators.raster import sample_bilinear
    g = F.col("line")
    ends = t.lines.where(F.size(g) >= 2).select("code", r(L.length_m("line"), 6).alias("m"), F.posexplode(F.array(g[0], F.element_at(g, -1))).alias("i", "p")).select("code", "m", "i", "p.*")
    at = sample_bilinear(ends, t.heights(ends), ["code", "i", "m"])
    d = at.groupBy("code", "m").agg(*[F.max(F.when(F.col("i") == i, F.col("ground"))).alias(f"g{i}") for i in (0, 1)])
    return d.select("code", RD.step_count("m", F.col("g1") - F.col("g0"), F.lit(None).cast("int")).alias("steps"))


_ENDS = """ends AS (SELECT floor(x * 100 + 0.5) / 100 AS jx, floor(y * 100 + 0.5) / 100 AS jy FROM (SELECT p.* FROM ppath p JOIN (SELECT code, max(i) AS m FROM ppath GROUP BY code) USING (code) WHERE i = 0 OR i = m) GROUP BY 1, 2 HAVING count(*) >= 2),
 jt AS (SELECT jx, jy FROM ends UNION SELECT floor(x * 100 + 0.5) / 100, floor(y * 100 + 0.5) / 100 FROM ppath WHERE i = 7 AND code % 2 = 0
  UNION SELECT floor(x * 100 + 0.5) / 100, floor(y * 100 + 0.5) / 100 FROM ppath p JOIN (SELECT code, max(i) AS m FROM ppath GROUP BY code) USING (code) WHERE i = m AND code % 3 = 0)"""


def joints(t):
    """Shared line ends, every second line's middle and every third line's end, so that most lines have a junction."""
    own = RD.planar_ends(t.planar_lines)
    q = lambda c: F.floor(F.col(c) * 100 + 0.5) / 100
    mid = t.planar_lines.where((F.col("code") % 2 == 0) & (F.size("line") > 7)).select(F.col("line")[7].alias("p")).select(q("p.x").alias("jx"), q("p.y").alias("jy"))
    end = t.planar_lines.where("code % 3 = 0").select(F.element_at("line", -1).alias("p")).select(q("p.x").alias("jx"), q("p.y").alias("jy"))
    return own.union(mid).union(end).distinct()


_POS = lambda every, off: f"(SELECT s.*, step, step * {every}::DOUBLE + {off} AS tpos FROM aseg s, (SELECT unnest(range(0, 400)) AS step)) WHERE len > 0 AND tpos >= start AND tpos < start + len"
_AT = "ax + (tpos - start) / len * (bx - ax) AS x, ay + (tpos - start) / len * (by - ay) AS y, (bx - ax) / len AS ux, (by - ay) / len AS uy"
_TOTAL = "tot AS (SELECT code, sum(len) AS total FROM seg GROUP BY code)"


@query("E37_edge_marks", with_(SEG, ROAD, RT, _ENDS, _TOTAL) + f"""SELECT code, CAST(step AS BIGINT) AS step, side, {rnd('x - uy * side * (half - 0.3)', 2)} AS x, {rnd('y + ux * side * (half - 0.3)', 2)} AS y FROM (SELECT code, step, tpos, {_AT} FROM {_POS(8.0, 4)}) JOIN rt USING (code) JOIN tot USING (code), (VALUES (-1), (1)) v(side)
 WHERE marked AND tpos < total - 4 AND NOT EXISTS (SELECT 1 FROM jt WHERE pow(x - jx, 2) + pow(y - jy, 2) <= 144)""")
def _(t):
    return RD.edge_marks(road_table(t), joints(t)).select("code", "step", "side", r("x", 2).alias("x"), r("y", 2).alias("y"))


@query("E37_lane_dividers", with_(SEG, ROAD, RT, _ENDS, _TOTAL) + f"""SELECT code, CAST(step AS BIGINT) AS step, CAST(lane AS INTEGER) AS lane FROM (SELECT *, x - uy * sh AS mx, y + ux * sh AS my FROM (SELECT *, -half + lane * 2 * half / lane_count AS sh FROM (SELECT code, step, tpos, {_AT} FROM {_POS(8.0, 2)}) JOIN rt USING (code) JOIN tot USING (code), (SELECT unnest(range(1, 6)) AS lane)
 WHERE marked AND oneway AND lane_count >= 2 AND lane < lane_count AND tpos < total - 3)) WHERE NOT EXISTS (SELECT 1 FROM jt WHERE pow(mx - jx, 2) + pow(my - jy, 2) <= 144)""")
def _(t):
    return RD.lane_marks(road_table(t), joints(t)).where("style = 'divider'").select("code", "step", "lane")


_BENDS = f"""mk AS (SELECT code, step, tpos, total, x, y FROM (SELECT code, step, tpos, {_AT} FROM {_POS(4.0, 2)}) JOIN rt USING (code) JOIN tot USING (code) WHERE marked AND lane_count >= 2 AND NOT oneway AND tpos < total - 2),
 look AS (SELECT code, step, k, CASE k WHEN 1 THEN greatest(0, back - 1) WHEN 2 THEN least(total, back + 1) WHEN 3 THEN greatest(0, ahead - 1) ELSE least(total, ahead + 1) END AS tt FROM (SELECT *, greatest(0, tpos - 10) AS back, least(total, tpos + 14) AS ahead FROM mk), (VALUES (1), (2), (3), (4)) v(k)),
 spot4 AS (SELECT code, step, k, ax + (tt - start) / len * (bx - ax) AS px, ay + (tt - start) / len * (by - ay) AS py FROM look JOIN (SELECT *, lead(start) OVER (PARTITION BY code ORDER BY seg) AS onward FROM aseg) USING (code) WHERE tt >= start AND (onward IS NULL OR tt < onward)),
 bend AS (SELECT code, step, atan2(y4 - y3, x4 - x3) - atan2(y2 - y1, x2 - x1) + pi() AS d FROM (SELECT code, step, {', '.join(f'max(CASE WHEN k = {k} THEN p{c} END) AS {c}{k}' for k in (1, 2, 3, 4) for c in 'xy')} FROM spot4 GROUP BY code, step))"""


@query("E37_centre_marks", with_(SEG, ROAD, RT, _ENDS, _TOTAL, _BENDS) + """SELECT code, style, count(*) AS n FROM (SELECT code, CASE WHEN degrees(abs(d - 2 * pi() * floor(d / (2 * pi())) - pi())) > 12 THEN 'solid' WHEN floor(tpos / 4) % 2 = 0 THEN 'broken' END AS style FROM mk JOIN bend USING (code, step)
 WHERE NOT EXISTS (SELECT 1 FROM jt WHERE pow(x - jx, 2) + pow(y - jy, 2) <= 144)) WHERE style IS NOT NULL GROUP BY code, style""")
def _(t):
    d = RD.lane_marks(road_table(t), joints(t)).where("style <> 'divider'")
    return d.groupBy("code", "style").agg(F.count("*").alias("n"))


@query("E37_stop_bars", with_(SEG, ROAD, RT, _ENDS, _TOTAL, "tip AS (SELECT code, 'start' AS a, x AS tx, y AS ty FROM ppath WHERE i = 0 UNION ALL SELECT code, 'end', x, y FROM ppath JOIN (SELECT code, max(i) AS i FROM ppath GROUP BY code) USING (code, i))") + f"""SELECT code, a AS "at", {rnd('ax + sh * (bx - ax) - (by - ay) / len * mid', 2)} AS x, {rnd('ay + sh * (by - ay) + (bx - ax) / len * mid', 2)} AS y FROM
 (SELECT *, (tpos - start) / len AS sh, CASE WHEN oneway THEN 0.0::DOUBLE WHEN a = 'end' THEN (-half + 0.3::DOUBLE) / 2 ELSE (half - 0.3::DOUBLE) / 2 END AS mid FROM (SELECT s.*, a, half, oneway, CASE WHEN a = 'end' THEN total - 7 ELSE 7.0::DOUBLE END AS tpos FROM aseg s JOIN tot USING (code) JOIN rt USING (code), (VALUES ('end'), ('start')) v(a) WHERE marked AND total >= 20 AND (a = 'end' OR NOT oneway)) WHERE tpos >= start AND tpos < start + len)
 JOIN tip USING (code, a) WHERE EXISTS (SELECT 1 FROM jt WHERE pow(tx - jx, 2) + pow(ty - jy, 2) <= 144)""")
def _(t):
    return RD.stop_bars(road_table(t), joints(t)).select("code", "at", r("x", 2).alias("x"), r("y", 2).alias("y"))


_LAMP = "lamp AS (SELECT vid AS lamp_id, x, y FROM pven WHERE vid % 4 = 1)"


def mapped_lamps(t):
    return pven(t).where("vid % 4 = 1").select(F.col("vid").alias("lamp_id"), "x", "y")


@query("E38_lamp_sites", with_(PVEN, SEG, ROAD, RT, _ENDS, _LAMP) + f"""SELECT source, count(*) AS n, {rnd('sum(x) / count(*)', 2)} AS mean_x FROM (SELECT 'row' AS source, px AS x FROM (SELECT x - uy * o AS px, y + ux * o AS py FROM (SELECT *, CASE WHEN step % 2 = 0 THEN 1 ELSE -1 END * (half + 0.6) AS o FROM (SELECT code, step, {_AT} FROM {_POS(32.0, 16)}) JOIN rt USING (code) WHERE marked))
 WHERE NOT EXISTS (SELECT 1 FROM jt WHERE pow(px - jx, 2) + pow(py - jy, 2) <= 144) AND NOT EXISTS (SELECT 1 FROM lamp WHERE pow(px - lamp.x, 2) + pow(py - lamp.y, 2) <= 225) UNION ALL SELECT 'mapped', x FROM lamp) GROUP BY source""")
def _(t):
    d = RD.lamp_sites(road_table(t), joints(t), mapped_lamps(t))
    return d.groupBy("source").agg(F.count("*").alias("n"), r(F.sum("x") / F.count("*"), 2).alias("mean_x"))


_WHAT = "CASE vid % 3 WHEN 0 THEN 'crossing' WHEN 1 THEN 'signal' ELSE 'sign' END"


@query("E39_furniture", with_(PVEN, SEG, ROAD, RT) + f"""SELECT what, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY floor(d * 1000 + 0.5), code, seg) AS rn FROM (SELECT vid, {_WHAT} AS what, code, seg, {DIST} AS d FROM pven, aseg)) , (VALUES (0), (1)) v(copy) WHERE rn = 1 AND (what <> 'crossing' OR d <= 3) AND (copy = 0 OR what = 'signal') GROUP BY what""")
def _(t):
    n = pven(t).select(F.col("vid").alias("node_id"), F.expr(_WHAT).alias("what"), "x", "y")
    return RD.furniture(n, road_table(t)).groupBy("what").agg(F.count("*").alias("n"))


@query("J16_frontage")
def _(t):
    v = t.bld.select(F.explode("ring").alias("p")).select(F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    return RD.frontage(RD.chunks(road_table(t)), v).select("code", "chunk", "seg", "side")


@query("J28_parallel_stairs", with_(PVEN, SEG, ROAD, RT) + f"""SELECT vid, d <= half + 5.57 AND degrees(acos(least(1, abs(((bx - ax) * 3 + (by - ay) * 4) / len / 5)))) <= 30 AS along FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY floor(d * 1000 + 0.5), code, seg) AS rn FROM (SELECT *, {DIST} AS d FROM pven, aseg)) JOIN rt USING (code) WHERE rn = 1""")
def _(t):
    s = pven(t).select(F.col("vid").alias("stair_id"), "x", "y", (F.col("x") - 1.5).alias("sx0"), (F.col("y") - 2).alias("sy0"), (F.col("x") + 1.5).alias("sx1"), (F.col("y") + 2).alias("sy1"))
    return RD.parallel_stairs(s, road_table(t)).select(F.col("stair_id").alias("vid"), "along")


@query("P5_road_table", with_(SEG, ROAD, RT, _TOTAL) + f"SELECT code, kind, street, lane_count, oneway, {rnd('half', 3)} AS half, {rnd('total', 2)} AS metres FROM rt JOIN tot USING (code)")
def _(t):
    length = t.segs.groupBy("code").agg(F.sum("len").alias("total"))
    return road_table(t).join(length, "code").select("code", "kind", "street", "lane_count", "oneway", r("half", 3).alias("half"), r("total", 2).alias("metres"))


@query("P6_paved_cells")
def _(t):
    return RD.paved_masks(road_table(t), t.bld).groupBy("paving").agg(F.sum(F.bit_count("mask").cast("long")).alias("cells"))


@query("P6_people_sites")
def _(t):
    return RD.people_sites(RD.paved_masks(road_table(t), t.bld)).select("gx", "gy", "paving", r("x", 3).alias("x"), r("y", 3).alias("y"))


def twin_roads(t):
    """Every line twice over its whole length, a carriageway and its twin 12 m beside it, both one-way."""
    base = road_table(t).withColumn("half", F.lit(3.1)).withColumn("oneway", F.lit(True))
    twin = base.withColumn("code", -F.col("code") - 1).withColumn("line", F.transform("line", lambda p: F.struct((p["x"] + 12).alias("x"), (p["y"] + 12).alias("y"))))
    return base.unionByName(twin)


# Cells of all segments and their twins, grouped by runs along a column of cells: a run that touches one beside it takes
# the lesser number until none changes.
_TWIN = """tseg AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay)) AS tlen FROM (SELECT ax, ay, bx, by FROM seg UNION ALL SELECT ax + 12, ay + 12, bx + 12, by + 12 FROM seg) WHERE ax <> bx OR ay <> by),
 spot AS (SELECT *, gx + 0.5::DOUBLE AS x, gy + 0.5::DOUBLE AS y FROM (SELECT *, unnest(range(CAST(floor(least(ay, by) - 12) AS BIGINT), CAST(floor(greatest(ay, by) + 12) AS BIGINT) + 1)) AS gy FROM (SELECT *, unnest(range(CAST(floor(least(ax, bx) - 12) AS BIGINT), CAST(floor(greatest(ax, bx) + 12) AS BIGINT) + 1)) AS gx FROM tseg))),
 band AS (SELECT gx, gy, side, (bx - ax) / tlen AS ux, (by - ay) / tlen AS uy FROM (SELECT *, ((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / tlen AS off, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / tlen AS along FROM spot), (VALUES (1), (-1)) v(side) WHERE off * side >= 3.1 AND off * side < 11.1 AND along >= 0 AND along <= tlen),
 facing AS (SELECT gx, gy, bit_or(1 << CAST(floor(((degrees(atan2(-ux * side, uy * side)) + 360) % 360) / 45) AS INTEGER)) AS seen FROM band GROUP BY gx, gy),
 lane AS (SELECT DISTINCT gx, gy FROM (SELECT *, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / (tlen * tlen))) AS t FROM spot) WHERE sqrt(pow(x - (ax + t * (bx - ax)), 2) + pow(y - (ay + t * (by - ay)), 2)) <= 3.1),
 isl AS (SELECT gx, gy, gy - row_number() OVER (PARTITION BY gx ORDER BY gy) AS gap FROM (SELECT gx, gy FROM facing WHERE (seen & (seen << 3)) > 0 OR (seen & (seen << 4)) > 0 OR (seen & (seen << 5)) > 0) ANTI JOIN lane USING (gx, gy)),
 run AS (SELECT row_number() OVER (ORDER BY gx, lo) AS id, * FROM (SELECT gx, gap, min(gy) AS lo, max(gy) AS hi FROM isl GROUP BY gx, gap)),
 touch AS MATERIALIZED (SELECT a.id AS a, b.id AS b, least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1 AS shared FROM run a JOIN run b ON b.gx = a.gx + 1 AND a.lo <= b.hi AND b.lo <= a.hi),
 beside AS MATERIALIZED (SELECT a, b FROM touch UNION ALL SELECT b, a FROM touch),
 grp(id, root) USING KEY (id) AS (SELECT id, id FROM run UNION SELECT b, min(n.root) FROM grp n JOIN beside ON a = n.id JOIN recurring.grp k ON k.id = b WHERE n.root < k.root GROUP BY b),
 tag AS (SELECT g.id, lpad(CAST(r.gx + 1000000000 AS VARCHAR), 12, '0') || ',' || lpad(CAST(r.lo + 1000000000 AS VARCHAR), 12, '0') AS label FROM grp g JOIN run r ON r.id = g.root),
 on_ AS (SELECT DISTINCT gx, gy FROM (SELECT cx, cy, side, gx, unnest(range(CAST(floor(cy - side / 2) AS BIGINT), CAST(floor(cy + side / 2) AS BIGINT) + 1)) AS gy FROM (SELECT *, unnest(range(CAST(floor(cx - side / 2) AS BIGINT), CAST(floor(cx + side / 2) AS BIGINT) + 1)) AS gx FROM bld)) WHERE abs(gx + 0.5 - cx) < side / 2 AND abs(gy + 0.5 - cy) < side / 2),
 cel AS (SELECT label, gx, gy FROM isl JOIN run USING (gx, gap) JOIN tag USING (id)),
 grown AS (SELECT label, area, coalesce(built, 0) AS built, 4 * area - 2 * inner_ - 2 * coalesce(across, 0) AS perimeter FROM (SELECT label, CAST(sum(hi - lo + 1) AS BIGINT) AS area, CAST(sum(hi - lo) AS BIGINT) AS inner_ FROM run JOIN tag USING (id) GROUP BY label)
  LEFT JOIN (SELECT label, CAST(sum(shared) AS BIGINT) AS across FROM touch JOIN tag ON tag.id = a GROUP BY label) USING (label) LEFT JOIN (SELECT label, count(*) AS built FROM cel JOIN on_ USING (gx, gy) GROUP BY label) USING (label)),
 island AS (SELECT * FROM grown WHERE area >= 15 AND built <= 0.05 * area AND perimeter / 2 > 20 AND (perimeter / 2) * (perimeter / 2) / area > 8)"""
_ISLANDS = with_(SEG, BLD, _TWIN).replace("WITH ", "WITH RECURSIVE ", 1)


@query("P7_islands", _ISLANDS + "SELECT label, area, built, CAST(perimeter AS BIGINT) AS perimeter FROM island")
def _(t):
    return RD.islands(connected_masks(RD.island_masks(twin_roads(t)), G.cell_masks(t.bld))).select("label", "area", "built", "perimeter")


@query("P7_island_sites", _ISLANDS + """SELECT label, CASE WHEN wide THEN k ELSE m END AS gx, CASE WHEN wide THEN m ELSE k END AS gy, CASE WHEN k % 24 = 0 THEN 'lamp' WHEN k % 12 = 0 THEN 'tree' ELSE 'shrub' END AS kind
 FROM (SELECT label, wide, CASE WHEN wide THEN gx ELSE gy END AS k, CAST(floor(avg(CASE WHEN wide THEN gy ELSE gx END)) AS BIGINT) AS m FROM (SELECT *, max(gx) OVER w - min(gx) OVER w >= max(gy) OVER w - min(gy) OVER w AS wide FROM cel JOIN island USING (label) WINDOW w AS (PARTITION BY label)) GROUP BY ALL) WHERE k % 3 = 0""")
def _(t):
    cells = connected_masks(RD.island_masks(twin_roads(t)), G.cell_masks(t.bld))
    return RD.island_sites(cells, RD.islands(cells))


_COVER = """useg AS (SELECT code, ax, ay, bx, by, kind, coalesce(surface = 'concrete', FALSE) AS concrete, 0 AS walk FROM seg JOIN rt USING (code) UNION ALL SELECT code, ax + 12, ay + 12, bx + 12, by + 12, kind, coalesce(surface = 'concrete', FALSE), 0 FROM seg JOIN rt USING (code)
  UNION ALL SELECT code, ax + 25, ay - 9, bx + 25, by - 9, kind, FALSE, 1 FROM seg JOIN rt USING (code) WHERE code % 7 = 3),
 uspot AS (SELECT *, gx + 0.5::DOUBLE AS x, gy + 0.5::DOUBLE AS y, sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay)) AS ulen FROM (SELECT *, unnest(range(CAST(floor(least(ay, by) - 9) AS BIGINT), CAST(floor(greatest(ay, by) + 9) AS BIGINT) + 1)) AS gy FROM (SELECT *, unnest(range(CAST(floor(least(ax, bx) - 9) AS BIGINT), CAST(floor(greatest(ax, bx) + 9) AS BIGINT) + 1)) AS gx FROM useg WHERE ax <> bx OR ay <> by))),
 umeet AS (SELECT gx, gy, code, kind, concrete, walk, ulen, abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / ulen AS off, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ulen AS along, sqrt(pow(x - (ax + t * (bx - ax)), 2) + pow(y - (ay + t * (by - ay)), 2)) AS far FROM (SELECT *, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / (ulen * ulen))) AS t FROM uspot)),
 ulayer AS (SELECT gx, gy, CASE WHEN concrete THEN 1 ELSE 0 END AS rank FROM umeet WHERE walk = 0 AND far <= 3.1 UNION ALL SELECT gx, gy, 2 FROM cel JOIN island USING (label)
  UNION ALL SELECT gx, gy, CASE WHEN kind IN ('trunk', 'primary') THEN 3 WHEN kind IN ('secondary', 'tertiary') THEN 4 ELSE 5 END FROM umeet WHERE walk = 0 AND kind IN ('trunk', 'primary', 'secondary', 'tertiary', 'unclassified', 'residential', 'living_street') AND off >= 3.1 AND off < 3.1::DOUBLE + 5.57::DOUBLE AND along >= 0 AND along <= ulen
  UNION ALL SELECT gx, gy, CASE WHEN code % 2 = 0 THEN 6 ELSE 7 END FROM umeet WHERE walk = 1 AND far <= 1.2),
 ubest AS MATERIALIZED (SELECT gx, gy, min(rank) AS rank FROM ulayer WHERE rank < 3 OR NOT EXISTS (SELECT 1 FROM on_ WHERE on_.gx = ulayer.gx AND on_.gy = ulayer.gy) GROUP BY gx, gy),
 unear AS (SELECT c.gx, c.gy, c.rank, count(n.rank) FILTER (WHERE n.rank = 2) AS own, count(n.rank) FILTER (WHERE n.rank < 2) AS road FROM ubest c, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) v(dx, dy) LEFT JOIN ubest n ON n.gx = c.gx + dx AND n.gy = c.gy + dy GROUP BY c.gx, c.gy, c.rank)"""
_LAYERS = ("asphalt", "concrete", "median", "hex", "brick", "paving", "walk", "trail")


@query("U6_layered_cover", with_(SEG, BLD, ROAD, RT, _TWIN, _COVER).replace("WITH ", "WITH RECURSIVE ", 1) + f"""SELECT gx // 64 - CASE WHEN gx < 0 AND gx % 64 <> 0 THEN 1 ELSE 0 END AS tx, gy // 64 - CASE WHEN gy < 0 AND gy % 64 <> 0 THEN 1 ELSE 0 END AS ty, CASE WHEN rank = 2 AND own < 4 THEN 'median kerb' WHEN rank IN (3, 4, 5) AND road > 0 THEN 'kerb' ELSE [{', '.join(f"'{n}'" for n in _LAYERS)}][CAST(rank + 1 AS INTEGER)] END AS layer, count(*) AS cells FROM unear GROUP BY 1, 2, 3""")
def _(t):
    """Carriageways with their twins, centre islands, sidewalks by paving and walks, each where earlier ones left room, with
    kerbs around islands and along roads; out of buildings but for roads and islands."""
    roads, shapes = twin_roads(t), G.cell_masks(t.bld)
    lanes = written(RD.carriageway_masks(roads, "concrete"))
    isles = connected_masks(RD.island_masks(roads, lanes.groupBy("gy", "word").agg(F.bit_or("mask").alias("mask"))), shapes)
    medians = isles.join(RD.islands(isles).select("root"), "root", "left_semi")
    sided = roads.where(F.col("kind").isin(*RD.SIDE_KINDS)).groupBy("line", "half", "paving").agg(F.min("code").alias("code"))
    sides = L.segments(sided, "code").where("len > 0").withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    bands = written(RD.paving_words(sides))
    band = lambda p: bands.select("gy", "word", F.col(p).alias("mask")).where("mask IS NOT NULL")
    walks = road_table(t).where("code % 7 = 3").withColumn("even", F.col("code") % 2 == 0).withColumn("half", F.lit(1.2)).withColumn("line", F.transform("line", lambda p: F.struct((p["x"] + 25).alias("x"), (p["y"] - 9).alias("y"))))
    paths = written(RD.carriageway_masks(walks, "even"))
    layers = [("asphalt", lanes.where("NOT concrete")), ("concrete", lanes.where("concrete")), ("median", medians),
              *[(name, band(p)) for name, p in (("hex", "hex"), ("brick", "brick"), ("paving", "concrete"))],
              ("walk", paths.where("even")), ("trail", paths.where("NOT even"))]
    d = layered_masks(layers, shapes, ("hex", "brick", "paving", "walk", "trail"), (("median kerb", ("median",), None), ("kerb", ("hex", "brick", "paving"), ("asphalt", "concrete"))))
    return d.groupBy(F.col("word").alias("tx"), F.floor(F.col("gy") / 64).cast("long").alias("ty"), "layer").agg(F.sum(F.bit_count("mask").cast("long")).alias("cells"))


# ---------------------------------------------- districts

_NAMES = ("jollibee session", "McDonald''s Plaza", "Cafe Luz", "BDO Main", "Night Market")
_KINDS = ("fast_food", "cafe", "bank", "shop")


def pois(t):
    at = lambda values, n: F.element_at(F.array(*[F.lit(v.replace("''", "'")) for v in values]), (F.expr(n) + 1).cast("int"))
    d = t.raw("customer").select(F.col("c_custkey").alias("poi_id"), at(_NAMES, "c_custkey % 5").alias("name"), at(_KINDS, "c_custkey % 4").alias("kind"), F.expr(f"c_custkey * 7 % {200}").alias("k"))
    x, y = geo.planar_xy(F.expr(lng("k")), F.expr(lat("k")))
    return d.select("poi_id", "name", "kind", (x + (F.col("poi_id") % 9) * 3).alias("x"), (y + (F.col("poi_id") % 5) * 2).alias("y"))


POI = f"""poi AS (SELECT c_custkey AS poi_id, [{', '.join(f"'{n}'" for n in _NAMES)}][CAST(1 + c_custkey % 5 AS INTEGER)] AS name, [{', '.join(f"'{n}'" for n in _KINDS)}][CAST(1 + c_custkey % 4 AS INTEGER)] AS kind,
  {px_sql(lng('(c_custkey * 7 % 200)'))} + (c_custkey % 9) * 3 AS x, {py_sql(lat('(c_custkey * 7 % 200)'))} + (c_custkey % 5) * 2 AS y FROM customer)"""
_DISP = "CASE WHEN lower(name) LIKE 'jollibee%' THEN 'Jollibee' WHEN lower(name) LIKE 'mcdonald%' THEN 'McDonald''s' WHEN lower(name) LIKE 'bdo%' THEN 'BDO' ELSE name END"


@query("E43_display_name", with_(POI) + f"SELECT poi_id, {_DISP} AS text, CASE WHEN {_DISP} = 'McDonald''s' THEN 'chain:McDonald' WHEN {_DISP} IN ('Jollibee', 'BDO') THEN 'chain:' || {_DISP} ELSE 'kind:' || kind END AS colour FROM poi")
def _(t):
    return pois(t).select("poi_id", DI.display_name("name").alias("text"), DI.colour_key("name", "kind").alias("colour"))


_KORD = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(DI.KIND_ORDER)) + " END"


@query("J12_assign_signs", with_(BLD, POI) + f"""SELECT bid, text, kind, poi_id, CAST(row_number() OVER (PARTITION BY bid ORDER BY {_KORD}, a) AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY bid ORDER BY poi_id) AS a FROM (SELECT *, row_number() OVER (PARTITION BY bid, text ORDER BY poi_id) AS f FROM
 (SELECT *, {_DISP} AS text, row_number() OVER (PARTITION BY poi_id ORDER BY floor(d * 1000 + 0.5), bid) AS rn FROM (SELECT poi.*, bid, {_SQ} AS d FROM poi, bld) WHERE d <= 8) WHERE rn = 1) WHERE f = 1) WHERE a <= 4""")
def _(t):
    return DI.assign_signs(pois(t), t.bld).select("bid", "text", "kind", "poi_id", "position")


_AREA13 = "ma AS (SELECT p_partkey AS aid, {x} + (p_partkey % 4) * 3 AS rx, {y} + (p_partkey % 3) * 3 AS ry, 6.0 + p_size % 20 AS h FROM part)".format(x=px_sql(lng("p_partkey")), y=py_sql(lat("p_partkey")))


def match_polys(t):
    x, y = geo.planar_xy(F.expr(lng("p_partkey")), F.expr(lat("p_partkey")))
    d = t.raw("part").select(F.col("p_partkey").alias("aid"), (x + F.expr("(p_partkey % 4) * 3")).alias("rx"), (y + F.expr("(p_partkey % 3) * 3")).alias("ry"), F.expr("6.0D + p_size % 20").alias("h"))
    h = F.col("h")
    ring = F.array(*[F.struct((F.col("rx") + a * h).alias("x"), (F.col("ry") + b * h).alias("y")) for a, b in [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]])
    return d.withColumn("aedges", G.edges(ring)).select("*", (F.col("rx") - h).alias("west"), (F.col("ry") - h).alias("south"), (F.col("rx") + h).alias("east"), (F.col("ry") + h).alias("north"))


_INC = lambda lo, hi: f"greatest(0, floor({hi} - 0.5) - ceil({lo} - 0.5) + 1)"


@query("J13_match_area", with_(BLD, _AREA13) + f"""SELECT aid, bid, CAST(i AS BIGINT) AS inside, CAST(n AS BIGINT) AS cells FROM (SELECT aid, bid, {_INC('greatest(cx - side / 2, rx - h)', 'least(cx + side / 2, rx + h)')} * {_INC('greatest(cy - side / 2, ry - h)', 'least(cy + side / 2, ry + h)')} AS i, {_INC('cx - side / 2', 'cx + side / 2')} * {_INC('cy - side / 2', 'cy + side / 2')} AS n FROM ma, bld) WHERE i > 0.5 * n""")
def _(t):
    return DI.match_areas(match_polys(t), t.bld).select("aid", "bid", "inside", "cells")


_SSEG = "sqrt(pow(greatest(abs({x} - cx) - side / 2, 0), 2) + pow(greatest(abs({y} - cy) - side / 2, 0), 2))"


def _sd(p, a, b):
    """SQL distance of place p from the segment a to b, each given by its column prefix."""
    t = f"greatest(0, least(1, coalesce((({p}x - {a}x) * ({b}x - {a}x) + ({p}y - {a}y) * ({b}y - {a}y)) / nullif(pow({b}x - {a}x, 2) + pow({b}y - {a}y, 2), 0), 0)))"
    return f"sqrt(pow({p}x - ({a}x + {t} * ({b}x - {a}x)), 2) + pow({p}y - ({a}y + {t} * ({b}y - {a}y)), 2))"


_TURN_OF = lambda p, a, b: f"sign(({b}x - {a}x) * ({p}y - {a}y) - ({b}y - {a}y) * ({p}x - {a}x))"
_SIDES = """side4 AS (SELECT bid, cx - side / 2 AS w, cx + side / 2 AS e, cy - side / 2 AS s, cy + side / 2 AS n, cx + c.ax * side / 2 AS cx, cy + c.ay * side / 2 AS cy, cx + c.bx * side / 2 AS dx, cy + c.by * side / 2 AS dy FROM (SELECT *, unnest([{'ax': -1, 'ay': -1, 'bx': 1, 'by': -1}, {'ax': 1, 'ay': -1, 'bx': 1, 'by': 1}, {'ax': 1, 'ay': 1, 'bx': -1, 'by': 1}, {'ax': -1, 'ay': 1, 'bx': -1, 'by': -1}]) AS c FROM bld))"""


@query("J27_adjacent_road", with_(BLD, SEG, _SIDES) + f"""SELECT bid, code AS road, {rnd('gap', 3)} AS road_m FROM (SELECT *, row_number() OVER (PARTITION BY bid ORDER BY floor(gap * 1000 + 0.5), code, seg) AS rn FROM (SELECT bid, code, seg, min(CASE WHEN {_TURN_OF('c', 'a', 'b')} * {_TURN_OF('d', 'a', 'b')} < 0 AND {_TURN_OF('a', 'c', 'd')} * {_TURN_OF('b', 'c', 'd')} < 0 THEN 0.0::DOUBLE ELSE least({_sd('c', 'a', 'b')}, {_sd('d', 'a', 'b')}, {_sd('a', 'c', 'd')}, {_sd('b', 'c', 'd')}) END) AS gap
 FROM side4 JOIN seg ON least(ax, bx) <= e + 40 AND greatest(ax, bx) >= w - 40 AND least(ay, by) <= n + 40 AND greatest(ay, by) >= s - 40 GROUP BY bid, code, seg) WHERE gap <= 40) WHERE rn = 1""")
def _(t):
    return DI.adjacent_road(t.bld, t.segs).select("bid", "road", r("road_m", 3).alias("road_m"))


@query("P8_street_front", with_(BLD, SEG, ROAD) + f"""SELECT bid, street, code, {rnd('d', 3)} AS metres, CAST(ntile(4) OVER (PARTITION BY street ORDER BY code, along, bid) AS INTEGER) AS part, CASE WHEN building IN ('apartments', 'house') OR {sha8("(oid || 'flats')")} % 100 < 55 THEN 'apartment' ELSE 'commercial' END AS kind FROM
 (SELECT *, row_number() OVER (PARTITION BY bid, street ORDER BY d, code, seg) AS rn, start + ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / len AS along FROM (SELECT *, {DIST} AS d FROM (SELECT *, cx AS x, cy AS y FROM bld WHERE side * side >= 12), (SELECT aseg.*, street FROM aseg JOIN road USING (code))) WHERE d <= 60) WHERE rn = 1""")
def _(t):
    s = t.segs.join(t.roads.select("code", "street"), "code")
    d = DI.street_front(t.bld, s, t.roads.select("street"), 60.0)
    return d.select("bid", "street", "code", r("dist", 3).alias("metres"), "part", "kind")


@query("P9_hotels")
def _(t):
    a, b = geo.planar_lnglat("cx", "cy")
    blds = t.bld.withColumn("lng", a).withColumn("lat", b)
    d = DI.hotel_buildings(pois(t), match_polys(t), blds, t.segs)
    return d.select("bid", "hotel", "road", "z", "x", "y")


_LM = "lm AS (SELECT s_suppkey AS lid, {x} AS lx, {y} AS ly FROM supplier)".format(x=px_sql(lng("s_suppkey")), y=py_sql(lat("s_suppkey")))


def landmarks(t):
    x, y = geo.planar_xy(F.expr(lng("s_suppkey")), F.expr(lat("s_suppkey")))
    return t.raw("supplier").select(F.col("s_suppkey").alias("lid"), x.alias("lx"), y.alias("ly"))


@query("P10_landmark_candidates", with_(BLD, _LM) + f"SELECT lid, bid, {rnd('side * side', 3)} AS area FROM lm, bld WHERE {_SSEG.format(x='lx', y='ly')} <= 250")
def _(t):
    return DI.landmark_candidates(landmarks(t), t.bld).select("lid", "bid", r("area", 3).alias("area"))


@query("P10_corridor", with_(SEG, _LM) + f"""SELECT lid, code, {rnd('sum(greatest(0, least(len, tt + hh) - greatest(0, tt - hh)))', 2)} AS metres FROM (SELECT *, sqrt(greatest(0, 62500 - off * off)) AS hh FROM (SELECT *, ((lx - ax) * (bx - ax) + (ly - ay) * (by - ay)) / len AS tt, ((lx - ax) * (by - ay) - (ly - ay) * (bx - ax)) / len AS off FROM seg, lm ) WHERE abs(off) < 250) WHERE greatest(0, least(len, tt + hh) - greatest(0, tt - hh)) > 0 GROUP BY lid, code""")
def _(t):
    return DI.corridor(t.segs, landmarks(t), 250.0).where("metres > 0").select("lid", "code", r("metres", 2).alias("metres"))


_FRONT = f"""ray AS (SELECT code, step, side, x, y, -uy * side AS nx, ux * side AS ny FROM (SELECT code, step, tpos, {_AT} FROM {_POS(5.0, 5)}) JOIN tot USING (code), (VALUES (1), (-1)) v(side) WHERE tpos < total - 5),
 wall AS (SELECT cx - side / 2 AS w, cx + side / 2 AS e, cy - side / 2 AS s, cy + side / 2 AS n, unnest([{{'ax': -1, 'ay': -1, 'bx': 1, 'by': -1}}, {{'ax': 1, 'ay': -1, 'bx': 1, 'by': 1}}, {{'ax': 1, 'ay': 1, 'bx': -1, 'by': 1}}, {{'ax': -1, 'ay': 1, 'bx': -1, 'by': -1}}]) AS c, cx, cy, side / 2 AS h FROM bld),
 edge AS (SELECT w, e, s, n, cx + c.ax * h AS ax, cy + c.ay * h AS ay, cx + c.bx * h AS bx, cy + c.by * h AS by FROM wall),
 shot AS (SELECT code, side, step, min(far) AS front_m FROM (SELECT code, side, step, ((ax - x) * (by - ay) - (ay - y) * (bx - ax)) / den AS far, ((ax - x) * ny - (ay - y) * nx) / den AS u FROM (SELECT *, nx * (by - ay) - ny * (bx - ax) AS den FROM ray JOIN edge ON w <= greatest(x, x + nx * 25) AND e >= least(x, x + nx * 25) AND s <= greatest(y, y + ny * 25) AND n >= least(y, y + ny * 25)) WHERE abs(den) > 1e-12) WHERE u >= 0 AND u <= 1 AND far >= 0 AND far <= 25 GROUP BY code, side, step),
 front AS (SELECT code, side, quantile_cont(front_m, 0.5) AS m, count(*) AS samples FROM shot GROUP BY code, side)"""


@query("P11_street_front", with_(SEG, BLD, _TOTAL, _FRONT) + f"SELECT code, side, {rnd('m', 3)} AS front_m, {rnd('width', 3)} AS width_m, samples FROM front JOIN (SELECT code, CASE WHEN count(*) = 2 THEN sum(m) END AS width FROM front GROUP BY code) USING (code)")
def _(t):
    return DI.street_measures(t.segs, t.bld).select("code", "side", r("front_m", 3).alias("front_m"), r("width_m", 3).alias("width_m"), "samples")


_GAP = f"""tseg AS (SELECT code, ax, ay, bx, by, len FROM seg UNION ALL SELECT -code - 1, ax + 12, ay + 12, bx + 12, by + 12, len FROM seg),
 spots AS (SELECT code, step, {_AT} FROM {_POS(3.0, 0)}),
 gap AS (SELECT code, step, min(d) AS d FROM (SELECT code, step, sqrt(pow(x - (ax + t * (bx - ax)), 2) + pow(y - (ay + t * (by - ay)), 2)) AS d FROM (SELECT p.code, step, x, y, q.ax, q.ay, q.bx, q.by, greatest(0, least(1, coalesce(((x - q.ax) * (q.bx - q.ax) + (y - q.ay) * (q.by - q.ay)) / nullif(pow(q.bx - q.ax, 2) + pow(q.by - q.ay, 2), 0), 0))) AS t
  FROM spots p JOIN tseg q ON q.code <> p.code AND x >= least(q.ax, q.bx) - 15 AND x <= greatest(q.ax, q.bx) + 15 AND y >= least(q.ay, q.by) - 15 AND y <= greatest(q.ay, q.by) + 15)) WHERE d <= 15 GROUP BY code, step)"""


@query("P11_carriageway_gap", with_(SEG, ROAD, RT, _GAP) + f"SELECT code, {rnd('m', 3)} AS gap_m, samples, floor((m - 1.0) / lane_count * 100 + 0.5) / 100 AS lane_m FROM (SELECT code, quantile_cont(d, 0.5) AS m, count(*) AS samples FROM gap GROUP BY code) JOIN rt USING (code)")
def _(t):
    tw = twin_roads(t)
    s = L.segments(tw.select("code", "line"), "code")
    a = L.segments(tw.where("code >= 0").select("code", "lane_count", "line"), "code")
    return DI.carriageway_gap(a, s).select("code", r("gap_m", 3).alias("gap_m"), "samples", "lane_m")


_PC = "CASE " + " ".join(f"WHEN cover = '{c}' THEN {i}" for i, c in enumerate((*DI.PARK_CLASSES, *DI.PARK_REST))) + " END"
_COV = "[" + ", ".join(f"'{c}'" for c in (*DI.PARK_CLASSES, *DI.PARK_REST)) + "]"
_PARK = f"pk AS (SELECT *, {_COV}[CAST(1 + bid % 9 AS INTEGER)] AS cover FROM (SELECT bid, side, cx, cy FROM bld))"


def park_shapes(t):
    """Buildings read as park areas, three around each third one so that they overlap."""
    move = lambda c, d: (F.col(c) + d)
    b = t.bld.withColumn("cover", F.element_at(F.array(*[F.lit(c) for c in (*DI.PARK_CLASSES, *DI.PARK_REST)]), (1 + F.col("bid") % 9).cast("int")))
    near = b.withColumn("bid", F.col("bid") + 10**6).withColumn("cover", F.lit("wood")).withColumn("edges", F.transform("edges", lambda e: F.struct((e["ax"] + 4).alias("ax"), (e["ay"] + 4).alias("ay"), (e["bx"] + 4).alias("bx"), (e["by"] + 4).alias("by"))))
    for c in "wsen":
        near = near.withColumn(c, move(c, 4))
    return b.select("bid", "cover", "edges", "w", "s", "e", "n").unionByName(near.select("bid", "cover", "edges", "w", "s", "e", "n"))


@query("P12_park_cover", with_(BLD, _PARK) + f"""SELECT cover, count(*) AS cells FROM (SELECT gx, gy, arg_min(cover, {_PC}) AS cover FROM (SELECT cover, gx, gy FROM (SELECT cover, w, s, e, n, unnest(range(CAST(floor(w) AS BIGINT), CAST(floor(e) AS BIGINT) + 1)) AS gx FROM
 (SELECT cover, cx + d - side / 2 AS w, cy + d - side / 2 AS s, cx + d + side / 2 AS e, cy + d + side / 2 AS n FROM (SELECT cx, cy, side, cover, 0 AS d FROM pk UNION ALL SELECT cx, cy, side, 'wood', 4 FROM pk))), (SELECT unnest(range(0, 60)) AS k), LATERAL (SELECT CAST(floor(s) AS BIGINT) + k AS gy)
 WHERE gx + 0.5 > w AND gx + 0.5 < e AND gy + 0.5 > s AND gy + 0.5 < n) GROUP BY gx, gy) GROUP BY cover""")
def _(t):
    return DI.park_cover(park_shapes(t)).groupBy("cover").agg(F.count("*").alias("cells"))


@query("P12_park_trees")
def _(t):
    s = park_shapes(t)
    return DI.park_trees(s, DI.park_cover(s)).select("i", "j", "kind", r("x", 3).alias("x"), r("y", 3).alias("y"))


# ----------------------------------------------------- routes (W4, W11, P14, P15), refresh


@query("P14_route_report", with_(PATH, "legs AS (SELECT p.code, {d} AS m FROM path p JOIN path q ON p.code = q.code AND q.i = p.i + 1)".format(d=hav_km("p.lng", "p.lat", "q.lng", "q.lat", 6371000.0)),
                               "sl AS (SELECT p.code, {d} AS m FROM path p JOIN path q ON p.code = q.code AND p.i % 5 = 0 AND q.i = p.i + 5)".format(d=hav_km("p.lng", "p.lat", "q.lng", "q.lat", 6371000.0))) +
       f"SELECT code, CAST(n AS INTEGER) AS vertices, {rnd('length', 3)} AS length_m, {rnd('straight', 3)} AS straight_m, TRUE AS starts FROM (SELECT code, count(*) AS n FROM path GROUP BY code HAVING count(*) > 5) JOIN (SELECT code, sum(m) AS length FROM legs GROUP BY code) USING (code) JOIN (SELECT code, sum(m) AS straight FROM sl GROUP BY code) USING (code)")
def _(t):
    d = Q.route_report(routes(t))
    return d.select("code", "vertices", r("length_m", 3).alias("length_m"), r("straight_m", 3).alias("straight_m"), F.col("starts_at_stop").alias("starts"))


def routes(t, every=5):
    stops = F.transform(F.filter("line", lambda p, i: i % every == 0), lambda p: F.struct(F.lit("stop").alias("name"), p["lng"].alias("lng"), p["lat"].alias("lat")))
    return t.lines.where(F.size("line") > 5).select("code", "line", stops.alias("stops"), F.lit(False).alias("is_loop"))


_ARC = f"""arc AS (SELECT code, i, lng, lat, coalesce(sum(m) OVER (PARTITION BY code ORDER BY i), 0) AS arc FROM (SELECT *, CASE WHEN i > 0 THEN {hav_km('plng', 'plat', 'lng', 'lat', 6371000.0)} END AS m FROM (SELECT *, lag(lng) OVER w AS plng, lag(lat) OVER w AS plat FROM path WINDOW w AS (PARTITION BY code ORDER BY i))))"""


@query("P14_stop_uturns", with_(PATH, _ARC, """stops AS (SELECT code, i AS vx, i // 4 AS stop, arc AS centre, total, CAST(floor(least(arc, total - arc) / 3.0) AS INTEGER) AS room FROM arc JOIN (SELECT code, max(arc) AS total, max(i) AS last FROM arc GROUP BY code) USING (code) WHERE last >= 5 AND i % 4 = 0 AND i > 0 AND i // 4 <= last // 4 - 1),
 steps AS (SELECT *, unnest(range(1, room + 1)) AS k FROM stops WHERE room >= 1),
 back AS (SELECT code, vx, k, min({'d': abs(arc - (centre - 3.0 * k)), 'i': i, 'lng': lng, 'lat': lat}) AS p FROM steps JOIN arc USING (code) GROUP BY code, vx, k),
 ahead AS (SELECT code, vx, k, min({'d': abs(arc - (centre + 3.0 * k)), 'i': i, 'lng': lng, 'lat': lat}) AS q FROM steps JOIN arc USING (code) GROUP BY code, vx, k)""") +
       f"""SELECT code, CAST(stop AS INTEGER) AS stop, CAST(vx AS INTEGER) AS "at", spur_m FROM (SELECT code, stop, vx, coalesce(min(CASE WHEN {hav_km('p.lng', 'p.lat', 'q.lng', 'q.lat', 6371000.0)} > 15 THEN k END) - 1, room) * 3.0::DOUBLE AS spur_m FROM stops JOIN back USING (code, vx) JOIN ahead USING (code, vx, k) GROUP BY code, stop, vx, room) WHERE spur_m >= 50""")
def _(t):
    return L.stop_uturns(Q.route_report(routes(t, 4)))


# Three lines hold all orders: what their vertices need is summed along lines of any length.
TRACK = f"""track AS (SELECT o_orderkey % 3 AS code, o_orderkey // 3 AS i, 120.55 + 0.05 * sin((o_orderkey // 3) / 211.0 + o_orderkey % 3) AS lng, 16.35 + 0.05 * cos((o_orderkey // 3) / 333.0) + ((o_orderkey * 7919) % 11) / 1000000.0 AS lat FROM orders)""".replace("120.55", "120.55::DOUBLE").replace("0.05 ", "0.05::DOUBLE ").replace("16.35", "16.35::DOUBLE").replace("211.0", "211.0::DOUBLE").replace("333.0", "333.0::DOUBLE").replace("1000000.0", "1000000.0::DOUBLE")


def track(t):
    return t._view(TRACK, orders=t.raw("orders"))


@query("W1_track_arcs", with_(TRACK) + f"""SELECT code, i, {rnd('sum(m) OVER (PARTITION BY code ORDER BY i)', 2)} AS arc FROM (SELECT code, i, CASE WHEN plng IS NULL THEN 0 ELSE {hav_km('plng', 'plat', 'lng', 'lat', 6371000.0)} END AS m FROM (SELECT *, lag(lng) OVER w AS plng, lag(lat) OVER w AS plat FROM track WINDOW w AS (PARTITION BY code ORDER BY i)))""")
def _(t):
    return tracks.arcs(track(t)).select("code", "i", r("arc", 2).alias("arc"))


_BR = "fmod(degrees(atan2(sin(radians(b.lng - a.lng)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lng - a.lng)))) + 360, 360)"
_TURN = "CASE WHEN fmod(abs(h1 - h2), 360) > 180 THEN 360 - fmod(abs(h1 - h2), 360) ELSE fmod(abs(h1 - h2), 360) END"


@query("W3_track_headings", with_(TRACK) + f"""SELECT p.code, p.i, {rnd(_BR, 2)} AS heading FROM track p JOIN (SELECT code, max(i) AS m, min(i) AS l FROM track GROUP BY code) USING (code) JOIN track a ON a.code = p.code AND a.i = CASE WHEN p.i = m THEN greatest(l, m - 5) ELSE p.i END JOIN track b ON b.code = p.code AND b.i = least(m, p.i + 5) WHERE m > l""")
def _(t):
    return tracks.headings(track(t)).select("code", "i", r("heading", 2).alias("heading"))


@query("W4_backtracks", with_(PATH, f"""arc AS (SELECT code, i, lng, lat, coalesce(sum(m) OVER (PARTITION BY code ORDER BY i), 0) AS arc FROM (SELECT *, CASE WHEN i > 0 THEN {hav_km('plng', 'plat', 'lng', 'lat', 6371000.0)} END AS m FROM (SELECT *, lag(lng) OVER w AS plng, lag(lat) OVER w AS plat FROM path WINDOW w AS (PARTITION BY code ORDER BY i))))""",
        f"""head AS (SELECT p.code, p.i, p.lng, p.lat, p.arc, m, total, {_BR} AS h FROM arc p JOIN (SELECT code, max(i) AS m, max(arc) AS total FROM arc GROUP BY code) USING (code) JOIN path a ON a.code = p.code AND a.i = CASE WHEN p.i = m THEN greatest(0, m - 5) ELSE p.i END JOIN path b ON b.code = p.code AND b.i = least(m, p.i + 5))""",
        f"""firsts AS (SELECT code, i, min(j) AS j, arg_min(gap, j) AS gap FROM (SELECT x.code, x.i, y.i AS j, y.arc - x.arc AS gap, x.h AS h1, y.h AS h2 FROM head x JOIN head y ON x.code = y.code AND y.i > x.i WHERE y.arc - x.arc > 150 AND y.arc - x.arc <= x.total * 0.9 AND {hav_km('x.lng', 'x.lat', 'y.lng', 'y.lat', 6371000.0)} <= 10) WHERE {_TURN} > 120 GROUP BY code, i)""",
        """runs AS (SELECT *, sum(CASE WHEN i <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY code ORDER BY i) AS run FROM (SELECT *, max(j) OVER (PARTITION BY code ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM firsts))""")
       + f"SELECT code, CAST(min(i) AS INTEGER) AS i, CAST(max(j) AS INTEGER) AS j, {rnd('max(gap)', 2)} AS gap FROM runs GROUP BY code, run")
def _(t):
    d = t.lines.withColumn("stop_idx", F.array(F.lit(0), F.size("line") - 1))
    return L.backtracks(d).select("code", "i", "j", r("path_gap_m", 2).alias("gap"))


@query("W11_worst_detour", with_(PATH) + f"""SELECT code, seq, {rnd('score', 3)} AS score FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY floor(score * 1000 + 0.5) DESC, seq) AS rn FROM (SELECT code, i AS seq, {hav_km('plng', 'plat', 'lng', 'lat', 6371000.0)} + {hav_km('lng', 'lat', 'nlng', 'nlat', 6371000.0)} - {hav_km('plng', 'plat', 'nlng', 'nlat', 6371000.0)} AS score
 FROM (SELECT *, lag(lng) OVER w AS plng, lag(lat) OVER w AS plat, lead(lng) OVER w AS nlng, lead(lat) OVER w AS nlat FROM path WINDOW w AS (PARTITION BY code ORDER BY i)) WHERE plng IS NOT NULL AND nlng IS NOT NULL AND i % 5 <> 0)) WHERE rn = 1""")
def _(t):
    w = F.transform("line", lambda p, i: F.struct(i.alias("seq"), p["lng"].alias("lng"), p["lat"].alias("lat"), (i % 5 == 0).alias("mandatory")))
    return Q.worst_detours(t.lines.select("code", w.alias("w"))).select("code", "seq", r("score", 3).alias("score"))


_DRAWN = "(lng + CASE WHEN code % 4 = 3 AND i % 3 = 0 THEN 0.006::DOUBLE ELSE 0.0004::DOUBLE END)"
_MOVED = f"""drawn AS (SELECT code, i AS seq, {_DRAWN} AS slng, lat + 0.0003::DOUBLE AS slat, greatest(i - 4, 0) AS lo, least(i + 4, last) AS hi FROM path JOIN (SELECT code, max(i) AS last FROM path GROUP BY code) USING (code) WHERE i > 0 AND i < last),
 leg AS (SELECT s.*, (p.lng - slng) * kx AS ax, (p.lat - slat) * ky AS ay, (q.lng - slng) * kx AS bx, (q.lat - slat) * ky AS by, kx, ky FROM (SELECT *, {math.pi / 180 * 6371000.0!r}::DOUBLE AS ky, cos(radians(slat)) * {math.pi / 180 * 6371000.0!r}::DOUBLE AS kx FROM drawn) s JOIN path p ON p.code = s.code AND p.i >= lo AND p.i < hi JOIN path q ON q.code = s.code AND q.i = p.i + 1),
 foot AS (SELECT *, ax + u * (bx - ax) AS x, ay + u * (by - ay) AS y FROM (SELECT *, greatest(0, least(1, coalesce(-(ax * (bx - ax) + ay * (by - ay)) / nullif(pow(bx - ax, 2) + pow(by - ay, 2), 0), 0))) AS u FROM leg)),
 spot AS (SELECT code, seq, lo, hi, slng, slat, {rnd('m.lng', 5)} AS nlng, {rnd('m.lat', 5)} AS nlat FROM (SELECT code, seq, lo, hi, slng, slat, min({{'d': sqrt(x * x + y * y), 'lng': slng + x / kx, 'lat': slat + y / ky}}) AS m FROM foot GROUP BY ALL)),
 hit AS (SELECT code, seq, min({{'d': {hav_km('lng', 'lat', 'nlng', 'nlat', 6371000.0)}, 'i': i}}) AS h FROM spot JOIN path USING (code) GROUP BY code, seq)"""


@query("P15_relocate_stops", with_(PATH, _MOVED) + f"""SELECT code, seq, CASE WHEN m > 400 THEN 'refused: too far' WHEN h.d > 30 THEN 'refused: off the line' WHEN h.i < lo OR h.i > hi THEN 'refused: order' ELSE 'moved' END AS outcome, nlng AS new_lng, nlat AS new_lat, {rnd('m', 2)} AS moved_m FROM (SELECT *, {hav_km('slng', 'slat', 'nlng', 'nlat', 6371000.0)} AS m FROM spot) JOIN hit USING (code, seq)""")
def _(t):
    n = F.size("line")
    s = t.lines.where(n > 2).select("code", F.col("line").alias("trunk"), n.alias("n"), F.posexplode("line").alias("seq", "p")).where("seq > 0 AND seq < n - 1")
    far = (F.col("code") % 4 == 3) & (F.col("seq") % 3 == 0)
    s = s.select("code", "seq", "trunk", (F.col("p.lng") + F.when(far, 0.006).otherwise(0.0004)).alias("lng"), (F.col("p.lat") + 0.0003).alias("lat"),
                 F.greatest(F.col("seq") - 4, F.lit(0)).alias("from_idx"), F.least(F.col("seq") + 4, F.col("n") - 1).alias("to_idx"))
    return Q.relocate_stops(s).select("code", "seq", "outcome", "new_lng", "new_lat", r("moved_m", 2).alias("moved_m"))


@query("P16_refresh_elevations", with_(DEST) + f"SELECT slug, elevation AS old, CAST(g AS DOUBLE) AS new, elevation IS DISTINCT FROM g AS changed FROM (SELECT *, round_even({height_sql(f'floor({_P15[0]})', f'floor({_P15[1]})')}, 0) AS g FROM dest)")
def _(t):
    return RF.refresh_elevations(t.dest.select("slug", "lng", "lat", "elevation"), t.heights(t.dest, 15))


def tm_sql(src):
    """CTEs of the transverse Mercator forward series."""
    lng0, lat0 = geo.CITY_CENTRE
    e = " + ".join(["eta"] + [f"{a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(geo.TM_ALPHA, 1)])
    n = " + ".join(["xi"] + [f"{a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(geo.TM_ALPHA, 1)])
    return f"""t1 AS (SELECT *, sinh(atanh(sin(radians(lat))) - {geo.TM_ECC!r}::DOUBLE * atanh({geo.TM_ECC!r}::DOUBLE * sin(radians(lat)))) AS tt, radians(lng - {lng0}::DOUBLE) AS dl FROM {src}),
 t2 AS (SELECT *, atan2(tt, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + tt * tt)) AS eta FROM t1),
 tm AS (SELECT *, {geo.TM_RECTIFYING!r}::DOUBLE * ({e}) AS e, {geo.TM_RECTIFYING!r}::DOUBLE * ({n}) - {geo.tm_northing_of_origin(lat0)!r}::DOUBLE AS n FROM t2)"""


@query("P17_project_posts", f"WITH {_H(0)}, {tm_sql('h')} SELECT id, {rnd('e', 3)} AS e, {rnd('n', 3)} AS n FROM tm")
def _(t):
    return RF.project_posts(points(t)).select("id", r("e", 3).alias("e"), r("n", 3).alias("n"))
