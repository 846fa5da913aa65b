"""Roads: attributes, junctions, markings, street furniture, sidewalks and centre islands."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upland.functions.geo import col, once, signed_offset
from upland.functions.ids import unit_hash
from upland.operators import lines as L
from upland.operators.tracks import running
from upland.operators import rings as G
from upland.operators.cellgroups import label_text
from upland.operators.cells import box_join, nearest
from upland.operators.strips import band_masks, near_masks
from upland.session import written

# Lanes, widths, spacings and class rules.
LANE_M = 3.1
DEFAULT_LANES = {"motorway": 4, "trunk": 2, "primary": 2, "secondary": 2, "tertiary": 2, "unclassified": 2, "residential": 2,
                 "living_street": 2, "pedestrian": 2, "service": 1, "track": 1}
MIN_WIDTH = {"service": 3.5, "track": 3.0, "pedestrian": 4.0, "residential": 5.0, "living_street": 4.5}
MARKED = ("motorway", "trunk", "primary", "secondary", "tertiary")
SIDE_KINDS = ("trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street")
SIDEWALK_M, BUILT_M, CHUNK_M = 5.57, 6.0, 25.0
JUNCTION_M, LAMP_EVERY_M, LAMP_CLEAR_M = 12.0, 32.0, 15.0
PEOPLE_PER_M2 = {"hex": 1 / 30, "brick": 1 / 60, "concrete": 1 / 250, "paving": 1 / 150, "setts": 1 / 150}
PAVING_ORDER = ("hex", "brick", "concrete", "paving", "setts", "step", "gravel", "earth")
STEP_RISE_M, GOING_M = 0.17, 0.5
ISLAND_REACH_M = 8.0


def _lookup(table: dict, key, default) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(m[col(key)], F.lit(default))


# ------------------------------------------------------------- attributes


def kind(highway) -> Column:
    return F.regexp_replace(col(highway), "_link$", "")


def lanes(tag, road_kind) -> Column:
    """The first of `a;b` when it is a whole number; else the class default."""
    first = F.trim(F.split(F.coalesce(col(tag), F.lit("")), ";")[0])
    return F.when(first.rlike(r"^[+-]?\d+$"), first.cast("int")).otherwise(_lookup(DEFAULT_LANES, road_kind, 2))


def width_m(lane_count, road_kind) -> Column:
    return F.greatest(col(lane_count) * LANE_M, _lookup(MIN_WIDTH, road_kind, 3.0))


def is_concrete(surface) -> Column:
    return F.coalesce(col(surface).isin("concrete", "paving_stones", "concrete:plates"), F.lit(False))


def sidewalk_paving(road_kind) -> Column:
    k = col(road_kind)
    return F.when(k.isin("trunk", "primary"), "hex").when(k.isin("secondary", "tertiary"), "brick").otherwise("concrete")


def walk_surface(surface, highway) -> Column:
    s, h = F.coalesce(col(surface), F.lit("")), col(highway)
    return (F.when(s.isin("ground", "dirt", "earth", "mud", "grass", "unpaved") | ((h == "path") & (s == "")), "earth")
            .when(s.isin("gravel", "fine_gravel", "compacted", "pebblestone"), "gravel")
            .when(s.isin("paving_stones", "sett", "cobblestone"), "setts").when(h == "steps", "step").otherwise("paving"))


def wall_size(barrier, height) -> Column:
    """struct(height, thickness): mapped height capped at 8 m, else the kind's own."""
    b = col(barrier)
    base = F.when(b == "retaining_wall", 2.7).when(b == "wall", 1.8)
    t = F.trim(F.regexp_replace(F.coalesce(col(height), F.lit("")), " m$", ""))
    h = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), t.cast("double"))
    return F.struct(F.least(F.when(h.isNull() | (h == 0), base).otherwise(h), F.lit(8.0)).alias("height"),
                    F.when(b == "retaining_wall", 0.4).when(b == "wall", 0.25).alias("thickness"))


def wall_material(barrier, material) -> Column:
    return F.when((col(barrier) == "retaining_wall") | F.coalesce(col(material).isin("stone", "rock", "brick"), F.lit(False)), "stone").otherwise("render")


def sign_class(highway, traffic_sign) -> Column:
    code = F.split(F.regexp_replace(F.coalesce(col(traffic_sign), F.lit("")), "^PH:", ""), ";")[0]
    h = col(highway)
    return (F.when(h.isin("stop", "give_way"), h).when(col(traffic_sign).isNull(), F.lit(None)).when(code.startswith("HM"), "HM")
            .when(F.substring(code, 1, 1).isin("R", "W", "G"), F.substring(code, 1, 1)).otherwise("R"))


def step_count(length, climb, mapped) -> Column:
    """Treads of a stairway: mapped count, else by the climb, at most 0.5 m deep; never under 0.2 m each."""
    n = F.coalesce(col(mapped), F.greatest(F.bround(F.abs(col(climb)) / STEP_RISE_M), F.ceil(col(length) / GOING_M)))
    return F.least(F.greatest(F.lit(1), n), F.floor(col(length) / 0.2) + 1).cast("int")


def road_table(roads: DataFrame) -> DataFrame:
    """Lines with tags (highway, lanes, oneway, surface) to their attribute columns."""
    r = roads.withColumn("kind", kind("highway")).withColumn("lane_count", lanes("lanes", "kind"))
    return r.withColumn("half", width_m("lane_count", "kind") / 2).withColumn("concrete", is_concrete("surface")).withColumn(
        "marked", F.col("kind").isin(*MARKED)).withColumn("paving", sidewalk_paving("kind"))


def junctions(ways: DataFrame, line: str = "line") -> DataFrame:
    """Places (7 decimals) where at least two line ends meet."""
    g = F.col(line)
    ends = ways.select(F.explode(F.array(g[0], F.element_at(g, -1))).alias("p"))
    q = lambda c: F.floor(F.col(c) * 1e7 + 0.5) / 1e7
    return ends.groupBy(q("p.lng").alias("lng"), q("p.lat").alias("lat")).agg(F.count("*").alias("n")).where("n >= 2")


def planar_ends(roads: DataFrame, line: str = "line") -> DataFrame:
    """Junction points (jx, jy) of planar lines, to a centimetre."""
    g = F.col(line)
    ends = roads.select(F.explode(F.array(g[0], F.element_at(g, -1))).alias("p"))
    q = lambda c: F.floor(F.col(c) * 100 + 0.5) / 100
    return ends.groupBy(q("p.x").alias("jx"), q("p.y").alias("jy")).agg(F.count("*").alias("n")).where("n >= 2").select("jx", "jy")


def clear_of(sites: DataFrame, points: DataFrame, site_id: str, r: float, x: str = "x", y: str = "y", px: str = "jx", py: str = "jy") -> DataFrame:
    """Sites with no point within r metres. Only the nearest point of a site is ever looked for, so a crowd of points
    in one place costs no more than one."""
    sites = written(sites)            # read three times below, and dear to make
    pts = points.select(F.col(px).alias("_px"), F.col(py).alias("_py")).distinct()
    hit = nearest(sites.select(site_id, F.col(x).alias("_sx"), F.col(y).alias("_sy")), pts, 1, origin_id=site_id,
                  origin_at=lambda: [F.col("_sx"), F.col("_sy")], item_at=lambda: [F.col("_px"), F.col("_py")],
                  distance=F.hypot(F.col("_sx") - F.col("_px"), F.col("_sy") - F.col("_py")), tie=["_px", "_py"], max_m=r, origin_site=["_sx", "_sy"])
    return sites.join(hit.select(site_id), site_id, "left_anti")


# ------------------------------------------------------------------- markings


def _heading(before, after, bx, by, ax, ay) -> Column:
    return F.atan2(col(ay) - col(by), col(ax) - col(bx))


def lane_marks(roads: DataFrame, joints: DataFrame) -> DataFrame:
    """Marking positions on marked roads of two lanes or more: mark_id, code, style (divider, solid, broken), t, x, y,
    shift. One-way roads get lane dividers every 8 m; two-way roads every 4 m a solid line where the road turns more than
    12 degrees (from 10 m back to 14 m ahead), else broken every second step; none within 12 m of a junction."""
    r = roads.where(F.col("marked") & (F.col("lane_count") >= 2))
    g = F.col("line")
    n = F.size(g)
    sums = running(F.zip_with(F.slice(g, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(g, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])))
    r = r.where(n >= 2).withColumn("_arc", sums).withColumn("total", F.element_at("_arc", -1))

    one = L.points_along(L.segments(r.where("oneway").drop("_arc"), "code"), 8.0, 2.0).where(F.col("t") < F.col("total") - 3)
    one = one.withColumn("lane", F.explode(F.sequence(F.lit(1), F.col("lane_count") - 1)))
    one = one.withColumn("shift", -F.col("half") + F.col("lane") * 2 * F.col("half") / F.col("lane_count"))
    one = one.select("code", F.lit("divider").alias("style"), "lane", "step", "t",
                     (F.col("x") - F.col("uy") * F.col("shift")).alias("x"), (F.col("y") + F.col("ux") * F.col("shift")).alias("y"), "shift")

    two = L.points_along(L.segments(r.where("NOT oneway").withColumn("_line", F.col("line")), "code"), 4.0, 2.0).where(F.col("t") < F.col("total") - 2)

    def at(t):
        """Place on the row's own line at arc t: struct(x, y). The leg it lies on is looked for once."""
        leg = lambda t: F.struct(t.alias("t"), F.least(F.greatest(F.size(F.filter("_arc", lambda v: v <= t)) - 1, F.lit(0)), F.size("_line") - 2).alias("i"))

        def place(p):
            a, b = F.get("_line", p["i"]), F.get("_line", p["i"] + 1)
            lo, span = F.get("_arc", p["i"]), F.get("_arc", p["i"] + 1) - F.get("_arc", p["i"])
            return once(F.when(span > 0, (p["t"] - lo) / span).otherwise(F.lit(0.0)), lambda s: F.struct((a["x"] + s * (b["x"] - a["x"])).alias("x"), (a["y"] + s * (b["y"] - a["y"])).alias("y")))

        return once(once(F.greatest(F.lit(0.0), F.least(t, F.col("total"))), leg), place)

    def heading(t):
        ends = F.struct(at(F.greatest(F.lit(0.0), t - 1)).alias("b"), at(F.least(F.col("total"), t + 1)).alias("a"))
        return once(ends, lambda q: F.atan2(q["a"]["y"] - q["b"]["y"], q["a"]["x"] - q["b"]["x"]))

    turn = F.abs(F.pmod(heading(F.least(F.col("total"), F.col("t") + 14)) - heading(F.greatest(F.lit(0.0), F.col("t") - 10)) + math.pi, F.lit(2 * math.pi)) - math.pi)
    two = two.withColumn("_bend", F.explode(F.array(F.degrees(turn))))       # explode keeps it from being worked out again
    two = two.withColumn("style", F.when(F.col("_bend") > 12, "solid").when(F.floor(F.col("t") / 4) % 2 == 0, "broken"))
    two = two.where(F.col("style").isNotNull()).select("code", "style", F.lit(0).alias("lane"), "step", "t", "x", "y", F.lit(0.0).alias("shift"))
    marks = one.unionByName(two).withColumn("mark_id", F.concat_ws(":", "code", "style", "lane", "step"))
    return clear_of(marks, joints, "mark_id", JUNCTION_M)


def edge_marks(roads: DataFrame, joints: DataFrame) -> DataFrame:
    """White edge marks every 8 m on both sides of marked roads, clear of junctions."""
    segs = L.segments(roads.where("marked"), "code")
    ends = segs.groupBy("code").agg(F.max(F.col("start") + F.col("len")).alias("total"))
    p = L.points_along(segs, 8.0, 4.0).join(ends, "code").where(F.col("t") < F.col("total") - 4)
    p = p.withColumn("mark_id", F.concat_ws(":", "code", "step"))
    p = clear_of(p, joints, "mark_id", JUNCTION_M).withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    o = F.col("side") * (F.col("half") - 0.3)
    return p.select("code", "step", "side", (F.col("x") - F.col("uy") * o).alias("x"), (F.col("y") + F.col("ux") * o).alias("y"))


def stop_bars(roads: DataFrame, joints: DataFrame) -> DataFrame:
    """A bar 7 m back from each junction end of marked roads of 20 m or more; none at the start of a one-way road."""
    segs = L.segments(roads.where("marked"), "code")
    w = Window.partitionBy("code")
    segs = segs.withColumn("total", F.max(F.col("start") + F.col("len")).over(w)).where("total >= 20")
    last = segs.withColumn("_end", F.lit("end")).withColumn("_t", F.col("total") - 7)
    first = segs.where("NOT oneway").withColumn("_end", F.lit("start")).withColumn("_t", F.lit(7.0))
    tips = segs.where(F.col("start") == 0).select("code", F.lit("start").alias("_end"), F.col("ax").alias("tx"), F.col("ay").alias("ty")).unionByName(
        segs.where(F.col("start") + F.col("len") == F.col("total")).select("code", F.lit("end").alias("_end"), F.col("bx").alias("tx"), F.col("by").alias("ty")))
    hit = last.unionByName(first).where((F.col("_t") >= F.col("start")) & (F.col("_t") < F.col("start") + F.col("len")))
    bars = hit.join(tips, ["code", "_end"]).withColumn("bar_id", F.concat_ws(":", "code", "_end"))
    far = clear_of(bars.select("bar_id", "tx", "ty"), joints, "bar_id", JUNCTION_M, "tx", "ty")
    bars = bars.join(far.select("bar_id"), "bar_id", "left_anti")
    s = (F.col("_t") - F.col("start")) / F.col("len")
    ux, uy = (F.col("bx") - F.col("ax")) / F.col("len"), (F.col("by") - F.col("ay")) / F.col("len")
    mid = F.when(F.col("oneway"), 0.0).when(F.col("_end") == "end", (-F.col("half") + 0.3) / 2).otherwise((F.col("half") - 0.3) / 2)
    return bars.select("code", F.col("_end").alias("at"), (F.col("ax") + s * (F.col("bx") - F.col("ax")) - uy * mid).alias("x"),
                       (F.col("ay") + s * (F.col("by") - F.col("ay")) + ux * mid).alias("y"))


# ------------------------------------------------------------------ furniture


def lamp_sites(roads: DataFrame, joints: DataFrame, mapped: DataFrame) -> DataFrame:
    """Lamps along marked roads every 32 m, sides in turn, not within 12 m of a junction nor 15 m of a mapped lamp, plus
    the mapped ones (lamp_id, x, y): site_id, x, y, source."""
    p = L.points_along(L.segments(roads.where("marked"), "code"), LAMP_EVERY_M, LAMP_EVERY_M / 2)
    o = F.when(F.col("step") % 2 == 0, 1).otherwise(-1) * (F.col("half") + 0.6)
    p = p.select(F.concat_ws(":", F.lit("road"), "code", "step").alias("site_id"), (F.col("x") - F.col("uy") * o).alias("x"), (F.col("y") + F.col("ux") * o).alias("y"))
    p = clear_of(p, joints, "site_id", JUNCTION_M)
    p = clear_of(p, mapped.select(F.col("x").alias("jx"), F.col("y").alias("jy")), "site_id", LAMP_CLEAR_M)
    own = mapped.select(F.concat_ws(":", F.lit("mapped"), "lamp_id").alias("site_id"), "x", "y", F.lit("mapped").alias("source"))
    return p.withColumn("source", F.lit("row")).unionByName(own)


def furniture(nodes: DataFrame, roads: DataFrame) -> DataFrame:
    """Crossings, signals and signs (node_id, what, x, y) placed by their nearest road: crossings only within 3 m of its
    line; signals at either kerb 6 m back; signs where mapped when off the road, else at its right edge."""
    segs = L.segments(roads.select("code", "half", "line"), "code")
    n = L.nearest_line(nodes, segs, point_id="node_id", line_id="code")
    n = n.where((F.col("what") != "crossing") | (F.col("dist") <= 3.0))
    fx = F.col("ax") + F.col("share") * (F.col("bx") - F.col("ax"))
    fy = F.col("ay") + F.col("share") * (F.col("by") - F.col("ay"))
    sides = F.when(F.col("what") == "signal", F.array(F.lit(-1), F.lit(1))).otherwise(F.array(F.lit(0)))
    n = n.select("*", fx.alias("fx"), fy.alias("fy"), F.explode(sides).alias("side"))
    off = F.abs(F.col("offset")) > F.col("half") + 0.3
    o = (F.when(F.col("what") == "signal", F.col("side") * (F.col("half") + 0.8)).when(F.col("what") == "sign", -(F.col("half") + 0.6)).otherwise(0.0))
    along = F.when(F.col("what") == "signal", -6.0 * F.col("side")).otherwise(0.0)
    x = F.when((F.col("what") == "sign") & off, F.col("x")).otherwise(F.col("fx") - F.col("uy") * o + F.col("ux") * along)
    y = F.when((F.col("what") == "sign") & off, F.col("y")).otherwise(F.col("fy") + F.col("ux") * o + F.col("uy") * along)
    return n.select("node_id", "what", "code", "side", x.alias("px"), y.alias("py"))


# ------------------------------------------------------------ stairs, sidewalks


def parallel_stairs(stairs: DataFrame, roads: DataFrame, max_deg: float = 30.0) -> DataFrame:
    """Stairways (stair_id, sx0, sy0, sx1, sy1, x, y = middle) beside their nearest road: within its half width + 5.57 m
    and within max_deg of its direction."""
    segs = L.segments(roads.select("code", "half", "line"), "code")
    n = L.nearest_line(stairs, segs, point_id="stair_id", line_id="code")
    dx, dy = F.col("sx1") - F.col("sx0"), F.col("sy1") - F.col("sy0")
    size = F.greatest(F.hypot(dx, dy), F.lit(1e-9))
    angle = F.degrees(F.acos(F.least(F.lit(1.0), F.abs((dx * F.col("ux") + dy * F.col("uy")) / size))))
    return n.withColumn("along", (F.col("dist") <= F.col("half") + SIDEWALK_M) & (angle <= max_deg)).withColumn("angle", angle)


def chunks(roads: DataFrame) -> DataFrame:
    """Centreline pieces of 25 m of each segment on streets that can have sidewalks, per side: chunk_id, code, chunk, side,
    ax..by of the piece, half, paving."""
    segs = L.segments(roads.where(F.col("kind").isin(*SIDE_KINDS)), "code").where("len > 0")
    first, last = F.floor(F.col("start") / CHUNK_M), F.floor((F.col("start") + F.col("len")) / CHUNK_M)
    c = segs.withColumn("chunk", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    t0 = F.greatest(F.col("start"), F.col("chunk") * CHUNK_M) - F.col("start")
    t1 = F.least(F.col("start") + F.col("len"), (F.col("chunk") + 1) * CHUNK_M) - F.col("start")
    ux, uy = (F.col("bx") - F.col("ax")) / F.col("len"), (F.col("by") - F.col("ay")) / F.col("len")
    c = c.withColumn("_t0", t0).withColumn("_t1", t1).where("_t1 - _t0 > 0")
    c = c.select("code", "chunk", "seg", "half", "paving", F.explode(F.array(F.lit(1), F.lit(-1))).alias("side"), ux.alias("ux"), uy.alias("uy"),
                 (F.col("ax") + F.col("_t0") * ux).alias("ax"), (F.col("ay") + F.col("_t0") * uy).alias("ay"),
                 (F.col("ax") + F.col("_t1") * ux).alias("bx"), (F.col("ay") + F.col("_t1") * uy).alias("by"), (F.col("_t1") - F.col("_t0")).alias("len"))
    return c.select(F.concat_ws(":", "code", "chunk", "seg", "side").alias("chunk_id"), "*")


def _band_box(reach) -> list[Column]:
    r = col(reach)
    return [F.least("ax", "bx") - r, F.least("ay", "by") - r, F.greatest("ax", "bx") + r, F.greatest("ay", "by") + r]


def frontage(pieces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Pieces with a building point (px, py) on their side from the kerb out to the sidewalk's width + 6 m. A semi-join:
    it stops at the first building."""
    off = signed_offset("px", "py", "ax", "ay", "bx", "by") * F.col("side")
    along = (F.col("px") - F.col("ax")) * F.col("ux") + (F.col("py") - F.col("ay")) * F.col("uy")
    ok = off.between(F.col("half"), F.col("half") + SIDEWALK_M + BUILT_M) & along.between(F.lit(0.0), F.col("len"))
    pt = [F.col("px"), F.col("py"), F.col("px"), F.col("py")]
    return box_join(pieces, vertices.select("px", "py").distinct(), _band_box(F.col("half") + SIDEWALK_M + BUILT_M), pt, ok, "left_semi")


def carriageway_masks(roads: DataFrame, flag: str | None = None) -> DataFrame:
    """Cells whose centre is on a carriageway, as words of 64 along each row: gy, word, mask, and `flag`, a true or false
    column of the roads. Of equal lines the widest is read."""
    keys = [flag] if flag else []
    wide = roads.groupBy("line", *keys).agg(F.max("half").alias("half"), F.min("code").alias("code"))
    segs = L.segments(wide, "code").where("len > 0")
    words = near_masks(segs, F.col(flag).cast("int") if flag else F.lit(0), F.col("half"))
    return words.select("gy", "word", "mask", *([(F.col("tag") == 1).alias(flag)] if flag else []))


def paved_masks(roads: DataFrame, buildings: DataFrame) -> DataFrame:
    """Sidewalk cover as words of 64 cells along each row (gy, word, paving, mask): each cell takes the first paving in order
    among the pieces over it, off the carriageways and out of the buildings. Equal lines of one width and paving are read
    once."""
    vertices = buildings.select(F.explode("ring").alias("p")).select(F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    sided = roads.groupBy("line", "kind", "half", "paving").agg(F.min("code").alias("code"))
    kept = frontage(chunks(sided), vertices)
    seen = paving_words(kept)
    taken = carriageway_masks(roads).unionByName(G.cell_masks(buildings)).groupBy("gy", "word").agg(F.bit_or("mask").alias("_taken"))
    both = seen.join(taken, ["gy", "word"], "left")
    own = G.first_of([F.col(p) for p in PAVING_ORDER], F.bitwise_not(F.coalesce("_taken", F.lit(0).cast("long"))))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("paving"), m.alias("mask")) for p, m in zip(PAVING_ORDER, own)]))
    return both.select("gy", "word", each.alias("_o")).select("gy", "word", "_o.*").where("mask <> 0")


def paving_words(pieces: DataFrame) -> DataFrame:
    """Words (gy, word) of the cells of sidewalks along pieces (side, half, paving), with a column of masks for each paving."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PAVING_ORDER]), F.col("paving")) - 1
    words = band_masks(pieces, rank, F.col("half"), F.col("half") + SIDEWALK_M)
    return words.groupBy("gy", "word").agg(*[F.bit_or(F.when(F.col("tag") == i, F.col("mask"))).alias(p) for i, p in enumerate(PAVING_ORDER)])


def people_sites(paved: DataFrame) -> DataFrame:
    """People on paved cells (words of `paved_masks`): a cell holds one with its paving's density, at a repeatable place
    inside it."""
    rate = _lookup(PEOPLE_PER_M2, "paving", 0.0)
    u = lambda what: unit_hash(F.lit("people"), F.lit(what), "gx", "gy")
    return G.mask_cells(paved).where(u("keep") < rate).select("gx", "gy", "paving", (F.col("gx") + u("x")).alias("x"), (F.col("gy") + u("y")).alias("y"))


# --------------------------------------------------------------- centre islands


def island_masks(roads: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Cells off every carriageway (`taken`, where its words are at hand) with a one-way carriageway's edge within 8 m on two
    facing sides, as words of 64 along each row (gy, word, mask). Equal lines are read once; a word holds the cells seen
    from each of eight directions, so facing ones are found 64 at a time."""
    lines = roads.where("oneway").groupBy("line", "half").agg(F.min("code").alias("code"))
    one = L.segments(lines, "code").where("len > 0")
    both = one.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    # toward the carriageway: the piece's normal, turned by the side the cell lies on; facing sides point apart
    ux, uy = (F.col("bx") - F.col("ax")) / F.col("len"), (F.col("by") - F.col("ay")) / F.col("len")
    octant = F.floor(F.pmod(F.degrees(F.atan2(-ux * F.col("side"), uy * F.col("side"))), F.lit(360.0)) / 45)
    words, none = band_masks(both, octant, F.col("half"), F.col("half") + ISLAND_REACH_M), F.lit(0).cast("long")
    seen = words.groupBy("gy", "word").agg(*[F.coalesce(F.bit_or(F.when(F.col("tag") == k, F.col("mask"))), none).alias(f"_o{k}") for k in range(9)])
    facing = none
    for k in (3, 4, 5):
        for i in range(9 - k):
            facing = facing.bitwiseOR(F.col(f"_o{i}").bitwiseAND(F.col(f"_o{i + k}")))
    lanes = (carriageway_masks(roads) if taken is None else taken).select("gy", "word", F.col("mask").alias("_lane"))
    free = F.bitwise_not(F.coalesce("_lane", none))
    return seen.join(lanes, ["gy", "word"], "left").select("gy", "word", facing.bitwiseAND(free).alias("mask")).where("mask <> 0")


def islands(labelled: DataFrame) -> DataFrame:
    """Groups of cells (words of `connected_masks`) that are centre islands: at least 15 m2, at most 5% built on, long and thin
    (half the perimeter over 20 m and its square over 8 areas): root, label, area, built, perimeter."""
    count = lambda c: F.sum(F.bit_count(c).cast("long"))
    g = labelled.groupBy("root").agg(count("mask").alias("area"), count("marked").alias("built"), (4 * count("mask") - F.sum("sides")).alias("perimeter"))
    half = F.col("perimeter") / 2
    g = g.where((F.col("area") >= 15) & (F.col("built") <= 0.05 * F.col("area")) & (half > 20) & (half * half / F.col("area") > 8))
    return g.withColumn("label", label_text(F.col("root")))


def island_sites(labelled: DataFrame, keep: DataFrame, every: int = 12) -> DataFrame:
    """Planting on islands: every 3 m along an island a shrub, every 12 m a lamp and a tree in turn. Positions follow the
    global grid along the island's longer axis, so tiles agree."""
    c = G.mask_cells(labelled.select("root", "gy", "word", "mask").join(keep.select("root"), "root", "left_semi"))
    ext = c.groupBy("root").agg((F.max("gx") - F.min("gx") >= F.max("gy") - F.min("gy")).alias("_wide"))
    c = c.join(ext, "root").withColumn("_k", F.when(F.col("_wide"), F.col("gx")).otherwise(F.col("gy"))).withColumn("_o", F.when(F.col("_wide"), F.col("gy")).otherwise(F.col("gx")))
    mid = c.where(F.col("_k") % 3 == 0).groupBy("root", "_wide", "_k").agg(F.floor(F.avg("_o")).cast("long").alias("_m"))
    kind_ = F.when(F.col("_k") % (2 * every) == 0, "lamp").when(F.col("_k") % every == 0, "tree").otherwise("shrub")
    return mid.select(label_text(F.col("root")).alias("label"), F.when(F.col("_wide"), F.col("_k")).otherwise(F.col("_m")).alias("gx"), F.when(F.col("_wide"), F.col("_m")).otherwise(F.col("_k")).alias("gy"), kind_.alias("kind"))
