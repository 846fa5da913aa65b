"""What is measured in batches, or found once and written, gives what each row alone would."""

import math

from pyspark.sql import functions as F

from upland.operators import lines as L
from upland.operators import rings as G
from upland.plans import districts as DI

EDGES = "array<struct<ax:double,ay:double,bx:double,by:double>>"


def box_edges(w, s, e, n):
    w, s, e, n = map(float, (w, s, e, n))
    p = [(w, s), (e, s), (e, n), (w, n), (w, s)]
    return [{"ax": a, "ay": b, "bx": c, "by": d} for (a, b), (c, d) in zip(p, p[1:])]


def test_gaps_of_outlines_and_segments(spark):
    cases = [
        (1, box_edges(0, 0, 10, 10), (20.0, 5.0, 30.0, 5.0), 10.0),           # an end is nearest
        (2, box_edges(0, 0, 10, 10), (-5.0, 5.0, 15.0, 5.0), 0.0),            # crosses
        (3, box_edges(0, 0, 10, 10), (13.0, -50.0, 13.0, 50.0), 3.0),         # a corner of the outline is nearest
        (4, box_edges(0, 0, 10, 10), (13.0, 14.0, 13.0, 14.0), 5.0),          # a segment without length
        (5, box_edges(0, 0, 10, 10)[:1], (2.0, 3.0, 4.0, 6.0), 3.0),          # another number of edges
        (6, [], (0.0, 0.0, 1.0, 1.0), None),
    ]
    rows = [(k, e, *map(float, s)) for k, e, s, _ in cases]
    d = spark.createDataFrame(rows, f"k long, edges {EDGES}, ax double, ay double, bx double, by double").coalesce(1)
    got = {r["k"]: r["m"] for r in G.segment_gaps(d, ["k"], "edges", "m").collect()}
    assert got.keys() == {1, 2, 3, 4, 5} and all(math.isclose(got[k], m, abs_tol=1e-9) for k, _, _, m in cases if m is not None)


def test_hotels_are_found_once(spark):
    """The buildings of hotels are written before their roads and tiles are looked for, so the result's plan finds none again."""
    blds = [(i, 60.0 * (i % 6), 60.0 * (i // 6), 10.0) for i in range(24)]
    d = spark.createDataFrame(blds, "bid long, cx double, cy double, side double")
    h = F.col("side") / 2
    at = lambda a, b: F.struct((F.col("cx") + a * h).alias("x"), (F.col("cy") + b * h).alias("y"))
    d = d.withColumn("ring", F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1), at(-1, -1))).withColumn("edges", G.edges("ring"))
    d = d.select("*", *[(F.col(c) + k * h).alias(o) for c, k, o in (("cx", -1, "w"), ("cy", -1, "s"), ("cx", 1, "e"), ("cy", 1, "n"))])
    d = d.select("*", F.lit(None).cast("string").alias("t_height"), F.lit(None).cast("string").alias("t_levels"), F.concat(F.lit("way/"), "bid").alias("oid"),
                 (F.lit(120.5) + F.col("cx") / 1e6).alias("lng"), (F.lit(16.3) + F.col("cy") / 1e6).alias("lat"))
    pois = spark.createDataFrame([(7, 2.0, 1.0), (8, 61.0, 0.0), (9, 62.0, 1.0)], "poi_id long, x double, y double")
    areas = d.where("bid in (1, 2)").select(F.col("bid").alias("aid"), F.col("edges").alias("aedges"), F.col("w").alias("west"), F.col("s").alias("south"), F.col("e").alias("east"), F.col("n").alias("north"))
    line = [{"x": -50.0, "y": -20.0}, {"x": 80.0, "y": -20.0}]
    segs = L.segments(spark.createDataFrame([(5, line)], "code long, line array<struct<x:double,y:double>>"), "code")
    got = DI.hotel_buildings(pois, areas, d, segs)
    assert sorted((r["bid"], r["hotel"], r["road"]) for r in got.collect()) == [(0, "point:7", 5), (1, "point:8", 5), (2, "area:2", 5)]
    assert "aedges" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_standing_trees_hold_their_candidates_once(spark):
    """Heights are asked of written places, so the plan does not hold the joins behind them at each reading."""
    from upland.functions import geo
    from upland.plans import flora as FL
    boxes = spark.createDataFrame([(0.0, 0.0, 290.0, 290.0)], "w double, s double, e double, n double")
    d = spark.createDataFrame([(1, box_edges(30, 30, 40, 40), 30.0, 30.0, 40.0, 40.0)], f"bid long, edges {EDGES}, w double, s double, e double, n double")
    segs = L.segments(spark.createDataFrame([(5, [{"x": 0.0, "y": 80.0}, {"x": 60.0, "y": 80.0}])], "code long, line array<struct<x:double,y:double>>"), "code")
    places = FL.tree_candidates(boxes, d, segs)
    x, y = geo.pixel_xy(*geo.planar_lnglat(F.lit(45.0), F.lit(45.0)), 14)
    at = spark.range(1).select(F.floor(x).alias("i"), F.floor(y).alias("j")).first()
    ground = [(14, at["i"] + a, at["j"] + b, 2000.0) for a in range(-30, 31) for b in range(-30, 31)]
    heights = spark.createDataFrame(ground, "z int, gx long, gy long, height double")
    got = FL.standing_trees(places, heights, geo.planar_lnglat, lowest=900.0)
    rows = {r["site_id"]: r for r in got.collect()}
    from upland.functions.ids import unit_hash
    stand = {r["site_id"] for r in places.where(unit_hash(F.lit("stand"), "site_id") < 0.2).collect()}
    assert stand and rows.keys() == stand and all(abs(r["ground"] - 2000.0) < 1e-6 and r["slope_deg"] < 1e-6 for r in rows.values())
    assert "edges" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_lane_marks_bend_once(spark):
    """Two-way marks are solid where the line turns, and marks are made once, not at each reading."""
    from upland.plans import roads as RD
    bent = [(0.0, 0.0), (60.0, 0.0), (60.0, 60.0)]
    d = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in bent], True, 2, False, 3.1)], "code long, line array<struct<x:double,y:double>>, marked boolean, lane_count int, oneway boolean, half double")
    joints = spark.createDataFrame([(0.0, 0.0)], "jx double, jy double")
    got = RD.lane_marks(d, joints)

    def at(t):
        t = min(max(t, 0.0), 120.0)
        return (t, 0.0) if t <= 60 else (60.0, t - 60)

    def heading(t):
        (bx, by), (ax, ay) = at(max(0.0, t - 1)), at(min(120.0, t + 1))
        return math.atan2(ay - by, ax - bx)

    want = []
    for k in range(30):
        t = 2.0 + 4 * k
        turn = abs((heading(min(120.0, t + 14)) - heading(max(0.0, t - 10)) + math.pi) % (2 * math.pi) - math.pi)
        style = "solid" if math.degrees(turn) > 12 else "broken" if math.floor(t / 4) % 2 == 0 else None
        if style and t < 118 and math.hypot(*at(t)) > 12:
            want.append((k, style))
    assert {s for _, s in want} == {"solid", "broken"} and sorted((r["step"], r["style"]) for r in got.collect()) == want
    assert "_arc" not in got._jdf.queryExecution().optimizedPlan().toString()
