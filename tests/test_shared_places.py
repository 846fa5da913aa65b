"""Joins that meet every different place or outline once give what every row alone would."""

import numpy as np
from pyspark.sql import functions as F

from upland.operators import cells
from upland.operators import lines as L
from upland.operators import rings as G
from upland.plans import districts as DI


def squares(spark, rows, key="bid"):
    """Squares (id, cx, cy, side) as buildings with ring, edges and box."""
    d = spark.createDataFrame(rows, f"{key} long, cx double, cy double, side double")
    h = F.col("side") / 2
    at = lambda sx, sy: F.struct((F.col("cx") + sx * h).alias("x"), (F.col("cy") + sy * h).alias("y"))
    d = d.withColumn("ring", F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1), at(-1, -1)))
    return d.withColumn("edges", G.edges("ring")).select("*", (F.col("cx") - h).alias("w"), (F.col("cy") - h).alias("s"), (F.col("cx") + h).alias("e"), (F.col("cy") + h).alias("n"))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def square_gap(x, y, b):
    return float(np.hypot(max(abs(x - b[1]) - b[3] / 2, 0), max(abs(y - b[2]) - b[3] / 2, 0)))


def test_nearest_building_of_points_on_one_place(spark):
    blds = [(i, 50.0 * (i % 7), 40.0 * (i % 3), 10.0 + i % 4) for i in range(60)]
    pts = [(i, 50.0 * (i % 7) + i % 3 * 5, 11.0 * (i % 5)) for i in range(300)]
    got = DI.nearest_building(spark.createDataFrame(pts, "poi_id long, x double, y double"), squares(spark, blds), "poi_id", "bid", 8.0)
    want = []
    for i, x, y in pts:
        near = sorted((int(square_gap(x, y, b) * 1000 + 0.5), b[0]) for b in blds if square_gap(x, y, b) <= 8)
        want += [(i, near[0][1])] if near else []
    assert sorted((r["poi_id"], r["bid"]) for r in got.collect()) == want
    assert "Aggregate [x" in plan(got)           # places are told apart before they meet buildings


def zigzags(spark, n):
    """Lines on few courses, many of them the same, as code and line of x, y."""
    rows = [(i, [(100.0 * (i % 5) + 30 * v, 60.0 * (i % 3) + 10 * (v % 2)) for v in range(4)]) for i in range(n)]
    d = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in v]) for i, v in rows], "code long, line array<struct<x:double,y:double>>")
    return rows, d


def gap_to(x, y, v):
    out = []
    for (ax, ay), (bx, by) in zip(v, v[1:]):
        t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        out.append(float(np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))))
    return min(out)


def test_adjacent_road_of_equal_outlines(spark):
    rows, lines = zigzags(spark, 60)
    blds = [(i, 100.0 * (i % 5) + 40, 60.0 * (i % 3) + 35 + i % 2, 8.0) for i in range(90)]
    got = DI.adjacent_road(squares(spark, blds), L.segments(lines, "code")).collect()
    assert len(got) == 90 and {r["bid"] for r in got} == set(range(90))
    by_outline = {}
    for r in got:
        by_outline.setdefault(blds[r["bid"]][1:], set()).add((r["road"], round(r["road_m"], 6)))
    assert all(len(v) == 1 and next(iter(v))[0] < 15 for v in by_outline.values())     # the least code of equal lines


def test_match_areas_counts_cells_by_rows(spark):
    blds = [(i, 30.0 * (i % 4) + 0.3, 20.0 * (i % 3) + 0.2, 6.0 + i % 5) for i in range(60)]
    areas = [(i, 30.0 * (i % 4) + i % 3 + 0.2, 20.0 * (i % 3) + i % 2 + 0.1, 9.0 + i % 4) for i in range(40)]
    a = squares(spark, areas, "aid").select("aid", F.col("edges").alias("aedges"), F.col("w").alias("west"), F.col("s").alias("south"), F.col("e").alias("east"), F.col("n").alias("north"))
    inside = lambda q, gx, gy: abs(gx + 0.5 - q[1]) < q[3] / 2 and abs(gy + 0.5 - q[2]) < q[3] / 2
    cells = {q: {(x, y) for x in range(-20, 130) for y in range(-20, 70) if inside(q, x, y)} for q in {*blds, *areas}}
    want = sorted((p[0], b[0], len(cells[p] & cells[b]), len(cells[b])) for p in areas for b in blds if len(cells[p] & cells[b]) > 0.5 * len(cells[b]))
    assert want and sorted(tuple(r) for r in DI.match_areas(a, squares(spark, blds)).collect()) == want


def test_cells_of_shapes_by_words(spark):
    """Row by row reading of a ring with a hole gives the cells that `contains` gives, over negative and word edges."""
    ring = [(-70.2, -3.0), (130.4, 2.0), (66.0, 41.7), (-5.5, 9.0), (-70.2, -3.0)]
    hole = [(10.0, 3.0), (20.0, 20.0), (60.0, 11.0), (10.0, 3.0)]
    edges = [{"ax": a, "ay": b, "bx": c, "by": d} for r in (ring, hole) for (a, b), (c, d) in zip(r, r[1:])]
    d = spark.createDataFrame([(1, edges, -70.2, -3.0, 130.4, 41.7)] * 2, "k long, edges array<struct<ax:double,ay:double,bx:double,by:double>>, w double, s double, e double, n double")
    grid = spark.range(-75, 135).select(F.col("id").alias("gx")).crossJoin(spark.range(-5, 45).select(F.col("id").alias("gy")))
    want = grid.crossJoin(d.limit(1)).where(G.contains("edges", F.col("gx") + 0.5, F.col("gy") + 0.5))
    masks = G.cell_masks(d, "k")
    assert sorted((r["gx"], r["gy"]) for r in G.mask_cells(masks).collect()) == sorted((r["gx"], r["gy"]) for r in want.collect())
    assert masks.count() < 200


def test_points_and_lines_on_shared_places(spark):
    rows, lines = zigzags(spark, 45)
    pts = [(i, 100.0 * (i % 5) + 20, 60.0 * (i % 3) + 8 + i % 2) for i in range(120)]
    p = spark.createDataFrame(pts, "vid long, x double, y double")
    want = {(i, c): gap_to(x, y, v) for i, x, y in pts for c, v in rows}
    got = {(r["vid"], r["code"]): r["dist"] for r in L.line_gaps(p, lines, "code", 40.0).collect()}
    assert got.keys() == {k for k, d in want.items() if d <= 40} and all(abs(want[k] - d) < 1e-9 for k, d in got.items())
    near = L.nearest_line(p, L.segments(lines, "code"), point_id="vid", line_id="code", k=4, max_m=40.0)
    best = {}
    for (i, c), d in want.items():
        if d <= 40:
            best.setdefault(i, []).append((int(d * 1000 + 0.5), c))
    assert sorted((r["vid"], r["rank"], r["code"]) for r in near.collect()) == sorted((i, k + 1, c) for i, q in best.items() for k, (_, c) in enumerate(sorted(q)[:4]))


def test_polygons_and_pairs_on_shared_places(spark):
    polys = [(i, 40.0 * (i % 4), 30.0 * (i % 2), 30.0) for i in range(24)]
    pts = [(i, 20.0 * (i % 9) + 1, 15.0 * (i % 4) + 1) for i in range(180)]
    q = squares(spark, polys, "rid").select("rid", "edges", F.col("w").alias("west"), F.col("s").alias("south"), F.col("e").alias("east"), F.col("n").alias("north"))
    p = spark.createDataFrame(pts, "vid long, x double, y double")
    want = sorted((i, b[0]) for i, x, y in pts for b in polys if square_gap(x, y, b) == 0)
    assert sorted((r["vid"], r["rid"]) for r in G.points_in_polygons(p, q).collect()) == want
    n = {rid: sum(1 for _, k in want if k == rid) for _, rid in want}
    assert {r["rid"]: r["n"] for r in G.count_in_polygons(p, q).collect()} == n
    b = spark.createDataFrame([(i, 20.0 * (i % 5), 15.0) for i in range(50)], "id long, dx double, dy double")
    c = [F.col(k) for k in ("x", "y", "dx", "dy")]
    got = cells.within_pairs(p, b, 25.0, a_at=c[:2], b_at=c[2:], distance=F.hypot(c[0] - c[2], c[1] - c[3]), b_id="id", a_site=["x", "y"], b_site=["dx", "dy"])
    assert sorted((r["vid"], r["id"]) for r in got.collect()) == sorted((i, j) for i, x, y in pts for j in range(50) if np.hypot(x - 20 * (j % 5), y - 15) <= 25)


def test_street_measures_of_equal_lines(spark):
    """Copies of a street and of its buildings change no distance; a copy of a line is another line, 0 m away."""
    line = lambda y: [{"x": 30.0 * v, "y": y + v} for v in range(5)]
    table = lambda rows: spark.createDataFrame(rows, "code long, line array<struct<x:double,y:double>>")
    segs = lambda rows: L.segments(table(rows), "code")
    one, many = [(0, line(0.0)), (1, line(9.0))], [(i, line(9.0 * (i % 2))) for i in range(20)]
    blds = [(i, 20.0 + 40 * (i % 3), 20.0, 6.0 + i % 2) for i in range(6)]
    got = lambda rows, b: {(r["code"], r["side"]): (r["front_m"], r["width_m"], r["samples"]) for r in DI.street_measures(segs(rows), squares(spark, b)).collect()}
    want = got(one, blds)
    assert want and got(many, blds + [(i + 10, *q) for i, *q in blds]) == {(i, s): v for i in range(20) for (c, s), v in want.items() if c == i % 2}
    gap = lambda rows: {r["code"]: (round(r["gap_m"], 6), r["samples"]) for r in DI.carriageway_gap(segs(rows).withColumn("lane_count", F.lit(2)), segs(rows)).collect()}
    apart, alone = gap(one), gap(many)
    assert apart.keys() == {0, 1} and all(8 < d < 9 for d, _ in apart.values())
    assert alone.keys() == set(range(20)) and all(d < 1e-6 for d, _ in alone.values())
    assert sorted(tuple(r) for r in L.alike_lines(segs(many), "code").collect()) == [(i, i % 2, 10) for i in range(20)]
