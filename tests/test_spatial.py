"""Cell joins against brute force, with crowded cells, ties and partition counts varied."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from upland.operators import cells, lines as L, rings as G, tiles as T
from upland.plans import districts as DI, roads as RD
from upland.operators import cellgroups
from upland.operators.cellgroups import connected_cells
from upland.operators.graph import components


def crowd(n, seed=1):
    """A third of the points in one metre, a sixth on one spot, the rest spread over 20 km."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = i % 6
        x, y = (500 + rng.random(), 500 + rng.random()) if k < 2 else (700.0, 700.0) if k == 2 else (rng.uniform(0, 20000), rng.uniform(0, 20000))
        out.append((i, x, y))
    return out


def knn(spark, o, p, k, **kw):
    a = spark.createDataFrame(o, "oid int, x double, y double")
    b = spark.createDataFrame(p, "pid int, px double, py double")
    d = cells.nearest(a, b, k, origin_id="oid", origin_at=lambda: [F.col("x"), F.col("y")], item_at=lambda: [F.col("px"), F.col("py")],
                      distance=F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")), tie=["pid"], same_site=["px", "py"], **kw)
    return sorted((r["oid"], r["rank"], r["pid"]) for r in d.collect())


def brute(o, p, k, most=None, skip=False):
    P = np.array([(x, y) for _, x, y in p])
    ids = np.array([i for i, *_ in p])
    out = []
    for i, x, y in o:
        d = np.hypot(P[:, 0] - x, P[:, 1] - y)
        ok = np.ones(len(d), bool) if most is None else d <= most
        if skip:
            ok &= ids != i
        order = sorted(np.flatnonzero(ok), key=lambda j: (math.floor(d[j] * 1000 + 0.5), ids[j]))[:k]
        out += [(i, r + 1, int(ids[j])) for r, j in enumerate(order)]
    return sorted(out)


def test_knn_crowded(spark):
    o, p = crowd(300, 2), crowd(3000, 3)
    assert knn(spark, o, p, 4) == brute(o, p, 4)


def test_knn_max_distance_and_self(spark):
    p = crowd(1500, 4)
    assert knn(spark, p[:200], p, 2, max_m=300.0, exclude=F.col("oid") == F.col("pid")) == brute(p[:200], p, 2, 300.0, True)


def test_knn_shuffled_tables(spark, monkeypatch):
    monkeypatch.setattr(cells, "BROADCAST_ROWS", 0)
    o, p = crowd(100, 5), crowd(1200, 6)
    assert knn(spark, o, p, 3) == brute(o, p, 3)


def test_knn_empty_and_few(spark):
    assert knn(spark, crowd(5), [], 2) == []
    assert knn(spark, crowd(5), [(7, 1.0, 1.0)], 2) == brute(crowd(5), [(7, 1.0, 1.0)], 2)


def test_within_pairs_salted(spark, monkeypatch):
    monkeypatch.setattr(cells, "HOT_ROWS", 20)
    o, p = crowd(60, 7), crowd(400, 8)
    a = spark.createDataFrame(o, "oid int, x double, y double").repartition(5)
    b = spark.createDataFrame(p, "pid int, px double, py double")
    at = lambda *c: [F.col(v) for v in c]
    d = cells.within_pairs(a, b, 250.0, a_at=at("x", "y"), b_at=at("px", "py"), distance=F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")), b_id="pid")
    got = sorted((r["oid"], r["pid"]) for r in d.collect())
    assert got == sorted((i, j) for i, x, y in o for j, u, v in p if math.hypot(x - u, y - v) <= 250)


def test_box_join_mixed_sizes(spark):
    rng = random.Random(9)
    box = lambda i: (i, *(lambda x, y, w, h: (x, y, x + w, y + h))(rng.uniform(-500, 500), rng.uniform(-500, 500), rng.choice([0, 1, 40, 900]), rng.choice([0, 3, 200])))
    A, B = [box(i) for i in range(120)], [box(i) for i in range(90)]
    a = spark.createDataFrame(A, "aid int, w double, s double, e double, n double")
    b = spark.createDataFrame(B, "bid int, bw double, bs double, be double, bn double")
    at = lambda p: [F.col(p + c) for c in "wsen"]
    hit = lambda p, q: p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2]
    want = sorted((p[0], q[0]) for p in A for q in B if hit(p, q))
    got = cells.box_join(a, b, at(""), at("b"), F.lit(True))
    assert sorted((r["aid"], r["bid"]) for r in got.select("aid", "bid").collect()) == want
    met = {i for i, _ in want}
    assert {r["aid"] for r in cells.box_join(a, b, at(""), at("b"), F.lit(True), "left_semi").collect()} == met
    assert {r["aid"] for r in cells.box_join(a, b, at(""), at("b"), F.lit(True), "left_anti").collect()} == {p[0] for p in A} - met


def lines(spark, n=25, seed=10):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        x, y = rng.uniform(0, 3000), rng.uniform(0, 3000)
        pts = [(x, y)]
        for _ in range(rng.randint(1, 6)):
            x, y = x + rng.uniform(-300, 300), y + rng.uniform(-300, 300)
            pts.append((x, y))
        rows.append((c, pts))
    return rows, spark.createDataFrame(rows, "code int, line array<struct<x:double,y:double>>")


def seg_d(px, py, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0, min(1, ((px - a[0]) * dx + (py - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.hypot(px - a[0] - t * dx, py - a[1] - t * dy)


def test_nearest_line_with_long_segments(spark):
    rows, df = lines(spark)
    pts = crowd(80, 11)
    p = spark.createDataFrame(pts, "pid int, x double, y double")
    got = {r["pid"]: (r["code"], round(r["dist"], 6)) for r in L.nearest_line(p, L.segments(df, "code"), point_id="pid", line_id="code", longest=20.0).collect()}
    for i, x, y in pts:
        best = min((math.floor(min(seg_d(x, y, a, b) for a, b in zip(g, g[1:])) * 1000 + 0.5), c) for c, g in rows)
        assert got[i][0] == best[1] and abs(got[i][1] * 1000 - best[0]) <= 0.51


def test_points_along_cover_the_line(spark):
    rows, df = lines(spark)
    got = {}
    for r in L.points_along(L.segments(df, "code"), 8.0).collect():
        got.setdefault(r["code"], []).append(r["step"])
    for c, g in rows:
        total = sum(math.dist(a, b) for a, b in zip(g, g[1:]))
        assert sorted(got[c]) == list(range(math.ceil(total / 8.0 - 1e-9)))


def test_polygon_with_hole(spark):
    sq = lambda h: [(-h, -h), (h, -h), (h, h), (-h, h), (-h, -h)]
    poly = spark.createDataFrame([(1, [sq(10.0), sq(4.0)])], "pid int, rings array<array<struct<x:double,y:double>>>").withColumn("edges", G.all_edges("rings"))
    poly = poly.select("pid", "edges", F.lit(-10.0).alias("west"), F.lit(-10.0).alias("south"), F.lit(10.0).alias("east"), F.lit(10.0).alias("north"))
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 7.0, 0.5), (3, 12.0, 0.0), (4, -5.0, -9.0)], "id int, x double, y double")
    assert {r["id"] for r in G.points_in_polygons(pts, poly, "left_semi").collect()} == {2, 4}
    assert {r["id"] for r in G.points_in_polygons(pts, poly, "left_anti").collect()} == {1, 3}


def test_hull_of_crowd(spark):
    pts = [(1, x, y) for _, x, y in crowd(500, 12)]
    d = spark.createDataFrame(pts, "k int, x double, y double").repartition(7)
    got = sorted((r["x"], r["y"]) for r in G.convex_hulls(d, "k").collect())
    assert got == sorted(map(tuple, G._hull(np.array([(x, y) for _, x, y in pts]))))


def test_simplify(spark):
    g = [(0.0, 0.0), (1.0, 0.0001), (2.0, 0.0), (2.0, 1.0)]
    d = spark.createDataFrame([(1, g), (2, [(0.0, 0.0), (0.0, 0.0)])], "id int, line array<struct<lng:double,lat:double>>")
    got = {r["id"]: r["s"] for r in d.select("id", L.simplify("line", 0.0012).alias("s")).collect()}
    assert [(p["lng"], p["lat"]) for p in got[1]] == [(0, 0), (2, 0), (2, 1)] and got[2] is None


def test_connected_cells(spark):
    rng = random.Random(13)
    pts = {(x, 0) for x in range(60)} | {(x, 5) for x in range(0, 40)} | {(0, y) for y in range(3, 6)} | {(rng.randrange(80), rng.randrange(20, 40)) for _ in range(300)}
    d = spark.createDataFrame(sorted(pts), "gx long, gy long")
    got = {}
    for r in connected_cells(d).collect():
        got.setdefault(r["label"], set()).add((r["gx"], r["gy"]))
    todo, want = set(pts), []
    while todo:
        group, stack = set(), [next(iter(todo))]
        while stack:
            c = stack.pop()
            if c in todo:
                todo.remove(c)
                group.add(c)
                stack += [(c[0] + 1, c[1]), (c[0] - 1, c[1]), (c[0], c[1] + 1), (c[0], c[1] - 1)]
        want.append(group)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_connected_cells_over_tiles(spark, monkeypatch):
    """A comb, a spiral and scattered cells over many small tiles, with negative places: groups, sides and marks."""
    monkeypatch.setattr(cellgroups, "TILE", 8)
    rng = random.Random(17)
    pts = {(x, y) for x in range(-40, 40, 2) for y in range(-30, 0)} | {(x, 0) for x in range(-40, 40)}
    x, y, dx, dy = 60, 0, 1, 0
    for leg in range(2, 60, 2):
        for _ in range(leg):
            pts.add((x, y))
            x, y = x + dx, y + dy
        dx, dy = -dy, dx
    pts |= {(rng.randrange(-100, -50), rng.randrange(-50, 50)) for _ in range(2500)}
    marks = {(rng.randrange(-100, 100), rng.randrange(-50, 50)) for _ in range(3000)}
    table = lambda s: spark.createDataFrame(sorted(s), "gx long, gy long")
    rows = connected_cells(table(pts), table(marks)).collect()
    beside = lambda c: [(c[0] + 1, c[1]), (c[0] - 1, c[1]), (c[0], c[1] + 1), (c[0], c[1] - 1)]
    label, todo = {}, sorted(pts)
    for first in todo:
        stack = [first]
        while stack:
            c = stack.pop()
            if c in pts and c not in label:
                label[c] = f"{first[0] + 10**9:012d},{first[1] + 10**9:012d}"
                stack += beside(c)
    want = {c: (label[c], sum(n in pts for n in beside(c)), c in marks) for c in pts}
    assert {(r["gx"], r["gy"]): (r["label"], r["sides"], r["marked"]) for r in rows} == want and len(rows) == len(pts)
    assert connected_cells(table(pts).limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    up = {}

    def find(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    rng.shuffle(links)
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {a: find(a) for link in links for a in link if link[0] != link[1]}


def test_quadtree_equals_recursive_split(spark):
    rng = random.Random(14)
    pts = [(i, 120.6 + rng.gauss(0, 0.01) * (1 if i % 3 else 0.0001), 16.4 + rng.gauss(0, 0.01) * (1 if i % 3 else 0.0001)) for i in range(600)]
    tile = lambda lng, lat, z: (int((lng + 180) / 360 * 2**z), int((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * 2**z))

    def split(items, z, cap, out):
        if len(items) <= cap or z >= 18:
            for i in items:
                out[i[0]] = z
            return
        kids = {}
        for i in items:
            kids.setdefault(tile(i[1], i[2], z + 1), []).append(i)
        for k in kids.values():
            split(k, z + 1, cap, out)

    want, roots = {}, {}
    for p in pts:
        roots.setdefault(tile(p[1], p[2], 13), []).append(p)
    for items in roots.values():
        split(items, 13, 20, want)
    d = spark.createDataFrame(pts, "id int, lng double, lat double")
    assert {r["id"]: r["z"] for r in T.quadtree(d, 20, 13).collect()} == want


def test_chunks_do_not_depend_on_partitions(spark):
    d = spark.range(101).withColumn("k", F.lit("a"))
    want = {}
    for part, ids in enumerate(np.array_split(np.arange(101), 6), 1):
        want.update({int(i): part for i in ids})
    for n in (1, 8):
        assert {r["id"]: r["part"] for r in DI.equal_chunks(d.repartition(n), ["k"], ["id"], 6).collect()} == want


def test_thin_and_manifest_do_not_depend_on_partitions(spark):
    d = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("x"), F.lit(120.6).alias("lng"), F.lit(16.4).alias("lat"))
    thin = [sorted(r["id"] for r in T.thin_half(d.repartition(n), ["x"], "id").collect()) for n in (1, 8)]
    assert thin[0] == thin[1] and len(thin[0]) == 249
    man = [sorted((r["x"], r["rows"], r["sha256"]) for r in T.manifest(d.repartition(n), ["x"], ["id"]).collect()) for n in (1, 8)]
    assert man[0] == man[1]


def test_stop_uturns_and_relocation(spark):
    from upland.plans import route_qa as Q
    deg = 1 / 111_195.0
    out = [(120.6 + i * 10 * deg, 16.4) for i in range(11)]
    spur = [(120.6 + 100 * deg, 16.4 + i * 10 * deg) for i in range(1, 9)]
    g = out + spur + spur[-2::-1] + [(120.6 + (100 + i * 10) * deg, 16.4) for i in range(0, 11)]
    d = spark.createDataFrame([("R", g, [0, 18, len(g) - 1])], "code string, line array<struct<lng:double,lat:double>>, stop_idx array<int>")
    u = L.stop_uturns(d).collect()
    assert len(u) == 1 and u[0]["at"] == 18 and 75 <= u[0]["spur_m"] <= 90
    s = spark.createDataFrame([("R", 1, 120.6 + 50 * deg, 16.4 + 20 * deg, out, 0, 10), ("R", 2, 120.6 + 50 * deg, 16.4 + 900 * deg, out, 0, 10)],
                              "code string, seq int, lng double, lat double, trunk array<struct<lng:double,lat:double>>, from_idx int, to_idx int")
    got = {r["seq"]: (r["outcome"], round(r["moved_m"])) for r in Q.relocate_stops(s).collect()}
    assert got[1] == ("moved", 20) and got[2][0] == "refused: too far"


def test_equal_chunks_of_many_wide_rows(spark):
    """A million rows in three groups: parts equal ntile's, though each range shuffle samples its own bounds."""
    from pyspark.sql import Window
    d = spark.range(1_000_000).select((F.col("id") % 3).alias("k"), F.pmod(F.xxhash64("id"), F.lit(50_000)).alias("v"), "id", F.md5(F.col("id").cast("string")).alias("wide"))
    got = DI.equal_chunks(d, ["k"], ["v", "id"], 6).select("id", "part")
    want = d.select("id", F.ntile(6).over(Window.partitionBy("k").orderBy("v", "id")).alias("want"))
    assert got.join(want, "id").where("part = want").count() == 1_000_000
    assert DI.equal_chunks(d.limit(1000), ["k"], ["id"]).groupBy("k", "part").count().agg(F.min("count"), F.max("count")).first()[1] <= 20


def test_box_joins_start_no_job_while_planned(spark):
    def started():
        return spark.sparkContext._jsc.sc().dagScheduler().nextJobId()

    x, y = F.col("x"), F.col("y")
    pts = spark.range(50).select("id", (F.col("id") * 3.0).alias("x"), (F.col("id") * 2.0).alias("y"))
    boxes = spark.range(9).select((F.col("id") * 11.0).alias("w"), (F.col("id") * 11.0).alias("s"), (F.col("id") * 11.0 + 4).alias("e"), (F.col("id") * 11.0 + 4).alias("n"))
    before = started()
    for _ in range(3):
        pts = cells.box_join(pts, boxes, [x, y, x, y], [F.col(c) for c in "wsen"], F.lit(True), "left_anti")
    assert started() == before
    inside = {i for i in range(50) for b in range(9) if 11 * b <= 3 * i <= 11 * b + 4 and 11 * b <= 2 * i <= 11 * b + 4}
    assert {r["id"] for r in pts.collect()} == set(range(50)) - inside


def test_knn_by_place_searches_each_place_once(spark):
    """Origins on shared places give what each would alone, and the cell tables on the driver stay small."""
    p = crowd(1200, 21)
    o = [(i, *crowd(40, 22)[i % 40][1:]) for i in range(400)] + [(1000 + i, *p[i][1:]) for i in range(60)]
    assert knn(spark, o, p, 3, origin_site=["x", "y"]) == brute(o, p, 3)
    q = p[:200] + [(5000 + i, *p[i][1:]) for i in range(200)]
    assert knn(spark, q, q, 2, origin_site=["x", "y"], exclude=F.col("oid") == F.col("pid")) == brute(q, q, 2, None, True)
    assert knn(spark, q, p, 2, origin_site=["x", "y"], max_m=40.0) == brute(q, p, 2, 40.0)
    assert cells.BROADCAST_ROWS <= 20_000 and spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "256k"
