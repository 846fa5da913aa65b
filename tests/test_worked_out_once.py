"""What many rows share is worked out once, and gives what every row alone would."""

import numpy as np
from pyspark.sql import functions as F

from tests.test_shared_places import gap_to, plan, square_gap, squares, zigzags
from upland.operators import lines as L
from upland.operators import rings as G
from upland.operators import tiles as T
from upland.operators import tracks
from upland.plans import districts as DI
from upland.plans import massing as M


def test_running_sums_name_their_values_once(spark):
    d = spark.createDataFrame([([1.0, 2.0, 4.0],), ([],), (None,), ([0.5] * 300,)], "v array<double>")
    sums = d.select(tracks.running(F.transform("v", lambda x: x * 7777.0), block=128).alias("s"))
    assert plan(sums).count("7777.0") == 1
    got = [r["s"] for r in sums.collect()]
    assert got[:3] == [[0.0, 7777.0, 3 * 7777.0, 7 * 7777.0], [0.0], [0.0]] and got[3] == [i * 0.5 * 7777 for i in range(301)]


def test_facing_edges_name_the_ring_once(spark):
    d = squares(spark, [(1, 0.0, 0.0, 10.0)])
    line = F.array(F.struct(F.lit(-50.0).alias("ax"), F.lit(-20.0).alias("ay"), F.lit(50.0).alias("bx"), F.lit(-20.0).alias("by")))
    moved = lambda edges, m: F.transform(edges, lambda e: F.struct((e["ax"] + m).alias("ax"), e["ay"].alias("ay"), e["bx"].alias("bx"), e["by"].alias("by")))
    out = plan(d.select(G.facing_edges(moved("edges", 7777.0), moved(line, 8888.0)).alias("f")))
    assert out.count("7777.0") == out.count("8888.0") == 1
    assert d.select(G.facing_edges("edges", line).alias("f")).first()["f"] == [0]


def test_hulls_of_many_small_keys_and_a_crowd(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(x), float(y)) for k in range(400) for x, y in rng.integers(0, 9, (k % 7 + 1, 2))]
    rows += [(-1, float(x), float(y)) for x, y in rng.normal(0, 50, (30000, 2))]
    d = spark.createDataFrame(rows, "k long, x double, y double").repartition(3)
    out = G.convex_hulls(d, "k")
    assert "MapInPandas" not in plan(out)                                        # no data frame for each key
    got = {}
    for r in out.orderBy("k", "i").collect():
        got.setdefault(r["k"], []).append((r["x"], r["y"]))
    own = {}
    for k, x, y in rows:
        own.setdefault(k, []).append((x, y))
    assert got == {k: [tuple(p) for p in G._hull(np.array(v)).tolist()] for k, v in own.items()}


def test_backtracks_of_short_and_long_lines_agree(spark, monkeypatch):
    there = [(120.6 + 0.0004 * i, 16.4) for i in range(9)]
    rows = [(c, [(x, y + 1e-5 * (c % 3)) for x, y in there + there[-2::-1]]) for c in range(6)] + [(9, there)]
    d = spark.createDataFrame([(c, [{"lng": x, "lat": y} for x, y in v], [0, len(v) - 1]) for c, v in rows], "code long, line array<struct<lng:double,lat:double>>, stop_idx array<int>")
    short = sorted(tuple(r) for r in L.backtracks(d).collect())
    monkeypatch.setattr(L, "SHORT_LINE", 4)
    assert sorted(tuple(r) for r in L.backtracks(d).collect()) == short and {r[0] for r in short} == set(range(6))


def test_landmark_counts_are_those_of_the_pairs(spark):
    places = spark.createDataFrame([(f"p{i}", 0.01 * (i % 7), 0.01 * (i % 3)) for i in range(60)], "slug string, lng double, lat double")
    box = lambda i: None if i % 5 == 0 else (0.01 * (i % 4) - 0.01, -0.02, 0.01 * (i % 4) + 0.01, 0.005)
    views = spark.createDataFrame([(i, box(i), f"p{i * 3}") for i in range(40)], "vid long, view struct<west:double,south:double,east:double,north:double>, selected string")
    want = sorted((r["vid"], r["count"]) for r in T.landmarks_in_reach(places, views, "vid").groupBy("vid").count().collect())
    assert want and sorted(tuple(r) for r in T.landmark_counts(places, views, "vid").collect()) == want


def test_street_front_meets_outlines_and_segments_once(spark, monkeypatch):
    rows, lines = zigzags(spark, 45)
    blds = [(i, 100.0 * (i % 5) + 40, 60.0 * (i % 3) + 20.0, 8.0) for i in range(90)]
    segs = L.segments(lines.withColumn("street", F.concat(F.lit("s"), F.col("code") % 3)), "code")
    b = squares(spark, blds).withColumn("oid", F.concat(F.lit("way/"), "bid"))
    b = b.select("*", *[F.lit(None).cast("string").alias(c) for c in ("t_height", "t_levels")], F.lit("yes").alias("building"))
    met, plain = [], L.lines_within
    monkeypatch.setattr(L, "lines_within", lambda p, s, m: met.append((p.count(), s.count())) or plain(p, s, m))
    got = {(r["bid"], r["street"]): (r["code"], r["dist"], r["part"]) for r in DI.street_front(b, segs, segs.select("street"), 60.0).collect()}
    assert met == [(15, 45)]                      # 15 outlines of 90 buildings, 15 courses of three segments of 45 lines
    want = {}
    for i, x, y, _ in blds:
        for c, v in rows:
            d = gap_to(x, y, v)
            if d <= 60 and (d, c) < want.get((i, f"s{c % 3}"), (61, 0)):
                want[i, f"s{c % 3}"] = (d, c)
    assert got.keys() == want.keys() and all(abs(want[k][0] - g[1]) < 1e-9 for k, g in got.items()) and {g[2] for g in got.values()} == {1, 2, 3, 4}


def test_landmark_candidates_of_shared_places(spark, monkeypatch):
    blds = [(i, 40.0 * (i % 7), 90.0 * (i % 3), 10.0 + i % 2) for i in range(84)]
    marks = [(i, 60.0 * (i % 3), 30.0 * (i % 2)) for i in range(18)]
    met, plain = [], DI.box_join
    monkeypatch.setattr(DI, "box_join", lambda a, b, *q, **k: met.append((a.count(), b.count())) or plain(a, b, *q, **k))
    got = DI.landmark_candidates(spark.createDataFrame(marks, "lid long, lx double, ly double"), squares(spark, blds), 100.0).collect()
    assert met == [(6, 42)]
    assert sorted((r["lid"], r["bid"], round(r["metres"], 6)) for r in got) == sorted((i, b[0], round(square_gap(x, y, b), 6)) for i, x, y in marks for b in blds if square_gap(x, y, b) <= 100)


def test_prepare_measures_equal_outlines_once(spark, monkeypatch):
    blds = [(i, 40.0 * (i % 7), 90.0 * (i % 3), 10.0) for i in range(84)]
    b = squares(spark, blds).withColumn("oid", F.concat(F.lit("way/"), "bid"))
    ex = squares(spark, [(0, 0.0, 0.0, 20.0)], "rid").select(F.col("edges").alias("redges"), F.col("w").alias("west"), F.col("s").alias("south"), F.col("e").alias("east"), F.col("n").alias("north"))
    met, plain = [], G.drop_touching
    monkeypatch.setattr(G, "drop_touching", lambda s, r, *q: met.append(s.count()) or plain(s, r, *q))
    got = {r["bid"]: (r["area"], r["centre_m"]) for r in M.prepare(b, ex, (200.0, 0.0)).collect()}
    assert met == [21]
    assert got == {q[0]: (100.0, square_gap(200.0, 0.0, q)) for q in blds if (q[1], q[2]) != (0.0, 0.0)}
