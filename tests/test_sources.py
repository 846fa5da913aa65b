"""Files in and out."""

import json

from pyspark.sql import functions as F

from upland.operators import rings as G, tiles as T
from upland.sources import geojson, osm, refresh


def test_point_features(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [120.6, 16.4]}, "properties": {"slug": "a", "name": "A", "hours": {"open": "08:00", "close": "17:00"}, "elevation_m": 1500}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc, indent=1))
    r = geojson.read_points(spark, str(tmp_path / "a.geojson")).first()
    assert (r["slug"], r["lng"], r["lat"], r["hours"]["open"], r["elevation_m"]) == ("a", 120.6, 16.4, "08:00", 1500.0)
    (tmp_path / "b.geojson").write_text('{"type": "FeatureCollection", "features": null}')
    assert geojson.read_points(spark, str(tmp_path / "b.geojson")).count() == 0


def test_route_features(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}, "properties": {"code": "R", "name": "R", "kind": "JEEPNEY", "fareBase": 13, "farePerKm": 1.8, "stops": [{"name": "s", "seq": 1, "coord": [1, 2]}]}}]}
    (tmp_path / "r.geojson").write_text(json.dumps(doc))
    r = geojson.read_routes(spark, str(tmp_path / "r.geojson")).first()
    assert r["line"][1]["lat"] == 4 and r["stops"][0]["lng"] == 1 and str(r["fare_per_km"]) == "1.80"


def test_history_key_styles(spark, tmp_path):
    doc = {"eras": [{"key": "A", "name": "a", "startYear": 1900, "endYear": None, "summary": ""}, {"key": "B", "name": "b", "start_year": 1950, "end_year": 1960, "summary": ""}],
           "events": [{"title": "t", "year": 1910, "era": "A", "description": "", "coord": None}, {"title": "u", "year": 1955, "era": "B", "description": "", "coord": [120.6, 16.4]}]}
    (tmp_path / "h.json").write_text(json.dumps(doc))
    eras, events = geojson.read_history(spark, str(tmp_path / "h.json"))
    assert [(r["key"], r["start_year"], r["end_year"]) for r in eras.orderBy("key").collect()] == [("A", 1900, None), ("B", 1950, 1960)]
    assert [(r["title"], r["lng"]) for r in events.orderBy("title").collect()] == [("t", None), ("u", 120.6)]


def test_elements_and_relations(spark, tmp_path):
    p = lambda x, y: {"lat": y, "lon": x}
    sq = [p(0, 0), p(4, 0), p(4, 4), p(0, 4), p(0, 0)]
    hole = [p(1, 1), p(2, 1), p(2, 2), p(1, 2), p(1, 1)]
    doc = {"elements": [
        {"type": "way", "id": 1, "tags": {"building": "yes"}, "geometry": sq}, {"type": "way", "id": 2, "tags": {"building": "yes"}, "geometry": sq[:4]},
        {"type": "relation", "id": 3, "tags": {"building": "yes"}, "members": [{"type": "way", "ref": 1, "role": "outer", "geometry": sq[:3]}, {"type": "way", "ref": 2, "role": "outer", "geometry": sq[2:][::-1]}, {"type": "way", "ref": 3, "role": "inner", "geometry": hole}]},
        {"type": "relation", "id": 4, "tags": {}, "members": [{"type": "way", "ref": 1, "role": "outer", "geometry": sq[:3]}]},
        {"type": "node", "id": 5, "lat": 1.0, "lon": 2.0, "tags": {"natural": "tree"}}]}
    (tmp_path / "o.json").write_text(json.dumps(doc))
    el = osm.read_elements(spark, str(tmp_path / "o.json"))
    assert el.count() == 5
    rings = osm.polygons(el)
    xy = lambda c: F.transform(F.col(c)[0], lambda q: F.struct(q["lon"].alias("x"), q["lat"].alias("y")))
    got = {r["id"]: (r["a"], r["n"]) for r in rings.select("id", G.area(xy("outer")).alias("a"), F.size("inner").alias("n")).collect()}
    assert got == {"way/1": (16.0, 0), "relation/3": (16.0, 1)}
    assert [r["cls"] for r in el.where("id = 5").select(F.explode(osm.element_classes()).alias("cls")).collect()] == ["tree"]


def test_tiles_round_trip(spark, tmp_path):
    d = spark.range(300).select(F.lit(16).alias("z"), (F.col("id") % 3).alias("x"), F.lit(1).alias("y"), "id", (120.5 + F.col("id") / 1000).alias("lng"), F.lit(16.4).alias("lat"))
    T.write_tiles(d, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    m = lambda df: {(r["x"], r["rows"], r["sha256"]) for r in T.manifest(df, ["z", "x", "y"], ["id"]).collect()}
    assert m(d) == m(back)


def test_full_refresh_twice(spark, tmp_path):
    t = {"eras": (spark.createDataFrame([("A",)], "key string"), ("key",)), "events": (spark.createDataFrame([("A", 1900, "x"), ("A", 1901, "y")], "era string, year int, title string"), ("era", "year", "title"))}
    runs = []
    for _ in range(2):
        counts = {r["table"]: r["rows"] for r in refresh.full_refresh(t, str(tmp_path / "c")).collect()}
        runs.append((counts, sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "c" / "events")).collect())))
    assert runs[0] == runs[1] and runs[0][0] == {"eras": 1, "events": 2}


def test_index_search_reads_its_buckets(spark):
    import random
    from uuid import uuid4

    from upland.operators import places as P
    from upland.session import shared_folder
    r = random.Random(2)
    rows = [(i, " ".join(r.choices(["market", "river", "stone", "lamp", "the", "walking", "walked"], k=r.randint(0, 6)))) for i in range(300)] + [(300, None), (301, "stone river stone river"), (301, "stone river")]
    d = spark.createDataFrame(rows, "id int, body string")
    path = f"{shared_folder(spark)}/index_tests/{uuid4().hex}"
    P.write_index(d, "id", path, "body", buckets=16)
    for q in ("river", "stone the river", "walking lamp", "market nowhere", "the", ""):
        got = sorted(x["id"] for x in P.index_search(spark, path, "id", q, buckets=16).collect())
        assert got == sorted({x["id"] for x in P.text_search(d, q, "body").collect()}), q
    plan = P.index_search(spark, path, "id", "stone river", buckets=16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(bucket") == 2 and "(bucket#" in plan


def test_bilinear_by_blocks(spark, monkeypatch):
    import math
    import random

    from upland.functions import geo
    from upland.operators import raster as R
    monkeypatch.setattr(R, "CROWD", 20)
    r = random.Random(6)
    z, n = 14, 2.0 ** 14 * 256
    base = 64 * 54_000, 64 * 29_800
    height = {(base[0] + i, base[1] + j): r.uniform(900, 1500) for i in range(-3, 130) for j in range(-3, 70) if r.random() > 0.01}
    h = spark.createDataFrame([(z, x, y, v) for (x, y), v in height.items()] + [(13, base[0], base[1], 1.0), (z, base[0] + 500, base[1], None)], "z int, gx long, gy long, height double")
    spots = [(r.uniform(-4, 131), r.uniform(-4, 71)) for _ in range(800)] + [(64.25, 10.5)] * 60 + [(63.5, 63.5), (64.0, 64.0), (127.999, 20.0)]
    lnglat = lambda u, v: (u / n * 360 - 180, math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * v / n)))))
    rows = [(i, f"k{i}", *lnglat(base[0] + a, base[1] + b)) for i, (a, b) in enumerate(spots)]
    d = spark.createDataFrame(rows, "id int, name string, lng double, lat double")
    px = {x["id"]: (x["u"], x["v"]) for x in d.select("id", *[c.alias(a) for c, a in zip(geo.pixel_xy("lng", "lat", z), "uv")]).collect()}
    got = {(x["id"], x["name"]): x["ground"] for x in R.sample_bilinear(d, h, ["id", "name"]).collect()}
    want = {}
    for i, (u, v) in px.items():
        a, b = math.floor(u), math.floor(v)
        four = [height.get((a + p, b + q)) for p in (0, 1) for q in (0, 1)]
        if None not in four:
            fu, fv = u - a, v - b
            want[(i, f"k{i}")] = (1 - fu) * ((1 - fv) * four[0] + fv * four[1]) + fu * ((1 - fv) * four[2] + fv * four[3])
    assert got.keys() == want.keys() and len(want) > 700
    assert all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)


def test_publish_swaps_whole_and_keeps_what_is_alike(spark):
    from uuid import uuid4

    from upland.session import shared_folder
    from upland.sources import publish as PB
    root = f"{shared_folder(spark)}/publish_tests/{uuid4().hex}"
    rows = [(x, i, 120.0 + x, 16.0, f"r{i}") for x in range(4) for i in range(5)]
    table = lambda rows: spark.createDataFrame(rows, "x int, i int, lng double, lat double, name string")
    put = lambda rows: {r["x"]: r["outcome"] for r in PB.publish_tiles(table(rows), root, ["x"], ["i", "name"]).collect()}
    read = lambda: sorted(tuple(r) for r in PB.read_tiles(spark, root, ["x"], "i int, name string").select("x", "i", "name").collect())
    assert set(put(rows).values()) == {"new"} and read() == sorted((r[0], r[1], r[4]) for r in rows)
    assert set(put(rows[::-1]).values()) == {"kept"}
    other = [r for r in rows if r[0] != 3] + [(2, 9, 122.0, 16.0, "more"), (7, 0, 127.0, 16.0, None)]
    assert put(other) == {0: "kept", 1: "kept", 2: "changed", 7: "new"}
    assert read() == sorted(((r[0], r[1], r[4]) for r in other), key=lambda r: (r[0], r[1]))
    # a run that was lost before its manifest changes nothing
    table(rows).write.parquet(f"{root}/runs/{uuid4().hex}")
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{root}/manifests/v=9")
    spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jvm.java.net.URI(root), spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifests/v=9/_SUCCESS"), False)
    assert PB.versions(spark, root) == [1, 2, 3] and len(read()) == len(other)


def test_publish_tables_by_content(spark):
    from uuid import uuid4

    from upland.session import shared_folder
    from upland.sources import publish as PB
    root = f"{shared_folder(spark)}/publish_tests/{uuid4().hex}"
    a = lambda v: spark.createDataFrame([(i, f"n{i}", v) for i in range(10)], "k int, name string, v int")
    out = lambda **t: {r["name"]: (r["outcome"], r["rows"]) for r in PB.publish_tables({n: (d, ("name",)) for n, d in t.items()}, root).collect()}
    assert out(p=a(1), c=a(2)) == {"p": ("new", 10), "c": ("new", 10)}
    assert out(p=a(1).repartition(3), c=a(3)) == {"p": ("kept", 10), "c": ("changed", 10)}
    assert out(p=a(1).limit(0), c=a(3), d=a(None)) == {"p": ("changed", 0), "c": ("kept", 10), "d": ("new", 10)}
