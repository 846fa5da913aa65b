"""Values that must come out exactly."""


import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from upland.functions import fares, geo, hours, ids, text
from upland.operators import places as P
from upland.plans import roads as RD
from upland.streaming import submissions as S


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def each(spark, values, fn, kind="double"):
    return [r["v"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", fn(F.col("x")).alias("v")).orderBy("i").collect()]


def test_haversine(spark):
    assert abs(one(spark, geo.haversine_km(F.lit(120.5936), F.lit(16.4116), F.lit(120.628), F.lit(16.4201))) - 3.79) < 0.05


def test_fares(spark):
    trad = lambda b, p: lambda x: fares.traditional_fare(x, F.lit(b), F.lit(p))["fare"]
    assert each(spark, [3.2, 4.3, 5.0, 25.0, 50.0], trad(14.0, 2.0)) == [14, 16, 16, 56, 106]
    assert each(spark, [5.0], trad(13.0, 1.8)) == [14.75]
    assert each(spark, [0.4, 3.2, 4.3, 5.0, 7.2, 10.0, 26.0], lambda x: fares.modern_fare(x)["fare"]) == [17, 17, 19, 19, 25, 29, 61]
    assert each(spark, [3.2, 4.3, 5.0, 10.0, 26.0], lambda x: fares.modern_fare(x, True)["fare"]) == [13.5, 15.25, 15.25, 23.25, 48.75]


def test_money_parts_sum_to_fare(spark):
    for f in (fares.taxi_fare(F.col("x")), fares.modern_fare(F.col("x"), True), fares.traditional_fare(F.col("x"), F.lit(13.0), F.lit(1.8))):
        d = spark.createDataFrame([(v,) for v in (0.3, 4.0, 7.7, 23.1)], "x double").select(f.alias("f"))
        rows = d.select("f.fare", F.aggregate(F.map_values(fares.money_parts("f.breakdown")), F.lit(0.0), lambda a, v: a + v).alias("s")).collect()
        assert all(abs(r["fare"] - r["s"]) < 1e-9 for r in rows)


def test_guide_lapse(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, fares.guide_lapsed(ts("2026-06-30 23:00:00"))) is False
    assert one(spark, fares.guide_lapsed(ts("2026-07-01 00:00:00"))) is True


def test_uuid_v5(spark):
    assert one(spark, ids.uuid_v5(F.lit("www.example.com"), str(uuid.NAMESPACE_DNS))) == "2ed6657d-e927-568b-95e1-2665a8aea6a2"
    names = [f"place-{i}" for i in range(50)]
    assert each(spark, names, lambda x: ids.uuid_v5(x, ids.ROW_NAMESPACE), "string") == [str(uuid.uuid5(uuid.UUID(ids.ROW_NAMESPACE), n)) for n in names]


def test_crc(spark):
    names = ["way/1", "way/22w", "relation/9"]
    assert each(spark, names, ids.crc_of, "string") == [zlib.crc32(n.encode()) for n in names]


def test_tm_round_trip_and_scale(spark):
    d = spark.createDataFrame([(120.5 + i * 0.01, 16.3 + i * 0.01) for i in range(20)], "lng double, lat double")
    from upland.operators.quality import round_trip
    assert round_trip(d).first()["worst_m"] < 1e-6
    e, n = geo.tm_forward(F.lit(geo.CITY_CENTRE[0]), F.lit(geo.CITY_CENTRE[1]))
    assert abs(one(spark, e)) < 1e-9 and abs(one(spark, n)) < 1e-6


def test_open_hours(spark):
    h = lambda a, b: F.struct(F.lit(a).alias("open"), F.lit(b).alias("close"))
    at = lambda hh, m: one(spark, hours.open_at(hh, F.lit(m)))
    assert at(h("20:00", "02:00"), 60) and not at(h("20:00", "02:00"), 120) and at(h("20:00", "02:00"), 1200)
    assert at(h("08:00", "08:00"), 5) and at(h("08:00", "17:00"), 480) and not at(h("08:00", "17:00"), 1020)
    assert one(spark, hours.local_minutes(F.lit("2024-01-01 16:00:00").cast("timestamp"))) == 0


def test_address_classes(spark):
    bad = ["10.0.0.1", "172.16.0.1", "192.168.1.1", "127.0.0.1", "169.254.1.1", "100.64.0.1", "0.0.0.0", "::1", "fe80::1", "fd00::1", "::ffff:10.0.0.1", "host", "1.2.3"]
    assert not any(each(spark, bad, text.is_public_address, "string"))
    assert all(each(spark, ["8.8.8.8", "172.32.0.1", "100.128.0.1", "2606:4700::1111"], text.is_public_address, "string"))


def test_quotes(spark):
    page = F.lit("We are OPEN  daily\nfrom 8:00 am to 9:00 pm.")
    assert one(spark, text.quote_found(page, F.lit("open daily from 8:00 am")))
    assert not one(spark, text.quote_found(page, F.lit("open daily")))
    assert not one(spark, text.quote_found(page, F.lit("daily open from 8:00 am to")))


def test_html_and_redaction(spark):
    assert one(spark, text.html_to_text(F.lit("<p>a&nbsp;b</p><SCRIPT>x<y</SCRIPT>c&amp;d"))).split() == ["a", "b", "c&d"]
    assert one(spark, text.redact_status_url(F.lit("https://h/corrections/status/abc?x=1"))) == "https://h/corrections/status/[token]?x=1"


def test_bbox_and_zoom():
    assert P.parse_bbox(None) is None and P.parse_bbox("  ") is None
    assert P.parse_bbox("120.6,16.4,120.55,16.35") == (120.55, 16.35, 120.6, 16.4)
    assert P.parse_bbox(",1,200,2") == (120.5, 16.3, 120.7, 16.3)
    for bad in ("1,2,3", "a,1,2,3", "nan,1,2,3", "inf,1,2,3"):
        with pytest.raises(ValueError):
            P.parse_bbox(bad)
    assert [P.parse_zoom(z) for z in (None, "0", "13.5", "99")] == [14, 1, 14, 22]
    with pytest.raises(ValueError):
        P.parse_zoom("x")


def test_shape_checks(spark):
    assert each(spark, ["burnham-park", "A", "a--b", "a" * 81], text.is_slug, "string") == [True, False, False, False]
    assert each(spark, ["R-1", "r1", "R-", "A" * 17], text.is_route_code, "string") == [True, False, False, False]
    assert each(spark, ["c" * 25, "short", "x" * 41], text.is_row_id, "string") == [True, False, False]


NOW = 1_000_000.0


def parse(spark, **fields):
    base = {"page": "/destinations/burnham-park", "message": "The boat rental closes at 5 pm now.", "email": "reader@example.test", "name": "", "link": "", "website": "", "startedAt": str(int(NOW) - 3001)}
    row = {**base, **fields}
    d = spark.createDataFrame([tuple(row[k] for k in sorted(row))], ", ".join(f"{k} string" for k in sorted(row)))
    return S.parse(d, F.lit(NOW)).first()


def test_form_parsing(spark):
    ok = parse(spark)
    assert ok["kind"] == "valid" and ok["name"] is None and ok["link"] is None and ok["page"] == "/destinations/burnham-park"
    assert parse(spark, message="wrong")["errors"].keys() == {"message"}
    assert parse(spark, name="  Ana Dela Cruz  ")["name"] == "Ana Dela Cruz"
    assert parse(spark, name="x" * 81)["errors"].keys() == {"name"}
    assert parse(spark, email="")["errors"].keys() == {"email"} and parse(spark, email="someone@")["errors"].keys() == {"email"}
    assert parse(spark, link=" https://example.org/hours ")["link"] == "https://example.org/hours"
    for link in ("example.org/hours", "http://example.org/hours", "javascript:alert(1)", "https://example.org/" + "x" * 2000):
        assert parse(spark, link=link)["errors"].keys() == {"link"}
    assert parse(spark, website="http://spam")["kind"] == "spam" and parse(spark, startedAt=str(int(NOW) - 100))["kind"] == "spam"
    assert parse(spark, startedAt="")["kind"] == "valid"


def test_difficulty(spark):
    base = "Cafe by the Ruins now opens at 8:00 am and closes at 9:00 pm."
    d = lambda page, message: one(spark, S.difficulty(F.lit(page), F.lit(message)))
    assert d("/eat-stay", base).asDict() == {"hard": False, "in_scope": True, "reasons": []}
    assert not d("/destinations/bencab-museum", "BenCab Museum is now closed on Mondays.")["hard"]
    assert "not one place's page" in d("/map", base)["reasons"]
    assert "long report" in d("/eat-stay", base + " " * 10 + "x" * 400)["reasons"]
    assert "several times" in d("/eat-stay", "Open 8:00 am to 5:00 pm on weekdays, 10:00 am to 9:00 pm on weekends.")["reasons"]
    assert "hours and prices" in d("/eat-stay", "Opens at 9 am now, and a meal costs about ₱500.")["reasons"]
    assert not d("/destinations/burnham-park", "Please rename Burnham Park to Burnham Lake Park.")["in_scope"]


def test_stairs_beside_a_road(spark):
    road = spark.createDataFrame([(1, 3.1, [(0.0, 0.0), (100.0, 0.0)])], "code int, half double, line array<struct<x:double,y:double>>")
    rows = [(1, 20.0, 5.0, 50.0, 6.0), (2, 30.0, 4.0, 32.0, 40.0), (3, 20.0, 13.67, 50.0, 13.67)]
    s = spark.createDataFrame(rows, "stair_id int, sx0 double, sy0 double, sx1 double, sy1 double")
    s = s.withColumn("x", (F.col("sx0") + F.col("sx1")) / 2).withColumn("y", (F.col("sy0") + F.col("sy1")) / 2)
    assert {r["stair_id"]: r["along"] for r in RD.parallel_stairs(s, road).collect()} == {1: True, 2: False, 3: False}


def test_lane_tag(spark):
    got = each(spark, ["2;3", "2.0", "4", None, " 3 ;1"], lambda x: RD.lanes(x, F.lit("residential")), "string")
    assert got == [2, 2, 4, 2, 3]


def test_nearest_and_relief(spark):
    rows = [("session-road", 120.5967, 16.4118, 1484.0), ("mines-view", 120.6305, 16.4145, 1558.0), ("bencab", 120.55, 16.42, 1014.0), ("lost", 120.6, 16.41, None)]
    d = spark.createDataFrame(rows, "slug string, lng double, lat double, elevation double")
    o = spark.createDataFrame([(1, 120.5936, 16.4116)], "oid int, olng double, olat double")
    near = P.nearest_places(o, d.where("elevation is not null"), 2, origin_id="oid", place_id="slug", o=("olng", "olat"), p=("lng", "lat")).orderBy("rank").collect()
    assert [r["slug"] for r in near] == ["session-road", "mines-view"] and near[0]["km"] < 0.5
    rel = P.relief(d, 120.5936, 16.4116).orderBy("km").collect()
    assert [r["slug"] for r in rel] == ["session-road", "mines-view", "bencab"] and rel[0]["span"] == 544 and rel[0]["lowest"] == "bencab"
    with pytest.raises(Exception, match="at least one place"):
        P.relief(d.where("elevation is null"), 1.0, 1.0).collect()


def test_verdict_rules(spark):
    cols = "id int, outcome string, note string, table string, slug string, field string, open string, close string, price_range int, source_url string, quote string"
    q = "We are open daily from 8:00 am to 9:00 pm."
    rows = [(1, "proposed", None, "venues", "cafe", "hours", "08:00", "21:00", None, "https://example.org", q), (2, "proposed", None, "venues", "cafe", "hours", "8", "21:00", None, "https://example.org", q),
            (3, "held", "n" * 400, None, None, None, None, None, None, None, None), (4, "held", "", None, None, None, None, None, None, None, None), (5, "other", None, None, None, None, None, None, None, None, None)]
    got = {r["id"]: (r["outcome"], r["note"]) for r in S.check_verdict(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: ("proposed", None), 2: ("held", "The check's answer was incomplete."), 3: ("held", "n" * 300), 4: ("held", "No public page confirms it."), 5: ("held", "No public page confirms it.")}
