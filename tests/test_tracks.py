import math
import random

import pytest
from pyspark.sql import functions as F

from upland.operators import lines as L
from upland.operators import tracks as T

V = "code int, i long, lng double, lat double"


def hav(a, b):
    x, y, u, v = map(math.radians, (*a, *b))
    return 2 * 6371000.0 * math.asin(math.sqrt(min(1.0, math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2)))


def walk(r, n):
    p, out = (120.6, 16.4), []
    for _ in range(n):
        out.append(p)
        p = (p[0] + r.gauss(0, 2e-5) + 1e-5, p[1] + r.gauss(0, 2e-5))
    return out


@pytest.mark.parametrize("block", [8, 4096])
def test_arcs_and_headings_of_long_lines(spark, monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK", block)
    r = random.Random(4)
    lines = {0: walk(r, 10_000 if block > 8 else 61), 1: walk(r, 1), 2: walk(r, 2), 3: walk(r, 37), 4: [(120.6, 16.4)] * 9}
    rows = [(c, i + c, x, y) for c, ps in lines.items() for i, (x, y) in enumerate(ps)]
    r.shuffle(rows)
    d = spark.createDataFrame(rows, V)
    arcs = {(x["code"], x["i"]): x["arc"] for x in T.arcs(d).collect()}
    assert len(arcs) == len(rows)
    for c, ps in lines.items():
        total = 0.0
        for i, p in enumerate(ps):
            total += hav(ps[i - 1], p) if i else 0.0
            assert math.isclose(arcs[(c, i + c)], total, rel_tol=1e-9, abs_tol=1e-6)
    own = spark.createDataFrame([(c, ps) for c, ps in lines.items()], "code int, line array<struct<lng:double,lat:double>>")
    want = {(x["code"], x["i"]): x["h"] for x in own.select("code", F.posexplode(F.transform("line", lambda p, i: L.bearing_at("line", i))).alias("i", "h")).collect()}
    for x in T.headings(d).collect():
        if len(lines[x["code"]]) == 1:
            assert x["heading"] is None
        else:
            assert math.isclose(x["heading"], want[(x["code"], x["i"] - x["code"])], abs_tol=1e-6)


def test_nearest_vertex_by_arc(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 5)
    r = random.Random(5)
    arcs = sorted(round(r.uniform(0, 900), 1) for _ in range(40)) + [1500.0]
    track = spark.createDataFrame([(1, i, float(i), 0.0, a) for i, a in enumerate([0.0, *arcs])], V + ", arc double")
    ts = [r.uniform(0, 1500) for _ in range(200)] + [0.0, 1500.0, arcs[3], (arcs[5] + arcs[6]) / 2]
    asked = spark.createDataFrame([(1, float(t)) for t in ts], "code int, t double")
    all_ = [0.0, *arcs]
    got = T.nearest_by_arc(asked, track, "t", "p").collect()
    assert len(got) == len(ts)
    for g in got:
        assert abs(all_[int(g["p"]["lng"])] - g["t"]) <= min(abs(a - g["t"]) for a in all_) + 1e-9


def test_running_sums_in_two_levels(spark):
    d = spark.createDataFrame([([float(i % 7) for i in range(n)],) for n in (0, 1, 2, 127, 128, 129, 1000)] + [(None,)], "v array<double>")
    for row in d.select("v", T.running(F.col("v")).alias("s")).collect():
        if row["v"] is not None:
            want = [0.0]
            for x in row["v"]:
                want.append(want[-1] + x)
            assert row["s"] == want
