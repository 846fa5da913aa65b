"""Cells as words of 64: strips beside lines, connected groups and layers give what single cells give."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from upland.operators import cellgroups as CG
from upland.operators import cover as C
from upland.operators import lines as L
from upland.operators import rings as G
from upland.operators import strips as S
from upland.plans import roads as RD


def cells_of(words, *keys):
    return {tuple(r) for r in G.mask_cells(words).select("gx", "gy", *keys).collect()}


def masks_of(spark, cells):
    bits = {}
    for x, y in cells:
        bits[(y, x >> 6)] = bits.get((y, x >> 6), 0) | 1 << (x & 63)
    return spark.createDataFrame([(y, w, m - 2**64 if m >= 2**63 else m) for (y, w), m in bits.items()] or [(0, 0, 0)], "gy long, word long, mask long").where("mask <> 0")


LINES = [[(0.3, 0.2), (61.7, 4.1), (70.2, 90.6)], [(-130.4, -70.9), (-129.8, -20.1)], [(-20.0, 30.0), (40.0, 30.0)], [(10.5, -40.0), (10.5, -90.0)]]


@pytest.mark.parametrize("cells", [50, 400_000])
def test_strips_of_lines(spark, monkeypatch, cells):
    monkeypatch.setattr(S, "CELLS", cells)
    rows = [(i, [{"x": x, "y": y} for x, y in v]) for i, v in enumerate(LINES * 3)]
    segs = L.segments(spark.createDataFrame(rows, "code long, line array<struct<x:double,y:double>>"), "code").withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    band = cells_of(S.band_masks(segs, F.col("side") + 1, F.lit(2.0), F.lit(7.5)), "tag")
    near = cells_of(S.near_masks(segs, F.lit(0), F.lit(3.1)))
    want_band, want_near = set(), set()
    gx, gy = np.meshgrid(np.arange(-160, 100), np.arange(-110, 120))
    for v in LINES:
        for (ax, ay), (bx, by) in zip(v, v[1:]):
            dx, dy, px, py = bx - ax, by - ay, gx + 0.5 - ax, gy + 0.5 - ay
            size = np.hypot(dx, dy)
            off, arc = (dx * py - dy * px) / size, (dx * px + dy * py) / size
            for side in (1, -1):
                hit = (off * side >= 2) & (off * side < 7.5) & (arc >= 0) & (arc <= size)
                want_band |= {(int(x), int(y), side + 1) for x, y in zip(gx[hit], gy[hit])}
            t = np.clip(arc / size, 0, 1)
            hit = np.hypot(px - t * dx, py - t * dy) <= 3.1
            want_near |= {(int(x), int(y)) for x, y in zip(gx[hit], gy[hit])}
    assert band == want_band and near == want_near


def blobs(rng, n, lo, hi):
    return {(x + a, y + b) for x, y in ((rng.randrange(lo, hi), rng.randrange(lo, hi)) for _ in range(n)) for a in range(rng.randrange(1, 40)) for b in range(rng.randrange(1, 4))}


def test_groups_of_words(spark):
    rng = random.Random(4)
    cells, marks = blobs(rng, 260, -300, 560), blobs(rng, 60, -300, 560)
    table = lambda s: spark.createDataFrame(sorted(s), "gx long, gy long")
    want = {}
    for r in CG.connected_cells(table(cells), table(marks)).collect():
        n = want.setdefault(r["label"], [0, 0, 0])
        for i, v in enumerate((1, r["sides"], int(r["marked"]))):
            n[i] += v
    d = CG.connected_masks(masks_of(spark, cells), masks_of(spark, marks)).withColumn("label", CG.label_text(F.col("root")))
    got = d.groupBy("label").agg(F.sum(F.bit_count("mask")), F.sum("sides"), F.sum(F.bit_count("marked")))
    assert len(want) > 20 and {r[0]: list(r)[1:] for r in got.collect()} == want
    assert cells_of(d.select("gy", "word", "mask")) == cells
    assert CG.connected_masks(masks_of(spark, [])).collect() == []


def test_layers_of_words(spark):
    rng = random.Random(9)
    sets = {n: blobs(rng, 60, -90, 90) for n in ("road", "island", "pave", "walk")}
    holes, table = blobs(rng, 30, -90, 90), lambda s: spark.createDataFrame(sorted(s), "gx long, gy long")
    rest = (("pave", "walk"), (("ring", ("island",), None), ("kerb", ("pave", "walk"), ("road",))))
    want = {tuple(r) for r in C.layered([(n, table(s)) for n, s in sets.items()], table(holes), *rest).collect()}
    got = C.layered_masks([(n, masks_of(spark, s)) for n, s in sets.items()], masks_of(spark, holes), *rest)
    assert len({w[2] for w in want}) == 6 and cells_of(got, "layer") == want


def test_islands_and_sidewalks_of_equal_lines(spark):
    """Copies of lines change nothing, and each line is read once: pieces are told apart before their cells."""
    line = lambda y: [{"x": float(x), "y": y + 0.3 + x / 50} for x in range(0, 241, 40)]
    rows = [(i, line(12.0 * (i % 2)), 3.1, True, "primary", "hex") for i in range(2)]
    table = lambda r: spark.createDataFrame(r, "code long, line array<struct<x:double,y:double>>, half double, oneway boolean, kind string, paving string")
    one, many = table(rows), table([(i + 2 * k, *rest) for k in range(30) for i, *rest in rows])
    square = [(i, [{"x": x, "y": y} for x, y in ((a, 20.0), (a + 5, 20.0), (a + 5, 25.0), (a, 25.0), (a, 20.0))]) for i, a in enumerate((20.0, 100.0))]
    b = spark.createDataFrame(square, "bid long, ring array<struct<x:double,y:double>>")
    b = b.withColumn("edges", G.edges("ring")).select("*", *[c.alias(n) for c, n in zip(G.box("ring"), "wsen")])
    want = cells_of(RD.island_masks(one))
    assert want and all(2.5 < y - x / 50 < 9.5 for x, y in want) and cells_of(RD.island_masks(many)) == want
    paved = cells_of(RD.paved_masks(one, b), "paving")
    assert paved and cells_of(RD.paved_masks(many, b), "paving") == paved
    assert RD.islands(CG.connected_masks(RD.island_masks(many))).count() == 1
