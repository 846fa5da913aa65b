import random

import pytest

from upland.operators import cover as C


@pytest.mark.parametrize("tile", [4, 256])
def test_layers_holes_and_rims(spark, monkeypatch, tile):
    monkeypatch.setattr(C, "TILE", tile)
    rng = random.Random(9)
    blob = lambda n: {(rng.randrange(-20, 20), rng.randrange(-20, 20)) for _ in range(n)}
    road, island, pave, walk, gaps = blob(300), blob(300) | {(i, j) for i in range(5, 12) for j in range(5, 12)}, blob(500), blob(400), blob(200)
    table = lambda s: spark.createDataFrame([c for c in s for _ in range(rng.randint(1, 3))], "gx long, gy long")
    got = {(r["gx"], r["gy"]): r["layer"] for r in C.layered([("road", table(road)), ("island", table(island)), ("pave", table(pave)), ("walk", table(walk))], table(gaps), ("pave", "walk"),
                                                             (("ring", ("island",), None), ("kerb", ("pave", "walk"), ("road",)))).collect()}
    first = {}
    for name, cells in (("road", road), ("island", island), ("pave", pave - gaps), ("walk", walk - gaps)):
        for c in cells:
            first.setdefault(c, name)
    beside = lambda c: [first.get((c[0] + a, c[1] + b)) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]
    want = {c: "ring" if n == "island" and any(b != "island" for b in beside(c)) else "kerb" if n in ("pave", "walk") and "road" in beside(c) else n for c, n in first.items()}
    assert got == want and {"ring", "kerb", "island", "road", "pave", "walk"} == set(want.values())
    assert C.layered([("road", table(road).limit(0))], rims=(("ring", ("road",), None),)).collect() == []
