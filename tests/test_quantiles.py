import random

import numpy as np
import pytest

from upland.operators import quantiles as Q

SHARES, NAMES = [0.0, 0.5, 0.95, 0.99, 1.0], ["a", "b", "c", "d", "e"]


def values(kind, n, r):
    if kind == "even":
        return [r.random() for _ in range(n)]
    if kind == "wild":                       # spans where nearly all values share one slice of every round
        return [10.0 ** r.randint(-300, 300) * r.choice((-1, 1)) for _ in range(n)]
    if kind == "ties":
        return [float(r.randint(0, 3)) for _ in range(n)]
    return [7.5] * n


@pytest.mark.parametrize("slices,rounds", [(4096, 2), (2, 3), (5, 0)])
def test_against_numpy(spark, monkeypatch, slices, rounds):
    monkeypatch.setattr(Q, "SLICES", slices)
    monkeypatch.setattr(Q, "ROUNDS", rounds)
    r = random.Random(6)
    groups = {(k, n): values(k, n, r) for k in ("even", "wild", "ties", "one") for n in (1, 2, 3, 500)}
    groups[(None, 4)] = [1.0, 2.0, 4.0, 8.0]
    rows = [(k, n, v) for (k, n), vs in groups.items() for v in vs] + [("even", 500, None), ("none", 1, None)]
    r.shuffle(rows)
    got = Q.exact_quantiles(spark.createDataFrame(rows, "k string, m int, v double"), ["k", "m"], "v", SHARES, NAMES).collect()
    assert len(got) == len(groups)
    for row in got:
        vs = groups[(row["k"], row["m"])]
        assert row["n"] == len(vs)
        assert np.allclose([row[n] for n in NAMES], np.quantile(vs, SHARES), rtol=1e-12)


def test_without_groups_and_without_rows(spark):
    d = spark.createDataFrame([(float(i * i % 1009),) for i in range(3000)], "v double")
    row = Q.exact_quantiles(d, [], "v", SHARES, NAMES).first()
    assert np.allclose([row[n] for n in NAMES], np.quantile([float(i * i % 1009) for i in range(3000)], SHARES))
    assert Q.exact_quantiles(d.limit(0), [], "v", SHARES, NAMES).collect() == []
