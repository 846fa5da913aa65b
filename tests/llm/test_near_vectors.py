import numpy as np
from pyspark.sql import functions as F

from upland.llm import near_vectors as N

ROW = "vec_id long, embedding array<float>, label int"


def brute(rows):
    ids, vs = [], []
    for i, v in rows:
        ok = i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)
        if ok:
            ids.append(i)
            vs.append(np.array(v, np.float32).astype(float))
    x = np.array([v / np.linalg.norm(v) for v in vs])
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    label = np.array(ids)
    while True:
        new = np.array([min([label[a], *label[hit[a]]]) for a in range(len(ids))])
        if np.array_equal(new, label):
            break
        label = new
    return {i: (int(h.sum()), int(c)) for i, h, c in zip(ids, hit, label)}


def test_groups_of_all_sizes(spark):
    rng = np.random.default_rng(1)
    rows = []
    for size, noise in [(1, 0)] * 300 + [(2, 0.2)] * 60 + [(3, 0.33)] * 40 + [(120, 0.25), (700, 0.1)]:
        centre = rng.normal(size=24)
        rows += [(centre + noise * rng.normal(size=24)).tolist() for _ in range(size)]
    rows = [(i, v) for i, v in enumerate(np.array(rows)[rng.permutation(len(rows))].astype(np.float32).tolist())]
    want = brute(rows)
    odd = [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] + [1.0] * 23), (5003, [None] + [1.0] * 23), (5004, []), (None, rows[0][1]), (5005, [float("inf")] * 24), (5006, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], ROW).withColumn("node", F.lit("x")).withColumn("tree", F.lit("x"))
    got = N.near_duplicates(df, leaf=64, sample=300).collect()
    assert len(got) == len(rows) + len(odd)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert all(found[i] == (0, i) for i, _ in odd)
    pairs, hit = sum(n for n, _ in want.values()), sum(min(n, found[i][0]) for i, (n, _) in want.items())
    assert all(found[i][0] <= n for i, (n, _) in want.items()) and hit >= 0.98 * pairs
    assert np.mean([found[i][1] == c for i, (_, c) in want.items()]) > 0.98


def test_repeated_rows(spark):
    a, b = [1.0, 0.0, 0.5], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(1, a, 0), (1, a, 1), (2, a, 0), (3, b, 0), (4, [2.0, 0.0, 1.01], 0)], ROW)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in N.near_duplicates(df).collect())
    assert got == [(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 0, 3), (4, 3, 1)]
    assert N.near_duplicates(spark.createDataFrame([], ROW)).count() == 0


def test_given_table(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in N.near_duplicates(df, leaf=64).collect()}
    assert np.mean([got[i] == w for i, w in want.items()]) > 0.99
