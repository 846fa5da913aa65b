import numpy as np
from pyspark.sql import functions as F

from tests.llm.util import clashing, docs
from upland.llm import quality


def test_features_of_odd_texts():
    import pyarrow as pa

    from upland.llm.common import byte_view
    texts = ["", None, "a", "one two two two", "X" * 100000, " \n ", "äöü 12 !!"] * 3
    x = quality.features(*byte_view(pa.array(texts)))
    assert x.shape == (21, len(quality.NAMES)) and np.isfinite(x).all() and np.array_equal(x[:7], x[7:14])
    f = dict(zip(quality.NAMES, x[3]))
    assert np.isclose(f["log_words"], np.log(5)) and f["again"] == 0.5 and f["top"] == 0.75 and np.isclose(f["distinct"], 0.5)
    assert x[0].tolist() == x[1].tolist() == [0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0]


def test_prior_and_risk_on_known_mixtures():
    rng = np.random.default_rng(0)
    d = len(quality.NAMES)
    for prior in (0.3, 0.6, 0.9):
        positive = rng.normal(0, 1, (4000, d))
        n = 8000
        is_pos = rng.random(n) < prior
        unlabelled = np.where(is_pos[:, None], rng.normal(0, 1, (n, d)), rng.normal(1.6, 1, (n, d)))
        assert abs(quality.estimate_prior(positive, unlabelled, 1) - prior) < 0.08
        s = quality.fit(positive, unlabelled).score(unlabelled)
        assert np.mean((s > 0.5) == is_pos) > 0.95


def test_held_out_accuracy(spark, data):
    big = data.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    table = spark.read.parquet(f"{big}/documents.parquet")
    rows = quality.scores(table, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert len(good) > 20 and len(bad) > 5
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9     # some 250 positives to learn from here
    assert quality.accepted(table, labels).columns == table.columns


def test_odd_tables(spark):
    table = clashing(docs(spark, ["good text here", None, "", "good text here"], ids=[1, 2, None, 1]), "x", "row", "score", "quality")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.scores(table, none).collect()
    assert len(rows) == 4 and {r["score"] for r in rows} == {0.5} and {r["predicted"] for r in rows} == {0}
    labels = spark.createDataFrame([(i, 1) for i in range(200)] + [(3, None), (None, 1)], "doc_id long, quality int").withColumn("x", F.lit(1))
    many = docs(spark, [f"some plain text number {i}" for i in range(150)] + ["### !!! ***"] * 50)
    out = quality.scores(many, labels).collect()
    assert len(out) == 200 and all(0 <= r["score"] <= 1 for r in out)
    assert quality.scores(docs(spark, []), labels).count() == 0
