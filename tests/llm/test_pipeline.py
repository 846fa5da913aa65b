"""The pipeline against its stages done by brute force, each on its own input."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup_and_mix import brute as exact
from tests.llm.test_ngram_join import brute as near
from tests.llm.util import docs as table
from upland.llm import mixing, ngram_join, quality, sentencepieces

NAMES = [n for n, _ in corpus_pipeline.STAGES]


def test_stages_one_by_one(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(before, docs.schema), data)
        rows = out.collect()
        got = sorted(r["doc_id"] for r in rows)
        if name != NAMES[-1]:
            assert out.columns == docs.columns and {tuple(r) for r in rows} <= {tuple(r) for r in before}
        texts = {r["doc_id"]: r["text"] for r in before}
        ids = sorted(texts)
        if name == NAMES[0]:
            kept = set(got)
            assert len(got) == len(kept)
            good, bad = [i for i in ids if labels.get(i) == 1], [i for i in ids if labels.get(i) == 0]
            assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.1 * len(bad)
        elif name == NAMES[1]:
            assert got == sorted({keep for keep, *_ in exact([(i, texts[i]) for i in ids]).values()})
        elif name == NAMES[2]:
            assert got == [ids[i] for i, _, c in near([texts[i] for i in ids]) if i == c]
        elif name == NAMES[3]:
            size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", texts[i] or "")) for i in ids}
            plan = {r["doc_id"]: r["copies"] for r in mixing.repetitions(spark.createDataFrame(before, docs.schema)).collect()}
            assert got == sorted(i for i in ids for _ in range(plan[i]))
            assert abs(sum(size[i] for i in got) - 1.5 * sum(size.values())) < 0.15 * sum(size.values())
        else:
            source = {r["doc_id"]: r["text"] for r in before}
            back = sentencepieces.decode(out).collect()
            assert all(r["decoded"] == source[r["doc_id"]] and r["exact"] for r in back) and set(got) == set(source)
        before = rows
    whole = corpus_pipeline.run(spark, data)
    assert sorted(map(tuple, whole.select("doc_id", "sample", "n_pieces", F.xxhash64("pieces")).collect())) == sorted((r["doc_id"], r["sample"], r["n_pieces"], h) for r, h in zip(rows, [x[0] for x in spark.createDataFrame(rows, whole.schema).select(F.xxhash64("pieces")).collect()]))


def test_empty_and_odd_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    empty, odd = docs.limit(0), docs.limit(3).unionByName(docs.limit(1).selectExpr("cast(null as bigint) doc_id", "cast(null as string) text", "lang", "cast(null as string) source", "n_chars"))
    for table in (empty, odd.withColumn("row", F.lit(1)).withColumn("x", F.lit(2))):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, data).count() >= 0
    assert quality.ACCEPT == 0.7


def test_near_copies_are_found_without_sending_alike_texts_whole(spark, monkeypatch):
    texts = [" ".join(f"own{i}_{j}" if j % 10 == i % 10 else f"w{j}" for j in range(300)) for i in range(80)]
    texts += [texts[7] + " more", texts[30].upper()]
    sent, whole = [], ngram_join.sets_for
    monkeypatch.setattr(ngram_join, "sets_for", lambda docs, route: sent.extend(route.collect()) or whole(docs, route))
    left = corpus_pipeline.near_copies(spark, table(spark, texts), "")
    assert sorted(r["doc_id"] for r in left.collect()) == [i for i, _, c in near(texts) if i == c] == list(range(80))
    assert len(sent) < 20
