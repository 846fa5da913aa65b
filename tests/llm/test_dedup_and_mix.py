import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.util import clashing, docs
from upland.llm import exact_dedup, mixing

TEXTS = ["a b c", "abc", None, "", " \n", "a  b  c", "abd", "long " * 40000, "long" * 40000, "é ü", "éü", "x" * 70000 + "y", "x" * 70000 + "z"]


def brute(texts):
    groups = defaultdict(list)
    for i, t in texts:
        t = t or ""
        groups[re.sub("[\x20\x09-\x0d]", "", t)].append((-len(t), i))
    return {i: (min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(norm.encode()).hexdigest()) for norm, g in groups.items() for _, i in g}


@pytest.mark.parametrize("primes, chunk", [(exact_dedup.PRIMES, exact_dedup.CHUNK), ((7, 11), exact_dedup.CHUNK), ((3, 5), 1000)])
def test_equal_texts(spark, primes, chunk):
    """Also with primes so small that different texts share fingerprints."""
    texts = TEXTS + [f"text {i}" for i in range(60)] + ["text 7", "tex t7", "ab" * 900 + "c" * 300, "ab" * 900 + "d" * 300]
    rows = exact_dedup.classes(clashing(docs(spark, texts), "k", "sha", "norm", "no"), chunk=chunk, primes=primes).collect()
    want = brute(list(enumerate(texts)))
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows} == want and len(rows) == len(texts)


def test_repeated_rows_and_null_ids(spark):
    table = docs(spark, ["a b", "a b", "ab", "c", "c", "d"], ids=[1, 1, 2, None, 5, None])
    rows = exact_dedup.classes(table).collect()
    assert len(rows) == 6 and sum(r["kept"] for r in rows) == 3
    assert {(r["keep_id"], r["group_size"]) for r in rows} == {(1, 3), (5, 2), (None, 1)}
    assert sorted(r["text"] for r in exact_dedup.deduplicated(table).collect()) == ["a b", "c", "d"]
    assert exact_dedup.classes(docs(spark, [])).count() == 0


def test_chunks_combine_like_the_whole():
    import pyarrow as pa
    f = exact_dedup.chunk_hashes().func
    text = "dé" * 5000
    whole, parts = f(pa.array([text])).to_pylist()[0], f(pa.array([text[:7], text[7:4001], "", text[4001:]])).to_pylist()
    h = [0, 0]
    for p in parts:
        h = [(h[0] * p["s1"] + p["h1"]) % exact_dedup.PRIMES[0], (h[1] * p["s2"] + p["h2"]) % exact_dedup.PRIMES[1]]
    assert h == [whole["h1"], whole["h2"]] and sum(p["n"] for p in parts) == whole["n"]


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {s: 0.0 for s in names}, set(names), 1.5 * sum(sizes.values())
    while open_ and left > 1e-9:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_targets_follow_the_resharing(spark):
    rng = np.random.default_rng(3)
    for _ in range(4):
        sizes = {f"s{i}": int(10 ** rng.uniform(0, 5)) for i in range(11)} | {None: 40, "none": 0}
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        want = brute_targets(sizes)
        assert {r["source"] for r in got} == set(want)
        assert all(abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) for r in got)


def test_the_mix(spark):
    texts = [f"w{i} " * (1 + i % 30) for i in range(3000)] + [None, "", " "]
    sources = ["big" if i % 3 else f"s{i % 5}" for i in range(3000)] + [None, "s1", "big"]
    table = clashing(docs(spark, texts, sources), "size", "target", "n", "row", "key")
    rows = mixing.repetitions(table).collect()
    assert len(rows) == len(texts) and all(0 <= r["copies"] <= 2 for r in rows)
    for s in {r["source"] for r in rows} - {None}:
        taken, target = sum(r["size"] * r["copies"] for r in rows if r["source"] == s), next(r["target"] for r in rows if r["source"] == s)
        assert abs(taken - target) < 0.1 * target
    out = mixing.mixed(table)
    assert out.columns == table.columns
    assert {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {r["doc_id"]: r["copies"] for r in rows if r["copies"]}
    assert mixing.repetitions(docs(spark, [])).count() == 0 and mixing.mixed(docs(spark, [])).count() == 0
