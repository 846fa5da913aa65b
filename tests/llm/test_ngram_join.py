import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.util import clashing, docs
from upland.llm import ngram_join as J


def brute(texts):
    sets = []
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall("[^\x20\x09-\x0d]+", low)
        sets.append(frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
    label = list(range(len(texts)))
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    pairs = set()
    for own in holders.values():
        for a in own:
            pairs.update((min(a, b), max(a, b)) for b in own if a != b)
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while True:
        before = list(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return [(i, len(s), label[i]) for i, s in enumerate(sets)]


def corpus(rng, n):
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words, 60))
    texts = []
    while len(texts) < n:
        base = list(rng.choice(words, rng.integers(3, 120)))
        texts.append(" ".join(base))
        kind = rng.integers(0, 6)
        if kind == 0:
            for _ in range(rng.integers(1, 12)):              # copies with ever more changes
                at = rng.integers(0, len(base))
                base[at] = str(rng.choice(words))
                texts.append("  ".join(base).upper())
        elif kind == 1:
            texts.append(passage + "\n" + " ".join(base[:20]))
        elif kind == 2:
            texts.append(" ".join(base[:-1]))
    return texts


@pytest.mark.parametrize("settings", [{}, {"HOT": 4, "BUCKET": 300, "MEMBERS": 3}])
def test_against_brute_force(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(J, k, v)
    texts = corpus(np.random.default_rng(7), 500) + [None, "", " \n", "one", "One", "one two three four", "ONE two\tthree four", "a b c d e", "a b c d f", "é " * 9, "x " * 30000]
    got = J.similar(clashing(docs(spark, texts), "fp", "n", "cells", "id", "root", "token")).collect()
    want = brute(texts)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert len({c for _, n, c in want}) < len(want) - 100


def test_near_the_threshold(spark):
    """Pairs one shingle to either side of the threshold."""
    rng = np.random.default_rng(2)
    texts = []
    for i in range(60):
        base = [f"a{i}_{j}" for j in range(int(rng.integers(9, 90)))]
        n = len(base) - 4
        texts += [" ".join(base), " ".join(base[:len(base) - int(np.floor(n * 0.2))]), " ".join(base[:len(base) - int(np.floor(n * 0.2)) - 1])]
    got = J.similar(docs(spark, texts)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(texts)


def test_given_documents(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    rows = table.orderBy("doc_id").collect()
    ids = [r["doc_id"] for r in rows]
    want = [(ids[i], n, ids[c]) for i, n, c in brute([r["text"] for r in rows])]
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.similar(table).collect()) == want
    assert sorted(r["doc_id"] for r in J.one_of_each(table).collect()) == [i for i, _, c in want if i == c]


def test_odd_rows(spark):
    table = docs(spark, ["a b c d e f g"] * 4 + ["", None, "z", "z"], ids=[5, 5, None, 9, None, 3, None, None])
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.similar(table).collect()), key=str)
    assert got == sorted([(5, 3, 5), (5, 3, 5), (None, 3, 5), (9, 3, 5), (None, 0, None), (3, 0, 3), (None, 1, None), (None, 1, None)], key=str)
    assert J.one_of_each(table).columns == table.columns
    assert J.similar(docs(spark, [])).count() == 0


def test_few_groups_against_brute_force(spark, monkeypatch):
    for k, v in {"CELLS": 1, "HOT": 4, "BUCKET": 300, "MEMBERS": 3}.items():
        monkeypatch.setattr(J, k, v)
    texts = corpus(np.random.default_rng(7), 500)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.similar(docs(spark, texts)).collect()) == brute(texts)


def test_least_met_holds_for_all_members(spark):
    """The bound of a group is that of no fitting pair of its members more."""
    exact = lambda a, b: -(-(a + b) * 4 // 9) + (-a * 4 // 5) + 1
    sizes = spark.range(1, 120).select(F.col("id").alias("a")).join(spark.range(1, 120).select(F.col("id").alias("b")), F.expr("b <= a and 5 * b >= 4 * a - 40"))
    bound = {(r["a"], r["b"]): r["m"] for r in sizes.select("a", "b", J.least_met(F.col("a"), F.col("b")).alias("m")).collect()}
    for (a, b), m in bound.items():
        assert m == min(exact(x, y) for x in range(b, a + 1) for y in range(b, x + 1))


def test_group_with_a_larger_member(spark, monkeypatch):
    """x and y share 8 shingles of 10, but one token of the matrix; x has a longer text in its group that holds it too."""
    def sets(*texts):
        raw = [t.encode() for t in texts]
        return [t for _, t in J.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(t) for t in raw]))]

    for i in range(1000):
        words = [f"w{i}_{j}" for j in range(13)]
        texts = [" ".join(words), " ".join([*words, "more"]), " ".join([*words[:12], "other"])]
        x, longer, y = sets(*texts)
        x_, longer_, y_ = (set(t[:J.prefix(len(t))].tolist()) for t in (x, longer, y))
        if len(x_ & y_) == 1 and x_ & y_ == longer_ & y_:
            break
    assert (len(x), len(longer), len(y)) == (9, 10, 9) and i < 999
    of = {J.fingerprint(x): 1, J.fingerprint(longer): 1, J.fingerprint(y): 2}
    monkeypatch.setattr(J, "groups_of", lambda distinct: spark.createDataFrame(list(of.items()), "fp long, grp long"))
    assert sorted((r["doc_id"], r["component_id"]) for r in J.similar(docs(spark, texts)).collect()) == [(0, 0), (1, 0), (2, 0)]


@pytest.mark.parametrize("alone", [False, True])
def test_alike_sets_are_not_sent_whole(spark, monkeypatch, alone):
    """Sets that share much, but not enough, meet as sketches only, within a group and between groups."""
    rng = np.random.default_rng(3)
    base = [f"w{j}" for j in range(400)]
    texts = []
    for i in range(120):
        texts.append(" ".join(f"own{i}_{j}" if j % 12 == i % 12 else w for j, w in enumerate(base)))
    copied = rng.choice(120, 5, replace=False).tolist()
    texts += [texts[i] + " and more" for i in copied]
    sent = []
    whole = J.sets_for
    monkeypatch.setattr(J, "sets_for", lambda docs, route: sent.extend(route.collect()) or whole(docs, route))
    if alone:
        monkeypatch.setattr(J, "groups_of", lambda distinct: J.stash(distinct.select("fp", F.col("fp").alias("grp"))))
    got = J.similar(docs(spark, texts)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(texts)
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] != r["component_id"]) == sorted((120 + k, i) for k, i in enumerate(copied))
    assert 10 <= len(sent) <= 30


def test_sketches_keep_all_similar_sets():
    rng = np.random.default_rng(5)
    sets = []
    for size in [1, 2, 5, 9, 31, 33, 40, 60, 64, 65, 100, 127, 129, 300, 1000]:
        own = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
        for share in np.linspace(0.5, 1.2, 30):
            more = rng.integers(0, 1 << 63, max(0, int(size * (share - 1))), dtype=np.uint64)
            part = own[:max(1, int(size * share))] if rng.integers(0, 2) else own[-max(1, int(size * share)):]
            sets.append(np.unique(np.concatenate([part, more])))
    sets.sort(key=len)
    sketches, matrix = J.Sketches([len(t) for t in sets], [J.sketch(t) for t in sets]), J.Matrix(sets)
    found = similar = 0
    for i, t in enumerate(sets):
        near, exact = sketches.near(len(t), J.sketch(t)).tolist(), matrix.similar(t).tolist()
        assert set(exact) <= set(near) and i in near
        assert sketches.near(len(t), J.sketch(t), i + 1).tolist() == [j for j in near if j > i]
        found, similar = found + len(near), similar + len(exact)
    assert similar <= found < 1.3 * similar


def test_matrix_rows_of_fitting_sizes_only(spark):
    """A token that sets of 1 and 30 shingles hold gives no rows; with one of 31, it gives those of the two large ones."""
    words = [f"w{j}" for j in range(34)]
    long, short = " ".join(words), [" ".join(words[i:i + 5]) for i in range(30)]
    none = np.zeros(0, np.uint64)
    assert J.entries(docs(spark, [long, *short]), none, 1).count() == 0
    rows = J.entries(docs(spark, [long, long + " more", *short]), none, 1).collect()
    assert rows and {r["n"] for r in rows} == {30, 31}
    held = {}
    for r in rows:
        held.setdefault(r["token"], []).append(r["n"])
    assert all(sorted(n) == [30, 31] for n in held.values())
