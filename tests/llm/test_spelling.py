import random
import zlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.util import clashing, docs
from upland.llm import spelling as S


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    s, t = sorted((a, b), key=len)
    return len(t) == len(s) + 1 and any(t[:i] + t[i + 1:] == s for i in range(len(t)))


def by_hand(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: sorted((x for x in n if abs(len(x) - len(w)) < 2 and one_edit(x, w)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: near[w][0] if near[w] and n[near[w][0]] >= 2 * n[w] else None for w in n}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(near[w]), None if form[w] is None else n[form[w]]) for w in n)


def key(r):
    return tuple(map(str, r))


def got(df, **k):
    return [tuple(r) for r in S.variants(df, **k).collect()]


def made(seed, words=400, rows=120):
    r = random.Random(seed)
    base = ["".join(r.choices("aeisÉß", weights=[3, 3, 2, 2, 1, 1], k=r.randint(4, 6))) for _ in range(words)]
    base += ["x" * 300 + c for c in "abc"] + ["straße", "strasse", "Straße", "naïve", "naive"] * 3
    weights = [1 / (i % 97 + 1) for i in range(len(base))]
    return [(i if i % 9 else None, " ".join(w.upper() if r.random() < 0.1 else w for w in r.choices(base, weights, k=60)) + "\n" + r.choice(["×÷×÷×", "", "1a2b", "don't"])) for i in range(rows)] + [(1, None), (2, ""), (3, "hello " * 500)]


@pytest.mark.parametrize("cell,bucket", [(32_000, 48), (60, 4), (1, 1)])
def test_against_brute_force(spark, monkeypatch, cell, bucket):
    monkeypatch.setattr(S, "BUCKET", bucket)
    rows = made(cell)
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "word", "n", "run", "root", "form", "id")
    want = by_hand(rows)
    assert sum(r[4] > 0 for r in want) > 100 and any(r[1] and r[2] != r[1] for r in want)
    assert sorted(got(df, cell=cell), key=key) == sorted(want, key=key)


def test_unlike_a_sample(spark):
    """A sample that holds few of the words only changes where they meet."""
    rows = made(8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(got(df, cell=20, sample=100), key=key) == sorted(by_hand(rows), key=key)
    assert sorted(got(df, cell=20, sample=0), key=key) == sorted(by_hand(rows), key=key)


WORD = st.text(st.sampled_from("abcé"), min_size=5, max_size=7)


@settings(max_examples=60, deadline=None)
@given(st.sets(WORD, min_size=1, max_size=40), st.sets(WORD, min_size=1, max_size=20), st.integers(0, 3))
def test_trees_lose_no_pair(own, asked, seed):
    length = len(min(own))
    own = [w for w in own if len(w) == length]
    S.BUCKET, old = 2, S.BUCKET
    try:
        cell = S.Cell(own, np.arange(len(own)) + seed)
        for n in (length - 1, length, length + 1):
            q = sorted(w for w in asked if len(w) == n)
            if q:
                assert cell.near(q)[0].tolist() == [sum(one_edit(a, b) for b in own) for a in q]
        top = S.Top(own, len(own), 1)
        for n in (length - 1, length, length + 1):
            for w in (w for w in asked if len(w) == n):
                counts = S.letter_counts(*S.letters([w]))
                reached = {c for c, _ in top.reached(length, counts, 2 if n == length else 1)}
                for x in own:
                    (home, _), = top.reached(length, S.letter_counts(*S.letters([x])), 0)
                    assert not one_edit(x, w) or home in reached
    finally:
        S.BUCKET = old


def test_marks_differ_at_most_as_counts_do():
    r = np.random.default_rng(2)
    c = r.poisson(0.3, (300, S.LETTERS)).astype(np.int16)
    c[:20, :3] += 7
    m = S.marks(c)
    differ = np.bitwise_count(m[:, None] ^ m[None]).sum(axis=2)
    assert (differ <= np.abs(c[:, None].astype(int) - c[None]).sum(axis=2)).all()


def test_one_word_for_a_third_of_all(spark):
    rows = [(i, "common " * 50 + f"commom {'zzzzz ' * (i % 2)}") for i in range(300)]
    assert sorted(got(spark.createDataFrame(rows, "doc_id long, text string")), key=key) == sorted(by_hand(rows), key=key)


def test_empty_table(spark):
    assert got(docs(spark, ["a"]).limit(0)) == []
    assert got(docs(spark, ["", None])) == []


def test_given_table_and_sql(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    have = sorted(map(key, got(df)))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    r = con.sql(S.ORACLE)
    at = [r.columns.index(c) for c in ("word", "form", "root", "n", "n_near", "form_n")]
    assert have == sorted(key([x[i] for i in at]) for x in r.fetchall())
    assert have == sorted(map(key, by_hand([(x["doc_id"], x["text"]) for x in df.collect()])))
