import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.util import clashing, docs
from upland.llm import repeats as R


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + 400] for r in raws for i in range(len(r) - 399))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - 399):
            if seen[r[i:i + 400]] > 1:
                gone[i:i + 400] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(r, np.uint8)[~gone]) if r else b""
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def word(rng):
    return "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))


def corpus(rng, n):
    passages = [" ".join(word(rng) for _ in range(k)) for k in (55, 70, 80, 90, 120, 300)]
    exact = [x[:399] for x in (" ".join(word(rng) for _ in range(200)) for _ in range(2))] + [" ".join("abcd"[i % 4] + str(i * i) for i in range(90))[:k] for k in (400, 401)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word(rng) for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages + exact)
            a = rng.randint(0, len(p) // 3) if rng.random() < 0.5 else 0
            parts += [p[a:], " ".join(word(rng) for _ in range(rng.randint(0, 30)))]
        texts.append(" ".join(parts))
    return texts


@pytest.mark.parametrize("settings", [{}, {"RUN": 7, "RANGE": 20, "BITS": 8}])
def test_against_brute_force(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(R, k, v)
    rng = random.Random(4)
    texts = corpus(rng, 250) + [None, "", "a" * 399, "b" * 400, "c" * 401, "d" * 3000, "ab" * 900, "xyz" * 200 + "q" * 450 + "xyz" * 200, "same " * 100, "same " * 100]
    got = R.without_repeats(clashing(docs(spark, texts), "id", "k", "start", "spans", "part")).orderBy("doc_id").collect()
    want = brute(texts)
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == want
    assert sum(w[1] > 0 for w in want) > 50 and sum(w[1] == 0 for w in want) > 50


def test_given_documents(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id")
    rows = table.collect()
    got = R.without_repeats(table).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == brute([r["text"] for r in rows])
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


def test_repeated_rows_and_null_ids(spark):
    long = " ".join(str(i * 7919) for i in range(120))
    got = R.without_repeats(docs(spark, [long, long, long + "x", "short"], ids=[1, 1, None, None])).collect()
    assert sorted((r["n_bytes"] - r["n_removed"], r["n_spans"]) for r in got) == [(0, 1), (0, 1), (1, 1), (5, 0)]
    assert R.without_repeats(docs(spark, [])).count() == 0


def test_merge_equals_sort():
    rng = random.Random(9)
    rows = [("".join(rng.choice("ab") for _ in range(rng.randint(0, 14))).encode(), b"l", 1) for _ in range(900)]
    runs = [sorted(rows[i::7]) for i in range(7)]
    out = list(R.merged([R.front_coded(r) for r in runs] + [b""]))
    assert [o[1] for o in out] == sorted(r[0] for r in rows)
    assert all(o[0] == R.common(p[1], o[1]) for p, o in zip(out, out[1:]))


def test_large_groups_agree_with_small_ones():
    rng = random.Random(3)
    core = bytes(rng.randrange(256) for _ in range(R.CORE))
    group = {}
    for _ in range(40):
        right = core + b"".join(rng.choice((b"aaaaaaaaaa", b"aaaaabbbbb")) for _ in range(12))
        left = b"".join(rng.choice((b"xxxxxxxxxx", b"xxxxxyyyyy")) for _ in range(12))
        low, high = sorted((rng.randint(0, 99), rng.randint(0, 99)))
        group[(right[:R.LENGTH], left[:R.PART - 1])] = 1
    rows, last = [], b""
    for right, left in sorted(group):
        rows.append([right, left, 1, R.common(last, right)])
        last = right
    many = R.repeated(rows)
    for i in range(len(rows)):
        want = set()
        for j in range(len(rows)):
            if i != j:
                reach, back = R.common(rows[i][0], rows[j][0]), R.common(rows[i][1], rows[j][1])
                want |= set(range(R.LENGTH - reach, back + 1))
        assert set(o for a, b in zip(many[i][::2], many[i][1::2]) for o in range(a, b + 1)) == want
