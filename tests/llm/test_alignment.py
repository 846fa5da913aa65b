import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.util import clashing, docs
from upland.llm import alignment as AL
from upland.llm import words as W

A, B = AL.default_pair()
SIGNS = "ab Z.,;:!?)('s\n\t é×ß́  　日本▁😀0<s>\x85"


def bytes_of(ids, table):
    return [table[i] for i in ids]


def by_hand(texts):
    """The contract's columns, from whole texts: every overlapping pair of tokens, tested pair by pair."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    t, al = W.byte_level(A), AL.aligner(A, B)
    docs_links, rows = [], []
    for text in texts:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        pa, pb = bytes_of(a, al.bytes_a), bytes_of(b, al.pieces.bytes)
        if not text or b"".join(pa) != (" " + text).encode() or b"".join(pb) != (" " + text).encode():
            rows.append((0, 0, 0, 0, ""))
            docs_links.append([])
            continue
        sa, sb = [sum(map(len, pa[:i])) for i in range(len(a) + 1)], [sum(map(len, pb[:i])) for i in range(len(b) + 1)]
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if sa[i] < sb[j + 1] and sb[j] < sa[i + 1]]
        cuts = sorted(set(sa) & set(sb))
        groups = ";".join(f"{','.join(str(a[i]) for i in range(len(a)) if x <= sa[i] < y)}|{','.join(str(b[j]) for j in range(len(b)) if x <= sb[j] < y)}" for x, y in zip(cuts, cuts[1:]))
        rows.append((len(a), len(b), len(cuts) - 1, len(links), hashlib.sha256(groups.encode()).hexdigest()))
        docs_links.append(links)
    n = Counter(x for links in docs_links for x in links)
    top = {}
    for (_, b), c in n.items():
        top[b] = max(top.get(b, 0), c)
    return [(*r[:4], sum(n[x] == top[x[1]] for x in links), sum(n[x] for x in links), r[4]) for r, links in zip(rows, docs_links)]


def prose(r, words):
    return " ".join("".join(r.choices("abcdeé,.'\n▁ A1", weights=[9] * 6 + [2] * 4 + [0.02, 1, 1, 1], k=r.randint(1, 12))) for _ in range(words))


def got(df, **k):
    return [tuple(x)[1:] for x in sorted(AL.align(df, **k).collect(), key=lambda x: x["doc_id"])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(SIGNS), max_size=20), min_size=1, max_size=4))
def test_words_give_the_pieces_of_whole_texts(texts):
    import numpy as np
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    p = W.pieces(B)
    for t in texts:
        if not t:
            continue
        raw = (" " + t).encode()
        at = W.word_starts(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), fine=True)
        words = [raw[a:b] for a, b in zip(at.tolist(), [*at.tolist()[1:], len(raw)])]
        assert [i for ids in p.ids(words) for i in ids] == sp.encode(t)


@pytest.mark.parametrize("common", [None, 40, 0])
def test_against_brute_force(spark, common):
    r = random.Random(11)
    texts = [prose(r, r.randint(1, 40)) for _ in range(60)] + ["", None, " ", "\n", "a▁b", "<0x41> <s> <|endoftext|>", "日本語のテキスト", "é" * 300, "same text", "same text", "x\x00y"]
    df = clashing(docs(spark, texts), "pair", "n", "row", "rare", "b", "top", "words")
    assert got(df, common=common) == by_hand(texts)


def test_forgetting_keeps_counts(spark, monkeypatch):
    monkeypatch.setattr(AL, "BLOCK", 200)
    monkeypatch.setattr(AL, "KEPT_WORDS", 4)
    al = AL.Aligner(A, B)
    import numpy as np
    seen = Counter()

    def flush():
        seen["forgotten"] += 1

    al.before_forget = flush
    for t in ("one two three four five six", "seven eight nine"):
        raw = np.frombuffer((" " + t).encode(), np.uint8)
        numbers, *_ = al.words(raw, np.array([0]), np.array([len(raw)]))
        assert ";".join(al.groups[w] for w in numbers).count(";") == len(t.split()) - 1
    assert seen["forgotten"] == 1


def test_groups_are_given(spark):
    row = AL.align(docs(spark, ["an example of text"]), with_groups=True).first()
    assert hashlib.sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"]


def test_null_ids_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    for common in (None, 0):
        rows = AL.align(df, common=common).collect()
        assert sorted((x["doc_id"] is None, x["count_sum"] > 0) for x in rows) == [(False, False), (False, True), (True, True), (True, True)]
    assert AL.align(docs(spark, ["a"]).limit(0)).collect() == []


def test_given_table(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet").where("length(text) < 1500")
    texts = [x["text"] for x in df.orderBy("doc_id").collect()]
    assert got(df) == by_hand(texts)
