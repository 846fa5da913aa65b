import random
import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.util import clashing, docs
from upland.llm import token_files as TF
from upland.llm import words as W
from upland.llm.common import scratch

PATH = TF.default_tokenizer()


def whole(text):
    return W.byte_level(PATH).encode(text or "", add_special_tokens=False).ids


def by_hand(rows):
    """(doc_id, start, n, crc) of (doc_id, text) rows in key order, as a list."""
    out, at = [], 0
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*whole(t), 2]
        out.append((k, at, len(ids), zlib.crc32(array("I", ids).tobytes())))
        at += len(ids)
    return out


def encode_all(texts):
    raw = [t.encode() for t in texts]
    ends = np.cumsum([0, *map(len, raw)])
    ids, n = W.ByteCoder(PATH).encode(np.frombuffer(b"".join(raw), np.uint8), ends[:-1], ends[1:])
    at = np.cumsum([0, *n])
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


SIGNS = "ab Z.,;:!?)('s\n\t é×ßÀ́  　日本▁😀0<|endoftext|>\x00\x85"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(SIGNS), max_size=25), max_size=5))
def test_words_give_the_ids_of_whole_texts(texts):
    assert encode_all(texts) == [whole(t) for t in texts]


def test_words_of_prose_and_long_words():
    r = random.Random(3)
    texts = ["<|endoftext|> a", "x" * 5000, " ".join("".join(r.choices("abcé,.'s\n", k=r.randint(1, 30))) for _ in range(2000)), "", "it's we'll \n\n  end \n", "a\nb,c d"]
    assert encode_all(texts) == [whole(t) for t in texts]


def test_words_are_forgotten_within_bounds(monkeypatch):
    monkeypatch.setattr(W, "KEPT_WORDS", 3)
    coder = W.ByteCoder(PATH)
    for text in ("one two three four five six", "seven one two", "one nine"):
        d = np.frombuffer(text.encode(), np.uint8)
        assert coder.encode(d, np.array([0]), np.array([len(d)]))[0].tolist() == whole(text)


def test_perfect_hash_is_minimal_and_knows_its_keys():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(r.integers(-2**63, 2**63 - 1, n)).astype(np.uint64) if n > 2 else np.arange(n, dtype=np.uint64)
        h = TF.PerfectHash.of(keys)
        assert sorted(h.numbers(keys).tolist()) == list(range(len(keys)))
        assert h.words.size * 64 <= 2 * GAMMA_WORST * max(n, 1) + 64 * 70


GAMMA_WORST = 4


def test_round_trip(spark):
    r = random.Random(5)
    rows = [(i * 7 - 300, " ".join(r.choices(["alpha", "Beta,", "γ", "don't", "x1\n"], k=r.randint(0, 60)))) for i in range(400)]
    rows += [(None, "no key"), (None, None), (5000, None), (5001, ""), (5002, "   "), (5003, "z" * 40_000)]
    r.shuffle(rows)
    df = clashing(docs(spark, [t for _, t in rows], ids=[0] * len(rows)), "key", "hash", "ids", "start").drop("doc_id")
    ids = spark.createDataFrame([(t, k) for k, t in rows], "t string, doc_id long")
    df = ids.withColumn("text", ids.t).withColumn("key", ids.t).withColumn("hash", ids.t).withColumn("start", ids.t)
    folder = f"{scratch(spark)}/token_tests/{r.random()}"
    m = TF.write(df, folder, shard_bytes=2000)
    assert m.count() > 4
    got = TF.lookup(df, folder, with_ids=True).collect()
    want = by_hand([x for x in rows if x[0] is not None])
    shift = sum(len(whole(t)) + 1 for k, t in rows if k is None)
    assert sorted((g["key"], g["start"], g["n_tokens"], g["ids_crc32"]) for g in got if g["key"] is not None) == [(k, s + shift, n, c) for k, s, n, c in want]
    assert sorted(g["ids"] for g in got if g["key"] is None) == sorted([*whole(t), 2] for k, t in rows if k is None)
    texts = dict(rows)
    assert all(g["ids"] == [*whole(texts[g["key"]]), 2] for g in got if g["key"] is not None)
    assert [g["start"] for g in sorted(got, key=lambda g: g["start"])] == np.cumsum([0] + [g["n_tokens"] for g in sorted(got, key=lambda g: g["start"])])[:-1].tolist()
    # keys that are not there, and one asked for twice
    some = TF.lookup(spark.createDataFrame([(1,), (2,), (10**15,), (-300,), (-300,)], "doc_id long"), folder).collect()
    assert [g["key"] for g in some] == [-300] + [k for k in (1, 2) if k in texts]


def test_repeated_keys_over_shards(spark):
    rows = [(7, f"text {i} of one key") for i in range(300)] + [(8, "next")] + [(6, "before")] * 3
    folder = f"{scratch(spark)}/token_tests/{random.random()}"
    m = TF.write(spark.createDataFrame(rows, "doc_id long, text string"), folder, shard_bytes=600)
    assert m.where("first = 7 AND last = 7").count() > 1
    got = TF.lookup(spark.createDataFrame([(7,), (6,)], "doc_id long"), folder, with_ids=True).collect()
    assert sorted(tuple(g["ids"]) for g in got if g["key"] == 7) == sorted((*whole(t), 2) for k, t in rows if k == 7)
    assert sum(g["key"] == 6 for g in got) == 3


def test_wide_ids_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(TF, "READ_BYTES", 64)
    folder = f"{scratch(spark)}/token_tests/{random.random()}"
    rows = [(1, "a b c " * 50), (2, "d"), (3, ""), (4, "e f g h " * 20)]
    TF.write(spark.createDataFrame(rows, "doc_id long, text string"), folder, end_id=70_000).collect()
    m = TF.manifest(spark, folder).first()
    shard = TF.Shard(folder, m["name"])
    assert m["width"] == 4
    for i, (_, t) in enumerate(rows):
        assert shard.ids(i).tolist() == [*whole(t), 70_000]
    assert [(r, np.concatenate(list(p)).tolist()) for r, p in shard.many(np.arange(4))] == [(i, [*whole(t), 70_000]) for i, (_, t) in enumerate(rows)]


def test_empty_table_and_odd_keys(spark):
    empty = docs(spark, []).limit(0)
    assert TF.written_and_read(empty).collect() == []
    with pytest.raises(ValueError):
        TF.write(spark.createDataFrame([("a", "b")], "doc_id string, text string"), "x")


def test_given_table(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(x["doc_id"], x["text"]) for x in df.select("doc_id", "text").collect()]
    got = sorted(tuple(x) for x in TF.written_and_read(df).collect())
    assert got == sorted(by_hand(rows))
