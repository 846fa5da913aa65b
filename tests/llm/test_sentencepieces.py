import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.util import clashing, docs
from upland.llm import sentencepieces as S
from upland.llm.common import mix

V = S.vocabulary(S.default_model())


def brute(text):
    """All segmentations of a word's text with their probabilities."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=S.default_model())
    lp = dict(zip(V.ids.tolist(), V.lp.tolist()))
    spelled = S.SPACE + text.replace(" ", S.SPACE)
    paths = [((), 0, 0.0)]
    done = []
    while paths:
        ids, at, total = paths.pop()
        if at == len(spelled):
            done.append((ids, total))
            continue
        singles = False
        for k in range(1, V.longest + 1):
            piece = spelled[at:at + k]
            i = sp.piece_to_id(piece)
            if len(piece) == k and i in lp and sp.id_to_piece(i) == piece:
                singles |= k == 1
                paths.append((ids + (i,), at + k, total + lp[i]))
        if not singles:
            raw = spelled[at].encode()
            paths.append((ids + tuple(V.byte_ids[list(raw)].tolist()), at + 1, total - S.BYTE_COST * len(raw)))
    z = math.log(sum(math.exp(t) for _, t in done))
    return {ids: t - z for ids, t in done}


def test_probabilities_and_distinctness():
    for text in ("there", "ab", "\n", "ñab", "to be"):
        want = brute(text)
        for row in S.sampled([text] * 50, mix(np.arange(50).astype(np.uint64)), 4, V):
            keys = [tuple(r[0].tolist()) for r in row]
            assert len(set(keys)) == len(keys) == min(4, len(want))
            values = [r[2] for r in row]
            assert values == sorted(values, reverse=True)
            assert all(abs(r[1] - want[k]) < 1e-6 for r, k in zip(row, keys))


def test_a_sample_without_replacement():
    """Shares of first draws, of second draws given the first, and weighted sums agree with the probabilities."""
    flat = S.Vocabulary(S.default_model())
    flat.lp = np.full_like(flat.lp, -3.0)
    n = 6000
    rows = S.sampled(["andre"] * n, mix(np.arange(n).astype(np.uint64)), 3, flat)
    p = {}
    for r in rows:
        for ids, lp, *_ in r:
            p[tuple(ids)] = math.exp(lp)
    assert len(p) > 5 and abs(sum(p.values()) - 1) < 0.01
    first = Counter(tuple(r[0][0]) for r in rows)
    assert all(abs(first[q] / n - p[q]) < 4 * math.sqrt(p[q] / n) + 0.002 for q in p)
    top = first.most_common(1)[0][0]
    second = Counter(tuple(r[1][0]) for r in rows if tuple(r[0][0]) == top)
    m = sum(second.values())
    assert all(abs(second[q] / m - p[q] / (1 - p[top])) < 4 * math.sqrt(p[q] / m) + 0.01 for q in p if q != top)
    assert abs(np.mean([sum(math.exp(lp) / q for _, lp, _, q in r) for r in rows]) - 1) < 0.05


def test_the_table(spark, data):
    texts = ["", None, "hello  world", "\ttabs\nand lines ", "日本語のテキスト", "🎉 x", "y" * 5000, "a b " * 20000, "hello  world", " "]
    own = docs(spark, texts).unionByName(spark.read.parquet(f"{data}/documents.parquet").limit(40).withColumn("doc_id", F.col("doc_id") + 100))
    n = own.count()
    rows = S.encode(clashing(own, "pieces", "sample", "exact"), k=2)
    got = S.decode(rows).join(own.select("doc_id", "text"), "doc_id").collect()
    assert all(r["exact"] and r["decoded"] == (r["text"] or "") and r["n_pieces"] == len(r["pieces"]) and 0 < r["inclusion"] <= 1 or r["inclusion"] == 0 for r in got)
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in own.collect()} and n < len(got) <= 2 * n - 2
    single = {r["doc_id"] for r in got} - {r["doc_id"] for r in got if r["sample"] == 2}
    assert {0, 1} <= single and all(r["inclusion"] == 1 for r in got if r["doc_id"] in single)
    again = {(r["doc_id"], r["sample"]): r["pieces"] for r in S.encode(own.repartition(5), k=2).collect()}
    assert again == {(r["doc_id"], r["sample"]): r["pieces"] for r in got}
    assert S.encode(docs(spark, [])).count() == 0
    assert S.encode(docs(spark, ["a", "a"], ids=[None, 5])).count() == 2
