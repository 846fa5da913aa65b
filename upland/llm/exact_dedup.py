"""Exact deduplication with composable polynomial fingerprints.

A text without white space is cut into chunks; a chunk's hash is its bytes as a polynomial, modulo two primes. Chunk
hashes are made independently, in any task, and combine by shifting: hash(xy) = hash(x) * r**len(y) + hash(y). Equal
fingerprints are then compared by content, chunk against chunk: chunks with one hash must hold one text. Chunks that
collide get different numbers, so equal fingerprints of different texts never meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upland.llm.common import SPACES, byte_view, slices, stash, text_of

PRIMES = (2147483647, 2147483629)
ROOTS = (1103515245, 1664525013)
CHUNK = 1 << 16          # code points


def powers(root: int, prime: int, n: int) -> np.ndarray:
    """root**0 .. root**(n-1) modulo prime, by doubling."""
    out = np.ones(n, np.int64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have:have + more] = out[:more] * pow(root, have, prime) % prime
        have += more
    return out


def chunk_hashes(primes=PRIMES, roots=ROOTS):
    """An Arrow function: text chunk -> (n bytes, h1, h2, s1, s2), s being the shift root**n."""
    kind = pa.struct([(c, pa.int64()) for c in ("n", "h1", "h2", "s1", "s2")])
    table: dict[int, np.ndarray] = {}

    def of(chunks: pa.Array) -> pa.Array:
        raw, ends = byte_view(chunks)
        n = np.diff(ends)
        longest = int(n.max()) + 1 if len(n) else 1
        out = [n]
        shifts = []
        for p, r in zip(primes, roots):
            if len(table.get(p, ())) < longest:
                table[p] = powers(r, p, longest)
            h = np.zeros(len(n), np.int64)
            for lo, hi in slices(ends):
                size = n[lo:hi]
                full = np.flatnonzero(size)
                if not len(full):
                    continue
                start, stop = ends[lo], ends[hi]
                back = np.repeat(ends[lo + 1:hi + 1], size) - 1 - np.arange(start, stop)
                terms = (raw[start:stop].astype(np.int64) + 1) * table[p][back]
                h[lo + full] = np.add.reduceat(terms, ends[lo + full] - start) % p
            out.append(h)
            shifts.append(table[p][n])
        return pa.StructArray.from_arrays([pa.array(x) for x in (*out, *shifts)], fields=list(kind))

    return F.arrow_udf(of, "struct<n:bigint,h1:bigint,h2:bigint,s1:bigint,s2:bigint>")


def combined(parts: Column, primes=PRIMES) -> Column:
    """Fold chunk hashes, in order, into the whole text's fingerprint."""
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n", "h1", "h2")])
    return F.aggregate(parts, zero, lambda a, c: F.struct((a["n"] + c["n"]).alias("n"), ((a["h1"] * c["s1"] + c["h1"]) % primes[0]).alias("h1"), ((a["h2"] * c["s2"] + c["h2"]) % primes[1]).alias("h2")))


def chunk_rows(docs: DataFrame, chunk: int, primes) -> DataFrame:
    text = text_of(docs)
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("k"), F.length(text).cast("long").alias("cps"), F.translate(text, SPACES, "").alias("norm"))
    cut = F.when(F.length("norm") <= chunk, F.array("norm")).otherwise(F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)))
    rows = rows.select("doc_id", "k", "cps", F.sha2(F.encode("norm", "UTF-8"), 256).alias("sha"), F.posexplode(cut).alias("no", "chunk"))
    return rows.withColumn("h", chunk_hashes(primes)("chunk"))


def classes(docs: DataFrame, chunk: int = CHUNK, primes=PRIMES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (and k, a hash of the row's own text).

    Texts are equal when the same without white space; of equal ones the longest original stays, then the smallest
    doc_id. Null text counts as empty (all empty texts are equal); a null doc_id sorts after all others; of rows that
    repeat id and text one stays; an empty table gives no rows; other columns are not looked at."""
    rows = chunk_rows(docs, chunk, primes)
    texts = rows.select("h.n", "h.h1", "h.h2", "chunk").distinct()
    clash = stash(texts.groupBy("n", "h1", "h2").agg(F.count("*").alias("texts")).where("texts > 1").select("n", "h1", "h2"))
    parts = rows.select("doc_id", "k", "cps", "sha", "no", "h.*", F.lit(0).alias("twin"))
    if not clash.isEmpty():
        names = texts.join(clash, ["n", "h1", "h2"]).selectExpr("n", "h1", "h2", "chunk", "dense_rank() over (partition by n, h1, h2 order by chunk) as twin")
        parts = rows.select("doc_id", "k", "cps", "sha", "no", "chunk", "h.*").join(names, ["n", "h1", "h2", "chunk"], "left").select("doc_id", "k", "cps", "sha", "no", "n", "h1", "h2", "s1", "s2", F.coalesce("twin", F.lit(0)).alias("twin"))
    # a row that repeats another gives the same chunks again: the set drops them, the count keeps their number
    own = parts.groupBy("doc_id", "k", "cps", "sha").agg(F.array_sort(F.collect_set(F.struct("no", "n", "h1", "h2", "s1", "s2", "twin"))).alias("parts"), F.count("*").alias("rows"))
    own = own.select("doc_id", "k", "cps", "sha", F.expr("rows div size(parts)").alias("times"), combined(F.col("parts"), primes).alias("f"),
                     F.when((F.size("parts") > 1) | (F.element_at("parts", 1)["twin"] > 0), F.transform("parts", lambda x: F.struct(x["n"], x["h1"], x["h2"], x["twin"]))).alias("cut"))
    own = stash(own.select("doc_id", "k", "cps", "sha", "times", F.col("f.n").alias("n"), F.col("f.h1").alias("h1"), F.col("f.h2").alias("h2"), F.coalesce(F.col("cut").cast("string"), F.lit("")).alias("cut")))
    key = ["n", "h1", "h2", "cut"]
    best = F.struct((-F.col("cps")).alias("len"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("k").alias("k"))
    groups = stash(own.groupBy(*key).agg(F.min(best).alias("best"), F.sum("times").alias("group_size")))
    joined = own.join(groups, key).select("doc_id", "k", F.col("best.id").alias("keep_id"), "group_size", (best == F.col("best")).alias("top"), F.col("sha").alias("text_sha256"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"))
    return joined.select("doc_id", "keep_id", "group_size", (F.col("top") & (F.col("copy") == 1)).alias("kept"), "text_sha256", "k")


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """The documents that stay, with all their columns. Rows that repeat id and text are one document."""
    stay = classes(docs, **how).where("kept").select(F.col("doc_id").alias("id_"), F.col("k").alias("k_"))
    rows = docs.select(docs["doc_id"].alias("id"), F.xxhash64(text_of(docs)).alias("k"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    twice = classes_repeat(rows)
    return twice.join(stay, F.col("id").eqNullSafe(F.col("id_")) & (F.col("k") == F.col("k_")), "left_semi").select("row.*")


def classes_repeat(rows: DataFrame) -> DataFrame:
    """One of the rows that share id and text."""
    seen = rows.groupBy("id", "k").agg(F.count("*").alias("n")).where("n > 1")
    return rows if seen.isEmpty() else rows.dropDuplicates(["id", "k"])


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS cps, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY cps DESC, doc_id NULLS LAST)
"""
