"""Alignment of the tokens of two tokenizers over the same bytes.

The ends of a text's A tokens and B tokens, as running byte counts, are two dictionaries from end to token; the ends that
both hold, sorted, cut both id lists into groups. Inside a group of p and q tokens no other end is shared, so its p + q - 1
stretches between neighbouring ends are its links: each lies in one A token and one B token, and each pair of tokens that
overlaps does so in one stretch. Texts are cut at word starts, where both tokenizers end a token, so groups lie inside
words: the dictionaries are made once for each different word a worker meets.

Counts of id pairs over all texts come from a first pass that sends each pair's sum per task. The second pass needs the
pairs' counts in every task: those of at least a threshold are broadcast, the least power of two that leaves at most
COMMON pairs (16 bytes each, whatever the table); links of rarer pairs are joined to the table of counts by a shuffle. No
pair is left out, and none of the shuffled ones is frequent.

Null and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens: zeros and no groups.
Rows repeated or without an id stay rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upland.llm import words as W
from upland.llm.common import byte_view, slices, stash, text_of

COMMON = 1 << 20
KEPT_WORDS = 800_000
BLOCK = 1 << 21
SHIFT = 32                     # an id pair as one number: A's id above, B's below


def default_pair() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def slices_of(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(last A token, last B token) of each group."""
    at_a, at_b = dict(zip(ends_a, range(len(ends_a)))), dict(zip(ends_b, range(len(ends_b))))
    common = sorted(at_a.keys() & at_b.keys())
    return np.array([at_a[e] for e in common], np.int64), np.array([at_b[e] for e in common], np.int64)


def links_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of each overlap, in order: one for each stretch between neighbouring ends."""
    ends = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


class Aligner:
    """Groups and links of words, learned once each."""

    def __init__(self, path_a: str, path_b: str):
        self.path_a, self.pieces = path_a, W.pieces(path_b)
        t = W.byte_level(path_a)
        back = {s: b for b, s in W.SIGNS.items()}
        self.bytes_a = [bytes(back[c] for c in t.id_to_token(i)) if all(c in back for c in t.id_to_token(i)) else b"" for i in range(t.get_vocab_size())]
        self.sizes_a, self.sizes_b = (np.array([len(b) for b in x]) for x in (self.bytes_a, self.pieces.bytes))
        self.table = W.WordTable(self._learn, self._forget, KEPT_WORDS)
        self.before_forget = None
        self._clear()

    def _clear(self) -> None:
        self.pairs, self.groups, self.shape = W.Rows("q"), [], W.Rows("q")
        self.valued: tuple = (None, 0)

    def _forget(self) -> None:
        if self.before_forget:
            self.before_forget()
        self._clear()

    def _learn(self, words: list[bytes]) -> None:
        ids_a, ids_b = W.byte_level_ids(self.path_a, words), self.pieces.ids(words)
        valid = [True] * len(words)
        for ids, table in ((ids_a, self.bytes_a), (ids_b, self.pieces.bytes)):
            valid = [ok and b"".join([table[i] for i in own]) == w for ok, own, w in zip(valid, ids, words)]
        for i in (i for i, ok in enumerate(valid) if not ok):
            ids_a[i], ids_b[i] = [], []
        # the words one after another, so one pair of dictionaries has the ends of all; words end where both end
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (ids_a, ids_b))
        n_a, n_b = (np.array([len(i) for i in x], np.int64) for x in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.sizes_a[flat_a]), np.cumsum(self.sizes_b[flat_b])
        last_a, last_b = slices_of(ends_a.tolist(), ends_b.tolist())
        link_a, link_b = links_of(ends_a, ends_b)
        word_of = np.repeat(np.arange(len(words)), n_a)
        n_groups, n_links = np.bincount(word_of[last_a], minlength=len(words)), np.bincount(word_of[link_a], minlength=len(words))
        self.groups += self._texts(ids_a, ids_b, last_a + 1, last_b + 1, n_groups)
        self.pairs.add_flat(flat_a[link_a] << SHIFT | flat_b[link_b], n_links)
        self.shape.add_flat(np.stack([n_a, n_b, n_groups, n_links, np.array(valid)], 1).astype(np.int64).ravel(), np.full(len(words), 5))

    @staticmethod
    def _texts(ids_a, ids_b, to_a: np.ndarray, to_b: np.ndarray, n_groups: np.ndarray) -> list[str]:
        """The groups of each word as text."""
        a, b = (list(map(str, chain.from_iterable(x))) for x in (ids_a, ids_b))
        texts, i, j = [], 0, 0
        for to_i, to_j in zip(to_a.tolist(), to_b.tolist()):
            texts.append(f"{a[i]}|{b[j]}" if to_i - i == 1 == to_j - j else f"{','.join(a[i:to_i])}|{','.join(b[j:to_j])}")
            i, j = to_i, to_j
        ends = np.cumsum(n_groups).tolist()
        return [";".join(texts[x:y]) for x, y in zip([0, *ends], ends)]

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of each word, first and last word of each text, whether the text has tokens)."""
        at = W.word_starts(data, starts, ends, fine=True)
        numbers = self.table.numbers(data, at)
        first, last = np.searchsorted(at, starts), np.searchsorted(at, ends)
        wrong = W.sums(1 - self.shapes()[numbers, 4], first, last)
        return numbers, first, last, (last > first) & (wrong == 0)

    def shapes(self) -> np.ndarray:
        """Per word: A tokens, B tokens, groups, links, whether both give it back."""
        return self.shape.arrays()[0].reshape(-1, 5)

    def values(self, run: str, keys: np.ndarray, counts: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Per word, from the broadcast counts of a run: sum of its links' counts, links that are their B id's best, links
        whose pair is not among them."""
        done, table = self.valued if self.valued[0] == run else (run, np.zeros((0, 3), np.int64))
        pairs, ends = self.pairs.arrays()
        if len(table) < len(ends) - 1:
            new = pairs[ends[len(table)]:]
            at = np.minimum(np.searchsorted(keys, new), max(len(keys) - 1, 0))
            hit = keys[at] == new if len(keys) else np.zeros(len(new), bool)
            cut = ends[len(table):] - ends[len(table)]
            fresh = [W.sums(np.where(hit, v[at], 0).astype(np.int64) if len(keys) else np.zeros(len(new), np.int64), cut[:-1], cut[1:]) for v in (counts, best)]
            table = np.concatenate([table, np.stack([*fresh, W.sums((~hit).astype(np.int64), cut[:-1], cut[1:])], 1)])
        self.valued = (run, table)
        return table


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """A worker's aligner, which keeps what it has learned."""
    return Aligner(path_a, path_b)


def with_space(raw: np.ndarray, off: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of rows lo to hi with a space before each text that is not empty."""
    ends = off[lo:hi + 1] - off[lo]
    full = np.diff(ends) > 0
    data = np.insert(raw[off[lo]:off[hi]], ends[:-1][full], 32)
    ends = ends + np.concatenate([[0], np.cumsum(full)])
    return data, ends[:-1], ends[1:]


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    raw, off = byte_view(column)
    for lo, hi in slices(off, BLOCK):
        yield (lo, hi, *with_space(raw, off, lo, hi))


def pair_counts(docs: DataFrame, text: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """How many links of all texts hold each id pair linked: pair (A's id * 2**32 + B's), n."""
    paths = _paths(path_a, path_b)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, times, ready = aligner(*paths), np.zeros(0, np.int64), []

        def flush() -> None:
            nonlocal times
            used = np.flatnonzero(times)
            values, ends = al.pairs.arrays()
            pairs = W.spread(values, ends, used)
            keys, which = np.unique(pairs, return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, which, np.repeat(times[used], ends[used + 1] - ends[used]))
            ready.append((keys, n))
            times = np.zeros(0, np.int64)

        al.before_forget = flush
        try:
            for batch in batches:
                for _, _, data, starts, ends in blocks(batch.column(0)):
                    numbers, first, last, valid = al.words(data, starts, ends)
                    numbers = numbers[np.repeat(valid, last - first)]
                    seen = np.bincount(numbers, minlength=len(times))
                    seen[:len(times)] += times
                    times = seen
                    yield from _pairs(ready)
            flush()
            yield from _pairs(ready)
        finally:
            al.before_forget = None

    return docs.select(text_of(docs, text).alias("text")).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _pairs(ready: list) -> Iterator[pa.RecordBatch]:
    while ready:
        keys, n = ready.pop()
        for at in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at:at + (1 << 16)]), pa.array(n[at:at + (1 << 16)])], names=["pair", "n"])


def _paths(path_a: str | None, path_b: str | None) -> tuple[str, str]:
    a, b = default_pair() if path_a is None or path_b is None else (None, None)
    return path_a or a, path_b or b


def common_pairs(counts: DataFrame, most: int) -> tuple[pa.Table, int]:
    """(pairs of at least a threshold with their counts, the threshold): the least power of two that leaves at most `most`."""
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count("*").alias("c")).collect()     # at most 63 rows
    threshold, held = 0, 0
    for r in sorted(sizes, key=lambda r: -r["p"]):
        held += r["c"]
        if held > most:
            threshold = 2 << r["p"]
            break
    return counts.where(F.col("n") >= threshold).toArrow(), threshold


COLUMNS = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None, with_groups: bool = False, common: int | None = None) -> DataFrame:
    """Per document: key, n_a, n_b, n_groups, n_links, n_best (links whose pair has its B id's highest count), count_sum
    (counts of the links' pairs), groups_sha256 of the groups written `a1,a2|b1;a3|b2,b3`, and with_groups that text."""
    paths, spark = _paths(path_a, path_b), docs.sparkSession
    counts = stash(pair_counts(docs, text, *paths))
    low = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    top = counts.groupBy(low.alias("b")).agg(F.max("n").alias("top"))
    chosen, threshold = common_pairs(counts, COMMON if common is None else common)
    keys, n = chosen["pair"].to_numpy(), chosen["n"].to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    tops = top.toArrow()                                                                   # at most one row for each id of B
    ids, highest = tops["b"].to_numpy(), tops["top"].to_numpy()
    order = np.argsort(ids)
    best = n == highest[order][np.searchsorted(ids[order], keys & ((1 << SHIFT) - 1))] if len(keys) else np.zeros(0, bool)
    shared, run = spark.sparkContext.broadcast((keys, n, best)), uuid.uuid4().hex
    name = uuid.uuid4().hex

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(*paths)
        for batch in batches:
            for lo, hi, data, starts, ends in blocks(batch.column(1)):
                numbers, first, last, valid = al.words(data, starts, ends)
                last = np.where(valid, last, first)
                shape, value = al.shapes()[numbers], al.values(run, *shared.value)[numbers]
                columns = [W.sums(shape[:, i], first, last) for i in range(4)] + [W.sums(value[:, 1], first, last), W.sums(value[:, 0], first, last)]
                texts = [";".join([al.groups[w] for w in numbers[a:b].tolist()]) for a, b in zip(first, last)]
                out = [batch.column(0).slice(lo, hi - lo), *map(pa.array, columns), pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts], pa.string())]
                names = [name, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
                if threshold > 1:
                    out.append(pa.array(list(rare(al, shared.value[0], numbers, value[:, 2], first, last)), pa.list_(pa.int64())))
                    names.append("rare")
                if with_groups:
                    out.append(pa.array(texts, pa.string()))
                    names.append("groups")
                yield pa.RecordBatch.from_arrays(out, names=names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{name}` {kind}, {COLUMNS}" + (", rare array<long>" if threshold > 1 else "") + (", groups string" if with_groups else "")
    found = docs.select(docs[key].alias(name), text_of(docs, text).alias("text")).mapInArrow(rows, schema)
    if threshold > 1:
        found = stash(found.withColumn("row", F.monotonically_increasing_id()))            # numbers hold, as the rows are written
        asked = found.select("row", F.explode("rare").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("times"))
        joined = asked.join(counts.where(F.col("n") < threshold), "pair").join(top, F.col("b") == low)
        more = joined.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("n")).alias("sum"))
        found = found.join(more, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("sum", F.lit(0)))
        found = found.drop("row", "rare", "best", "sum")
    return found.withColumnRenamed(name, key)


def rare(al: Aligner, keys: np.ndarray, numbers: np.ndarray, missing: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[list[int]]:
    """Per text the pairs of its links that are not among `keys`, one for each link."""
    pairs, ends = al.pairs.arrays()
    for a, b in zip(first, last):
        of = W.spread(pairs, ends, numbers[a:b][missing[a:b] > 0])
        at = np.minimum(np.searchsorted(keys, of), max(len(keys) - 1, 0))
        yield of[keys[at] != of] if len(keys) else of
