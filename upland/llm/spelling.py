"""Spelling variants: words one edit apart, found in k-d trees over letter counts.

One edit changes a word's letter counts by at most two in L1 distance: by two when a letter is replaced, by one when one
is put in or left out. So for each pair of lengths (the same, one more, one less) the words of one length are searched in
the k-d tree of the other within two or one, and what is found is held letter by letter.

The tree has two parts. Its top is cut from a bounded sample of the words and only decides where words are compared: each
word lives in one cell of the tree of its length and is sent as a query to every cell of its length and the neighbouring
ones that its ball reaches. A cell's task holds the cell's words, splits them on in a tree with tight boxes and streams
the queries through it. Cells hold about CELL words as long as the sample can tell; beyond that they grow, but only with
the number of different words over the number of cells. What comes back is one row for each query and cell with any near
word, added up by word with partial sums.

Null texts have no words; a null id counts as empty in the hash. Words with equal letter counts need no split of their
own, since they are never one edit apart. Equal counts n are settled by code-point order. An empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upland.llm.common import stash, text_of

RUN = "[a-z\\u00C0-\\u00FF]+"
EVERY = 97                     # fixed values of the planted slips and of what counts as a word
SHORTEST, LEAST, FACTOR = 5, 3, 2
LETTERS = 26 + 64              # a to z, U+00C0 to U+00FF
SAMPLE = 1 << 17
CELL = 32_000
BUCKET = 48
PAIRS = 1 << 20
MAIN, STEPS, REST = 26, 4, 24  # bits of a word's mark: four steps of each plain letter, and the parity of all else


# ---------------------------------------------------------------- words


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words as they stand, with the slips: where the hash of id and run is a multiple of EVERY, one letter is left out."""
    upper = "".join(map(chr, range(65, 91)))
    runs = docs.select(F.coalesce(docs[key].cast("string"), F.lit("")).alias("id"), F.translate(text_of(docs, text), upper, upper.lower()).alias("t"))
    runs = runs.select("id", F.explode(F.regexp_extract_all("t", F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= SHORTEST)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    short = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return runs.select(F.when(h % EVERY == 0, short).otherwise(F.col("run")).alias("word")).where(F.length("word") >= SHORTEST)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return occurrences(docs, key, text).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)


# ---------------------------------------------------------------- letters


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all words one after another as small numbers, ends)."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    ends = np.cumsum([0, *map(len, words)])
    return np.where(codes < 128, codes - 97, codes - 0xC0 + 26).astype(np.uint8), ends


def letter_counts(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    rows = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    kind = np.int16 if len(ends) < 2 or np.diff(ends).max() < 1 << 14 else np.int32
    return np.bincount(rows * LETTERS + flat, minlength=(len(ends) - 1) * LETTERS).reshape(-1, LETTERS).astype(kind)


def marks(counts: np.ndarray) -> np.ndarray:
    """128 bits for each row, of which two rows differ in at most as many as their counts differ by."""
    bits = [counts[:, :MAIN] > k for k in range(STEPS)]
    over = np.zeros((len(counts), REST), np.int64)
    np.add.at(over, (slice(None), np.arange(LETTERS - MAIN) % REST), counts[:, MAIN:])
    np.add.at(over, (slice(None), np.arange(MAIN) % REST), np.maximum(counts[:, :MAIN] - STEPS, 0))
    return np.packbits(np.concatenate([*bits, over % 2 == 1], 1), axis=1, bitorder="little").view("<u8")


# ---------------------------------------------------------------- top of the trees


class Top:
    """Trees of all lengths, cut from a sample. Cells are numbered; a length without a tree is one cell."""

    def __init__(self, words: list[str], total: int, cell: int = CELL):
        self.nodes: list[tuple] = []
        self.roots: dict[int, int] = {}
        self.cells = 0
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        least = max(16, round(cell * len(words) / max(total, 1)))
        for length in sorted(by_length):
            self.roots[length] = self._node(letter_counts(*letters(by_length[length])), least)

    def _node(self, counts: np.ndarray, least: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        cut = split(counts) if len(counts) > least else None
        if cut is None:
            self.nodes[at] = (self.cells,)
            self.cells += 1
        else:
            left = counts[:, cut[0]] <= cut[1]
            self.nodes[at] = (*cut, self._node(counts[left], least), self._node(counts[~left], least))
        return at

    def reached(self, length: int, counts: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, rows of counts whose ball of this radius reaches it) in the tree of a length."""
        if length not in self.roots:
            yield -length, np.arange(len(counts))
            return
        none = np.zeros(len(counts), np.int64)
        stack = [(self.roots[length], np.arange(len(counts)), none, {})]
        while stack:
            node, rows, far, bounds = stack.pop()
            if len(self.nodes[node]) == 1:
                yield self.nodes[node][0], rows
                continue
            dim, cut, *children = self.nodes[node]
            low, high = bounds.get(dim, (-1, 1 << 30))
            value = counts[rows, dim].astype(np.int64)
            outside = lambda a, b: np.maximum(a - value, 0) + np.maximum(value - b, 0)
            for child, span in zip(children, ((low, min(high, cut)), (max(low, cut + 1), high))):
                d = far[rows] - outside(low, high) + outside(*span)
                keep = d <= radius
                if keep.any():
                    inside = none.copy()
                    inside[rows[keep]] = d[keep]
                    stack.append((child, rows[keep], inside, {**bounds, dim: span}))


def split(counts: np.ndarray) -> tuple[int, int] | None:
    """(letter, count) that parts rows best: the letter of the largest variance, at its median."""
    dim = int(counts.var(axis=0).argmax())
    values = counts[:, dim]
    cut = int(np.median(values))
    if cut >= values.max():
        cut = int(values.max()) - 1
    return (dim, cut) if values.min() <= cut else None


# ---------------------------------------------------------------- one cell


class Cell:
    """The words of one length in one cell, for range searches of words of this length or one more or less."""

    def __init__(self, words: list[str], n: np.ndarray):
        order = sorted(range(len(words)), key=lambda i: (-int(n[i]), words[i]))        # so the least row is the best form
        self.words, self.n, self.length = [words[i] for i in order], n[order], len(words[0])
        flat, ends = letters(self.words)
        self.flat = flat.reshape(len(words), self.length)
        counts = letter_counts(flat, ends)
        self.used = np.flatnonzero(counts.any(axis=0))
        self.counts, self.marks = self._narrow(counts), marks(counts)
        self.root = self._node(np.arange(len(words)))

    def _narrow(self, counts: np.ndarray) -> np.ndarray:
        """Counts of the letters these words have, and the sum of all others."""
        others = counts.sum(axis=1, keepdims=True) - counts[:, self.used].sum(axis=1, keepdims=True)
        return np.concatenate([counts[:, self.used], others], 1).astype(counts.dtype)

    def _node(self, rows: np.ndarray) -> tuple:
        counts = self.counts[rows]
        box = counts.min(axis=0), counts.max(axis=0)
        cut = split(counts) if len(rows) > BUCKET else None
        if cut is None:
            return (*box, rows)
        left = counts[:, cut[0]] <= cut[1]
        return (*box, self._node(rows[left]), self._node(rows[~left]))

    def candidates(self, counts: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query rows, own rows) whose letter counts may differ by at most the radius."""
        narrow, mark = self._narrow(counts), marks(counts)
        stack = [(self.root, np.arange(len(counts)))]
        while stack:
            (low, high, *rest), rows = stack.pop()
            own = narrow[rows]
            rows = rows[(np.maximum(low - own, 0) + np.maximum(own - high, 0)).sum(axis=1) <= radius]
            if not len(rows):
                continue
            if len(rest) == 2:
                stack += [(rest[0], rows), (rest[1], rows)]
                continue
            for at in range(0, len(rest[0]), PAIRS):                   # only rows of equal counts can be more than a bucket
                mine = rest[0][at:at + PAIRS]
                step = max(1, PAIRS // len(mine))
                for lo in range(0, len(rows), step):
                    part = rows[lo:lo + step]
                    differ = np.bitwise_count(mark[part, None, 0] ^ self.marks[None, mine, 0]) + np.bitwise_count(mark[part, None, 1] ^ self.marks[None, mine, 1])
                    q, p = np.nonzero(differ <= radius)
                    if len(q):
                        yield part[q], mine[p]

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For words of one length: how many of the cell's words are one edit away, and the best of them (or -1)."""
        flat, ends = letters(words)
        length = len(words[0])
        flat, counts = flat.reshape(len(words), length), letter_counts(flat, ends)
        n, best = np.zeros(len(words), np.int64), np.full(len(words), len(self.words), np.int64)
        step = max(1, (16 << 20) // self.length)
        for q, p in packed(self.candidates(counts, 2 if length == self.length else 1)):
            for lo in range(0, len(q), step):
                a, b = q[lo:lo + step], p[lo:lo + step]
                ok = one_edit(flat[a], self.flat[b])
                n += np.bincount(a[ok], minlength=len(n))
                np.minimum.at(best, a[ok], b[ok])
        return n, np.where(n > 0, best, -1)


def packed(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Small runs of pairs put together."""
    held: list = []
    size = 0
    for pair in pairs:
        held.append(pair)
        size += len(pair[0])
        if size >= PAIRS:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows differ by exactly one replaced letter, or one put in or left out."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    short, long = (a, b) if a.shape[1] < b.shape[1] else (b, a)
    head = np.minimum.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    tail = np.minimum.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= short.shape[1]


# ---------------------------------------------------------------- on Spark


def near_words(vocab: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """Of a written table (word, n) with different words: word, n_near, best (n, word) for the words with any near word."""
    spark, total = vocab.sparkSession, vocab.count()
    share = min(1.0, sample / max(total, 1))
    chosen = vocab.where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))).select("word").toArrow()       # about `sample` words
    top = Top(chosen["word"].to_pylist(), total, cell)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            lengths = np.array([len(w) for w in words], np.int64)
            for length in np.unique(lengths).tolist():
                of = np.flatnonzero(lengths == length)
                counts = letter_counts(*letters([words[i] for i in of]))
                for other in range(max(SHORTEST, length - 1), length + 2):
                    for role, radius in ((0, 0), (1, 2)) if other == length else ((1, 1),):
                        for c, rows in top.reached(other, counts, radius):
                            at = pa.array(of[rows])
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), c)), pa.array(np.full(len(rows), role, np.int32)), batch.column(0).take(at), batch.column(1).take(at)], names=["cell", "role", "word", "n"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, words, n, cell_ = None, [], [], None
        for batch in batches:
            ids, roles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = (np.flatnonzero((np.diff(ids) != 0) | (np.diff(roles) != 0)) + 1).tolist()
            for lo, hi in zip([0, *edges], [*edges, len(ids)]):
                if lo == hi:
                    continue
                if ids[lo] != open_:
                    open_, words, n, cell_ = ids[lo], [], [], None
                part = batch.column(2).slice(lo, hi - lo).to_pylist()
                if roles[lo] == 0:
                    words += part
                    n.append(batch.column(3).slice(lo, hi - lo).to_numpy())
                    continue
                if not words:                                            # a cell that only queries reach
                    continue
                cell_ = cell_ or Cell(words, np.concatenate(n))
                for length in {len(w) for w in part}:
                    asked = [w for w in part if len(w) == length]
                    found, best = cell_.near(asked)
                    hit = np.flatnonzero(found)
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([pa.array([asked[i] for i in hit]), pa.array(found[hit]), pa.array(cell_.n[best[hit]]), pa.array([cell_.words[i] for i in best[hit]])], names=["word", "found", "best_n", "best"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    routed = vocab.select("word", "n").mapInArrow(route, "cell long, role int, word string, n long").repartition(parts, "cell").sortWithinPartitions("cell", "role")
    found = routed.mapInArrow(search, "word string, found long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("found").alias("n_near"), best.alias("_b")).select("word", "n_near", (-F.col("_b.less")).alias("best_n"), F.col("_b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form): the last form reached from each word. Forms are at least FACTOR times as
    frequent as their words, so chains end; each round doubles the steps taken."""
    now = stash(forms.select("word", F.col("form").alias("root")))
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("_up"))
        now = stash(now.select("word", "root").join(up, "root", "left").select("word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """Words of all texts with their spelling variants: word, n, n_near (words one edit away), form (the near word of
    largest n, if at least twice as frequent), form_n, root (the last of the chain of forms)."""
    vocab = stash(vocabulary(docs, key, text))
    near = near_words(vocab, cell, sample)
    is_form = F.col("best_n") >= FACTOR * F.col("n")
    all_ = stash(vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    last = roots(all_.where("form IS NOT NULL"))
    return all_.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = """
WITH RECURSIVE runs AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
held AS (SELECT doc_id, run, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM runs WHERE length(run) >= 5),
bytes AS (SELECT doc_id, run, flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM held),
hashed AS (SELECT doc_id, run, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) AS h FROM bytes),
slips AS (SELECT doc_id, run, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
every AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
vocab AS (SELECT word, count(*) AS n FROM every JOIN slips ON every.run = slips.run AND every.doc_id IS NOT DISTINCT FROM slips.doc_id WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3),
holes AS (SELECT word, n, i, substr(word, 1, i::INT - 1) AS head, substr(word, i::INT + 1) AS tail FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
UNION SELECT a.word, b.word, b.n FROM holes a JOIN vocab b ON a.head || a.tail = b.word
UNION SELECT b.word, a.word, a.n FROM holes a JOIN vocab b ON a.head || a.tail = b.word),
best AS (SELECT word, count(*) AS n_near, min({'l': -other_n, 'w': other}) AS s FROM near GROUP BY word),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -s.l >= 2 * v.n THEN s.w END AS form, CASE WHEN -s.l >= 2 * v.n THEN -s.l END AS form_n FROM vocab v LEFT JOIN best ON best.word = v.word),
chain AS (SELECT word, word AS at FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word JOIN formed l ON l.word = c.at WHERE l.form IS NULL
"""
