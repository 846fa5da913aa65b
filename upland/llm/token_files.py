"""Token ids in binary shards with a minimal perfect hash index.

A shard is two files. `<name>.ids` holds raw little-endian ids, document after document in key order, two bytes each
where the vocabulary allows, else four. `<name>.idx` maps keys to places in it: a minimal perfect hash gives each of the
n different keys a number below n, under which stand the key's fingerprint and its first row; rows have offsets into the
ids. The hash is built in levels: keys that are alone in their bit of a level are done, the rest go to the next; a key's
number is the count of set bits before its own, read from a running count. So a lookup looks at one or two bits, one
fingerprint and two offsets, whatever the size. Fingerprints are 64-bit scrambles of integer keys, one to one, so an absent
key is never taken for one that is there.

Writing: rows are ranged and sorted by key, each task streams its range into files of names of their own, and the table of
shards (`manifest`) lists the files of the tasks that were kept. A task run again, or twice at once, leaves files that no
manifest names. Shards grow beyond SHARD_BYTES of text only where there would be more than MOST_SHARDS, so the manifest has
a bound.

Nulls: a null text is empty; null keys come first and are looked up by a null key. Repeated keys: their rows follow one
another, ordered by text, and a lookup gives all; a key with very many rows goes over several shards. An empty table has
an empty manifest. Rows equal in key and text cannot be told apart and lie in one shard, streamed.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upland.llm.common import byte_view, mix, scratch, slices, text_of
from upland.llm.words import byte_coder, byte_level

SHARD_BYTES = 32 << 20
MOST_SHARDS = 1 << 16
READ_BYTES = 4 << 20
BLOCK = 1 << 21
GAMMA = 2                      # bits of a level for each key in it
MAGIC = int.from_bytes(b"IDSHARD1", "little")
LEVEL_STEP = np.uint64(0x9E3779B97F4A7C15)
MANIFEST = "name string, first long, last long, first_hash long, n_nulls long, n_docs long, n_ids long, width long"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def place(path: str):
    """(file system, path in it) of a folder, local or remote."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


# ---------------------------------------------------------------- the hash


def _bit(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(keys ^ mix(np.full(1, level + 1, np.uint64) * LEVEL_STEP)) % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """Numbers 0 to n - 1 for n different 64-bit keys: `bits` of all levels one after another as 64-bit words, the words of
    each level in `sizes`, and the set bits before each word in `before`."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, before: np.ndarray):
        self.sizes, self.words, self.before = sizes, words, before
        self.at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        keys, sizes, levels = keys.astype(np.uint64), [], []
        while len(keys):
            n = -(-len(keys) * GAMMA // 64)
            bit = _bit(keys, len(sizes), n * 64)
            alone = np.bincount(bit, minlength=n * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(n)
            keys = keys[~alone[bit]]
        words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        counts = np.cumsum(np.bitwise_count(words), dtype=np.int64)
        return cls(np.array(sizes, np.int64), words, (counts - np.bitwise_count(words)).astype(np.uint32))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; of a key that is not there, -1 or any number."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, n in enumerate(self.sizes.tolist()):
            bit = _bit(keys[open_], level, n * 64)
            word, one = self.at[level] + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64)
            hit = (self.words[word] & one) != 0
            w = word[hit]
            out[open_[hit]] = self.before[w] + np.bitwise_count(self.words[w] & (one[hit] - np.uint64(1)))
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


# ---------------------------------------------------------------- shards


def index_bytes(keys: np.ndarray, n_nulls: int, sizes: np.ndarray, width: int) -> bytes:
    """The index of a shard: its rows' keys in order (the first n_nulls rows have none) and their numbers of ids."""
    own, first = np.unique(keys[n_nulls:].astype(np.int64), return_index=True)
    own, h = own.astype(np.uint64), PerfectHash.of(own)
    number = h.numbers(own)
    marks, rows = np.zeros(len(own), np.uint64), np.zeros(len(own), np.uint64)
    marks[number], rows[number] = mix(own), (first + n_nulls).astype(np.uint64)
    repeats = np.zeros(len(own), np.uint64)
    repeats[number] = np.diff(np.append(first, len(keys) - n_nulls)).astype(np.uint64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint64)
    head = np.array([MAGIC, width, len(own), len(keys), n_nulls, offsets[-1], len(h.sizes)], np.uint64)
    parts = [head, h.sizes.astype(np.uint64), h.words, h.before.astype(np.uint64), marks, rows, repeats, offsets]
    return b"".join(p.astype("<u8").tobytes() for p in parts)


class Shard:
    """One shard, opened for keyed reading."""

    def __init__(self, folder: str, name: str):
        fs, root = place(folder)
        with fs.open_input_stream(f"{root}/{name}.idx") as f:
            all_ = np.frombuffer(f.read(), "<u8")
        if int(all_[0]) != MAGIC:
            raise ValueError(f"{name}.idx is no index of token ids")
        width, n, docs, self.n_nulls, _, levels = (int(v) for v in all_[1:7])
        self.kind = np.dtype("<u2" if width == 2 else "<u4")
        at = 7

        def take(k: int) -> np.ndarray:
            nonlocal at
            at += k
            return all_[at - k:at]

        sizes = take(levels)
        words = int(sizes.sum())
        self.hash = PerfectHash(sizes.astype(np.int64), take(words), take(words))
        self.marks, self.rows, self.repeats, self.offsets = take(n), take(n).astype(np.int64), take(n).astype(np.int64), take(docs + 1).astype(np.int64)
        self.file = fs.open_input_file(f"{root}/{name}.ids")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which key, row) of every row of the given keys."""
        number = self.hash.numbers(keys)
        there = np.flatnonzero(number >= 0)
        there = there[self.marks[number[there]] == mix(keys[there].astype(np.uint64))]
        n = self.repeats[number[there]]
        first = np.repeat(self.rows[number[there]] - (np.cumsum(n) - n), n)
        return np.repeat(there, n), first + np.arange(len(first))

    def pieces(self, row: int) -> Iterator[np.ndarray]:
        """The ids of a row, READ_BYTES at a time."""
        at, end, width = int(self.offsets[row]), int(self.offsets[row + 1]), self.kind.itemsize
        while at < end:
            n = min(end - at, READ_BYTES // width)
            yield np.frombuffer(self.file.read_at(n * width, at * width), self.kind)
            at += n

    def ids(self, row: int) -> np.ndarray:
        return np.concatenate(list(self.pieces(row)) or [np.zeros(0, self.kind)]).astype("<u4")

    def many(self, rows: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(row, its ids in pieces) of ascending rows; rows that lie close together are read together."""
        lo = 0
        while lo < len(rows):
            start = self.offsets[rows[lo]]
            hi = int(np.searchsorted(self.offsets[rows + 1], start + READ_BYTES // self.kind.itemsize, "right"))
            if hi <= lo:
                yield int(rows[lo]), self.pieces(int(rows[lo]))
                lo += 1
                continue
            width = self.kind.itemsize
            block = np.frombuffer(self.file.read_at(int(self.offsets[rows[hi - 1] + 1] - start) * width, int(start) * width), self.kind)
            for r in rows[lo:hi].tolist():
                yield r, [block[self.offsets[r] - start:self.offsets[r + 1] - start]]
            lo = hi


# ---------------------------------------------------------------- writing


def encode_rows(data: np.ndarray, ends: np.ndarray, tokenizer: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids) of texts that follow one another, each closed by end_id."""
    ids, n = byte_coder(tokenizer).encode(data, ends[:-1], ends[1:])
    if end_id is None:
        return ids, n
    out = np.full(len(ids) + len(n), end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
    return out, n + 1


def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int | None = 2,
          shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every text and write the shards under `folder`; the manifest, one row a shard in key order with `start`, the
    ids of all shards before it. Other columns are ignored, whatever their names."""
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise ValueError("keys are whole numbers; hash or number others first")
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    small = docs.select(docs[key].cast("long").alias("key"), text_of(docs, text).alias("text"))
    total = small.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(min(MOST_SHARDS, -(-total // shard_bytes))) or 1
    ranged = small.withColumn("hash", F.xxhash64("text")).repartitionByRange(shards, "key", "hash").sortWithinPartitions("key", "hash", "text")

    def write_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = place(folder)
        width = 2 if max(byte_level(tokenizer).get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else 4
        name, out, keys, sizes, first_hash = uuid.uuid4().hex, None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                out, first_hash = fs.open_output_stream(f"{root}/{name}.ids"), batch.column(2)[0].as_py()
            keys.append(batch.column(0))
            raw, off = byte_view(batch.column(1))
            for lo, hi in slices(off, BLOCK):
                ids, n = encode_rows(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], tokenizer, end_id)
                out.write(ids.astype(f"<u{width}").tobytes())
                sizes.append(n)
        if out is None:
            return
        out.close()
        column, n = pa.chunked_array(keys), np.concatenate(sizes)
        with fs.open_output_stream(f"{root}/{name}.idx") as f:
            f.write(index_bytes(column.fill_null(0).to_numpy(), column.null_count, n, width))
        row = [name, column[0].as_py(), column[-1].as_py(), first_hash, column.null_count, len(column), int(n.sum()), width]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.string()] + [pa.int64()] * 7)], names=["name", "first", "last", "first_hash", "n_nulls", "n_docs", "n_ids", "width"])

    ranged.mapInArrow(write_shard, MANIFEST).write.mode("overwrite").parquet(f"{folder}/written")
    before = Window.orderBy(F.col("first").asc_nulls_first(), "first_hash").rowsBetween(Window.unboundedPreceding, -1)   # at most MOST_SHARDS rows
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/written").withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    rows.write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{MANIFEST}, start long").parquet(f"{folder}/manifest")


# ---------------------------------------------------------------- keyed reading


FOUND = "key long, start long, n_tokens long, ids_crc32 long"


def lookup(keys: DataFrame, folder: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Rows of the documents that the given keys name: key, start (ids of all documents before it), n_tokens, ids_crc32
    (of the ids as little-endian 32-bit numbers) and, if asked for, `ids`. Keys that are not there give no row; a key
    given twice is looked up once."""
    spark = keys.sparkSession
    shards = manifest(spark, folder).orderBy("start", F.col("first").asc_nulls_first(), "first_hash").toArrow()       # at most MOST_SHARDS rows
    names, starts = shards["name"].to_pylist(), shards["start"].to_pylist()
    low = int(np.iinfo(np.int64).min)
    first, last = (shards[c].fill_null(low).to_numpy() for c in ("first", "last"))
    nulls = np.flatnonzero(shards["n_nulls"].to_numpy() > 0)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            none = column.is_null().to_numpy(zero_copy_only=False)
            k = column.fill_null(0).to_numpy()
            a, b = np.searchsorted(last, k, "left"), np.searchsorted(first, k, "right")
            n = np.where(none, 0, np.maximum(b - a, 0))
            at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            which = np.repeat(k, n)
            if none.any():
                at, which = np.concatenate([at, nulls]), np.concatenate([which, np.zeros(len(nulls), np.int64)])
            asked = pa.array(which, mask=np.arange(len(which)) >= len(which) - (len(nulls) if none.any() else 0))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), asked], names=["shard", "key"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, shard = None, None
        for batch in batches:
            at = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(at)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(at)]):
                if lo == hi:
                    continue
                if at[lo] != open_:
                    open_, shard = at[lo], Shard(folder, names[at[lo]])
                asked = batch.column(1).slice(lo, hi - lo)
                k = asked.drop_null().to_numpy()
                which, rows = shard.find(k)
                found = [(k[which], rows, False)]
                if asked.null_count:
                    found.append((np.zeros(shard.n_nulls, np.int64), np.arange(shard.n_nulls), True))
                for of, rows, null in found:
                    yield from answers(shard, of, rows, null, starts[open_], with_ids)

    n = max(1, len(names))
    asked = keys.select(keys[key].cast("long").alias("key")).distinct()
    routed = asked.mapInArrow(route, "shard long, key long").repartition(n, "shard").sortWithinPartitions("shard", "key")
    return routed.mapInArrow(read, FOUND + (", ids array<int>" if with_ids else ""))


def answers(shard: Shard, keys: np.ndarray, rows: np.ndarray, null: bool, start: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    order = np.argsort(rows, kind="stable")
    keys, rows = keys[order], rows[order]
    sums, texts, held, lo = [], [], 0, 0
    for i, (row, parts) in enumerate(shard.many(rows)):
        c, kept = 0, []
        for p in parts:
            p = p.astype("<u4")
            c = zlib.crc32(p, c)
            if with_ids:
                kept.append(p)
        sums.append(c)
        texts.append(kept)
        held += int(shard.offsets[row + 1] - shard.offsets[row])
        if held > READ_BYTES or i + 1 == len(rows):
            part = rows[lo:i + 1]
            columns = [pa.array(keys[lo:i + 1], mask=np.full(len(part), null)), pa.array(start + shard.offsets[part]), pa.array(shard.offsets[part + 1] - shard.offsets[part]), pa.array(sums, pa.int64())]
            if with_ids:
                columns.append(pa.array([np.concatenate(t) if t else np.zeros(0, "<u4") for t in texts], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
            sums, texts, held, lo = [], [], 0, i + 1


def written_and_read(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Every document's place and checksum, read from shards written in the shared folder: doc_id, start, n_tokens,
    ids_crc32."""
    folder = f"{scratch(docs.sparkSession)}/token_files/{uuid.uuid4().hex}"
    write(docs, folder, key, text, tokenizer, end_id)
    return lookup(docs, folder, key).select(F.col("key").alias(key), "start", "n_tokens", "ids_crc32")
