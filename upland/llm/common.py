"""Shared helpers: scratch tables, bounded bitmaps, byte views of Arrow text, and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SLICE_BYTES = 1 << 20   # text looked at together by the numpy code, so temporaries stay small


def scratch(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named


def stash(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


# ---------------------------------------------------------------- bounded membership


def bitmap(df: DataFrame, key: Column, bits: int = 24) -> np.ndarray:
    """2**bits bits, one set for the low bits of each key: at most 2**(bits - 6) words reach the driver, whatever the
    number of keys. Membership has false positives only, so it may thin work but never decide a result."""
    slot = key.bitwiseAND(F.lit((1 << bits) - 1))
    words = (df.select(F.shiftright(slot, 6).alias("w"), F.expr("1L").alias("one"), slot.bitwiseAND(F.lit(63)).cast("int").alias("b"))
             .groupBy("w").agg(F.bit_or(F.expr("shiftleft(one, b)")).alias("v")).toArrow())
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["w"].to_numpy()] = words["v"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.astype(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


# ---------------------------------------------------------------- bytes of Arrow text


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    ends = np.frombuffer(off, np.int64 if large else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, ends


def slices(ends: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; a longer row is alone in its range."""
    lo, n = 0, len(ends) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_RNG = np.random.default_rng(20240511)
BYTE_KEYS = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(BASE, 4096)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_BACK = powers(_INVERSE, 4096)


def _power(base_table: np.ndarray, at: np.ndarray) -> np.ndarray:
    low, high = at & 4095, at >> 12
    out = base_table[low]
    if len(high) and high.max():
        big = powers((base_table[4095:] * base_table[1:2])[0], int(high.max()) + 1)
        out = out * big[high]
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans [start, end) of one buffer, equal spans hashing equally wherever they stand."""
    at = np.arange(len(data), dtype=np.int64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_KEYS[data] * _power(_POWERS, at), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_BACK, starts) + (ends - starts).astype(np.uint64))


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every id of an edge, root being the smallest id of its component.

    Each round takes every root to the smallest root next to it, follows that pointer once more, and contracts the
    edges; what remains shrinks geometrically and is written to the shared folder. A hub's edges are pre-aggregated by
    min() before the shuffle and its joins may be split, since both sides come from files."""
    live = stash(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = stash(live.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("root", F.col("id")))
    while not live.isEmpty():
        step = live.select(F.explode(F.array(F.struct(F.col("b").alias("id"), F.col("a").alias("to")), F.struct(F.col("a").alias("id"), F.col("a").alias("to")))).alias("e")).select("e.*")
        step = stash(step.groupBy("id").agg(F.min("to").alias("to")))
        far = step.select(F.col("id").alias("to"), F.col("to").alias("far"))
        step = stash(step.join(far, "to").select("id", F.least("to", "far").alias("to")))
        labels = stash(labels.join(step.withColumnRenamed("id", "root"), "root", "left").select("id", F.coalesce("to", "root").alias("root")))
        one = live.join(step.select(F.col("id").alias("a"), F.col("to").alias("ra")), "a")
        two = one.join(step.select(F.col("id").alias("b"), F.col("to").alias("rb")), "b")
        live = stash(two.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return labels
