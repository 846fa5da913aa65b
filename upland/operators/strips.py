"""Whole-metre cells beside and on line pieces, as words of 64 cells along each row.

Work grows with the length of the pieces, not with the plane. Pieces are dealt by place; a task reads them batch by batch,
row by row of cells, and joins what many pieces cover before anything is sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACE_M = 1024                 # pieces of one square of this side, in four lots, go to one task
CELLS = 400_000                # cells looked at together (more only for a single longer piece)
FIELDS = ("ax", "ay", "bx", "by", "ux", "uy", "len", "side", "inner", "outer")


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of so many items of every row: the row and the number of the item in it."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _between(slope: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x with low <= slope * x + at <= high; no bound where the slope is almost nothing."""
    flat = np.abs(slope) < 1e-6
    safe = np.where(flat, 1.0, slope)
    a, b = (low - at) / safe, (high - at) / safe
    return np.where(flat, -1e15, np.minimum(a, b)), np.where(flat, 1e15, np.maximum(a, b))


def _words(p: dict[str, np.ndarray], tag: np.ndarray, band: bool) -> list[np.ndarray]:
    """tag, gy, word, mask of the cells of some pieces; one word may come many times."""
    dx, dy = p["bx"] - p["ax"], p["by"] - p["ay"]
    size = np.sqrt(dx * dx + dy * dy)
    reach = np.ceil(p["outer"])
    low, high = (np.minimum(p["inner"] * p["side"], p["outer"] * p["side"]), np.maximum(p["inner"] * p["side"], p["outer"] * p["side"])) if band else (-p["outer"], p["outer"])
    past = np.zeros(len(dx)) if band else p["outer"]
    south, north = (np.floor(f(p["ay"], p["by"]) + d).astype(np.int64) for f, d in ((np.minimum, -reach), (np.maximum, reach)))
    west, east = (np.floor(f(p["ax"], p["bx"]) + d).astype(np.int64) for f, d in ((np.minimum, -reach), (np.maximum, reach)))
    i, k = _spread(north - south + 1)
    gy = south[i] + k
    qy = gy + 0.5 - p["ay"][i]
    # along a row the offset falls by dy, the arc grows by dx, a metre
    across = _between(-(dy / size)[i], (dx / size)[i] * qy, low[i], high[i])
    along = _between((dx / size)[i], (dy / size)[i] * qy, -past[i], (size + past)[i])
    first = np.maximum(west[i], np.floor(np.maximum(across[0], along[0]) + p["ax"][i] - 1.5)).astype(np.int64)
    last = np.minimum(east[i], np.ceil(np.minimum(across[1], along[1]) + p["ax"][i] + 0.5)).astype(np.int64)
    j, k = _spread(np.maximum(last - first + 1, 0))
    gx, gy, i = first[j] + k, gy[j], i[j]
    px, py = gx + 0.5, gy + 0.5
    ax, ay = p["ax"][i], p["ay"][i]
    dx, dy = dx[i], dy[i]
    if band:
        off = (dx * (py - ay) - dy * (px - ax)) / size[i] * p["side"][i]
        arc = (px - ax) * p["ux"][i] + (py - ay) * p["uy"][i]
        hit = (off >= p["inner"][i]) & (off < p["outer"][i]) & (arc >= 0) & (arc <= p["len"][i])
    else:
        t = np.maximum(0.0, np.minimum(1.0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy)))
        ex, ey = px - (ax + t * dx), py - (ay + t * dy)
        hit = np.sqrt(ex * ex + ey * ey) <= p["outer"][i]
    j, i, gx, gy = j[hit], i[hit], gx[hit], gy[hit]
    if not len(gx):
        return [tag[:0].astype(np.int64), gy, gx, gx.view(np.uint64)]
    new = np.ones(len(gx), bool)
    new[1:] = (j[1:] != j[:-1]) | (gx[1:] >> 6 != gx[:-1] >> 6)
    at = np.flatnonzero(new)
    return [tag[i[at]].astype(np.int64), gy[at], gx[at] >> 6, np.bitwise_or.reduceat(np.uint64(1) << (gx & 63).astype(np.uint64), at)]


def _joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The same words, each once."""
    tag, gy, word, mask = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((word, gy, tag))
    tag, gy, word, mask = tag[order], gy[order], word[order], mask[order]
    if not len(tag):
        return [tag, gy, word, mask.view(np.int64)]
    new = np.ones(len(tag), bool)
    new[1:] = (tag[1:] != tag[:-1]) | (gy[1:] != gy[:-1]) | (word[1:] != word[:-1])
    at = np.flatnonzero(new)
    return [tag[at], gy[at], word[at], np.bitwise_or.reduceat(mask, at).view(np.int64)]


def _masks(pieces: DataFrame, tag: Column, inner: Column, outer: Column, side: Column, band: bool) -> DataFrame:
    one = pieces.withColumns({"_tag": tag.cast("long"), "inner": inner.cast("double"), "outer": outer.cast("double"), "side": side.cast("double")})
    one = one.withColumn("ux", (F.col("bx") - F.col("ax")) / F.col("len")).withColumn("uy", (F.col("by") - F.col("ay")) / F.col("len"))
    place = [F.floor(F.col(c) / PLACE_M) for c in ("ax", "ay")]
    dealt = one.select("_tag", *FIELDS).repartition(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), *place, F.xxhash64("ax", "ay").bitwiseAND(F.lit(3).cast("long")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = {c: batch.column(c).to_numpy() for c in FIELDS}
            tags, wide = batch.column("_tag").to_numpy(), 2 * np.ceil(p["outer"]) + 4
            upto = np.cumsum((np.abs(p["bx"] - p["ax"]) + np.abs(p["by"] - p["ay"]) + wide) * wide) // CELLS
            cuts = [0, *(np.flatnonzero(upto[1:] != upto[:-1]) + 1), len(tags)]
            parts = [_words({c: v[a:b] for c, v in p.items()}, tags[a:b], band) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _joined(parts)], names=["tag", "gy", "word", "mask"])

    words = dealt.sortWithinPartitions(*place).mapInArrow(read, "tag long, gy long, word long, mask long")
    return words.groupBy("tag", "gy", "word").agg(F.bit_or("mask").alias("mask"))


def band_masks(pieces: DataFrame, tag: Column, inner: Column, outer: Column) -> DataFrame:
    """Cells whose centre lies from inner to outer metres off a piece (ax, ay, bx, by, len) on its `side` (1 left, -1 right),
    between its ends: tag, gy, word, mask. Tags are whole numbers."""
    return _masks(pieces, tag, inner, outer, F.col("side"), True)


def near_masks(pieces: DataFrame, tag: Column, reach: Column) -> DataFrame:
    """Cells whose centre lies at most `reach` metres from a piece: tag, gy, word, mask."""
    return _masks(pieces, tag, F.lit(0.0), reach, F.lit(1.0), False)
