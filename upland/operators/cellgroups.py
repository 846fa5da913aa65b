"""Connected groups of whole-metre cells (4 neighbours), in two levels.

Cells are dealt to square tiles with the cells just beyond their edges, in one shuffle; a tile holds at most TILE**2 of
them. In a tile, runs of cells are joined into parts at once. Parts that touch across an edge are linked, and only those
links go to the graph step, whose rounds grow with the logarithm of the number of tiles a group crosses. No cell takes part
in more than two shuffles, however large its group. `connected_masks` does the same on words of 64 cells (`rings.cell_masks`)
and gives words back, so that a plane full of cells is a few million rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upland.operators.graph import components
from upland.operators.rings import mask_cells
from upland.session import written

TILE = 256
WORDS = 4                      # words of 64 cells a tile of `connected_masks` is wide
BIAS = 1 << 30                 # cells lie within 2**30 metres of the origin
OWN, BEYOND, MARKED = 0, 1, 2


def cell_key(gx: Column, gy: Column) -> Column:
    """One whole number for a cell, ordered by gx, then gy."""
    return (gx + BIAS) * F.lit(2 * BIAS) + gy + BIAS


def label_text(key: Column) -> Column:
    """A cell number as text that sorts alike."""
    part = lambda c: F.lpad((c - BIAS + 10**9).cast("string"), 12, "0")
    return F.concat_ws(",", part(F.shiftright(key, 31)), part(key.bitwiseAND(F.lit(2 * BIAS - 1))))


def join_runs(gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    """For different cells ordered by (gx, gy): the row of the first cell of each cell's connected part."""
    n = len(gx)
    new = np.ones(n, bool)
    new[1:] = (gx[1:] != gx[:-1]) | (gy[1:] != gy[:-1] + 1)
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    # runs of neighbouring columns that share a row: each cell with the cell beside it
    key, beside = gx * (4 * TILE) + gy, (gx + 1) * (4 * TILE) + gy
    at = np.minimum(np.searchsorted(key, beside), n - 1)
    hit = key[at] == beside
    links = np.unique(np.stack([run[hit], run[at[hit]]], 1), axis=0)
    root = np.arange(len(first))
    while len(links):
        a, b = root[links[:, 0]], root[links[:, 1]]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        links = links[root[links[:, 0]] != root[links[:, 1]]]
    return first[root[run]]


def _tile(table: pa.Table) -> pa.Table:
    columns = _parts(*(table[c].to_numpy() for c in ("gx", "gy", "role")))
    return pa.table([pa.array(c) for c in columns], names=["gx", "gy", "part", "sides", "marked"])


def _parts(gx: np.ndarray, gy: np.ndarray, role: np.ndarray) -> list[np.ndarray]:
    """A tile's own cells with their part, neighbours and mark."""
    wide, tall = gx.min() - 1, gy.min() - 1
    key = (gx - wide) * (4 * TILE) + (gy - tall)
    own = np.unique(key[role == OWN])
    x, y = own // (4 * TILE), own % (4 * TILE)
    part = join_runs(x, y) if len(own) else own
    taken = np.unique(np.concatenate([own, key[role == BEYOND]]))
    sides = sum(np.isin(own + step, taken, assume_unique=True).astype(np.int32) for step in (1, -1, 4 * TILE, -4 * TILE)) if len(own) else own.astype(np.int32)
    number = lambda i: (x[i] + wide + BIAS) * (2 * BIAS) + y[i] + tall + BIAS
    return [x + wide, y + tall, number(part), sides, np.isin(own, key[role == MARKED])]


def _tile_words(table: pa.Table) -> pa.Table:
    """The same of words: a tile's cells by part, as words with the number of neighbours their cells have together."""
    word, row, mask, role = (table[c].to_numpy() for c in ("word", "gy", "mask", "role"))
    at, bit = np.nonzero((mask.view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))
    x, y, part, sides, marked = _parts(word[at] * 64 + bit, row[at], role[at])
    if not len(x):
        return pa.table([pa.array([], pa.int64())] * 6, names=["gy", "word", "part", "mask", "sides", "marked"])
    order = np.lexsort((x, y, part))
    x, y, part, sides, marked = (c[order] for c in (x, y, part, sides, marked))
    new = np.ones(len(x), bool)
    new[1:] = (part[1:] != part[:-1]) | (y[1:] != y[:-1]) | (x[1:] >> 6 != x[:-1] >> 6)
    first = np.flatnonzero(new)
    bits = np.uint64(1) << (x & 63).astype(np.uint64)
    join = lambda b: np.bitwise_or.reduceat(b, first).view(np.int64)
    columns = [y[first], x[first] >> 6, part[first], join(bits), np.add.reduceat(sides.astype(np.int64), first), join(np.where(marked, bits, np.uint64(0)))]
    return pa.table([pa.array(c) for c in columns], names=["gy", "word", "part", "mask", "sides", "marked"])


def tile_parts(cells: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Different cells (gx, gy) with the part of their tile they belong to (its least cell's number), how many of their four
    neighbours are cells, and whether they are among the different cells `marks`."""
    tile = lambda x, y, role: F.struct(F.floor(x / TILE).cast("long").alias("tx"), F.floor(y / TILE).cast("long").alias("ty"), F.lit(role).alias("role"))
    gx, gy = F.col("gx"), F.col("gy")
    at = lambda c, i: F.pmod(c, F.lit(TILE)) == i
    beyond = [F.when(at(gx, 0), tile(gx - 1, gy, BEYOND)), F.when(at(gx, TILE - 1), tile(gx + 1, gy, BEYOND)),
              F.when(at(gy, 0), tile(gx, gy - 1, BEYOND)), F.when(at(gy, TILE - 1), tile(gx, gy + 1, BEYOND))]
    rows = cells.select("gx", "gy", F.explode(F.filter(F.array(tile(gx, gy, OWN), *beyond), lambda t: t.isNotNull())).alias("t"))
    if marks is not None:
        rows = rows.unionByName(marks.select("gx", "gy", tile(gx, gy, MARKED).alias("t")))
    return rows.select("gx", "gy", "t.*").groupBy("tx", "ty").applyInArrow(_tile, "gx long, gy long, part long, sides int, marked boolean")


def connected_cells(cells: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Different cells (gx, gy) by connected group: label (the group's least cell), sides (neighbours in the group) and
    marked (also in `marks`)."""
    parts = written(tile_parts(cells, marks))
    at = lambda c: F.pmod(F.col(c), F.lit(TILE))
    border = parts.where((parts["sides"] > 0) & ((at("gx") == 0) | (at("gy") == 0) | (at("gx") == TILE - 1) | (at("gy") == TILE - 1))).select("gx", "gy", "part")
    out = parts.join(_across(border, TILE, TILE), "part", "left")
    return out.select("gx", "gy", label_text(F.coalesce("root", "part")).alias("label"), "sides", "marked")


def _across(border: DataFrame, wide: int, tall: int) -> DataFrame:
    """(part, root) of parts that touch others across the edges of tiles, from the cells (gx, gy, part) along these edges."""
    last = {"gx": F.pmod("gx", F.lit(wide)) == wide - 1, "gy": F.pmod("gy", F.lit(tall)) == tall - 1}
    one = lambda c: border.where(last[c]).select(*[(F.col(k) + int(k == c)).alias(k) for k in ("gx", "gy")], F.col("part").alias("a"))
    links = one("gx").unionByName(one("gy")).join(border.withColumnRenamed("part", "b"), ["gx", "gy"]).select("a", "b").distinct()
    return components(links).withColumnRenamed("id", "part")


def connected_masks(masks: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Words (gy, word, mask), one row each, by connected group: root (number of the group's least cell, `label_text` makes
    its label), gy, word, mask, sides (neighbours its cells have in the group, together) and marked (the cells that `marks`,
    words too, also have). Written to the shared folder."""
    tile = lambda word, gy, mask, role: F.struct(F.floor(word / WORDS).cast("long").alias("tx"), F.floor(gy / TILE).cast("long").alias("ty"), mask.alias("mask"), F.lit(role).alias("role"))
    word, gy, mask = F.col("word"), F.col("gy"), F.col("mask")
    none, left, right = F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(-2**63).cast("long")
    west, east, south, north = F.pmod(word, F.lit(WORDS)) == 0, F.pmod(word, F.lit(WORDS)) == WORDS - 1, F.pmod(gy, F.lit(TILE)) == 0, F.pmod(gy, F.lit(TILE)) == TILE - 1
    beyond = [F.when(west, tile(word - 1, gy, mask.bitwiseAND(left), BEYOND)), F.when(east, tile(word + 1, gy, mask.bitwiseAND(right), BEYOND)),
              F.when(south, tile(word, gy - 1, mask, BEYOND)), F.when(north, tile(word, gy + 1, mask, BEYOND))]
    rows = masks.where(mask != 0).select("word", "gy", F.explode(F.filter(F.array(tile(word, gy, mask, OWN), *beyond), lambda t: t.isNotNull() & (t["mask"] != 0))).alias("t"))
    if marks is not None:
        rows = rows.unionByName(marks.where("mask <> 0").select("word", "gy", tile(word, gy, mask, MARKED).alias("t")))
    parts = written(rows.select("word", "gy", "t.*").groupBy("tx", "ty").applyInArrow(_tile_words, "gy long, word long, part long, mask long, sides long, marked long"))
    edge = F.when(south | north, mask).otherwise(mask.bitwiseAND(F.when(west, left).otherwise(none).bitwiseOR(F.when(east, right).otherwise(none))))
    border = mask_cells(parts.where(west | east | south | north).select("gy", "word", "part", edge.alias("mask")))
    return written(parts.join(_across(border, 64 * WORDS, TILE), "part", "left").select(F.coalesce("root", "part").alias("root"), "gy", "word", "mask", "sides", "marked"))
