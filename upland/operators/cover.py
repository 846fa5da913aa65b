"""Layered covers of whole-metre cells: each layer takes what earlier ones left, and rims are cut along edges.

Priority is a minimum per cell, combined before the one shuffle by cell. Rims need a cell's neighbours: cells are dealt to
tiles with the cells just beyond their edges, at most (TILE + 2)**2 of them, and a tile is read as a small raster.
`layered_masks` does the same on words of 64 cells, whose neighbours are the word shifted and the words beside it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upland.operators.rings import first_of

TILE = 256


def layered(layers: list[tuple[str, DataFrame]], holes: DataFrame | None = None, spared: tuple[str, ...] = (), rims: tuple[tuple[str, tuple[str, ...], tuple[str, ...] | None], ...] = ()) -> DataFrame:
    """(gx, gy, layer) of layers (name, cells) in order of priority. Layers named in `spared` stay out of the cells `holes`. A
    rim (name, of, along) takes the cells of the layers `of` that have one of the layers `along` beside them (4 neighbours),
    or, with None, anything but their own; earlier rims go first."""
    names = [n for n, _ in layers]
    rows = [c.select("gx", "gy", F.lit(i).alias("rank")) for i, (_, c) in enumerate(layers)]
    if holes is not None and spared:
        off = F.array(*[F.lit(names.index(n)) for n in spared])
        gaps = holes.select("gx", "gy").distinct().withColumn("_hole", F.lit(True))
        best = reduce(DataFrame.unionByName, rows).groupBy("gx", "gy").agg(
            F.min("rank").alias("_any"), F.min(F.when(~F.array_contains(off, F.col("rank")), F.col("rank"))).alias("_solid"))
        best = best.join(gaps, ["gx", "gy"], "left").select("gx", "gy", F.when(F.col("_hole"), F.col("_solid")).otherwise(F.col("_any")).alias("rank")).where("rank IS NOT NULL")
    else:
        best = reduce(DataFrame.unionByName, rows).groupBy("gx", "gy").agg(F.min("rank").alias("rank"))
    all_names = [*names, *[r[0] for r in rims]]
    plan = [(len(names) + i, [names.index(n) for n in of], None if along is None else [names.index(n) for n in along]) for i, (_, of, along) in enumerate(rims)]
    if plan:
        best = _rimmed(best, plan)
    return best.select("gx", "gy", F.element_at(F.array(*[F.lit(n) for n in all_names]), F.col("rank") + 1).alias("layer"))


def _rimmed(cells: DataFrame, plan: list[tuple[int, list[int], list[int] | None]]) -> DataFrame:
    gx, gy = F.col("gx"), F.col("gy")
    tile = lambda x, y, own: F.struct(F.floor(x / TILE).cast("long").alias("tx"), F.floor(y / TILE).cast("long").alias("ty"), F.lit(own).alias("own"))
    at = lambda c, i: F.pmod(c, F.lit(TILE)) == i
    homes = F.array(tile(gx, gy, True), F.when(at(gx, 0), tile(gx - 1, gy, False)), F.when(at(gx, TILE - 1), tile(gx + 1, gy, False)),
                    F.when(at(gy, 0), tile(gx, gy - 1, False)), F.when(at(gy, TILE - 1), tile(gx, gy + 1, False)))
    rows = cells.select("gx", "gy", "rank", F.explode(F.filter(homes, lambda h: h.isNotNull())).alias("t")).select("gx", "gy", "rank", "t.*")

    def rims_of(table: pa.Table) -> pa.Table:
        x, y, rank, own = (table[c].to_numpy() for c in ("gx", "gy", "rank", "own"))
        x0, y0 = x.min() - 1, y.min() - 1
        raster = np.full((int(x.max() - x0) + 2, int(y.max() - y0) + 2), -1, np.int32)
        raster[x - x0, y - y0] = rank
        i, j, out = x[own] - x0, y[own] - y0, rank[own].copy()
        beside = np.stack([raster[i + a, j + b] for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])
        for new, of, along in reversed(plan):
            mine = np.isin(rank[own], of)
            meets = (~np.isin(beside, of) if along is None else np.isin(beside, along)).any(axis=0)
            out[mine & meets] = new
        return pa.table({"gx": x[own], "gy": y[own], "rank": pa.array(out, pa.int32())})

    return rows.groupBy("tx", "ty").applyInArrow(rims_of, "gx long, gy long, rank int")


def layered_masks(layers: list[tuple[str, DataFrame]], holes: DataFrame | None = None, spared: tuple[str, ...] = (), rims: tuple[tuple[str, tuple[str, ...], tuple[str, ...] | None], ...] = ()) -> DataFrame:
    """`layered` of words: (gy, word, layer, mask) of layers (name, words gy, word, mask)."""
    none, names = F.lit(0).cast("long"), [n for n, _ in layers]
    tables = [*layers, *([("_hole", holes)] if holes is not None else [])]
    rows = reduce(DataFrame.unionByName, [m.select("gy", "word", F.lit(n).alias("_name"), "mask") for n, m in tables])
    d = rows.groupBy("gy", "word").agg(*[F.coalesce(F.bit_or(F.when(F.col("_name") == n, F.col("mask"))), none).alias(n) for n, _ in tables])
    hole = F.bitwise_not(F.col("_hole")) if holes is not None else F.lit(-1).cast("long")
    own = first_of([F.col(n).bitwiseAND(hole) if n in spared else F.col(n) for n in names])
    d = d.select("gy", "word", *[m.alias(n) for n, m in zip(names, own)])
    any_of = lambda group: reduce(lambda p, q: p.bitwiseOR(q), [F.col(n) for n in group])
    if rims:
        # every word tells the four beside it, and itself, what they see of it
        shift = lambda how, c, k: F.call_function(how, c, F.lit(k))
        seen = [any_of(of if along is None else along) for _, of, along in rims]
        blank = [F.lit(0).cast("long").alias(n) for n in names]

        def told(dy, dw, own, **of):
            what = [of[side](s).alias(f"_{side}{i}") if side in of else none.alias(f"_{side}{i}") for i, s in enumerate(seen) for side in "wens"]
            return F.struct((F.col("gy") + dy).alias("gy"), (F.col("word") + dw).alias("word"), *([F.col(n) for n in names] if own else blank), *what)

        same = lambda s: s
        words = F.array(told(0, 0, True, w=lambda s: shift("shiftleft", s, 1), e=lambda s: shift("shiftrightunsigned", s, 1)),
                        told(0, 1, False, w=lambda s: shift("shiftrightunsigned", s, 63)), told(0, -1, False, e=lambda s: shift("shiftleft", s, 63)),
                        told(1, 0, False, s=same), told(-1, 0, False, n=same))
        d = d.select(F.explode(words).alias("t")).select("t.*")
        beside = [f"_{side}{i}" for i in range(len(rims)) for side in "wens"]
        d = d.groupBy("gy", "word").agg(*[F.bit_or(c).alias(c) for c in (*names, *beside)])
        cut, left = [], F.lit(-1).cast("long")
        for i, (_, of, along) in enumerate(rims):
            four = [F.col(f"_{side}{i}") for side in "wens"]
            meets = F.bitwise_not(reduce(lambda p, q: p.bitwiseAND(q), four)) if along is None else reduce(lambda p, q: p.bitwiseOR(q), four)
            cut.append(any_of(of).bitwiseAND(meets).bitwiseAND(left))
            left = left.bitwiseAND(F.bitwise_not(cut[-1]))
        d = d.select("gy", "word", *[F.col(n).bitwiseAND(left).alias(n) for n in names], *[m.alias(r[0]) for r, m in zip(rims, cut)])
        names = [*names, *[r[0] for r in rims]]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), F.col(n).alias("mask")) for n in names]))
    return d.select("gy", "word", each.alias("_l")).select("gy", "word", "_l.*").where("mask <> 0")
