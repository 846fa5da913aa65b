"""Closed rings held as arrays of planar points: measures, tests and stitching."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upland.functions.geo import col, once
from upland.operators.cells import box_join

EDGE = "struct<ax:double,ay:double,bx:double,by:double>"


def edges(ring) -> Column:
    """Consecutive point pairs of a closed array<struct<x, y>>."""
    g = col(ring)
    n = F.greatest(F.size(g) - 1, F.lit(0))
    return F.zip_with(F.slice(g, F.lit(1), n), F.slice(g, F.lit(2), n), lambda a, b: F.struct(
        a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def all_edges(rings) -> Column:
    return F.flatten(F.transform(col(rings), edges))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def signed_area(ring) -> Column:
    """Shoelace area about the first point (keeps digits in large coordinates); positive counter-clockwise."""
    g = col(ring)
    x0, y0 = g[0]["x"], g[0]["y"]
    return _sum(F.transform(edges(g), lambda e: (e["ax"] - x0) * (e["by"] - y0) - (e["bx"] - x0) * (e["ay"] - y0))) / 2


def area(ring) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring) -> Column:
    return _sum(F.transform(edges(ring), lambda e: F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"])))


def centroid(ring) -> Column:
    """struct(x, y) of the area's centre."""
    g = col(ring)
    x0, y0 = g[0]["x"], g[0]["y"]
    a = signed_area(g)
    cross = lambda e: (e["ax"] - x0) * (e["by"] - y0) - (e["bx"] - x0) * (e["ay"] - y0)
    cx = _sum(F.transform(edges(g), lambda e: (e["ax"] + e["bx"] - 2 * x0) * cross(e))) / (6 * a)
    cy = _sum(F.transform(edges(g), lambda e: (e["ay"] + e["by"] - 2 * y0) * cross(e))) / (6 * a)
    return F.struct((x0 + cx).alias("x"), (y0 + cy).alias("y"))


def box(ring) -> list[Column]:
    xs, ys = F.transform(col(ring), lambda p: p["x"]), F.transform(col(ring), lambda p: p["y"])
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def contains(edge_list, x, y) -> Column:
    """Even-odd test over all edges of a polygon; holes are simply more edges."""
    px, py = col(x), col(y)
    odd = F.aggregate(col(edge_list), F.lit(False), lambda acc, e: acc != (
        ((e["ay"] > py) != (e["by"] > py)) & (px < (e["bx"] - e["ax"]) * (py - e["ay"]) / (e["by"] - e["ay"]) + e["ax"])))
    return F.coalesce(odd, F.lit(False))


def row_runs(edge_list, gy) -> Column:
    """Runs (lo, hi) of whole-metre cells of the row gy whose centre lies in the polygon: the even-odd test of `contains`
    read along the row, between the places where edges cross its middle."""
    py = gy + 0.5
    cut = F.filter(col(edge_list), lambda e: (e["ay"] > py) != (e["by"] > py))
    xs = F.array_sort(F.transform(cut, lambda e: F.ceil((e["bx"] - e["ax"]) * (py - e["ay"]) / (e["by"] - e["ay"]) + e["ax"] - 0.5).cast("long")))
    pairs = lambda xs: F.transform(F.filter(xs, lambda x, i: i % 2 == 0), lambda x, i: F.struct(x.alias("lo"), (F.get(xs, 2 * i + 1) - 1).alias("hi")))
    return F.filter(once(xs, pairs), lambda p: p["lo"] <= p["hi"])


def cell_masks(shapes: DataFrame, key: str | None = None) -> DataFrame:
    """Cells whose centre lies in a shape (edges, w, s, e, n) as words of 64 along each row: key, gy, word, mask (one bit a
    cell). Equal shapes are read once, and what many shapes cover is joined before cells are listed."""
    keys = [key] if key else []
    one = shapes.select(*keys, "edges", "s", "n").dropDuplicates([*keys, "edges"])
    rows = one.select(*keys, "edges", F.explode(F.sequence(F.floor("s").cast("long"), F.floor("n").cast("long"))).alias("gy"))
    runs = rows.select(*keys, "gy", F.explode(row_runs("edges", F.col("gy"))).alias("_r")).select(*keys, "gy", "_r.lo", "_r.hi")
    words = runs.withColumn("word", F.explode(F.sequence(F.floor(F.col("lo") / 64), F.floor(F.col("hi") / 64))))
    first, last = F.greatest(F.col("lo") - F.col("word") * 64, F.lit(0)), F.least(F.col("hi") - F.col("word") * 64, F.lit(63))
    full = F.lit(-1).cast("long")
    mask = F.call_function("shiftleft", full, first.cast("int")).bitwiseAND(F.call_function("shiftrightunsigned", full, (63 - last).cast("int")))
    return words.select(*keys, "gy", "word", mask.alias("mask")).groupBy(*keys, "gy", "word").agg(F.bit_or("mask").alias("mask"))


def mask_cells(masks: DataFrame) -> DataFrame:
    """The cells (gx, gy, and the other columns) whose bits are set in words of 64."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit("mask", k) == 1)
    rest = [c for c in masks.columns if c not in ("gy", "word", "mask")]
    return masks.where("mask <> 0").select("gy", "word", *rest, F.explode(bits).alias("_k")).select((F.col("word") * 64 + F.col("_k")).alias("gx"), "gy", *rest)


def first_of(masks: list[Column], free: Column | None = None) -> list[Column]:
    """Of words in order, the cells each has that no earlier one has (and that are in `free`)."""
    none = F.lit(0).cast("long")
    left, own = F.lit(-1).cast("long") if free is None else free, []
    for m in masks:
        m = F.coalesce(m, none)
        own.append(m.bitwiseAND(left))
        left = left.bitwiseAND(F.bitwise_not(m))
    return own


def distance_to(edge_list, x, y) -> Column:
    """Metres from a point to the nearest edge."""
    px, py = col(x), col(y)

    def one(e):
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        len2 = dx * dx + dy * dy
        t = F.when(len2 == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - e["ax"]) * dx + (py - e["ay"]) * dy) / len2)))
        return F.hypot(px - (e["ax"] + t * dx), py - (e["ay"] + t * dy))

    return F.array_min(F.transform(col(edge_list), one))


def _side(ax, ay, bx, by, px, py) -> Column:
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def edges_cross(e, f) -> Column:
    d1 = _side(e["ax"], e["ay"], e["bx"], e["by"], f["ax"], f["ay"])
    d2 = _side(e["ax"], e["ay"], e["bx"], e["by"], f["bx"], f["by"])
    d3 = _side(f["ax"], f["ay"], f["bx"], f["by"], e["ax"], e["ay"])
    d4 = _side(f["ax"], f["ay"], f["bx"], f["by"], e["bx"], e["by"])
    meet = (F.least(e["ax"], e["bx"]) <= F.greatest(f["ax"], f["bx"])) & (F.greatest(e["ax"], e["bx"]) >= F.least(f["ax"], f["bx"])) \
        & (F.least(e["ay"], e["by"]) <= F.greatest(f["ay"], f["by"])) & (F.greatest(e["ay"], e["by"]) >= F.least(f["ay"], f["by"]))
    return (d1 * d2 <= 0) & (d3 * d4 <= 0) & meet


def segment_gaps(pairs: DataFrame, key: list[str], edge_col: str, out: str) -> DataFrame:
    """Metres between outline and segment (ax, ay, bx, by) of each row, 0 where they cross: `key` and `out`. Batches are
    measured in numpy; the same formula as an expression is too long a method for the JVM to compile."""
    rows = pairs.select(*key, "ax", "ay", "bx", "by", edge_col).where(F.size(edge_col) > 0)
    schema = T.StructType([*rows.select(*key).schema.fields, T.StructField(out, T.DoubleType())])

    def gap(px, py, ax, ay, bx, by):
        dx, dy = bx - ax, by - ay
        len2 = dx * dx + dy * dy
        t = np.where(len2 == 0, 0.0, np.maximum(0.0, np.minimum(1.0, ((px - ax) * dx + (py - ay) * dy) / np.where(len2 == 0, 1.0, len2))))
        x, y = px - (ax + t * dx), py - (ay + t * dy)
        return np.sqrt(x * x + y * y)

    def side(ax, ay, bx, by, px, py):
        return np.sign((bx - ax) * (py - ay) - (by - ay) * (px - ax))

    def measured(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(batch.num_columns - 1)
            n = lists.value_lengths().to_numpy()
            e = [c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten()]
            f = [np.repeat(batch.column(len(key) + i).to_numpy(), n) for i in range(4)]
            best = np.minimum.reduce([gap(e[0], e[1], *f), gap(e[2], e[3], *f), gap(f[0], f[1], *e), gap(f[2], f[3], *e)])
            meet = (np.minimum(e[0], e[2]) <= np.maximum(f[0], f[2])) & (np.maximum(e[0], e[2]) >= np.minimum(f[0], f[2])) \
                & (np.minimum(e[1], e[3]) <= np.maximum(f[1], f[3])) & (np.maximum(e[1], e[3]) >= np.minimum(f[1], f[3]))
            cross = meet & (side(*e, f[0], f[1]) * side(*e, f[2], f[3]) <= 0) & (side(*f, e[0], e[1]) * side(*f, e[2], e[3]) <= 0)
            least = np.minimum.reduceat(np.where(cross, 0.0, best), np.cumsum(n) - n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(key)], pa.array(least)], schema=pa.schema([*[batch.schema.field(i) for i in range(len(key))], (out, pa.float64())]))

    return rows.mapInArrow(measured, schema)


def intersects(a_edges, b_edges) -> Column:
    """Two polygons touch: an edge of one meets an edge of the other, or one holds the other's first point."""
    a, b = col(a_edges), col(b_edges)
    return (F.exists(a, lambda e: F.exists(b, lambda f: edges_cross(e, f)))
            | contains(b, a[0]["ax"], a[0]["ay"]) | contains(a, b[0]["ax"], b[0]["ay"]))


def facing_edges(ring_edges, target_edges, *, dot: float = 0.45, tol: float = 8.0, shortest: float = 2.0) -> Column:
    """0-based edges of a counter-clockwise ring that face a line: outward normal toward it, and within tol metres of
    the nearest edge; edges under `shortest` metres never count."""
    def look(e, i, t):
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        size = F.hypot(dx, dy)
        mx, my = (e["ax"] + e["bx"]) / 2, (e["ay"] + e["by"]) / 2

        def foot(s):
            sx, sy = s["bx"] - s["ax"], s["by"] - s["ay"]
            len2 = sx * sx + sy * sy
            u = F.when(len2 == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((mx - s["ax"]) * sx + (my - s["ay"]) * sy) / len2)))
            away = once(u, lambda u: F.struct((s["ax"] + u * sx - mx).alias("vx"), (s["ay"] + u * sy - my).alias("vy")))
            return once(away, lambda v: F.struct(F.hypot(v["vx"], v["vy"]).alias("d"), v["vx"].alias("vx"), v["vy"].alias("vy")))

        def seen(best):
            toward = (dy * best["vx"] - dx * best["vy"]) / size / F.greatest(best["d"], F.lit(1e-9))
            return F.struct(i.alias("i"), best["d"].alias("d"), toward.alias("dot"), size.alias("size"))

        return once(F.array_min(F.transform(t, foot)), seen)

    def facing(seen):
        return once(F.array_min(F.transform(seen, lambda e: e["d"])), lambda closest: F.transform(
            F.filter(seen, lambda e: (e["dot"] > dot) & (e["d"] < closest + tol)), lambda e: e["i"]))

    seen = once(col(target_edges), lambda t: F.filter(F.transform(col(ring_edges), lambda e, i: look(e, i, t)), lambda e: e["size"] >= shortest))
    return once(seen, facing)


# -------------------------------------------------------------------- joins


def points_in_polygons(points: DataFrame, polygons: DataFrame, how: str = "inner", x: str = "x", y: str = "y",
                       edge_col: str = "edges", floor_level: int = 3) -> DataFrame:
    """Points joined to (or kept, or dropped by) the polygons that hold them. Polygons carry `edges` and their box
    as west, south, east, north. For semi and anti, copies of a polygon are dropped first."""
    if how != "inner":
        polygons = polygons.select(edge_col, "west", "south", "east", "north").dropDuplicates([edge_col])
    px, py = F.col(x), F.col(y)
    if how == "inner":
        met = _places_in_outlines(points.select(x, y).distinct(), polygons, x, y, edge_col, floor_level)
        return points.join(met.join(polygons, edge_col), [x, y]).select(*points.columns, *polygons.columns)
    return box_join(points, polygons, [px, py, px, py], [F.col(c) for c in ("west", "south", "east", "north")],
                    contains(edge_col, x, y), how, floor_level)


def _places_in_outlines(places: DataFrame, polygons: DataFrame, x: str, y: str, edge_col: str, floor_level: int = 3) -> DataFrame:
    """Columns of the places and the outlines (edge_col) that hold them; every different outline is looked at once."""
    px, py = F.col(x), F.col(y)
    outlines = polygons.select(edge_col, "west", "south", "east", "north").dropDuplicates([edge_col])
    return box_join(places, outlines, [px, py, px, py], [F.col(c) for c in ("west", "south", "east", "north")],
                    contains(edge_col, x, y), "inner", floor_level).select(*places.columns, edge_col)


def count_in_polygons(points: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y", edge_col: str = "edges") -> DataFrame:
    """The polygons that hold points, with their number n: points are counted per place and outline, no pair is listed."""
    met = _places_in_outlines(points.groupBy(x, y).agg(F.count("*").alias("n")), polygons, x, y, edge_col)
    return polygons.join(met.groupBy(edge_col).agg(F.sum("n").alias("n")), edge_col)


def drop_touching(shapes: DataFrame, rings: DataFrame, floor_level: int = 3, how: str = "left_anti") -> DataFrame:
    """Shapes (edges, w, s, e, n) that touch none of the rings (edges as redges, and west..north)."""
    rings = rings.select("redges", "west", "south", "east", "north").dropDuplicates(["redges"])
    return box_join(shapes, rings, [F.col(c) for c in "wsen"], [F.col(c) for c in ("west", "south", "east", "north")],
                    intersects("edges", "redges"), how, floor_level)


# --------------------------------------------------------------- stitching, hulls


def _stitch(parts: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Member ways joined end to end into closed rings; what never closes is dropped."""
    todo, out = [list(p) for p in parts if len(p) >= 2], []
    while todo:
        ring = todo.pop(0)
        while ring[0] != ring[-1]:
            for i, p in enumerate(todo):
                if p[0] == ring[-1] or p[-1] == ring[-1]:
                    ring += (p if p[0] == ring[-1] else p[::-1])[1:]
                    todo.pop(i)
                    break
            else:
                break
        if ring[0] == ring[-1] and len(ring) >= 4:
            out.append(ring)
    return out


RINGS_SCHEMA = "id string, outer array<array<struct<lon:double,lat:double>>>, inner array<array<struct<lon:double,lat:double>>>"


def stitch_relations(relations: DataFrame) -> DataFrame:
    """Relations (id string, members) to outer and inner rings; one row in, one row out."""

    def run(batches):
        for pdf in batches:
            rows = []
            for rid, members in zip(pdf["id"], pdf["members"]):
                by_role = {"outer": [], "inner": []}
                for m in members if members is not None else []:
                    role = m["role"] or "outer"
                    if m["type"] == "way" and role in by_role and m["geometry"] is not None and len(m["geometry"]) >= 2:
                        by_role[role].append([(p["lon"], p["lat"]) for p in m["geometry"]])
                rings = {r: [[{"lon": a, "lat": b} for a, b in ring] for ring in _stitch(parts)] for r, parts in by_role.items()}
                rows.append((rid, rings["outer"], rings["inner"]))
            yield pd.DataFrame(rows, columns=["id", "outer", "inner"])

    return relations.select("id", "members").mapInPandas(run, RINGS_SCHEMA)


def _hull(pts: np.ndarray) -> np.ndarray:
    """Counter-clockwise convex hull of points."""
    return np.array(_hull_of(np.asarray(pts).tolist()))


def _hull_of(pts: list) -> list:
    """Counter-clockwise convex hull of (x, y) pairs, from the least one on. Plain floats: most keys have few points."""
    pts = sorted(set(map(tuple, pts)))
    if len(pts) < 3:
        return pts

    def half(seq):
        out = []
        for p in seq:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return half(pts)[:-1] + half(pts[::-1])[:-1]


HULL_FEW = 64     # so many points of one key in a batch are sent on as they are


def convex_hulls(points: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Hull vertices (key, i, x, y) of each key's points. Of a key with many rows in an Arrow batch only their hull is sent
    on, salted, and each salted part is reduced again, so a key with most of the rows never meets one task whole; the
    points of a key with few are sent on untouched, to one task."""
    kt = points.schema[key].dataType.simpleString()
    small = points.select(key, F.col("x").cast("double"), F.col("y").cast("double"), F.lit(0).alias("_salt"))
    schema = f"{key} {kt}, x double, y double, _salt int"

    def reduced(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            which = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            many = np.flatnonzero(np.bincount(which) > HULL_FEW)
            if not len(many):
                yield batch
                continue
            keep = np.isin(which, many, invert=True)
            parts = [batch.filter(pa.array(keep))]
            xy = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2)])
            for k in many.tolist():
                rows = np.flatnonzero(which == k)
                h = np.array(_hull_of(xy[rows].tolist())).reshape(-1, 2)
                salt = pa.array(np.arange(len(h), dtype=np.int32) % salts)
                parts.append(pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(h), rows[0]))), pa.array(h[:, 0]), pa.array(h[:, 1]), salt], schema=batch.schema))
            yield from parts

    dealt = small.mapInArrow(reduced, schema).repartition(key, "_salt").sortWithinPartitions(key)
    few = dealt.mapInArrow(reduced, schema).groupBy(key).agg(F.collect_list("x").alias("_x"), F.collect_list("y").alias("_y"))
    point = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    @F.arrow_udf("array<struct<x:double,y:double>>")
    def final(xs: pa.Array, ys: pa.Array) -> pa.Array:
        hulls = [_hull_of(zip(x, y)) for x, y in zip(xs.to_pylist(), ys.to_pylist())]
        flat = np.array([p for h in hulls for p in h]).reshape(-1, 2)
        ends = np.cumsum([0, *map(len, hulls)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], fields=list(point.value_type)))

    return few.select(key, F.posexplode(final("_x", "_y")).alias("i", "_h")).select(key, "i", "_h.x", "_h.y")
