"""Lines held as one array of points per row.

A line is a row, so measures of one line are array expressions and need no shuffle; `segments` is the
exploded form that joins use.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upland.functions.geo import (bearing_deg, bearing_diff, col, haversine_m, segment_distance, segment_param,
                                  signed_offset)
from upland.operators import tracks
from upland.operators.cells import nearest
from upland.operators.tracks import running
from upland.session import written

STEP_BACK = 5  # vertices a local bearing looks ahead
SHORT_LINE = 256  # vertices of a line that is looked through within its row


# ----------------------------------------------------- measures of a lng/lat line


def legs_m(line) -> Column:
    """Great-circle metres of each leg of an array<struct<lng, lat>>."""
    g = col(line)
    n = F.size(g)
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(F.zip_with(
        F.slice(g, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(g, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: haversine_m(a["lng"], a["lat"], b["lng"], b["lat"])))


def total(values) -> Column:
    return F.aggregate(col(values), F.lit(0.0), lambda acc, x: acc + x)


def length_m(line) -> Column:
    return total(legs_m(line))


def arc_m(line) -> Column:
    """Cumulative metres at each vertex, starting at 0."""
    return running(legs_m(line))


def extent(line) -> Column:
    g = col(line)
    lngs, lats = F.transform(g, lambda p: p["lng"]), F.transform(g, lambda p: p["lat"])
    return F.struct(F.array_min(lngs).alias("west"), F.array_min(lats).alias("south"),
                    F.array_max(lngs).alias("east"), F.array_max(lats).alias("north"))


def bearing_at(line, i) -> Column:
    """Direction of travel at vertex i (0-based): to the vertex five ahead, or from five back at the end."""
    g, i = col(line), col(i)
    last = F.size(g) - 1
    j = F.least(last, i + STEP_BACK)
    back = F.greatest(F.lit(0), i - STEP_BACK)
    a, b = F.when(j == i, back).otherwise(i), j
    pa, pb = F.get(g, a), F.get(g, b)
    return bearing_deg(pa["lng"], pa["lat"], pb["lng"], pb["lat"])


def forward_indices(line, stops) -> Column:
    """For each stop in order, the vertex nearest to it at or after the previous stop's vertex."""
    g = col(line)

    def step(acc, s):
        ahead = F.transform(F.sequence(acc["at"], F.size(g) - 1), lambda i: F.struct(
            haversine_m(F.get(g, i)["lng"], F.get(g, i)["lat"], s["lng"], s["lat"]).alias("d"), i.alias("i")))
        best = F.array_min(ahead)["i"]
        return F.struct(best.alias("at"), F.concat(acc["found"], F.array(best)).alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    return F.aggregate(col(stops), start, step, lambda acc: acc["found"])


def strictly_rising(values) -> Column:
    v = col(values)
    n = F.size(v)
    return F.when(n < 2, F.lit(True)).otherwise(F.forall(
        F.zip_with(F.slice(v, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(v, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a < b), lambda x: x))


# ------------------------------------------------------------------ simplification


def _douglas_peucker(x: np.ndarray, y: np.ndarray, tol: float) -> list[int]:
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    stack = [(0, len(x) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        px, py = x[a + 1:b], y[a + 1:b]
        dx, dy = x[b] - x[a], y[b] - y[a]
        len2 = dx * dx + dy * dy
        t = np.clip(((px - x[a]) * dx + (py - y[a]) * dy) / len2, 0, 1) if len2 else np.zeros(len(px))
        d = np.hypot(px - (x[a] + t * dx), py - (y[a] + t * dy))
        far = int(np.argmax(d))
        if d[far] > tol:
            m = a + 1 + far
            keep[m] = True
            stack += [(a, m), (m, b)]
    return np.flatnonzero(keep).tolist()


def simplify(line, tolerance: float) -> Column:
    """Douglas-Peucker in degrees; null when the line collapses to one place."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def kept(lngs: pd.Series, lats: pd.Series) -> pd.Series:
        return pd.Series([_douglas_peucker(np.asarray(a, float), np.asarray(b, float), tolerance) if a is not None and len(a) > 1 else None
                          for a, b in zip(lngs, lats)])

    g = col(line)
    idx = kept(F.transform(g, lambda p: p["lng"]), F.transform(g, lambda p: p["lat"]))
    out = F.transform(idx, lambda i: F.get(g, i))
    return F.when((F.size(out) < 2) | ((F.size(out) == 2) & (out[0] == out[1])), F.lit(None)).otherwise(out)


# ------------------------------------------------------- exploded planar segments


def segments(df: DataFrame, line_id: str, line: str = "line") -> DataFrame:
    """One row per leg of an array<struct<x, y>>: seg, ax, ay, bx, by, len, start (arc at a). Other columns stay."""
    g = F.col(line)
    n = F.size(g)
    ends = lambda first: F.slice(g, F.lit(first), F.greatest(n - 1, F.lit(0)))
    lens = F.zip_with(ends(1), ends(2), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    fields = F.arrays_zip(ends(1).alias("a"), ends(2).alias("b"), F.col("_lens").alias("len"), F.slice("_sums", F.lit(1), F.greatest(n - 1, F.lit(0))).alias("start"))
    with_start = F.transform(fields, lambda s: F.struct(s["a"]["x"].alias("ax"), s["a"]["y"].alias("ay"), s["b"]["x"].alias("bx"), s["b"]["y"].alias("by"), s["len"].alias("len"), s["start"].alias("start")))
    rest = [c for c in df.columns if c != line]
    summed = df.where(n >= 2).withColumn("_lens", lens).withColumn("_sums", running(F.col("_lens")))
    return summed.select(*rest, F.posexplode(with_start).alias("seg", "_s")).select(*rest, "seg", "_s.*")


def alike_lines(segs: DataFrame, line_id: str) -> DataFrame:
    """(line_id, _same, _alike) of lines by their segments: the least id of the lines of the same course, and their number.
    Written to the shared folder."""
    course = segs.groupBy(line_id).agg(F.sort_array(F.collect_list(F.struct("seg", "ax", "ay", "bx", "by"))).alias("_course"))
    w = Window.partitionBy("_course")
    return written(course.select(line_id, F.min(line_id).over(w).alias("_same"), F.count("*").over(w).alias("_alike")))


def points_along(segs: DataFrame, every, offset: float = 0.0, steps: str | None = None) -> DataFrame:
    """Points at arc offset, offset + every, ... of each line, from its segments: step (0-based), t, x, y, ux, uy.
    Each segment makes its own points, so no join to positions is needed. `every` is metres or a column of the
    line's own spacing; `steps` names a column with the number of points a line may have."""
    every = col(every)
    first = F.ceil((F.col("start") - offset) / every)
    first = F.greatest(first, F.lit(0))
    last = F.ceil((F.col("start") + F.col("len") - offset) / every) - 1
    if steps is not None:
        last = F.least(last, F.col(steps) - 1)
    out = segs.where((F.col("len") > 0) & (last >= first)).withColumn("step", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    t = F.col("step") * every + F.lit(offset)
    share = (t - F.col("start")) / F.col("len")
    return out.select("*", t.alias("t"), (F.col("ax") + share * (F.col("bx") - F.col("ax"))).alias("x"),
                      (F.col("ay") + share * (F.col("by") - F.col("ay"))).alias("y"),
                      ((F.col("bx") - F.col("ax")) / F.col("len")).alias("ux"), ((F.col("by") - F.col("ay")) / F.col("len")).alias("uy"))


def pieces(segs: DataFrame, longest: float) -> DataFrame:
    """Segments cut into equal parts of at most `longest` metres, for the cell search; the whole segment stays on the
    row, so distances are those of the whole."""
    n = F.greatest(F.ceil(F.col("len") / longest), F.lit(1)).cast("int")
    out = segs.withColumn("_n", n).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    mid = (F.col("piece") + 0.5) / F.col("_n")
    return out.select("*", (F.col("ax") + mid * (F.col("bx") - F.col("ax"))).alias("mx"),
                      (F.col("ay") + mid * (F.col("by") - F.col("ay"))).alias("my")).drop("_n")


def nearest_line(points: DataFrame, segs: DataFrame, *, point_id: str, line_id: str, k: int = 1, max_m: float | None = None,
                 longest: float = 64.0) -> DataFrame:
    """The k nearest lines' segments of each point (x, y): dist, along (arc of the foot), offset (left +), ux, uy.

    k counts lines: a line is represented by its nearest segment. With k = 1 that is one search; for more, candidate
    rows are the nearest segments of all lines within max_m."""
    if k == 1:
        items = pieces(segs, longest)
        found = nearest(
            points, items, 1, origin_id=point_id, origin_at=lambda: [F.col("x"), F.col("y")],
            item_at=lambda: [F.col("mx"), F.col("my")], distance=segment_distance("x", "y", "ax", "ay", "bx", "by"),
            tie=[line_id, "seg", "piece"], same_site=["ax", "ay", "bx", "by", "piece"], max_m=max_m, slack_m=longest / 2, origin_site=["x", "y"])
        found = found.drop("piece", "mx", "my", "rank")
    else:
        if max_m is None:
            raise ValueError("k > 1 needs max_m")
        # once per place; of lines that share a segment only the first k can be among a place's k by it
        first = F.dense_rank().over(Window.partitionBy("ax", "ay", "bx", "by").orderBy(line_id))
        found = lines_within(points.select("x", "y").distinct(), segs.withColumn("_c", first).where(F.col("_c") <= k).drop("_c"), max_m)
        by = Window.partitionBy("x", "y", line_id).orderBy(F.floor(F.col("dist") * 1000 + 0.5), "seg")
        found = found.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")
        by = Window.partitionBy("x", "y").orderBy(F.floor(F.col("dist") * 1000 + 0.5), line_id)
        found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        found = points.join(found, ["x", "y"]).select(*points.columns, *[c for c in found.columns if c not in ("x", "y")])
    share = segment_param("x", "y", "ax", "ay", "bx", "by")
    return found.select("*", (F.col("start") + share * F.col("len")).alias("along"), share.alias("share"),
                        signed_offset("x", "y", "ax", "ay", "bx", "by").alias("offset"),
                        ((F.col("bx") - F.col("ax")) / F.col("len")).alias("ux"), ((F.col("by") - F.col("ay")) / F.col("len")).alias("uy"))


def lines_within(points: DataFrame, segs: DataFrame, max_m: float) -> DataFrame:
    """Every (point, segment) at most max_m apart, with dist."""
    from upland.operators.cells import box_join
    x, y = F.col("x"), F.col("y")
    seg_box = [F.least("ax", "bx") - max_m, F.least("ay", "by") - max_m, F.greatest("ax", "bx") + max_m, F.greatest("ay", "by") + max_m]
    d = segment_distance("x", "y", "ax", "ay", "bx", "by")
    return box_join(points, segs, [x, y, x, y], seg_box, d <= F.lit(max_m)).withColumn("dist", d)


def line_gaps(points: DataFrame, lines: DataFrame, line_id: str, max_m: float, line: str = "line") -> DataFrame:
    """Every (point, line) at most max_m apart, with dist. Lines of the same vertices are measured once, and so are points
    on one place (x, y); only the result lists them all."""
    every = written(lines.select(line_id, line).withColumn("_same", F.min(line_id).over(Window.partitionBy(line))))
    segs = segments(every.where(F.col(line_id) == F.col("_same")).select("_same", line), "_same", line)
    near = lines_within(points.select("x", "y").distinct(), segs, max_m).groupBy("x", "y", "_same").agg(F.min("dist").alias("dist"))
    return points.join(near.join(every.select(line_id, "_same"), "_same").drop("_same"), ["x", "y"])


# ---------------------------------------------------------------- route checks


def backtracks(routes: DataFrame, code: str = "code", line: str = "line", stop_idx: str = "stop_idx", *, close_m: float = 10.0,
               gap_m: float = 150.0, share: float = 0.9, turn: float = 120.0) -> DataFrame:
    """Stretches where a line comes back within close_m of an earlier vertex, more than gap_m of path later, heading
    the other way, with no stop strictly between: one row per merged episode (code, i, j, path_gap_m)."""
    lines = routes.select(code, F.explode(F.array(F.struct(F.col(stop_idx).alias("_stops"), arc_m(line).alias("_arc"), F.col(line).alias("_g")))).alias("_l")).select(code, "_l.*")
    # what a vertex needs of its line is worked out in arrays, once a line (explode keeps it from being worked out again)
    each = F.transform("_g", lambda p, i: F.struct(i.alias("i"), p["lng"].alias("lng"), p["lat"].alias("lat"), F.get("_arc", i).alias("arc"), bearing_at("_g", i).alias("heading"),
                       # stops at or before a vertex: two vertices hold no stop strictly between them when the counts agree
                       F.size(F.filter("_stops", lambda s: s <= i)).alias("upto"), F.size(F.filter("_stops", lambda s: s < i)).alias("before")))
    top = F.array_max(F.transform("_g", lambda p: F.abs(p["lat"])))
    lines = lines.select(code, F.element_at("_arc", -1).alias("_total"), top.alias("_top"), F.explode(F.array(each)).alias("_v"))

    def back(p, q, total):
        """The line is at q again where it was at p."""
        gap = q["arc"] - p["arc"]
        return (q["i"] > p["i"]) & (gap > gap_m) & (gap <= total * share) & (p["upto"] == q["before"]) \
            & (haversine_m(p["lng"], p["lat"], q["lng"], q["lat"]) <= close_m) & (bearing_diff(p["heading"], q["heading"]) > turn)

    # a short line is looked through within its row, the vertices of a long one are joined by cells
    first = lambda p: F.get(F.filter("_v", lambda q: back(p, q, F.col("_total"))), F.lit(0))
    hits = F.transform("_v", lambda p: F.struct(p["i"].alias("i"), p["arc"].alias("arc"), first(p).alias("q")))
    short = lines.where(F.size("_v") <= SHORT_LINE).select(code, F.explode(hits).alias("_h")).where("_h.q is not null")
    short = short.select(code, "_h.i", F.col("_h.q.i").alias("j"), (F.col("_h.q.arc") - F.col("_h.arc")).alias("gap"))
    v = lines.where(F.size("_v") > SHORT_LINE).select(code, "_total", "_top", F.explode("_v").alias("_p"))
    # cells a little wider than close_m at the route's own highest latitude, so a pair is at most one cell apart
    side = close_m * 1.01 / 111_190.0
    cy, cx = F.floor(F.col("_p.lat") / side).cast("long"), F.floor(F.col("_p.lng") * F.cos(F.radians("_top")) / side).cast("long")
    v = v.select(code, "_total", "_p", cx.alias("_cx"), cy.alias("_cy"))
    near = F.array(*[F.struct((F.col("_cx") + dx).alias("_rx"), (F.col("_cy") + dy).alias("_ry")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    a = v.select(code, "_total", "_p", F.explode(near).alias("_r")).select(code, "_total", "_p", "_r.*")
    b = v.select(F.col(code).alias("_code"), F.col("_p").alias("_q"), "_cx", "_cy")
    pairs = a.join(b, (F.col(code) == F.col("_code")) & (F.col("_rx") == F.col("_cx")) & (F.col("_ry") == F.col("_cy")) & back(F.col("_p"), F.col("_q"), F.col("_total")))
    long = pairs.groupBy(code, F.col("_p.i").alias("i")).agg(F.min(F.struct(F.col("_q.i").alias("j"), (F.col("_q.arc") - F.col("_p.arc")).alias("gap"))).alias("m")).select(code, "i", "m.j", "m.gap")
    firsts = short.unionByName(long)
    w = Window.partitionBy(code).orderBy("i")
    reach = F.max("j").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = firsts.withColumn("_new", F.when(F.col("i") <= reach, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(code, "_run").agg(F.min("i").alias("i"), F.max("j").alias("j"), F.max("gap").alias("path_gap_m")).drop("_run")


def stop_uturns(routes: DataFrame, **limits: float) -> DataFrame:
    """Stops (not the first or last) whose approach and departure run on top of each other (`tracks.stop_uturns`): code,
    stop, at (vertex), spur_m. Routes carry code, line, stop_idx."""
    n = F.size("stop_idx")
    stops = routes.select("code", n.alias("_n"), F.posexplode("stop_idx").alias("stop", "at")).where("stop >= 1 AND stop <= _n - 2").drop("_n")
    return tracks.stop_uturns(written(tracks.arcs(tracks.of_lines(routes))), stops, **limits)


def project_on_line(lng, lat, line) -> Column:
    """Nearest place on a lng/lat line in a local equirectangular frame at the point: struct(dist_m, lng, lat)."""
    lng, lat, g = col(lng), col(lat), col(line)
    ky = F.lit(np.pi / 180 * 6371000.0)
    kx = F.cos(F.radians(lat)) * ky
    n = F.size(g)

    def foot(a, b):
        ax, ay, bx, by = (a["lng"] - lng) * kx, (a["lat"] - lat) * ky, (b["lng"] - lng) * kx, (b["lat"] - lat) * ky
        t = segment_param(F.lit(0.0), F.lit(0.0), ax, ay, bx, by)
        x, y = ax + t * (bx - ax), ay + t * (by - ay)
        return F.struct(F.hypot(x, y).alias("dist_m"), (lng + x / kx).alias("lng"), (lat + y / ky).alias("lat"))

    return F.array_min(F.zip_with(F.slice(g, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(g, F.lit(2), F.greatest(n - 1, F.lit(0))), foot))
