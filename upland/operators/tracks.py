"""Lines as vertex tables, for lines of any length: one row a vertex, (line, i, lng, lat), i rising by one.

Sums along a line are prefix scans of two levels. Vertices are dealt to blocks of BLOCK in a row, each with the last one of
the block before; a block is summed in one task, and a line's block totals, one row a block, are added up on their own. So
the work is linear in the vertices, and a line that holds a third of all of them spreads over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upland.functions.geo import bearing_deg, haversine_m, once

BLOCK = 4096
BIN_M = 64.0                   # metres of arc that are looked up together


def blocked(vertices: DataFrame, before: int = 1, after: int = 0, i: str = "i") -> DataFrame:
    """Vertices with their block `_b`; the last `before` and first `after` of a block stand in its neighbours too, marked
    `_guest`."""
    if max(before, after) > BLOCK:
        raise ValueError(f"a block of {BLOCK} vertices is too short for {max(before, after)} beside it")
    at, b = F.pmod(F.col(i), F.lit(BLOCK)), F.floor(F.col(i) / BLOCK).cast("long")
    homes = F.array(F.struct(b.alias("_b"), F.lit(False).alias("_guest")), F.when(at >= BLOCK - before, F.struct((b + 1).alias("_b"), F.lit(True).alias("_guest"))),
                    F.when(at < after, F.struct((b - 1).alias("_b"), F.lit(True).alias("_guest"))))
    return vertices.select("*", F.explode(F.filter(homes, lambda h: h.isNotNull())).alias("_h")).select("*", "_h.*").drop("_h")


def running_totals(blocks: DataFrame, line: str, value: str, out: str, i: str = "i") -> DataFrame:
    """Own rows of a blocked table with `out`, the sum of `value` up to and with the row."""
    own = blocks.where("NOT _guest")
    inside = own.withColumn("_in", F.sum(value).over(Window.partitionBy(line, "_b").orderBy(i).rowsBetween(Window.unboundedPreceding, 0)))
    totals = own.groupBy(line, "_b").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(line).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    joined = inside.join(totals.select(line, "_b", before.alias("_before")), [line, "_b"])
    return joined.withColumn(out, F.col("_before") + F.col("_in")).drop("_b", "_guest", "_in", "_before")


def arcs(vertices: DataFrame, line: str = "code", i: str = "i") -> DataFrame:
    """Vertices with `leg`, the metres from the one before (0 at the start), and `arc`, the metres from the start."""
    near = Window.partitionBy(line, "_b").orderBy(i)
    v = blocked(vertices, i=i).withColumn("_x", F.lag("lng").over(near)).withColumn("_y", F.lag("lat").over(near))
    leg = F.when(F.col("_x").isNotNull(), haversine_m("_x", "_y", "lng", "lat")).otherwise(0.0)
    return running_totals(v.withColumn("leg", leg).drop("_x", "_y"), line, "leg", "arc", i)


def headings(vertices: DataFrame, ahead: int = 5, line: str = "code", i: str = "i") -> DataFrame:
    """Vertices with `heading`, the direction to the vertex `ahead` on, the last one where fewer are left; at the end, from
    as many back. A line of one vertex has none."""
    near = Window.partitionBy(line, "_b").orderBy(i)
    seen = lambda c: [F.last(c).over(near.rowsBetween(0, ahead)), F.first(c).over(near.rowsBetween(-ahead, 0))]
    v = blocked(vertices, ahead, ahead, i)
    (lng_on, lng_back), (lat_on, lat_back), (i_on, i_back) = seen("lng"), seen("lat"), seen(i)
    v = v.select("*", lng_on.alias("_xo"), lat_on.alias("_yo"), i_on.alias("_io"), lng_back.alias("_xb"), lat_back.alias("_yb"), i_back.alias("_ib")).where("NOT _guest")
    on = F.col("_io") > F.col(i)
    heading = F.when(on, bearing_deg(F.col("lng"), F.col("lat"), F.col("_xo"), F.col("_yo"))).when(F.col("_ib") < F.col(i), bearing_deg(F.col("_xb"), F.col("_yb"), F.col("lng"), F.col("lat")))
    return v.withColumn("heading", heading).drop("_b", "_guest", "_xo", "_yo", "_io", "_xb", "_yb", "_ib")


def nearest_by_arc(asked: DataFrame, track: DataFrame, t: str, out: str, line: str = "code", i: str = "i") -> DataFrame:
    """Rows (line, t, ...) with `out`, a struct (lng, lat) of the vertex whose arc is nearest to t, of two alike the
    earlier. Each vertex answers for the arc up to half way to its neighbours; arcs meet in bins of BIN_M metres."""
    near = Window.partitionBy(line, "_b").orderBy(i)
    v = blocked(track, 1, 1, i)
    low, high = (F.lag("arc").over(near) + F.col("arc")) / 2, (F.lead("arc").over(near) + F.col("arc")) / 2
    v = v.select("*", F.coalesce(low, F.lit(-1.0)).alias("_low"), high.alias("_high")).where("NOT _guest")
    top = F.coalesce("_high", F.col("arc") + BIN_M)
    bins = F.sequence(F.floor(F.col("_low") / BIN_M), F.floor(top / BIN_M))
    v = v.where((F.col("_low") < F.col("_high")) | F.col("_high").isNull()).select(F.col(line).alias("_line"), F.explode(bins).alias("_bin"), "_low", "_high", F.struct("lng", "lat").alias(out))
    a = asked.withColumn("_bin", F.floor(F.col(t) / BIN_M))
    on = (F.col(line) == F.col("_line")) & (a["_bin"] == v["_bin"]) & (F.col(t) > F.col("_low")) & (F.col("_high").isNull() | (F.col(t) <= F.col("_high")))
    return a.join(v, on).drop(a["_bin"]).drop(v["_bin"]).drop("_line", "_low", "_high")


def stop_uturns(track: DataFrame, stops: DataFrame, *, near_m: float = 15.0, step_m: float = 3.0, least_m: float = 50.0) -> DataFrame:
    """Stops (code, stop, at = vertex; not a line's first or last) whose approach and departure run on top of each other for
    at least least_m: code, stop, at, spur_m. `track` has arcs. One row per stop, step and side; the first parted step is a
    map-side minimum."""
    ends = track.groupBy("code").agg(F.max("arc").alias("_total"))
    own = track.select("code", F.col("i").alias("at"), F.col("arc").alias("_centre"))
    s = stops.join(own, ["code", "at"]).join(ends, "code")
    s = s.withColumn("_room", F.floor(F.least(F.col("_centre"), F.col("_total") - F.col("_centre")) / step_m).cast("int")).where("_room >= 1")
    k = s.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_room")))).drop("_total")
    k = k.withColumn("_tb", F.col("_centre") - F.col("_k") * F.lit(step_m)).withColumn("_tf", F.col("_centre") + F.col("_k") * F.lit(step_m))
    k = nearest_by_arc(nearest_by_arc(k, track, "_tb", "_p"), track, "_tf", "_q")
    parted = haversine_m(F.col("_p.lng"), F.col("_p.lat"), F.col("_q.lng"), F.col("_q.lat")) > near_m
    out = k.groupBy("code", "stop", "at", "_room").agg(F.min(F.when(parted, F.col("_k"))).alias("_first"))
    return out.select("code", "stop", "at", (F.coalesce(F.col("_first") - 1, F.col("_room")) * F.lit(step_m)).alias("spur_m")).where(F.col("spur_m") >= least_m)


def of_lines(lines: DataFrame, line: str = "line", code: str = "code") -> DataFrame:
    """The vertex table of lines held as arrays."""
    return lines.select(code, F.posexplode(line).alias("i", "_p")).select(code, "i", F.col("_p.lng").alias("lng"), F.col("_p.lat").alias("lat"))


def running(values: Column, block: int = 128) -> Column:
    """0 and the sums of an array of numbers up to and with each: in two levels too, so a long array is not copied for every
    one of its elements."""
    def parts(v):
        last = F.floor((F.size(v) - 1) / block).cast("int")
        return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(v, c * block + 1, F.lit(block)))).otherwise(F.array().cast("array<array<double>>"))

    within = lambda p: F.aggregate(p, F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    before = lambda sums: F.aggregate(sums, F.array(F.lit(0.0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(s, -1))))
    joined = lambda sums, totals: F.concat(F.array(F.lit(0.0)), F.flatten(F.transform(sums, lambda s, c: once(F.get(totals, c), lambda t: F.transform(F.slice(s, F.lit(2), F.size(s)), lambda x: x + t)))))
    return once(once(values, lambda v: F.transform(parts(v), within)), lambda sums: once(before(sums), lambda totals: joined(sums, totals)))
