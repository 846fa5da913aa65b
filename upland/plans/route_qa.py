"""Checks and repairs of transit routes against their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upland.functions.geo import haversine_m, round5
from upland.operators import lines as L

# The limits a route must meet.
SKETCH_VERTICES = 50
STOP_ON_LINE_M = 30.0
RATIO = (1.0, 3.0)
MOVE_M = 400.0
MATCH_DEG = 1e-7


def unmatched_stops(stops: DataFrame, vertices: DataFrame, stop_id: str, eps: float = MATCH_DEG) -> DataFrame:
    """Stops (code, slng, slat) equal to no vertex (code, lng, lat) of their own line: an equi-join on rounded positions,
    each stop looking at the two nearest roundings per axis, then the exact test."""
    cell = lambda c: F.floor(F.col(c) / (2 * eps)).cast("long")
    near = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - eps) / (2 * eps)).cast("long"), F.floor((F.col(c) + eps) / (2 * eps)).cast("long")))
    a = stops.withColumn("_cx", F.explode(near("slng"))).withColumn("_cy", F.explode(near("slat")))
    b = vertices.select(F.col("code").alias("_code"), F.col("lng").alias("_lng"), F.col("lat").alias("_lat"), cell("lng").alias("_vx"), cell("lat").alias("_vy"))
    hit = a.join(b, (F.col("code") == F.col("_code")) & (F.col("_cx") == F.col("_vx")) & (F.col("_cy") == F.col("_vy"))
                 & (F.abs(F.col("slng") - F.col("_lng")) < eps) & (F.abs(F.col("slat") - F.col("_lat")) < eps), "left_semi")
    return stops.join(hit.select(stop_id).distinct(), stop_id, "left_anti")


def route_report(routes: DataFrame) -> DataFrame:
    """One row per route (code, line, stops array<struct<name, lng, lat>>, is_loop): lengths, stop distances, order and
    whether each limit holds. All of it is arithmetic on the route's own arrays, so nothing is shuffled; U-turns at stops
    and backtracks come from `lines.stop_uturns` and `lines.backtracks` on the result."""
    stops = F.transform("stops", lambda s: F.struct(s["lng"].alias("lng"), s["lat"].alias("lat")))
    r = routes.withColumn("_s", stops).withColumn("stop_idx", L.forward_indices("line", "_s")).withColumn("_arc", L.arc_m("line"))
    closed = F.when(F.col("is_loop"), F.concat("_s", F.slice("_s", 1, 1))).otherwise(F.col("_s"))
    at = lambda i: F.get(F.col("line"), i)
    off = F.transform(F.arrays_zip("_s", "stop_idx"), lambda z: haversine_m(at(z["stop_idx"])["lng"], at(z["stop_idx"])["lat"], z["_s"]["lng"], z["_s"]["lat"]))
    first, last = F.get("line", F.lit(0)), F.element_at("line", -1)
    end = F.when(F.col("is_loop"), F.get("_s", F.lit(0))).otherwise(F.element_at("_s", -1))
    start = F.get("_s", F.lit(0))
    r = r.select(
        "code", "line", "stop_idx",
        F.size("line").alias("vertices"), F.element_at("_arc", -1).alias("length_m"), L.length_m(closed).alias("straight_m"),
        F.array_max(off).alias("worst_stop_m"), L.strictly_rising("stop_idx").alias("in_order"),
        (haversine_m(first["lng"], first["lat"], start["lng"], start["lat"]) <= STOP_ON_LINE_M).alias("starts_at_stop"),
        (haversine_m(last["lng"], last["lat"], end["lng"], end["lat"]) <= STOP_ON_LINE_M).alias("ends_at_stop"))
    return r.withColumn("ratio", F.col("length_m") / F.col("straight_m")).withColumn("is_sketch", F.col("vertices") <= SKETCH_VERTICES).withColumn(
        "ok", (F.col("worst_stop_m") <= STOP_ON_LINE_M) & F.col("in_order") & F.col("ratio").between(*RATIO)
        & F.col("starts_at_stop") & F.col("ends_at_stop"))


def worst_detours(points: DataFrame) -> DataFrame:
    """Per route the optional waypoint whose two legs cost most over going straight past it: (code, seq, score). Points
    carry code, seq, mandatory and array columns are built per route; max_by picks the worst without sorting."""
    mid = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.struct(
        (haversine_m(F.get("w", i - 1)["lng"], F.get("w", i - 1)["lat"], F.get("w", i)["lng"], F.get("w", i)["lat"])
         + haversine_m(F.get("w", i)["lng"], F.get("w", i)["lat"], F.get("w", i + 1)["lng"], F.get("w", i + 1)["lat"])
         - haversine_m(F.get("w", i - 1)["lng"], F.get("w", i - 1)["lat"], F.get("w", i + 1)["lng"], F.get("w", i + 1)["lat"])).alias("score"),
        (-F.get("w", i)["seq"]).alias("back"), F.get("w", i)["mandatory"].alias("mandatory")))
    # to the millimetre, the earlier waypoint first
    ranked = F.transform(F.filter(mid, lambda m: ~m["mandatory"]), lambda m: F.struct(F.floor(m["score"] * 1000 + 0.5).alias("mm"), m["back"].alias("back"), m["score"].alias("score")))
    best = points.where(F.size("w") > 2).withColumn("_best", F.array_max(ranked))
    return best.where(F.col("_best").isNotNull()).select("code", (-F.col("_best.back")).alias("seq"), F.col("_best.score").alias("score"))


def relocate_stops(stops: DataFrame) -> DataFrame:
    """Move each stop onto the stretch of a trunk line between its neighbours: new place, metres moved, outcome.

    Rows carry code, seq, lng, lat (as drawn), trunk (line) and from_idx, to_idx (the neighbours' vertices on it). A move
    over 400 m is refused; so is one that ends over 30 m from a trunk vertex or out of order."""
    stretch = F.slice("trunk", F.col("from_idx") + 1, F.greatest(F.col("to_idx") - F.col("from_idx") + 1, F.lit(0)))
    d = stops.withColumn("_stretch", stretch).withColumn("_p", L.project_on_line("lng", "lat", "_stretch"))
    d = d.withColumn("new_lng", round5("_p.lng")).withColumn("new_lat", round5("_p.lat"))
    d = d.withColumn("moved_m", haversine_m("lng", "lat", "new_lng", "new_lat"))
    near = F.transform("trunk", lambda v: haversine_m(v["lng"], v["lat"], F.col("new_lng"), F.col("new_lat")))
    d = d.withColumn("line_m", F.array_min(near)).withColumn("_at", (F.array_position(near, F.array_min(near)) - 1).cast("int"))
    outcome = (F.when(F.size("_stretch") < 2, "refused: empty stretch").when(F.col("moved_m") > MOVE_M, "refused: too far")
               .when(F.col("line_m") > STOP_ON_LINE_M, "refused: off the line")
               .when(~((F.col("_at") >= F.col("from_idx")) & (F.col("_at") <= F.col("to_idx"))), "refused: order").otherwise("moved"))
    return d.withColumn("outcome", outcome).drop("_stretch", "_p", "_at")
