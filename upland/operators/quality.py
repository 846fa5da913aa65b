"""Data checks: each returns the offending rows or one row of figures; `require` turns a check into an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upland.functions.geo import CITY_CENTRE, col, in_service_area, tm_forward, tm_inverse
from upland.operators.tiles import manifest

ELEVATION_RANGE = (850.0, 1700.0)


def require_count(df: DataFrame, n: int) -> DataFrame:
    """One row with the count; evaluating it fails when the count is not n."""
    return df.agg(F.count("*").alias("n")).withColumn("ok", F.assert_true(F.col("n") == n, F.concat(F.lit("expected "), F.lit(n), F.lit(" rows, found "), F.col("n"))).isNull())


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: nulls per column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def missing_parents(children: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    known = parents.select(F.col(parent_key).alias(key)).distinct()
    return children.where(F.col(key).isNotNull()).join(known, key, "left_anti")


def outside_list(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(list(allowed)))


def too_long(df: DataFrame, column: str, most: int) -> DataFrame:
    return df.where(F.char_length(column) > most)


def update_counts(updated: DataFrame) -> DataFrame:
    return updated.agg(F.count_if("changed").alias("changed"), F.count("*").alias("rows"))


def count_drift(df: DataFrame, reference: int, share: float = 0.01) -> DataFrame:
    n = F.count("*")
    return df.agg(n.alias("n"), (F.abs(n - reference) <= reference * share).alias("ok"))


def height_gate(samples: DataFrame, sampled: str, expected: str, tolerance: Column) -> DataFrame:
    """Figures over anchors: mean and worst difference, voids, and whether every one is within its tolerance."""
    d = F.col(sampled) - F.col(expected)
    return samples.agg(F.avg(d).alias("mean"), F.max(F.abs(d)).alias("worst"), F.count_if(F.col(sampled).isNull()).alias("voids"),
                       F.min(F.coalesce(F.abs(d) <= tolerance, F.lit(False))).alias("ok"))


def uncovered(pixels: DataFrame, corners: DataFrame, side: int) -> DataFrame:
    """Tiles (x, y) between the corners (a table of x, y) whose side * side pixels (x, y, px, py) are not all there, with how
    many are. Only the tiles' counts meet, never the pixels."""
    span = corners.agg(*[f(c).cast("long").alias(f"{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])
    wanted = span.select(F.explode(F.sequence("lox", "hix")).alias("x"), "loy", "hiy").select("x", F.explode(F.sequence("loy", "hiy")).alias("y"))
    have = pixels.select("x", "y", "px", "py").distinct().groupBy("x", "y").agg(F.count("*").alias("n"))
    return wanted.join(have, ["x", "y"], "left").select("x", "y", F.coalesce("n", F.lit(0)).cast("long").alias("n")).where(F.col("n") < side * side)


def broken_records(tiles: DataFrame, records: DataFrame, tile: list[str], record_bytes: int, kinds: int) -> DataFrame:
    """Listed tiles (tile, bytes) whose bytes are not whole records, whose records (tile, kind) are not as many, or hold a kind
    that is not known (0 to kinds - 1): the tile with what is wrong."""
    n = records.groupBy(*tile).agg(F.count("*").alias("_n"), F.count_if(~F.coalesce(F.col("kind").between(0, kinds - 1), F.lit(False))).alias("_odd"))
    j = tiles.join(n, tile, "left")
    wrong = (F.when(F.col("bytes") % record_bytes != 0, "part of a record").when(F.col("bytes") != F.coalesce("_n", F.lit(0)) * record_bytes, "records missing or unlisted")
             .when(F.col("_odd") > 0, "unknown kind"))
    return j.withColumn("wrong", wrong).where("wrong IS NOT NULL").select(*tile, "wrong")


def tile_budget(man: DataFrame, most_bytes: int) -> DataFrame:
    return man.where(F.col("bytes") > most_bytes)


def orphans(listed: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side."""
    a, b = listed.select(key).distinct(), present.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("unlisted")))


def manifest_mismatches(stored: DataFrame, content: DataFrame, tile: list[str], columns: list[str]) -> DataFrame:
    """Tiles whose stored hash is not that of their rows now."""
    now = manifest(content, tile, columns).select(*tile, F.col("sha256").alias("_now"))
    return stored.join(now, tile, "full_outer").where(~F.col("sha256").eqNullSafe(F.col("_now"))).select(*tile)


def round_trip(df: DataFrame, lng: str = "lng", lat: str = "lat", centre=CITY_CENTRE, gate_m: float = 1.0) -> DataFrame:
    """Largest error in metres of projecting and back."""
    e, n = tm_forward(lng, lat, centre)
    d = df.select(F.col(lng).alias("_a"), F.col(lat).alias("_b"), e.alias("_e"), n.alias("_n"))
    a, b = tm_inverse("_e", "_n", centre)
    err = F.hypot((a - F.col("_a")) * 106_800, (b - F.col("_b")) * 110_700)
    return d.agg(F.max(err).alias("worst_m")).withColumn("ok", F.col("worst_m") <= gate_m)


def element_gaps(elements: DataFrame) -> DataFrame:
    """Elements without any geometry."""
    has = F.col("lat").isNotNull() | (F.size("geometry") > 0) | F.exists("members", lambda m: F.size(m["geometry"]) > 0)
    return elements.where(~F.coalesce(has, F.lit(False)))


def bad_stops(stops: DataFrame, name: str = "name", lng: str = "lng", lat: str = "lat") -> DataFrame:
    named = F.char_length(F.coalesce(col(name), F.lit(""))) > 0
    return stops.where(~(named & F.coalesce(in_service_area(lng, lat), F.lit(False))))


def bad_elevations(places: DataFrame, elevation: str = "elevation") -> DataFrame:
    return places.where(F.col(elevation).isNotNull() & ~F.col(elevation).between(*ELEVATION_RANGE))
