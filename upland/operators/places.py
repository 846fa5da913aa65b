"""Place, venue, transit and history queries."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from upland.functions import hours as H
from upland.functions import text as X
from upland.functions.geo import CITY_BOUNDS, between_box, chord_m, col, haversine_km, in_service_area, unit_sphere_m
from upland.operators.cells import lookup_join, nearest

# The allowed values of the enumerated columns, page sizes and limits.
CATEGORIES = ("NATURE", "PARK", "VIEWPOINT", "HERITAGE", "MARKET", "MUSEUM", "CHURCH", "RECREATION")
ERAS = ("PRE_COLONIAL", "AMERICAN_COLONIAL", "POST_WAR", "MODERN")
ROUTE_KINDS = ("JEEPNEY", "TAXI_SIM")
VENUE_CATEGORIES = ("RESTAURANT", "HOTEL", "TRANSIENT", "SOUVENIR", "FOOD_SHOP")
DEFAULT_LIMIT, MAX_LIMIT, LIST_CAP = 20, 50, 200
WALKABLE_KM = 0.8


# ----------------------------------------------------------- request parameters


def _floats(raw: str, count: int) -> np.ndarray:
    """`count` finite numbers of a comma-separated parameter; what is left blank is 0, as in a web form."""
    try:
        values = np.array([field.strip() or "0" for field in raw.split(",")], float)
    except ValueError:
        values = np.array([np.nan])
    if values.shape != (count,) or not np.isfinite(values).all():
        raise ValueError(f"wants_{count}_numbers")
    return values


def parse_bbox(raw: str | None):
    """(west, south, east, north) of two opposite corners in either order, cut to the city; None where no box is asked for."""
    if not (raw or "").strip():
        return None
    corners, city = _floats(raw, 4).reshape(2, 2), np.reshape(CITY_BOUNDS, (2, 2))
    return tuple(np.clip(np.sort(corners, axis=0), *city).ravel().tolist())


def parse_zoom(raw: str | None, fallback: int = 14) -> int:
    """The nearest whole zoom (halves up) of 1 to 22."""
    asked = _floats(raw, 1)[0] if (raw or "").strip() else fallback
    return int(np.clip(np.floor(asked + 0.5), 1, 22))


def bbox_filter(df: DataFrame, raw: str | None, lng: str = "lng", lat: str = "lat") -> DataFrame:
    box = parse_bbox(raw)
    return df if box is None else df.where(between_box(lng, lat, box))


def zoom_line(zoom: int, z12: str = "line_z12", z14: str = "line_z14", full: str = "line") -> Column:
    """The simplified line that fits a zoom, or the full one where there is none."""
    pick = F.col(z12) if zoom < 13 else F.col(z14) if zoom <= 14 else F.col(full)
    return F.coalesce(pick, F.col(full))


def enum_filter(df: DataFrame, column: str, value, allowed: Iterable) -> DataFrame:
    """No value: no filter. A value outside the list is an error, not an empty result."""
    if value is None or value == "":
        return df
    if value not in set(allowed):
        raise ValueError(f"unknown {column}")
    return df.where(F.col(column) == value)


def any_of(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isin(list(values))) if values else df


def price_filter(df: DataFrame, price_max: int | None) -> DataFrame:
    if price_max is None:
        return df
    if price_max != int(price_max) or not 1 <= price_max <= 4:
        raise ValueError("priceMax must be an integer 1-4")
    return df.where(F.col("price_range") <= int(price_max))


def shape_split(df: DataFrame, slug: str, row_id: str, code: str) -> DataFrame:
    """Rows with a `reject` reason, null where every key is well formed."""
    reason = (F.when(~F.coalesce(X.is_slug(slug), F.lit(False)), "slug")
              .when(~F.coalesce(X.is_row_id(row_id), F.lit(False)), "id")
              .when(~F.coalesce(X.is_route_code(code), F.lit(False)), "route"))
    return df.withColumn("reject", reason)


def open_places(df: DataFrame, ts, hours: str = "hours") -> DataFrame:
    return df.where(H.open_at(hours, H.local_minutes(ts)))


# ------------------------------------------------------------------ text search


def text_search(df: DataFrame, q: str, *texts: str) -> DataFrame:
    """Rows whose text holds every term of q. No terms left: no rows."""
    terms = X.query_terms(q)
    if not terms:
        return df.limit(0)
    words = X.tokens(F.concat_ws(" ", *texts))
    return df.withColumn("_words", words).where(
        F.forall(F.array(*[F.lit(t) for t in terms]), lambda t: F.array_contains("_words", t))).drop("_words")


def write_index(df: DataFrame, key: str, path: str, *texts: str, buckets: int = 64) -> None:
    """Inverted index of the texts: `postings` (bucket, term, key), a folder for each bucket of terms and sorted by term in
    its files, and `terms` (bucket, term, n) with the number of keys that hold a term. A common term's postings are dealt
    over several files by key."""
    bucket = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(buckets)).cast("int").alias("bucket")
    rows = df.select(F.explode(X.tokens(F.concat_ws(" ", *texts))).alias("term"), key).select(bucket, "term", key).distinct()
    rows.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(8))).repartition("bucket", "_part").drop("_part").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    made = df.sparkSession.read.parquet(f"{path}/postings")
    made.groupBy("bucket", "term").agg(F.count("*").alias("n")).repartition("bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")


def index_search(spark: SparkSession, path: str, key: str, q: str, buckets: int = 64) -> DataFrame:
    """Keys whose texts hold every term of q, from a written index: only the buckets of its terms are read, and the terms'
    counts, one row each, say in which order postings meet, the rarest first. No terms left, or one that no text holds: no
    rows."""
    terms = X.query_terms(q)
    postings = spark.read.parquet(f"{path}/postings")
    of = lambda t: (F.col("bucket") == zlib.crc32(t.encode()) % buckets) & (F.col("term") == t)
    found = {}
    if terms:
        any_ = of(terms[0])
        for t in terms[1:]:
            any_ = any_ | of(t)
        found = {r["term"]: r["n"] for r in spark.read.parquet(f"{path}/terms").where(any_).collect()}        # one row for each term asked
    if not terms or len(found) < len(terms):
        return postings.select(key).limit(0)
    first, *rest = sorted(terms, key=lambda t: (found[t], t))
    hits = postings.where(of(first)).select(key)
    for t in rest:
        hits = hits.join(postings.where(of(t)).select(key), key, "left_semi")
    return hits


def name_contains(df: DataFrame, name: str, column: str = "name", limit: int = 5) -> DataFrame:
    bare = name.replace("%", "").replace("_", "")
    return df.where(F.contains(F.lower(col(column)), F.lower(F.lit(bare)))).orderBy(column).limit(limit)


def keyset_page(df: DataFrame, key: str = "id", cursor=None, limit: int | None = None) -> DataFrame:
    """One page after the cursor in key order, with next_cursor set on its rows when more follow. One bounded sort:
    the extra row tells whether there is a next page."""
    if limit is not None and (int(limit) != limit or limit < 1):
        raise ValueError("limit must be a positive integer")
    n = min(limit or DEFAULT_LIMIT, MAX_LIMIT)
    if cursor is not None:
        df = df.where(F.col(key) > F.lit(cursor))
    page = df.orderBy(key).limit(n + 1).withColumn("_pos", F.row_number().over(Window.orderBy(key)))
    everything = Window.partitionBy(F.lit(0))
    more = F.max("_pos").over(everything) > n
    last = F.max(F.when(F.col("_pos") == n, F.col(key))).over(everything)
    return page.withColumn("next_cursor", F.when(more, last)).where(F.col("_pos") <= n).drop("_pos")


def one(df: DataFrame, condition: Column, order: str = "id") -> DataFrame:
    return df.where(condition).orderBy(order).limit(1)


def in_given_order(df: DataFrame, key: str, keys: Sequence) -> DataFrame:
    """Rows of the given keys in the given order: the list is a literal map on the row, so there is no join."""
    pos = F.create_map(*[x for i, k in enumerate(keys) for x in (F.lit(k), F.lit(i))])
    return df.where(F.col(key).isin(list(keys))).withColumn("position", pos[F.col(key)]).orderBy("position")


# ---------------------------------------------------------------- nested lists


def with_list(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, order: Sequence[str], fields: Sequence[str],
              name: str) -> DataFrame:
    """Parents with their children nested in order; no children gives an empty list. The nested value is the result's own
    row, so its size is the caller's data model (stops of a route, pictures of a place)."""
    item = F.struct(*[F.col(c) for c in dict.fromkeys([*order, *fields])])
    lists = children.groupBy(F.col(child_key).alias("_k")).agg(F.sort_array(F.collect_list(item)).alias(name))
    joined = parents.join(lists, F.col(parent_key) == F.col("_k"), "left").drop("_k")
    return joined.withColumn(name, F.coalesce(name, F.array()))


def first_child(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, order: Column, fields: Sequence[str]) -> DataFrame:
    """Parents with one child or nulls: the least by `order`, chosen map-side before the shuffle."""
    best = children.groupBy(F.col(child_key).alias("_k")).agg(F.min_by(F.struct(*fields), order).alias("_c"))
    return parents.join(best, F.col(parent_key) == F.col("_k"), "left").select(parents["*"], *[F.col("_c")[f].alias(f) for f in fields])


def keyed_update(base: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Base with columns taken from the matching change row, and `changed` telling which rows had one."""
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = base.join(new, list(keys), "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_new_{c}", c)).drop(f"_new_{c}")
    return out.withColumn("changed", F.coalesce("_hit", F.lit(False))).drop("_hit")


# ------------------------------------------------------------------- neighbours


def nearest_places(origins: DataFrame, places: DataFrame, n: int, *, origin_id: str, place_id: str, o: tuple[str, str], p: tuple[str, str],
                   exclude_self: bool = False, max_km: float | None = None, tie: Sequence[str] | None = None) -> DataFrame:
    """The n nearest places of each origin by great-circle distance (km, rank)."""
    out = nearest(
        origins, places, n, origin_id=origin_id, origin_at=lambda: unit_sphere_m(*o), item_at=lambda: unit_sphere_m(*p),
        distance=haversine_km(*o, *p) * 1000.0, tie=tie or [place_id], same_site=list(p), max_m=None if max_km is None else max_km * 1000,
        exclude=(F.col(origin_id) == F.col(place_id)) if exclude_self else None, origin_site=list(o))
    return out.withColumn("km", F.col("dist") / 1000.0).drop("dist")


def closest_stop(origins: DataFrame, stops: DataFrame, *, origin_id: str, max_km: float = WALKABLE_KM) -> DataFrame:
    """The best route to ride: the route whose nearest stop is nearest, within walking distance. The nearest stop of
    the best route is the nearest stop of all, so one search answers both steps. Stops carry route, seq, slng, slat."""
    return nearest_places(origins, stops, 1, origin_id=origin_id, place_id="stop_id", o=("lng", "lat"), p=("slng", "slat"),
                          max_km=max_km, tie=["route", "seq"]).drop("rank")


def relief(places: DataFrame, lng: float, lat: float) -> DataFrame:
    """Places with a height, by distance from one point: km on every row, with the lowest, highest and span of all.
    The three figures are one small aggregate, joined back by broadcast of its single row."""
    pts = places.where(F.col("elevation").isNotNull()).withColumn("km", haversine_km(F.lit(lng), F.lit(lat), "lng", "lat"))
    sums = pts.agg(F.min_by("slug", F.struct("elevation", "km", "slug")).alias("lowest"),
                   F.max_by("slug", F.struct(F.col("elevation"), F.col("km"), F.col("slug"))).alias("highest"),
                   (F.max("elevation") - F.min("elevation")).alias("span"), F.count("*").alias("points"))
    sums = sums.withColumn("points", F.when(F.col("points") > 0, F.col("points")).otherwise(F.raise_error(F.lit("relief needs at least one place with a height"))))
    return pts.withColumn("_one", F.lit(1)).join(F.broadcast(sums.withColumn("_one", F.lit(1))), "_one").drop("_one")


# ------------------------------------------------------------------ trip prices


def price_trips(trips: DataFrame, rates: DataFrame) -> DataFrame:
    """Every trip with fare, breakdown and modern fare, or the first reason why it has none (mode, ends, area, no_route,
    bad_route, lost_route). `rates` is code, fare_base, fare_per_km."""
    from upland.functions import fares as P
    ends = ("from_lng", "from_lat", "to_lng", "to_lat")
    t = trips.withColumn("mode", F.lower(F.coalesce("mode", F.lit("jeepney")))).join(rates.withColumnRenamed("code", "_code"), F.col("route_code") == F.col("_code"), "left")
    bus = F.col("mode") == "jeepney"
    wrong = {
        "mode": ~F.col("mode").isin("jeepney", "taxi"),
        "ends": F.greatest(*[F.col(c).isNull().cast("int") for c in ends]) == 1,
        "area": ~(in_service_area(*ends[:2]) & in_service_area(*ends[2:])),
        "no_route": bus & (F.coalesce("route_code", F.lit("")) == ""),
        "bad_route": bus & ~X.is_route_code("route_code"),
        "lost_route": bus & F.col("_code").isNull(),
    }
    reasons = F.array(*[F.when(test, F.lit(name)) for name, test in wrong.items()])
    t = t.withColumn("reject", F.get(F.filter(reasons, lambda r: r.isNotNull()), F.lit(0))).withColumn("_km", haversine_km(*ends))
    fine = F.col("reject").isNull()
    t = t.withColumn("_p", F.when(fine & bus, P.traditional_fare("_km", "fare_base", "fare_per_km")).when(fine, P.taxi_fare("_km"))).withColumn("_m", F.when(fine & bus, P.modern_fare("_km")))
    return t.select(*trips.columns, "reject", "_p.distance_km", "_p.fare", "_p.breakdown", F.col("_m.fare").alias("modern_fare"))


# ------------------------------------------------------------------ clusters, sets


def map_clusters(points: DataFrame, zoom: int, cell_px: int = 50, last_zoom: int = 13) -> DataFrame:
    """Marker clusters: count and mean position per cell of cell_px screen pixels; past last_zoom every point stands
    alone. Counts combine map-side, so a crowded cell costs one row per task."""
    if zoom > last_zoom:
        return points.select(F.lit(1).cast("long").alias("n"), F.col("lng"), F.col("lat"))
    world = float(512 * 2**zoom)
    x = (F.col("lng") + 180) / 360 * world
    y = (1 - F.asinh(F.tan(F.radians("lat"))) / F.lit(math.pi)) / 2 * world
    return points.groupBy(F.floor(x / cell_px).cast("long").alias("cx"), F.floor(y / cell_px).cast("long").alias("cy")).agg(
        F.count("*").alias("n"), F.avg("lng").alias("lng"), F.avg("lat").alias("lat")).select("cx", "cy", "n", "lng", "lat")


def tiles_covering(boxes: DataFrame, z: int) -> DataFrame:
    """Distinct tiles (x, y) that the boxes (west, south, east, north) touch."""
    from upland.functions.geo import tile_x, tile_y
    zc = F.lit(z)
    span = boxes.select(F.explode(F.sequence(tile_x("west", zc), tile_x("east", zc))).alias("x"), tile_y("north", zc).alias("_a"), tile_y("south", zc).alias("_b"))
    return span.select("x", F.explode(F.sequence("_a", "_b")).alias("y")).distinct()
