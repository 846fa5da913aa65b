"""Map element extracts: reading, class selection, polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upland.functions.geo import col
from upland.operators.rings import stitch_relations
from upland.schemas import OSM


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """One row per element with its tags map, geometry and members. A whole-document extract is one JSON value; write
    it to Parquet once and let later jobs read that."""
    return elements_from_docs(spark.read.schema(OSM).option("multiLine", True).json(path))


def elements_from_docs(doc: DataFrame) -> DataFrame:
    """One row per element of parsed extract documents (also line-delimited ones, which split over tasks)."""
    return doc.select(F.explode("elements").alias("e")).select("e.*")


def tag(name: str, tags="tags") -> Column:
    return col(tags)[name]


# The tag rules of each element class.
DRIVABLE = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "pedestrian", "service", "track")
WALKABLE = ("footway", "pedestrian", "cycleway", "path", "bridleway", "steps")
SIGN_KINDS = ("fast_food", "restaurant", "cafe", "bank", "pharmacy", "bar", "ice_cream", "food_court", "hotel")
WALLS = ("retaining_wall", "wall")


def road_class(tags="tags") -> Column:
    """Highway class without its link suffix."""
    return F.regexp_replace(F.coalesce(tag("highway", tags), F.lit("")), "_link$", "")


def poi_kind(tags="tags") -> Column:
    t = lambda k: tag(k, tags)
    return (F.when(t("amenity").isin(*SIGN_KINDS), t("amenity")).when(t("tourism").isin("hotel", "motel"), F.lit("hotel"))
            .when(t("shop").isNotNull(), F.lit("shop")))


def element_classes(tags="tags", kind="type") -> Column:
    """Every class an element belongs to."""
    t = lambda k: tag(k, tags)
    way, node = col(kind) == "way", col(kind) == "node"
    no = lambda c: F.coalesce(~c, F.lit(True))
    rules = {
        "drivable": way & road_class(tags).isin(*DRIVABLE) & no(t("tunnel").isin("yes", "building_passage")) & no(t("area") == "yes"),
        "walkway": way & t("highway").isin(*WALKABLE) & no(t("footway") == "crossing") & no(t("tunnel") == "yes"),
        "wall": way & t("barrier").isin(*WALLS),
        "hotel": t("tourism").isin("hotel", "resort") & t("name").isNotNull(),
        "poi": t("name").isNotNull() & poi_kind(tags).isNotNull(),
        "tree": node & (t("natural") == "tree"),
        "tree_row": way & (t("natural") == "tree_row"),
        "crossing": node & (t("highway") == "crossing") & no(t("crossing").isin("unmarked", "no")),
        "lamp": node & (t("highway") == "street_lamp"),
        "signal": node & (t("highway") == "traffic_signals"),
        "sign": node & (t("highway").isin("stop", "give_way") | (t("traffic_sign").isNotNull() & no(t("highway").isin("crossing", "street_lamp", "traffic_signals")))),
        "building": t("building").isNotNull(),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))


def polygons(elements: DataFrame) -> DataFrame:
    """Closed ways and multipolygon relations: id, tags, outer and inner rings (lon, lat). A relation's member ways are
    stitched end to end; everything else stays in the JVM."""
    key = F.concat_ws("/", "type", "id")
    g = F.col("geometry")
    closed = elements.where((F.col("type") == "way") & (F.size("geometry") >= 4) & (g[0] == F.element_at("geometry", -1)))
    point = F.transform("geometry", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    empty = F.array().cast("array<array<struct<lon:double,lat:double>>>")
    ways = closed.select(key.alias("id"), "tags", F.array(point).alias("outer"), empty.alias("inner"))
    rel = elements.where(F.col("type") == "relation").select(key.alias("id"), "tags", "members")
    rings = stitch_relations(rel)
    return ways.unionByName(rel.select("id", "tags").join(rings, "id").where(F.size("outer") > 0).select("id", "tags", "outer", "inner"))
