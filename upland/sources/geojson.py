"""GeoJSON and history files in, features and structured data out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upland.functions.geo import quantise
from upland.schemas import FEATURE, FEATURES, HISTORY, ROUTE_FEATURES


def _point_columns(f: DataFrame) -> DataFrame:
    return f.select("properties.*", F.get(F.col("geometry.coordinates"), F.lit(0)).alias("lng"), F.get(F.col("geometry.coordinates"), F.lit(1)).alias("lat"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Point features of a FeatureCollection file: properties + lng, lat. A null feature list gives no rows."""
    doc = spark.read.schema(FEATURES).option("multiLine", True).json(path)
    return _point_columns(doc.select(F.explode("features").alias("f")).select("f.*"))


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """Line features: code, name, kind, fares, line (array of lng, lat), stops."""
    doc = spark.read.schema(ROUTE_FEATURES).option("multiLine", True).json(path)
    f = doc.select(F.explode("features").alias("f")).select("f.*")
    line = F.transform("geometry.coordinates", lambda p: F.struct(p[0].alias("lng"), p[1].alias("lat")))
    stops = F.transform("properties.stops", lambda s: F.struct(s["name"].alias("name"), s["seq"].alias("seq"), s["coord"][0].alias("lng"), s["coord"][1].alias("lat")))
    return f.select(F.col("properties.code").alias("code"), F.col("properties.name").alias("name"), F.col("properties.kind").alias("kind"),
                    F.col("properties.fareBase").cast("decimal(10,2)").alias("fare_base"), F.col("properties.farePerKm").cast("decimal(10,2)").alias("fare_per_km"),
                    line.alias("line"), stops.alias("stops"))


def features_from_text(lines: DataFrame) -> DataFrame:
    """Point features from text rows, one Feature a row."""
    return _point_columns(lines.select(F.from_json("value", FEATURE).alias("f")).select("f.*"))


def read_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(eras, events); the year keys come in camelCase or snake_case."""
    return history_from_docs(spark.read.schema(HISTORY).option("multiLine", True).json(path))


def history_from_docs(doc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(eras, events) of parsed history documents."""
    eras = doc.select(F.explode("eras").alias("e")).select("e.*")
    eras = eras.select("key", "name", F.coalesce("startYear", "start_year").alias("start_year"), F.coalesce("endYear", "end_year").alias("end_year"), "summary")
    events = doc.select(F.explode("events").alias("e")).select("e.*")
    return eras, events.select("title", "year", "era", "description", F.get("coord", F.lit(0)).alias("lng"), F.get("coord", F.lit(1)).alias("lat"))


def feature_json(geometry: Column, depth: int, props: dict[str, Column]) -> Column:
    """One Feature as JSON text, coordinates to 5 decimals; depth is the nesting of the coordinates."""
    g = F.struct(geometry["type"].alias("type"), quantise(geometry["coordinates"], depth).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), g.alias("geometry"), F.struct(*[c.alias(k) for k, c in props.items()]).alias("properties")))


def write_features(df: DataFrame, feature: Column, path: str, by: list[str]) -> None:
    """One Feature a line, in a folder per tile: nothing is gathered into one document."""
    df.select(*by, feature.alias("value")).write.mode("overwrite").partitionBy(*by).text(path)


def place_jsonld(name: str, description: str, slug: str, lng: str, lat: str, elevation: str, site: str) -> Column:
    """schema.org row of a place; a missing elevation is left out, and < is escaped for embedding in a page."""
    geo = F.struct(F.lit("GeoCoordinates").alias("@type"), F.col(lat).alias("latitude"), F.col(lng).alias("longitude"), F.col(elevation).alias("elevation"))
    doc = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("TouristAttraction").alias("@type"), F.col(name).alias("name"),
                   F.col(description).alias("description"), F.concat(F.lit(f"{site}/destinations/"), F.col(slug)).alias("url"), geo.alias("geo"))
    return F.replace(F.to_json(doc), F.lit("<"), F.lit("\\u003c"))
