"""Publishing tables and tiles: staged writes, content hashes, and a manifest that is the only thing readers follow.

A run writes under a folder of its own name, which nothing refers to until its manifest is written, in one more folder whose
number is one above the last. Readers take the highest complete manifest, so they see a run whole or not at all, and a run
that was lost half way leaves files that no manifest names. What has the content hash of the manifest before keeps its old
files and is not written again.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upland.operators.tiles import manifest as tile_manifest
from upland.sources.refresh import with_row_ids
from upland.streaming.jobs import exists

TABLES = "name string, rows long, sha256 string, path string"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete manifests under a root, in order."""
    if not exists(spark, f"{root}/manifests"):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifests")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(int(p.getPath().getName()[2:]) for p in found if exists(spark, f"{p.getPath()}/_SUCCESS"))


def latest(spark: SparkSession, root: str) -> DataFrame | None:
    known = versions(spark, root)
    return spark.read.parquet(f"{root}/manifests/v={known[-1]}") if known else None


def commit(manifest: DataFrame, root: str) -> DataFrame:
    """Write the next manifest; a number that another run has taken meanwhile is an error, not an overwrite."""
    spark = manifest.sparkSession
    number = (versions(spark, root) or [0])[-1] + 1
    manifest.write.mode("errorifexists").parquet(f"{root}/manifests/v={number}")
    return spark.read.parquet(f"{root}/manifests/v={number}")


def content(df: DataFrame) -> DataFrame:
    """One row: rows and a hash of a table's content, whatever the order of its rows."""
    d = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    piece = lambda i: F.conv(F.substring(d, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")
    sums = df.select(*[piece(i).alias(f"s{i}") for i in range(4)]).agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(f"s{i}"), F.lit(0)).alias(f"s{i}") for i in range(4)])
    return sums.select("rows", F.sha2(F.concat_ws(":", "rows", *[f"s{i}" for i in range(4)]), 256).alias("sha256"))


def publish_tables(tables: dict[str, tuple[DataFrame, tuple[str, ...]]], root: str) -> DataFrame:
    """A full refresh: every table (name to rows and natural key) with its deterministic ids, parents first. One row a table:
    name, rows, sha256, path and outcome (new, changed, kept)."""
    spark = next(iter(tables.values()))[0].sparkSession
    old = {r["name"]: r for r in before.collect()} if (before := latest(spark, root)) is not None else {}          # one row a table
    run, rows = uuid4().hex, []
    for name, (df, natural) in tables.items():
        made = with_row_ids(df, name, *natural)
        now = content(made).first()
        was = old.get(name)
        kept = was is not None and was["sha256"] == now["sha256"]
        path = was["path"] if kept else f"{root}/runs/{run}/{name}"
        if not kept:
            made.write.parquet(path)
        rows.append((name, now["rows"], now["sha256"], path, "kept" if kept else "changed" if was is not None else "new"))
    return commit(spark.createDataFrame(rows, f"{TABLES}, outcome string").coalesce(1), root)


def publish_tiles(df: DataFrame, root: str, tile: list[str], columns: list[str], lng: str = "lng", lat: str = "lat", per_file: int = 1_000_000) -> DataFrame:
    """Tiles of rows, of which only new and changed ones are written; gone ones are dropped from the manifest. One row a
    tile: the tile, rows, bytes, bounds, sha256, path and outcome (new, changed, kept). A crowded tile is written by several
    tasks."""
    spark = df.sparkSession
    now, run = tile_manifest(df, tile, columns, lng, lat), uuid4().hex
    before = latest(spark, root)
    if before is None:
        before = spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in df.select(*tile).dtypes) + ", sha256 string, path string")
    was = before.select(*tile, F.col("sha256").alias("_was"), F.col("path").alias("_path"))
    j = now.join(was, tile, "left")
    kept = F.coalesce(F.col("_was") == F.col("sha256"), F.lit(False))
    place = F.concat(F.lit(f"{root}/runs/{run}/"), F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in tile]))
    j = j.withColumn("outcome", F.when(kept, "kept").when(F.col("_was").isNotNull(), "changed").otherwise("new")).withColumn("path", F.when(kept, F.col("_path")).otherwise(place)).drop("_was", "_path")
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c not in tile]), F.lit(8))
    fresh = df.join(j.where("outcome <> 'kept'").select(*tile), tile, "left_semi")
    fresh.withColumn("_salt", salt).repartition(*tile, "_salt").drop("_salt").write.option("maxRecordsPerFile", per_file).partitionBy(*tile).parquet(f"{root}/runs/{run}")
    return commit(j, root)


def read_tiles(spark: SparkSession, root: str, tile: list[str], schema: str) -> DataFrame:
    """The rows of the latest manifest's tiles with the columns of `schema` and the tile's own. Runs are few, so each is read
    with its tiles chosen by the manifest."""
    m = latest(spark, root)
    runs = [r["run"] for r in m.select(F.regexp_extract("path", "/runs/([0-9a-f]+)/", 1).alias("run")).distinct().collect()]          # one row a run
    parts = []
    for run in runs:
        own = m.where(F.contains(F.col("path"), F.lit(f"/runs/{run}/"))).select(*tile)
        types = dict(m.dtypes)
        rows = spark.read.schema(f"{schema}, " + ", ".join(f"`{c}` {types[c]}" for c in tile)).parquet(f"{root}/runs/{run}")
        parts.append(rows.join(own, tile, "left_semi"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
