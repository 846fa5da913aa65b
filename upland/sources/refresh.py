"""Full refresh of the content tables and replacement of listed entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upland.functions.ids import row_id


def with_row_ids(df: DataFrame, table: str, *natural: str) -> DataFrame:
    """Deterministic id from the table name and the natural key, so a re-run writes the same rows."""
    return df.withColumn("id", row_id(table, F.concat_ws(":", *natural)))


def full_refresh(tables: dict[str, tuple[DataFrame, tuple[str, ...]]], root: str) -> DataFrame:
    """Write every table, parents first in the given order, and report rows per table as read back from the files.
    Each table is replaced whole, so running it again gives the same content."""
    spark, counts = None, None
    for name, (df, natural) in tables.items():
        spark = df.sparkSession
        with_row_ids(df, name, *natural).write.mode("overwrite").parquet(f"{root}/{name}")
        n = spark.read.parquet(f"{root}/{name}").agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        counts = n if counts is None else counts.union(n)
    return counts


def replace_entries(entries: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """Listed entries with their outcome: replaced where the place exists, skipped (and reported) where it does not."""
    known = places.select(key).distinct().withColumn("_known", F.lit(True))
    return entries.join(known, key, "left").withColumn("outcome", F.when(F.col("_known"), "replaced").otherwise("skipped")).drop("_known")
