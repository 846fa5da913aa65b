"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upland.session import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) of every id that has a link to another: root is the least id of its component.

    Every round each id points to the least id next to it. Such pointers meet only in pairs that point to each other, of
    which the lesser stays; so they form trees of at least two ids, whose tops are found by doubling the steps. Links are
    drawn again between the tops, at most half as many as there were ids, and rounds grow with the logarithm of the ids,
    whatever the shape. Tables between steps are written. A hub's links are cut to a minimum before they are shuffled."""
    ends = lambda df: df.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("to")), F.struct(F.col("b").alias("id"), F.col("a").alias("to")))).alias("e")).select("e.*")
    ordered = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = written(ordered(links.select(F.col(a).alias("a"), F.col(b).alias("b"))))
    found = written(ends(left).select("id").distinct().withColumn("root", F.col("id")))
    while not left.isEmpty():
        tops = _tops(written(ends(left).groupBy("id").agg(F.min("to").alias("to"))))
        pick = lambda name, out: tops.select(F.col("id").alias(name), F.col("to").alias(out))
        found = written(found.join(pick("root", "_r"), "root", "left").select("id", F.coalesce("_r", "root").alias("root")))
        left = written(ordered(left.join(pick("a", "_a"), "a").join(pick("b", "_b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))))
    least = found.groupBy("root").agg(F.min("id").alias("_least"))
    return found.join(least, "root").select("id", F.col("_least").alias("root"))


def _tops(pointers: DataFrame) -> DataFrame:
    """(id, to) with `to` the top of each id's tree."""
    after = lambda df: df.select(F.col("id").alias("to"), F.col("to").alias("next"))
    mutual = (F.col("next") == F.col("id")) & (F.col("id") < F.col("to"))
    now = written(pointers.join(after(pointers), "to").select("id", F.when(mutual, F.col("id")).otherwise(F.col("to")).alias("to")))
    while True:
        step = now.join(after(now), "to").select("id", F.col("next").alias("to"))
        new = written(step.join(after(now), "to").select("id", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        now = new.select("id", "to")
        if new.where("moved").isEmpty():
            return now
