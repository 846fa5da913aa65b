"""Mixing sources to target weights, in DataFrame expressions only.

Words are counted per document and summed per source; each source gets a target, its rate is target / size, and a
document is emitted floor(rate) times plus once more where a hash of its id falls under the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upland.llm.common import stash, text_of

WEIGHTS = (5, 2, 1)      # by the sources' order, repeating
SHARE = 1.5              # of all words, what the mix holds
MOST = 2                 # a source's words are taken at most so often
SMALL = 100_000          # sources up to this number are sent to every task; more are joined by a shuffle


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size). Targets are weight shares of share * all words; one that
    exceeds most * its source's words stops there and the rest is shared again by weight until none is above. In order
    of cap / weight the stopped sources come first, so one pass over the sources finds the level; nothing here is
    larger than the list of sources."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("fill", F.col("source").asc_nulls_last())
    before, everything = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int"))).withColumn("cap", (F.col("source_size") * most).cast("double"))
    per = per.withColumn("fill", F.col("cap") / F.col("w")).withColumn("goal", F.sum("source_size").over(everything) * F.lit(share)).withColumn("all_w", F.sum("w").over(everything))
    per = per.withColumn("level", (F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    per = per.withColumn("open", F.min(F.when(F.col("fill") > F.col("level"), F.struct("fill", F.col("source").isNull().alias("n"), "source", "level"))).over(everything))
    target = F.when(F.col("open").isNull() | (F.col("fill") <= F.col("open.level")), F.col("cap")).otherwise(F.col("w") * F.col("open.level"))
    return per.select("source", "source_size", F.least(target, F.col("cap")).alias("target"))


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of the key; the same in every run."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def with_targets(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Rows with a column source, joined to their source's figures."""
    per = stash(per).withColumnRenamed("source", "of")
    if per.count() <= SMALL:
        per = F.broadcast(per)
    return rows.join(per, F.col("source").eqNullSafe(F.col("of")), "inner").drop("of")


def copies(key: Column, seed: int) -> Column:
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return (whole + F.when(draw(key, seed) < rate - whole, 1).otherwise(0)).cast("long")


def repetitions(docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """One row per document: doc_id, source, size (words), source_size, target (its source's) and copies, how often the
    mix takes it. A null text has no words; a null source is a source of its own, ordered last; repeated rows are
    separate documents with the same draw; an empty table gives no rows; other columns are not looked at."""
    sizes = stash(docs.select(docs["doc_id"], docs["source"], n_words(text_of(docs)).alias("size")))
    return with_targets(sizes, targets(sizes, **how)).select("doc_id", "source", "size", "source_size", "target", copies(F.col("doc_id"), seed).alias("copies"))


def mixed(docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """The mix itself: each document, with all its columns, as often as `repetitions` says."""
    sizes = docs.select(docs["source"].alias("source"), n_words(text_of(docs)).alias("size"))
    rows = docs.select(docs["source"].alias("source"), docs["doc_id"].alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    taken = with_targets(rows, targets(sizes, **how)).select("row", copies(F.col("key"), seed).alias("n")).where("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i")).select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(list_extract([5.0, 2.0, 1.0], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)) AS DOUBLE) AS w, CAST(2 * source_size AS DOUBLE) AS cap FROM p),
f AS (SELECT *, cap / w AS fill, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS goal, sum(w) OVER () AS all_w FROM w),
l AS (SELECT *, (goal - coalesce(sum(cap) OVER b, 0::DOUBLE)) / (all_w - coalesce(sum(w) OVER b, 0::DOUBLE)) AS level FROM f
      WINDOW b AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, (SELECT level FROM l WHERE fill > level ORDER BY fill, source NULLS LAST LIMIT 1) AS stop FROM l),
t AS (SELECT source, source_size, least(cap, CASE WHEN stop IS NULL OR fill <= stop THEN cap ELSE w * stop END) AS target FROM o),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0::DOUBLE END AS rate,
      CAST(('0x' || substr(md5('7:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
