"""Exact quantiles without gathering or sorting a group.

The ranks asked for are closed in on by counting: the values' span is cut into SLICES equal slices, counted with partial
sums, and only the slice that holds a rank is looked at again, between the least and greatest value it has. After ROUNDS
such passes what is left of a group of n spread-out values is about n / SLICES**ROUNDS rows, which are numbered in order.
Uneven values only leave more rows for that last step, never a wrong rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from upland.session import written

SLICES, ROUNDS = 4096, 2


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], names: list[str]) -> DataFrame:
    """Per group the quantiles at `shares` under `names`, between two neighbouring values in proportion, and `n`, the
    number of values. Null values do not count; a group without values has no row. `by` may be empty."""
    keys = [f"_k{i}" for i in range(len(by))]
    v = written(df.where(F.col(value).isNotNull()).select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.lit(0).alias("_all"), F.col(value).cast("double").alias("_v")))
    on = [*keys, "_all"]
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in on]
    stats = v.groupBy(*on).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    at = lambda s: (F.col("_n") - 1) * F.lit(float(s))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(at(s)), F.ceil(at(s))) for s in shares])))
    asked = stats.select(*on, "_lo", "_hi", F.lit(0).cast("long").alias("_before"), F.explode(ranks).alias("_rank"))
    for _ in range(ROUNDS):
        spans = asked.select(*on, "_lo", "_hi").distinct()
        rows = v.alias("v").join(spans.alias("s"), [*same("v", "s"), F.col("_v").between(F.col("_lo"), F.col("_hi"))]).select("s.*", "_v")
        slice_ = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * SLICES), F.lit(SLICES - 1))).otherwise(0)
        counts = rows.groupBy(*on, "_lo", slice_.alias("_s")).agg(F.count("*").alias("_c"), F.min("_v").alias("_l"), F.max("_v").alias("_h"))
        below = F.coalesce(F.sum("_c").over(Window.partitionBy(*on, "_lo").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("_below", below)
        hit = [*same("a", "c"), F.col("a._lo") == F.col("c._lo"), F.col("_rank") >= F.col("_before") + F.col("_below"), F.col("_rank") < F.col("_before") + F.col("_below") + F.col("_c")]
        asked = asked.alias("a").join(counts.alias("c"), hit).select(*[f"a.{k}" for k in on], F.col("_l").alias("_lo"), F.col("_h").alias("_hi"), (F.col("_before") + F.col("_below")).alias("_before"), "_rank")
    asked = written(asked)
    spans = asked.where("_lo < _hi").select(*on, "_lo", "_hi", "_before").distinct()
    rows = v.alias("v").join(spans.alias("s"), [*same("v", "s"), F.col("_v").between(F.col("_lo"), F.col("_hi"))]).select("s.*", "_v")
    number = F.row_number().over(Window.partitionBy(*on, "_lo").orderBy("_v")) - 1 + F.col("_before")
    numbered = rows.withColumn("_rank", number).select(*on, "_rank", "_v")
    found = asked.where("_lo = _hi").select(*on, "_rank", F.col("_lo").alias("_v")).unionByName(
        numbered.alias("v").join(asked.where("_lo < _hi").alias("a"), [*same("v", "a"), F.col("v._rank") == F.col("a._rank")], "left_semi"))
    of_rank = found.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_m"))           # at most two ranks a share
    out = stats.alias("t").join(of_rank.alias("m"), same("t", "m")).select(*[f"t.{k}" for k in keys], "_n", "_m")
    value_at = lambda s: F.col("_m")[F.floor(at(s))] + (F.col("_m")[F.ceil(at(s))] - F.col("_m")[F.floor(at(s))]) * (at(s) - F.floor(at(s)))
    return out.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], *[value_at(s).alias(n) for s, n in zip(shares, names)], F.col("_n").alias("n"))
