"""Applying corrections: the gate, the change log, undo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upland.functions.hours import valid_hours
from upland.streaming.queue import rolling_cap

# What may be changed, and how soon again.
ALLOWED = (("venues", "hours"), ("venues", "price_range"), ("destinations", "hours"))
COOLDOWN_DAYS = 7
TARGET = ["target_table", "slug", "field"]


def gate(proposals: DataFrame, reports: DataFrame, log: DataFrame, places: DataFrame, now: Column) -> DataFrame:
    """Proposals (id, target_table, slug, field, open, close, price_range) with their outcome, tested in order: the report is
    being checked, the field may change, the value is well formed, no standing change in the last 7 days, the place exists.
    Of several that pass for one target in a batch the first by id is applied and the rest meet its cooldown."""
    flag = lambda df, on, name: df.select(*on).distinct().withColumn(name, F.lit(True))
    checking = flag(reports.where("status = 'checking'"), ["id"], "_checking")
    recent = flag(log.where(F.col("undone_at").isNull() & (F.col("applied_at") > now - F.expr(f"INTERVAL {COOLDOWN_DAYS} DAYS"))), TARGET, "_recent")
    known = flag(places, ["target_table", "slug"], "_known")
    p = proposals.join(checking, "id", "left").join(recent, TARGET, "left").join(known, ["target_table", "slug"], "left")
    allowed = F.lit(False)
    for t, f in ALLOWED:
        allowed = allowed | ((F.col("target_table") == t) & (F.col("field") == f))
    value = F.when(F.col("field") == "hours", valid_hours("open", "close")).otherwise(F.coalesce(F.col("price_range").between(1, 4), F.lit(False)))
    outcome = (F.when(F.col("_checking").isNull(), "held: not checking").when(~allowed, "held: field").when(~value, "held: value")
               .when(F.col("_recent"), "held: cooldown").when(F.col("_known").isNull(), "held: place").otherwise("applied"))
    p = p.withColumn("outcome", outcome).drop("_checking", "_recent", "_known")
    first = p.where("outcome = 'applied'").groupBy(*TARGET).agg(F.min("id").alias("_first"))
    p = p.join(first, TARGET, "left")
    return p.withColumn("outcome", F.when((F.col("outcome") == "applied") & (F.col("id") != F.col("_first")), "held: cooldown").otherwise(F.col("outcome"))).drop("_first")


def replay_applied(history: DataFrame, row_id: str, ts: str) -> DataFrame:
    """History of proposals with `accepted`: only an applied change starts the 7-day cooldown of its target. The same
    recurrence as the hourly cap, with a cap of one."""
    return rolling_cap(history, TARGET, ts, row_id, 1, COOLDOWN_DAYS * 86_400)


def value_json() -> Column:
    return F.when(F.col("field") == "hours", F.to_json(F.struct("open", "close"))).otherwise(F.col("price_range").cast("string"))


def apply_changes(decided: DataFrame, places: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(places after, new log rows) of the applied proposals. Places carry target_table, slug, hours_json, price_range."""
    a = decided.where("outcome = 'applied'").withColumn("new_value", value_json())
    before = places.select("target_table", "slug", "hours_json", F.col("price_range").cast("string").alias("_p"))
    log = a.join(before, ["target_table", "slug"]).select(
        F.col("id").alias("correction_id"), *TARGET, F.when(F.col("field") == "hours", F.col("hours_json")).otherwise(F.col("_p")).alias("old_value"),
        "new_value", now.alias("applied_at"), F.lit(None).cast("timestamp").alias("undone_at"))
    return set_values(places, a.select(*TARGET, F.col("new_value").alias("_v"))), log


def set_values(places: DataFrame, values: DataFrame) -> DataFrame:
    """Places with the given values (target, _v) written over theirs; a null value is written too."""
    h = values.where("field = 'hours'").select("target_table", "slug", F.col("_v").alias("_h"), F.lit(True).alias("_has_h"))
    p = values.where("field = 'price_range'").select("target_table", "slug", F.col("_v").cast("int").alias("_p"), F.lit(True).alias("_has_p"))
    j = places.join(h, ["target_table", "slug"], "left").join(p, ["target_table", "slug"], "left")
    return j.withColumn("hours_json", F.when(F.col("_has_h"), F.col("_h")).otherwise(F.col("hours_json"))).withColumn(
        "price_range", F.when(F.col("_has_p"), F.col("_p")).otherwise(F.col("price_range"))).select(*places.columns)


def undo(log: DataFrame, change_ids: DataFrame, places: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places after, log after, errors). The old value comes back even when a later change stands; of several undone at
    once for one target the last by id wins. Asking for a change that is missing or already undone is an error row."""
    open_ = log.where(F.col("undone_at").isNull())
    asked = change_ids.select("id").distinct()
    hit = open_.join(asked, "id", "left_semi")
    errors = asked.join(hit.select("id"), "id", "left_anti").withColumn("error", F.lit("change not found or already undone"))
    back = hit.groupBy(*TARGET).agg(F.max_by("old_value", "id").alias("_v"))
    after = log.join(hit.select("id", F.lit(True).alias("_u")), "id", "left").withColumn("undone_at", F.when(F.col("_u"), now).otherwise(F.col("undone_at"))).select(*log.columns)
    return set_values(places, back), after, errors


def first_per_target(changes: DataFrame, order: str = "id") -> DataFrame:
    """One change per target inside a batch: the first by order, picked map-side before the shuffle."""
    rest = [c for c in changes.columns if c not in TARGET]
    return changes.groupBy(*TARGET).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_c")).select(*TARGET, "_c.*")
