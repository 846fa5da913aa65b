"""The report queue: caps, claims, the status machine, releases, replies, retention."""

from __future__ import annotations

import re
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upland.session import written

# Caps, retries, sweep sizes and ages.
HOURLY_CAP, DAILY_CAP, MAX_ATTEMPTS = 30, 60, 3
PER_SWEEP, REPLIES_PER_SWEEP = 3, 9
STUCK_MINUTES, CONTACT_DAYS, TEXT_MONTHS = 15, 90, 12
REMOVED_TEXT = "(deleted after 12 months)"
TOKEN = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def rolling_cap(rows: DataFrame, keys: list[str], ts: str, row_id: str, cap: int, window_s: int) -> DataFrame:
    """Rows with `accepted`: a row is accepted when fewer than cap accepted rows of its key lie in the trailing window
    (strictly after ts - window). Only accepted rows count, so acceptance is a recurrence in time order. Row ids differ.

    Time is cut into buckets one window long. Where a bucket and the one before hold at most cap rows together, every row
    of it is accepted whatever came earlier; those rows are settled by counting. What is left are runs of full buckets,
    each seeded by the settled bucket before it. With a cap of one a run is a chain of pointers, followed by doubling
    (`_hops`), so a busy key's rows spread over all tasks. With more, the next row depends on the last cap accepted ones
    together, and each run is folded in time order as its sorted rows stream past, holding cap timestamps and never the
    group."""
    width = window_s * 1_000_000
    r = rows.withColumn("_us", F.unix_micros(ts)).withColumn("_b", F.floor(F.col("_us") / width).cast("long"))
    n = r.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = n.select(*keys, (F.col("_b") + 1).alias("_b"), F.col("_n").alias("_p"))
    n = n.join(before, [*keys, "_b"], "left").withColumn("_full", F.col("_n") + F.coalesce("_p", F.lit(0)) > cap)
    full = n.where("_full")
    runs = full.withColumn("_run", F.col("_b") - F.row_number().over(Window.partitionBy(*keys).orderBy("_b"))).select(*keys, "_b", "_run")
    starts = runs.groupBy(*keys, "_run").agg((F.min("_b") - 1).alias("_b"))
    marked = r.join(n.select(*keys, "_b", "_full"), [*keys, "_b"])
    settled = marked.where("NOT _full")
    small = [*keys, "_b", "_us", row_id]
    work = marked.where("_full").select(*small).join(runs, [*keys, "_b"]).withColumn("_seed", F.lit(False))
    seeds = settled.select(*small).join(starts, [*keys, "_b"]).withColumn("_seed", F.lit(True))
    work = work.unionByName(seeds)
    if cap == 1:
        taken = _hops(work, [*keys, "_run"], row_id, width).withColumn("_t", F.lit(True))
        decided = marked.where("_full").join(taken, row_id, "left").withColumn("accepted", F.col("_t").isNotNull())
    else:
        decided = marked.where("_full").join(_fold(work, [*keys, "_run"], row_id, cap, width, rows.schema[row_id].dataType.simpleString()), row_id)
    return settled.withColumn("accepted", F.lit(True)).unionByName(decided.select(*settled.columns, "accepted")).select(*rows.columns, "accepted")


SLICE = 100_000                # rows that look for their next one together


def _hops(work: DataFrame, run: list[str], row_id: str, width: int) -> DataFrame:
    """Ids of the rows that chains of one accepted row a window go through. A chain starts at a run's first row; a row
    points to the first one at least a window later, which lies in the next bucket or first in the one after. Buckets are
    cut into slices of about SLICE rows, in which rows and those that look for them are sorted together; who finds none
    takes the first row of the next slice that has any. Pointers of 1, 2, 4, ... steps are written, and the chains are
    gone through from the longest to the shortest."""
    rows = written(work.select(*run, "_b", F.struct(F.col("_us").alias("us"), F.col(row_id).alias("id")).alias("_at")))
    parts = rows.groupBy(*run, "_b").agg(F.ceil(F.count("*") / SLICE).alias("_parts"))
    place = lambda us: F.floor((us - F.col("_b") * width) * F.col("_parts") / width)
    there = rows.join(parts, [*run, "_b"]).select(*run, "_b", place(F.col("_at.us")).alias("_s"), F.col("_at.us").alias("_when"), F.lit(1).alias("_row"), "_at")
    asking = rows.withColumn("_b", F.col("_b") + 1).join(parts, [*run, "_b"]).withColumn("_when", F.col("_at.us") + width)
    asking = asking.select(*run, "_b", place(F.col("_when")).alias("_s"), "_when", F.lit(0).alias("_row"), "_at")
    later = Window.partitionBy(*run, "_b", "_s").orderBy(F.desc("_when"), F.desc("_row"), F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    seen = there.unionByName(asking).withColumn("_next", F.last(F.when(F.col("_row") == 1, F.col("_at")), ignorenulls=True).over(later)).where("_row = 0")
    # the first row of the slices after each slice: one row a slice, so a run's slices are few
    first = there.groupBy(*run, "_b", "_s").agg(F.min("_at").alias("_first"))
    beyond = Window.partitionBy(*run).orderBy(F.desc("_b"), F.desc("_s"), "_has").rowsBetween(Window.unboundedPreceding, 0)
    spots = first.withColumn("_has", F.lit(1)).unionByName(asking.select(*run, "_b", "_s").distinct().withColumn("_first", F.lit(None).cast(first.schema["_first"].dataType)).withColumn("_has", F.lit(0)))
    spots = spots.withColumn("_other", F.last("_first", ignorenulls=True).over(beyond)).where("_has = 0").select(*run, "_b", "_s", "_other")
    found = seen.join(spots, [*run, "_b", "_s"]).select(F.col("_at.id").alias("id"), F.coalesce("_next", "_other").getField("id").alias("to")).where("to IS NOT NULL")
    longest = rows.groupBy(*run).agg((F.max("_b") - F.min("_b") + 1).alias("_k")).agg(F.max("_k")).first()[0] or 1
    steps = [written(found)]
    while 2 ** len(steps) < longest:
        last = steps[-1]
        steps.append(written(last.join(last.select(F.col("id").alias("to"), F.col("to").alias("on")), "to").select("id", F.col("on").alias("to"))))
    on_chain = rows.groupBy(*run).agg(F.min("_at").alias("_at")).select(F.col("_at.id").alias("id"))
    for step in reversed(steps):
        on_chain = written(on_chain.unionByName(on_chain.join(step, "id").select(F.col("to").alias("id"))))
    return on_chain.distinct().withColumnRenamed("id", row_id)


def _fold(work: DataFrame, run: list[str], row_id: str, cap: int, width: int, kind: str) -> DataFrame:
    work = work.select(F.xxhash64(*run).alias("_part"), F.to_json(F.struct(*run)).alias("_group"), "_us", row_id, "_seed")

    def fold(batches):
        group, recent = None, deque()
        for pdf in batches:
            ids, ok = [], []
            for g, us, i, seed in zip(pdf["_group"], pdf["_us"], pdf[row_id], pdf["_seed"]):
                if g != group:
                    group, recent = g, deque()
                while recent and recent[0] <= us - width:
                    recent.popleft()
                take = bool(seed) or len(recent) < cap
                if take:
                    recent.append(us)
                if not seed:
                    ids.append(i)
                    ok.append(take)
            yield pd.DataFrame({row_id: ids, "accepted": ok})

    return work.repartition("_part").sortWithinPartitions("_part", "_group", "_us", row_id).mapInPandas(fold, f"{row_id} {kind}, accepted boolean")


def recent_counts(rows: DataFrame, key: str, ts: str, now: Column) -> DataFrame:
    """Per key: rows in the last hour and the last day."""
    return rows.groupBy(key).agg(F.count_if(F.col(ts) > now - F.expr("INTERVAL 1 HOUR")).alias("last_hour"), F.count_if(F.col(ts) > now - F.expr("INTERVAL 1 DAY")).alias("last_day"))


def oldest(reports: DataFrame, status: str, limit: int) -> DataFrame:
    return reports.where(F.col("status") == status).orderBy("created_at", "id").limit(limit)


def claim(reports: DataFrame, now: Column, cap: int = DAILY_CAP) -> DataFrame:
    """Ids to check next: the oldest received, as many as the day's cap leaves. At most cap rows are ever ranked."""
    used = reports.agg(F.count_if(F.col("checked_at") > now - F.expr("INTERVAL 1 DAY")).alias("_used")).withColumn("_one", F.lit(1))
    first = oldest(reports, "received", cap).select("id", "created_at")
    ranked = first.withColumn("_r", F.row_number().over(Window.orderBy("created_at", "id"))).withColumn("_one", F.lit(1))
    return ranked.join(F.broadcast(used), "_one").where(F.col("_r") <= F.lit(cap) - F.col("_used")).select("id")


def fail(reports: DataFrame, failed: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Reports being checked whose check failed (id, error): back to received, or held at the third failure."""
    j = reports.join(failed.select("id", F.substring("error", 1, 300).alias("_e")), "id", "left")
    j = j.withColumn("_hit", F.col("_e").isNotNull() & (F.col("status") == "checking")).withColumn("_last", F.col("attempts") + 1 >= most)
    hit, last = F.col("_hit"), F.col("_last")
    return j.withColumn("status_note", F.when(hit & last, "The automatic check kept failing").otherwise(F.col("status_note"))).withColumn(
        "status", F.when(hit & last, "held").when(hit, "received").otherwise(F.col("status"))).withColumn(
        "last_error", F.when(hit, F.col("_e")).otherwise(F.col("last_error"))).withColumn(
        "attempts", F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts"))).select(*reports.columns)


def release_stuck(reports: DataFrame, now: Column, minutes: int = STUCK_MINUTES, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Checks older than `minutes` go back to received, or are held at the third attempt; `released` marks them."""
    stuck = (F.col("status") == "checking") & F.coalesce(F.col("checked_at") < now - F.make_interval(mins=F.lit(minutes)), F.lit(False))
    r = reports.withColumn("released", stuck)
    stuck, last = F.col("released"), F.col("attempts") + 1 >= most
    return r.withColumn("status", F.when(stuck & last, "held").when(stuck, "received").otherwise(F.col("status"))).withColumn(
        "attempts", F.when(stuck, F.col("attempts") + 1).otherwise(F.col("attempts"))).withColumn(
        "last_error", F.when(stuck, "stuck in checking").otherwise(F.col("last_error")))


def replay_status(log: DataFrame, key: str, ts: str, row_id: str, kind: str, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Final status of each report from its event log (received, failed, applied): the first of its first apply and its
    third failure decides. Per key only the least `most` failures are kept, and that pruning starts before the shuffle."""
    at = F.struct(ts, row_id)
    fails = log.where(F.col(kind) == "failed").select(key, at.alias("_at"))
    first = fails.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_at"))).where(F.col("_r") <= most)
    f = first.groupBy(key).agg(F.max(F.when(F.col("_r") == most, F.col("_at"))).alias("_third"), F.sort_array(F.collect_list("_at")).alias("_fails"))
    a = log.groupBy(key).agg(F.min(F.when(F.col(kind) == "applied", at)).alias("_applied"))
    j = a.join(f, key, "left")
    applied = F.col("_applied").isNotNull() & (F.col("_third").isNull() | (F.col("_applied") < F.col("_third")))
    fails_before = F.size(F.filter("_fails", lambda x: ~applied | (x < F.col("_applied"))))
    return j.select(key, F.when(applied, "applied").when(F.col("_third").isNotNull(), "held").otherwise("received").alias("status"),
                    F.when(F.col("_fails").isNull(), 0).otherwise(fails_before).alias("attempts"))


# -------------------------------------------------------------------- replies


def pending_replies(reports: DataFrame, limit: int = REPLIES_PER_SWEEP) -> DataFrame:
    return reports.where(F.col("status").isin("applied", "held") & F.col("replied_at").isNull() & F.col("reply_email").isNotNull()).orderBy("created_at", "id").limit(limit)


def claim_replies(reports: DataFrame, sent: DataFrame) -> DataFrame:
    """Replies due that were not sent before (sent: id): safe to run again on the same batch."""
    due = reports.where(F.col("status").isin("applied", "held") & F.col("replied_at").isNull() & F.col("reply_email").isNotNull())
    return due.join(sent.select("id"), "id", "left_anti")


def reply_text(wording: dict[str, tuple[str, str]]) -> tuple[Column, Column]:
    """Subject and body of each report's reply: `wording` has both for a status, with {column} where a value of the report
    goes in. Only columns that the wording names are shown; a status without wording gives null."""
    def filled(template: str) -> Column:
        parts = re.split(r"\{(\w+)\}", template)
        return F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])

    def of(which: int) -> Column:
        out = F.lit(None).cast("string")
        for status, texts in wording.items():
            out = F.when(F.col("status") == status, filled(texts[which])).otherwise(out)
        return out

    return of(0), of(1)


# ------------------------------------------------------------------ retention, status


def expire(reports: DataFrame, now: Column) -> DataFrame:
    """Contact cleared once resolved and answered (or with nothing to answer) or after 90 days; text replaced after 12 months."""
    has = F.col("reply_email").isNotNull() | F.col("reporter_name").isNotNull()
    done = F.col("resolved_at").isNotNull() & (F.col("replied_at").isNotNull() | F.col("reply_email").isNull())
    old = F.col("created_at") < now - F.expr(f"INTERVAL {CONTACT_DAYS} DAYS")
    clear = has & (done | old)
    gone = F.col("created_at") < now - F.expr(f"INTERVAL {TEXT_MONTHS} MONTHS")
    return reports.withColumn("message", F.when(gone, REMOVED_TEXT).otherwise(F.col("message"))).withColumn("_c", clear).withColumn(
        "reply_email", F.when(~F.col("_c"), F.col("reply_email"))).withColumn("reporter_name", F.when(~F.col("_c"), F.col("reporter_name"))).drop("_c")


def status_by_token(reports: DataFrame, tokens: DataFrame) -> DataFrame:
    """Public fields for well-formed tokens only."""
    return tokens.where(F.col("token").rlike(TOKEN)).join(reports.select("token", "status", "status_note", "created_at"), "token")


def queue_report(reports: DataFrame, now: Column) -> DataFrame:
    age = F.datediff(F.to_date(now), F.to_date("created_at"))
    return reports.groupBy("status", F.when(age < 1, "today").when(age < 7, "week").otherwise("older").alias("age")).agg(F.count("*").alias("n"))
