"""Structured Streaming jobs over the same rules as the batch functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from upland.functions.geo import round_half_up
from upland.schemas import SUBMISSION
from upland.streaming import queue as Q
from upland.streaming.submissions import parse


def read_submissions(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Form rows as a stream of JSON files with a fixed schema."""
    return spark.readStream.schema(SUBMISSION).option("maxFilesPerTrigger", files_per_batch).json(folder)


def parse_stream(forms: DataFrame) -> DataFrame:
    return parse(forms, F.unix_millis("received"))


def write_by_kind(parsed: DataFrame, root: str, checkpoint: str):
    """Valid, invalid and spam rows to a folder each. A batch's folder is named by its id and overwritten, so a batch that
    is run again after a lost executor or driver leaves the same rows."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{root}/batch={batch_id}")

    return parsed.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)


def cap_stream(rows: DataFrame, key: str, ts: str, row_id: str, cap: int = Q.HOURLY_CAP, window_s: int = 3600) -> DataFrame:
    """Rows of a stream with `accepted`, by the trailing cap per key. State is the accepted times of the last window, at most
    cap of them; a key's rows of a batch are taken in time order, and rows older than the newest already decided are placed
    at its time, as a queue would."""
    width = window_s * 1_000_000
    id_type = dict(rows.dtypes)[row_id]
    key_type = dict(rows.dtypes)[key]
    small = rows.select(key, row_id, F.unix_micros(ts).alias("us"))

    def decide(k, batches: Iterator[pd.DataFrame], state: GroupState):
        recent = list(state.get[0]) if state.exists else []
        clock = recent[-1] if recent else 0
        pdf = pd.concat(list(batches)).sort_values(["us", row_id])
        ids, ok = [], []
        for us, i in zip(pdf["us"], pdf[row_id]):
            clock = max(clock, int(us))
            recent = [t for t in recent if t > clock - width]
            take = len(recent) < cap
            if take:
                recent.append(clock)
            ids.append(i)
            ok.append(take)
        state.update((recent,))
        yield pd.DataFrame({key: [k[0]] * len(ids), row_id: ids, "accepted": ok})

    return small.groupBy(key).applyInPandasWithState(decide, f"{key} {key_type}, {row_id} {id_type}, accepted boolean", "times array<bigint>", "append", GroupStateTimeout.NoTimeout)


def status_stream(log: DataFrame, key: str, ts: str, row_id: str, kind: str, most: int = Q.MAX_ATTEMPTS) -> DataFrame:
    """Status after each batch of each report's events (received, failed, applied); events after an end are ignored."""
    key_type = dict(log.dtypes)[key]
    small = log.select(key, row_id, F.unix_micros(ts).alias("us"), F.col(kind).alias("what"))

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState):
        status, attempts = state.get if state.exists else ("received", 0)
        for what in pd.concat(list(batches)).sort_values(["us", row_id])["what"]:
            if status in ("applied", "held"):
                break
            if what == "applied":
                status = "applied"
            elif what == "failed":
                attempts += 1
                status = "held" if attempts >= most else "received"
        state.update((status, attempts))
        yield pd.DataFrame({key: [k[0]], "status": [status], "attempts": [attempts]})

    return small.groupBy(key).applyInPandasWithState(step, f"{key} {key_type}, status string, attempts int", "status string, attempts int", "update", GroupStateTimeout.NoTimeout)


def settled_views(views: DataFrame, user: str = "user_id", ts: str = "ts", quiet: str = "250 milliseconds", late: str | None = None) -> DataFrame:
    """The last view of each burst: views (west, south, east, north, zoom) of a user less than `quiet` apart form a session,
    its latest view is kept, bounds to 4 decimals and zoom to 1. A stream needs `late`, how long a view may be behind the
    newest one; what is later still is in no session, and `write_late` keeps it."""
    if views.isStreaming and late is None:
        raise ValueError("a stream needs late, and write_late for what comes later than that")
    v = views.withWatermark(ts, late) if views.isStreaming else views
    last = F.max_by(F.struct("west", "south", "east", "north", "zoom"), F.struct(*([F.col(ts)] if views.isStreaming else [F.col(ts), F.col("event_id")])))
    s = v.groupBy(F.col(user), F.session_window(ts, quiet).alias("_s")).agg(last.alias("_v"), F.count("*").alias("moves"))
    at = lambda c: round_half_up(F.col(f"_v.{c}"), 1e4).alias(c)
    return s.select(user, F.col("_s.start").alias("started"), "moves", at("west"), at("south"), at("east"), at("north"), round_half_up("_v.zoom", 10.0).alias("zoom"))


def write_late(views: DataFrame, late: str, root: str, checkpoint: str, ts: str = "ts"):
    """Rows of a stream that are more than `late` behind the newest row of the batches before, to root/late; the newest
    time so far stands in root/clock. A batch run again overwrites its own folders."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        clock = f"{root}/clock"
        before = spark.read.parquet(clock).where(F.col("batch") < batch_id).agg(F.max("newest").alias("n")).first()["n"] if exists(spark, clock) else None
        cut = F.lit(before) - F.expr(f"INTERVAL {late}") if before is not None else F.lit(None).cast("timestamp")
        batch.where(F.col(ts) < cut).write.mode("overwrite").parquet(f"{root}/late/batch={batch_id}")
        batch.agg(F.greatest(F.max(ts), F.lit(before).cast("timestamp")).alias("newest")).write.mode("overwrite").parquet(f"{clock}/batch={batch_id}")

    return views.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is made once: what is there already is read, so a step run again repeats nothing."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def sweep(reports: DataFrame, sent: DataFrame, now: Column, check: Callable[[DataFrame], DataFrame], send: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """One sweep: (reports after releasing stuck checks, summary by step and outcome). `check` maps the oldest reports to
    (id, outcome), `send` the pending replies to (id, outcome)."""
    freed = Q.release_stuck(reports, now)
    checked = check(Q.oldest(freed.drop("released"), "received", Q.PER_SWEEP))
    replies = send(Q.pending_replies(Q.claim_replies(freed, sent)))
    count = lambda df, step: df.groupBy(F.lit(step).alias("step"), "outcome").agg(F.count("*").alias("n"))
    summary = count(freed.where("released").withColumn("outcome", F.col("status")), "released").union(count(checked, "checked")).union(count(replies, "reply"))
    return freed.drop("released"), summary


def sent_replies(spark: SparkSession, root: str, ids) -> DataFrame:
    """Ids of replies claimed in an outbox and not given back because sending failed."""
    if not exists(spark, f"{root}/replies"):
        return spark.createDataFrame([], f"id {ids}")
    claimed = spark.read.parquet(f"{root}/replies").select("id", "batch")
    if not exists(spark, f"{root}/results"):
        return claimed.select("id")
    failed = spark.read.parquet(f"{root}/results").where("outcome <> 'sent'").select("id", "batch")
    return claimed.join(failed, ["id", "batch"], "left_anti").select("id")


def kept_sweep(reports: DataFrame, root: str, batch_id: int, now: Column, check: Callable[[DataFrame], DataFrame], send: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """One sweep whose every step is written under `root` by batch id before the next one acts on it: the reports claimed for
    checking, the outcomes of their checks, the replies claimed for sending, the results of sending. (changes to the reports,
    summary). A reply is sent from its claim and claimed once, so neither a retry nor a second sweep sends it again; one
    whose sending failed is given back. `check` and `send` map rows to (id, outcome)."""
    spark, kind = reports.sparkSession, reports.schema["id"].dataType.simpleString()
    at = lambda step: f"{root}/{step}/batch={batch_id}"
    freed = Q.release_stuck(reports, now)
    claimed = once(spark, at("checks"), lambda: Q.oldest(freed.drop("released"), "received", Q.PER_SWEEP))
    outcomes = once(spark, at("outcomes"), lambda: check(claimed).select("id", "outcome"))
    replies = once(spark, at("replies"), lambda: Q.pending_replies(Q.claim_replies(freed.drop("released"), sent_replies(spark, root, kind))))
    results = once(spark, at("results"), lambda: send(replies).select("id", "outcome"))
    done = F.col("outcome").isin("applied", "held")
    after = freed.where("released").select("id", "status", "attempts", F.lit(None).cast("timestamp").alias("checked_at"), F.lit(None).cast("timestamp").alias("replied_at"))
    after = after.join(outcomes.select("id"), "id", "left_anti")
    checked = claimed.join(outcomes, "id").select("id", F.when(done, F.col("outcome")).otherwise("received").alias("status"), (F.col("attempts") + F.when(done, 0).otherwise(1)).alias("attempts"), now.alias("checked_at"), F.lit(None).cast("timestamp").alias("replied_at"))
    replied = replies.join(results.where("outcome = 'sent'").select("id"), "id", "left_semi").select("id", "status", "attempts", F.lit(None).cast("timestamp").alias("checked_at"), now.alias("replied_at"))
    changes = once(spark, at("changes"), lambda: after.unionByName(checked).unionByName(replied))
    count = lambda df, step: df.groupBy(F.lit(step).alias("step"), "outcome").agg(F.count("*").alias("n"))
    summary = count(freed.where("released").withColumn("outcome", F.col("status")), "released").union(count(outcomes, "checked")).union(count(results, "reply"))
    return changes, once(spark, at("summary"), lambda: summary)


def apply_sweeps(reports: DataFrame, root: str) -> DataFrame:
    """The reports with the changes of all sweeps so far, the latest of each report winning."""
    spark = reports.sparkSession
    if not exists(spark, f"{root}/changes"):
        return reports
    c = spark.read.parquet(f"{root}/changes")
    last = c.groupBy("id").agg(F.max_by(F.struct("status", "attempts"), "batch").alias("_s"), F.max("checked_at").alias("_c"), F.max("replied_at").alias("_r"))
    j = reports.join(last, "id", "left")
    fresh = {"status": F.coalesce("_s.status", "status"), "attempts": F.coalesce("_s.attempts", "attempts"), "checked_at": F.coalesce("_c", "checked_at"), "replied_at": F.coalesce("_r", "replied_at")}
    return j.withColumns({c: e.cast(reports.schema[c].dataType) for c, e in fresh.items()}).select(*reports.columns)


def sweep_stream(ticks: DataFrame, load: Callable[[], DataFrame], check, send, root: str, checkpoint: str, every: str = "15 minutes"):
    """A kept sweep every 15 minutes over the reports as the sweeps so far have left them."""

    def run(_: DataFrame, batch_id: int) -> None:
        kept_sweep(apply_sweeps(load(), root), root, batch_id, F.current_timestamp(), check, send)

    return ticks.writeStream.foreachBatch(run).trigger(processingTime=every).option("checkpointLocation", checkpoint)
