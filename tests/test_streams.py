"""The streaming jobs give what the batch rules give."""

import datetime as dt
import json
import random
import time

from pyspark.sql import functions as F

from upland.streaming import jobs as J
from upland.streaming import queue as Q

T0 = dt.datetime(2024, 1, 1)


def run(query):
    query.processAllAvailable()
    query.stop()


def stream_of(spark, folder, schema, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
        del i
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_cap_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted((T0 + dt.timedelta(seconds=rng.randrange(20_000)), i % 3, i) for i in range(400))
    rows = [(k, ts, i) for ts, k, i in rows]
    schema = "k int, ts timestamp, id int"
    s = stream_of(spark, tmp_path / "in", schema, [rows[:150], rows[150:300], rows[300:]])
    q = J.cap_stream(s, "k", "ts", "id", 10, 3600).writeStream.format("memory").queryName("cap_out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    run(q)
    got = {r["id"]: r["accepted"] for r in spark.table("cap_out").collect()}
    want = {r["id"]: r["accepted"] for r in Q.rolling_cap(spark.createDataFrame(rows, schema), ["k"], "ts", "id", 10, 3600).collect()}
    assert got == want and not all(got.values())


def test_status_stream_equals_replay(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i % 9, T0 + dt.timedelta(minutes=i), i, rng.choice(["failed", "failed", "received", "applied"])) for i in range(120)]
    schema = "k int, ts timestamp, id int, what string"
    s = stream_of(spark, tmp_path / "in", schema, [rows[:50], rows[50:]])
    q = J.status_stream(s, "k", "ts", "id", "what").writeStream.format("memory").queryName("status_out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("update").start()
    run(q)
    want = {r["k"]: (r["status"], r["attempts"]) for r in Q.replay_status(spark.createDataFrame(rows, schema), "k", "ts", "id", "what").collect()}
    got = {r["k"]: (r["status"], r["attempts"]) for r in spark.table("status_out").collect()}
    last = {}
    for r in spark.table("status_out").collect():
        old = last.get(r["k"])
        if old is None or r["attempts"] > old[1] or r["status"] != "received":
            last[r["k"]] = (r["status"], r["attempts"])
    assert last == want and set(got) == set(want)


def test_submissions_split_and_rerun(spark, tmp_path):
    src = tmp_path / "forms"
    src.mkdir()
    forms = [{"id": i, "received": "2024-01-01T00:00:10Z", "website": "x" if i == 1 else "", "startedAt": "1704067200000", "page": "/eat-stay", "message": "bad" if i == 2 else "Closed on Mondays now.", "email": "a@b.test"} for i in range(4)]
    (src / "a.json").write_text("\n".join(json.dumps(f) for f in forms))
    for _ in range(2):
        out = tmp_path / "out"
        q = J.write_by_kind(J.parse_stream(J.read_submissions(spark, str(src))), str(out), str(tmp_path / f"cp{_}")).start()
        run(q)
    got = {r["id"]: r["kind"] for r in spark.read.parquet(str(out / "batch=0")).collect()}
    assert got == {0: "valid", 1: "spam", 2: "invalid", 3: "valid"}


def test_settled_views_stream(spark, tmp_path):
    ms = lambda m: T0 + dt.timedelta(milliseconds=m)
    row = lambda u, m, z: (u, ms(m), 120.50004, 16.3, 120.6, 16.4, z)
    schema = "user_id int, ts timestamp, west double, south double, east double, north double, zoom double"
    rows = [row(1, 0, 12.04), row(1, 100, 13.06), row(1, 900, 14.0), row(2, 50, 11.0)]
    s = stream_of(spark, tmp_path / "in", schema, [rows, [row(3, 60_000, 9.0)]])
    q = J.settled_views(s, late="10 seconds").writeStream.format("memory").queryName("views_out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    run(q)
    got = sorted((r["user_id"], r["moves"], r["zoom"], r["west"]) for r in spark.table("views_out").collect())
    assert got == [(1, 1, 14.0, 120.5), (1, 2, 13.1, 120.5), (2, 1, 11.0, 120.5)]


def test_sweep_stream_writes_a_summary(spark, tmp_path):
    rep = spark.createDataFrame([(i, T0, "checking", T0, 2 if i == 0 else 0, "e@x.test", None, "/", None, None) for i in range(3)],
                                "id int, created_at timestamp, status string, checked_at timestamp, attempts int, reply_email string, replied_at timestamp, page_path string, status_note string, last_error string")
    done = lambda df: df.select("id", F.lit("done").alias("outcome"))
    _, summary = J.sweep(rep, rep.limit(0).select("id"), F.lit(T0 + dt.timedelta(hours=1)), done, done)
    assert {(r["step"], r["outcome"]): r["n"] for r in summary.collect()} == {("released", "held"): 1, ("released", "received"): 2, ("checked", "done"): 2, ("reply", "done"): 1}
    src = tmp_path / "ticks"
    stream = stream_of(spark, src, "t int", [[(1,)]])
    q = J.sweep_stream(stream, lambda: rep, done, done, str(tmp_path / "out"), str(tmp_path / "cp"), every="1 second").start()
    run(q)
    assert spark.read.parquet(str(tmp_path / "out" / "summary" / "batch=0")).count() == 4


def test_sweeps_keep_their_results(spark, tmp_path):
    """Two sweeps, the second one run twice: each reply is sent once, but for one that failed and is sent again."""
    rows = [(i, T0 + dt.timedelta(minutes=i), ["applied", "held", "received"][i % 3], None, 0, f"e{i}@x.test", None, "/", None, None) for i in range(36)]
    rep = spark.createDataFrame(rows, "id int, created_at timestamp, status string, checked_at timestamp, attempts int, reply_email string, replied_at timestamp, page_path string, status_note string, last_error string")
    root, sent = str(tmp_path / "outbox"), []

    def send(df):
        ids = [r["id"] for r in df.collect()]
        sent.extend(ids)
        return spark.createDataFrame([(i, "failed" if i == 4 and sent.count(4) == 1 else "sent") for i in ids], "id int, outcome string")

    check = lambda df: df.select("id", F.when(F.col("id") % 2 == 0, "applied").otherwise("error").alias("outcome"))
    for batch in (0, 1, 1, 2, 3):
        J.kept_sweep(J.apply_sweeps(rep, root), root, batch, F.lit(T0 + dt.timedelta(hours=1)), check, send)
    assert sorted(sent) == sorted([*set(sent), 4]) and len(sent) > 20
    after = {r["id"]: r for r in J.apply_sweeps(rep, root).collect()}
    assert all(after[i]["replied_at"] is not None for i in set(sent)) and after[2]["status"] == "applied" and after[5]["attempts"] >= 1


def test_late_views_are_kept(spark, tmp_path):
    at = lambda s: (1, T0 + dt.timedelta(seconds=s))
    s = stream_of(spark, tmp_path / "in", "user_id int, ts timestamp", [[at(0), at(100)], [at(95), at(20)], [at(300), at(91)]])
    run(J.write_late(s, "10 seconds", str(tmp_path / "out"), str(tmp_path / "cp")).start())
    assert [r["ts"] for r in spark.read.parquet(str(tmp_path / "out" / "late")).collect()] == [at(20)[1]]
