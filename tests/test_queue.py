"""Caps, status machine, audit log and retention against plain folds."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from upland.streaming import audit as A, queue as Q, submissions as S

T0 = dt.datetime(2024, 1, 1)


def fold(rows, cap, width):
    out, seen = {}, {}
    for k, ts, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        recent = [t for t in seen.get(k, []) if t > ts - dt.timedelta(seconds=width)]
        out[i] = len(recent) < cap
        if out[i]:
            recent.append(ts)
        seen[k] = recent
    return out


def test_rolling_cap_equals_fold(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        k = 0 if i % 3 == 0 else rng.randrange(1, 12)
        at = rng.choice([rng.uniform(0, 3600 * 30), rng.gauss(40_000, 900), 3600.0 * rng.randrange(30)])
        rows.append((k, T0 + dt.timedelta(seconds=int(max(0, at))), i))
    d = spark.createDataFrame(rows, "k int, ts timestamp, id int")
    for cap in (1, 5, 30):
        got = {r["id"]: r["accepted"] for r in Q.rolling_cap(d, ["k"], "ts", "id", cap, 3600).collect()}
        assert got == fold(rows, cap, 3600)
    one = {r["id"]: r["accepted"] for r in Q.rolling_cap(d.repartition(1), ["k"], "ts", "id", 5, 3600).collect()}
    assert one == fold(rows, 5, 3600)


@pytest.mark.parametrize("slice_", [7, 100_000])
def test_cap_of_one_by_pointers(spark, monkeypatch, slice_):
    """Three busy keys, times that tie and that stand exactly a window apart, in slices with and without rows."""
    monkeypatch.setattr(Q, "SLICE", slice_)
    rng = random.Random(8)
    rows = []
    for i in range(4000):
        k = rng.randrange(3) if i % 10 else 3 + rng.randrange(40)
        at = rng.choice([rng.uniform(0, 3600 * 60), 3600.0 * rng.randrange(60), 900.0 * rng.randrange(240), rng.gauss(90_000, 300)])
        rows.append((k, T0 + dt.timedelta(seconds=max(0.0, round(at, 3))), i))
    d = spark.createDataFrame(rows, "k int, ts timestamp, id int")
    got = {r["id"]: r["accepted"] for r in Q.rolling_cap(d, ["k"], "ts", "id", 1, 3600).collect()}
    assert got == fold(rows, 1, 3600) and len(got) == len(rows)
    assert Q.rolling_cap(d.limit(0), ["k"], "ts", "id", 1, 3600).collect() == []


REPORT = ("id long, created_at timestamp, page_path string, message string, reply_email string, replied_at timestamp, reporter_name string, resolved_at timestamp, "
          "status string, token string, status_note string, checked_at timestamp, attempts int, last_error string")


def report(i, status="received", **kw):
    base = dict(id=i, created_at=T0, page_path="/", message="text", reply_email="r@example.test", replied_at=None, reporter_name="Ana", resolved_at=None, status=status, token=str(i), status_note=None,
                checked_at=None, attempts=0, last_error=None)
    base.update(kw)
    return tuple(base.values())


def test_three_failures_hold(spark):
    d = spark.createDataFrame([report(1, "checking"), report(2)], REPORT)
    bad = spark.createDataFrame([(1, "timeout"), (2, "timeout")], "id long, error string")
    for n in (1, 2, 3):
        d = Q.fail(d, bad)
        row = {r["id"]: r for r in d.collect()}
        assert row[1]["attempts"] == n and row[2]["attempts"] == 0
        assert row[1]["status"] == ("held" if n == 3 else "received")
        d = spark.createDataFrame([tuple({**r.asDict(), "status": "checking" if r["id"] == 1 else r["status"]}.values()) for r in row.values()], REPORT)
    assert row[1]["status_note"] == "The automatic check kept failing"


def test_claim_leaves_the_days_cap(spark):
    now = T0 + dt.timedelta(days=2)
    rows = [report(i, created_at=T0 + dt.timedelta(minutes=i)) for i in range(20)] + [report(100 + i, "applied", checked_at=now - dt.timedelta(hours=1)) for i in range(4)]
    got = sorted(r["id"] for r in Q.claim(spark.createDataFrame(rows, REPORT), F.lit(now), 7).collect())
    assert got == [0, 1, 2]


PLACE = "target_table string, slug string, hours_json string, price_range int"


def test_apply_cooldown_and_undo(spark):
    now = F.lit(T0 + dt.timedelta(days=10))
    places = spark.createDataFrame([("venues", "cafe", '{"open":"07:00","close":"20:00"}', 2), ("destinations", "park", None, None)], PLACE)
    log = spark.createDataFrame([(1, 9, "venues", "cafe", "price_range", "3", "2", T0 + dt.timedelta(days=8), None)],
                                "id long, correction_id long, target_table string, slug string, field string, old_value string, new_value string, applied_at timestamp, undone_at timestamp")
    rep = spark.createDataFrame([(i, "checking") for i in range(1, 9)], "id long, status string")
    prop = spark.createDataFrame([(1, "venues", "cafe", "hours", "08:00", "21:00", None), (2, "venues", "cafe", "hours", "09:00", "21:00", None), (3, "venues", "cafe", "price_range", None, None, 4),
                                  (4, "venues", "none", "hours", "08:00", "21:00", None), (5, "destinations", "park", "price_range", None, None, 1), (6, "destinations", "park", "hours", "8", "9", None),
                                  (99, "destinations", "park", "hours", "08:00", "09:00", None), (7, "destinations", "park", "hours", "08:00", "09:00", None)],
                                 "id long, target_table string, slug string, field string, open string, close string, price_range int")
    g = A.gate(prop, rep, log, places, now)
    assert {r["id"]: r["outcome"] for r in g.collect()} == {1: "applied", 2: "held: cooldown", 3: "held: cooldown", 4: "held: place", 5: "held: field", 6: "held: value", 99: "held: not checking", 7: "applied"}
    after, new = A.apply_changes(g, places, now)
    assert {r["slug"]: r["hours_json"] for r in after.collect()} == {"cafe": '{"open":"08:00","close":"21:00"}', "park": '{"open":"08:00","close":"09:00"}'}
    rows = {r["slug"]: r for r in new.collect()}
    assert rows["cafe"]["old_value"] == '{"open":"07:00","close":"20:00"}' and rows["park"]["old_value"] is None
    ids = spark.createDataFrame([(1,), (77,)], "id long")
    back, logged, errors = A.undo(log, ids, places, now)
    assert {r["slug"]: r["price_range"] for r in back.collect()}["cafe"] == 3
    assert [r["id"] for r in errors.collect()] == [77] and logged.first()["undone_at"] is not None
    assert [r["id"] for r in A.undo(logged, ids, places, now)[2].orderBy("id").collect()] == [1, 77]


def test_expiry(spark):
    now = F.lit(T0 + dt.timedelta(days=400))
    recent = T0 + dt.timedelta(days=390)
    rows = [report(1), report(2, created_at=recent), report(3, created_at=recent, resolved_at=recent), report(4, created_at=recent, resolved_at=recent, replied_at=recent), report(5, created_at=recent, resolved_at=recent, reply_email=None)]
    got = {r["id"]: (r["message"], r["reply_email"], r["reporter_name"]) for r in Q.expire(spark.createDataFrame(rows, REPORT), now).collect()}
    assert got == {1: (Q.REMOVED_TEXT, None, None), 2: ("text", "r@example.test", "Ana"), 3: ("text", "r@example.test", "Ana"), 4: ("text", None, None), 5: ("text", None, None)}


def test_routing_uses_the_strong_scorer_once(spark):
    rows = [(1, "/eat-stay", "Opens at 8:00 am now."), (2, "/map", "Opens at 8:00 am now."), (3, "/eat-stay", "Please rename this place."), (4, "/eat-stay", "Closed on Mondays.")]
    d = spark.createDataFrame(rows, "id int, page string, message string")
    cheap = lambda df: df.select("id", F.when(F.col("id") == 1, "proposed").otherwise("held").alias("outcome"))
    strong = lambda df: df.select("id", F.lit("proposed").alias("outcome"))
    got = {r["id"]: (r["outcome"], r["scored_by"]) for r in S.route(d, cheap, strong).collect()}
    assert got == {1: ("proposed", "cheap"), 2: ("proposed", "strong"), 3: ("held", "cheap"), 4: ("proposed", "strong after cheap")}


def test_reply_wording_is_the_callers(spark):
    rows = spark.createDataFrame([("applied", "/a", "done"), ("held", "/b", "secret"), ("received", "/c", None)], "status string, page_path string, status_note string")
    subject, body = Q.reply_text({"applied": ("Fixed", "{page_path}: {status_note}"), "held": ("Waiting", "{page_path} is read by a person")})
    assert [tuple(r) for r in rows.select(subject, body).collect()] == [("Fixed", "/a: done"), ("Waiting", "/b is read by a person"), (None, None)]
