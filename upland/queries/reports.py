"""Reports, queue, audit log and views, on the events and pages tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from upland.functions import text
from upland.queries import query
from upland.session import shared_folder
from upland.queries.places import _TEXT
from upland.queries.tables import DEST, EV, VEN, rnd, with_
from upland.streaming import audit as A
from upland.streaming import jobs as J
from upland.streaming import queue as Q
from upland.streaming import submissions as S

NOW = "TIMESTAMP '2024-01-28 12:00:00'"
now = lambda: F.expr(NOW)

MESSAGES = ("Now opens at 8:00 am and closes at 9:00 pm.", "Opens at 9 am now, and a meal costs about 500 pesos.", "Please rename this park.",
            "Open 8:00 am to 5:00 pm on weekdays, 10:00 am to 9:00 pm on weekends.", "short", "Closed on Mondays. ")
_pick = lambda k, values: f"(CASE {k} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END)"
_FORM = f"""SELECT event_id AS id, ts, user_id, CASE WHEN event_id % 19 = 0 THEN 'x' ELSE '' END AS website,
  CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'abc' WHEN event_id % 11 = 0 THEN '9999000' ELSE '9990000' END AS started,
  CASE event_id % 5 WHEN 0 THEN '/destinations/place-' || user_id WHEN 1 THEN '/eat-stay' WHEN 2 THEN ' /map ' WHEN 3 THEN '' ELSE 'bad' END AS page,
  CASE WHEN event_id % 23 = 0 THEN repeat('x', 450) ELSE {_pick('event_id % 6', MESSAGES)} END AS message,
  CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'someone@' ELSE 'r' || user_id || '@example.test' END AS email,
  CASE WHEN event_id % 29 = 0 THEN repeat('n', 81) ELSE '  Ana ' END AS name, CASE event_id % 8 WHEN 0 THEN 'http://example.org/x' WHEN 1 THEN 'https://example.org/hours' ELSE '' END AS link
  FROM {{src}}"""
FORM = f"form AS ({_FORM.format(src='events')})"
PARSED = """pf AS (SELECT *, CASE WHEN website <> '' THEN 'spam' WHEN started = 'abc' OR started = '9999000' THEN 'spam' WHEN e1 + e2 + e3 + e4 + e5 > 0 THEN 'invalid' ELSE 'valid' END AS kind FROM (SELECT *,
  CAST(NOT starts_with(pg, '/') AS INT) AS e1, CAST(length(trim(message)) < 10 AS INT) AS e2, CAST(email = '' OR email = 'someone@' AS INT) AS e3, CAST(link = 'http://example.org/x' AS INT) AS e4, CAST(length(trim(name)) > 80 AS INT) AS e5
  FROM (SELECT *, CASE WHEN trim(page) = '' THEN '/' ELSE trim(page) END AS pg FROM form)))"""


def forms(t):
    d = t.spark.sql(_FORM.format(src="{t}"), t=t.raw("events"))
    return d.withColumnRenamed("started", "startedAt")


def parsed(t):
    return S.parse(forms(t), F.lit(10_000_000.0))


@query("F15_parse_submission", with_(FORM, PARSED) + "SELECT id, kind, pg AS page, trim(message) AS message, CAST(e1 + e2 + e3 + e4 + e5 AS INTEGER) AS errors FROM pf")
def _(t):
    return parsed(t).select("id", "kind", "page", "message", F.size("errors").alias("errors"))


@query("S11_submissions", with_(FORM, PARSED) + "SELECT kind, count(*) AS n FROM pf GROUP BY kind")
def _(t):
    return parsed(t).groupBy("kind").agg(F.count("*").alias("n"))


@query("T1_submission_stream", with_(FORM, PARSED) + "SELECT kind, count(*) AS n FROM pf GROUP BY kind")
def _(t):
    """The same forms as a stream: parsed, written to a folder of each kind, and read back."""
    from uuid import uuid4

    from upland.session import shared_folder
    root = f"{shared_folder(t.spark)}/submissions/{uuid4().hex}"
    rows = t.spark.readStream.schema(t.spark.read.parquet(f"{t.folder}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    rows.createOrReplaceTempView("event_stream")
    stream = S.parse(t.spark.sql(_FORM.format(src="event_stream")).withColumnRenamed("started", "startedAt"), F.lit(10_000_000.0))
    J.write_by_kind(stream, f"{root}/out", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{root}/out").groupBy("kind").agg(F.count("*").alias("n"))


_DIFF = """df AS (SELECT *, (CASE WHEN NOT (regexp_matches(pg, '^/destinations/[a-z0-9-]+$') OR pg = '/eat-stay') THEN 1 ELSE 0 END) AS r1, CASE WHEN length(m) > 400 THEN 1 ELSE 0 END AS r2, CASE WHEN k = 3 THEN 1 ELSE 0 END AS r3, CASE WHEN k = 1 THEN 1 ELSE 0 END AS r4, k IN (0, 1, 3, 5) AS in_scope
  FROM (SELECT *, trim(message) AS m, CASE WHEN id % 23 = 0 THEN 9 ELSE id % 6 END AS k FROM pf))"""


@query("F16_difficulty", with_(FORM, PARSED, _DIFF) + "SELECT id, r1 + r2 + r3 + r4 > 0 AS hard, in_scope, CAST(r1 + r2 + r3 + r4 AS INTEGER) AS reasons FROM df")
def _(t):
    d = parsed(t).select("id", S.difficulty().alias("d"))
    return d.select("id", "d.hard", "d.in_scope", F.size("d.reasons").alias("reasons"))


@query("F17_route_report", with_(FORM, PARSED, _DIFF) + """SELECT scored_by, outcome, count(*) AS n FROM (SELECT CASE WHEN r1 + r2 + r3 + r4 > 0 THEN 'strong' WHEN id % 2 = 0 OR NOT in_scope THEN 'cheap' ELSE 'strong after cheap' END AS scored_by,
  CASE WHEN r1 + r2 + r3 + r4 > 0 THEN CASE WHEN id % 3 = 0 THEN 'proposed' ELSE 'held' END WHEN id % 2 = 0 THEN 'proposed' WHEN NOT in_scope THEN 'held' WHEN id % 3 = 0 THEN 'proposed' ELSE 'held' END AS outcome FROM df WHERE kind = 'valid') GROUP BY 1, 2""")
def _(t):
    score = lambda k: (lambda df: df.select("id", F.when(F.col("id") % k == 0, "proposed").otherwise("held").alias("outcome")))
    d = S.route(parsed(t).where("kind = 'valid'"), score(2), score(3))
    return d.groupBy("scored_by", "outcome").agg(F.count("*").alias("n"))


@query("E45_check_verdict", """SELECT id, outcome, CASE WHEN outcome = 'held' THEN note END AS note FROM (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'held' WHEN event_id % 3 = 0 OR event_id % 5 = 0 OR event_id % 7 = 0 THEN 'held' ELSE 'proposed' END AS outcome,
  CASE WHEN event_id % 2 = 1 THEN 'The check''s answer was incomplete.' WHEN event_id % 4 = 0 THEN 'No public page confirms it.' ELSE repeat('n', 300) END AS note FROM events)""")
def _(t):
    i = F.col("event_id")
    v = t.events.select(
        i.alias("id"), F.when(i % 2 == 0, "held").otherwise("proposed").alias("outcome"), F.when(i % 4 == 0, "").otherwise(F.repeat(F.lit("n"), 400)).alias("note"), F.when(i % 3 == 0, "routes").otherwise("venues").alias("table"), F.lit("cafe").alias("slug"),
        F.when(i % 11 == 0, "price_range").otherwise("hours").alias("field"), F.when(i % 5 == 0, "8:00").otherwise("08:00").alias("open"), F.lit("21:00").alias("close"), F.when(i % 5 == 0, 9).otherwise(2).alias("price_range"),
        F.lit("https://example.org/cafe").alias("source_url"), F.when(i % 7 == 0, "too short").otherwise("We are open daily from 8:00 am to 9:00 pm.").alias("quote"))
    return S.check_verdict(v).select("id", "outcome", "note")


_NORM = lambda x: f"trim(regexp_replace(lower({x}), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ')"


@query("J23_quote_check", f"""SELECT page_id, part, part <> 2 AND length(trim(substr(p, CAST((page_id * 7919 + part * 104729) % greatest(length(p) - 40, 1) + 1 AS BIGINT), 40))) >= 20 AS quoted FROM (SELECT page_id, {_NORM(_TEXT.format(h='html'))} AS p FROM pages), (VALUES (0), (1), (2)) v(part)""")
def _(t):
    """Quotes from anywhere in a page, at a place its number names; the third of each page has words added."""
    page = text.normalise(text.html_to_text("html"))
    at = lambda k: ((F.col("page_id") * 7919 + k * 104729) % F.greatest(F.length("p") - 40, F.lit(1)) + 1).cast("int")
    parts = F.array(*[F.struct(F.lit(k).alias("part"), F.concat(F.lit(" \n"), F.substr("p", at(k), F.lit(40)), F.lit(" not on the page" if k == 2 else "")).alias("quote")) for k in range(3)])
    q = t.raw("pages").select("page_id", "url", page.alias("p")).select("page_id", F.concat_ws("#", "url", "page_id").alias("source_url"), F.explode(parts).alias("q")).select("page_id", "source_url", "q.*")
    pages = t.raw("pages").select(F.concat_ws("#", "url", "page_id").alias("url"), "html")
    return S.quote_check(q, pages).select("page_id", "part", "quoted")


# ------------------------------------------------------------------ queue

REP = """rep AS (SELECT event_id AS id, ts AS created_at, CASE event_type WHEN 'signup' THEN 'received' WHEN 'error' THEN 'checking' WHEN 'purchase' THEN 'applied' ELSE 'held' END AS status, CAST(event_id % 4 AS INTEGER) AS attempts,
  CASE WHEN event_type <> 'signup' THEN ts END AS checked_at, '/eat-stay' AS page_path, 'text' AS message, CASE WHEN event_id % 3 <> 0 THEN 'r@example.test' END AS reply_email, CASE WHEN event_id % 5 = 0 THEN ts END AS replied_at, CASE WHEN event_id % 2 = 0 THEN 'Ana' END AS reporter_name,
  CASE WHEN event_type = 'purchase' THEN ts END AS resolved_at, 'note' AS status_note, CAST(NULL AS VARCHAR) AS last_error, substr(md5(CAST(event_id AS VARCHAR)), 1, 8) || '-0000-4000-8000-' || substr(md5(CAST(event_id AS VARCHAR)), 1, 12) AS token FROM events)"""


def reports(t):
    return t._view(REP, events=t.raw("events"))


@query("A18_recent_counts", f"SELECT user_id, count(*) FILTER (WHERE ts > {NOW} - INTERVAL 1 HOUR) AS last_hour, count(*) FILTER (WHERE ts > {NOW} - INTERVAL 1 DAY) AS last_day FROM events GROUP BY user_id")
def _(t):
    return Q.recent_counts(t.events, "user_id", "ts", now())


@query("T2_hourly_cap", """WITH RECURSIVE o AS (SELECT event_id, user_id % 3 AS k, ts, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS n FROM events),
 w AS (SELECT event_id, k, n, CAST(NULL AS TIMESTAMP) AS a, ts AS b, true AS accepted FROM o WHERE n = 1 UNION ALL
  SELECT o.event_id, o.k, o.n, CASE WHEN w.a IS NULL OR w.a <= o.ts - INTERVAL 1 HOUR THEN w.b ELSE w.a END, CASE WHEN w.a IS NULL OR w.a <= o.ts - INTERVAL 1 HOUR THEN o.ts ELSE w.b END, w.a IS NULL OR w.a <= o.ts - INTERVAL 1 HOUR FROM w JOIN o ON o.k = w.k AND o.n = w.n + 1)
SELECT event_id, k, accepted FROM w""")
def _(t):
    """Three busy keys hold all events: the cap is set so that it binds."""
    d = t.events.withColumn("k", F.col("user_id") % 3)
    return Q.rolling_cap(d, ["k"], "ts", "event_id", 2, 3600).select("event_id", "k", "accepted")


@query("T2_cap_unbound", "SELECT user_id, count(*) AS accepted FROM events GROUP BY user_id")
def _(t):
    d = Q.rolling_cap(t.events, ["user_id"], "ts", "event_id", 10_000, 3600)
    return d.where("accepted").groupBy("user_id").agg(F.count("*").alias("accepted"))


@query("T3_claim", with_(REP) + f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY created_at, id) AS rn FROM rep WHERE status = 'received') WHERE rn <= 2000 - (SELECT count(*) FROM rep WHERE checked_at > {NOW} - INTERVAL 1 DAY)")
def _(t):
    return Q.claim(reports(t), now(), 2000)


@query("T4_status_machine", """WITH ev AS (SELECT *, (ts, event_id) AS a FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM ev WHERE event_type = 'error'),
 k AS (SELECT u.user_id, ap, third FROM (SELECT user_id, min(a) FILTER (WHERE event_type = 'purchase') AS ap FROM ev GROUP BY user_id) u LEFT JOIN (SELECT user_id, max(a) FILTER (WHERE rn = 3) AS third FROM f WHERE rn <= 3 GROUP BY user_id) USING (user_id))
SELECT user_id, CASE WHEN ap IS NOT NULL AND (third IS NULL OR ap < third) THEN 'applied' WHEN third IS NOT NULL THEN 'held' ELSE 'received' END AS status, CAST((SELECT count(*) FROM f WHERE f.user_id = k.user_id AND rn <= 3 AND (NOT (ap IS NOT NULL AND (third IS NULL OR ap < third)) OR f.a < ap)) AS INTEGER) AS attempts FROM k""")
def _(t):
    log = t.events.withColumn("what", F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "applied").otherwise("received"))
    return Q.replay_status(log, "user_id", "ts", "event_id", "what")


@query("T5_release_stuck", with_(REP) + f"SELECT status, attempts, stuck AS released, count(*) AS n FROM (SELECT CASE WHEN stuck AND attempts + 1 >= 3 THEN 'held' WHEN stuck THEN 'received' ELSE status END AS status, CAST(CASE WHEN stuck THEN attempts + 1 ELSE attempts END AS INTEGER) AS attempts, stuck FROM (SELECT *, status = 'checking' AND checked_at < {NOW} - INTERVAL 15 MINUTE AS stuck FROM rep)) GROUP BY 1, 2, 3")
def _(t):
    return Q.release_stuck(reports(t), now()).groupBy("status", "attempts", "released").agg(F.count("*").alias("n"))


@query("T4_fail", with_(REP) + "SELECT id, CASE WHEN hit AND attempts >= 2 THEN 'held' WHEN hit THEN 'received' ELSE status END AS status, CAST(CASE WHEN hit THEN attempts + 1 ELSE attempts END AS INTEGER) AS attempts FROM (SELECT *, status = 'checking' AND id % 2 = 0 AS hit FROM rep)")
def _(t):
    rep = reports(t)
    return Q.fail(rep, rep.where("id % 2 = 0").select("id", F.lit("timeout").alias("error"))).select("id", "status", "attempts")


_STUCK = f"fr AS (SELECT *, status = 'checking' AND checked_at < {NOW} - INTERVAL 15 MINUTE AS stuck FROM rep), fs AS (SELECT * REPLACE (CASE WHEN stuck AND attempts + 1 >= 3 THEN 'held' WHEN stuck THEN 'received' ELSE status END AS status) FROM fr)"


@query("T6_sweep", with_(REP, _STUCK) + """SELECT 'released' AS step, status AS outcome, count(*) AS n FROM fs WHERE stuck GROUP BY 2 UNION ALL SELECT 'checked', CASE WHEN id % 2 = 0 THEN 'applied' ELSE 'held' END, count(*) FROM (SELECT * FROM fs WHERE status = 'received' ORDER BY created_at, id LIMIT 3) GROUP BY 2
 UNION ALL SELECT 'reply', 'sent', count(*) FROM (SELECT * FROM fs WHERE status IN ('applied', 'held') AND replied_at IS NULL AND reply_email IS NOT NULL AND id % 7 <> 0 ORDER BY created_at, id LIMIT 9) GROUP BY 2""")
def _(t):
    rep = reports(t)
    check = lambda df: df.select("id", F.when(F.col("id") % 2 == 0, "applied").otherwise("held").alias("outcome"))
    return J.sweep(rep, rep.where("id % 7 = 0").select("id"), now(), check, lambda df: df.select("id", F.lit("sent").alias("outcome")))[1]


# Two sweeps in a row, the second over what the first left: the rows each step changes.
_SWEEPS = """c1 AS (SELECT id, attempts, CASE WHEN id % 2 = 0 THEN 'applied' ELSE 'held' END AS outcome FROM fz WHERE status = 'received' ORDER BY created_at, id LIMIT 3),
 p1 AS (SELECT id, status, attempts FROM fz WHERE status IN ('applied', 'held') AND replied_at IS NULL AND reply_email IS NOT NULL ORDER BY created_at, id LIMIT 9),
 s2 AS (SELECT fz.* REPLACE (coalesce(c1.outcome, fz.status) AS status), p1.id IS NOT NULL AS answered FROM fz LEFT JOIN c1 USING (id) LEFT JOIN p1 ON p1.id = fz.id),
 c2 AS (SELECT id, attempts, CASE WHEN id % 2 = 0 THEN 'applied' ELSE 'held' END AS outcome FROM s2 WHERE status = 'received' ORDER BY created_at, id LIMIT 3),
 p2 AS (SELECT id, status, attempts FROM s2 WHERE status IN ('applied', 'held') AND replied_at IS NULL AND NOT answered AND reply_email IS NOT NULL ORDER BY created_at, id LIMIT 9)"""
_FREED = _STUCK.replace("ELSE status END AS status)", "ELSE status END AS status, CAST(CASE WHEN stuck THEN attempts + 1 ELSE attempts END AS INTEGER) AS attempts)").replace("fs AS", "fz AS")


@query("T6_kept_sweep", with_(REP, _FREED, _SWEEPS) + """SELECT 1 AS batch, 'released' AS step, id, status, attempts FROM fz WHERE stuck AND id NOT IN (SELECT id FROM c1) UNION ALL SELECT 1, 'checked', id, outcome, attempts FROM c1 UNION ALL SELECT 1, 'replied', id, status, attempts FROM p1
 UNION ALL SELECT 2, 'checked', id, outcome, attempts FROM c2 UNION ALL SELECT 2, 'replied', id, status, attempts FROM p2""")
def _(t):
    """Kept sweeps: each step written before the next acts on it; the first one is run twice, as after a lost driver, and
    changes nothing more."""
    root = f"{shared_folder(t.spark)}/sweeps/{uuid4().hex}"
    check = lambda df: df.select("id", F.when(F.col("id") % 2 == 0, "applied").otherwise("held").alias("outcome"))
    send = lambda df: df.select("id", F.lit("sent").alias("outcome"))
    step = F.when(F.col("checked_at").isNotNull(), "checked").when(F.col("replied_at").isNotNull(), "replied").otherwise("released")
    of = lambda changes, batch: changes.select(F.lit(batch).alias("batch"), step.alias("step"), "id", "status", "attempts")
    rep = reports(t)
    J.kept_sweep(rep, root, 1, now(), check, send)
    first = J.kept_sweep(rep, root, 1, now(), check, send)[0]
    second = J.kept_sweep(J.apply_sweeps(rep, root), root, 2, now(), check, send)[0]
    return of(first, 1).union(of(second, 2))


@query("A19_sweep_summary", with_(REP, _STUCK) + "SELECT status AS outcome, count(*) AS n FROM fs WHERE stuck GROUP BY 1")
def _(t):
    return Q.release_stuck(reports(t), now()).where("released").groupBy(F.col("status").alias("outcome")).agg(F.count("*").alias("n"))


@query("L4_oldest", with_(REP) + "SELECT id, created_at::VARCHAR AS created FROM rep WHERE status = 'received' ORDER BY created_at, id LIMIT 3")
def _(t):
    return Q.oldest(reports(t), "received", 3).select("id", F.regexp_replace(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "").alias("created"))


@query("T9_reply_outbox", with_(REP) + "SELECT id, status FROM rep WHERE status IN ('applied', 'held') AND replied_at IS NULL AND reply_email IS NOT NULL AND id % 7 <> 0")
def _(t):
    rep = reports(t)
    return Q.claim_replies(rep, rep.where("id % 7 = 0").select("id")).select("id", "status")


@query("T9_pending_replies", with_(REP) + "SELECT id FROM rep WHERE status IN ('applied', 'held') AND replied_at IS NULL AND reply_email IS NOT NULL ORDER BY created_at, id LIMIT 9")
def _(t):
    return Q.pending_replies(reports(t)).select("id")


_LATER = "TIMESTAMP '2024-04-15 00:00:00'"


@query("T10_retention", with_(REP) + f"SELECT id, CASE WHEN created_at < TIMESTAMP '2025-01-20 00:00:00' - INTERVAL 12 MONTH THEN '(deleted after 12 months)' ELSE message END AS message, CASE WHEN NOT clear THEN reply_email END AS reply_email, CASE WHEN NOT clear THEN reporter_name END AS reporter_name FROM (SELECT *, (reply_email IS NOT NULL OR reporter_name IS NOT NULL) AND ((resolved_at IS NOT NULL AND (replied_at IS NOT NULL OR reply_email IS NULL)) OR created_at < TIMESTAMP '2025-01-20 00:00:00' - INTERVAL 90 DAY) AS clear FROM rep)")
def _(t):
    return Q.expire(reports(t), F.expr("TIMESTAMP '2025-01-20 00:00:00'")).select("id", "message", "reply_email", "reporter_name")


@query("T10_contact_only", with_(REP) + f"SELECT count(reply_email) FILTER (WHERE NOT clear) AS emails, count(reporter_name) FILTER (WHERE NOT clear) AS names FROM (SELECT *, (reply_email IS NOT NULL OR reporter_name IS NOT NULL) AND ((resolved_at IS NOT NULL AND (replied_at IS NOT NULL OR reply_email IS NULL)) OR created_at < {_LATER} - INTERVAL 90 DAY) AS clear FROM rep)")
def _(t):
    return Q.expire(reports(t), F.expr(_LATER)).agg(F.count("reply_email").alias("emails"), F.count("reporter_name").alias("names"))


@query("T11_status_by_token", with_(REP) + "SELECT token, status, status_note FROM rep WHERE id % 10 = 0")
def _(t):
    rep = reports(t)
    asked = rep.where("id % 10 = 0").select("token").union(rep.where("id % 10 = 1").select(F.concat("token", F.lit("0")).alias("token"))).union(rep.where("id % 10 = 2").select(F.lit("x").alias("token")))
    return Q.status_by_token(rep, asked).select("token", "status", "status_note")


@query("T13_queue_report", with_(REP) + f"SELECT status, CASE WHEN age < 1 THEN 'today' WHEN age < 7 THEN 'week' ELSE 'older' END AS age, count(*) AS n FROM (SELECT status, date_diff('day', created_at::DATE, DATE '2024-01-28') AS age FROM rep) GROUP BY 1, 2")
def _(t):
    return Q.queue_report(reports(t), now())


# ------------------------------------------------------------------- audit

_CH = "SELECT event_id AS id, ts AS applied_at, 'venues' AS target_table, 'venue-' || user_id AS slug, CASE WHEN value > 245 OR event_id % 3 = 0 THEN 'hours' ELSE 'price_range' END AS field, user_id, value FROM {src}"
CH = f"ch AS ({_CH.format(src='events')})"


def changes(t):
    return t.spark.sql(_CH.format(src="{t}"), t=t.raw("events"))


@query("T7_replay_cooldown", with_(CH).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """, o AS (SELECT *, row_number() OVER (PARTITION BY slug, field ORDER BY applied_at, id) AS n FROM ch),
 w AS (SELECT id, slug, field, n, applied_at AS last, true AS accepted FROM o WHERE n = 1 UNION ALL
  SELECT o.id, o.slug, o.field, o.n, CASE WHEN w.last <= o.applied_at - INTERVAL 7 DAY THEN o.applied_at ELSE w.last END, w.last <= o.applied_at - INTERVAL 7 DAY FROM w JOIN o ON o.slug = w.slug AND o.field = w.field AND o.n = w.n + 1)
SELECT id, slug, field, accepted FROM w""")
def _(t):
    return A.replay_applied(changes(t), "id", "applied_at").select("id", "slug", "field", "accepted")


@query("W12_first_per_target", with_(CH) + "SELECT slug, field, min(id) AS id FROM ch GROUP BY slug, field")
def _(t):
    return A.first_per_target(changes(t).select("target_table", "slug", "field", "id")).select("slug", "field", "id")


_PROP = "SELECT event_id AS id, ts, CASE WHEN event_id % 9 = 0 THEN 'destinations' ELSE 'venues' END AS target_table, 'venue-' || (user_id + CASE WHEN event_id % 13 = 0 THEN 100000000 ELSE 0 END) AS slug, CASE WHEN event_id % 2 = 0 THEN 'hours' ELSE 'price_range' END AS field, CASE WHEN event_id % 5 = 0 THEN '8:00' ELSE '08:00' END AS open, '21:00' AS close, CAST(event_id % 6 AS INTEGER) AS price_range FROM {src}"
_GATE = f"""pr AS ({_PROP.format(src='events')}), lg AS (SELECT DISTINCT target_table, slug, field FROM ch WHERE id % 4 <> 0 AND applied_at > {NOW} - INTERVAL 7 DAY),
 g0 AS (SELECT pr.*, CASE WHEN pr.id % 11 = 0 THEN 'held: not checking' WHEN pr.target_table = 'destinations' AND pr.field = 'price_range' THEN 'held: field' WHEN pr.field = 'hours' AND open = '8:00' OR pr.field = 'price_range' AND price_range NOT BETWEEN 1 AND 4 THEN 'held: value' WHEN lg.slug IS NOT NULL THEN 'held: cooldown' WHEN pr.target_table <> 'venues' OR pr.id % 13 = 0 THEN 'held: place' ELSE 'applied' END AS o FROM pr LEFT JOIN lg ON pr.target_table = lg.target_table AND pr.slug = lg.slug AND pr.field = lg.field),
 g1 AS (SELECT *, CASE WHEN o = 'applied' AND row_number() OVER (PARTITION BY target_table, slug, field, o ORDER BY id) > 1 THEN 'held: cooldown' ELSE o END AS outcome FROM g0)"""


def gated(t):
    p = t.spark.sql(_PROP.format(src="{t}"), t=t.raw("events"))
    rep = p.where("id % 11 <> 0").select("id", F.lit("checking").alias("status"))
    log = changes(t).withColumn("undone_at", F.when(F.col("id") % 4 == 0, F.col("applied_at")))
    return A.gate(p, rep, log, venues(t), now())


def venues(t):
    return t.ven.select(F.lit("venues").alias("target_table"), F.col("vslug").alias("slug"), F.to_json("hours").alias("hours_json"), "price_range")


@query("J20_gate_checks", with_(CH, _GATE) + "SELECT id, outcome FROM g1")
def _(t):
    return gated(t).select("id", "outcome")


@query("T7_gate_summary", with_(CH, _GATE) + "SELECT outcome, count(*) AS n FROM g1 GROUP BY outcome")
def _(t):
    return gated(t).groupBy("outcome").agg(F.count("*").alias("n"))


@query("T8_apply", with_(CH, VEN, _GATE) + """SELECT vslug AS slug, coalesce(p.price_range, ven.price_range) AS price_range, coalesce(h.open, ven.open) AS open FROM ven LEFT JOIN (SELECT slug, price_range FROM g1 WHERE outcome = 'applied' AND field = 'price_range') p ON p.slug = vslug LEFT JOIN (SELECT slug, open FROM g1 WHERE outcome = 'applied' AND field = 'hours') h ON h.slug = vslug""")
def _(t):
    after, _log = A.apply_changes(gated(t), venues(t), now())
    return after.select("slug", "price_range", F.get_json_object("hours_json", "$.open").alias("open"))


@query("T8_undo", with_(CH, VEN) + """SELECT vslug AS slug, coalesce(u.v, ven.price_range) AS price_range FROM ven LEFT JOIN (SELECT slug, CAST(arg_max(1 + id % 4, id) AS INTEGER) AS v FROM ch WHERE field = 'price_range' AND id % 4 <> 0 AND id % 3 = 1 GROUP BY slug) u ON u.slug = vslug""")
def _(t):
    log = changes(t).select("id", "target_table", "slug", "field", F.when(F.col("field") == "price_range", (1 + F.col("id") % 4).cast("string")).alias("old_value"), "applied_at", F.when(F.col("id") % 4 == 0, F.col("applied_at")).alias("undone_at"))
    after, _log, _errors = A.undo(log, log.where("id % 3 = 1"), venues(t), now())
    return after.select("slug", "price_range")


# ------------------------------------------------------------------- views


@query("T12_settled_views", f"""SELECT user_id, n AS moves, {rnd('west', 4)} AS west, {rnd('zoom', 1)} AS zoom FROM (SELECT user_id, s, count(*) AS n, arg_max(120.5::DOUBLE + value / 3000, (ts, event_id)) AS west, arg_max(12 + value / 77, (ts, event_id)) AS zoom FROM
 (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 4 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, s)""")
def _(t):
    v = t.events.select("event_id", "user_id", "ts", (F.lit(120.5) + F.col("value") / 3000).alias("west"), F.lit(16.3).alias("south"), F.lit(120.6).alias("east"), F.lit(16.4).alias("north"), (12 + F.col("value") / 77).alias("zoom"))
    return J.settled_views(v, quiet="4 hours").select("user_id", "moves", "west", "zoom")
