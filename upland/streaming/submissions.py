"""Report forms: parsing, difficulty, routing between two scorers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upland.functions.geo import col

# Form limits and the wording rules.
FILL_MS = 3000
MAX_PAGE, MIN_MESSAGE, MAX_MESSAGE, MAX_EMAIL, MAX_LINK, MAX_NAME, LONG = 200, 10, 2000, 254, 2000, 80, 400
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
HTTPS = r"(?i)^https://[^\s/?#]+([/?#].*)?$"
TIME = r"(?i)\b\d{1,2}(:\d{2})?\s*(am|pm|a\.m\.|p\.m\.)|\b\d{1,2}:\d{2}\b"
HOURS = (r"(?i)\b(open|opens|opening|close|closes|closed|closing|hours?|schedule|daily|weekdays?|weekends?|mondays?|tuesdays?|wednesdays?|thursdays?|"
         r"fridays?|saturdays?|sundays?)\b")
PRICE = r"(?i)₱|\bphp\b|\bpesos?\b|\bprices?\b|\bpricey\b|\bexpensive\b|\bcheap(er)?\b|\bcosts?\b|\bfees?\b"
PLACE_PAGE = r"^/destinations/[a-z0-9-]+$"


def parse(forms: DataFrame, now_ms: Column) -> DataFrame:
    """Form rows to kind (valid, invalid, spam), cleaned fields and a map of field errors. A filled honeypot is spam, then a
    form sent in under three seconds; a missing start time counts as long ago. Works on a stream as on a table."""
    s = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    t = forms.select("*", *[s(c).alias(f"_{c}") for c in ("website", "startedAt", "message", "email", "name", "link")],
                     F.when(s("page") == "", "/").otherwise(s("page")).alias("_page"))
    started = F.when(F.col("_startedAt") == "", F.lit(0.0)).otherwise(F.expr("try_cast(_startedAt AS double)"))
    spam = (F.col("_website") != "") | F.coalesce(F.isnan(started) | (F.abs(started) == float("inf")) | (now_ms - started < FILL_MS), F.lit(True))
    n = lambda c: F.char_length(c)
    errors = F.create_map(
        F.lit("page"), F.when(~F.col("_page").startswith("/") | (n("_page") > MAX_PAGE), "page address"),
        F.lit("message"), F.when(n("_message") < MIN_MESSAGE, "at least 10 characters").when(n("_message") > MAX_MESSAGE, "under 2,000 characters"),
        F.lit("email"), F.when(F.col("_email") == "", "email needed").when((n("_email") > MAX_EMAIL) | ~F.col("_email").rlike(EMAIL), "email incomplete"),
        F.lit("link"), F.when((F.col("_link") != "") & ((n("_link") > MAX_LINK) | ~F.col("_link").rlike(HTTPS)), "link not https"),
        F.lit("name"), F.when(n("_name") > MAX_NAME, "name too long"))
    t = t.withColumn("errors", F.map_filter(errors, lambda k, v: v.isNotNull()))
    kind = F.when(spam, "spam").when(F.size("errors") > 0, "invalid").otherwise("valid")
    null_blank = lambda c: F.when(F.col(c) != "", F.col(c))
    keep = [c for c in forms.columns if c not in ("website", "startedAt", "page", "message", "email", "name", "link")]
    return t.select(*keep, kind.alias("kind"), "errors", F.col("_page").alias("page"), F.col("_message").alias("message"), F.col("_email").alias("email"),
                    null_blank("_name").alias("name"), null_blank("_link").alias("link"))


def difficulty(page="page", message="message") -> Column:
    """struct(hard, in_scope, reasons) of a report."""
    p, m = col(page), col(message)
    times = F.regexp_count(m, F.lit(TIME))
    hours, price = m.rlike(HOURS) | (times > 0), m.rlike(PRICE)
    reasons = F.array_compact(F.array(
        F.when(~p.rlike(PLACE_PAGE) & (p != "/eat-stay"), "not one place's page"), F.when(F.char_length(m) > LONG, "long report"),
        F.when(times > 2, "several times"), F.when(hours & price, "hours and prices")))
    return F.struct((F.size(reasons) > 0).alias("hard"), (hours | price).alias("in_scope"), reasons.alias("reasons"))


Scorer = Callable[[DataFrame], DataFrame]


def route(reports: DataFrame, cheap: Scorer, strong: Scorer) -> DataFrame:
    """Verdicts of reports (id, page, message, ...): hard ones from the strong scorer; others from the cheap one, and again
    from the strong one when held though in scope. A scorer maps reports to verdict rows (id, outcome, ...)."""
    r = reports.withColumn("_d", difficulty())
    hard, easy = r.where("_d.hard"), r.where("NOT _d.hard")
    first = cheap(easy.drop("_d"))
    again = first.where("outcome = 'held'").select("id").join(easy.where("_d.in_scope"), "id").drop("_d")
    kept = first.join(again.select("id"), "id", "left_anti")
    tag = lambda df, by: df.withColumn("scored_by", F.lit(by))
    return tag(strong(hard.drop("_d")), "strong").unionByName(tag(kept, "cheap")).unionByName(tag(strong(again), "strong after cheap"))


def check_verdict(verdicts: DataFrame) -> DataFrame:
    """Verdict rows held to their rules: an incomplete proposal becomes held; a held note is cut to 300 characters."""
    hhmm = r"^\d\d:\d\d$"
    value = F.when(F.col("field") == "hours", F.col("open").rlike(hhmm) & F.col("close").rlike(hhmm)).otherwise(F.col("price_range").between(1, 4))
    ok = (F.col("table").isin("venues", "destinations") & (F.char_length("slug") <= 120) & F.col("field").isin("hours", "price_range") & value
          & F.col("source_url").rlike(r"(?i)^[a-z][a-z0-9+.-]*://\S+$") & (F.char_length("source_url") <= 2000) & F.char_length("quote").between(20, 1000))
    proposed = F.col("outcome") == "proposed"
    good = proposed & F.coalesce(ok, F.lit(False))
    note = (F.when(good, F.lit(None)).when(proposed, "The check's answer was incomplete.")
            .otherwise(F.coalesce(F.expr("nullif(left(coalesce(note, ''), 300), '')"), F.lit("No public page confirms it."))))
    return verdicts.withColumn("note", note).withColumn("outcome", F.when(good, "proposed").otherwise("held"))


def quote_check(proposals: DataFrame, pages: DataFrame) -> DataFrame:
    """Proposals with `quoted`: their quote stands in the cited page (url, html). Page text is prepared once per page."""
    from upland.functions.text import html_to_text, normalise
    text = pages.select(F.col("url").alias("source_url"), normalise(html_to_text("html")).alias("_text"))
    q = normalise("quote")
    j = proposals.join(text, "source_url", "left")
    return j.withColumn("quoted", F.coalesce((F.char_length(q) >= 20) & F.contains("_text", q), F.lit(False))).drop("_text")
