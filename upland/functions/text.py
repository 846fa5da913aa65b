"""Text search terms, page text, quotes and report wording."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from upland.functions.geo import col

MAX_QUERY = 80
# Words too common to search by, and the suffixes the stemmer drops, longest first.
STOP_WORDS = ("a an and are as at be but by for if in into is it no not of on or such that the their then there "
              "these they this to was will with").split()
SUFFIXES = ("ations", "ation", "ings", "ing", "ies", "ed", "es", "ly", "s")
STEM_PATTERN = "^(.{3,}?)(" + "|".join(SUFFIXES) + ")$"


def stem(word) -> Column:
    """Lower-case word less one known suffix; at least three letters stay."""
    return F.regexp_replace(col(word), STEM_PATTERN, "$1")


def tokens(text) -> Column:
    """Distinct stems of the words of a text, stop words dropped."""
    words = F.regexp_extract_all(F.lower(col(text)), F.lit(r"([\p{L}\p{N}]+)"), 1)
    kept = F.filter(words, lambda w: ~w.isin(*STOP_WORDS))
    return F.array_distinct(F.transform(kept, stem))


def query_terms(q: str) -> list[str]:
    """The same stems for one query string, on the driver."""
    if len(q.strip()) > MAX_QUERY:
        raise ValueError(f"q must be at most {MAX_QUERY} characters")
    out = []
    for w in re.findall(r"[^\W_]+", q.lower()):
        if w not in STOP_WORDS:
            s = re.sub(STEM_PATTERN, r"\1", w)
            if s not in out:
                out.append(s)
    return out


def html_to_text(html) -> Column:
    """Page text: scripts, styles and tags become spaces; the two common entities are decoded."""
    t = F.regexp_replace(col(html), r"(?is)<(script|style).*?</\1>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = F.regexp_replace(t, r"&nbsp;|&#160;", " ")
    return F.regexp_replace(t, "&amp;", "&")


def normalise(text) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(text)), r"\s+", " "))


def quote_found(page, quote, least: int = 20) -> Column:
    q = normalise(quote)
    return (F.char_length(q) >= least) & F.contains(normalise(page), q)


# Address classes that are not public.
PRIVATE_ADDRESS = (
    r"^0\.", r"^10\.", r"^127\.", r"^169\.254\.", r"^172\.(1[6-9]|2\d|3[01])\.", r"^192\.168\.",
    r"^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.", r"^::1?$", r"(?i)^f[cd]", r"(?i)^fe80:", r"(?i)^::ffff:",
)
IPV4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
IPV6 = r"(?i)^[0-9a-f]{0,4}(:[0-9a-f]{0,4}){2,7}(\d+\.\d+\.\d+\.\d+)?$"


def is_public_address(ip) -> Column:
    ip = col(ip)
    private = F.lit(False)
    for pattern in PRIVATE_ADDRESS:
        private = private | ip.rlike(pattern)
    return (ip.rlike(IPV4) | ip.rlike(IPV6)) & ~private


def redact_status_url(url) -> Column:
    """A status address names the route, not its private token."""
    return F.regexp_replace(col(url), r"/corrections/status/[^/?#]+", "/corrections/status/[token]")


# What a route key looks like.
SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
ROW_ID = r"(?i)^[a-z0-9-]{20,40}$"
ROUTE_CODE = r"^[A-Z0-9]+(?:-[A-Z0-9]+)*$"


def is_slug(s) -> Column:
    return (F.char_length(col(s)) <= 80) & col(s).rlike(SLUG)


def is_row_id(s) -> Column:
    return col(s).rlike(ROW_ID)


def is_route_code(s) -> Column:
    return (F.char_length(col(s)) <= 16) & col(s).rlike(ROUTE_CODE)
