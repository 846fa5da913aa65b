"""Main text of web pages, with site templates removed.

Pages are read as a stream of tags into blocks. A block belongs to the elements around it; every element's subtree has
a hash of its tags, attributes and text. Spark counts, per host, on how many different pages a subtree stands, and
subtrees on many pages of their host are template, not text. What an element says of itself (menu, footer, advert,
form, comments and so on) is used as well, and where a page names its article, only the article is read.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upland.llm.common import stash

# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
DROPPED = frozenset("head nav footer aside form script style title noscript template iframe noframes object embed applet svg math canvas audio video map select option datalist button input textarea label fieldset dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
# fixed values: words of class, id and role that mark what is not the article
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
MARKS = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|masthead|site-?header|page-?header|top-?bar|footer|footnav|colophon|side-?bar|sidebar|widget|ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed)?|promo(?:tion)?|"
                   r"banner|cookies?|consent|gdpr|notices?|alert|popup|pop-up|modal|overlay|newsletter|subscribe|signup|sign-up|login|share|sharing|social|related|recommended|comments?|comment-?list|disqus|respond|replies|reply|pagination|pager|skip-?link|toolbar|search)(?=$|[\s_-])", re.I)
MANY_PAGES = 10          # a subtree on at least so many different pages of its host is template ...
MANY_SHARE = 0.2         # ... and on at least this share of them
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def not_article(tag: str, attrs: str, inside: bool) -> bool:
    """Does the element say that it is no part of an article?"""
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if tag in ("html", "body", "main"):
        return False
    if "=" not in attrs:
        return bool(re.search(r"\bhidden\b", attrs))
    for name, *value in ATTR.findall(attrs):
        value, name = "".join(value), name.lower()
        if name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true" or name == "hidden":
            return True
        if name in ("class", "id") and MARKS.search(value):
            return True
    return False


class Page:
    """Blocks of one page: text pieces with the elements they stand in."""

    def __init__(self, source: str):
        self.kind: list[tuple[str, bool, bool, int]] = []    # per element: tag, says it is no article, is an article, parent
        self.opened: list[str] = []
        self.pieces: list[tuple[int, str]] = []              # (element, text); None text ends a block
        self.ends: list[int] = []                            # per element, the piece where it ends
        self.starts: list[int] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[int] = []
        pos, articles = 0, 0

        def push(tag, attrs):
            nonlocal articles
            article = tag in ("article", "main")
            articles += article
            self.kind.append((tag, not_article(tag, attrs, articles > 0), article, stack[-1] if stack else -1))
            self.opened.append(attrs)
            self.starts.append(len(self.pieces))
            self.ends.append(-1)
            stack.append(len(self.kind) - 1)

        def pop():
            nonlocal articles
            e = stack.pop()
            articles -= self.kind[e][2]
            self.ends[e] = len(self.pieces)
            if self.kind[e][0] not in INLINE:
                self.pieces.append((-1, ""))

        def close_to(tags, stop):
            for i in range(len(stack) - 1, -1, -1):
                name = self.kind[stack[i]][0]
                if name in tags:
                    while len(stack) > i:
                        pop()
                    return
                if name in stop:
                    return

        def text(s):
            if s:
                self.pieces.append((stack[-1] if stack else -2, html.unescape(s)))

        while True:
            m = TAG.search(source, pos)
            if m is None:
                text(source[pos:])
                break
            text(source[pos:m.start()])
            pos = m.end()
            tag = m[2].lower() if m[2] else None
            if tag is None:
                if m[0].startswith("<![CDATA["):
                    text(m[0][9:-3].replace("&", "&amp;"))
                continue
            if m[1]:
                if tag == "p" and not any(self.kind[e][0] == "p" for e in stack) or tag == "br":
                    self.pieces.append((-1, ""))
                elif tag not in VOID:
                    close_to((tag,), () if tag not in INLINE else ("article", "main", "body", "td", "th", "table", "div", "section"))
                continue
            if tag not in INLINE:
                if tag in CLOSES_P:
                    close_to(("p",), ("button", "table", "td", "th", "article", "div", "li", "body", "blockquote", "section"))
                if tag in SIBLINGS:
                    names, stop = SIBLINGS[tag]
                    close_to(names.split(), stop.split())
                self.pieces.append((-1, ""))
            if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
                continue
            push(tag, m[3])
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, pos)
                body = source[pos:end.start()] if end else source[pos:]
                if tag not in DROPPED:
                    text(body)
                pos = end.end() if end else len(source)
                pop()
        while stack:
            pop()
        self._keep_an_article()

    def _keep_an_article(self) -> None:
        """Where every article stands in something to be left out (a form around the page, a wrapper named after its
        sidebar), what is around the first one is kept after all."""
        off = self.dropped()
        articles = [e for e, k in enumerate(self.kind) if k[2]]
        if articles and all(off[e] for e in articles):
            e = articles[0]
            while e >= 0:
                tag, _, article, parent = self.kind[e]
                self.kind[e] = tag, False, article, parent
                e = parent

    def dropped(self, template: set[int] = frozenset()) -> list[bool]:
        """Per element, whether it or one around it is left out."""
        out: list[bool] = []
        for e, (_, off, _, parent) in enumerate(self.kind):
            out.append(off or e in template or parent >= 0 and out[parent])
        return out

    def blocks(self, template: set[int] = frozenset()) -> list[str]:
        off = self.dropped(template)
        within: list[bool] = []
        for _, _, article, parent in self.kind:
            within.append(article or parent >= 0 and within[parent])
        only = any(w and not o for w, o in zip(within, off))
        out, piece = [], []
        for e, s in [*self.pieces, (-1, "")]:
            if e == -1:
                words = "".join(piece).split()
                if words:   # white space as str.split() knows it
                    out.append(" ".join(words))
                piece = []
            elif (e == -2 and not only) or e >= 0 and not off[e] and (within[e] or not only):
                piece.append(s)
        return out

    def subtrees(self) -> list[tuple[int, int]]:
        """(element, hash of tag, attributes and text below) of the elements that may be template: containers that are
        not the page, the article or running text of an article, and that hold text."""
        within: list[bool] = []
        out = []
        text_at = np.cumsum([0] + [e != -1 and bool(s.strip()) for e, s in self.pieces])
        for e, (tag, off, article, parent) in enumerate(self.kind):
            within.append(article or parent >= 0 and within[parent])
            if off or article or tag in ("html", "body") or tag in INLINE or within[e] and not self.opened[e].strip() or text_at[self.ends[e]] == text_at[self.starts[e]]:
                continue
            if within[e] and tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "table", "tr", "td", "th", "tbody", "figure"):
                continue
            below = " ".join("".join(s if x != -1 else " " for x, s in self.pieces[self.starts[e]:self.ends[e]]).split())
            out.append((e, number(f"{tag} {self.opened[e].strip()}\0{below}")))
        return out


def read(source: str | None, template_of=None) -> tuple[str, list[tuple[int, int]], int]:
    page = Page(source or "")
    trees = page.subtrees()
    template = {e for e, h in trees if template_of is not None and template_of(h)}
    text = " ".join(page.blocks(template))
    return text, trees, number(text)


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"


def _trees(batches):
    for batch in batches:
        rows = [read(s) for s in batch.column(1).to_pylist()]
        flat = [(h, t, own) for h, (_, trees, own) in zip(batch.column(0).to_pylist(), rows) for t in {t for _, t in trees}]
        flat += [(h, None, own) for h, (_, _, own) in zip(batch.column(0).to_pylist(), rows)]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.string()), pa.array([f[1] for f in flat], pa.int64()), pa.array([f[2] for f in flat], pa.int64())], names=["host", "tree", "page"])


def templates(pages: DataFrame, many: int = MANY_PAGES, share: float = MANY_SHARE) -> DataFrame:
    """(host, tree): subtrees on many different pages of their host. Pages with one main text count once, so mirrored
    pages make no template of their article."""
    host = F.lower(F.regexp_extract(F.coalesce(pages["url"].cast("string"), F.lit("")), HOST, 1))
    rows = pages.select(host.alias("host"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html")).mapInArrow(_trees, "host string, tree long, page long")
    counts = stash(rows.distinct().groupBy("host", "tree").agg(F.count("*").alias("n")))
    per_host = counts.where("tree is null").select("host", F.col("n").alias("pages"))
    return counts.where("tree is not null").where(F.col("n") >= many).join(per_host, "host").where(F.col("n") >= share * F.col("pages")).select("host", "tree")


def extract(pages: DataFrame, many: int = MANY_PAGES, share: float = MANY_SHARE) -> DataFrame:
    """One row per page: page_id, url, text (main text), n_chars (its code points).

    Null or empty html has empty text; a null url is a host of its own; repeated rows give the same text and count as
    one page; an empty table gives no rows; other columns are not looked at. Unclosed tags end with what is around
    them; an open comment or script runs to the end."""
    found = stash(templates(pages, many, share).groupBy("host").agg(F.collect_set("tree").alias("trees")))
    host = F.lower(F.regexp_extract(F.coalesce(pages["url"].cast("string"), F.lit("")), HOST, 1))
    rows = pages.select(pages["page_id"], pages["url"], host.alias("host"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))

    def text_of_page(html_: pa.Array, trees: pa.Array) -> pa.Array:
        out = []
        for s, t in zip(html_.to_pylist(), trees.to_pylist()):
            own = set(t or ())
            out.append(read(s, own.__contains__ if own else None)[0])
        return pa.array(out, pa.string())

    joined = rows.join(found, "host", "left") if not found.isEmpty() else rows.withColumn("trees", F.expr("cast(null as array<bigint>)"))
    return joined.select("page_id", "url", F.arrow_udf(text_of_page, "string")("html", "trees").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
