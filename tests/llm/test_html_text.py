import re

import pytest

from upland.llm import html_text
from upland.llm.html_text import read

ROW = "page_id long, url string, html string"


@pytest.mark.parametrize("source, text", [
    (None, ""), ("", ""), ("just text &amp; more", "just text & more"), ("<p>a<b>b</b>c<p>d\n  e<br>f", "abc d e f"),
    ("<html><body><nav>menu</nav><article><h1>T</h1><p>one <i>two</i></p><div class='comments'>bad</div></article><footer>f</footer></body></html>", "T one two"),
    ("<body class='has-sidebar'><div class='cookie-notice'>x</div><p>text</p><aside>y</aside></body>", "text"),
    ("<div><script>var a='<p>no</p>';</script><style>p{}</style>yes<!-- no --></div>", "yes"), ("<p>open <!-- never closed", "open"), ("<script>never closed", ""),
    ("<form><article>in a form</article></form>", "in a form"), ("<div class=sidebar-left-layout><main>m</main></div>", "m"), ("a &#233; &eacute; &lt;b&gt; &nbsp; z", "a é é <b> z"),
    ("<article><p>x<article class=comment>c</article></article>", "x"), ("<article>a<ul><li>1<li>2</ul></article>", "a 1 2"), ("</div></p>x</article>", "x"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("<article><header><h1>t</h1></header>b</article>", "t b"), ("<header>h</header><p>b", "b"), ("<div role=navigation>n</div><div hidden>h</div><p>b", "b"), ("<article>" + "<p>w</p>" * 3000 + "</article>", " ".join(["w"] * 3000)),
])
def test_main_text(source, text):
    assert read(source)[0] == text


def test_recurring_subtrees_go_and_articles_stay(spark):
    shared = "<div><p>Our paper is printed daily.</p></div>"
    rows = [(i, "http://a.example/" + str(i), f"<body>{shared}<div><p>Story number {i} of the day.</p></div></body>") for i in range(30)]
    rows += [(100 + i, f"http://b.example/{i}", f"<body>{shared}<p>Other {i}</p></body>") for i in range(3)]
    rows += [(200 + i, f"http://c.example/{i}", "<body><div><p>The same page, mirrored.</p></div></body>") for i in range(30)]
    rows += [(300 + i, f"http://d.example/{i}", f"<article><p>A line that all share.</p><div class='box'>Read on!</div><p>Text {i}</p></article>") for i in range(30)]
    rows += [(400, None, None), (401, "no url", "<p>x"), (401, "no url", "<p>x")]
    from pyspark.sql import functions as F
    pages = spark.createDataFrame(rows, ROW).withColumn("host", F.lit(1)).withColumn("trees", F.lit(2)).withColumn("text", F.lit(3))
    out = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()]
    assert len(out) == len(rows) and all(n == len(t) for _, t, n in out)
    got = {i: t for i, t, _ in out}
    assert all(got[i] == f"Story number {i} of the day." for i in range(30))
    assert got[101] == "Our paper is printed daily. Other 1"
    assert got[205] == "The same page, mirrored."
    assert got[307] == "A line that all share. Text 7"
    assert got[400] == "" and got[401] == "x"
    assert html_text.extract(spark.createDataFrame([], ROW)).count() == 0


def test_pages_table(spark, data):
    """The given pages hold their text in one article: tags taken off it by a plain expression give the same words."""
    import html
    pages = spark.read.parquet(f"{data}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = html_text.extract(pages).collect()
    assert len(rows) == len(source)
    for r in rows:
        body = re.search(r"<article>(.*)</article>", source[r["page_id"]], re.S)[1]
        plain = html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", body)))
        assert r["text"] == " ".join(plain.split())
