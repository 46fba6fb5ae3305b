"""Main text of pages: odd markup by hand, hosts that vote, and the given pages by a plain rule."""

import html as entities
import re

import pytest
from helpers import FOLDER, prose

from boxscan.llm import html
from boxscan.llm.queries import LLM_QUERIES

BODY = [prose(k, 60) for k in range(4)]


def paragraphs(texts):
    return "".join(f"<p>{x}</p>" for x in texts)


CHROME = ("<header class=site><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul></nav>"
          "<div class='cookie-notice'><p>We use cookies, a lot of them.</p></div>")
TAIL = ("<aside class=sidebar><p>Read these other stories now.</p></aside><div id=comments><article class=comment><p>"
        + prose(99, 200) + "</p></article></div><form action=/s><p>Search here</p></form><footer>&copy; us</footer>")


@pytest.mark.parametrize("open_, close", [
    ("<article>", "</article>"),
    ("<main><div class='row'>", "</div></main>"),
    ("<div id=wrap class=layout><div class='post-body'>", "</div></div>"),
    ("<div class='page with-sidebar'><article class='post post-123'><div class=entry-content>", "</div></article></div>"),
    ("<div><div>", "</div></div>"),
    ("<table><tr><td>menu</td><td>", "</td></tr></table>"),
    ("<form id=aspnet><article>", "</article></form>"),
])
def test_templates(open_, close):
    page = f"<html><body>{CHROME}{open_}<h1>Title</h1>{paragraphs(BODY)}{close}{TAIL}</body></html>"
    assert html.extract(page, []) == "\n\n".join(["Title", *BODY])
    assert html.extract(page, [html.vote(page)]) == "\n\n".join(["Title", *BODY])


@pytest.mark.parametrize("source, want", [
    ("", ""), (None, ""), ("plain &lt;words&gt; &amp  only", "plain <words> & only"),
    ("<p>a<p>b<br>c</p>", "a\n\nb c"), ("<p>x &#65;&nbsp;\t&eacute;\n\n y &bogus; &", "x A é y &bogus; &"),
    ("<p>one<script>if (a < b) { '</p>' }</script> two<!-- <p>no</p> --> three", "one two three"),
    ("<p>a <b>bold <i>and</p><p>next</b>", "a bold and\n\nnext"), ("<p>1 < 2 <3 and </p>", "1 < 2 <3 and"),
    ("<ul><li>one<li>two</ul>", "one\n\ntwo"), ("<p>cut <a href='x", "cut"), ("<p>a<a href=\"q>b</a> c", "ab c"),
    ("<div hidden><p>no</p></div><p>yes", "yes"), ("<p>a</p><!-- never closed <p>b", "a"), ("<p>t</p></div></p></x>u", "t\n\nu"),
    ("<style>p{}</style><title>T</title><p>x", "x"), ("<P CLASS=Ad>no</P><P>yes", "yes"), ("<svg><p>s</p></svg>", ""),
    ("<dl><dt>k<dd>v</dl>", "k\n\nv"), ("<article><header><h1>T</h1></header><p>b</p><footer>f</footer></article>", "T\n\nb"),
    ("<div><ul><li><a>a1</a><li><a>b1</a><li><a>c1</a></ul><p>text of it</p></div>", "text of it"),
])
def test_odd_markup(source, want):
    assert html.extract(source, []) == want


def test_deep_and_long_pages_take_linear_time():
    for source in ("<div>" * 100_000 + "x", "<p>" * 100_000, "<a href=\"" * 20_000, "</section>" * 100_000 + "y", "<!--" * 50_000):
        html.extract(source, ["div"])
    assert len(html.extract("<p>" + "word " * 1_000_000, [])) == 4_999_999


def pages_of_hosts():
    """Host a: an unlabelled comment list that is longer than the article on some pages."""
    def page(article, below):
        return (f"<body><div class=text-a>{paragraphs(article)}</div><div class=text-b>{paragraphs(below)}</div></body>")

    rows = [(k, f"http://a.example/{k}", page(BODY, ["short"]), "n") for k in range(20)]
    rows += [(100 + k, f"https://u:p@A.example:80/{k}?x", page(BODY[:1], BODY[1:]), "n") for k in range(5)]
    rows += [(200, None, "<p>no host", "n"), (201, "http://b.example", None, None), (202, "not a url", "", "t"),
             (None, "http://a.example", page(BODY, []), "n"), (0, "http://a.example/0", page(BODY, ["short"]), "n")]
    return rows


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_hosts_outvote_single_pages(spark, monkeypatch, limit):
    monkeypatch.setattr(html, "BROADCAST_BYTES", limit)
    rows = pages_of_hosts()
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumnRenamed("text", "host")
    got = html.extract_pages(docs)
    assert got.columns == ["page_id", "url", "host", "text", "n_chars"]
    found = sorted(((r.page_id, r.host, r.text, r.n_chars) for r in got.collect()), key=repr)
    want = []
    for page_id, url, source, host in rows:
        if url and "a.example" in url.lower():
            text = "\n\n".join(BODY if page_id is None or page_id < 100 else BODY[:1])
        else:
            text = "no host" if source == "<p>no host" else ""
        want.append((page_id, host, text, len(text)))
    assert found == sorted(want, key=repr)


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract_pages(none).count() == 0


def test_query(spark):
    """All given pages keep their article between its tags."""
    got = {r.page_id: (r.text, r.n_chars) for r in LLM_QUERIES["op11_html_text"](spark, FOLDER).collect()}
    rows = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        inside = r.html[r.html.index("<article>") + 9:r.html.index("</article>")]
        blocks = (entities.unescape(re.sub("</?br?>", " ", x)).split() for x in re.split("</?(?:p|h1)>", inside))
        text = "\n\n".join(" ".join(x) for x in blocks if x)
        assert got[r.page_id] == (text, len(text))
