"""Main text of pages: classes by hand, made-up sites, and the given pages against their article element."""

import html
import random
import re

import pandas as pd
import pytest

from mediacat.llm import templates as T
from mediacat.llm.queries import QUERIES


def texts(spark, rows):
    table = spark.createDataFrame([(i, u, h, "s", "t") for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string, source string, text string")
    got = T.extract_main_text(table).orderBy("page_id").collect()
    assert [r.n_chars for r in got] == [len(r.text) for r in got]
    return [r.text for r in got]


def own_text(source):
    """Of one page, without a template."""
    return T.main_text(T.read_page(source), set(), set(), set())


@pytest.mark.parametrize("inner, want", [
    ("<p>One &amp; two</p><p>Three</p>", "One & two\n\nThree"),
    ("<p>One<p>Two<br>three<b>four</b>", "One\n\nTwo threefour"),
    ("<p><b>Open.<br><p>Next &am and &amp", "Open.\n\nNext &am and &"),
    ("a < b <!-- no <p>x</p> --> c", "a < b c"),
    ("<script>var t='</p><p>no</p>'</script><style>p{}</style>Text", "Text"),
    ("<ul><li>x<li>y</ul><table><tr><td>1<td>2</table>", "x\n\ny\n\n1\n\n2"),
    ("<header><h1>Title</h1></header><p>Body</p><aside>beside</aside><footer>by me</footer>", "Title\n\nBody"),
    ("<p>Said</p><section class='comments'><article class=comment>no</article></section>", "Said"),
    ("<p>A</p><form><p>Mail</p></form><div id='cookie-notice'>ok?</div><div role=navigation>n</div><p hidden>h</p><p>B", "A\n\nB"),
    ("<p class='has-sidebar'>A</p><div class='share-box'>s</div><div style='display: none'>x</div>", "A"),
    ("", ""),
    ("<textarea>typed</textarea><p>  x \n\t y </p><p> </p>", "x y"),
])
def test_one_page(inner, want):
    around = "<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><div class='ad banner'>Buy</div>{}<footer>f</footer></body></html>"
    assert own_text(around.format(f"<article>{inner}</article>")) == want
    assert own_text(around.format(inner.replace("<header><h1>Title</h1></header>", "<h1>Title</h1>"))) == want


def test_classes_nest():
    def row(token, element, parent, pages, total, vector):
        return {"token": token, "element": element, "parent": parent, "slot": element == 3, "pages": pages, "total": total, "a": vector, "b": vector}

    rows = [
        row(1, 1, 0, 9, 9, 5), row(11, 1, None, 9, 9, 5), row(2, 2, 1, 9, 9, 5), row(90, None, None, 9, 9, 5),  # the page, a box, a fixed text
        row(3, 3, 2, 8, 8, 6), row(31, 3, None, 8, 8, 6), row(91, None, None, 8, 8, 6),  # a slot in the box, two tags only: its text stays
        row(4, 4, 3, 8, 40, 7), row(5, 5, 77, 9, 30, 8), row(92, None, None, 7, 7, 9),  # repeated tags; a stray element; a text of its own
    ]
    frame = pd.DataFrame(rows).astype({c: "Int64" for c in ("element", "parent")})
    assert T.nested_classes(frame.sample(frac=1, random_state=1)) == ({3}, {1, 2, 3, 4}, {90})


def site(rng, n, host, shell):
    out = []
    for i in range(n):
        body = [f"{host} {i} " + " ".join(rng.choice("queue node lease film frame".split()) for _ in range(rng.randrange(3, 30))) for _ in range(rng.randrange(1, 6))]
        out.append((f"https://{host}/{i}?x=1", shell.format(body="".join(f"<p>{b}</p>" for b in body)), "\n\n".join(body)))
    return out


def test_fixed_texts_of_a_host(spark):
    """Sites without an article element: what all pages have at one place goes, links in lists go, the rest stays."""
    rng = random.Random(3)
    shell = "<html><body><div class=top><b>Film blog</b></div><div class=box><h2>Latest</h2>{body}<div>All films are ours.</div></div><ul><li><a href=/>Start</a></ul></body></html>"
    pages = site(rng, 40, "films.example", shell)
    small = site(rng, 3, "few.example", shell)
    got = texts(spark, [p[:2] for p in pages + small])
    assert got[:40] == [p[2] for p in pages]
    assert got[40:] == ["Film blog\n\nLatest\n\n" + p[2] + "\n\nAll films are ours." for p in small]


def test_articles_keep_what_copies_share(spark):
    """A host of near copies of one article loses nothing of it; other pages of the host do not matter."""
    shell = "<html><body><nav>n</nav><article>{body}</article><div class=foot>fixed</div></body></html>"
    pages = [(f"http://m.example/{i}", shell.format(body=f"<p>The same text.</p><p>Copy {i}</p>")) for i in range(30)]
    got = texts(spark, pages + [(None, None), ("no url", ""), ("http://m.example/x", "<p>bare")])
    assert got == [f"The same text.\n\nCopy {i}" for i in range(30)] + ["", "", "bare"]
    assert texts(spark, pages[:1] * 3) == ["The same text.\n\nCopy 0"] * 3


def test_long_deep_and_broken(spark):
    deep = "<div>" * 20_000 + "end"
    long = "<article>" + "<p>word</p>" * 60_000
    broken = "<article><p class=\"x>lost</p>"
    assert texts(spark, [("http://a/", deep), ("http://a/", long), ("http://a/", broken), ("http://a/", "<")]) == ["end", "\n\n".join(["word"] * 60_000), "", "<"]
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert T.extract_main_text(empty).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        want[r.page_id, r.url] = "\n\n".join(t for b in blocks if (t := " ".join(html.unescape(b).split())))
    got = {(r.page_id, r.url): r.text for r in QUERIES["op13_template_extraction"](spark, folder).collect()}
    assert got == want
