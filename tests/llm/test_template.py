"""Template extraction: the provided layout, unmarked layouts, broken markup, degenerate rows."""

import html as H
import re

import numpy as np

from cohortlens.llm.queries import QUERIES
from cohortlens.llm.template import Block, Page, Template, main_texts

SF = "/root/testdata/sf0.001"


def plain_article(html):
    """The article of the provided pages' one layout, by string search."""
    body = html[html.index("<article>") + 9 : html.index("</article>")]
    blocks = re.split(r"</?(?:p|h\d)>", body)
    texts = [" ".join(H.unescape(re.sub("<[^>]*>", lambda m: " " if m[0] == "<br>" and False else "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_query_over_all_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = QUERIES["op10_template_extraction"](spark, SF).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r.text == plain_article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_containers_and_markup():
    page = """<html><head><title>t &amp; t</title><style>p{}</style></head><body><header>Site</header><div class="cookie-notice">We use</div>
    <main><article><h1>A &lt;title&gt;</h1><p>One <b>bold</b>er
       &nbsp; word<p>Two<ul><li>item<li>item</ul><div class="ad">Buy</div><script>if (a</b) "</p>"</script><!-- <p>no</p> -->
    <form>Name <input name=x></form><p>a < b and a<b class='x>y'>c</b></p><aside>side</aside></article>
    <section id="comments"><p>first!</p></section></main><footer>&copy;</footer></body></html>"""
    assert Page(page).main_text(frozenset()).split("\n") == ["A <title>", "One bolder word", "Two", "item", "item", "a < b and ac"]
    for broken, want in [("", ""), ("plain", "plain"), ("<article>open <p>x", "open\nx"), ("<p>a<!-- never closed", "a"), ("<a href='x>y</a> z", "y z"),
                         ("<script>x", ""), ("<nav>m</nav><p>b &#233;&eacute;</p>", "b éé"), ("</div></p>t", "t"), ("<article></article><p>out</p>", "")]:
        assert Page(broken).main_text(frozenset()) == want, broken


def test_unmarked_template_text_is_dropped(spark):
    def page(i):
        return f"<body><div><a>Home</a> <a>News</a></div><div><h2>Title {i}</h2><p>Body of {i}.</p><p>{'common' if i % 2 else 'rare'}</p></div><div>All rights</div></body>"

    rows = [(i, f"http://Big.example/{i}", page(i), "x") for i in range(40)] + [(100, "http://one.example/a?b", page(100), "y")]
    rows += [(200, None, "<p>no host</p>", "z"), (201, "http://big.example/e", None, "z"), (202, "not a url", "", "z"), (1, "http://big.example/1", page(1), "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    out = {}
    for r in main_texts(pages).collect():
        out.setdefault(r.page_id, []).append(r.text)
    assert out[3] == ["Title 3\nBody of 3.\ncommon"] and out[4] == ["Title 4\nBody of 4.\nrare"] and len(out[1]) == 2
    assert out[100] == ["Home News\nTitle 100\nBody of 100.\nrare\nAll rights"]  # one page: no template
    assert out[200] == ["no host"] and out[201] == [""] and out[202] == [""]
    assert main_texts(pages.limit(0)).count() == 0


def test_template_picks_the_slots_inside_the_article(spark, tmp_path):
    def page(i):
        return f"""<body><div>Site</div><article><h1>Title {i}</h1><div><p>Share this story</p></div><p>Body of {i}.</p>{"<p>More.</p>" * (i % 3)}
        <section><p>Read our terms</p></section></article><div>Around {i}</div></body>"""

    rows = [(i, f"http://big.example/{i}", page(i)) for i in range(12)]
    rows += [(50, "http://big.example/50", "<body><div>Site</div><div><p>No article here</p></div></body>")]
    rows += [(100 + i, f"http://few.example/{i}", page(i)) for i in range(4)]  # too few pages: by the containers alone
    rows += [(200 + i, f"http://copies.example/{i}", "<article><h1>Same</h1><p>text</p></article>") for i in range(8)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = {r.page_id: r.text.split("\n") for r in QUERIES["op10_template_extraction"](spark, str(tmp_path)).collect()}
    for i in range(12):
        assert out[i] == [f"Title {i}", f"Body of {i}."] + ["More."] * (i % 3)
    assert out[50] == ["No article here"]
    assert out[100] == ["Title 0", "Share this story", "Body of 0.", "Read our terms"]
    assert out[203] == ["Same", "text"]


def test_classes_are_ordered_and_nested():
    table = [(1, 10, 0), (2, 10, 1), (3, 10, 0), (7, 20, 1), (8, 20, 1)]  # tokens 1 2 3 around repeats of 7 8
    found, text = Template(np.array(table, np.int64).ravel()), Block("x", False, 99)
    order = [text, 1, text, 2, text, 7, text, 8, 7, text, 3, text]
    slots = [s for _, s in found.slots([(e, None, False) if isinstance(e, int) else (99, e, False) for e in order])]
    assert slots == [None, (10, 0), (10, 1), (20, 0), (20, 0), (10, 2)]
    assert [found.is_main(s) for s in slots[1:]] == [False, True, True, True, False]


def test_words_drop_whole_names_only():
    for page, want in [
        ("<div class='content no-sidebar'><article><h1>T</h1><p>x</p></article></div>", "T\nx"),
        ("<div class='sidebar'><article><p>x</p></article><p>side</p></div>", "x"),
        ("<article><h1 class='page-header'>T</h1><p class='notice-date'>May</p><p class='notice'>n</p><div class='ad'>Buy</div>x</article>", "T\nMay\nx"),
        ("<p class='ad'>Buy<p>Real text", "Real text"),
        ("<ul><li class='ad'>Buy<li>item</ul>", "item"),
        ("<table><tr><td class='promo'>Buy<td>cell<tr class='promo'><td>no<tr><td>yes</table>", "cell\nyes"),
        ("<p class='ad'>Buy<div>Real</div>", "Real"),
    ]:
        assert Page(page).main_text(None) == want, page


def test_containers_around_and_inside_articles():
    for page, want in [
        ("<article><p>Body</p></article><div class='comments'><article class='comment'><p>first!</p></article></div>", "Body"),
        ("<article><p>Body</p></article><article class='comment'><p>me too</p></article>", "Body"),
        ("<main><h1>T</h1><article><p>Body</p><div id='comments'><article><p>first!</p></article></div></article></main>", "T\nBody"),
        ("<div id='sidebar'><article><p>teaser</p></article></div><div><h1>T</h1><p>Body</p></div>", "T\nBody"),
        ("<div class='widget'><article><h1>T</h1><p>Body</p></article></div><div>Home</div>", "T\nBody"),
        ("<article><p class='ad'>Buy now</p><p>Body</p><p class='comment'>me too</p></article>", "Body"),
        ("<article><p>Body</p><ul class='comment-list'><li>first!</ul><div class='ad-slot'>Buy</div>tail</article>", "Body\ntail"),
        ("<div class='top-nav'>Home</div><p>Body</p><section class='related-posts'><h3>More</h3><p>x</p></section>"
         "<div class='social-links'>s</div>", "Body"),
        ("<div class='post-header'><h1>T</h1></div><p>Body</p>", "T\nBody"),
        ("<div class='layout-sidebar'><article><p>Body</p></article></div>", "Body"),
        ("<div class='content no-sidebar'><p>Body</p></div>", "Body"),
        ("<article>one<br>two<wbr>three <br/> four</article>", "one twothree four"),
        ("<article><h2 class='header'>Part</h2><p>Body</p></article>", "Part\nBody"),
        ("<aside><article>teaser</article></aside><p>Body</p>", "Body"),
        ("<article><p>" + "long word " * 300_000 + "</p></article>", ("long word " * 300_000).strip()),
    ]:
        assert Page(page).main_text(None) == want, page[:300]
