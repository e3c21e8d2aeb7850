import html
import re
import time

import pyarrow.parquet as pq
import pytest

from tabloom.llm import extract as x
from tabloom.llm.common import table


def article(page):
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split())
             for p in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(p for p in parts if p)


@pytest.mark.parametrize("bound", [x.BROADCAST_HOSTS, 0])
def test_pages_against_their_articles(spark, sf, bound):
    pages = {r["page_id"]: (r["url"], article(r["html"])) for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()}
    got = x.extract(table(spark, sf, "pages"), broadcast_hosts=bound).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == pages
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)


FULL = """<html><body><header><h1>Site</h1><nav>m</nav></header><div id="left-sidebar">side</div><main><article class=post12>
<header><h1>Title &amp; x</h1><span>by me</span></header><p>One <a href=x>link</a> two<br>three<p>Four&nbsp; five<!-- no -->
<script>var a = "<p>no</p>";</script><ul><li>a<li>b</ul><div class="user-comments"><p>first!</p></div>
<form>q<input></form><p style="display: none">hidden</p></article><aside>z</aside></main><footer>f</footer>"""


def test_boilerplate_is_left_out():
    assert x.main_text(FULL, None) == "Title & x\n\nOne link two three\n\nFour five\n\na\n\nb"


def test_consensus_path_of_a_host(spark):
    def page(body, story="div class='story-7'"):
        return f"<body><div class=top>{'t ' * 9}</div><{story}>{body}</div><div class=more>{'other news ' * 40}</div>"

    rows = [(i, f"http://H.example.com/{i}", page("<p>" + "long text " * 80)) for i in range(5)]
    # alone, the last page's best part would be the other news
    rows += [(9, "https://h.example.com:80/9", page("<p>short story")), (10, None, "no tags &lt;here"), (11, "x", None),
             (12, "", ""), (9, "https://h.example.com:80/9", page("<p>short story"))]
    pages = spark.createDataFrame([(*r, "p") for r in rows], "page_id long, url string, html string, path string")
    got = x.extract(pages).collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted(
        [(i, " ".join(["long text"] * 80)) for i in range(5)] + [(9, "short story")] * 2
        + [(10, "no tags <here"), (11, ""), (12, "")])
    assert x.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<", "<p", "<p>a</div></p></p>b", "<!-- x", "<script>a", "<p a='>'>t", "</p>", "<a><p>x</a>y"])
def test_broken_pages_do_not_fail(page):
    assert isinstance(x.main_text(page, "/html"), str)


def test_very_long_page():
    assert len(x.main_text("<article>" + "<div><p>word</p>" * 3000, None)) == 3000 * 6 - 2


STORY = "".join(f"<p>Paragraph {i} of a long story with many plain words in it.</p>" for i in range(6))
STORY_TEXT = "\n\n".join(f"Paragraph {i} of a long story with many plain words in it." for i in range(6))


@pytest.mark.parametrize("wrapper", ["<div class='site has-sidebar'>", "<div class='overflow-hidden'>", "<div id='search-results'>",
                                     "<form id=aspnetForm method=post>", "<div class=widget>"])
def test_named_wrappers_keep_what_they_hold(wrapper):
    end = f"</{re.match('<([a-z]+)', wrapper)[1]}>"
    beside = "<div class='ad'>buy this</div><div id='comments'><p>first!</p></div>"
    for inside in (f"<article>{STORY}</article>{beside}", f"<div class='content'>{STORY}</div>{beside}"):
        assert x.main_text(f"<html><body>{wrapper}{inside}{end}<footer>f</footer></body></html>", None) == STORY_TEXT


def test_many_named_parts_of_an_article():
    parts = STORY.replace("<p>", "<div class='elementor-widget-container'><p>").replace("</p>", "</p></div>")
    page = f"<html><body><article>{parts}<div class='comments'><p>{'no ' * 300}</p></div></article></body></html>"
    assert x.main_text(page, None) == STORY_TEXT


def test_long_comments_do_not_win():
    page = (f"<html><body><div class=entry>{STORY}</div><div class='comment-list'><article class='comment-body'>"
            f"<p>{'words of a reader ' * 30}</p></article></div></body></html>")
    assert x.main_text(page, None) == STORY_TEXT


def test_pages_in_named_wrappers_vote(spark):
    rows = [(i, f"https://h.example.org/{i}", f"<body><div class='site has-sidebar'><article>{STORY}</article></div></body>", "p")
            for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    assert [r.path for r in x.host_paths(pages).collect()] == ["/body/div.has.sidebar.site/article"]
    assert {r.text for r in x.extract(pages).collect()} == {STORY_TEXT}


def test_broken_pages_are_linear():
    began = time.time()
    for page in ('<a "' * 250000, "<!" * 300000, "<" * 500000, "<div class='c'>" * 60000 + "x", "<div><li>" * 30000 + "</p>" * 30000,
                 "<ab" * 200000):
        x.blocks(page)
    assert time.time() - began < 20
    # a tag that never ends is text
    assert " ".join(b[1] for b in x.blocks('<p>one <a "two</p><p>three</p>')) == 'one <a "two three'
