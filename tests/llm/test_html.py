"""Main text: a slow second reading of the tables' pages, templates, and pages of other makes."""

import html.parser

import pytest

from tagloom.llm import html_main
from tagloom.llm.html_main import main_text

ARTICLE_BLOCKS = {"p", "h1", "h2", "h3", "br", "li", "ul", "ol", "blockquote", "div", "section", "figure", "figcaption", "table", "tr", "td", "pre", "hr"}


class Plain(html.parser.HTMLParser):
    """Text of article elements, block by block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in ARTICLE_BLOCKS:
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag in ARTICLE_BLOCKS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth > 0:
            self.blocks[-1] += data


def plain(page):
    p = Plain()
    p.feed(page)
    p.close()
    return " ".join(t for b in p.blocks if (t := " ".join(b.split())))


def test_pages_of_the_tables(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: plain(r.html) for r in df.collect()}
    got = html_main.extract_main_text(df).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    assert all(want.values())


def test_the_join_path_gives_the_same(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: r.text for r in html_main.extract_main_text(df).collect()}
    monkeypatch.setattr(html_main, "BROADCAST_TOKENS", 0)
    assert {r.page_id: r.text for r in html_main.extract_main_text(df).collect()} == want


SITE = (
    "<html><head><title>{title} - Site</title></head><body><div class=c1><div class=c2><b>The Daily Site</b> <span>News you can use</span></div>"
    "<table><tr><td><a href=/a>World</a></td><td><a href=/b>Sport</a></td></tr></table></div><div class=c3><div class=c4><h2>{title}</h2>{story}</div>"
    "<div class=c5><p>Tell your friends about us</p><p>Printed on paper</p></div></div><div class=c6><ul>{links}</ul></div>"
    "<div class=c7><p>All rights reserved by the publisher</p><span>Imprint and contact</span></div></body></html>"
)


def site(n):
    """Pages of a host without any telling element, class or id, and their stories."""
    pages, want = [], []
    for k in range(n):
        story = [f"Story {k} begins here", f"and goes on with words {k * 7} of its own"][: 1 + k % 2] + [f"and ends with {k * 3} more"]
        links = "".join(f"<li><a href=/{k}/{i}>Other story {k + i}</a></li>" for i in range(3 + k % 3))
        pages.append(SITE.format(title=f"Head {k}", story="".join(f"<p data-id='menu-{k}' title='the id=menu field' data-hidden='false'>{b}</p>" for b in story), links=links))
        want.append(" ".join([f"Head {k}", *story]))
    return pages, want


def test_slots_are_the_result_where_no_element_tells(spark):
    """The template of a site without article, main or telling classes leaves the stories; without it they are not told."""
    pages, want = site(12)
    df = spark.createDataFrame([(k, f"http://plain.example/{k}", p, "h", "t", 1) for k, p in enumerate(pages)], "page_id int, url string, html string, host string, text string, kind int")
    got = {r.page_id: r.text for r in html_main.extract_main_text(df).collect()}
    assert got == dict(enumerate(want))
    assert all(main_text(p) != w for p, w in zip(pages, want))


def test_repeated_pages_of_a_host(spark):
    """A row that comes many times is as many pages of its host; a host of copies alone keeps their texts."""
    pages, want = site(6)
    rows = [(k, f"http://plain.example/{k}", p) for k, p in enumerate(pages)] + [(0, "http://plain.example/0", pages[0])] * 20 + [(9, "http://copies.example/", pages[1])] * 9
    got = html_main.extract_main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    assert len(got) == len(rows) and {r.text for r in got if 1 <= r.page_id < 6} == set(want[1:])
    assert all(want[0].removeprefix("Head 0 ") in r.text for r in got if r.page_id == 0) and all(want[1] in r.text for r in got if r.page_id == 9)


def test_large_templates_and_deep_stacks_take_little_time():
    import random
    import time

    rng = random.Random(0)
    page = "<body>" + "".join(f"<b{k}>x{k}</b{k}>" for k in range(4000))
    items = html_main.tokenize(page)
    tokens = [x.token for x in items if x.token]
    crossing = html_main.Template({t: (rng.randrange(2500), float(k), 5) for k, t in enumerate(tokens)})
    began = time.perf_counter()
    found = html_main.template_positions(items, crossing)
    html_main.tokenize("<div>" * 20_000 + "</b>" * 20_000)
    assert time.perf_counter() - began < 5 and found


def test_what_the_sweep_keeps_nests():
    import random

    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 14)
        classes: dict = {}
        for at in range(n):
            classes.setdefault(rng.randrange(5), []).append(at)
        kept = html_main._nested(classes)
        for a in kept:
            for b in kept - {a}:
                gaps = lambda x, y: {sum(o < i for o in y) for i in x}
                assert len(gaps(classes[a], classes[b])) == 1 or len(gaps(classes[b], classes[a])) == 1
        crosses = lambda a, b: len({sum(o < i for o in classes[b]) for i in classes[a]}) > 1 and len({sum(o < i for o in classes[a]) for i in classes[b]}) > 1
        assert {a for a in classes if not any(crosses(a, b) for b in classes if b != a)} <= kept


WRAP = "<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body>{}</body></html>"


@pytest.mark.parametrize(
    "body,want",
    [
        ("<header>Site</header><nav>Menu</nav><article><h1>Head</h1><p>One &amp; two&nbsp;x</p><p>T<b>hr</b>ee</p></article><footer>F</footer>", "Head One & two x Three"),
        ("<article><p>A</p><aside>side</aside><form>f<input></form><div class='ad-slot'>ad</div><p>B</p></article>", "A B"),
        ("<article><p>A</p><section id=comments><p>rude</p></section></article><div class=comments><article><p>c</p></article></div>", "A"),
        ("<div class='cookie-notice'>We use cookies</div><main><p>Main text</p></main><div id='sidebar'>s</div>", "Main text"),
        ("<div id=top-menu><a href=/>Home</a></div><div class='post-content'><p>Post</p>tail</div><div class='sidebar'>no</div>", "Post tail"),
        ("<form id=page><article><p>Inside a form</p></article></form>", "Inside a form"),
        ("<article><p>open<p>next<ul><li>i<li>j</ul>tail", "open next i j tail"),
        ("<article>a<br>b<script>if (a < b) document.write('</article>')</script>c<style>p{}</style><!-- no --></article>", "a bc"),
        ("<div class='content has-sidebar'><article><div class=post-header><h1>Head</h1></div><div class=masthead>x</div><p>Body</p></article></div>", "Head Body"),
        ("<article><p>x &lt;tag&gt; &#233;&#x1F4DA; &unknown; &am</p></article>", "x <tag> é📚 &unknown; &am"),
        ("<p>Only text with enough words to be the page's content.</p><ul><li><a href=a>Link</a></li><li><a href=b>Other</a></li></ul>", "Only text with enough words to be the page's content."),
        ("<article><header><h1>Title</h1></header><p>Body</p></article>", "Title Body"),
        ("<article></article>", ""),
        ("<ARTICLE><P CLASS=Ad>ad</P><P>Caps</P></ARTICLE>", "Caps"),
        ("<article><table><tr><td>a</td><td>b</td></tr></table><pre>c\n  d</pre></article>", "a b c d"),
    ],
)
def test_pages_of_other_makes(body, want):
    assert main_text(WRAP.format(body)) == want


def test_broken_pages():
    assert main_text(None) == "" and main_text("") == "" and main_text("plain  text") == "plain text"
    for page in ("<", "<div", "<div a='", "<article><p>x", "</div></div>", "<script>never", "<!--", "<p <p>", '<a href="x>y</a>'):
        main_text(page)
    assert main_text("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>") == "deep"
    assert main_text("<article>" + "<p>word</p>" * 20_000 + "</article>").count("word") == 20_000


def test_template_text_goes_where_no_element_says_what_is_content(spark):
    page = "<html><body><div><b>Our site</b><i>since 1990</i></div><div><p>{}</p></div><div><i>All rights reserved</i></div></body></html>"
    rows = [(k, f"http://h.example/{k}", page.format(f"story {k} with words of its own")) for k in range(8)]
    rows += [(100, None, page.format("alone")), (101, "http://other.example/", None), (102, "nonsense", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_main.extract_main_text(df).collect()}
    assert {k: got[k] for k in range(8)} == {k: f"story {k} with words of its own" for k in range(8)}
    assert got[100] == "Our sitesince 1990 alone All rights reserved" and got[101] == got[102] == ""
    template = html_main.deduce(df.selectExpr("'h.example' as host", "page_id as page", "html").where("page_id < 8")).collect()
    assert len({r["class"] for r in template}) >= 1 and len(template) > 10
    assert html_main.extract_main_text(df.limit(0)).count() == 0


def test_classes_hold_tokens_with_the_same_occurrences(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet").limit(60).selectExpr("'one.host' as host", "page_id as page", "html")
    pages = [html_main.tokenize(r.html) for r in df.collect()]
    vectors = {}
    for k, items in enumerate(pages):
        for x in items:
            if x.token:
                vectors.setdefault(x.token, [0] * len(pages))[k] += 1
    keep = {t: tuple(v) for t, v in vectors.items() if sum(map(bool, v)) >= max(2, len(pages) / 2)}
    by_vector = {}
    for t, v in keep.items():
        by_vector.setdefault(v, set()).add(t)
    want = sorted(sorted(c) for c in by_vector.values() if len(c) > 1)
    by_class = {}
    for r in html_main.deduce(df).collect():
        by_class.setdefault(r["class"], set()).add(r.token)
    assert sorted(sorted(c) for c in by_class.values()) == want


def test_only_ordered_and_nesting_classes_are_valid():
    items = html_main.tokenize("<a1></a1><b1></b1><c1></c1><d1></d1>")
    t = [x.token for x in items]
    template = html_main.Template({t[0]: (1, 0.0), t[6]: (1, 6.0), t[2]: (2, 1.0), t[4]: (2, 3.0)})
    assert html_main.template_positions(items, template) == {0, 2, 4, 6}
    crossing = html_main.Template({t[0]: (1, 0.0), t[4]: (1, 2.0), t[5]: (1, 2.5), t[2]: (2, 1.0), t[6]: (2, 3.0)})
    assert html_main.template_positions(items, crossing) == {0, 4, 5}
    disordered = html_main.Template({t[0]: (1, 9.0), t[6]: (1, 1.0)})
    assert html_main.template_positions(items, disordered) == set()


def test_fixed_blocks_inside_articles_go_by_page_kind(spark):
    """Boxes of a host's articles under neutral classes go, on a kind that a third of the host's pages are of."""
    page = "<html><body><article class='{}'><h1>Head {}</h1><div class=box1><p>Tell your friends</p><p>Ann writes here.</p></div><p>By <b>{}</b></p><p>Story {}.</p></article></body></html>"
    plain_page = "<html><body><div class=list><p>Entry {} of many</p></div></body></html>"
    rows = [(k, f"http://h.example/{k}", page.format("story", k, f"Name {k}", f"with words {k}")) for k in range(6)]
    rows += [(k, f"http://h.example/{k}", plain_page.format("x" * k)) for k in range(10, 22)]
    copy = "<html><body><article><p>The same story</p></article></body></html>"
    rows += [(k, f"http://copies.example/{k}", copy) for k in range(30, 35)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_main.extract_main_text(df).collect()}
    assert {k: got[k] for k in range(6)} == {k: f"Head {k} By Name {k} Story with words {k}." for k in range(6)}
    assert all(got[k] == "The same story" for k in range(30, 35))


@pytest.mark.parametrize(
    "body,want",
    [
        ("<article class='post category-social-media tag-search hentry'><p>Story</p></article>", "Story"),
        ("<article><p>A</p><section id='related-work'><h2 id='search'>Search</h2><p>B</p></section></article>", "A Search B"),
        ("<article><h1 class=page-header>Head</h1><div class='post-content share-enabled'><p>A</p></div></article>", "Head A"),
        ("<div style='overflow:hidden'><article data-id='search-3' title='x class=ad hidden'><p>Story</p></article></div>", "Story"),
        ('<div style="overflow: hidden"><article><p>Story</p></article></div>', "Story"),
        ("<form id=aspnetForm action=/><p>A whole page in a form</p><p>of two blocks</p><input></form>", "A whole page in a form of two blocks"),
        ("<article><p>A</p><div class='grid related-posts-plugin'><a href=/b>Other story</a></div><p hidden>no</p></article>", "A"),
        ("<article><p>A story</p></article><article class='comment even'><p>rude</p></article>", "A story"),
    ],
)
def test_single_words_of_names_drop_no_content(body, want):
    assert main_text(WRAP.format(body)) == want


LONG = " ".join(f"long story {k}" for k in range(40))


@pytest.mark.parametrize(
    "body,want",
    [
        (f"<main><div class='post-body'><p>{LONG}</p></div><div class='more'><article><p>teaser</p></article></div></main>", f"{LONG} teaser"),
        (f"<div class='post-content'><p>{LONG}</p></div><div class=more><article><p>teaser</p></article></div>", LONG),
        (f"<main><article><p>{LONG}</p></article><p>Short note of the site</p></main>", LONG),
        ("<div class=content><article><p>A short story</p></article>" + "<ul>" + "<li><a href=x>Another story's headline</a></li>" * 9 + "</ul></div>", "A short story"),
        (f"<article><p>{LONG}</p></article>" + "<div class=entry><p>One more entry of a list</p></div>" * 90, LONG),
    ],
)
def test_a_small_article_displaces_no_larger_element(body, want):
    assert main_text(WRAP.format(body)) == want


BODY = "<p>First paragraph of the story, long enough to say something.</p><p>Second paragraph of it.</p>"
TOLD = "First paragraph of the story, long enough to say something. Second paragraph of it."


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<article><h1>Head</h1><div class='widget text-block'>{BODY}</div></article>", f"Head {TOLD}"),
        (f"<article><div class='banner-title'><h1>Head</h1></div>{BODY}</article>", f"Head {TOLD}"),
        (f"<article><h1>Head</h1>{BODY}</article><div class='user-feedback'><article><p>I agree.</p></article><article><p>So do I, and at length.</p></article></div>", f"Head {TOLD}"),
        # parts of one element stay, headed or not; comments inside an article go, however long
        (f"<main><article><h1>Head</h1><p>One.</p></article><article>{BODY}</article></main>", f"Head One. {TOLD}"),
        (f"<article><h1>Head</h1>{BODY}<div class='comments'>{BODY * 5}</div></article>", f"Head {TOLD}"),
        (f"<article><h1>Head</h1>{BODY}<div class='sidebar'><p>See also.</p></div></article>", f"Head {TOLD}"),
        (f"<div class='a'><article>{BODY}</article></div><div class='b'><article><p>Third.</p></article></div>", f"{TOLD} Third."),
    ],
)
def test_parts_of_articles_and_articles_beside(page, want):
    assert main_text(f"<html><body>{page}</body></html>") == want


def test_columns_with_clashing_names(spark):
    rows = [(1, "http://h.example/1", f"<article>{BODY}</article>", "x", 2, 3), (2, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, template int, kind int")
    assert sorted(map(tuple, html_main.extract_main_text(df).collect())) == [(1, "http://h.example/1", TOLD, len(TOLD)), (2, None, "", 0)]
