"""Main text of pages: structures, consensus of hosts, odd rows, the planted articles of the test pages."""

import html as H
import re
import signal

import duckdb
import pytest

import __spark_entry__ as E
from kiln.llm import htmltext

LONG = "words of a reader who goes on and on about the matter " * 30
CASES = {
    "wrapped in a sidebar layout, with comments, shares and a notice": (
        '<html><body class="no-sidebar"><div id=page-12 class="wrap has-sidebar"><div class=header><h2>Site</h2></div><div class="content post-77">'
        '<div class=article-header><h1>Title &amp; more</h1></div><p>One <b>two</b>\n three.<p>Four <a href=x>five</a> six &lt;ok&gt; &#233;<ul><li>a<li>b</ul>'
        f'<div class=share-buttons>Share</div></div><div id=comments><div class=comment><p>{LONG}</p></div></div></div><div class=cookie-notice>We use cookies</div><footer>F</footer></body>',
        "Title & more\nOne two three.\nFour five six <ok> é\na\nb"),
    "article with a header, an aside and comments as articles": (
        "<nav>n</nav><article><header><h1>T</h1><p>by me</p></header><p>Body text<script>if(a<b){}</script> more<!-- c --> text</p><aside>side</aside><footer>foot</footer></article>"
        '<section class=comments><article class=comment><p>c1</p></article></section>', "T\nBody text more text"),
    "unclosed elements and a cut tag": ("<body><article><p><b>a<br>b<p>c<td>d</article><footer>no <div", "a b\nc\nd"),
    "no markup": ("plain text &amp; more", "plain text & more"),
    "forms, selects, buttons": ("<main><p>keep this</p><form><input><p>Your mail</p><button>Send</button></form><select><option>x</select></main>", "keep this"),
    "form around the page": (f"<form id=f><div class=main><p>{LONG}</p></div></form>", LONG.strip()),
    "a page builder's widget": (f"<body><h1>Top</h1><div class='elementor-widget post-content'><p>{LONG}</p></div><div class=widget><p>other</p></div></body>", "Top\n" + LONG.strip()),
    "white space": ("<article><p>  a \n\t b&nbsp;c </p>\n\n<p> </p><p>d</p></article>", "a b c\nd"),
    "advert longer than the article": (f"<body><div class=ad><p>{LONG}</p></div><article><h1>Short</h1><p>Short.</p></article>", "Short\nShort."),
    "hidden": ('<article><p>see</p><p hidden>no</p><div style="display: none">no</div><span class="ad">no</span></article>', "see"),
    "raw text": ("<article><p>a</p><style>p{}</style><textarea>x</textarea><noscript>y</noscript><svg><text>z</text></svg><p>b</p></article>", "a\nb"),
    "icons that close themselves": ("<article><p>a <svg class=i/> b<svg viewBox='0 0 1 1' />c</p><math/><p>d</p><svg class=menu><p>e</p></article><footer>f</footer>", "a b c\nd\ne"),
    "custom elements": ("<article><p>a <svg-icon name=x></svg-icon>b</p><style-guide><p>c</p></style-guide><template-x><p>d</p></template-x><title-bar>e</title-bar></article>", "a\nb\nc\nd\ne"),
    "formulas": ("<article><p>Let <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mi>y</mi></mfrac></math> be</p></article>", "Let x=1y be"),
    **{f"all in a wrapper named {c}": (f"<body><header><h1>Site</h1></header><div class='{c}'><h2>Head</h2><div class=text><p>{LONG}</p></div><div class=share>Share</div>"
                                      f"<div class=comments><p>{LONG * 2}</p></div></div><div class=sidebar>side</div><footer>f</footer></body>", "Head\n" + LONG.strip())
       for c in ("layout no-sidebar", "wrap has-sidebar", "menu-open", "hidden-print", "social-theme", "ad-free")},
    "wrappers in wrappers": (f"<section id=no-sidebar><div class=menu-open><h2>Head</h2><p>{LONG}</p></div><div class=cookie-notice>{LONG[:300]}</div></section>", "Head\n" + LONG.strip()),
    "long sidebar beside a short article": (f"<body><article><h2>Short</h2><p>Short.</p></article><div class=sidebar><p>{LONG}</p></div></body>", "Short\nShort."),
    "long menu of links": (f"<body><div class=menu><a href=x>{LONG}</a></div><div class=text><p>Short text.</p></div></body>", "Short text."),
    "cookie box longer than the text": (f"<body><div class=cookie-consent><p>{LONG}</p></div><div class=text><h2>Head</h2><p>{LONG[:800]}</p></div></body>", "Head\n" + LONG[:800].strip()),
    "lead and end beside a long body": (f"<body><div class=page><div class=post><div class=lead><p>The lead.</p></div><div class=body><div><p>{LONG}</p></div></div>"
                                        "<div><p>The end.</p></div></div><div class=tags><a href=x>tag one</a></div></div><div class=foot><p>Foot</p></div></body>",
                                        f"The lead.\n{LONG.strip()}\nThe end."),
    "short sections": (f"<article><div><div><div><div><section><p>{LONG}</p></section><section><h2>Two</h2><p>Short.</p></section></div></div></div></div></article><p>not of it</p>",
                       f"{LONG.strip()}\nTwo\nShort."),
    "lead in the body": (f"<body><h1>T</h1><p>The lead.</p><div class=text><p>{LONG}</p></div></body>", f"T\nThe lead.\n{LONG.strip()}"),
    "lead without a body": (f"<p>The lead.</p><div class=text><p>{LONG}</p></div>", f"The lead.\n{LONG.strip()}"),
    **{f"named {tag} {attrs}": (f"<body><nav>n</nav><article><h1>T</h1><p>{LONG}</p><{tag} {attrs}>{inner}</{tag.split()[0]}><p>End.</p></article><div class=comments><p>{LONG}</p></div></body>",
                                f"T\n{LONG.strip()}\n{want}\nEnd.")
       for tag, attrs, inner, want in [
           ("h2", 'id="related-work"', "Related work", "Related work"), ("h2", 'id="search-and-navigation"', "Search", "Search"), ("h2", "id=form", "Form", "Form"),
           ("h3", "id=share", "Share", "Share"), ("p", 'class="first print"', "In print.", "In print."), ("ul", 'class="popular-songs"', "<li>One<li class=menu-item>Two", "One\nTwo"),
           ("dl", "", "<dt id=print>Print</dt><dd class=reply>Said</dd>", "Print\nSaid"), ("table", "class=search", "<tr><td class=social>a</td><td id=menu>b</td></tr>", "a\nb"),
           ("div", 'class="form-factor"', "<p>The form factor.</p>", "The form factor."), ("section", 'id="discussion"', f"<h2>Discussion</h2><p>{LONG}</p>", f"Discussion\n{LONG.strip()}"),
           ("div", 'class="survey-responses"', "<p>Ten people answered.</p>", "Ten people answered."), ("div", "class=discussion", f"<p>{LONG}</p>", LONG.strip()),
           ("div", "class=related", f"<h2>Related work</h2><p>{LONG}</p>", f"Related work\n{LONG.strip()}"),
           ("p", "", 'An <span class="ad-hoc">ad hoc</span> <em class=reply>reply</em> and <a class=social href=x>a word</a> of it.', "An ad hoc reply and a word of it.")]},
    **{f"boilerplate {attrs} in an article": (f"<article><h1>T</h1><p>{LONG}</p><{tag} {attrs}>{inner}</{tag}><p>End.</p></article>", f"T\n{LONG.strip()}\nEnd.")
       for tag, attrs, inner in [
           ("div", "class=share-buttons", "Share this"), ("ul", 'class="popular-songs"', "<li><a href=x>One song</a><li><a href=y>Two songs</a>"), ("div", "class=related", "<a href=x>Another story</a>"),
           ("div", 'class="cookie-notice"', f"<p>{LONG}</p>"), ("div", "id=comments", f"<div class=comment><p>{LONG}</p></div>"), ("div", "class=discussion", f"<div class=reply><p>{LONG}</p></div>"),
           ("section", "class=responses", f"<p>{LONG}</p><form><p>Yours</p></form>"), ("p", "class=advertisement", "Buy!"), ("div", "class='newsletter-signup'", "<p>Your mail?</p>"), ("div", 'class="wp-block-search"', "Find")]},
    "a path of many steps": ("<body>" + "<div class=a><div class=b>" * 25 + f"<p>{LONG}</p>" + "</div></div>" * 25 + "</body>", LONG.strip()),
    "empty": ("", ""), "null": (None, ""), "nothing but a menu": ("<nav><a href=x>a</a></nav>", ""),
}


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(k, f"http://site{k}.example/x", h, "old", 1) for k, (h, _) in enumerate(CASES.values())]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, path int").repartition(3)
    return {r["page_id"]: r for r in htmltext.extract(df).collect()}


@pytest.mark.parametrize("k", range(len(CASES)), ids=list(CASES))
def test_page(texts, k):
    want = list(CASES.values())[k][1]
    assert texts[k]["text"] == want and texts[k]["n_chars"] == len(want)


def test_host_consensus(spark):
    # on most pages of the host the text is in div.story; on one page an odd box is longer
    page = lambda story, box: f"<body><div class=box><p>{box}</p></div><div class=story><p>{story}</p></div></body>"
    rows = [(i, f"https://Host.example:80/{i}", page("story text here and on " * 20, "box")) for i in range(5)]
    rows += [(9, "https://user@host.example/9", page("a short story", LONG)), (10, None, page("a short story", LONG)), (11, "https://other.example", page("a short story", LONG))]
    rows += [(12, "//host.example", "<body><p>no such box</p></body>"), (9, "https://host.example/9", page("a short story", LONG)), (None, "nonsense", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {}
    for r in htmltext.extract(df).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert got[9] == ["a short story"] * 2 and got[10] == got[11] == [LONG.strip()] and got[12] == ["no such box"] and got[None] == ["x"]
    assert {r["host"]: r["path"] for r in htmltext.host_paths(df).collect()}["host.example"] == "body>div.story"
    assert htmltext.extract(df.limit(0)).collect() == []


def test_host_consensus_keeps_leads(spark):
    page = lambda lead: f"<body><div class=post>{lead}<div class=text><p>{LONG}</p></div></div></body>"
    rows = [(i, "http://host.example/", page("<div class=lead><p>The lead.</p></div>" if i < 2 else "")) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: ("The lead.\n" if i < 2 else "") + LONG.strip() for i in range(6)}


def test_boxes_that_a_host_repeats(spark):
    """A box whose name only hints goes if most pages of its host have it, and stays where it is a page's own."""
    page = lambda i, box: f"<article><p>{i} {LONG}</p><div class='promo-strip'><p>{box}</p></div></article>"
    rows = [(i, "http://a.example/", page(i, "Read our magazine." if i else "Of this page alone.")) for i in range(5)]
    rows += [(10 + i, "http://b.example/", page(i, f"Text number {i}.")) for i in range(5)] + [(20 + i, None, page(i, "Read our magazine.")) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = lambda i: f"{i} {LONG}".strip()
    assert got == {**{i: text(i) + ("" if i else "\nOf this page alone.") for i in range(5)}, **{10 + i: f"{text(i)}\nText number {i}." for i in range(5)},
                   **{20 + i: f"{text(i)}\nRead our magazine." for i in range(4)}}


def test_votes_by_hand(spark):
    """Scores and votes written out for pages of one host; of equal votes the last path in order."""
    def page(**sizes):
        return "<body>" + "".join(f"<div class={k}><div class=in><p>{'x' * n}</p></div></div>" for k, n in sizes.items()) + "</body>"

    sizes = [{"a": 900, "b": 100}, {"a": 100, "b": 800}, {"b": 500, "c": 500}, {"c": 1}]
    votes = {}
    for s in sizes:
        scores = {f"body>div.{k}>div.in": float(n) for k, n in s.items()}
        scores |= {f"body>div.{k}": n * 0.95 for k, n in s.items()} | {"body": sum(s.values()) * 0.95**2}
        best = max(scores, key=lambda p: (scores[p], -p.count(">")))
        votes[best] = votes.get(best, 0) + round(1000 * min(1.0, scores[best] / sum(s.values())))
    rows = [(i, "http://h.example/", page(**s)) for i, s in enumerate(sizes)]
    got = htmltext.host_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).first()
    assert got["path"] == max(votes, key=lambda p: (votes[p], p)) and got["repeated"] is None
    tie = [(0, "http://t.example/", page(a=9)), (1, "http://t.example/", page(b=9))]
    assert htmltext.host_paths(spark.createDataFrame(tie, "page_id long, url string, html string")).first()["path"] == "body>div.b>div.in"


def test_deep_and_long_pages():
    assert htmltext.Page("<div>" * 3000 + "deep" + "</div>" * 3000).text(None) == "deep"
    body = "".join(f"<p>paragraph {i}</p>" for i in range(20_000))
    assert htmltext.Page(f"<article>{body}</article>").text("article").count("\n") == 19_999


@pytest.mark.parametrize("attrs", ["data-x='{" + '"k":"v",' * 25, 'data-x="' + "{'k':" * 100, '"' * 101, "'\"" * 50, 'a="b" ' * 50 + '"'])
def test_cut_tags_with_many_quotes(attrs):
    def late(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, 10)
    try:
        assert htmltext.Page("<p>a</p><div " + attrs).text(None) == "a"
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def test_articles_of_the_test_pages(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r["text"] for r in E.queries()["op1_main_text"](spark, sf).collect()}
    pages = duckdb.sql(f"SELECT page_id, html FROM '{sf}/pages.parquet'").fetchall()
    assert len(got) == len(pages)
    for i, h in pages:
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", h, re.S)[1])
        want = [re.sub(r"\s+", " ", H.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in blocks]
        assert got[i] == "\n".join(b for b in want if b)
