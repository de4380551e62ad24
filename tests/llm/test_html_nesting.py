"""Broken and deep nesting: read in one pass, and as short pages of the same kind are."""

import time

import pytest

from hetweave.llm import html_text, queries


@pytest.mark.parametrize("page", ["<div></p>" * 32_000, "<div>" * 3000 + "<body>" * 32_000, "<div>" * 30_000 + "<li>x" * 10_000, "<ul><li>" * 20_000 + "<dd>" * 10_000, "<tr><div>" * 20_000, "<span class=ad>" * 20_000 + "<div></span>" * 20_000, "<p><ins id=ads>" * 20_000])
def test_deep_pages_take_time_in_proportion(page):
    def seconds(text):
        began = time.process_time()
        html_text.parse(text)
        return time.process_time() - began

    seconds(page[:10_000])
    # eight times as long: 64 times the time if each tag walked over the open ones
    assert seconds(page) < 24 * max(seconds(page[: len(page) // 8]), 0.02)


def test_ends_stop_at_holders():
    def shape(page):
        return [(v.tag, v.parent, [t for _, t in v.runs]) for v in html_text.parse(page)]

    assert shape("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul>f") == [("html", -1, ["f"]), ("ul", 0, []), ("li", 1, ["a", "d"]), ("ul", 2, []), ("li", 3, ["b"]), ("li", 3, ["c"]), ("li", 1, ["e"])]
    assert shape("<table><tr><td>a<td>b<table><tr><td>c</table>d<tr><td>e") == [("html", -1, []), ("table", 0, []), ("tr", 1, []), ("td", 2, ["a"]), ("td", 2, ["b", "d"]), ("table", 4, []), ("tr", 5, []), ("td", 6, ["c"]), ("tr", 1, []), ("td", 8, ["e"])]
    assert shape("<div>a</p>b</div></div>c<p>d<div>e") == [("html", -1, ["c"]), ("div", 0, ["a", "b"]), ("p", 0, ["d"]), ("div", 0, ["e"])]


def test_query_over_deep_pages(spark, tmp_path):
    """op5 keeps the article under thousands of open elements; a null page is empty."""
    article = "<p>" + "The river rose in the night, and the town woke to water in its streets. " * 8 + "</p>"
    pages = [(1, "u", "<div>" * 4000 + f"<article>{article}</article>"), (2, None, None), (3, "u", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in queries.op5_html_text(spark, str(tmp_path)).collect()}
    assert got[1].text == article[3:-4].strip() and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[3].text, got[2].n_chars) == ("", "", 0)


def test_an_articles_own_header():
    """A title in the header of an article is kept, the page's header is not."""
    model = html_text.train(html_text.labelled_pages())
    text = "<p>" + "The river rose in the night, and the town woke to water in its streets. " * 5 + "</p>"
    body = text[3:-4].strip()
    plain = f"<body><article><header><h1>Title of it</h1></header>{text}</article></body>"
    page = f"<body><header><h1>My Site</h1></header><nav><a href=x>home</a></nav><article><header><h1>Title of it</h1><p>By the lake</p></header>{text}<footer>Copyright x</footer></article></body>"
    assert html_text.main_text(plain, model) == f"Title of it\n{body}"
    assert html_text.main_text(page, model) == f"Title of it\nBy the lake\n{body}"
    assert html_text.main_text(f"<body><header><h1>My Site</h1><p>Daily</p></header><main><h1>Title</h1>{text}</main></body>", model) == f"Title\n{body}"


TEXT = "The river rose in the night, and the town woke to water in its streets. " * 8
PROSE, BODY = f"<p>{TEXT}</p>", TEXT.strip()
LIST = "<ul><li><a href=x>Smith on floods</a></li><li><a href=y>Jones on rivers</a></li></ul>"
COOKIES = "We use cookies to make this site better for you."
ORDINARY = {
    "list of an article": (f"<main><h1>Title</h1>{PROSE}<h1>Sources</h1><p>These were read for it, in order.</p>{LIST}</main>", f"Title\n{BODY}\nSources\nThese were read for it, in order.\nSmith on floods\nJones on rivers"),
    "list under a heading": (f"<nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Title</h1>{PROSE}<h2>Further reading</h2>{LIST}</article>", f"Title\n{BODY}\nFurther reading\nSmith on floods\nJones on rivers"),
    "related list": (f"<article><h1>Title</h1>{PROSE}{PROSE}<div><h3>Related</h3>{LIST}</div></article>", f"Title\n{BODY}\n{BODY}"),
    "plain menu": (f"<div>{LIST}</div><div><h1>Title</h1>{PROSE}{PROSE}</div>", f"Title\n{BODY}\n{BODY}"),
    "named comments": (f"<article><h1>Title</h1>{PROSE}</article><div id='disqus_thread'><div class=post><p>I read it with joy, and my father did too.</p></div></div>", f"Title\n{BODY}"),
    "advert between": (f"<article><h1>Title</h1>{PROSE}<ins class='adsbygoogle'>Buy boots</ins>{PROSE}</article>", f"Title\n{BODY}\n{BODY}"),
    "advert in a line": (f"<article><h1>Title</h1><p>{BODY} <span class='advert'>Buy <span>boots</span> now</span> {BODY}</p></article>", f"Title\n{BODY} {BODY}"),
    "span in a line": (f"<article><h1>Title</h1><p>{BODY} <span class='x'>It was <b>wa</b>ter</span>, {BODY}</p></article>", f"Title\n{BODY} It was water, {BODY}"),
    "notice before": (f"<div>{COOKIES} <button>Accept</button></div><article><h1>Title</h1>{PROSE}{PROSE}</article>", f"Title\n{BODY}\n{BODY}"),
    "notice after": (f"<article><h1>Title</h1>{PROSE}{PROSE}</article><div>{COOKIES} <a href=/p>More</a> <button>Got it</button></div>", f"Title\n{BODY}\n{BODY}"),
}


def test_ordinary_markup():
    """Lists of an article stay; adverts in lines, comments under inner names and nameless notices go."""
    model = html_text.train(html_text.labelled_pages())
    got = {k: html_text.main_text(f"<html><body>{page}</body></html>", model) for k, (page, _) in ORDINARY.items()}
    assert got == {k: text for k, (_, text) in ORDINARY.items()}


def test_inline_nodes():
    """Inline elements that tell of adverts end where their own end tag or their block does."""

    def shape(page):
        return [(v.tag, v.parent, [(place[0], place[2], t) for place, t in v.runs]) for v in html_text.parse(page)]

    assert shape("<p>a<ins class=ad>b<ins>c</ins>d</ins> e</p>f") == [("html", -1, [(1, False, "f")]), ("p", 0, [(0, False, "a"), (0, True, "e")]), ("ins", 1, [(0, False, "bcd")])]
    assert shape("<p>a <span id=ads>b</p>c</span>d") == [("html", -1, [(1, False, "cd")]), ("p", 0, [(0, False, "a")]), ("span", 1, [(0, True, "b")])]
    assert shape("<span class=ad><div>a</span>b</div>c</span>d") == [("html", -1, [(1, False, "d")]), ("span", 0, [(1, False, "c")]), ("div", 1, [(0, False, "ab")])]
