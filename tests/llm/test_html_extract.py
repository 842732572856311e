"""HTML extraction: hand-written layouts, a host's template, the pages of the test table."""

import html
import re
import time

import pytest

from factloom.llm.html_extract import Token, deduce, extract, extract_pages, parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>x</article>";</script></head>
<body class="has-sidebar"><header><a href="/">Home</a></header><nav><ul><li><a>One</a></li></ul></nav>
<div id="cookie-notice">We use cookies</div>
<div class="content"><div class="post-body"><h1>A &amp; B</h1><p>First&nbsp;para
 with <b>bold</b> &lt;tag&gt;.<p>Second &#x41; &eacute;.<br>line</p><!-- <p>hidden</p> --><ul><li>item</ul><form><input>Sign up</form>
<div class="ad-box">Buy now</div><table><tr><td>c1<td>c2</table></div>
<section id="comments"><article class="comment"><p>First! A long comment by a reader that goes on and on and on.</p></article></section></div>
<aside>Related</aside><footer>&copy; x</footer></body></html>"""


def test_one_page_without_article():
    assert extract(PAGE, None) == "A & B\nFirst para with bold <tag>.\nSecond A é. line\nitem\nc1\nc2"


def test_article_inside_layout():
    page = "<body><div class=wrap><div class=sidebar>" + "menu words " * 30 + "</div><main><article><header><h1>Head</h1></header><p>Text 1 < 2.</p><div class='share-buttons'>Share</div></article></main></div>"
    assert extract(page, None) == "Head\nText 1 < 2."


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "</div></p>", "<script>x", "<!-- open", "<style>p{}</style>", "<nav>only a menu</nav>"])
def test_nothing_to_extract(page):
    assert extract(page, None) in ("", "<", "<p")


def test_plain_text_and_very_long_pages():
    assert extract("just text &amp; more", None) == "just text & more"
    assert len(extract("<article>" + "<p>word word</p>" * 20_000 + "</article>", None)) == 20_000 * 10 - 1
    assert extract("<div>" * 3000 + "deep" + "</div>" * 3000, None) == "deep"


def test_template_drops_fixed_texts_of_the_slot(spark):
    pages = [(k, f"http://h.com/{k}", f"<html><body><div class=x><p>Welcome to our site</p><p>Story {k} is about {'word ' * (k + 5)}</p><p>All rights to the text are ours</p></div></body></html>") for k in range(20)]
    pages += [(90, "http://other.com/", "<body><div>Welcome to our site</div>"), (91, None, None), (92, "x", ""), (0, *pages[0][1:])]
    got = extract_pages(spark.createDataFrame([(*p, "h") for p in pages], "page_id long, url string, html string, host string").repartition(4)).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 24 and by[3].text == "Story 3 is about " + " ".join(["word"] * 8)
    assert by[90].text == "Welcome to our site" and by[91].text == by[92].text == "" and all(r.n_chars == len(r.text) for r in got)
    assert extract_pages(spark.createDataFrame(pages[:1], "page_id long, url string, html string").limit(0)).count() == 0


def test_copies_of_one_page_keep_their_text(spark):
    pages = [(k, "http://h.com/", "<html><body><div><p>Same story</p></div></body></html>") for k in range(9)]
    assert {r.text for r in extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()} == {"Same story"}


def test_classes():
    """Places of a template: a slot that varies, one that doesn't, a list of records, an article repeated on a few pages."""
    page = lambda k: Token(k, -1, "", 0, 9, 9, 7, 500, 0)
    tokens = [page(0), Token(1, 0, "body", 0, 9, 9, 7, 500, 0), Token(2, 1, "div", 0, 9, 9, 7, 400, 0), Token(3, 2, "p", 0, 9, 30, 8, 400, 400), Token(4, 3, None, 0, 5, 5, 3, 50, 50)]
    tokens += [Token(5, 1, "div", 0, 9, 9, 7, 40, 40), Token(6, 5, None, 0, 9, 9, 7, 40, 40)]
    tokens += [Token(7, 1, "div", 0, 9, 9, 7, 60, 0), Token(8, 7, "li", 0, 6, 20, 5, 60, 0), Token(9, 8, "div", 0, 6, 20, 5, 20, 20), Token(10, 8, "p", 0, 6, 20, 5, 40, 40)]
    assert deduce(tokens) == {"slot": 2, "holds": ["p"], "fixed": [6], "lists": [7]}
    # Of unequal vectors, no class; the list of records is then a slot like any other.
    apart = [Token(t.token, t.parent, t.tag, t.flags, t.pages, t.total, t.token, t.mass, t.own) for t in tokens]
    assert deduce(apart)["fixed"] == deduce(apart)["lists"] == []


def nameless(k):
    """A page of a host whose elements tell nothing: a varying notice, the article, readers' records, a footer of the template."""
    words = lambda n, x: " ".join(f"{x}{k}word{j}" for j in range(n))
    notice = f"<div class=qb>{words(2, 'n')}</div>" if k % 4 else ""
    records = "".join(f"<div class=r><div class=ra>Reader {k} {j}</div><p>{words(6, 'r' + str(j))}</p><div class=rb>{j + 1} May</div></div>" for j in range(k % 5))
    article = f"<div class=qc><h1>{words(3, 'h')}</h1><p>{words(40, 'a')}</p><div class=qd><h2>{words(2, 's')}</h2><p>{words(5, 'b')}</p></div><p>Told before by others</p></div>"
    text = [words(3, "h"), words(40, "a"), words(2, "s"), words(5, "b"), *([] if k >= 30 else ["Told before by others"])]
    article = article.replace("<p>Told before by others</p>", "" if k >= 30 else "<p>Told before by others</p>")
    return f"<html><body><div class=qa>Start Home</div>{notice}{article}<div class=qe>{records}</div><div class=qf>All of this is ours</div></body></html>", "\n".join(text)


def test_template_alone_finds_the_article(spark):
    """No article, main or telling name: right with the template, wrong without; a paragraph on many pages stays."""
    made = [nameless(k) for k in range(60)]
    pages = spark.createDataFrame([(k, f"https://plain.example/{k}", source) for k, (source, _) in enumerate(made)], "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in extract_pages(pages).collect()}
    assert got == {k: text for k, (_, text) in enumerate(made)}
    assert all(extract(source, None) != text for source, text in made)


def stripped(source):
    """A page whose elements are all div and have no class."""
    return re.sub(r' class="?[a-z ]+"?', "", re.sub(r"<(/?)(?:article|nav|footer)\b", r"<\1div", source))


def test_table_pages_without_names(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = pages.collect()
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame([(r.page_id, r.url, stripped(r.html)) for r in rows], "page_id long, url string, html string")).collect()}
    want = {r.page_id: article(r.html) for r in rows}
    right = sum(got[k] == want[k] for k in want)
    assert right >= 0.99 * len(rows) and not any(extract(stripped(r.html), None) == want[r.page_id] for r in rows)


@pytest.mark.parametrize("piece", ["<script ", "<a ", '<a "', '<a x=">" ', "<div>", "<p><div>", "<", "<!--", "<!", "<![CDATA[", "</p>", "<li><div></li>", "<svg>", "&lt;", "<p class=a>"])
def test_hostile_pages_take_linear_time(piece):
    took = []
    for n in (200_000, 1_000_000):
        began = time.time()
        extract(piece * (n // len(piece)), None)
        took.append(time.time() - began)
    assert took[1] < 10 and took[1] < 15 * took[0] + 0.5


def article(source):
    inner = re.sub(r"<br>", " ", re.sub(r"</?b>", "", re.sub(r"</?(p|h1)>", "\0", source.split("<article>")[1].split("</article>")[0])))
    return "\n".join(x for x in (" ".join(html.unescape(x).split()) for x in inner.split("\0")) if x)


def test_table_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert {r.page_id: r.text for r in extract_pages(pages).collect()} == {r.page_id: article(r.html) for r in pages.collect()}


def test_links_do_not_weigh():
    blocks, _ = parse("<div><a href=x>one two</a> three</div>")
    assert [(b.text, b.links) for b in blocks] == [("one two three", 7)]


def test_texts_beside_the_longest_part_stay():
    long = "<p>" + "many words of the long part " * 40 + "</p>"
    page = f"<html><body><div class=content><h1>Headline</h1><p>The lead.</p><div class=text>{long}</div><div class=more><p>A short section.</p></div><div class=x><a href=a>One link</a> <a href=b>another</a></div></div></body></html>"
    got = extract(page, None).split("\n")
    assert got[:2] == ["Headline", "The lead."] and got[3:] == ["A short section."]
    two = f"<html><body><div>Aside text</div><article class=first>{long}</article><article class=second><p>Another piece.</p></article><article class=teaser><p>Read on</p></article></body></html>"
    assert extract(two, None).split("\n")[1:] == ["Another piece."]
    thirds = "<html><body>" + "".join(f"<article class={c}><p>{c} " + "word " * 50 + "</p></article>" for c in "abc") + "</body></html>"
    assert [x[0] for x in extract(thirds, None).split("\n")] == ["a", "b", "c"]


FILLER = "word " * 40


@pytest.mark.parametrize("inner, want", [
    ('<header class="entry-header"><h1>Head</h1></header><p>Text.</p>', "Head\nText."),
    ('<p>Text.</p><div class="recommended-reading"><p>A book on it.</p></div>', "Text.\nA book on it."),
    ('<p>Text.</p><section id="reply-to-critics"><p>They are wrong.</p></section>', "Text.\nThey are wrong."),
    ('<div data-id="search" data-hidden="false" data-class="ad"><p>Text.</p></div>', "Text."),
    ('<div title="class=ad hidden"><p>Text.</p></div>', "Text."),
    ('<p>Text.</p><div class="related-posts"><p>Other</p></div><div id="replyList">x</div><div class="notice">n</div><div hidden>h</div><div aria-hidden="true">a</div>', "Text."),
    ('<p>Text.</p><div class="post-comments"><p>Me too</p></div><div class="x-share">s</div>', "Text."),
])
def test_names_inside_an_article(spark, inner, want):
    page = lambda k, body: f"<html><body><nav>Menu</nav><article>{body}</article><footer>Foot</footer></body></html>"
    assert extract(page(0, inner), None) == want
    pages = [(k, f"http://h.com/{k}", page(k, f"<h1>Story {k}</h1><p>On {k} {FILLER}</p>")) for k in range(30)] + [(99, "http://h.com/x", page(99, inner))]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[99] == want and got[5] == f"Story 5\nOn 5 {FILLER.strip()}"


def test_a_byline_that_mostly_says_the_same_stays(spark):
    body = lambda k: f'<h1>Story {k}</h1><p class="byline">By {"Bo Other" if k % 10 == 0 else "Ann Author"}</p><p>On {k} {FILLER}</p><p class="hint">Read it twice</p>'
    pages = [(k, f"http://h.com/{k}", f"<html><body><nav>Menu</nav><article>{body(k)}</article></body></html>") for k in range(40)]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[5].startswith("Story 5\nBy Ann Author\nOn 5") and got[10].startswith("Story 10\nBy Bo Other\nOn 10") and "twice" not in got[5]


def test_paragraphs_of_links():
    page = '<body><h1>Head</h1><p>See <a>the first long work on it</a> and <a>the second one</a>, too.</p><p><a>Home</a> <a>News</a></p><ul><li><a>One</a></li></ul></body>'
    assert extract(page, None) == "Head\nSee the first long work on it and the second one, too."
