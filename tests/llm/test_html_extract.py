"""Main text of pages whose text is known."""

import html
import random
import re
import time

import pytest

from loomgraph.llm import html_extract as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="with-sidebar"><header class="site"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><!-- ad --><div class="ad">Buy &amp; smile</div>
%s
<aside>Related things</aside><form><input>Subscribe now</form><div id="comments"><p>First!</p></div><footer>&copy; 2020</footer></body></html>"""


def test_article():
    paragraphs = ["First & <best> paragraph here.", "Second one, with a link and more text to read.", "x < y"]
    inner = "<h1>Title</h1>" + "".join(f"<p>{html.escape(p)}</p>" for p in paragraphs)
    assert h.Page(PAGE % f"<article>{inner}</article>").text() == "\n".join(["Title", "First & <best> paragraph here.", *paragraphs[1:]])
    broken = "<article><h1>Title</h1><p><b>One <i>two</b>\n three.<br><p>Four &#233; &eacute;<div>five</div></article>"
    assert h.Page(PAGE % broken).text() == "Title\nOne two three.\nFour é é\nfive"


def test_sections_are_one_text():
    inner = '<div class="post"><div class="part part1"><p>Alpha text that is long.</p></div><div class="part part2"><p>Beta text that is long.</p></div></div>'
    assert h.Page(PAGE % inner).text() == "Alpha text that is long.\nBeta text that is long."


def test_odd_pages():
    for source in [None, "", " ", "<", "<p", "<!-- never closed <p>x</p>", "<script>x", "&nbsp;", "<nav>menu</nav>"]:
        assert h.Page(source).text() in ("", "<", "<p")
    assert h.Page("plain words only").text() == "plain words only"
    assert h.Page("<p>a" * 3000).text() == "\n".join(["a"] * 3000)
    assert h.Page("<div>" * 3000 + "deep").text() == "deep"


def pages(spark):
    good = "<div class='c%d'><div class='main'><p>The text number %d of this host is here.</p></div><div class='x'><p>%s</p></div></div>"
    rows = [(i, f"http://a.example/{i}", PAGE % (good % (i, i, "" if i else "noise " * 40))) for i in range(6)]
    return spark.createDataFrame([(*r, "x") for r in rows] + [(7, None, None, "x"), (8, "nonsense", "", "x"), (9, None, "<p>no url</p>", "x"), (9, None, "<p>no url</p>", "x")], "page_id long, url string, html string, host string")


def test_hosts_agree(spark):
    for limit in (h.BROADCAST_BYTES, 0):
        got = {r.page_id: r for r in h.extract(pages(spark), broadcast_bytes=limit).collect()}
        assert [got[i].text for i in range(6)] == [f"The text number {i} of this host is here." for i in range(6)]
        assert got[7].text == got[8].text == "" and got[7].n_chars == 0 and got[9].text == "no url"
    assert h.extract(pages(spark)).count() == 10
    assert h.extract(pages(spark).limit(0)).count() == 0


def test_nothing_beside_the_largest_part_is_lost(spark):
    paragraphs = "".join(f"<p>Paragraph number {k} of the text, with some words more in it.</p>" for k in range(8))
    table = "<table>" + "".join(f"<tr><td>cell {k} of a long table</td><td>and its second cell</td></tr>" for k in range(40)) + "</table>"
    items = "<ul>" + "".join(f"<li>item {k} of a list that is longer than the text</li>" for k in range(40)) + "</ul>"
    inner = [
        f'<div class="wrap"><div class="content">{paragraphs}</div>{table}</div>',
        f'<div class="wrap"><div class="content">{paragraphs}{items}</div></div>',
        f'<div class="wrap"><div class="intro"><p>A short start.</p></div><div class="body">{paragraphs}</div><div><div>{items}</div></div></div>',
        f"<article><div><p>A short start.</p><div><div>{table}</div></div></div>{paragraphs}</article>",
        f"<p>{'A long paragraph right in the body. ' * 3}</p>{table}",
    ]
    rows = [(k, f"http://h{k}.example/" if k else None, PAGE % x) for k, x in enumerate(inner)]
    for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        x = inner[r.page_id]
        assert r.text.split() == html.unescape(re.sub("<[^>]*>", " ", x)).split()


def test_links_beside_the_text_stay_out():
    links = "".join(f'<li><a href="/{k}">Another page {k}</a></li>' for k in range(9))
    inner = f'<div class="wrap"><div class="links"><ul>{links}</ul></div><div class="content"><p>{"The text of the page. " * 20}</p></div></div>'
    assert h.Page(PAGE % inner).text() == ("The text of the page. " * 20).strip()


@pytest.mark.parametrize(
    "inner, want",
    [
        ('<article><p>Kept text.</p><p class="advert">Buy this<p>And more text.</p></article>', "Kept text.\nAnd more text."),
        ('<article><p class="cookie-notice">We use cookies.</p><p>Kept text.</p><h2 id="share">Share<h2>Next</h2></article>', "Kept text.\nShare\nNext"),
        ('<article><ul><li>one<li class="comment">no<p>no</p><ul><li>no</ul><li>two</ul><p>Kept text.</article>', "one\ntwo\nKept text."),
        ('<article><p>Kept <span class="ad">not <span>this</span> one</span>text<span hidden>no</span>.</p><p>More <span role="alert">no<p>text</article>', "Kept text.\nMore\ntext"),
        ('<article><header class="entry-header"><h1>The title</h1></header><p>Kept text.</p><footer>by me</footer></article>', "The title\nKept text."),
        ('<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p><pre>a = 1 <span class="comment"># set</span></pre></article>', "So x=1 holds.\na = 1 # set"),
        ('<article><p>Kept <a href="x>text</a> and <b>bold</b>.</p><p>Last.</p></article>', "Kept text and bold.\nLast."),
        ('<article><p title=it\'s>Kept text.</p><p>It\'s here.</p></article>', "Kept text.\nIt's here."),
        ('<div id="comments"><article><p>A comment that is long, longer than all of the text.</p></article></div><article><p>Kept text.</p></article>', "Kept text."),
        ('<article><p>Kept text.</p><div class="discussion"><p>%s</p></div></article>' % ("The discussion of the results goes on. " * 4), "Kept text.\n" + ("The discussion of the results goes on. " * 4).strip()),
        ('<article><p>Kept text.</p><div class="related"><ul><li><a href="/a">Another article of this site</a></li></ul></div></article>', "Kept text."),
        ("<article><p>a&nbsp;&nbsp;b<!-- x --> c</p><![CDATA[d <e]]><p>&lt;p&gt;</article>", "a b c\nd <e\n<p>"),
    ],
)
def test_contract(inner, want):
    assert h.Page(PAGE % inner).text() == want


def test_host_decides_about_words_that_articles_use_too(spark):
    """The short discussion of page 0 holds no prose, but those of its host do; on the other host the word names link lists."""
    prose = "<p>" + "The results are discussed here at some length, in words. " * 3 + "</p>"
    page = "<article><p>Text %d of the page.</p><div class='discussion'>%s</div></article>"
    rows = [(i, "http://a.example/x", PAGE % (page % (i, prose if i else "<p>Short one.</p>"))) for i in range(5)]
    rows += [(10 + i, "http://b.example/x", PAGE % (page % (i, "<p>Join the forum</p>" if i else prose))) for i in range(5)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (h.BROADCAST_BYTES, 0):
        got = {r.page_id: r.text for r in h.extract(frame, broadcast_bytes=limit).collect()}
        assert got[0] == "Text 0 of the page.\nShort one." and got[1].count("discussed") == 3
        assert all(got[10 + i] == f"Text {i} of the page." for i in range(5))


def test_two_paths_with_the_same_end_differ():
    deep = "<div><div><div><div><div><div class='t'><p>%s</p></div></div></div></div></div></div>"
    page = h.Page("<body><section>" + deep % "first text" + "</section><div class='o'>" + deep % "other text" + "</div></body>")
    paths = {page.path(i): i for i in range(1, len(page.tags)) if page.steps[i] == "div.t"}
    assert len(paths) == 2 and [page.text(p) for p in paths] == ["first text", "other text"]
    assert all(page.on_path(p) == {i} for p, i in paths.items())


@pytest.mark.parametrize("source", ["<a \"" * 20000, "<a x=\"" * 20000, "<a x='\">" * 10000, "<div>" * 20000 + "x", "<div>" * 10000 + "</ul>" * 10000, "<div id=comments>" + "<article>" * 10000, "<ul><li class=ad>" * 6000, "<p class=ad>" * 8000, "<svg><object>" * 8000 + "</canvas>" * 8000, "<span class=ad>" * 8000, "<!--" * 25000, "<script>" * 12000, "<p " + "class=x " * 12000 + ">", "<" * 100000, "&" * 100000])
def test_hostile_pages_take_linear_time(source):
    began = time.process_time()
    h.Page(source).text("div>div")
    assert time.process_time() - began < 3  # one second on a free core


def test_random_pages_against_what_they_were_made_of():
    """Pages of nested sections with boilerplate at every level; the text is what was put in, in order."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    noise = [
        lambda: f"<nav><ul><li><a href='/'>{line(3)}</a></li></ul></nav>", lambda: f"<div class='ad-slot{rng.randint(1, 9)}'>{line(4)}</div>", lambda: f"<aside><p>{line(20)}</p></aside>",
        lambda: f"<p class='advert'>{line(5)}</p>", lambda: f"<form action='/'><p>{line(3)}</p><input type=text></form>", lambda: f"<script>{line(4)}<p></script>", lambda: f"<style>p {{}}</style><!-- {line(3)} -->",
        lambda: f"<div class='comments'><div class='comment'><p>{line(30)}</p></div></div>", lambda: f"<span hidden>{line(2)}</span>", lambda: f"<div class='newsletter'><h3>{line(2)}</h3></div>",
    ]

    def content(depth):
        parts, text = [], []
        for _ in range(rng.randint(2, 6)):
            kind = rng.random()
            if kind < 0.25:
                parts.append(rng.choice(noise)())
            elif kind < 0.4 and depth:
                inner, lines = content(depth - 1)
                parts.append(rng.choice(["<section>%s</section>", "<div class='part'>%s</div>", "<blockquote>%s</blockquote>"]) % inner)
                text += lines
            elif kind < 0.55:
                items = [line(rng.randint(1, 6)) for _ in range(3)]
                parts.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
                text += items
            else:
                x = line(rng.randint(3, 40))
                words = x.split(" ")
                words[0] = f"<b>{words[0]}</b>"
                parts.append(f"<p>{' '.join(words)}</p>")
                text.append(x)
        return "".join(parts), text

    for _ in range(200):
        inner, lines = content(3)
        assert h.Page(PAGE % f"<article><h1>Title</h1>{inner}</article>").text().split("\n") == ["Title", *lines]


PROSE_TEXT = ["The first paragraph of the text is long enough to be prose, with words and words in it.", "The second paragraph of the text is long enough too, and it has some more words to read.", "And there is a third one, so that nobody takes this for a notice or a line of the site."]


@pytest.mark.parametrize("word", sorted(h.WORDS | h.MAYBE))
def test_class_words_around_the_text(word):
    """Whatever the wrapper, section or heading of the text is called, the text stays; boilerplate beside it goes."""
    body = "".join(f"<p>{x}</p>" for x in PROSE_TEXT)
    site = '<nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies on this site.</div>%s<footer>&copy; us</footer>'
    want = "\n".join(PROSE_TEXT)
    for wrapper in (f'class="with-{word}"', f'class="content-{word}-wrap"', f'class="{word}"', f'id="{word}"', f'class="no-{word} layout"'):
        assert h.Page(site % f'<div {wrapper}><div class="text">{body}</div></div>').text() == want
    for holder in ("article", "main"):
        for section in (f'<section id="{word}">', f'<section id="{word}-and-more">', f'<div class="section" id="{word}">'):
            end = "</section>" if section.startswith("<section") else "</div>"
            page = h.Page(site % f"<{holder}><p>{PROSE_TEXT[2]}</p>{section}<h2 id='{word}-x'>Title {word}</h2>{body}{end}</{holder}>")
            assert page.text() == f"{PROSE_TEXT[2]}\nTitle {word}\n{want}"
        page = h.Page(site % f'<{holder}><h1 id="{word}-history">The title</h1><div class="{word}-sciences">{body}</div><h2 id="{word}">Next</h2><p>End.</p></{holder}>')
        assert page.text() == f"The title\n{want}\nNext\nEnd."


def test_sections_with_headings_outside_articles():
    body = "".join(f"<p>{x}</p>" for x in PROSE_TEXT)
    page = h.Page(f'<div class="body">{body}<section id="notifications"><h2>Notifications</h2><p>{PROSE_TEXT[0]}</p></section></div><div class="sidebar"><p>{PROSE_TEXT[1]}</p></div>')
    assert page.text() == "\n".join([*PROSE_TEXT, "Notifications", PROSE_TEXT[0]])


def test_hosts_vote_about_classes(spark):
    """On pages of little text a notice is most of the prose; the host's other pages know better. A wrapper with a class word is kept by its host."""
    notice = f'<div class="cookie-notice">{"".join(f"<p>{x}</p>" for x in PROSE_TEXT)}</div>'
    long = "".join(f"<p>{x} It goes on for a while. {x}</p>" for x in PROSE_TEXT)
    rows = [(i, "http://a.example/x", f"<div class='t'>{long if i else '<p>Short.</p>'}</div>{notice}") for i in range(5)]
    rows += [(10 + i, "http://b.example/x", f"<div class='sidebar'>{long if i else '<p>Short, but it is the text of the page.</p>'}</div><footer>x</footer>") for i in range(5)]
    for limit in (h.BROADCAST_BYTES, 0):
        got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_bytes=limit).collect()}
        assert got[0] == "Short." and all("This" not in got[i] and got[i].count("goes on") == 3 for i in range(1, 5))
        assert got[10] == "Short, but it is the text of the page." and got[11].count("goes on") == 3
