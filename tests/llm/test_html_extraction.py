"""Articles made of known blocks, with noise around and inside, come back block by block."""

import random
import time
from html import escape

import pytest

from skerry.llm.html_extraction import extract, main_text

NOISE = [
    "<nav><ul><li><a href='/x'>Home</a></li><li><a href=/y>News, more</a></li></ul></nav>",
    "<header><div class=logo>Site name</div></header>",
    "<div class='ad'>Buy this, now, today, and tomorrow.</div>",
    '<aside id="sidebar"><p>Popular, most read, of all time, and more.</p></aside>',
    "<script>var t = '</p><p>not text</p>'; if (a < b) {}</script>",
    "<style>p > b { color: red }</style><!-- a <p>comment</p> -->",
    "<form><label>Mail</label><input name=q><button>Go</button></form>",
    '<div class="cookie-notice" role="dialog"><p>We use cookies, as all do.</p></div>',
    '<section class="comments"><h3>Comments</h3><p>I liked this, really, a lot, so much.</p></section>',
    '<div class="related-posts"><ul><li><a href="/a">Other article</a></li></ul></div>',
    '<p class="share">Share <a href=#>this</a></p>',
]


def page(blocks, rng, wrap):
    inner = []
    for b in blocks:
        body = escape(b).replace(" ", rng.choice([" ", "\n ", "\t"]))
        words = body.split(" ")
        if len(words) > 3 and rng.random() < 0.4:
            words[1] = f"<b>{words[1]}</b>"
            words[2] = f'<a href="/l?a=1&amp;b=\'>\'">{words[2]}</a>'
        inner.append(f"<{rng.choice(['p', 'P', 'p class=lead'])}>{' '.join(words)}" + rng.choice(["</p>", "</p>\n", ""]))
        if rng.random() < 0.3:
            inner.append(rng.choice(NOISE[2:]))
    head, foot = rng.sample(NOISE, 3), rng.sample(NOISE, 2)
    return f"<!DOCTYPE html><html lang=en><head><title>T, t, t</title></head><body>{''.join(head)}{wrap[0]}{''.join(inner)}{wrap[1]}{''.join(foot)}<footer>&copy; 2024, all rights, reserved</footer></body></html>"


@pytest.mark.parametrize("wrap", [("<article>", "</article>"), ("<div id=content>", "</div>"), ("<main><div><div class=post-body>", "</div></div></main>"), ("<article><section>", "</section></article>")])
def test_blocks_come_back(wrap):
    rng = random.Random(str(wrap))
    for _ in range(60):
        blocks = [" ".join(rng.choices(["alpha", "beta,", "<i>", "gamma&", "é.", "\"x\"", "delta"], k=rng.choice([4, 12, 60, 200]))) for _ in range(rng.randint(2, 8))]
        assert main_text(page(blocks, rng, wrap)) == "\n".join(blocks)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("no tags at all, &amp; a reference", "no tags at all, & a reference"),
        ("<p>one<br>two<p>three &lt;b&gt; &eacute;&#233;&nbsp;x", "one two\nthree <b> éé x"),
        ("<body><nav>menu</nav></body>", ""),
        ("<article><h1>Head, line</h1><p><b>bold start<br><p>next <i>one</article><footer>foot</footer>", "Head, line\nbold start\nnext one"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><pre>e\n f</pre></article>", "a\nb\nc\nd\ne f"),
        ("<header><h1>Site</h1></header><p>text, of a page</p>", "text, of a page"),
        ("<div class=site-header>Site</div><article><header class=post-header><h1>Own</h1></header><p>x<figure><img src=a><figcaption>seen</figure></article>", "Own\nx\nseen"),
        ("<article><p>cut tag here <a href='x", "cut tag here"),
        ("<article><p>5 < 6 and 7 > 3</p></article></div></article>", "5 < 6 and 7 > 3"),
        ("<p>a &<b>amp;</b> c &am<!-- x -->p; d &amp;amp; e</p>", "a &amp; c &amp; d &amp; e"),
        ("<body><form id=aspnet><nav>menu</nav><div><p>The text, of a page, that lies in a form as a whole, long enough to be an article, with commas.</p></div></form></body>", "The text, of a page, that lies in a form as a whole, long enough to be an article, with commas."),
        ("<form id=all><article><p>In it, all.</p><form><p>Your comment, please</p></form></article></form>", "In it, all."),
        ("<SCRIPT>x</SCRIPT ><article><P>Upper</P></article><script>never closed <p>no</p>", "Upper"),
    ],
)
def test_odd_pages(html, text):
    assert main_text(html) == text


_LONG = ["A paragraph, long enough, of the body, with commas, and words for some points. " * 3] * 20


@pytest.mark.parametrize("many", [1, 20])
@pytest.mark.parametrize(
    ("before", "after", "head", "tail"),
    [
        ("<article><h1>T</h1><ul><li>short</li></ul><div>", "</div><table><tr><td>cell</td></tr></table></article>", ["T", "short"], ["cell"]),
        ("<article><section>", "</section><section><p>one, a</p><p>two, b</p><p>three, c</p></section></article>", [], ["one, a", "two, b", "three, c"]),
        ("<main><h1>T</h1><article>", "</article><p>after</p></main>", ["T"], ["after"]),
        ("<div><h1>T</h1><p>Lead.</p><div>", "</div><p>End.</p></div>", ["T", "Lead."], ["End."]),
    ],
)
def test_parts_beside_a_body_of_any_length(before, after, head, tail, many):
    body = [x.strip() for x in _LONG[:many]]
    html = f"<body><nav><a href=/>Home</a></nav>{before}{''.join(f'<p>{x}</p>' for x in body)}{after}<footer>f</footer></body>"
    assert main_text(html).split("\n") == head + body + tail


@pytest.mark.parametrize("mark", ["content has-sidebar", "no-sidebar", "page with-nav", "social-issues", "layout sidebar", "widget"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_wrappers_that_hold_the_article_stay(mark, inner):
    body = [x.strip() for x in _LONG[:5]]
    comments = '<section class="comments"><article class="comment-body"><p>I liked this, really, a lot, so much.</p></article></section>'
    html = f"<body><div class='site-header'>Site</div><div class='{mark}'><{inner}>{''.join(f'<p>{x}</p>' for x in body)}</{inner}>{comments}</div><div class='related-posts'><p>Other, and more.</p></div></body>"
    assert main_text(html).split("\n") == body


@pytest.mark.parametrize("inner", ["<div class=header>", "<b><div>", "<ul><li>", "<article><header>", "</b><div>", "<p><i>"])
def test_deep_pages_take_time_in_proportion(inner):
    def seconds(n):
        began = time.perf_counter()
        main_text(inner * n + "text, here" + "</i>" * n)
        return time.perf_counter() - began

    seconds(2000)
    assert seconds(32_000) < 40 * max(seconds(2000), 0.01)


def test_rows(spark):
    schema = "page_id bigint, url string, html string, text string"
    rows = [(1, "u", "<p>a</p>", "own"), (None, None, None, None), (3, "u", "", ""), (1, "u", "<p>a</p>", "own"), (5, "v", "<article>" + "<p>long text, " * 20000, "")]
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1].text, got[1].n_chars, got[None].text, got[3].n_chars) == ("a", 1, "", 0) and got[5].text.count("\n") == 19999
    assert not extract(spark.createDataFrame([], schema)).collect()


_BODY = [x.strip() for x in _LONG[:4]]
_ITEM = "<{tag} class='c-{k}'><div><b>Reader {k}</b> <time datetime=2024-01-0{k}>day {k}</time></div><p>I saw this, too, and it was, for me, quite so.</p><a href='?r={k}'>{word}</a></{tag}>"


@pytest.mark.parametrize("wrap", ["article", "div"])
@pytest.mark.parametrize(("tag", "word"), [("div", "Reply"), ("li", "Antworten"), ("section", "Répondre")])
def test_comments_are_known_by_structure(wrap, tag, word):
    """No class says what they are; two alike, signed and with an offer to answer."""
    items = "".join(_ITEM.format(tag=tag, k=k, word=word) for k in (1, 2, 3))
    html = f"<body><{wrap} id=content>{''.join(f'<p>{x}</p>' for x in _BODY)}<div class=x9>{'<ul>' if tag == 'li' else ''}{items}</div></{wrap}></body>"
    assert main_text(html).split("\n") == _BODY


def test_signed_parts_of_an_article_stay():
    """Dated entries that nobody can answer are the article's own."""
    items = "".join(f"<div class=entry><time>day {k}</time><p>What happened, that day, and after, in a few words.</p></div>" for k in (1, 2, 3))
    html = f"<body><article><h1>Log</h1>{items}</article></body>"
    assert main_text(html).count("What happened") == 3 and "day 2" in main_text(html)


@pytest.mark.parametrize(
    "advert",
    [
        "<div class=adsbygoogle><p>Buy this, now, and here, today, or tomorrow.</p></div>",
        "<div id=google_ads_iframe_1><p>Buy this, now, and here.</p></div>",
        "<div class='outbrain widget-7'><p>Ten things, you, and others, like.</p></div>",
        "<div class=taboola>You may, or may not, like this.</div>",
        "<div id=div-gpt-ad-12><p>Buy, buy, buy.</p></div>",
        "<ins data-ad-client=ca-1><div>Buy, buy, buy.</div></ins>",
        "<div><p><a rel='nofollow sponsored' href=//x>Our partner, and friend, offers, a lot.</a></p></div>",
        "<div class='discussion-thread'><p>I think, that this, is, not so.</p></div>",
        "<div class='discussion'><p>I think, that this, is, not so.</p></div>",
    ],
)
@pytest.mark.parametrize("wrap", ["article", "div"])
def test_adverts_and_threads_by_name_or_link(advert, wrap):
    html = f"<body><{wrap}>{''.join(f'<p>{x}</p>' for x in _BODY[:2])}{advert}{''.join(f'<p>{x}</p>' for x in _BODY[2:])}</{wrap}></body>"
    assert main_text(html).split("\n") == _BODY


@pytest.mark.parametrize("word", ["adsorption-data", "add-on", "has-ads", "no-adsense", "address", "gradient", "shadbox"])
def test_words_like_those_of_adverts(word):
    html = f"<body><div><div class='{word}'><p>Kept, as it is.</p></div>{''.join(f'<p>{x}</p>' for x in _BODY)}</div></body>"
    assert main_text(html).split("\n") == ["Kept, as it is.", *_BODY]


def test_link_only_paragraphs_stay_and_link_lists_go():
    inner = "".join(f"<p>{x}</p>" for x in _BODY)
    html = f"<body><div id=content><div>{inner}</div><p><a href=/x>only link</a></p><ul><li><a href=/a>one</a></li><li><a href=/b>two</a></li></ul><div><a href=/c>more</a> <a href=/d>and more</a></div></div></body>"
    assert main_text(html).split("\n") == [*_BODY, "only link"]
    tied = "<body><div><p>a, b, c, d</p></div><div><p>e, f, g, h</p></div></body>"  # equal scores: the first in page order leads, both stay
    assert main_text(tied) == "a, b, c, d\ne, f, g, h"


def test_plain_reader_of_well_formed_pages():
    """All blocks of the one article, read by the standard library's parser, on pages made of random parts."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.left, self.out, self.held = 0, 0, [], []

        def end(self):
            if text := " ".join("".join(self.held).split()):
                self.out.append(text)
            self.held = []

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if self.left or tag in ("aside", "form", "script") or dict(attrs).get("class") in ("ad", "share", "comments"):
                self.left += tag not in ("br", "img", "input")
            elif tag in ("p", "h1", "h2", "li", "ul", "div", "blockquote", "article", "td", "tr", "table"):
                self.end()
            elif tag == "br":
                self.held.append(" ")

        def handle_endtag(self, tag):
            if self.left:
                self.left -= 1
            elif tag in ("p", "h1", "h2", "li", "ul", "div", "blockquote", "article", "td", "tr", "table"):
                self.end()
                self.inside &= tag != "article"

        def handle_data(self, data):
            if self.inside and not self.left:
                self.held.append(data)

    rng = random.Random(11)
    words = ["alpha", "beta,", "&amp;", "<b>bold</b>", "é", "<a href=/x>link</a>", "&#233;", "x<br>y"]
    for _ in range(150):
        line = lambda: " ".join(rng.choices(words, k=rng.randint(1, 40)))
        parts = []
        for _ in range(rng.randint(1, 9)):
            kind = rng.choice(["p", "p", "p", "h2", "ul", "blockquote", "div", "noise"])
            if kind == "ul":
                parts.append(f"<ul><li>{line()}</li><li>{line()}</li></ul>")
            elif kind == "noise":
                parts.append(rng.choice(["<div class='ad'><p>Buy</p></div>", "<aside><p>Aside</p></aside>", "<form><p>Form</p></form>", "<script>s</script>", "<div class='share'>Share</div>"]))
            else:
                parts.append(f"<{kind}>{line()}</{kind}>")
        html = f"<html><body><nav><a href=/>Home</a></nav><article><h1>{line()}</h1>{''.join(parts)}</article><footer>f</footer></body></html>"
        plain = Plain()
        plain.feed(html)
        plain.end()
        assert main_text(html).split("\n") == plain.out
