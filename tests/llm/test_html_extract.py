import html
import math
import random
import re
import time
from xml.etree import ElementTree

import time

import pytest

from saltmarsh.llm.html_extract import Reader, extracted, main_text, path_ratios

LONG = "This is a sentence of the article, with commas, and it goes on for a while. Then it ends."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p></p><div> \n </div>", ""),
        ("just text &amp; more", "just text & more"),
        (f"<article><h1>A &lt;b&gt; title</h1><p>{LONG}</p><p>Short.</p></article>", f"A <b> title\n\n{LONG}\n\nShort."),
        (f"<nav><a href=x>Menu</a></nav><article><p>{LONG}<br>and\n on</p></article><footer>&copy; us</footer>", f"{LONG} and on"),
        (f"<article><p><b>Bold<br><p>{LONG}<p>Last</article>", f"Bold\n\n{LONG}\n\nLast"),
        (f"<script>var t='</p><article>';</script><!-- <p>no</p> --><article>{LONG}</article><!-- never ends <p>x", LONG),
        (f"<ARTICLE><P>{LONG}</P><UL><LI>one<LI>two</UL></ARTICLE>", f"{LONG}\n\none\n\ntwo"),
        (f"<article><header><h1>Title</h1></header><p>{LONG}</p><section id='comments'><p>I think, so it is. {LONG}</p></section></article>", f"Title\n\n{LONG}"),
        (f"<article><p>{LONG}</p></article><article class='comment'><p>{LONG} reader</p></article>", LONG),
        (f"<div class='header'>Site</div><div class=cookie-notice>We use cookies, as all do. {LONG}</div><div id=main><h2>Head</h2><p>{LONG}</p><p>x</p><p>{LONG}</p></div><div class='sidebar'>{LONG}</div>", f"Head\n\n{LONG}\n\nx\n\n{LONG}"),
        (f"<main><p>{LONG}</p><form><p>Sign up, now.</p><input></form><aside>{LONG}</aside><div style='display: none'>no</div></main>", LONG),
        (f'<article><p title="a > b">{LONG} <span class="ad">buy</span>end&nbsp;&#8212;&#x41;</p></article>', f"{LONG} end —A"),
        (f"<article><table><tr><td>a<td>b<tr><td>c</table><p>{LONG}</p></article>", f"a\n\nb\n\nc\n\n{LONG}"),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # no article element, no class names: the container tells sibling elements apart
        (f"<body><div>Home About Contact</div><div>{'<p>' + LONG + '</p>'}{('<p>' + LONG + '</p>') * 9}</div><div>Example Ltd, all rights reserved. 2024.</div></body>", "\n\n".join([LONG] * 10)),
        (f"<body><div><p>A notice, with a mark. And one more.</p></div><h1>Head</h1><div>{('<p>' + LONG + '</p>') * 5}<p>Short.</p></div><div><p>Promo text, call now.</p></div></body>", "\n\n".join(["Head"] + [LONG] * 5 + ["Short."])),
        # menus and link lists without names, outside and inside the article
        (f"<body><div class=boxy>{''.join(f'<div><a href=x>Link number {k}, a title</a></div>' for k in range(15))}</div><div class=zz><h2>T</h2>{('<p>' + LONG + '</p>') * 3}</div></body>", "\n\n".join(["T"] + [LONG] * 3)),
        (f"<article><h1>Head</h1>{('<p>' + LONG + '</p>') * 3}<div><ul>{'<li><a href=x>More to read, today.</a></li>' * 5}</ul></div></article>", "\n\n".join(["Head"] + [LONG] * 3)),
        # words of class names only weigh, so an article named like surroundings stays
        (f"<body><ul><li><a href=x>Menu</a></ul><div class='legal-news share-price'>{('<p>' + LONG + '</p>') * 3}</div></body>", "\n\n".join([LONG] * 3)),
        # a paragraph that is all link, among others
        (f"<article>{('<p>' + LONG + '</p>') * 3}<p><a href=x>See here.</a></p></article>", "\n\n".join([LONG] * 3 + ["See here."])),
        # what is hidden stays hidden: below many open inline elements, and past blocks within
        (f"<article><p>{LONG}</p><span hidden>{'<b>' * 300}secret</span></article>", LONG),
        (f"<article><p>{LONG}</p><span class='ad'><div>Buy one</div> Buy now</span></article>", LONG),
        (f"<article><p>{LONG}</p><span hidden><p>x</p>y<p>z</p></span><p>{LONG}</p></article>", f"{LONG}\n\n{LONG}"),
    ],
)
def test_paths_decide(page, text):
    assert main_text(page) == text


def plain_ratios(page):
    """Fused ratios of a well-formed page's paths, from an XML tree, path by path."""
    found = {}

    def walk(element, path):
        path = (*path, element.tag)
        text = " ".join("".join(element.itertext()).split()) if not len(element) or element[0].tag == "a" else ""
        if text:
            links = "".join("".join("".join(a.itertext()).split()) for a in element.iter("a"))
            found.setdefault(path, []).append((len(text), len(re.findall("[,.;:!?]", text)), len(links)))
            return
        for child in element:
            walk(child, path)

    walk(ElementTree.fromstring(page), ())
    own, keep = [], []
    for blocks in found.values():
        chars, marks, links = (sum(x) / len(blocks) for x in zip(*blocks))
        keep.append((1 - links / chars) ** 2)
        own.append(chars / (chars + 40) * (marks + 0.2) / (marks + 1) * keep[-1])
    out = {}
    for k, path in enumerate(found):
        bell = {j: math.exp(-((j - k) ** 2) / 2) for j in range(len(own)) if abs(j - k) <= 2}
        out[path] = (own[k] + keep[k] * sum(own[j] * w for j, w in bell.items()) / sum(bell.values())) / 2
    return list(out.values())


def test_ratios_against_a_tree():
    rng = random.Random(5)
    for _ in range(50):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            text = " ".join(rng.choice(["word", "more,", "end.", "x"]) for _ in range(rng.randrange(1, 30)))
            parts.append(rng.choice([f"<p>{text}</p>", f"<ul><li><a>{text}</a></li><li>{text}</li></ul>", f"<h1>{text}</h1>", f"<section><p>{text}</p></section>"]))
        page = f"<body>{''.join(parts)}</body>"
        assert list(path_ratios(Reader().read(page).blocks).values()) == pytest.approx(plain_ratios(page))


def test_long_and_deep_pages():
    assert main_text("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>").count(LONG) == 20_000
    assert LONG in main_text("<div>" * 500 + LONG)
    assert main_text("<b>" * 5000 + "x < y <3 & z") == "x < y <3 & z"
    assert main_text("<i>" + "<b>" * 50_000 + LONG + "</i>" * 50_000 + "</p>" * 50_000) == LONG


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in extracted(pages.withColumnRenamed("html", "html"), keep=("page_id", "url", "html")).collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(x for x in parts if x)


def test_edge_rows(spark):
    rows = [(1, None, None, 0), (None, "u", "<p>x</p>", 0), (1, "u", "<p>x</p>", 0), (1, "u", "<p>x</p>", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert sorted((r.page_id or 0, r.text) for r in extracted(pages).collect()) == [(0, "x"), (1, ""), (1, "x"), (1, "x")]
    assert extracted(pages.limit(0)).count() == 0


SENTENCES = "This is a long sentence, with marks. And another one, quite long; it goes on and on."


@pytest.mark.parametrize(
    "page, blocks",
    [
        (f"<article><h1>Title</h1><div class=by>By Ann</div><div class=when>2 May</div><p>{SENTENCES}</p></article>", ["Title", "By Ann", "2 May", SENTENCES]),
        (f"<article><h1>T</h1><h2 class=sub>Sub</h2><p class=lead>Lead</p><p>{SENTENCES}</p></article>", ["T", "Sub", "Lead", SENTENCES]),
        (f"<article><h1>T</h1><div><h2>S</h2><p>{SENTENCES}</p></div></article>", ["T", "S", SENTENCES]),
        (f'<article><h1>T</h1><p>Word</p><div class="ad"><p>{SENTENCES}</p></div></article>', ["T", "Word"]),
        (f"<article><h1>T</h1><div class=share><p>{SENTENCES}</p></div></article>", ["T", SENTENCES]),
        (f"<div><h1>T</h1><p>{SENTENCES}</p><p>Short</p><div class=x>tiny</div><p>{SENTENCES}</p></div><div class=footer>{SENTENCES}</div>", ["T", SENTENCES, "Short", "tiny", SENTENCES]),
        (f"<article><p>{SENTENCES}</p><ul class=nav><li><a href=x>Home</a><li><a href=y>More</a></ul><p>{SENTENCES}</p></article>", [SENTENCES, SENTENCES]),
    ],
)
def test_short_blocks_stay(page, blocks):
    assert main_text(page).split("\n\n") == blocks


def test_tags_that_never_end():
    """A megabyte of open quotes is text, read once; a tag may begin within what was none."""
    for text in ('<a "' * 250_000, "<a x='" * 170_000):
        began = time.perf_counter()
        assert main_text(text) == text.strip() and time.perf_counter() - began < 10
    assert main_text('<p>one</p> <a "<b>two</b>') == 'one\n\n<a "two'
    assert main_text("<p title='a>b'>one</p><!-- no end") == "one"
