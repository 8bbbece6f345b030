"""Pages written by hand, each with the text it should give; and pages that must not take long."""

import time

import pytest

from loomtide.llm import html_tree

A = "The river rose by two metres overnight, and the lower town was cut off."
B = "Engineers had warned of it for years. Nobody listened, she said."
C = "Repairs will take until spring."
P = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
TEXT = f"{A}\n{B}\n{C}"
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav>'
FOOT = "<footer>&copy; 2024 The Paper. All rights reserved.</footer>"

LAYOUTS = {
    "article": (f"<html><body>{NAV}<article><h1>Flood</h1>{P}</article>{FOOT}</body></html>", f"Flood\n{TEXT}"),
    "main": (f"<body>{NAV}<main><h1>Flood</h1>{P}</main>{FOOT}", f"Flood\n{TEXT}"),
    "div with a class": (f'<body><div class="menu"><a href=/>Home</a> <a href=/n>News</a></div><div class="post-content"><h2>Flood</h2>{P}</div><div class="footer">(c) Paper</div>', f"Flood\n{TEXT}"),
    "entry content": (f'<body><div id="header">The Paper</div><div class="entry-content">{P}</div><div id="sidebar"><h3>Related</h3><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></div>', TEXT),
    "wrapped main": (f'<body><div id="page"><div class="wrapper">{NAV}<article class="story">{P}</article></div></div>{FOOT}', TEXT),
    "sidebar in front": (f'<body><aside class="sidebar"><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></aside><article>{P}</article>', TEXT),
    "comments": (f'<body><article>{P}</article><section id="comments"><h3>2 comments</h3><div class="comment"><p>First! Great piece, thanks for it.</p></div><div class="comment"><p>I do not agree at all.</p></div></section>', TEXT),
    "cookie notice": (f'<body><div class="cookie-banner"><p>We use cookies to improve this site.</p><button>OK</button></div><article>{P}</article>', TEXT),
    "advert within": (f'<body><article><p>{A}</p><div class="ad">Buy now, half price!</div><p>{B}</p><p>{C}</p></article>', TEXT),
    "form within": (f'<body><article><p>{A}</p><form class="newsletter"><label>Your mail</label><input name=m><button>Join</button></form><p>{B}</p><p>{C}</p></article>', TEXT),
    "pull links within": (f'<body><article><p>{A}</p><aside class="related"><ul><li><a href=/1>More on floods</a></li><li><a href=/2>Dams</a></li></ul></aside><p>{B}</p><p>{C}</p></article>', TEXT),
    "header within": (f"<body>{NAV}<article><header><h1>Flood</h1></header>{P}</article>{FOOT}", f"Flood\n{TEXT}"),
    "list": (f"<body>{NAV}<article><p>{A}</p><ul><li>Bring water and a lamp.</li><li>Stay off the bridge.</li></ul><p>{C}</p></article>", f"{A}\nBring water and a lamp.\nStay off the bridge.\n{C}"),
    "quote and code": (f"<body><article><p>{A}</p><blockquote><p>{B}</p></blockquote><pre>level   2.1\n  m</pre></article>{FOOT}", f"{A}\n{B}\nlevel 2.1 m"),
    "table": (f"<body><article><p>{A}</p><table><tr><td>Monday</td><td>2.1 m</td></tr></table><p>{C}</p></article>", f"{A}\nMonday\n2.1 m\n{C}"),
    "inline elements": ('<body><article><p>The <b>river</b> rose <a href="/x">by two</a> m<sup>3</sup> over<i>night</i>.</p><p>It is <em>over</em> now, they say.</p></article>', "The river rose by two m3 overnight.\nIt is over now, they say."),
    "references": ("<body><article><p>Fish &amp; chips &lt;3 &#8212; &eacute;t&eacute; &unknown; 5 < 6 &amp; 7 > 2.</p><p>Caf&#xE9; au lait&nbsp;now.</p></article>", "Fish & chips <3 — été &unknown; 5 < 6 & 7 > 2.\nCafé au lait now."),
    "unclosed paragraphs": (f"<body>{NAV}<article><p>{A}<p>{B}<p>{C}</article>{FOOT}", TEXT),
    "cut off": (f"<html><body>{NAV}<article><h1>Flood</h1><p>{A}</p><p>{B}", f"Flood\n{A}\n{B}"),
    "unclosed select and video": (f"<body><article><p>{A}</p><video src=x><p>{B}</p><select name=s><p>{C}</p></article>{FOOT}", TEXT),
    "empty video, then one with words": (f'<body><article><p>{A}</p><video src="x"/><p>{B}</p><video>Your browser shows no video.</video><p>{C}</p></article>', TEXT),
    "formula": ("<body><article><p>So <math><mi>a</mi><mo>+</mo><mn>2</mn></math> is what was measured that night.</p></article>", "So a+2 is what was measured that night."),
    "scripts and styles": (f"<head><title>t</title><style>p{{}}</style></head><body><script>document.write('<p>no</p>')</script><article><p>{A}</p><script>if (a<b) x('</p>')</script><p>{B}</p><style>b{{}}</style><noscript><p>Turn it on</p></noscript><p>{C}</p></article>", TEXT),
    "comment marks": (f"<body><!-- <p>old</p> --><article><p>{A}</p><!-- ad > --><p>{B}</p><!--- x --->{'<p>' + C}</article><!-- open", TEXT),
    "odd quotes": (f"<body><article><p title='it\"s'>{A}</p><p title=\"5 > 4\">{B}</p><p data-x=it's>{C}</p></article>", TEXT),
    "capital tags": (f"<BODY><NAV><A HREF=/>Home</A></NAV><ARTICLE><P>{A}</P><P>{B}</P><P>{C}</P></ARTICLE></BODY>", TEXT),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    page, want = LAYOUTS[name]
    assert html_tree.texts([page], html_tree.train()) == [want]


@pytest.mark.parametrize("page", ["<p class='x\" " * 80_000, "<a" * 400_000, "<p class=\"x'> " * 60_000, "<b>" * 100_000 + "x" + "</i>" * 100_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<div>" * 100_000 + "deep", "<video>" * 50_000, "<!" * 300_000, "< " * 400_000, "<svg " * 100_000 + ">", "<p>&" * 100_000])
def test_time_grows_with_the_size_only(page):
    began = time.time()
    html_tree.texts([page], html_tree.train())
    assert time.time() - began < 15


def test_extract(spark):
    """Null html, repeated rows, columns that clash, a very long page and an empty table."""
    rows = [(1, "u", None, "old", 3), (1, "u", None, "old", 3), (None, None, LAYOUTS["article"][0], None, None), (2, "v", "", "x", 1), (3, "w", f"<article>{P * 3000}</article>", "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, html_tree.extract(df).collect()), key=str)
    long = "\n".join([TEXT] * 3000)
    assert got == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, LAYOUTS["article"][1], len(LAYOUTS["article"][1])), (2, "v", "", 0), (3, "w", long, len(long))], key=str)
    assert html_tree.extract(df.limit(0)).count() == 0
