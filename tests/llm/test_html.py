"""Markup that is left open, attributes that only look like marks, and articles in plain divisions."""

import random
import re
import time

import pytest

from chartweave.llm import html

from .util import prose

BROKEN = ["<script ", "<a ", '<a "', "<a 'x>\" ", '<a "x>" ', "<!--", "<script>", "<a<", "<", "</", "<p title='a\"b>'>x", "<!x "]


@pytest.mark.parametrize("part", BROKEN)
@pytest.mark.parametrize("tail", ["", ">"])
def test_time_grows_with_the_page(part, tail):
    began = time.process_time()
    html.Page(part * (1_000_000 // len(part)) + tail).extract(None)
    assert time.process_time() - began < 4


def test_tags_are_those_of_a_plain_scan():
    """Against a scanner that tries every place anew."""

    def plain(text):
        at, found = 0, []
        while (start := text.find("<", at)) >= 0:
            rest = text[start:]
            for expression in (r"<!--.*?(?:-->|\Z)", r"<(script|style|xmp|noframes)\b[^>]*>.*?(?:</\1\s*>|\Z)", r"<(?P<c>/?)(?P<n>[a-z][^\s/>]*+)(?P<a>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", r"<(?P<c>/?)(?P<n>[a-z][^\s/>]*+)(?P<a>[^>]*)>", r"<[!?][^>]*>"):
                m = re.match(expression, rest, re.S | re.I)
                if m:
                    d = m.groupdict()
                    found.append((start, start + m.end(), d["n"].lower() if d.get("n") else None, bool(d.get("c")), d.get("a") or ""))
                    at = start + m.end()
                    break
            else:
                at = start + 1
        return found

    rng = random.Random(4)
    pieces = ["<", ">", '"', "'", "<a", "<p ", "</p", "/", " ", "x", "=", "<!", "<!-- ", "-->", "<script", "</script>", "<style>", "</style >", "<B", "?"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14))) + rng.choice(["", ">", "-->"])
        got = list(html.Markup(text).tags())
        want = [t for t in plain(text) if t[0] < text.rfind(">")]  # a comment after the last > of a page has nothing behind it
        assert [t for t in got if t[2]] == [t for t in want if t[2]], text


def test_words_in_attribute_values_are_no_marks():
    page = '<article><h1>Head</h1><p title="the hidden truth">One hidden thing.</p><p data-x=hidden>Two.</p><p hidden>gone</p><p HIDDEN="">gone</p></article>'
    assert html.Page(page).extract(None) == "Head\n\nOne hidden thing.\n\nTwo."


def test_articles_in_plain_divisions_are_whole():
    rng = random.Random(2)
    a, b, c, d = (prose(rng, 30) for _ in range(4))
    menu = "<ul class=x><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>About</a></ul>"
    lists = "<ul><li><a href=1>first source</a></li><li><a href=2>second source</a></li><li><a href=3>third source</a></li></ul>"
    page = f"<body>{menu}<div class=post><p>{a}</p>{lists}<p>{b}</p></div></body>"
    assert html.Page(page).extract(None) == "\n\n".join([a, "first source", "second source", "third source", b])
    page = f"<body>{menu}<div id=wrap><h1>Title</h1><div class=text><p>{a}</p><p>{b}</p><p>{c}</p><p>{d}</p></div><div><p>last short par</p></div></div></body>"
    assert html.Page(page).extract(None) == "\n\n".join(["Title", a, b, c, d, "last short par"])
