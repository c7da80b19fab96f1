from __future__ import annotations

import math
import random
import time
from html.parser import HTMLParser

import pytest

from shotledger.llm import html_text
from shotledger.llm.html_text import main_text

PROSE = "The first sentence is long enough, and it ends. A second one follows, as sentences do. "


def page(body, head="<title>T</title><style>p{}</style><script>var t='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>More, more.</a></li></ul></nav>{body}<footer>&copy; Someone, 2020. All rights.</footer></body></html>"


@pytest.mark.parametrize(
    "body, want",
    [
        (f"<article><h1>Head</h1><p>{PROSE}</p><p>Short.</p></article>", f"Head {PROSE}Short."),
        (f"<div class='ad'>Buy this, now! Cheap, cheap.</div><article><p>{PROSE}<br>and\n more</p></article>", f"{PROSE}and more"),
        (f"<article><p><b>{PROSE}<p>Next one, too.</article>", f"{PROSE}Next one, too."),
        (f"<div id='main'><p>{PROSE}</p><p>{PROSE}</p></div><aside><p>{PROSE}</p></aside>", f"{PROSE}{PROSE}".strip()),
        (f"<article><p>{PROSE}</p><form><p>Name, please: <input></p></form><!-- {PROSE} --><p>End &amp; out.</p></article><div class='comments'><p>{PROSE}</p></div>", f"{PROSE}End & out."),
        (f"<article><p>{PROSE}</p><div class='cookie-notice'>We use cookies. Yes, we do.</div><ul><li>point one</li><li>point two</li></ul></article>", f"{PROSE}point one point two"),
        (f"<p>{PROSE}</p><p>{PROSE}</p>", f"{PROSE}{PROSE}".strip()),
    ],
)
def test_article_only(body, want):
    assert main_text(page(body)) == want.strip()


@pytest.mark.parametrize(
    "body, want",
    [
        (f"<div class='content-sidebar-wrap'><main><p>{PROSE}</p><p>{PROSE}</p></main><div class='sidebar'>Hot, now.</div></div>", PROSE + PROSE),
        (f"<div class='has-sidebar'><div><p>{PROSE}</p><p>{PROSE}</p></div><div class='sidebar'><p>Hot, now.</p></div></div>", PROSE + PROSE),
        (f"<div id='page-header-social'><div class='share-layout'><article><p>{PROSE}</p></article><div class='ad'>Buy, buy.</div></div></div>", PROSE),
        (f"<p>Tagline.</p><div class='has-sidebar'><div><p>{PROSE * 3}</p></div><div class='comments'><p>{PROSE * 5}</p></div></div>", PROSE * 3),
        (f"<div><p>{PROSE}</p></div><div id='comments'><article class='comment'><p>{PROSE}</p><p>{PROSE}</p></article></div>", PROSE),
        (f"<article><p>{PROSE}</p></article><div class='sidebar'><p>{PROSE}{PROSE}</p></div>", PROSE),
        (f"<article><p>{PROSE}</p></article><div class='comments'><p>{PROSE * 30}</p></div>", PROSE),
        (f"<div class='has-comments'><div><p>{PROSE}</p></div></div>", PROSE),
        (f"<article><p>{PROSE}</p><p class='share'>{PROSE}</p><div class='search-for-truth'><p>{PROSE}</p></div></article>", PROSE * 3),
        (f"<div class='share'><p>{PROSE}</p><p>{PROSE}</p></div><div class='ad-slot'><p>{PROSE}</p></div>", PROSE * 2),
        (f"<div class='ad'>{PROSE}</div><article><h1>words</h1><p>{'words without marks ' * 9}</p></article>", "words " + "words without marks " * 9),
        (f"<article><div class='legal-news'><p>{PROSE}</p></div><p class='ad'>{PROSE}</p></article>", PROSE),
        (f"<div style='display:none'><main><p>{PROSE}</p></main></div><div><p>Shown, here.</p></div>", "Shown, here."),
    ],
)
def test_a_word_alone_does_not_drop_the_article(body, want):
    assert main_text(page(body)) == want.strip()


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<html></html>") == ""
    assert main_text("plain text, no tags.") == "plain text, no tags."
    assert main_text("a < b and c > d, so.") == "a < b and c > d, so."
    assert main_text("<p>one<p>two &lt;three&gt;</i></div>") == "one two <three>"
    assert main_text("<article><p>x" + " y" * 200_000 + "</p></article>").count("y") == 200_000
    assert main_text("<p title='a>b'>in, text.</p><script>never closed <p>out</p>") == "in, text."


class Tree(HTMLParser):
    """Blocks of well-formed pages by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.path, self.blocks, self.link, self.fresh = [], [], 0, True

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link += 1
        else:
            self.path.append(tag + "".join(f".{v}" for _, v in attrs))
            self.fresh = True

    def handle_endtag(self, tag):
        if tag == "a":
            self.link -= 1
        else:
            self.path.pop()
            self.fresh = True

    def handle_data(self, data):
        if self.fresh:
            self.blocks.append([tuple(self.path), "", 0])
            self.fresh = False
        self.blocks[-1][1] += data
        self.blocks[-1][2] += len(data) if self.link else 0


def slow_scores(page):
    """Each path's score straight from the definition, with a pass over all blocks for each number."""
    tree = Tree()
    tree.feed(page)
    found = [(p, " ".join(t.split()), n) for p, t, n in tree.blocks if t.split()]
    weight = lambda p: math.prod(0.001 if t.endswith(".ad") else 0.5 if t.endswith(".share") else 1 for t in p)
    mean = lambda p, f: sum(weight(p) * f(t, n) for q, t, n in found if q == p) / sum(q == p for q, _, _ in found)
    chars, points = (lambda t, n: max(0, len(t) - n)), (lambda t, n: sum(c in ",.;:!?" for c in t))

    def smooth(f, i):
        near = [(math.exp(-2 * (k / 2) ** 2), mean(found[i + k][0], f)) for k in range(-2, 3) if 0 <= i + k < len(found)]
        return sum(w * x for w, x in near) / sum(w for w, _ in near)

    fused = [smooth(chars, i) * (1 + smooth(points, i)) for i in range(len(found))]
    out = {}
    for p in {p for p, _, _ in found}:
        own = [x for (q, _, _), x in zip(found, fused) if q == p]
        out[p] = math.cbrt(sum(own) / len(own) * (mean(p, chars) * (1 + mean(p, points))) ** 2)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_ratios_against_a_slow_version(seed):
    pick = random.Random(seed)

    def part(depth):
        kind = pick.choice(["p", "p", "h2", "div", "section", "ul"])
        name = pick.choice(["", "", "", " class='ad'", " class='share'"])
        text = lambda: " ".join(pick.choice(["word,", "another", "third.", "x"]) for _ in range(pick.randrange(1, 30)))
        if kind == "ul":
            return "<ul>" + "".join(f"<li><a href='x'>{text()}</a> {text()}</li>" for _ in range(3)) + "</ul>"
        if kind in ("p", "h2") or not depth:
            return f"<p{name}>{text()}, so.</p>"
        return f"<{kind}{name}>" + "".join(part(depth - 1) for _ in range(pick.randrange(1, 5))) + f"</{kind}>"

    page = "<html><body>" + "".join(part(3) for _ in range(6)) + "</body></html>"
    got, _ = html_text.scores(html_text.blocks(page))

    def names(path):
        if path is None or not path.tag:
            return ()
        own = path.weight / (path.above.weight or 1)
        return (*names(path.above), path.tag + (".ad" if own < 0.1 else ".share" if own < 1 else ""))

    want = slow_scores(page)
    assert {names(p) for p in got} == set(want)
    assert all(math.isclose(x, want[names(p)], rel_tol=1e-9, abs_tol=1e-12) for p, x in got.items())


@pytest.mark.parametrize(
    "unit", ["<a ", "<div>", "<a '>", "<a \">\" ", "</div", "<span><hr>", "<svg/>", "<script></script ", "<!-- ", "<p><table><i>", "<li><b>", "&#38;", "<div class='a b c'", "</p>", "<td><em>", "< "]
)
def test_hostile_pages_are_read_in_linear_time(unit):
    page = "<p>Start, here.</p>" + unit * (1_000_000 // len(unit))
    began = time.monotonic()
    main_text(page)
    assert time.monotonic() - began < 8  # measured: at most 2 s; the machine may be busy


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", page(f"<article><p>{PROSE}</p></article>"), "t"), (1, None, None, "t"), (None, "v", "", "t")], "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in html_text.extract(pages).collect()), key=repr)
    assert got == sorted([(1, "u", PROSE.strip(), len(PROSE.strip())), (1, None, "", 0), (None, "v", "", 0)], key=repr)
    assert html_text.extract(pages.limit(0)).count() == 0


DEUTSCH = "Der erste Satz ist lang genug, und er endet. Ein zweiter folgt, wie es Sätze tun. "


@pytest.mark.parametrize("prose", [PROSE, DEUTSCH])
def test_what_stands_in_an_article_and_beside_it(prose):
    table = "<figure class='wp-block-table'><table><tr><td>1990, north</td><td>12.5</td></tr></table><figcaption>Source, as said.</figcaption></figure>"
    quote = "<figure><blockquote><p>What was said, word by word.</p></blockquote></figure>"
    sources = "<ul><li><a href='/1'>The first source &amp; more</a></li><li><a href='/2'>Another source</a></li></ul>"
    teasers = "<div class='related-posts-box'><p>Read this too, it is good. And that, and that.</p><p>Another teaser, longer than the article, with many commas, all of them here. And on, and on, it goes.</p></div>"
    assert main_text(page(f"<article><p>{prose}</p>{table}<p>{prose}</p>{quote}</article>")) == f"{prose}1990, north 12.5 {prose}What was said, word by word."
    assert main_text(page(f"<article><p>{prose}</p><p>{prose}</p>{sources}</article>")) == f"{prose}{prose}The first source & more Another source"
    assert main_text(page(f"<article><p>{prose}</p><ul class='tags'><li><a href='/1'>one</a></li></ul></article>{sources}")) == prose.strip()
    assert main_text(page(f"<article><p>{prose}</p></article>{teasers}")) == prose.strip()
    assert main_text(page(f"<div id='text'><p>{prose}</p><p>{prose}</p></div>{teasers}")) == f"{prose}{prose}".strip()


def test_pages_without_an_article_are_empty():
    assert main_text(page("<div class='cookie-notice'><p>We use cookies, as all do. Agree, or leave.</p></div>")) == ""
    assert main_text(page(f"<div id='comments'><p>{PROSE * 20}</p></div>")) == ""
    assert main_text(page(f"<div class='widget'><p>{PROSE * 20}</p></div>")) == (PROSE * 20).strip()


@pytest.mark.parametrize("deep", [5, 600])
def test_deep_pages(deep):
    inner = f"<nav><ul><li>Menu, menu, menu.</li></ul></nav><div hidden>Unseen, unseen.</div><p>{PROSE}</p>"
    assert main_text(f"<body>{'<div>' * deep}{inner}{'</div>' * deep}<p>{PROSE}</p></body>") == f"{PROSE}{PROSE}".strip()
    assert main_text(f"<body><div hidden>{'<div>' * deep}a, b.{'</div>' * deep}Unseen, unseen.</div><p>{PROSE}</p></body>") == PROSE.strip()
