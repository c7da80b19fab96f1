"""Main text of web pages by tag-path ratios.

A page becomes blocks: runs of text between block-level tags, each with its root-to-leaf path of block tags. Per path, text length and
punctuation are summed and divided by the number of blocks with that path, which gives two ratios. Both series are smoothed
over the page with a short Gaussian window and fused, length times one more than punctuation, so that text without any still counts; a path whose mean fused score reaches a share of the
series' spread is content. Blocks in the same container as a content path, such as its headings and lists, belong to the article
unless they are mostly links.

Elements that are never article text by their tag (menus, forms, footers, scripts and so on), or that are hidden, don't enter the ratios. Words in
class, id or role drop nothing: they enter the path as a mark, and text under a mark counts for less in both ratios (``MARKED`` where the name
says nothing but noise, such as ``cookie-notice``; ``HINTED`` where it may as well be a subject, such as ``share`` or ``search-for-truth``). An article or main
element under a mark counts in full again, except among readers' replies. Text under a mark that stands beside the article (in another article or main element than the
best content, or where there is none, under a mark that doesn't hold the best content too) goes. Lists of links stay where they are part of an article element and under no mark. If all content is
under noise marks, the text is empty if it is readers' replies or no more than ``LONE_WORDS`` words.

Pages are read in one pass with work in proportion to their length. As in browsers, elements nested over ``DEPTH`` deep add nothing
to the path; they are counted by name, so that they end where they end and menus among them are dropped. Defined results: null, empty and text-free pages give the empty text; text outside any block tag is a block of the body; tags that are
not closed, or closed without being open, are tolerated; repeated rows are extracted one by one. Texts of any length are read whole.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from statistics import pstdev

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: HTML elements by how they are read.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark q ruby rt s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math object canvas audio video".split())
NOT_ARTICLE = frozenset("head nav footer aside form menu dialog button select option fieldset script style figcaption".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Words in class, id or role for what isn't article text.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent copyright disqus "
    "footer masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination pager paywall popup promo promoted promotion "
    "replies respond sidebar signup sponsor sponsored subscribe subscription toolbar widget login".split()
)
#: Words for the same that can also be what an article is about, or stand in the middle of it.
HINT_WORDS = frozenset("byline disclaimer form header legal recommended related reply search share sharing skip social tags teaser toc".split())
#: Of the noise words, those for what readers add.
REPLY_WORDS = frozenset("comment comments disqus replies respond".split())
#: Words that say where something stands, and nothing of what it is.
PLACE_WORDS = frozenset("area bar block bottom box col column container global group inner item items left list main outer page panel right section site slot top unit wrap wrapper".split())
MARKED, HINTED, DEPTH, LONE_WORDS = 0.001, 0.5, 512, 100
PUNCTUATION = re.compile(r"[,.;:!?…，。；：！？、]")
_TAG_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_QUOTE_OR_END = re.compile(r"[>\"']")


class Path:
    """A path of tags, one object for each path of a page: its last tag, the path above, and how much text under it counts."""

    __slots__ = ("tag", "above", "noise", "reply", "weight", "below", "mark", "article")

    def __init__(self, tag: str, above: Path | None, noise: bool = False, hint: bool = False, reply: bool = False):
        self.tag, self.above, self.noise = tag, above, noise
        self.reply = reply or above is not None and above.reply
        if tag in ("article", "main") and not self.reply:
            self.weight = 1.0
        else:
            self.weight = (above.weight if above else 1.0) * (MARKED if noise else HINTED if hint else 1.0)
        #: The nearest element with a mark, itself included, and the outermost article or main element.
        self.mark = self if noise or hint else above.mark if above is not None else None
        self.article = above.article if above is not None and above.article is not None else self if tag in ("article", "main") else None
        self.below: dict[tuple[str, bool, bool, bool], Path] = {}

    def child(self, tag: str, marks: tuple[bool, bool, bool]) -> Path:
        found = self.below.get((tag, *marks))
        if found is None:
            found = self.below[(tag, *marks)] = Path(tag, self, *marks)
        return found


def marks(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element's names mark it as noise, hint at noise, and mark it as readers' replies."""
    noise = hint = reply = False
    if attributes and tag not in ("html", "body", "article", "main"):
        for m in _NAMES.finditer(attributes):
            for name in (m[1] or m[2] or m[3] or "").lower().split():
                words = set(re.findall(r"[a-z]+", name))
                if not words & NOISE_WORDS:
                    hint |= bool(words & HINT_WORDS)
                elif words <= NOISE_WORDS | HINT_WORDS | PLACE_WORDS:
                    noise, reply = True, reply or bool(words & REPLY_WORDS)
                else:
                    hint = True
    return noise, hint and not noise, reply


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, name, whether it ends an element, and attributes of each tag; the name is empty for comments and the like."""
    at, quoted = 0, True
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", False, ""
            at = end
            continue
        m = _TAG_NAME.match(page, at + 1)
        if m is None and page[at + 1 : at + 2] not in ("!", "?", "/"):
            at += 1
            continue
        end = page.find(">", m.end() if m else at + 1)
        if end < 0:
            return  # no tag can end any more
        if m and quoted:
            upto = m.end()
            while (q := _QUOTE_OR_END.search(page, upto)) and q[0] != ">" and (close := page.find(q[0], q.end())) >= 0:
                upto = close + 1
            if q and q[0] == ">":
                end = q.start()
            else:
                quoted = False  # from here on quotes don't pair up, so they hide no end of a tag
        if m:
            yield at, end + 1, m[1].lower(), page[at + 1] == "/", page[m.end() : end]
        else:
            yield at, end + 1, "", False, ""
        at = end + 1


def blocks(page: str) -> list[tuple[Path, str, int]]:
    """(path, text, characters in links) of each block that may be article text, in page order."""
    found: list[tuple[Path, str, int]] = []
    tags: list[str] = []
    paths: list[Path] = [Path("", None)]
    dropped: list[bool] = [False]
    is_open: Counter[str] = Counter()
    buf: list[str] = []
    linked: list[str] = []
    at = 0
    # Elements too deep for a path: per name, whether each open one is dropped; and how many are.
    deeper: dict[str, list[bool]] = {}
    n_dropped = 0

    def flush() -> None:
        if buf:
            text = " ".join(html.unescape("".join(buf)).split())
            if text:
                found.append((paths[-1], text, len(" ".join(html.unescape("".join(linked)).split()))))
            buf.clear()
        linked.clear()

    def text(upto: int) -> None:
        if upto > at and not dropped[-1] and not n_dropped:
            buf.append(page[at:upto])
            if is_open["a"] or deeper.get("a"):
                linked.append(page[at:upto])

    def cut(k: int) -> None:
        nonlocal n_dropped
        is_open.subtract(tags[k:])
        del tags[k:], paths[k + 1 :], dropped[k + 1 :]
        deeper.clear()
        n_dropped = 0

    def close(names: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        if any(is_open[x] for x in names):
            for k in range(len(tags) - 1, -1, -1):
                if tags[k] in within:
                    return
                if tags[k] in names:
                    return cut(k)

    for start, end, tag, ends, attributes in tokens(page):
        if start < at:  # inside an element that is read raw
            continue
        text(start)
        at = end
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        elif tag == "br" and not dropped[-1] and not n_dropped:
            buf.append(" ")
            linked.append(" ")
        if ends:
            if deeper.get(tag):
                n_dropped -= deeper[tag].pop()
            else:
                close((tag,))
            continue
        if tag in CLOSES_P:
            close(("p",), ("table", "td", "th", "button", "object", "article", "section", "div"))
        if tag in CLOSES:
            names, within = CLOSES[tag]
            close(tuple(names.split()), within)
        if tag in RAW:
            if not (tag in ("svg", "math") and attributes.rstrip().endswith("/")):
                last = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
                stop = page.find(">", last.end()) if last else -1
                at = len(page) if stop < 0 else stop + 1
        elif tag not in VOID:
            header = tag == "header" and not is_open["article"] and not is_open["main"]
            hidden = bool(attributes) and tag not in ("html", "body", "article", "main") and _HIDDEN.search(attributes) is not None
            goes = tag in NOT_ARTICLE or header or hidden
            if len(tags) >= DEPTH:
                deeper.setdefault(tag, []).append(goes)
                n_dropped += goes
                continue
            dropped.append(dropped[-1] or goes)
            paths.append(paths[-1] if tag in INLINE or dropped[-1] else paths[-1].child(tag, marks(tag, attributes)))
            tags.append(tag)
            is_open[tag] += 1
    text(len(page))
    flush()
    return found


def smoothed(series: list[float], radius: int = 2) -> list[float]:
    """Gaussian mean over the neighbours within the radius, with a deviation of half of it."""
    weights = [math.exp(-2 * (k / radius) ** 2) for k in range(-radius, radius + 1)]
    n = len(series)
    mean = []
    for i in range(n):
        near = [(weights[k + radius], series[i + k]) for k in range(-radius, radius + 1) if 0 <= i + k < n]
        mean.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    return mean


def scores(found: list[tuple[Path, str, int]]) -> tuple[dict[Path, float], float]:
    """The score of each path, and the standard deviation of the fused series."""
    sums: dict[Path, list[float]] = {}
    for path, text, links in found:
        s = sums.setdefault(path, [0, 0, 0, 0])
        s[0] += path.weight * max(0, len(text) - links)
        s[1] += path.weight * len(PUNCTUATION.findall(text))
        s[2] += 1
    length = smoothed([sums[p][0] / sums[p][2] for p, _, _ in found])
    points = smoothed([sums[p][1] / sums[p][2] for p, _, _ in found])
    fused = [a * (1 + b) for a, b in zip(length, points)]
    for (path, _, _), x in zip(found, fused):
        sums[path][3] += x
    # A path's own ratios count for more than its surroundings, so that a short line or lone link list beside long paragraphs stays out.
    return {p: math.cbrt(total / n * (chars / n * (1 + marks / n)) ** 2) for p, (chars, marks, n, total) in sums.items()}, pstdev(fused)


def main_text(page: str | None, share: float = 0.5) -> str:
    """The article's blocks joined by one space; ``share``: of the fused series' standard deviation, that a path's score must reach."""
    found = blocks(page or "")
    if not found:
        return ""
    score, spread = scores(found)
    top = max(score.values())
    limit = min(share * spread, top)
    content = {p for p, x in score.items() if x >= limit and x >= 0.1 * top} or {max(score, key=score.get)}
    # Where the article is: in an article or main element, else under no mark, as far as there is content.
    places = [p for p in content if p.article is not None and p.weight == 1] or [p for p in content if p.weight == 1] or list(content)
    best = max(places, key=score.get)
    if best.weight <= MARKED and (best.reply or sum(len(t.split()) for p, t, _ in found if p in content) <= LONE_WORDS):
        return ""
    around, up = set(), best
    while up is not None:
        around.add(up)
        up = up.above

    def beside(path: Path) -> bool:
        """Under a mark that the best content isn't under, and not in its article."""
        if path.mark is None or path.mark in around or path.article is not None and path.article in around:
            return False
        return best.article is not None or path.mark.weight < best.weight

    content = {p for p in content if not beside(p)}
    homes = {p.above for p in content if p.above is not None and p.above.tag not in ("", "html", "body")}
    bare = {p.above for p in content} - homes
    at_home: dict[Path | None, bool] = {None: False}

    def belongs(path: Path, text: str, links: int) -> bool:
        if path in content:
            return True
        if path.noise or beside(path):
            return False
        if 2 * links > len(text):
            return path.tag in ("li", "dd") and path.weight == 1 and path.article is not None and path.article in around
        up, way = path, []
        while up not in at_home:
            way.append(up)
            if up in homes or up.noise:
                at_home[up] = up in homes
                break
            up = up.above
        for x in way:
            at_home[x] = at_home[up]
        return at_home[path] or path.above in bare and re.fullmatch("h[1-6]|blockquote|pre", path.tag) is not None

    return " ".join(t for p, t, links in found if belongs(p, t, links))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` per page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = [main_text(x.as_py()) for x in part.column(2)]
                arrays = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
