"""Main text of web pages by minimum cut.

A page is read into blocks of text (what stands between two starts or ends of block elements). Each block has a
node. Its terminal capacities are the costs of either label: a naive Bayes classifier's log-odds from the
block's words, links, punctuation, tag and place, plus a cost where an enclosing element says what it is: a high one
for tags and roles (article and main; nav, footer, aside, form), less for class names that say it by themselves ("comments"),
little for names that occur in articles too ("related"), which classifier and neighbours may overrule. An inline element
that speaks against its text makes a node of its own. Neighbouring blocks, and blocks next to each other under one parent,
are tied by edges whose capacity falls with their distance in the DOM. The maximum flow
(by blocking flows) gives the cheapest labelling; blocks that cannot reach the boilerplate terminal are content.

The classifier is trained here, on the blocks of at most TRAIN_PAGES pages (by a hash of their texts) whose
tags or roles say what they are, never class names; weak priors stand for pages without any. Everything else is read from the page alone.

Pages are read in one pass: time is in proportion to a page's length, whatever tags it leaves open or closes in vain.

Cases: a null or empty page has the empty text; unclosed and misplaced tags are repaired as browsers do in
the usual cases; a page of boilerplate only has the empty text; repeated rows give the same text each; null ids
and urls pass; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import least

TRAIN_PAGES = 400
PAGE_WEIGHT = 20  # blocks of either label that a page counts for at most in training, however many it has
SIBLINGS, NEIGHBOURS = 2.0, 1.0

_LETTER = re.compile("[a-zA-Z]")
_TAG_NAME = re.compile(r"[^\s/>]++")
_GAP = re.compile(r"[\s/]*+")
_ATTRIBUTE_NAME = re.compile(r"=?[^\s/>=]*+")
_EQUALS = re.compile(r"\s*+=\s*+")
_BARE_VALUE = re.compile(r"[^\s>]*+")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_ENDS: dict[str, re.Pattern] = {}

RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "title", "textarea", "audio", "video", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li",
    "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSES_P = BLOCK - {"body", "caption", "head", "html", "legend", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: An element that starts ends the innermost open one of these, unless one of the second stands within that.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tr": (("tr",), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)), "body": (("head",), ()),
}
HOLDS_P = {"article", "aside", "blockquote", "body", "button", "dd", "details", "dialog", "div", "fieldset", "figure", "footer", "form", "header", "html", "li", "main", "nav", "section", "table", "td", "th"}
TABLE_PARTS = {"caption", "table", "tbody", "td", "tfoot", "th", "thead", "tr"}
CELLS = {"caption", "table", "td", "th"}  # an end tag of anything else doesn't reach out of these

BOILERPLATE_TAGS = {"nav", "footer", "aside", "menu", "select", "search", "dialog", "button", "head"}
BOILERPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
#: Parts of a class or an id that say boilerplate by themselves.
STRONG_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disqus", "footer", "login", "modal", "nav", "navbar", "navigation", "newsletter", "pagination", "popup", "promo", "promoted", "sidebar", "signup",
    "sponsor", "sponsored", "subscribe",
}
#: Those that also occur in articles: the block's own words and its neighbours may speak louder.
WEAK_NAMES = {
    "banner", "copyright", "disclaimer", "menu", "notice", "notices", "pager", "promotion", "recommended", "related", "replies", "reply", "respond", "search",
    "share", "sharing", "skip", "social", "tags", "toolbar", "widget",
}
CONTENT_NAMES = {"article", "body", "content", "entry", "main", "post", "story", "text"}
HEADER_NAMES = {"header", "masthead", "topbar"}

#: What elements say of the text in them, and the cost against the other label (positive: of boilerplate).
_NONE, _LIKELY, _CONTENT, _WEAK, _STRONG, _FORM, _FIRM = range(7)
COSTS = (0.0, 6.0, 16.0, -3.0, -16.0, -40.0, -40.0)
MOST_LEARNED = 8.0  # that the classifier adds to either side
_REFUSED = {_WEAK, _STRONG, _FORM, _FIRM}


def _says(tag: str, attributes: list[tuple[str, str]], inside: int, seen_content: bool, in_article: bool) -> int:
    """What the element says of its text, given what its parent says."""
    if inside == _FIRM or tag in BOILERPLATE_TAGS or tag == "header" and not in_article:
        return _FIRM
    names: set[str] = set()
    claimed = False
    for name, value in attributes:
        if name in ("class", "id"):
            names.update(x.lower() for x in _NAME_PART.findall(html.unescape(value)))
        elif name == "role" and tag != "article":
            if value.lower() in BOILERPLATE_ROLES:
                return _FIRM
            claimed = claimed or value.lower() == "main"
        elif name == "itemprop":
            claimed = claimed or value == "articleBody"
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return _FIRM
    if tag in ("html", "body"):
        return inside
    good, strong, weak = names & CONTENT_NAMES, names & STRONG_NAMES, names & WEAK_NAMES
    if not in_article:
        strong |= names & HEADER_NAMES
    firmly = strong and (not good or strong & {"ad", "ads", "comment", "comments", "sidebar"} and "main" not in names)
    if claimed or tag in ("article", "main"):
        return _STRONG if firmly else inside if inside in _REFUSED and seen_content else _CONTENT
    if tag == "form":
        return _FORM
    if firmly:
        return max(inside, _STRONG)
    if inside in _REFUSED or inside == _CONTENT and not weak:
        return inside
    if weak and not good:
        return _WEAK
    return _LIKELY if inside == _NONE and good & {"article", "content", "entry", "main", "post", "story"} else inside


class Block:
    """Text between two block boundaries; an inline element that says otherwise than its block makes one of its own, on the same line."""

    __slots__ = ("above", "holder", "line", "linked", "named", "runs", "tag", "text")

    def __init__(self, line: int, named: int, holder: int, above: int, tag: str):
        self.line, self.named, self.holder, self.above, self.tag = line, named, holder, above, tag
        self.runs: list[tuple[int, str]] = []  # place in the page, and text as it stands there
        self.linked, self.text = 0, ""


class Page:
    """The blocks of a page, in one pass over it. `up` and `depth` are of its block elements."""

    def __init__(self, page: str):
        self.found: list[Block] = []
        self.up, self.depth = [0], [0]
        # open elements: tag, number of the innermost block element, what it says, whether in an article, places of the innermost block, cell and p
        self.stack: list[tuple] = [("", 0, _NONE, False, 0, 0, 0)]
        self.opens: dict[str, list[int]] = {}
        self.links, self.line, self.seen_content = 0, 0, False
        self.lines: dict[int, Block] = {}  # blocks of the line, by what they say
        self._read(page)
        self._flush()

    def _flush(self) -> None:
        for block in self.lines.values():
            block.text = " ".join("".join(t for _, t in block.runs).split())
            if block.text:
                self.found.append(block)
        self.lines = {}
        self.line += 1

    def _text(self, at: int, text: str) -> None:
        top = self.stack[-1]
        holder = self.stack[top[4]]
        says = top[2] if top[2] in _REFUSED else holder[2]  # an inline element speaks up only against its text
        if (block := self.lines.get(says)) is None:
            block = self.lines[says] = Block(self.line, says, holder[1], self.up[holder[1]], holder[0])
        block.runs.append((at, text))
        if self.links:
            block.linked += len("".join(text.split()))

    def _close(self, to: int) -> None:
        while len(self.stack) > to:
            tag = self.stack.pop()[0]
            self.opens[tag].pop()
            self.links -= tag == "a"

    def _last(self, tags: tuple) -> int:
        return max((self.opens[t][-1] for t in tags if self.opens.get(t)), default=0)

    def _end(self, tag: str) -> None:
        k = self._last((tag,))
        if not k:
            if tag == "p":  # stands for an empty paragraph
                self._flush()
            return
        top = self.stack[-1]
        if tag not in TABLE_PARTS and top[5] > k or tag in TABLE_PARTS and tag != "table" and self._last(("table",)) > k:
            return
        if tag not in BLOCK and top[4] > k:  # blocks opened in it stay open
            if tag == "a":
                self.links -= 1
                self.opens["a"].pop()
                self.opens.setdefault("", []).append(k)
                self.stack[k] = ("", *self.stack[k][1:])
            return
        if tag in BLOCK:
            self._flush()
        self._close(k)

    def _start(self, tag: str, attributes: list[tuple[str, str]]) -> None:
        if tag in BLOCK:
            self._flush()
            if tag in CLOSES_P and self.stack[-1][6]:
                self._close(self.stack[-1][6])
            if tag in ENDS:
                tags, until = ENDS[tag]
                if (k := self._last(tags)) > self._last(until):
                    self._close(k)
        elif tag == "a" and self.links:
            self._end("a")
        above = self.stack[-1]
        here, block = len(self.stack), tag in BLOCK
        says = _says(tag, attributes, above[2], self.seen_content, above[3])
        if tag in ("article", "main") and says == _CONTENT:
            self.seen_content = True
        number = above[1]
        if block:
            number = len(self.up)
            self.up.append(above[1])
            self.depth.append(self.depth[above[1]] + 1)
        p = here if tag == "p" else 0 if tag in HOLDS_P else above[6]
        self.stack.append((tag, number, says, above[3] or tag in ("article", "main"), here if block else above[4], here if tag in CELLS else above[5], p))
        self.opens.setdefault(tag, []).append(here)
        self.links += tag == "a"

    def _read(self, page: str) -> None:
        at, end, endless = 0, len(page), set()
        while at < end:
            stop = page.find("<", at)
            while 0 <= stop < end - 1 and page[stop + 1] not in "!?/" and not _LETTER.match(page, stop + 1):
                stop = page.find("<", stop + 1)  # a sign of its own
            if stop < 0 or stop == end - 1:
                stop = end
            if stop > at:
                piece = page[at:stop]
                self._text(at, html.unescape(piece) if "&" in piece else piece)
            if stop == end:
                return
            at = stop + 1
            if page[at] in "!?":
                comment = page.startswith("!--", at)
                stop = at + 3 if comment and page.startswith(("!-->", "!--->"), at) else page.find("-->" if comment else ">", at + 3 if comment else at)
                at = end if stop < 0 else page.find(">", stop) + 1
                continue
            closing = page[at] == "/"
            name = _TAG_NAME.match(page, at + closing)
            if not name or not _LETTER.match(name[0]):  # "</" before no letter: a comment up to the next ">"
                stop = page.find(">", at)
                at = end if stop < 0 else stop + 1
                continue
            tag, at = name[0].lower(), name.end()
            attributes, at = _attributes(page, at)
            if attributes is None:
                return
            if closing:
                if tag == "br":
                    self._text(at, " ")
                elif tag not in RAW:
                    self._end(tag)
            elif tag in RAW:
                if tag in ("svg", "math") and page[at - 2] == "/":
                    continue
                ending = None if tag in endless else _raw_end(tag).search(page, at)
                if ending:
                    _, at = _attributes(page, ending.end())
                else:
                    endless.add(tag)
                    at = end if tag in ("script", "style", "textarea", "title") else at
            elif tag in VOID:
                if tag == "hr":
                    self._flush()
                elif tag == "br":
                    self._text(at, " ")
            else:
                self._start(tag, attributes)

    def distance(self, a: Block, b: Block) -> int:
        """Steps between the elements that hold two blocks."""
        x, y, steps = a.holder, b.holder, 0
        while x != y:
            if self.depth[x] < self.depth[y]:
                x, y = y, x
            x = self.up[x]
            steps += 1
        return steps


def _raw_end(tag: str) -> re.Pattern:
    if tag not in _RAW_ENDS:
        _RAW_ENDS[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)
    return _RAW_ENDS[tag]


def _attributes(page: str, at: int) -> tuple[list[tuple[str, str]] | None, int]:
    """Attributes of a tag from after its name, and where the page goes on; no list if the page ends before the tag does."""
    found: list[tuple[str, str]] = []
    end = len(page)
    while True:
        at = _GAP.match(page, at).end()
        if at >= end:
            return None, end
        if page[at] == ">":
            return found, at + 1
        name = _ATTRIBUTE_NAME.match(page, at)
        at, value = name.end(), ""
        if equals := _EQUALS.match(page, at):
            at = equals.end()
            if at >= end:
                return None, end
            if page[at] in "\"'":
                close = page.find(page[at], at + 1)
                if close < 0:
                    return None, end
                value, at = page[at + 1 : close], close + 1
            elif page[at] != ">":
                bare = _BARE_VALUE.match(page, at)
                value, at = bare[0], bare.end()
        found.append((name[0].lower(), value))


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in order, without empty ones."""
    return Page(page).found


#: Features of a block with the number of their values, and prior counts (content, boilerplate) of each value.
PRIORS = (
    ((1, 3), (2, 3), (3, 3), (4, 2), (8, 1)),  # words: 1, 2-4, 5-9, 10-24, more
    ((6, 2), (3, 3), (1, 4), (1, 8)),  # share of linked characters: none, to 1/3, to 2/3, more
    ((2, 4), (4, 2)),  # ends as a sentence does
    ((6, 2), (4, 2), (2, 5), (2, 2), (2, 3)),  # p, heading, list item, table or quote, other
    ((2, 3), (4, 2), (2, 4)),  # first tenth, middle, last tenth of the blocks
    ((4, 3), (1, 3)),  # holds a copyright sign or bars between words
)
_OFFSETS = np.cumsum([0, *map(len, PRIORS)])
_TAGS = {"p": 0, "h1": 1, "h2": 1, "h3": 1, "h4": 1, "h5": 1, "h6": 1, "li": 2, "td": 3, "th": 3, "blockquote": 3, "pre": 3, "figcaption": 3}


def features(block: Block, k: int, n: int) -> list[int]:
    words = block.text.count(" ") + 1
    share = block.linked / max(1, len(block.text) - words + 1)
    values = (
        0 if words < 2 else 1 if words < 5 else 2 if words < 10 else 3 if words < 25 else 4,
        0 if not share else 1 if share <= 1 / 3 else 2 if share <= 2 / 3 else 3,
        int(block.text[-1] in ".!?…:;\"'”»)。！？"),
        _TAGS.get(block.tag, 4),
        0 if 10 * k < n else 2 if 10 * (k + 1) > 9 * n else 1,
        int("©" in block.text or " | " in block.text),
    )
    return [int(o) + v for o, v in zip(_OFFSETS, values, strict=False)]


def priors() -> np.ndarray:
    return np.array([x for f in PRIORS for x in f], float)


def log_odds(counts: np.ndarray) -> np.ndarray:
    """By feature value, ln P(value | content) - ln P(value | boilerplate)."""
    out = np.empty(len(counts))
    for a, b in zip(_OFFSETS[:-1], _OFFSETS[1:], strict=True):
        out[a:b] = np.log(counts[a:b, 0] / counts[a:b, 0].sum()) - np.log(counts[a:b, 1] / counts[a:b, 1].sum())
    return out


def content_side(gains: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """The cheapest labelling of nodes: gains are log-odds of content, ties are undirected edges with capacities.

    A node with a positive gain is filled from the source, one with a negative gain drains to the sink;
    blocking flows in layers saturate the ties between. Content is what cannot reach the sink.
    """
    n = len(gains)
    filled, drain = [max(0.0, g) for g in gains], [max(0.0, -g) for g in gains]
    to: list[int] = []
    room: list[float] = []
    edges: list[list[int]] = [[] for _ in range(n)]
    for a, b, c in ties:
        edges[a].append(len(to))
        to.append(b)
        room.append(c)
        edges[b].append(len(to))
        to.append(a)
        room.append(c)
    while True:
        layer = [0 if f > 1e-12 else -1 for f in filled]
        queue, reached = deque(k for k in range(n) if not layer[k]), False
        while queue:
            k = queue.popleft()
            reached = reached or drain[k] > 1e-12
            for e in edges[k]:
                if room[e] > 1e-12 and layer[to[e]] < 0:
                    layer[to[e]] = layer[k] + 1
                    queue.append(to[e])
        if not reached:
            break
        following = [0] * n
        for start in range(n):
            while layer[start] == 0 and filled[start] > 1e-12:
                path, k = [], start
                while drain[k] <= 1e-12:
                    while following[k] < len(edges[k]):
                        e = edges[k][following[k]]
                        if room[e] > 1e-12 and layer[to[e]] == layer[k] + 1:
                            break
                        following[k] += 1
                    else:
                        if not path:
                            k = -1
                            break
                        k = to[path.pop() ^ 1]
                        following[k] += 1
                        continue
                    path.append(e)
                    k = to[e]
                if k < 0:
                    break
                flow = min([filled[start], drain[k], *(room[e] for e in path)])
                filled[start] -= flow
                drain[k] -= flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
    drains = [d > 1e-12 for d in drain]
    queue = deque(k for k in range(n) if drains[k])
    while queue:
        k = queue.popleft()
        for e in edges[k]:
            if room[e ^ 1] > 1e-12 and not drains[to[e]]:
                drains[to[e]] = True
                queue.append(to[e])
    return [not d for d in drains]


def labelled(page: Page, odds: np.ndarray) -> list[bool]:
    """Whether each block of the page is content."""
    found, n = page.found, len(page.found)
    gains, ties, last = [], [], {}
    for k, block in enumerate(found):
        learned = float(sum(odds[f] for f in features(block, k, n)))
        gains.append(max(-MOST_LEARNED, min(MOST_LEARNED, learned)) + COSTS[block.named])
        if k:
            if found[k - 1].line == block.line:
                capacity = SIBLINGS
            else:
                apart = page.distance(found[k - 1], block)
                capacity = SIBLINGS if apart <= 2 and found[k - 1].above == block.above else NEIGHBOURS / (1 + apart)
            ties.append((k - 1, k, capacity))
        if (before := last.get(block.above, k)) < k - 1:
            ties.append((before, k, NEIGHBOURS))
        last[block.above] = k
    return content_side(gains, ties)


def extract(page: str | None, odds: np.ndarray) -> str:
    read = Page(page or "")
    lines: dict[int, list[tuple[int, str]]] = {}
    for block, content in zip(read.found, labelled(read, odds), strict=True):
        if content:
            lines.setdefault(block.line, []).extend(block.runs)
    return "\n".join(" ".join("".join(t for _, t in sorted(runs)).split()) for _, runs in sorted(lines.items()))


def told(block: Block) -> int | None:
    """1 (content) or 0 as an element by its tag or role says, not by a class; None if none does."""
    return 1 if block.named == _CONTENT else 0 if block.named in (_FORM, _FIRM) else None


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((len(priors()), 2), np.int64)
    for batch in batches:
        for page in batch.column(0).to_pylist():
            found, own = blocks(page or ""), np.zeros_like(counts)
            for k, block in enumerate(found):
                if (label := told(block)) is not None:
                    own[features(block, k, len(found)), 1 - label] += 1
            each = np.maximum(PAGE_WEIGHT, own[: len(PRIORS[0])].sum(axis=0))  # every block has one value of the first feature
            counts += own * 1000 * PAGE_WEIGHT // each
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts)), pa.int32()), pa.array(counts[:, 0].copy()), pa.array(counts[:, 1].copy())], names=["feature", "content", "boilerplate"])


def train(pages: DataFrame, most: int = TRAIN_PAGES) -> np.ndarray:
    """Log-odds of the feature values, from the named blocks of at most `most` different pages."""
    rows = pages.select(F.xxhash64("html").alias("h"), "html")
    chosen = least(rows.select("h"), "h", most)
    sample = rows.join(F.broadcast(chosen), "h", "left_semi").groupBy("h").agg(F.first("html").alias("html")).select("html")
    sums = sample.mapInArrow(_counted, "feature int, content long, boilerplate long").groupBy("feature").agg(F.sum("content"), F.sum("boilerplate")).collect()
    counts = priors()
    for feature, *two in sums:
        counts[feature] += np.array(two) / 1000
    return log_odds(counts)


def extract_all(pages: DataFrame, most: int = TRAIN_PAGES) -> DataFrame:
    """A row per page: page_id, url, text, n_chars."""
    odds = train(pages, most)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(batch.column(2)[k].as_py(), odds) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long"
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(extracted, kind)
