"""Main text of HTML pages by minimum-cut labelling of text blocks.

A page is cut into text blocks (what block-level elements hold).  A logistic classifier
gives each block the log-odds of being content; its positive or negative part becomes the
capacity to the content or boilerplate terminal.  Neighbouring blocks, and blocks next to
each other under the same parent element, are joined by smoothness edges.  The maximum
flow's cut is the labelling of least cost: a doubtful block goes with its surroundings.

The classifier is trained on a bounded sample of pages (``sample``, a documented
parameter) from their own markup: blocks inside article or main elements against blocks
inside navigation, footers, asides, forms or elements named as such; its inputs are the
text's shape and tag only.  What the markup says outright is added as evidence afterwards.
Evidence against a block (a boilerplate name or element) outweighs classifier and edges.
Evidence for it (an article around it) does not: inside an article the cut decides about
blocks of links and blocks whose names are doubtful, outside of one about every block.

Defined cases: null or empty html, and pages without content, give the empty text (0
characters); unclosed tags, comments, scripts and svg drawings end where a browser ends them (svg alone
may close itself by '/>'); formulas keep their text, but for annotations; br is white space; table cells of a row are one block; character references decode as in HTML5;
text of hidden elements is left out, inline ones to their own end tag or the end of
their block; very long pages are read whole, in time linear in their length; repeated rows give equal rows.  An empty
table gives an empty result.  Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample
from .logistic import Logistic

SAMPLE = 400
# fixed values: element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object canvas audio video title textarea select".split())
# start tags that end an open svg, and elements inside it that hold html again
BREAKOUT = frozenset("""b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre
ruby s small span strong strike sub sup table tt u ul var""".split())
HTML_AGAIN = frozenset("foreignobject desc title".split())
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary
table tbody tfoot thead tr ul""".split())
CELL = frozenset("td th".split())
ENDS_P = BLOCK - frozenset("button option".split())
CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr", {"table"}), "td": ("td th", {"tr", "table"}),
          "th": ("td th", {"tr", "table"}), "option": ("option", {"select"}), "tbody": ("tbody thead tfoot tr", {"table"})}
OUTSIDE = frozenset("nav aside footer form button dialog menu".split())
BAD_NAMES = frozenset("""nav navbar navigation menu menubar breadcrumb breadcrumbs masthead topbar footer sidebar rail aside widget widgets ad ads adv
advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice
notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup signin login search searchbox share sharing social follow
related recommended recommendations trending pagination pager reviews comment comments commentlist commentary disqus respond replies reply toolbar skip
copyright disclaimer complementary contentinfo hidden""".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus reviews".split())
# their ids are anchors, often made of a heading's text; other elements hold a page's layout
ANCHORED = frozenset("section article main h1 h2 h3 h4 h5 h6 p li dt dd td th tr pre blockquote caption figcaption summary address a".split())
TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
TOP_NAMES = frozenset("header banner head top".split())  # boilerplate only outside the article
GOOD_NAMES = frozenset("article post entry story content main text body articlebody maincontent".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?][^>]*>?)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*>?", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?<![\w-])(hidden)(?![\w-])", re.S)
FORMULA_END = re.compile(r"</(annotation-xml|annotation|math)(?=[\s/>])[^>]*>", re.I)
HIDING = re.compile("hidden|none", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'", re.S)
UNQUOTED_END = re.compile(r"=\s*[^\s\"'>][^\s>]*\Z")
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
KINDS = ("h", "p", "li", "div", "tr")


class Element:
    __slots__ = ("tag", "main", "bad", "firm", "doubt", "good", "number", "silent")

    def __init__(self, tag: str, above: Element | None, names: set[str], ids: set[str], hidden: bool, number: int, silent: bool = False):
        """names: the words of class and role; ids: those of the id; silent: a hidden inline element, whose text is not shown."""
        self.tag, self.number, self.silent = tag, number, silent
        inside = above.main if above else False
        self.main = inside or tag in ("article", "main") or "rolemain" in names
        every = names | ids
        whole = bool(every) and every <= BAD_NAMES
        anchor = tag in ANCHORED
        if self.main:  # a class names a container's part in the layout; elsewhere all words must agree
            named = bool(names & BAD_NAMES) and (whole or not anchor) or whole and (not anchor or tag == "section" and bool(ids & COMMENT_NAMES))
        else:
            sure = ids if not anchor or tag not in TEXT_TAGS and (whole or ids & COMMENT_NAMES) else set()
            named = bool((names | sure) & BAD_NAMES) or tag == "header" or bool((names if tag in TEXT_TAGS else every) & TOP_NAMES)
        # firm: no article inside can undo it; bad: an article may, if the page has no other; doubt: the classifier and the cut decide
        self.firm = (above.firm if above else False) or hidden or tag in ("nav", "aside", "footer", "button", "dialog") or named and bool(every & COMMENT_NAMES)
        self.bad = (above.bad if above else False) or self.firm or tag in OUTSIDE or named
        self.doubt = (above.doubt if above and inside == self.main else False) or not named and tag not in ("article", "main") and bool(every & BAD_NAMES)
        self.good = (above.good if above else False) or bool(every & GOOD_NAMES)


class Block:
    __slots__ = ("text", "kind", "parent", "element", "linked")

    def __init__(self, text: str, element: Element, parent: int, linked: int):
        self.text, self.element, self.parent, self.linked = text, element, parent, linked
        self.kind = "h" if re.fullmatch("h[1-6]", element.tag) else element.tag if element.tag in KINDS else "div"


def _names(attributes: str) -> tuple[set[str], set[str], bool]:
    """(words of class and role, words of the id, hidden)."""
    names, ids, hidden = set(), set(), False
    for key, a, b, c, bare in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if bare or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
        if key in ("class", "id", "role"):
            (ids if key == "id" else names).update(WORD.findall(CAMEL.sub(" ", value).lower()))
            if key == "role" and value.lower() == "main":
                names.add("rolemain")
    return names, ids, hidden


def _self_closed(tag: str) -> bool:
    """Does a start tag end in '/>'?  A slash at the end of an unquoted value belongs to the value."""
    inner = QUOTED.sub('""', tag.removesuffix(">"))
    return inner.endswith("/") and not UNQUOTED_END.search(inner)


def _after_svg(page: str, at: int, above: set[str]) -> int:
    """Where a browser ends the svg opened before ``at``: after its end tag, or before a tag that cannot be inside it."""
    depth, inner = 1, 0
    while (m := TAG.search(page, at)) is not None:
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if page.startswith("<![CDATA[", m.start()):
            end = page.find("]]>", m.start())
            at = end + 3 if end >= 0 else len(page)
        elif m[1] or m[4]:
            if tag == "svg":
                depth -= 1
                if not depth:
                    return at
            elif tag in HTML_AGAIN:
                inner = max(inner - 1, 0)
            elif not inner and (tag in ("p", "br") or tag in above):
                return m.start()
        elif tag in BREAKOUT and not inner:
            return m.start()
        elif tag in HTML_AGAIN and not _self_closed(m[0]):
            inner += 1
        elif tag == "svg" and not _self_closed(m[0]):
            depth += 1
    return len(page)


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    root = Element("html", None, set(), set(), False, 0)
    stack, found, held = [root], [], []  # held: (text, inside a link)
    count = silent = links = 0  # silent, links: such elements on the stack

    def flush() -> None:
        if held:
            text = " ".join("".join(t for t, _ in held).split())
            if text:
                owner = next(e for e in reversed(stack) if e.tag in BLOCK or e is root)
                above = stack[stack.index(owner) - 1] if owner is not root else root
                found.append(Block(text, owner, above.number, sum(len(t.strip()) for t, a in held if a)))
            held.clear()

    def close(at: int) -> None:
        nonlocal silent, links
        gone = stack[at:]
        if any(e.tag in BLOCK for e in gone):
            flush()
        silent -= sum(e.silent for e in gone)
        links -= sum(e.tag == "a" for e in gone)
        del stack[at:]

    def open_at(tags: set[str], stop: set[str]) -> int | None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                return k
            if stack[k].tag in stop:
                return None
        return None

    def text(a: int, b: int) -> None:
        if a < b and not silent:
            held.append((html_lib.unescape(page[a:b]), links > 0))

    at, seen, formula_end = 0, -1, None
    while (m := TAG.search(page, at)) is not None:
        text(at, m.start())
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            k = open_at({tag}, set() if tag in BLOCK else BLOCK - {"p"})
            if k is not None:
                close(k)
            elif tag in BLOCK:
                flush()
            continue
        if tag == "br":
            held.append((" ", False))
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "svg":
            if not _self_closed(m[0]):
                at = _after_svg(page, at, {e.tag for e in stack[1:]})
            continue
        if tag in ("annotation", "annotation-xml") and not _self_closed(m[0]):  # a formula's source, which is not shown
            if seen < at:
                formula_end = FORMULA_END.search(page, at)
                seen = formula_end.start() if formula_end else len(page)
            if formula_end and formula_end[1].lower() == tag:
                at = formula_end.end()
            continue
        if tag in ("mtr", "mtd"):
            held.append((" ", False))
        if tag in ENDS_P and (k := open_at({"p"}, {"button", "td", "th"})) is not None:
            close(k)
        if tag in CLOSES and (k := open_at(set(CLOSES[tag][0].split()), CLOSES[tag][1])) is not None:
            close(k)
        if tag == "a" and (k := open_at({"a"}, BLOCK)) is not None:
            close(k)
        if tag in CELL:
            held.append((" ", False))
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        if tag in BLOCK or tag in CELL or tag == "a":
            count += 1
            names, ids, hidden = _names(m[3] or "")
            if tag == "body":
                names, ids = set(), set()
            stack.append(Element(tag, stack[-1], names, ids, hidden, count))
            links += tag == "a"
        elif silent and any(e.silent and e.tag == tag for e in stack) or m[3] and HIDING.search(m[3]) and _names(m[3])[2]:
            count += 1  # on the stack until its own end tag, or the end of its block
            stack.append(Element(tag, stack[-1], set(), set(), False, count, silent=True))
            silent += 1
    text(at, len(page))
    flush()
    return found


def shape(found: list[Block]) -> np.ndarray:
    """The classifier's inputs: the text's shape, its tag and its place."""
    rows = []
    for i, b in enumerate(found):
        words = b.text.split()
        n = len(b.text)
        rows.append([np.log1p(len(words)), min(b.linked / n, 1.0), sum(c in ".,;:!?" for c in b.text) / len(words), float(b.text[-1] in ".!?…\"'"),
                     sum(c.isdigit() for c in b.text) / n, i / len(found), n / len(words), *(float(b.kind == k) for k in KINDS)])
    return np.array(rows, float).reshape(len(found), 7 + len(KINDS))


def weak_labels(found: list[Block]) -> np.ndarray:
    """1 content, 0 boilerplate, -1 the markup does not say."""
    return np.array([0 if b.element.bad else 1 if b.element.main and not b.element.doubt else -1 for b in found], int)


def log_odds(found: list[Block], model: Logistic | None) -> np.ndarray:
    x = shape(found)
    own = np.clip(model.logit(x), -3, 3) if model is not None else np.clip(0.8 * x[:, 0] - 4 * x[:, 1] + x[:, 3] - 1.5, -3, 3)
    links = (x[:, 1] > 0.8) & np.array([b.kind != "h" for b in found])  # an article may hold one line of links; several make a part of their own
    undone = not any(b.element.main and not b.element.bad for b in found)  # the only article sits in a badly named wrapper
    bad = np.array([b.element.firm or b.element.bad and not (undone and b.element.main) for b in found])
    main = np.array([b.element.main for b in found])
    good = np.array([b.element.good for b in found])
    doubt = np.where([b.element.doubt for b in found], np.where(main, 2.5, 2.0), 0.0)  # less than what speaks for a block's surroundings
    any_main = bool((main & ~bad).any())
    return own + np.where(bad, -12.0, np.where(main, np.where(links, -2.0 + np.clip(own, -0.5, 0.5) - own, 4.5), np.where(good, 1.5, 0.0) + (-3.0 if any_main else 1.0)) - doubt)


def minimum_cut(odds: np.ndarray, parents: list[int], near: float = 0.6, same: float = 0.8) -> np.ndarray:
    """True for blocks on the content side of the minimum cut (Dinic's maximum flow)."""
    n = len(odds)
    source, sink = n, n + 1
    to, room, out = [], [], [[] for _ in range(n + 2)]

    def edge(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to)), to.append(b), room.append(there)
        out[b].append(len(to)), to.append(a), room.append(back)

    for i, v in enumerate(odds.tolist()):
        if v > 0:
            edge(source, i, v, 0.0)
        elif v < 0:
            edge(i, sink, -v, 0.0)
    last: dict[int, int] = {}
    for i, p in enumerate(parents):
        if i:
            edge(i - 1, i, near, near)
        if p in last:
            edge(last[p], i, same, same)
        last[p] = i
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return np.array([level[i] >= 0 for i in range(n)], bool)
        turn, path, a = [0] * (n + 2), [], source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            step = None
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    step = e
                    break
                turn[a] += 1
            if step is not None:
                path.append(step)
                a = to[step]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1
            else:
                break


def main_text(page: str | None, model: Logistic | None = None) -> tuple[str, int, int]:
    """(text, blocks, content blocks) of one page."""
    found = blocks(page or "")
    if not found:
        return "", 0, 0
    keep = minimum_cut(log_odds(found, model), [b.parent for b in found])
    return "\n".join(b.text for b, k in zip(found, keep.tolist(), strict=True) if k), len(found), int(keep.sum())


def train(pages: list[str]) -> Logistic | None:
    """The block classifier from a sample's own markup; None if it shows one kind of block only."""
    x, y = [], []
    for page in pages:
        found = blocks(page)
        label = weak_labels(found)
        x.append(shape(found)[label >= 0])
        y.append(label[label >= 0])
    y = np.concatenate(y) if y else np.empty(0)
    if not 0 < y.sum() < len(y):
        return None
    return Logistic(5.0).fit(np.vstack(x), y.astype(float))


def _extracted(model: Logistic | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h, model) for h in batch.column("html").to_pylist()]
            text, n, k = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()),
                 pa.array(n, pa.int32()), pa.array(k, pa.int32())], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_content"])
    return run


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_content) of every page, whole html."""
    light = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    picked = hashed_sample(light.filter("html IS NOT NULL"), sample, light.count(), "page_id").select("html").collect()
    model = train(sorted(r["html"] for r in picked))
    kind = light.schema["page_id"].dataType.simpleString()
    return light.mapInArrow(_extracted(model), f"page_id {kind}, url string, text string, n_chars long, n_blocks int, n_content int")
