"""Main text of web pages by composite text density.

A page becomes a DOM tree. Every node gets characters, tags, and the characters and tags within
links below it. Its density is characters per tag, adjusted for links by

    C/T * log_b(C*T / (LC*LT)),    b = ln(C*LC/(C-LC) + LCB*C/CB + e)

with 1 for a zero in a denominator; CB and LCB are the body's. A node's density sum is that of its
children. The node with the largest sum is the article's frame; the smallest density on the path
from it to the body is the threshold. Below the frame, each subtree with a density under the
threshold whose characters are mostly links goes, and so do elements that can't be article text by
their name.

A word of a class, id or role (``ad``, ``sidebar``, ``comments``) is a hint that needs a second sign:
a container goes unless it holds the article, or most of the text where that must be; a paragraph, heading or
list item only if most of it is links, unless it says that it is an advert. Words that articles use
as well (``comment``, ``search``) take a container that is mostly links, has a form, stands outside
the article, or is one of several alike.

Nulls, empty pages and pages without text give an empty text. Tags left open, stray end tags,
truncated pages and nesting of any depth are fine: parser and walks are loops, linear in the page.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The HTML standard's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Open elements that a start tag ends, and how far up it looks.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"})}
#: Elements that hold no article text, and words of class, id or role that say so.
NO_TEXT = frozenset("script style noscript template head nav aside footer form button select textarea iframe object embed canvas svg dialog menu title input option".split())
ADVERT = frozenset("ad ads advert adverts advertisement advertising promo promoted sponsor sponsored".split())
NOISE = ADVERT | frozenset(
    "banner breadcrumb breadcrumbs comments consent contentinfo cookie cookies disqus footer masthead menu nav navbar navigation newsletter notice notices popup related replies respond share sharing sidebar signup social subscribe toolbar widget".split()
)
DOUBTFUL = frozenset("alert comment complementary dialog reply search skip".split())
#: Elements that hold text themselves, rather than blocks of it.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption blockquote pre address".split())
CONTROLS = frozenset("form input select textarea button".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
MARKS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
SPACE = re.compile(r"\s+")


class Dom:
    """Nodes as parallel lists in page order; a parent comes before its children. 0 is the root."""

    def __init__(self) -> None:
        self.name, self.up, self.attrs = ["#root"], [-1], [""]
        self.items: list[list[tuple[bool, object]]] = [[]]  #: (is a node, node number or text)

    def add(self, name: str, up: int, attrs: str) -> int:
        self.name.append(name)
        self.up.append(up)
        self.attrs.append(attrs)
        self.items.append([])
        self.items[up].append((True, len(self.name) - 1))
        return len(self.name) - 1


def parse(page: str) -> Dom:
    dom, open_, at, n = Dom(), [0], 0, len(page)
    where: dict[str, list[int]] = {}  # for each name the places of its open elements, so that none is searched for

    def top(names) -> int:
        return max((where[x][-1] for x in names if where.get(x)), default=0)

    def close(names: set[str] | frozenset[str], fence: set[str] | frozenset[str]) -> None:
        """End the innermost open element of ``names``, and all within, unless a fence is nearer."""
        k = top(names)
        if k and k > top(fence):
            for node in open_[k:]:
                where[dom.name[node]].pop()
            del open_[k:]

    def say(text: str) -> None:
        if text:
            dom.items[open_[-1]].append((False, text))

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[1]:
            name = m[1].lower()
            close({name}, {"table", "td", "th", "article", "body"} - {name} if name in INLINE or name == "p" else frozenset())
        elif m[2]:
            name = m[2].lower()
            if name in CLOSES_P:
                close({"p"}, {"table", "td", "th", "article", "section", "div", "body", "li", "blockquote", "aside", "main", "figure"})
            if name in ENDS:
                names, fence = ENDS[name]
                for _ in names:
                    close(names, fence)
            node = dom.add(name, open_[-1], m[3])
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(page, at)
                dom.items[node].append((False, page[at : end.start() if end else n]))
                at = end.end() if end else n
            elif name not in VOID and not m[3].rstrip().endswith("/"):
                where.setdefault(name, []).append(len(open_))
                open_.append(node)
    return dom


def _marks(attrs: str) -> set[str]:
    return {w for m in MARKS.finditer(attrs) for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower())}


def unwanted(dom: Dom) -> list[bool]:
    """Nodes whose text is not the article's, with all below them: by element, or by a hint and its second sign."""
    n = len(dom.name)
    out, in_article = [False] * n, [False] * n
    hints: dict[int, tuple[set[str], set[str]]] = {}
    for i in range(1, n):
        up, name = dom.up[i], dom.name[i]
        in_article[i] = in_article[up] or name in ("article", "main")
        out[i] = out[up] or name in NO_TEXT or (name == "header" and not in_article[up])
        if not out[i] and dom.attrs[i] and name not in ("html", "body", "article", "main"):
            words = _marks(dom.attrs[i])
            if words & (NOISE | DOUBTFUL):
                hints[i] = words & NOISE, words & DOUBTFUL
            out[i] = bool(HIDDEN.search(dom.attrs[i]))
    if not hints:
        return out
    chars, linked, controls, holds = [0] * n, [0] * n, [False] * n, [False] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[dom.up[i]] or dom.name[i] == "a"
    for i in range(n - 1, 0, -1):
        up, name = dom.up[i], dom.name[i]
        if name not in NO_TEXT:
            own = sum(len(SPACE.sub("", t)) for is_node, t in dom.items[i] if not is_node)
            chars[i] += own
            linked[i] += own if in_link[i] else 0
            chars[up] += chars[i]
            linked[up] += linked[i]
        controls[up] = controls[up] or controls[i] or name in CONTROLS
        holds[up] = holds[up] or holds[i] or name in ("article", "main")
    alike: dict[tuple[int, str], int] = {}
    for i, (_, doubtful) in hints.items():
        for w in doubtful:
            alike[dom.up[i], w] = alike.get((dom.up[i], w), 0) + 1
    for i in range(1, n):
        if i in hints and not out[i] and not out[dom.up[i]]:
            sure, doubtful = hints[i]
            links = linked[i] * 2 > chars[i]
            # The text itself, whatever its name is: it holds the article, or most of what there is where the article must be.
            whole = holds[i] or (not sure & ADVERT and (in_article[i] or not holds[0]) and chars[i] * 2 > chars[0])
            if dom.name[i] in TEXTUAL or dom.name[i] in INLINE:
                out[i] = not whole and (links or bool(sure & ADVERT))
            elif sure:
                out[i] = not whole
            else:
                out[i] = not whole and (links or controls[i] or not in_article[i] or any(alike[dom.up[i], w] > 1 for w in doubtful))
        out[i] = out[i] or out[dom.up[i]]
    return out


def densities(dom: Dom, skip: list[bool]) -> tuple[list[float], list[float], list[int], list[int]]:
    """Composite density, density sum, characters and link characters of every node."""
    n = len(dom.name)
    chars, tags, linked, links = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[dom.up[i]] or dom.name[i] == "a"
    for i in range(n - 1, -1, -1):
        if skip[i]:
            continue
        own = sum(len(SPACE.sub("", t)) for is_node, t in dom.items[i] if not is_node)
        chars[i] += own
        linked[i] += own if in_link[i] else 0
        if i:
            up = dom.up[i]
            chars[up] += chars[i]
            linked[up] += linked[i]
            tags[up] += tags[i] + 1
            links[up] += links[i] + (dom.name[i] == "a")
    body = next((i for i in range(n) if dom.name[i] == "body"), 0)
    cb, lcb = max(1, chars[body]), linked[body]
    density = [0.0] * n
    for i in range(n):
        c = chars[i]
        if c:
            t, lc, lt = max(1, tags[i]), max(1, linked[i]), max(1, links[i])
            base = math.log(c * linked[i] / max(1, c - linked[i]) + lcb * c / cb + math.e)
            density[i] = c / t * max(0.0, math.log(c * t / (lc * lt)) / math.log(base)) if base > 1 + 1e-9 else c / t
    sums = [0.0] * n
    for i in range(1, n):
        sums[dom.up[i]] += density[i]
    return density, sums, chars, linked


def frame_of(dom: Dom, density: list[float], sums: list[float], skip: list[bool]) -> tuple[int, float]:
    """The node with the largest density sum, and the threshold of its path to the body.

    Inline nodes and blocks of running text can't be a frame: they are taken with their parent.
    """
    blocks = [i for i in range(len(dom.name)) if not skip[i] and dom.name[i] not in INLINE and dom.name[i] not in ("p", "pre", "ul", "ol", "dl", "table", "blockquote", "html", "#root")]
    best = max(blocks, key=lambda i: (sums[i], -i), default=0)
    up, low = best, density[best]
    while up > 0 and dom.name[up] != "body":
        low = min(low, density[up])
        up = dom.up[up]
    if up > 0:
        low = min(low, density[up])
    outer = 0  # a frame within an article is part of it
    up = dom.up[best]
    while up > 0:
        outer = up if dom.name[up] in ("article", "main") else outer
        up = dom.up[up]
    return outer or best, low


def blocks_of(dom: Dom, frame: int, threshold: float, density: list[float], chars: list[int], linked: list[int], skip: list[bool]) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(line))).strip()
        line.clear()
        if text:
            out.append(text)

    stack: list[tuple[int, int]] = [(frame, 0)]
    while stack:
        node, k = stack.pop()
        if k == len(dom.items[node]):
            if dom.name[node] not in INLINE:
                end()
            continue
        stack.append((node, k + 1))
        is_node, what = dom.items[node][k]
        if not is_node:
            line.append(what)
            continue
        if skip[what]:
            if dom.name[what] not in INLINE:
                end()
            continue
        if dom.name[what] == "br":
            line.append(" ")
            continue
        if dom.name[what] not in INLINE:
            end()
            if density[what] < threshold and chars[what] and linked[what] * 2 > chars[what]:
                continue
        stack.append((what, 0))
    end()
    return out


def extract(page: str | None) -> str:
    """The main text: its blocks in page order, one a line."""
    if not page:
        return ""
    dom = parse(page)
    skip = unwanted(dom)
    density, sums, chars, linked = densities(dom, skip)
    if not chars[0]:
        return ""
    frame, threshold = frame_of(dom, density, sums, skip)
    return "\n".join(blocks_of(dom, frame, threshold, density, chars, linked, skip))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of ``pages``."""

    def run(batches):
        for batch in batches:
            texts = [extract(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
