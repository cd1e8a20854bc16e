"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text at block-level tags; each is a node.

* Terminals. A logistic classifier of a block's own form and its neighbours'
  (link density, length, punctuation, kind of tag, place in the page) gives the
  costs of calling it content or boilerplate.
* Smoothness. Blocks next to one another are joined by an edge that falls with
  their distance in the tree of elements, and so are blocks that follow one
  another under one parent. Where one stands in a part of the page that the
  other does not, or only one has a telling class name, the edge is BORDER of it.
* Seeds. The parts that the page itself marks (main and article; nav, footer
  and the like; what lies outside of the page's main part; class names and ids
  that speak of boilerplate or of content, as whole tokens) are tied to the
  content or the boilerplate side by membership edges, which no block's form
  alone outweighs, but a class name's can be by its neighbours.

The minimum cut, by maximum flow, is the cheapest labelling of the page as a
whole. Blocks whose costs differ by more than all their edges are settled first,
which leaves the minimum as it is.

The classifier is fitted on at most SAMPLE pages of least hash. Its labels are
the marked parts, which are not among its features, so it carries over to pages
that mark nothing; PRIOR holds where the sample says little. Class names do not
reach into a <main> or <article> below, and named blocks are not trained on.

Pages are independent rows: no shuffle, and memory of one page. Defined cases:
null or empty html gives an empty text; broken markup is read as browsers do,
tags close what they must; a page of any length is one row; repeated rows get
equal texts; extra columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import storage
from textloom.llm.sampling import least_hash
from textloom.sources.tables import table

SAMPLE = 300
#: Edges of adjacency and of siblings, and the share of one that crosses a border; bound of the classifier's log odds.
NEXT, SIBLING, BORDER, SURE = 0.5, 0.6, 0.5, 3.0
#: Membership edges: in a marked boilerplate part, in the main part, outside of it, with a bad name, with a good one.
AWAY_EDGE, MAIN_EDGE, OUTSIDE_EDGE, BAD_EDGE, GOOD_EDGE = 8.0, 3.5, 4.5, 6.8, 2.0
_TAG = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title")}
#: Elements whose text is not shown; they stand inside a line, and one that is never closed holds nothing.
MUTE = frozenset("noscript template iframe svg select object".split())
_MUTE_TAG = re.compile(rf"<(/?)({'|'.join(sorted(MUTE))})(?=[\s/>])", re.I)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_FORMULA = "math annotation maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics"
INLINE |= frozenset(_FORMULA.split()) | {"annotation-xml"}
_GAP = frozenset("br img input annotation annotation-xml mspace mtd mtr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AWAY = frozenset("nav footer aside form button menu dialog head fieldset".split())
MAIN = frozenset("article main".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_ENDS_SVG = _CLOSES_P | MAIN | {"body", "li", "dd", "dt"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS_P = MUTE | {"td", "th", "table", "button"}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": set()}
_BAD = re.compile(
    r"(?:ads?|adverts?|advertisement|adsense|adslot|banner|promo\w*|sponsor\w*|sidebar|side-bar|rail|nav|navbar|navigation|menu|footer|masthead|breadcrumbs?|cookies?|"
    r"consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscri\w*|signup|sign-up|share|sharing|social|related|recommend\w*|comments?|replies|reply|respond|disqus|"
    r"widget|toolbar|pagination|pager|login|search|skip|disclaimer|copyright|outbrain|taboola|paywall)",
    re.I,
)
_GOOD = re.compile(r"(?:main-?content|content|post-?(?:body|content|text)|entry-?(?:body|content|text)|article-?(?:body|content|text)|story-?(?:body|text)|article|post|entry|story)", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    away: bool
    main: bool
    linked: int
    parent: int
    named: bool = False
    good: bool = False
    #: Elements between this block and the one before it: 2 for neighbours under one parent.
    far: int = 2


def _drawn(m: re.Match) -> bool:
    """<svg/>."""
    return m[2].lower() == "svg" and m[3].rstrip().endswith("/")


def _never_closed(page: str) -> set[int]:
    """Places of the MUTE tags that no end tag closes; an end tag closes the last one open of its name."""
    open_: dict[str, list[int]] = {}
    at, find = 0, _TAG.search
    if not _MUTE_TAG.search(page):
        return set()
    while m := find(page, at):
        at, tag = m.end(), (m[2] or "").lower()
        if tag in MUTE:
            if not m[1] and not _drawn(m):
                open_.setdefault(tag, []).append(m.start())
            elif m[1] and open_.get(tag):
                open_[tag].pop()
        elif tag in _RAW and not m[1]:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
    return {x for places in open_.values() for x in places}


def blocks(page: str | None) -> list[Block]:
    """Blocks with text, in page order; white space inside one is one space."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int, bool, bool]] = [("", False, False, 0, False, False)]  # tag, away, main, number, named, good
    parts: list[str] = []
    number = linked = link = at = low = last = 0
    page = page or ""
    void = _never_closed(page)
    #: Of each MUTE element that stands open: its place in the stack, and the text and links that it interrupts.
    muted: list[tuple[int, list[str], int, int]] = []

    def flush() -> None:
        nonlocal parts, linked, low, last
        if parts and not muted:
            text = " ".join("".join(parts).split())
            if text:
                tag, away, main, _, named, good = stack[-1]
                low = min(low, len(stack))
                out.append(Block(text, tag, away, main, linked, stack[-2][3] if len(stack) > 1 else 0, named, good, last + len(stack) - 2 * low))
                low = last = len(stack)
        parts, linked = [], 0

    def add(s: str) -> None:
        nonlocal linked
        s = _html.unescape(s) if "&" in s else s
        parts.append(s)
        if link:
            linked += len(s.strip())

    def close(k: int) -> None:
        nonlocal parts, linked, link, low
        while muted and muted[-1][0] >= k:
            j, parts, linked, link = muted.pop()
            del stack[j:]
        if len(stack) > k:
            flush()
            del stack[k:]
        low = min(low, len(stack))

    pos, find = 0, _TAG.search
    while m := find(page, pos):
        if m.start() > at:
            add(page[at : m.start()])
        pos = at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                link = max(0, link - 1)
            elif tag not in INLINE:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
                if k or tag not in MUTE:
                    close(k) if k else flush()
            continue
        if tag in _RAW:
            end = _RAW[tag].search(page, pos)
            pos = at = end.end() if end else len(page)
            continue
        if tag in MUTE:
            if m.start() not in void and not _drawn(m):
                number += 1
                muted.append((len(stack), parts, linked, link))
                stack.append((tag, True, stack[-1][2], number, stack[-1][4], stack[-1][5]))
                parts, linked, link = [], 0, 0
            continue
        if muted and stack[muted[-1][0]][0] == "svg":  # as browsers do, a block of the page ends a drawing
            if tag in _ENDS_SVG and not any(x[0] == "foreignobject" for x in stack[muted[-1][0] :]):
                close(muted[-1][0])
            elif m[3] and m[3].rstrip().endswith("/"):
                continue
        if tag in INLINE:
            if tag == "a":
                link += 1
            elif tag in _GAP:
                parts.append(" ")
            elif tag == "wbr":
                pass
            elif m[3] and _hidden(m[3]) and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
                pos = at = end.end() if end else pos
            continue
        flush()
        link = 0
        if tag in VOID:
            continue
        if tag in _CLOSES_P:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == "p"), 0)
            if k and not any(stack[i][0] in _HOLDS_P for i in range(k, len(stack))):
                close(k)
        if tag in _CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in _SCOPE[tag] or stack[k][0] in MUTE:
                    break
                if stack[k][0] in _CLOSES[tag]:
                    close(k)
                    break
        _, away, main, _, named, good = stack[-1]
        named = named and tag not in MAIN
        main = main or tag in MAIN
        away = away or tag in AWAY or (tag == "header" and not main)
        if m[3]:
            names = {x[1].lower(): (x[2] or "").strip("\"'") for x in _NAMED.finditer(m[3])}
            label = f"{names.get('class', '')} {names.get('id', '')}".split()
            role = names.get("role", "").lower()
            if role in ("main", "article"):
                main, named = True, False
            elif tag not in ("html", "body", "article", "main"):
                named = named or any(_BAD.fullmatch(x) or (not main and x.lower() == "header") for x in label)
                good = good or any(_GOOD.fullmatch(x) for x in label)
                away = away or role in _ROLES
            away = away or _hidden(m[3])
        if tag == "body":  # what stands open from the head is closed
            close(1)
        number += 1
        stack.append((tag, away, main, number, named, good))
        if tag in ("html", "body", "head"):
            stack[-1] = (tag, tag == "head", False, number, False, False)
    if at < len(page):
        add(page[at:])
    close(1)
    flush()
    return out


def _hidden(attributes: str) -> bool:
    if "hidden" not in attributes.lower() and "none" not in attributes.lower():
        return False
    names = {x[1].lower(): (x[2] or "").strip("\"'").lower() for x in _NAMED.finditer(attributes)}
    return "hidden" in names or names.get("aria-hidden") == "true" or "display:none" in names.get("style", "").replace(" ", "")


_HEADS = frozenset(f"h{k}" for k in range(1, 7))
_END = frozenset(".!?:…\"'”’»)")
_COMMAS = re.compile(r"[,;]")
#: bias, link density, length, sentence end, commas, heading, list item, paragraph, letters after a sign, place in the
#: page, squared, and of the blocks before and after: link density, length, paragraph.
PRIOR = np.array([-1.5, -4.0, 1.2, 1.2, 0.4, 0.5, -0.5, 0.8, -1.0, 0.0, 0.0, -0.8, 0.4, 0.3])


def features(page: list[Block]) -> np.ndarray:
    """A row a block: its form and that of the blocks on both sides; nothing of the parts and names that make labels."""
    n = len(page)
    if not n:
        return np.zeros((0, len(PRIOR)))
    size = np.array([len(b.text) for b in page], float)
    link = np.minimum(1.0, np.array([b.linked for b in page]) / size)
    long = np.minimum(2.0, np.log1p(size) / 4)
    is_p = np.array([b.tag == "p" for b in page], float)
    ends = np.array([b.text[-1] in _END for b in page], float)
    commas = np.minimum(2.0, np.array([len(_COMMAS.findall(b.text)) for b in page]) / (size / 60 + 1))
    sign = np.array([not b.text[0].isalnum() for b in page], float)
    place = (np.arange(n) + 0.5) / n
    around = lambda v: (np.concatenate([v[:1] * 0, v[:-1]]) + np.concatenate([v[1:], v[:1] * 0])) / 2
    kind = lambda tags: np.array([b.tag in tags for b in page], float)
    return np.stack([np.ones(n), link, long, ends, commas, kind(_HEADS), kind({"li"}), is_p, sign, place, place * place, around(link), around(long), around(is_p)], 1)


def fit(pages: list[str | None], rounds: int = 300, rate: float = 0.5, hold: float = 0.01) -> np.ndarray:
    """Logistic weights by gradient descent; labels: in the page's main part and not in one that it marks otherwise. hold draws to PRIOR."""
    x, y = [], []
    for p in map(blocks, pages):
        if any(b.main for b in p):
            x.append(features(p)[[not b.named for b in p]])
            y += [float(b.main and not b.away) for b in p if not b.named]
    if not x or len(set(y)) < 2:
        return PRIOR.copy()
    x, y, w = np.concatenate(x), np.array(y), PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * (x.T @ (p - y) / len(y) + hold * (w - PRIOR))
    return w


def odds(page: list[Block], w: np.ndarray) -> np.ndarray:
    """The classifier's log odds of content, within SURE."""
    return np.clip(features(page) @ w, -SURE, SURE)


def seeds(page: list[Block]) -> tuple[list[float], list[float]]:
    """Membership edges of each block to the content and to the boilerplate side."""
    has = any(b.main and not b.away for b in page)
    content = [MAIN_EDGE * b.main + GOOD_EDGE * (b.good and not has) for b in page]
    return content, [AWAY_EDGE * b.away + OUTSIDE_EDGE * (has and not b.main) + BAD_EDGE * b.named for b in page]


def smoothness(page: list[Block]) -> list[tuple[int, int, float]]:
    """Edges (i, j, capacity) of neighbours in the page and under a parent."""
    part = [(b.main, b.away, b.named) for b in page]
    cross = lambda i, j: 1.0 if part[i] == part[j] else BORDER
    edges, last = [], {}
    for j, b in enumerate(page):
        if j:
            edges.append((j - 1, j, NEXT * cross(j - 1, j) * (2 / max(2, b.far)) ** 2))
        if b.parent in last and last[b.parent] < j - 1:
            edges.append((last[b.parent], j, SIBLING * cross(last[b.parent], j)))
        last[b.parent] = j
    return edges


def max_flow(n: int, source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Dinic: True for the nodes on the source's side of a minimum cut. source and sink: terminal capacities; edges go both ways."""
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, cap = [], []

    def arc(u: int, v: int, c: float, back: float) -> None:
        head[u].append(len(to))
        to.append(v)
        cap.append(c)
        head[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i in range(n):
        both = min(source[i], sink[i])  # passes straight through
        if source[i] > both:
            arc(s, i, source[i] - both, 0.0)
        if sink[i] > both:
            arc(i, t, sink[i] - both, 0.0)
    for u, v, c in edges:
        arc(u, v, c, c)
    tiny = 1e-12
    while True:
        level, queue = [-1] * (n + 2), deque([s])
        level[s] = 0
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn, path, u = [0] * (n + 2), [], s
        while True:
            if u == t:
                f = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= f
                    cap[e ^ 1] += f
                k = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                u = to[path[k] ^ 1]
                del path[k:]
            elif turn[u] < len(head[u]):
                e = head[u][turn[u]]
                if cap[e] > tiny and level[to[e]] == level[u] + 1:
                    path.append(e)
                    u = to[e]
                else:
                    turn[u] += 1
            elif u == s:
                break
            else:
                level[u] = -1
                u = to[path.pop() ^ 1]


def label(page: list[Block], w: np.ndarray, settle: bool = True) -> list[bool]:
    """Content or not, for each block, at least total cost."""
    n = len(page)
    if not n:
        return []
    z, (content, boilerplate) = odds(page, w), seeds(page)
    keep = [a + b for a, b in zip(np.logaddexp(0, z).tolist(), content)]  # cost of calling it boilerplate
    drop = [a + b for a, b in zip(np.logaddexp(0, -z).tolist(), boilerplate)]  # content
    edges, weight = smoothness(page), [0.0] * n
    for u, v, c in edges:
        weight[u] += c
        weight[v] += c
    fixed: list[bool | None] = [None] * n
    if settle:
        fixed = [(keep[i] > drop[i]) if abs(keep[i] - drop[i]) > weight[i] else None for i in range(n)]
    free = [i for i in range(n) if fixed[i] is None]
    if free:
        place, inner = {i: k for k, i in enumerate(free)}, []
        for u, v, c in edges:
            if u in place and v in place:
                inner.append((place[u], place[v], c))
            for a, b in ((u, v), (v, u)):
                if a in place and b not in place:
                    if fixed[b]:
                        keep[a] += c
                    else:
                        drop[a] += c
        for i, side in zip(free, max_flow(len(free), [keep[i] for i in free], [drop[i] for i in free], inner)):
            fixed[i] = side
    return [bool(x) for x in fixed]


def main_text(page: str | None, w: np.ndarray = PRIOR) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, ok in zip(found, label(found, w)) if ok)


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(page_id, url, html) to (page_id, url, text, n_chars)."""
    storage.bounded_arrow_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    few = least_hash(pages, F.xxhash64("page_id", "url"), sample).filter("html is not null").select("html")
    w = fit([r["html"] for r in few.collect()])

    def run(batches):
        for b in batches:
            text = [main_text(x, w) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
