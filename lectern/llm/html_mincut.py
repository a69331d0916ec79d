"""Main-text extraction by minimum-cut labelling of a page's blocks.

A trained classifier gives each block of text a cost for either label: those are the terminal capacities, to which an
element that says what it is (by its tag, or by a class or id that is a name of boilerplate as a whole) adds one that
outweighs it; a class that only holds such a word among others (``side-effects``) adds little, and the classifier and
the edges decide.  Blocks that follow each other, and blocks under one parent, are joined by smoothness edges.  The
minimum cut separates content from boilerplate.

Defined results: a null or empty page, and a page without content, has an empty text; very long pages are read whole;
repeated rows give equal rows; an empty table gives an empty table; other columns are not read.
"""
from __future__ import annotations

import html as markup
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import first_ids, fit_logistic, one_row_each

#: Bounds on the pages, and on the blocks of a page, that the classifier is fitted to.
MAX_TRAINING_PAGES, MAX_TRAINING_BLOCKS = 1_500, 64
#: Capacities: the most that the classifier adds; of a block's region, by its strength; of edges between neighbours and siblings.
CLASSIFIER_COST, REGION_COST, NEIGHBOUR, SIBLING = 2.0, {0: 0.0, 1: 0.6, 2: 4.0}, 0.3, 0.8

# Elements that never hold text of a page, that split text into blocks, and that name a region.
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "head", "title", "textarea", "select", "button", "option", "datalist", "annotation", "annotation-xml"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
#: Elements that leave an open head open, that are closed by "/>", and that end those where they have no place.
OF_HEAD = {"head", "html", "base", "basefont", "bgsound", "link", "meta", "title", "style", "script", "noscript", "template"}
FOREIGN = {"svg"}
BREAKS_OUT = {"body", "blockquote", "center", "dd", "div", "dl", "dt", "embed", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "img", "li", "menu", "ol", "p", "pre", "table", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: Elements of formulas, whose text is that of the paragraph.
FORMULA = {"math", "semantics", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "merror", "mpadded", "mphantom", "mfenced", "menclose", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mprescripts", "none", "mtable", "mtr", "mtd"}
AWAY_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
MAIN_TAGS = {"article", "main"}
AWAY_WORDS = re.compile(r"ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|gdpr|popup|modal|nav\w*|menu|breadcrumbs?|sidebar|side|footer|header|masthead|comments?|respond|disqus|related|share|social|subscribe|newsletter|login|signup|search|widgets?|pagination|pager|toolbar|skip")
MAIN_WORDS = {"article", "main", "content", "post", "entry", "story", "body"}
#: Words that add nothing to a name.
FRAME_WORDS = {"site", "page", "global", "top", "bottom", "left", "right", "primary", "secondary", "container", "wrapper", "wrap", "box", "area", "list", "section", "block", "bar", "inner", "outer", "row", "col", "column", "item", "items", "links", "link", "buttons", "media", "bottom", "the", "js", "ui"}
AWAY_ROLES = re.compile(r"\brole\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|alert|dialog|menu|form)\b", re.I)
MAIN_ROLES = re.compile(r"\brole\s*=\s*[\"']?(?:main|article)\b", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*+(?:[\"'][^>]*)?)>|<[!?][^>]*>", re.S)
#: The attributes of a tag that ends in "/>"; a slash in an unquoted value belongs to that.
_CLOSED = re.compile(r"(?<!=)/\s*\Z")
_UNQUOTED = re.compile(r"=\s*[^\s\"'>]+/\Z")
_NAMES = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def name_strength(name: str, inside_main: bool = False) -> int:
    """Of a class or id: 2 or -2 if all its words but those of FRAME_WORDS name content or boilerplate, 1 or -1 if some
    do, else 0.  Boilerplate comes first where both are named; a header within the content isn't boilerplate."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w and w not in FRAME_WORDS]
    away = sum(bool(AWAY_WORDS.fullmatch(w)) and not (inside_main and w == "header") for w in words)
    main = sum(w in MAIN_WORDS for w in words)
    strength = 2 if away + main == len(words) else 1
    return -strength if away else strength if main else 0


def region(tag: str, attributes: str, inside_main: bool) -> int:
    """What an element says of its text: 2 or 1 content, -1 or -2 boilerplate, strongly or weakly, else 0."""
    if tag in MAIN_TAGS:
        return 2
    if tag in AWAY_TAGS or tag == "header" and not inside_main:
        return -2
    if attributes:
        if AWAY_ROLES.search(attributes):
            return -2
        said = [name_strength(n, inside_main) for m in _NAMES.finditer(attributes) for n in next(filter(None, m.groups()), "").split()]
        if MAIN_ROLES.search(attributes):
            said.append(2)
        low, high = min(said, default=0), max(said, default=0)
        return low if low == -2 or low < 0 and high < 2 else high
    return 0


def blocks(page: str) -> list[tuple[str, int, int, int, int]]:
    """(text, length of link text, region, parent, kind) of each block in page order; kind 1 marks headings."""
    out: list[tuple[str, int, int, int, int]] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, region, number of the element
    parts: list[str] = []
    silent: list[tuple[str, int]] = []  # open silent elements: tag, height of the stack
    linked = links = serial = 0
    kind = 0
    lower = None

    def flush():
        nonlocal parts, linked, kind
        if parts:
            text = " ".join(markup.unescape("".join(parts)).split())
            if text:
                out.append((text, linked, stack[-1][1], stack[-1][2], kind))
        parts, linked, kind = [], 0, 0

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        upto = m.start() if m else len(page)
        if upto > at and silent and silent[-1][0] == "head" and page[at:upto].strip():
            silent.pop()  # text ends a head
        if upto > at and not silent:
            piece = page[at:upto]
            parts.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if silent and not closing:
            top, height = silent[-1]
            if top == "head" and tag not in OF_HEAD:
                silent.pop()  # its end tag may be left out
            elif top == "option" and tag in ("option", "optgroup", "hr"):
                silent.pop()
            elif top in FOREIGN:
                if _CLOSED.search(m[3]) and not _UNQUOTED.search(m[3]):
                    continue
                if tag in BREAKS_OUT and not any(x[0] in ("foreignobject", "desc", "annotation-xml") for x in stack[height:]):
                    silent.pop()
                    del stack[height:]
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag in INLINE or tag in FORMULA or tag in VOID and tag != "hr":
            continue
        if tag in RAW and not closing:
            lower = lower if lower is not None else page.lower()
            end = lower.find(f"</{tag}", at) if len(lower) == len(page) else next((x.start() for x in re.finditer(f"</{tag}", page[at:], re.I)), -1 - at) + at
            at = len(page) if end < 0 else end
            flush() if tag == "textarea" else None
            continue
        if tag in SILENT:
            if tag in RAW:
                continue
            if closing:
                where = next((i for i in range(len(silent) - 1, -1, -1) if silent[i][0] == tag), -1)
                if where >= 0:
                    del stack[silent[where][1] :], silent[where:]
            elif tag not in FOREIGN or not _CLOSED.search(m[3]) or _UNQUOTED.search(m[3]):
                silent.append((tag, len(stack)))
            continue
        if tag == "body" and not closing:
            silent.clear()  # a head that was never closed
        flush()
        links = 0
        if tag in ("p", "hr", "html", "body"):
            continue
        if closing:
            where = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if where:
                del stack[where:]
                while silent and silent[-1][1] > where:  # an end tag closes what is open within its element
                    silent.pop()
        else:
            serial += 1
            if tag == "li" and stack[-1][0] == "li" or tag in ("dt", "dd") and stack[-1][0] in ("dt", "dd") or tag == "tr" and stack[-1][0] in ("td", "th", "tr") or tag in ("td", "th") and stack[-1][0] in ("td", "th"):
                stack.pop()
            own = region(tag, m[3], stack[-1][1] > 0)
            if abs(own) == 1 and abs(stack[-1][1]) == 2:
                own = 0  # a weak name doesn't leave a region that is strongly named
            # Items and cells share their list's or row's number, so that siblings meet.
            number = stack[-1][2] if tag in ("li", "dt", "dd", "td", "th") or tag[0] == "h" and tag[1:].isdigit() else serial
            stack.append((tag, own or stack[-1][1], number))
            if tag[0] == "h" and tag[1:].isdigit():
                kind = 1
    flush()
    return out


_PUNCTUATION = re.compile(r"[.,;:!?]")


def traits(text: str, linked: int, kind: int) -> list[float]:
    n = len(text)
    return [min(2.0, np.log1p(n) / 4), min(1.0, linked / n), min(1.0, 20 * len(_PUNCTUATION.findall(text)) / n), float(text[-1] in ".!?:;\"'»”"), float(kind), min(2.0, np.log1p(text.count(" ")) / 3)]


WIDTH = 6


def persistent(pull: list[float], edges: list[tuple[int, int, float]]) -> tuple[list[int], list[float], list[list[tuple[int, float]]]]:
    """Labels (1, 0, or -1 if still open) that every minimum cut can have, with what the open ones are left with.

    A node whose own pull is at least the sum of its edges takes its own side; its edges then pull at its neighbours.
    """
    near: list[list[tuple[int, float]]] = [[] for _ in pull]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    pull, label = list(pull), [-1] * len(pull)
    free = [sum(w for _, w in x) for x in near]
    queue = list(range(len(pull)))
    while queue:
        i = queue.pop()
        if label[i] >= 0 or abs(pull[i]) < free[i]:
            continue
        label[i] = int(pull[i] > 0)
        for j, w in near[i]:
            if label[j] < 0:
                pull[j] += w if label[i] else -w
                free[j] -= w
                queue.append(j)
    return label, pull, near


def minimum_cut(pull: list[float], edges: list[tuple[int, int, float]]) -> list[int]:
    """1 for nodes on the content side of a minimum cut; pull > 0 is the capacity from content, < 0 to boilerplate."""
    label, pull, near = persistent(pull, edges)
    rest = [i for i, x in enumerate(label) if x < 0]
    if not rest:
        return label
    place = {i: k for k, i in enumerate(rest)}
    s, t = len(rest), len(rest) + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(len(rest) + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for i in rest:
        if pull[i] > 0:
            edge(s, place[i], pull[i], 0.0)
        elif pull[i] < 0:
            edge(place[i], t, -pull[i], 0.0)
        for j, w in near[i]:
            if label[j] < 0 and i < j:
                edge(place[i], place[j], w, w)
    while True:  # phases of blocking flows on the level graph
        level = [-1] * len(out)
        level[s], queue = 0, [s]
        for a in queue:
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            break
        tried, path, a = [0] * len(out), [], s
        while True:
            if a == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while tried[a] < len(out[a]):
                e = out[a][tried[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                tried[a] += 1
            if tried[a] < len(out[a]):
                path.append(e)
                a = to[e]
            elif a == s:
                break
            else:
                level[a] = -1
                a = to[path.pop() ^ 1]
    for i in rest:
        label[i] = int(level[place[i]] >= 0)
    return label


def main_text(page: str | None, weights: np.ndarray, bias: float) -> str:
    parts = blocks(page or "")
    if not parts:
        return ""
    x = np.array([traits(text, linked, kind) for text, linked, _, _, kind in parts])
    regions = [r for _, _, r, _, _ in parts]
    # What isn't named is open to the classifier.
    pull = np.clip(x @ weights + bias, -CLASSIFIER_COST, CLASSIFIER_COST) + np.array([REGION_COST[abs(r)] * (r > 0) - REGION_COST[abs(r)] * (r < 0) for r in regions])
    edges, last = [], {}
    for i, (_, _, r, parent, _) in enumerate(parts):
        if i:
            edges.append((i - 1, i, NEIGHBOUR))
        if parent in last:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    label = minimum_cut(pull.tolist(), edges)
    return " ".join(text for (text, *_), keep in zip(parts, label) if keep)


def fit(pages: DataFrame, max_pages: int = MAX_TRAINING_PAGES) -> tuple[np.ndarray, float]:
    """Weights of the block classifier.  Blocks in a strongly named region are its labelled rows; the name is no input.
    With no such blocks of both kinds nothing is learned, and all that isn't named as boilerplate is content."""
    known = pages.select(F.col("page_id").alias("__id"), F.coalesce("html", F.lit("")).alias("html"))
    chosen = one_row_each(known, first_ids(known, max_pages))

    def rows(batches):
        for pdf in batches:
            out = []
            for page in pdf["html"]:
                named = [b for b in blocks(page) if abs(b[2]) == 2]
                named = named[:: max(1, -(-len(named) // MAX_TRAINING_BLOCKS))]
                out += [(int(r > 0), zlib.crc32(text.encode("utf-8", "surrogatepass")), traits(text, linked, kind)) for text, linked, r, _, kind in named]
            yield pd.DataFrame(out, columns=["y", "crc", "x"])

    got = chosen.mapInPandas(rows, "y int, crc long, x array<double>").toPandas().sort_values(["crc", "y"], ignore_index=True)
    if got["y"].nunique() < 2:
        return np.zeros(WIDTH), CLASSIFIER_COST
    x = np.stack(got["x"].to_numpy())
    n = len(x)
    w, b = fit_logistic(np.repeat(np.arange(n), WIDTH), np.tile(np.arange(WIDTH), n), x.ravel(), got["y"].to_numpy(float), WIDTH, l2=1e-3)
    return w[:, 0], float(b[0])


def extract(pages: DataFrame, model: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """page_id, url, text of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(pages))

    @F.pandas_udf("string")
    def text_of(sources: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, *shared.value) for x in sources], dtype=object)

    return pages.select("page_id", "url", text_of("html").alias("text"))
