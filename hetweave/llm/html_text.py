"""Main text of web pages by a tree-structured graphical model.

The nodes of a page's tree are its block elements; each is content or not. What a node shows
(tag, names, own text, links, punctuation, its share of the page, where it stands, the heading
over it) speaks for either label through weights, and a child's label depends on its parent's
through a potential for each pair of kinds of element. On a tree the sum-product algorithm is
exact: messages go up from the leaves, then down from the root, and their product is each node's
marginal. Text of nodes with a marginal of 0.5 or more is kept.

The weights are fitted as a logistic regression on the labels of single nodes, the potentials are
counted as what a parent's label adds to a child's. Pages with known labels are not at hand in
the tables, so labelled_pages() makes them: layouts with semantic tags, with telling names, and
with names that say nothing or mislead, where a mark in the text itself, taken out after parsing,
says what is content. No name or word decides a label. Own pages can be given instead.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hetweave.llm.common import add_column, free_name, small_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_INSIDE = re.compile(r"((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HEADING = re.compile(r"h[1-6]")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is text, not markup; none of it is ever content.
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes svg math".split())
NEVER = RAW | frozenset("head button select option datalist object canvas audio video map label legend".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption search".split()
) | NEVER
#: A start tag of the first kind closes an open one of the others, up to a holder of its kind.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
_CLOSES_P = BLOCK - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "label", "button", "legend"} - RAW

_FAMILY = {t: "nav" for t in ("nav", "menu", "dir", "search")} | {t: t for t in ("header", "footer", "aside", "form", "article", "main", "body", "html", "section", "div", "p")}
_FAMILY |= {t: "heading" for t in ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup")} | {t: "list" for t in ("ul", "ol", "dl", "li", "dt", "dd")}
_FAMILY |= {t: "table" for t in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption")} | {t: "quote" for t in ("blockquote", "pre", "figure", "figcaption", "details", "summary", "address")}
_FAMILY |= {t: "form" for t in ("fieldset",)} | {"dialog": "aside"}
#: Words of class, id and role that tell something, by what they tell: fixed values.
_TELLING = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip",
    "frame": "header masthead footer foot topbar bottom colophon copyright sidebar side aside widget rail banner contentinfo complementary",
    "advert": "ad ads adsbygoogle adv advert advertisement adverts promo promotion sponsor sponsored sponsors dfp adsense teaser",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login paywall disclaimer toast",
    "social": "share sharing social related recommended recommendations more tags tag author byline meta trending popular",
    "comment": "comment comments reply replies respond discussion disqus thread",
    "content": "content article post entry story main text body page prose copy",
}
_TELLS = {w: kind for kind, words in _TELLING.items() for w in words.split()}
_ORDER = ("advert", "comment", "notice", "menu", "social", "frame", "content")
#: A name with one of these tells a state of the page, not what the element is: fixed values.
_STATES = frozenset("enabled disabled open closed has no not with without count is".split())
#: Elements that may stand in a head; any other start tag ends it.
_IN_HEAD = frozenset("head title base link meta style script noscript template".split())
#: Words of short headings and of short texts that tell something: fixed values.
_HEADED = {
    "comment": "comment comments reply replies response responses discussion reader readers say",
    "social": "related more also recommended popular trending latest share follow tags author about similar",
    "notice": "newsletter subscribe subscription cookie cookies sign login alerts",
    "menu": "menu navigation sections categories archive archives links contents topics",
    "advert": "advertisement sponsored promoted partner partners",
}
_HEADS = {w: kind for kind, words in _HEADED.items() for w in words.split()}
_SAYS = re.compile(r"\b(?:cookies?|subscribe|newsletter|sign up|log ?in|consent|privacy policy|terms of (?:use|service)|advertisement|sponsored)\b", re.I)
_LEGAL = re.compile(r"\u00a9|\(c\)|\bcopyright\b|\ball rights reserved\b", re.I)
_STOPS = re.compile(r"[.!?;:,\u2026\u3002\u3001\uff01\uff1f\u061f\u060c\u0964](?=\s|$|[\"'\u201d\u00bb)])|[\u3002\u3001\uff01\uff1f]")


@dataclass
class Node:
    tag: str
    parent: int
    tells: tuple[str, ...] = ()
    hidden: bool = False
    #: Pieces of text by place: (line, piece of the line, whether a space stands before it).
    runs: list[tuple[tuple[int, int, bool], str]] = field(default_factory=list)
    size: int = 0
    linked: int = 0
    label: int | None = None
    #: A header of an article, not of the page.
    own: bool = False
    inline: bool = False
    #: A button or an input field stands right in it.
    asks: bool = False

    @property
    def family(self) -> str:
        family = _FAMILY.get(self.tag, "other")
        return f"own {family}" if self.own else family


def _names(inside: str) -> tuple[tuple[str, ...], bool]:
    """What an element's names tell, and whether its attributes hide it."""
    tells: tuple[str, ...] = ()
    hidden = False
    if "=" in inside:
        marks = set()
        for name, *values in _ATTRIBUTE.findall(inside):
            name, value = name.lower(), next((v for v in values if v), "")
            if name in ("class", "id", "role", "itemprop", "aria-label"):
                for one in value.split():
                    parts = _WORD.findall(_HUMP.sub(" ", one).lower())
                    if not _STATES.intersection(parts):
                        marks |= {_TELLS[w] for w in parts if w in _TELLS}
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
                hidden = True
        tells = tuple(k for k in _ORDER if k in marks)
    if "hidden" in inside.lower() and re.search(r"(?:^|[\s\"'])hidden(?=[\s=/]|$)", _QUOTED.sub("''", inside), re.I):
        hidden = True
    return tells, hidden


def parse(page: str) -> list[Node]:
    """The block elements of a page, parents before children, with their runs of text in page order.

    Inline elements belong to the block around them; a line break is white space. Those whose names
    tell of an advert are nodes of their own, so they can be left out of a line that stays. A block
    that stands between two pieces of its parent's text makes them two lines. Unclosed and stray tags
    are taken as browsers do for the common cases: paragraphs, list items, cells, ends. Where the
    open elements of each tag stand is kept, so no tag walks over the others and broken nesting of
    any depth is read in one pass.
    """
    nodes, stack, links, at, line, piece, space = [Node("html", -1)], [0], 0, 0, 0, 0, False
    buffer: list[str] = []
    solid = [0]  # where on the stack blocks stand
    nested: list[int] = []  # for each open inline node, the open elements of its tag inside it
    places: dict[str, list[int]] = {"html": [0]}  # where on the stack each tag stands, from the root on

    def last(tags: Iterable[str]) -> int:
        """Where the innermost open element of these tags stands; 0 if none but the root does."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def flush(inline: bool = False) -> None:
        nonlocal line, piece, space
        raw = _SPACE.sub(" ", html.unescape("".join(buffer))) if buffer else ""
        buffer.clear()
        if text := raw.strip():
            nodes[stack[-1]].runs.append(((line, piece, space or raw[0] == " "), text))
            nodes[stack[-1]].size += len(text)
            piece += 1
            space = False
        space = space or raw[-1:] == " "
        if not inline and piece:
            line, piece = line + 1, 0
        space = space and inline

    def close(k: int) -> None:
        nonlocal links
        inline = k > solid[-1]
        flush(inline)
        for s in stack[k:]:
            places[nodes[s].tag].pop()
            if nodes[s].inline:
                nested.pop()
        del stack[k:]
        while solid[-1] >= len(stack):
            solid.pop()
        if not inline:
            links = 0

    n, quotes = len(page), True
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at : m.start()])
            if links:
                nodes[stack[-1]].linked += m.start() - at
        at, inside = m.end(), ""
        tag = (m[2] or "").lower()
        if tag:
            # quoted values may hold a >; once a quote stays open to the end of the page, none do
            found = _INSIDE.match(page, at) if quotes else None
            quotes = quotes and found is not None
            end = found.end() if found else page.find(">", at) + 1 or n
            inside, at = page[at : end - 1], end
        if not tag:
            if m[0].startswith("<![CDATA["):
                buffer.append(html.escape(m[0][9:-3]))
            continue
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK and tag not in ("html", "body"):
                if k := last((tag,)):
                    close(k)
                else:
                    flush()
            elif tag == "br":
                buffer.append(" ")
            if tag not in BLOCK and (k := last((tag,))) > solid[-1]:
                if k == len(stack) - 1 and nested[-1]:
                    nested[-1] -= 1
                else:
                    close(k)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            if not inside.endswith("/") or tag not in ("svg", "math"):
                at = end.end() if end else n
            continue
        if tag == "a":
            links = 1
        if tag in ("br", "wbr", "img", "input"):
            nodes[stack[-1]].asks |= tag == "input"
            buffer.append("" if tag == "wbr" else " ")
            continue
        if tag not in BLOCK:
            if nodes[stack[-1]].inline and nodes[stack[-1]].tag == tag:
                nested[-1] += tag not in VOID and not inside.endswith("/")
            elif "=" in inside and tag not in VOID and not inside.endswith("/"):
                tells, hidden = _names(inside)
                if "advert" in tells:
                    flush(inline=True)
                    nodes.append(Node(tag, stack[-1], tells, hidden, inline=True))
                    places.setdefault(tag, []).append(len(stack))
                    stack.append(len(nodes) - 1)
                    nested.append(0)
            continue
        if tag == "button":
            nodes[stack[-1]].asks = True
        if tag in _CLOSES_P and nodes[stack[solid[-1]]].tag == "p":
            close(solid[-1])
        if tag in _CLOSES:
            ends, holders = _CLOSES[tag]
            holder = last(holders)
            open_ = [p[k] for p in (places.get(t, []) for t in ends) if (k := bisect_right(p, holder)) < len(p)]
            if open_:
                close(min(open_))
        if _HEADING.fullmatch(tag) and _HEADING.fullmatch(nodes[stack[solid[-1]]].tag):
            close(solid[-1])
        flush()
        links = 0
        if len(stack) > 1 and tag not in _IN_HEAD and nodes[stack[1]].tag == "head":
            close(1)
        if tag in ("html", "body"):
            if places.get(tag):
                continue
        node = Node(tag, stack[-1], *_names(inside))
        nodes.append(node)
        if tag == "header":  # the nearest of these that is open says whose it is
            node.own = last(("article",)) > last(("nav", "aside", "footer", "form"))
        if tag not in VOID:
            places.setdefault(tag, []).append(len(stack))
            solid.append(len(stack))
            stack.append(len(nodes) - 1)
    flush()
    return nodes


def _kind(node: Node) -> str:
    """What potentials tell apart: the tag's family, for plain holders also what their names tell."""
    family = node.family
    return f"{family} {' '.join(node.tells)}" if family in ("div", "section") else family


_FRAMES = frozenset(("nav", "header", "footer", "aside", "form", "article", "main"))
#: What names of a holder tell of all in it, whatever names stand further in.
_LASTING = frozenset(("advert", "comment", "notice"))


def _bucket(x: float, *edges: float) -> int:
    return bisect_right(edges, x)


def _headed(node: Node) -> tuple[str, ...]:
    """What a short heading tells of the text under it."""
    text = " ".join(t for _, t in node.runs)
    words = _WORD.findall(text.lower()) if len(text) < 60 else []
    return tuple(sorted({_HEADS[w] for w in words if w in _HEADS})) if len(words) <= 5 else ()


def _features(nodes: list[Node]) -> list[tuple[str, ...]]:
    n = len(nodes)
    size, linked, stops = [v.size for v in nodes], [min(v.linked, v.size) for v in nodes], []
    for v in nodes:
        stops.append(sum(len(_STOPS.findall(t)) for _, t in v.runs))
    own_size, own_linked, own_stops = list(size), list(linked), list(stops)
    for k in range(n - 1, 0, -1):
        for sums in (size, linked, stops):
            sums[nodes[k].parent] += sums[k]
    whole, before = max(size[0], 1), 0
    out: list[tuple[str, ...]] = []
    within: list[tuple[str, ...]] = []
    over: list[tuple[str, ...]] = []  # what the last heading before or around a node tells
    latest: list[tuple[str, ...] | None] = [None] * n
    for k, node in enumerate(nodes):
        family = node.family
        p = node.parent
        around = within[p] if p >= 0 else ()
        told = node.tells or ((family,) if family in _FRAMES else ())
        held = tuple(x for x in around if x in _LASTING and x not in told)
        within.append(told + held if told else around)
        heading = (latest[p] if latest[p] is not None else over[p]) if p >= 0 else ()
        if family == "heading":
            heading = _headed(node)
            latest[p] = heading
        over.append(heading)
        text = " ".join(t for _, t in node.runs) if own_size[k] < 400 else ""
        share = own_linked[k] / own_size[k] if own_size[k] else 0
        below = linked[k] / size[k] if size[k] else 0
        long_ = _bucket(own_size[k], 1, 25, 100, 300)
        parent = size[p] if p >= 0 else whole
        found = [
            "bias",
            f"tag {family}",
            f"links {_bucket(share, 0.01, 0.3, 0.8)} {long_}",
            f"stops {_bucket(own_stops[k], 1, 2, 5)} {long_}",
            f"part {_bucket(size[k] / whole, 0.02, 0.1, 0.3, 0.6)} {_bucket(below, 0.1, 0.4, 0.8)}",
            f"sum {_bucket(size[k], 1, 60, 250, 1000)} {_bucket(stops[k], 1, 4, 12)}",
            f"holder {_bucket(parent / whole, 0.1, 0.3, 0.6)} {_bucket(linked[p] / max(parent, 1) if p >= 0 else 0, 0.1, 0.4, 0.8)} {_bucket(stops[p] if p >= 0 else 0, 1, 4, 12)}",
            f"place {_bucket(before / whole, 0.02, 0.2, 0.8, 0.98)} {int(size[k] >= 200)}",
            f"under {nodes[p].family if p >= 0 else ''}",
        ]
        found += [f"tells {x}" for x in told or ("nothing",)] + [f"within {x}" for x in around or ("nothing",)] + [f"headed {x}" for x in heading or ("nothing",)]
        if below >= 0.4 and size[k]:
            found += [f"listed {family} {nodes[p].family if p >= 0 else ''} {x} {y}" for x in around or ("nothing",) for y in heading or ("nothing",)]
        if node.asks:
            found.append(f"asks {_bucket(own_size[k] or size[k], 1, 60, 250, 1000)}")
        if text:
            found += ["legal"] * bool(_LEGAL.search(text)) + [f"says {min(len(_SAYS.findall(text)), 2)} {_bucket(before / whole, 0.02, 0.98)}"] * bool(_SAYS.search(text))
        before += own_size[k]
        out.append(tuple(found))
    return out


@dataclass
class TreeModel:
    emission: dict[tuple[int, str], float]
    pair: dict[tuple[str, str, int, int], float]
    unseen: float = 0.0

    def __post_init__(self) -> None:
        """What each feature adds for content over what it adds against."""
        self.gain = {x: self.emission.get((1, x), self.unseen) - self.emission.get((0, x), self.unseen) for _, x in self.emission}

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The chance of each node to be content: messages up, then down; nodes are in page order."""
        n = len(nodes)
        gain, up = self.gain.get, [[0.0, 0.0] for _ in range(n)]
        own = [[0.0, sum([gain(x, 0.0) for x in f])] for f in _features(nodes)]
        kinds = [_kind(v) for v in nodes]
        links = [[[self.pair.get((kinds[v.parent], kinds[k], a, b), -0.7) for b in (0, 1)] for a in (0, 1)] for k, v in enumerate(nodes)]
        below = [list(o) for o in own]
        for k in range(n - 1, 0, -1):
            for a in (0, 1):
                up[k][a] = _log_sum(links[k][a][0] + below[k][0], links[k][a][1] + below[k][1])
                below[nodes[k].parent][a] += up[k][a]
        down = [[0.0, 0.0] for _ in range(n)]
        out = []
        for k in range(n):
            if k:
                p = nodes[k].parent
                rest = [below[p][a] + down[p][a] - up[k][a] for a in (0, 1)]
                down[k] = [_log_sum(rest[0] + links[k][0][b], rest[1] + links[k][1][b]) for b in (0, 1)]
                top = max(down[k])
                down[k] = [d - top for d in down[k]]
            gap = below[k][0] + down[k][0] - below[k][1] - down[k][1]
            out.append(1 / (1 + exp(max(-60.0, min(60.0, gap)))))
        return out


def _log_sum(a: float, b: float) -> float:
    return a + log(1 + exp(b - a)) if a > b else b + log(1 + exp(a - b))


def train(pages: Iterable[list[Node]], rounds: int = 12, ridge: float = 0.3) -> TreeModel:
    """Fit weights to the labels of single nodes, and count what parents' labels add to them."""
    index: dict[str, int] = {}
    at, of, ys, n = [], [], [], 0
    pairs: Counter = Counter()
    for nodes in pages:
        for node, f in zip(nodes, _features(nodes), strict=True):
            y = node.label or 0
            if node.tag not in NEVER:  # what is never content is decided already
                for x in f:
                    at.append(n)
                    of.append(index.setdefault(x, len(index)))
                ys.append(y)
                n += 1
            if node.parent >= 0:
                pairs[_kind(nodes[node.parent]), _kind(node), nodes[node.parent].label or 0, y] += 1
    # Newton's method over a few hundred features
    x, goal = np.zeros((n, len(index))), np.array(ys, float)
    np.add.at(x, (np.array(at, int), np.array(of, int)), 1.0)
    weights = np.zeros(len(index))
    for _ in range(rounds if n else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - goal) + ridge * weights
        bend = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(index))
        weights -= np.linalg.solve(bend, slope)
    emission = {(y, x): float(weights[k]) * y for x, k in index.items() for y in (0, 1)}
    pair = {}
    for t in {t[:2] for t in pairs}:
        count = [[pairs[*t, a, b] + 0.5 for b in (0, 1)] for a in (0, 1)]
        whole = sum(map(sum, count))
        for a in (0, 1):
            for b in (0, 1):
                # the label's own share is in the weights; the potential has what the parent adds
                pair[*t, a, b] = log(count[a][b] * whole / (sum(count[a]) * (count[0][b] + count[1][b])))
    return TreeModel(emission, pair)


#: What starts a text that is content in a made page; it is taken out before features are seen.
MARK = "\ue000"


def label(nodes: list[Node]) -> list[Node]:
    """Labels from the marks in a page's runs: own text first, else most of the text below."""
    total, inside = [0] * len(nodes), [0] * len(nodes)
    for k, v in enumerate(nodes):
        marked = [t.startswith(MARK) for _, t in v.runs]
        v.runs = [(i, t.removeprefix(MARK)) for i, t in v.runs]
        v.size -= sum(marked)
        total[k] += v.size
        inside[k] += sum(len(t) for (_, t), m in zip(v.runs, marked, strict=True) if m)
        v.label = int(any(marked)) if v.runs else None
    for k in range(len(nodes) - 1, -1, -1):
        if nodes[k].label is None:
            nodes[k].label = int(2 * inside[k] > total[k])
        if k:
            total[nodes[k].parent] += total[k]
            inside[nodes[k].parent] += inside[k]
    return nodes


def labelled_pages(n: int = 1200, seed: int = 11) -> list[list[Node]]:
    """Pages from random layouts, with a label for each node of their parsed trees."""
    rng = random.Random(seed)
    letters = "etaoinshrdlu"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))

    def phrase(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.randint(a, b))).capitalize()

    def prose(a: int, b: int) -> str:
        out, left = [], rng.randint(a, b)
        while left > 0:
            k = min(left, rng.randint(2, 16))
            out.append(" ".join(word() + ("," if rng.random() < 0.08 else "") for _ in range(k)).capitalize() + rng.choice(".....!?"))
            left -= k
        return " ".join(out)

    def links(tag: str, k: int) -> str:
        return "".join(f"<{tag}><a href='/{i}'>{phrase(1, rng.choice([2, 2, 6]))}</a></{tag}>" for i in range(k))

    def plain() -> str:
        """A name that tells nothing, or none."""
        name = rng.choice(["", "", "row", "box", "inner", "wrap", "col-8", "c12", "x" + word(), "sc-" + word() + "Q", "grid unit", "has-sidebar", "no-ads", "layer", "left", "block-" + word()])
        return f" class='{name}'" if name else ""

    def telling(kind: str) -> str:
        name = rng.choice(_TELLING[kind].split())
        name = rng.choice([name, name, f"{name}-box", f"{name}_{word()}", word() + name.capitalize(), f"{name} clearfix", f"{name}{rng.choice(['Area', 'Block', 'Wrapper'])}"])
        return f" {rng.choice(['class', 'class', 'id'])}='{name}'"

    def named(kind: str, most: float = 0.6) -> str:
        return telling(kind) if rng.random() < most else plain()

    def content() -> str:
        out = []
        if rng.random() < 0.8:
            out.append(f"<h1>{MARK}{phrase(1, 10)}{rng.choice(['', '', '.'])}</h1>")
        shapes = ["<p>{}</p>"] * 8 + ["<p>{}", "<p><b>{}<br>", "<h2>{}</h2>", "<h3>{}</h3>", "<ul><li>{}</li></ul>", "<blockquote><p>{}</p></blockquote>", "<table><tr><td>{}</td></tr></table>", "<pre>{}</pre>", "<div>{}</div>", "<section><p>{}</p></section>", "<p>{} <a href='/x'>see</a></p>", "<figure><figcaption>{}</figcaption></figure>"]
        listed = lambda: "".join(rng.choice(["<li>{0}<a href='/x'>{1}</a></li>", "<li><a href='/x'>{0}{1}</a></li>", "<li><a href='/x'>{0}{1}</a>, {2}.</li>"]).format(MARK, phrase(1, 6), phrase(1, 4)) for _ in range(rng.randint(1, 7)))
        short = rng.random() < 0.15
        for _ in range(1 if short else rng.choice([1, 1, 2, 3, 5, 8, 14])):
            shape, size = rng.choice(shapes), 3 if short else rng.choice([1, 3, 12, 40, 90])
            text = phrase(1, 7) if shape.startswith("<h") else phrase(1, 12) if rng.random() < 0.2 else prose(1, size)
            if shape.startswith("<h") and rng.random() < 0.1:
                text += " " + rng.choice(sorted(_HEADS)) + " " + phrase(3, 5)
            if rng.random() < 0.04:
                text += rng.choice([" Copyright was at stake.", " They subscribe to it.", " The cookies were sweet, the author said."]) + " " + prose(10, 40)
            if shape.startswith("<p") and rng.random() < 0.06:  # an advert in the midst of a line
                tag = rng.choice(["span", "ins", "a", "small"])
                text += f" <{tag}{telling('advert')}>{rng.choice([phrase(1, 5), prose(3, 12)])}</{tag}> {prose(1, 20)}"
            out.append(shape.format(MARK + text))
            if rng.random() < 0.03:
                out.append(f"<ins{telling('advert')}>{phrase(1, 5)}</ins>")
        if not short and rng.random() < 0.2:  # what was read, where to go on
            out.append(rng.choice(["", "<h2>{}</h2>", "<h1>{}</h1>", "<p>{}</p>"]).format(MARK + phrase(1, 4)) + f"<{(tag := rng.choice(['ul', 'ol']))}>{listed()}</{tag}>")
        return "".join(out)

    def wrapped(body: str) -> str:
        style = rng.random()
        if style < 0.3:
            if rng.random() < 0.3:  # an article's own header holds its title, and what else stands before its text
                top, rest = f"<h1>{MARK}{phrase(1, 10)}</h1>", rng.choice(["", "<p>{}</p>", "<h2>{}</h2>", "<div>{}</div>"]).format(MARK + rng.choice([phrase(2, 9), prose(8, 30)]))
                body = f"<header{plain()}>{rng.choice(['{}', '<div>{}</div>']).format(top + rest)}</header>{body}"
            return f"<article{rng.choice(['', telling('content'), plain()])}>{body}</article>"
        if style < 0.4:
            return rng.choice(["<main>{}</main>", "<main><article>{}</article></main>", "<main><div>{}</div></main>"]).format(body)
        if style < 0.48:
            return body
        if style < 0.56:
            return f"<table><tr><td>{links('p', 4)}</td><td>{body}</td></tr></table>"
        if style < 0.75:
            odd = rng.choice(["", "", " id='comments-enabled'", " id='has-ads'", " data-title='the hidden cost of'"])
            return f"<div{telling('content')}{odd}>{body}</div>"
        return f"<div{plain()}>{rng.choice(['{}', '<div>{}</div>']).format(body)}</div>"

    def junk() -> str:
        text = prose(3, rng.choice([6, 15, 40]))
        people = "".join(rng.choice(["<div><b>{0}</b><p>{1}</p></div>", "<li><p>{1}</p></li>", "<p>{1}</p>", "<div>{0}: {1}</div>"]).format(phrase(1, 2), prose(3, 30)) for _ in range(rng.randint(1, 5)))
        says = rng.choice(["Comments", "Readers say", "{} comments", "Replies", "Discussion", "What readers say", "Leave a reply"]).format(rng.randint(1, 99))
        also = rng.choice(["Related", "More " + word(), "Read also", "Popular", "Share", "Latest " + word(), "Recommended", "Tags", "About the author"])
        inner = rng.choice(["<div{0}>{1}</div>", "<div{0}><p>{1}</p></div>", "<article{0}><p>{1}</p></article>"])
        posts = "".join(inner.format(telling("content"), prose(3, 30)) for _ in range(rng.randint(1, 5)))
        asks = rng.choice(["<button>OK</button>", "<button>Accept</button>", "<a href='/p'>More</a> <button>Got it</button>", "<a href='/p'>privacy policy</a>", ""])
        legal = rng.choice(["&copy; {}", "Copyright 2024 {}", "{} All rights reserved.", "&copy; site.example &middot; {}"]).format(text)
        notice = rng.choice(["We use cookies. {}", "{} By going on you consent.", "Subscribe to our newsletter. {}", "Sign up: {}"]).format(text)
        return rng.choice(
            [
                lambda: f"<nav{plain()}><ul>{links('li', rng.randint(2, 8))}</ul></nav>",
                lambda: f"<div{named('menu')}><ul>{links('li', rng.randint(2, 8))}</ul></div>",
                lambda: f"<div{named('menu')}>{links('span', rng.randint(2, 8))}</div>",
                lambda: f"<table><tr>{links('td', rng.randint(3, 7))}</tr></table>",
                lambda: f"<div{telling('advert')}>{rng.choice(['{}', '<p>{}</p>', '<div><p>{}</p></div>', '<span>{}</span>', '<p>{}</p><p>{}</p>']).replace('{}', text)}</div>",
                lambda: f"<div{named('notice')}>{rng.choice(['{} ', '<p>{}</p>', '<div><p>{}</p></div>']).format(notice)}{asks}</div>",
                lambda: f"<div{plain()}>{rng.choice(['{} ', '<p>{}</p>']).format(notice)}{asks}</div>",
                lambda: f"<{rng.choice(['div', 'section'])}{telling('comment')}>{posts}</div>",
                lambda: f"<div{telling('advert')}>{inner.format(telling('content'), text)}</div>",
                lambda: f"<div{telling('notice')}><p>{text}</p></div>",
                lambda: f"<aside{plain()}><h3>{phrase(1, 3)}</h3>{rng.choice(['<p>' + text + '</p>', '<ul>' + links('li', 4) + '</ul>'])}</aside>",
                lambda: f"<{rng.choice(['div', 'section'])}{named('social')}><h3>{also}</h3><ul>{links('li', rng.randint(2, 5))}</ul></div>",
                lambda: f"<div{telling('social')}>{rng.choice([links('p', 3), '<p>' + text + '</p>'])}</div>",
                lambda: f"<section{telling('comment')}>{people}</section>",
                lambda: f"<div{telling('comment')}><h3>{rng.choice([says, phrase(1, 3)])}</h3>{people}</div>",
                lambda: f"<div{plain()}><{rng.choice(['h2', 'h3'])}>{says}</h2>{people}</div>",
                lambda: f"<div{telling('comment')}><ul>{people}</ul></div>",
                lambda: f"<form><p>{text}</p><input><button>{word()}</button></form>",
                lambda: f"<header{plain()}>{rng.choice(['<h1>{}</h1><p>{}</p>', '<p>{}</p>', '<div>{}</div>', '{}']).replace('{}', phrase(1, 5))}</header>",
                lambda: f"<footer{rng.choice(['', telling('content'), telling('social')])}>{rng.choice(['{}', '<p>{}</p>', '<div>{}</div><p>{}</p>', '{} ' + links('span', 1)])}</footer>".replace("{}", rng.choice([legal, text, phrase(1, 4)])),
                lambda: f"<div{named('frame')}>{rng.choice(['{}', '<p>{}</p>', '<small>{}</small>']).format(legal)}</div>",
                lambda: f"<div{telling('frame')}><h4>{phrase(1, 2)}</h4><p>{text}</p></div>",
            ]
        )()

    pages = []
    for _ in range(n):
        body = wrapped(content() + (junk() + content() if rng.random() < 0.3 else "") + (junk() if rng.random() < 0.3 else ""))
        before, after = ("".join(junk() for _ in range(rng.choice([0, 1, 1, 2, 3]))) for _ in range(2))
        outer = rng.choice(["{}", "{}", "<div id='page'>{}</div>", "<div class='wrap'>{}</div>", "<div>{}</div>"]).format(before + body + after)
        pages.append(label(parse(rng.choice(["<html><head><title>x</title></head><body>{}</body></html>", "<html><head><title>x</title>{}</html>", "{}"]).replace("{}", outer))))
        if rng.random() < 0.1:  # a page of bare text
            bare = rng.choice(["{}", "<p>{}</p><p>{}", "<body>{}</body>", "<html><body>{}<br></body></html>", "<div>{}</div>", "<div><p>{}</p><p>{}</p></div>"])
            pages.append(label(parse(bare.replace("{}", MARK + prose(2, 80)))))
    return pages


def main_text(page: str, model: TreeModel) -> str:
    """The kept runs of text in page order, joined by line ends."""
    nodes = parse(page)
    pieces: list[tuple[tuple[int, int, bool], str]] = []
    dropped: set[int] = set()
    chances = model.marginals(nodes)
    for k, node in enumerate(nodes):
        if node.tag in NEVER or node.hidden or node.parent in dropped:
            dropped.add(k)
        kept = k not in dropped and chances[k] >= 0.5
        pieces += [(place, text if kept else "") for place, text in node.runs]
    lines: dict[int, list[str]] = {}
    for (line, _, space), text in sorted(pieces):
        lines.setdefault(line, []).append(" " * space + text)
    return "\n".join(t for parts in lines.values() if (t := _SPACE.sub(" ", "".join(parts)).strip()))


def extract_text(pages: DataFrame, model: TreeModel | None = None, *, html_column: str = "html") -> tuple[DataFrame, str]:
    """pages with a string column of their main text, and that column's name.

    A null or empty page, and one with no content, has an empty text. Character references are
    decoded; white space inside a block is one space, none at its ends; blocks are joined by one
    line end. Long pages are read whole; nesting may be of any depth. Other columns pass
    through; repeated rows have equal texts. Without a model one is trained on labelled_pages().
    """
    small_batches(pages.sparkSession)
    name = free_name(pages, "main_text")
    sent = pages.sparkSession.sparkContext.broadcast(model or train(labelled_pages()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.names.index(html_column))
            yield add_column(batch, name, pa.array([main_text(x.as_py() or "", sent.value) for x in column], pa.string()))

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(name, T.StringType())])), name
