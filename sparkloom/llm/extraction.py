"""Operator 7, HTML extraction: belief propagation on the DOM tree.

Every element and every text is a binary variable (content or not). A node's own potential
is a logistic model of its tag, class and id words, length, link share and punctuation;
parent and child are tied by a 2 x 2 potential for the kind of child (text, inline, block,
section). Messages go up from the leaves and down from the root once (exact on a tree), and
a text is kept where its marginal for content is at least one half.

Both kinds of potentials are learned from labelled pages: ``labelled_pages`` builds a fixed
number of them from layouts in which the place of the content is known. Training takes a
second on the driver; the parameters (a few hundred numbers) go to the tasks.

Scale: pages are extracted where they are read, no shuffle, one page in memory at a time.
Defined cases: null, empty or text-less html gives an empty text; plain text without tags is
content if the model says so; repeated rows are extracted each; broken nesting is read as
browsers do for p, li, table parts and options, below DEPTH open elements as siblings; tags
without an end are text; time grows with the page's length, whatever its markup; nothing is
dropped or capped by length.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe".split())
HIDDEN = RAW | frozenset("head svg math select option button input datalist object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt s samp small span strike strong sub sup time tt u var wbr img".split())
SECTIONS = frozenset("html body main article section nav aside header footer form".split())
#: Opening one of these closes an open one of those, up to the nearest of the last.
CLOSES = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tfoot tr td th", "table"), "thead": ("thead tbody tfoot tr td th", "table"), "body": ("head", "html"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
NAMED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
UNQUOTED = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Words in class, id and role names that the unary model looks at, by what they tell.
HINTS = {
    "body": "article content main post entry story body text copy prose blog page document articlebody",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar tabs topbar skip sitemap toc",
    "edge": "header footer masthead banner colophon copyright logo brand legal imprint head foot",
    "side": "sidebar aside related recommended popular trending widget rail secondary complementary more",
    "ad": "ad ads advert advertisement adverts sponsor sponsored promo promoted adsense dfp outbrain taboola advertorial commercial",
    "note": "cookie cookies consent notice alert popup modal overlay gdpr dialog toast disclaimer banner paywall subscribe newsletter signup",
    "talk": "comment comments commentlist reply replies respond disqus discussion reader readers feedback reviews",
    "form": "form search login register contact field input",
    "share": "share sharing social follow facebook twitter like buttons tags tag meta byline author",
}
HINT_OF = {}
for _k, _v in HINTS.items():
    for _w in _v.split():
        HINT_OF.setdefault(_w, []).append(_k)
TAGS = "html body main article section nav aside header footer form div p h1 h2 h3 h4 h5 h6 ul ol li a b i em strong span table tr td th blockquote pre code figure figcaption dl dt dd label #text".split()
#: Elements whose content is told by their tag, however deep it lies.
CONTAINERS = "nav aside header footer form article main".split()
#: Stands before a text of the content in labelled pages.
MARK = "\ue000"
NUMBERS = ("length", "links", "points", "bias")
FEATURES = {name: i for i, name in enumerate([*(f"tag:{t}" for t in TAGS), *(f"under:{t}" for t in TAGS), *(f"name:{h}" for h in HINTS), *(f"within:{h}" for h in HINTS), *(f"inside:{h}" for h in (*HINTS, *(f"<{t}>" for t in CONTAINERS))), *NUMBERS])}


class Node:
    __slots__ = ("tag", "hints", "above", "parent", "text", "children", "size", "linked", "points", "label")

    def __init__(self, tag: str, parent: int, hints: tuple[str, ...] = (), text: str = ""):
        self.tag, self.parent, self.hints, self.text = tag, parent, hints, text
        self.size = self.linked = self.points = 0
        self.above: frozenset[str] = frozenset()
        self.label = None


@lru_cache(100_000)
def hints_of(attributes: str) -> tuple[str, ...]:
    found = set()
    for m in ATTRIBUTE.finditer(attributes):
        if m[1].lower() == "hidden" or m[1].lower() == "aria-hidden" and "true" in (m[2] or ""):
            found.add("#hidden")
        for w in NAME.findall(m[2] or ""):
            found.update(HINT_OF.get(w.lower(), ()))
    return tuple(sorted(found))


def tags_of(source: str) -> Iterator[tuple]:
    """(start, end, closing, name, attributes) of tags, in order; comments and declarations have no name.

    One pass: whatever a search once misses (a quote, a ``>``) isn't searched for again. ``send``
    a position to go on from there.
    """
    at, n, quoting = 0, len(source), True
    while (lt := source.find("<", at)) >= 0:
        m = NAMED.match(source, lt)
        if m:
            p, attributes = m.end(), m.end()
            while quoting:
                p = UNQUOTED.match(source, p).end()
                if p >= n or source[p] == ">":
                    break
                close = source.find(source[p], p + 1)
                p = close + 1 if close >= 0 else n
            if p >= n or source[p] != ">":
                quoting = False  # quotes don't pair up: from here on tags end at their first ">"
                p = source.find(">", attributes)
                if p < 0:
                    return
            found = lt, p + 1, bool(m[1]), m[2].lower(), source[attributes:p]
        elif source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            found = lt, end + 3 if end >= 0 else n, False, None, ""
        elif source.startswith(("<!", "<?"), lt):
            end = source.find(">", lt)
            if end < 0:
                return
            found = lt, end + 1, False, None, ""
        else:
            at = lt + 1
            continue
        onward = yield found
        at = found[1]
        if onward is not None:
            at = onward
            yield None


def tree(source: str) -> list[Node]:
    """Nodes in document order, parents before children; hidden elements have no nodes."""
    nodes = [Node("#root", -1)]
    stack = [0]
    # Places in the stack by tag, and those of elements that aren't inline: every search for an open element looks at the last of them.
    places: dict[str, list[int]] = {}
    blocks: list[int] = []
    done = 0
    never_closed: set[str] = set()

    def push(tag: str) -> None:
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append(len(nodes) - 1)

    def close(place: int) -> None:
        while len(stack) > place:
            tag = nodes[stack.pop()].tag
            places[tag].pop()
            if tag not in INLINE:
                blocks.pop()

    def last(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def put(text: str) -> None:
        if text and not text.isspace():
            nodes.append(Node("#text", stack[-1], (), entities.unescape(text)))
        elif text:
            nodes.append(Node("#space", stack[-1], (), " "))

    found = tags_of(source)
    for start, end, closing, tag, attributes in found:
        put(source[done:start])
        done = end
        if tag is None:
            continue
        if closing:
            place = last(tag)
            # A paragraph's end looks through inline elements only, most others not out of a table or its cells.
            bound = blocks[-1] if tag == "p" and blocks else last("td", "th", "table") if tag not in ("tr", "tbody", "thead", "tfoot", "table", "div", *SECTIONS) else 0
            if place and place >= bound:
                close(place)
            continue
        if tag in ENDS_P and blocks and nodes[stack[blocks[-1]]].tag == "p":
            close(blocks[-1])
        if tag in CLOSES:
            those, stop = CLOSES[tag]
            while (place := last(*those)) > last(*stop):
                close(place)
                if tag not in ("tr", "td", "th", "tbody", "tfoot", "thead"):
                    break
        if tag in RAW or tag in HIDDEN and tag not in ("head", "object") and tag not in VOID:
            ends = None if tag in never_closed else re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, done)
            gt = source.find(">", ends.end()) if ends else -1
            if gt < 0:
                never_closed.add(tag)
            if gt >= 0 or tag in RAW:
                done = gt + 1 if gt >= 0 else len(source)
                found.send(done)
            continue
        hints = hints_of(attributes) if attributes and not attributes.isspace() else ()
        nodes.append(Node(tag, stack[-1], hints))
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            push(tag)
    put(source[done:])
    return nodes


def measured(nodes: list[Node]) -> None:
    """Characters, linked characters and punctuation below every node; the hints and containers above it, at any distance."""
    in_link = [False] * len(nodes)
    within: list[frozenset[str]] = [frozenset()] * len(nodes)  # of a node's children
    for i, x in enumerate(nodes):
        if x.parent >= 0:
            x.above = within[x.parent]
            own = (*(h for h in x.hints if h != "#hidden"), *((f"<{x.tag}>",) if x.tag in CONTAINERS else ()))
            within[i] = x.above.union(own) if own else x.above
        in_link[i] = x.parent >= 0 and in_link[x.parent] or x.tag == "a"
        if x.tag == "#text":
            x.size = len(x.text)
            x.linked = x.size if in_link[i] else 0
            x.points = sum(map(x.text.count, ".,;!?"))
    for x in reversed(nodes[1:]):
        p = nodes[x.parent]
        p.size += x.size
        p.linked += x.linked
        p.points += x.points


def features(x: Node, parent: Node | None) -> list[tuple[int, float]]:
    out = [(FEATURES["bias"], 1.0), (FEATURES["length"], min(math.log1p(x.size), 8.0) / 4), (FEATURES["links"], x.linked / x.size if x.size else 0.0), (FEATURES["points"], min(1.0, 20 * x.points / x.size) if x.size else 0.0)]
    if (k := FEATURES.get(f"tag:{x.tag}")) is not None:
        out.append((k, 1.0))
    if parent is not None and (k := FEATURES.get(f"under:{parent.tag}")) is not None:
        out.append((k, 1.0))
    out += [(FEATURES[f"name:{h}"], 1.0) for h in x.hints if h != "#hidden"]
    if parent is not None:
        out += [(FEATURES[f"within:{h}"], 1.0) for h in parent.hints if h != "#hidden"]
    out += [(FEATURES[f"inside:{h}"], 1.0) for h in x.above]
    return out


def kind_of(x: Node, parent: Node) -> int:
    """Which tie holds: by the kind of child, and whether the parent is a mere wrapper (of any mixture)."""
    kind = 0 if x.tag == "#text" else 1 if x.tag in INLINE else 3 if x.tag in SECTIONS else 2
    return kind + 4 * (parent.tag in ("#root", "html", "body") or parent.tag in ("div", "main") and not parent.hints)


def marginals(nodes: list[Node], weights: list[float], ties: list[tuple[float, float, float, float]]) -> list[float]:
    """P(content) of every node: unary log-odds, then messages up and down (log-odds throughout)."""
    n = len(nodes)
    own = [0.0] * n
    for i in range(1, n):
        x = nodes[i]
        if x.tag != "#space":
            own[i] = sum(weights[k] * v for k, v in features(x, nodes[x.parent]))
            if "#hidden" in x.hints:
                own[i] -= 12.0
    exp, log = math.exp, math.log

    def passed(odds: float, a: float, b: float, c: float, d: float) -> float:
        # log of (c + d * e^odds) / (a + b * e^odds): what a neighbour with these odds says
        e = exp(min(max(odds, -30.0), 30.0))
        return log((c + d * e) / (a + b * e))

    up, total = [0.0] * n, own[:]
    for i in range(n - 1, 0, -1):
        x = nodes[i]
        if x.tag != "#space":
            p00, p01, p10, p11 = ties[kind_of(x, nodes[x.parent])]  # p<parent><child>
            up[i] = passed(total[i], p00, p01, p10, p11)
            total[x.parent] += up[i]
    belief = total[:]
    for i in range(1, n):
        x = nodes[i]
        if x.tag != "#space":
            p00, p01, p10, p11 = ties[kind_of(x, nodes[x.parent])]
            belief[i] = total[i] + passed(belief[x.parent] - up[i], p00, p10, p01, p11)
    return [1 / (1 + exp(-min(max(b, -30.0), 30.0))) for b in belief]


def joined(nodes: list[Node], keep: list[bool]) -> str:
    """Kept texts in page order; white space is one space, and blocks are a space apart."""
    parts: list[str] = []
    open_blocks: list[int] = [-1] * len(nodes)
    last = None
    for i, x in enumerate(nodes):
        if i and x.parent >= 0:
            open_blocks[i] = i if x.tag not in INLINE and x.tag[0] != "#" else open_blocks[x.parent]
        if x.tag in ("br", "hr"):
            parts.append(" ")
        if x.tag[0] == "#" and i and keep[i]:
            if open_blocks[i] != last:
                parts.append(" ")
                last = open_blocks[i]
            parts.append(x.text)
    return " ".join("".join(parts).split())


def labelled_pages(count: int = 240, seed: int = 20) -> Iterator[str]:
    """Pages in many layouts; texts of the content are marked by a leading U+E000."""
    rng = random.Random(seed)
    syllables = "an be co da el fi gor hu in jo ka lum me no or pi ra st tu ve wer xi yo za".split()

    def words(n: int) -> str:
        out = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)]
        return " ".join(w + (rng.choice(".,;") if rng.random() < 0.15 else "") for w in out).capitalize() + rng.choice([".", ".", "", "!"])

    def named(group: str) -> str:
        a = rng.choice(HINTS[group].split())
        return rng.choice([f'class="{a}"', f'id="{a}"', f'class="{a} {rng.choice(["box", "wrap", "c1", "row"])}"', f'class="site-{a}"', f'class="{a}-area x{rng.randint(1, 9)}"'])

    def link() -> str:
        return f'<a href="/{rng.choice(syllables)}">{words(rng.randint(1, 3)).rstrip(".!")}</a>'

    def links() -> str:
        return rng.choice(["<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8))) + "</ul>", " | ".join(link() for _ in range(rng.randint(2, 6)))])

    def deep(inner: str) -> str:
        """The same within one to three wrappers that say nothing, or as it is."""
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            tag = rng.choice(["div", "div", "section", "li", "article", "span" if "<" not in inner else "div"])
            inner = f"<{tag}{rng.choice(['', '', ' class=inner', ' class=row', ' id=c2', ' class=u-mb4'])}>{inner}</{tag}>"
        return inner

    def prose() -> str:
        """Sentences as an article has them, where there is none."""
        return "".join(f"<p>{' '.join(words(rng.randint(5, 15)) for _ in range(rng.randint(1, 5)))}</p>" for _ in range(rng.randint(1, 3)))

    def menu() -> str:
        inner = deep(rng.choice([links(), links(), prose()]))
        return rng.choice([f"<nav>{inner}</nav>", f"<div {named('menu')}>{inner}</div>", f"<ul {named('menu')}><li>{link()}<li>{link()}</ul>", f"<nav {named('menu')}>{inner}</nav>"])

    def edge(tag: str) -> str:
        inner = rng.choice([f"<p>{words(rng.randint(2, 14))}</p>", f"&copy; {words(rng.randint(1, 12))}", f"<h2>{words(3)}</h2>{links()}", f"{words(4)}{menu()}", f"{words(2)} &middot; {words(rng.randint(3, 12))}", prose()])
        inner = deep(inner)
        return rng.choice([f"<{tag}>{inner}</{tag}>", f"<div {named('edge')}>{inner}</div>", f"<{tag} {named('edge')}>{inner}</{tag}>"])

    def side() -> str:
        inner = rng.choice([f"<h3>{words(2)}</h3>{links()}", f"<p>{words(rng.randint(5, 60))}</p>", f"<h4>{words(3)}</h4><p>{words(rng.randint(8, 40))}</p>{link()}", prose()])
        inner = deep(inner)
        return rng.choice([f"<aside>{inner}</aside>", f"<div {named('side')}>{inner}</div>", f"<section {named('side')}>{inner}</section>", f"<aside {named('side')}>{inner}</aside>"])

    def ad() -> str:
        return f"<div {named('ad')}>{deep(rng.choice([words(rng.randint(2, 40)), f'<p>{words(rng.randint(4, 30))}</p>', link(), prose()]))}</div>"

    def note() -> str:
        return f"<div {named('note')}>{deep(rng.choice([words(rng.randint(4, 40)), f'<p>{words(rng.randint(5, 40))}</p>{link()}', prose()]))}</div>"

    def talk() -> str:
        one = lambda: rng.choice([f"<div {named('talk')}><b>{words(2)}</b><p>{words(rng.randint(4, 60))}</p></div>", f"<li>{words(2)}<p>{words(rng.randint(4, 60))}</p></li>", f"<article {named('talk')}><p>{words(rng.randint(4, 60))}</p></article>"])
        tag = rng.choice(["div", "section", "ol", "ul"])
        return f"<{tag} {named('talk')}>{rng.choice(['', f'<h3>{words(2)}</h3>'])}{''.join(deep(rng.choice([one, one, prose])()) for _ in range(rng.randint(1, 5)))}</{tag}>"

    def form() -> str:
        inner = deep(rng.choice([f"<p>{words(rng.randint(2, 20))}</p>", prose()]))
        return rng.choice([f"<form><label>{words(3)}</label><input name=q>{inner}</form>", f"<form {named('form')}>{inner}<textarea>{words(4)}</textarea></form>", f"<div {named('form')}><label>{words(2)}</label></div>"])

    def share() -> str:
        return f"<div {named('share')}>{links()}</div>"

    def block() -> str:
        mark, t = MARK, words(rng.randint(2, 90))
        half = words(rng.randint(3, 20))
        return rng.choice([
            f"<p>{mark}{t}</p>", f"<p>{mark}{t}</p>", f"<p>{mark}{t}", f"<p>{mark}{t} <a href='/x'>{mark}{words(3)}</a>{mark} {half}</p>", f"<p><b>{mark}{half}</b>{mark} {t}</p>", f"<p><b>{mark}{t}<br><p>{mark}{half}</p>",
            f"<h2>{mark}{words(rng.randint(2, 9))}</h2>", f"<ul><li>{mark}{half}</li><li>{mark}{t}</li></ul>", f"<ol><li>{mark}{half}<li>{mark}{half}</ol>", f"<blockquote><p>{mark}{t}</p></blockquote>", f"<table><tr><td>{mark}{half}<td>{mark}{words(2)}</table>",
            f"<figure><img src=x><figcaption>{mark}{half}</figcaption></figure>", f"<pre>{mark}{half}</pre>", f"<div>{mark}{t}</div>", f"<section><h3>{mark}{words(4)}</h3><p>{mark}{t}</p></section>", f"<p>{mark}{words(1)}</p>", f"<p><em>{mark}{t}</em></p>",
        ])

    junk = [menu, side, ad, note, form, share, talk]
    for _ in range(count):
        title = words(rng.randint(3, 12))
        inside = [deep(block()) if rng.random() < 0.4 else block() for _ in range(rng.randint(1, 14))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            inside.insert(rng.randint(0, len(inside)), rng.choice([ad, share, note, side, form, menu])())
        head = rng.choice([f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>", f"<h1>{title}</h1><p>{words(8)}</p>"])
        if rng.random() < 0.2:
            inside.append(talk())
        body = deep(head + "".join(inside)) if rng.random() < 0.3 else head + "".join(inside)
        body = rng.choice([f"<article>{body}</article>", f"<article>{body}</article>", f"<main>{body}</main>", f"<main><article>{body}</article></main>", f"<div {named('body')}>{body}</div>", f"<div {named('body')}><article>{body}</article></div>", f"<section {named('body')}>{body}</section>"])
        before = [f() for f in rng.sample(junk[:5], rng.randint(0, 3))]
        after = [f() for f in rng.sample(junk, rng.randint(0, 4))]
        page = "".join([edge("header") if rng.random() < 0.5 else "", *before, body, *after, edge("footer") if rng.random() < 0.8 else ""])
        if rng.random() < 0.3:
            page = f'<div class="{rng.choice(["wrapper", "container", "outer", "layout"])}">{page}</div>'
        yield f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{page}</body></html>"


def fit(pages: int = 300, rounds: int = 500, smooth: float = 2.0) -> tuple[list[float], list[tuple]]:
    """(unary weights, ties) from ``pages`` labelled pages; at most that many are used.

    The unary model is a logistic regression, the ties are counted; how much each of the two
    counts against the other is chosen by the errors of the marginals on the same pages.
    """
    rows, labels, counts, held = [], [], np.full((8, 2, 2), smooth), []
    for source in labelled_pages(pages):
        nodes = tree(source)
        good = [0] * len(nodes)
        for i, x in enumerate(nodes):
            if x.tag == "#text" and MARK in x.text:
                x.text = x.text.replace(MARK, "")
                good[i] = len(x.text)
        measured(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            good[nodes[i].parent] += good[i]
        for i, x in enumerate(nodes[1:], 1):
            if x.tag == "#space" or not x.size:
                continue
            x.label = int(2 * good[i] > x.size)
            rows.append(features(x, nodes[x.parent]))
            labels.append(x.label)
            if (p := nodes[x.parent].label) is not None:
                counts[kind_of(x, nodes[x.parent]), p, x.label] += 1
        held.append(nodes)
    m, y = np.zeros((len(rows), len(FEATURES))), np.array(labels, float)
    for r, row in enumerate(rows):
        for k, v in row:
            m[r, k] = v
    w, s = np.zeros(len(FEATURES)), np.zeros(len(FEATURES))
    for _ in range(rounds):
        g = m.T @ (1 / (1 + np.exp(-m @ w)) - y) / len(y) + 1e-4 * w
        s += g * g
        w -= 0.5 * g / np.sqrt(s + 1e-8)
    # Potentials are relative to independence, as the unary model already holds the base rates.
    tie = counts / counts.sum(2, keepdims=True)
    tie /= np.sqrt(tie[:, :1, :] * tie[:, 1:, :])

    def model(share: float, power: float) -> tuple[list[float], list[tuple]]:
        return (share * w).tolist(), [tuple(t.ravel().tolist()) for t in tie**power]

    def errors(candidate: tuple) -> int:
        return sum((q >= 0.5) != x.label for nodes in held[::3] for x, q in zip(nodes, marginals(nodes, *candidate)) if x.tag == "#text")

    return min((model(a, b) for a in (0.5, 0.75, 1.0) for b in (0.5, 1.0, 1.5)), key=errors)


def main_text(source: str | None, model: tuple[list[float], list[tuple]]) -> str:
    """The main text of a page."""
    if not source:
        return ""
    nodes = tree(source)
    measured(nodes)
    p = marginals(nodes, *model)
    keep = [x.tag == "#text" and q >= 0.5 for x, q in zip(nodes, p)]
    for i, x in enumerate(nodes):
        if x.tag == "#space":
            keep[i] = True
    return joined(nodes, keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: tuple | None = None) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page."""
    model = model or fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), model) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
