"""Main-text extraction from HTML by a tree-structured graphical model.

A page's block elements form a tree; each has a label, content or not.  A node's own potential is a sum of learned
weights of its features (tag, words of class, id and role, amount of text, links, sentences); a learned 2 x 2 table
ties a child's label to its parent's.  Sum-product messages, once upward and once downward, give each node's exact
marginal (there is a table for each kind of edge: is the child named, or of a tag
that stands for a page region, and is the parent the page itself); the text of nodes at 0.5 or more is kept.  Weights and table are trained by maximum likelihood on labelled
pages that `labelled_page` writes (layouts with menus, notices, adverts, forms, comments and so on), from a fixed seed.

Character references are decoded, white space inside a block (line breaks included) becomes one blank, blocks are
joined in page order by one newline.  Null and empty pages, and pages of which nothing is content, give ''.  Broken
markup (unclosed elements, cut tags, stray ends) is read as a browser would close it.  Any page length is read whole;
other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from functools import cache, lru_cache

from pyspark.sql import DataFrame

from .common import map_columns

# Element kinds of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base basefont br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head script style noscript template svg math iframe object canvas select textarea button audio video map".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tbody", "tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
BORDERS = frozenset("article aside body div footer form header html main nav ol section table ul dl td th #page".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<raw>script|style|textarea|title|noscript|iframe)(?=[\s/>])[^>]*>(?:.*?(?=</(?P=raw)(?=[\s/>]))|.*)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<more>(?>\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<more2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.I | re.S,
)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
SENTENCE = re.compile(r"[.!?…。]['\")»”]?(?:\s|$)")
BUCKETS = 1 << 12


class Node:
    __slots__ = ("tag", "named", "parent", "children", "pieces", "letters", "linked", "label")

    def __init__(self, tag: str, named: str, parent: Node | None):
        self.tag, self.named, self.parent = tag, named, parent
        self.children: list[Node] = []
        self.pieces: list[str] = []
        self.letters = self.linked = 0
        self.label = None
        if parent is not None:
            parent.children.append(self)


def parse(html: str, mark: str | None = None) -> tuple[Node, list[tuple[Node, list[str]]]]:
    """The tree of block elements, and the blocks (their node and pieces of text) in page order.

    mark: an attribute whose value labels an element and what is in it (training pages).
    """
    root = Node("#page", "", None)
    stack: list[tuple[str, Node]] = [("#page", root)]  # open elements; inline ones share their block's node
    opened: Counter = Counter()  # open elements by tag: what isn't open is not looked for
    blocks: list[tuple[Node, list[str]]] = []
    pieces: list[str] = []
    hidden = links = 0  # open elements that are dropped, and open links

    def text(piece: str):
        if not hidden and piece:
            node = stack[-1][1]
            pieces.append(piece)
            n = len(piece)
            node.letters += n
            if links:
                node.linked += n

    def border():
        nonlocal pieces
        if pieces:
            blocks.append((stack[-1][1], pieces))
            pieces = []

    def pop_to(k: int):
        nonlocal hidden, links
        while len(stack) > k:
            tag = stack[-1][0]
            if tag not in INLINE:
                border()
            hidden -= tag in DROPPED
            links -= tag == "a"
            opened[tag] -= 1
            stack.pop()

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag == "br":
                text(" ")
                continue
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE or tag == "p" and stack[k][0] in BORDERS:
                    break
            continue
        if tag in VOID:
            if tag == "hr":
                border()
            else:
                text(" " if tag == "br" else "")
            continue
        if tag in CLOSES_P or tag in SAME:
            shut = SAME.get(tag, ("p",)) if tag in SAME else ("p", *(HEADINGS if tag in HEADINGS else ()))
            for k in range(len(stack) - 1, 0, -1) if any(opened[t] for t in shut) else ():
                if stack[k][0] in shut:
                    pop_to(k)
                    if tag not in SAME:
                        break
                elif stack[k][0] in BORDERS and stack[k][0] not in ("td", "th") or tag not in SAME and stack[k][0] in BORDERS:
                    break
        if tag in INLINE:
            links += tag == "a"
            opened[tag] += 1
            stack.append((tag, stack[-1][1]))
            continue
        border()
        if tag in ("html", "body") and opened[tag]:
            continue
        if tag in DROPPED:
            hidden += 1
        if hidden:
            opened[tag] += 1
            stack.append((tag, stack[-1][1]))
            continue
        more = m["more"] or m["more2"] or ""
        node = Node(tag, " ".join(a or b or c for a, b, c in NAMED.findall(more)) if "=" in more else "", stack[-1][1])
        if mark and (found := re.search(rf'{mark}="(\d)"', more)):
            node.label = int(found[1])
        if not more.endswith("/") or tag not in ("path",):
            opened[tag] += 1
            stack.append((tag, node))
    if at < len(html):
        text(html[at:])
    border()
    return root, blocks


@lru_cache(20_000)
def named_features(tag: str, named: str) -> tuple[int, ...]:
    words = {w.lower() for w in PARTS.findall(named)}
    return (bucket(f"tag {tag}"), *(bucket(f"name {w}") for w in sorted(words)), *(() if words else (bucket("no name"),)))


@cache
def bucket(feature: str) -> int:
    h = 2166136261
    for b in feature.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % BUCKETS


@cache
def amount_features(tag: str, parent: str, size: int, links: int, ends: int, under: int) -> tuple[int, ...]:
    return bucket(f"size {size}"), bucket(f"links {links} {min(size, 2)}"), bucket(f"ends {ends} {min(size, 2)}"), bucket(f"under {under}"), bucket(f"{tag} {min(size, 3)}"), bucket(f"{tag} in {parent}"), bucket(f"{tag} under {under}")


def features(nodes: list[Node], blocks: list[tuple[Node, list[str]]]) -> list[tuple[int, ...]]:
    """nodes: parents before children."""
    sentences: dict[int, int] = {}
    for node, pieces in blocks:
        if node.letters:
            last = next((p for p in reversed(pieces) if not p.isspace()), "")
            sentences[id(node)] = max(sentences.get(id(node), 0), 1 if SENTENCE.search(last[-3:]) else 0)
    below: dict[int, list[int]] = {}
    for node in reversed(nodes):
        own = below.setdefault(id(node), [0, 0])
        own[0] += node.letters
        own[1] += node.linked
        if node.parent is not None:
            up = below.setdefault(id(node.parent), [0, 0])
            up[0] += own[0]
            up[1] += own[1]
    out = []
    for node in nodes:
        n, linked = below[id(node)]
        size = 0 if node.letters < 2 else 1 if node.letters < 25 else 2 if node.letters < 80 else 3 if node.letters < 250 else 4
        share = 0 if not n else min(3, 4 * linked // n)
        under = 0 if n < 40 else 1 if n < 300 else 2 if n < 1500 else 3
        out.append(named_features(node.tag, node.named) + amount_features(node.tag, "" if node.parent is None else "page" if node.parent.tag in PAGE else node.parent.tag, size, share, sentences.get(id(node), 2), under))
    return out


def in_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node.children)
    return out


REGIONS = frozenset("aside footer form header nav".split())
PAGE = frozenset("#page html body".split())


def edge_kind(node: Node) -> int:
    return (node.named != "" or node.tag in REGIONS) + 2 * (node.parent is not None and node.parent.tag in PAGE)


def log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


class TreeModel:
    def __init__(self):
        self.weight = [0.0] * BUCKETS
        self.tables = [[[1.0, 0.0], [0.0, 1.0]] for _ in range(4)]  # [kind of edge][parent's label][child's label]

    def marginals(self, parents: list[int], kinds: list[int], own: list[float]) -> tuple[list[float], list[float]]:
        """P(content) of every node, and the log odds each child sees of its parent without itself.

        parents: for each node its parent's place, before its own; -1 for the root.
        """
        tables = self.tables
        up, rise = list(own), [0.0] * len(own)
        for k in range(len(own) - 1, 0, -1):  # upward: log odds that a child tells its parent
            b = up[k]
            (t00, t01), (t10, t11) = tables[kinds[k]]
            rise[k] = log_add(t10, t11 + b) - log_add(t00, t01 + b)
            up[parents[k]] += rise[k]
        total, seen = list(up), [0.0] * len(own)
        for k in range(1, len(own)):  # downward
            seen[k] = a = total[parents[k]] - rise[k]
            (t00, t01), (t10, t11) = tables[kinds[k]]
            total[k] = up[k] + log_add(t01, t11 + a) - log_add(t00, t10 + a)
        return [1 / (1 + math.exp(-max(-60.0, min(60.0, x)))) for x in total], seen

    def own_potentials(self, found: list[tuple[int, ...]]) -> list[float]:
        weight = self.weight.__getitem__
        return [sum(map(weight, f)) for f in found]

    def fit(self, pages: list[tuple[list[int], list[int], list[tuple[int, ...]], list[int]]], epochs: int = 12, rate: float = 0.15, l2: float = 2e-4, seed: int = 3) -> TreeModel:
        """pages: parents, kinds of edge, features and labels of their nodes.  Stochastic ascent of the likelihood, page by page."""
        rng, pages, w = random.Random(seed), list(pages), self.weight
        for epoch in range(epochs):
            rng.shuffle(pages)
            step = rate / (1 + 0.3 * epoch)
            for parents, kinds, found, labels in pages:
                own = self.own_potentials(found)
                p, seen = self.marginals(parents, kinds, own)
                for f, y, q in zip(found, labels, p):
                    d = step * (y - q)
                    for i in f:
                        w[i] += d - step * l2 * w[i]
                n = max(1, len(own))
                for k in range(1, len(own)):
                    t = self.tables[kinds[k]]
                    (t00, t01), (t10, t11) = t
                    # the pair's belief, from what the parent is without the child and the child is without the parent
                    a = seen[k]
                    b = math.log(max(p[k], 1e-12) / max(1 - p[k], 1e-12)) - (log_add(t01, t11 + a) - log_add(t00, t10 + a))
                    logs = [t00, t01 + b, t10 + a, t11 + a + b]
                    most = max(logs)
                    mass = [math.exp(x - most) for x in logs]
                    z = sum(mass)
                    for j, x in enumerate(mass):
                        t[j >> 1][j & 1] -= step * x / z / n
                    t[labels[parents[k]]][labels[k]] += step / n
        return self

    def content(self, html: str | None) -> list[str]:
        """The blocks of the main text."""
        if not html:
            return []
        root, blocks = parse(html)
        nodes = in_order(root)
        place = {id(n): k for k, n in enumerate(nodes)}
        p, _ = self.marginals([-1 if n.parent is None else place[id(n.parent)] for n in nodes], [*map(edge_kind, nodes)], self.own_potentials(features(nodes, blocks)))
        kept = ((" ".join(entities.unescape("".join(pieces)).split())) for node, pieces in blocks if p[place[id(node)]] >= 0.5)
        return [k for k in kept if k]

    def text(self, html: str | None) -> str:
        return "\n".join(self.content(html))


# Words of class and id attributes that layouts use.
CONTENT_NAMES = "content article post entry main story text page-content article-body post-content entry-content main-content story-body".split()
NOISE = {
    "nav": "nav menu navbar main-menu top-nav breadcrumb breadcrumbs links pagination pager toc".split(),
    "header": "header masthead top site-header page-header branding logo toolbar".split(),
    "footer": "footer site-footer bottom copyright legal colophon credits".split(),
    "aside": "sidebar aside side widget rail secondary right-column related recommended more-stories popular trending teaser tags share social author-box".split(),
    "notice": "cookie cookie-notice notice consent gdpr banner alert popup modal overlay paywall message".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense ad-slot commercial".split(),
    "form": "form newsletter subscribe signup login search contact-form".split(),
    "comments": "comments comment comment-list reply replies responses discussion disqus respond user-comments".split(),
}
NOISE_TAGS = {"nav": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "aside": ("aside", "div", "section"), "notice": ("div", "section", "p"), "ad": ("div", "aside", "ins"), "form": ("form", "form", "div"), "comments": ("section", "div", "ol")}


def labelled_page(rng: random.Random) -> str:
    """A page whose elements say in data-y whether they are content."""
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiouéü") for _ in range(rng.randint(1, 4)))

    def words(n: int) -> str:
        w = [word() for _ in range(n)]
        return " ".join([w[0].capitalize(), *w[1:]])

    def prose(low: int = 1, high: int = 6) -> str:
        text = " ".join(words(rng.randint(1, 22)) + rng.choice("....!?") for _ in range(rng.randint(low, high)))
        return text if rng.random() < 0.8 else text[:-1]  # cut off, verse, lists

    def inline(t: str) -> str:
        return t if rng.random() < 0.7 else f"<{(i := rng.choice('b i em strong a'.split()))}{' href=x' * (i == 'a')}>{t[: len(t) // 3]}</{i}>{t[len(t) // 3 :]}"

    def named(names: list[str], never: float = 0.1) -> str:
        return "" if rng.random() < never else f' {rng.choice(("class", "class", "id"))}="{rng.choice(names)}"'

    def noise(kind: str) -> str:
        tag = rng.choice(NOISE_TAGS[kind])
        bare = tag in ("nav", "header", "footer", "form", "aside")
        open_ = f'<{tag} data-y="0"{named(NOISE[kind], 0.6 if bare else 0.0)}>'
        item = lambda: f'<a href="/{word()}">{words(rng.randint(1, 3))}</a>'
        if kind == "nav":
            inner = "<ul>" * (tag != "ul") + "".join(f"<li>{item()}</li>" for _ in range(rng.randint(2, 9))) + "</ul>" * (tag != "ul")
        elif kind == "header":
            inner = rng.choice((f"<h1>{words(2)}</h1>", f"<div>{item()}</div>", f"<p>{words(4)}</p>", words(3)))
        elif kind == "footer":
            inner = rng.choice((f"&copy; {words(3)} &middot; {prose(1, 2)}", f"<p>{prose(1, 2)}</p>", f"<p>{item()} | {item()}</p>", f"<ul><li>{item()}</li><li>{item()}</li></ul>"))
        elif kind == "aside":
            inner = f"<h3>{words(2)}</h3>" * (rng.random() < 0.5) + rng.choice(("<ul>" + "".join(f"<li>{item()}</li>" for _ in range(rng.randint(2, 6))) + "</ul>", f"<p>{prose(1, 3)}</p>", prose(1, 2), f"<div>{item()}</div><p>{prose(1, 1)}</p>"))
        elif kind == "form":
            inner = f"<label>{words(2)}</label><input name=q>" + f"<p>{prose(1, 1)}</p>" * (rng.random() < 0.6) + "<button>Go</button>"
        elif kind == "comments":
            each = rng.choice(("li", "div", "p", "div", "p", "article"))
            inner = f"<h2>{words(2)}</h2>" * (rng.random() < 0.6) + "".join(f'<{each}{named(["comment", "reply", "comment-body"], 0.5)}>' + (f"<p>{prose(1, 4)}</p>" if each != "p" else prose(1, 3)) + f"</{each}>" for _ in range(rng.randint(1, 5)))
        else:
            inner = rng.choice((prose(1, 2), f"<p>{prose(1, 2)}</p>", f"<p>{prose(1, 1)} {item()}</p>", item()))
        return f"{open_}{inner}</{tag}>"

    def article() -> str:
        parts = [f"<h1>{words(rng.randint(2, 10))}{rng.choice(('', '.'))}</h1>"] * (rng.random() < 0.85)
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 14))):
            kind = rng.random()
            if kind < 0.68:
                parts.append(rng.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>")).format(inline(prose())))
            elif kind < 0.78:
                parts.append(f"<h{(h := rng.choice('234'))}>{words(rng.randint(1, 6))}</h{h}>")
            elif kind < 0.86:
                tag = rng.choice(("ul", "ol"))
                parts.append(f"<{tag}>" + "".join(f"<li>{inline(prose(1, 1) if rng.random() < 0.6 else words(rng.randint(1, 6)))}</li>" for _ in range(rng.randint(2, 6))) + f"</{tag}>")
            elif kind < 0.9:
                parts.append(f"<blockquote>{rng.choice(('<p>{}</p>', '{}')).format(prose(1, 3))}</blockquote>")
            elif kind < 0.93:
                parts.append(f"<pre>{words(8)}</pre>" if rng.random() < 0.5 else f"<figure><img src=x><figcaption>{words(6)}</figcaption></figure>")
            elif kind < 0.95:
                parts.append("<table>" + "".join(f"<tr><td>{words(2)}</td><td>{words(3)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            else:
                parts.append(noise(rng.choice(("ad", "aside", "form", "notice"))))
        return "".join(parts)

    body: list[str] = []
    for kind, share in (("notice", 0.25), ("header", 0.5), ("nav", 0.8), ("ad", 0.5)):
        if rng.random() < share:
            body.append(noise(kind))
    rng.shuffle(body)
    tag, never = rng.choice((("article", 0.7), ("article", 0.7), ("article", 0.7), ("main", 0.7), ("div", 0.15), ("section", 0.2), ("td", 0.8), ("", 1)))
    main = article()
    if tag:
        main = f'<{tag} data-y="1"{named(CONTENT_NAMES, never)}>{main}{noise("comments") if rng.random() < 0.15 else ""}</{tag}>'
        if tag == "td":
            main = f'<table data-y="1"><tr>{main}</tr></table>'
    else:
        main = re.sub(r"<(\w+)>", r'<\1 data-y="1">', main)
    after = [noise(kind) for kind, share in (("comments", 0.4), ("aside", 0.5), ("ad", 0.3), ("form", 0.25), ("nav", 0.15)) if rng.random() < share]
    rng.shuffle(after)
    if rng.random() < 0.3:
        after.insert(0, noise("aside"))
        after.append(noise("aside"))
    body += [main, *after]
    if rng.random() < 0.85:
        body.append(noise("footer"))
    inner = "".join(body)
    if rng.random() < 0.35:
        inner = f'<div{named(["wrapper", "container", "page", "layout", "site"], 0.3)}>{inner}</div>'
    return f"<html><head><title>{words(3)}</title></head><body>{inner}</body></html>" if rng.random() < 0.93 else inner


def labelled_nodes(page: str) -> tuple[list[int], list[int], list[tuple[int, ...]], list[int]]:
    root, blocks = parse(page, "data-y")
    nodes = in_order(root)
    place = {id(n): k for k, n in enumerate(nodes)}
    labels: list[int] = []
    for n in nodes:
        labels.append(n.label if n.label is not None else 0 if n.parent is None else labels[place[id(n.parent)]])
    return [-1 if n.parent is None else place[id(n.parent)] for n in nodes], [*map(edge_kind, nodes)], features(nodes, blocks), labels


@cache
def trained(pages: int = 800, seed: int = 5) -> TreeModel:
    rng = random.Random(seed)
    return TreeModel().fit([labelled_nodes(labelled_page(rng)) for _ in range(pages)])


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of pages."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def make():
        text = shared.value.text

        def run(ids, urls, htmls):
            texts = [text(h) for h in htmls]
            return ids, urls, texts, [len(t) for t in texts]

        return run

    return map_columns(pages.select("page_id", "url", "html"), "page_id long, url string, text string, n_chars long", make)
