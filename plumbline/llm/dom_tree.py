"""Main text of web pages by a tree-structured graphical model over the DOM.

A page becomes a tree of block elements whose leaves are its text blocks (runs of inline content; <br> ends a run). Every
node has a hidden state, content or not. Its own potential comes from its tag, the words of its class, id and role, its length, its share of
the page's text and of linked text; a potential on each edge ties a child to its parent. Sum-product messages up and down the tree
give each node's marginal, all pages of a batch at once, level by level. Parameters are fitted by exact gradients of the
likelihood (observed minus expected counts, from the same messages) on labelled pages: (html, main text) pairs, in which
a leaf is content if its block is a line of the text, and an element if it holds such a leaf.

No page labels come with the driver's tables; labelled_pages() writes pages of many layouts whose text is known.

Defined cases: null, empty or tag-free html gives the text that there is (empty if none); unclosed, misnested and cut tags are
repaired as browsers do in the common cases, in time that grows with the page; very long pages are read whole; a node whose marginal is
a half exactly is content; repeated rows are each extracted; an empty table gives no rows. extract() keeps other columns, a column
`text` of the pages gives way to its own; the query reads page_id, url and html alone.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import begin, table, trim

# fixed values: HTML's element classes
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template textarea title iframe object svg math select datalist audio video canvas head button".split())
RAW = set("script style textarea title iframe noscript template svg math xmp".split())
BLOCK = set(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption nav header footer aside form fieldset "
    "blockquote pre figure figcaption address details summary dialog center hgroup menu search label".split()
)
ENDS_P = BLOCK - set("html body label".split())
SELF_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": set("ul ol menu".split()), "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "thead", "tbody", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

# words in class, id and role that the model may weigh; it learns what they mean
GROUPS = (
    "article|post|entry|story|blog|news|hentry|main|prose", "content|body|text|page|copy", "title|headline|heading|subtitle|lead|intro|summary",
    "nav|navbar|navigation|menu|breadcrumb|breadcrumbs|pagination|pager|toc|tabs", "header|masthead|top|topbar|banner|logo|hero|branding|site", "footer|foot|bottom|copyright|legal|colophon|contentinfo",
    "sidebar|aside|side|rail|widget|complementary|related|recommended|recommendations|more|popular|trending|teaser|teasers", "ad|ads|advert|advertisement|sponsor|sponsored|promo|promotion|adsense|banner|commercial|dfp",
    "cookie|cookies|consent|gdpr|notice|notification|alert|popup|modal|overlay|dialog|privacy|warning|message|paywall", "comment|comments|reply|replies|respond|discussion|disqus|thread|feedback|reviews|response|responses",
    "form|search|login|signin|signup|subscribe|subscription|newsletter|register|contact|poll|survey", "share|sharing|social|follow|tags|tag|meta|byline|author|date|rating|tools|print", "caption|figure|image|photo|gallery|media|credit", "wrapper|wrap|container|row|col|grid|inner|outer|layout|section|block|box",
)
_WORDS = {w: [k for k, g in enumerate(GROUPS) if w in g.split("|")] for g in GROUPS for w in g.split("|")}
TAGS = sorted(BLOCK)
LENGTHS, LINKS, MARKS, SHARES = 12, 5, 4, 6
N_TAG, N_GROUP = len(TAGS), len(GROUPS)
N_ELEMENT = N_TAG + N_GROUP + LENGTHS + LINKS + SHARES + 1
N_LEAF = LENGTHS + LINKS + MARKS + N_TAG + SHARES + 1
N_UNARY = N_ELEMENT + N_LEAF

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


@functools.lru_cache(maxsize=50_000)
def _groups(attrs: str) -> tuple[int, ...]:
    found = set()
    for m in _ATTR.finditer(attrs):
        for w in re.findall(r"[a-z]+|[A-Z][a-z]*", m[2] or m[3] or m[4] or ""):
            found.update(_WORDS.get(w.lower(), ()))
    return tuple(sorted(found))


class Page:
    """parent, tag and class words of each node; a leaf has tag -1, its text and how much of it is linked."""

    __slots__ = ("parent", "tag", "groups", "text", "linked")

    def __init__(self, html: str):
        self.parent, self.tag, self.groups, self.text, self.linked = [-1], [TAGS.index("html")], [()], [None], [0]
        self._parse(html)

    def _leaf(self, pieces: list[str], linked: int, at: int) -> None:
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text:
            self.parent.append(at)
            self.tag.append(-1)
            self.groups.append(())
            self.text.append(text)
            self.linked.append(min(linked, len(text)))

    def _parse(self, html: str) -> None:
        stack = [("html", 0)]  # open block elements
        opened: dict[str, int] = {}  # how many of each are open, so that an end tag without its element costs nothing
        pieces, linked, in_link, at, hidden, under = [], 0, 0, 0, 0, 0  # under: the stack's height where hiding began
        name_of = {t: k for k, t in enumerate(TAGS)}
        n = len(html)

        def close_from(k):
            """The elements from place k of the stack end, and with them what hides within them."""
            nonlocal hidden
            for name, _ in stack[k:]:
                opened[name] -= 1
            del stack[k:]
            if len(stack) < under:
                hidden = 0

        def flush():
            nonlocal pieces, linked
            if pieces:
                self._leaf(pieces, linked, stack[-1][1])
                pieces, linked = [], 0

        while at < n:
            m = _TOKEN.search(html, at)
            start = m.start() if m else n
            if start > at and not hidden:
                pieces.append(html[at:start])
                if in_link:
                    linked += start - at
            if not m:
                break
            at = m.end()
            close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if tag in RAW:
                if not close and not attrs.endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                    at = end.end() if end else n
                continue
            if tag in HIDDEN:
                if not attrs.endswith("/"):
                    under = under if hidden else len(stack)
                    hidden = max(0, hidden + (-1 if close else 1))
                continue
            if hidden and tag in ("body", "article", "main", "div", "p"):
                hidden = 0  # an element that can't stand in a hidden one ends it
            if tag == "br" or tag == "hr":
                flush()
                continue
            if tag == "a":
                in_link = 0 if close else 1
                continue
            if tag in VOID or tag not in BLOCK:
                continue
            flush()
            in_link = 0
            if close:
                if opened.get(tag):
                    close_from(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
                continue
            if tag == "html":
                continue
            if tag in ENDS_P and opened.get("p"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        close_from(k)
                        break
                    if stack[k][0] in ("div", "td", "th", "li", "blockquote", "article", "section"):
                        break
            if tag in SELF_END and any(map(opened.get, SELF_END[tag])):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in SELF_END[tag]:
                        close_from(k)
                        break
                    if stack[k][0] in HOLDS.get(tag, ()):
                        break
            self.parent.append(stack[-1][1])
            self.tag.append(name_of[tag])
            self.groups.append(_groups(attrs) if attrs else ())
            self.text.append(None)
            self.linked.append(0)
            if not attrs.endswith("/"):
                stack.append((tag, len(self.parent) - 1))
                opened[tag] = opened.get(tag, 0) + 1
        flush()


class Forest:
    """The nodes of many pages in arrays, by depth, with their features."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.parent) for p in pages]
        base = np.cumsum([0, *sizes[:-1]]) if pages else np.zeros(0, int)
        self.first, self.n = base, sum(sizes)
        parent = np.concatenate([np.array(p.parent) + b for p, b in zip(pages, base, strict=True)])
        parent[base] = -1
        tag = np.concatenate([p.tag for p in pages])
        self.parent, self.leaf = parent, tag < 0
        text = [t for p in pages for t in p.text]
        length = np.array([len(t) if t else 0 for t in text], dtype=float)
        linked = np.concatenate([p.linked for p in pages]).astype(float)
        depth = np.zeros(self.n, dtype=int)
        for k in range(self.n):  # a parent stands before its children
            if parent[k] >= 0:
                depth[k] = depth[parent[k]] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)] if self.n < 4000 else np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1])
        own = length.copy()
        for level in self.levels[:0:-1]:
            np.add.at(length, parent[level], length[level])
            np.add.at(linked, parent[level], linked[level])
        whole = np.repeat(length[base], sizes)
        share = np.minimum((length / np.maximum(whole, 1) * (SHARES - 1)).astype(int), SHARES - 1)  # of the page's text; the last is all of it
        rows, cols = [], []

        def add(where, column):
            rows.append(where)
            cols.append(column)

        el, lf = np.flatnonzero(~self.leaf), np.flatnonzero(self.leaf)
        size = np.minimum(np.log2(length + 1).astype(int), LENGTHS - 1)
        link = np.minimum((linked / np.maximum(length, 1) * LINKS).astype(int), LINKS - 1)
        add(el, tag[el])
        add(el, N_TAG + N_GROUP + size[el])
        add(el, N_TAG + N_GROUP + LENGTHS + link[el])
        add(el, N_TAG + N_GROUP + LENGTHS + LINKS + share[el])
        add(el, np.full(len(el), N_ELEMENT - 1))
        groups = [g for p in pages for g in p.groups]
        add(np.repeat(np.arange(self.n), [len(g) for g in groups]), np.array([N_TAG + k for g in groups for k in g], dtype=int))
        add(lf, N_ELEMENT + np.minimum(np.log2(own[lf] + 1).astype(int), LENGTHS - 1))
        add(lf, N_ELEMENT + LENGTHS + link[lf])
        add(lf, N_ELEMENT + LENGTHS + LINKS + MARKS + tag[parent[lf]])
        add(lf, N_ELEMENT + LENGTHS + LINKS + MARKS + N_TAG + share[lf])
        add(lf, np.full(len(lf), N_UNARY - 1))
        marks = [(k, m) for k in lf for m in _marks(text[k])]
        add(np.array([k for k, _ in marks], dtype=int), np.array([N_ELEMENT + LENGTHS + LINKS + m for _, m in marks], dtype=int))
        self.rows, self.cols = np.concatenate(rows), np.concatenate(cols)

    def messages(self, unary: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginal of content of every node, joint of (parent, child) states of every edge, log partition of each tree.

        unary: log potential of content against not. edge[kind, parent state, child state]; kind 1 for leaves.
        """
        kind = self.leaf.astype(int)
        up = np.zeros((self.n, 2))  # log potential of a node's subtree by its state
        up[:, 1] = unary
        sent = np.zeros((self.n, 2))  # its message to its parent, by the parent's state
        for level in self.levels[:0:-1]:
            sent[level] = np.logaddexp(edge[kind[level], :, 0] + up[level, :1], edge[kind[level], :, 1] + up[level, 1:])
            np.add.at(up, self.parent[level], sent[level])
        down = np.zeros((self.n, 2))
        joint = np.zeros((self.n, 2, 2))
        for level in self.levels[1:]:
            above = down[self.parent[level]] + up[self.parent[level]] - sent[level]
            both = above[:, :, None] + edge[kind[level]] + up[level][:, None, :]
            both -= both.max(axis=(1, 2), keepdims=True)
            p = np.exp(both)
            joint[level] = p / p.sum(axis=(1, 2), keepdims=True)
            down[level] = np.logaddexp(above[:, 0, None] + edge[kind[level], 0], above[:, 1, None] + edge[kind[level], 1])
            down[level] -= down[level].max(axis=1, keepdims=True)
        total = up + down
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -40, 40))), joint, np.logaddexp(up[self.first, 0], up[self.first, 1])


def _marks(text: str):
    if text[-1] in ".!?\"'”’:…":
        yield 0
    if text.count(",") + text.count(".") >= 2:
        yield 1
    if "©" in text[:40] or "rights reserved" in text[:200].lower():
        yield 2
    if text.count(" ") < 2:
        yield 3


class Model:
    def __init__(self, unary: np.ndarray, edge: np.ndarray):
        self.unary, self.edge = unary, edge

    def potentials(self, forest: Forest) -> np.ndarray:
        return np.bincount(forest.rows, weights=self.unary[forest.cols], minlength=forest.n)

    def texts(self, pages: list[str]) -> list[str]:
        trees = [Page(p) for p in pages]
        if not trees:
            return []
        forest = Forest(trees)
        content, _, _ = forest.messages(self.potentials(forest), self.edge)
        out = []
        for tree, at in zip(trees, forest.first, strict=True):
            out.append("\n".join(t for k, t in enumerate(tree.text) if t is not None and content[at + k] >= 0.5))
        return out


def train(labelled: list[tuple[str, str]], steps: int = 120, rate: float = 0.25, decay: float = 2e-3) -> Model:
    """Fit potentials on (html, main text) pairs by Adam over exact gradients."""
    trees = [Page(h) for h, _ in labelled]
    forest = Forest(trees)
    y = np.zeros(forest.n)
    for tree, (_, text), at in zip(trees, labelled, forest.first, strict=True):
        lines = set(text.split("\n"))
        for k, t in enumerate(tree.text):
            if t is not None and t in lines:
                y[at + k] = 1
    for level in forest.levels[:0:-1]:
        np.maximum.at(y, forest.parent[level], y[level])
    child = np.flatnonzero(forest.parent >= 0)
    kind, up_state, state = forest.leaf[child].astype(int), y[forest.parent[child]].astype(int), y[child].astype(int)
    seen_edge = np.zeros((2, 2, 2))
    np.add.at(seen_edge, (kind, up_state, state), 1)
    seen = np.bincount(forest.cols, weights=y[forest.rows], minlength=N_UNARY)
    theta = np.zeros(N_UNARY + 8)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        model = Model(theta[:N_UNARY], theta[N_UNARY:].reshape(2, 2, 2))
        p, joint, _ = forest.messages(model.potentials(forest), model.edge)
        wanted_edge = np.zeros((2, 2, 2))
        np.add.at(wanted_edge, kind, joint[child])
        grad = np.concatenate([seen - np.bincount(forest.cols, weights=p[forest.rows], minlength=N_UNARY), (seen_edge - wanted_edge).ravel()]) / len(labelled) - decay * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        theta = theta + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return Model(theta[:N_UNARY].copy(), theta[N_UNARY:].reshape(2, 2, 2).copy())


# --- labelled pages ----------------------------------------------------------------------------------------------------


def labelled_pages(n: int = 600, seed: int = 11) -> list[tuple[str, str]]:
    """Pages of varied layout with their main text."""
    rng = random.Random(seed)
    return [_written_page(rng) for _ in range(n)]


_SYLLABLES = "an be cor dil est for gan hes in jor kel lin mar nos or pel qui ran sol tur um ver wen xi yor za über ción eau ñar".split()


def _word(rng) -> str:
    return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))


def _sentence(rng, least: int = 1, most: int = 22) -> str:
    words = [_word(rng) for _ in range(rng.randint(least, most))]
    return " ".join(w + ("," if rng.random() < 0.08 else "") for w in words).capitalize() + rng.choice("....!?")


def _prose(rng) -> str:
    if rng.random() < 0.2:
        return _sentence(rng, 1, 4)
    if rng.random() < 0.08:
        return " | ".join(_word(rng) for _ in range(rng.randint(3, 30)))
    return " ".join(_sentence(rng, 3) for _ in range(rng.randint(1, 9)))


def _links(rng, k: int, item: str = "li") -> str:
    return "".join(f'<{item}><a href="/{_word(rng)}">{" ".join(_word(rng).title() for _ in range(rng.randint(1, 4)))}</a></{item}>' for _ in range(k))


def _named(rng, tag: str, names: str) -> str:
    """An open tag, plain or with a class or id of the given names."""
    name = rng.choice(names.split())
    name = rng.choice([name, f"{name}-{_word(rng)}", f"site-{name}", f"{name} clearfix", f"js-{name}"])
    return rng.choice([f'<{tag} class="{name}">', f'<{tag} id="{name}">', f"<{tag} class='{name}'>"])


def _written_page(rng) -> tuple[str, str]:
    lines: list[str] = []

    def say(text: str) -> str:
        lines.append(" ".join(text.split()))
        return entities.escape(text, quote=False)

    def element(tag: str, names: str, inner: str, plain: float = 0.4) -> str:
        """Semantic tag, or a div that only its name tells."""
        if rng.random() < 0.5:
            return (f"<{tag}>" if rng.random() < plain else _named(rng, tag, names)) + inner + f"</{tag}>"
        return _named(rng, "div", names) + inner + "</div>"

    def noise(kind: str) -> str:
        if kind == "nav":
            return element("nav", "nav navbar menu navigation breadcrumbs", rng.choice(["<ul>", "<ol>", "<div>"]) + _links(rng, rng.randint(2, 9), rng.choice(["li", "span", "li"])) + rng.choice(["</ul>", ""]))
        if kind == "header":
            return element("header", "header masthead topbar banner", f"<{rng.choice(['h1', 'h2', 'p', 'div'])}><a href='/'>{_word(rng).title()}</a>" + (f"<p>{_sentence(rng, 2, 7)}</p>" if rng.random() < 0.4 else ""))
        if kind == "footer":
            return element("footer", "footer copyright colophon bottom", rng.choice(["&copy; ", "© 2020 ", "", "Copyright "]) + f"{_word(rng)}.com &middot; {_sentence(rng)}" + (f"<p>{_sentence(rng)}</p>" if rng.random() < 0.4 else "") + (f"<ul>{_links(rng, 3)}</ul>" if rng.random() < 0.4 else ""))
        if kind == "aside":
            return element("aside", "sidebar related recommended widget rail popular", f"<h3>{_sentence(rng, 1, 4)}</h3><ul>{_links(rng, rng.randint(2, 7))}</ul>" + (f"<p>{_prose(rng)}</p>" if rng.random() < 0.5 else ""))
        if kind == "ad":
            tag = rng.choice(["div", "div", "section", "aside"])
            return _named(rng, tag, "ad ads advert advertisement sponsored promo") + rng.choice([_sentence(rng), f"<p>{_prose(rng)}</p>", f"<a href='#'>{_sentence(rng)}</a>"]) + f"</{tag}>"
        if kind == "notice":
            tag = rng.choice(["div", "section", "dialog"])
            return _named(rng, tag, "cookie-notice consent notice alert popup gdpr modal cookie-banner") + f"<p>{_prose(rng)}</p><button>OK</button></{tag}>"
        if kind == "form":
            return f"<form{rng.choice(['', ' class=newsletter', ' id=search', ' class=login-form'])}><label>{_sentence(rng, 1, 4)}</label><input name=q><p>{_sentence(rng)}</p><button>{_word(rng)}</button></form>"
        if kind == "comments":
            tag = rng.choice(["li", "div", "article"])
            items = "".join(f"<{tag} class='{rng.choice(['comment', 'reply', 'comment-body'])}'><p>{_prose(rng)}</p></{tag}>" for _ in range(rng.randint(1, 6)))
            return element("section", "comments discussion responses disqus_thread replies", f"<h3>{rng.randint(1, 30)} {_word(rng)}</h3>{items}", plain=0.0)
        if kind == "share":
            return _named(rng, "div", "share social tags meta tools") + _links(rng, rng.randint(1, 5), "span") + "</div>"
        return "<script>var t=\"</p>\";</script><style>p{margin:0}</style><!-- " + _word(rng) + " -->"

    def block() -> str:
        roll = rng.random()
        if roll < 0.62:
            text, tag = _prose(rng), rng.choice(["p", "p", "p", "p", "p", "div"])
            shape = rng.random()
            if shape < 0.15:
                return f"<{tag}><b>{say(text)}<br><p>{say(_prose(rng))}</p>"
            if shape < 0.35:
                a, _, b = text.partition(" ")
                lines.append(" ".join(text.split()))
                return f"<{tag}>{entities.escape(a, False)} <a href='#'>{entities.escape(b[: len(b) // 6], False)}</a>{entities.escape(b[len(b) // 6 :], False)}</{tag}>"
            return f"<{tag}>{say(text)}" + (f"</{tag}>" if rng.random() < 0.85 else "")
        if roll < 0.74:
            tag = rng.choice(["h2", "h3", "h4"])
            return f"<{tag}>{say(_sentence(rng, 1, 7))}</{tag}>"
        if roll < 0.83:
            tag = rng.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{say(_sentence(rng))}" + rng.choice(["</li>", ""]) for _ in range(rng.randint(2, 5))) + f"</{tag}>"
        if roll < 0.88:
            return f"<blockquote><p>{say(_prose(rng))}</p></blockquote>"
        if roll < 0.92:
            return f"<pre>{say(_sentence(rng))}</pre>"
        if roll < 0.96:
            return "<table>" + "".join(f"<tr><td>{say(_sentence(rng, 1, 3))}</td><td>{say(_sentence(rng, 1, 3))}</td></tr>" for _ in range(rng.randint(1, 3))) + "</table>"
        return f"<figure><img src=x><figcaption>{say(_sentence(rng))}</figcaption></figure>"

    kinds = ["nav", "header", "footer", "aside", "ad", "notice", "form", "comments", "share", "script"]
    before = [noise(k) for k in kinds if k in ("nav", "header", "ad", "notice", "script", "form", "share", "aside") and rng.random() < 0.4]
    rng.shuffle(before)
    body = [f"<h1>{say(_sentence(rng, 2, 10))}</h1>"] if rng.random() < 0.8 else []
    for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14])):
        body.append(block())
        if rng.random() < 0.1:
            body.append(noise(rng.choice(["ad", "aside", "share", "form", "notice", "script"])))
    inside = "".join(body) + (noise("comments") if rng.random() < 0.2 else "") + (noise("share") if rng.random() < 0.2 else "")
    shape = rng.random()
    if shape < 0.45:
        main = "<article" + rng.choice(["", "", " class='post'", " id=story"]) + f">{inside}</article>"
    elif shape < 0.6:
        main = f"<main>{inside}</main>"
    elif shape < 0.92:
        main = _named(rng, "div", "content article post entry story main article-body post-content entry-content") + inside + "</div>"
    else:
        main = f"<div>{inside}</div>"
    after = [noise(k) for k in kinds if k in ("footer", "aside", "ad", "comments", "form", "nav", "notice", "share") and rng.random() < 0.4]
    rng.shuffle(after)
    for _ in range(rng.choice([0, 0, 0, 1, 2, 4])):  # wrappers that say nothing
        tag = rng.choice(["div", "div", "section"])
        main = f"<{tag}>" + main + (after.pop() if after and rng.random() < 0.2 else "") + f"</{tag}>"
    if rng.random() < 0.1:  # bare pages
        before, after = [], []
    if rng.random() < 0.3:
        main = _named(rng, "div", "wrapper container page layout") + main + (after.pop() if after else "") + "</div>"
    html = f"<!DOCTYPE html><html><head><title>{_sentence(rng)}</title></head><body>{''.join(before)}{main}{''.join(after)}" + ("</body></html>" if rng.random() < 0.8 else "")
    return html, "\n".join(lines)


@functools.cache
def default_model() -> Model:
    return train(labelled_pages())


# --- Spark ----------------------------------------------------------------------------------------------------------


def extract(pages: DataFrame, model: Model | None = None, html: str = "html") -> DataFrame:
    """pages with a column text: the main text of each page."""
    model = model or default_model()
    unary, edge = model.unary, model.edge
    from collections.abc import Iterator

    import pyarrow as pa

    def run(columns):
        begin("dom tree")
        m = Model(unary, edge)
        for column in columns:
            out, held, size = [], [], 0
            for h in column:
                held.append(h.as_py() or "")
                size += len(held[-1])
                if size > 1 << 20 or len(held) >= 256:
                    out += m.texts(held)
                    held, size = [], 0
            yield pa.array(out + m.texts(held), pa.string())
        trim()

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return pages.withColumn("text", F.arrow_udf(run, "string")(F.col(html)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
