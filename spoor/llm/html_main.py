"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

A page becomes a tree of block elements; its leaves are stretches of inline text. Boosted
trees give every node the chances that its text is all boilerplate, all article, or mixed.
Decoding takes the most likely labels of the whole tree under which everything below a
boilerplate node is boilerplate and everything below an article node is article.

The trees learn from pages made here: regions of many layouts, with telling or meaningless
names, filled with text that is sampled from the pages at hand.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.boosting import Boosted

DROP, MIXED, KEEP = 0, 1, 2
# the bounds of what training reads and makes
TRAIN_PAGES, TRAIN_TEXTS, MADE_PAGES = 60, 2000, 500

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
# fixed values of the markup language
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math",
       "object", "select", "button", "datalist", "canvas", "audio", "video", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn",
          "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp",
          "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
          "img", "input", "picture"}
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
TAGS = ("html", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "h4", "ul", "ol",
        "li", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre",
        "figure", "figcaption", "dl", "fieldset", "address", "dialog")
TOKENS = ("article", "content", "post", "entry", "story", "main", "body", "text", "nav", "menu",
          "header", "head", "footer", "foot", "sidebar", "side", "aside", "ad", "advert", "sponsor",
          "promo", "cookie", "consent", "notice", "banner", "alert", "comment", "reply", "discussion",
          "respond", "form", "subscribe", "newsletter", "login", "search", "share", "social",
          "related", "recommend", "breadcrumb", "widget", "popup", "modal", "copyright", "legal",
          "tag", "toolbar", "pagination", "meta", "author")
FLAG = {name: i for i, name in enumerate([*("<" + t for t in TAGS), *TOKENS])}
NUMBERS = 22


class Node:
    __slots__ = ("tag", "flags", "parent", "kids", "text", "linked", "controls", "order")

    def __init__(self, tag, flags, parent):
        self.tag, self.flags, self.parent = tag, flags, parent
        self.kids: list[Node] = []
        self.text: list[str] | None = None
        self.linked = self.controls = self.order = 0


def flags_of(tag: str, attributes: str) -> frozenset[int]:
    """The tag and the known words of class, id and role."""
    found = {FLAG["<" + tag]} if "<" + tag in FLAG else set()
    if attributes and "=" in attributes:
        for m in re.finditer(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", attributes, re.I):
            value = re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1])
            for word in re.findall(r"[a-z]+", value.lower()):
                for w in (word, word[:-1] if word.endswith("s") else word):
                    if w in FLAG:
                        found.add(FLAG[w])
    return frozenset(found)


def parse(page: str | None) -> Node:
    """The tree of block elements; leaves hold text, an element with one leaf only is it."""
    root = Node("#root", frozenset(), None)
    here, leaf, links = root, None, 0
    stack: list[tuple[str, Node]] = []  # every open element with its block node
    page = page or ""
    at, skip = 0, None

    def put(raw: str) -> None:
        nonlocal leaf
        if not raw or (leaf is None and raw.isspace()):
            return
        if leaf is None:
            leaf = Node("#text", frozenset(), here)
            leaf.text = []
            here.kids.append(leaf)
        leaf.text.append(raw)
        if links:
            leaf.linked += len(raw.strip())

    def pop(n: int) -> None:
        nonlocal here, leaf, links
        while len(stack) > n:
            tag, node = stack.pop()
            if tag == "a":
                links -= 1
            if tag not in INLINE:
                here, leaf = node.parent, None

    while at < len(page):
        m = MARKUP.search(page, at)
        put(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == tag:
                    pop(n)
                    break
            else:
                if tag == "p" or tag == "br":
                    leaf = None
            continue
        if tag == "head":
            skip = re.compile(r"</head\s*>|(?=<body\b)", re.I).search(page, at)
            at = skip.end() if skip else at
            continue
        if tag in RAW:
            skip = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = skip.end() if skip else len(page)
            if tag in ("button", "select", "textarea"):
                here.controls += 1
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                leaf = None
            elif tag == "input":
                here.controls += 1
            continue
        if tag not in INLINE:
            # an open paragraph ends at the next block, an open item at the next item
            for n in range(len(stack) - 1, -1, -1):
                name = stack[n][0]
                if name == "p":
                    pop(n)
                    break
                if name not in INLINE:
                    break
            if tag in CLOSES:
                ends, bounds = CLOSES[tag]
                for n in range(len(stack) - 1, -1, -1):
                    if stack[n][0] in bounds:
                        break
                    if stack[n][0] in ends:
                        pop(n)
                        break
            node = Node(tag, flags_of(tag, m[3]), here)
            here.kids.append(node)
            here, leaf = node, None
            stack.append((tag, node))
        elif not m[3].rstrip().endswith("/"):
            stack.append((tag, here))
            if tag == "a":
                links += 1
    return root


def listed(root: Node) -> list[Node]:
    """All nodes with text below, in page order, lone leaves folded into their element."""
    out: list[Node] = []
    todo = [root]
    while todo:  # children before parents is not needed here
        node = todo.pop()
        if len(node.kids) == 1 and node.kids[0].text is not None:
            node.text, node.linked, node.kids = node.kids[0].text, node.kids[0].linked, []
        out.append(node)
        todo.extend(reversed(node.kids))
    full = {}
    for node in reversed(out):
        own = node.text is not None and not "".join(node.text).isspace()
        full[node] = own or any(full[k] for k in node.kids)
        node.kids = [k for k in node.kids if full[k]]
    return [n for n in out if full[n]]


def clean(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def features(nodes: list[Node]) -> tuple[np.ndarray, list[str]]:
    """Feature rows of the nodes of a page, and the clean text of each leaf."""
    n = len(nodes)
    texts = [clean(x.text) if x.text is not None else "" for x in nodes]
    place = {x: i for i, x in enumerate(nodes)}
    size, words, marks, linked, odd = (np.zeros(n) for _ in range(5))
    leaves, tags, controls = np.zeros(n), np.ones(n), np.zeros(n)
    depth = np.zeros(n)
    for i, (x, t) in enumerate(zip(nodes, texts)):
        depth[i] = depth[place[x.parent]] + 1 if x.parent in place else 0
        controls[i] = x.controls
        if x.text is not None:
            size[i], words[i], leaves[i] = len(t), t.count(" ") + 1, 1
            marks[i] = t.count(".") + t.count(",") + t.count(";") + t.count("?") + t.count("!")
            linked[i] = min(x.linked, len(t))
            odd[i] = sum(map(str.isdigit, t)) + t.count("|") + t.count("©")
    for i in range(n - 1, 0, -1):
        up = place[nodes[i].parent]
        for a in (size, words, marks, linked, odd, leaves, tags, controls):
            a[up] += a[i]
    starts = np.zeros(n)
    run = 0.0
    for i, x in enumerate(nodes):
        starts[i] = run
        if x.text is not None:
            run += size[i]
    up = np.array([place[x.parent] if x.parent in place else 0 for x in nodes])
    index, count, same = np.zeros(n), np.ones(n), np.ones(n)
    left, right = np.zeros(n), np.zeros(n)
    for x in nodes:
        kinds: dict[str, int] = {}
        for k in x.kids:
            kinds[k.tag] = kinds.get(k.tag, 0) + 1
        for j, k in enumerate(x.kids):
            i = place[k]
            index[i], count[i], same[i] = j, len(x.kids), kinds[k.tag] / len(x.kids)
            left[i] = size[place[x.kids[j - 1]]] if j else 0
            right[i] = size[place[x.kids[j + 1]]] if j + 1 < len(x.kids) else 0
    log, whole = np.log1p, max(1.0, size[0] if n else 1.0)
    safe, some = np.maximum(size, 1), np.maximum(words, 1)
    x = np.zeros((n, NUMBERS + 2 * len(FLAG)), np.float32)
    x[:, :NUMBERS] = np.stack(
        [
            depth, [float(v.text is not None) for v in nodes], log(size), log(words),
            linked / safe, marks / some, odd / safe, log(safe / np.maximum(leaves, 1)),
            log(leaves), size / whole, starts / whole, (starts + size) / whole,
            index / np.maximum(count - 1, 1), log(count), same, log(left), log(right),
            (linked / safe)[up], log(size)[up], log(safe / tags), log(controls),
            (marks / some)[up],
        ],
        axis=1,
    ) if n else 0
    above: list[frozenset[int]] = []
    for i, v in enumerate(nodes):
        parent = frozenset() if i == 0 else above[up[i]] | nodes[up[i]].flags
        above.append(parent)
        for f in v.flags:
            x[i, NUMBERS + f] = 1
        for f in parent:
            x[i, NUMBERS + len(FLAG) + f] = 1
    return x, texts


def decode(nodes: list[Node], log_p: np.ndarray) -> list[bool]:
    """Which leaves are article, under labels that no ancestor contradicts."""
    place = {x: i for i, x in enumerate(nodes)}
    drop, keep = log_p[:, DROP].copy(), log_p[:, KEEP].copy()
    best = np.zeros(len(nodes))
    for i in range(len(nodes) - 1, -1, -1):
        kids = [place[k] for k in nodes[i].kids]
        drop[i] += drop[kids].sum()
        keep[i] += keep[kids].sum()
        best[i] = max(drop[i], keep[i])
        if kids:
            best[i] = max(best[i], log_p[i, MIXED] + best[kids].sum())
    out, state = [False] * len(nodes), [MIXED] * len(nodes)
    for i, x in enumerate(nodes):
        forced = state[place[x.parent]] if x.parent in place else MIXED
        if forced != MIXED:
            state[i] = forced
        elif keep[i] >= best[i]:
            state[i] = KEEP
        elif drop[i] >= best[i]:
            state[i] = DROP
        out[i] = x.text is not None and state[i] == KEEP
    return out


def extract(pages: list[str | None], model: Boosted) -> list[str]:
    """The main text of each page, blocks joined by a line end; empty if there is none."""
    trees = [listed(parse(p)) for p in pages]
    made = [features(t) for t in trees]
    rows = np.concatenate([x for x, _ in made])
    log_p = model.log_p(rows) if len(rows) else np.zeros((0, 3))
    out, at = [], 0
    for nodes, (x, texts) in zip(trees, made):
        kept = decode(nodes, log_p[at : at + len(x)])
        at += len(x)
        out.append("\n".join(t for t, k in zip(texts, kept) if k and t))
    return out


class Maker:
    """Makes pages whose regions are known. Article text is marked by a wrapping sign."""

    SIGN = ""

    def __init__(self, texts: list[str], seed: int = 42):
        self.r = random.Random(seed)
        self.texts = texts or ["lorem ipsum dolor sit amet, consectetur adipiscing elit."]
        self.plain = False

    def words(self, low: int, high: int) -> str:
        out: list[str] = []
        want = self.r.randint(low, high)
        while len(out) < want:
            out += self.r.choice(self.texts).split() or ["x"]
        start = self.r.randint(0, len(out) - want)
        return html.escape(" ".join(out[start : start + want]), quote=False)

    def named(self, *names: str) -> str:
        """An attribute with one of the names, or a meaningless one, or none."""
        if self.plain:
            return self.r.choice(["", "", f' class="c{self.r.randint(1, 99)}"'])
        name = self.r.choice(names)
        extra = self.r.choice(["", "", "-wrap", "-box", "_area", "Section", " clearfix", "-1"])
        return f' {self.r.choice(["class", "class", "id"])}="{name}{extra}"'

    def links(self, n: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(n)]
        form = self.r.random()
        if form < 0.6:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return (" | " if form < 0.8 else " ").join(items)

    def box(self, tags: str, names: str, inner: str) -> str:
        tag = self.r.choice(tags.split())
        return f"<{tag}{self.named(*names.split())}>{inner}</{tag}>"

    def header(self) -> str:
        inner = self.r.choice(["", f"<h1>{self.words(1, 3)}</h1>", f"<a href='/'>{self.words(1, 2)}</a>"])
        inner += self.r.choice(["", f"<p>{self.words(2, 8)}</p>", self.links(self.r.randint(2, 6))])
        return self.box("header header div", "header masthead head site-header", inner or self.words(1, 4))

    def menu(self) -> str:
        return self.box("nav nav div", "nav menu navbar main-menu breadcrumb", self.links(self.r.randint(2, 9)))

    def advert(self) -> str:
        text = self.words(3, 30)
        return self.box("div div aside ins section", "ad ads advert ad-slot sponsor promo banner",
                        self.r.choice([text, f"<p>{text}</p>", f"<a href='/x'>{text}</a>"]))

    def notice(self) -> str:
        more = self.r.choice(["", "<button>OK</button>", "<a href='/p'>OK</a>"])
        return self.box("div div section dialog", "cookie cookie-notice consent notice alert banner popup",
                        f"<p>{self.words(4, 40)}</p>{more}" if self.r.random() < 0.7 else self.words(4, 30) + more)

    def sidebar(self) -> str:
        parts = []
        for _ in range(self.r.randint(1, 3)):
            parts.append(f"<h3>{self.words(1, 4)}</h3>" if self.r.random() < 0.7 else "")
            parts.append(self.r.choice([self.links(self.r.randint(2, 7)), f"<p>{self.words(5, 40)}</p>"]))
        return self.box("aside aside div", "sidebar side widget related recommend rail", "".join(parts))

    def form(self) -> str:
        parts = [f"<p>{self.words(2, 20)}</p>"] if self.r.random() < 0.6 else []
        for _ in range(self.r.randint(1, 3)):
            parts.append(f"<label>{self.words(1, 2)}</label><input name='a'>")
        parts.append(self.r.choice([f"<button>{self.words(1, 2)}</button>", "<input type='submit'>", ""]))
        tag = f"<form{self.named('form', 'subscribe', 'newsletter', 'login', 'search')}>{''.join(parts)}</form>"
        return self.r.choice([tag, self.box("div section", "newsletter subscribe signup form", tag)])

    def comments(self) -> str:
        parts = [f"<h3>{self.words(1, 3)}</h3>"] if self.r.random() < 0.7 else []
        item = self.r.choice(["li", "div", "div", "article"])
        for _ in range(self.r.randint(1, 6)):
            who = self.r.choice(["", f"<b>{self.words(1, 2)}</b> ", f"<span>{self.words(1, 2)}</span> "])
            text = self.words(3, 80)
            parts.append(f"<{item}{self.named('comment', 'reply', 'comment-body')}>{who}"
                         + self.r.choice([text, f"<p>{text}</p>"]) + f"</{item}>")
        return self.box("section div div ol", "comments comment-list discussion responses replies", "".join(parts))

    def share(self) -> str:
        return self.box("div ul", "share social tags toolbar", self.links(self.r.randint(2, 5)))

    def footer(self) -> str:
        text = self.r.choice(["&copy; ", "© 2020 ", "", "Copyright "]) + self.words(2, 40)
        inner = self.r.choice([text, f"<p>{text}</p>", self.links(3) + f"<p>{text}</p>"])
        return self.box("footer footer div", "footer foot site-footer copyright legal", inner)

    def block(self) -> str:
        """A piece of the article."""
        kind, s = self.r.random(), self.SIGN
        low, high = self.r.choice([(1, 6), (5, 40), (20, 120), (60, 300)])
        text = s + self.words(low, high)
        if self.r.random() < 0.25:
            text += f" <{self.r.choice(['b', 'i', 'em', 'span'])}>{self.words(1, 8)}"
            text += self.r.choice(["</b>", "</i>", "</em>", "</span>", ""])
        if self.r.random() < 0.15:
            text += f' <a href="/y">{self.words(1, 4)}</a> {self.words(2, 20)}'
        if kind < 0.7:
            return f"<p>{text}" + self.r.choice(["</p>", "</p>", "</p>", "<br>", ""])
        if kind < 0.78:
            tag = self.r.choice(["h2", "h3", "h4"])
            return f"<{tag}>{s}{self.words(1, 12)}</{tag}>"
        if kind < 0.84:
            tag = self.r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{s}{self.words(2, 30)}</li>" for _ in range(self.r.randint(2, 6))) + f"</{tag}>"
        if kind < 0.89:
            return f"<blockquote>{self.r.choice(['', '<p>'])}{text}</blockquote>"
        if kind < 0.93:
            return f"<div>{text}</div>"
        if kind < 0.96:
            rows = "".join(f"<tr><td>{s}{self.words(1, 5)}</td><td>{s}{self.words(1, 5)}</td></tr>" for _ in range(3))
            return f"<table>{rows}</table>"
        return f"<figure><img src='a'><figcaption>{s}{self.words(3, 20)}</figcaption></figure>"

    def page(self) -> str:
        r = self.r
        self.plain = r.random() < 0.2
        parts = [f"<h1>{self.SIGN}{self.words(2, 14)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.randint(1, 14)):
            parts.append(self.block())
            if r.random() < 0.05:
                parts.append(r.choice([self.advert, self.share, self.form, self.notice])())
        inner = "".join(parts)
        if r.random() < 0.3:
            inner = f"<div{self.named('content', 'body', 'text', 'entry')}>{inner}</div>"
        tail = "".join(f() for f in (self.share, self.comments) if r.random() < 0.12)
        tag = r.choice("article article article main section div div".split())
        name = self.named("article", "content", "post", "entry", "story", "main", "post-body") if r.random() < 0.6 else ""
        article = f"<{tag}{name}>{inner}{tail}</{tag}>"
        before = [f() for f in (self.header, self.menu, self.notice, self.advert, self.menu, self.form) if r.random() < 0.5]
        after = [f() for f in (self.comments, self.sidebar, self.form, self.advert, self.share, self.footer, self.notice) if r.random() < 0.45]
        middle = [article]
        if r.random() < 0.25:
            middle.insert(r.randint(0, 1), self.sidebar())
        if r.random() < 0.35:
            middle = [self.box("div main section", "wrapper page container main layout", "".join(middle))]
        body = "".join(before + middle + after)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body>{body}</body></html>"


def train(texts: list[str], pages: int = MADE_PAGES) -> Boosted:
    """Fit the trees on made pages filled with ``texts``."""
    maker = Maker(texts)
    rows, labels = [], []
    for _ in range(pages):
        nodes = listed(parse(maker.page()))
        signed = [x.text is not None and any(Maker.SIGN in t for t in x.text) for x in nodes]
        for x in nodes:
            if x.text is not None:
                x.text = [t.replace(Maker.SIGN, "") for t in x.text]
        place = {x: i for i, x in enumerate(nodes)}
        label = [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            if nodes[i].text is not None:
                label[i] = KEEP if signed[i] else DROP
            else:
                kinds = {label[place[k]] for k in nodes[i].kids}
                label[i] = kinds.pop() if len(kinds) == 1 else MIXED
        rows.append(features(nodes)[0])
        labels += label
    return Boosted(3).fit(np.concatenate(rows), np.array(labels))


def fit(pages: DataFrame, html_col: str = "html") -> Boosted:
    """Trees trained on text of at most ``TRAIN_PAGES`` pages, the first by a hash of the page."""
    some = (
        pages.select(F.col(html_col).alias("h"))
        .where(F.length("h").between(1, 200_000))
        .select("h", F.xxhash64("h").alias("o"))
        .orderBy("o", "h")
        .limit(TRAIN_PAGES)
        .select("h")
        .toPandas()["h"]
    )
    texts = [clean(x.text) for p in some for x in listed(parse(p)) if x.text is not None]
    return train(texts[:TRAIN_TEXTS])


def main_text(pages: DataFrame, model: Boosted, html_col: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page.

    Defined results: a null or empty page, or one without an article, has an empty text;
    every row keeps its own result; an empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for at in range(0, len(batch), 64):
                out += extract(batch.iloc[at : at + 64].tolist(), shared.value)
            yield pd.Series(out, dtype=object)

    return pages.withColumn(name, extracted(F.col(html_col)))
