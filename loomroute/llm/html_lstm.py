"""Main text of web pages with a recurrent block labeller.

A page is read as a sequence of leaf blocks: runs of text between block-level tags, white space inside turned
into single spaces, character references decoded. Each block has a vector of its tag path (hashed tags,
classes, ids and roles of its ancestors), of its hashed words, and of a few shapes (length, share of linked
text, place in the page). A bidirectional LSTM in numpy reads the whole page's sequence in both directions and
labels every block content or not, so a block is judged with the document around it.

Training uses a bounded sample of ``pages`` whole pages (those with the smallest hash of page_id, url and html)
and ``layouts`` made-up pages. A sample page is labelled by where its prose is: the article or main element with
the most of it, else the deepest container that holds most of the page's prose, without what that element holds of
navigation, forms, asides and blocks that are mostly links. A made-up page is put together from parts whose label is
known by construction (headlines, bylines, paragraphs, lists, tables; menus, adverts, notices, forms, sidebars, reader
comments, footers), in words of the sample, with container names that often say nothing, so shapes, order and
neighbours must decide. One task trains; only the weights, of fixed size, reach the driver and are broadcast.
Training sequences are cut at ``WINDOW`` blocks; labelling never cuts.

Defined cases: null or empty html gives empty text; broken markup is read as far as it goes, with the implied
ends of paragraphs, list items, cells and the head, and skipped elements end with their parent; scripts, styles,
forms' fields and the head are never blocks; pages of any length are read whole; a table without any block trains
on made-up pages alone; equal pages have equal texts; other columns are ignored.
"""

from __future__ import annotations

import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES, LAYOUTS = 240, 2000
SEED = 20
PATH_DIM, WORD_DIM, SHAPES = 64, 16, 6
DIM = PATH_DIM + WORD_DIM + SHAPES
HIDDEN = 16
EPOCHS = 12
LEARNING_RATE = 0.01
#: Blocks that a training sequence has at most; labelling is never cut.
WINDOW = 512

# Tags of HTML by their meaning, and names that sites give to kinds of blocks.
SKIPPED = frozenset("script style noscript template svg iframe textarea select option button title object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split()
)
#: Tags that can stand in a head; any other one ends it.
HEAD_TAGS = frozenset("base basefont bgsound html link meta noframes noscript script style template title".split())
#: Elements that can hold a page's main text, and those inside it that are apart from it.
HOLDERS = frozenset("article body center dd div fieldset main section table tbody td tr".split())
APART = frozenset("nav footer aside form menu dialog fieldset".split())
# Names of containers on made-up pages; the empty name and the plain ones say nothing.
PLAIN_NAMES = ("", "", "", "wrapper", "row", "col", "inner", "box", "block", "x1", "c2", "left", "right", "center", "container", "group", "item", "grid", "layout", "panel")
MAIN_NAMES = ("content", "post", "entry", "article", "story", "main", "article body", "post content", "entry content", "page", "text")
PART_NAMES = {
    "menu": ("nav", "navbar", "menu", "navigation", "breadcrumb", "breadcrumbs", "tabs", "topbar", "links", "pagination", "toc"),
    "advert": ("ad", "ads", "advert", "advertisement", "banner", "promo", "sponsor", "sponsored", "adsense"),
    "notice": ("notice", "alert", "cookie", "consent", "gdpr", "popup", "modal", "message", "warning", "announcement"),
    "form": ("newsletter", "subscribe", "login", "search", "signup", "contact form", "form"),
    "sidebar": ("sidebar", "side", "widget", "related", "recommended", "popular", "trending", "more", "share", "social", "tags", "author box"),
    "comments": ("comments", "comment", "comment list", "disqus", "disqus thread", "replies", "reply", "responses", "discussion", "respond", "feedback", "reader comments", "talkback"),
    "footer": ("footer", "copyright", "colophon", "legal", "site info", "bottom"),
}
_ENDS_P = BLOCK - {"html", "body"}
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}


Block = tuple[str, tuple[str, ...], int, tuple[tuple[int, str], ...]]


class _Blocks(HTMLParser):
    """Collects (text, path tokens, linked characters, numbers of the elements around it with their tags)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, tuple[str, ...], int]] = []
        self.elements = 0
        self.text: list[str] = []
        self.skip = ""
        self.inside: list[str] = []  # block tags open inside the skipped element
        self.head = False
        self.skips = self.links = self.linked = 0

    def _flush(self) -> None:
        if self.text:
            words = " ".join("".join(self.text).split())
            if words:
                self.blocks.append((words, tuple(t for _, own, _ in self.stack for t in own), self.linked, tuple((n, tag) for tag, _, n in self.stack)))
            self.text = []
        self.linked = 0

    def _pop(self, tags: tuple[str, ...]) -> None:
        while self.stack and self.stack[-1][0] in tags:
            self.stack.pop()

    def handle_starttag(self, tag, attrs):
        if self.skip and not (self.head and tag == "body"):
            self.skips += tag == self.skip
            if tag in BLOCK and tag not in VOID:
                self.inside.append(tag)
            return
        self.skip = ""
        if tag == "head":
            self._flush()
            self.head = True
            return
        if tag not in HEAD_TAGS:
            self.head = False
        if tag in SKIPPED:
            self.skip, self.skips, self.inside = tag, 1, []
        elif tag == "br":
            self.text.append(" ")
        elif tag == "a":
            self.links = 1
        elif tag in BLOCK:
            self._flush()
            self.links = 0
            if tag in _ENDS_P:
                self._pop(("p",))
            self._pop(_SAME.get(tag, ()))
            if tag in VOID:
                return
            names = [tag]
            for key, value in attrs:
                if value and key in ("class", "id", "role"):
                    names += [w for w in value.lower().replace("-", " ").replace("_", " ").split()]
            self.elements += 1
            self.stack.append((tag, tuple(names), self.elements))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or self.skip:
            if tag in VOID:
                self.handle_starttag(tag, attrs)
        elif tag not in SKIPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip:
                self.skips -= 1
                if not self.skips:
                    self.skip = ""
                return
            if tag in self.inside:
                while self.inside.pop() != tag:
                    pass
                return
            if not (tag == "head" and self.head or any(tag == t for t, _, _ in self.stack)):
                return
            self.skip = ""  # its parent closes
        if tag == "head":
            self.head = False
        elif tag == "a":
            self.links = 0
        elif tag in BLOCK:
            self._flush()
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    del self.stack[i:]
                    break

    def handle_data(self, data):
        if not self.skip:
            self.head = self.head and data.isspace()  # text cannot stand in a head
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str | None) -> list[Block]:
    reader = _Blocks()
    if html:
        reader.feed(html)
        reader.close()
        reader._flush()
    return reader.blocks


def _prose(block: Block) -> int:
    """Characters outside links of a block that reads like a sentence, else 0."""
    text, _, linked, _ = block
    return max(len(text) - linked, 0) if linked * 2 < len(text) and len(text.split()) >= 4 and text[-1] in ".!?:;\"'”»…" else 0


def main_element(page: list[Block]) -> int | None:
    """Number of the element that holds the main text, by where the prose of the page is."""
    mass: dict[int, int] = {}
    size: dict[int, int] = {}
    tags: dict[int, str] = {}
    depth: dict[int, int] = {}
    for block in page:
        apart = any(tag in APART for _, tag in block[3])
        for level, (number, tag) in enumerate(block[3]):
            tags[number], depth[number] = tag, level
            mass[number] = mass.get(number, 0) + (0 if apart else _prose(block))
            size[number] = size.get(number, 0) + (0 if apart else max(len(block[0]) - block[2], 0))
    named = [n for n, tag in tags.items() if tag in ("article", "main")]
    if named:
        return max(named, key=lambda n: (mass[n], size[n], depth[n], -n))
    total = max(mass.values(), default=0)
    weight = mass if total else size
    total = max(weight.values(), default=0)
    held = [n for n, tag in tags.items() if tag in HOLDERS and total and weight[n] >= 0.6 * total]
    return max(held, key=lambda n: (depth[n], weight[n], -n), default=None)


def teach(page: list[Block]) -> list[bool]:
    """Labels of a sample page: what the main element holds, but for elements apart and blocks that are mostly links."""
    main = main_element(page)
    out = []
    for text, _, linked, around in page:
        numbers = [n for n, _ in around]
        inside = numbers.index(main) + 1 if main in numbers else None
        out.append(inside is not None and not any(tag in APART for _, tag in around[inside:]) and linked * 2 < len(text))
    return out


def features(page: list) -> np.ndarray:
    out = np.zeros((len(page), DIM), dtype=np.float32)
    crc = zlib.crc32
    n = len(page)
    paths: dict[tuple, np.ndarray] = {}
    for i, (text, path, linked, _) in enumerate(page):
        own = paths.get(path)
        if own is None:
            own = np.zeros(PATH_DIM, dtype=np.float32)
            for t in path:
                h = crc(t.encode())
                own[h % PATH_DIM] += 1.0
                own[(h >> 8) % PATH_DIM] -= 1.0
            paths[path] = own
        out[i, :PATH_DIM] = own
        words = np.bincount([crc(w) & (WORD_DIM - 1) for w in text.lower().encode().split()], minlength=WORD_DIM)
        out[i, PATH_DIM : PATH_DIM + WORD_DIM] = words / max(words.sum(), 1)
        size = len(text)
        out[i, PATH_DIM + WORD_DIM :] = (np.log1p(size) / 8, linked / max(size, 1), i / n, 1.0 - i / n, text[-1] in ".!?", sum(map(str.isdigit, text[:200])) / min(size, 200))
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {}
    for way in "fb":
        w[f"{way}x"] = rng.normal(0, 0.15, (DIM, 4 * HIDDEN))
        w[f"{way}h"] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
        w[f"{way}c"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    w["o"] = rng.normal(0, 0.15, 2 * HIDDEN)
    w["p"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _run(w, way, x, mask, keep):
    """States over time of one direction. x: (T, B, DIM); mask: (T, B, 1), false steps leave the state alone."""
    steps, many, _ = x.shape
    z = x.reshape(-1, DIM) @ w[f"{way}x"] + w[f"{way}c"]
    z = z.reshape(steps, many, 4 * HIDDEN)
    h = np.zeros((many, HIDDEN), dtype=np.float32)
    c = np.zeros_like(h)
    states, trace = np.empty((steps, many, HIDDEN), dtype=np.float32), []
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        gates = z[t] + h @ w[f"{way}h"]
        ifo = _sigmoid(gates[:, : 3 * HIDDEN])
        i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
        g = np.tanh(gates[:, 3 * HIDDEN :])
        m = mask[t]
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        if keep:
            trace.append((t, h, c, i, f, o, g, tc))
        h = np.where(m, o * tc, h)
        c = np.where(m, c_new, c)
        states[t] = h
    return states, trace


def _back(w, way, x, mask, trace, d_states, grads):
    many = x.shape[1]
    dh = np.zeros((many, HIDDEN), dtype=np.float32)
    dc = np.zeros_like(dh)
    dz = np.zeros((x.shape[0], many, 4 * HIDDEN), dtype=np.float32)
    for t, h, c, i, f, o, g, tc in reversed(trace):
        m = mask[t]
        dh = dh + d_states[t]
        do, dcn = dh * tc, dc + dh * o * (1 - tc * tc)
        d = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), do * o * (1 - o), dcn * i * (1 - g * g)], axis=1) * m
        dz[t] = d
        grads[f"{way}h"] += h.T @ d
        dh = np.where(m, d @ w[f"{way}h"].T, dh)
        dc = np.where(m, dcn * f, dc)
    flat = dz.reshape(-1, 4 * HIDDEN)
    grads[f"{way}x"] += x.reshape(-1, DIM).T @ flat
    grads[f"{way}c"] += flat.sum(0)


def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), DIM), dtype=np.float32)
    mask = np.zeros((steps, len(pages), 1), dtype=bool)
    for b, p in enumerate(pages):
        x[: len(p), b] = p
        mask[: len(p), b] = True
    return x, mask


def scores(w: dict, pages: list[np.ndarray], cells: int = 60_000) -> list[np.ndarray]:
    """Probability of content for every block; pages of like length go together, at most ``cells`` blocks at once."""
    out: list[np.ndarray] = [np.empty(0, np.float32)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and len(pages[order[upto]]) * (upto + 1 - at) <= cells:
            upto += 1
        own = order[at:upto]
        x, mask = _pad([pages[i] for i in own])
        both = np.concatenate([_run(w, "f", x, mask, False)[0], _run(w, "b", x, mask, False)[0]], axis=2)
        p = _sigmoid(both @ w["o"] + w["p"][0])
        for b, i in enumerate(own):
            out[i] = p[: len(pages[i]), b]
        at = upto
    return out


def train(sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Adam on the log loss of all blocks."""
    rng = np.random.default_rng(seed)
    w = new_weights(rng)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for _ in range(epochs):
        # Sequences of like length share a batch, so few steps are padding; batches come in random order.
        order = sorted(rng.permutation(len(sequences)).tolist(), key=lambda i: len(sequences[i][0]))
        for at in rng.permutation(np.arange(0, len(order), 32)).tolist():
            own = [sequences[i] for i in order[at : at + 32]]
            x, mask = _pad([s[0] for s in own])
            y = np.zeros(mask.shape[:2], dtype=np.float32)
            for b, (_, label) in enumerate(own):
                y[: len(label), b] = label
            f, ft = _run(w, "f", x, mask, True)
            r, rt = _run(w, "b", x, mask, True)
            both = np.concatenate([f, r], axis=2)
            d = (_sigmoid(both @ w["o"] + w["p"][0]) - y) * mask[..., 0] / mask.sum()
            grads = {k: np.zeros_like(v) for k, v in w.items()}
            grads["o"] += np.einsum("tb,tbh->h", d, both)
            grads["p"] += d.sum()
            ds = d[..., None] * w["o"]
            _back(w, "f", x, mask, ft, ds[..., :HIDDEN], grads)
            _back(w, "b", x, mask, rt, ds[..., HIDDEN:], grads)
            step += 1
            for k in w:
                g = np.clip(grads[k], -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - (LEARNING_RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


class _Layouts:
    """Made-up pages: blocks and their labels by construction."""

    def __init__(self, rng: np.random.Generator, words: list[str]) -> None:
        self.rng, self.words = rng, words or [a + b for a in ("ka", "lo", "mi", "re", "su", "ta") for b in ("n", "rel", "st", "do", "ve", "s")]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def one(self, items):
        return items[int(self.rng.integers(len(items)))]

    def some(self, low: int, high: int) -> str:
        return " ".join(self.one(self.words) for _ in range(int(self.rng.integers(low, high + 1))))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.some(4, 18).capitalize() + self.one("....!?") for _ in range(int(self.rng.integers(low, high + 1))))

    def named(self, tag: str, names) -> tuple[str, ...]:
        """Tokens of an element; a name is given, or one that says nothing."""
        return (tag, *self.one(names).split())

    def part(self, kind: str, around: tuple[str, ...]) -> list[tuple[str, tuple[str, ...], int]]:
        own = {"menu": "nav", "form": "form", "sidebar": "aside", "footer": "footer", "notice": "dialog"}.get(kind)
        tag = own if own and self.chance(0.4) else self.one(("div", "div", "section", "ul"))
        path = (*around, *self.named(tag, PLAIN_NAMES if self.chance(0.3) and (tag == own or kind in ("menu", "footer", "comments")) else PART_NAMES[kind]))
        out = []
        if kind == "menu" or (kind == "sidebar" and self.chance(0.6)):
            if self.chance(0.3):
                out.append((self.some(1, 3), (*path, "h3"), 0))
            for _ in range(int(self.rng.integers(2, 9))):
                text = self.some(1, 6 if kind == "sidebar" else 3)
                out.append((text, (*path, *self.one((("ul", "li"), ("li",), ("p",), ()))), len(text)))
        elif kind == "comments":
            if self.chance(0.7):
                out.append((f"{self.rng.integers(1, 90)} {self.some(1, 2)}", (*path, self.one(("h2", "h3", "div"))), 0))
            for _ in range(int(self.rng.integers(1, 6))):
                item = (*path, *self.one((("ol", "li"), ("div",), ("div", "comment"), ("article",), ("ul", "li"), ())))
                if self.chance(0.7):
                    out.append((self.some(1, 2), (*item, self.one(("div", "p", "h4"))), 0))
                if self.chance(0.4):
                    out.append((f"{self.rng.integers(1, 29)} {self.some(1, 1)} {self.rng.integers(2000, 2030)}", (*item, "div"), 0))
                out.append((self.sentences(1, 4) if self.chance(0.8) else self.some(2, 9), (*item, "p") if self.chance(0.8) else item, 0))
                if self.chance(0.4):
                    text = self.some(1, 1)
                    out.append((text, (*item, "div"), len(text)))
        elif kind == "form":
            for _ in range(int(self.rng.integers(1, 4))):
                out.append((self.some(1, 7), (*path, self.one(("p", "div", "h3"))), 0))
        elif kind == "footer":
            year = f"© {self.rng.integers(1990, 2030)} " if self.chance(0.4) else "© " if self.chance(0.5) else ""
            out.append((year + (self.sentences(1, 1) if self.chance(0.5) else self.some(2, 12)), path if self.chance(0.5) else (*path, "p"), 0))
            if self.chance(0.4):
                text = self.some(2, 6)
                out.append((text, (*path, "ul", "li"), len(text)))
        else:  # adverts, notices, sidebars in prose
            for _ in range(1 if kind == "notice" else int(self.rng.integers(1, 3))):
                text = self.sentences(1, 2) if self.chance(0.7) else self.some(2, 9)
                out.append((text, path if self.chance(0.6) else (*path, "p"), len(text) if self.chance(0.25) else 0))
        return out

    def content(self, around: tuple[str, ...]) -> list[tuple[str, tuple[str, ...], int]]:
        out = []
        head = (*around, "header") if self.chance(0.4) else around
        if self.chance(0.85):
            out.append((self.some(2, 12).capitalize(), (*head, self.one(("h1", "h1", "h2"))), 0))
        if self.chance(0.35):
            out.append((f"{self.one(('By', 'Von', 'Par', 'Por', ''))} {self.some(2, 3)}".strip(), (*head, *self.one((("p",), ("div", "byline"), ("p", "author"), ("div", "meta")))), 0))
        if self.chance(0.25):
            out.append((f"{self.rng.integers(1, 29)} {self.some(1, 1)} {self.rng.integers(2000, 2030)}", (*head, *self.one((("p",), ("div",), ("div", "date")))), 0))
        for _ in range(int(self.rng.integers(1, 14))):
            kind = self.rng.random()
            if kind < 0.72:
                text = self.sentences(1, 6)
                out.append((text, (*around, self.one(("p", "p", "p", "p", "div"))), len(text) // 5 if self.chance(0.2) else 0))
            elif kind < 0.80:
                out.append((self.some(1, 7).capitalize(), (*around, self.one(("h2", "h3", "h4"))), 0))
            elif kind < 0.88:
                for _ in range(int(self.rng.integers(2, 6))):
                    out.append((self.some(1, 10), (*around, self.one(("ul", "ol")), "li"), 0))
            elif kind < 0.93:
                for _ in range(int(self.rng.integers(2, 7))):
                    out.append((self.some(1, 3), (*around, "table", "tbody", "tr", self.one(("td", "th"))), 0))
            else:
                out.append((self.sentences(1, 2), (*around, *self.one((("blockquote",), ("blockquote", "p"), ("pre",), ("figure", "figcaption")))), 0))
        return out

    def page(self) -> tuple[list, list[bool]]:
        body = ("html", "body", *(self.named("div", PLAIN_NAMES) if self.chance(0.5) else ()))
        where = self.rng.random()
        if where < 0.35:
            main = (*body, *self.one((("article",), ("main",), ("main", "article"), ("div", "article"))))
        elif where < 0.7:
            main = (*body, *self.named(self.one(("div", "section")), MAIN_NAMES))
        else:
            main = (*body, *self.named(self.one(("div", "section", "div")), PLAIN_NAMES))
        blocks: list = []
        labels: list[bool] = []

        def put(rows, label):
            blocks.extend((*row, ()) for row in rows)
            labels.extend([label] * len(rows))

        for kind, p in (("notice", 0.25), ("menu", 0.75), ("advert", 0.35), ("menu", 0.25), ("form", 0.15), ("sidebar", 0.25), ("advert", 0.15)):
            if self.chance(p):
                put(self.part(kind, (*body, "header") if kind == "menu" and self.chance(0.3) else body), False)
        rows = self.content(main)
        cuts = sorted(int(self.rng.integers(1, len(rows) + 1)) for _ in range(int(self.rng.integers(0, 4))))
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            put(rows[a:b], True)
            if b < len(rows) and a < b:
                put(self.part(self.one(("advert", "advert", "sidebar", "form", "notice")), main), False)
        for kind, p in (("sidebar", 0.3), ("form", 0.2), ("comments", 0.45), ("advert", 0.3), ("sidebar", 0.35), ("menu", 0.2), ("footer", 0.8), ("notice", 0.2)):
            if self.chance(p):
                put(self.part(kind, main if kind != "footer" and self.chance(0.3) else body), False)
        return blocks, labels


def fit(pages: list[str], seed: int = SEED, layouts: int = LAYOUTS) -> dict[str, np.ndarray]:
    """Weights from the sample's html and made-up pages."""
    rng = np.random.default_rng(seed)
    own = [b for b in map(blocks, pages) if b]
    words = [w for page in own for text, *_ in page for w in text.split()[:400]]
    maker = _Layouts(rng, words)
    sequences = []
    for page, labels in [*((page, teach(page)) for page in own), *(maker.page() for _ in range(layouts))]:
        x, y = features(page), np.array(labels, dtype=np.float32)
        sequences += [(x[i : i + WINDOW], y[i : i + WINDOW]) for i in range(0, len(x), WINDOW)]
    return train(sequences, seed=seed)


def extract(pages: DataFrame, weights: dict) -> DataFrame:
    """(page_id, url, text) for each row of (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                read = [blocks(h) for h in part.column("html").to_pylist()]
                keep = [s > 0.5 for s in scores(w, [features(p) for p in read])]
                texts = ["\n\n".join(b[0] for b, k in zip(page, kept) if k) for page, kept in zip(read, keep)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string")


def sample(pages: DataFrame, n: int = PAGES) -> DataFrame:
    """(h, html) of the training pages: the n smallest hashes first, then the html of these alone."""
    rows = pages.where(F.length("html") > 0).select(F.xxhash64("page_id", "url", "html").alias("h"), "html")
    chosen = rows.select("h").orderBy("h").limit(n).distinct()
    return rows.join(F.broadcast(chosen), "h").dropDuplicates(["h"])  # n rows at most


def fit_sample(chosen: DataFrame, seed: int = SEED) -> dict[str, np.ndarray]:
    """Train in one task, single-threaded like all of Spark's Python workers; only the weights come back."""
    names = list(new_weights(np.random.default_rng(0)))

    def run(batches):
        rows = sorted((h, html) for b in batches for h, html in zip(b.column("h").to_pylist(), b.column("html").to_pylist()))
        w = fit([html for _, html in rows], seed)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([w[k].astype("<f4").tobytes() for k in names], pa.binary())], names=["name", "data"])

    found = {r["name"]: np.frombuffer(r["data"], dtype="<f4") for r in chosen.coalesce(1).mapInArrow(run, "name string, data binary").collect()}
    if not found:  # an empty sample may have no task at all
        return fit([], seed)
    shapes = {k: v.shape for k, v in new_weights(np.random.default_rng(0)).items()}
    return {k: v.reshape(shapes[k]) for k, v in found.items()}


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = extract(pages, fit_sample(sample(pages.select("page_id", "url", "html"))))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
