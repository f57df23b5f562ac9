"""Main text of web pages by a recurrent block labeller.

A page becomes its leaf sequence: the text blocks between block-level tags, in
page order (scripts, styles, comments and the head carry no text). Each block
has a vector of its tag path (hashed tag, class and id words), one of its
hashed words, and a few measures. A bidirectional LSTM in numpy reads the whole
sequence and classifies every block with the page as context. Pages of more than
``CELLS`` blocks are read in stretches, each direction's state carried over and
one number per block kept, so a page takes little more than its blocks' texts.
It is trained on at most ``SAMPLE`` pages that mark their article themselves
(of up to ``TRAIN_CHARS`` characters, drawn among all such pages) and on layouts laid around the same texts (menus, headers, sidebars, notices, adverts,
forms, reader comments, with usual class names or none); path words are hidden
at random in training, so that no single name decides.

Character references are decoded, white space in a block becomes one space,
blocks are joined by two \\n. Null html counts as empty and gives an empty text;
a null url stays null; unclosed and deeply nested tags are walked without
recursion; whole pages are read, of any length. If no page of the table marks an
article, there is nothing to learn from, and a block counts as main text if no
part of its path is a known container of the other kinds. Repeated rows get
repeated results; a block whose score ties at the border (0) isn't main text.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnxml.llm.common import unit_hash
from vulnxml.llm.linear import sigmoid

PATH, WORDS, MEASURES, HIDDEN = 96, 32, 8, 16
WIDTH = PATH + WORDS + MEASURES
SAMPLE, EPOCHS, BATCH, RATE, HIDE = 160, 16, 16, 0.01, 0.15
#: Blocks of one training page at most (from its start), and of a padded batch.
TRAIN_BLOCKS, CELLS = 160, 1 << 15
#: Characters of a training page at most; of its main blocks, characters and
#: number that a layout takes; number of other blocks.
TRAIN_CHARS, LAYOUT_CHARS, LAYOUT_BLOCKS, LAYOUT_OTHERS = 200_000, 2000, 40, 3

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
# Fixed values of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = ("script", "style", "title", "noscript", "template", "textarea", "svg", "iframe", "object", "select")
#: Of these, a start tag without an end tag hides nothing.
UNCLOSED = frozenset("noscript template svg object select".split())
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in HIDDEN_TAGS}
#: A start tag that closes an open one of the second set, down to the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"datalist"})}
NOT_MAIN = frozenset("nav menu header footer aside sidebar ad ads advert banner promo sponsor cookie notice consent form comment comments widget related share social breadcrumb subscribe newsletter popup modal button".split())


class Block:
    __slots__ = ("parts", "path", "names", "linked", "inside", "text", "heading")

    def __init__(self, path: np.ndarray, names: tuple, inside: bool, heading: bool) -> None:
        self.parts: list[str] | None = []
        self.path, self.names, self.inside, self.heading = path, names, inside, heading
        self.linked, self.text = 0, ""


_slots: dict[str, int] = {}


def slot(name: str) -> int:
    if name not in _slots:
        if len(_slots) > 50_000:
            _slots.clear()
        _slots[name] = zlib.crc32(name.encode("utf-8", "surrogatepass")) % PATH
    return _slots[name]


def leaf_blocks(page: str | None, marks: frozenset = frozenset(("article",))) -> list[Block]:
    """The page's text blocks in order. ``inside``: under a tag in ``marks``."""
    page = page or ""
    path, open_, out = np.zeros(PATH, np.int32), [], []
    names: dict[str, int] = {}
    block: Block | None = None
    links = marked = 0
    endless: set[str] = set()
    paths: dict[tuple, tuple] = {}  # blocks of like place share their path

    def place() -> tuple[np.ndarray, tuple]:
        small = np.minimum(path, 2).astype(np.int8)
        key = small.tobytes(), tuple(names)
        return paths.setdefault(key, (small, key[1]))

    def text(raw: str) -> None:
        nonlocal block
        if raw and (block is not None or not raw.isspace()):
            if block is None:
                block = Block(*place(), marked > 0, any(f"h{i}" in names for i in range(1, 7)))
            block.parts.append(raw)
            if links:
                block.linked += len(raw)

    def flush() -> None:
        nonlocal block
        if block is not None:
            block.text = " ".join(entities.unescape("".join(block.parts)).split())
            block.parts = None
            if block.text:
                out.append(block)
        block = None

    def pop() -> None:
        nonlocal links, marked
        tag, found = open_.pop()
        for n in found:
            path[slot(n)] -= 1
            names[n] -= 1
            if not names[n]:
                del names[n]
        links -= tag == "a"
        marked -= tag in marks
        if tag not in INLINE:
            flush()

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag in names and any(t == tag for t, _ in reversed(open_)):
                while open_[-1][0] != tag:
                    pop()
                pop()
            elif tag not in INLINE:
                flush()
            continue
        if tag == "br":
            text(" ")
            continue
        if tag not in INLINE:
            flush()
        if tag in _END:
            if tag in endless or tag == "svg" and m.group(3).rstrip().endswith("/"):
                continue
            end = _END[tag].search(page, at)
            if end is None and tag in UNCLOSED:
                endless.add(tag)
            else:
                at = end.end() if end else len(page)
            continue
        if tag in VOID:
            continue
        if tag in CLOSES:
            same, stop = CLOSES[tag]
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] in stop:
                    break
                if open_[i][0] in same:
                    while len(open_) > i:
                        pop()
                    break
        elif tag not in INLINE and open_ and "p" in names:
            i = len(open_) - 1
            while i >= 0 and open_[i][0] in INLINE:
                i -= 1
            if i >= 0 and open_[i][0] == "p":
                del_from = i
                while len(open_) > del_from:
                    pop()
        attrs = m.group(3)
        if attrs.rstrip().endswith("/") and tag not in INLINE and tag not in ("div", "p", "section", "article"):
            continue
        found = [tag]
        if "=" in attrs:
            for v in _NAMES.findall(attrs):
                found += dict.fromkeys(_PART.findall("".join(v).lower()))
        for n in found:
            path[slot(n)] += 1
            names[n] = names.get(n, 0) + 1
        open_.append((tag, found))
        links += tag == "a"
        marked += tag in marks
    flush()
    return out


def vectors(blocks: list[Block], lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Vectors of a page's blocks, or of those from ``lo`` to ``hi``."""
    part = blocks[lo:hi]
    x = np.zeros((len(part), WIDTH), np.float32)
    for i, b in enumerate(part):
        t, n = b.text, len(b.text)
        x[i, :PATH] = b.path
        words = t.lower().split(" ")
        at = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words)) % WORDS
        count = np.bincount(at, minlength=WORDS)
        x[i, PATH:PATH + WORDS] = count / max(float(np.linalg.norm(count)), 1)
        stops = t.count(".") + t.count("!") + t.count("?")
        x[i, PATH + WORDS:] = (np.log1p(n) / 4, min(1.0, b.linked / n), 1.0 * (t[-1] in ".!?:"), min(1.0, 10 * t.count(",") / n),
                               min(1.0, 20 * stops / n), np.log1p(len(words)) / 3, (lo + i) / len(blocks), 1.0 * b.heading)
    return x


def start(seed: int = 5) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {}
    for way in "fb":
        p["x" + way] = (r.standard_normal((WIDTH, 4 * HIDDEN)) / np.sqrt(24)).astype(np.float32)
        p["h" + way] = (r.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
        p["b" + way] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)  # in, forget, out, new
    p["o"], p["c"] = (r.standard_normal(2 * HIDDEN) / 4).astype(np.float32), np.zeros((), np.float32)
    return p


def run_way(p: dict, way: str, x: np.ndarray, mask: np.ndarray, keep: bool, state: tuple | None = None) -> tuple[np.ndarray, list, tuple]:
    """States (T, B, H) of one direction, from ``state`` on, and the last one;
    padded steps leave the state alone."""
    steps, n, _ = x.shape
    pre = x @ p["x" + way] + p["b" + way]
    h, c = state or (np.zeros((n, HIDDEN), np.float32),) * 2
    out, tape = np.zeros((steps, n, HIDDEN), np.float32), []
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        z = pre[t] + h @ p["h" + way]
        g = sigmoid(z[:, :3 * HIDDEN])
        i, f, o, u = g[:, :HIDDEN], g[:, HIDDEN:2 * HIDDEN], g[:, 2 * HIDDEN:], np.tanh(z[:, 3 * HIDDEN:])
        m = mask[t][:, None]
        nc = np.where(m, f * c + i * u, c)
        tc = np.tanh(nc)
        nh = np.where(m, o * tc, h)
        if keep:
            tape.append((t, h, c, i, f, o, u, tc, m))
        h, c, out[t] = nh, nc, nh
    return out, tape, (h, c)


def back_way(p: dict, way: str, x: np.ndarray, tape: list, dout: np.ndarray, g: dict) -> None:
    dh = np.zeros_like(dout[0])
    dc = np.zeros_like(dh)
    dpre = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
    for t, h0, c0, i, f, o, u, tc, m in reversed(tape):
        d = dout[t] + dh
        dm = np.where(m, d, 0)
        dcc = np.where(m, dc + dm * o * (1 - tc * tc), 0)
        dz = np.concatenate([dcc * u * i * (1 - i), dcc * c0 * f * (1 - f), dm * tc * o * (1 - o), dcc * i * (1 - u * u)], axis=1)
        dpre[t] = dz
        g["h" + way] += h0.T @ dz
        dh = np.where(m, dz @ p["h" + way].T, d)
        dc = np.where(m, dcc * f, dc)
    flat = dpre.reshape(-1, 4 * HIDDEN)
    g["x" + way] += x.reshape(-1, WIDTH).T @ flat
    g["b" + way] += flat.sum(axis=0)


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), bool)
    for i, v in enumerate(pages):
        x[:len(v), i], mask[:len(v), i] = v, True
    return x, mask


def logits(p: dict, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    f, tf, _ = run_way(p, "f", x, mask, keep)
    b, tb, _ = run_way(p, "b", x, mask, keep)
    both = np.concatenate([f, b], axis=2)
    return both @ p["o"] + p["c"], (both, tf, tb)


def logits_in_stretches(p: dict, pages: list[list[Block]], stretch: int) -> np.ndarray:
    """(T, B): the logits of whole pages, vectors made for ``stretch`` steps at a time."""
    steps = max(map(len, pages))
    z = np.full((steps, len(pages)), p["c"], np.float32)
    cuts = range(0, steps, stretch)
    x, mask = None, None
    for way, part, order in (("f", slice(None, HIDDEN), cuts), ("b", slice(HIDDEN, None), reversed(cuts))):
        state = None
        for lo in order:
            if x is None or len(cuts) > 1:
                x, mask = padded([vectors(blocks, lo, lo + stretch) for blocks in pages])
            out, _, state = run_way(p, way, x, mask, False, state)
            z[lo:lo + len(out)] += out @ p["o"][part]
    return z


def train(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = 5) -> dict:
    p, r = start(seed), np.random.default_rng(seed)
    m, s, k = {n: np.zeros_like(v) for n, v in p.items()}, {n: np.zeros_like(v) for n, v in p.items()}, 0
    for epoch in range(epochs):
        order = r.permutation(len(pages))
        order = order[np.argsort([len(pages[i]) // 8 for i in order], kind="stable")]  # like lengths together
        groups = np.array_split(order, max(1, len(order) // BATCH))
        for rows in (groups[i] for i in r.permutation(len(groups))):
            x, mask = padded([pages[i] for i in rows])
            x[:, :, :PATH] *= r.random((1, len(rows), PATH)) >= HIDE * (r.random((1, len(rows), 1)) < 0.5)
            y = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(rows):
                y[:len(labels[i]), j] = labels[i]
            z, (both, tf, tb) = logits(p, x, mask, True)
            d = (np.where(mask, sigmoid(z) - y, 0) / max(1, mask.sum())).astype(np.float32)
            g = {n: np.zeros_like(v) for n, v in p.items()}
            g["o"], g["c"] = np.tensordot(both, d, ([0, 1], [0, 1])), d.sum()
            dboth = d[:, :, None] * p["o"]
            back_way(p, "f", x, tf, dboth[:, :, :HIDDEN], g)
            back_way(p, "b", x, tb, dboth[:, :, HIDDEN:], g)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            k += 1
            for n in p:
                d_ = g[n] / max(1.0, norm) + 1e-5 * p[n]
                m[n], s[n] = 0.9 * m[n] + 0.1 * d_, 0.999 * s[n] + 0.001 * d_ * d_
                p[n] = (p[n] - RATE * (1 - epoch / (epochs + 1)) * (m[n] / (1 - 0.9 ** k)) / (np.sqrt(s[n] / (1 - 0.999 ** k)) + 1e-8)).astype(np.float32)
    return p


MARK = "\x02"


def layout(texts: list[str], others: list[str], seed: int) -> str:
    """A page laid around some main texts; those begin with ``MARK``."""
    r = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(r.integers(len(xs)))]
    words = [w for t in others for w in t.split()] or ["word"]
    some = lambda a, b: " ".join(entities.escape(pick(*words)) for _ in range(int(r.integers(a, b))))
    wrap = lambda tag, names, body: f"<{tag}{f' class={chr(34)}{names}{chr(34)}' if r.random() < 0.8 else ''}>{body}</{tag}>"
    links = lambda n, a=1, b=4: "".join(f'<li><a href="/{i}">{some(a, b)}</a></li>' for i in range(n))
    line = lambda: entities.escape(pick(*others)) if others and r.random() < 0.5 else some(4, 30) + "."
    n = lambda: int(r.integers(2, 9))
    extra = {
        "menu": lambda: wrap(pick("nav", "div", "ul"), pick("menu", "nav", "main-nav", "navbar", "topnav"), f"<ul>{links(n())}</ul>"),
        "header": lambda: wrap(pick("header", "div"), pick("header", "site-header", "masthead", "top"), f"<{(t := pick('h1', 'p', 'div', 'span'))}>{some(1, 6)}</{t}><p>{some(3, 9)}</p>"),
        "crumbs": lambda: wrap(pick("div", "nav", "ol"), pick("breadcrumb", "breadcrumbs", "path"), " &gt; ".join(f"<a href='#'>{some(1, 2)}</a>" for _ in range(3))),
        "notice": lambda: wrap(pick("div", "section", "p"), pick("notice", "cookie-notice", "cookie", "consent", "alert", "gdpr-banner"), f"<p>{line()}</p><button>{some(1, 3)}</button>"),
        "advert": lambda: wrap(pick("div", "aside", "section"), pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"), pick(f"<p>{line()}</p>", line(), f"<a href='/x'>{line()}</a>")),
        "form": lambda: f"<form class='{pick('search', 'subscribe', 'newsletter', 'login')}'><label>{some(1, 4)}</label><input name=q><p>{some(4, 15)}</p><button>{some(1, 3)}</button></form>",
        "sidebar": lambda: wrap(pick("aside", "div"), pick("sidebar", "side", "widget", "related", "rail"), f"<h3>{some(1, 4)}</h3>" + pick(f"<ul>{links(n(), 3, 10)}</ul>", f"<p>{line()}</p><p>{line()}</p>")),
        "share": lambda: wrap("div", pick("share", "social", "tags", "meta", "byline"), "".join(f"<a href='#'>{some(1, 3)}</a> " for _ in range(4))),
        "comments": lambda: wrap(pick("section", "div", "ol"), pick("comments", "comment-list", "responses", "discussion"), f"<h2>{some(1, 3)}</h2>" + "".join(
            wrap(pick("div", "li", "div"), pick("comment", "comment-body", "reply"), f"<b>{some(1, 3)}</b><p>{line()}</p>") for _ in range(n()))),
        "footer": lambda: wrap(pick("footer", "div"), pick("footer", "site-footer", "bottom", "copyright"), pick(f"<p>&copy; {line()}</p>", f"&copy; {line()}", f"<ul>{links(n())}</ul><p>{line()}</p>")),
    }
    body = []
    for i, t in enumerate(texts):
        t = MARK + entities.escape(t)
        tag = "h1" if i == 0 else pick("p", "p", "p", "p", "p", "h2", "blockquote", "pre", "li", "td", "div")
        body.append({"li": f"<ul><li>{t}</li></ul>", "td": f"<table><tr><td>{t}</td></tr></table>"}.get(tag, f"<{tag}>{t}</{tag}>" if r.random() < 0.9 else f"<{tag}>{t}"))
        if i and r.random() < 0.06:
            body.append(extra[pick("advert", "share", "sidebar", "form", "notice")]())
    main = wrap(pick("article", "article", "main", "div", "div", "section"), pick("content", "article", "post", "entry-content", "story", "article-body", "main", "text"), "".join(body))
    before = [extra[k]() for k in ("header", "menu", "crumbs", "notice", "advert", "sidebar", "share", "form") if r.random() < 0.45]
    after = [extra[k]() for k in ("share", "comments", "sidebar", "advert", "form", "notice", "menu", "footer") if r.random() < 0.5]
    if r.random() < 0.5:
        r.shuffle(before)
    return f"<html><head><title>{some(2, 6)}</title><style>p{{}}</style></head><body>{''.join(before)}{pick('', '<div>', '<div class=wrap>')}{main}{''.join(after)}</body></html>"


def training_set(pages: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    xs, ys = [], []
    texts, others = [], []
    for page in pages:
        blocks = leaf_blocks(page)[:TRAIN_BLOCKS]
        y = np.array([b.inside for b in blocks], np.float32)
        if len(blocks) and y.any():
            xs.append(vectors(blocks))
            ys.append(y)
            texts.append([b.text[:LAYOUT_CHARS] for b in blocks if b.inside][:LAYOUT_BLOCKS])
            others += [b.text for b in blocks if not b.inside and len(b.text) > 30][:LAYOUT_OTHERS]
    for i, t in enumerate(texts):
        if i % 4 == 0:  # a page that says one thing over and over
            t = t[:4] + [min(t, key=len)] * 40
            for tag in ("p", "p><b"):
                blocks = leaf_blocks("<html><body><nav><a href='/'>x</a></nav><article>" + f"<{tag}>".join(["", *map(entities.escape, t)]) + "</article><footer>y</footer>")
                xs.append(vectors(blocks))
                ys.append(np.array([b.inside for b in blocks], np.float32))
        for again in range(2):
            blocks = leaf_blocks(layout(t, others[i % max(1, len(others)):][:40] + others[:5], 2 * i + again))[:TRAIN_BLOCKS]
            y = np.array([b.text.startswith(MARK) for b in blocks], np.float32)
            for b in blocks:
                b.text = b.text.lstrip(MARK + " ") or " "
            xs.append(vectors(blocks))
            ys.append(y)
    return xs, ys


def main_mask(p: dict | None, pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page, which of its blocks are main text."""
    if p is None:
        return [np.array([NOT_MAIN.isdisjoint(b.names) for b in blocks], bool) for blocks in pages]
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    while order:
        size = len(pages[order[-1]])
        take = order[-max(1, CELLS // size):]
        del order[-len(take):]
        z = logits_in_stretches(p, [pages[i] for i in take], CELLS)
        for j, i in enumerate(take):
            out[i] = z[:len(pages[i]), j] > 0
    return out


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> dict | None:
    """Weights learned from at most ``SAMPLE`` of the pages with an article tag
    (the smallest hashes of the id)."""
    marked = pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).alias("html")).where(
        F.col("html").rlike("(?i)<article[\\s>]") & (F.length("html") < TRAIN_CHARS)).withColumn("hash", unit_hash("id", seed=5))
    # Most pages aren't sorted: about half as many again as are wanted pass the hash.
    rows = marked.where(F.coalesce("hash", F.lit(0.0)) < 1.5 * SAMPLE / max(marked.count(), 1)).orderBy("hash", "id", "html").limit(SAMPLE)
    texts = [r["html"] for r in sorted(rows.collect(), key=lambda r: (r["id"] or "", r["html"]))]
    xs, ys = training_set(texts)
    return train(xs, ys) if xs else None


#: Pages parsed together, so that sequences of like length share steps.
TOGETHER, TOGETHER_CHARS = 256, 4_000_000


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    weights = fit(pages, id_col, html_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str] = []
            held: list[list[Block]] = []
            chars = 0

            def label() -> None:
                out.extend("\n\n".join(b.text for b, m in zip(blocks, mask) if m) for blocks, mask in zip(held, main_mask(weights, held)))
                held.clear()

            for t in batch.column(2):
                page = t.as_py()
                held.append(leaf_blocks(page))
                chars += len(page or "")
                if len(held) >= TOGETHER or chars >= TOGETHER_CHARS:
                    label()
                    chars = 0
            label()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())],
                                             ["id", "url", "text", "n_chars"])

    src = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = src.mapInArrow(each, "id bigint, url string, text string, n_chars bigint")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
