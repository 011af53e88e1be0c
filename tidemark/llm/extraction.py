"""Main text of web pages: a recurrent block labeller.

A page becomes its leaf blocks in order.  A block is described by its tag path (tags, class and id words of the open elements), by
its hashed words and by a few measures; a bidirectional LSTM reads the whole sequence, so each decision sees the page on both
sides.  Training takes a bounded sample of pages whose own markup says what is article and what is not, and lays their texts out
anew in many page shapes, so that the model learns from paths, words and neighbours rather than from one template.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_chunk, smallest_hashes

TRAINING_PAGES = 160
LAYOUTS_PER_PAGE = 6
LONGEST_TRAINING_PAGE = 40_000
SHORT_SHARE = 0.2
STRANGE_SHARE = 0.25
PATH_BUCKETS, WORD_BUCKETS = 1024, 1024
PATH_WIDTH, WORD_WIDTH, MEASURES, HIDDEN = 16, 8, 6, 24

# Fixed values of HTML: elements that end a text block, that have no content, and whose content is not text of the page.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
                       "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript "
                       "object ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title "
                       "tr ul video audio".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template iframe textarea title svg math object select".split())
MARKUP = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


@dataclass
class _Open:
    path: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    words = [w for found in NAMES.findall(attributes) for w in NAME_WORD.findall("".join(found).lower())] if "=" in attributes else []
    return (tag, *(f".{w}" for w in words))


def blocks(source: str) -> list[Block]:
    """Leaf blocks with text, in page order: references decoded, white space runs one blank, trimmed."""
    out: list[Block] = []
    state = _Open()

    def close() -> None:
        if state.text:
            text = SPACE.sub(" ", "".join(state.text)).strip()
            if text:
                out.append(Block(tuple(n for _, names in state.path for n in names), text, state.linked))
            state.text, state.linked = [], 0

    def add(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            state.text.append(text)
            if state.links:
                state.linked += len(text)

    at, lower = 0, None
    while True:
        found = MARKUP.search(source, at)
        if not found:
            add(source[at:])
            break
        add(source[at:found.start()])
        at = found.end()
        tag = (found.group(2) or found.group(5) or "").lower()
        if not tag:
            if found.group().startswith("<![CDATA["):
                state.text.append(found.group()[9:].removesuffix("]]>"))
            continue
        ends = bool(found.group(1) or found.group(4))
        if tag in BLOCK_TAGS:
            close()
        elif tag == "br":
            state.text.append(" ")
        if ends:
            for k in range(len(state.path) - 1, -1, -1):
                if state.path[k][0] == tag:
                    state.links -= sum(t == "a" for t, _ in state.path[k:])
                    del state.path[k:]
                    break
            continue
        if tag in RAW_TAGS:
            lower = source.lower() if lower is None else lower
            if len(lower) != len(source):
                lower = re.sub(r"[A-Z]", lambda m: m.group().lower(), source)
            stop = lower.find(f"</{tag}", at)
            at = len(source) if stop < 0 else stop
            if stop >= 0:
                gone = source.find(">", stop)
                at = len(source) if gone < 0 else gone + 1
            continue
        if tag in VOID_TAGS:
            continue
        if tag in BLOCK_TAGS:
            for same in (("p",) if tag != "li" else ("p", "li")):
                for k in range(len(state.path) - 1, -1, -1):
                    if state.path[k][0] == same:
                        state.links -= sum(t == "a" for t, _ in state.path[k:])
                        del state.path[k:]
                        break
                    if state.path[k][0] in BLOCK_TAGS and state.path[k][0] not in ("p", "li"):
                        break
        state.path.append((tag, _names(tag, found.group(3) or found.group(6) or "")))
        state.links += tag == "a"
    close()
    return out


def _bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


class Describer:
    """Blocks of pages as arrays; buckets of words already met are kept in a bounded table."""

    def __init__(self) -> None:
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words: dict[str, int] = {}

    def _path(self, path: tuple[str, ...]) -> np.ndarray:
        got = self.paths.get(path)
        if got is None:
            if len(self.paths) > 100_000:
                self.paths.clear()
            got = self.paths[path] = np.array([_bucket(p, PATH_BUCKETS) for p in dict.fromkeys(path)] or [0])
        return got

    def _word(self, word: str) -> int:
        got = self.words.get(word)
        if got is None:
            if len(self.words) > 300_000:
                self.words.clear()
            got = self.words[word] = _bucket(word, WORD_BUCKETS)
        return got

    def describe(self, page: list[Block]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        paths, words, measures = [], [], np.zeros((len(page), MEASURES))
        for i, b in enumerate(page):
            parts = b.text.split(" ")
            paths.append(self._path(b.path))
            words.append(np.array([self._word(w) for w in parts]))
            stops = sum(map(b.text.count, ".,;:!?"))
            measures[i] = (np.log1p(len(parts)) / 5, min(1.0, b.linked / len(b.text)), min(1.0, 5 * stops / len(parts)),
                           i / len(page), len(b.path) / 20, b.text[-1] in ".!?:\"'")
        return paths, words, measures


def _mean_rows(weights: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = np.array([len(r) for r in rows])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), counts)
    total = np.add.reduceat(weights[flat], np.cumsum(counts) - counts, axis=0)
    return total / counts[:, None], flat, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Labeller:
    """Weights of the network; ``forward`` reads pages of equal padding, ``learn`` takes one Adam step on them."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        width = PATH_WIDTH + WORD_WIDTH + MEASURES
        def new(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0] if len(shape) > 1 else 1), shape)
        self.p = {"path": rng.normal(0, 0.3, (PATH_BUCKETS, PATH_WIDTH)), "word": rng.normal(0, 0.3, (WORD_BUCKETS, WORD_WIDTH)),
                  "out": new(2 * HIDDEN, 1), "out_b": np.zeros(1)}
        for side in "lr":
            self.p[f"x{side}"], self.p[f"h{side}"], bias = new(width, 4 * HIDDEN), new(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN)
            bias[HIDDEN:2 * HIDDEN] = 1.0
            self.p[f"b{side}"] = bias
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.steps = 0

    def _inputs(self, pages: list[tuple]) -> tuple:
        lengths = np.array([len(x[0]) for x in pages])
        path, flat_p, own_p = _mean_rows(self.p["path"], [r for x in pages for r in x[0]])
        word, flat_w, own_w = _mean_rows(self.p["word"], [r for x in pages for r in x[1]])
        rows = np.concatenate([path, word, np.concatenate([x[2] for x in pages])], axis=1)
        mask = np.arange(lengths.max())[None, :] < lengths[:, None]
        x = np.zeros((*mask.shape, rows.shape[1]))
        x[mask] = rows
        return x, mask, (flat_p, own_p, flat_w, own_w)

    def _pass(self, side: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        n, steps, _ = x.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out, saved = np.zeros((n, steps, HIDDEN)), []
        gates_x = x @ self.p[f"x{side}"] + self.p[f"b{side}"]
        for t in range(steps) if side == "l" else range(steps - 1, -1, -1):
            live = mask[:, t, None]
            g = gates_x[:, t] + h @ self.p[f"h{side}"]
            i, f, o = _sigmoid(g[:, :HIDDEN]), _sigmoid(g[:, HIDDEN:2 * HIDDEN]), _sigmoid(g[:, 2 * HIDDEN:3 * HIDDEN])
            a = np.tanh(g[:, 3 * HIDDEN:])
            c_new = f * c + i * a
            tc = np.tanh(c_new)
            if keep:
                saved.append((t, live, h, c, i, f, o, a, tc))
            h, c = np.where(live, o * tc, h), np.where(live, c_new, c)
            out[:, t] = h
        return out, saved

    def forward(self, pages: list[tuple]) -> list[np.ndarray]:
        """The probability of article text for every block of every page."""
        x, mask, _ = self._inputs(pages)
        both = np.concatenate([self._pass("l", x, mask, False)[0], self._pass("r", x, mask, False)[0]], axis=2)
        p = _sigmoid(both @ self.p["out"] + self.p["out_b"])[:, :, 0]
        return [p[k, :int(m.sum())] for k, m in enumerate(mask)]

    def learn(self, pages: list[tuple], labels: list[np.ndarray], rate: float = 0.01) -> float:
        x, mask, (flat_p, own_p, flat_w, own_w) = self._inputs(pages)
        hl, sl = self._pass("l", x, mask, True)
        hr, sr = self._pass("r", x, mask, True)
        both = np.concatenate([hl, hr], axis=2)
        p = _sigmoid(both @ self.p["out"] + self.p["out_b"])[:, :, 0]
        y = np.zeros(mask.shape)
        y[mask] = np.concatenate(labels)
        n = mask.sum()
        dz = np.where(mask, p - y, 0.0)[:, :, None] / n
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["out"], grad["out_b"] = np.einsum("nth,nto->ho", both, dz), dz.sum((0, 1))
        dboth = dz @ self.p["out"].T
        dx = np.zeros_like(x)
        for side, saved, dout in (("l", sl, dboth[:, :, :HIDDEN]), ("r", sr, dboth[:, :, HIDDEN:])):
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            for t, live, h0, c0, i, f, o, a, tc in reversed(saved):
                dh = dh + dout[:, t]
                dhl = np.where(live, dh, 0.0)
                dcl = np.where(live, dc, 0.0) + dhl * o * (1 - tc ** 2)
                dg = np.concatenate([dcl * a * i * (1 - i), dcl * c0 * f * (1 - f), dhl * tc * o * (1 - o), dcl * i * (1 - a ** 2)], axis=1)
                grad[f"h{side}"] += h0.T @ dg
                grad[f"x{side}"] += x[:, t].T @ dg
                grad[f"b{side}"] += dg.sum(0)
                dx[:, t] += dg @ self.p[f"x{side}"].T
                dh = np.where(live, dg @ self.p[f"h{side}"].T, dh)
                dc = np.where(live, dcl * f, dc)
        rows = dx[mask]
        for name, part, flat, own in (("path", rows[:, :PATH_WIDTH], flat_p, own_p), ("word", rows[:, PATH_WIDTH:PATH_WIDTH + WORD_WIDTH], flat_w, own_w)):
            np.add.at(grad[name], flat, (part / np.bincount(own)[:, None])[own])
        self.steps += 1
        for k, g in grad.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g ** 2
            self.p[k] -= rate * (self.m[k] / (1 - 0.9 ** self.steps)) / (np.sqrt(self.v[k] / (1 - 0.99 ** self.steps)) + 1e-8)
        return float(-np.mean(np.log(np.where(y == 1, p, 1 - p)[mask] + 1e-12)))


MARK = "\x02"
# The element and names that pages commonly give to each part.
ARTICLE_SHELLS = ("article", "main", 'div class="content"', 'div id="main-content"', 'div class="post-body"', 'div class="entry-content"',
                  'section class="article-body"', 'div class="story"', 'div role="main"', 'div class="text"', "div", "section")
SIDE_SHELLS = {
    "menu": ("nav", 'div class="menu"', 'div id="navigation"', 'ul class="nav"', 'div class="breadcrumb"', 'div class="topbar links"'),
    "head": ("header", 'div class="header"', 'div id="masthead"', 'div class="site-title"'),
    "foot": ("footer", 'div class="footer"', 'div id="foot"', 'div class="copyright"'),
    "side": ("aside", 'div class="sidebar"', 'div id="right-column"', 'div class="related"', 'div class="widget"', 'section class="more-stories"'),
    "note": ('div class="cookie-notice"', 'div class="banner"', 'div id="consent"', 'div class="notice"', 'div role="alert"', 'div class="popup"',
             'div class="newsletter"', 'p class="disclaimer"'),
    "adverts": ('div class="ad"', 'div class="advert"', 'div class="sponsored"', 'div id="promo"', 'aside class="ads"', 'section class="advertisement"'),
    "form": ("form", 'form class="search"', 'form id="login"', 'div class="subscribe form"'),
    "talk": ('section class="comments"', 'div id="comments"', 'div class="comment-list"', 'ol class="commentlist"', 'div class="discussion replies"',
             'section id="reader-comments"'),
}


def cut_short(text: str, rng: np.random.Generator) -> str:
    """The first words of a paragraph as a sentence of its own."""
    words = " ".join(text.split(" ")[:int(rng.integers(1, 4))]).rstrip(".,;:!?") or "-"
    return words + (".", ".", "!", "?", "")[int(rng.integers(5))]


def laid_out(article: list[str], other: list[str], rng: np.random.Generator) -> str:
    """A page of a random shape; article blocks begin with MARK."""

    def pick(options: tuple[str, ...]) -> str:
        return options[int(rng.integers(len(options)))]

    def shell(name: str, inner: str) -> str:
        return f"<{name}>{inner}</{name.split()[0]}>"

    def some() -> str:
        words = html.escape(other[int(rng.integers(len(other)))]).split(" ")
        return " ".join(words[:int(rng.integers(1, 30))])

    def links(n: int) -> str:
        inner = "".join(f'<li><a href="/{k}">{some()}</a></li>' for k in range(n))
        return f"<ul>{inner}</ul>" if rng.random() < 0.7 else re.sub("</?li>", " ", inner)

    def part(kind: str) -> str:
        if kind == "menu" or kind in ("side", "foot") and rng.random() < 0.5:
            inner = links(int(rng.integers(2, 9)))
        elif kind == "form":
            inner = f'<label>{some()}</label><input name="q"><button>{some()}</button>'
        elif kind == "talk":
            tag = pick(("p", "div", 'li class="comment"', 'div class="comment-text"'))
            texts = [html.escape(article[int(rng.integers(len(article)))]) for _ in range(int(rng.integers(1, 5)))]
            inner = (f"<h3>{some()}</h3>" if rng.random() < 0.5 else "") + "".join(shell(tag, t) for t in texts)
        else:
            inner = "".join(shell("p", some()) if rng.random() < 0.5 else some() for _ in range(int(rng.integers(1, 3))))
        return shell(pick(SIDE_SHELLS[kind]), inner)

    body = []
    for k, text in enumerate(article):
        # a paragraph of a word or two says nothing of its own, so that its path and neighbours must decide
        kept = cut_short(text, rng) if rng.random() < SHORT_SHARE else text
        safe = MARK + html.escape(kept)
        tag = "h1" if k == 0 and rng.random() < 0.8 else pick(("p", "p", "p", "p", "p", "p", "h2", "li", "blockquote", "div", "pre", "td"))
        inner = f"<b>{safe}</b>" if rng.random() < 0.1 else safe
        if rng.random() < 0.05:
            inner = f'{inner} <a href="/x">{some()}</a>'
        if tag == "li":
            body.append(f"<ul><li>{inner}</li></ul>")
        elif tag == "td":
            body.append(f"<table><tr><td>{inner}</td></tr></table>")
        else:
            body.append(f"<{tag}>{inner}" + ("" if tag == "p" and rng.random() < 0.1 else f"</{tag}>"))
        if rng.random() < 0.04:
            body.append(part(pick(("adverts", "note", "side", "form"))))
    core = shell(pick(ARTICLE_SHELLS), "".join(body) + (part(pick(("talk", "side", "foot"))) if rng.random() < 0.2 else ""))
    before = [part(k) for k in ("note", "head", "menu", "adverts", "form", "side") if rng.random() < 0.5]
    after = [part(k) for k in ("talk", "side", "adverts", "note", "menu", "form") if rng.random() < 0.4]
    rng.shuffle(before)
    rng.shuffle(after)
    inner = "".join(before) + core + "".join(after) + (part("foot") if rng.random() < 0.85 else "")
    if rng.random() < 0.3:
        inner = shell(pick(('div class="wrapper"', 'div id="page"', "div")), inner)
    return f"<html><head><title>x</title></head><body>{inner}</body></html>"


def own_labels(page: list[Block]) -> np.ndarray:
    """What the page's own semantic elements say: article text is inside ``article`` or ``main`` and not inside a marked-off part."""
    return np.array([bool({"article", "main"} & set(b.path)) and not {"nav", "aside", "footer", "header", "form", ".ad"} & set(b.path)
                     for b in page], dtype=float)


def fit(pages: list[str], layouts: int = LAYOUTS_PER_PAGE, epochs: int = 6, batch: int = 16, seed: int = 5) -> Labeller:
    """Train on ``layouts`` new shapes of each page and on the page itself, some article blocks cut to a word or two in all of them.

    Pages without both classes lend nothing; with no usable page the labeller stays untrained around one half.
    """
    rng, describer, cases = np.random.default_rng(seed), Describer(), []

    def add(page: list[Block], label: np.ndarray) -> None:
        paths, words, measures = describer.describe(page)
        # some blocks get the words of no language, so that no single word decides
        strange = rng.random(len(words)) < STRANGE_SHARE
        cases.append(((paths, [rng.integers(0, WORD_BUCKETS, len(w)) if odd else w for w, odd in zip(words, strange)], measures), label))

    for source in pages:
        page = blocks(source)
        y = own_labels(page) if page else np.empty(0)
        if not len(y) or y.all() or not y.any():
            continue
        article, other = [b.text for b, k in zip(page, y) if k], [b.text for b, k in zip(page, y) if not k]
        for _ in range(layouts):
            first = int(rng.integers(len(article)))
            made = blocks(laid_out(article[first:first + int(rng.integers(2, 26))], other, rng))
            label = np.array([MARK in b.text for b in made], dtype=float)
            for b in made:
                b.text = b.text.replace(MARK, "").strip() or "-"
            add(made, label)
        if len(page) <= 200:
            for b, k in zip(page, y):
                b.text = cut_short(b.text, rng) if k and rng.random() < SHORT_SHARE else b.text
            add(page, y)
    model = Labeller()
    steps, total = 0, max(1, epochs * (len(cases) // batch + 1))
    for _ in range(epochs):
        order = sorted(rng.permutation(len(cases)), key=lambda k: len(cases[k][1]) // 8)
        groups = [order[k:k + batch] for k in range(0, len(order), batch)]
        for g in rng.permutation(len(groups)):
            chosen = [cases[k] for k in groups[g]]
            model.learn([c[0] for c in chosen], [c[1] for c in chosen], rate=0.01 * (1 - steps / total) + 0.0005)
            steps += 1
    return model


def train(pages: DataFrame, training_pages: int = TRAINING_PAGES) -> Labeller:
    """Fit on at most ``training_pages`` pages, those with the smallest hashes of their id.

    NULL ids and html and pages of more than ``LONGEST_TRAINING_PAGE`` characters are left out of the training.
    """
    known = pages.select("page_id", "html").where(F.col("page_id").isNotNull() & F.col("html").isNotNull())
    chosen = smallest_hashes(known.select("page_id"), training_pages, known.count(), "page_id").distinct()
    sample = known.join(F.broadcast(chosen), "page_id").where(F.length("html") <= LONGEST_TRAINING_PAGE)
    return fit([r["html"] for r in sample.orderBy(F.xxhash64("page_id"), "page_id", F.xxhash64("html")).limit(training_pages).collect()])


def extract(pages: DataFrame, model: Labeller, threshold: float = 0.5) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    NULL, empty and text-less html give an empty text; ids and urls may be NULL; repeated rows give equal texts; html is read whole,
    cut-off markup at its end is dropped; an empty table gives no rows; further columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast({k: v.astype(np.float32) for k, v in model.p.items()})

    def work() -> object:
        labeller, describer = Labeller(), Describer()
        labeller.p = shared.value

        def texts(cols: dict[str, pa.Array], sources: list[str]) -> pa.RecordBatch:
            parsed = [blocks(s) for s in sources]
            out = [""] * len(sources)
            order = sorted((k for k, page in enumerate(parsed) if page), key=lambda k: len(parsed[k]))
            for a in range(0, len(order), 64):
                group = order[a:a + 64]
                for k, p in zip(group, labeller.forward([describer.describe(parsed[k]) for k in group])):
                    out[k] = "\n".join(b.text for b, q in zip(parsed[k], p) if q >= threshold)
            return pa.RecordBatch.from_arrays([cols["page_id"], cols["url"], pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
                                              names=["page_id", "url", "text", "n_chars"])
        return texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from per_chunk(work(), "html")(batches)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
