"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks: the text between block-level tags, with the tags, classes, ids and roles on its path.
A bidirectional LSTM in numpy reads one vector per block (hashed path tokens, hashed words and a few shares) in both
directions over the whole page and gives each block the probability of being part of the article.

The tables carry no labels, so the network learns from a bounded sample: ``SAMPLE`` pages of at most ``SAMPLE_CHARS``
characters, the ones with the smallest hash. Blocks whose path holds sectioning elements are labelled by what HTML says
of them; besides, each page's article blocks are laid out anew in random templates (containers, classes, menus, adverts,
forms, comments between and around them), whose labels are known. All pages are then read whole, by mapInArrow.

Defined cases: null and empty pages have no block and an empty text; repeated rows are read each; broken markup never
fails (an open comment, script or tag runs to the end); characters references are decoded once; white space inside a
block, no-break spaces and line breaks included, is one blank; extra columns are ignored. Without any page the result is empty.
"""

from __future__ import annotations

import html as markup
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm.text_arrays import as_bytes, hash_spans, lowered, spans

SAMPLE, SAMPLE_CHARS = 240, 60_000
PATHS, WORDS, WIDTH, HIDDEN, SHARES = 2048, 2048, 24, 16, 6
EPOCHS, RATE = 8, 0.01
ROWS_AT_ONCE = 256

# Element names of the HTML standard.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p
pre search section select summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template iframe noembed noframes xmp svg math object".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDS = frozenset(("ul", "ol", "menu", "dl", "table", "select"))

_TAG = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)()[^>]*>|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % PATHS


@dataclass
class Blocks:
    """Leaf blocks of one page, in order."""

    texts: list[str] = field(default_factory=list)
    paths: list[tuple[int, ...]] = field(default_factory=list)
    names: list[frozenset[str]] = field(default_factory=list)
    linked: list[float] = field(default_factory=list)


def leaf_blocks(page: str | None) -> Blocks:
    """The page's blocks: text, hashed path tokens, the path's tokens, and the share of characters inside links."""
    out, page = Blocks(), page or ""
    # Open elements: name, tokens of the path down to it, their buckets.
    stack: list[tuple[str, frozenset[str], tuple[int, ...]]] = [("", frozenset(), ())]
    opened: dict[str, int] = {}
    words: list[str] = []
    linked = at = 0
    paragraph = None

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(words).split())
        if text:
            name, tokens, buckets = stack[-1]
            out.texts.append(text)
            out.names.append(tokens)
            out.paths.append((*buckets, _bucket("leaf " + next((s[0] for s in reversed(stack) if s[0] in BLOCKS), ""))))
            out.linked.append(min(1.0, linked / len(text)))
        words.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal paragraph
        for name, _, _ in stack[to:]:
            opened[name] -= 1
        del stack[to:]
        if paragraph is not None and paragraph >= to:
            paragraph = None

    def say(text: str) -> None:
        nonlocal linked
        if text:
            text = markup.unescape(text)
            words.append(text)
            if opened.get("a"):
                linked += len(text)

    while True:
        tag = _TAG.search(page, at)
        say(page[at:tag.start() if tag else len(page)])
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        block = name in BLOCKS
        if block:
            flush()
        elif name == "br":
            words.append(" ")
        if tag[1] or tag[4]:
            if opened.get(name):
                to = len(stack) - 1
                while stack[to][0] != name and (block or stack[to][0] not in BLOCKS):
                    to -= 1
                if stack[to][0] == name:
                    pop(to)
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in VOID:
            continue
        if block and paragraph is not None:
            pop(paragraph)
        if any(opened.get(x) for x in _CLOSES.get(name, ())):
            to = len(stack) - 1
            while to and stack[to][0] not in _CLOSES[name] and stack[to][0] not in _HOLDS:
                to -= 1
            if stack[to][0] in _CLOSES[name]:
                pop(to)
        own = {name}
        for kind, a, b, c in _NAMES.findall(tag[3] or ""):
            own.update(f".{piece.lower()}" for piece in _PIECES.findall(a or b or c))
        _, tokens, buckets = stack[-1]
        if not own <= tokens:
            new = sorted(own - tokens)
            tokens, buckets = tokens | own, (*buckets, *map(_bucket, new))
        if name == "p":
            paragraph = len(stack)
        stack.append((name, tokens, buckets))
        opened[name] = opened.get(name, 0) + 1
    flush()
    return out


@dataclass
class Inputs:
    """Blocks of many pages as arrays: ids with the row they belong to, shares, and where each page begins."""

    path: np.ndarray
    path_row: np.ndarray
    word: np.ndarray
    word_row: np.ndarray
    shares: np.ndarray
    begun: np.ndarray


def inputs(pages: list[Blocks]) -> Inputs:
    texts = [t for p in pages for t in p.texts]
    paths = [x for p in pages for x in p.paths]
    begun = np.concatenate([[0], np.cumsum([len(p.texts) for p in pages])]).astype(np.int64)
    data, offsets = as_bytes(pa.array(texts, pa.large_string()))
    starts, ends, row = spans(lowered(data), offsets)
    word = (hash_spans(lowered(data), starts, ends) % np.uint64(WORDS)).astype(np.int64)
    sizes = np.array([len(x) for x in paths], np.int64)
    n_words = np.bincount(row, minlength=len(texts))
    place = np.arange(len(texts)) - np.repeat(begun[:-1], np.diff(begun))
    total = np.repeat(np.diff(begun), np.diff(begun))
    shares = np.stack([
        np.log1p(n_words) / 4, np.array([x for p in pages for x in p.linked], float), np.array([t[-1] in ".!?…\"”»" for t in texts], float),
        place / np.maximum(total, 1), np.minimum(sizes, 40) / 20, np.array([sum(c.isdigit() for c in t[:200]) / min(len(t), 200) for t in texts], float),
    ], 1).astype(np.float32) if texts else np.zeros((0, SHARES), np.float32)
    return Inputs(np.array([x for path in paths for x in path], np.int64), np.repeat(np.arange(len(paths)), sizes), word, row, shares, begun)


def untrained(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shapes = {"path": (PATHS, WIDTH), "word": (WORDS, WIDTH), "share": (SHARES, WIDTH), "bias": (WIDTH,), "out": (2 * HIDDEN + WIDTH,), "out_b": (1,)}
    for d in ("f", "b"):
        shapes |= {f"{d}x": (WIDTH, 4 * HIDDEN), f"{d}h": (HIDDEN, 4 * HIDDEN), f"{d}c": (4 * HIDDEN,)}
    return {k: rng.normal(0, 0.15 if len(s) > 1 else 0.01, s).astype(np.float32) for k, s in shapes.items()}


def _pooled(table: np.ndarray, ids: np.ndarray, row: np.ndarray, n: int, power: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's vectors, summed and divided by their number to ``power``, and that divisor's inverse."""
    out, many = np.zeros((n, table.shape[1]), np.float32), np.bincount(row, minlength=n)
    full = np.flatnonzero(many)
    if len(full):
        out[full] = np.add.reduceat(table[ids], np.searchsorted(row, full))
    scale = (1 / np.maximum(many, 1) ** power).astype(np.float32)
    return out * scale[:, None], scale


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(p: dict[str, np.ndarray], d: str, x: np.ndarray) -> tuple[np.ndarray, list]:
    """States (steps, rows, HIDDEN) of one direction."""
    h = c = np.zeros((x.shape[1], HIDDEN), x.dtype)
    states, kept = np.empty((*x.shape[:2], HIDDEN), x.dtype), []
    into = x @ p[d + "x"] + p[d + "c"]
    for t in range(len(x)):
        z = into[t] + h @ p[d + "h"]
        gates, new = _sigmoid(z[:, :3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN:])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
        kept.append((h, c, i, f, o, new))
        c = f * c + i * new
        h = o * np.tanh(c)
        states[t] = h
    return states, kept


def _lstm_slopes(p: dict[str, np.ndarray], d: str, x: np.ndarray, kept: list, dh_all: np.ndarray, g: dict[str, np.ndarray]) -> np.ndarray:
    dz_all = np.empty((*x.shape[:2], 4 * HIDDEN), x.dtype)
    dh = dc = np.zeros_like(kept[0][0])
    for t in range(len(x) - 1, -1, -1):
        h, c, i, f, o, new = kept[t]
        tc = np.tanh(f * c + i * new)
        dh = dh + dh_all[t]
        dc = dc + dh * o * (1 - tc ** 2)
        dz = np.concatenate([dc * new * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - new ** 2)], 1)
        dz_all[t] = dz
        dh, dc = dz @ p[d + "h"].T, dc * f
    before = np.concatenate([k[0] for k in kept])
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    g[d + "h"], g[d + "x"], g[d + "c"] = before.T @ flat, x.reshape(-1, x.shape[2]).T @ flat, flat.sum(0)
    return dz_all @ p[d + "x"].T


def scores(p: dict[str, np.ndarray], x: Inputs, pages: np.ndarray, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, dict | None]:
    """Rows of the given pages and the score of each; with ``labels`` (1, 0, or -1 for unknown) also the slopes of the mean loss."""
    sizes = np.diff(x.begun)[pages]
    rows = np.concatenate([np.arange(x.begun[q], x.begun[q + 1]) for q in pages]) if len(pages) else np.zeros(0, np.int64)
    column = np.repeat(np.arange(len(pages)), sizes)
    step = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    turned = np.repeat(sizes, sizes) - 1 - step
    index = np.full(len(x.shares), -1)
    index[rows] = np.arange(len(rows))
    parts = []
    for ids, of in ((x.path, x.path_row), (x.word, x.word_row)):
        mine = index[of] >= 0
        order = np.argsort(index[of[mine]], kind="stable")
        parts.append((ids[mine][order], index[of[mine]][order]))
    (path, path_row), (word, word_row) = parts
    (of_path, path_scale), (of_words, word_scale) = _pooled(p["path"], path, path_row, len(rows), 0), _pooled(p["word"], word, word_row, len(rows), 1)
    v = np.tanh(of_path + of_words + x.shares[rows] @ p["share"] + p["bias"])
    shape = (int(sizes.max()) if len(sizes) else 0, len(pages), WIDTH)
    fx, bx = np.zeros(shape, v.dtype), np.zeros(shape, v.dtype)
    fx[step, column], bx[turned, column] = v, v
    fh, f_kept = _lstm(p, "f", fx)
    bh, b_kept = _lstm(p, "b", bx)
    both = np.concatenate([fh[step, column], bh[turned, column], v], 1)
    out = _sigmoid(both @ p["out"] + p["out_b"])
    if labels is None:
        return rows, out, None
    told = labels[rows] >= 0
    slope = (np.where(told, out - labels[rows], 0) / max(int(told.sum()), 1)).astype(v.dtype)
    g = {"out": both.T @ slope, "out_b": slope.sum(keepdims=True)}
    d_both = slope[:, None] * p["out"]
    d_f, d_b = np.zeros_like(fh), np.zeros_like(bh)
    d_f[step, column], d_b[turned, column] = d_both[:, :HIDDEN], d_both[:, HIDDEN:2 * HIDDEN]
    dv = d_both[:, 2 * HIDDEN:] + _lstm_slopes(p, "f", fx, f_kept, d_f, g)[step, column] + _lstm_slopes(p, "b", bx, b_kept, d_b, g)[turned, column]
    dv = dv * (1 - v ** 2)
    g["share"], g["bias"] = x.shares[rows].T @ dv, dv.sum(0)
    for name, ids, of, scale in (("path", path, path_row, path_scale), ("word", word, word_row, word_scale)):
        g[name] = np.zeros_like(p[name])
        np.add.at(g[name], ids, (dv * scale[:, None])[of])
    return rows, out, g


def fit(x: Inputs, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters after ``epochs`` passes of Adam over the pages, 24 at a time."""
    p, rng = untrained(seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    filled = np.flatnonzero(np.diff(x.begun))
    steps = 0
    for _ in range(epochs):
        for pages in np.array_split(rng.permutation(filled), max(1, len(filled) // 24)):
            if not len(pages):
                continue
            steps += 1
            _, _, g = scores(p, x, pages, labels)
            clip = min(1.0, 1.0 / (float(np.sqrt(sum((a ** 2).sum() for a in g.values()))) + 1e-9))
            for k, a in g.items():
                a = a * clip
                m[k], v[k] = 0.9 * m[k] + 0.1 * a, 0.99 * v[k] + 0.01 * a ** 2
                p[k] = p[k] - (RATE * m[k] / (1 - 0.9 ** steps) / (np.sqrt(v[k] / (1 - 0.99 ** steps)) + 1e-6)).astype(np.float32)
    return p


#: Elements whose blocks are, or are not, part of an article by what HTML says of them; class names of adverts and the like.
ARTICLE = frozenset(("article", "main", ".article", ".main"))
OUTSIDE = frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "noscript", ".ad", ".ads", ".advert", ".sidebar", ".menu",
                     ".nav", ".navbar", ".footer", ".header", ".comments", ".comment", ".cookie", ".notice", ".banner", ".related", ".newsletter"))

# Usual containers and wordings of web pages, to lay out sample pages.
_HOLDERS = ["article", "main", "div class=content", "div id=content", "div class=main-content", "div class=post-body", "div class=entry-content", "div class=article-body",
            "div class=story", "section class=article", "section", "td class=content", "div role=main", "div class=text", "div class=post", "div"]
_AROUND = {
    "menu": ["nav", "ul class=menu", "div class=navbar", "div id=nav", "div class=navigation", "div role=navigation", "div class=top-menu", "div class=breadcrumbs"],
    "head": ["header", "div id=header", "div class=masthead", "div class=site-header", "div class=logo", "div role=banner"],
    "side": ["aside", "div class=sidebar", "div id=sidebar", "div class=related", "div class=widget", "div class=right-column", "section class=recommended", "div class=most-read", "div class=tags"],
    "note": ["div class=cookie-notice", "div id=cookie-banner", "div class=notice", "div class=alert", "div class=consent", "dialog", "div class=popup", "noscript", "div class=banner"],
    "ad": ["div class=ad", "div class=advert", "div class=advertisement", "div class=sponsored", "div class=promo", "ins class=ads", "div id=ad-slot", "section class=promotion"],
    "form": ["form", "form class=newsletter", "form class=search", "div class=subscribe", "fieldset", "div class=login"],
    "talk": ["div class=comments", "section id=comments", "div class=comment-area", "div class=comment", "ol class=comment-list", "div class=replies", "div class=reader-comments", "div id=disqus", "div class=discussion", "section class=responses"],
    "foot": ["footer", "div id=footer", "div class=site-footer", "div class=copyright", "div class=bottom", "div role=contentinfo"],
}
_SAID = {
    "head": ["Home", "Log in", "Sign up", "Search", "Welcome"], "side": ["Related articles", "Most read", "Tags", "Recent posts", "About the author"],
    "note": ["We use cookies to improve this site.", "Please enable JavaScript.", "Accept all", "This site uses cookies."], "ad": ["Advertisement", "Sponsored", "Buy now", "Special offer"],
    "form": ["Subscribe to our newsletter", "Your email", "Submit", "Search", "Password", "Send"], "talk": ["Comments", "Reply", "Leave a comment", "2 comments", "says:"],
    "foot": ["© 2024", "All rights reserved.", "Privacy policy", "Terms of use", "Contact us"], "menu": ["Home", "News", "Sports", "About", "Contact", "Archive"],
}


def laid_out(article: list[str], others: list[str], rng: random.Random) -> tuple[str, list[int]]:
    """A page made of the article's blocks and of pieces around and between them, with the label of each block."""
    parts, labels = [], []

    def wrap(holder: str, inner: str) -> str:
        if holder.startswith("td"):
            return f"<table><tr><{holder}>{inner}</td></tr></table>"
        return f"<{holder}>{inner}</{holder.split()[0]}>"

    def piece(kind: str) -> str:
        n, body = rng.choice((1, 2, 4, 6)) if kind != "ad" else 1, []
        for _ in range(n):
            text = rng.choice(_SAID[kind]) if rng.random() < 0.4 else rng.choice(others or ["x"])
            text = text if kind in ("talk", "ad") or rng.random() < 0.2 else " ".join(text.split()[:rng.randint(1, 6)])
            text = markup.escape(text) or "x"
            link = kind in ("menu", "side", "foot") and rng.random() < 0.8
            inner = f'<a href="/x">{text}</a>' if link else text
            body.append(f"<{(tag := rng.choice(('li', 'p', 'div', 'span') if kind != 'form' else ('label', 'button', 'p', 'div')))}>{inner}</{tag}>")
            labels.append(0)
            if tag in ("span", "label"):  # inline pieces of one block
                body[-1] = f"<div>{body[-1]}</div>"
        holder = rng.choice(_AROUND[kind])
        return wrap(holder, "".join(body))

    before = [k for k in ("note", "head", "menu", "ad", "side", "form") if rng.random() < 0.5]
    after = [k for k in ("ad", "side", "form", "talk", "note", "foot") if rng.random() < 0.5]
    parts.extend(piece(k) for k in before)
    inner = []
    for n, text in enumerate(article):
        tag = rng.choice(("h1", "h2", "p")) if n == 0 else rng.choice(("p",) * 6 + ("h2", "h3", "blockquote", "pre", "div", "li", "td"))
        said = markup.escape(text)
        if rng.random() < 0.15 and " " in text:
            first, rest = text.split(" ", 1)
            said = f'<a href="/y">{markup.escape(first)}</a> {markup.escape(rest)}'
        said = f"<{tag}>{said}</{tag}>"
        inner.append({"li": f"<ul>{said}</ul>", "td": f"<table><tr>{said}</tr></table>"}.get(tag, said))
        labels.append(1)
        if rng.random() < 0.12:
            inner.append(piece(rng.choice(("ad", "side", "form", "note"))))
    holder = rng.choice(_HOLDERS)
    holder = rng.choice(("article", "main")) if rng.random() < 0.3 else holder
    parts.append(wrap(holder, "".join(inner)))
    parts.extend(piece(k) for k in after)
    body = "".join(parts)
    return f"<html><body>{wrap(rng.choice(('div class=wrapper', 'div id=page', 'div class=container')), body) if rng.random() < 0.5 else body}</body></html>", labels


def learned(sample: list[str], seed: int = 5) -> dict[str, np.ndarray]:
    """The network, from sample pages and three new layouts of each."""
    rng, pages, labels = random.Random(seed), [], []
    read = [leaf_blocks(page) for page in sample]
    told = [[0 if names & OUTSIDE else 1 if names & ARTICLE else -1 for names in b.names] for b in read]
    others = [t for b, known in zip(read, told) for t, y in zip(b.texts, known) if len(t) < 600]
    for blocks, known in zip(read, told):
        pages.append(blocks)
        labels.extend(known)
        article = [t for t, y in zip(blocks.texts, known) if y == 1] or ([rng.choice(others)] if others else [])
        for _ in range(3 if article else 0):
            page, made = laid_out(article, others, rng)
            again = leaf_blocks(page)
            if len(again.texts) == len(made):
                pages.append(again)
                labels.extend(made)
    return fit(inputs(pages), np.array(labels, np.int64), seed=seed)


def sample_pages(pages: DataFrame, most: int = SAMPLE, chars: int = SAMPLE_CHARS) -> list[str]:
    """``most`` distinct pages of at most ``chars`` characters, those with the smallest hash."""
    kept = pages.where(F.length("html").between(1, chars)).select("html", F.xxhash64("html").alias("h"))
    # Copies count once: hashes are made distinct before any page moves.
    chosen = kept.select("h").distinct().orderBy("h").limit(most)
    rows = kept.join(F.broadcast(chosen), "h", "left_semi").groupBy("h").agg(F.min("html").alias("html"))
    return sorted({r["html"] for r in rows.collect()})  # at most ``most`` pages of ``chars`` characters


def page_blocks(pages: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """page_id, url and ``blocks`` (array of text and score, in page order). One row for each row of ``pages``."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("text", pa.string()), ("score", pa.float32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                read = [leaf_blocks(v.as_py()) for v in batch.column("html")]
                x = inputs(read)
                score = np.zeros(int(x.begun[-1]), np.float32)
                sizes = np.diff(x.begun)
                order = np.argsort(sizes, kind="stable")
                order = order[sizes[order] > 0]
                while len(order):
                    # The longest pages first; as many as fit a grid of bounded size.
                    n = int(max(1, min(64, 200_000 // max(int(sizes[order[-1]]), 1))))
                    rows, out, _ = scores(shared.value, x, order[-n:])
                    score[rows] = out
                    order = order[:-n]
                values = pa.StructArray.from_arrays([pa.array([t for b in read for t in b.texts], pa.string()), pa.array(score)], fields=list(kind))
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.ListArray.from_arrays(pa.array(x.begun.astype(np.int32)), values)],
                                                 ["page_id", "url", "blocks"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, blocks array<struct<text: string, score: float>>")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = page_blocks(pages, learned(sample_pages(pages)))
    text = F.array_join(F.transform(F.filter("blocks", lambda b: b["score"] >= 0.5), lambda b: b["text"]), "\n")
    return rows.select("page_id", "url", text.alias("text")).select("*", F.length("text").cast("long").alias("n_chars"))
