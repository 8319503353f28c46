"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import html as html_lib
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by their part in the layout.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul button textarea xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What browsers never show as text; it ends at its own end tag only, or with the page.
RAW = frozenset("script style template iframe noframes noembed".split())
TEXT_ONLY = frozenset("title textarea xmp".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"), "body": ("head",)}
_HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "optgroup": ("select",)}
_KEEPS_P = ("td", "th", "li", "div", "article", "section", "table")
#: Elements in which a trailing slash closes an element at once.
_FOREIGN = frozenset(("svg", "math"))

_MARKUP = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
_NAMING = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WHITE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?;:](?:\s|$)")
_end_tags = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for name in sorted(RAW | TEXT_ONLY)}


@dataclass(frozen=True)
class Block:
    """A run of text between block-level tags. near: the block-level elements next to it, the outer one first; linked: characters within links."""

    text: str
    near: tuple[str, ...]
    linked: int


@dataclass
class Page:
    """A page's blocks in its order, and its features: (name, first block, block after the last) for every stretch of blocks that has one."""

    blocks: list[Block]
    features: list[tuple[str, int, int]]


class _Stack:
    """The open elements. What an element says of the blocks in it is noted once, when it closes, and each step looks only at the
    nearest element of a name: the time grows with the page, however deep it nests."""

    def __init__(self):
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.active: dict[str, list[int]] = {}
        self.said: list[tuple[str, int, int]] = []

    def nearest(self, names: tuple[str, ...]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def push(self, name: str, words: tuple[str, ...], block: int) -> None:
        told = ("in:" + name, *("name:" + w for w in words))
        self.places.setdefault(name, []).append(len(self.open))
        if name in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append((name, told))
        for f in told:
            self.active.setdefault(f, []).append(block)

    def cut(self, place: int, block: int) -> None:
        """Closes the elements from place on."""
        while len(self.open) > place:
            name, told = self.open.pop()
            self.places[name].pop()
            if name in BLOCKS:
                self.blocks.pop()
            for f in told:
                since = self.active[f].pop()
                # Inside another element that says the same, the outer one's stretch holds this one.
                if not self.active[f] and block > since:
                    self.said.append((f, since, block))

    def close(self, names: tuple[str, ...], wall: int, block: int) -> None:
        """Closes the nearest element of these names, unless an element at `wall` or above it stands between."""
        place = self.nearest(names)
        if place > wall:
            self.cut(place, block)

    def near(self) -> tuple[str, ...]:
        return tuple(self.open[k][0] for k in self.blocks[-2:])


def read_page(page: str) -> Page:
    """The leaf blocks of a page in its order, character references decoded, white space inside a block one space, and their features."""
    out: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    links: list[str] = []

    def flush() -> None:
        if parts:
            text = _WHITE.sub(" ", html_lib.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, stack.near(), len(_WHITE.sub(" ", "".join(links)).strip())))
            parts.clear()
            links.clear()

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if stack.places.get("a"):
                links.append(text)

    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ends, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW:
            if not ends:
                after = _end_tags[name].search(page, at)
                at = after.end() if after else n
            continue
        if name == "br":
            add(" ")
            continue
        foreign = stack.nearest(tuple(_FOREIGN)) >= 0
        if name in BLOCKS and not foreign:
            flush()
        if ends:
            stack.close((name,), -1 if name in BLOCKS or name in _FOREIGN else stack.blocks[-1] if stack.blocks else -1, len(out))
            continue
        if name in VOID or (foreign or name in _FOREIGN) and attributes.rstrip().endswith("/"):
            continue
        if not foreign:
            if name in CLOSES:
                stack.close(CLOSES[name], stack.nearest(_HOLDS.get(name, ())), len(out))
            if name in BLOCKS:
                stack.close(("p",), stack.nearest(_KEEPS_P), len(out))
        words = tuple(dict.fromkeys(w.lower() for a in _NAMING.finditer(attributes) for w in _NAME_WORD.findall(a[1] or a[2] or a[3] or ""))) if attributes else ()
        stack.push(name, words, len(out))
        if name in TEXT_ONLY and not foreign:
            after = _end_tags[name].search(page, at)
            end = after.start() if after else n
            # Of these only xmp takes character references as they are written.
            add(html_lib.escape(page[at:end]) if name == "xmp" else page[at:end])
            at = end
    flush()
    stack.cut(0, len(out))
    return Page(out, stack.said + [(f, k, k + 1) for k, b in enumerate(out) for f in _looks(b)] + _surroundings(out))


def leaf_blocks(page: str) -> list[Block]:
    return read_page(page).blocks


def _looks(b: Block) -> list[str]:
    """What a block's text and nearest elements look like."""
    n = len(b.text)
    share = b.linked / n
    out = [
        "tag:" + (b.near[-1] if b.near else "-"),
        "pair:" + "/".join(b.near),
        "size:" + str(min(8, n.bit_length())),
        "links:" + ("none" if not share else "some" if share < 0.5 else "most"),
        "sentences:" + str(min(3, sum(1 for _ in islice(_SENTENCE.finditer(b.text), 3)))),
    ]
    if "©" in b.text or "|" in b.text and n < 120:
        out.append("sign")
    return out


#: Characters of a block that reads as running text, if at most a third of them are links.
_LONG = 60


def _surroundings(blocks: list[Block]) -> list[tuple[str, int, int]]:
    """What stands next to each block: running text, and how many blocks of links in a row it is one of."""
    long = [len(b.text) >= _LONG and 3 * b.linked <= len(b.text) for b in blocks]
    most = [2 * b.linked >= len(b.text) for b in blocks]
    before, after = [False] * len(blocks), [False] * len(blocks)
    for k in range(1, len(blocks)):
        before[k] = before[k - 1] or long[k - 1]
    for k in range(len(blocks) - 2, -1, -1):
        after[k] = after[k + 1] or long[k + 1]
    out, k = [], 0
    while k < len(blocks):
        end = k + 1
        while end < len(blocks) and most[end] == most[k]:
            end += 1
        if most[k]:
            beside = (k > 0 and long[k - 1]) + (end < len(blocks) and long[end])
            out += [(f"run:{min(3, end - k)}", k, end), (f"run beside:{beside}", k, end)]
        k = end
    for k, b in enumerate(blocks):
        where = "between" if before[k] and after[k] else "after" if before[k] else "ahead" if after[k] else "alone"
        kind = "long" if long[k] else "links" if most[k] else "short"
        tag = b.near[-1] if b.near else "-"
        out += [(f"{kind} {where}", k, k + 1), (f"{kind} in {tag}", k, k + 1)]
    return out


@dataclass
class Crf:
    """A binary chain: weights of features for 'main text' over 'other', and of the four transitions and two starts."""

    weights: dict[str, float]
    steps: list[list[float]]
    starts: list[float]

    def scores(self, page: Page) -> list[float]:
        """What the features of each block say for 'main text'."""
        change = [0.0] * (len(page.blocks) + 1)
        get = self.weights.get
        for f, a, b in page.features:
            w = get(f)
            if w is not None:
                change[a] += w
                change[b] -= w
        return list(accumulate(change[:-1]))

    def viterbi(self, scores: list[float]) -> list[int]:
        """The likeliest labels; ties go to 'other'."""
        if not scores:
            return []
        back = []
        (oo, om), (mo, mm) = self.steps
        other, main = self.starts[0], self.starts[1] + scores[0]
        for e in scores[1:]:
            a, b, c, d = other + oo, main + mo, other + om, main + mm
            back.append((int(b > a), int(d > c)))
            other, main = max(a, b), max(c, d) + e
        out = [int(main > other)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


#: Blocks of one chain in training; longer pages are trained on in pieces of this length, all of them.
CHAIN = 128


def train(pages: list[Page], labels: list[list[int]], least: int = 3, l2: float = 1e-3, steps: int = 250) -> Crf:
    """Penalised maximum likelihood by full-batch gradient steps; forward-backward runs over all chains at once. The same pages give the
    same model. Pages of more than CHAIN blocks are chains of CHAIN blocks, of which only the first has a start."""
    pairs = [(p, y) for p, y in zip(pages, labels) if p.blocks]
    if not pairs:
        return Crf({}, [[0.0, 0.0], [0.0, 0.0]], [0.0, 0.0])
    base = np.concatenate([[0], np.cumsum([len(p.blocks) for p, _ in pairs])])
    every = int(base[-1])
    count: Counter[str] = Counter()
    for p, _ in pairs:
        for f, a, b in p.features:
            count[f] += b - a
    names = sorted(x for x, c in count.items() if c >= least)
    index = {x: i for i, x in enumerate(names)}
    stretches = np.array([(index[f], o + a, o + b) for (p, _), o in zip(pairs, base.tolist()) for f, a, b in p.features if f in index], np.int64).reshape(-1, 3)
    col, from_, to = stretches.T
    # The chains, as rows of a table of blocks; -1 where a row has ended.
    chains = [(o + k, min(o + k + CHAIN, e), k == 0) for o, e in zip(base[:-1].tolist(), base[1:].tolist()) for k in range(0, e - o, CHAIN)]
    n, t_max = len(chains), max(b - a for a, b, _ in chains)
    where = np.full((n, t_max), -1, np.int64)
    for r, (a, b, _) in enumerate(chains):
        where[r, : b - a] = np.arange(a, b)
    here, opens = where >= 0, np.array([o for _, _, o in chains])
    gold_of = np.concatenate([np.array(y, np.int64) for _, y in pairs])
    gold = np.where(here, gold_of[where], 0)
    both = here[:, 1:]
    k = len(names)
    theta, m, v = np.zeros(k + 6), np.zeros(k + 6), np.zeros(k + 6)

    def by_feature(of_block: np.ndarray) -> np.ndarray:
        """Sums over each feature's blocks."""
        upto = np.concatenate([[0.0], np.cumsum(of_block)])
        return np.bincount(col, upto[to] - upto[from_], k)

    seen = np.concatenate([by_feature(gold_of.astype(float)), np.zeros(6)])
    np.add.at(seen, k + 2 * gold[:, :-1][both] + gold[:, 1:][both], 1)
    np.add.at(seen, k + 4 + gold[opens, 0], 1)
    for step in range(1, steps + 1):
        change = np.bincount(from_, theta[col], every + 1) - np.bincount(to, theta[col], every + 1)
        e = np.where(here, np.cumsum(change)[where], 0.0)
        trans, start = theta[k : k + 4].reshape(2, 2), theta[k + 4 :]
        alpha, beta = np.zeros((t_max, n, 2)), np.zeros((t_max, n, 2))
        alpha[0] = np.where(opens[:, None], start[None, :], 0.0)
        alpha[0, :, 1] += e[:, 0]
        for t in range(1, t_max):
            a = np.logaddexp(alpha[t - 1][:, 0, None] + trans[0], alpha[t - 1][:, 1, None] + trans[1])
            a[:, 1] += e[:, t]
            alpha[t] = np.where(here[:, t, None], a, alpha[t - 1])
        log_z = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
        pair = np.zeros(4)
        for t in range(t_max - 2, -1, -1):
            ahead = beta[t + 1].copy()
            ahead[:, 1] += e[:, t + 1]
            joint = alpha[t][:, :, None] + trans[None] + ahead[:, None, :] - log_z[:, None, None]
            pair += (np.exp(joint) * here[:, t + 1, None, None]).sum(0).reshape(4)
            b = np.logaddexp(trans[:, 0][None] + ahead[:, 0, None], trans[:, 1][None] + ahead[:, 1, None])
            beta[t] = np.where(here[:, t + 1, None], b, 0.0)
        main = np.exp(alpha[:, :, 1] + beta[:, :, 1] - log_z[None]).T
        of_block = np.zeros(every)
        of_block[where[here]] = main[here]
        first = (np.exp(alpha[0] + beta[0] - log_z[:, None]) * opens[:, None]).sum(0)
        expected = np.concatenate([by_feature(of_block), pair, first])
        grad = (expected - seen) / every + l2 * theta * 0.1
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.15 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf({x: float(w) for x, w in zip(names, theta)}, theta[k : k + 4].reshape(2, 2).tolist(), theta[k + 4 :].tolist())


# Elements around and inside the layouts that training pages are laid out in. {} takes a text of the page; + marks main text.
_FRAMES = (
    ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="post-content">', "</div>"), ('<div id="content"><div class="entry">', "</div></div>"),
    ('<div class="article-body">', "</div>"), ('<section class="story">', "</section>"), ('<div id="main" role="main">', "</div>"),
)
_BEFORE = (
    "<nav><ul>{li}</ul></nav>", '<div class="menu"><ul>{li}</ul></div>', "<header><p>{}</p></header>", '<div id="header"><h2>{}</h2><ul>{li}</ul></div>', '<div class="cookie-notice"><p>{}</p><button>{}</button></div>', '<div class="ad">{}</div>',
    '<form action="/s"><label>{}</label><input name="q"><button>{}</button></form>', '<div class="banner notice">{}</div>', '<ul class="breadcrumb">{li}</ul>', '<aside class="sidebar"><h3>{}</h3><p>{}</p><ul>{li}</ul></aside>',
)
_AFTER = (
    "<footer>{}</footer>", '<div id="footer"><p>© {}</p><ul>{li}</ul></div>', "<aside><h3>{}</h3><p>{}</p></aside>", '<div class="sidebar widget"><p>{}</p><ul>{li}</ul></div>', '<section class="comments"><h3>{}</h3><div class="comment"><p>{}</p></div><div class="comment"><p>{}</p></div></section>',
    '<div id="comments"><ol><li class="comment"><p>{}</p></li><li class="comment"><p>{}</p></li></ol><form><textarea>{}</textarea><button>{}</button></form></div>', '<div class="related"><h4>{}</h4><ul>{li}</ul></div>', '<div class="newsletter signup"><form><p>{}</p><input><button>{}</button></form></div>', '<div class="share social"><a href="#">{}</a><a href="#">{}</a></div>',
    '<div class="ad sponsored"><p>{}</p></div>',
)
_INSIDE = ('<div class="ad">{}</div>', '<aside class="promo"><p>{}</p></aside>', '<div class="share"><a href="#">{}</a></div>', '<form class="subscribe"><p>{}</p><input></form>', '<div class="notice"><p>{}</p></div>')
# Layouts that name nothing, and names that say nothing: then texts, links and neighbours have to tell. # takes a drawn name.
_PLAIN_FRAMES = (("", ""), ("<div>", "</div>"), ("<div><div>", "</div></div>"), ('<div class="#">', "</div>"), ('<div id="#"><div class="#">', "</div></div>"), ("<table><tr><td>", "</td></tr></table>"), ("<section>", "</section>"), ('<table class="#"><tr><td width="70%"><div>', "</div></td></tr></table>"))
_PLAIN_BEFORE = ("<ul>{li}</ul>", "<div><ul>{li}</ul></div>", '<div class="#">{a}</div>', "<p>{a}</p>", "<table><tr><td>{a}</td></tr></table>")
_PLAIN_AFTER = ("<p>© {}</p>", "<div>© {} | {a}</div>", "<ul>{li}</ul>", '<div class="#"><p>© {}</p></div>', "<p>{a}</p>")
_NAMES = ("wrapper", "wrap", "container", "row", "col", "page", "box", "inner", "outer", "text", "block", "site", "center", "grid")
_WHOLE = (("", ""), ("", ""), ("", ""), ('<div id="#">', "</div>"), ('<div class="#"><div class="#">', "</div></div>"), ("<div>", "</div>"))
_MARK = "\x02"


def laid_out(texts: list[str], seed: int) -> str:
    """A page in a drawn layout, made of the given texts; those of the main part begin with a mark."""
    draw = random.Random(seed)
    short = lambda: html_lib.escape(" ".join(draw.choice(texts).split()[: draw.randint(1, 6)]) or "x")
    any_text = lambda: short() if draw.random() < 0.6 else html_lib.escape(draw.choice(texts))
    name = lambda: draw.choice(_NAMES) if draw.random() < 0.7 else "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(1, 7)))
    link = lambda text: f'<a href="/{draw.randint(0, 99)}">{text}</a>'

    def fill(piece: str) -> str:
        piece = piece.replace("{li}", "".join(f"<li>{link(short())}</li>" for _ in range(draw.randint(2, 7))))
        piece = piece.replace("{a}", draw.choice((" | ", " ", " · ")).join(link(short()) for _ in range(draw.randint(2, 6))))
        while "{}" in piece:
            piece = piece.replace("{}", any_text(), 1)
        return re.sub(r'(class|id)="#"', lambda m: f'{m[1]}="{name()}"', piece)

    def part(x: str) -> str:
        """A text of the main part: plain, with a link inside, or a link alone."""
        tag = draw.choice(("p", "p", "p", "p", "p", "li", "blockquote", "h2", "h3", "pre", "td", "div"))
        body, n = html_lib.escape(x), draw.random()
        if n < 0.12 and " " in body:
            first, rest = body.split(" ", 1)
            body = f"{first} {link(short())} {rest}"
        elif n < 0.18:
            tag, body = draw.choice(("li", "li", "p")), link(short())
        elif n < 0.35:
            body = any_text()
        return f"<{tag}>{_MARK}{body}</{tag}>"

    plain = draw.random() < 0.5
    opened, closed = draw.choice(_PLAIN_FRAMES if plain else _FRAMES)
    head = [f"<{t}>{_MARK}{short()}</{t}>" for t in (("h1",), ("h1",), ("h2",), ())[draw.randrange(4)]]
    # Some pages have little to say.
    chosen = texts if draw.random() < 0.75 else draw.sample(texts, min(len(texts), draw.randint(1, 3)))
    own = [*head, *map(part, chosen)]
    # A list or a table holds what stands in it one after the other.
    own = ["<ul>" + x + "</ul>" if x.startswith("<li") else f"<table><tr>{x}</tr></table>" if x.startswith("<td") else x for x in own]
    for _ in range(draw.choice((0, 0, 1, 2))):
        own.insert(draw.randint(min(1, len(own)), len(own)), fill(draw.choice(_INSIDE)))
    few = draw.randint(0 if plain else 1, 2 if plain else 4)
    before = [fill(x) for x in draw.sample(_PLAIN_BEFORE if plain and draw.random() < 0.6 else _BEFORE, few)]
    after = [fill(x) for x in draw.sample(_PLAIN_AFTER if plain and draw.random() < 0.6 else _AFTER, draw.randint(0 if plain else 1, 2 if plain else 4))]
    if not plain and draw.random() < 0.2:  # comments within the frame
        own.append(fill(_AFTER[4]))
    start, end = draw.choice(_WHOLE)
    title = f"<head><title>{short()}</title></head>" if draw.random() < 0.7 else ""
    return f"<html>{title}<body>{fill(start)}{''.join(before)}{fill(opened)}{''.join(own)}{closed}{''.join(after)}{end}</body></html>"


_OTHER = frozenset("nav header footer aside form menu select button textarea head title".split())


def _within(page: Page, tags: Iterable[str]) -> list[bool]:
    """Whether each block is in an element of these tags."""
    out, wanted = [False] * len(page.blocks), {"in:" + t for t in tags}
    for f, a, b in page.features:
        if f in wanted:
            out[a:b] = [True] * (b - a)
    return out


def training_pages(htmls: list[str], layouts: int = 3) -> tuple[list[Page], list[list[int]]]:
    """Labelled pages: each page as it is, where it marks its main part by article or main, and all its texts in drawn layouts."""
    xs, ys = [], []
    for k, html in enumerate(htmls):
        page = read_page(html)
        if not page.blocks:
            continue
        main = [int(m and not o) for m, o in zip(_within(page, ("article", "main")), _within(page, _OTHER))]
        if any(main):
            xs.append(page)
            ys.append(main)
        texts = [x for b, y in zip(page.blocks, main) if (y or not any(main)) and (x := b.text.replace(_MARK, "").strip())]
        if not texts:
            continue
        for j in range(layouts):
            # Marked and unmarked, the layout has the same blocks: the marks tell the labels, and the page without them is learned.
            marked = laid_out(texts, 1000 * k + j)
            xs.append(read_page(marked.replace(_MARK, "")))
            ys.append([int(b.text.startswith(_MARK)) for b in leaf_blocks(marked)])
    return xs, ys


def fit(pages: DataFrame, max_pages: int = 200, html_col: str = "html", id_col: str = "page_id") -> Crf:
    """A model trained on at most max_pages whole pages, those with the smallest hashes of their ids and contents: bounded in pages, not in their lengths."""
    keyed = pages.filter(F.length(html_col) > 0).withColumn("_h", F.xxhash64(F.lit("fit"), id_col, F.md5(html_col)))
    # Only the hashes go through the top-k of every task; then the pages of those at most max_pages rows are read.
    picked = keyed.select("_h").distinct().orderBy("_h").limit(max_pages)
    rows = keyed.join(F.broadcast(picked), "_h").groupBy("_h").agg(F.min(html_col).alias("_html")).collect()
    rows = sorted(rows, key=lambda r: r["_h"])
    return train(*training_pages([r["_html"] for r in rows]))


def extract(pages: DataFrame, model: Crf, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    The blocks that Viterbi labels as main text, joined in page order by two line feeds; nothing else is dropped or cut. A
    null or empty page, and one without main text, gives an empty string and 0. Pages are read one by one: repeated rows
    and null ids stay; other columns are ignored. Unclosed and stray tags are taken as browsers take them, and the time grows with
    the page, however deep it nests. Scripts, styles, templates and frames are no text; formulas, pictures' words and fall-back texts
    are, and the model judges them by where they stand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for page in b.column(2).to_pylist():
                read = read_page(page or "")
                texts.append("\n\n".join(x.text for x, y in zip(read.blocks, model.viterbi(model.scores(read))) if y))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
