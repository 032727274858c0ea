"""HTML main text by a linear-chain conditional random field over DOM leaf blocks.

A page is read into its leaf blocks: stretches of text between block-level tags, each with the tags and the class,
id and role words of its ancestors. Blocks form a chain with two states, article and rest; unary features come from
ancestors and text, pairwise ones from neighbouring states. The model is fitted by gradient ascent on labelled
pages and decoded by Viterbi. The labelled pages are rendered here, TRAINING_PAGES of them, from page layouts with
known article blocks; fitting takes seconds on the driver, and 2 x features weights travel to the tasks.

Pages are read, decoded and written one by one where they lie; there is no shuffle.

Defined results: a null or empty html gives an empty text; broken or unclosed markup is read as browsers do as far
as blocks are concerned, a tag cut off at the end is dropped, and of unclosed elements only those of _TO_END hide the
rest of the page; repeated rows give repeated rows; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrawl.session import ship_with_tasks

ship_with_tasks(__name__)

TRAINING_PAGES, STEPS, RATE, PENALTY = 900, 150, 0.3, 1e-3

# ---- fixed lists: kinds of tags ----
_BLOCK = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section
select summary table tbody td tfoot th thead tr ul""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title noscript template iframe svg textarea noframes xmp".split())
#: Of these, the ones that run to the end of the page where they are not closed; others are read on behind their tag.
_TO_END = frozenset("script style title textarea".split())
#: A slash at the end of a tag belongs to an unquoted value, if there is one.
_UNQUOTED = re.compile(r"=\s*[^\s\"']+\Z")
#: An opening tag closes an open element of these kinds.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
           "th": ("td", "th"), "option": ("option",)}
#: Blocks that an opening tag of their kind may close across.
_NO_BORDER = frozenset("p li td th dt dd tr".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)"""
                  r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.DOTALL)
_NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORDS = re.compile(r"\w+")

# ---- fixed lists: words of class, id and role that speak for a kind of block ----
HINTS = {
    "advert": "ad ads adv advert advertisement advertising banner promo promotion sponsor sponsored sponsors",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs topbar toolbar",
    "comment": "comment comments commentlist reply replies respond discussion disqus reader readers review reviews",
    "side": "sidebar side aside widget widgets related recommended recommendations popular trending complementary more",
    "foot": "footer foot copyright legal colophon contentinfo credits imprint",
    "head": "header masthead banner branding logo top site-header",
    "notice": "cookie cookies notice consent gdpr alert warning popup modal dialog overlay paywall disclaimer message",
    "form": "form subscribe subscription newsletter signup login search contact share social sharing follow",
    "article": "article content post entry story body main text prose page",
}
_HINT_OF = {w: k for k, ws in HINTS.items() for w in ws.split()}
_TAGS = """article main section nav header footer aside form div li table p h1 h2 h3 blockquote pre figure figcaption dl dialog
address select""".split()
_SHAPES = ["bias", "under_4_words", "under_10_words", "over_25_words", "links", "half_links", "sentence", "comma", "sign",
           "digits", "first", "last", "in_article_tag"]
FEATURES = [f"{kind}:{h}" for kind in ("hint", "wide", "near") for h in HINTS] + [f"tag:{t}" for t in _TAGS] + _SHAPES
#: An element with more of a page's text outside of links than this is its body, whatever its name says.
WIDE = 0.5
_AT = {f: i for i, f in enumerate(FEATURES)}
_HEADINGS = {"h4": "h3", "h5": "h3", "h6": "h3", "ol": "li", "ul": "li", "td": "table", "th": "table", "dd": "dl", "dt": "dl",
             "menu": "nav", "option": "select", "fieldset": "form", "search": "form"}


# ---- blocks of a page -------------------------------------------------------------------------------


@dataclass
class Block:
    """A leaf block. hints: of each kind, the number of the innermost element with such a word; near: the kinds of the
    innermost element with any, and its number; both as far as they are bounded by the number of kinds, not by depth."""
    text: str
    tags: tuple[str, ...]
    hints: tuple[tuple[str, int], ...]
    near: tuple[tuple[str, ...], int]
    linked: int = 0


@dataclass(slots=True)
class _Open:
    tag: str
    hints: tuple[str, ...]
    number: int
    before: int


@dataclass
class _Reader:
    """Collects text until a block-level tag ends the block.

    What a block needs of its ancestors is kept as counts and innermost places, so a tag costs the same at any depth.
    """
    open: list[_Open] = field(default_factory=list)
    places: dict[str, list[int]] = field(default_factory=dict)
    borders: list[int] = field(default_factory=list)
    inner: list[int] = field(default_factory=list)
    named: list[_Open] = field(default_factory=list)
    kinds: dict[str, list[int]] = field(default_factory=dict)
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    plain: list[int] = field(default_factory=list)
    semantic: list[bool] = field(default_factory=list)
    linked: int = 0
    total: int = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            linked = min(self.linked, len(text))
            hints = tuple((kind, numbers[-1]) for kind, numbers in self.kinds.items() if numbers)
            near = (self.named[-1].hints, self.named[-1].number) if self.named else ((), -1)
            self.blocks.append(Block(text, tuple(t for t, at in self.places.items() if at), hints, near, linked))
            self.total += len(text) - linked
        self.parts, self.linked = [], 0

    def text(self, raw: str) -> None:
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.places.get("a"):
                self.linked += len(text.strip())

    def cut(self, place: int) -> None:
        """Close all open elements from a place on."""
        while len(self.open) > place:
            o = self.open.pop()
            self.places[o.tag].pop()
            for stack in (self.borders, self.inner):
                if stack and stack[-1] == len(self.open):
                    stack.pop()
            if o.hints:
                self.named.pop()
                self.plain[o.number] = self.total - o.before
                for kind in o.hints:
                    self.kinds[kind].pop()

    def close(self, tags: tuple[str, ...]) -> None:
        """Close the innermost open element of these kinds and all inside it, unless a block boundary is between."""
        place = max((at[-1] for at in map(self.places.get, tags) if at), default=-1)
        if place >= 0 and (not self.borders or self.borders[-1] <= place):
            self.cut(place)

    def start(self, tag: str, attributes: str) -> None:
        if tag in _BLOCK:
            self.flush()
            self.close(("p",))
            if tag in _CLOSES:
                self.close(_CLOSES[tag])
        elif tag == "br":
            self.parts.append(" ")
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCK:
            return
        hints: tuple[str, ...] = ()
        if "=" in attributes:
            named = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes))
            hints = tuple(dict.fromkeys(_HINT_OF[w] for w in map(str.lower, _WORD.findall(named)) if w in _HINT_OF))
        place = len(self.open)
        self.open.append(o := _Open(tag, hints, len(self.plain), self.total))
        self.places.setdefault(tag, []).append(place)
        if tag in _BLOCK:
            self.inner.append(place)
            if tag not in _NO_BORDER:
                self.borders.append(place)
        if hints:
            self.named.append(o)
            self.plain.append(0)
            self.semantic.append(tag in ("article", "main"))
            for kind in hints:
                self.kinds.setdefault(kind, []).append(o.number)

    def end(self, tag: str) -> None:
        if tag in _BLOCK:
            self.flush()
        at = self.places.get(tag)
        if at and (tag in _BLOCK or not self.inner or self.inner[-1] < at[-1]):
            self.cut(at[-1])

    def finish(self) -> list[Block]:
        """The blocks; hints of elements that hold most of the page's own text, and of articles, are told apart."""
        self.flush()
        self.cut(0)
        wide = [s or p > WIDE * self.total for p, s in zip(self.plain, self.semantic, strict=True)]
        for b in self.blocks:
            b.hints = tuple(f"{'wide' if wide[n] else 'hint'}:{kind}" for kind, n in b.hints)
            b.near = tuple(f"near:{kind}" for kind in b.near[0] if not wide[b.near[1]])
        return self.blocks


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order."""
    reader, at, unclosed = _Reader(), 0, set()
    while (m := _TAG.search(page, at)) is not None:
        reader.text(page[at:m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name or page[m.end() - 1] != ">":
            continue  # comments, declarations, a tag cut off at the end
        tag = name.lower()
        if m[1] or m[4]:
            reader.end(tag)
        elif tag == "svg" and (m[3] or m[6] or "").endswith("/") and not _UNQUOTED.search(m[3] or m[6]):
            continue
        elif tag in _RAW and tag not in unclosed:
            stop = re.compile(f"</{re.escape(tag)}[^>]*(?:>|\\Z)", re.IGNORECASE).search(page, at)
            if stop:
                at = stop.end()
            elif tag in _TO_END:
                at = len(page)
            else:
                unclosed.add(tag)  # looked for once a page
        elif tag in _RAW:
            continue
        else:
            reader.start(tag, m[3] or m[6] or "")
    reader.text(page[at:])
    return reader.finish()


def features(blocks: list[Block]) -> list[list[int]]:
    """Which features hold for each block."""
    rows = []
    for k, b in enumerate(blocks):
        names = {f"tag:{_HEADINGS.get(t, t)}" for t in b.tags}
        names.update(b.hints)
        names.update(b.near)
        n, share = len(_WORDS.findall(b.text)), b.linked / max(1, len(b.text))
        shapes = {
            "bias": True, "under_4_words": n < 4, "under_10_words": n < 10, "over_25_words": n > 25, "links": share > 0,
            "half_links": share > 0.5, "sentence": b.text[-1] in ".!?…\"”", "comma": ", " in b.text,
            "sign": any(c in b.text for c in "©®|»›"), "digits": sum(map(str.isdigit, b.text)) > len(b.text) / 4,
            "first": k == 0, "last": k == len(blocks) - 1, "in_article_tag": "article" in b.tags or "main" in b.tags}
        names.update(s for s, holds in shapes.items() if holds)
        rows.append(sorted(_AT[x] for x in names if x in _AT))
    return rows


# ---- the chain --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Chain:
    """unary: score of the article state over the other by feature; pair: scores of neighbouring states."""
    unary: np.ndarray
    pair: np.ndarray

    def decode(self, rows: list[list[int]]) -> list[bool]:
        """Best states of a chain (Viterbi)."""
        if not rows:
            return []
        weights, ((p00, p01), (p10, p11)) = self.unary, self.pair.tolist()
        a, b, back = 0.0, 0.0, []
        for k, row in enumerate(rows):
            score = float(weights[row].sum())
            if k:
                from_a, from_b = a + p00 >= b + p10, a + p01 >= b + p11
                back.append((from_a, from_b))
                a, b = (a + p00 if from_a else b + p10), (a + p01 if from_b else b + p11)
            b += score
        state, path = b > a, []
        path.append(state)
        for from_a, from_b in reversed(back):
            state = not (from_b if state else from_a)
            path.append(state)
        return path[::-1]


def fit(pages: list[tuple[list[list[int]], list[bool]]], steps: int = STEPS, rate: float = RATE) -> Chain:
    """Weights of the largest penalised likelihood over labelled chains, by full-batch gradient ascent (Adam)."""
    n, longest = len(pages), max(len(y) for _, y in pages)
    x, y, on = np.zeros((n, longest, len(FEATURES))), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (rows, labels) in enumerate(pages):
        for k, row in enumerate(rows):
            x[i, k, row], y[i, k], on[i, k] = 1.0, int(labels[k]), True
    flat, size = x.reshape(-1, len(FEATURES)), len(FEATURES)
    pairs = on[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
    w, first, second = np.zeros(size + 4), np.zeros(size + 4), np.zeros(size + 4)
    for step in range(1, steps + 1):
        score, pair = (flat @ w[:size]).reshape(n, longest), w[size:].reshape(2, 2)
        unary = np.stack([np.zeros_like(score), score], 2) * on[:, :, None]
        move = np.where(pairs.T[:, :, None, None], pair, 0.0)  # place, page, from, to
        ahead, behind = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
        ahead[0] = unary[:, 0]
        for k in range(1, longest):
            new = np.logaddexp.reduce(ahead[k - 1][:, :, None] + move[k - 1], axis=1) + unary[:, k]
            ahead[k] = np.where(on[:, k, None], new, ahead[k - 1])
        for k in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(move[k] + (unary[:, k + 1] + behind[k + 1])[:, None, :], axis=2)
            behind[k] = np.where(on[:, k + 1, None], new, behind[k + 1])
        total = np.logaddexp.reduce(ahead[-1], axis=1)
        article = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total).T * on
        both = np.exp(ahead[:-1, :, :, None] + move + (unary.transpose(1, 0, 2)[1:] + behind[1:])[:, :, None, :]
                      - total[None, :, None, None]) * pairs.T[:, :, None, None]
        up = np.concatenate([flat.T @ ((y - article) * on).ravel(), (seen - both.sum((0, 1))).ravel()]) / n
        up -= PENALTY * w
        first, second = 0.9 * first + 0.1 * up, 0.99 * second + 0.01 * up * up
        w += rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return Chain(w[:size], w[size:].reshape(2, 2))


# ---- labelled pages ---------------------------------------------------------------------------------


class PageMaker:
    """Renders pages whose article blocks are known."""

    def __init__(self, seed: int):
        self.draw = random.Random(seed)
        self.labels: list[bool] = []
        self.keep = False

    def words(self, low: int, high: int) -> str:
        d = self.draw
        sounds = "a e i o u ta re no mi su len kor ver dan pil est ing tion über és ña".split()
        return " ".join("".join(d.choices(sounds, k=d.randint(1, 4))) for _ in range(d.randint(low, high)))

    def sentence(self, low: int, high: int) -> str:
        d, text = self.draw, self.words(low, high).capitalize()
        if len(text) > 30 and d.random() < 0.7:
            text = text.replace(" ", ", ", 1)
        return text + d.choice(". . . . ! ?".split() + [""])

    def block(self, tag: str, text: str, link: float = 0.0, inner: str = "") -> str:
        self.labels.append(self.keep)
        shown = f'<a href="/{len(self.labels)}">{text}</a>' if self.draw.random() < link else text
        if self.draw.random() < 0.15 and not inner:
            shown = f"<b>{shown}</b>"
        return f"<{tag}{inner}>{shown}</{tag}>"

    def named(self, tag: str, kind: str, chance: float = 0.8) -> str:
        d = self.draw
        if d.random() > chance:
            return tag
        word = d.choice(HINTS[kind].split())
        near = d.choice(["", "", "-box", "-wrap", " block", "-1", "-list"])
        return f'{tag} {d.choice(["class", "class", "class", "id"])}="{d.choice(["", "", "site-", "page-"])}{word}{near}"'

    def wrap(self, opening: str, inside: str) -> str:
        return f"<{opening}>{inside}</{opening.split()[0]}>"

    def items(self, low: int, high: int, link: float) -> str:
        each = [self.block("li", self.words(1, 4), link) for _ in range(self.draw.randint(low, high))]
        return self.wrap("ul", "".join(each))

    def boilerplate(self, kind: str) -> str:
        d = self.draw
        if kind == "menu":
            return self.wrap(d.choice(["nav", self.named("nav", "menu"), self.named("div", "menu", 1)]), self.items(2, 8, 0.95))
        if kind == "head":
            return self.wrap(d.choice(["header", self.named("header", "head"), self.named("div", "head", 1)]),
                             self.block(d.choice(["p", "div", "h1", "h2"]), self.words(1, 5), 0.6))
        if kind == "foot":
            line = d.choice(["&copy; ", "© ", "", "&copy; 2024 "]) + d.choice([self.words(1, 6), self.sentence(3, 14)])
            return self.wrap(d.choice(["footer", "footer", self.named("footer", "foot"), self.named("div", "foot", 1)]),
                             self.block("p" if d.random() < 0.5 else "div", line, 0.2))
        if kind == "side":
            return self.wrap(d.choice(["aside", self.named("aside", "side"), self.named("div", "side", 1)]), d.choice([
                lambda: self.block("h3", self.words(1, 3)) + self.items(2, 6, 0.9),
                lambda: self.block("p", self.sentence(4, 30)), lambda: self.block("div", self.sentence(3, 12), 0.5)])())
        if kind == "comment":
            head = self.block("h3", self.words(1, 2)) if d.random() < 0.6 else ""
            each = [self.wrap(self.named(d.choice(["div", "li", "article"]), "comment", 0.9), "".join(
                self.block("p", self.sentence(3, 40)) for _ in range(d.randint(1, 2)))) for _ in range(d.randint(1, 5))]
            return self.wrap(self.named(d.choice(["section", "div", "ul", "aside"]), "comment", 1), head + "".join(each))
        if kind == "form":
            return self.wrap(d.choice(["form", self.named("form", "form"), self.named("div", "form", 1)]), "".join(
                self.block("p", self.words(1, 8)) for _ in range(d.randint(1, 3)))
                + '<input name="q">')
        # adverts and notices
        return self.wrap(self.named(d.choice(["div", "div", "div", "section", "aside"]), kind, 1),
                         "".join(self.block("p", self.sentence(2, 25), 0.3) for _ in range(d.randint(1, 2))))

    def article(self) -> str:
        d = self.draw
        self.keep = True
        inside = [self.block(d.choice(["h1", "h1", "h2"]), d.choice([self.words(2, 10), self.sentence(4, 14)]))] if d.random() < 0.9 else []
        for _ in range(d.choice([1, 2, 3, 5, 8, 12])):
            kind = d.random()
            if kind < 0.72:
                text = " ".join(self.sentence(1, 25) for _ in range(d.randint(1, 6)))
                text = text.replace(" ", d.choice([" | ", " » ", " ® "])) if d.random() < 0.08 else text
                inside.append(self.block("p", text, 0.03 if d.random() < 0.9 else 0.5))
            elif kind < 0.82:
                inside.append(self.block(d.choice(["h2", "h3"]), self.words(1, 8)))
            elif kind < 0.88:
                inside.append(self.items(2, 5, 0.1))
            elif kind < 0.93:
                inside.append(self.wrap("blockquote", self.block("p", self.sentence(5, 30))))
            elif kind < 0.96:
                inside.append(self.block("pre", self.words(2, 15)))
            else:
                self.keep = False
                inside.append(self.boilerplate(d.choice(["advert", "form", "side", "notice", "form"])))
                self.keep = True
        self.keep = False
        if d.random() < 0.2:
            inside.append(self.boilerplate(d.choice(["comment", "form", "side", "advert"])))
        shell = d.choices(["article", self.named("article", "article"), "main", self.named("div", "article", 1),
                           self.named("section", "article", 1), "div"], [5, 3, 2, 4, 2, 1])[0]
        body = self.wrap(self.misnamed(shell, 0.35), "".join(inside))
        body = self.wrap("main", body) if d.random() < 0.2 and shell != "main" else body
        return self.wrap(self.misnamed("div", 0.8), body) if d.random() < 0.2 else body

    def misnamed(self, opening: str, chance: float) -> str:
        """Words that speak for boilerplate on an element that is none: "read-more", "top", "alert"."""
        d = self.draw
        if d.random() > chance:
            return opening
        words = " ".join(d.choice(HINTS[d.choice(["advert", "menu", "side", "head", "notice", "form", "foot"])].split())
                         for _ in range(d.choice([1, 1, 2])))
        if '="' in opening:
            return opening[:-1] + f' {words}"'
        return f'{opening} {d.choice(["class", "class", "id"])}="{d.choice(["", "", "read-", "post "])}{words}{d.choice(["", "", "-story"])}"'

    def page(self) -> tuple[str, list[bool]]:
        d, self.labels = self.draw, []
        before = [k for k, p in (("notice", 0.3), ("head", 0.5), ("menu", 0.8), ("advert", 0.5), ("form", 0.2), ("side", 0.15))
                  if d.random() < p]
        after = [k for k, p in (("comment", 0.4), ("side", 0.4), ("advert", 0.2), ("form", 0.2), ("notice", 0.2), ("menu", 0.15),
                                ("foot", 0.85)) if d.random() < p]
        before, after = [[] if d.random() < 0.1 else kinds for kinds in (before, after)]
        if d.random() < 0.3:
            d.shuffle(before)
        body = "".join(self.boilerplate(k) for k in before) + self.article() + "".join(self.boilerplate(k) for k in after)
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{body}</body></html>", self.labels


def labelled_pages(n: int, seed: int) -> list[tuple[list[Block], list[bool]]]:
    maker, out = PageMaker(seed), []
    for _ in range(n):
        page, labels = maker.page()
        blocks = blocks_of(page)
        if len(blocks) == len(labels):
            out.append((blocks, list(labels)))
    return out


@lru_cache(1)
def trained(pages: int = TRAINING_PAGES, seed: int = 11) -> Chain:
    return fit([(features(blocks), labels) for blocks, labels in labelled_pages(pages, seed)])


def main_text(page: str, chain: Chain) -> str:
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, keep in zip(blocks, chain.decode(features(blocks)), strict=True) if keep)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text: the article of every page."""
    chain = chain or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "", chain) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                                             ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string")
