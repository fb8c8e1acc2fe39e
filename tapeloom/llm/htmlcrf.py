"""Main text of web pages: a linear-chain conditional random field over the DOM's leaf blocks.

A page is cut into leaf blocks: text between the borders of block elements, with the path of open elements. A block
is described by its ancestors' tags and the words of their class, id and role, and by its text: length, share of
linked characters, punctuation, place in the page. The field has two labels, main text and other, with weights for
each feature and label and for each step from label to label. It is trained by gradient ascent on the exact
log-likelihood (forward-backward) over labelled pages, and a page's labels are those of the best path (Viterbi).

The labelled pages are drawn by ``labelled_pages`` from many layouts: menus, headers, side bars, notices, adverts,
forms, footers and readers' comments around an article, with element and class names in common use. Their number is
a parameter; training takes place in the driver and does not grow with the table. Any iterator of (blocks, labels)
can take their place.

A null or empty page, or one without main text, gives the empty string. Repeated pages get equal results. Only the
id, url and html columns are read.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tapeloom.llm.tables import prepare

#: Labelled pages to train on, steps, step size and decay.
PAGES, STEPS, RATE, DECAY, SEED = 500, 150, 0.5, 0.02, 11

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|iframe|object|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/a-z][^>]*>|(?P<text>[^<]+|<)",
    re.IGNORECASE | re.DOTALL,
)
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)

# Elements that begin and end a block, and elements without content.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these ends an open element of the same group.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDERS = frozenset("article aside body div footer form header main nav ol section table ul dl select blockquote figure".split())


@dataclass
class Block:
    path: tuple[str, ...]  # open elements, outermost first: tag, then words of class, id and role, by blanks
    text: str
    linked: int = 0  # characters inside links


@cache
def element(tag: str, rest: str) -> str:
    words = [w for m in NAMES.finditer(rest) for g in m.groups() if g for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", g).lower()) if w]
    return " ".join([tag, *dict.fromkeys(words)])


def leaf_blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[str] = []
    tags: list[str] = []
    parts: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(tuple(stack), text, linked))
            parts.clear()
        linked = 0

    def cut(depth: int) -> None:
        nonlocal links
        flush()
        links -= tags[depth:].count("a")
        del stack[depth:], tags[depth:]

    for m in TOKEN.finditer(page):
        text = m.group("text")
        if text is not None:
            text = entities.unescape(text)
            parts.append(text)
            if links:
                linked += len(text.strip())
            continue
        tag = m.group("tag")
        if tag is None:
            continue
        tag = tag.lower()
        if m.group("close"):
            if tag in tags:
                depth = len(tags) - 1 - tags[::-1].index(tag)
                if tag in BLOCK:
                    cut(depth)
                elif not any(t in BLOCK for t in tags[depth:]):
                    links -= tags[depth:].count("a")
                    del stack[depth:], tags[depth:]
            elif tag in BLOCK:
                flush()
        elif tag in BLOCK:
            flush()
            if "p" in tags and tag not in ("button", "label", "option", "select", "textarea"):
                cut(len(tags) - 1 - tags[::-1].index("p"))
            for k in range(len(tags) - 1, -1, -1):
                if tags[k] in SIBLINGS.get(tag, ()):
                    cut(k)
                    break
                if tags[k] in HOLDERS:
                    break
            if tag not in VOID:
                stack.append(element(tag, m.group("rest")))
                tags.append(tag)
        elif tag == "br":
            parts.append(" ")
        elif tag not in VOID and not m.group("rest").endswith("/"):
            stack.append(element(tag, m.group("rest")) if tag != "a" else "a")
            tags.append(tag)
            links += tag == "a"
    flush()
    return out


@cache
def path_features(path: tuple[str, ...]) -> tuple[str, ...]:
    found = []
    for e in path:
        tag, *words = e.split(" ")
        if tag not in BLOCK:  # inline elements are closed before their block ends
            continue
        if tag not in ("html", "body"):
            found.append(f"in {tag}")
        found += [f"named {w}" for w in words]
    blocks = [e.split(" ")[0] for e in path if e.split(" ")[0] in BLOCK]
    found.append(f"leaf {blocks[-1] if blocks else ''}")
    return tuple(dict.fromkeys(found))


def text_features(b: Block, at: int, count: int) -> list[str]:
    text = b.text
    words = text.count(" ") + 1
    marks = sum(map(text.count, ".,;:!?"))
    return [
        "all",
        f"words {min(8, words.bit_length())}",
        f"links {min(4, 5 * b.linked // len(text))}",
        f"marks {min(4, 20 * marks // words)}",
        f"ends {text[-1] in '.!?:' }",
        f"sign {any(c in text for c in '©®»›')}",
        f"first {at == 0}",
        f"last {at == count - 1}",
        f"place {5 * at // count}",
    ]


def features(blocks: list[Block]) -> list[list[str]]:
    return [[*path_features(b.path), *text_features(b, k, len(blocks))] for k, b in enumerate(blocks)]


@dataclass
class Field:
    """Weights for label 1 (main text) against 0, and of the four steps."""

    number: dict[str, int]
    weight: np.ndarray
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def decode(self, pages: list[list[list[str]]]) -> list[list[int]]:
        """The best labels of each page."""
        known = self.number
        numbers = [[n for f in block if (n := known.get(f)) is not None] for page in pages for block in page]
        sizes = np.array([len(n) for n in numbers], np.int64)
        flat = np.fromiter((x for n in numbers for x in n), np.int64, int(sizes.sum()))
        scores = np.bincount(np.repeat(np.arange(len(sizes)), sizes), self.weight[flat], minlength=len(sizes)).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        out, at = [], 0
        for page in pages:
            zero, one, back = 0.0, 0.0, []
            for k in range(len(page)):
                if k:
                    from0, from1 = zero + s01 > one + s11, zero + s00 >= one + s10
                    zero, one = max(zero + s00, one + s10), max(zero + s01, one + s11)
                    back.append((0 if from1 else 1, 0 if from0 else 1))
                one += scores[at + k]
            at += len(page)
            label = int(one > zero)
            labels = [label] if page else []
            for choice in reversed(back):
                label = choice[label]
                labels.append(label)
            out.append(labels[::-1])
        return out


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> Field:
    """Gradient ascent (steps scaled by past gradients) on the mean log-likelihood with a quadratic penalty."""
    names: dict[str, int] = {}
    for blocks, _ in pages:
        for b in blocks:
            for f in b:
                names.setdefault(f, len(names))
    longest, count = max(len(b) for b, _ in pages), len(pages)
    there, gold = np.zeros((count, longest), bool), np.zeros((count, longest), np.int64)
    rows, cols = [], []
    for p, (blocks, labels) in enumerate(pages):
        there[p, : len(blocks)] = True
        gold[p, : len(blocks)] = labels
        for k, b in enumerate(blocks):
            rows += [p * longest + k] * len(b)
            cols += [names[f] for f in b]
    row, col = np.array(rows), np.array(cols)
    weight, step = np.zeros(len(names)), np.zeros((2, 2))
    past_w, past_s = np.full(len(names), 1e-6), np.full((2, 2), 1e-6)
    seen = np.zeros((2, 2))
    both = there[:, 1:]
    np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    for _ in range(steps):
        score = np.zeros((count, longest, 2))
        score[:, :, 1] = np.bincount(row, weight[col], minlength=count * longest).reshape(count, longest)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for k in range(1, longest):
            move = np.logaddexp(ahead[:, k - 1, 0, None] + step[0], ahead[:, k - 1, 1, None] + step[1]) + score[:, k]
            ahead[:, k] = np.where(there[:, k, None], move, ahead[:, k - 1])
        for k in range(longest - 2, -1, -1):
            after = behind[:, k + 1] + score[:, k + 1]
            move = np.logaddexp(after[:, 0, None] + step[:, 0], after[:, 1, None] + step[:, 1])
            behind[:, k] = np.where(there[:, k + 1, None], move, 0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])[:, None, None]
        one = np.exp(ahead + behind - total)[:, :, 1]
        pull = np.where(there, gold - one, 0).ravel()
        grad = np.bincount(col, pull[row], minlength=len(names)) / count - decay * weight / count
        pair = np.exp(ahead[:, :-1, :, None] + step + (score + behind)[:, 1:, None, :] - total[..., None]) * both[..., None, None]
        grad_s = (seen - pair.sum(axis=(0, 1))) / count - decay * step / count
        past_w += grad**2
        past_s += grad_s**2
        weight += rate * grad / np.sqrt(past_w)
        step += rate * grad_s / np.sqrt(past_s)
    return Field(names, weight, step)


# Names that page parts go by.
PARTS = {
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs toc pagination pager tabs",
    "head": "header masthead top banner logo site title branding tagline skip",
    "side": "sidebar side widget related aside rail recommended popular trending tags archive author bio",
    "notice": "cookie notice consent alert banner gdpr popup modal message warning newsletter subscribe signup",
    "advert": "ad ads advert advertisement sponsor sponsored promo promoted adsense banner",
    "form": "form login search contact signup subscribe field",
    "foot": "footer foot bottom copyright legal colophon social share",
    "comment": "comments comment discussion replies reply respond responses thread disqus",
    "main": "content main article post entry story body text page primary hentry column",
}
PARTS = {k: v.split() for k, v in PARTS.items()}


def labelled_pages(count: int = PAGES, seed: int = SEED) -> Iterator[tuple[list[Block], list[int]]]:
    """Blocks and labels of pages of many layouts; the labels come with the parts, not from a rule about blocks."""
    draw = random.Random(seed)
    sound = "an be co de en fa gi ho in ka le mo ni or pa qu re st ti un ver wa ze é ü ña".split()

    def word() -> str:
        return "".join(draw.choices(sound, k=draw.randint(1, 4)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(draw.randint(low, high)))

    def sentence() -> str:
        return words(1, 18).capitalize().replace(" ", ", ", draw.random() < 0.4) + draw.choice("...!?")

    def prose(low: int = 1, high: int = 7) -> tuple[str, int]:
        parts = [sentence() for _ in range(draw.randint(low, high))]
        text, linked = " ".join(parts), 0
        if draw.random() < 0.15:
            linked = len(parts[0])
        return text, linked

    def named(tag: str, part: str, sure: float = 0.75) -> str:
        if draw.random() > sure:
            return tag
        return " ".join([tag, *dict.fromkeys(draw.choices(PARTS[part], k=draw.choice((1, 1, 2))))])

    def blocks(outer: tuple[str, ...], label: int, entries: list[tuple[tuple[str, ...], str, int]]):
        return [(Block((*outer, *p), t, n), label) for p, t, n in entries if t]

    def anchors(n: int, inner: tuple[str, ...] = ("ul", "li")) -> list:
        return [((*inner, "a"), t, len(t)) for t in (words(1, 3) for _ in range(n))]

    def short(low: int = 1, high: int = 3) -> list:
        return [((draw.choice(("p", "div", "span", "h3", "p")),), draw.choice((words(2, 9), sentence(), prose(1, 2)[0])), 0) for _ in range(draw.randint(low, high))]

    def menu(outer):
        top = draw.choice((named("nav", "menu", 0.4), named("div", "menu", 1), named("ul", "menu", 1)))
        return blocks((*outer, top), 0, anchors(draw.randint(2, 9), draw.choice((("ul", "li"), ("li",), ()))))

    def head(outer):
        return blocks((*outer, named(draw.choice(("header", "div")), "head", 1)), 0, [((draw.choice(("h1", "p", "div", "a")),), words(1, 6), 0), *anchors(draw.randint(0, 4))])

    def side(outer):
        top = draw.choice((named("aside", "side", 0.5), named("div", "side", 1)))
        return blocks((*outer, top), 0, [*short(0, 2), *anchors(draw.randint(1, 6))])

    def notice(outer):
        return blocks((*outer, named("div", "notice", 1)), 0, [*short(1, 2), (("button",), words(1, 2), 0)])

    def advert(outer):
        return blocks((*outer, named(draw.choice(("div", "div", "aside", "section")), "advert", 1)), 0, short(1, 2))

    def form(outer):
        return blocks((*outer, named("form", "form", 0.5)), 0, [((draw.choice(("label", "p", "legend", "button", "textarea")),), words(1, 6), 0) for _ in range(draw.randint(1, 4))])

    def foot(outer):
        top = draw.choice((named("footer", "foot", 0.4), named("div", "foot", 1)))
        lines = [((draw.choice(("p", "div", "")),) if draw.random() < 0.5 else (), "© " + words(1, 3) + " · " + draw.choice((sentence(), words(2, 6), prose(1, 2)[0])), 0)]
        return blocks((*outer, top), 0, [*lines, *anchors(draw.randint(0, 5))])

    def comment(outer):
        top = draw.choice((named("div", "comment", 1), named("section", "comment", 1), named("ol", "comment", 1)))
        inner = draw.choice((("li", "p"), ("p",), (named("div", "comment", 1), "p"), (named("article", "comment", 1), "p")))
        return blocks((*outer, top), 0, [((draw.choice(("h2", "h3")),), words(1, 3), 0)] * draw.randint(0, 1) + [(inner, *prose(1, 4)) for _ in range(draw.randint(1, 5))])

    def article(outer):
        top = draw.choices((("article",), (named("article", "main", 0.6),), (named("main", "main", 0.4), "article"), (named("main", "main", 0.4),), (named("div", "main", 1),), (named("section", "main", 1),), ()), (5, 2, 2, 2, 4, 1, 1))[0]
        entries = [(("h1",), words(3, 12), 0)] if draw.random() < 0.85 else []
        odd = draw.choice((str.upper, lambda t: t.replace(" ", " | "), lambda t: t.replace(" ", draw.choice(("!! ", "### ", "$$$ "))), lambda t: words(1, 1) + " " + t)) if draw.random() < 0.1 else str
        for _ in range(draw.choice((draw.randint(1, 9), draw.randint(1, 9), draw.randint(6, 40)))):
            kind = draw.random()
            if kind < 0.8:
                entries.append((("p",) if draw.random() < 0.85 else ("p", "b"), *prose(1, 9)))
            elif kind < 0.86:
                entries.append(((draw.choice(("h2", "h3")),), words(1, 8), 0))
            elif kind < 0.93:
                entries += [(("ul", "li"), draw.choice((sentence(), words(1, 10))), 0) for _ in range(draw.randint(2, 4))]
            else:
                entries.append((draw.choice((("blockquote", "p"), ("blockquote",), ("pre",), ("table", "tr", "td"), ("figure", "figcaption"))), *prose(1, 3)))
        made = blocks((*outer, *top), 1, [(p, odd(t), min(n, len(t))) for p, t, n in entries])
        for part in (advert, advert, side, notice, form, menu, comment):  # often a part stands inside the article
            if draw.random() < 0.15:
                at = draw.randint(0, len(made))
                made[at:at] = part((*outer, *top))
        return made

    for _ in range(count):
        outer = ("html", "body") + ((named("div", draw.choice(("main", "head")), 0.3),) if draw.random() < 0.25 else ())
        before = [p for p, share in ((notice, 0.2), (head, 0.5), (menu, 0.7), (advert, 0.5), (side, 0.2), (form, 0.15)) if draw.random() < share]
        after = [p for p, share in ((comment, 0.45), (side, 0.35), (form, 0.2), (advert, 0.2), (notice, 0.1), (menu, 0.1), (foot, 0.85)) if draw.random() < share]
        draw.shuffle(before)
        before, after = before if draw.random() < 0.85 else [], after if draw.random() < 0.85 else []
        page = [x for part in (*before, article, *after) for x in part(outer)]
        yield [b for b, _ in page], [label for _, label in page]


@cache
def trained(count: int = PAGES, seed: int = SEED) -> Field:
    return train([(features(blocks), labels) for blocks, labels in labelled_pages(count, seed)])


def extract(pages: DataFrame, model: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    spark = prepare(pages.sparkSession)
    sent = spark.sparkContext.broadcast(model or trained())

    def main_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [leaf_blocks(x) if x else [] for x in batch.column(2).to_pylist()]
            labels = sent.value.decode([features(b) for b in found])
            texts = [" ".join(b.text for b, is_main in zip(blocks, own, strict=True) if is_main) for blocks, own in zip(found, labels, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return rows.mapInArrow(main_text, "page_id long, url string, text string, n_chars long")
