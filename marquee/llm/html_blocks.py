"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks in order. Each block has a vector of its tag path (names, class and id words of the
elements around it, hashed), of its words (hashed) and of a few figures, and a bidirectional LSTM that reads the whole
sequence says for every block whether it belongs to the article. Pages are spread by Spark; inside a task they are
read in batches of like length.

The labeller is trained when it is used, on at most ``FIT_PAGES`` pages (those with the smallest hash of id, url and html,
of at most ``FIT_CHARS`` characters). Their blocks are labelled by what the markup itself says: elements that by name, class or
id are boilerplate, or content; where it says nothing, a container of mostly prose is article as a whole. Each is also shown in variants with other names for these elements and with prose in
boilerplate, and pages of other makes are put together from its words, so that names and orders which these pages don't have
are learned too; some paths and words are blotted out, so that neighbours and figures count. Extraction covers every page, whole.

Inputs: a null or empty html gives the empty text, as does a page without article blocks; a page that ends within a
tag loses only that tag. Repeated rows get equal texts, null ids and urls are returned as they are, an empty
table gives no rows (the labeller is then trained on variants of nothing, and unused). Other columns aren't read.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.bilstm import BiLstm
from marquee.llm.common import table
from marquee.llm.textbytes import NOT_SPACE, word_hashes, words_of

FIT_PAGES = 300
FIT_CHARS = 100_000
FIT_STEPS = 220
#: Blocks of these pages whose words make up the variants, at most.
PROSE_BLOCKS = 2000
#: A block of so many words, less than half of it linked, is prose.
PROSE_WORDS = 8
PATH_SIZE, WORD_SIZE, FIGURES = 256, 64, 6
SLOTS = 4096

#: Elements without text of the page.
SKIPPED = "script style noscript template title head svg iframe textarea select button object canvas".split()
#: Those of them whose content is no markup; it ends at their end tag only. A title without an end tag isn't raw.
RAW = "script style iframe textarea".split()
#: What a head may hold.
IN_HEAD = set("html head base basefont bgsound link meta title noscript noframes style script template".split())
#: Elements that begin and end a block.
BLOCKS = set(
    "html body p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd td th tr table thead tbody tfoot caption article section nav aside header footer main blockquote pre figure figcaption form fieldset legend address hr details summary label".split()
)
#: Elements that are pieces of a text, not containers of texts.
PIECES = set("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption b i em strong span a small code".split())
VOID = set("br hr img input meta link area base col embed source track wbr".split())
#: What class and id words and element names say of a block.
BOILERPLATE_NAMES = "nav aside header footer form menu dialog fieldset".split()
BOILERPLATE_WORDS = (
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement banner promo promotion sponsor sponsored cookie cookies consent gdpr notice alert "
    "popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments reply replies discussion disqus breadcrumb "
    "breadcrumbs pagination pager widget login search form copyright legal tags toolbar topbar skip"
).split()
NEUTRAL_WORDS = "page wrap wrapper container row col grid inner outer site left center box block module section home single hentry clearfix layout area".split()
CONTENT_NAMES = "article main".split()
CONTENT_WORDS = "article content main post entry story body text".split()

#: What stands in a tag behind its name. A quote opens a value only right after "=", a value without quotes ends at white space.
REST = r"""(?:=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)|[^>])*+"""
MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|<(?P<skip>{'|'.join(RAW)})(?=[\s/>]){REST}>.*?(?:</(?P=skip)\s*>|\Z)"
    rf"|<title(?=[\s/>]){REST}>(?:(?!</?(?:svg|head|body|title|{'|'.join(sorted(BLOCKS - {'head', 'body'}))})[\s/>]).)*?</title\s*>"
    rf"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>{REST})>"
    r"|<[!?/a-z][^>]*(?:>|\Z)"
    r"|[^<]+|<",
    re.I | re.S,
)
NAMING = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass
class Block:
    """path: the elements around it from the outside, each a tuple of its name and its class and id words; within: the number of
    the innermost of them that isn't itself a piece of text."""

    path: tuple[tuple[str, ...], ...]
    text: str
    linked: int
    within: int = -1


@lru_cache(maxsize=4096)
def element(name: str, rest: str) -> tuple[str, ...]:
    words = (w for m in NAMING.finditer(rest) for w in re.split(r"[^a-z0-9]+", next(x for x in (*m.groups(), "") if x is not None).lower()) if w)
    return (name, *dict.fromkeys(words))


def skips(found: list[re.Match[str]]) -> dict[int, int]:
    """The end tag's number for each start tag of an element to skip, or -1 if it has none; an svg tag that ends in /> is its own end."""
    out: dict[int, int] = {}
    still: dict[str, list[int]] = {x: [] for x in SKIPPED if x != "head" and x not in RAW}
    for i, m in enumerate(found):
        name = (m["name"] or "").lower()
        if name not in still:
            continue
        if not m["end"]:
            out[i] = i if name == "svg" and m["rest"].endswith("/") else -1
            if out[i] < 0:
                still[name].append(i)
        elif still[name]:
            out[still[name].pop()] = i
    return out


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    path: list[tuple[str, ...]] = []
    serials: list[int] = []
    parts: list[str] = []
    begun = False  # whether the block has more than white space
    linked = in_link = 0
    at: tuple[tuple[str, ...], ...] = ()
    within = -1
    in_head = False
    found = list(MARKUP.finditer(page))
    skipped = skips(found)
    skip_to, unclosed = -1, False  # an element to skip without an end tag lasts to the next block

    def close() -> None:
        nonlocal linked, begun
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(at, text, min(linked, len(text)), within))
        parts.clear()
        linked, begun = 0, False

    for number, m in enumerate(found):
        if number <= skip_to:
            continue
        name = m["name"]
        if name is None:
            raw = m[0]
            if raw[0] != "<" or raw == "<":
                in_head = in_head and not raw.strip()
                if in_head or unclosed:
                    continue
                text = html.unescape(raw) if "&" in raw else raw
                if not begun and text.strip():
                    begun = True
                    at = tuple(path)
                    within = next((serials[i] for i in range(len(path) - 1, -1, -1) if path[i][0] not in PIECES), -1)
                parts.append(text)
                linked += len(text.strip()) * bool(in_link)
            continue
        name = name.lower()
        unclosed = unclosed and name not in BLOCKS
        if not m["end"]:
            in_head = in_head and name in IN_HEAD
        if number in skipped:
            skip_to = skipped[number]
            unclosed = unclosed or skip_to < 0
            continue
        if m["end"]:
            in_head = in_head and name != "head"
            if name == "a":
                in_link = max(0, in_link - 1)
            if name == "br":
                parts.append(" ")
            if name in BLOCKS:
                close()
            for i in range(len(path) - 1, -1, -1):
                if path[i][0] == name:
                    del path[i:], serials[i:]
                    break
            continue
        if name == "head":
            in_head = True
        elif name == "br":
            parts.append(" ")
        if name in BLOCKS:
            close()
            inner = next((i for i in range(len(path) - 1, -1, -1) if path[i][0] in ("p", "li", "dt", "dd", "td", "th", "tr", "ul", "ol", "table", "div", "section", "article")), -1)
            if inner >= 0 and (path[inner][0] == "p" or path[inner][0] == name and name in ("li", "dt", "dd", "td", "th", "tr")):
                del path[inner:], serials[inner:]
        if name in VOID or re.search(r"""(?:^|[\s"'])/$""", m["rest"]):
            continue
        in_link += name == "a"
        path.append(element(name, m["rest"]))
        serials.append(number)
    close()
    return out


def said(path: tuple[tuple[str, ...], ...]) -> int | None:
    """What the markup says of a block: 1 article, 0 boilerplate, None nothing. A header within the article is its own."""
    content = False
    for name, *words in path:
        if name in CONTENT_NAMES or (words and any(w in CONTENT_WORDS for w in words) and not any(w in BOILERPLATE_WORDS for w in words)):
            content = True
        elif (name in BOILERPLATE_NAMES and not (content and name == "header")) or any(w in BOILERPLATE_WORDS for w in words):
            return 0
    return 1 if content else None


def is_prose(b: Block) -> bool:
    return len(b.text.split()) >= PROSE_WORDS and 2 * b.linked < len(b.text)


def labels_of(blocks: list[Block]) -> list[int]:
    """What each block is to be taught as. Where the markup says nothing, a container is judged whole: if most words of the blocks
    that stand in it one after the other are in prose, all of them are article, its headings, list items, cells and short
    paragraphs too; lists of links in it aren't."""
    out = [said(b.path) for b in blocks]
    at = 0
    while at < len(blocks):
        to = at + 1
        while to < len(blocks) and out[at] is None and out[to] is None and blocks[to].within == blocks[at].within:
            to += 1
        if out[at] is None:
            run = blocks[at:to]
            words = [len(b.text.split()) for b in run]
            article = 2 * sum(n for n, b in zip(words, run, strict=True) if is_prose(b)) > sum(words)
            out[at:to] = [int(article and 2 * b.linked <= len(b.text)) for b in run]
        at = to
    return [int(x or 0) for x in out]


@lru_cache(maxsize=65536)
def path_slots(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    tokens = {t for name, *words in path for t in (name, *(f".{w}" for w in words))} | {f"last {path[-1][0]}" if path else "none"}
    return np.array(sorted({zlib.crc32(t.encode()) % PATH_SIZE for t in tokens}))


def vectors(blocks: list[Block]) -> np.ndarray:
    """A row for each block."""
    x = np.zeros((len(blocks), PATH_SIZE + WORD_SIZE + FIGURES), dtype=np.float32)
    w = words_of(pa.array([b.text for b in blocks], pa.string()), NOT_SPACE)
    slot = (word_hashes(w) % np.uint64(WORD_SIZE)).astype(np.int64)
    n = np.bincount(w.docs, minlength=len(blocks))
    counts = np.bincount(w.docs * WORD_SIZE + slot, minlength=len(blocks) * WORD_SIZE).reshape(-1, WORD_SIZE)
    x[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = counts / np.maximum(1, np.sqrt((counts * counts).sum(1)))[:, None]
    for i, b in enumerate(blocks):
        x[i, path_slots(b.path)] = 1
        x[i, -FIGURES:] = (math.log1p(n[i]) / 5, b.linked / max(1, len(b.text)), b.text[-1:] in ".!?", n[i] < 5, len(b.path) / 10, i / len(blocks))
    return x


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, rows))
    x = np.zeros((len(rows), steps, rows[0].shape[1]), dtype=np.float32)
    mask = np.zeros((len(rows), steps), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
        mask[i, : len(r)] = 1
    return x, mask


def variant(blocks: list[Block], prose: list[str], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """The page with other names for its boilerplate and content elements, or without names for its content, with more headings, lists
    and short paragraphs in the article and more prose and links around it; and its labels, which are those of the page
    as it was."""

    def boiler() -> tuple[str, ...]:
        if rng.random() < 0.35:
            return (str(rng.choice(BOILERPLATE_NAMES)),)
        return (str(rng.choice(["div", "section", "aside", "ul", "form", "p"])), str(rng.choice(BOILERPLATE_WORDS)))

    def content() -> tuple[str, ...]:
        if rng.random() < 0.5:
            return (str(rng.choice(CONTENT_NAMES)),)
        return (str(rng.choice(["div", "section", "main", "article"])), str(rng.choice(CONTENT_WORDS)))

    swaps: dict[tuple[str, ...], tuple[str, ...]] = {}

    def swap(e: tuple[str, ...]) -> tuple[str, ...]:
        if e not in swaps:
            alone = said((e,))
            swaps[e] = e if alone is None or rng.random() < 0.3 else (content() if alone else boiler())
        return swaps[e]

    def some(most: int) -> str:
        return " ".join(prose[int(rng.integers(len(prose)))].split()[: int(rng.integers(1, most))])

    labels = labels_of(blocks)
    bare = rng.random() < 0.3  # a page whose markup doesn't name its content
    out = [Block(tuple(map(swap, (e for e in b.path if not (bare and said((e,)) == 1)))) or (("div",),), b.text, b.linked) for b in blocks]
    for at in range(len(out) - 1, -1, -1):  # pieces of the article's own
        if rng.random() < 0.2 and labels[at] and prose:
            inner = [[("ul",), ("li",)], [("ol",), ("li",)], [("table",), ("tr",), ("td",)], [("blockquote",)], [("h2",)], [("h3",)], [("p",)], [("pre",)], [("div",), ("p",)]][int(rng.integers(9))]
            for _ in range(int(rng.integers(1, 4)) if inner[-1][0] in ("li", "td") else 1):
                out.insert(at + 1, Block((*out[at].path[:-1], *inner), some(20), 0))
                labels.insert(at + 1, 1)
    edges = [i for i in range(len(out) + 1) if (i == 0 or not labels[i - 1]) or (i == len(out) or not labels[i])]
    for _ in range(int(rng.integers(0, 4)) if prose else 0):
        # named boilerplate anywhere, unnamed lists of links only outside of the article
        named = rng.random() < 0.7
        at = int(rng.integers(0, len(out) + 1)) if named else int(rng.choice(edges))
        outside = out[min(at, len(out) - 1)].path[: int(rng.integers(0, 4))] if out else ()
        if named:
            inside = (*outside, boiler())
            tail = [("p",)] if rng.random() < 0.6 else [("ul",), ("li",)]
            added = [Block((*inside, *tail), some(40), 0) for _ in range(int(rng.integers(1, 4)))]
        else:
            outside = tuple(e for e in outside if said((e,)) != 1)
            texts = [some(5) for _ in range(int(rng.integers(2, 7)))]
            added = [Block((*outside, ("div",), ("ul",), ("li",)), t, len(t)) for t in texts]
        out[at:at] = added
        labels[at:at] = [0] * len(added)
        edges = [i for i in range(len(out) + 1) if (i == 0 or not labels[i - 1]) or (i == len(out) or not labels[i])]
    return out, labels


def invented(prose: list[str], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A page of a make of its own, of words of the sample, and its labels: regions in any order and number around an article that
    is named or not, with pieces of every kind in it and boilerplate between them."""

    def some(least: int, most: int) -> str:
        words: list[str] = []
        n = int(rng.integers(least, most))
        while len(words) < n:
            words += prose[int(rng.integers(len(prose)))].split()
        return " ".join(words[:n])

    def pick(names: list[str]) -> str:
        return str(names[int(rng.integers(len(names)))])

    def neutral() -> tuple[str, ...]:
        words = [pick(NEUTRAL_WORDS) if rng.random() < 0.7 else f"x{int(rng.integers(10**6))}" for _ in range(int(rng.integers(0, 3)))]
        return (pick(["div", "div", "div", "section", "span"]), *words)

    def wraps(most: int) -> tuple[tuple[str, ...], ...]:
        return tuple(neutral() for _ in range(int(rng.integers(0, most))))

    def named(names: list[str], words: list[str]) -> tuple[str, ...]:
        extra = [pick(NEUTRAL_WORDS)] if rng.random() < 0.4 else []
        if rng.random() < 0.35:
            return (pick(names), *extra)
        return (pick(["div", "div", "section", "ul" if words is BOILERPLATE_WORDS else "div"]), *rng.permutation([pick(words), *extra]).tolist())

    blocks: list[Block] = []
    labels: list[int] = []

    def add(path: tuple[tuple[str, ...], ...], text: str, linked: float, yes: bool) -> None:
        blocks.append(Block(path, text, int(linked * len(text))))
        labels.append(int(yes))

    def boilerplate(outer: tuple[tuple[str, ...], ...]) -> None:
        has_name = rng.random() < 0.75
        inner = (*outer, *wraps(2), named(BOILERPLATE_NAMES, BOILERPLATE_WORDS)) if has_name else (*outer, *wraps(2), neutral())
        if rng.random() < 0.55 or not has_name:  # links
            for _ in range(int(rng.integers(1, 9))):
                item = [(("ul",), ("li",)), (("p",),), (("table",), ("tr",), ("td",)), ()][int(rng.integers(4))]
                add((*inner, *item, ("a",)), some(1, 9), 1, False)
        else:
            for _ in range(int(rng.integers(1, 5))):
                item = [(("p",),), (("h3",),), (("ul",), ("li",)), ()][int(rng.integers(4))]
                add((*inner, *item), some(1, 40), float(rng.choice([0, 0, 0.5, 1])), False)

    def article(outer: tuple[tuple[str, ...], ...]) -> None:
        has_name = rng.random() < 0.6
        body = (*outer, *wraps(2), named(CONTENT_NAMES, CONTENT_WORDS)) if has_name else (*outer, neutral())
        body = (*body, *wraps(2)) if rng.random() < 0.3 else body
        if rng.random() < 0.8:
            add((*body, ("h1" if rng.random() < 0.6 else "h2",)), some(1, 9), float(rng.random() < 0.1), True)
        for n in range(int(rng.integers(1, 12))):
            kind = rng.random()
            if n < 1 or kind < 0.55:
                add((*body, ("p",)), some(10, 90) + pick([".", ".", "", "!"]), float(rng.random() < 0.2) * 0.3, True)
            elif kind < 0.63:
                add((*body, ("p",)), some(1, 6) + pick([".", "", "?"]), 0, True)
            elif kind < 0.73:
                add((*body, (pick(["h2", "h3", "h4"]),)), some(1, 7), 0, True)
            elif kind < 0.93:
                item = [[("ul",), ("li",)], [("ol",), ("li",)], [("table",), ("tr",), ("td",)], [("blockquote",)], [("figure",), ("figcaption",)], [("pre",)], [("dl",), ("dt",)], [("dl",), ("dd",)]][int(rng.integers(8))]
                for _ in range(int(rng.integers(1, 6))):
                    add((*body, *item), some(1, 15), 0, True)
            else:
                boilerplate(body)

    root = ((("html",), ("body", *((pick(NEUTRAL_WORDS),) if rng.random() < 0.3 else ()))))[int(rng.integers(0, 2)) :] + wraps(3)
    for _ in range(int(rng.integers(0, 4))):
        boilerplate(root)
    article(root)
    for _ in range(int(rng.integers(0, 4))):
        boilerplate(root)
    return blocks, labels


def trained(pages: list[str], seed: int = 11, steps: int = FIT_STEPS) -> BiLstm:
    rng = np.random.default_rng(seed)
    model = BiLstm(PATH_SIZE + WORD_SIZE + FIGURES)
    parsed = [b for b in map(blocks_of, pages) if b]
    prose = [x.text for b in parsed for x, yes in zip(b, labels_of(b), strict=True) if yes][:PROSE_BLOCKS]

    def batches() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for _ in range(steps if parsed else 0):
            chosen = [parsed[i] for i in rng.integers(0, len(parsed), 16)]
            shown = [(b, labels_of(b)) if (kind := rng.random()) < 0.2 else variant(b, prose, rng) if kind < 0.5 or not prose else invented(prose, rng) for b in chosen]
            rows = [vectors(b) for b, _ in shown]
            for r in rows:
                r[rng.random(len(r)) < 0.05, :PATH_SIZE] = 0
                if rng.random() < 0.4:  # words of another language say nothing
                    r[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = 0
            x, mask = padded(rows)
            labels = np.zeros_like(mask)
            for i, (_, known) in enumerate(shown):
                labels[i, : len(known)] = known
            yield x, mask, labels

    model.fit(batches())
    return model


def texts_of(pages: list[str], model: BiLstm) -> list[str]:
    """The main text of each page."""
    parsed = [blocks_of(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(parsed) if b), key=lambda i: len(parsed[i]))
    while order:
        # pages of like length together, about SLOTS blocks at once
        n = max(1, SLOTS // len(parsed[order[-1]]))
        some, order = order[-n:], order[:-n]
        x, mask = padded([vectors(parsed[i]) for i in some])
        keep = model.probabilities(x, mask)[0] > 0.5
        for i, k in zip(some, keep, strict=True):
            out[i] = "\n\n".join(b.text for b, yes in zip(parsed[i], k, strict=False) if yes)
    return out


def fit_sample(pages: DataFrame, html_column: str = "html") -> list[str]:
    """Up to FIT_PAGES different pages, in an order that doesn't depend on how they are dealt out. The hashes are ranked
    by themselves, so that tasks don't send pages to the driver which aren't among the chosen."""
    fit = pages.filter(F.length(html_column).between(1, FIT_CHARS)).select(F.xxhash64("page_id", "url", html_column).alias("h"), html_column)
    chosen = [r[0] for r in fit.select("h").distinct().orderBy("h").limit(FIT_PAGES).collect()]
    found = {r["h"]: r[html_column] for r in fit.filter(F.col("h").isin(chosen)).distinct().collect()} if chosen else {}
    return [found[h] for h in chosen]


def main_text(pages: DataFrame, model: BiLstm, html_column: str = "html") -> DataFrame:
    """(page_id, url, text) of every row of pages."""
    kept = pages.select("page_id", "url", F.coalesce(F.col(html_column), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts_of(part.column(2).to_pylist(), model), pa.string())], names=["page_id", "url", "text"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"page_id {id_type}, url string, text string")


def op10_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = main_text(pages, trained(fit_sample(pages)))
    return found.withColumn("n_chars", F.length("text").cast("long"))
