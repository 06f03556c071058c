"""Main text of web pages by two passes over blocks.

First pass: each block is judged by itself, by its length, its link density and the density of stop words in it; the
containers it lies in are one more feature. Those that the task itself excludes (menus, footers, forms ...) rule it out;
an article or main element makes the limits milder, but rules nothing in. Second pass: short and other ambiguous blocks
inherit the label of their nearest decided neighbours. Stop words are those of a few languages and what the pages
themselves show to be function words: short words that are in many pages of one declared language.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlens.llm.common import batch_of, column_list, map_arrow, prepared, table
from shotlens.session import materialise

#: Frequent function words of a few languages.
STOP_WORDS = frozenset(
    "a an and are as at be been but by can for from had has have he her his if in into is it its more no not of on one or our she so than that the their them there they this to was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer es für hat im in ist mit nach nicht noch nur oder sich sie sind so über um und von vor war wie wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con de del el en es esta este fue ha la las lo los más no para pero por que se si sin sobre son su sus también un una y".split()
)
#: Limits of the first pass: share of link text, length of a short block, shares of stop words.
MAX_LINKS, SHORT, LONG, LOW, HIGH = 0.25, 70, 200, 0.10, 0.20
#: Learned stop words: longest one, share of a language's pages that it is in, pages without the word that are added to
#: each language's (so that few pages prove little), entries that a task counts at a time.
STOP_LETTERS, STOP_SHARE, PRIOR_PAGES, COUNTED = 6, 0.2, 50, 200_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|select|iframe|object|svg|math|title|canvas|video|audio)\b[^>]*(?:(?<=/)>|>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_NAMES = re.compile(r"[a-z]+", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORDS = re.compile(r"[^\W\d_]+")
_SENTENCE_END = re.compile(r"[.!?\u2026\u3002\u0964\u061f](?:\s|$)|\u3002")
_LANGUAGE = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})\b", re.I)
_CONTAINERS = frozenset("html body div section article main nav aside header footer form ul ol dl table tbody thead tfoot tr td th fieldset figure blockquote details dialog menu address center hgroup search".split())
_BLOCKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr caption figcaption summary legend option label".split())
_BAD_TAGS = frozenset("nav aside footer form menu dialog head fieldset button search".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
#: Words of class and id names that tell boilerplate.
_BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "sidebar sidebars widget widgets related recommended recommendations share sharing social menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist disqus respond replies reply "
    "login signup signin register search toolbar pagination pager copyright disclaimer paywall tags toc trending".split()
)
#: Words before such a name that tell of a layout's wrapper, and names that even an article inside does not lift.
_LAYOUT, _COMMENTS = frozenset("with has no without".split()), frozenset("comment comments commentlist disqus respond replies reply".split())
GOOD, BAD, NEAR, SHORT_ = "good", "bad", "near", "short"


@dataclass(slots=True)
class Block:
    parts: list[str] = field(default_factory=list)
    links: int = 0
    bad: bool = False  # in a container that holds no main text
    main: bool = False  # in one that may hold it
    heading: bool = False
    text: str = ""
    label: str = ""


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if "=" in raw or "hidden" in raw else {}


def _marks(tag: str, attributes: dict[str, str], in_main: bool) -> tuple[str, bool]:
    """Whether an element is boilerplate ("firm", "weak", which an article or main element inside lifts, or ""), and
    whether it may hold the main text."""
    firm = tag in _BAD_TAGS or tag == "header" and not in_main
    main, weak = tag in ("article", "main"), False
    if attributes:
        names: set[str] = set()
        for k in ("class", "id"):
            for token in attributes.get(k, "").split():
                words = [x.lower() for x in _NAMES.findall(_CAMEL.sub(" ", token))]
                names.update(w for w, before in zip(words, ["", *words], strict=False) if before not in _LAYOUT)
        role = attributes.get("role", "").lower()
        firm = firm or role in _BAD_ROLES or bool(names & _COMMENTS) and tag not in ("html", "body") or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        weak = bool(names & _BAD_NAMES) and tag not in ("html", "body") and not main
        main = main or role in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody"
    return "firm" if firm else "weak" if weak else "", main and not firm and not weak


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order with their text (references decoded, white space folded), links and containers."""
    out: list[Block] = []
    block = Block()
    stack: list[tuple[str, str, bool]] = []  # container, in boilerplate, in main text
    bad, main = "", False
    anchors = 0

    def end() -> None:
        nonlocal block
        if block.parts:
            block.text = " ".join("".join(block.parts).split())
            if block.text:
                out.append(block)
        block = Block(bad=bool(bad), main=main)

    def text(piece: str) -> None:
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            block.parts.append(piece)
            if anchors:
                block.links += len(" ".join(piece.split()))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "a":
                anchors = max(0, anchors - 1)
            elif tag in _BLOCKS or tag in ("head", "button"):
                end()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        _, bad, main = stack[k]
                        del stack[k:]
                        break
                block.bad, block.main = bool(bad), main
                anchors = 0
            continue
        if tag == "br":
            block.parts.append(" ")
        elif tag == "a":
            anchors += not m[4].endswith("/")
        elif tag in _BLOCKS or tag in ("head", "button"):
            end()
            anchors = 0
            is_bad, is_main = _marks(tag, _attributes(m[4]), main)
            if tag in _CONTAINERS or tag in ("head", "button") or is_bad:
                if not m[4].endswith("/") and tag != "hr":
                    stack.append((tag, bad, main))
                    if tag == "body":  # an unclosed head ends here
                        bad = ""
                    bad = "firm" if "firm" in (bad, is_bad) else "" if is_main else bad or is_bad
                    main = main or is_main
            elif tag in ("p", "li", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6"):
                # an element of this kind that was left open, and was marked, ends here
                while stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                    _, bad, main = stack.pop()
            block.bad, block.main, block.heading = bool(bad), main, tag[0] == "h" and tag[1:].isdigit()
    text(page[at:])
    end()
    return out


def judge(b: Block, stop_words: frozenset[str] = STOP_WORDS) -> str:
    """First pass."""
    n = len(b.text)
    if b.bad or b.links > MAX_LINKS * n or b.text.startswith("©") and not b.main:
        return BAD
    if b.heading:
        return SHORT_
    if n < SHORT:
        return BAD if b.links and not b.main else SHORT_
    words = _WORDS.findall(b.text.lower())
    stops = sum(w in stop_words for w in words) / max(1, len(words))
    if stops >= HIGH:
        return GOOD if n > LONG or b.main else NEAR
    # without stop words: sentences of a language that isn't known
    prose = n > LONG and not b.links and len(_SENTENCE_END.findall(b.text)) > 1
    return NEAR if stops >= LOW or b.main or prose else BAD


def inherit(blocks: list[Block]) -> None:
    """Second pass: first the blocks that are nearly good (good unless both neighbours are bad), then short ones (the
    label of both neighbours; where they differ, good in main text or next to a block that was nearly good, and for a
    heading the label of what follows). A block's neighbours are the nearest decided ones; the page's ends count as bad.
    For a block in main text those that a container rules out are passed over, and the ends of the main text count as good."""
    first = [b.label for b in blocks]
    near = [f == NEAR for f in first]

    def decided(i: int, step: int, skip: tuple[str, ...]) -> tuple[str, bool]:
        main = blocks[i].main
        i += step
        while 0 <= i < len(blocks):
            if main and not blocks[i].bad and not blocks[i].main:
                break
            if first[i] not in skip and not (main and blocks[i].bad):
                return first[i], near[i]
            i += step
        return GOOD if main else BAD, False

    for i, b in enumerate(blocks):
        if first[i] == NEAR:
            left, right = decided(i, -1, (SHORT_, NEAR))[0], decided(i, 1, (SHORT_, NEAR))[0]
            long = len(b.text) > LONG // 2
            b.label = BAD if left == right == BAD and not long else GOOD
    first = [b.label if f == NEAR else f for b, f in zip(blocks, first, strict=True)]
    for i, b in enumerate(blocks):
        if first[i] == SHORT_:
            (left, left_near), (right, right_near) = decided(i, -1, (SHORT_,)), decided(i, 1, (SHORT_,))
            b.label = right if b.heading else left if left == right else GOOD if b.main or left_near or right_near else BAD


def main_text(page: str, stop_words: frozenset[str] = STOP_WORDS) -> list[str]:
    """The texts of the blocks that are main text."""
    blocks = blocks_of(page)
    for b in blocks:
        b.label = judge(b, stop_words)
    inherit(blocks)
    return [b.text for b in blocks if b.label == GOOD]


def function_words(spark: SparkSession, pages: DataFrame, html_col: str = "html") -> frozenset[str]:
    """Words of at most STOP_LETTERS letters that are in the share STOP_SHARE of the pages of one declared language (the
    pages without one are a group too), to which PRIOR_PAGES are added, counted over all pages. Their number is bounded: a
    page's words over that share, for each language code."""
    prepared(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys, n = list(seen), pa.array(list(seen.values()), pa.int64())
            seen.clear()
            return batch_of(lang=pa.array([k[0] for k in keys], pa.string()), word=pa.array([k[1] for k in keys], pa.string()), n=n)

        for b in batches:
            for page in column_list(b, "page"):
                m = _LANGUAGE.search(page)
                lang = m[1].lower() if m else ""
                text = " ".join([x.text for x in blocks_of(page) if not x.bad])
                seen[lang, ""] += 1
                seen.update([(lang, w) for w in set(_WORDS.findall(text.lower())) if len(w) <= STOP_LETTERS])
            if len(seen) > COUNTED:
                yield out()
        yield out()

    texts = pages.select(F.coalesce(F.col(html_col), F.lit("")).alias("page"))
    counted = materialise(spark, map_arrow(texts, count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    sizes = counted.where("word = ''").select("lang", F.col("n").alias("pages"))
    found = counted.where("word <> ''").join(sizes, "lang").where(F.col("n") >= STOP_SHARE * (F.col("pages") + PRIOR_PAGES))
    return frozenset(found.select("word").distinct().toArrow().column(0).to_pylist())


def extract_pages(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The id, URL, text (blocks joined by a line feed) and n_chars (code points) of every row's whole page.

    Null html is empty, and an empty or textless page has an empty text; null ids and URLs stay null; repeated rows are
    extracted each; an empty table gives an empty table; further columns are not read. The stop words are learned from
    the same pages, so that a page's text may depend on the table it is in. Markup that is cut off or not
    closed is read as far as it goes: an element that is open at the end holds all that follows it.
    """
    prepared(spark)
    kind = pages.schema[id_col].dataType.simpleString()
    stop_words = STOP_WORDS | function_words(spark, pages, html_col)
    shared = spark.sparkContext.broadcast(stop_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["\n".join(main_text(x, shared.value)) for x in column_list(b, "page")]
            yield batch_of(**{id_col: b.column(0), url_col: b.column(1)}, text=pa.array(texts, pa.string()), n_chars=pa.array([len(t) for t in texts], pa.int64()))

    rows = pages.select(F.col(id_col), F.col(url_col), F.coalesce(F.col(html_col), F.lit("")).alias("page"))
    return map_arrow(rows, run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark, table(spark, sf_dir, "pages"))
