"""Main text of web pages by two passes of rules over blocks.

A page is cut into blocks at block-level tags; each knows its words, the share of them
in links, and the regions it is in (an article, or boilerplate by tag or class).

Pass 1 decides what it can.  Blocks in boilerplate regions and blocks that are mostly
links go; blocks that are long enough and dense enough in function words stay; where a
page marks an article, what stands outside goes.  On a page without any dense block,
whose language the function words don't know, length alone decides.  Short blocks and
blocks that aren't dense stay open.  Pass 2 gives each open block the label of its
nearest decided neighbour in the same region; with neighbours equally near on both sides
that differ, or with none, an article keeps the block and the rest of a page only a long
one.  A long block outside an article goes only if no neighbour on either side stays.

Defined cases: a null or empty html has an empty text; what a page leaves unclosed ends
with the page, but a tag without its ``>`` is dropped; equal pages have equal texts;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import textnum

#: Function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all
    der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei um am
    de la le et les en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son
    el y los del las por para con no su al lo como más pero sus ya o""".split()
)
#: Elements by what they mean for blocks.
BLOCKS = frozenset(
    """address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3
    h4 h5 h6 head header hgroup html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr
    ul xmp""".split()
)
RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "select", "textarea", "title", "button", "canvas", "audio", "video")
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset".split())
ARTICLE = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words in a class, id or role that mark boilerplate.
MARKS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar
    widget cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related
    recommended recommendations footer header masthead toolbar pager pagination copyright legal comment comments respond reply replies disqus discussion
    contentinfo complementary search""".split()
)
COMMENTS = frozenset("comment comments respond reply replies disqus discussion".split())

_RAW = "|".join(RAW)
_ATTRIBUTES = r"""(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+"""  # only a quote after = opens a value
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/>]){_ATTRIBUTES}(?<=/)>|<(?P<raw>{_RAW})(?=[\s/>]){_ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>{_ATTRIBUTES})(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S | re.I,
)
_MARKED = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Rules:
    links: float = 0.4  # more of the characters in links: boilerplate
    short: int = 70  # characters; below, outside an article, a block stays open
    dense: float = 0.25  # share of function words that keeps a block


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    boilerplate: bool = False
    article: int = 0  # number of the article around it, 0 for none
    text: str = ""


def _marks(attributes: str) -> set[str]:
    return {w.lower() for m in _MARKED.finditer(attributes) for w in _PART.findall(m[1])}


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page that hold text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # open containers: tag, boilerplate, article
    flagged: str | None = None  # a paragraph that is boilerplate by its class
    articles = links = at = 0
    now = Block()

    def close() -> None:
        nonlocal now
        text = " ".join(unescape("".join(now.parts)).split())
        if text:
            now.text = text
            out.append(now)
        now = Block(boilerplate=bool(stack and stack[-1][1]) or flagged is not None, article=stack[-1][2] if stack else 0)

    def add(piece: str) -> None:
        if piece:
            now.parts.append(piece)
            if links:
                now.linked += len(piece)

    for m in _TOKEN.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if not m[0].endswith(">"):  # the page ends within a tag
            break
        marks = _marks(m["attributes"]) if "=" in m["attributes"] else set()
        if tag not in BLOCKS and tag not in VOID:  # as in browsers, what isn't known to be a block is none
            if tag == "a":
                links = max(0, links - 1) if m["end"] else 1
            # but for elements of a page's own whose name or class says boilerplate
            own = "-" in tag and (any(x[0] == tag for x in stack) if m["end"] else bool((marks | set(tag.split("-"))) & MARKS) and not m[0].endswith("/>"))
            if not own:
                continue
            marks |= set(tag.split("-"))
        if tag in VOID:
            if tag == "hr":
                close()
            else:
                add(" ")
            continue
        links = 0 if tag != "a" else links
        if m["end"]:
            if tag == "p" or tag == flagged:
                flagged = None
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if depth is not None:
                del stack[depth:]
            close()
            continue
        bad, article = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
        comments = bool(marks & COMMENTS)
        if tag in ARTICLE and not comments:
            if not articles:  # a menu left open: no article stands in one
                del stack[next((k for k, x in enumerate(stack) if x[0] in ("nav", "menu", "header")), len(stack)) :]
            bad, article = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
            if not article and not bad:
                articles += 1
                article = articles
        marked = marks & MARKS - ({"header"} if article else set())
        bad = bad or bool(marked) or (tag in BOILERPLATE and not (tag == "header" and article)) or (bool(m["attributes"]) and _HIDDEN.search(m["attributes"]) is not None)
        if tag == "p" or re.fullmatch("h[1-6]|li|dt|dd|td|th|tr|option", tag):
            # closed by the next of their kind, so never on the stack
            flagged = tag if bad and not (stack and stack[-1][1]) else None
        elif tag not in ("html", "body", "head"):
            flagged = None
            stack.append((tag, bad, article))
        close()
    else:
        add(html[at:])
    close()
    return out


def labels(blocks: list[Block], rules: Rules = Rules()) -> list[bool]:
    """Which blocks are main text."""
    first: list[bool | None] = []
    marked = any(b.article and not b.boilerplate for b in blocks)
    gone = [b.boilerplate or b.linked > rules.links * len(b.text) or (marked and not b.article) for b in blocks]
    long = [len(b.text) >= rules.short for b in blocks]
    dense = [wide and not bad and _density(b.text) >= rules.dense for b, wide, bad in zip(blocks, long, gone)]
    known = any(dense)  # else the page's language has no function words here, and density says nothing
    for b, bad, wide, full in zip(blocks, gone, long, dense):
        first.append(False if bad else True if full or (wide and not known) else None)
    out = []
    left = _nearest(blocks, first, range(len(blocks)))
    right = _nearest(blocks, first, range(len(blocks) - 1, -1, -1))
    for k, keep in enumerate(first):
        if keep is None:
            near = [x for x in (left[k], right[k]) if x is not None]
            least = min((d for d, _ in near), default=0)
            votes = {label for d, label in near if d == least}
            # a long block goes only if boilerplate is all that is near on either side
            keep = (long[k] and (bool(blocks[k].article) or any(label for _, label in near))) or (votes.pop() if len(votes) == 1 else bool(blocks[k].article) or long[k])
        out.append(keep)
    return out


def _density(text: str) -> float:
    """Share of function words."""
    words = [w.lower() for w in _WORD.findall(text)]
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _nearest(blocks: list[Block], first: list[bool | None], order: range) -> list[tuple[int, bool] | None]:
    """Distance and label of the last decided block of the same region on one side; boilerplate within an article decides nothing."""
    out: list[tuple[int, bool] | None] = [None] * len(blocks)
    seen: dict[int, tuple[int, bool]] = {}
    for k in order:
        region = blocks[k].article
        if first[k] is None:
            if region in seen:
                out[k] = abs(k - seen[region][0]), seen[region][1]
        elif not (region and blocks[k].boilerplate):
            seen[region] = k, first[k]
    return out


def main_text(html: str | None, rules: Rules = Rules()) -> str:
    """The blocks of main text, joined by empty lines."""
    if not html:
        return ""
    blocks = blocks_of(html)
    return "\n\n".join(b.text for b, keep in zip(blocks, labels(blocks, rules)) if keep)


def extract(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnum.slices(batch, "html"):
                texts = [main_text(x.as_py(), rules) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(textnum.lean(run), "page_id bigint, url string, text string, n_chars bigint")
