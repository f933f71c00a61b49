"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one decides the blocks of all pages on their own: by the tags that enclose
them (navigation, footers and the like), by link density, length and stop-word density. A word in class, id or role (adverts,
comments and the like) or a form only makes a block doubtful, unless the element holds most of the page's good text. Short blocks and blocks with few stop words stay undecided. Pass two gives them the label of the nearest decided
neighbours, the nearer one if the two sides differ; a heading goes with what follows it. An article mark keeps no block by
itself: inside, only neighbours from inside speak and ties are good; outside, an undecided block needs good text on both sides.

One pass over each page in a task; nothing is shuffled. Defined cases: null or empty html gives an empty text. Broken
markup is read as it comes: unclosed tags end with their container, a cut-off tag or comment at the end is
dropped, a lone ``<`` is text. Repeated rows give equal rows.
"""

from __future__ import annotations

import html
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.session import configure

# A quote opens a value only behind an equals sign; an unquoted value ends at white space or at the end of the tag.
VALUE = r"=\s*\"[^\"]*\"|=\s*'[^']*'|=\s*[^\s\"'>][^\s>]*|[^>]"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:{VALUE})*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
RAW = {"script", "style", "template", "noscript", "iframe", "object", "svg", "math", "canvas", "textarea", "select", "title", "audio", "video", "button"}
CONTAINERS = {"article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "head", "header", "hgroup", "main", "menu", "nav", "ol", "section", "table", "tbody", "td", "th", "tr", "ul"}
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "pre", "address", "figcaption", "caption", "summary", "hr", "legend", "label"}
BOILERPLATE_TAGS = {"aside", "dialog", "footer", "form", "head", "header", "menu", "nav", "fieldset"}
HINTS = set(
    "ad ads adsense advert advertisement advertising adverts alert aside banner breadcrumb breadcrumbs comment comments complementary consent contentinfo "
    "cookie cookies discussion disqus feedback footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split()
)
ARTICLE_HINTS = set("article articlebody entry post story".split())
STOP_WORDS = set(
    "a an and are as at be by for from had has have he in is it not of on or she that the they this to was were which with you "
    "au aux avec ce dans de des du elle en est et il je la le les ne par pas pour que qui se sur un une "
    "als auch auf aus bei das dem den der des die ein eine er es für ich im ist mit nicht sich sie sind und von wie zu "
    "al como con del el ella era esta las lo los más muy no para pero por se sin su sus una y".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MARKS = string.punctuation + "«»“”„‘’…–—¿¡"
LONG_CHARS, LINKED, STOPPED = 80, 0.5, 0.2
SPARSE, SPARSE_INSIDE = 0.1, 0.02


def hinted(attributes: str) -> tuple[bool, bool, bool]:
    """Whether attributes hide an element, whether class, id or role mark boilerplate, and whether they mark an article."""
    hidden = bad = good = False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name in ("class", "id", "role"):
            words = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()))
            bad |= bool(words & HINTS)
            good |= bool(words & ARTICLE_HINTS) or name == "role" and value.lower() in ("main", "article")
    return hidden, bad, good


def blocks(page: str) -> list[dict]:
    """Text blocks of a page in order: text, linked (characters in links), bad, hints (numbers of the elements round
    it that a word marks as boilerplate), inside (an article), leaf."""
    out: list[dict] = []
    stack: list[tuple[str, bool, tuple, bool]] = [("", False, (), False)]  # tag, bad, hints, inside an article
    parts: list[str] = []
    linked: list[str] = []
    link, leaf_bad, leaf_hints, leaf, at, number = 0, False, (), "", 0, 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            in_links = len(" ".join(html.unescape("".join(linked)).split()))
            out.append({"text": text, "linked": in_links, "bad": stack[-1][1] or leaf_bad, "hints": stack[-1][2] + leaf_hints, "inside": stack[-1][3], "leaf": leaf})
        parts, linked = [], []

    def add(text: str) -> None:
        parts.append(text)
        if link:
            linked.append(text)

    while match := TOKEN.search(page, at):
        add(page[at : match.start()])
        at = match.end()
        end, tag, attributes = match[1], match[2], match[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW and not end:
            if attributes.endswith("/"):
                continue
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
        elif tag == "a":
            link = 0 if end else 1
        elif tag == "br":
            add(" ")
        elif tag in CONTAINERS:
            flush()
            leaf, leaf_bad, leaf_hints, link = "", False, (), 0
            if end:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                if depth:
                    del stack[depth:]
                continue
            if tag == "body":
                del stack[1:]
            hidden, bad, good = hinted(attributes)
            _, out_bad, hints, inside = stack[-1]
            own = tag in BOILERPLATE_TAGS - {"form"} and not (tag == "header" and inside) or hidden and tag not in ("body", "main")
            # A form may be the whole page: like a word, it only makes a block doubtful. Words on an article say nothing.
            if (tag == "form" or bad and not good) and tag not in ("article", "main", "body"):
                number += 1
                hints += (number,)
            # A comment or a teaser may be an article of its own: what encloses it decides.
            stack.append((tag, out_bad or own, hints, inside or tag == "main" or (tag == "article" or good) and (good or not bad)))
        elif tag in LEAVES:
            flush()
            leaf, link = ("", 0) if end else (tag, 0)
            leaf_bad, bad, good = (False, False, False) if end else hinted(attributes)
            number += 1
            leaf_hints = (number,) if bad and not good else ()
    rest = page[at:]
    add(rest)
    flush()
    return out


def doubts(found: list[dict]) -> list[bool]:
    """Whether each block stands under a hint. Elements that hold most of the page's good text are no boilerplate."""
    plain = [not b["bad"] and b["linked"] <= LINKED * len(b["text"]) for b in found]
    good = [p and (b["inside"] or first_pass(b) == "good") for p, b in zip(plain, found)]
    total = 0
    held: dict[int, int] = {}
    for block, counts in zip(found, good if any(good) else plain):
        if counts:
            total += len(block["text"])
            for number in block["hints"]:
                held[number] = held.get(number, 0) + len(block["text"])
    return [any(2 * held.get(number, 0) <= total for number in b["hints"]) for b in found]


def first_pass(block: dict) -> str:
    """good, bad, open, or sparse (long without stop words), by the block's own text."""
    text, heading = block["text"], block["leaf"] in HEADINGS
    density = block["linked"] / len(text)
    if density > LINKED:
        return "open" if heading and block["inside"] else "bad"
    if len(text) < LONG_CHARS:
        return "bad" if "©" in text else "open"
    words = text.lower().split()
    stopped = sum(w.strip(MARKS) in STOP_WORDS for w in words) / len(words)
    if stopped >= STOPPED:
        return "good"
    if density > LINKED / 2:
        return "bad"
    # The article mark lowers the bound, it doesn't lift it.
    few = stopped < (SPARSE_INSIDE if block["inside"] else SPARSE)
    return "sparse" if few and not heading and block["leaf"] != "pre" else "open"


def second_pass(found: list[dict], labels: list[str], doubtful: list[bool], marked: bool) -> list[bool]:
    """Whether each block is main text: open blocks by their nearest decided neighbours.

    Inside an article only neighbours inside it speak. Where the two sides are equally near, the article mark decides.
    Doubtful blocks say nothing about others; they need long dense text, and good text on both sides.
    """
    before: list[tuple[int, str] | None] = []
    after: list[tuple[int, str] | None] = []
    own = [b["inside"] and not b["bad"] and not doubt for b, doubt in zip(found, doubtful)]
    for out, order in ((before, range(len(found))), (after, range(len(found) - 1, -1, -1))):
        last: dict[bool, tuple[int, str] | None] = {True: None, False: None}
        for i in order:
            out.append(last[own[i]])
            if labels[i] != "open" and not doubtful[i]:
                last[False] = (i, labels[i])
                if own[i]:
                    last[True] = (i, labels[i])
    after.reverse()
    kept = []
    for i, block in enumerate(found):
        label, left, right = labels[i], before[i], after[i]
        sides = [(abs(i - place), said) for place, said in filter(None, (left, right))]
        between = len(sides) == 2 and {said for _, said in sides} == {"good"}
        if doubtful[i] and not (block["leaf"] == "h1" and label == "open"):
            label = "good" if between and label == "good" and len(block["text"]) >= 2 * LONG_CHARS else "bad"
        elif label == "open":
            if block["leaf"] in HEADINGS and right:
                # A heading belongs to what follows it.
                label = right[1]
            elif doubtful[i] or marked and not own[i]:
                label = "good" if between else "bad"
            else:
                label = "good" if not sides else min(sides, key=lambda side: (side[0], side[1] != "good"))[1]
        kept.append(label == "good")
    return kept


def extract(page: str) -> str:
    """The main text of one page, blocks joined by newlines."""
    found = blocks(page)
    doubtful = doubts(found)
    marked = any(b["inside"] and not b["bad"] and not doubt for b, doubt in zip(found, doubtful))
    labels = ["bad" if b["bad"] else first_pass(b) for b in found]
    size = {label: sum(len(b["text"]) for b, own in zip(found, labels) if own == label) for label in ("good", "sparse")}
    # On a page whose language the stop words don't know, their absence says nothing.
    known = size["good"] > size["sparse"]
    # A paragraph of an article may be all names and numbers: its neighbours decide.
    labels = [("bad" if known and not (b["inside"] and b["leaf"] == "p") else "open") if label == "sparse" else label for b, label in zip(found, labels)]
    return "\n".join(b["text"] for b, main in zip(found, second_pass(found, labels, doubtful, marked)) if main)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of ``pages`` (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page or "") for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: main text of every page and its length."""
    pages = configure(spark).read.parquet(f"{sf_dir}/pages.parquet")
    return extracted(pages).withColumn("n_chars", F.length("text").cast("long"))
