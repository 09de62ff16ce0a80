"""Main text of web pages as a maximum-scoring subsequence of their tokens.

A page is a sequence of words, tags, comments and scripts.  Words score positive and tags
negative; the best contiguous run of tokens, found by one linear scan, is the content
region.  The weights come from labelled pages: pages that mark their content themselves
with exactly one ``<article>`` or ``<main>``.  A kind of tag (its name, and whether it
carries a class, id or role that names page furniture) costs what its odds of standing
inside the marked region say; the tags that bound the region itself cost more than any text
is worth, so that no run reaches across them.  Furniture costs as little as running text:
its words score nothing, and it is left out of the region afterwards.

Inside the region, subtrees that are not content (menus, headers and footers of the page,
side bars, notices, adverts, forms, scripts, styles, reader comments) are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm import textbytes as tb

#: Labelled pages that the fit takes at most (those with the smallest hash of the id).
SAMPLE = 2_000
WORD, FLOOR, STEEP, WALL = 1.0, -0.01, 4.0, -1e9
#: Tags that bound a page or its content.
BOUNDS = frozenset(("html", "body", "article", "main"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg|select|object)\b.*?(?:</\1\s*>|\Z)"
    r"|<(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<[!/?a-zA-Z][^<>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
_NAME = re.compile(r"<(/?)\s*([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"(?:class|id|role|aria-label|itemprop|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s=>/])|display\s*:\s*none|visibility\s*:\s*hidden", re.I)

VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
#: Elements that are no content wherever they stand.
FURNITURE = frozenset("nav aside form footer button input select textarea dialog menu head".split())
#: Words of class, id and role names that mark furniture.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner popup modal cookie "
    "cookies consent gdpr notice notices alert warning nav navbar navigation menu breadcrumb breadcrumbs sidebar side "
    "aside widget footer masthead topbar toolbar comment comments disqus replies reply respond share sharing social "
    "related recommended newsletter subscribe subscription signup login search form complementary contentinfo "
    "pagination pager skip copyright legal disclaimer".split())
#: Elements of running text: their tags do not end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
CONTENT = frozenset(("article", "main"))
#: Elements whose end tag is often left out, and the tags that end them.
ENDS = {"p": frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()), "li": frozenset(["li"])}


def furniture(name: str, tag: str) -> bool:
    """Whether an element is no content by its name, class, id, role or because it is hidden."""
    if name in FURNITURE:
        return True
    if " " not in tag and "\n" not in tag and "\t" not in tag:
        return False
    if name not in ("html", "body") and _HIDDEN.search(tag):
        return True
    if name in ("html", "body", "article", "main"):
        return False
    for found in _ATTRIBUTE.finditer(tag):
        if found[0][:5].lower() in ("style", "itemp"):
            continue
        value = found[1] or found[2] or found[3] or ""
        words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
        if not MARKS.isdisjoint(words):
            return True
    return False


def tokens(page: str):
    """(kind, raw text, element) of each token: "text", "open", "close" or "skip" (comments, scripts and the like).

    The element is its name, with a "!" before it if it is page furniture.
    """
    for found in _TOKEN.finditer(page):
        raw = found[0]
        if raw[0] != "<" or len(raw) == 1 or not (raw[1].isalpha() or raw[1] in "/!?"):
            yield "text", raw, ""
        elif found[1] or raw[1] in "!?":
            yield "skip", raw, found[1].lower() if found[1] else "!"
        else:
            name = _NAME.match(raw)
            if not name:
                yield "skip", raw, "!"
            elif name[1]:
                yield "close", raw, name[2].lower()
            else:
                tag = name[2].lower()
                yield "open", raw, ("!" if furniture(tag, raw) else "") + tag


def parsed(page: str) -> list[tuple[str, str, str, bool]]:
    """Tokens with the kind of tag that has a weight, and whether they stand in furniture.

    End tags get their element's kind; an end tag without an element, and elements that are never closed, are
    passed over as browsers do.
    """
    out, stack, deep = [], [], 0
    open_names: Counter = Counter()  # an end tag of none of them needs no search
    for kind, raw, name in tokens(page):
        if kind == "open":
            plain = name.lstrip("!")
            for open_name, enders in ENDS.items():
                if stack and stack[-1].lstrip("!") == open_name and plain in enders:
                    open_names[open_name] -= 1
                    deep -= stack.pop()[0] == "!"
            if plain in VOID or raw.endswith("/>"):
                out.append(("void", raw, plain, deep > 0))
                continue
            # A page's own header stands outside its article; the header of an article is content.
            if plain == "header" and not any(open_names[c] for c in CONTENT):
                name = "!header"
            stack.append(name)
            open_names[plain] += 1
            deep += name[0] == "!"
            out.append((kind, raw, name, deep > 0))
        elif kind == "close":
            at = None
            if open_names[name]:
                at = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].lstrip("!") == name)
            if at is None or (name in INLINE and any(s.lstrip("!") not in INLINE for s in stack[at + 1 :])):
                out.append(("void", raw, name, deep > 0))
                continue
            full = stack[at]
            out.append((kind, raw, full, deep > 0))
            deep -= sum(s[0] == "!" for s in stack[at:])
            open_names.subtract(s.lstrip("!") for s in stack[at:])
            del stack[at:]
        else:
            out.append((kind, raw, name, deep > 0))
    return out


def _key(kind: str, name: str) -> str | None:
    """The entry of a tag in the weights; None for text and what stands outside all scoring."""
    if kind in ("open", "close"):
        return ("/" if kind == "close" else "") + name
    return None


def marked(page: list) -> tuple[int, int] | None:
    """First and end token of the one region that a page marks as its content, if it does."""
    for element in ("article", "main"):
        opens = [i for i, t in enumerate(page) if t[0] == "open" and t[2] == element and not t[3]]
        if len(opens) == 1:
            closes = [i for i, t in enumerate(page) if t[0] == "close" and t[2] == element and i > opens[0]]
            return opens[0] + 1, closes[0] if closes else len(page)
    return None


def tag_counts(page: str) -> list[tuple[str, int, int]]:
    """Kinds of tags of a labelled page, and how often each stands inside and outside its region."""
    found = parsed(page)
    region = marked(found)
    inside, outside = Counter(), Counter()
    if region:
        for i, (kind, _, name, hidden) in enumerate(found):
            key = _key(kind, name)
            if key and not (hidden and name[0] != "!"):
                (inside if region[0] <= i < region[1] else outside)[key] += 1
    return [(k, inside[k], outside[k]) for k in inside | outside]


def weights_from(counts) -> dict[str, float]:
    """Weight of each kind of tag: a small cost if it stands inside, growing with the odds of standing outside."""
    out = {}
    for key, a, b in counts:
        name = key.lstrip("/")
        if name in BOUNDS:
            out[key] = WALL if not a else FLOOR
        elif name[0] != "!":
            out[key] = min(FLOOR, STEEP * math.log((a + 1) / (a + b + 1)))
    return out


def weight(weights: dict[str, float], key: str) -> float:
    """Weight of a kind of tag; of those that no labelled page has, only bounds cost more than running text."""
    return weights.get(key, WALL if key.lstrip("/") in BOUNDS else FLOOR)


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """First and end index of the contiguous run with the largest sum (the first and longest of equal ones)."""
    best, at, total, begin = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0 or (total == 0 and i and best == 0):
            total, begin = 0.0, i
        total += s
        if total > best or (total == best and begin == at[0] and best > 0):
            best, at = total, (begin, i + 1)
    return at


def extract(page: str, weights: dict[str, float]) -> str:
    """Main text of a page: blocks of the best region, joined by one space."""
    found = parsed(page)
    scores = np.zeros(len(found))
    for i, (kind, raw, name, hidden) in enumerate(found):
        key = _key(kind, name)
        if kind == "text":
            scores[i] = 0.0 if hidden else WORD * len(raw.split())
        elif key and not (hidden and name[0] != "!"):
            scores[i] = weight(weights, key)
    begin, end = best_region(scores)
    pieces = []
    for kind, raw, name, hidden in found[begin:end]:
        if kind == "text":
            if not hidden:
                pieces.append(html.unescape(raw) if "&" in raw else raw)
        elif kind in ("open", "close", "void") and name.lstrip("!") not in INLINE:
            pieces.append(" ")
    return " ".join("".join(pieces).split())


def _tags(batches):
    for batch in batches:
        total: dict[str, list[int]] = {}
        for page in batch.column(0).to_pylist():
            for key, a, b in tag_counts(page or ""):
                had = total.setdefault(key, [0, 0])
                had[0] += a
                had[1] += b
        yield pa.RecordBatch.from_arrays([
            pa.array(list(total), pa.string()), pa.array([v[0] for v in total.values()], pa.int64()),
            pa.array([v[1] for v in total.values()], pa.int64())], names=["tag", "inside", "outside"])


def train(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights of the kinds of tags from at most ``sample`` pages that mark their content; {} if none does."""
    labelled = pages.where(F.lower("html").rlike("<(article|main)[\\s>]")).select("page_id", "html")
    ids = labelled.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    chosen = labelled.join(F.broadcast(ids.distinct()), "page_id", "left_semi").select("html")
    counts = chosen.mapInArrow(_tags, "tag string, inside long, outside long")
    counts = counts.groupBy("tag").agg(F.sum("inside"), F.sum("outside")).where(F.length("tag") < 64)
    return weights_from([tuple(r) for r in counts.orderBy(F.desc("sum(inside)"), "tag").limit(4096).collect()])


def _extracted(weights: dict[str, float]):
    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("html"))
            for low, high, _, _ in tb.slices(column):
                part = batch.slice(low, high - low)
                texts = [extract(p or "", weights) for p in column.slice(low, high - low).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())],
                                                 names=[*part.schema.names, "text"])

    return run


def main_text(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``pages`` with ``text``, the main text of ``html``; a column called ``text`` is replaced, the others stay.

    A NULL or empty page, one without words and one of markup only have an empty text.  Every row stands for itself
    (repeated rows have equal texts); of equally good regions the first is taken; an empty table gives an empty one.
    Pages of any length are read whole.
    """
    pages = pages.drop("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields) + ", text string"
    return pages.mapInArrow(_extracted(weights), schema)
