"""Text rules as column expressions; a text is always matched as a whole."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast import rules
from holdfast.functions.choice import first_match

NOT_WORD = r"[^\p{L}\p{N}]+"


def whole_word(word: str) -> str:
    """Pattern for a word that no letter or digit of any alphabet touches.

    The word comes first, so that a text is scanned for it and only hits look around.
    """
    return rf"{word}(?![\p{{L}}\p{{N}}])(?<![\p{{L}}\p{{N}}]{word})"


def note_sentiment(text: Column, patterns: Mapping[str, str] = rules.SENTIMENT_PATTERNS,
                   default: str = rules.DEFAULT_SENTIMENT) -> Column:
    """First class whose pattern occurs anywhere in the text, ignoring case."""
    return first_match([(text.rlike(f"(?i)({p})"), F.lit(name)) for name, p in patterns.items()], F.lit(default))


def topic_label(text: Column, patterns: Mapping[str, Sequence[str]] = rules.TOPIC_PATTERNS) -> Column:
    """Label with the most matching patterns; the earlier label wins a tie, no match gives NULL."""
    scored = []
    for position, (label, wanted) in enumerate(patterns.items()):
        hits = sum((text.rlike(f"(?i){p}").cast("int") for p in wanted), F.lit(0))
        scored.append(F.struct(hits.alias("hits"), F.lit(-position).alias("order"), F.lit(label).alias("label")))
    best = F.array_max(F.array(*scored))
    return F.when(best["hits"] > 0, best["label"])


def spaced_words(text: Column) -> Column:
    """The words of a text in lower case, each with a blank of its own on either side."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), NOT_WORD, "  ")), F.lit(" "))


def word_count(spaced: Column) -> Column:
    """Number of words in ``spaced_words``."""
    blanks = F.char_length(spaced) - F.char_length(F.replace(spaced, F.lit(" "), F.lit("")))
    return F.when(F.trim(spaced) == "", 0).otherwise((blanks / 2).cast("long"))


def term_count(spaced: Column, term: str) -> Column:
    """Occurrences in ``spaced_words`` of a word, or of several words in a row, whatever stands between them.

    The term is taken apart like a text: case and characters that are no part of a word do not count.
    """
    words = [w for w in re.split(r"[\W_]+", term.lower()) if w]
    if not words:
        raise ValueError(f"no word in the search term {term!r}")
    sought = " " + "  ".join(words) + " "
    without = F.replace(spaced, F.lit(sought), F.lit(""))
    return ((F.char_length(spaced) - F.char_length(without)) / len(sought)).cast("long")


def sections(text: Column) -> Column:
    """Sections of a document: split before headings and at blank lines, outer white space removed."""
    marked = F.regexp_replace(text, r"\n(#{1,6} )", "\n\n$1")
    parts = F.split(marked, r"\n[ \t]*\n\s*")
    trimmed = F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda p: p != "")


def pieces(section: Column, max_chars: int) -> Column:
    """A section cut in pieces of at most ``max_chars`` characters; nothing is left out."""
    starts = F.sequence(F.lit(1), F.char_length(section), F.lit(max_chars))
    return F.transform(starts, lambda s: F.substr(section, s, F.lit(max_chars)))
