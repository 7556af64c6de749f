"""Text expressions: sentences, pair labels, display texts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations whose full stop does not end a sentence.
ABBREVIATIONS = (
    "vs.", "e.g.", "i.e.", "Fig.", "Eq.", "Tab.", "Sec.", "No.", "al.", "approx.", "p.", "U.S.", "D.C.",
    "St.", "Dr.", "Mr.", "Ms.", "Prof.", "Inc.", "Ltd.", "Co.", "Corp.", "Ref.", "Eqs.", "Figs.", "Refs.",
    "Jan.", "Feb.", "Mar.", "Apr.", "Jun.", "Jul.", "Aug.", "Sep.", "Oct.", "Nov.", "Dec.",
    "Dept.", "Univ.", "Bldg.", "Ave.", "Blvd.", "Rd.",
)

WHITESPACE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_sentences(text, abbreviations: Sequence[str] = ABBREVIATIONS, whole_words: bool = True) -> Column:
    """Array of sentences, cut after ``.``, ``?`` or ``!`` followed by space.

    One regular expression does it: the cut may not follow an abbreviation.
    With ``whole_words=False`` an abbreviation also protects words that merely
    end like it (``al.`` protects ``final.``).
    """
    edge = r"\b" if whole_words else ""
    guard = "".join(f"(?<!{edge}{re.escape(a)})" for a in abbreviations)
    pieces = F.split(_c(text), f"(?<=[.?!]){guard}{WHITESPACE}+")
    return F.filter(pieces, lambda s: s != "")


def pair_label(a, b) -> Column:
    return F.concat_ws(" x ", F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b)))


def split_pair(pair) -> tuple[Column, Column]:
    parts = F.split(_c(pair), " x ")
    return parts[0], parts[1]


def format_p(p) -> Column:
    p = _c(p)
    # Sixteenths are the only exact ties at three digits; they go to even.
    p = F.when(p * 16 == F.floor(p * 16), F.bround(p, 3)).otherwise(p)
    return F.when(p < 0.001, "p < 0.001").when(p.isNotNull(), F.format_string("p = %.3f", p))


def count_label(name, n) -> Column:
    return F.format_string("%s\n(n=%d)", _c(name), _c(n))


def parent_of(column_name, parents: Mapping[str, str]) -> Column:
    """Feature behind a one-hot column, from the encoder's own column table."""
    name = _c(column_name)
    if not parents:
        return name
    lookup = F.create_map(*[F.lit(x) for kv in parents.items() for x in kv])
    return F.coalesce(lookup[name], name)
