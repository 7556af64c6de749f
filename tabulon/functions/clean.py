"""Cleaning expressions: null tokens, numbers, labels, ratings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Survey codes for "not known".
UNKNOWN_TOKENS = ("un", "unknown", "n/a", "na")

# Cell texts the usual CSV readers take as missing.
READER_NULLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Words that mean yes.
TRUTHY = ("yes", "y", "true", "1")

# Damage classes and the status words behind them.
UNDAMAGED, LOW, SIGNIFICANT = "Undamaged", "Low", "Significant"
DAMAGE_ORDER = (UNDAMAGED, LOW, SIGNIFICANT)
STATUS_LOW = ("minor",)
STATUS_SIGNIFICANT = ("moderate", "severe", "destroyed")

# The characters Unicode calls white space.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000")

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove every kind of white space at both ends (plain ``trim`` takes blanks only)."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def null_if_unknown(c: Column | str, tokens: Iterable[str] = UNKNOWN_TOKENS) -> Column:
    c = _col(c)
    return F.when(F.lower(strip(c)).isin(*tokens), None).otherwise(c)


def string_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


def clean_unknowns(df: DataFrame, tokens: Iterable[str] = UNKNOWN_TOKENS,
                   cols: Iterable[str] | None = None) -> DataFrame:
    tokens = tuple(tokens)
    cols = list(cols) if cols is not None else string_columns(df)
    return df.withColumns({c: null_if_unknown(c, tokens) for c in cols})


def clean_reader_nulls(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    cols = list(cols) if cols is not None else string_columns(df)
    return df.withColumns({c: F.when(F.col(c).isin(*READER_NULLS), None).otherwise(F.col(c)) for c in cols})


def to_numeric(c: Column | str, strip_grouping: bool = True) -> Column:
    """Text to double; anything that is not a finite decimal number is null."""
    text = _col(c).cast("string")
    if strip_grouping:
        text = F.regexp_replace(text, "[, ]", "")
    return F.when(text.rlike(_NUMBER), finite(text.try_cast("double")))


def finite(c: Column | str) -> Column:
    c = _col(c)
    return F.when(F.abs(c) < float("inf"), c)  # NaN sorts above infinity


def damage_label(c: Column | str) -> Column:
    """0, 1 and two or more; everything between or below has no class."""
    c = _col(c)
    return F.when(c == 0, UNDAMAGED).when(c == 1, LOW).when(c >= 2, SIGNIFICANT)


def damage_code(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c == 0, 0).when(c == 1, 1).when(c >= 2, 2)


def status_label(c: Column | str) -> Column:
    s = F.lower(strip(c))
    return (
        F.when(s == "undamaged", UNDAMAGED)
        .when(s.isin(*STATUS_LOW), LOW)
        .when(s.isin(*STATUS_SIGNIFICANT), SIGNIFICANT)
    )


def parse_ef(c: Column | str) -> Column:
    """Rating text to integer: ``subEF`` is -1, ``EF2``/``2``/``2.7`` are 2."""
    s = F.lower(strip(c))
    number = to_numeric(F.regexp_replace(s, "ef", ""), strip_grouping=False)
    return F.when(s == "subef", F.lit(-1)).otherwise(number.try_cast("int"))


def ef_display(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c == -1, "sub").otherwise(c.cast("string"))


def is_truthy(c: Column | str) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(*TRUTHY), F.lit(False))


def canonical_category(c: Column | str) -> Column:
    """Give ``30.0`` and ``30`` the same category text."""
    return F.regexp_replace(_col(c), r"^(-?\d+)\.0+$", "$1")
