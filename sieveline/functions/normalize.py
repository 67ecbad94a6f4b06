"""The four text normal forms, which are not interchangeable, as column expressions.

alnum: NFKC, lower case, letters and numbers only. nospace: NFKC, no white space, case folded. collapse: runs of white
space become one blank, edges trimmed. strip: edges trimmed, body untouched. Null gives null except for collapse,
whose null is ''.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the reference's language: Java's Unicode class and four control characters.
SPACE = r"(?U)[\s\x1c-\x1f]"


def _nfkc(text: str | None) -> str | None:
    return text if text is None or text.isascii() or unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(_nfkc, na_action="ignore")


@F.pandas_udf(T.StringType())
def _nospace(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: "".join(_nfkc(t).split()).casefold(), na_action="ignore")


def alnum(c: Column) -> Column:
    return F.replace(F.regexp_replace(F.lower(nfkc(c)), r"[^\p{L}\p{N}]", ""), F.lit("ς"), F.lit("σ"))


def nospace(c: Column) -> Column:
    return _nospace(c)


def collapse(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE + "+", " "), "^ | $", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    """True for null, empty and white space."""
    return c.isNull() | ~c.rlike(r"(?U)[^\s\x1c-\x1f]")
