"""Names and keys: everything stays in the JVM but the Unicode fold of names that aren't ASCII."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graincast.functions.terms import SPELT_OUT, count_terms

#: Legal-form words of company names. Fixed values.
LEGAL_KOREAN = ("유한책임회사", "주식회사", "유한회사", "합자회사", "합명회사")
LEGAL_LATIN = ("corporation", "incorporated", "limited", "company", "corp", "inc", "ltd", "llc", "plc", "gmbh", "pte", "co")
#: Bracketed legal marks, blanks allowed within. Fixed values.
LEGAL_MARKS = ("주", "유", "株", "有")
#: Characters that a Latin legal word doesn't touch, and those that role names are compared without. Fixed values.
WORD_LETTERS, ROLE_MARKS = "0-9a-z가-힣", r"\s\-_/.,()·|"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x) if x is not None else None)


def fold(c: Column) -> Column:
    """NFKC. ASCII text is its own fold: only other names are sent to Python, as nulls take their place."""
    return F.coalesce(_nfkc(F.when(~c.rlike(r"^\p{ASCII}*$"), c)), c)


def squeeze(c: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")


def trim(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_company(raw: Column, unicode: bool = True) -> Column:
    """Key of a company name: folded, lower, without legal forms; the squeezed name itself if nothing else is left."""
    name = F.lower(trim(fold(raw) if unicode else raw))
    name = F.regexp_replace(name, r"(?U)\(\s*(?:" + "|".join(LEGAL_MARKS) + r")\s*\)", " ")
    bare = F.regexp_replace(name, "|".join(LEGAL_KOREAN), " ")
    bare = F.regexp_replace(bare, f"(?<![{WORD_LETTERS}])(?:{'|'.join(LEGAL_LATIN)})(?![{WORD_LETTERS}])", " ")
    key = squeeze(bare)
    return F.coalesce(F.when(key != "", key).otherwise(squeeze(name)), F.lit(""))


def role_text(c: Column, unicode: bool = True) -> Column:
    """Role names for comparison: folded, lower, without blanks, hyphens and the like, so "Back-end" is "backend"."""
    c = F.coalesce(c, F.lit(""))
    return F.regexp_replace(F.lower(fold(c) if unicode else c), f"(?U)[{ROLE_MARKS}]+", "")


def plain_company(c: Column) -> Column:
    return F.lower(squeeze(F.coalesce(c, F.lit(""))))


def loose_title(c: Column) -> Column:
    """Title key without what stands in parentheses."""
    return F.lower(squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), r"\([^)]*\)", "")))


def exact_title(c: Column) -> Column:
    return F.lower(squeeze(F.coalesce(c, F.lit(""))))


def iso_date(c: Column) -> Column:
    """Date of a string's first ten characters, null unless they are YYYY-MM-DD."""
    head = F.substring(c, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head))


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether any term is a part of ``text``; false for no terms and null text."""
    if len(terms) > SPELT_OUT:
        return count_terms(text, list(dict.fromkeys(terms))) > 0
    found = F.lit(False)
    for t in terms:
        found = found | text.contains(t)
    return F.coalesce(found, F.lit(False))
