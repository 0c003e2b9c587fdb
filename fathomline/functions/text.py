"""Column functions for text: cleaning, sentences, sizes and terms.

Every function maps Column to Column, stays in the JVM and is row-local, so
each one also works on a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns every caller must agree on. Java, Python and RE2 give
# different meanings to a bare \s, so the class spells out the characters.
DOT_RUN = r"\.{2,}"
_SPACES = r"\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Java tries the parts of a class one by one: the ranges in front settle most characters. A
# single plain space is no match, as nothing would change.
_SPACE = rf"[\x00-\x20\x7f-\uffff&&[{_SPACES}]]"
WHITESPACE_RUN = rf"[\x00-\x1f\x7f-\uffff&&[{_SPACES}]]{_SPACE}*| {_SPACE}+"
SENTENCE_END = r"([.!?]+) "
CLAUSE_END = r"([,;:]+) "
TERM = r"[\p{L}\p{N}_]{2,}"
# U+001E counts as whitespace, so cleaned text can never contain it.
MARK = "\u001e"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def collapse_dots(text: Column) -> Column:
    return F.regexp_replace(text, DOT_RUN, ".")


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, WHITESPACE_RUN, " ")


def clean(text: Column) -> Column:
    """Dots first, then whitespace: ``. .`` is therefore left alone."""
    return collapse_whitespace(collapse_dots(text))


def _cut(text: Column, after: str) -> Column:
    parts = F.split(F.regexp_replace(text, after, "$1" + MARK), MARK)
    # a bare F.trim would take the position as the characters to cut off
    return F.filter(F.transform(parts, lambda part: F.trim(part)), lambda part: part != "")


def sentences(cleaned: Column) -> Column:
    """Non-empty trimmed sentences of a cleaned text, in order."""
    return _cut(cleaned, SENTENCE_END)


def clauses(sentence: Column) -> Column:
    return _cut(sentence, CLAUSE_END)


def count_tokens(text: Column, method: str = "words") -> Column:
    """Size of a text: space-separated words, or a quarter of its characters."""
    if method == "words":
        return F.size(F.split(text, " "))
    if method == "chars":
        return F.ceil(F.length(text) / 4).cast("int")
    raise ValueError(f"unknown token counter {method!r}; use 'words' or 'chars'")


def terms(text: Column) -> Column:
    """Lower-cased index terms of at least two letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def distinct_terms(text: Column) -> Column:
    return F.array_distinct(terms(text))
