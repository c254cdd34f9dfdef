"""Column helpers shared by the SQL-only operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six ASCII separators of words, for regular expressions and translate().
BLANK_CLASS = r"[ \t\n\x0B\f\r]"
BLANKS = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.filter(
        F.split(whole_text(text), BLANK_CLASS + "+"), lambda w: w != F.lit(""))


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def count_rare(text: Column, chars: str) -> Column:
    """``count_chars`` by plain searches: faster where the characters are rare."""
    rest = text
    for c in chars:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.length(text) - F.length(rest)


def word_count(text: Column) -> Column:
    """Number of words without building them: separators squeezed, then counted."""
    squeezed = F.trim(F.regexp_replace(whole_text(text), BLANK_CLASS + "+", " "))
    return F.when(squeezed == "", F.lit(0)).otherwise(
        count_chars(squeezed, " ") + 1).cast("bigint")
