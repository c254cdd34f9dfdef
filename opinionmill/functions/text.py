"""Row-level text cleaning and parsing, built from JVM-side expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from opinionmill import schema as S
from opinionmill.functions.once import once

# Character classes spelled out, because ``\s``, ``\w`` and ``\d``
# mean different sets to different regex engines.
WS = (
    r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORD = r"\p{L}\p{N}_"
URL_PATTERN = rf"https?://[^{WS}]+|www\.[^{WS}]+"
TAG_PATTERN = r"<[^>]+>"
SPACES_PATTERN = rf"[{WS}]+"
EDGE_SPACES_PATTERN = rf"^[{WS}]+|[{WS}]+$"
AGE_PATTERN = rf"(\p{{Nd}}+)[{WS}]+({'|'.join(S.DAYS_PER_UNIT)})"
SPEC_TAIL_PATTERN = (
    rf"^({'|'.join(S.SPEC_HEADS)})[{WS}]+\p{{Nd}}[{WORD}{WS}]*$"
)
# A run of spaces other than a single U+0020.
UNEVEN_SPACES_PATTERN = rf"[{WS}](?:[{WS}]+|(?<! ))"
# Code points outside this set may change under NFC or combine with a neighbour.
NFC_STABLE = (
    r"\x{0}-\x{2ff}\x{1e00}-\x{1eff}\x{2010}-\x{2027}\x{2030}-\x{205e}"
    r"\x{20a0}-\x{20bf}\x{1f300}-\x{1faff}"
)
# end of fixed values
# Any space but U+0020, of ASCII and beyond; the first range tells most letters at once.
_CONTROL_PATTERN = r"[\x00-\x1f]"  # one range is told faster than two
_ASCII_ODD_PATTERN = r"[\t-\r\x1c-\x1f]"
_WIDE_ODD_PATTERN = rf"[\x{{80}}-\x{{3000}}&&[{WS}]]"
_ASCII_UNEVEN_PATTERN = r"[\t-\r\x1c-\x20](?:[\t-\r\x1c-\x20]+|(?<! ))"


def is_missing(text: Column) -> Column:
    """Null, empty, or the word "nan" in any case."""
    # no longer text is lower-cased only to be compared
    short = F.when(F.octet_length(text) <= 3, F.lower(text)).otherwise("-")
    return text.isNull() | short.isin("", "nan")


def blank_missing(text: Column) -> Column:
    return F.when(is_missing(text), F.lit("")).otherwise(text)


def _nfc_udf():
    # Defined inside so that workers receive the function by value.
    def compose(values: pa.Array) -> pa.Array:
        import unicodedata

        import pyarrow

        return pyarrow.array(
            [None if v is None else unicodedata.normalize("NFC", v)
             for v in values.to_pylist()],
            pyarrow.string(),
        )

    return arrow_udf(compose, "string")


def normalize_nfc(text: Column) -> Column:
    """Compose to Unicode NFC.

    Only rows holding a code point that NFC could touch are sent to Python;
    the others pass as nulls through the Arrow stage and keep their text.
    """
    ascii_only = F.octet_length(text) == F.length(text)  # counted faster than matched
    touched = F.when(~ascii_only & text.rlike(f"[^{NFC_STABLE}]"), text)
    return F.coalesce(_nfc_udf()(touched), text)


def _replaced_where(text: Column, marks: tuple[str, ...], pattern: str) -> Column:
    """Spaces for ``pattern``; texts without any of ``marks`` hold no match, and plain
    search is much faster than the pattern."""
    def replaced(t: Column) -> Column:
        marked = reduce(Column.__or__, [F.contains(t, F.lit(m)) for m in marks])
        return F.when(marked, F.regexp_replace(t, pattern, " ")).otherwise(t)

    return once(text, replaced)


def strip_urls(text: Column) -> Column:
    return _replaced_where(text, ("http://", "https://", "www."), URL_PATTERN)


def strip_html(text: Column) -> Column:
    return _replaced_where(text, ("<",), TAG_PATTERN)


def even_spaces(text: Column) -> Column:
    """One U+0020 for every run of spaces; most of them are one already.

    Line feeds, the most frequent of the others, need no pattern. Small classes tell texts
    that are even then, and the pattern for ASCII texts tries two ranges a character
    instead of all.
    """
    def evened(t: Column) -> Column:
        ascii_only = F.octet_length(t) == F.length(t)
        uneven = F.contains(t, F.lit("  ")) | (
            t.rlike(_CONTROL_PATTERN) & t.rlike(_ASCII_ODD_PATTERN)) | (
            ~ascii_only & t.rlike(_WIDE_ODD_PATTERN))
        return F.when(uneven, F.when(ascii_only, F.regexp_replace(t, _ASCII_UNEVEN_PATTERN, " ")).otherwise(
            F.regexp_replace(t, UNEVEN_SPACES_PATTERN, " "))).otherwise(t)

    return once(F.replace(text, F.lit("\n"), F.lit(" ")), evened)


def collapse_ws(text: Column) -> Column:
    # after the first step every run is one U+0020, so trim() completes the strip
    return F.trim(even_spaces(text))


def strip_edges(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACES_PATTERN, "")


def preprocess_text(text: Column) -> Column:
    """NFC, URLs out, tags out, spaces collapsed; missing text gives ''."""
    cleaned = collapse_ws(strip_html(strip_urls(normalize_nfc(text))))
    return F.coalesce(cleaned, F.lit(""))


# decimal digits of all scripts and their ASCII form
_DIGITS = "".join(c for c in map(chr, range(128, 0x10000)) if unicodedata.category(c) == "Nd")
_DIGIT_VALUES = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def parse_days_ago(text: Column) -> Column:
    """Days from prose such as "2 tuần trước"; -1 when there is no such phrase."""
    # ignoring case in the pattern is cheaper than lowering every text
    pattern = f"(?iu){AGE_PATTERN}"
    digits = F.regexp_extract(text, pattern, 1)
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    per_unit = F.create_map(*[F.lit(x) for kv in S.DAYS_PER_UNIT.items() for x in kv])
    # more digits than a LONG holds only ever mean "long ago"
    long_ago = F.lit(10**15)
    # (the leading 0 spares texts without a match a failing cast)
    plain = F.translate(digits, _DIGITS, _DIGIT_VALUES)
    number = F.concat(F.lit("0"), plain).try_cast("bigint")
    count = F.least(F.coalesce(number, long_ago), long_ago)
    return F.coalesce(
        count * F.try_element_at(per_unit, unit), F.lit(-1).cast("bigint"))


def polarity_code(label: Column) -> Column:
    """Scorer label or display value to ``pos`` / ``neg``; anything else ``neu``."""
    return (
        F.when(label.isin("positive", S.DISPLAY_POS, S.POS), S.POS)
        .when(label.isin("negative", S.DISPLAY_NEG, S.NEG), S.NEG)
        .otherwise(S.NEU)
    )


def display_polarity(code: Column) -> Column:
    """Two-valued display form: everything but positive shows as negative."""
    return F.when(code == S.POS, S.DISPLAY_POS).otherwise(S.DISPLAY_NEG)


def star_band(score: Column) -> Column:
    return F.when(score >= 4.5, 5).when(score >= 3.5, 4).otherwise(3)


def nps_band(nps: Column) -> Column:
    return F.when(nps >= 0, "good").otherwise("needs improvement")


def canonical_aspect(raw: Column) -> Column:
    """Strip, lower, ``_`` to space, collapse; null below two characters."""
    lowered = F.translate(F.lower(strip_edges(raw)), "_", " ")
    s = F.regexp_replace(lowered, SPACES_PATTERN, " ")
    return F.when(F.length(s) >= 2, s)


def strip_spec_tail(s: Column) -> Column:
    """"pin 5800" to "pin" for the known component heads."""
    head = F.regexp_extract(s, SPEC_TAIL_PATTERN, 1)
    return F.coalesce(F.nullif(head, F.lit("")), s)
