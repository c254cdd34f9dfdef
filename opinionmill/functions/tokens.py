"""Token-level steps on arrays, so that one review stays one row.

Nothing here shuffles: a sentence's words, labels and spans travel inside the
review row. The long-form equivalents live in ``operators.tokens``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinionmill import schema as S
from opinionmill.functions.once import once
from opinionmill.functions import text as tx

_SEP = "\x1f"  # counts as whitespace, so it never occurs inside a word


def split_words(text: Column) -> Column:
    """Whitespace words; an empty array for blank text."""
    return _pieces(tx.even_spaces(text))


def _pieces(even: Column) -> Column:
    # only leading or trailing space leaves an empty piece behind
    return F.array_remove(F.split(even, " "), "")


def argmax(logits: Column) -> Column:
    """Zero-based index of the largest value, the first one on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def label_name(index: Column, labels=S.TAG_LABELS) -> Column:
    names = F.array(*[F.lit(x) for x in labels])
    return F.get(names, index)


def mark(words: Column, labels: Column) -> Column:
    """Words behind the first letter of their label; unlabelled ones are null."""
    return F.zip_with(words, labels, lambda w, l: F.concat(F.substring(l, 1, 1), w))


def dictionary_marks(text: Column, heads: list[str], tails: list[str]) -> Column:
    """Marked words of ``text`` from a dictionary: B for a keyword's first word,
    I for its later words; all others are a mere O, which no span holds."""
    return once(tx.even_spaces(text), lambda t: _marked(
        _pieces(t), _pieces(F.lower(t)), heads, tails))


def _marked(words: Column, keys: Column, heads: list[str], tails: list[str]) -> Column:
    return F.zip_with(words, keys, lambda w, key: (
        F.when(key.isin(*heads), F.concat(F.lit("B"), w))
        .when(key.isin(*tails), F.concat(F.lit("I"), w)).otherwise("O")))


def dictionary_spans(
    text: Column, heads: list[str], tails: list[str],
    label: Callable[[Column], Column] | None = None, even: bool = False,
) -> Column:
    """``spans`` of ``dictionary_marks``, and ``label`` of the lowered words if there are any.

    Lowered words are split once for all uses, and only texts that hold a head are marked.
    ``even`` says that single U+0020 are the only spaces of ``text``.
    """
    def told(t: Column, low: Column) -> Column:
        spans = F.when(
            F.exists(low, lambda w: w.isin(*heads)),
            marked_spans(_marked(_pieces(t), low, heads, tails)))
        if label is None:
            return F.struct(spans.alias("spans"))
        return once(spans, lambda s: F.struct(
            s.alias("spans"), F.when(F.size(s) > 0, label(low)).alias("label")))

    def of_even(t: Column) -> Column:
        return once(_pieces(F.lower(t)), lambda low: told(t, low))

    return of_even(text) if even else once(tx.even_spaces(text), of_even)


def bio_spans(words: Column, labels: Column) -> Column:
    return marked_spans(mark(words, labels))


def marked_spans(marked: Column) -> Column:
    """Aspect spans as ``array<struct<display, seg>>``.

    A span opens at B and runs over the I's that follow without a gap. The
    marked words become one line and a regular expression reads the spans off,
    which is linear in the sentence and stays in the JVM.
    """
    line = F.concat(F.lit(_SEP), F.array_join(marked, _SEP))
    runs = F.regexp_extract_all(
        line, F.lit(f"{_SEP}B([^{_SEP}]*(?:{_SEP}I[^{_SEP}]*)*)"), 1)
    segs = F.transform(runs, lambda r: F.replace(r, F.lit(_SEP + "I"), F.lit(" ")))
    spans = F.transform(
        segs,
        lambda g: F.struct(
            F.trim(F.translate(g, "_", " ")).alias("display"), g.alias("seg")),
    )
    return F.filter(spans, lambda s: F.length(s["display"]) >= 2)


def lexicon_label(text: Column, positive: list[str], negative: list[str]) -> Column:
    """"negative" when negative words outnumber positive ones, else "positive"."""
    return lexicon_label_of(split_words(F.lower(text)), positive, negative)


def lexicon_label_of(lowered: Column, positive: list[str], negative: list[str]) -> Column:
    """``lexicon_label`` of words already lower-cased."""
    return once(lexicon_hits_of(lowered, positive, negative), label_of_hits)


def lexicon_hits_of(lowered: Column, positive: list[str], negative: list[str]) -> Column:
    """How many of the lower-cased words are ``positive`` and how many ``negative``."""
    def hits(words: Column, terms: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*terms)))

    known = list(dict.fromkeys([*positive, *negative]))
    told = F.filter(lowered, lambda w: w.isin(*known))
    return once(told, lambda words: F.struct(
        hits(words, positive).alias("positive"), hits(words, negative).alias("negative")))


def label_of_hits(hits: Column) -> Column:
    return F.when(hits["negative"] > hits["positive"], "negative").otherwise("positive")
