"""Mapping raw aspect terms to categories: dictionary match, then fuzzy match."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from opinionmill import schema as S
from opinionmill.functions import text as tx
from opinionmill.functions.once import computed, once
from opinionmill.operators.grams import alike, containing, marked_words, pieces
from opinionmill.plans.scale import (
    BROADCAST_ROWS,
    bounded_rows,
    lookup_join,
    rank_rows,
    settle,
    spread,
    within,
)

#: Keywords up to which each term is compared with all of its length band.
BAND_ROWS = 256


def taxonomy_from_map(
    spark: SparkSession, categories: Mapping[str, tuple[str, ...]]
) -> DataFrame:
    """Dictionary rows ``(category, keyword, kw_ord)`` from a category map."""
    rows = [
        (cat, kw, i)
        for i, (cat, kw) in enumerate(
            (cat, kw) for cat, kws in categories.items() for kw in kws)
    ]
    return spark.createDataFrame(rows, S.TAXONOMY)


def blacklist_from_terms(spark: SparkSession, terms=S.GENERIC_TERMS) -> DataFrame:
    return spark.createDataFrame([(t,) for t in terms], "term string")


def taxonomy_index(taxonomy: DataFrame) -> DataFrame:
    """Keywords lower-cased and numbered: longest first, then category, then
    dictionary order. ``rank`` 0 wins every tie."""
    rows = taxonomy.select(
        "category", F.lower("keyword").alias("keyword"), "kw_ord",
        F.length(F.lower("keyword")).alias("kw_len"))
    order = [F.desc("kw_len"), F.asc("category"), F.asc("kw_ord")]
    return rank_rows(rows, order, "rank")


# ----------------------------------------------------------------- exact matching


def with_clean_aspect(df: DataFrame, raw: str = "aspect_raw") -> DataFrame:
    """Add ``s``: canonical form with a numeric spec tail cut off."""
    clean = once(tx.canonical_aspect(F.col(raw)), tx.strip_spec_tail)
    return computed(df, "s", clean)


def drop_generic(df: DataFrame, blacklist: DataFrame, col: str = "s") -> DataFrame:
    terms = blacklist.select(F.col("term").alias(col)).distinct()
    if within(terms, BROADCAST_ROWS):
        terms = F.broadcast(terms)
    return df.join(terms, col, "left_anti")


def _first_keyword(rows: list, s: Column) -> Column:
    """Best keyword whose ``piece`` is contained in ``s``; ``rows`` are in index order.

    A term that is itself a keyword contains no longer one, so it is looked up
    directly; only other terms are searched for every keyword in turn.
    """
    def entry(r) -> Column:
        return F.struct(*[F.lit(r[c]).alias(c) for c in ("piece", "keyword", "category")])

    first = {r["piece"]: r for r in reversed(rows)}
    direct = F.create_map(*[x for k, r in first.items() for x in (F.lit(k), entry(r))])
    ranked = F.array(*[entry(r) for r in rows])
    return once(s, lambda hay: F.coalesce(
        F.try_element_at(direct, hay),
        F.get(F.filter(ranked, lambda k: F.contains(hay, k["piece"])), F.lit(0))))


def keyword_match(
    df: DataFrame, taxonomy: DataFrame, word_boundary: bool = False
) -> DataFrame:
    """Add ``keyword`` and ``category`` of the best keyword contained in ``s``.

    The match is on substrings ("ai" is found in "hai") unless ``word_boundary`` is
    set: then the keyword's words must be whole words of ``s`` with the same between
    them ("wi-fi" is found in "wi-fi 6", not in "wi fi"). Dictionaries of up to
    ``INLINE_ROWS`` keywords become part of the expression: no join, no shuffle. Larger
    ones go through ``keyword_match_by_anchor``.
    """
    index = taxonomy_index(taxonomy)
    piece = marked_words if word_boundary else (lambda x: x)
    rows = bounded_rows(index.withColumn("piece", piece(F.col("keyword"))))
    if rows is not None:
        rows = sorted(rows, key=lambda r: r["rank"])
        if not rows:
            null = F.lit(None).cast("string")
            return df.withColumn("keyword", null).withColumn("category", null)
        return (
            computed(df, "_hit", _first_keyword(rows, piece(F.col("s"))))
            .withColumn("keyword", F.col("_hit.keyword"))
            .withColumn("category", F.col("_hit.category"))
            .drop("_hit")
        )
    found = settle(keyword_match_by_anchor(df.select("s"), index, word_boundary))
    return lookup_join(df, found, "s")


def keyword_match_by_anchor(
    terms: DataFrame, index: DataFrame, word_boundary: bool = False
) -> DataFrame:
    """``(s, keyword, category)`` for each distinct term holding a keyword.

    Keywords are filed under their rarest gram, see ``grams.containing``: a term brings
    its grams of a few lengths, however many lengths the keywords have.
    """
    piece = marked_words if word_boundary else (lambda x: x)
    # one row per keyword: the copy that wins in index order
    keys = index.groupBy(piece(F.col("keyword")).alias("piece")).agg(
        F.min_by(F.struct("keyword", "category", "rank"), "rank").alias("k"))
    hays = _distinct_terms(terms).select("s", piece(F.col("s")).alias("hay"))
    return (
        containing(settle(hays), settle(keys))
        .groupBy("s").agg(F.min_by("k", "k.rank").alias("k"))
        .select("s", "k.keyword", "k.category")
    )


# ----------------------------------------------------------------- fuzzy matching


def length_band_candidates(
    terms: DataFrame, taxonomy: DataFrame, band: int = S.LENGTH_BAND
) -> DataFrame:
    """Pairs whose lengths differ by at most ``band``, as an equi-join.

    Each distinct term lists the lengths it accepts; a dictionary of checked
    size is broadcast. Beyond it both sides are also keyed by a slice of the
    dictionary, because lengths alone are far too few keys to spread the work.
    """
    index = taxonomy_index(taxonomy)
    keys = index.select("category", "keyword", "kw_len", "rank")
    n = F.length("s")
    lens = (
        _distinct_terms(terms).withColumn("kw_len", F.explode(F.sequence(n - band, n + band)))
    )
    if within(keys, BROADCAST_ROWS):
        return lens.join(F.broadcast(keys), "kw_len")
    slices = 1024
    keys = keys.withColumn("_slice", F.pmod(F.col("rank"), F.lit(slices)).cast("int"))
    lens = lens.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return lens.join(keys, ["kw_len", "_slice"]).drop("_slice")


def _ratio_udf(cutoff: float):
    # Defined inside so that workers receive the function by value.
    def ratios(left: pa.Array, right: pa.Array) -> pa.Array:
        from difflib import SequenceMatcher

        import pyarrow

        matchers: dict = {}
        out = []
        for a, b in zip(left.to_pylist(), right.to_pylist()):
            if a is None or b is None:
                out.append(None)
                continue
            m = matchers.get(b)
            if m is None:  # the matcher indexes its second argument once
                m = matchers[b] = SequenceMatcher(None, "", b)
            m.set_seq1(a)
            # quick_ratio is an upper bound, so nothing above the cutoff is lost
            out.append(m.ratio() if cutoff <= 0 or m.quick_ratio() >= cutoff else 0.0)
        return pyarrow.array(out, pyarrow.float64())

    return arrow_udf(ratios, "double")


def similarity(s: Column, keyword: Column, cutoff: float = 0.0) -> Column:
    """Ratcliff/Obershelp ratio; the argument order matters.

    With a ``cutoff`` pairs that cannot reach it come back as 0.
    """
    return _ratio_udf(cutoff)(s, keyword)


def _bigrams(s: Column) -> Column:
    return pieces(s, 2)


def _distinct_terms(terms: DataFrame) -> DataFrame:
    return spread(terms.select("s").where("s is not null").distinct(), "s")


def _fuzzy_pairs(
    terms: DataFrame, taxonomy: DataFrame, cutoff: float, band: int
) -> DataFrame:
    """Candidate pairs that can still reach ``cutoff``.

    The ratio is 2M / (|s| + |keyword|) with M <= the shorter length. Matched
    blocks are separated by unmatched characters, so above 0.8 at least one
    block has two characters: both filters drop only pairs below the cutoff.
    """
    if cutoff > 0 and not within(taxonomy, BAND_ROWS):
        index = settle(taxonomy_index(taxonomy))
        keys = index.groupBy("keyword").agg(
            F.min_by(F.struct("category", "rank"), "rank").alias("k"))
        pairs = alike(_distinct_terms(terms), keys.select("keyword"), cutoff, band)
        return pairs.join(keys, "keyword").select("s", "keyword", "k.category", "k.rank")
    total = F.length("s") + F.length("keyword")
    reach = 2 * F.least(F.length("s"), F.length("keyword")) >= total * cutoff
    pairs = length_band_candidates(terms, taxonomy, band).where(reach)
    if cutoff > 0.8:
        pairs = pairs.where(
            F.arrays_overlap(_bigrams(F.col("s")), _bigrams(F.col("keyword"))))
    return pairs


def fuzzy_match(
    terms: DataFrame,
    taxonomy: DataFrame,
    cutoff: float = S.FUZZY_CUTOFF,
    band: int = S.LENGTH_BAND,
) -> DataFrame:
    """``(s, keyword, category, ratio)`` for terms close enough to a keyword.

    Only the single best keyword counts (ties: first in index order). A term
    that is a part of that keyword is rejected as too generic.
    """
    scored = _fuzzy_pairs(terms, taxonomy, cutoff, band).withColumn(
        "ratio", similarity(F.col("s"), F.col("keyword"), cutoff))
    best = F.max_by(
        F.struct("keyword", "category", "ratio"),
        F.struct("ratio", (-F.col("rank")).alias("early")))
    return (
        scored.where(F.col("ratio") >= cutoff)
        .groupBy("s").agg(best.alias("b"))
        .select("s", "b.keyword", "b.category", "b.ratio")
        .where(~F.contains("keyword", F.col("s")))
    )


# ------------------------------------------------------------------- full cascade


def normalize_aspects(
    df: DataFrame,
    taxonomy: DataFrame,
    blacklist: DataFrame,
    raw: str = "aspect_raw",
    fuzzy: bool = True,
    cutoff: float = S.FUZZY_CUTOFF,
    word_boundary: bool = False,
    matcher: Callable[..., DataFrame] = fuzzy_match,
    unmatched: bool = False,
) -> DataFrame:
    """Add ``category``; rows that fit none are dropped. With ``unmatched`` the terms that
    match no keyword stay, without a category; generic and too short ones go all the same.

    Exact matching is row-local. Only terms it misses go on, once per distinct
    spelling, to fuzzy matching; the accepted spellings come back as a lookup.
    ``matcher`` may bring them from elsewhere, see ``TermMemo.categories``.
    """
    clean = drop_generic(
        with_clean_aspect(df, raw).where("s is not null"), blacklist)
    exact = keyword_match(clean, taxonomy, word_boundary).drop("keyword")
    if not fuzzy:
        return (exact if unmatched else exact.where("category is not null")).drop("s")
    misses = exact.where("category is null").select("s")
    near = settle(
        matcher(misses, taxonomy, cutoff)
        .select("s", F.col("category").alias("_near")))
    if within(near, BROADCAST_ROWS):
        joined = exact.join(F.broadcast(near), "s", "left")
    else:
        joined = lookup_join(exact, near, "s", spread=F.xxhash64(*exact.columns))
    found = joined.withColumn("category", F.coalesce("category", "_near"))
    return (found if unmatched else found.where("category is not null")).drop("s", "_near")


def validate_categories(
    df: DataFrame, taxonomy: DataFrame, by: list[str] | None = None
) -> DataFrame:
    """``valid`` per group (or one row): some category, and none unknown."""
    known = taxonomy.select(
        "category", F.lit(True).alias("_known")).distinct()
    # null and the text "nan" are gaps, not categories
    counted = (
        df.groupBy(*(by or []), "category").agg(F.count(F.lit(1)).alias("n"))
        .withColumn(
            "category",
            F.when(F.lower("category") != "nan", F.col("category")))
    )
    checked = lookup_join(counted, known, "category")
    present = F.col("category").isNotNull()
    good = F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0))
    bad = F.count_if(present & F.col("_known").isNull())
    return checked.groupBy(*(by or [])).agg(((good > 0) & (bad == 0)).alias("valid"))
