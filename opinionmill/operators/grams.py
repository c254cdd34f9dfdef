"""Joins of many terms with many keywords through pieces of their spelling.

``containing``: keywords contained in terms. A keyword can only be in a term that has
each of its grams, so it is filed under the one that fewest terms have, its anchor; terms
look up their grams and what they meet is checked.

``alike``: pairs that may reach a similarity ratio. A keyword is cut into one segment more
than there can be breaks between it and a string that is alike, so one segment is left
whole and stands at nearly the same place there.

Neither ever pairs terms and keywords that have no such piece in common, nothing is
broadcast without a check, and pieces with many keywords are salted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionmill.functions import text as tx
from opinionmill.plans.scale import lookup_join, settle

#: Letters of an anchor; shorter keywords are filed whole.
GRAM = 6
#: Keywords under one segment that a term's row may meet.
HEAVY = 10_000


def pieces(text: Column, size: int) -> Column:
    """All substrings of ``size`` letters, in order."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(
        F.length(text) >= size,
        F.transform(starts, lambda i: F.substring(text, i, F.lit(size))),
    ).otherwise(F.array().cast("array<string>"))


def marked_words(text: Column) -> Column:
    """``text`` with a mark on both sides of every word.

    A marked keyword is contained in a marked text only where each of its words is a
    whole word there and what stands between and around them is the same.
    """
    return F.regexp_replace(text, f"([{tx.WORD}]+)", "\u0001$1\u0001")


# ------------------------------------------------------------------- containment


def anchors(keys: DataFrame, seen: DataFrame, gram: int = GRAM) -> DataFrame:
    """``keys`` (one row per ``piece``) with the ``gram`` each is filed under.

    ``seen`` has the grams of the terms, one row per term and gram. Keywords with a gram
    that no term has cannot be contained and are left out.
    """
    size = F.length("piece")
    short = keys.where(size <= gram).withColumn("gram", F.col("piece"))
    counts = seen.where(F.length("gram") == gram).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    long = keys.where(size > gram).select("piece", F.explode(F.array_distinct(
        pieces(F.col("piece"), gram))).alias("gram"))
    chosen = long.join(counts, "gram", "left").groupBy("piece").agg(
        F.min_by("gram", F.struct("n", "gram")).alias("gram"),
        F.bool_or(F.col("n").isNull()).alias("impossible"))
    return short.unionByName(
        keys.join(chosen.where(~F.col("impossible")).drop("impossible"), "piece"))


def containing(terms: DataFrame, keys: DataFrame, gram: int = GRAM) -> DataFrame:
    """All pairs of ``terms`` (``s``, ``hay``) and ``keys`` (``piece``, …) with the piece
    contained in ``hay``; terms are distinct, keys have one row per ``piece``."""
    sizes = [r[0] for r in keys.select(
        F.least(F.length("piece"), F.lit(gram))).distinct().collect()]  # at most gram + 1
    if not sizes:
        return terms.join(keys, F.lit(False))
    found = F.array_distinct(F.flatten(F.array(*[pieces(F.col("hay"), n) for n in sorted(sizes)])))
    seen = terms.select("s", "hay", F.explode(found).alias("gram"))
    return candidates(seen, anchors(keys, seen, gram)).where(F.contains("hay", F.col("piece")))


def candidates(seen: DataFrame, filed: DataFrame) -> DataFrame:
    """What the terms meet under their grams; each pair meets once, under the anchor."""
    return seen.join(filed, "gram").drop("gram")


# -------------------------------------------------------------------- similarity


def least_matched(total: int, cutoff: float) -> int:
    """The least M with a ratio 2M / total of ``cutoff`` or more, as it is computed later."""
    matched = max(math.ceil(total * cutoff / 2) - 1, 0)
    while 2.0 * matched / total < cutoff:
        matched += 1
    return matched


def _steps(lengths: list[int], cutoff: float, band: int) -> list[tuple[int, int, int]]:
    """(term length, keyword length, letters matched at least) that can reach the cutoff."""
    return [(a, b, m) for b in lengths for a in range(max(b - band, 1), b + band + 1)
            if (m := least_matched(a + b, cutoff)) <= min(a, b)]


def alike(terms: DataFrame, keywords: DataFrame, cutoff: float, band: int) -> DataFrame:
    """``(s, keyword)``, distinct: every pair of a ratio of ``cutoff`` or more whose
    lengths differ by at most ``band``, and few others.

    ``terms`` has ``s`` and ``keywords`` has ``keyword``, both distinct. The ratio is
    2M / (|s| + |keyword|) for M letters in matched blocks. Two neighbouring blocks are
    parted by an unmatched letter of at least one side, so with ``u`` unmatched letters on
    both sides the keyword is broken at most ``u`` times: of ``u + 1`` segments one lies
    inside a block, shifted by no more than either side has unmatched letters. Turning one
    string into the other takes at most ``u`` edits, which is checked before pairs leave.
    """
    spark = terms.sparkSession
    words = keywords.withColumn("kw_len", F.length("keyword")).where("kw_len > 0")
    lengths = [r[0] for r in words.select("kw_len").distinct().collect()]
    steps = F.broadcast(spark.createDataFrame(  # a few rows for each length of a keyword
        _steps(lengths, cutoff, band), "s_len int, kw_len int, m int"))

    def segments(strings: DataFrame, on: str) -> DataFrame:
        rows = strings.join(steps, on).withColumn("u", F.expr("s_len + kw_len - 2 * m"))
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("u"))).alias("seg"))
        return rows.withColumn("start", F.expr("seg * kw_len div (u + 1)")).withColumn(
            "size", F.expr("(seg + 1) * kw_len div (u + 1) - start"))

    right = segments(words, "kw_len").selectExpr(
        "keyword", "s_len", "kw_len", "seg", "substring(keyword, start + 1, size) as piece")
    places = F.expr("""sequence(greatest(0, start - kw_len + m), least(s_len - size, start + s_len - m))""")
    fits = F.expr("greatest(0, start - kw_len + m) <= least(s_len - size, start + s_len - m)")
    left = segments(terms.withColumn("s_len", F.length("s")), "s_len").where(fits).select(
        "s", "s_len", "kw_len", "seg", "u", F.explode(F.array_distinct(F.transform(
            places, lambda i: F.substring(F.col("s"), i + 1, F.col("size"))))).alias("piece"))
    key = ["s_len", "kw_len", "seg", "piece"]
    heavy = settle(right.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HEAVY).select(
        F.struct(*key).alias("key"), (F.col("n") / HEAVY + 1).cast("int").alias("salts")))

    def salted(rows: DataFrame) -> DataFrame:
        return lookup_join(rows.withColumn("key", F.struct(*key)), heavy, "key").withColumn(
            "salts", F.coalesce("salts", F.lit(1))).drop("key")

    left = salted(left).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    right = salted(right).withColumn("salt", F.pmod(F.xxhash64("keyword"), F.col("salts")).cast("int"))
    met = left.drop("salts").join(right.drop("salts"), [*key, "salt"])
    return met.where(F.expr("levenshtein(s, keyword, u) >= 0")).select("s", "keyword").distinct()
