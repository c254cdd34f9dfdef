"""Product ranking, samples and the product x aspect heatmap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinionmill import schema as S
from opinionmill.functions import text as tx
from opinionmill.functions.rounding import half_even_pct, satisfaction_score
from opinionmill.operators.metrics import opinion_cube, profile_order, tally
from opinionmill.plans.scale import global_index, settle


def ranking_order() -> list[Column]:
    return [F.desc("score"), F.asc("product")]


def product_scores(opinions: DataFrame) -> DataFrame:
    """Per product: counts, rates, score and stars (unordered)."""
    pos, neg, total = F.col("pos"), F.col("neg"), F.col("total")
    return (
        tally(opinions, "product").where("product is not null")
        .select(
            "product", "total", "pos", "neg",
            half_even_pct(pos, total).alias("pos_rate"),
            half_even_pct(neg, total).alias("neg_rate"),
            satisfaction_score(pos, total).alias("score"),
        )
        .withColumn("stars", tx.star_band(F.col("score")))
    )


def product_ranking(opinions: DataFrame) -> DataFrame:
    """Every product with its 1-based rank: score descending, then name."""
    placed = global_index(product_scores(opinions), ranking_order(), "rank")
    return placed.withColumn("rank", F.col("rank") + 1)


def best_products(opinions: DataFrame, k: int = 3) -> DataFrame:
    return (
        product_scores(opinions)
        .orderBy(F.desc("pos_rate"), *ranking_order()).limit(k)
    )


def top_products(opinions: DataFrame, k: int = 15) -> DataFrame:
    return (
        product_scores(opinions)
        .orderBy(F.desc("total"), *ranking_order()).limit(k)
        .select("product", "total", "pos", "neg", "pos_rate", "neg_rate")
    )


def top_aspects_scaled(profile: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent categories with bar width relative to the largest."""
    top = profile.orderBy(*profile_order()).limit(k)
    widest = F.max("total").over(Window.partitionBy())  # over at most k rows
    return top.select(
        "category", "total", "pos", "neg", "pos_rate", "neg_rate",
        (F.col("total") / widest * 100).alias("bar_width"),
    )


def sample_reviews(
    opinions: DataFrame, k: int = 10, counts: DataFrame | None = None
) -> DataFrame:
    """Per product the first k mentions as one text block, plus what remains.

    Each task keeps the first k mentions of a product, texts included, and only these
    are shuffled: one read of the texts, whatever share of the rows a product has. The
    number of mentions comes from ``counts`` (an ``opinion_cube``) or from the product
    column alone.
    """
    named = opinions.where("product is not null")
    place = F.row_number().over(Window.partitionBy("product").orderBy("ord"))
    chosen = named.select("product", "ord", "polarity", "category", "review_text").withColumn(
        "place", place).where(F.col("place") <= k)
    line = F.concat(
        tx.display_polarity(F.col("polarity")), F.lit(" | "),
        F.coalesce("category", F.lit("")), F.lit(':\n  "'),
        F.replace(F.coalesce("review_text", F.lit("")), F.lit('"'), F.lit("'")),
        F.lit('"'),
    )
    first = (
        chosen.select("product", "place", line.alias("line")).groupBy("product")
        .agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    )
    totals = named.groupBy("product").agg(F.count(F.lit(1)).alias("total")) if counts is None else (
        tally(counts, "product").where("product is not null").select("product", "total"))
    shown = F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n")
    more = F.when(
        F.col("total") > k,
        F.concat(F.lit("\n\n... và "), (F.col("total") - k).cast("string"),
                 F.lit(" đánh giá khác")),
    ).otherwise("")
    return first.join(totals, "product").select(
        "product", "total", F.concat(shown, more).alias("tooltip"))


def top_categories(opinions: DataFrame, k: int = 10) -> DataFrame:
    return (
        tally(opinions, "category").where("category is not null")
        .orderBy(*profile_order()).limit(k)
        .select("category", "total", "first_ord")
    )


def heatmap_rows(opinions: DataFrame, k: int = 10) -> DataFrame:
    """One row per product with an array of k zero-filled cells.

    The grid is filled inside each product's row: categories outside the top k
    fold into one null cell first, so a product collects at most k + 1 entries
    and no join or cross product is needed.
    """
    if "ord" in opinions.columns:  # read them once for both steps
        opinions = settle(opinion_cube(opinions))
    top = top_categories(opinions, k).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(
                (-F.col("total")).alias("t"), "first_ord", "category"))),
            lambda x: x["category"],
        ).alias("top")
    ).scalar()
    folded = opinions.where("product is not null").withColumn(
        "category", F.when(F.array_contains(top, F.col("category")), F.col("category")))
    cells = tally(folded, "product", "category")
    per_product = cells.groupBy("product").agg(
        F.collect_list(F.struct("category", "total", "pos", "neg")).alias("seen"))
    wide = per_product.withColumn("top", top)

    def cell(name: Column, col: Column) -> Column:
        hit = F.get(F.filter(F.col("seen"), lambda s: s["category"] == name), F.lit(0))
        return F.coalesce(half_even_pct(hit[col], hit["total"]), F.lit(0))

    return wide.select(
        "product",
        F.transform(
            "top",
            lambda name, i: F.struct(
                i.alias("col"), name.alias("category"),
                cell(name, "pos").alias("pos_pct"),
                cell(name, "neg").alias("neg_pct"),
            ),
        ).alias("cells"),
    )


def heatmap(opinions: DataFrame, k: int = 10) -> DataFrame:
    """Long form: one row per product and top category."""
    return heatmap_rows(opinions, k).select("product", F.inline("cells"))


def heatmap_maps(opinions: DataFrame, k: int = 10) -> DataFrame:
    """Per product a map from category to its two percentages."""
    return heatmap_rows(opinions, k).select(
        "product",
        F.map_from_entries(F.transform(
            "cells",
            lambda c: F.struct(
                c["category"],
                F.struct(c["pos_pct"].alias("pos_pct"), c["neg_pct"].alias("neg_pct"))),
        )).alias("aspects"),
    )


def heatmap_dominant(cells: DataFrame) -> DataFrame:
    """Per cell the stronger side and its value; the side is null at 0."""
    value = F.greatest("pos_pct", "neg_pct")
    side = F.when(F.col("pos_pct") >= F.col("neg_pct"), S.POS).otherwise(S.NEG)
    return cells.select(
        "product", "category",
        F.when(value > 0, side).alias("side"), value.alias("value"))
