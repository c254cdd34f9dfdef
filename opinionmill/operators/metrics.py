"""Summary metrics, aspect profile, drivers and trend.

All of them need only counts. ``tally`` turns opinions into counts once; it
also accepts a frame that already holds counts (an ``opinion_cube``), so a
dashboard reads the opinion table a single time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinionmill import schema as S
from opinionmill.functions import text as tx
from opinionmill.functions.rounding import half_even_pct
from opinionmill.plans.scale import order_statistics_near

COUNTS = ("total", "pos", "neg", "first_ord")


def tally(df: DataFrame, *keys: str) -> DataFrame:
    """Counts per ``keys``: total, pos, neg and the first position seen."""
    if set(COUNTS) <= set(df.columns):
        aggs = [
            F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
            F.coalesce(F.sum("pos"), F.lit(0)).alias("pos"),
            F.coalesce(F.sum("neg"), F.lit(0)).alias("neg"),
        ]
        first = F.min("first_ord")
    else:
        aggs = [
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("polarity") == S.POS).alias("pos"),
            F.count_if(F.col("polarity") == S.NEG).alias("neg"),
        ]
        first = F.min("ord")
    return df.groupBy(*keys).agg(*aggs, first.alias("first_ord"))


def opinion_cube(opinions: DataFrame) -> DataFrame:
    """Counts per (product, category): all the A-metrics but trend and samples
    can be computed from this small table."""
    return tally(opinions, "product", "category")


def kpi_metrics(opinions: DataFrame) -> DataFrame:
    """One row: totals, rates, net score and its band."""
    t = tally(opinions)
    rated = t.select(
        "total",
        F.col("pos").alias("pos_count"),
        F.col("neg").alias("neg_count"),
        half_even_pct(F.col("pos"), F.col("total")).alias("pos_rate"),
        half_even_pct(F.col("neg"), F.col("total")).alias("neg_rate"),
    )
    nps = F.col("pos_rate") - F.col("neg_rate")
    return rated.select(
        "*",
        (100 - F.col("pos_rate") - F.col("neg_rate")).alias("neu_rate"),
        nps.alias("nps"),
        tx.nps_band(nps).alias("nps_band"),
    )


def top_aspect(opinions: DataFrame) -> DataFrame:
    """One row: the most frequent category and its count, "N/A" / 0 when empty."""
    best = F.max_by(
        F.struct("category", "total"),
        F.struct("total", (-F.col("first_ord")).alias("early")))
    return (
        tally(opinions, "category").where("category is not null")
        .agg(best.alias("b"))
        .select(
            F.coalesce("b.category", F.lit("N/A")).alias("top_aspect"),
            F.coalesce("b.total", F.lit(0)).alias("top_aspect_count"),
        )
    )



def profile_order() -> list[Column]:
    return [F.desc("total"), F.asc("first_ord")]


def aspect_profile(opinions: DataFrame) -> DataFrame:
    """Per category: counts, rates and impact on the overall net score.

    ``first_ord`` is kept as the tie-break of every ordering built on top.
    """
    # missing categories still count in the grand total; a row for each category
    grand = F.sum("total").over(Window.partitionBy())
    per_category = tally(opinions, "category").withColumn("grand", grand)
    total, grand = F.col("total"), F.col("grand")
    return per_category.where("category is not null").select(
        "category", "total", "pos", "neg",
        half_even_pct(F.col("pos"), total).alias("pos_rate"),
        half_even_pct(F.col("neg"), total).alias("neg_rate"),
        half_even_pct(F.col("pos") - F.col("neg"), grand).alias("impact"),
        "first_ord",
    )


def aspect_impact(opinions: DataFrame) -> DataFrame:
    return aspect_profile(opinions).select("category", "pos", "neg", "impact", "first_ord")


def worst_aspects(opinions: DataFrame, k: int = 8) -> DataFrame:
    return (
        aspect_profile(opinions)
        .orderBy(F.desc("neg"), *profile_order()).limit(k)
    )


def pos_drivers(opinions: DataFrame, k: int = 2) -> DataFrame:
    return drivers(opinions, k).where("side = 'pos'").drop("side")


def neg_drivers(opinions: DataFrame, k: int = 2) -> DataFrame:
    return drivers(opinions, k).where("side = 'neg'").drop("side")


def drivers(opinions: DataFrame, k: int = 2) -> DataFrame:
    """The categories that lift and lower the net score most, with their place."""
    size = F.abs("impact")
    side = F.when(F.col("impact") > 0, S.POS).when(F.col("impact") < 0, S.NEG)
    # a row for each category
    place = F.row_number().over(
        Window.partitionBy("side").orderBy(F.desc("rate"), *profile_order())) - 1
    return (
        aspect_profile(opinions).withColumns({"side": side, "rate": size})
        .where("side is not null").withColumn("place", place.cast("bigint"))
        .where(F.col("place") < k).select("side", "category", "rate", "place"))


# ------------------------------------------------------------------------ trend

_SLOTS = 5


def _slot_rates(df: DataFrame, slot: Column) -> DataFrame:
    """Rates of the five slots from one aggregate row; empty slots give 0 / 0."""
    marked = df.select(slot.alias("slot"), "polarity")

    def counts(i: int) -> list[Column]:
        here = F.col("slot") == i
        return [
            F.count_if(here).alias(f"n{i}"),
            F.count_if(here & (F.col("polarity") == S.POS)).alias(f"p{i}"),
            F.count_if(here & (F.col("polarity") == S.NEG)).alias(f"q{i}"),
        ]

    one = marked.agg(*[c for i in range(_SLOTS) for c in counts(i)])
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("slot"),
            F.col(f"n{i}").alias("total"),
            half_even_pct(F.col(f"p{i}"), F.col(f"n{i}")).alias("pos_rate"),
            half_even_pct(F.col(f"q{i}"), F.col(f"n{i}")).alias("neg_rate"),
        )
        for i in range(_SLOTS)
    ])
    return one.select(F.inline(rows))


def has_time(opinions: DataFrame) -> DataFrame:
    """One row: does any opinion carry a non-empty (or missing) time text?"""
    filled = F.col("time_text").isNull() | (F.col("time_text") != "")
    return opinions.agg(F.coalesce(F.bool_or(filled), F.lit(False)).alias("has_time"))


def recency_slot(days: Column) -> Column:
    """Oldest first: >21, 15-21, 8-14, 1-7, 0 days; null when unknown."""
    return (
        F.when(days > 21, 0).when(days > 14, 1).when(days > 7, 2)
        .when(days >= 1, 3).when(days == 0, 4)
    )


def trend_by_recency(opinions: DataFrame) -> DataFrame:
    return _slot_rates(opinions, recency_slot(tx.parse_days_ago(F.col("time_text"))))


def trend_by_position(opinions: DataFrame) -> DataFrame:
    """Five slices of ``ceil(n / 5)`` rows in row order, the last ones shorter."""
    def ranks(n: int) -> list[int]:
        size = -(-n // _SLOTS) if n else 1
        return [size * i for i in range(1, _SLOTS) if size * i <= n]

    ends = order_statistics_near(
        opinions.select("ord"), "ord", [i / _SLOTS for i in range(1, _SLOTS)], ranks)
    slot = F.lit(len(ends))
    for i in reversed(range(len(ends))):
        slot = F.when(F.col("ord") <= F.lit(ends[i]), i).otherwise(slot)
    return _slot_rates(opinions, slot)


def trend(opinions: DataFrame) -> DataFrame:
    """By recency when any time text can be read, else by position."""
    readable = tx.parse_days_ago(F.col("time_text")) >= 0
    if "time_text" in opinions.columns and not opinions.where(readable).isEmpty():
        return trend_by_recency(opinions)
    return trend_by_position(opinions)


def trend_series(opinions: DataFrame) -> DataFrame:
    """One row of chart strings: ``x,y`` points and the closed polygon."""
    points = F.array_sort(F.collect_list(F.struct("slot", "pos_rate", "neg_rate")))

    def line(rate: str) -> Column:
        return F.array_join(
            F.transform(
                F.col("pts"),
                lambda p: F.concat_ws(
                    ",", (p["slot"] * 25).cast("string"),
                    (100 - p[rate]).cast("string"))),
            " ",
        )

    return (
        trend(opinions).agg(points.alias("pts"))  # always five rows
        .select(line("pos_rate").alias("pos_pts"), line("neg_rate").alias("neg_pts"))
        .withColumn("pos_poly", F.concat(F.lit("0,100 "), "pos_pts", F.lit(" 100,100")))
    )
