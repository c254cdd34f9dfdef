"""The dashboard document, as rows of JSON or as one bounded document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionmill.operators import feed as fd
from opinionmill.operators import metrics as m
from opinionmill.operators import products as p
from opinionmill.plans.scale import number_few, rank_rows, settle

SECTIONS = (
    "metrics", "trend", "drivers", "aspects", "worst_aspects", "products",
    "best_products", "heatmap_columns", "heatmap", "feed",
)
#: Sections whose number of rows does not grow with the opinions.
BOUNDED = ("metrics", "trend", "drivers", "worst_aspects", "best_products", "heatmap_columns")


def dashboard_sections(
    opinions: DataFrame, history: DataFrame | None = None,
    live: tuple[str, DataFrame] | None = None,
) -> DataFrame:
    """All sections whole, as ``(section, place, key, json)`` rows.

    ``place`` orders the ranked sections; the unranked ones (heatmap, feed) are
    ordered by ``key``. ``live`` is a sentence just scored and what ``score_one`` found in
    it: the text is the section ``live_text``, the findings are ``live``. Counts come from one cube, so the opinion table is read
    for the cube, the trend, the samples and the feed only.
    """
    cube = settle(m.opinion_cube(opinions))
    top = m.top_aspect(cube)
    kpis = (
        m.kpi_metrics(cube)
        .withColumn("top_aspect", top.select("top_aspect").scalar())
        .withColumn("top_aspect_count", top.select("top_aspect_count").scalar()))
    profile = m.aspect_profile(cube)
    tooltips = p.sample_reviews(opinions, counts=cube).select("product", "tooltip")
    products = (
        p.product_ranking(cube).join(tooltips, "product", "left")
        .withColumn("place", F.col("rank") - 1))

    def rows(name: str, df: DataFrame, key: str | None = None) -> DataFrame:
        body = [c for c in df.columns if c not in ("place", "first_ord")]
        place = F.col("place") if "place" in df.columns else F.lit(0)
        return df.select(
            F.lit(name).alias("section"), place.cast("bigint").alias("place"),
            (F.col(key) if key else F.lit("")).alias("key"),
            F.to_json(F.struct(*body), {"ignoreNullFields": "false"}).alias("json"))

    parts = [
        rows("metrics", kpis),
        rows("trend", m.trend_series(opinions)),
        rows("drivers", m.drivers(cube), "side"),
        rows("aspects", rank_rows(profile, m.profile_order(), "place")),
        rows("worst_aspects", number_few(
            m.worst_aspects(cube), [F.desc("neg"), *m.profile_order()], "place")),
        rows("products", products),
        rows("best_products", number_few(
            p.best_products(cube), [F.desc("pos_rate"), *p.ranking_order()], "place")),
        rows("heatmap_columns", number_few(
            p.top_categories(cube), m.profile_order(), "place")
            .select("category", "place")),
        rows("heatmap", p.heatmap_maps(cube), "product"),
        rows("feed", fd.review_feed(opinions), "text"),
    ]
    if history is not None:
        parts.append(rows("history", history.withColumn("place", F.col("seq"))))
    if live is not None:
        text, found = live
        parts += [
            rows("live_text", opinions.sparkSession.range(1).select(F.lit(text).alias("text"))),
            rows("live", found, "aspect_raw")]
    return reduce(DataFrame.unionByName, parts)


def export_dashboard(
    opinions: DataFrame, path: str, history: DataFrame | None = None,
    live: tuple[str, DataFrame] | None = None,
) -> None:
    """Write the sections as JSON, one folder per section, any amount of rows."""
    (
        dashboard_sections(opinions, history, live)
        .write.mode("overwrite").partitionBy("section").json(path))


def dashboard_document(sections: DataFrame) -> DataFrame:
    """One row with the ``BOUNDED`` sections as a single JSON object.

    A single object passes through one task; the other sections (aspects, products,
    heatmap, feed, history) grow with the input and stay rows, see ``export_dashboard``.
    """
    one = sections.where(F.col("section").isin(*BOUNDED)).groupBy("section").agg(
        F.array_sort(F.collect_list(F.struct("place", "key", "json"))).alias("items"))
    body = F.concat(
        F.lit('"'), F.col("section"), F.lit('":['),
        F.array_join(F.transform("items", lambda i: i["json"]), ","), F.lit("]"))
    return one.agg(
        F.concat(
            F.lit("{"),
            F.array_join(F.array_sort(F.collect_list(body)), ","),
            F.lit("}")).alias("document"))
