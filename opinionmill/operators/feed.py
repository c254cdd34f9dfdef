"""The review feed and everything a reader does with it: facets, filters,
search, pages and the panels beside it.

A feed row is ``(text, product, tags)`` with ``tags`` an array of
``struct<aspect, polarity>`` in first-seen order. Feed order is by text; ties
in any ranking go to the key met first in that order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinionmill import schema as S
from opinionmill.functions.rounding import half_up_pct
from opinionmill.plans.pages import ranked_page, write_ranked
from opinionmill.plans.scale import TOP_ROWS, global_index, number_few, settle, spread_small


#: Bytes a core from which the rows of a feed stay where they are: smaller files are cut
#: into splits of this size, and a row is little work.
FEED_SPLIT = 4 << 20


def review_feed(opinions: DataFrame) -> DataFrame:
    """One item per distinct review text.

    The first aggregate removes repeats on the map side, so even a text shared
    by a third of all rows reaches the second one as a few rows per task, and
    an item never collects more than categories x polarities entries.
    """
    pol = (
        F.when(F.col("polarity").isin(S.POS, S.NEG), F.col("polarity")).otherwise(S.NEU)
    )
    tags = (
        spread_small(opinions, "ord", FEED_SPLIT).where("review_text is not null")
        .groupBy(
            F.col("review_text").alias("text"), F.col("category").alias("aspect"),
            pol.alias("polarity"))
        .agg(F.min("ord").alias("ord"), F.min_by("product", "ord").alias("product"))
    )
    item = tags.groupBy("text").agg(
        F.min_by("product", "ord").alias("product"),
        F.array_sort(F.collect_list(F.struct("ord", "aspect", "polarity"))).alias("t"),
    )
    return item.select(
        "text", "product",
        F.transform(
            "t",
            lambda x: F.struct(x["aspect"].alias("aspect"), x["polarity"].alias("polarity")),
        ).alias("tags"),
    )


def feed_summary(opinions: DataFrame) -> DataFrame:
    """One row: sentences, mentions and the caption built from them."""
    return opinions.agg(
        F.countDistinct("review_text").alias("sentences"),
        F.count(F.lit(1)).alias("mentions"),
    ).withColumn(
        "caption",
        F.concat(F.col("sentences").cast("string"), F.lit(" câu → "),
                 F.col("mentions").cast("string"), F.lit(" khía cạnh")),
    )


def feed_tags(feed: DataFrame) -> DataFrame:
    """One row per tag, with its place inside the item."""
    return feed.select(
        "text", "product", F.posexplode("tags").alias("tag_pos", "tag")
    ).select("text", "product", "tag_pos", "tag.aspect", "tag.polarity")


def _first_seen() -> Column:
    return F.min(F.struct("text", "tag_pos")).alias("seen")


# --------------------------------------------------------------- alerts, facets


def smart_alerts(feed: DataFrame) -> DataFrame:
    """The (product, category) pair with most negative and most positive tags."""
    named = F.when(F.coalesce("product", F.lit("")) == "", S.DEFAULT_PRODUCT).otherwise(
        F.col("product"))
    pairs = (
        feed_tags(feed).where(F.col("polarity").isin(S.POS, S.NEG))
        .groupBy(named.alias("product"), "aspect", "polarity")
        .agg(F.count(F.lit(1)).alias("mentions"), _first_seen())
    )
    best = F.min_by(
        F.struct("product", "aspect", "mentions"),
        F.struct((-F.col("mentions")).alias("m"), "seen"))
    kind = F.when(F.col("polarity") == S.NEG, "quality").otherwise("opportunity")
    return (
        pairs.groupBy("polarity").agg(best.alias("b"))
        .select(kind.alias("alert"), "b.product", "b.aspect", "b.mentions")
    )


def quality_alert(feed: DataFrame) -> DataFrame:
    return smart_alerts(feed).where("alert = 'quality'")


def opportunity_alert(feed: DataFrame) -> DataFrame:
    return smart_alerts(feed).where("alert = 'opportunity'")


def aspect_facet_counts(feed: DataFrame) -> DataFrame:
    """Items mentioning each category; ``seen`` is the tie-break of its order."""
    once = feed.select(
        "text",
        F.posexplode(F.array_distinct(F.transform("tags", lambda t: t["aspect"])))
        .alias("tag_pos", "aspect"),
    )
    return once.groupBy("aspect").agg(F.count(F.lit(1)).alias("items"), _first_seen())


def product_facet_counts(feed: DataFrame) -> DataFrame:
    return feed.groupBy("product").agg(
        F.count(F.lit(1)).alias("items"), F.min("text").alias("seen"))


def _page(
    rows: DataFrame, order_by: list[Column], page: int, size: int, past_end: str
) -> DataFrame:
    """Rows of one page with ``row`` (0-based place), ``page``, ``pages``, ``found``.

    ``past_end`` says which page stands in for one beyond the last. Early pages
    come from a top-k; deeper ones from a numbered copy of the rows, so no
    single task ever holds more than ``TOP_ROWS`` of them.
    """
    page = max(page, 1)
    found = rows.agg(F.count(F.lit(1))).scalar()
    if page * size <= TOP_ROWS:
        numbered = number_few(rows.orderBy(*order_by).limit(page * size), order_by, "row")
    else:
        numbered = global_index(rows, order_by, "row")
    pages = F.greatest(F.lit(1), F.ceil(F.col("found") / size))
    beyond = F.lit(1) if past_end == "first" else F.col("pages")
    return (
        numbered.withColumn("found", found)
        .withColumn("pages", pages.cast("int"))
        .withColumn("page", F.when(F.col("pages") < page, beyond).otherwise(page).cast("int"))
        .where((F.col("row") >= (F.col("page") - 1) * size)
               & (F.col("row") < F.col("page") * size))
    )


def facet_page(feed: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """A page of the product facet; a page past the end shows the first one."""
    counts = product_facet_counts(feed)
    shown = _page(counts, [F.desc("items"), F.asc("seen")], page, size, "first")
    return shown.select("page", "pages", "row", "product", "items")


def store_feed(feed: DataFrame, path: str) -> None:
    """Write the feed and its product facet for paging, see ``stored_page``.

    The facet is counted from the feed as written, which is computed once.
    """
    write_ranked(feed, [F.asc("text")], f"{path}/feed")
    stored = feed.sparkSession.read.schema(feed.schema).parquet(f"{path}/feed/rows")
    write_ranked(product_facet_counts(stored), [F.desc("items"), F.asc("seen")], f"{path}/products")


def stored_page(spark: SparkSession, path: str, page: int = 1, size: int = 10) -> DataFrame:
    """``feed_page`` of the whole feed, from one or two files of ``store_feed``."""
    return ranked_page(spark, f"{path}/feed", page, size, "last")


def stored_facet_page(spark: SparkSession, path: str, page: int = 1, size: int = 20) -> DataFrame:
    """``facet_page`` from the files of ``store_feed``."""
    shown = ranked_page(spark, f"{path}/products", page, size, "first")
    return shown.select("page", "pages", "row", "product", "items")


# ------------------------------------------------------------ filter and search


def filter_feed(
    feed: DataFrame, product: str | None = None, category: str | None = None
) -> DataFrame:
    if product is not None:
        feed = feed.where(F.col("product") == product)
    if category is not None:
        feed = feed.where(F.exists("tags", lambda t: t["aspect"] == category))
    return feed


def search_feed(feed: DataFrame, query: str = "") -> DataFrame:
    """Case-insensitive substring of the text, the product or any tag."""
    if not query:
        return feed
    q = F.lower(F.lit(query))
    return feed.where(
        F.contains(F.lower("text"), q)
        | F.contains(F.lower("product"), q)
        | F.exists("tags", lambda t: F.contains(F.lower(t["aspect"]), q))
    )


@dataclass(frozen=True)
class Slice:
    """What the reader has selected."""

    product: str | None = None
    category: str | None = None
    query: str = ""

    def feed(self, feed: DataFrame) -> DataFrame:
        return search_feed(filter_feed(feed, self.product, self.category), self.query)

    def tags(self, feed: DataFrame) -> DataFrame:
        tags = feed_tags(self.feed(feed))
        return tags if self.category is None else tags.where(F.col("aspect") == self.category)


def feed_page(
    feed: DataFrame, selection: Slice = Slice(), page: int = 1, size: int = 10
) -> DataFrame:
    """A page of the selected feed; a page past the end shows the last one."""
    return _page(selection.feed(feed), [F.asc("text")], page, size, "last")


# ----------------------------------------------------------------------- panels


def _slice_counts(feed: DataFrame, selection: Slice) -> DataFrame:
    return selection.tags(feed).groupBy("aspect").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("polarity") == S.POS).alias("pos"),
        F.count_if(F.col("polarity") == S.NEG).alias("neg"),
        _first_seen(),
    )


def slice_aspects(feed: DataFrame, selection: Slice = Slice(), k: int = 10) -> DataFrame:
    top = _slice_counts(feed, selection).orderBy(F.desc("total"), F.asc("seen")).limit(k)
    widest = F.max("total").over(Window.partitionBy())  # over at most k rows
    return top.select(
        "aspect", "total", "pos", "neg",
        (F.col("total") / widest * 100).alias("bar_width"))


def slice_sentiment(feed: DataFrame, selection: Slice = Slice()) -> DataFrame:
    """One row: rates over positive plus negative tags, half up."""
    pos = F.count_if(F.col("polarity") == S.POS)
    neg = F.count_if(F.col("polarity") == S.NEG)
    both = F.col("pos") + F.col("neg")
    return (
        selection.tags(feed).agg(pos.alias("pos"), neg.alias("neg"))
        .select(
            "pos", "neg",
            half_up_pct(F.col("pos"), both).alias("pos_rate"),
            half_up_pct(F.col("neg"), both).alias("neg_rate"))
    )


def slice_alerts(feed: DataFrame, selection: Slice = Slice(), k: int = 5) -> DataFrame:
    return (
        _slice_counts(feed, selection).where("neg > 0")
        .orderBy(F.desc("neg"), F.asc("seen")).limit(k)
        .select("aspect", "neg",
                half_up_pct(F.col("neg"), F.col("total")).alias("neg_rate"))
    )


def slice_best_products(
    feed: DataFrame, selection: Slice = Slice(), k: int = 3
) -> DataFrame:
    return (
        selection.tags(feed).groupBy("product").agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("polarity") == S.POS).alias("pos"),
            F.min("text").alias("seen"))
        .withColumn("pos_rate", half_up_pct(F.col("pos"), F.col("total")))
        .orderBy(F.desc("pos_rate"), F.asc("seen")).limit(k)
        .select("product", "total", "pos_rate")
    )


def settled_feed(opinions: DataFrame) -> DataFrame:
    """A feed computed once, for sessions that slice it many times."""
    return settle(review_feed(opinions))
