"""Views that present the test tables in the shapes the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionmill.functions import tokens as tk
from opinionmill.operators import taxonomy as tax
from opinionmill.plans.extract import Models
from opinionmill.plans.scale import rank_rows, spread_small

TAXONOMY = {
    "Quality": ("worthless", "pathetic", "onble", "thanedble"),
    "Motion": ("thtion", "attion", "ertion"),
    "Making": ("oning", "ering", "reing"),
    "Person": ("eriner", "thanea"),
    "Pin & Sạc": ("pin", "sạc nhanh", "sạc"),
    "Màn hình": ("màn hình",),
}
BLACKLIST = ("sản phẩm", "máy", "onthe", "thetion")
MODELS = Models(
    heads=("thtion", "attion", "ertion", "erting", "thatti", "reing", "worthless",
           "oning", "ering", "thering", "onthe", "eration", "attions", "thition"),
    tails=("the", "of", "and"),
    positive=("the", "des", "und", "is"),
    negative=("of", "la", "der", "on"),
)
# Heads that no keyword is contained in, but that are spelled like one.
NEAR_MODELS = Models(
    heads=("thatin", "retion", "antion", "hetion", "ention", "edtion", "thonea", "einer", "thtion"),
    tails=("the", "of", "and"), positive=MODELS.positive, negative=MODELS.negative)
# Phrases that a segmenter makes one word; no second word begins another phrase.
PHRASES = (*(f"{head} the" for head in MODELS.heads), "thing of", "that and")
# A day on which every ledger entry of the fixtures was made.
CLOCK = "2026-01-02 03:04:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def opinion_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as opinions, without the review text (no join to orders)."""
    return _facts(spark, sf_dir, table(spark, sf_dir, "lineitem"))


def _facts(spark: SparkSession, sf_dir: str, lines: DataFrame, *more: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        """((l_orderkey % 134217728) * 8 + l_linenumber % 8) * 4294967296
           + (l_partkey % 262144) * 16384 + l_suppkey % 16384 as ord""",
        "l_orderkey",
        "p_brand as product",
        "p_type || '-' || (p_size % 2) as category",
        "lower(p_type) as aspect_raw",
        """case when p_size % 2 = 0 and l_returnflag = 'A' then 'pos'
                when p_size % 2 = 1 and l_returnflag = 'R' then 'neg'
                when l_returnflag = 'N' and l_linenumber = 7 then 'neu'
                when p_size % 2 = 0 then 'neg' else 'pos' end as polarity""",
        """case when l_partkey % 11 = 0 then ''
                when l_partkey % 13 = 0 then 'hôm nay'
                when l_partkey % 60 < 14 then (l_partkey % 60) || ' ngày trước'
                when l_partkey % 60 < 40 then ((l_partkey % 60) div 7) || ' tuần trước'
                when l_partkey % 60 < 55 then ((l_partkey % 60) div 30) || ' tháng trước'
                else '1 năm trước' end as time_text""",
        *more,
    )


def opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full opinion table; one review text per order.

    The two large tables are joined first, while their rows are a few numbers.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    text = "'order ' || l_orderkey || ' ' || o_orderpriority as review_text"
    return _facts(spark, sf_dir, lines, text).select(
        "ord", "product", "review_text", "category", "aspect_raw", "polarity", "time_text")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reviews, decorated with what cleaning has to remove."""
    k = F.pmod(F.col("doc_id"), F.lit(5))
    text = (
        F.when(k == 0, F.concat("text", F.lit(" https://a.example/x?y=1<b>z</b>")))
        .when(k == 1, F.concat("text", F.lit(" <br/>www.a.example end")))
        .when(k == 2, F.concat("text", F.lit("\u00a0\u00a0e\u0301")))
        .when(k == 3, F.col("text"))
        .otherwise("NaN")
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"), F.col("source").alias("product"),
        text.alias("text"),
        F.expr("""case when doc_id % 7 = 0 then null
                       else (doc_id % 60) || ' ngày trước' end""").alias("time_text"))


def html_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("ord"),
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("product"),
        F.col("html").alias("text"), F.lit("").alias("time_text"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.expr("conv_id * 1000 + turn").alias("sent_id"), "text")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sent_id, word_id, word)``."""
    return sentences(spark, sf_dir).select(
        "sent_id",
        F.posexplode(tk.split_words(F.col("text"))).alias("word_id", "word"))


def labelled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.length("word") % 5
    label = F.when(m == 0, "B-ASP").when(m == 1, "I-ASP").otherwise("O")
    return words(spark, sf_dir).withColumn("label", label)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sent_id, pos, word_id, logits)``: a piece per four characters; the first
    piece of a word carries its label, later ones a different label."""
    def one_hot(cls):
        return F.array(*[(cls == i).cast("float") for i in range(3)])

    def entry(word_id, cls):
        return F.struct(word_id.cast("int").alias("word_id"), one_hot(cls).alias("logits"))

    def pieces(w, i):
        m = F.length(w) % 5
        cls = F.when(m == 0, 1).when(m == 1, 2).otherwise(0)
        return F.transform(
            F.sequence(F.lit(0), F.ceil(F.length(w) / 4).cast("int") - 1),
            lambda p: entry(i, F.when(p == 0, cls).otherwise((cls + 1) % 3)))

    marker = F.array(entry(F.lit(None), F.lit(0)))
    line = F.concat(
        marker,
        F.flatten(F.transform(tk.split_words(F.col("text")), pieces)),
        marker)
    return sentences(spark, sf_dir).select(
        "sent_id", F.posexplode(line).alias("pos", "t")
    ).select("sent_id", "pos", "t.word_id", "t.logits")


def raw_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct document words, some turned into spellings that need work."""
    w = (
        spread_small(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
        .select(F.explode(tk.split_words(F.col("text"))).alias("w")).distinct()
    )
    n = F.length("w")
    raw = (
        F.when(n % 7 == 0, F.concat(
            F.lit("Sạc nhanh "), n.cast("string"), F.lit(" "), F.col("w")))
        .when(n % 7 == 1, F.concat(F.lit("  T"), F.col("w"), F.lit("_X")))
        .when((n % 7 == 2) & (n > 8), F.concat(F.lit("màn_hình "), n.cast("string")))
        .when((n % 7 == 3) & (n > 9), F.lit("Sản_phẩm"))
        .otherwise(F.col("w"))
    )
    return w.select(raw.alias("aspect_raw")).distinct()


def taxonomy(spark: SparkSession) -> DataFrame:
    return tax.taxonomy_from_map(spark, TAXONOMY)


def word_taxonomy(texts: DataFrame) -> DataFrame:
    """A large dictionary: the distinct words of ``text`` with four letters or more."""
    word = F.explode(tk.split_words(F.lower("text")))
    words = texts.select(word.alias("keyword")).where("length(keyword) >= 4").distinct()
    return rank_rows(words, ["keyword"], "kw_ord").select(
        F.concat(F.lit("C"), (F.length("keyword") % 7).cast("string")).alias("category"),
        "keyword", F.col("kw_ord").cast("int").alias("kw_ord"))


def blacklist(spark: SparkSession) -> DataFrame:
    return tax.blacklist_from_terms(spark, BLACKLIST)


def part_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary taken from the part table."""
    return table(spark, sf_dir, "part").select(
        F.col("p_type").alias("category"), F.col("p_name").alias("keyword"),
        F.col("p_partkey").cast("int").alias("kw_ord"))


def known_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opinion categories but one."""
    return (
        table(spark, sf_dir, "part")
        .selectExpr("p_type || '-' || (p_size % 2) as category",
                    "p_name as keyword", "cast(p_partkey as int) as kw_ord")
        .where("category <> 'PROMO-1'"))
