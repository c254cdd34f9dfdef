"""From reviews to the opinion table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionmill import schema as S
from opinionmill.functions import text as tx
from opinionmill.functions import tokens as tk
from opinionmill.functions.once import computed
from opinionmill.operators import scoring
from opinionmill.operators.taxonomy import fuzzy_match, normalize_aspects
from opinionmill.operators.tokens import build_pairs
from opinionmill.plans.scale import settle, spread_small
from opinionmill.sources.memo import TermMemo
from opinionmill.sources.reviews import clean_reviews, non_empty_reviews


@dataclass(frozen=True)
class Models:
    """Tagger, scorer and word segmenter. Factories run in Python workers; without
    them a dictionary (``heads`` / ``tails``) and a lexicon do the work in the JVM,
    and words are what stands between spaces."""

    heads: tuple[str, ...] = ()
    tails: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    tagger: Callable | None = field(default=None, compare=False)
    scorer: Callable | None = field(default=None, compare=False)
    segmenter: Callable | None = field(default=None, compare=False)
    batch: int = 32


def models_from_taxonomy(rows, positive=(), negative=()) -> Models:
    """Dictionary models for keyword rows: first words are heads, others tails."""
    words = [r["keyword"].lower().split() for r in rows]
    heads = sorted({w[0] for w in words if w})
    tails = sorted({x for w in words for x in w[1:]} - set(heads))
    return Models(tuple(heads), tuple(tails), tuple(positive), tuple(negative))


def tag_mentions(
    clean: DataFrame, models: Models, keep: tuple[str, ...] = (), even: bool = False,
    hits: bool = False
) -> DataFrame:
    """One row per aspect span, with the position ``ord`` packed from the review's
    and the span's. A review stays one row until its spans are known, so
    tagging and grouping need no shuffle. Sentences and terms are in segmented words.
    Without a scorer ``label`` is that of the review, whose words are counted once for all
    of its spans; with ``hits`` these counts stay instead, for ``score_mentions`` to judge.
    The columns ``keep`` stay. ``even`` says that ``clean`` is as ``clean_reviews`` makes it."""
    if models.segmenter is not None:
        clean, even = scoring.segment_words(clean, models.segmenter, batch=models.batch), False
    lexicon = list(models.positive), list(models.negative)
    counted = []

    def hits_of(lowered: Column) -> Column:
        return tk.lexicon_hits_of(lowered, *lexicon)

    if models.tagger is None:
        if models.scorer is None:
            counted = [F.col("_told.label").alias("hits")]
        tagged = computed(clean, "_told", tk.dictionary_spans(
            F.col("clean"), list(models.heads), list(models.tails),
            hits_of if counted else None, even)
        ).where("size(_told.spans) > 0")
        spans = F.col("_told.spans")
    else:
        scored = scoring.score_words(clean, models.tagger, batch=models.batch)
        words, labels = scoring.token_labels()
        spans = tk.bio_spans(words, labels)
        tagged = scored
        if models.scorer is None:
            tagged, spans = computed(tagged, "_spans", spans).where("size(_spans) > 0"), F.col("_spans")
            tagged = computed(tagged, "hits", hits_of(tk.split_words(F.lower("clean"))))
            counted = ["hits"]
    told = []
    if models.scorer is None:
        told = ["hits"] if hits else [tk.label_of_hits(F.col("hits")).alias("label")]
    rows = tagged.select(
        "ord", "product", F.col("text").alias("review_text"), "time_text",
        F.col("clean").alias("sentence"), *counted, *keep,
        F.posexplode(spans).alias("i", "span"))
    packed = F.shiftleft("ord", S.MENTION_BITS) + F.col("i")
    fits = (F.col("ord") < (1 << S.REVIEW_ORD_BITS)) & (F.col("i") < (1 << S.MENTION_BITS))
    return rows.select(
        F.when(fits, packed).otherwise(
            F.raise_error(F.lit("review position or mention count too large"))).alias("ord"),
        "product", "review_text", "time_text", "sentence", *told, *keep,
        F.col("span.display").alias("aspect_raw"), F.col("span.seg").alias("term"))


def score_mentions(pairs: DataFrame, models: Models) -> DataFrame:
    """Add ``polarity`` to the pairs; without a scorer it is told from their ``hits``."""
    if models.scorer is None:
        scored = pairs.withColumn("label", tk.label_of_hits(F.col("hits")))
    else:
        scored = scoring.score_pairs(pairs, models.scorer, batch=models.batch)
    return scored.withColumn("polarity", tx.polarity_code(F.col("label")))


def extract_opinions(
    reviews: DataFrame,
    taxonomy: DataFrame,
    blacklist: DataFrame,
    models: Models,
    fuzzy: bool = True,
    clean: bool = True,
    memo: TermMemo | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The opinion table of ``reviews`` (ord, product, text, time_text), with the columns
    ``keep`` of theirs.

    With ``clean`` False the text is tagged as it is. Mentions that match no keyword come
    without a category; ``build_pairs`` drops them, and only its pairs are
    scored. Python models run once: their mentions are
    settled, because fuzzy matching reads them twice. ``memo`` keeps fuzzy matches for
    later runs.
    """
    if clean:
        ready = clean_reviews(reviews)
    else:
        blank = F.coalesce("text", F.lit(""))
        ready = non_empty_reviews(
            spread_small(reviews, "ord").withColumn("clean", tx.strip_edges(blank)))
    mentions = tag_mentions(ready, models, keep, even=clean, hits=True)
    if fuzzy and (models.tagger is not None or models.segmenter is not None):
        mentions = settle(mentions)
    pairs = build_pairs(normalize_aspects(
        mentions, taxonomy, blacklist, fuzzy=fuzzy,
        matcher=memo.categories if memo else fuzzy_match, unmatched=True))
    return score_mentions(pairs, models).select(
        *[f.name for f in S.OPINIONS.fields], *keep)


def score_one(
    spark: SparkSession,
    text: str | None,
    taxonomy: DataFrame,
    blacklist: DataFrame,
    models: Models,
    clean: bool = True,
) -> DataFrame:
    """Opinions of a single sentence; none for anything but non-blank text."""
    usable = isinstance(text, str) and bool(text.strip())
    rows = [(0, S.DEFAULT_PRODUCT, text, "")] if usable else []
    return extract_opinions(
        spark.createDataFrame(rows, S.REVIEWS), taxonomy, blacklist, models, clean=clean
    ).select("category", "aspect_raw", "polarity")
