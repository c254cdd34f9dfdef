"""Token steps on long-form tables: one row per subword or word."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinionmill import schema as S
from opinionmill.functions import tokens as tk

_CHUNK = 512  # words handled by one window of bio_spans


def explode_words(df: DataFrame, text: str = "text", key: str = "sent_id") -> DataFrame:
    """``(sent_id, word_id, word)`` from whitespace-separated text."""
    return df.select(
        key, F.posexplode(tk.split_words(F.col(text))).alias("word_id", "word"))


def argmax_labels(tokens: DataFrame) -> DataFrame:
    """Add ``label`` from ``logits``."""
    return tokens.withColumn("label", tk.label_name(tk.argmax(F.col("logits"))))


def truncate_subwords(tokens: DataFrame, max_len: int = S.MAX_TOKENS) -> DataFrame:
    """Keep what fits between the two sentence markers. ``pos`` is data, so this
    is a filter that reaches the scan."""
    return tokens.where(
        (F.col("pos") <= max_len - 2) | F.col("word_id").isNull())


def first_subword_label(tokens: DataFrame) -> DataFrame:
    """``(sent_id, word_id, label)``: the label of each word's first subword.

    Position and class share one LONG, so the aggregate keeps fixed-width
    state and combines before the shuffle.
    """
    packed = F.shiftleft(F.col("pos").cast("bigint"), 16) + tk.argmax(F.col("logits"))
    return (
        tokens.where("word_id is not null")
        .groupBy("sent_id", "word_id").agg(F.min(packed).alias("p"))
        .select(
            "sent_id", "word_id",
            tk.label_name(F.col("p").bitwiseAND(F.lit(0xFFFF)).cast("int")).alias("label"))
    )


def align_words_labels(words: DataFrame, labels: DataFrame) -> DataFrame:
    """Words with their labels; words without one (as past a truncation) drop out."""
    return words.join(labels, ["sent_id", "word_id"])


def bio_spans(labelled: DataFrame) -> DataFrame:
    """``(sent_id, start, display, seg)`` from long-form labelled words.

    For every word the last B and the last O so far are needed. Running maxima
    are taken inside chunks of ``_CHUNK`` words and carried over between chunk
    summaries, so one endless sentence is still shared by many tasks.
    """
    chunked = labelled.select(
        "sent_id", "word_id", "word", F.substring("label", 1, 1).alias("l"),
        F.floor(F.col("word_id") / _CHUNK).cast("int").alias("chunk"))
    is_b = F.when(F.col("l") == "B", F.col("word_id"))
    is_o = F.when(F.col("l") == "O", F.col("word_id"))
    inside = (
        Window.partitionBy("sent_id", "chunk").orderBy("word_id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    running = chunked.withColumn("b", F.max(is_b).over(inside)).withColumn(
        "o", F.max(is_o).over(inside))
    before = (
        Window.partitionBy("sent_id").orderBy("chunk")
        .rowsBetween(Window.unboundedPreceding, -1))
    carried = (
        chunked.groupBy("sent_id", "chunk")
        .agg(F.max(is_b).alias("cb"), F.max(is_o).alias("co"))
        .select("sent_id", "chunk", F.max("cb").over(before).alias("pb"),
                F.max("co").over(before).alias("po"))
        # a sentence of one chunk has nothing to carry
        .where("chunk > 0 and (pb is not null or po is not null)")
    )
    open_at = (
        running.join(carried, ["sent_id", "chunk"], "left")
        .withColumn("b", F.coalesce("b", "pb"))
        .withColumn("o", F.coalesce("o", "po"))
        .where("l in ('B', 'I') and b is not null and (o is null or o < b)")
    )
    seg = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("word_id", "word"))),
            lambda w: w["word"]),
        " ")
    return (
        open_at.groupBy("sent_id", F.col("b").alias("start")).agg(seg.alias("seg"))
        .select("sent_id", "start",
                F.trim(F.translate("seg", "_", " ")).alias("display"), "seg")
        .where(F.length("display") >= 2)
    )


def build_pairs(aspects: DataFrame) -> DataFrame:
    """``(sentence, term)`` pairs to score: categorised aspects only."""
    return aspects.where("category is not null")
