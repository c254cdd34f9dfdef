"""From raw documents to encoded training documents, in five written stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionmill.llm import line_dedup, mixing, near_dups, pieces, quality_rules
from opinionmill.llm.tables import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is high enough.

    Null, empty and very short texts fail a base rule and go; every row is judged by its
    own text, so repeated rows and null ids are treated alike. No rows give no rows.
    """
    return quality_rules.quality_rules(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document or line has (nearly) too.

    Documents that lose lines and have no word left go; ones that had none before stay as
    they are, null texts too. Null ids come last, see ``line_dedup`` for repeated ones.
    ``n_chars`` is that of the new text.
    """
    lost = next(f"lost{i}" for i in range(len(docs.columns) + 1) if f"lost{i}" not in docs.columns)
    kept = line_dedup.dedup_lines(docs, count_as=lost)
    emptied = (F.col(lost) > 0) & ~F.col("text").rlike(r"[^ \t\n\x0B\f\r]")
    return kept.where(~emptied).drop(lost).withColumn(
        "n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is alike in its five-word shingles.

    The smallest id stays, with all rows that repeat it; null ids and texts without words
    stay. Judged on what the lines stage leaves, which takes most near copies apart.
    """
    return near_dups.drop_near_dups(docs, width=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target rate asks for.

    Repeated rows of an id, and all null ids, share one draw; a null source is a source of
    its own; texts without words weigh nothing and are drawn like the rest of their source.
    """
    return mixing.mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, one row a row; null and empty texts have none."""
    return pieces.encode_pieces(docs)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("mix", mix), ("encode", encode)]

#: The last stage segments by an automaton and the third by set similarity over what
#: the others leave; tests/llm compares every stage with SQL or brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
