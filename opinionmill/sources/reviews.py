"""Reading review tables and giving every row a fixed position."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionmill import schema as S
from opinionmill.functions import text as tx
from opinionmill.functions.once import computed
from opinionmill.plans.scale import lookup_join, rank_rows, spread_small
from opinionmill.sources.lines import records_of_files


@dataclass(frozen=True)
class Roles:
    """Which columns hold the review text, the product and the date."""

    text: str
    product: str | None = None
    date: str | None = None


def _packed(high: Column, high_count: int, low: Column) -> Column:
    """``high`` and ``low`` in one LONG of ``REVIEW_ORD_BITS`` bits."""
    low_bits = S.REVIEW_ORD_BITS - max(1, (max(high_count, 1) - 1).bit_length())
    fits = low < F.lit(1 << low_bits)
    return F.when(fits, F.shiftleft(high.cast("bigint"), low_bits) + low).otherwise(
        F.raise_error(F.lit("a file or split holds too many rows to number")))


def _with_ord(df: DataFrame, row_in_file: Column) -> DataFrame:
    """Number rows by (file name, row in file)."""
    paths = sorted(df.inputFiles())
    row = row_in_file.alias("_row")
    if len(paths) <= 1:
        return df.select("*", row).withColumn(
            "ord", _packed(F.lit(0), 1, F.col("_row"))).drop("_row")
    spark = df.sparkSession
    files = spark.createDataFrame(list(zip(paths, range(len(paths)))), "_path string, _file long")
    placed = df.select("*", row, F.input_file_name().alias("_path"))
    joined = lookup_join(placed, files, "_path", spread=F.xxhash64("_row"))
    number = F.coalesce("_file", F.raise_error(F.lit("input file not in the listing")))
    return joined.withColumn("ord", _packed(number, len(paths), F.col("_row"))).drop(
        "_row", "_path", "_file")


_CSV = {"escape": '"', "multiLine": "true"}


def csv_columns(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The column names that Spark's reader takes from the first header."""
    return spark.read.option("header", True).options(**_CSV).csv(path).columns


def _csv_cells(names: list[str]) -> Column:
    return F.from_csv("text", ", ".join(f"c{i} string" for i in range(len(names))), _CSV).alias("cells")


def _read_csv(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """The files as Spark's reader names their columns, and their numbered rows."""
    raw = spark.read.option("header", True).options(**_CSV).csv(path)
    names = raw.columns
    records, paths = records_of_files(spark, path)
    files = rank_rows(paths, ["path"], "_file")
    rows = lookup_join(records.where("record > 0"), files, "path", "inner", spread=F.col("record"))
    placed = rows.select(_csv_cells(names), _packed(
        F.col("_file"), len(raw.inputFiles()), F.col("record") - 1).alias("ord"))
    return raw, placed.select(
        *[F.col(f"cells.c{i}").alias(name) for i, name in enumerate(names)], "ord")


def read_each_csv(
    spark: SparkSession, paths: list[str], names: list[str], keys: DataFrame, key: str,
    na_tokens: tuple[str, ...] = S.NA_TOKENS,
) -> DataFrame:
    """The rows that ``read_reviews`` finds in each file on its own, and its ``key``.

    All files have the columns ``names``; ``keys`` (path, ``key``) is a row for each.
    """
    records, _ = records_of_files(spark, paths)
    rows = lookup_join(records.where("record > 0"), keys, "path", "inner", spread=F.col("record"))
    placed = rows.select(_csv_cells(names), key, _packed(
        F.lit(0), 1, F.col("record") - 1).alias("ord"))

    def cell(i: int) -> Column:
        text = F.col(f"cells.c{i}")
        return F.when(~text.isin(*na_tokens), text).alias(names[i])

    return placed.select(*[cell(i) for i in range(len(names)) if names[i] != "ord"], key, "ord")


def read_reviews(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "csv",
    na_tokens: tuple[str, ...] = S.NA_TOKENS,
) -> DataFrame:
    """All columns as text, missing-value tokens as null, plus ``ord``.

    A CSV file of any size is read by many tasks, line breaks inside quotes included,
    and its rows are numbered in file order, see ``lines.quoted_records``. JSON Lines are
    numbered in split order rather than line order.
    """
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    if fmt == "csv":
        raw, placed = _read_csv(spark, path)
    elif fmt == "parquet":
        raw = spark.read.parquet(*([path] if isinstance(path, str) else path))
        placed = _with_ord(raw, F.col("_metadata.row_index"))
    elif fmt == "json":
        raw = spark.read.option("primitivesAsString", True).json(path)
        parts = raw.rdd.getNumPartitions()
        placed = raw.withColumn("ord", _packed(F.spark_partition_id(), parts, local))
    else:
        raise ValueError(f"unknown format: {fmt}")
    kept = [c for c in raw.columns if c != "ord"]

    def cell(name: str) -> Column:
        text = F.col(f"`{name}`").cast("string")
        return F.when(~text.isin(*na_tokens), text).alias(name)

    return placed.select(*[cell(c) for c in kept], "ord")


def _data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "ord"]


def drop_empty_rows(df: DataFrame, besides: tuple[str, ...] = ()) -> DataFrame:
    """Drop rows in which every column but ``ord`` and those in ``besides`` is null."""
    return df.na.drop(how="all", subset=[c for c in _data_columns(df) if c not in besides])


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Distinct rows, each keeping its first position.

    Repeats collapse before the shuffle, so many copies of one row stay cheap.
    """
    return df.groupBy(*_data_columns(df)).agg(F.min("ord").alias("ord"))


def load_report(df: DataFrame) -> DataFrame:
    """One row: rows read, and rows left after dropping empty and repeated ones."""
    cols = _data_columns(df)
    filled = F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull()
    row = F.when(filled, F.struct(*cols))
    return df.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.countDistinct(row).alias("rows_kept"))


def bind_roles(
    df: DataFrame,
    roles: Roles,
    default_product: str = S.DEFAULT_PRODUCT,
    missing_product: str = S.UNKNOWN_PRODUCT,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(ord, product, text, time_text)`` from the chosen columns, and ``keep``."""
    def column(name: str) -> Column:
        return F.col(f"`{name}`").cast("string")

    product = (
        F.lit(default_product) if roles.product is None
        else F.coalesce(column(roles.product), F.lit(missing_product)))
    time_text = (
        F.lit("") if roles.date is None else F.coalesce(column(roles.date), F.lit("")))
    return df.select(
        "ord", product.alias("product"), column(roles.text).alias("text"),
        time_text.alias("time_text"), *keep)


def clean_reviews(reviews: DataFrame) -> DataFrame:
    """Add ``clean`` and keep the reviews that still have text."""
    return non_empty_reviews(computed(
        spread_small(reviews, "ord"), "clean", tx.preprocess_text(tx.blank_missing(F.col("text")))))


def non_empty_reviews(df: DataFrame, col: str = "clean") -> DataFrame:
    return df.where(F.length(col) > 0)
