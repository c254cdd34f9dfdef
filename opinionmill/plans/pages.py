"""Ranked rows written once, of which any page is read from the one or two files it is in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_ranked(rows: DataFrame, order_by: list[Column], path: str) -> None:
    """Write ``rows`` in order: each file holds a range of it, an index how many rows.

    A range sort, so every task writes its range in order and no task holds more than one.
    """
    ranges = F.spark_partition_id().alias("_range")
    spark = rows.sparkSession
    rows.orderBy(*order_by).select("*", ranges).write.parquet(f"{path}/rows")
    # ranges are numbered in order; one that was cut into several files is so by its name
    files = spark.read.parquet(f"{path}/rows").groupBy(
        "_range", F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    files.write.parquet(f"{path}/index")


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(file, first row, rows) in order; an entry for each file."""
    rows = spark.read.parquet(f"{path}/index").orderBy("_range", "file").collect()
    out, start = [], 0
    for r in rows:
        out.append((r["file"], start, r["n"]))
        start += r["n"]
    return out


def ranked_page(
    spark: SparkSession, path: str, page: int = 1, size: int = 10, past_end: str = "last"
) -> DataFrame:
    """A page of rows stored by ``write_ranked``, with ``row`` (from 0), ``found``,
    ``pages`` and ``page``; ``past_end`` says which page stands in for one beyond the end.

    Only the files that hold rows of the page are read, however deep it lies.
    """
    files = _files(spark, path)
    found = sum(n for _, _, n in files)
    pages = max(1, -(-found // size))
    page = max(page, 1)
    if page > pages:
        page = 1 if past_end == "first" else pages
    low, high = (page - 1) * size, page * size
    empty = spark.read.parquet(f"{path}/rows")
    wanted = [(f, start) for f, start, n in files if start < high and start + n > low]
    starts = F.create_map(*[F.lit(x) for f, start in wanted for x in (f, start)]) if wanted else None
    rows = (spark.read.schema(empty.schema).parquet(*[f for f, _ in wanted]).withColumn(
        "row", starts[F.col("_metadata.file_path")] + F.col("_metadata.row_index"))
        if wanted else empty.withColumn("row", F.lit(0).cast("bigint")).limit(0))
    return rows.drop("_range").where((F.col("row") >= low) & (F.col("row") < high)).select(
        "*", F.lit(found).cast("bigint").alias("found"), F.lit(pages).alias("pages"), F.lit(page).alias("page"))
