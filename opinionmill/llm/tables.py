"""Steps that are written once and read by several later ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionmill.plans.scale import shared_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the session's shared folder and read it back.

    Cuts lineage in files that every executor can read again after a loss.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """``docs`` as one column ``row`` besides the named ones, so that no name can clash."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    return docs.select(row.alias("row"), *[v.alias(k) for k, v in columns.items()])


def unpacked(docs: DataFrame, **replaced: Column) -> list[Column]:
    """The columns of ``docs`` from ``row``, those named with other values."""
    return [(replaced[c] if c in replaced else F.col(f"row.c{i}")).alias(c)
            for i, c in enumerate(docs.columns)]
