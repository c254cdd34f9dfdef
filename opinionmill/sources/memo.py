"""Fuzzy matches kept between runs, for as long as the dictionary stays the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionmill import schema as S
from opinionmill.operators.taxonomy import fuzzy_match
from opinionmill.plans.scale import lookup_join
from opinionmill.sources.commits import CommitLog, read_or_empty

_TERMS = "s string, category string"


def dictionary_digest(taxonomy: DataFrame, cutoff: float, band: int) -> str:
    """A digest of everything a match depends on; the order of the rows does not count."""
    row = F.md5(F.concat_ws("\u0001", *[
        F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("category", "keyword", "kw_ord")]))
    halves = [F.sum(F.conv(F.substring(row, at, 12), 16, 10).cast("decimal(38,0)")).cast("string")
              for at in (1, 13)]
    return taxonomy.agg(F.md5(F.concat_ws(
        "|", F.count(F.lit(1)).cast("string"), *[F.coalesce(h, F.lit("")) for h in halves],
        F.lit(str(cutoff)), F.lit(str(band))))).first()[0]


class TermMemo:
    """Terms with the category a fuzzy match gave them, or null for none.

    Each dictionary has a table of its own, named by its digest, so another dictionary or
    cutoff starts afresh. A run matches only the terms that are not there yet and adds
    them in one commit; runs at the same time may add a term twice, with the same result.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def known(self, digest: str) -> DataFrame:
        log = CommitLog(self.spark, f"{self.root}/{digest}/log")
        rows = read_or_empty(self.spark, f"{self.root}/{digest}/terms", f"{_TERMS}, commit string")
        done = lookup_join(rows, log.entries().select("commit"), "commit", "inner")
        return done.groupBy("s").agg(F.max("category").alias("category"))

    def categories(
        self, terms: DataFrame, taxonomy: DataFrame,
        cutoff: float = S.FUZZY_CUTOFF, band: int = S.LENGTH_BAND,
    ) -> DataFrame:
        """``(s, category)`` of the distinct ``s`` of ``terms`` that match a keyword."""
        digest = dictionary_digest(taxonomy, cutoff, band)
        commit = uuid.uuid4().hex
        path, asked = (f"{self.root}/{digest}/{name}" for name in (
            f"terms/commit={commit}", f"asked/{commit}"))

        def written(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{asked}/{name}")
            return self.spark.read.schema("s string").parquet(f"{asked}/{name}")

        # all terms first and then the new ones, so that neither is computed twice
        wanted = written(terms.select("s").where("s is not null").distinct(), "all")
        new = written(wanted.join(self.known(digest), "s", "left_anti"), "new")
        if not new.isEmpty():
            found = fuzzy_match(new, taxonomy, cutoff, band).select("s", "category")
            new.join(found, "s", "left").write.parquet(path)
            CommitLog(self.spark, f"{self.root}/{digest}/log").append(commit, "terms", 0)
        return wanted.join(self.known(digest).where("category is not null"), "s")
