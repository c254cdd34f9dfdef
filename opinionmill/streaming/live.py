"""Scoring reviews, or whole uploaded files, as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opinionmill.plans.extract import Models, extract_opinions
from opinionmill.plans.uploads import analyse_new_uploads, file_keys
from opinionmill.sources.reviews import Roles
from opinionmill.sources.store import OpinionStore, valid_key


def score_stream(
    reviews: DataFrame,
    taxonomy: DataFrame,
    blacklist: DataFrame,
    models: Models,
    store: OpinionStore,
    checkpoint: str,
    prefix: str = "stream",
    fuzzy: bool = True,
) -> StreamingQuery:
    """Extract opinions from a stream of reviews into the store.

    Reviews are independent, so no state is kept. Each micro-batch replaces its
    own partition ``<prefix>-<batch>``: a batch replayed after a failure ends
    up stored once. Stops when the input seen at the start is used up.
    """
    if not valid_key(prefix):
        raise ValueError("prefix may hold letters, digits, _ and - only")

    def save(batch: DataFrame, batch_id: int) -> None:
        opinions = extract_opinions(batch, taxonomy, blacklist, models, fuzzy=fuzzy)
        store.write(opinions, f"{prefix}-{batch_id}")

    return (
        reviews.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def score_uploads(
    spark: SparkSession,
    folder: str,
    roles: Roles,
    taxonomy: DataFrame,
    blacklist: DataFrame,
    models: Models,
    store: OpinionStore,
    checkpoint: str,
    files_per_batch: int = 100,
    fuzzy: bool = True,
) -> StreamingQuery:
    """Analyse CSV files that arrive in ``folder``, each as an upload of its own.

    The stream carries the names of new files only. The keys of a micro-batch's files
    are computed in one job and joined against the store, so that a file whose content
    was analysed before, in a batch run or under another name, is neither parsed nor
    stored again; of equal files that arrive together the first in name order is taken.
    The new files of a micro-batch are analysed together, see ``analyse_new_uploads``.
    A batch replayed after a failure finds what it has stored already.
    """
    arrived = (
        spark.readStream.format("binaryFile").option("pathGlobFilter", "*.csv")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("maxFilesPerTrigger", files_per_batch).load(folder).select("path"))

    def save(batch: DataFrame, batch_id: int) -> None:
        paths = [r["path"] for r in batch.collect()]  # at most files_per_batch
        keys = file_keys(batch.sparkSession, paths, roles).join(
            store.keys().select("cache_key"), "cache_key", "left_anti")
        new = keys.groupBy("cache_key").agg(F.min("path").alias("path"))
        found = {r["path"]: r["cache_key"] for r in new.collect()}
        if found:
            analyse_new_uploads(
                batch.sparkSession, found, roles, taxonomy, blacklist, models, store, fuzzy=fuzzy)

    return (
        arrived.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
