"""Stored opinion tables, one per input, and the ledger of inputs."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionmill import schema as S
from opinionmill.operators.metrics import tally
from opinionmill.operators.taxonomy import validate_categories
from opinionmill.plans.scale import lookup_join
from opinionmill.sources.commits import CommitLog, read_or_empty
from opinionmill.sources.lines import numbered_lines
from opinionmill.sources.reviews import Roles

_CUBE = ("cache_key string, product string, category string, total bigint, pos bigint, neg bigint, "
         "first_ord bigint, commit string")
KEY_PATTERN = re.compile(r"[\w-]+")


def _role_names(roles: Roles) -> tuple[str, str, str]:
    return (
        roles.text,
        roles.product or S.NO_PRODUCT_COLUMN,
        roles.date or S.NO_DATE_COLUMN,
    )


def content_key(spark: SparkSession, path: str, roles: Roles) -> DataFrame:
    """``(path, cache_key)``: MD5 of each file's bytes followed by the role names.

    Each file passes through one cell, so this is for files below 2 GB; ``file_key`` takes
    files of any size.
    """
    names = [F.encode(F.lit(n), "UTF-8") for n in _role_names(roles)]
    return (
        spark.read.format("binaryFile").load(path)
        .select("path", F.md5(F.concat("content", *names)).alias("cache_key")))


def _digest_part(digest: Column, start: int, size: int = 12) -> Column:
    return F.conv(F.substring(digest, start, size), 16, 10).cast("decimal(38,0)")


def _row_digest(columns: list[str]) -> Column:
    """MD5 of all values, each led by its length so that values cannot run together;
    a null differs from every value."""
    def told(name: str) -> Column:
        value = F.col(f"`{name}`").cast("string")
        return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.md5(F.concat(*[told(c) for c in columns]))


def table_key(rows: DataFrame, by: str, roles: Roles) -> DataFrame:
    """``(by, rows, cache_key)`` for inputs held as rows of one large table.

    Row digests are summed instead of strung together: the sum combines on the
    map side and does not depend on partitioning. Every column but ``by`` is part of
    each row's digest, the position ``ord`` too, so row order still matters.
    """
    columns = sorted(c for c in rows.columns if c != by)
    digest = _row_digest(columns)
    sums = (
        rows.select(by, digest.alias("d"))
        .groupBy(by).agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(_digest_part(F.col("d"), 1)).alias("a"),
            F.sum(_digest_part(F.col("d"), 13)).alias("b"),
            F.sum(_digest_part(F.col("d"), 25, 8)).alias("c"))
    )
    parts = [F.col(c).cast("string") for c in ("rows", "a", "b", "c")]
    names = [F.lit(n) for n in (*columns, *_role_names(roles))]
    return sums.select(
        by, "rows", F.md5(F.concat_ws("|", *parts, *names)).alias("cache_key"))


def file_key(spark: SparkSession, path: str | list[str], roles: Roles) -> DataFrame:
    """``(path, rows, cache_key)`` for text files of any size: ``table_key`` of their lines.

    A file is digested in byte ranges by many tasks. Lines keep their number and all their
    bytes; only whether the last one ends in a line feed makes no difference.
    """
    lines = numbered_lines(spark, path).withColumnRenamed("line", "ord")
    return table_key(lines, "path", roles)


def valid_key(key: str) -> bool:
    return bool(KEY_PATTERN.fullmatch(key))


# ----------------------------------------------------------------------- ledger


def _ledger_columns() -> list[Column]:
    return [
        F.col("name"), F.date_format("ts", "dd/MM/yyyy HH:mm").alias("date"),
        F.col("rows").cast("bigint").alias("rows"), F.col("hash")]


def new_entries(uploads: DataFrame, history: DataFrame) -> DataFrame:
    """Ledger rows for ``uploads`` (batch, name, ts, rows, hash), numbered after
    the rows already there; ``batch`` is a unique LONG from 0."""
    last = history.agg(F.coalesce(F.max("seq"), F.lit(0))).scalar()
    return uploads.select(
        (last + F.col("batch") + 1).cast("bigint").alias("seq"), *_ledger_columns())


def skip_processed(batch: DataFrame, history: DataFrame) -> DataFrame:
    """``batch`` (one row per input, with ``hash``) with ``status`` new / cached."""
    known = history.select("hash", F.lit(True).alias("_seen")).where(
        "hash is not null").distinct()
    return lookup_join(batch, known, "hash").withColumn(
        "status", F.when(F.col("_seen"), "cached").otherwise("new")).drop("_seen")


def history_view(history: DataFrame) -> DataFrame:
    """Newest first, with a safe key and whether a stored result can be opened."""
    safe = F.regexp_replace(F.coalesce("hash", F.lit("")), "[^a-zA-Z0-9_-]", "")
    return history.select(
        "seq", "name", "date", "rows", safe.alias("key"),
        (F.length(safe) > 0).alias("can_open"),
    ).orderBy(F.desc("seq"))


def latest_key(history: DataFrame) -> DataFrame:
    return history.agg(F.max_by("hash", "seq").alias("hash"))


def _ddl(schema, **more: str) -> str:
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in schema.fields]
    return ", ".join([*fields, *(f"{k} {v}" for k, v in more.items())])


class OpinionStore:
    """Opinion tables under one folder, each under its ``cache_key``.

    Every change writes files of its own first and then becomes one entry of a commit
    log, at a number that no other entry has. Readers only look at what the log names, so
    they see a change whole or not at all, and see tables that are being replaced as they
    were. The order of the log also numbers the ledger, whoever writes at the same time.
    The latest result is a row of the ledger, not a second copy of the data.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.opinions_path = f"{self.root}/opinions"
        self.keys_path = f"{self.root}/keys"
        self.cubes_path = f"{self.root}/cubes"
        self.history_path = f"{self.root}/history"
        self.log = CommitLog(spark, f"{self.root}/log")

    # opinions

    def write(self, opinions: DataFrame, cache_key: str | list[str] | None = None) -> None:
        """Store opinions; with ``cache_key`` None or a list the frame brings the column.

        Tables of the same keys are replaced, by an empty one too if ``cache_key`` names
        it. Rows stay where they were computed: one large input is written by many tasks.
        Those of a list of keys are dealt by key, large ones cut, so that not every task
        writes a file for every key.
        """
        named = [cache_key] if isinstance(cache_key, str) else cache_key or []
        if not all(valid_key(k) for k in named):
            raise ValueError("cache key may hold letters, digits, _ and - only")
        if isinstance(cache_key, str):
            opinions = opinions.withColumn("cache_key", F.lit(cache_key))
        else:
            key = F.col("cache_key")
            opinions = opinions.withColumn("cache_key", F.when(
                key.rlike("^[A-Za-z0-9_-]+$"), key).otherwise(F.raise_error(F.lit(
                    "cache key may hold letters, digits, _ and - only"))))
            if named:
                opinions = opinions.hint("rebalance", F.col("cache_key"))
        commit = uuid.uuid4().hex
        cols = [f.name for f in S.OPINIONS.fields]
        (
            opinions.select(*cols, "cache_key")
            .write.partitionBy("cache_key").parquet(f"{self.opinions_path}/commit={commit}"))
        # counts of the new rows alone; they tell the keys and are merged by ``cube``
        cubes = f"{self.cubes_path}/commit={commit}"
        tally(self._stored().where(F.col("commit") == commit), "cache_key", "product", "category"
              ).write.parquet(cubes)
        keys = self.spark.read.schema("cache_key string, total bigint").parquet(cubes).groupBy(
            "cache_key").agg(F.sum("total").alias("rows"))
        if named:
            listed = self.spark.createDataFrame([(k,) for k in named], "cache_key string")
            keys = listed.join(keys, "cache_key", "full").fillna(0, "rows")
        keys.write.parquet(f"{self.keys_path}/commit={commit}")
        self.log.append(commit, "write", 0)

    def _stored(self) -> DataFrame:
        """Rows of all commits, those under way and replaced ones too."""
        return read_or_empty(self.spark, self.opinions_path, _ddl(
            S.OPINIONS, commit="string", cache_key="string"))

    def keys(self) -> DataFrame:
        """``(cache_key, rows, commit)`` of the tables that stand."""
        said = read_or_empty(
            self.spark, self.keys_path, "cache_key string, rows bigint, commit string")
        # each key has a row per commit that wrote or removed it
        said = lookup_join(said, self.log.entries().select("commit", "seq", "kind"), "commit", "inner")
        last = said.groupBy("cache_key").agg(
            F.max_by(F.struct("rows", "commit", "kind"), "seq").alias("last"))
        return last.where("last.kind = 'write'").select("cache_key", "last.rows", "last.commit")

    def all(self) -> DataFrame:
        current = self.keys().select(F.struct("commit", "cache_key").alias("_at"))
        rows = self._stored().withColumn("_at", F.struct("commit", "cache_key"))
        return lookup_join(rows, current, "_at", "inner").drop("_at", "commit")

    def cube(self) -> DataFrame:
        """``opinion_cube`` of all stored tables, from the counts kept with each of them.

        A write counts its own rows only; replaced and removed tables drop out with their
        key. Metrics, rankings and the heatmap read this instead of the opinions.
        """
        current = self.keys().select(F.struct("commit", "cache_key").alias("_at"))
        counts = read_or_empty(self.spark, self.cubes_path, _CUBE).withColumn(
            "_at", F.struct("commit", "cache_key"))
        return tally(lookup_join(counts, current, "_at", "inner"), "product", "category")

    def read(self, cache_key: str) -> DataFrame:
        """One stored result, from its own folder; without rows if there is none."""
        at = self.keys().where(F.col("cache_key") == cache_key).first()
        if at is None:
            return self.spark.createDataFrame([], S.OPINIONS)
        return read_or_empty(
            self.spark, f"{self.opinions_path}/commit={at['commit']}/cache_key={cache_key}", _ddl(S.OPINIONS))

    def holds(self, cache_key: str) -> bool:
        return not self.keys().where(F.col("cache_key") == cache_key).isEmpty()

    def latest(self) -> DataFrame:
        """The result of the newest ledger entry."""
        row = self._entries().agg(F.max_by("hash", F.struct("commit_seq", "seq")).alias("hash")).first()
        return self.read(row["hash"] or "")

    def load(self, cache_key: str, taxonomy: DataFrame) -> DataFrame:
        """Reopen a stored result after checking its key and its categories.

        A valid one becomes the latest again.
        """
        if not valid_key(cache_key):
            raise ValueError("not a cache key")
        opinions = self.read(cache_key)
        if not validate_categories(opinions, taxonomy).first()["valid"]:
            raise ValueError("stored result is missing or uses unknown categories")
        entry = (
            self.history().where(F.col("hash") == cache_key)
            .orderBy(F.desc("seq")).limit(1).drop("seq"))
        if entry.isEmpty():  # stored without a ledger row: point to it all the same
            entry = self.spark.createDataFrame(
                [(0, cache_key, "", opinions.count(), cache_key)], S.HISTORY).drop("seq")
        self._append(entry.withColumn("place", F.lit(0).cast("bigint")))
        return opinions

    def forget_latest(self) -> None:
        """Until the next entry or ``load`` there is no latest result."""
        self._append(self.spark.createDataFrame(
            [("", "", 0, None, 0)], "name string, date string, rows bigint, hash string, place bigint"),
            "reset")

    # ledger

    def history(self) -> DataFrame:
        """The ledger; entries are numbered in the order of the commits."""
        return self._entries().where("kind = 'history'").select(*[f.name for f in S.HISTORY.fields])

    def _entries(self) -> DataFrame:
        rows = read_or_empty(self.spark, self.history_path, _ddl(
            S.HISTORY, place="bigint", commit="string")).drop("seq")
        return lookup_join(rows, self.log.entries().select(
            "commit", "kind", "before", F.col("seq").alias("commit_seq")), "commit", "inner").withColumn(
                "seq", F.col("before") + F.col("place") + 1)

    def append_history(self, uploads: DataFrame) -> None:
        """Ledger rows for ``uploads`` (batch, name, ts, rows, hash); ``batch`` is a unique
        LONG from 0."""
        self._append(uploads.select(*_ledger_columns(), F.col("batch").cast("bigint").alias("place")))

    def _append(self, entries: DataFrame, kind: str = "history") -> None:
        commit = uuid.uuid4().hex
        path = f"{self.history_path}/commit={commit}"
        entries.write.parquet(path)
        n = self.spark.read.schema("place bigint").parquet(path).agg(F.max("place")).first()[0]
        if n is not None:
            self.log.append(commit, kind, n + 1 if kind == "history" else 0)

    # upkeep

    def stale_keys(self, taxonomy: DataFrame) -> DataFrame:
        """Keys of stored results that use unknown categories."""
        return (
            validate_categories(self.all(), taxonomy, ["cache_key"])
            .where("not valid").select("cache_key"))

    def purge_stale(self, taxonomy: DataFrame) -> list[str]:
        """Remove stale results, all in one commit; returns the keys that are gone."""
        commit = uuid.uuid4().hex
        path = f"{self.keys_path}/commit={commit}"
        self.stale_keys(taxonomy).withColumn("rows", F.lit(0).cast("bigint")).write.parquet(path)
        gone = self.spark.read.schema("cache_key string").parquet(path)
        keys = [r["cache_key"] for r in gone.toLocalIterator()]
        if keys:
            self.log.append(commit, "remove", 0)
        return keys

    def vacuum(self) -> int:
        """Delete the files of commits of which no table stands any more; their number.

        For times without readers of older states.
        """
        live = self.keys().select("commit").distinct()
        old = self.log.entries().where("kind = 'write'").select("commit").join(live, "commit", "left_anti")
        n = 0
        for row in old.toLocalIterator():
            self.log.delete(f"{self.cubes_path}/commit={row['commit']}")
            n += self.log.delete(f"{self.opinions_path}/commit={row['commit']}")
        self.spark.catalog.refreshByPath(self.opinions_path)
        return n
