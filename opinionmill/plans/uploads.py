"""From an uploaded file to its stored opinions, without repeating earlier work."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionmill.operators.taxonomy import validate_categories
from opinionmill.plans.extract import Models, extract_opinions
from opinionmill.plans.scale import settle
from opinionmill.sources import reviews as rv
from opinionmill.sources.memo import TermMemo
from opinionmill.sources.store import OpinionStore, file_key


@dataclass(frozen=True)
class Upload:
    """The opinions of an input, its key, and whether they were stored before."""

    opinions: DataFrame
    cache_key: str
    reused: bool


def file_keys(spark: SparkSession, paths: list[str], roles: rv.Roles) -> DataFrame:
    """``(path, cache_key)``: the key that each file has as an upload of its own."""
    return file_key(spark, paths, roles).select("path", F.md5("cache_key").alias("cache_key"))


def upload_key(spark: SparkSession, path: str | list[str], roles: rv.Roles) -> str:
    """One key for all files of an input and the columns chosen from it."""
    keys = file_key(spark, path, roles).agg(F.array_sort(F.collect_list("cache_key")).alias("k"))
    return keys.select(F.md5(F.array_join("k", "|"))).first()[0]  # a short text for each file


def analyse_upload(
    spark: SparkSession,
    path: str | list[str],
    roles: rv.Roles,
    taxonomy: DataFrame,
    blacklist: DataFrame,
    models: Models,
    store: OpinionStore,
    name: str | None = None,
    fuzzy: bool = True,
    memo: TermMemo | None = None,
    now: datetime | None = None,
) -> Upload:
    """Read a CSV input, extract and store its opinions, and enter it in the ledger.

    An input whose files and roles were analysed before is not read again: its stored
    opinions are reused, unless they hold categories that ``taxonomy`` no longer knows.
    Empty and repeated rows do not count. Either way the input becomes the latest one.
    With ``memo`` terms that earlier inputs had are not matched anew.
    """
    key = upload_key(spark, path, roles)
    stored = store.read(key)
    reused = store.holds(key) and (
        stored.isEmpty() or bool(validate_categories(stored, taxonomy).first()["valid"]))
    if reused:
        known = store.history().where(F.col("hash") == key)
        rows = known.agg(F.max_by("rows", "seq")).first()[0] or 0
    else:
        # read once: the rows are counted, extracted from, and read again by fuzzy matching
        raw = settle(rv.dedupe_rows(rv.drop_empty_rows(rv.read_reviews(spark, path))))
        store.write(extract_opinions(
            rv.bind_roles(raw, roles), taxonomy, blacklist, models, fuzzy=fuzzy, memo=memo), key)
        rows, stored = raw.count(), store.read(key)
    label = name or (path if isinstance(path, str) else path[0]).rstrip("/").rpartition("/")[2]
    store.append_history(spark.createDataFrame(
        [(0, label, now or datetime.now(), rows, key)],
        "batch bigint, name string, ts timestamp, rows bigint, hash string"))
    return Upload(stored, key, reused)


def analyse_new_uploads(
    spark: SparkSession,
    keys: dict[str, str],
    roles: rv.Roles,
    taxonomy: DataFrame,
    blacklist: DataFrame,
    models: Models,
    store: OpinionStore,
    fuzzy: bool = True,
    memo: TermMemo | None = None,
    now: datetime | None = None,
) -> None:
    """Analyse CSV files that the store does not hold, each as an upload of its own.

    ``keys`` (some hundred at most) gives the key of each path, as from ``file_keys``. Files
    with the same columns are read, cleaned, matched and stored together, in one pass
    whatever their number; repeated rows count within a file only. The ledger gets an
    entry for each, in the order of the paths. Nothing is stored if a file has not the
    columns of ``roles``.
    """
    headers: dict[tuple[str, ...], list[str]] = {}
    for path in sorted(keys):
        headers.setdefault(tuple(rv.csv_columns(spark, unquote(path))), []).append(path)
    inputs = []
    for names, paths in headers.items():
        column = next(f"_upload{i}" for i in range(len(names) + 1) if f"_upload{i}" not in names)
        known = spark.createDataFrame([(p, keys[p]) for p in paths], f"path string, {column} string")
        raw = rv.dedupe_rows(rv.drop_empty_rows(rv.read_each_csv(
            spark, [unquote(p) for p in paths], list(names), known, column), (column,)))
        rv.bind_roles(raw, roles)  # fails without the columns
        inputs.append((raw, column, paths))
    rows: dict[str, int] = {}
    for raw, column, paths in inputs:
        raw = settle(raw)
        found = extract_opinions(
            rv.bind_roles(raw, roles, keep=(column,)), taxonomy, blacklist, models, fuzzy=fuzzy,
            memo=memo, keep=(column,))
        store.write(found.withColumnRenamed(column, "cache_key"), [keys[p] for p in paths])
        rows |= {r[column]: r["count"] for r in raw.groupBy(column).count().collect()}
    at = now or datetime.now()
    entries = [(i, unquote(path).rpartition("/")[2], at, rows.get(keys[path], 0), keys[path])
               for i, path in enumerate(sorted(keys))]
    store.append_history(spark.createDataFrame(
        entries, "batch bigint, name string, ts timestamp, rows bigint, hash string"))
