"""Helpers for inputs whose size or skew is not known when the plan is written.

``bounded_rows`` / ``within`` check a size before anything is broadcast or
inlined; ``lookup_join`` salts instead of broadcasting beyond that size;
``global_index`` numbers rows of any amount; ``order_statistics`` and
``order_statistics_near`` find exact positions without sorting.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
INLINE_ROWS = 4_096
TOP_ROWS = 10_000
SALTS = 64


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the session.

    Without a name only a local session, whose tasks run on the same machine, gets a
    temporary one; on a cluster that would be a folder executors cannot see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="opinionmill-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut lineage through the shared checkpoint folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def _session_tasks(spark: SparkSession) -> int:
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over as many tasks as the session shuffles into.

    For rows of few bytes and much work each: the partition sizes adaptive
    execution aims at would leave that work to one task.
    """
    return df.repartition(_session_tasks(df.sparkSession), key)


def spread_small(df: DataFrame, key: str, split: int | None = None) -> DataFrame:
    """``spread`` an input so small that its splits leave cores idle.

    An input with at least one full split per core keeps its partitioning and
    is not shuffled. Streams are left alone. ``split`` is the bytes of a split that is
    worth no shuffle, for little work a row less than the largest one.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    split = split or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes"))
    # bytes of the tables read, not the plan's own estimate, which multiplies joins
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(
        int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= split * spark.sparkContext.defaultParallelism:
        return df
    return spread(df, key)


def within(df: DataFrame, max_rows: int) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_rows(df: DataFrame, max_rows: int = INLINE_ROWS) -> list[Row] | None:
    """All rows when there are at most ``max_rows`` of them, else None."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    spread: Column | None = None,
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join to a table with one row per ``key``.

    A right side of checked size is broadcast. Otherwise each left key is cut
    into ``salts`` slices by ``spread`` and the right side repeated once per
    slice, so a key holding a third of the rows is shared by many tasks.
    """
    if within(right, max_rows):
        return left.join(F.broadcast(right), key, how)
    if spread is None:
        spread = F.xxhash64(*[F.col(c) for c in left.columns])
    salted_left = left.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    salted_right = right.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")


def global_index(df: DataFrame, order_by: list, name: str = "pos") -> DataFrame:
    """Number all rows 0, 1, 2, … in the given order, on any amount of rows.

    A range sort is settled so its partitions stay as they are; the offset of
    each partition is then added to the row's place inside it. The driver sees
    one count per partition.
    """
    placed = settle(df.orderBy(*order_by))
    spot = F.monotonically_increasing_id()
    counts = {
        r["_part"]: r["count"]
        for r in placed.select(F.spark_partition_id().alias("_part"))
        .groupBy("_part").count().collect()
    }
    last = max(counts, default=-1)
    sizes = [counts.get(i, 0) for i in range(last + 1)]
    offsets = [0, *itertools.accumulate(sizes)][: len(sizes)] or [0]
    start = F.element_at(
        F.lit(offsets).cast("array<bigint>"), F.spark_partition_id() + 1)
    inside = spot.bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, start + inside)


def rank_rows(df: DataFrame, order_by: list, name: str = "pos") -> DataFrame:
    """``global_index`` with a shortcut for frames checked to be small."""
    if not within(df, BROADCAST_ROWS):
        return global_index(df, order_by, name)
    return number_few(df, order_by, name)


def number_few(df: DataFrame, order_by: list, name: str = "pos") -> DataFrame:
    """Number rows in one window; only for frames already limited or checked."""
    place = F.row_number().over(Window.partitionBy().orderBy(*order_by)) - 1
    return df.withColumn(name, place.cast("bigint"))


def order_statistics(
    df: DataFrame, column: str, ranks: list[int], fanout: int = 1 << 16
) -> list[int]:
    """Exact values at the given 1-based ranks of a unique LONG column.

    Each pass counts the rows of ``fanout`` equal-width cells inside the range
    still open for every rank and narrows the range to one cell. Passes read a
    single column and shuffle at most ``fanout * len(ranks)`` counts; the value
    range, not the row count, sets their number (at most four).
    """
    if not ranks:
        return []
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    return _narrowed(df, column, ranks, {r: (lo, hi, r) for r in ranks}, fanout)


def order_statistics_near(
    df: DataFrame, column: str, fractions: list[float], ranks: Callable[[int], list[int]],
    accuracy: int = 100_000, fanout: int = 1 << 16,
) -> list[int]:
    """Exact values of a unique LONG column at ``ranks(number of rows)``, which lie near
    the given ``fractions`` of all rows (as many or the first few of them).

    One pass counts the rows and sketches quantiles on both sides of each fraction. A
    second one counts the rows between these brackets and, in cells, inside them; where
    cells are one value wide (dense positions up to about 10^9 rows) that settles it. If
    any rank lies outside its bracket, all values are searched.
    """
    slack = 3 / accuracy
    marks = [min(max(f + d, 0.0), 1.0) for f in fractions for d in (-slack, slack)]
    n, lo, hi, values = df.agg(
        F.count(column), F.min(column), F.max(column),
        F.percentile_approx(column, marks, accuracy)).first()
    wanted = ranks(n)
    if not wanted:
        return []
    spans: list[tuple[int, int]] = []  # brackets, those that overlap made one
    for a, b in zip(values[::2], values[1::2], strict=True):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    hist = _histogram(df, column, spans, fanout, outside=True)
    below, found = 0, {}
    for i, (a, b) in enumerate(spans):
        below += sum(count for _, count in hist.get(-1 - i, []))
        inside = sum(count for _, count in hist.get(i, []))
        for r in wanted:
            if below < r <= below + inside:
                found[r] = _cell_of(hist[i], (a, b), r - below, fanout)
        below += inside
    if len(found) < len(set(wanted)):  # ranges must not overlap in part
        found = {r: (lo, hi, r) for r in wanted}
    return _narrowed(df, column, wanted, found, fanout)


def _cell_width(span: tuple[int, int], fanout: int) -> int:
    return (span[1] - span[0]) // fanout + 1


def _histogram(
    df: DataFrame, column: str, spans: list[tuple[int, int]], fanout: int, outside: bool = False
) -> dict[int, list[tuple[int, int]]]:
    """Rows per cell of each span, as ``{span: [(cell, rows)]}``; with ``outside`` also
    those before span ``i`` and after the one before it, under ``-1 - i``."""
    x = F.col(column)
    cell = F.lit(None).cast("struct<span:int,cell:bigint>")
    if outside:
        gap = sum((x > F.lit(b)).cast("int") for _, b in spans)
        cell = F.struct((-1 - gap).cast("int").alias("span"), F.lit(0).cast("bigint").alias("cell"))
    for i, (a, b) in enumerate(spans):
        w = _cell_width((a, b), fanout)
        # cells start at multiples of w, so no difference can overflow
        number = F.expr(f"(`{column}` - pmod(`{column}`, {w}L)) div {w}L")
        cell = F.when(
            (x >= F.lit(a)) & (x <= F.lit(b)),
            F.struct(F.lit(i).alias("span"), number.alias("cell"))).otherwise(cell)
    hist: dict[int, list[tuple[int, int]]] = {}
    for row in (
        df.select(cell.alias("c")).where("c is not null")
        .select("c.span", "c.cell").groupBy("span", "cell").count().collect()
    ):
        hist.setdefault(row["span"], []).append((row["cell"], row["count"]))
    return hist


def _cell_of(
    cells: list[tuple[int, int]], span: tuple[int, int], want: int, fanout: int
) -> tuple[int, int, int]:
    """Bounds of the cell with the row of rank ``want`` in the span, and its rank there."""
    w = _cell_width(span, fanout)
    for c, n in sorted(cells):
        if want <= n:
            return max(c * w, span[0]), min(c * w + w - 1, span[1]), want
        want -= n
    raise ValueError("fewer rows than the rank asks for")


def _narrowed(
    df: DataFrame, column: str, ranks: list[int],
    open_ranges: dict[int, tuple[int, int, int]], fanout: int,
) -> list[int]:
    """The values at ``ranks`` from a range (low, high, rank inside) that holds each."""
    open_ranges = dict(open_ranges)
    found: dict[int, int] = {}
    while True:
        for rank, (a, b, _) in list(open_ranges.items()):
            if a == b:
                found[rank] = a
                del open_ranges[rank]
        if not open_ranges:
            return [found[r] for r in ranks]
        spans = sorted({(a, b) for a, b, _ in open_ranges.values()})
        hist = _histogram(df, column, spans, fanout)
        for rank, (a, b, want) in open_ranges.items():
            open_ranges[rank] = _cell_of(hist[spans.index((a, b))], (a, b), want, fanout)
