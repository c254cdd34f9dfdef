"""Text files of any size as numbered lines and as quoted records, read by many tasks.

Spark cuts a file into byte ranges and gives each its lines. What a range needs from the
ones before it is only how many lines and records they hold and whether they end inside
quotes. Each range is therefore summed up for both cases, the sums of a file are folded in
order (one small entry a range), and every line is then placed by its range's entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionmill.plans.scale import BROADCAST_ROWS, lookup_join, settle, within

_PLACED = "n bigint, r0 bigint, r1 bigint, i0 boolean, i1 boolean, e0 boolean, e1 boolean"


def _raw_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"), "value")


def _quote_marks(value: Column, sep: str) -> list[Column]:
    """What a line does to "inside quotes": ``ends`` it, then ``turns`` it over (or not).

    Pairs of quotes change nothing. A single quote after a separator or at the start of
    a line opens a cell, or closes one whose text ends there; any other one closes a cell
    or is a mere letter of an unquoted one, so that afterwards no cell is open.
    """
    single = F.replace(value, F.lit('""'), F.lit(""))
    other = f'[^"{_escaped(sep)}]"'
    ends = single.rlike(f"(?s){other}")
    rest = F.regexp_replace(single, f"(?s)^.*{other}", "")
    left = F.when(ends, rest).otherwise(single)
    turns = (F.length(left) - F.length(F.replace(left, F.lit('"'), F.lit("")))) % 2 == 1
    quoted = F.contains(value, F.lit('"'))
    return [(quoted & ends).alias("ends"), (quoted & turns).alias("turns"),
            value.isin("", "\r").alias("blank")]


def _escaped(sep: str) -> str:
    return "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in sep)


def _stepping():
    """For marked lines that follow each other, the first one inside quotes or not: which
    begin inside, which end so, and which begin a record."""
    # Defined inside so that workers receive the function by value.
    def step(ends, turns, blank, inside):
        import numpy as np

        count = np.cumsum(turns)
        last = np.maximum.accumulate(np.where(ends, np.arange(len(ends)), -1))
        since = np.where(last >= 0, count[last] - turns[last], 0)
        after = np.where(last >= 0, count - since, count + inside) % 2 == 1
        before = np.concatenate([[inside], after[:-1]])
        return before, after, ~before & ~blank

    return step


def _slicing():
    """The slices of a batch that lie in one range each, with its path and start."""
    def slices(batch):
        import numpy as np

        path, start = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
        ids = path.indices.to_numpy()
        cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (start[1:] != start[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if a < b:
                yield (path.dictionary[int(ids[a])].as_py(), int(start[a])), batch.slice(a, b - a)

    return slices


def _placing(keep: int):
    """For lines with marks: number in the range and, both for a range that begins outside
    (0) and inside (1) of quotes, ``r`` records begun so far, ``i`` whether this line
    begins inside and ``e`` whether it ends so. The first ``keep`` columns stay."""
    step, slices = _stepping(), _slicing()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        here, seen, inside, begun = None, 0, [False, True], [0, 0]
        for batch in batches:
            for name, part in slices(batch):
                if name != here:
                    here, seen, inside, begun = name, 0, [False, True], [0, 0]
                ends, turns, blank = (
                    part.column(keep + k).to_numpy(zero_copy_only=False).astype(bool) for k in range(3))
                out = [pa.array(np.arange(seen + 1, seen + part.num_rows + 1))]
                begun_, inside_, after_ = [], [], []
                for case in (0, 1):
                    before, after, starts = step(ends, turns, blank, inside[case])
                    records = begun[case] + np.cumsum(starts)
                    begun[case], inside[case] = int(records[-1]), bool(after[-1])
                    begun_.append(pa.array(records))
                    inside_.append(pa.array(before))
                    after_.append(pa.array(after))
                seen += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:keep], *out, *begun_, *inside_, *after_],
                    names=[*part.schema.names[:keep], "n", "r0", "r1", "i0", "i1", "e0", "e1"])

    return place


def _assembling(cut: bool):
    """Records put together from the marked lines of a range in their order: those that lie
    in it as a whole or, with ``cut``, the pieces of its first and last one that do not."""
    step, slices = _stepping(), _slicing()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        here, seen, begun, inside = None, 0, 0, False
        held: list[pa.Array] = []  # lines of a record that goes on in the next batch
        for batch in batches:
            for name, part in slices(batch):
                def flags(column, part=part):
                    return part.column(column).to_numpy(zero_copy_only=False).astype(bool)

                first = {c: part.column(c)[0].as_py() for c in ("inside", "records", "begun", "open")}
                if name != here:
                    here, seen, begun, inside, held = name, 0, 0, first["inside"], []
                blank = flags("blank")
                before, after, starts = step(flags("ends"), flags("turns"), blank, inside)
                record = begun + np.cumsum(starts)
                piece = (record == 0) | (first["open"] & (record == first["begun"]))
                rows = np.flatnonzero((before | ~blank) & (piece if cut else ~piece))
                begun, inside, line = int(record[-1]), bool(after[-1]), seen + rows
                seen += part.num_rows
                if not len(rows):
                    continue
                values, number = part.column("value").take(pa.array(rows)), record[rows]
                if held and inside and not starts.any():
                    held.append(values)
                    continue
                if held:
                    number = np.concatenate([np.full(sum(map(len, held)), number[0]), number])
                    values, held = pa.concat_arrays([*held, values]), []
                at = np.flatnonzero(np.diff(number, prepend=-1))
                if not cut and inside and number[-1] == begun:
                    held, values, at = [values[at[-1]:]], values[:at[-1]], at[:-1]
                if not len(at):
                    continue
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(at, len(values)), pa.int32()), values)
                more = [pa.array(np.full(len(at), name[1])), pa.array(line[at])] if cut else []
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(name[0], part.column("path").type), len(at)),
                     pa.array(first["records"] + number[at] - 1), *more,
                     pc.binary_join(lists, pa.scalar("\n", values.type))],
                    names=["path", "record", *(["start", "line"] if cut else []), "text"])

    return assemble


def _range_sums(placed: DataFrame) -> DataFrame:
    return placed.groupBy("path", "start").agg(
        F.max("n").alias("n"), F.max("r0").alias("r0"), F.max("r1").alias("r1"),
        F.max_by("e0", "n").alias("e0"), F.max_by("e1", "n").alias("e1"))


def _range_offsets(sums: DataFrame) -> DataFrame:
    """``path``, ``start``, ``inside``, ``lines``, ``records`` before each range, how many
    records are ``begun`` in it, and whether the last one is ``open`` at its end.

    The ranges of a file are folded in one row: some bytes for each range of it. They are
    settled, so that the files are read for them once, however often the lines are used.
    """
    ranges = sums.groupBy("path").agg(F.array_sort(F.collect_list(
        F.struct("start", "n", "r0", "r1", "e0", "e1"))).alias("ranges"))
    zero = F.lit(0).cast("bigint")
    entry = "array<struct<start:bigint,inside:boolean,lines:bigint,records:bigint,begun:bigint,open:boolean>>"

    def step(state: Column, x: Column) -> Column:
        def pick(outside: str, within: str) -> Column:
            return F.when(state["inside"], x[within]).otherwise(x[outside])

        now = F.struct(x["start"].alias("start"), state["inside"].alias("inside"),
                       state["lines"].alias("lines"), state["records"].alias("records"),
                       pick("r0", "r1").alias("begun"), pick("e0", "e1").alias("open"))
        return F.struct(
            pick("e0", "e1").alias("inside"), (state["lines"] + x["n"]).alias("lines"),
            (state["records"] + pick("r0", "r1")).alias("records"),
            F.concat(state["out"], F.array(now)).alias("out"))

    start = F.struct(F.lit(False).alias("inside"), zero.alias("lines"), zero.alias("records"),
                     F.array().cast(entry).alias("out"))
    return settle(ranges.select(
        "path", F.inline(F.aggregate("ranges", start, step, lambda s: s["out"]))))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path``, ``line`` (0, 1, … in its file), ``value``: every line between line feeds."""
    raw = _raw_lines(spark, path)
    none = [F.lit(False).alias(c) for c in ("ends", "turns", "blank")]
    zero, no = F.lit(0).cast("bigint"), F.lit(False)
    at = raw.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n")).withColumns(
        {"r0": zero, "r1": zero, "e0": no, "e1": no})  # lines alone, whatever is quoted
    rows = raw.select("path", "start", "value", *none).mapInArrow(
        _placing(3), f"path string, start bigint, value string, {_PLACED}")
    return _at_offsets(rows, _range_offsets(at)).select(
        "path", (F.col("lines") + F.col("n") - 1).alias("line"), "value")


def _at_offsets(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    key = F.struct("path", "start").alias("key")
    return lookup_join(
        rows.withColumn("key", key),
        offsets.select(key, "inside", "lines", "records"), "key", "inner").drop("key")


def _in_order(lines: DataFrame, offsets: DataFrame) -> DataFrame:
    """Lines with what is known of their range, in the order of the file within it."""
    at, key = offsets.drop("lines"), ["path", "start"]
    if within(offsets, BROADCAST_ROWS):
        return lines.join(F.broadcast(at), key)
    return lines.withColumn("_row", F.monotonically_increasing_id()).join(at, key).repartition(
        *key).sortWithinPartitions(*key, "_row").drop("_row")


def quoted_records(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """``path``, ``record`` (0, 1, … in its file), ``text``, see ``records_of_files``."""
    return records_of_files(spark, path, sep)[0]


def records_of_files(
    spark: SparkSession, path: str | list[str], sep: str = ","
) -> tuple[DataFrame, DataFrame]:
    """``path``, ``record`` (0, 1, … in its file), ``text``: records of quoted cells; and
    the ``path`` of every file that holds any, told without another reading.

    Line breaks inside quotes belong to their cell. A quote is doubled inside quotes;
    a quote in the midst of an unquoted cell is a letter. Blank lines between records do
    not count; a line may end in CR LF. A record that spans lines is put together by the task
    that reads them, one that spans ranges in a shuffle, so a quote that is never closed
    makes one record of the rest of its file.
    """
    raw = _raw_lines(spark, path)
    marks = _quote_marks(F.col("value"), sep)
    at = raw.select("path", "start", *marks).mapInArrow(
        _placing(2), f"path string, start bigint, {_PLACED}")
    offsets = _range_offsets(_range_sums(at))
    files = offsets.where("begun > 0").select("path").distinct()
    lines = _in_order(raw.select("path", "start", "value", *marks), offsets)
    found = lines.mapInArrow(_assembling(cut=False), "path string, record bigint, text string")
    if not offsets.where("inside or open").isEmpty():
        # only the pieces of records that cross ranges meet in a shuffle
        pieces = lines.mapInArrow(
            _assembling(cut=True), "path string, record bigint, start bigint, line bigint, text string"
        ).groupBy("path", "record").agg(
            F.array_sort(F.collect_list(F.struct("start", "line", "text"))).alias("parts"))
        found = found.unionByName(pieces.select("path", "record", F.array_join(
            F.transform("parts", lambda x: x["text"]), "\n").alias("text")))
    return found.withColumn("text", F.when(
        F.endswith("text", F.lit("\r")), F.expr("substring(text, 1, length(text) - 1)")
    ).otherwise(F.col("text"))), files
