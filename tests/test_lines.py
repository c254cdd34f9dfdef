"""Lines and quoted records of files that are cut into many ranges."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from opinionmill.sources import lines
from opinionmill.sources import reviews as rv


@pytest.fixture(params=["134217728", "64"])
def small_ranges(spark, request):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.set(k, request.param if k == keys[0] else "0")
    yield int(request.param)
    for k, v in zip(keys, before, strict=True):
        spark.conf.set(k, v)


def table_text(rows, end="\n", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=quoting).writerows(rows)
    return out.getvalue()


def random_rows(seed, n=120):
    rng = random.Random(seed)
    letters = ['"', '""', ",", "\n", "\r\n", "a", "bé", " ", "漢", "'", ';"', '",']
    return [[f"r{i}", *("".join(rng.choice(letters) for _ in range(rng.randrange(9))) for _ in range(2))]
            for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", [1, 2])
def test_csv_in_ranges(spark, tmp_path, small_ranges, end, seed):
    rows = random_rows(seed)
    text = table_text([["id", "my text", "other"], *rows], end)
    (tmp_path / "x.csv").write_bytes(text.encode())
    df = rv.read_reviews(spark, str(tmp_path / "x.csv"), na_tokens=())
    got = [tuple(r) for r in df.orderBy("ord").select("ord", "id", "my text", "other").collect()]
    assert [r[0] for r in got] == list(range(len(rows)))
    assert [[x or "" for x in r[1:]] for r in got] == rows
    if small_ranges < 1000:
        assert lines._raw_lines(spark, str(tmp_path / "x.csv")).rdd.getNumPartitions() > 20


def test_same_cells_as_the_whole_file_reader(spark, tmp_path, small_ranges):
    """Stray quotes, blank lines, short and long rows."""
    text = ('a,b,c\n\n1,6.5" screen,x\n2,"",""\n\n\n"3",a"b"c,"q ""x"" y"\n4\n5,"line\n\nbreak",end"\n'
            '6,x,y,z\n"7","ends in a break\n","\n"\n8," pad ","comma, ""in"" it"\n9,last,"no feed at the end"')
    (tmp_path / "x.csv").write_text(text, encoding="utf-8", newline="")
    want = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(
        str(tmp_path / "x.csv")).collect()
    got = rv.read_reviews(spark, str(tmp_path / "x.csv"), na_tokens=()).orderBy("ord").drop("ord").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and len(got) == 9


def test_many_files(spark, tmp_path, small_ranges):
    """Every file has a header; a file without rows, and an open quote in one of them."""
    parts = [random_rows(s, 30) for s in range(3)]
    for i, rows in enumerate(parts):
        (tmp_path / f"{i} ă.csv").write_bytes(table_text([["id", "t", "u"], *rows]).encode())
    (tmp_path / "3.csv").write_text("id,t,u\n")
    (tmp_path / "4.csv").write_text('id,t,u\nz,"open\nto the,end\n')
    df = rv.read_reviews(spark, str(tmp_path), na_tokens=())
    got = [[x or "" for x in r] for r in df.orderBy("ord").select("id", "t", "u").collect()]
    assert got[:-1] == [r for rows in parts for r in rows] and got[-1][:1] == ["z"]
    assert df.select("ord").distinct().count() == 91


def test_numbered_lines(spark, tmp_path, small_ranges):
    rng = random.Random(3)
    want = {}
    for name in ("a", "b"):
        values = ["".join(rng.choice('xé" ,\r') for _ in range(rng.randrange(40))) for _ in range(100)]
        (tmp_path / name).write_bytes("\n".join(values).encode() + b"\n" * (name == "a"))
        want[name] = values
    got = lines.numbered_lines(spark, str(tmp_path)).withColumn("path", F.right("path", F.lit(1)))
    rows = sorted(map(tuple, got.collect()))
    assert rows == [(n, i, v) for n in want for i, v in enumerate(want[n]) if (i, v) != (99, "")
                    or n == "a" or v]


def test_empty_file(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"")
    assert lines.numbered_lines(spark, str(tmp_path / "x")).isEmpty()
    assert lines.quoted_records(spark, str(tmp_path / "x")).isEmpty()


def test_records_inside_a_range_need_no_shuffle(spark, tmp_path):
    """Lines of a cell are joined where they are read, over batches too; of records that
    cross ranges only the pieces are shuffled."""
    rows = [*random_rows(5), ["long", "\n".join(f"line {i}" for i in range(40)), "\n\n"]]
    (tmp_path / "x.csv").write_bytes(table_text(rows, quoting=csv.QUOTE_ALL).encode())
    want = [next(csv.reader(io.StringIO(t, newline=""))) for t in (table_text([r]) for r in rows)]
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.files.maxPartitionBytes",
            "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for size in ("134217728", "300"):
            for k, v in zip(keys, ("3", size, size), strict=True):
                spark.conf.set(k, v)
            found = lines.quoted_records(spark, str(tmp_path / "x.csv"))
            got = [r["text"] for r in found.orderBy("record").collect()]
            assert [next(csv.reader(io.StringIO(t + "\n", newline=""))) for t in got] == want
            shuffled = "hashpartitioning" in found._jdf.queryExecution().executedPlan().toString()
            assert shuffled == (size == "300")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_lines_keep_their_order_beyond_a_broadcast(spark, tmp_path, small_ranges, monkeypatch):
    rows = random_rows(6)
    (tmp_path / "x.csv").write_bytes(table_text(rows).encode())
    want = [tuple(r) for r in lines.quoted_records(spark, str(tmp_path)).drop("path").orderBy("record").collect()]
    monkeypatch.setattr(lines, "within", lambda df, most: False)
    got = [tuple(r) for r in lines.quoted_records(spark, str(tmp_path)).drop("path").orderBy("record").collect()]
    assert got == want and len(got) == len(rows)
