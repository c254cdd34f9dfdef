"""Pages of stored rows: equal to pages of the rows themselves, from few files."""

import pytest
from pyspark.sql import functions as F

from opinionmill.operators import feed as fd
from opinionmill.plans import pages


def test_pages_partition_the_rows(spark, tmp_path):
    rows = spark.range(1003).select(F.xxhash64("id").alias("v"), "id").repartition(5)
    pages.write_ranked(rows, [F.asc("v")], str(tmp_path))
    want = [r["id"] for r in rows.orderBy("v").collect()]
    for page in (1, 2, 50, 101, 10**9):
        got = pages.ranked_page(spark, str(tmp_path), page, 10)
        here = min(page, 101)
        found = got.orderBy("row").collect()
        assert [r["id"] for r in found] == want[(here - 1) * 10: here * 10]
        assert {(r["found"], r["pages"], r["page"]) for r in found} == {(1003, 101, here)}
        assert len(got.inputFiles()) <= 2
    first = pages.ranked_page(spark, str(tmp_path), 500, 10, "first")
    assert [r["row"] for r in first.orderBy("row").collect()] == list(range(10))


@pytest.mark.parametrize("rows", [0, 1, 10])
def test_few_rows(spark, tmp_path, rows):
    pages.write_ranked(spark.range(rows), [F.asc("id")], str(tmp_path))
    got = pages.ranked_page(spark, str(tmp_path), 3, 10).orderBy("row").collect()
    assert [r["id"] for r in got] == list(range(rows))


def test_feed_pages(spark, tmp_path, make_opinions):
    ops = make_opinions([(f"P{i % 45}", f"text {i % 60:02d}", "Pin", "pos") for i in range(300)])
    feed = fd.review_feed(ops)
    fd.store_feed(feed, str(tmp_path))
    for page in (1, 3, 6, 99):
        assert sorted(map(str, fd.stored_page(spark, str(tmp_path), page).select("row", "text", "page", "pages").collect())) == \
            sorted(map(str, fd.feed_page(feed, page=page).select("row", "text", "page", "pages").collect()))
        assert sorted(map(str, fd.stored_facet_page(spark, str(tmp_path), page).collect())) == \
            sorted(map(str, fd.facet_page(feed, page=page).collect()))


def test_facet_is_counted_from_the_written_feed(spark, tmp_path, make_opinions, monkeypatch):
    opinions = make_opinions([("A", "t", "Pin", "pos"), ("B", "u", "Pin", "neg"), (None, "v", None, "neu"), ("A", "w", "x", "pos")])
    seen, counts = [], fd.product_facet_counts
    monkeypatch.setattr(fd, "product_facet_counts", lambda feed: seen.append(feed) or counts(feed))
    fd.store_feed(fd.review_feed(opinions), str(tmp_path))
    assert seen[0].inputFiles() and all("/feed/rows/" in f for f in seen[0].inputFiles())
    rows = [(r["product"], r["items"]) for r in fd.stored_facet_page(spark, str(tmp_path)).orderBy("row").collect()]
    assert rows == [("A", 2), ("B", 1), (None, 1)]
