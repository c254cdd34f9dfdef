import random

import pytest

from opinionmill.operators import feed as fd

ROWS = [
    ("B", "bad", "Pin", "neg"), ("A", "bad", "Loa", "neg"), ("A", "bad", "Pin", "neg"),
    ("A", "all good", "Pin", "pos"), ("A", "all good", "Pin", "odd"), ("C", "so so", "Giá", "neg"),
    ("", "so fine", "Giá", "pos"),
]


@pytest.fixture
def feed(make_opinions):
    return fd.review_feed(make_opinions(ROWS))


@pytest.fixture
def big(spark, make_opinions):
    rng = random.Random(2)
    return fd.settled_feed(make_opinions([
        (f"p{rng.randint(0, 44):02d}", f"text {rng.randint(0, 120):03d}",
         rng.choice(["Pin", "Loa", "Giá", "Màn"]), rng.choice(["pos", "neg", "neu"]))
        for _ in range(700)]))


def items(df):
    return {r["text"]: (r["product"], [tuple(t) for t in r["tags"]]) for r in df.collect()}


def test_items(feed):
    assert items(feed) == {
        "bad": ("B", [("Pin", "neg"), ("Loa", "neg")]),
        "all good": ("A", [("Pin", "pos"), ("Pin", "neu")]),
        "so so": ("C", [("Giá", "neg")]),
        "so fine": ("", [("Giá", "pos")]),
    }


def test_summary(make_opinions):
    assert fd.feed_summary(make_opinions(ROWS)).first()["caption"] == "4 câu → 7 khía cạnh"


def test_alerts(feed):
    # all pairs count one: the first in feed order wins
    assert tuple(fd.quality_alert(feed).first()) == ("quality", "B", "Pin", 1)
    assert tuple(fd.opportunity_alert(feed).first()) == ("opportunity", "A", "Pin", 1)


def test_blank_product_gets_the_default(make_opinions):
    got = fd.smart_alerts(fd.review_feed(make_opinions([("", "x", "Pin", "pos")])))
    assert [tuple(r) for r in got.collect()] == [("opportunity", "Sản phẩm chung", "Pin", 1)]


def test_facets(big):
    found = items(big)
    aspects = {r["aspect"]: r["items"] for r in fd.aspect_facet_counts(big).collect()}
    assert aspects == {
        a: sum(any(t[0] == a for t in tags) for _, tags in found.values()) for a in aspects}
    products = {r["product"]: r["items"] for r in fd.product_facet_counts(big).collect()}
    assert sum(products.values()) == len(found)


def test_facet_pages_partition(big):
    n = fd.product_facet_counts(big).count()
    pages = [fd.facet_page(big, page=i, size=20).orderBy("row").collect() for i in (1, 2, 3)]
    assert pages[0][0]["pages"] == -(-n // 20)
    seen = [r["product"] for p in pages[: pages[0][0]["pages"]] for r in p]
    assert len(seen) == len(set(seen)) == n
    counts = [r["items"] for p in pages[: pages[0][0]["pages"]] for r in p]
    assert counts == sorted(counts, reverse=True)
    assert fd.facet_page(big, page=99).collect()[0]["page"] == 1


@pytest.mark.parametrize("top_rows", [10_000, 0])
def test_feed_pages_partition(big, monkeypatch, top_rows):
    """Both the top-k and the numbered route give every item exactly once."""
    monkeypatch.setattr(fd, "TOP_ROWS", top_rows)
    n = big.count()
    texts = []
    for page in range(1, -(-n // 10) + 1):
        got = fd.feed_page(big, page=page).orderBy("row").collect()
        assert {(r["page"], r["found"]) for r in got} == {(page, n)}
        texts += [r["text"] for r in got]
    assert texts == sorted(items(big))
    last = fd.feed_page(big, page=10**6).collect()
    assert {r["text"] for r in last} == set(texts[-(n % 10 or 10):])


def test_filter_and_search(feed):
    assert set(items(fd.filter_feed(feed, "A"))) == {"all good"}
    assert set(items(fd.filter_feed(feed, category="Pin"))) == {"bad", "all good"}
    assert set(items(fd.search_feed(feed, "SO"))) == {"so so", "so fine"}
    assert set(items(fd.search_feed(feed, "giá"))) == {"so so", "so fine"}
    assert set(items(fd.search_feed(feed, "b"))) == {"bad"}
    assert len(items(fd.search_feed(feed, ""))) == 4
    assert fd.feed_page(feed, fd.Slice(product="none")).collect() == []


def test_panels(feed):
    pick = fd.Slice(category="Pin")
    assert [tuple(r)[:4] for r in fd.slice_aspects(feed, pick).collect()] == [("Pin", 3, 1, 1)]
    s = fd.slice_sentiment(feed, pick).first()
    assert (s["pos"], s["neg"], s["pos_rate"], s["neg_rate"]) == (1, 1, 50, 50)
    assert [tuple(r) for r in fd.slice_alerts(feed, pick).collect()] == [("Pin", 1, 33)]
    best = [tuple(r) for r in fd.slice_best_products(feed, pick).collect()]
    assert best == [("A", 2, 50), ("B", 1, 0)]
    nothing = fd.slice_sentiment(feed, fd.Slice(query="zzz")).first()
    assert tuple(nothing) == (0, 0, 0, 0)
    widths = [r["bar_width"] for r in fd.slice_aspects(feed).orderBy("aspect").collect()]
    assert widths == [pytest.approx(200 / 3), pytest.approx(100 / 3), 100.0]
