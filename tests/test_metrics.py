import random

import pytest
from pyspark.sql import functions as F

from opinionmill import schema as S
from opinionmill.operators import metrics as m
from opinionmill.operators import products as p

ROWS = [
    ("A", "t1", "Pin", "pos", "2 ngày trước"),
    ("A", "t1", "Loa", "neg", "2 tuần trước"),
    ("B", "t2", "Pin", "neg", "1 tháng trước"),
    ("B", "t3", "Giá", "neu", ""),
    ("C", "t3", "Loa", "neg", "hôm nay"),
    ("B", "t4", "Giá", "pos", "0 ngày"),
    ("A", "t5", "Màn", "pos", "3 tuần trước"),
]


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_kpis(make_opinions):
    r = m.kpi_metrics(make_opinions(ROWS)).first()
    assert (r["total"], r["pos_count"], r["neg_count"]) == (7, 3, 3)
    assert (r["pos_rate"], r["neg_rate"], r["neu_rate"], r["nps"]) == (43, 43, 14, 0)
    assert r["nps_band"] == "good"


def test_empty_table(spark):
    empty = spark.createDataFrame([], S.OPINIONS)
    r = m.kpi_metrics(empty).first()
    assert (r["total"], r["pos_rate"], r["neu_rate"], r["nps"]) == (0, 0, 100, 0)
    assert rows(m.top_aspect(empty)) == [("N/A", 0)]
    assert rows(m.trend_series(empty)) == [(
        "0,100 25,100 50,100 75,100 100,100", "0,100 25,100 50,100 75,100 100,100",
        "0,100 0,100 25,100 50,100 75,100 100,100 100,100")]
    for df in (m.aspect_profile(empty), m.drivers(empty), p.product_ranking(empty),
               p.heatmap(empty), p.sample_reviews(empty), p.best_products(empty)):
        assert df.collect() == []


def test_ties_go_to_first_seen(make_opinions):
    ops = make_opinions(ROWS)
    assert rows(m.top_aspect(ops)) == [("Pin", 2)]
    order = [r["category"] for r in m.aspect_profile(ops).orderBy(*m.profile_order()).collect()]
    assert order == ["Pin", "Loa", "Giá", "Màn"]
    # categories without negatives may appear among the worst
    worst = [(r["category"], r["neg"]) for r in m.worst_aspects(ops).collect()]
    assert worst == [("Loa", 2), ("Pin", 1), ("Giá", 0), ("Màn", 0)]


def test_impact_and_drivers(make_opinions):
    ops = make_opinions(ROWS)
    impact = {r["category"]: r["impact"] for r in m.aspect_impact(ops).collect()}
    assert impact == {"Pin": 0, "Loa": -29, "Giá": 14, "Màn": 14}
    got = sorted((r["side"], r["place"], r["category"], r["rate"]) for r in m.drivers(ops).collect())
    assert got == [("neg", 0, "Loa", 29), ("pos", 0, "Giá", 14), ("pos", 1, "Màn", 14)]


def test_trend_by_recency(make_opinions):
    got = sorted(rows(m.trend_by_recency(make_opinions(ROWS))))
    assert got == [(0, 1, 0, 100), (1, 1, 100, 0), (2, 1, 0, 100), (3, 1, 100, 0), (4, 1, 100, 0)]


@pytest.mark.parametrize("n, sizes", [
    (1, [1, 0, 0, 0, 0]), (4, [1, 1, 1, 1, 0]), (5, [1, 1, 1, 1, 1]), (6, [2, 2, 2, 0, 0]),
    (7, [2, 2, 2, 1, 0]), (11, [3, 3, 3, 2, 0])])
def test_position_slices(make_opinions, n, sizes):
    ops = make_opinions([("A", f"t{i}", "Pin", "pos" if i % 2 else "neg") for i in range(n)])
    # far apart and out of order on purpose
    ops = ops.withColumn("ord", F.col("ord") * 10**12 - 7).repartition(3)
    got = [r["total"] for r in m.trend_by_position(ops).orderBy("slot").collect()]
    assert got == sizes


def test_trend_falls_back_to_position(make_opinions):
    ops = make_opinions([("A", "t", "Pin", "pos", "hôm nay")] * 5)
    assert m.has_time(ops).first()["has_time"] is True
    assert rows(m.trend(ops).groupBy().sum("total")) == [(5,)]
    assert m.has_time(ops.withColumn("time_text", F.lit(""))).first()["has_time"] is False


def test_ranking(make_opinions):
    got = [(r["rank"], r["product"], r["score"], r["stars"])
           for r in p.product_ranking(make_opinions(ROWS)).orderBy("rank").collect()]
    assert got == [(1, "A", 3.7, 4), (2, "B", 2.3, 3), (3, "C", 1.0, 3)]


def test_cube_gives_the_same_as_opinions(make_opinions):
    ops = make_opinions(ROWS)
    cube = m.opinion_cube(ops)
    for fn in (m.kpi_metrics, m.top_aspect, m.aspect_profile, m.worst_aspects, m.drivers,
               p.product_ranking, p.best_products, p.top_products, p.heatmap):
        assert sorted(rows(fn(ops)), key=str) == sorted(rows(fn(cube)), key=str), fn.__name__


def test_sample_reviews(make_opinions):
    ops = make_opinions(
        [("A", f'say "{i}"', "Pin", "neu" if i else "pos") for i in range(12)] + [("B", "x", "Loa", "neg")])
    got = {r["product"]: r["tooltip"] for r in p.sample_reviews(ops).collect()}
    assert got["B"] == '🔴 Tiêu cực | Loa:\n  "x"'
    lines = got["A"].split("\n\n")
    assert lines[0] == "🟢 Tích cực | Pin:\n  \"say '0'\""
    assert lines[9] == "🔴 Tiêu cực | Pin:\n  \"say '9'\""
    assert lines[10:] == ["... và 2 đánh giá khác"]


def test_heatmap_grid_is_complete(make_opinions):
    rng = random.Random(5)
    data = [(rng.choice("ABCDE"), f"t{i}", f"c{rng.randint(0, 13):02d}", rng.choice(["pos", "neg"]))
            for i in range(200)] + [("Z", "only", "rare", "pos")]
    ops = make_opinions(data)
    cells = p.heatmap(ops).collect()
    cats = {r["category"] for r in cells}
    assert len(cats) == 10 and len(cells) == 6 * 10 and "rare" not in cats
    for r in cells:
        own = [x[3] for x in data if x[0] == r["product"] and x[2] == r["category"]]
        assert r["pos_pct"] == (round(own.count("pos") / len(own) * 100) if own else 0)
    dominant = {(r["product"], r["category"]): (r["side"], r["value"])
                for r in p.heatmap_dominant(p.heatmap(ops)).collect()}
    assert all(v == (None, 0) for (prod, _), v in dominant.items() if prod == "Z")
    maps = {r["product"]: r["aspects"] for r in p.heatmap_maps(ops).collect()}
    assert all(set(v) == cats for v in maps.values())


def test_partitioning_does_not_matter(make_opinions):
    rng = random.Random(11)
    ops = make_opinions([
        (rng.choice("ABCDE"), f"t{rng.randint(0, 40)}", rng.choice(["Pin", "Loa", "Giá"]),
         rng.choice(["pos", "neg", "neu"])) for _ in range(300)])
    for fn in (m.aspect_profile, m.drivers, p.product_ranking, p.sample_reviews, m.trend_series):
        once = sorted(rows(fn(ops.coalesce(1))), key=str)
        assert once == sorted(rows(fn(ops.repartition(9))), key=str), fn.__name__
