import random

import pytest
from pyspark.sql import functions as F

from opinionmill.plans import scale


@pytest.mark.parametrize("parts", [1, 7])
def test_global_index(spark, parts):
    rng = random.Random(parts)
    values = [(rng.randint(0, 50), i) for i in range(2000)]
    df = spark.createDataFrame(values, "k int, i int").repartition(parts)
    got = scale.global_index(df, [F.desc("k"), F.asc("i")], "pos").orderBy("pos").collect()
    want = sorted(values, key=lambda x: (-x[0], x[1]))
    assert [(r["k"], r["i"], r["pos"]) for r in got] == [
        (k, i, p) for p, (k, i) in enumerate(want)]


def test_global_index_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(5000).withColumn("k", F.col("id") % 13)
        got = scale.global_index(df, ["k", "id"], "pos")
        assert got.rdd.getNumPartitions() > 1
        want = sorted((i % 13, i) for i in range(5000))
        assert [(r["k"], r["id"]) for r in got.orderBy("pos").collect()] == want
        assert got.select("pos").distinct().count() == 5000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_global_index_empty(spark):
    assert scale.global_index(spark.range(0), ["id"]).collect() == []


@pytest.mark.parametrize("fanout", [4, 4096])
def test_order_statistics(spark, fanout):
    rng = random.Random(1)
    # clusters far apart, negatives, and the ends of the LONG range
    values = sorted({rng.randint(0, 500) for _ in range(200)}
                    | {2**61 + rng.randint(0, 10**6) for _ in range(200)}
                    | {-5, -(2**62), 2**62})
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    ranks = [1, 2, len(values) // 3, len(values) // 2, len(values)]
    got = scale.order_statistics(df, "x", ranks, fanout=fanout)
    assert got == [values[r - 1] for r in ranks]


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_lookup_join_salted(spark, how):
    left = spark.createDataFrame(
        [("hot" if i % 3 else f"k{i % 10}", i) for i in range(600)], "key string, v int")
    right = spark.createDataFrame(
        [("hot", 1), ("k0", 2), ("k3", 3), ("unused", 4)], "key string, w int")
    small = scale.lookup_join(left, right, "key", how)
    salted = scale.lookup_join(left, right, "key", how, max_rows=0, salts=5)
    assert sorted(map(str, small.collect())) == sorted(map(str, salted.collect()))
    assert salted.count() == small.count() > 0


def test_bounds(spark):
    assert scale.within(spark.range(5), 5) and not scale.within(spark.range(6), 5)
    assert scale.bounded_rows(spark.range(6), 5) is None
    assert len(scale.bounded_rows(spark.range(5), 5)) == 5


def test_rank_rows_beyond_limit(spark, monkeypatch):
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 3)
    got = scale.rank_rows(spark.range(20), [F.desc("id")], "r").collect()
    assert {r["id"]: r["r"] for r in got} == {i: 19 - i for i in range(20)}


def test_spread_small(spark):
    df = spark.range(10).coalesce(1)
    assert scale.spread_small(df, "id").rdd.getNumPartitions() >= 4
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1b")
    try:
        assert scale.spread_small(df, "id").rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("accuracy", [4, 50, 100_000])
@pytest.mark.parametrize("kind", ["dense", "sparse", "few", "none"])
def test_order_statistics_near(spark, accuracy, kind):
    """Exact whatever the sketch is worth; ranks and fractions need not agree well."""
    rng = random.Random(accuracy)
    values = {"dense": range(3000), "few": [5, -2**63, 2**63 - 1], "none": [],
              "sparse": [*{rng.randrange(-2**62, 2**62) for _ in range(2000)}, *range(2**62, 2**62 + 500)]}[kind]
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    ranks = lambda n: [r for r in (-(-n // 5), 2 * -(-n // 5), n - 1, n) if 0 < r <= n]
    got = scale.order_statistics_near(df, "v", [0.2, 0.4, 0.6, 0.8], ranks, accuracy)
    assert got == [sorted(values)[r - 1] for r in ranks(len(values))]


def test_order_statistics_near_reads_twice(spark):
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("near", "")
    df = spark.range(200_000).withColumnRenamed("id", "v")
    before = len(jobs.getJobIdsForGroup("near"))
    assert scale.order_statistics_near(df, "v", [0.2, 0.8], lambda n: [n // 5, 4 * n // 5]) == [39_999, 159_999]
    spark.sparkContext.setJobGroup(None, None)
    # each of the two aggregates is a job for its map side and one for its result
    assert len(jobs.getJobIdsForGroup("near")) - before <= 4
