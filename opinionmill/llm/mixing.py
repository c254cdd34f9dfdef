"""Mixing sources to target weights.

Words are summed per source, targets are filled by weight up to the most a source
can give, and every document is emitted ``floor(rate)`` times plus one further
copy drawn with the fraction as probability. The draw hashes the seed and the
document's id, so reruns and retried tasks agree.

Only one row per source is ever ordered or broadcast by size; the documents are
read twice and joined to those few rows by Spark's own choice, so a source with a
third of all rows is combined before its shuffle and never gathered.

Defined results: a null text has size 0; a null source is a source of its own and
comes last; repeated rows (same id) share one draw; an empty table gives an empty
result; sources of size 0 have target 0; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinionmill.llm.columns import word_count
from opinionmill.llm.tables import packed, unpacked

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2.0
SEED = 20


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the id alone (52 bits of an MD5)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``target`` from per-document sizes.

    Filling by weight up to caps has a closed form: order the sources by
    ``cap / weight``; those below the final level get their cap, the others share
    what is left by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.lit(list(WEIGHTS)), (
        (F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size"))
    by_level = Window.partitionBy().orderBy(
        F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumn("left", F.lit(BUDGET) * F.sum("source_size").over(everything)
                         - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    per = per.withColumn("heads", F.sum("weight").over(rest))
    share = F.col("left") * F.col("weight") / F.col("heads")
    # the first source in this order whose share stays under its cap sets the level
    fits = F.when(share <= F.col("cap"), F.struct(
        (F.col("cap") / F.col("weight")).alias("at"), F.col("left"), F.col("heads")))
    per = per.withColumn("final", F.min(fits).over(everything))
    final = F.col("final.left") * F.col("weight") / F.col("final.heads")
    return per.select(
        "source", "source_size",
        F.least(F.col("cap"), F.coalesce(final, F.col("cap"))).cast("double").alias("target"))


def copies(size_rate: Column, doc_id: Column, seed: int = SEED) -> Column:
    whole = F.floor(size_rate)
    return (whole + (draw(doc_id, seed) < size_rate - whole).cast("bigint")).cast("bigint")


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
             source: str = "source", seed: int = SEED) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``rate``, ``copies``."""
    sizes = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"))
    return _with_copies(sizes, source_targets(sizes), seed)


def _with_copies(rows: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    t = targets.withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return rows.join(t, rows["source"].eqNullSafe(t["_source"])).drop("_source").withColumn(
        "rate", rate).withColumn("copies", copies(F.col("rate"), F.col("doc_id"), seed))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                source: str = "source", seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as drawn, columns as in ``docs``."""
    sizes = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    t = source_targets(sizes).select(
        F.col("source").alias("target_source"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
        .otherwise(0.0).alias("rate"))
    rows = packed(docs, source=F.col(f"`{source}`"), doc_id=F.col(f"`{doc_id}`"))
    joined = rows.join(t, F.col("source").eqNullSafe(F.col("target_source")))
    return joined.withColumn("n", copies(F.col("rate"), F.col("doc_id"), seed)).where("n > 0").withColumn(
        "n", F.explode(F.sequence(F.lit(1), F.col("n")))).select(*unpacked(docs))


def duck_mix(docs: str, seed: int = SEED) -> str:
    """DuckDB CTEs over ``docs`` ending in ``mixed``, by resharing in turns.

    Each turn gives every source that is not yet full its share by weight and
    fills up those whose share exceeds their cap; as many turns as there are
    sources are always enough.
    """
    return f"""
sized as materialized (select *, len(regexp_extract_all(coalesce(text, ''),
  '[^ \\t\\n\\x0B\\f\\r]+'))::bigint as size from {docs}),
per as materialized (select source, sum(size)::bigint as source_size,
  [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
  from sized group by source),
turn as (
  select 0 as k, source, source_size, weight, false as done from per
  union all
  select k + 1, source, source_size, weight, done or (
    ({BUDGET} * sum(source_size) over () - coalesce(sum({MOST} * source_size) filter (done) over (), 0))
    * weight / sum(weight) filter (not done) over () > {MOST} * source_size)
  from turn where k <= (select count(*) from per)),
target as materialized (select source, source_size, case when done then {MOST} * source_size else
    ({BUDGET} * sum(source_size) over () - coalesce(sum({MOST} * source_size) filter (done) over (), 0))
    * weight / sum(weight) filter (not done) over () end::double as target
  from turn where k = (select count(*) from per)),
mixed as materialized (select s.*, source_size, target, (floor(rate) + case when
    ('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint / {float(1 << 52)}
    < rate - floor(rate) then 1 else 0 end)::bigint as copies
  from sized s join (select *, case when source_size > 0 then target / source_size else 0 end as rate
    from target) t on s.source is not distinct from t.source)""".lstrip("\n")
