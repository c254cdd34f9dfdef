"""How quality filters interact: what each removes at each place of every order.

A document is reduced to a mask of the filters it fails. Only the number of documents
per part, mask and label is needed from then on: at most ``4 * 2 ** filters`` cells a
part. Each cell is folded across the array of all orders, a literal of the plan, with
``aggregate`` and ``transform`` into one struct per order and step, weighted by the
cell's count; the cells of a part are merged by elementwise sums.

Texts are read once and never shuffled. Equal texts meet by their SHA-256 digest, after
the rows of a digest are combined per part and label, so a text that a third of all rows
share reaches the second stage as a few rows a task.

Defined results: a null text is the empty one, a null part the empty string. A row with a
null id has no smaller id before it, nor does it come before another, and has no labels;
rows that repeat an id each count, and count as equal to texts of smaller ids only. An id
that is labelled more than once has a label if any of its rows has. An empty table gives
no rows. Further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinionmill.llm.columns import whole_text

#: The filters of the audit: fails under so many words, ...
MIN_WORDS = 100
DISTINCT_PERCENT = 80
UPPER_PERCENT = 10
SYMBOLS = "#$%&*|"
#: The filter on texts that an earlier document has too.
COPY = "E"

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def plain_words(text: Column) -> Column:
    """Words between any of the six ASCII separators, by splits at single blanks."""
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one text alone."""
    text = whole_text(text)
    words = plain_words(text)
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * DISTINCT_PERCENT,
        "C": upper * 100 > F.length(text) * UPPER_PERCENT,
        "D": text.rlike(f"[{SYMBOLS}]"),
    }


def _sum_of_bits(failures: Mapping[str, Column], letters: str) -> Column:
    mask = F.lit(0)
    for letter, fails in failures.items():
        mask = mask + F.when(fails, F.lit(1 << letters.index(letter))).otherwise(F.lit(0))
    return mask


def mask_cells(
    docs: DataFrame, labels: DataFrame, failures: Mapping[str, Column], copy: str | None = COPY,
    doc_id: str = "doc_id", text: str = "text", part: str = "lang",
) -> DataFrame:
    """``part``, ``mask``, ``good``, ``toxic``, ``n``: documents per cell.

    ``failures`` must depend on the text alone; ``copy`` names the filter that equal
    texts of smaller ids fail. Bit ``k`` of the mask is the filter that is ``k``-th in
    alphabetic order.
    """
    letters = "".join(sorted([*failures, *([copy] if copy else [])]))
    rows = docs.select(
        F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        _sum_of_bits(failures, letters).alias("mask"),
        F.unhex(F.sha2(whole_text(F.col(text)), 256)).alias("digest"),
    ).groupBy("digest", "mask", "part", "id").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max("quality") == 1, F.lit(False)).alias("good"),
        F.coalesce(F.max("toxic") == 1, F.lit(False)).alias("toxic"))
    rows = rows.join(marks, "id", "left").select(
        "digest", "mask", "part", "id", "n", *[
            F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")])
    per_text = rows.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("first"),
        # one row an id is left in such a group, so this is the count of the first id
        F.coalesce(F.min_by("n", "id"), F.lit(0)).alias("at_first"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"))
    if copy:
        earliest = F.min("first").over(Window.partitionBy("digest"))
        new = F.when(F.col("first") == F.col("earliest"), F.col("at_first")).otherwise(F.lit(0))
        bit = 1 << letters.index(copy)
        per_text = per_text.withColumn("earliest", earliest).withColumn(
            "new", new + F.col("no_id")).select("part", "good", "toxic", F.explode(F.array(
                F.struct(F.col("mask"), F.col("new").alias("n")),
                F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("new")).alias("n")),
            )).alias("c")).select("part", "good", "toxic", "c.*").where("n > 0")
    return per_text.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def _fold(cell: Column, orders: Column) -> Column:
    """One struct per order and step, order after order: what the cell adds there."""
    def step(state: Column, bit: Column) -> Column:
        fails = cell["mask"].bitwiseAND(bit) != 0
        alive = state["alive"]
        n = cell["n"]

        def weigh(condition: Column) -> Column:
            return F.when(condition, n).otherwise(F.lit(0).cast("bigint"))

        out = F.struct(
            weigh(alive & ~fails).alias("kept"), weigh(alive & fails).alias("removed"),
            weigh(~alive & fails).alias("redundant"), weigh(cell["mask"] == bit).alias("unique_fails"),
            weigh(alive & fails & cell["good"]).alias("good_lost"),
            weigh(alive & fails & cell["toxic"]).alias("toxic_lost"))
        return F.struct(
            (alive & ~fails).alias("alive"), F.concat(state["out"], F.array(out)).alias("out"))

    start = F.struct(
        F.lit(True).alias("alive"),
        F.lit([]).cast(f"array<struct<{','.join(f'{c}:bigint' for c in COUNTS)}>>").alias("out"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(
        order, start, step, lambda state: state["out"])))


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """A row per part, order of ``letters`` and step, from ``mask_cells``.

    ``kept`` documents stand after the step, ``removed`` ones go there, ``redundant``
    ones fail its filter but went before, ``unique_fails`` fail it alone; ``good_lost``
    and ``toxic_lost`` are those removed with that label. ``shapley`` is what the step's
    filter removes summed over all orders. The number of rows grows with the factorial
    of the number of filters; more than seven are refused.
    """
    letters = "".join(sorted(letters))
    if len(letters) > 7:
        raise ValueError("an audit takes at most seven filters")
    names = ["".join(p) for p in permutations(letters)]
    bits = [[1 << letters.index(c) for c in name] for name in names]
    orders = F.lit(bits)
    size = len(letters)
    zeros = F.array_repeat(F.struct(*[F.lit(0).cast("bigint").alias(c) for c in COUNTS]),
                           len(names) * size)

    def added(total: Column, cell: Column) -> Column:
        return F.zip_with(total, _fold(cell, orders), lambda a, b: F.struct(
            *[(a[c] + b[c]).alias(c) for c in COUNTS]))

    merged = cells.groupBy("part").agg(
        # at most four cells a mask
        F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells")
    ).select("part", F.aggregate("cells", zeros, added).alias("steps"))
    flat_bits = F.lit([b for order in bits for b in order])
    per_filter = F.transform(
        F.lit([1 << i for i in range(size)]),
        lambda bit: F.aggregate(
            F.arrays_zip(F.col("steps.removed").alias("removed"), flat_bits.alias("bit")),
            F.lit(0).cast("bigint"),
            lambda total, x: total + F.when(x["bit"] == bit, x["removed"]).otherwise(F.lit(0))))
    rows = merged.withColumn("shapley", per_filter).select(
        "part", "shapley", F.posexplode("steps").alias("at", "s"))
    order = F.element_at(F.lit(names), (F.floor(F.col("at") / size) + 1).cast("int"))
    step = (F.col("at") % size + 1).cast("int")
    rows = rows.select("part", order.alias("filter_order"), step.alias("step"), "s.*", "shapley")
    return rows.withColumn("shapley", F.element_at("shapley", F.instr(
        F.lit(letters), F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five built-in filters, per language."""
    failures = text_failures(F.col("text"))
    return audit(mask_cells(docs, labels, failures), "".join([*failures, COPY]))


def duck_audit(docs: str = "documents", labels: str = "labels") -> str:
    """DuckDB SQL for ``audit_filters``: one row a document, order and step."""
    blank = " \\t\\n\\x0B\\f\\r"
    return f"""with
t as materialized (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from {docs}),
w as materialized (select *, regexp_extract_all(text, '[^{blank}]+') as ws,
  min(doc_id) over (partition by text) as first from t),
f as materialized (select doc_id, part, (case when len(ws) < {MIN_WORDS} then 'A' else '' end)
  || (case when 100 * len(list_distinct(ws)) < {DISTINCT_PERCENT} * len(ws) then 'B' else '' end)
  || (case when 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > {UPPER_PERCENT} * len(text) then 'C' else '' end)
  || (case when regexp_matches(text, '[{SYMBOLS}]') then 'D' else '' end)
  || (case when doc_id > first then 'E' else '' end) as fails from w),
mark as (select doc_id, max(quality) = 1 as good, max(toxic) = 1 as toxic from {labels} group by doc_id),
cell as materialized (select part, fails, coalesce(good, false) as good, coalesce(toxic, false) as toxic, count(*) as n
  from f left join mark using (doc_id) group by all),
letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
orders as materialized (select a.c || b.c || c.c || d.c || e.c as filter_order
  from letter a join letter b on b.c <> a.c join letter c on c.c not in (a.c, b.c)
  join letter d on d.c not in (a.c, b.c, c.c) join letter e on e.c not in (a.c, b.c, c.c, d.c)),
places as materialized (select filter_order, unnest(range(1, 6))::int as step from orders),
seen as (select *, filter_order[step] as letter, contains(fails, filter_order[step]) as failing,
  len(translate(fails, filter_order[:step - 1], '')) < len(fails) as gone from places, cell),
counted as (select part, filter_order, step, any_value(letter) as letter,
  sum(n) filter (not gone and not failing) as kept, sum(n) filter (not gone and failing) as removed,
  sum(n) filter (gone and failing) as redundant, sum(n) filter (fails = letter) as unique_fails,
  sum(n) filter (not gone and failing and good) as good_lost,
  sum(n) filter (not gone and failing and toxic) as toxic_lost
  from seen group by part, filter_order, step)
select part, filter_order, step, {', '.join(f'coalesce({c}, 0)::bigint as {c}' for c in COUNTS)},
  coalesce(sum(removed) over (partition by part, letter), 0)::bigint as shapley from counted"""
