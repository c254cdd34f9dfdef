"""Line dedup within an edit bound of one word, by deletion neighbourhoods.

A line is compared as its sequence of words. Two lines are near when one word
inserted, deleted or replaced turns one into the other. A line goes when an equal
or near line stands earlier (by document id, then line number), whether or not
that line stays; lines of fewer than ``MIN_WORDS`` words always stay.

Steps, all of them DataFrame operations:

1. Every line becomes a row of hashes; equal lines meet in one aggregate.
2. Near lines agree in their first or in their last half. Only distinct lines that
   share such a half with another go on (an exact filter, four keys a line).
3. Those emit every one-word deletion outside the shared half as a hashed key. Lines replaced in the same
   place share ``(variant, place)``; a line and its lengthened form share the
   shorter line itself. An aggregate per key finds the earliest member, so a key
   of any size gives one row per line and never pairs.
4. The words of each line and of the earliest partner found are compared.

No step gathers a key's rows: aggregates combine before their shuffle, and the
joins are plain equi-joins that Spark splits where one key is hot.

Defined results: null texts stay null, empty ones empty; a document may lose all
its lines and then has an empty text. A null id comes after all others. Rows that share
an id are documents of their own if their texts differ, in the order of the texts' MD5;
rows that repeat both are one document, and all of them keep the same lines. Where ids
repeat, documents are numbered in that order first. An empty table gives an empty result;
other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionmill.llm.columns import let
from opinionmill.llm.tables import packed, unpacked, written
from opinionmill.plans.scale import global_index

MIN_WORDS = 5
_LAST = (1 << 63) - 1
_SHIFT = 1 << 32


def _doc_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("bigint"), F.lit(_LAST))


def _place(key: Column, line: Column) -> Column:
    """Document and line number as one ordered number that aggregates in place."""
    return (key.cast("decimal(20,0)") * F.lit(_SHIFT).cast("decimal(10,0)")
            + line.cast("decimal(10,0)")).cast("decimal(31,0)")


def _squeezed(text: Column) -> Column:
    """Each run of blanks inside a line as one space; line breaks stay."""
    odd = F.contains(text, F.lit("  "))
    for blank in "\t\x0b\f\r":
        odd = odd | F.contains(text, F.lit(blank))
    return F.when(odd, F.regexp_replace(text, r"[ \t\x0B\f\r]+", " ")).otherwise(text)


def _half_keys(t: Column, n: Column) -> list[Column]:
    """First and last half of a squeezed line, as a line of its length and of one word less."""
    def words(count: Column) -> Column:
        return F.call_function("substring_index", t, F.lit(" "), count)

    def of(length: Column) -> list[Column]:
        half = F.floor(length / 2).cast("int")
        return [F.xxhash64(F.lit("head"), length, words(half)),
                F.xxhash64(F.lit("tail"), length, words(half - length))]
    return [*of(n), *of(n - 1)]


_HALVES = ["k1", "k2", "k3", "k4"]


def _line_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``dk, line, h`` and the half keys of every line that can be removed."""
    lines = docs.where(F.col(text).isNotNull()).select(
        _doc_key(F.col(doc_id)).alias("dk"),
        F.posexplode(F.split(_squeezed(F.col(text)), "\n")).alias("line", "_l"))
    lines = lines.select("dk", "line", F.trim("_l").alias("t")).withColumn(
        "n", (F.octet_length("t") - F.octet_length(F.replace("t", F.lit(" "), F.lit(""))) + 1).cast("int"))
    return lines.where(F.col("n") >= MIN_WORDS).select("dk", "line", F.xxhash64("t").alias("h"), *(
        k.alias(name) for k, name in zip(_half_keys(F.col("t"), F.col("n")), _HALVES, strict=True)))


def _near(a: Column, b: Column) -> Column:
    """Whether two arrays of words are within one edit (or equal)."""
    def longer(short: Column, long: Column) -> Column:
        same = F.zip_with(short, F.slice(long, F.lit(1), F.size(short)), lambda x, y: x == y)
        return let(same, lambda s: let(
            F.when(F.array_contains(s, False), F.array_position(s, False).cast("int") - 1)
            .otherwise(F.size(short)),
            lambda p: F.slice(long, p + 2, F.size(long)) == F.slice(short, p + 1, F.size(long))))

    differing = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d))
    return F.when(F.size(a) == F.size(b), differing <= 1).when(
        F.size(a) + 1 == F.size(b), longer(a, b)).when(
        F.size(b) + 1 == F.size(a), longer(b, a)).otherwise(F.lit(False))


def _variant_keys(w: Column, head: Column, tail: Column) -> Column:
    """The line's own key (``p`` 0) and one for each word ``p`` left out.

    A line whose first half alone is shared can only differ after it, one whose last
    half alone is shared only before it: words left out elsewhere could meet nothing.

    A key is the XOR of its words hashed with their places. Running XORs, of words in
    place and of words moved up by one, give every variant without building it.
    """
    def running(shift: int) -> Column:
        hashed = F.transform(w, lambda x, i: F.xxhash64(x, i - F.lit(shift)))
        return F.aggregate(hashed, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.concat(
            acc, F.array(F.element_at(acc, -1).bitwiseXOR(x))))

    def key(v: Column, size: Column, p: Column) -> Column:
        return F.struct(v.alias("v"), size.alias("n"), p.alias("p"))

    n = F.size(w)
    half = F.floor((n - 1) / 2).cast("int")
    return let(F.struct(running(0).alias("own"), running(1).alias("moved")), lambda r: F.concat(
        F.array(key(F.element_at(r["own"], -1), n, F.lit(0))),
        F.transform(F.sequence(F.when(tail, F.lit(1)).otherwise(half + 1),
                               F.when(head, n).otherwise(half + 1)), lambda p: key(
            F.get(r["own"], p - 1).bitwiseXOR(F.get(r["moved"], p)).bitwiseXOR(
                F.element_at(r["moved"], -1)), n - 1, p))))


def _near_earlier(docs: DataFrame, distinct: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Hashes ``h`` of the distinct lines that have a near line earlier."""
    halves = distinct.select("h", F.posexplode(F.array(*_HALVES)).alias("pos", "key"))
    own = F.count(F.when(F.col("pos") < 2, F.lit(1)))
    shared = halves.groupBy("key").agg(F.count("*").alias("c"), own.alias("own")).where(
        "c > 1 and own > 0").select("key")
    wanted = halves.join(shared, "key").groupBy("h").agg(
        F.max(F.col("pos") % 2 == 0).alias("head"), F.max(F.col("pos") % 2 == 1).alias("tail"))
    # first occurrence of each wanted line, by document
    spots = distinct.join(wanted, "h").select(
        "h", "first", "head", "tail", F.floor(F.col("first") / _SHIFT).cast("bigint").alias("dk"),
        (F.col("first") % _SHIFT).cast("int").alias("line"))
    by_doc = spots.groupBy("dk").agg(F.collect_list(
        F.struct("line", "h", "first", "head", "tail")).alias("spots"))
    source = docs.where(F.col(text).isNotNull()).select(
        _doc_key(F.col(doc_id)).alias("dk"), F.col(text).alias("_text"))
    lines = source.join(by_doc, "dk").select(let(F.split(F.col("_text"), "\n"), lambda ls: F.transform(
        F.col("spots"), lambda s: F.struct(
            *(s[c].alias(c) for c in ("h", "first", "head", "tail")),
            F.trim(_squeezed(F.get(ls, s["line"]))).alias("t")))).alias("found"))
    candidates = lines.select(F.explode("found").alias("f")).select("f.*")
    # rows that share an id can hold different texts: keep what the hash names
    candidates = written(candidates.where(F.xxhash64("t") == F.col("h")).select(
        "h", "first", "head", "tail", F.split("t", " ").alias("w")), "line-candidates")

    keys = candidates.select("h", "first", F.explode(
        _variant_keys(F.col("w"), F.col("head"), F.col("tail"))).alias("k")).select(
        "h", "first", "k.*")
    keys = written(keys, "line-variants")
    per_place = keys.where("p > 0").groupBy("v", "n", "p").agg(
        F.min("first").alias("best"), F.max("first").alias("worst")).where("best < worst")
    replaced = keys.join(per_place, ["v", "n", "p"]).where("best < first").select("h", "first", "best")
    # distinct lines have distinct own keys, so a variant meets at most one shorter line
    shorter = keys.where("p = 0").select("v", "n", F.col("h").alias("sh"), F.col("first").alias("sf"))
    met = keys.where("p > 0").join(shorter, ["v", "n"]).select(
        F.when(F.col("sf") < F.col("first"), F.struct("h", "first", F.col("sf").alias("best")))
        .otherwise(F.struct(F.col("sh").alias("h"), F.col("sf").alias("first"), F.col("first").alias("best")))
        .alias("m"))
    edited = met.select("m.*")
    pairs = replaced.union(edited).groupBy("h").agg(
        F.min("first").alias("first"), F.min("best").alias("best"))
    words = candidates.select(F.col("first").alias("at"), "w").dropDuplicates(["at"])
    a = words.select(F.col("at").alias("first"), F.col("w").alias("mine"))
    b = words.select(F.col("at").alias("best"), F.col("w").alias("other"))
    checked = pairs.join(a, "first").join(b, "best")
    return checked.where(_near(F.col("mine"), F.col("other"))).select("h")


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``dk`` and the array ``gone`` of line numbers (from 0) that go."""
    lines = written(_line_rows(docs, doc_id, text), "lines")
    lines = lines.withColumn("at", _place(F.col("dk"), F.col("line")))
    distinct = lines.groupBy("h").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), *(F.first(k).alias(k) for k in _HALVES))
    distinct = written(distinct, "distinct-lines")
    near = _near_earlier(docs, distinct, doc_id, text).withColumn("near", F.lit(True))
    judged = distinct.select("h", "first", "last").join(near, "h", "left").where(
        "near or first < last").select("h", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.select("h", "at", "dk", "line").join(judged, "h").where("near or at > first")
    return gone.groupBy("dk").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def _numbered(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the number ``dk`` of their document, and each document once.

    Ids that no two rows share are such numbers themselves. Else documents are the
    distinct pairs of id and text, numbered by a range sort of ids and digests.
    """
    rows = packed(docs, dk=_doc_key(F.col(f"`{doc_id}`")), text=F.col(f"`{text}`"))
    if rows.groupBy("dk").count().where("count > 1").isEmpty():
        return rows, rows.select("dk", "text")
    null = F.col(f"`{doc_id}`").isNull()
    own = F.struct(null.alias("none"), _doc_key(F.col(f"`{doc_id}`")).alias("dk"),
                   F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("digest"))
    rows = packed(docs, own=own, text=F.col(f"`{text}`"))
    each = written(rows.groupBy("own").agg(F.first("text", ignorenulls=True).alias("text")), "line-documents")
    placed = global_index(each.select("own"), ["own"], "dk")
    return rows.join(placed, "own").drop("own"), each.join(placed, "own").select("dk", "text")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                count_as: str | None = None) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``.

    ``count_as`` names an extra column with the number of lines taken out.
    """
    rows, each = _numbered(docs, doc_id, text)
    joined = rows.join(removed_lines(each, "dk", "text"), "dk", "left")
    kept = F.array_join(F.filter(
        F.split(F.col("text"), "\n"), lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    new = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)
    columns = unpacked(docs, **{text: new})
    if count_as:
        # a null text has no lines, whatever a document equal but for it lost
        lost = F.when(F.col("text").isNotNull(), F.size("gone"))
        columns.append(F.coalesce(lost, F.lit(0)).cast("bigint").alias(count_as))
    return joined.select(*columns)


def duck_lines(docs: str) -> str:
    """DuckDB CTEs over ``docs`` ending in ``line_deduped`` with the column ``new_text``."""
    return f"""
lsrc as materialized (select *, string_split(text, chr(10)) as ls,
  dense_rank() over (order by doc_id nulls last, md5(text)) as dr from {docs}),
lall as (select distinct dr, unnest(ls) as l, unnest(range(len(ls))) as i from lsrc),
lw as materialized (select dr, i, (dr::hugeint * {_SHIFT} + i) as place,
  regexp_extract_all(l, '[^ \\t\\n\\x0B\\f\\r]+') as w from lall),
ld as materialized (select w, min(place) as first from lw where len(w) >= {MIN_WORDS} group by w),
lv as materialized (select first, len(w) as n, p, list_concat(w[1:p - 1], w[p + 1:]) as v
  from (select *, unnest(range(1, len(w) + 1)) as p from ld)),
lnear as (
  select a.first from lv a join (select v, n, p, min(first) as best from lv group by v, n, p) b
    on a.v = b.v and a.n = b.n and a.p = b.p where best < a.first
  union select lv.first from lv join ld on lv.v = ld.w where ld.first < lv.first
  union select ld.first from lv join ld on lv.v = ld.w where lv.first < ld.first),
lgone as materialized (select dr, i from lw join ld on lw.w = ld.w
  where place > first or first in (select first from lnear)),
lper as (select dr, list(distinct i) as gone from lgone group by dr),
line_deduped as materialized (select lsrc.* exclude (dr), coalesce(len(gone), 0)::bigint as n_removed,
  case when gone is null then text else array_to_string(list_transform(list_filter(
    list_zip(ls, range(len(ls))), lambda x: not list_contains(gone, x[2])), lambda x: x[1]), chr(10)) end as new_text
  from lsrc left join lper on lsrc.dr = lper.dr)""".lstrip("\n")
