"""Ranked lexical search over hashed sketches of maxima, exact.

Documents are tokenised once into shards, which are written: per shard its vocabulary and,
document by document, term numbers and frequencies. To search, a task folds the impact of
every term of a document into the larger of what its two hashed coordinates hold. Looking
up the terms of a query there gives at least what the document scores, however many terms
share a coordinate. Documents are then scored exactly by descending bound, until a bound
is below the k-th best score that the task has found so far, in this or earlier shards.
Each task hands on ``k`` rows a query, which are merged in two steps.

Corpus statistics come from all documents. Queries are collected in batches of at most
about ``BATCH_PAIRS`` (query, term) pairs, the next batch reads the same shards; a query
with more terms than that is a batch of its own, as its text is one row anyway. Terms are
found by 64-bit hash and then compared byte by byte, so none is taken for another.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, with only
A-Z lower-cased. Impacts are integers, see ``impacts``; equal scores go by ascending id.

Defined results: null and blank texts have no terms; such documents are never found and do
not count as documents, such queries have no rows. Rows that repeat a document id are
documents of their own; a null id comes after all others. Rows that share a query id (null
too) are one query whose terms are counted together. Empty tables give no rows. One text
is handled whole in memory, at about forty times its size. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinionmill.llm.tables import written
from opinionmill.llm.wordarrays import Chunk, chunks, mix

K = 20
WIDTH = 2048
#: Documents of one sketch, bytes of the texts of a shard, documents scored at a time.
BLOCK = 2048
SHARD_BYTES = 1 << 20
STEP = 32
BATCH_PAIRS = 200_000
#: Sketches hold impacts in units of this size, rounded up.
UNIT = 16
SALTS = 64

_TERM = np.zeros(256, dtype=bool)
_TERM[0x80:] = True
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    _TERM[ord(_a): ord(_b) + 1] = True

_SHARD = ("ids array<bigint>, n_docs bigint, n_terms bigint, lengths binary, vocabulary binary, "
          "df binary, names binary, bounds binary, terms binary, counts binary")
_SHARD_FIELDS = pa.schema([
    (name, {"array<bigint>": pa.list_(pa.int64()), "bigint": pa.int64(), "binary": pa.binary()}[kind])
    for name, kind in (field.split(" ") for field in _SHARD.split(", "))])
_PAIRS = "query bigint, term string, n bigint"
_HITS = "query bigint, doc_id bigint, score bigint"


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds per unit of its weight: below a million, in whole numbers."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def length_factors(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 75 + (25 * lengths * n_docs) // n_terms


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# --------------------------------------------------------------------------- shards


def term_spans(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end byte of each term; row bounds end terms."""
    n = len(chunk.data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = _TERM[chunk.data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[chunk.bounds] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends


def _spans_equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    return bool((data[place + np.repeat(a, size)] == data[place + np.repeat(b, size)]).all())


def vocabulary_of(chunk: Chunk, starts: np.ndarray, ends: np.ndarray
                  ) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Hashes in ascending order, names and, for each span, its term number."""
    hashes = chunk.hashes(starts, ends)
    found, at, number = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends - starts
    like = at[number]
    if (size == size[like]).all() and _spans_equal(chunk.data, starts, starts[like], size):
        return found, [chunk.text(starts[i], ends[i]) for i in at.tolist()], number
    names = [chunk.text(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    both = sorted(set(zip(hashes.tolist(), names, strict=True)))
    place = {name: i for i, (_, name) in enumerate(both)}
    return (np.array([h for h, _ in both], np.uint64), [name for _, name in both],
            np.array([place[x] for x in names], np.int64))


def shard_row(chunk: Chunk, ids: pa.Array) -> dict:
    starts, ends = term_spans(chunk)
    row_bounds = np.searchsorted(starts, chunk.bounds)
    lengths = np.diff(row_bounds)
    if len(starts):
        hashes, names, number = vocabulary_of(chunk, starts, ends)
    else:
        hashes, names, number = np.zeros(0, np.uint64), [], np.zeros(0, np.int64)
    docs = np.repeat(np.arange(chunk.rows), lengths)
    pairs, counts = np.unique(docs * max(len(names), 1) + number, return_counts=True)
    doc, term = np.divmod(pairs, max(len(names), 1))
    return {
        "ids": ids, "n_docs": int((lengths > 0).sum()), "n_terms": len(starts),
        "lengths": lengths.astype(np.int64).tobytes(), "vocabulary": hashes.tobytes(),
        # all below 2 ** 31, as a text has fewer bytes
        "df": np.bincount(term, minlength=len(names)).astype(np.int32).tobytes(),
        "names": b" ".join(names),
        "bounds": np.searchsorted(doc, np.arange(chunk.rows + 1)).astype(np.int32).tobytes(),
        "terms": term.astype(np.int32).tobytes(), "counts": counts.astype(np.int32).tobytes(),
    }


def build_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The written shards of all documents, in the order in which they are read."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for chunk in chunks(batch.column(1), fold=True, size=SHARD_BYTES):
                row = shard_row(chunk, ids.slice(chunk.first, chunk.rows).to_pylist())
                yield pa.RecordBatch.from_pylist([row], _SHARD_FIELDS)

    rows = docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    return written(rows.mapInArrow(build, _SHARD), "search-shards")


# -------------------------------------------------------------------------- queries


@dataclass
class Batch:
    """Queries with their terms: query ``i`` has ``bounds[i]`` … ``bounds[i + 1]``."""

    queries: list[int | None]
    bounds: np.ndarray
    term: np.ndarray  # numbers into hashes and names
    n: np.ndarray
    hashes: np.ndarray
    names: list[bytes]

    @staticmethod
    def of(rows: list) -> Batch:
        names = sorted({r["term"].encode() for r in rows})
        place = {x: i for i, x in enumerate(names)}
        rows = sorted(rows, key=lambda r: (r["query"] is None, r["query"] or 0))
        queries = list(dict.fromkeys(r["query"] for r in rows))
        many: dict = {}
        for r in rows:
            many[r["query"]] = many.get(r["query"], 0) + 1
        ends = np.cumsum([0, *map(len, names)])
        chunk = Chunk(0, np.frombuffer(b"".join(names), np.uint8), ends, True)
        return Batch(
            queries, np.cumsum([0, *(many[q] for q in queries)]),
            np.array([place[r["term"].encode()] for r in rows], np.int64),
            np.array([r["n"] for r in rows], np.int64),
            chunk.hashes(ends[:-1], ends[1:]), names)

    def numbers(self, row: dict) -> np.ndarray:
        """The shard's number of each term, -1 where the shard lacks it."""
        hashes = np.frombuffer(row["vocabulary"], np.uint64)
        names = row["names"]
        ends = np.append(np.flatnonzero(np.frombuffer(names, np.uint8) == 0x20), len(names))
        starts = np.append(0, ends[:-1] + 1)
        out = np.full(len(self.names), -1, np.int64)
        first = np.searchsorted(hashes, self.hashes)
        last = np.searchsorted(hashes, self.hashes, side="right")
        for i in np.flatnonzero(first < last).tolist():
            for j in range(int(first[i]), int(last[i])):
                if names[starts[j]: ends[j]] == self.names[i]:
                    out[i] = j
        return out


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """``query``, ``term``, ``n``: how often each query has each of its terms."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1), fold=True):
                starts, ends = term_spans(chunk)
                if not len(starts):
                    continue
                _, names, number = vocabulary_of(chunk, starts, ends)
                row = np.searchsorted(chunk.bounds, starts, side="right") - 1
                pairs, n = np.unique(row * len(names) + number, return_counts=True)
                at, term = np.divmod(pairs, len(names))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(chunk.first, chunk.rows).take(pa.array(at)),
                    pa.array([names[i].decode() for i in term.tolist()], pa.string()),
                    pa.array(n, pa.int64())], names=["query", "term", "n"])

    rows = queries.select(F.col(query_id).cast("bigint").alias("query"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(count, _PAIRS).groupBy("query", "term").agg(F.sum("n").alias("n"))


def document_frequencies(shards: DataFrame, batch: Batch) -> np.ndarray:
    """In how many documents each term of the batch occurs; one row a term and task."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(batch.names), np.int64)
        for part in batches:
            for row in part.to_pylist():
                at = batch.numbers(row)
                here = at >= 0
                total[here] += np.frombuffer(row["df"], np.int32)[at[here]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    rows = shards.select("vocabulary", "df", "names").mapInArrow(
        count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(len(batch.names), np.int64)
    for r in rows:
        out[r["term"]] = r["df"]
    return out


# --------------------------------------------------------------------------- search


def coordinates(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two coordinates of each term, from separate bits of a rehash."""
    h = mix(hashes)
    return ((h & np.uint64(0xFFFFFFFF)) % np.uint64(WIDTH)).astype(np.int64), (
        (h >> np.uint64(32)) % np.uint64(WIDTH)).astype(np.int64)


class Best:
    """The k best documents of one query so far."""

    def __init__(self, k: int):
        self.k = k
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A score that a document needs at least to have a chance."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        fits = score >= self.least
        if not fits.any():
            return
        score = np.concatenate([self.score, score[fits]])
        ids = np.concatenate([self.id, ids[fits]])
        null = np.concatenate([self.null, null[fits]])
        best = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.id, self.null = score[best], ids[best], null[best]


class Shard:
    """One shard with the corpus totals, searched block by block."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.row = row
        self.ids = np.array([0 if x is None else x for x in row["ids"]], np.int64)
        self.null = np.array([x is None for x in row["ids"]], bool)
        self.m = length_factors(np.frombuffer(row["lengths"], np.int64), n_docs, n_terms)
        self.hashes = np.frombuffer(row["vocabulary"], np.uint64)
        self.bounds = np.frombuffer(row["bounds"], np.int32).astype(np.int64)
        self.terms = np.frombuffer(row["terms"], np.int32).astype(np.int64)
        self.counts = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        docs = np.repeat(np.arange(len(self.ids)), np.diff(self.bounds))
        self.key = docs * max(len(self.hashes), 1) + self.terms
        self.impact = impacts(self.counts, self.m[docs])
        self.docs = docs

    def sketches(self, first: int, last: int) -> list[np.ndarray]:
        """Coordinate by document: the largest impact that any of its terms put there."""
        a, b = self.bounds[first], self.bounds[last]
        units = (-(-self.impact[a:b] // UNIT)).astype(np.uint16)
        doc, out = self.docs[a:b] - first, []
        for place in coordinates(self.hashes):
            flat = np.zeros(WIDTH * (last - first), np.uint16)
            np.maximum.at(flat, place[self.terms[a:b]] * (last - first) + doc, units)
            out.append(flat.reshape(WIDTH, last - first))
        return out

    def scores(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of documents for the shard's ``terms``."""
        want = docs[:, None] * max(len(self.hashes), 1) + terms[None, :]
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return (np.where(self.key[at] == want, self.impact[at], 0) * weights).sum(axis=1)

    def search(self, batch: Batch, weights: np.ndarray, best: list[Best]) -> int:
        """Improve ``best``; gives the number of documents scored."""
        number, scored = batch.numbers(self.row), 0
        places = coordinates(batch.hashes)
        for first in range(0, len(self.ids), BLOCK):
            last = min(first + BLOCK, len(self.ids))
            one, two = self.sketches(first, last)
            for i, top in enumerate(best):
                span = slice(batch.bounds[i], batch.bounds[i + 1])
                terms, w = batch.term[span], weights[span]
                here = number[terms] >= 0  # other terms add nothing in this shard
                terms, w = terms[here], w[here]
                if not len(terms):
                    continue
                units = np.minimum(one[places[0][terms]], two[places[1][terms]])
                # whole numbers far below 2 ** 53
                bound = w.astype(np.float64) @ units.astype(np.float64) * UNIT
                hope = np.flatnonzero(bound >= top.least)
                hope = hope[np.argsort(-bound[hope], kind="stable")]
                for k in range(0, len(hope), STEP):
                    part = hope[k: k + STEP]
                    part = part[bound[part] >= top.least]
                    if not len(part):
                        break
                    at = part + first
                    top.add(self.scores(at, number[terms], w), self.ids[at], self.null[at])
                    scored += len(part)
        return scored


def _batches(pairs: DataFrame) -> Iterator[Batch]:
    groups = -(-pairs.count() // BATCH_PAIRS)
    for i in range(groups):
        rows = pairs.where(F.pmod(F.xxhash64("query"), F.lit(groups)) == i).collect()
        if rows:
            yield Batch.of(rows)


def _first(hits: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_search(
    docs: DataFrame, queries: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text",
    query_id: str = "item_id", query_text: str = "text",
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``doc_id``, ``score``: the k best with a score above 0."""
    shards = build_shards(docs, doc_id, text)
    total = shards.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n_docs, n_terms = total["docs"] or 0, total["terms"] or 0
    hits = None
    if n_terms:
        pairs = written(query_terms(queries, query_id, query_text), "search-queries")
        for batch in _batches(pairs):
            df = document_frequencies(shards, batch)
            by_term = np.array([weight(int(x), n_docs) for x in df], np.int64)
            found = _search_shards(shards, batch, batch.n * by_term[batch.term], k, n_docs, n_terms)
            hits = found if hits is None else hits.unionAll(found)
    if hits is None:
        hits = docs.sparkSession.createDataFrame([], _HITS)
    hits = hits.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    hits = _first(_first(hits, k, "query", "salt"), k, "query")
    return hits.select(F.col("query").alias(query_id), "rank", "doc_id", "score")


def _search_shards(shards: DataFrame, batch: Batch, weights: np.ndarray, k: int,
                   n_docs: int, n_terms: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in batch.queries]
        for part in batches:
            for i in range(part.num_rows):
                row = part.slice(i, 1).to_pylist()[0]
                Shard(row, n_docs, n_terms).search(batch, weights, best)
        size = [len(b.score) for b in best]
        ids = np.concatenate([b.id for b in best])
        null = np.concatenate([b.null for b in best])
        yield pa.RecordBatch.from_arrays([
            pa.array(batch.queries, pa.int64()).take(pa.array(np.repeat(np.arange(len(best)), size))),
            pa.array(ids, pa.int64(), mask=null),
            pa.array(np.concatenate([b.score for b in best]), pa.int64()),
        ], names=["query", "doc_id", "score"])

    return shards.mapInArrow(search, _HITS)


def duck_ranked(docs: str = "documents", items: str = "benchmark", k: int = K) -> str:
    """DuckDB SQL for ``ranked_search``: every document is scored."""
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""with
d as materialized (select row_number() over () as row, doc_id, regexp_extract_all({lower}, '{term}') as ws from {docs}),
asked as materialized (select item_id, term, count(*) as qtf
  from (select item_id, unnest(regexp_extract_all({lower}, '{term}')) as term from {items}) group by all),
total as materialized (select count(*) filter (len(ws) > 0) as n_docs, sum(len(ws))::bigint as n_terms from d),
tf as materialized (select row, term, count(*) as tf from (select row, unnest(ws) as term from d)
  where term in (select term from asked) group by all),
w as materialized (select term, floor(1000 * ln((2.0 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::bigint as w
  from tf, total group by term),
m as (select row, doc_id, 75 + (25 * len(ws) * n_docs) // n_terms as m from d, total where len(ws) > 0),
scored as (select item_id, row, any_value(doc_id) as doc_id,
  sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
  from asked join w using (term) join tf using (term) join m using (row) group by item_id, row)
select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank,
  doc_id, score from scored where score > 0 qualify rank <= {k}"""
