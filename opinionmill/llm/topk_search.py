"""Exact BM25 top-k by block-max pruning over sharded inverted indexes.

Document counts, lengths and term frequencies are summed over the whole corpus
first, so a shard scores exactly as one index of everything would. A task cuts its
documents into shards of about ``SHARD_TOKENS`` tokens; each shard inverts its
documents into posting lists with the largest impact of every block of
``BLOCK_DOCS`` documents. A query's blocks are bounded by the sums of those
maxima: the most promising are scored first and set the k-th best score, and of
the others only those whose bound still reaches it are scored. The shards' best
are merged in each task, then across tasks; ties go to the smaller id. Scores are rounded to 6 decimals first.

Documents are dealt by hash to levels, the first of about ``FIRST_DOCS``, all up to a level
``GROWTH`` times those before. A level hands out only what beats the k-th best of the
levels before it, so that a query's rows grow with the number of levels, not of tasks.

A query is the ``TERMS`` words of its row with the largest tf * idf, weighed over
the whole text. Queries are sent in groups of ``QUERY_GROUP`` (a bounded
broadcast); further groups take further passes over the documents.

Defined results: null and empty texts have no terms: as documents they count, but
are never found, as queries they give no rows. Every row with an id is a document and,
among the queries, a query of its own, whatever ids repeat: the hits of rows that share
a query id stand beside each other with ranks of their own, those of equal rows are
searched once and repeated. Rows without an id are neither counted, found nor asked. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinionmill.llm.tables import written
from opinionmill.llm.wordarrays import Chunk, chunks

#: What tells queries apart: the id and 128 bits of the text, besides how often the row is there.
QUERY = ["query_id", "text_a", "text_b", "copies"]
K1, B = 1.2, 0.75
TERMS = 16
SHARD_TOKENS = 1 << 20
BLOCK_DOCS = 64
QUERY_GROUP = 16_384
FIRST_DOCS, FIRST_TASKS, GROWTH = 8192, 2, 8
DIGITS = 6


def postings(chunk: Chunk) -> tuple[np.ndarray, ...]:
    """Row, word hash, frequency and first byte span of each row's distinct words."""
    starts, ends = chunk.words()
    h = chunk.hashes(starts, ends)
    row = np.searchsorted(chunk.bounds, starts, side="right") - 1
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    tf = np.diff(np.append(first, len(h)))
    return row[first], h[first], tf, starts[order][first], ends[order][first]


def corpus_statistics(texts: DataFrame) -> tuple[DataFrame, int, float]:
    """``h, df`` of every term (written), number of documents, mean length."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, tokens = [], 0
            for chunk in chunks(batch.column(0), fold=True):
                _, h, tf, _, _ = postings(chunk)
                found.append(np.unique(h, return_counts=True))
                tokens += int(tf.sum())
            if not found:
                continue
            word, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            df = np.bincount(at, np.concatenate([f[1] for f in found]), len(word)).astype(np.int64)
            yield pa.record_batch({
                "h": pa.array(np.append(word.view(np.int64), 0)), "df": pa.array(np.append(df, 0)),
                "docs": pa.array(np.append(np.zeros(len(word), np.int64), batch.num_rows)),
                "tokens": pa.array(np.append(np.zeros(len(word), np.int64), tokens))})

    per = texts.mapInArrow(count, "h bigint, df bigint, docs bigint, tokens bigint").groupBy("h").agg(
        F.sum("df").alias("df"), F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    per = written(per, "terms")
    docs, tokens = per.agg(F.sum("docs"), F.sum("tokens")).first()
    return per.select("h", "df"), docs or 0, (tokens or 0) / docs if docs else 0.0


def query_terms(queries: DataFrame, terms: DataFrame, n_docs: int, limit: int = TERMS) -> DataFrame:
    """``QUERY``, ``h, idf, place`` of the heaviest terms of each query."""
    # equal rows are one query; the copies of a row combine before the shuffle
    apart = queries.select(
        "query_id", F.xxhash64(F.lit(1), "text").alias("text_a"),
        F.xxhash64(F.lit(2), "text").alias("text_b"), "text").groupBy(*QUERY[:3]).agg(
        F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(4), fold=True):
                row, h, tf, s, e = postings(chunk)
                at = pa.array(row + chunk.first)
                yield pa.record_batch({
                    **{name: batch.column(i).take(at) for i, name in enumerate(QUERY)},
                    "h": pa.array(h.view(np.int64)), "tf": pa.array(tf, pa.int64()),
                    "word": pa.array([chunk.text(a, b) for a, b in zip(s, e, strict=True)], pa.binary())})

    asked = apart.select(*QUERY, "text").mapInArrow(
        run, ", ".join(f"{c} bigint" for c in QUERY) + ", h bigint, tf bigint, word binary")
    idf = F.log(F.lit(1.0) + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(terms, "h").withColumn("idf", idf).withColumn("w", F.col("tf") * F.col("idf"))
    place = Window.partitionBy(*QUERY).orderBy(F.desc("w"), "word")
    return weighed.withColumn("place", F.row_number().over(place)).where(
        F.col("place") <= limit).select(*QUERY, "h", "idf", "place")


class Group:
    """A group of queries as arrays: distinct terms, and each query's terms."""

    def __init__(self, query: np.ndarray, h: np.ndarray, idf: np.ndarray) -> None:
        self.terms, at = np.unique(h.view(np.uint64), return_inverse=True)
        self.idf = np.zeros(len(self.terms))
        self.idf[at] = idf
        self.ids, self.query = np.unique(query, return_inverse=True)
        self.term = at


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(int(size.sum()))


class Shard:
    """Posting lists of the terms a group asks for, with block maxima."""

    def __init__(self, group: Group, doc_ids: np.ndarray, lengths: np.ndarray,
                 doc: np.ndarray, h: np.ndarray, tf: np.ndarray, mean: float) -> None:
        at = np.minimum(np.searchsorted(group.terms, h), len(group.terms) - 1)
        asked = group.terms[at] == h
        term, doc, tf = at[asked], doc[asked], tf[asked]
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order], tf[order]
        norm = K1 * (1 - B + B * lengths[doc] / mean)
        self.doc_ids, self.doc = doc_ids, doc
        self.impact = group.idf[term] * tf * (K1 + 1) / (tf + norm)
        self.blocks = len(doc_ids) // BLOCK_DOCS + 1
        key = term * self.blocks + doc // BLOCK_DOCS
        self.block_first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.block_key = key[self.block_first]
        self.block_size = np.diff(np.append(self.block_first, len(key)))
        self.block_max = np.maximum.reduceat(self.impact, self.block_first) if len(key) else np.zeros(0)
        self.block_bounds = np.searchsorted(
            self.block_key, np.arange(len(group.terms) + 1) * self.blocks)

    def best(self, group: Group, k: int, floor: np.ndarray | None = None
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, document id and score of every query's best ``k``; those with less
        than ``floor``, a score for each query, may be left out."""
        empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        n = np.diff(self.block_bounds)[group.term]
        entry = _spread(self.block_bounds[:-1][group.term], n)
        if not len(entry):
            return empty
        # bound of each (query, block): the sum of its terms' maxima there
        query = np.repeat(group.query, n)
        cell = query * self.blocks + self.block_key[entry] % self.blocks
        order = np.argsort(cell, kind="stable")
        entry, cell = entry[order], cell[order]
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        bound = np.add.reduceat(self.block_max[entry], first)
        per_cell = np.diff(np.append(first, len(cell)))
        owner = cell[first] // self.blocks
        open_ = np.ones(len(first), bool) if floor is None else bound + 10.0 ** -DIGITS >= floor[owner]
        # round one: blocks with the largest bounds, k of each query at most
        rank = np.lexsort((-bound, owner))
        begin = np.searchsorted(owner, owner[rank])
        lead = np.zeros(len(first), bool)
        lead[rank] = np.arange(len(first)) - begin < k
        lead &= open_
        q1, d1, s1 = self._score(entry, first, per_cell, owner, lead)
        q1, d1, s1 = self._top(q1, d1, s1, k)
        # the k-th best so far prunes the rest
        full = np.bincount(q1, minlength=len(group.ids))
        least = np.full(len(group.ids), -np.inf)
        last = np.append(q1[1:] != q1[:-1], True)[: len(q1)]
        least[q1[last]] = s1[last]
        least[full < k] = -np.inf
        rest = ~lead & open_ & (bound + 10.0 ** -DIGITS >= least[owner])
        q2, d2, s2 = self._score(entry, first, per_cell, owner, rest)
        return self._top(*(np.concatenate(x) for x in ((q1, q2), (d1, d2), (s1, s2))), k)

    def _score(self, entry, first, per_cell, owner, wanted):
        part = entry[_spread(first[wanted], per_cell[wanted])]
        query = np.repeat(np.repeat(owner[wanted], per_cell[wanted]), self.block_size[part])
        post = _spread(self.block_first[part], self.block_size[part])
        key = query * len(self.doc_ids) + self.doc[post]
        order = np.argsort(key, kind="stable")
        key = key[order]
        if not len(key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        score = np.round(np.add.reduceat(self.impact[post[order]], head), DIGITS)
        return key[head] // len(self.doc_ids), self.doc_ids[key[head] % len(self.doc_ids)], score

    @staticmethod
    def _top(query, doc, score, k):
        order = np.lexsort((doc, -score, query))
        query, doc, score = query[order], doc[order], score[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < k
        return query[keep], doc[keep], score[keep]


class Asked:
    """A group of queries, shared with the tasks, and the names of its queries in order."""

    def __init__(self, spark: SparkSession, rows: pa.Table) -> None:
        cells = np.stack([rows[c].to_numpy() for c in QUERY])
        new = np.append(True, (cells[:, 1:] != cells[:, :-1]).any(axis=0))
        self.spark, self.named = spark, cells[:, new]
        self.shared = spark.sparkContext.broadcast(
            (Group(np.cumsum(new) - 1, rows["h"].to_numpy(), rows["idf"].to_numpy()), self.named))

    def floors(self, last: DataFrame | None) -> Broadcast:
        """Score and document of each query's ``last`` hit, for as many as have one."""
        score, doc = np.full(self.named.shape[1], -np.inf), np.zeros(self.named.shape[1], np.int64)
        if last is not None:
            place = {name: i for i, name in enumerate(zip(*self.named.tolist(), strict=True))}
            found = last.select(*QUERY, "doc_id", "score").toArrow()  # a row a query
            at = [place[name] for name in zip(*(found[c].to_pylist() for c in QUERY), strict=True)]
            score[at], doc[at] = found["score"].to_numpy(), found["doc_id"].to_numpy()
        return self.spark.sparkContext.broadcast((score, doc))


def _search_group(docs: DataFrame, asked: Asked, last: DataFrame | None, mean: float, k: int) -> DataFrame:
    """``QUERY, docs, scores``: each task's best of the queries asked, sorted by ``QUERY``,
    without those that do not come before the query's ``last``."""
    shared, floors = asked.shared, asked.floors(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (group, named), (floor, floor_doc) = shared.value, floors.value
        held: list[tuple] = []
        tokens = n_docs = 0
        # the best of all shards so far, at most k of each query
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

        def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids, lengths, doc, h, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            q, d, s = Shard(group, ids, lengths, doc, h, tf, mean).best(group, k, floor)
            ahead = (s > floor[q]) | (s == floor[q]) & (d < floor_doc[q])
            return Shard._top(*(np.concatenate(x) for x in zip(
                best, (q[ahead], d[ahead], s[ahead]), strict=True)), k)

        def batch_of(q: np.ndarray, d: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
            bounds = np.append(first, len(q)).astype(np.int32)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(bounds), pa.array(x))
            return pa.record_batch({
                **{name: pa.array(named[i][q[first]]) for i, name in enumerate(QUERY)},
                "docs": lists(d), "scores": lists(s)})

        for batch in batches:
            for chunk in chunks(batch.column(1), fold=True):
                row, h, tf, _, _ = postings(chunk)
                length = np.bincount(row, tf, chunk.rows)
                ids = batch.column(0).slice(chunk.first, chunk.rows).to_numpy(zero_copy_only=False)
                held.append((ids, length, row + n_docs, h, tf))
                n_docs += chunk.rows
                tokens += int(tf.sum())
                if tokens >= SHARD_TOKENS:
                    best = flush()
                    held, tokens, n_docs = [], 0, 0
        if held:
            best = flush()
        if len(best[0]):
            yield batch_of(*best)

    return docs.mapInArrow(
        run, ", ".join(f"{c} bigint" for c in QUERY) + ", docs array<bigint>, scores array<double>")


def _levels(source: DataFrame, n_docs: int) -> list[DataFrame]:
    """The documents in disjoint parts; all together up to each ``GROWTH`` times as many as
    before. The first is small and searched by few tasks."""
    if n_docs <= FIRST_DOCS:
        return [source]
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    cuts = [0]
    while cuts[-1] < 1 << 40:
        cuts.append(min(1 << 40, cuts[-1] * GROWTH or (1 << 40) * FIRST_DOCS // n_docs + 1))
    parts = [source.where((u >= a) & (u < b)) for a, b in pairwise(cuts)]
    return [parts[0].repartition(FIRST_TASKS), *parts[1:]]


def search(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id",
           text: str = "text", terms: int = TERMS) -> DataFrame:
    """``query_id, rank, doc_id, score``: the ``k`` best documents of each query.

    ``queries`` has the same id and text columns as ``docs``.
    """
    source = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    asked = queries.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("bigint").alias("query_id"), F.col(text).alias("text"))
    stats, n_docs, mean = corpus_statistics(source.select("text"))
    chosen = written(query_terms(asked, stats, n_docs, terms), "query-terms")
    ids = chosen.where("place = 1").count()
    groups = max(1, math.ceil(ids / QUERY_GROUP * 1.1)) if ids > QUERY_GROUP else 1
    asked = []
    for g in range(groups):
        mine = chosen.where(F.pmod(F.xxhash64(*QUERY), F.lit(groups)) == g)
        rows = mine.orderBy(*QUERY, "place").toArrow()  # about QUERY_GROUP * terms rows
        if rows.num_rows:
            asked.append((g, Asked(docs.sparkSession, rows)))
    if not asked:
        return docs.sparkSession.createDataFrame(
            [], "query_id bigint, rank int, doc_id bigint, score double")
    place = Window.partitionBy(*QUERY).orderBy(F.desc("score"), "doc_id")
    ranked = None
    for part in _levels(source, n_docs):
        if ranked is not None:
            ranked = written(ranked, "best-so-far")
        found = []
        for g, group in asked:
            last = None if ranked is None else ranked.where(
                (F.col("rank") == k) & (F.pmod(F.xxhash64(*QUERY), F.lit(groups)) == g))
            found.append(_search_group(part, group, last, mean, k))
        best = reduce(DataFrame.union, found).select(
            *QUERY, F.explode(F.arrays_zip("docs", "scores")).alias("x")).select(
            *QUERY, F.col("x.docs").alias("doc_id"), F.col("x.scores").alias("score"))
        best = best if ranked is None else best.union(ranked.drop("rank"))
        ranked = best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select(
        "query_id", "rank", "doc_id", "score",
        F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy")).drop("copy")
