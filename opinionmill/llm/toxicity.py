"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag has a label. A sentence's
probability is a logistic function of its words; a document is toxic when at least
one sentence is, so its probability is the noisy-or ``1 - prod(1 - p)``. Gradients
through the noisy-or train the sentence model from document labels alone, and the
same model then points at the offending sentences.

Features are hashed words and word beginnings of ``PREFIXES`` bytes (A-Z
lower-cased), so a stem is known whatever follows it. The classifier is fitted on
at most ``FIT_DOCS`` labelled documents a class, chosen by a hash of the id; texts
are scored whole, in one pass without a shuffle, by the broadcast weights
(``1 << FEATURE_BITS`` numbers). The driver gets counts by feature and, of the
documents fitted on, sentences reduced to telling features; it never gets texts.

Defined results: a null or empty text has no sentences and scores 0; ids without a
label are only scored; of rows that share an id one is fitted on, all are scored; if one class has no labelled document all scores are 0;
repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionmill.llm.tables import written
from opinionmill.llm.wordarrays import Chunk, chunks, mix

FIT_DOCS = 3000
FEATURE_BITS = 18
PREFIXES = (3, 4, 5, 6)
STEPS = 400
TELLING = 20.0
SHRINK = 1e-4
FLAG_AT = 0.7

_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), 39]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Sentences:
    """Features of a chunk: flat ids, first feature of each sentence, rows."""

    features: np.ndarray
    heads: np.ndarray
    row: np.ndarray
    first_byte: np.ndarray
    last_byte: np.ndarray


def sentences(chunk: Chunk) -> Sentences:
    """Sentences with at least one word, and the hashed features of their words."""
    n = len(chunk.data)
    none = np.zeros(0, np.int64)
    if not n:
        return Sentences(none, none, none, none, none)
    letter = _LETTER[chunk.data]
    cut = np.zeros(n + 1, bool)
    cut[chunk.bounds] = True
    head, tail = letter.copy(), letter.copy()
    head[1:] &= ~letter[:-1] | cut[1:n]
    tail[:-1] &= ~letter[1:] | cut[1:n]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    if not len(starts):
        return Sentences(none, none, none, none, none)
    kinds = [chunk.hashes(starts, ends)]
    for k in PREFIXES:
        kinds.append(mix(chunk.hashes(starts, np.minimum(starts + k, ends)) + np.uint64(k)))
    ids = (np.stack(kinds, axis=1) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64).ravel()
    row = np.searchsorted(chunk.bounds, starts, side="right") - 1
    stops = np.cumsum(_STOP[chunk.data])[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (row[1:] != row[:-1]) | (stops[1:] != stops[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return Sentences(ids, first * (1 + len(PREFIXES)), row[first], starts[first], ends[last])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def feature_counts(chunk: Chunk, toxic: np.ndarray) -> np.ndarray:
    """How many clean (row 0) and toxic (row 1) documents of a chunk hold each feature."""
    dims = 1 << FEATURE_BITS
    s = sentences(chunk)
    row = np.repeat(s.row, np.diff(np.append(s.heads, len(s.features))))
    once = np.unique(row * dims + s.features)
    return np.bincount(toxic[once // dims] * dims + once % dims, minlength=2 * dims).reshape(2, dims)


def telling(counts: np.ndarray, sizes: tuple[int, int]) -> np.ndarray:
    """Features that differ between the classes by more than chance.

    ``TELLING`` is a chi-square over documents; all others keep weight 0.
    """
    b, a = counts.astype(float)
    n0, n1 = map(float, sizes)
    chi = (a * (n0 - b) - b * (n1 - a)) ** 2 * (n0 + n1) / np.maximum(
        n1 * n0 * (a + b) * (n0 + n1 - a - b), 1)
    return np.flatnonzero(chi >= TELLING)


@dataclass
class Bag:
    """A document by its telling features: sentences alike in them stand once, counted."""

    features: list[int]
    sizes: list[int]
    times: list[int]


def bags(chunk: Chunk, told: np.ndarray) -> list[Bag]:
    """A bag for each row; ``told`` says of every feature whether it is telling."""
    s = sentences(chunk)
    kinds: list[dict[tuple[int, ...], int]] = [{} for _ in range(chunk.rows)]
    at = np.repeat(np.arange(len(s.heads)), np.diff(np.append(s.heads, len(s.features))))
    kept = told[s.features]
    at, features = at[kept], s.features[kept]
    order = np.lexsort((features, at))
    ends = np.searchsorted(at, np.arange(len(s.heads) + 1)).tolist()
    features = features[order].tolist()
    for i, row in enumerate(s.row.tolist()):
        kind = tuple(features[ends[i]:ends[i + 1]])
        kinds[row][kind] = kinds[row].get(kind, 0) + 1
    return [Bag([f for kind in sorted(k) for f in kind], [len(kind) for kind in sorted(k)],
                [k[kind] for kind in sorted(k)]) for k in kinds]


def descend(found: list[Bag], labels: np.ndarray, kept: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights of the sentence model from bags; the last one is the bias."""
    dims = 1 << FEATURE_BITS
    place = np.zeros(dims, np.int64)
    place[kept] = np.arange(len(kept))
    col = place[np.concatenate([np.array(b.features, np.int64) for b in found])]
    size = np.concatenate([np.array(b.sizes, np.int64) for b in found])
    times = np.concatenate([np.array(b.times, float) for b in found])
    owner = np.repeat(np.arange(len(found)), [len(b.sizes) for b in found])
    sentence = np.repeat(np.arange(len(size)), size)
    labels = labels.astype(float)
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    # one column more for the bias
    w = np.append(np.zeros(len(kept)), -5.0)
    heavy = np.where(labels > 0, 0.5 / n1, 0.5 / n0)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        p = _sigmoid(np.bincount(sentence, w[col], len(size)) + w[-1])
        clean = np.exp(np.bincount(owner, times * np.log1p(-np.minimum(p, 1 - 1e-9)), len(labels)))
        ratio = clean / np.maximum(1 - clean, 1e-9)
        # d(log-likelihood)/d(logit): in a toxic bag each sentence takes its part
        pull = times * p * np.where(labels[owner] > 0, ratio[owner], -1.0) * heavy[owner]
        grad = np.append(np.bincount(col, pull[sentence], len(kept)), pull.sum())
        grad[:-1] -= SHRINK * w[:-1]
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        w += 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    weights = untaught()
    weights[kept] = w[:-1]
    weights[-1] = w[-1]
    return weights


def untaught() -> np.ndarray:
    """Weights that find nothing toxic."""
    weights = np.zeros((1 << FEATURE_BITS) + 1)
    weights[-1] = -30.0
    return weights


def fit(texts: list[bytes], toxic: list[int], steps: int = STEPS) -> np.ndarray:
    """Weights from texts at hand, by the steps that ``train`` takes in tasks."""
    if len(set(toxic)) < 2:
        return untaught()
    labels = np.array(toxic)
    cut = [(c, labels[c.first:c.first + c.rows]) for c in chunks(pa.array(texts, pa.large_binary()), fold=True)]
    kept = telling(sum(feature_counts(c, y) for c, y in cut), (int((labels == 0).sum()), int(labels.sum())))
    told = np.isin(np.arange(1 << FEATURE_BITS), kept)
    return descend([b for c, _ in cut for b in bags(c, told)], labels, kept, steps)


def score_chunk(chunk: Chunk, weights: np.ndarray) -> tuple[np.ndarray, Sentences, np.ndarray]:
    """Noisy-or score of each row, its sentences, and their probabilities."""
    s = sentences(chunk)
    score = np.zeros(chunk.rows)
    if not len(s.heads):
        return score, s, np.zeros(0)
    p = _sigmoid(np.add.reduceat(weights[s.features], s.heads) + weights[-1]).astype(np.float64)
    none = np.bincount(s.row, np.log1p(-np.minimum(p, 1 - 1e-12)), chunk.rows)
    return 1 - np.exp(none), s, p


def fit_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
             label: str = "toxic", limit: int = FIT_DOCS) -> DataFrame:
    """``doc_id, toxic, text``: at most ``limit`` labelled documents of each class.

    None is from the held-out third. Of rows that share an id the text with the
    smallest digest stands for it, so there are never more than ``2 * limit`` rows.
    """
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & ~held & F.col("toxic").isin(0, 1)).distinct()
    draw = lambda x: known.where(F.col("toxic") == x).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(limit)
    chosen = F.broadcast(draw(0).union(draw(1)))  # at most 2 * limit rows
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).join(chosen, "doc_id")
    one = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.md5("text").alias("key"), "text")).alias("t"))
    return one.select("doc_id", "toxic", "t.text")


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic") -> np.ndarray:
    """Weights fitted on ``fit_rows``; the driver never holds a text.

    Tasks count documents by feature (at most ``1 << FEATURE_BITS`` sums), then send
    each document's sentences reduced to their telling features, equal ones once.
    """
    rows = written(fit_rows(docs, labels, doc_id, text, label), "toxicity-fit")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return untaught()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << FEATURE_BITS), np.int64)
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(0), fold=True):
                total += feature_counts(c, toxic[c.first:c.first + c.rows])
        seen = np.flatnonzero(total.any(axis=0))
        yield pa.record_batch({
            "feature": pa.array(seen), "clean": pa.array(total[0][seen]), "toxic": pa.array(total[1][seen])})

    per = rows.select("text", "toxic").mapInArrow(count, "feature bigint, clean bigint, toxic bigint")
    sums = per.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    counts = np.zeros((2, 1 << FEATURE_BITS), np.int64)
    counts[:, sums["feature"].to_numpy()] = [sums["clean"].to_numpy(), sums["toxic"].to_numpy()]
    kept = telling(counts, (sizes[0], sizes[1]))
    shared = docs.sparkSession.sparkContext.broadcast(np.isin(np.arange(1 << FEATURE_BITS), kept))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(0), fold=True):
                found = bags(c, shared.value)
                part = batch.slice(c.first, c.rows)
                yield pa.record_batch({
                    "doc_id": part.column(2), "toxic": part.column(1),
                    **{k: pa.array([getattr(b, k) for b in found], pa.list_(pa.int32()))
                       for k in ("features", "sizes", "times")}})

    kind = rows.schema["doc_id"].dataType.simpleString()
    taken = rows.select("text", "toxic", "doc_id").mapInArrow(
        gather, f"doc_id {kind}, toxic int, features array<int>, sizes array<int>, times array<int>").toArrow()
    taken = taken.sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    cells = [taken[k].combine_chunks() for k in ("features", "sizes", "times")]
    found = [Bag(*(c[i].values.to_numpy(zero_copy_only=False) for c in cells)) for i in range(len(taken))]
    return descend(found, taken["toxic"].to_numpy(), kept)


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   flag_at: float = FLAG_AT) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` and ``spans`` of every row.

    ``spans`` holds start, length (UTF-8 bytes) and probability of each sentence
    that alone reaches ``flag_at``.
    """
    weights = docs.sparkSession.sparkContext.broadcast(
        train(docs, labels, doc_id, text).astype(np.float32))
    kind = docs.schema[doc_id].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("size", pa.int64()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            for chunk in chunks(batch.column(1), fold=True):
                score, s, p = score_chunk(chunk, w)
                hot = np.flatnonzero(p >= flag_at)
                bounds = np.searchsorted(s.row[hot], np.arange(chunk.rows + 1)).astype(np.int32)
                spans = pa.StructArray.from_arrays([
                    pa.array(s.first_byte[hot] - chunk.bounds[s.row[hot]], pa.int64()),
                    pa.array(s.last_byte[hot] - s.first_byte[hot], pa.int64()),
                    pa.array(p[hot], pa.float64())], fields=list(span))
                yield pa.record_batch({
                    "doc_id": batch.column(0).slice(chunk.first, chunk.rows),
                    "score": pa.array(np.clip(score, 0, 1).astype(np.float64)),
                    "spans": pa.ListArray.from_arrays(pa.array(bounds), spans)})

    scored = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, score double, spans array<struct<start:bigint,size:bigint,p:double>>")
    return scored.select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= flag_at).cast("int").alias("predicted"), "spans")
