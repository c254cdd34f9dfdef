"""Masked pseudo-likelihood from a bidirectional window network.

Every token is predicted from the ``SIDE`` tokens on its left and on its right:
embeddings of the window are concatenated, pass a tanh layer, and a two-level
softmax (class, then word of the class) gives a normalised probability. A
document's score is the sum of the log-probabilities of all its tokens.

The network's vocabulary is the ``TOP`` most frequent words of the whole corpus and
``RARE`` hashed groups of all others. Such a word is scored as itself: the probability of
its group there, times its share of the group's tokens in the corpus. These shares come
from exact counts of every word, by a join on the words that documents have.

Training is local SGD: in each round every task starts from the same parameters, trains on
its share of the positions of all its documents (the rounds together on every position),
and hands in its parameters as one row, weighted by the tokens it saw; Spark sums these
rows in two steps. What is gathered thus grows with the input, what reaches the driver is
one model. A task's documents, not the number of tasks, say how far a round gets. Biases
start at the unigram distribution.

Defined results: a null or blank text has no tokens and scores 0 with a null mean;
repeated rows score alike; an empty table gives an empty result. Scores depend on
how rows are dealt to tasks in training, though little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionmill.llm.tables import written
from opinionmill.llm.wordarrays import Chunk, chunks, mix

TOP, RARE = 4032, 64
CLASSES, MEMBERS = 64, 64
SIDE, WIDTH, HIDDEN = 2, 8, 16
ROUNDS = 2
SUMS = 64
PART = 1 << 17
BATCH = 16384
RATE = 0.05
_SHAPES = {
    "embed": (TOP + RARE + 1, WIDTH), "into": (2 * SIDE * WIDTH, HIDDEN), "into_bias": (HIDDEN,),
    "classes": (HIDDEN, CLASSES), "classes_bias": (CLASSES,),
    "words": (CLASSES, HIDDEN, MEMBERS), "words_bias": (CLASSES, MEMBERS),
}
SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at: at + n].reshape(shape)
        at += n
    return out


def start(counts: np.ndarray, seed: int = 7) -> np.ndarray:
    """Parameters before training: small random weights, unigram biases."""
    flat = np.zeros(SIZE, np.float32)
    p, rng = views(flat), np.random.default_rng(seed)
    for name in ("embed", "into", "classes", "words"):
        fan = _SHAPES[name][-2]
        p[name][...] = rng.normal(0, 0.3 if name == "embed" else fan ** -0.5 * 0.5, _SHAPES[name])
    share = (counts + 0.5).reshape(CLASSES, MEMBERS)
    p["classes_bias"][...] = np.log(share.sum(1) / share.sum())
    p["words_bias"][...] = np.log(share / share.sum(1, keepdims=True))
    return flat


class Words:
    """Word hashes to ids: frequent words by rank, the rest by hash."""

    def __init__(self, top: np.ndarray) -> None:
        self.order = np.argsort(top)
        self.sorted = top[self.order]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        rare = TOP + (hashes % np.uint64(RARE)).astype(np.int64)
        if not len(self.sorted):
            return rare
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], rare)


def contexts(ids: np.ndarray, bounds: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The window of each token, or of those ``at`` some places, padded at row ends."""
    size = np.diff(bounds)
    first, last = np.repeat(bounds[:-1], size), np.repeat(bounds[1:], size)
    if at is None:
        at = np.arange(len(ids))
    else:
        first, last = first[at], last[at]
    out = np.empty((len(at), 2 * SIDE), np.int64)
    padded = np.concatenate([np.zeros(SIDE, ids.dtype), ids, np.zeros(SIDE, ids.dtype)])
    before, after = at - first, last - 1 - at
    for j, step in enumerate((*range(-SIDE, 0), *range(1, SIDE + 1))):
        out[:, j] = padded.take(at + (step + SIDE))
        out[np.flatnonzero(before < -step if step < 0 else after < step), j] = TOP + RARE
    return out


def _by_class(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each token, tokens in class order, and where each class begins there."""
    group = (ids // MEMBERS).astype(np.uint8)  # few bits sort by counting
    return group, np.argsort(group, kind="stable"), np.append(0, np.cumsum(np.bincount(group, minlength=CLASSES)))


def _softmax(x: np.ndarray) -> np.ndarray:
    """The softmax of each row, in place."""
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def _log_softmax_at(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """One entry a row of the log-softmax; ``x`` is overwritten."""
    x -= x.max(axis=1, keepdims=True)
    chosen = x[np.arange(len(x)), place]
    np.exp(x, out=x)
    return chosen - np.log(x.sum(axis=1))


def log_probs(p: dict[str, np.ndarray], window: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Log-probability of each token given its window."""
    hidden = np.tanh(p["embed"].take(window, axis=0).reshape(len(ids), -1) @ p["into"] + p["into_bias"])
    group, order, cut = _by_class(ids)
    out = _log_softmax_at(hidden @ p["classes"] + p["classes_bias"], group)
    hidden, member, inner = hidden[order], (ids % MEMBERS)[order], np.empty_like(out)
    for c in range(CLASSES):
        a, b = cut[c: c + 2]
        if a < b:
            inner[a:b] = _log_softmax_at(hidden[a:b] @ p["words"][c] + p["words_bias"][c], member[a:b])
    out[order] += inner
    return out


def train_step(flat: np.ndarray, square: np.ndarray, window: np.ndarray, ids: np.ndarray) -> None:
    """One Adagrad step on the mean log-likelihood of a batch."""
    p, n = views(flat), len(ids)
    grad = np.zeros_like(flat)
    g = views(grad)
    x = p["embed"].take(window, axis=0).reshape(n, -1)
    hidden = np.tanh(x @ p["into"] + p["into_bias"])
    group, order, cut = _by_class(ids)
    miss = -_softmax(hidden @ p["classes"] + p["classes_bias"])
    miss[np.arange(n), group] += 1
    g["classes"][...] = hidden.T @ miss
    g["classes_bias"][...] = miss.sum(0)
    back = miss @ p["classes"].T
    ordered, member, inner = hidden[order], (ids % MEMBERS)[order], np.empty_like(back)
    for c in range(CLASSES):
        a, b = cut[c: c + 2]
        if a < b:
            h = ordered[a:b]
            miss = -_softmax(h @ p["words"][c] + p["words_bias"][c])
            miss[np.arange(b - a), member[a:b]] += 1
            g["words"][c] = h.T @ miss
            g["words_bias"][c] = miss.sum(0)
            inner[a:b] = miss @ p["words"][c].T
    back[order] += inner
    back *= 1 - hidden * hidden
    g["into"][...] = x.T @ back
    g["into_bias"][...] = back.sum(0)
    deep = (back @ p["into"].T).reshape(-1, WIDTH)
    flat_window = window.ravel()
    for j in range(WIDTH):
        g["embed"][:, j] = np.bincount(flat_window, deep[:, j], _SHAPES["embed"][0])
    grad /= n
    square += grad * grad
    flat += RATE * grad / np.sqrt(square + 1e-8)


def word_counts(texts: DataFrame) -> DataFrame:
    """``h``, ``n``: hash and number of tokens of every word, written once."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(c.hashes(*c.words()), return_counts=True)
                     for c in chunks(batch.column(0), fold=True)]
            if not found:
                continue
            word, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            n = np.bincount(at, np.concatenate([f[1] for f in found]), len(word)).astype(np.int64)
            yield pa.record_batch({"h": pa.array(word.view(np.int64)), "n": pa.array(n)})

    return written(texts.mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(
        F.sum("n").alias("n")), "word-counts")


def vocabulary(per: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent words, and token counts of all ids."""
    top = per.orderBy(F.desc("n"), "h").limit(TOP).collect()
    groups = per.groupBy(F.col("h").bitwiseAND(RARE - 1).alias("g")).agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(TOP + RARE)
    counts[: len(top)] = [r["n"] for r in top]
    for r in groups:
        counts[TOP + r["g"]] += r["n"]
    for r in top:
        counts[TOP + (r["h"] & (RARE - 1))] -= r["n"]
    return np.array([r["h"] for r in top], np.int64).view(np.uint64), counts


def _summed(rows: DataFrame) -> DataFrame:
    """Rows ``n``, ``v`` (packed doubles) added up, first ``SUMS`` at a time, then to one."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(SIZE)
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, total = n + k, total + np.frombuffer(v.as_buffer(), np.float64)
        if n:
            yield pa.record_batch({"n": pa.array([n]), "v": pa.array([total.tobytes()], pa.binary())})

    for tasks in (SUMS, 1):
        rows = rows.repartition(tasks).mapInArrow(add, "n bigint, v binary")
    return rows


def _id_chunks(column: pa.BinaryArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, ids and row bounds of parts of about ``PART`` tokens of a packed column."""
    n = len(column)
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + n + 1] // 2
    data = column.buffers()[2]
    data = np.frombuffer(data, np.int16) if data is not None and data.size else np.zeros(0, np.int16)
    first = 0
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + PART, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield (first, data[bounds[first]: bounds[last]].astype(np.int64),
               (bounds[first: last + 1] - bounds[first]).astype(np.int64))
        first = last


def train(encoded: DataFrame, counts: np.ndarray) -> np.ndarray:
    """Parameters after ``ROUNDS`` rounds of local SGD over the packed ``ids``."""
    sc, flat = encoded.sparkSession.sparkContext, start(counts)
    for turn in range(ROUNDS):
        shared = sc.broadcast(flat)

        def local(batches: Iterator[pa.RecordBatch], turn=turn, shared=shared) -> Iterator[pa.RecordBatch]:
            flat = shared.value.copy()
            square, seen = np.zeros_like(flat), 0
            for batch in batches:
                for _, ids, bounds in _id_chunks(batch.column(0)):
                    place = mix(np.arange(len(ids), dtype=np.uint64) + np.uint64(len(ids)))
                    pick = np.flatnonzero(place % np.uint64(ROUNDS) == turn)
                    window = contexts(ids, bounds, pick)
                    # steps of one size, whatever the part's
                    steps = max(1, round(len(pick) / BATCH))
                    for a, b in zip(*(len(pick) * np.arange(k, steps + k) // steps for k in (0, 1)), strict=True):
                        if a < b:
                            train_step(flat, square, window[a:b], ids[pick[a:b]])
                    seen += len(pick)
            if seen:
                packed = (flat.astype(np.float64) * seen).tobytes()
                yield pa.record_batch({"n": pa.array([seen]), "v": pa.array([packed], pa.binary())})

        found = _summed(encoded.select("ids").mapInArrow(local, "n bigint, v binary")).collect()
        if not found:
            return flat
        flat = (np.frombuffer(found[0]["v"], np.float64) / found[0]["n"]).astype(np.float32)
    return flat


def encode(docs: DataFrame, doc_id: str, text: str, top: np.ndarray) -> DataFrame:
    """The written rows ``row``, ``doc_id``, ``ids`` (packed 16-bit numbers of the tokens)
    and, of words beyond the top, ``rare`` (distinct hashes) with ``times``."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = Words(shared.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            for chunk in chunks(batch.column(1), fold=True):
                starts, ends = chunk.words()
                hashes, bounds = chunk.hashes(starts, ends), chunk.word_bounds(starts)
                ids = words.ids(hashes)
                rare = ids >= TOP
                row, h, k = _distinct(np.repeat(np.arange(chunk.rows), np.diff(bounds))[rare], hashes[rare])
                cut = pa.array(np.searchsorted(row, np.arange(chunk.rows + 1)), pa.int32())
                yield pa.record_batch({
                    "row": pa.array(number + np.arange(chunk.rows)),
                    "doc_id": batch.column(0).slice(chunk.first, chunk.rows),
                    "ids": pa.Array.from_buffers(pa.binary(), chunk.rows, [
                        None, pa.py_buffer((bounds * 2).astype(np.int32)), pa.py_buffer(ids.astype(np.int16))]),
                    "rare": pa.ListArray.from_arrays(cut, pa.array(h.view(np.int64))),
                    "times": pa.ListArray.from_arrays(cut, pa.array(k, pa.int32()))})
                number += chunk.rows

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return written(rows.mapInArrow(
        run, f"row bigint, doc_id {kind}, ids binary, rare array<bigint>, times array<int>"), "encoded")


def _distinct(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and count of each different word of a row, in row order."""
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1]))[: len(row)])
    return row[first], hashes[first], np.diff(np.append(first, len(row)))


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, log_prob, mean_log_prob, unigram_log_prob`` of every row."""
    per = word_counts(docs.select(F.col(text).alias("text")))
    top, counts = vocabulary(per)
    encoded = encode(docs, doc_id, text, top)
    shared = docs.sparkSession.sparkContext.broadcast((train(encoded, counts), counts))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, counts = shared.value
        p = views(flat)
        alone = np.log((counts + 0.5) / (counts + 0.5).sum())
        group_log = np.append(np.zeros(TOP), np.log(np.maximum(counts[TOP:], 1)))
        for batch in batches:
            for first, ids, bounds in _id_chunks(batch.column(2)):
                window, found = contexts(ids, bounds), np.zeros(len(ids))
                for at in range(0, len(ids), BATCH):
                    found[at: at + BATCH] = log_probs(p, window[at: at + BATCH], ids[at: at + BATCH])
                n = np.diff(bounds)
                row = np.repeat(np.arange(len(n)), n)
                yield pa.record_batch({
                    "row": batch.column(0).slice(first, len(n)), "doc_id": batch.column(1).slice(first, len(n)),
                    "n_tokens": pa.array(n, pa.int64()),
                    "net": pa.array(np.bincount(row, found - group_log[ids], len(n)).astype(float)),
                    "alone": pa.array(np.bincount(row, alone[ids] - group_log[ids], len(n)).astype(float))})

    scored = encoded.select("row", "doc_id", "ids").mapInArrow(
        run, f"row bigint, doc_id {kind}, n_tokens bigint, net double, alone double")
    # what is missing of a rare word's share is its count, which is 1 for most of them; it
    # is at most as frequent as the last of the top words, so no key is hot
    share = encoded.select("row", F.inline(F.arrays_zip(F.col("rare").alias("h"), F.col("times").alias("k")))).join(
        per.where("n > 1").hint("shuffle_hash"), "h").groupBy("row").agg(F.sum(F.col("k") * F.log("n")).alias("share"))
    share_of = F.coalesce("share", F.lit(0.0))
    log_prob = F.col("net") + share_of
    return scored.join(share, "row", "left").select(
        "doc_id", "n_tokens", log_prob.alias("log_prob"),
        F.when(F.col("n_tokens") > 0, log_prob / F.col("n_tokens")).alias("mean_log_prob"),
        (F.col("alone") + share_of).alias("unigram_log_prob"))
