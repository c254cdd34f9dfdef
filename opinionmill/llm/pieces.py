"""Piece encoding and decoding: an Aho-Corasick automaton drives Viterbi.

The pieces of a vocabulary file form one automaton over UTF-8 bytes. Reading a
byte moves its state along; the state's longest piece ending here and, by output
links, every shorter one relax the best score at this position, so one pass over
the text finds the segmentation with the largest sum of piece scores (ties: the
longer last piece). Bytes that no piece covers fall back to byte pieces.

A task reads a batch, cuts it where no piece can reach across (before a blank that
follows other text, around line feeds; checked on the vocabulary), and segments
each distinct span once, all spans moving through the automaton in step. Spans
longer than nearly all others walk through it one by one.

The vocabulary at hand lists merge ranks, not log-probabilities. ``scores="zipf"``
takes ``-ln(rank + 2.7)`` less a constant as log-probability, ``"file"`` takes the
listed numbers. A text gets one blank in front, as the vocabulary expects; it is
taken off again when decoding. U+2581 in a text is encoded by bytes, so every
text that is valid UTF-8 comes back exactly.

Defined results: a null or empty text has no pieces and decodes to an empty text;
repeated rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionmill.llm.wordarrays import Chunk, chunks

BLANK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_BYTES = 3 << 20
#: Fewer spans than this that are still being read go one by one.
IN_STEP = 64
_HARMONIC = 11.0  # about ln(vocabulary) + 0.6: makes fewer pieces win


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as bytes by id, their scores, and the ids of the byte pieces."""

    pieces: tuple[bytes, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]


def load_vocabulary(path: str = DEFAULT_MODEL, scores: str = "zipf") -> Vocabulary:
    """Read a SentencePiece model file; control and unused pieces become empty."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces, values, byte_ids = [b""] * n, [0.0] * n, [-1] * 256
    rank = 0
    for i in range(n):
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[i] = model.id_to_piece(i).replace(BLANK, " ").encode()
            values[i] = model.get_score(i) if scores == "file" else -math.log(rank + 2.7) - _HARMONIC
            rank += 1
    if min(byte_ids) < 0:
        raise ValueError("the vocabulary has no byte pieces")
    lowest = min(values) - 10
    for b, i in enumerate(byte_ids):
        pieces[i], values[i] = bytes([b]), lowest
    return Vocabulary(tuple(pieces), tuple(values), tuple(byte_ids))


class Automaton:
    """Dense moves, output links and piece tables of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        fallback = set(vocabulary.byte_ids)
        children: list[dict[int, int]] = [{}]
        piece_at = [-1]
        words = [(i, p) for i, p in enumerate(vocabulary.pieces) if p and i not in fallback]
        for i, piece in words:
            node = 0
            for b in piece:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    piece_at.append(-1)
                node = nxt
            if piece_at[node] < 0:
                piece_at[node] = i
        n = len(children)
        self.symbol = np.zeros(256, np.int32)  # bytes of no piece share symbol 0
        used = sorted({b for _, p in words for b in p})
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        moves = np.zeros((n, self.width), np.int32)
        link = np.full(n, -1, np.int64)  # nearest suffix state with a piece
        fail = [0] * n
        queue = deque()
        for b, child in children[0].items():
            moves[0, self.symbol[b]] = child
            queue.append(child)
        while queue:
            node = queue.popleft()
            back = fail[node]
            link[node] = back if piece_at[back] >= 0 else link[back]
            moves[node] = moves[back]
            for b, child in children[node].items():
                fail[child] = int(moves[back, self.symbol[b]])
                moves[node, self.symbol[b]] = child
                queue.append(child)
        self.moves = moves.ravel()
        piece_at = np.array(piece_at, np.int64)
        has = piece_at >= 0
        self.output = np.where(has, np.arange(n), link)  # longest piece state, or -1
        self.link = link
        self.piece_at = piece_at
        sizes = np.array([len(p) for p in vocabulary.pieces], np.int64)
        scores = np.array(vocabulary.scores)
        self.size_at = np.where(has, sizes[np.maximum(piece_at, 0)], 0)
        self.score_at = np.where(has, scores[np.maximum(piece_at, 0)], -np.inf)
        self.byte_ids = np.array(vocabulary.byte_ids, np.int64)
        self.byte_score = float(scores[self.byte_ids[0]])
        self.sizes = sizes
        self.bytes_at = np.concatenate([[0], np.cumsum(sizes)])
        self.bytes = np.frombuffer(b"".join(vocabulary.pieces), np.uint8)
        self.cut_blanks = all(b" " not in p.lstrip(b" ") for _, p in words)
        self.cut_lines = all(p == b"\n" or b"\n" not in p for _, p in words)

    def one(self, data: np.ndarray) -> tuple[list[int], float]:
        """Segment one span, byte by byte."""
        best, back, state = [0.0], [0], 0
        symbols = self.symbol[data].tolist()
        raw = data.tolist()
        moves, output, link = self.moves, self.output, self.link
        for t, s in enumerate(symbols):
            state = int(moves[state * self.width + s])
            top, choice = best[t] + self.byte_score, int(self.byte_ids[raw[t]])
            out = int(output[state])
            found, piece = -math.inf, -1
            while out >= 0:
                value = best[t + 1 - int(self.size_at[out])] + float(self.score_at[out])
                if value > found:
                    found, piece = value, int(self.piece_at[out])
                out = int(link[out])
            if found >= top:
                top, choice = found, piece
            best.append(top)
            back.append(choice)
        ids, at = [], len(raw)
        while at:
            ids.append(back[at])
            at -= int(self.sizes[back[at]])
        return ids[::-1], best[-1]

    def many(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment spans: flat ids, bounds of each span's ids, and scores."""
        n = len(starts)
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        start, size_o = starts[order], size[order]
        alone = min(n, IN_STEP)
        longest = int(size_o[alone]) if n > alone else 0
        scalar = int(np.searchsorted(-size_o, -longest, side="left")) if longest else n
        ids_of: dict[int, list[int]] = {}
        total = np.zeros(n)
        for k in range(scalar):
            ids_of[k], total[k] = self.one(data[start[k]: start[k] + size_o[k]])
        count = np.zeros(n, np.int64)
        for k, ids in ids_of.items():
            count[k] = len(ids)
        s0, z0 = start[scalar:], size_o[scalar:]
        m = len(s0)
        if m:
            at = np.concatenate([[0], np.cumsum(z0 + 1)])
            best = np.zeros(int(at[-1]))
            back = np.zeros(int(at[-1]), np.int64)
            at = at[:-1]
            state = np.zeros(m, np.int64)
            for t in range(int(z0[0])):
                live = int(np.searchsorted(-z0, -t, side="left"))  # spans longer than t
                raw = data[s0[:live] + t]
                state[:live] = self.moves[state[:live] * self.width + self.symbol[raw]]
                here = at[:live] + t + 1
                top = np.full(live, -np.inf)
                piece = np.zeros(live, np.int64)
                out = self.output[state[:live]]
                who = np.flatnonzero(out >= 0)
                out = out[who]
                while len(who):
                    value = best[here[who] - self.size_at[out]] + self.score_at[out]
                    better = value > top[who]
                    hit = who[better]
                    top[hit] = value[better]
                    piece[hit] = self.piece_at[out[better]]
                    out = self.link[out]
                    more = out >= 0
                    who, out = who[more], out[more]
                plain = best[here - 1] + self.byte_score
                low = top < plain
                best[here] = np.where(low, plain, top)
                back[here] = np.where(low, self.byte_ids[raw], piece)
            total[scalar:] = best[at + z0]
            place, who, trail = z0.copy(), np.flatnonzero(z0 > 0), []
            while len(who):
                ids = back[at[who] + place[who]]
                trail.append((who, ids))
                place[who] -= self.sizes[ids]
                count[scalar + who] += 1
                who = who[place[who] > 0]
        bounds_o = np.concatenate([[0], np.cumsum(count)])
        flat = np.zeros(int(bounds_o[-1]), np.int32)
        for k, ids in ids_of.items():
            flat[bounds_o[k]: bounds_o[k + 1]] = ids
        if m:
            for turn, (who, ids) in enumerate(trail):
                flat[bounds_o[scalar + who + 1] - 1 - turn] = ids
        # back to the order of the spans given
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        made = count[place]
        bounds = np.concatenate([[0], np.cumsum(made)])
        return flat[spread(bounds_o[:-1][place], made)], bounds, total[place]

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows, bounds of each row's ids, and each row's score."""
        full = np.diff(chunk.bounds) > 0
        heads = chunk.bounds[:-1][full]
        data = np.insert(chunk.data, heads, 32)
        bounds = chunk.bounds + np.concatenate([[0], np.cumsum(full)])
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(chunk.rows + 1, np.int64), np.zeros(chunk.rows)
        cut = np.zeros(n, bool)
        cut[bounds[:-1][full]] = True
        if self.cut_blanks:
            blank = data == 32
            cut[1:] |= blank[1:] & ~blank[:-1]
        if self.cut_lines:
            feed = data == 10
            cut |= feed
            cut[1:] |= feed[:-1]
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        spans = Chunk(0, data, bounds, False)
        _, first, same = np.unique(spans.hashes(starts, ends), return_index=True, return_inverse=True)
        # a collision of 64-bit hashes must not change a text: compare lengths and bytes
        if not _alike(data, starts, ends, first[same]):
            first, same = np.arange(len(starts)), np.arange(len(starts))
        ids, id_bounds, scores = self.many(data, starts[first], ends[first])
        made = np.diff(id_bounds)[same]
        flat = ids[spread(id_bounds[:-1][same], made)]
        row_spans = np.searchsorted(starts, bounds, side="left")
        out = np.concatenate([[0], np.cumsum(made)])[row_spans]
        sums = np.concatenate([[0.0], np.cumsum(scores[same])])[row_spans]
        return flat, out, np.diff(sums)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows and their bounds, the blank in front taken off."""
        size = self.sizes[ids]
        data = self.bytes[spread(self.bytes_at[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[bounds]
        full = np.diff(ends) > 0
        data = np.delete(data, ends[:-1][full])
        return data, ends - np.concatenate([[0], np.cumsum(full)])


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions ``first[i] … first[i] + size[i]`` of all i, one after the other."""
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(int(size.sum()))


def _alike(data, starts, ends, other) -> bool:
    size = ends - starts
    if not np.array_equal(size, size[other]):
        return False
    return bool(np.array_equal(data[spread(starts, size)], data[spread(starts[other], size)]))


@lru_cache(maxsize=2)
def automaton_of(vocabulary: Vocabulary) -> Automaton:
    return Automaton(vocabulary)


def encode_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  model: str = DEFAULT_MODEL, scores: str = "zipf") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_pieces``, ``score``, ``ids``, ``round_trip`` per row.

    ``round_trip`` tells whether decoding ``ids`` gave back the text's bytes. The
    vocabulary (bounded by its file) goes to the executors as a broadcast.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(model, scores))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton_of(shared.value)
        for batch in batches:
            for chunk in chunks(batch.column(1), size=CHUNK_BYTES):
                ids, bounds, score = auto.encode(chunk)
                data, ends = auto.decode(ids, bounds)
                same = np.array([
                    np.array_equal(data[ends[i]: ends[i + 1]],
                                   chunk.data[chunk.bounds[i]: chunk.bounds[i + 1]])
                    for i in range(chunk.rows)], bool)
                yield pa.record_batch({
                    "doc_id": batch.column(0).slice(chunk.first, chunk.rows),
                    "n_bytes": pa.array(np.diff(chunk.bounds)),
                    "n_pieces": pa.array(np.diff(bounds)),
                    "score": pa.array(score),
                    "ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                    "round_trip": pa.array(same)})

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_pieces bigint, score double, "
             "ids array<int>, round_trip boolean")


def decode_pieces(encoded: DataFrame, ids: str = "ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """``encoded`` with a column ``text`` decoded from ``ids`` (null ids: null)."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(model))

    @F.pandas_udf("string")
    def text_of(column):
        pieces = shared.value.pieces
        return column.map(lambda x: None if x is None else b"".join(
            [pieces[i] for i in x])[1:].decode())

    return encoded.withColumn("text", text_of(F.col(ids)))
