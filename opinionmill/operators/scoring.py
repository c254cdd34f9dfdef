"""Pluggable models, run as Arrow stages over the rows Spark hands out.

A tagger factory returns a callable from a list of word lists to a list of
``(word_ids, logits)``: one entry per token, ``word_ids`` None for sentence
markers, ``logits`` one value per label (O, B, I). A scorer factory returns a
callable from a list of (sentence, term) pairs to a list of class indexes. A
segmenter factory returns a callable from a list of texts to a list of texts in
which the parts of one word are joined by ``_``. Factories must be picklable; each
Python worker builds the model once and feeds it slices of ``batch`` rows. What a
tagger returns leaves the worker in pieces, cut by the length of the texts, so that
a batch of long texts is never held with all its scores.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from opinionmill import schema as S
from opinionmill.functions import tokens as tk
from opinionmill.functions.once import computed


#: Characters of the texts whose scores a worker holds at once; a longer text stands alone.
RUN_CHARS = 1 << 20


def _runs(most: int) -> Callable:
    """A cutter of texts into consecutive runs of at most ``most`` characters."""
    # defined inside so that workers receive it by value
    def cut(texts: list) -> Iterator[list]:
        run, size = [], 0
        for text in texts:
            more = len(text or "")
            if run and size + more > most:
                yield run
                run, size = [], 0
            run.append(text)
            size += more
        if run:
            yield run

    return cut


def _per_process(model_factory: Callable) -> Callable:
    """A getter that builds the model on first use in each Python worker.

    Workers outlive tasks, so a slow-loading model is loaded once per worker.
    """
    key = f"model_{uuid.uuid4().hex}"

    def get():
        import sys
        import types

        name = "_opinionmill_models"
        home = sys.modules.setdefault(name, types.ModuleType(name))
        if not hasattr(home, key):
            setattr(home, key, model_factory())
        return getattr(home, key)

    return get


def _tagger_udf(model_factory: Callable, batch: int):
    get_model, runs = _per_process(model_factory), _runs(RUN_CHARS)

    # Defined inside so that workers receive the function by value.
    def tag(chunks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy
        import pyarrow

        entry = pyarrow.struct([
            ("pos", pyarrow.int32()), ("word_id", pyarrow.int32()),
            ("logits", pyarrow.list_(pyarrow.float32())),
        ])
        model = get_model()
        for run in (run for chunk in chunks for run in runs(chunk.to_pylist())):
            words = [(t or "").split() for t in run]
            rows = [i for i, w in enumerate(words) if w]
            lengths = numpy.zeros(len(words), numpy.int32)
            ids, logits, positions = [], [], []
            for start in range(0, len(rows), batch):
                part = rows[start:start + batch]
                for i, (word_ids, scores) in zip(part, model([words[i] for i in part])):
                    lengths[i] = len(word_ids)
                    ids.extend(word_ids)
                    positions.append(numpy.arange(len(word_ids), dtype=numpy.int32))
                    logits.append(numpy.asarray(scores, numpy.float32))
            flat = numpy.concatenate(logits) if logits else numpy.zeros((0, 1), numpy.float32)
            steps = numpy.arange(len(flat) + 1, dtype=numpy.int32) * flat.shape[1]
            tokens = pyarrow.StructArray.from_arrays(
                [
                    pyarrow.array(
                        numpy.concatenate(positions) if positions else [], pyarrow.int32()),
                    pyarrow.array(ids, pyarrow.int32()),
                    pyarrow.ListArray.from_arrays(
                        pyarrow.array(steps), pyarrow.array(flat.reshape(-1))),
                ],
                fields=list(entry))
            offsets = numpy.concatenate([[0], numpy.cumsum(lengths)]).astype(numpy.int32)
            yield pyarrow.ListArray.from_arrays(pyarrow.array(offsets), tokens)

    return arrow_udf(tag, S.TOKENS)


def score_tokens(
    df: DataFrame, model_factory: Callable, text: str = "clean", batch: int = 32
) -> DataFrame:
    """Add ``tokens``. Rows keep all their columns; only the text goes to Python.

    ``clean_reviews`` has already spread small inputs over the cores.
    """
    return df.withColumn("tokens", _tagger_udf(model_factory, batch)(F.col(text)))


def explode_tokens(df: DataFrame, key: str = "sent_id") -> DataFrame:
    """Long form ``(sent_id, pos, word_id, logits)``."""
    return df.select(key, F.inline("tokens"))


def _word_scores_udf(model_factory: Callable, batch: int, max_len: int):
    get_model, runs = _per_process(model_factory), _runs(RUN_CHARS)
    room = max_len - 2  # without the two sentence markers

    def tag(chunks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from collections import deque

        import numpy
        import pyarrow

        kind = pyarrow.list_(pyarrow.list_(pyarrow.float32()))
        model = get_model()
        for run in (run for chunk in chunks for run in runs(chunk.to_pylist())):
            words = [(t or "").split() for t in run]
            found = [[None] * len(w) for w in words]
            todo = deque((i, 0) for i, w in enumerate(words) if w)
            while todo:
                part = [todo.popleft() for _ in range(min(batch, len(todo)))]
                scored = model([words[i][at:at + room] for i, at in part])
                for (i, at), (word_ids, scores) in zip(part, scored):
                    after = at + 1
                    for pos, w in enumerate(word_ids[:room + 1]):
                        if w is not None and found[i][at + w] is None:
                            found[i][at + w] = numpy.asarray(scores[pos], numpy.float32)
                            after = max(after, at + w + 1)
                    if after < len(words[i]):
                        todo.append((i, after))
            yield pyarrow.array(found, kind)

    return arrow_udf(tag, "array<array<float>>")


def score_words(
    df: DataFrame, model_factory: Callable, text: str = "clean", batch: int = 32,
    max_len: int = S.MAX_TOKENS
) -> DataFrame:
    """Add ``word_logits``: the scores of each word's first subword, for all words.

    A text longer than ``max_len`` subwords is tagged in consecutive segments; the
    next one starts at the first word that the one before had no room for.
    """
    return df.withColumn(
        "word_logits", _word_scores_udf(model_factory, batch, max_len)(F.col(text)))


def token_labels(text: str = "clean", logits: str = "word_logits") -> tuple[Column, Column]:
    """Words and their labels, as columns, for a frame from ``score_words``."""
    labels = F.transform(F.col(logits), lambda x: tk.label_name(tk.argmax(x)))
    return tk.split_words(F.col(text)), labels


def _segmenter_udf(model_factory: Callable, batch: int):
    get_model = _per_process(model_factory)

    def segment(chunks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow

        model = get_model()
        for chunk in chunks:
            texts = chunk.to_pylist()
            rows = [i for i, t in enumerate(texts) if t and t.strip()]
            for start in range(0, len(rows), batch):
                part = rows[start:start + batch]
                for i, text in zip(part, model([texts[i] for i in part]), strict=True):
                    texts[i] = text
            yield pyarrow.array(texts, pyarrow.string())

    return arrow_udf(segment, "string")


def segment_words(
    df: DataFrame, model_factory: Callable, text: str = "clean", batch: int = 32
) -> DataFrame:
    """``df`` with the words of ``text`` segmented; null and blank texts stay as they are."""
    rest = [c for c in df.columns if c != text]
    marked = computed(df.withColumnRenamed(text, "__whole"), text,
                      _segmenter_udf(model_factory, batch)(F.col("__whole")))
    return marked.select(*[F.col(f"`{c}`") for c in [*rest, text]])


def _scorer_udf(model_factory: Callable, batch: int):
    get_model = _per_process(model_factory)

    def score(
        chunks: Iterator[tuple[pa.Array, pa.Array]]
    ) -> Iterator[pa.Array]:
        import pyarrow

        model = get_model()
        for sentences, terms in chunks:
            pairs = list(zip(sentences.to_pylist(), terms.to_pylist()))
            out: list = []
            for start in range(0, len(pairs), batch):
                out.extend(int(c) for c in model(pairs[start:start + batch]))
            yield pyarrow.array(out, pyarrow.int32())

    return arrow_udf(score, "int")


def score_pairs(
    df: DataFrame,
    model_factory: Callable,
    sentence: str = "sentence",
    term: str = "term",
    batch: int = 32,
) -> DataFrame:
    """Add ``label`` ("positive" / "negative") for each (sentence, term)."""
    index = _scorer_udf(model_factory, batch)(F.col(sentence), F.col(term))
    return df.withColumn("label", tk.label_name(index, S.POLARITY_LABELS))


# ------------------------------------------------- deterministic stand-in models


def dictionary_tagger(heads: list[str], tails: list[str]) -> Callable:
    """Tagger factory: B for keyword heads, I for later keyword words, else O.

    Words are cut into pieces of four characters; only the first piece carries
    the label, as a trained tagger would be read.
    """
    def factory():
        import numpy

        classes = {t: 2 for t in tails} | {h: 1 for h in heads}
        one_hot = numpy.eye(3, dtype=numpy.float32)

        def tag(batch):
            out = []
            for words in batch:
                ids, found = [None], [0]
                for n, w in enumerate(words):
                    later = (len(w) - 1) // 4
                    ids += [n] * (later + 1)
                    found.append(classes.get(w.lower(), 0))
                    found += [0] * later
                out.append(([*ids, None], one_hot[[*found, 0]]))
            return out

        return tag

    return factory


def phrase_segmenter(phrases: list[str]) -> Callable:
    """Segmenter factory: joins listed phrases, the longest first, from the left.

    Case does not count, and the words of a phrase must be whole words.
    """
    def factory():
        listed = {tuple(p.lower().split()) for p in phrases}
        longest = max(map(len, listed), default=1)

        def segment(batch):
            out = []
            for text in batch:
                words, joined, at = text.split(), [], 0
                keys = [w.lower() for w in words]
                while at < len(words):
                    size = next((n for n in range(min(longest, len(words) - at), 1, -1)
                                 if tuple(keys[at:at + n]) in listed), 1)
                    joined.append("_".join(words[at:at + size]))
                    at += size
                out.append(" ".join(joined))
            return out

        return segment

    return factory


def lexicon_scorer(positive: list[str], negative: list[str]) -> Callable:
    """Scorer factory: class 0 when negative words outnumber positive ones."""
    def factory():
        good, bad = set(positive), set(negative)

        def score(pairs):
            out = []
            for sentence, _ in pairs:
                words = (sentence or "").lower().split()
                out.append(int(sum(w in bad for w in words) <= sum(w in good for w in words)))
            return out

        return score

    return factory
