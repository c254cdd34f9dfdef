"""Token ids as Arrow files of equal-length sequences, read back without copies.

Documents are put in order by a range exchange and each task encodes its range into one
Arrow IPC file: record batches of ``BATCH`` sequences, each a fixed-size list of ``length``
ids, with two masks of the same shape (``real``: no padding; ``last``: the end id of a
document). Ids fill the sequences one after another; only the last sequence of a file is
padded. As all batches but the last have ``BATCH`` rows, sequence ``i`` of a file is row
``i % BATCH`` of batch ``i // BATCH``, reached through the file's footer. On a file that the
machine can map into memory no byte of it is copied, see ``sequence``.

Beside each file lies an Arrow file with the documents it holds. The manifest, a written
table, names the files of the tasks that ended well: each task writes under a name of its
own, so tasks that are retried or run twice leave files that nothing refers to. Files lie
in the shared folder that the session names, and are opened through ``pyarrow.fs``.

Ids are kept in 16 bits where the vocabulary and the end id allow it, else in 32.

Ranges are cut by id, then by a hash of the text, then by the row's place in the input, so
an id that a third of all rows share, or null, is still dealt to many tasks.

Defined results: a null text is the empty one and has the end id alone; null ids come last;
rows that repeat an id stay rows of their own, ordered by a hash of their texts; an empty
table gives no file. A text is encoded whole, in memory of about twenty times its size.
Further columns are not read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinionmill.llm.tables import written
from opinionmill.plans.scale import shared_path

LENGTH = 1024
#: Sequences of a record batch, bytes of texts and words encoded at a time, words remembered.
BATCH = 256
CALL_BYTES = 4 << 20
CALL_WORDS = 1 << 14
KNOWN_WORDS = 1 << 20
END_ID = 2

_MANIFEST = "part int, file string, index string, n_docs bigint, n_tokens bigint, n_sequences bigint"
_DOCUMENT = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def file_schema(length: int, wide: bool) -> pa.Schema:
    def of(kind: pa.DataType) -> pa.DataType:
        return pa.list_(pa.field("item", kind, nullable=False), length)

    return pa.schema([
        pa.field("ids", of(pa.uint32() if wide else pa.uint16()), nullable=False),
        pa.field("real", of(pa.bool_()), nullable=False), pa.field("last", of(pa.bool_()), nullable=False)])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:/"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _opened(path: str) -> pa.NativeFile:
    """Mapped into memory where the file is local, else read by ranges."""
    system, path = _place(path)
    return pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)


# -------------------------------------------------------------------------- writing


@dataclass
class SequenceWriter:
    """Packs ids into sequences and writes every full batch of them at once."""

    folder: str
    name: str
    length: int
    wide: bool
    pending: list[np.ndarray] = field(default_factory=list)
    ends: list[np.ndarray] = field(default_factory=list)
    held: int = 0
    written: int = 0
    docs: int = 0

    def __post_init__(self) -> None:
        system, folder = _place(self.folder)
        system.create_dir(folder, recursive=True)
        self.kind = np.dtype(np.uint32 if self.wide else np.uint16)
        self.schema = file_schema(self.length, self.wide)
        self._out = system.open_output_stream(f"{folder}/{self.name}.arrow")
        self._index_out = system.open_output_stream(f"{folder}/{self.name}.docs.arrow")
        self._file = pa.ipc.new_file(self._out, self.schema)
        self._index = pa.ipc.new_file(self._index_out, INDEX)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents by their ids one after another, the end ids included."""
        ends = np.cumsum(sizes)
        here = self.written + self.held
        self._index.write_batch(pa.RecordBatch.from_arrays(
            [doc_ids.cast(pa.int64()), pa.array(here + ends - sizes), pa.array(sizes)], schema=INDEX))
        last = np.zeros(len(ids), bool)
        last[ends - 1] = True
        self.pending.append(ids.astype(self.kind))
        self.ends.append(last)
        self.held += len(ids)
        self.docs += len(sizes)
        full = self.length * BATCH
        if self.held >= full:
            ids_, last_ = np.concatenate(self.pending), np.concatenate(self.ends)
            cut = self.held - self.held % full
            for a in range(0, cut, full):
                self._write(ids_[a: a + full], last_[a: a + full])
            self.pending, self.ends, self.held = [ids_[cut:]], [last_[cut:]], self.held - cut

    def _write(self, ids: np.ndarray, last: np.ndarray) -> None:
        pad = -len(ids) % self.length
        real = np.ones(len(ids) + pad, bool)
        real[len(ids):] = False
        columns = (np.concatenate([ids, np.zeros(pad, self.kind)]), real,
                   np.concatenate([last, np.zeros(pad, bool)]))
        self._file.write_batch(pa.RecordBatch.from_arrays([
            pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type)
            for x, f in zip(columns, self.schema, strict=True)], schema=self.schema))
        self.written += len(ids)

    def close(self) -> dict:
        if self.held:
            self._write(np.concatenate(self.pending), np.concatenate(self.ends))
        for x in (self._file, self._index, self._out, self._index_out):
            x.close()
        return {"file": f"{self.folder}/{self.name}.arrow", "index": f"{self.folder}/{self.name}.docs.arrow",
                "n_docs": self.docs, "n_tokens": self.written,
                "n_sequences": -(-self.written // self.length)}


#: Ids of words by tokenizer file, kept between the tasks of a worker.
_KNOWN: dict[str, dict[str, bytes]] = {}


class WordCoder:
    """Encodes whole texts, each distinct word of a call once.

    For tokenizers that take words apart from one another: their normaliser and
    pre-tokeniser drop white space and let nothing reach across it, so that the ids of a
    text are those of its words (between ASCII white space) one after another. Up to
    ``KNOWN_WORDS`` words are remembered between calls; that changes no result.
    """

    def __init__(self, tokenizer: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(tokenizer)
        self.known = _KNOWN.setdefault(tokenizer, {})
        self.end_id = end_id
        self.wide = max(self.coder.get_vocab_size(with_added_tokens=True), end_id + 1) > 1 << 16
        self.code, self.kind = ("I", np.dtype("<u4")) if self.wide else ("H", np.dtype("<u2"))

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian integers."""
        known = self.known
        out = list(map(known.get, words))
        new = [i for i, ids in enumerate(out) if ids is None]
        for a in range(0, len(new), CALL_WORDS):
            part = new[a: a + CALL_WORDS]
            coded = self.coder.encode_batch_fast([words[i] for i in part], add_special_tokens=False)
            for i, one in zip(part, coded, strict=True):
                ids = one.ids
                out[i] = struct.pack(f"<{len(ids)}{self.code}", *ids)
        for i in new[: max(0, KNOWN_WORDS - len(known))]:
            known[words[i]] = out[i]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; end ids included."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = self.word_ids(coded.dictionary.to_pylist())
        words.append(struct.pack(f"<{self.code}", self.end_id))
        size = np.fromiter(map(len, words), np.int64, len(words)) // self.kind.itemsize
        ids = np.frombuffer(b"".join(words), self.kind)
        # a text's words, then the end id as one word more
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        stops = bounds[1:] + np.arange(len(texts))
        place = np.full(len(coded) + len(texts), len(words) - 1, np.int32)
        inside = np.ones(len(place), bool)
        inside[stops] = False
        place[inside] = coded.indices.to_numpy()
        n = size[place]
        ends = np.cumsum(n)
        kind = np.int32 if ends[-1] < 1 << 31 else np.int64
        shift = ((np.cumsum(size) - size)[place] - (ends - n)).astype(kind)
        at = np.repeat(shift, n)
        at += np.arange(len(at), dtype=kind)
        return ids[at], np.diff(ends[stops], prepend=0)


def _calls(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CALL_BYTES``; a longer text is one of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first, n = 0, len(texts)
    while first < n:
        base = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, base + CALL_BYTES, side="right")), first + 1)
        yield first, last
        first = last


def write_sequences(
    docs: DataFrame, tokenizer: str, end_id: int = END_ID, length: int = LENGTH,
    files: int | None = None, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Write all documents in ascending id order; the manifest, one row a file.

    ``tokenizer`` is a file of the tokenizers library, of the kind that ``WordCoder`` takes,
    that every executor can read at that path. ``files`` is about how many files come out, the session's number of shuffle
    partitions by default.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "token-files")
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                         spark.sparkContext.defaultParallelism)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCoder(tokenizer, end_id)
        part = TaskContext.get().partitionId()
        out = None
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for a, b in _calls(texts):
                out = out or SequenceWriter(folder, f"{part:06d}-{uuid.uuid4().hex}", length, coder.wide)
                out.add(batch.column(0).slice(a, b - a), *coder.encode(texts.slice(a, b - a)))
        if out:
            yield pa.RecordBatch.from_pylist([{"part": part} | out.close()], pa.schema([
                ("part", pa.int32()), ("file", pa.string()), ("index", pa.string()),
                ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_sequences", pa.int64())]))

    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("place")]
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"),
        F.xxhash64(F.col(text).cast("string")).alias("tie"), F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    return written(rows.select("doc_id", "text").mapInArrow(write, _MANIFEST), "token-manifest")


# -------------------------------------------------------------------------- reading


def sequence(path: str, i: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Ids and masks of one sequence: views into the mapped file."""
    batch = pa.ipc.open_file(_opened(path)).get_batch(i // BATCH)
    row = batch.slice(i % BATCH, 1)
    ids, real, last = (row.column(k).flatten() for k in range(3))
    return ids.to_numpy(zero_copy_only=True), real, last


def with_offsets(manifest: DataFrame) -> DataFrame:
    """Add ``first_token`` and ``first_sequence`` of each file; the table has a row a file."""
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumns({
        f"first_{c}": F.coalesce(F.sum(f"n_{c}s").over(before), F.lit(0).cast("bigint"))
        for c in ("token", "sequence")})


def _each_file(manifest: DataFrame) -> DataFrame:
    spark = manifest.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return with_offsets(manifest).repartition(n, "part")


def read_sequences(manifest: DataFrame) -> DataFrame:
    """``sequence`` (numbered over all files), ``ids``, ``real``, ``last``."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for row in part.to_pylist():
                with _opened(row["file"]) as source:
                    found, at = pa.ipc.open_file(source), row["first_sequence"]
                    for i in range(found.num_record_batches):
                        batch = found.get_batch(i)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.arange(at, at + batch.num_rows)),
                            batch.column(0).cast(pa.list_(pa.int32())), batch.column(1).cast(pa.list_(pa.bool_())),
                            batch.column(2).cast(pa.list_(pa.bool_()))], names=["sequence", "ids", "real", "last"])
                        at += batch.num_rows

    return _each_file(manifest).mapInArrow(
        read, "sequence bigint, ids array<int>, real array<boolean>, last array<boolean>")


def _documents_of(file: str, index: str) -> Iterator[pa.RecordBatch]:
    """``doc_id``, ``start`` in the file, ``n_tokens`` and the CRC of each document's ids.

    Bounds are taken from the mask of last ids and must agree with the index.
    """
    with _opened(file) as source, _opened(index) as index_source:
        sequences, documents = pa.ipc.open_file(source), pa.ipc.open_file(index_source)
        starts, sizes, crcs = array("q"), array("q"), array("q")
        crc = size = at = 0
        for i in range(sequences.num_record_batches):
            batch = sequences.get_batch(i)
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=True)
            flat = flat[: batch.column(1).flatten().true_count].astype("<u4")
            last = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            done = 0
            for end in (np.flatnonzero(last) + 1).tolist():
                starts.append(at)
                sizes.append(size + end - done)
                crcs.append(zlib.crc32(flat[done:end], crc))
                at, crc, size, done = at + sizes[-1], 0, 0, end
            crc, size = zlib.crc32(flat[done:], crc), size + len(flat) - done
        read = 0
        for i in range(documents.num_record_batches):
            listed = documents.get_batch(i)
            span = slice(read, read + listed.num_rows)
            if any(listed.column(k).to_pylist() != x[span].tolist() for k, x in ((1, starts), (2, sizes))):
                raise ValueError(f"{index} does not fit {file}")
            yield listed.append_column("ids_crc32", pa.array(crcs[span], pa.int64()))
            read = span.stop
        if read != len(starts):
            raise ValueError(f"{index} does not fit {file}")


def read_documents(manifest: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids_crc32``."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for row in part.to_pylist():
                for docs in _documents_of(row["file"], row["index"]):
                    start = pa.array(docs.column(1).to_numpy() + row["first_token"])
                    yield docs.set_column(1, "start", start)

    return _each_file(manifest).mapInArrow(read, _DOCUMENT)


def token_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files and read every document back from them."""
    return read_documents(write_sequences(docs, tokenizer))
