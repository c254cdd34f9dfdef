"""Exact removal of long repeats with run-length indexes.

A byte goes when a ``LENGTH``-byte string covers it that also starts in a document
with a smaller id. Candidates are routed by content, so every index stays small:

1. Each ``LENGTH``-byte string is named by its smallest hashed ``GRAM``-byte piece
   (a minimiser). Consecutive strings of one name form a stretch of text, and equal
   strings always get the same name. The names of each group of documents meet by
   hash; names that occur in one document only are done.
2. Stretches of shared names meet by name and hash. Equal stretches are settled
   there: all but the first document's are repeats. Only stretches that share a
   name and yet differ, once each, go on with their bytes.
3. Those of one bucket are sorted into a Burrows-Wheeler transform, kept as runs
   with the text place of every run's end. Each stretch streams backwards through
   it, one step of the run table a byte, so that the rows of all its suffixes are
   known; rows that agree for ``LENGTH`` bytes form one class, and a suffix whose
   class holds a smaller id has a match that long and is marked.
4. Marks return to their documents, which are cut and hashed.

Everything between documents and result travels as packed arrays; the texts are
shuffled once, by groups, and that exchange serves all rounds. Within a group equal
stretches are settled at once, so a passage found in a third of all rows sends one
entry for each group of about ``GROUP_BYTES``. The largest piece of work a task
holds is one group or one bucket of about the same size.

Defined results: null texts are empty (the hash of no bytes); a null id counts as
larger than all others; rows that share an id are not earlier than each other;
matches never cross documents; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionmill.llm.wordarrays import Chunk, chunks, mix, stream

LENGTH = 50
GRAM = 24
SPAN = LENGTH - GRAM + 1
GROUP_BYTES = 6 << 20
INDEX_BYTES = 1 << 20
_LAST = np.iinfo(np.int64).max
_BYTE = stream(256, 31)
_FACTOR = stream(32, 32) | np.uint64(1)


def grams(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of the ``size`` bytes from each place on, by doubling."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    power, width, level, out, done = _BYTE[data], 1, 0, None, 0
    with np.errstate(over="ignore"):
        while True:
            if size & width:
                if out is None:
                    out, done = power, width
                else:
                    n = min(len(out), len(power) - done)
                    out, done = out[:n] * _FACTOR[16 + level] + power[done: done + n], done + width
            if 2 * width > size:
                return mix(out[: len(data) - size + 1])
            power = power[:-width] * _FACTOR[level] + power[width:]
            width *= 2
            level += 1


def least_of(values: np.ndarray, span: int) -> np.ndarray:
    """The smallest of ``span`` values from each place on."""
    width, out = 1, values
    while 2 * width <= span:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    if width < span:
        n = len(values) - span + 1
        out = np.minimum(out[:n], out[span - width: span - width + n])
    return out


def stretches(chunk: Chunk) -> tuple[np.ndarray, ...]:
    """Name, row, start (in the row) and number of strings of each stretch."""
    n = len(chunk.data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.astype(np.uint64), none, none, none
    name = least_of(grams(chunk.data), SPAN)
    inside = np.zeros(n + 1, np.int8)  # places where a string fits into its row
    size = np.diff(chunk.bounds)
    fits = size >= LENGTH
    inside[chunk.bounds[:-1][fits]] += 1
    inside[chunk.bounds[:-1][fits] + size[fits] - LENGTH + 1] -= 1
    inside = np.cumsum(inside, dtype=np.int8)[: len(name)].astype(bool)
    head = inside.copy()
    head[1:] &= ~inside[:-1] | (name[1:] != name[:-1])
    head[chunk.bounds[:-1][fits]] = True
    tail = inside.copy()
    tail[:-1] &= head[1:] | ~inside[1:]
    start, count = np.flatnonzero(head), np.flatnonzero(tail) + 1 - np.flatnonzero(head)
    if len(count) and count.max() > SPAN:  # periodic text: cut, so that bytes stay bounded
        parts = -(-count // SPAN)
        step = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(start, parts) + step * SPAN
        count = np.minimum(np.repeat(count, parts) - step * SPAN, SPAN)
    row = np.searchsorted(chunk.bounds, start, side="right") - 1
    return name[start], row, start - chunk.bounds[row], count


def _span_keys(chunk: Chunk, row: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each stretch."""
    first = chunk.bounds[row] + start
    return chunk.hashes(first, first + count + LENGTH - 1)


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.int64(len(arrays[0])).tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]])


def _unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_BLOB = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
_BLOB_SQL = "bucket int, g int, kind int, data binary"
MARKS, ASKED = 1, 2


def _documents(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Ids and texts of one group in an order that every round repeats."""
    ids = table["doc_id"].combine_chunks().fill_null(_LAST)
    order = pa.table({"i": ids, "t": table["text"]}).sort_by([("i", "ascending"), ("t", "ascending")])
    return order["i"].to_numpy(), order["t"].combine_chunks()


def _found(ids: np.ndarray, texts: pa.Array, keys: bool) -> tuple[np.ndarray, ...]:
    """Stretches of a whole group: name, row, start, count and, if asked, content key."""
    parts = []
    for chunk in chunks(texts):
        name, row, start, count = stretches(chunk)
        key = _span_keys(chunk, row, start, count) if keys else np.zeros(0, np.uint64)
        parts.append((name, row + chunk.first, start, count, key))
    if not parts:
        parts = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64))]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _by_bucket(name: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of sorted names, and where each bucket begins."""
    where = (name >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return where, np.searchsorted(where, np.arange(buckets + 1))


def _heads(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


class RunIndex:
    """A run-length Burrows-Wheeler index over a set of byte strings."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        size = np.diff(bounds)
        n = self.strings = len(size)
        total = len(data) + n
        # every string is followed by its own end mark; marks sort first, by string
        self.starts = bounds[:-1] + np.arange(n)
        self.size = size
        text = np.zeros(total, np.int64)
        body = np.ones(total, bool)
        body[self.starts + size] = False
        text[body] = data.astype(np.int64) + 1
        owner = np.repeat(np.arange(n), size + 1)
        left = np.repeat(self.starts + size, size + 1) - np.arange(total)  # bytes up to the end mark
        key = np.zeros(total, np.int64)
        for j in range(7):  # seven symbols of nine bits
            part = np.zeros(total, np.int64)
            part[: total - j] = text[j:]
            key = (key << 9) | np.where(left >= j, part, 0)
        step, ranks = 7, {}
        order = np.argsort(key, kind="stable")
        rank = self._ranks(order, key[order])
        while True:
            ranks[step] = rank
            beyond = np.arange(total) + step
            second = np.where(left >= step, n + rank[np.minimum(beyond, total - 1)], owner)
            order = np.argsort(rank * (2 * total + n) + second, kind="stable")
            pair = (rank * (2 * total + n) + second)[order]
            rank = self._ranks(order, pair)
            step *= 2
            if step > int(size.max()):
                break
        self.order = order
        before = text[np.maximum(order - 1, 0)]
        before[np.isin(order, self.starts)] = 0  # before a string's first byte stands an end mark
        self.run_start = _heads(before)
        self.run_head = before[self.run_start]
        run_size = np.diff(np.append(self.run_start, total))
        # place of a run's first row after one step back: smaller symbols, then equal ones above
        grouped = np.argsort(self.run_head, kind="stable")
        running = np.cumsum(run_size[grouped]) - run_size[grouped]
        self.run_base = np.empty(len(grouped), np.int64)
        self.run_base[grouped] = running
        self.run_end_place = order[self.run_start + run_size - 1]
        self.text_owner = owner
        # rows that agree with the row above for LENGTH bytes
        far = max(s for s in ranks if s <= LENGTH)
        a, b = order[:-1], order[1:]
        shift = LENGTH - far
        last = total - 1
        agree = (left[a] >= LENGTH) & (left[b] >= LENGTH) & (ranks[far][a] == ranks[far][b]) & (
            ranks[far][np.minimum(a + shift, last)] == ranks[far][np.minimum(b + shift, last)])
        self.class_start = np.flatnonzero(np.append(True, ~agree))

    @staticmethod
    def _ranks(order: np.ndarray, sorted_key: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(np.append(0, sorted_key[1:] != sorted_key[:-1]))
        return rank

    def back(self, rows: np.ndarray) -> np.ndarray:
        """One step towards the front of the text, by the run table."""
        run = np.searchsorted(self.run_start, rows, side="right") - 1
        return self.run_base[run] + rows - self.run_start[run]

    def first_documents(self, docs: np.ndarray) -> np.ndarray:
        """The smallest document of each class of rows."""
        return np.minimum.reduceat(docs[self.text_owner[self.order]], self.class_start)

    def long_matches(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """String and offset of every suffix that a smaller document repeats."""
        first = self.first_documents(docs)
        by_size = np.argsort(-self.size, kind="stable")
        size = self.size[by_size]
        rows = by_size.copy()  # the rows of the end marks
        strings, offsets = [], []
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, side="left"))
            rows[:live] = self.back(rows[:live])
            if t + 1 < LENGTH:
                continue
            kind = np.searchsorted(self.class_start, rows[:live], side="right") - 1
            who = by_size[:live]
            hit = first[kind] < docs[who]
            strings.append(who[hit])
            offsets.append(size[:live][hit] - 1 - t)
        if not strings:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(strings), np.concatenate(offsets)


def mark_repeats(docs: DataFrame, doc_id: str, text: str):
    """Grouped documents, the number of groups, and packed marks by group."""
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES))
    buckets = groups
    source = source.select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("g"), "doc_id", "text")

    def names(table: pa.Table) -> pa.Table:
        ids, texts = _documents(table)
        name, row, _, _, _ = _found(ids, texts, False)
        doc = ids[row]
        order = np.argsort(name, kind="stable")
        name, doc = name[order], doc[order]
        first = _heads(name)
        several = (np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)) if len(first) else first
        name = name[first]
        _, cut = _by_bucket(name, buckets)
        g = table["g"][0].as_py()
        return _table(_BLOB, [
            (b, g, 0, _pack(name[lo:hi], several[lo:hi].astype(np.uint8)))
            for b, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if hi > lo])

    def shared_names(table: pa.Table) -> pa.Table:
        blobs = [_unpack(x, np.uint64, np.uint8) for x in table["data"].to_pylist()]
        name = np.concatenate([x[0] for x in blobs])
        order = np.argsort(name, kind="stable")
        first = _heads(name[order])
        several = np.concatenate([x[1] for x in blobs])[order].astype(bool)
        size = np.diff(np.append(first, len(name)))
        shared = (size > 1) | np.logical_or.reduceat(several, first)
        flag = np.empty(len(name), bool)
        flag[order] = np.repeat(shared, size)
        at, rows = 0, []
        for g, x in zip(table["g"].to_pylist(), blobs, strict=True):
            rows.append((table["bucket"][0].as_py(), g, 0, np.packbits(flag[at: at + len(x[0])]).tobytes()))
            at += len(x[0])
        return _table(_BLOB, rows)

    def entries(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return _table(_BLOB, [])
        ids, texts = _documents(table)
        name, row, start, count, content = _found(ids, texts, True)
        order = np.argsort(name, kind="stable")
        first = _heads(name[order])
        _, cut = _by_bucket(name[order][first], buckets)
        shared = np.zeros(len(first), bool)
        for b, bits in zip(answers["bucket"].to_pylist(), answers["data"].to_pylist(), strict=True):
            lo, hi = cut[b], cut[b + 1]
            shared[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
        keep = order[np.repeat(shared, np.diff(np.append(first, len(order))))]
        name, row, start, count, content = (x[keep] for x in (name, row, start, count, content))
        doc = ids[row]
        order = np.lexsort((start, row, doc, content, name))
        name, row, start, count, content, doc = (x[order] for x in (name, row, start, count, content, doc))
        # settled here: later documents of the group with the same stretch
        first = _heads(name, content)
        size = np.diff(np.append(first, len(name)))
        later = doc > np.repeat(doc[first], size)
        leader = np.zeros(len(name), bool)
        leader[first] = True
        # one document can hold a stretch twice: all its places follow the leader
        again = ~later & ~leader
        g = table["g"][0].as_py()
        rows = []
        whole = lambda m: (row[m].astype(np.int32), start[m].astype(np.int32), count[m].astype(np.int32))
        if later.any():
            rows.append((int(g) % buckets, g, MARKS, _pack(*whole(later))))
        for kept in (leader, again):
            at = np.flatnonzero(kept)
            _, cut = _by_bucket(name[at], buckets)
            for b, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if hi > lo:
                    m = at[lo:hi]
                    rows.append((b, g, 0, _pack(name[m], content[m], doc[m], *whole(m))))
        return _table(_BLOB, rows)

    def settle(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        out, parts, owner = [], [], []
        for g, kind, data in zip(*(table[c].to_pylist() for c in ("g", "kind", "data")), strict=True):
            if kind == MARKS:
                out.append((bucket, g, MARKS, data))
            else:
                parts.append(_unpack(data, np.uint64, np.uint64, np.int64, np.int32, np.int32, np.int32))
                owner.append(np.full(len(parts[-1][0]), g, np.int64))
        if not parts:
            return _table(_BLOB, out)
        name, content, doc, row, start, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        g = np.concatenate(owner)
        order = np.lexsort((start, row, g, doc, content, name))
        name, content, doc, row, start, count, g = (
            x[order] for x in (name, content, doc, row, start, count, g))
        first = _heads(name, content)
        size = np.diff(np.append(first, len(name)))
        repeat = doc > np.repeat(doc[first], size)
        by_name = _heads(name[first])
        mixed = np.repeat(np.diff(np.append(by_name, len(first))) > 1, np.diff(np.append(by_name, len(first))))
        ask = np.repeat(mixed, size) & ~repeat  # the first document's stretches, all places
        for kind, wanted in ((MARKS, repeat), (ASKED, ask)):
            at = np.flatnonzero(wanted)
            at = at[np.argsort(g[at], kind="stable")]
            cut = np.append(_heads(g[at]), len(at))
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                m = at[lo:hi]
                if hi > lo:
                    arrays = (row[m], start[m], count[m])
                    out.append((bucket, int(g[m[0]]), kind, _pack(*(
                        arrays if kind == MARKS else (name[m], content[m], *arrays)))))
        return _table(_BLOB, out)

    def fetch(key, table: pa.Table, asked: pa.Table) -> pa.Table:
        wanted = [_unpack(d, np.uint64, np.uint64, np.int32, np.int32, np.int32) for k, d in zip(
            asked["kind"].to_pylist(), asked["data"].to_pylist(), strict=True) if k == ASKED]
        if not wanted or not table.num_rows:
            return _table(_BLOB, [])
        ids, texts = _documents(table)
        name, content, row, start, count = (np.concatenate(x) for x in zip(*wanted, strict=True))
        order = np.lexsort((row, content, name))
        name, content, row, start, count = (x[order] for x in (name, content, row, start, count))
        whole = next(chunks(texts, size=1 << 62))
        first = whole.bounds[row] + start
        size = count.astype(np.int64) + LENGTH - 1
        g = table["g"][0].as_py()
        _, cut = _by_bucket(name, buckets)
        rows = []
        for b, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if hi > lo:
                before = np.cumsum(size[lo:hi]) - size[lo:hi]
                place = np.repeat(first[lo:hi] - before, size[lo:hi]) + np.arange(int(size[lo:hi].sum()))
                head = _pack(name[lo:hi], content[lo:hi], ids[row[lo:hi]], row[lo:hi], start[lo:hi], count[lo:hi])
                rows.append((b, g, 0, head + whole.data[place].tobytes()))
        return _table(_BLOB, rows)

    def index(table: pa.Table) -> pa.Table:
        parts, texts, owner = [], [], []
        for g, data in zip(table["g"].to_pylist(), table["data"].to_pylist(), strict=True):
            x = _unpack(data, np.uint64, np.uint64, np.int64, np.int32, np.int32, np.int32)
            parts.append(x)
            texts.append(np.frombuffer(data, np.uint8, offset=8 + len(x[0]) * 36))
            owner.append(np.full(len(x[0]), g, np.int64))
        name, content, doc, row, start, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        g, text = np.concatenate(owner), np.concatenate(texts)
        size = count.astype(np.int64) + LENGTH - 1
        place = np.cumsum(size) - size
        order = np.lexsort((content, name))
        first = order[_heads(name[order], content[order])]  # one text of each content
        same = np.repeat(np.arange(len(first)), np.diff(np.append(_heads(name[order], content[order]), len(order))))
        # names stay together; a new index begins once the last one is full
        names = name[first]
        heads = _heads(names)
        bytes_ = np.add.reduceat(size[first], heads)
        batch = np.repeat((np.cumsum(bytes_) - bytes_) // INDEX_BYTES, np.diff(np.append(heads, len(names))))
        out = []
        hit_s, hit_o = [], []
        for lo, hi in zip(*(lambda c: (c[:-1], c[1:]))(np.append(_heads(batch), len(batch))), strict=True):
            mine = first[lo:hi]
            z = size[mine]
            before = np.cumsum(z) - z
            data = text[np.repeat(place[mine] - before, z) + np.arange(int(z.sum()))]
            s, o = RunIndex(data, np.append(before, z.sum())).long_matches(doc[mine])
            hit_s.append(s + lo)
            hit_o.append(o)
        s, o = np.concatenate(hit_s), np.concatenate(hit_o)
        # every place of the first document that holds the content gets the marks
        of = np.argsort(s, kind="stable")
        s, o = s[of], o[of]
        begin, end = np.searchsorted(s, same), np.searchsorted(s, same, side="right")
        n = end - begin
        at = np.repeat(order, n)
        offs = o[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        by_g = np.argsort(g[at], kind="stable")
        at, offs = at[by_g], offs[by_g]
        cut = np.append(_heads(g[at]), len(at))
        bucket = table["bucket"][0].as_py()
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if hi > lo:
                m = at[lo:hi]
                out.append((bucket, int(g[m[0]]), MARKS, _pack(
                    row[m], (start[m] + offs[lo:hi]).astype(np.int32), np.ones(hi - lo, np.int32))))
        return _table(_BLOB, out)

    grouped = lambda df: df.groupBy("g")
    answers = grouped(source).applyInArrow(names, _BLOB_SQL).groupBy("bucket").applyInArrow(
        shared_names, _BLOB_SQL)
    settled = grouped(source).cogroup(grouped(answers)).applyInArrow(entries, _BLOB_SQL).groupBy(
        "bucket").applyInArrow(settle, _BLOB_SQL)
    indexed = grouped(source).cogroup(grouped(settled)).applyInArrow(fetch, _BLOB_SQL).groupBy(
        "bucket").applyInArrow(index, _BLOB_SQL)
    return source, settled.union(indexed)


def removed_mask(bounds: np.ndarray, row: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which bytes of the concatenated rows some marked string covers."""
    change = np.zeros(int(bounds[-1]) + 1, np.int32)
    first = bounds[row] + start
    np.add.at(change, first, 1)
    np.add.at(change, first + count + LENGTH - 1, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row.

    ``with_text`` adds the remaining bytes as ``kept`` (cuts may fall inside a
    character) and ``spans``, the removed runs as start and size.
    """
    source, marks = mark_repeats(docs, doc_id, text)
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
              ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    sql = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    if with_text:
        span = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))
        fields += [("kept", pa.binary()), ("spans", span)]
        sql += ", kept binary, spans array<struct<start:bigint,size:bigint>>"
    schema = pa.schema(fields)

    def cut(key, table: pa.Table, marks: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table(schema, [])
        ids, texts = _documents(table)
        whole = next(chunks(texts, size=1 << 62))
        found = [_unpack(d, np.int32, np.int32, np.int32) for k, d in zip(
            marks["kind"].to_pylist(), marks["data"].to_pylist(), strict=True) if k == MARKS]
        gone = np.zeros(len(whole.data), bool)
        if found:
            row, start, count = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
            gone = removed_mask(whole.bounds, row, start, count)
        rows = []
        for i, doc in enumerate(ids.tolist()):
            lo, hi = whole.bounds[i], whole.bounds[i + 1]
            mine = gone[lo:hi]
            kept = whole.data[lo:hi][~mine].tobytes()
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
            line = (None if doc == _LAST else doc, int(hi - lo), int(mine.sum()), len(edge) // 2,
                    hashlib.sha256(kept).hexdigest())
            if with_text:
                line += (kept, [{"start": int(a), "size": int(b - a)} for a, b in edge.reshape(-1, 2)])
            rows.append(line)
        return _table(schema, rows)

    return source.groupBy("g").cogroup(marks.groupBy("g")).applyInArrow(cut, sql)


def brute_force(rows: list[tuple[int, bytes]], length: int = LENGTH) -> Iterator[tuple]:
    """The definition itself, for tests: every string's smallest document in a dict."""
    first: dict[bytes, int] = {}
    for doc, text in rows:
        for i in range(len(text) - length + 1):
            s = text[i: i + length]
            first[s] = min(first.get(s, doc), doc)
    for doc, text in rows:
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if first[text[i: i + length]] < doc:
                gone[i: i + length] = b"\x01" * length
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        kept = bytes(b for b, x in zip(text, gone, strict=True) if not x)
        yield doc, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()
