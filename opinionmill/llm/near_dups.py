"""MinHash near-duplicates with odd sketches.

A document is the set of its distinct ``WIDTH``-word shingles (A-Z lower-cased).
``SAMPLES`` minima of that set are taken; rows of ``ROWS`` minima make bands that
find candidates, and all minima, tagged by position, are folded into one parity
bitmap, the odd sketch. The population count of two sketches' XOR estimates how
many minima differ, closely where similarity is high, so most candidates are
dropped without their texts. The rest are confirmed on their full sets.

Groups of any size are handled without forming their pairs:

* documents with equal sets are one node from the start;
* first each member of a band is compared with the band's smallest member;
* members that are still in another component than most of their band are then
  compared with the band in blocks of ``BLOCK`` sketches, first their few best
  partners, then, if they are still apart, every partner that passes the sketch.

A pair at the threshold is missed by all bands with probability
``(1 - 0.8 ** ROWS) ** BANDS``, about 5e-8. The sketch drops a pair only ``SLACK``
below the threshold, over five deviations. A second bitmap holds the parity of the
whole set: its XOR never counts more than the sets' symmetric difference, so what it
drops is below the threshold for certain, and for sets of up to some thousand
shingles hardly any other pair is left to confirm.

Defined results: null and empty texts have no set, stay alone and are kept; rows
sharing an id are one node; null ids are kept and have no component; an empty
table gives an empty result; other columns are carried along by ``drop_near_dups``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionmill.llm.components import components
from opinionmill.llm.tables import packed, unpacked, written
from opinionmill.llm.wordarrays import chunks, mix, stream, windows

WIDTH = 4
PERCENT = 80
SAMPLES = 256
ROWS = 4
BITS = 1024
SLACK = 0.15
BLOCK = 256
BEST = 4
BANDS = 32  # of the SAMPLES / ROWS possible ones
_SEED_FACTOR, _SEED_TAG, _SEED_BAND = 11, 12, 13


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a column, in order."""
    for chunk in chunks(column, fold=True):
        starts, ends = chunk.words()
        keys, bounds = windows(chunk.hashes(starts, ends), chunk.word_bounds(starts), width)
        for r in range(chunk.rows):
            yield np.unique(keys[bounds[r]: bounds[r + 1]])


def minima(keys: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The smallest of ``mix``-like hashes of a set, one for each factor."""
    low = np.full(len(factors), np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for at in range(0, len(keys), 512):
            x = keys[at: at + 512, None] * factors[None, :]
            low = np.minimum(low, (x ^ (x >> np.uint64(29))).min(axis=0))
    return low


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Fold the minima, tagged by position, into a parity bitmap of ``BITS`` bits."""
    with np.errstate(over="ignore"):
        bit = (mix(low + stream(len(low), _SEED_TAG)) % np.uint64(BITS)).astype(np.int64)
    parity = (np.bincount(bit, minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def set_parity(keys: np.ndarray) -> np.ndarray:
    """The parity bitmap of a whole set."""
    bit = (keys >> np.uint64(32)).astype(np.int64) % BITS
    return np.packbits((np.bincount(bit, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


_SKETCHED = ("doc_id bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>, "
             "sketch array<bigint>, parity array<bigint>")


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
             width: int = WIDTH) -> DataFrame:
    """Per row: set size, a 128-bit digest of the set, band keys and odd sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = stream(SAMPLES, _SEED_FACTOR) | np.uint64(1)
        tags = stream(BANDS, _SEED_BAND)
        for batch in batches:
            n = batch.num_rows
            sizes = np.zeros(n, np.int64)
            d = np.zeros((n, 2), np.uint64)
            bands = np.zeros((n, BANDS), np.int64)
            odd = np.zeros((n, BITS // 64), np.int64)
            parity = np.zeros((n, BITS // 64), np.int64)
            with np.errstate(over="ignore"):
                for i, keys in enumerate(shingle_sets(batch.column(1), width)):
                    sizes[i] = len(keys)
                    if not len(keys):
                        continue
                    d[i, 0] = np.add.reduce(mix(keys))
                    d[i, 1] = np.bitwise_xor.reduce(mix(keys + np.uint64(1)))
                    low = minima(keys, factors)
                    odd[i] = odd_sketch(low)
                    parity[i] = set_parity(keys)
                    key = tags.copy()
                    for j in range(ROWS):
                        key = mix(key + low[j: BANDS * ROWS: ROWS])
                    bands[i] = key.view(np.int64)
            fixed = lambda x: pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.record_batch({
                "doc_id": batch.column(0), "n": pa.array(sizes),
                "d1": pa.array(d[:, 0].copy().view(np.int64)),
                "d2": pa.array(d[:, 1].copy().view(np.int64)),
                "bands": fixed(bands), "sketch": fixed(odd),
                "parity": fixed(parity)})

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")
                       ).mapInArrow(run, _SKETCHED)


def _differing(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0),
                       lambda s, v: s + v)


def _most_bits(percent: int) -> int:
    """Differing bits up to which a pair is not dropped."""
    allowed = 2 * SAMPLES * (1 - (percent / 100 - SLACK))
    return int(BITS / 2 * (1 - np.exp(-2 * allowed / BITS)))


def _may_link(a: str, b: str, percent: int) -> Column:
    """Pairs that size, whole-set parity and odd sketch leave open."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return _sizes_fit(na, nb, percent) & (
        _differing(F.col(f"{a}.parity"), F.col(f"{b}.parity")) * (100 + percent)
        <= (na + nb) * (100 - percent)) & (
        _differing(F.col(f"{a}.sketch"), F.col(f"{b}.sketch")) <= _most_bits(percent))


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the threshold."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(shingle_sets(batch.column(2), width), shingle_sets(batch.column(3), width),
                       strict=True)
            linked = []
            for x, y in both:
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(
        run, "a bigint, b bigint")


def _apart(members: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int,
           best: int | None) -> DataFrame:
    """Pairs across components inside bands, by blocks of sketches.

    ``members`` has ``key, node``. Only members outside their band's most frequent
    component are compared, with the whole band; ``best`` keeps each one's closest
    partners only.
    """
    placed = members.join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    per = placed.groupBy("key", "component").agg(F.count("*").alias("c"))
    bands = per.groupBy("key").agg(
        F.max_by("component", F.struct("c", "component")).alias("main"),
        F.sum("c").alias("size"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    rows = placed.join(bands, "key").join(nodes.select("node", "n", "sketch", "parity"), "node")
    rows = rows.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    asks = rows.where("component != main").withColumn("other", F.explode(every)).select(
        "key", "block", "other", F.lit(True).alias("asks"), "node", "component", "n", "sketch", "parity")
    gives = rows.withColumn("ask", F.explode(every)).select(
        "key", F.col("ask").alias("block"), F.col("block").alias("other"),
        F.lit(False).alias("asks"), "node", "component", "n", "sketch", "parity")
    met = ["key", "block", "other"]
    both = asks.union(gives).repartition(*met).sortWithinPartitions(*met)
    most = _most_bits(percent)

    def starts(frame: pd.DataFrame) -> np.ndarray:
        ids = frame[met].to_numpy()
        return np.flatnonzero(np.any(ids[1:] != ids[:-1], axis=1)) + 1

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        cut = starts(frame)
        asking = frame["asks"].to_numpy()
        node, comp, size = (frame[c].to_numpy() for c in ("node", "component", "n"))
        sketch, parity = (np.stack(frame[c].to_numpy()).view(np.uint64) for c in ("sketch", "parity"))
        found = []
        for lo, hi in zip(np.append(0, cut), np.append(cut, len(frame)), strict=True):
            a, b = lo + np.flatnonzero(asking[lo:hi]), lo + np.flatnonzero(~asking[lo:hi])
            if not len(a) or not len(b):
                continue
            bits = np.bitwise_count(sketch[a][:, None, :] ^ sketch[b][None, :, :]).sum(axis=2)
            fit = np.minimum(size[a][:, None], size[b][None, :]) * 100 >= np.maximum(
                size[a][:, None], size[b][None, :]) * percent
            apart = np.bitwise_count(parity[a][:, None, :] ^ parity[b][None, :, :]).sum(axis=2, dtype=np.int64)
            fit &= apart * (100 + percent) <= (size[a][:, None] + size[b][None, :]) * (100 - percent)
            fit &= (comp[a][:, None] != comp[b][None, :]) & (bits <= most)
            if best is not None:
                bits = np.where(fit, bits, BITS + 1)
                close = np.argsort(bits, axis=1, kind="stable")[:, :best]
                keep = np.zeros_like(fit)
                np.put_along_axis(keep, close, True, axis=1)
                fit &= keep
            i, j = np.nonzero(fit)
            found.append(np.stack([node[a[i]], node[b[j]]]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pd.DataFrame({"a": pairs.max(axis=0), "b": pairs.min(axis=0)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # only the last two blocks that meet, about 2 * BLOCK rows, wait for the next batch
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            cut = starts(frame)
            last = int(cut[-1]) if len(cut) else 0
            rest = frame.iloc[last:].reset_index(drop=True)
            if last:
                yield compare(frame.iloc[:last])
        if rest is not None and len(rest):
            yield compare(rest)

    return both.mapInPandas(run, "a bigint, b bigint").distinct()


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    rows = written(sketches(docs, doc_id, text, width), "sketches")
    full = rows.where("n > 0 and doc_id is not null")
    sets = full.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("node"))
    sets = written(sets, "sets")
    nodes = full.join(sets, ["n", "d1", "d2"]).where("doc_id = node").select(
        "node", "n", "bands", "sketch", "parity")
    banded = nodes.select("node", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(
        F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last").drop("last")
    members = written(banded.join(buckets, "key"), "band-members")
    wanted = members.select("node").distinct()
    nodes = written(nodes.join(wanted, "node"), "candidate-sketches")
    source = docs.select(F.col(doc_id).cast("bigint").alias("node"), F.col(text).alias("text"))
    texts = written(source.join(wanted, "node"), "candidate-texts")

    facts = F.struct("n", "sketch", "parity")
    first = members.where("node != centre").select(
        F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    first = first.join(nodes.select(F.col("node").alias("a"), facts.alias("of_a")), "a").join(
        nodes.select(F.col("node").alias("b"), facts.alias("of_b")), "b")
    tried = written(first.where(_may_link("of_a", "of_b", percent)).select("a", "b").distinct(), "pairs")
    links = written(confirm(tried, texts, percent, width), "links")
    for best in (BEST, None):
        labels = written(components(links), "labels")
        more = _apart(members.select("key", "node"), labels, nodes, percent, best)
        more = written(more.join(tried, ["a", "b"], "left_anti"), "pairs")
        links = written(links.union(confirm(more, texts, percent, width)), "links")
        tried = tried.union(more)
    labels = components(links)
    named = sets.join(labels, "node", "left").select(
        "n", "d1", "d2", F.coalesce("component", "node").alias("component_id"))
    found = rows.select("doc_id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
    component = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(
        F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def drop_near_dups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``docs`` with one document, the smallest id, of each group of near-duplicates."""
    gone = near_groups(docs, doc_id, text, percent, width).where("not kept").select("doc_id").distinct()
    rows = packed(docs, doc_id=F.col(f"`{doc_id}`"))
    return rows.join(gone, "doc_id", "left_anti").select(*unpacked(docs))
