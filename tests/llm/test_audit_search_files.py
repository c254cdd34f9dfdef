"""Filter audit, ranked search and token files: SQL, brute force and odd rows."""

import itertools
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opinionmill.llm import filter_audit, max_sketch, queries, token_files
from opinionmill.llm.tables import written
from opinionmill.llm.wordarrays import Chunk, chunks
from tools.check import canon

SF = "/root/testdata/sf0.001"
CODER = public_tokenizers.path("word_bpe_49k.json")
PLAIN = "A quiet river runs past the old mill, and nobody in the village minds its slow way. " * 3
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
# repeated and null ids with the same and other texts, clashing column names
ROWS = [
    (1, None, "en", "a", 1, 0, 1), (2, "", "en", "b", 2, 1, 0), (3, " \t\n", "de", "c", 3, 1, 1),
    (4, PLAIN, "en", "d", 4, 0, 0), (4, PLAIN, "en", "d", 4, 0, 0), (4, "MILL # mill", "", "d", 4, 0, 0),
    (5, PLAIN, None, "e", 5, None, 1), (None, PLAIN, "en", "f", 6, 1, 1), (None, PLAIN, "en", "g", 7, 1, 1),
    (6, LONG, "en", "h", 8, 1, 1), (2**63 - 1, PLAIN, "en", "i", 9, 1, 1), (-7, "naïve café 漢字 MILL's", "fr", "j", 10, 1, 1),
    (9, "RIVER river", "fr", "k", 11, 1, 1), (8, "RIVER river", "fr", "k", 12, 1, 1),
]
SCHEMA = "doc_id bigint, text string, lang string, mask string, n int, good int, score int"
LABELS = [(1, 1, 0), (2, 0, 1), (4, 1, 1), (4, 0, None), (5, 1, 1), (None, 1, 1), (99, 1, 1), (9, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"arrow_{name}", df.toArrow())
        con.execute(f"create table {name} as select * from arrow_{name}")
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    return canon(rel.fetchall(), names), sorted(names)


def rows_of(df):
    return canon([tuple(r) for r in df.collect()], df.columns), sorted(df.columns)


# ------------------------------------------------------------------------- audit


def brute_audit(rows, marks):
    first, out = {}, {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    counted = []
    for doc_id, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": any(c in text for c in "#$%&*|"),
            "E": doc_id is not None and first[text] < doc_id}
        good = any(i == doc_id and q == 1 for i, q, _ in marks if i is not None)
        bad = any(i == doc_id and t == 1 for i, _, t in marks if i is not None)
        counted.append((lang or "", {k for k, v in fails.items() if v}, good, bad))
    for part in {c[0] for c in counted}:
        for order in itertools.permutations("ABCDE"):
            alive = [c for c in counted if c[0] == part]
            for step, letter in enumerate(order, 1):
                gone = [c for c in alive if letter in c[1]]
                before = [c for c in counted if c[0] == part and c[1] & set(order[: step - 1])]
                alive = [c for c in alive if letter not in c[1]]
                out[part, "".join(order), step] = [
                    len(alive), len(gone), sum(letter in c[1] for c in before),
                    sum(c[1] == {letter} for c in counted if c[0] == part),
                    sum(c[2] for c in gone), sum(c[3] for c in gone)]
    return out


def test_audit_by_definition(docs, labels):
    got = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.audit_filters(docs, labels).collect()}
    want = brute_audit(ROWS, LABELS)
    assert set(got) == set(want) and {k[0] for k in got} == {"", "de", "en", "fr"}
    for key, counts in want.items():
        assert [got[key][c] for c in filter_audit.COUNTS] == counts, key
        letter = key[1][key[2] - 1]
        assert got[key]["shapley"] == sum(
            v[1] for k, v in want.items() if k[0] == key[0] and k[1][k[2] - 1] == letter)


def test_audit_by_sql_on_odd_rows(docs, labels):
    assert rows_of(filter_audit.audit_filters(docs, labels)) == by_sql(
        filter_audit.duck_audit(), documents=docs, labels=labels)


def test_audit_of_nothing(docs, labels):
    assert filter_audit.audit_filters(docs.limit(0), labels).isEmpty()
    out = filter_audit.audit_filters(docs, labels.limit(0))
    assert out.count() == 4 * 600 and out.where("good_lost + toxic_lost > 0").isEmpty()


def test_audit_of_own_filters(docs, labels):
    cells = filter_audit.mask_cells(docs, labels, {"X": F.length("text") > 50, "Y": F.col("text").isNull()}, copy=None)
    out = {(r["filter_order"], r["step"]): r["removed"] for r in
           filter_audit.audit(cells, "XY").where("part = 'en'").collect()}
    assert out == {("XY", 1): 6, ("XY", 2): 1, ("YX", 1): 1, ("YX", 2): 6}
    with pytest.raises(ValueError):
        filter_audit.audit(cells, "ABCDEFGH")


def test_same_text_in_many_rows(spark, labels):
    """One text holds most rows; only its smallest id is no copy."""
    docs = spark.range(5000).selectExpr("id as doc_id", "if(id % 10 < 7, 'same', concat('t', id)) as text",
                                        "if(id % 2 = 0, 'en', 'de') as lang")
    out = {(r["part"], r["step"]): r["removed"] for r in
           filter_audit.audit_filters(docs, labels).where("filter_order = 'EABCD'").collect()}
    assert out["en", 1] + out["de", 1] == 3499


# ------------------------------------------------------------------------ search


ITEMS = [(1, "the river and the OLD mill mill"), (2, None), (2, "café"), (3, "#!?"), (None, "word5 naïve river"), (4, "")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


@pytest.mark.parametrize("batch_pairs", [max_sketch.BATCH_PAIRS, 3])
def test_search_by_sql_on_odd_rows(docs, items, batch_pairs, monkeypatch):
    monkeypatch.setattr(max_sketch, "BATCH_PAIRS", batch_pairs)
    got = max_sketch.ranked_search(docs, items)
    assert rows_of(got) == by_sql(max_sketch.duck_ranked(), documents=docs, benchmark=items)
    assert {r["item_id"] for r in got.collect()} == {1, 2, None}


def test_search_of_nothing(docs, items):
    assert max_sketch.ranked_search(docs.limit(0), items).isEmpty()
    assert max_sketch.ranked_search(docs, items.limit(0)).isEmpty()
    assert max_sketch.ranked_search(docs.where("doc_id = 2"), items).isEmpty()


def test_search_over_words_of_few_kinds(spark, monkeypatch):
    """Many ties and crowded sketches; small blocks and shards."""
    monkeypatch.setattr(max_sketch, "WIDTH", 16)
    monkeypatch.setattr(max_sketch, "BLOCK", 7)
    monkeypatch.setattr(max_sketch, "SHARD_BYTES", 900)
    draw = random.Random(4)
    texts = [" ".join(f"w{min(int(draw.expovariate(0.1)), 60)}" for _ in range(draw.randrange(30))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = docs.where("doc_id % 9 = 0").withColumnRenamed("doc_id", "item_id")
    assert rows_of(max_sketch.ranked_search(docs, items, k=5)) == by_sql(
        max_sketch.duck_ranked(k=5), documents=docs, benchmark=items)


def test_bounds_hold_and_prune():
    draw = np.random.default_rng(5)
    names = [f"t{i}" for i in range(3000)]
    texts = [" ".join(names[min(int(x), 2999)] for x in draw.exponential(150, 120)) for _ in range(1500)]
    chunk = next(chunks(pa.array(texts), fold=True, size=1 << 30))
    row = max_sketch.shard_row(chunk, list(range(1500)))
    shard = max_sketch.Shard(row, row["n_docs"], row["n_terms"])
    rows = [{"query": q, "term": t, "n": 1} for q in range(4) for t in set(texts[q * 100].split())]
    batch = max_sketch.Batch.of(rows)
    number = batch.numbers(row)
    df = np.frombuffer(row["df"], np.int32)[number]
    weights = np.array([max_sketch.weight(int(x), 1500) for x in df])[batch.term]
    one, two = shard.sketches(0, 1500)
    places = max_sketch.coordinates(batch.hashes)
    best = [max_sketch.Best(5) for _ in batch.queries]
    assert shard.search(batch, weights, best) < 0.2 * 4 * 1500  # few documents are scored
    for i in range(4):
        span = slice(batch.bounds[i], batch.bounds[i + 1])
        terms, w = batch.term[span], weights[span]
        exact = shard.scores(np.arange(1500), number[terms], w)
        bound = w @ np.minimum(one[places[0][terms]], two[places[1][terms]]).astype(np.int64) * max_sketch.UNIT
        assert (bound >= exact).all()
        order = np.lexsort((np.arange(1500), -exact))[:5]
        assert best[i].id.tolist() == order.tolist() and best[i].score.tolist() == exact[order].tolist()


def test_terms_that_share_a_hash(monkeypatch):
    """All terms hashed alike are still told apart by their bytes."""
    monkeypatch.setattr(Chunk, "hashes", lambda self, a, b: np.full(len(a), 7, np.uint64))
    chunk = next(chunks(pa.array(["b a b", "c a"]), fold=True))
    row = max_sketch.shard_row(chunk, [1, 2])
    assert row["names"] == b"a b c" and np.frombuffer(row["df"], np.int32).tolist() == [2, 1, 1]
    assert max_sketch.Batch.of([{"query": 1, "term": t, "n": 1} for t in "cbx"]).numbers(row).tolist() == [1, 2, -1]


# -------------------------------------------------------------------- token files


def coded(text):
    return [*Tokenizer.from_file(CODER).encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_files_by_definition(spark):
    got = {tuple(r) for r in queries.QUERIES["op13_token_files"](spark, SF).collect()}
    at, want = 0, set()
    for doc_id, text in duckdb.connect().execute(
            f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall():
        ids = coded(text)
        want.add((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


@pytest.mark.parametrize(("length", "batch", "call"), [(8, 3, 64), (1024, 256, 1 << 22)])
def test_files_of_odd_rows(docs, length, batch, call, monkeypatch):
    monkeypatch.setattr(token_files, "BATCH", batch)
    monkeypatch.setattr(token_files, "CALL_BYTES", call)
    manifest = token_files.write_sequences(docs, CODER, length=length, files=3)
    got = sorted(token_files.read_documents(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got][-2:] == [None, None] and len(got) == len(ROWS)
    ids = [r["doc_id"] for r in got][:-2]
    assert ids == sorted(ids)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    want = sorted((str(r[0]), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r in ROWS for x in [coded(r[1])])
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    sequences = token_files.read_sequences(manifest).orderBy("sequence").collect()
    assert [r["sequence"] for r in sequences] == list(range(len(sequences)))
    assert all(len(r["ids"]) == len(r["real"]) == len(r["last"]) == length for r in sequences)
    flat = [x for r in sequences for x, real in zip(r["ids"], r["real"], strict=True) if real]
    for r in got:
        here = np.array(flat[r["start"]: r["start"] + r["n_tokens"]], "<u4")
        assert zlib.crc32(here.tobytes()) == r["ids_crc32"]
    assert sum(x for r in sequences for x in r["last"]) == len(ROWS)


def test_any_sequence_without_copies(docs):
    row = token_files.write_sequences(docs.where("doc_id = 6"), CODER, length=16, files=1).first()
    want = coded(LONG)
    for i in (0, 1, 255, 256, 700, row["n_sequences"] - 1):
        ids, real, last = token_files.sequence(row["file"], i)
        assert ids.dtype == np.uint16 and not ids.flags.owndata and not ids.flags.writeable
        here = want[i * 16: i * 16 + 16]
        assert ids.tolist()[: len(here)] == here and sum(real.to_pylist()) == len(here)
        assert sum(last.to_pylist()) == (i == row["n_sequences"] - 1)


def test_words_apart_give_the_ids_of_whole_texts():
    draw = random.Random(5)
    parts = [*"abcABC XYZ 019 \t\n\x0b\x0c\r.,;'!?-<|>#$", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "é",
             "́", "H̱", " ", " ", "漢字", "한", "한", "Σ", "İ", "ß", "😀",
             "‍", "\x1c", "\x85", "　", "﻿", "\x00", "don't"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(60))) for _ in range(3000)]
    ids, sizes = token_files.WordCoder(CODER, 2).encode(pa.array(texts))
    ends, coder = np.cumsum(sizes), Tokenizer.from_file(CODER)
    for text, end, n in zip(texts, ends, sizes, strict=True):
        assert ids[end - n: end].tolist() == [*coder.encode(text, add_special_tokens=False).ids, 2], text


def test_files_of_nothing(docs):
    manifest = token_files.write_sequences(docs.limit(0), CODER)
    assert manifest.isEmpty() and token_files.read_documents(manifest).isEmpty()
    assert token_files.read_sequences(manifest).isEmpty()


def test_leftover_files_are_not_read(docs):
    """Files of a task that ran twice are named in no manifest."""
    manifest = written(token_files.write_sequences(docs, CODER, files=2), "kept")
    folder = os.path.dirname(manifest.first()["file"]).removeprefix("file:")
    with open(f"{folder}/000000-other.arrow", "wb") as out:
        out.write(b"half a file")
    assert token_files.read_documents(manifest).count() == len(ROWS)
