"""Nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import random

import hashlib
import math
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from opinionmill.llm import (
    line_dedup, mixing, near_dups, pieces, pseudo_likelihood, quality_rules, repeats, topk_search,
    toxicity, url_filter,
)
from opinionmill.llm.components import components
from opinionmill.llm.wordarrays import chunks

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
PLAIN = "A quiet river runs past the old mill, and nobody in the village minds its slow way. " * 3
ROWS = [
    (1, None, "en", "a", 0, "k", 1), (2, "", "en", None, 0, "k", 2), (3, " \t\n", "de", "a", 3, "k", 3),
    (4, PLAIN, "en", "b", None, "k", 4), (4, PLAIN, "en", "b", None, "k", 4), (5, PLAIN, None, "b", 9, "k", 5),
    (6, LONG, "en", "c", len(LONG), None, 6), (None, PLAIN + " end", "en", "c", 1, "k", 7),
    (7, "x" * 5000, "en", "a", 5000, "k", 8), (8, "naïve café ▁ 漢字   end", "fr", "a", 1, "k", 9),
]
# extra columns whose names clash with those inside the operators
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, node int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id bigint, toxic int")


def test_quality(docs, none):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert got[1]["n_words"] == got[2]["n_words"] == got[3]["n_words"] == 0 and got[1]["base_failed"]
    assert got[4]["n_repeat_words"] == got[4]["n_words"] == 51 and not got[4]["kept"]
    assert quality_rules.quality_rules(docs).columns == docs.columns
    assert quality_rules.judge(none).isEmpty() and quality_rules.quality_rules(none).isEmpty()


def test_lines(docs, none, spark):
    out = line_dedup.dedup_lines(docs, count_as="gone")
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == [*docs.columns, "gone"] and out.count() == len(ROWS)
    assert got[1]["text"] is None and got[2]["text"] == "" and got[3]["text"] == " \t\n"
    assert got[4]["text"] == PLAIN and got[5]["text"] == "" and got[5]["gone"] == 1
    assert got[None]["text"] == ""  # one word more than an earlier line
    assert line_dedup.dedup_lines(none).isEmpty()


@pytest.mark.parametrize("ids", [(None, 1, None, 7, 7, 7), (5, 1, 5, 5, None, 2**63 - 1), (3, 3, 3, 3, 3, 3)])
def test_lines_of_shared_ids(spark, ids):
    """Null and repeated ids with the same and other texts: only repeated lines go."""
    line, other = "one two three four five", "a quite unique line of words"
    texts = [other, line, line, f"{other} more\n{line}\nlast words stay here too", None, line + "\n" + line]
    rows = [*zip(ids, texts, strict=True), (ids[1], line)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(r["doc_id"]), str(r["text"]), r["n"]) for r in
                 line_dedup.dedup_lines(docs, count_as="n").collect())
    con = duckdb.connect()
    con.register("odd", docs.toArrow())
    want = con.execute(f"with {line_dedup.duck_lines('odd')} select doc_id, new_text, n_removed from line_deduped")
    assert got == sorted((str(a), str(b), n) for a, b, n in want.fetchall())
    assert sum("last words stay here too" in t for _, t, _ in got) == 1
    assert any(other in t for _, t, _ in got) and any(t.startswith(line) for _, t, _ in got)


def test_clashing_names(spark):
    """Columns named like those inside the operators pass through unchanged."""
    names = ["row", "dk", "gone", "own", "n", "rate", "source_size", "__gone", "__dk", "__n", "__rate",
             "target_source", "component_id", "kept", "a.b"]
    schema = "doc_id bigint, text string, source string, " + ", ".join(f"`{c}` string" for c in names)
    text = "some words that stand in every one of these documents here"
    docs = spark.createDataFrame([(i, text, "s", *[f"{c}{i}" for c in names]) for i in (1, 2, 2)], schema)
    for out in (line_dedup.dedup_lines(docs), near_dups.drop_near_dups(docs), mixing.mix_sources(docs)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names)
    assert [r["doc_id"] for r in near_dups.drop_near_dups(docs).collect()] == [1]


def test_line_edits(spark):
    base = "one two three four five six"
    rows = [(1, base), (2, base + " seven"), (3, base.replace("three", "x")), (4, "one two four five six"),
            (5, "one two three four"), (6, "one x three four x six"), (7, "a b c d e\n" + base)]
    got = dict(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == {1: base, 2: "", 3: "", 4: "", 5: rows[4][1], 6: rows[5][1], 7: "a b c d e"}


def test_near(docs, none):
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dups.near_groups(docs).collect()}
    assert {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (None, None, True)} <= got
    assert near_dups.drop_near_dups(docs).columns == docs.columns
    assert near_dups.near_groups(none).isEmpty()


def test_mix(docs, none):
    got = {r["doc_id"]: r for r in mixing.mix_plan(docs).collect()}
    assert len(got) == 9 and got[1]["size"] == 0 and got[2]["target"] == 0
    assert all(r["copies"] * r["size"] <= 2 * r["size"] for r in got.values())
    first, again = (sorted(map(str, mixing.mix_sources(docs).collect())) for _ in range(2))
    assert first == again
    assert mixing.mix_sources(none).isEmpty() and mixing.mix_plan(none).isEmpty()


def test_pieces(docs, none):
    out = pieces.encode_pieces(docs)
    assert out.where("not round_trip").isEmpty() and out.count() == len(ROWS)
    back = {r["doc_id"]: r["text"] for r in pieces.decode_pieces(out).collect()}
    assert back[6] == LONG and back[8] == ROWS[-1][1] and back[1] == ""
    assert pieces.encode_pieces(none).isEmpty()
    auto = pieces.automaton_of(pieces.load_vocabulary())
    text = np.frombuffer((" " + LONG[:3000]).encode(), np.uint8)
    cut = np.flatnonzero(text == 32)
    ids, bounds, score = auto.many(text, cut, np.append(cut[1:], len(text)))
    for k in range(0, len(cut), 7):
        alone, best = auto.one(text[cut[k]: np.append(cut, len(text))[k + 1]])
        assert list(ids[bounds[k]: bounds[k + 1]]) == alone and abs(best - score[k]) < 1e-9


def test_repeats(docs, none):
    got = {(r["doc_id"], r["n_removed"]) for r in repeats.remove_repeats(docs).collect()}
    assert (4, 0) in got and (5, len(PLAIN)) in got and (1, 0) in got and (7, 0) in got
    assert (None, len(PLAIN)) in got  # the end is new
    r = repeats.remove_repeats(docs, with_text=True).where("doc_id = 1").first()
    assert r["kept_sha256"] == hashlib.sha256(b"").hexdigest() and r["spans"] == []
    assert repeats.remove_repeats(none).isEmpty()


def test_run_index_against_definition():
    rng = np.random.default_rng(1)
    core = rng.integers(97, 100, 70).astype(np.uint8)
    strings = [np.concatenate([rng.integers(97, 100, rng.integers(0, 9)).astype(np.uint8), core])[:76]
               for _ in range(30)]
    bounds = np.cumsum([0, *map(len, strings)])
    docs = rng.integers(0, 9, 30)
    s, o = repeats.RunIndex(np.concatenate(strings), bounds).long_matches(docs)
    want = {(i, p) for i, x in enumerate(strings) for p in range(len(x) - 49) if any(
        docs[j] < docs[i] and x[p:p + 50].tobytes() in y.tobytes() for j, y in enumerate(strings))}
    assert set(zip(s.tolist(), o.tolist(), strict=True)) == want


def test_search(docs, none):
    got = topk_search.search(docs, docs, k=3).collect()
    assert {r["query_id"] for r in got} == {4, 5, 6, 7, 8} and max(r["rank"] for r in got) <= 3
    assert next(r["doc_id"] for r in got if r["query_id"] == 7 and r["rank"] == 1) == 7
    assert topk_search.search(none, none).isEmpty() and topk_search.search(docs, none).isEmpty()


def test_block_pruning_is_exact(monkeypatch):
    rng = np.random.default_rng(2)
    n, terms = 1500, 40
    doc = rng.integers(0, n, 9000)
    h = np.sort(rng.integers(1, 2**62, terms).astype(np.uint64))
    pairs = np.unique(np.stack([doc, np.minimum(rng.geometric(0.1, 9000), terms) - 1]), axis=1)
    tf = rng.integers(1, 5, pairs.shape[1])
    lengths = np.maximum(np.bincount(pairs[0], tf, n), 1)
    asked = [(q, int(t)) for q in range(20) for t in rng.choice(terms, 6, replace=False)]
    idf = rng.uniform(0.1, 5, terms)
    group = topk_search.Group(*(np.array(x) for x in ([a for a, _ in asked], h[[t for _, t in asked]].view(np.int64),
                                                      idf[[t for _, t in asked]])))
    shard = topk_search.Shard(group, np.arange(n), lengths, pairs[0], h[pairs[1]], tf, float(lengths.mean()))
    q, d, s = shard.best(group, 10)
    for query in range(20):
        score = np.zeros(n)
        for t in (t for a, t in asked if a == query):
            at = pairs[1] == t
            norm = topk_search.K1 * (1 - topk_search.B + topk_search.B * lengths[pairs[0][at]] / lengths.mean())
            score[pairs[0][at]] += idf[t] * tf[at] * (topk_search.K1 + 1) / (tf[at] + norm)
        score = np.round(score, topk_search.DIGITS)
        best = sorted((-x, i) for i, x in enumerate(score) if x > 0)[:10]
        mine = q == query
        assert np.allclose(s[mine], [-x for x, _ in best], atol=2e-6) and len(best) == mine.sum()


def test_search_hands_out_rows_by_levels(spark, monkeypatch):
    """A query's rows do not grow with the tasks; ids repeat, texts are alike or equal."""
    draw = random.Random(3)
    texts = [" ".join(f"w{min(int(draw.expovariate(0.02)), 200)}" for _ in range(30)) for _ in range(900)]
    rows = [(i % 1100 if i % 7 else None, texts[i % 900 if i % 5 else i % 40]) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(30)
    asked = docs.where("doc_id % 50 = 0")
    handed, group = [], topk_search._search_group

    def spied(*args):
        found = group(*args)
        handed.append(found.selectExpr("coalesce(sum(size(docs)), 0)").first()[0])
        return found

    whole = sorted(tuple(r) for r in topk_search.search(docs, asked, k=4).collect())
    monkeypatch.setattr(topk_search, "FIRST_DOCS", 100, raising=False)
    monkeypatch.setattr(topk_search, "GROWTH", 3, raising=False)
    monkeypatch.setattr(topk_search, "_search_group", spied)
    assert sorted(tuple(r) for r in topk_search.search(docs, asked, k=4).collect()) == whole
    assert sum(handed) <= asked.distinct().count() * 4 * 10  # 2 tasks, then 2 for each level


def test_windows_and_classes_of_tokens():
    """Windows stop at row ends, for all tokens or some; classes are told in few bits."""
    pl, rng = pseudo_likelihood, np.random.default_rng(5)
    bounds = np.array([0, 0, 1, 3, 3, 7, 40, 40])
    ids = rng.integers(0, pl.TOP + pl.RARE, 40)
    none = pl.TOP + pl.RARE
    steps = [*range(-pl.SIDE, 0), *range(1, pl.SIDE + 1)]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    want = np.array([[ids[i + d] if bounds[row[i]] <= i + d < bounds[row[i] + 1] else none for d in steps]
                     for i in range(40)])
    some = np.array([0, 2, 3, 6, 7, 38, 39])
    assert (pl.contexts(ids, bounds) == want).all() and (pl.contexts(ids, bounds, some) == want[some]).all()
    assert pl.contexts(ids[:0], np.array([0, 0])).shape == (0, 2 * pl.SIDE)
    group, order, cut = pl._by_class(ids)
    assert group.itemsize == 1 and len(cut) == pl.CLASSES + 1
    assert order.tolist() == sorted(range(40), key=lambda i: ids[i] // pl.MEMBERS)
    assert all((group[order[cut[c]: cut[c + 1]]] == c).all() for c in range(pl.CLASSES))


def out_of_words(spark):
    """How much lower a token of invented words scores than one of prose."""
    draw = random.Random(8)
    words = [f"w{min(int(draw.expovariate(0.002)), 3000)}" for _ in range(40_000)]
    rows = [(i, " ".join(words[i * 400: i * 400 + 400])) for i in range(100)]
    rows.append((100, " ".join(f"zz{draw.randrange(10**9)}" for _ in range(300))))
    got = {r["doc_id"]: r["mean_log_prob"] for r in pseudo_likelihood.score_documents(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    return min(v for k, v in got.items() if k < 100) - got[100]


def test_likelihood_of_one_document(spark):
    """A score is the product of plain softmax probabilities, word by word."""
    pl = pseudo_likelihood
    draw = random.Random(4)
    texts = [" ".join(f"w{int(draw.expovariate(0.0003))}" for _ in range(1000)) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    per = pl.word_counts(docs.select("text"))
    top, counts = pl.vocabulary(per)
    tokens = [w for t in texts for w in t.split()]
    many = {w: tokens.count(w) for w in set(tokens)}
    assert len(many) > pl.TOP and counts.sum() == len(tokens)
    assert sorted(counts[: pl.TOP], reverse=True) == sorted(many.values(), reverse=True)[: pl.TOP]
    p = pl.views(pl.train(pl.encode(docs, "doc_id", "text", top), counts))

    def number(word):
        chunk = next(chunks(pa.array([word])))
        h = int(chunk.hashes(*chunk.words())[0])
        at = np.flatnonzero(top == np.uint64(h))
        return int(at[0]) if len(at) else pl.TOP + h % pl.RARE

    def softmax(x):
        return np.exp(x - x.max()) / np.exp(x - x.max()).sum()

    ids = {w: number(w) for w in many}
    groups = {g: sum(n for w, n in many.items() if ids[w] == g) for g in set(ids.values())}
    words = texts[5].split()
    total = 0.0
    for i, word in enumerate(words):
        window = [ids[words[j]] if 0 <= j < len(words) else pl.TOP + pl.RARE for j in (i - 2, i - 1, i + 1, i + 2)]
        hidden = np.tanh(np.concatenate([p["embed"][k] for k in window]) @ p["into"] + p["into_bias"])
        group, member = divmod(ids[word], pl.MEMBERS)
        chance = softmax(hidden @ p["classes"] + p["classes_bias"])[group]
        chance *= softmax(hidden @ p["words"][group] + p["words_bias"][group])[member]
        total += np.log(chance * many[word] / groups[ids[word]])
    got = {r["doc_id"]: r for r in pl.score_documents(docs).collect()}[5]
    assert got["n_tokens"] == 1000 and abs(got["log_prob"] - total) < 1e-3 * abs(total)
    assert abs(got["mean_log_prob"] - total / 1000) < 1e-2


def test_likelihood(docs, none, spark):
    got = {r["doc_id"]: r for r in pseudo_likelihood.score_documents(docs).collect()}
    assert got[1]["n_tokens"] == 0 and got[1]["log_prob"] == 0 and got[1]["mean_log_prob"] is None
    assert got[6]["n_tokens"] == 30_000 and got[6]["log_prob"] < 0
    assert pseudo_likelihood.score_documents(none).isEmpty()
    assert out_of_words(spark) > 1
    flat = pseudo_likelihood.start(np.arange(pseudo_likelihood.TOP + pseudo_likelihood.RARE, dtype=float))
    window = np.zeros((4096, 4), np.int64)
    p = pseudo_likelihood.log_probs(pseudo_likelihood.views(flat), window, np.arange(4096))
    assert abs(np.exp(p.astype(float)).sum() - 1) < 1e-3  # a normalised distribution


def test_toxic(docs, none, labels, spark):
    out = toxicity.score_toxicity(docs, labels)
    assert out.count() == len(ROWS) and out.where("score < 0 or score > 1 or score is null").isEmpty()
    assert toxicity.score_toxicity(none, labels).isEmpty()
    assert toxicity.score_toxicity(docs, labels.limit(0)).where("predicted = 1").isEmpty()
    clean, bad = b"The mill is old. The river is slow.", b"The mill is old. What an idiotic fool."
    w = toxicity.fit([clean, bad] * 40, [0, 1] * 40)
    chunk = next(chunks(pa.array([bad, clean, b""], pa.large_binary()), fold=True))
    score, s, p = toxicity.score_chunk(chunk, w)
    assert score[0] > 0.7 > 0.3 > score[1] and score[2] == 0
    assert s.row[p >= 0.7].tolist() == [0] and s.first_byte[p >= 0.7][0] >= 17  # the second sentence


def test_urls(spark):
    rows = [(1, None, "<p>casino bets pills</p>", 1), (2, "no scheme", None, 2),
            (3, "http://CasinoBets.Example.net/x?q", "<p>a</p>", 3), (3, "http://org/", "", 4),
            (4, "https://a.example.org/es/1#t", "", 5), (5, "http://q.example.net", "", 6)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, token int")
    got = [tuple(r)[:5] for r in url_filter.filter_urls(pages).collect()]
    assert (1, "", "", None, "allow") in got and (2, "", "", None, "allow") in got
    assert (3, "org", "/", "org/", "allow") in got
    assert (4, "a.example.org", "/es/1", "example.org/es/", "block") in got
    words = next(r["host_words"] for r in url_filter.filter_urls(pages).collect() if r["host"].startswith("casino"))
    assert words[:2] == ["casino", "bets"]
    assert url_filter.filter_urls(pages.limit(0)).isEmpty()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).isEmpty()


def test_pipeline_on_odd_rows(spark, docs, none):
    for table in (docs.select("doc_id", "text", "lang", "source", "n_chars"), none):
        out = table
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, "")
        assert out.where("not round_trip").isEmpty()


def test_line_edits_by_definition(spark):
    """Lines of few different words, where one edit can be read in several places."""
    draw = random.Random(7)
    rows = [(i, " ".join(draw.choice("ab") for _ in range(draw.randint(5, 12)))) for i in range(120)]

    def near(x, y):
        if len(x) < len(y):
            x, y = y, x
        if len(x) == len(y):
            return sum(p != q for p, q in zip(x, y, strict=True)) <= 1
        return len(x) == len(y) + 1 and any(x[:p] + x[p + 1:] == y for p in range(len(x)))

    words = [t.split() for _, t in rows]
    want = {i for i in range(len(rows)) if any(near(words[i], words[j]) for j in range(i))}
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), count_as="gone")
    assert {r["doc_id"] for r in out.collect() if r["gone"]} == want
    assert 0 < len(want) < len(rows)


def test_toxicity_scores_are_the_noisy_or_of_their_sentences():
    bad, clean = "You are a rotten vuggle. ", "The mill stood by the river. "
    texts = [(clean * (i % 5 + 1)).encode() for i in range(40)] + [
        (clean * (i % 4) + bad + clean).encode() for i in range(40)]
    w = toxicity.fit(texts, [0] * 40 + [1] * 40)

    def alone(part: bytes) -> float:
        return float(toxicity.score_chunk(next(chunks(pa.array([part], pa.large_binary()), fold=True)), w)[0][0])

    bias = w[-1]
    for text in {*texts, b"", b"a vuggle. a vuggle! the\nmill"}:
        none = 1.0
        for part in text.replace(b"!", b".").replace(b"\n", b".").split(b"."):
            words = part.split()
            if words:
                # the words of a sentence add up, each taken from a sentence of its own
                odds = sum(math.log(p / (1 - p)) - bias for p in map(alone, words)) + bias
                none *= 1 - 1 / (1 + math.exp(-odds))
        assert alone(text) == pytest.approx(1 - none, abs=1e-6)


def test_toxicity_fits_on_one_row_an_id(spark):
    docs = spark.createDataFrame(
        [(i, f"quiet mill {i}") for i in range(12)] + [(3, "other text")] * 50 + [(3, None), (None, "x")],
        "doc_id bigint, text string")
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(12)] + [(4, 1), (None, 1)], "doc_id bigint, toxic int")
    rows = [tuple(r)[:2] for r in toxicity.fit_rows(docs, labels).collect()]
    learnt = [i for i in range(12) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(rows) == sorted([(i, i % 2) for i in learnt] + ([(4, 1)] if 4 in learnt else []))
    some = toxicity.fit_rows(docs, labels, limit=2)
    assert some.groupBy("toxic").count().where("count > 2").isEmpty()
    texts = sorted((r["doc_id"], r["toxic"], bytes(r["text"])) for r in toxicity.fit_rows(docs, labels).collect())
    want = toxicity.fit([t for _, _, t in texts], [y for _, y, _ in texts])
    assert np.allclose(toxicity.train(docs, labels), want)
