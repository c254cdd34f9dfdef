"""The llm queries and pipeline stages against SQL or brute force on small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from opinionmill.llm import line_dedup, mixing, near_dups, pieces, quality_rules, queries, repeats, url_filter
from opinionmill.llm.tables import written
from tools.check import TABLES, canon

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def same(df, rel):
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(rel.fetchall(), cols)


def test_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_with_sql(spark, con, name):
    same(queries.QUERIES[name](spark, SF), con.execute(queries.ORACLE[name]))


def test_search_with_repeated_and_missing_ids(spark, tmp_path):
    texts = ["mill river stone", "mill mill pond", "river river reed stone", "pond reed", "", None, "Mill stone Mill"]
    ids = [50, 50, 1, None, 2, 100, 50, None, 3]
    rows = [(ids[i % 9], texts[i % 7]) for i in range(63)] + [(50, "mill river stone")] * 2 + [(None, "mill")] * 3
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(
        str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    same(queries.QUERIES["op2_topk_search"](spark, str(tmp_path)), c.execute(queries.ORACLE["op2_topk_search"]))


def test_repeats_by_definition(spark, con, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_BYTES", 100_000)
    rows = [(a, (b or "").encode()) for a, b in con.execute("select doc_id, text from documents").fetchall()]
    got = {tuple(r) for r in queries.QUERIES["op3_repeats"](spark, SF).collect()}
    assert got == set(repeats.brute_force(rows))


def test_url_rules(spark, con):
    rows = {r["page_id"]: r for r in queries.QUERIES["op1_url_filter"](spark, SF).collect()}
    for page_id, url in con.execute("select page_id, url from pages").fetchall():
        host, path = url_filter.parts(url)
        fits = [r for r in url_filter.RULES if path.startswith("/" + r.partition("/")[2]) and (
            host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0]))]
        r = rows[page_id]
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (max(fits, key=len) if fits else None)
        if fits:
            assert r["verdict"] == url_filter.RULES[r["rule"]]
        elif "casino" in host or "pills" in host:
            assert r["verdict"] == "block"


def test_pieces_by_scalar_walk(spark, con):
    auto = pieces.automaton_of(pieces.load_vocabulary())
    import numpy as np
    texts = dict(con.execute("select doc_id, text from documents").fetchall())
    for r in queries.QUERIES["op6_pieces"](spark, SF).collect():
        assert r["round_trip"]
        data = np.frombuffer(b" " + texts[r["doc_id"]].encode(), np.uint8)
        _, best = auto.one(data)
        assert abs(best - r["score"]) < 1e-6 * max(1, abs(best))
        assert sum(len(auto.vocabulary.pieces[i]) for i in r["ids"]) == len(data)


def test_pseudo_likelihood_beats_unigrams(spark):
    r = queries.QUERIES["op5_pseudo_likelihood"](spark, SF).selectExpr(
        "sum(log_prob) as a", "sum(unigram_log_prob) as b", "count(*) as n", "max(log_prob) as top").first()
    assert r["n"] == 200 and r["a"] > r["b"] and r["top"] <= 0


def test_toxicity_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.QUERIES["op10_toxicity"](spark, sf).where("held_out").join(labels, "doc_id")
    r = got.selectExpr("avg(if(predicted = toxic, 1, 0)) as right",
                       "avg(if(toxic = 1, predicted, null)) as caught").first()
    assert r["right"] > 0.9 and r["caught"] > 0.7


def test_pipeline_stages(spark, con):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = written(docs, "docs")

    def view(df, name):
        con.register("staged", df.toPandas())
        con.execute(f"create or replace table {name} as select * from staged")

    view(docs, "d0")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, written(stage(spark, docs, SF), f"s{k}")
        if name == "quality":
            want = con.execute(f"with {quality_rules.duck_judged('d0')} select doc_id from judged where kept")
            same(docs.select("doc_id"), want)
        elif name == "lines":
            want = con.execute(f"with {line_dedup.duck_lines('d1')} select doc_id, new_text as text, "
                               "length(new_text) as n_chars from line_deduped "
                               r"where not (n_removed > 0 and not regexp_matches(new_text, '[^ \t\n\x0B\f\r]'))")
            same(docs.select("doc_id", "text", "n_chars"), want)
        elif name == "near":
            assert {r[0] for r in docs.select("doc_id").collect()} == brute_kept(before.collect(), 5)
        elif name == "mix":
            want = con.execute(f"with recursive {mixing.duck_mix('d3')} "
                               "select doc_id, text from mixed, unnest(range(copies)) where copies > 0")
            same(docs.select("doc_id", "text"), want)
        else:
            assert docs.count() == before.count() and docs.where("not round_trip").isEmpty()
        if name != "encode":
            assert docs.columns == before.columns
            view(docs, f"d{k + 1}")


def brute_kept(rows, width, percent=80):
    sets = {}
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                a_, b_ = root(a), root(b)
                parent[max(a_, b_)] = min(a_, b_)
    return {i for i in ids if root(i) == i}


def test_large_near_group(spark, monkeypatch):
    """Many edited copies of one text: chains beyond the band's first member."""
    import random
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"] for r in near_dups.drop_near_dups(docs, width=4).collect()}
    assert got == brute_kept(docs.collect(), 4)
