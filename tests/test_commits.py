"""The store's commit log: concurrent writers, replacement, removal and reuse."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from opinionmill import schema as S
from opinionmill.operators import metrics
from opinionmill.operators import taxonomy as tax
from opinionmill.plans import extract
from opinionmill.plans.uploads import analyse_upload
from opinionmill.sources import commits
from opinionmill.sources import reviews as rv
from opinionmill.sources import store as st
from opinionmill.sources.memo import TermMemo
from opinionmill.streaming.live import score_uploads


def upload(spark, *keys):
    return spark.createDataFrame(
        [(i, f"{k}.csv", 3, k) for i, k in enumerate(keys)], "batch long, name string, rows int, hash string"
    ).withColumn("ts", F.lit("2026-02-03 04:05:06").cast("timestamp"))


def at_once(jobs):
    errors = []

    def run(job):
        try:
            job()
        except Exception as err:
            errors.append(err)

    threads = [threading.Thread(target=run, args=(j,)) for j in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors


def test_writers_at_once(spark, tmp_path, make_opinions):
    store = st.OpinionStore(spark, str(tmp_path))
    ops = make_opinions([("A", "t", "Pin", "pos")] * 3)
    ledger = [lambda k=k: store.append_history(upload(spark, f"{k}a", f"{k}b")) for k in range(4)]
    tables = [lambda n=n: store.write(ops.limit(n), "same") for n in (1, 2, 3)]
    at_once([*ledger, *tables])
    rows = store.history().collect()
    assert sorted(r["seq"] for r in rows) == list(range(1, 9))
    by_seq = [r["hash"] for r in sorted(rows, key=lambda r: r["seq"])]
    assert all(a[0] == b[0] and a[1] + b[1] == "ab" for a, b in zip(by_seq[::2], by_seq[1::2], strict=True))
    log = store.log.entries().orderBy("seq").collect()
    assert [r["seq"] for r in log] == list(range(1, 8)) and len({r["commit"] for r in log}) == 7
    last = [r["commit"] for r in log if r["kind"] == "write"][-1]
    kept = spark.read.parquet(f"{store.opinions_path}/commit={last}").count()
    assert store.read("same").count() == store.all().count() == kept


def test_a_taken_number_is_not_overwritten(spark, tmp_path):
    log = commits.CommitLog(spark, f"file://{tmp_path}/a b")
    assert log._put("1.json", "first") and not log._put("1.json", "second")
    assert (tmp_path / "a b" / "1.json").read_text() == "first" and len(os.listdir(tmp_path / "a b")) == 1


def test_a_taken_number_in_another_file_system(spark, tmp_path, monkeypatch):
    """The way through Hadoop's file systems."""
    monkeypatch.setattr(commits.CommitLog, "_local", lambda self, path: None)
    log = commits.CommitLog(spark, str(tmp_path / "log"))
    assert log.append("x", "write", 0) == 1 and log.append("y", "history", 2) == 2
    assert not log._put(f"{1:020d}.json", "other")
    assert [(r["seq"], r["commit"], r["before"]) for r in log.entries().orderBy("seq").collect()] == [
        (1, "x", 0), (2, "y", 0)]


def test_half_a_write_is_not_seen(spark, tmp_path, make_opinions, monkeypatch):
    store = st.OpinionStore(spark, str(tmp_path))
    store.write(make_opinions([("A", "old", "Pin", "pos")]), "k")
    before = store.read("k")
    with monkeypatch.context() as m:
        m.setattr(commits.CommitLog, "append", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.write(make_opinions([("A", "new", "Pin", "pos")] * 2), "k")
    assert [r["review_text"] for r in store.read("k").collect()] == ["old"]
    assert [r["review_text"] for r in store.all().collect()] == ["old"]
    store.write(make_opinions([("A", "new", "Pin", "pos")] * 2), "k")
    assert before.count() == 1  # a reader goes on with what it saw
    assert store.all().count() == 2


def test_empty_write_replaces(spark, tmp_path, make_opinions):
    store = st.OpinionStore(spark, str(tmp_path))
    ops = make_opinions([("A", "t", "Pin", "pos")])
    store.write(ops, "k")
    store.write(ops, "other")
    store.write(ops.limit(0), "k")
    assert store.read("k").isEmpty() and store.holds("k") and store.all().count() == 1
    store.write(ops.limit(0).withColumn("cache_key", F.lit("k")))  # names no key
    assert store.all().count() == 1
    assert {(r["cache_key"], r["rows"]) for r in store.keys().collect()} == {("k", 0), ("other", 1)}


def test_removal_and_vacuum(spark, tmp_path, make_opinions):
    store = st.OpinionStore(spark, str(tmp_path))
    taxonomy = tax.taxonomy_from_map(spark, {"Pin": ("pin",)})
    for key, category in (("a", "Pin"), ("b", "gone"), ("a", "Pin"), ("c", "gone")):
        store.write(make_opinions([("A", "t", category, "pos")]), key)
    assert sorted(store.purge_stale(taxonomy)) == ["b", "c"] and store.purge_stale(taxonomy) == []
    assert not store.holds("b") and store.read("b").isEmpty()
    assert store.vacuum() == 3
    assert store.all().count() == 1 and len(os.listdir(tmp_path / "opinions")) == 1
    store.write(make_opinions([("A", "t", "Pin", "pos")]), "b")
    assert store.read("b").count() == 1


def test_latest_is_forgotten_until_the_next_entry(spark, tmp_path, make_opinions):
    store = st.OpinionStore(spark, str(tmp_path))
    taxonomy = tax.taxonomy_from_map(spark, {"Pin": ("pin",)})
    store.write(make_opinions([("A", "t", "Pin", "pos")]), "k")
    store.append_history(upload(spark, "k"))
    assert store.latest().count() == 1
    store.forget_latest()
    assert store.latest().isEmpty() and store.history().count() == 1
    store.load("k", taxonomy)
    assert store.latest().count() == 1
    assert [r["seq"] for r in store.history().orderBy("seq").collect()] == [1, 2]


def test_upload_is_analysed_once(spark, tmp_path):
    taxonomy = tax.taxonomy_from_map(spark, {"Pin": ("pin",)})
    blacklist = tax.blacklist_from_terms(spark)
    models = extract.Models(heads=("pin", "loa"), positive=("tốt",), negative=("xấu",))
    store = st.OpinionStore(spark, str(tmp_path / "store"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_text(
        'comment,product\n"pin\ntốt",A\n"pin\ntốt",A\nloa,B\n,\npin xấu,\n', encoding="utf-8")

    def run(roles=rv.Roles("comment", "product"), dictionary=taxonomy):
        return analyse_upload(spark, str(tmp_path / "in" / "x.csv"), roles, dictionary, blacklist, models, store)

    first, again = run(), run()
    assert (first.reused, again.reused) == (False, True) and first.cache_key == again.cache_key
    got = sorted((r["product"], r["review_text"], r["polarity"]) for r in again.opinions.collect())
    assert got == [("A", "pin\ntốt", "pos"), (S.UNKNOWN_PRODUCT, "pin xấu", "neg")]
    assert [(r["name"], r["rows"]) for r in store.history().orderBy("seq").collect()] == [("x.csv", 3)] * 2
    other = run(rv.Roles("comment"))  # other columns: another input
    assert not other.reused and other.cache_key != first.cache_key
    wider = tax.taxonomy_from_map(spark, {"Akku": ("pin",)})
    changed = run(dictionary=wider)  # its categories are gone: done anew
    assert not changed.reused and {r["category"] for r in changed.opinions.collect()} == {"Akku"}
    (tmp_path / "in" / "x.csv").write_text("comment,product\npin,A\n", encoding="utf-8")
    assert not run().reused


def test_file_key_of_ranges(spark, tmp_path):
    """The key does not depend on how a file is cut, only on its lines and the roles."""
    body = "".join(f"dòng {i},\"x\n{i % 7}\"\n" for i in range(300))
    (tmp_path / "a").write_text(body, encoding="utf-8")

    def key(roles=rv.Roles("t")):
        return st.file_key(spark, str(tmp_path / "a"), roles).first()["cache_key"]

    whole = key()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        assert key() == whole and key(rv.Roles("t", "p")) != whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    table = spark.createDataFrame(
        [("f", i, x) for i, x in enumerate(body.split("\n")[:-1])], "path string, ord bigint, value string")
    assert st.table_key(table, "path", rv.Roles("t")).first()["cache_key"] == whole
    (tmp_path / "a").write_text(body.replace("dòng 5,", "dòng 5;"), encoding="utf-8")
    assert key() != whole


def test_terms_are_matched_once(spark, tmp_path, monkeypatch):
    memo = TermMemo(spark, str(tmp_path))
    taxonomy = tax.taxonomy_from_map(spark, {"Camera": ("camera",), "Pin": ("sạc nhanh",)})
    asked = []

    def watched(terms, *args):
        asked.append(sorted(r["s"] for r in terms.collect()))
        return tax.fuzzy_match(terms, *args)

    monkeypatch.setattr("opinionmill.sources.memo.fuzzy_match", watched)

    def run(*values, dictionary=taxonomy, cutoff=S.FUZZY_CUTOFF):
        terms = spark.createDataFrame([(v,) for v in values], "s string")
        return {r["s"]: r["category"] for r in memo.categories(terms, dictionary, cutoff).collect()}

    assert run("camerra", "zzz", None) == {"camerra": "Camera"}
    assert run("camerra", "zzz", "sạc nhnh", "zzz") == {"camerra": "Camera", "sạc nhnh": "Pin"}
    assert asked == [["camerra", "zzz"], ["sạc nhnh"]]
    assert run("camerra", "zzz") == {"camerra": "Camera"} and len(asked) == 2
    other = tax.taxonomy_from_map(spark, {"Lens": ("camera",)})
    assert run("camerra", dictionary=other) == {"camerra": "Lens"}
    assert run("camerra", cutoff=0.99) == {} and len(asked) == 4


def test_stream_skips_what_a_batch_has_stored(spark, tmp_path):
    taxonomy, blacklist = tax.taxonomy_from_map(spark, {"Pin": ("pin",)}), tax.blacklist_from_terms(spark)
    models = extract.Models(heads=("pin",), positive=("tốt",), negative=("xấu",))
    store = st.OpinionStore(spark, str(tmp_path / "store"))
    (tmp_path / "in").mkdir()
    for name, text in (("a", "pin tốt"), ("b", "pin xấu"), ("copy of a", "pin tốt")):
        (tmp_path / "in" / f"{name}.csv").write_text(f"comment\n{text}\n", encoding="utf-8")
    args = (rv.Roles("comment"), taxonomy, blacklist, models, store)

    def stream():
        score_uploads(spark, str(tmp_path / "in"), *args, str(tmp_path / "progress")).awaitTermination()
        return sorted((r["name"]) for r in store.history().collect())

    analyse_upload(spark, str(tmp_path / "in" / "a.csv"), *args)
    assert stream() == ["a.csv", "b.csv"]
    assert sorted(r["review_text"] for r in store.all().collect()) == ["pin tốt", "pin xấu"]
    (tmp_path / "in" / "c.csv").write_text("comment\npin tốt tốt\n", encoding="utf-8")
    (tmp_path / "in" / "d.csv").write_text("comment\npin xấu\n", encoding="utf-8")
    assert stream() == ["a.csv", "b.csv", "c.csv"]
    assert analyse_upload(spark, str(tmp_path / "in" / "d.csv"), *args).reused


def test_cube_follows_the_tables(spark, tmp_path, make_opinions):
    """The merged counts always equal those of the opinions that stand."""
    store = st.OpinionStore(spark, str(tmp_path))
    taxonomy = tax.taxonomy_from_map(spark, {"Pin": ("pin",), "Loa": ("loa",)})
    a = make_opinions([("A", "t", "Pin", "pos"), ("A", "u", "Pin", "neg"), ("B", "t", "Loa", "pos"), (None, "t", None, "neu")])
    b = make_opinions([("A", "t", "Pin", "neg"), ("C", "t", "other", "pos")])

    def same():
        rows = [sorted(map(str, df.collect())) for df in (
            store.cube(), metrics.opinion_cube(store.all()), metrics.kpi_metrics(store.cube()),
            metrics.kpi_metrics(store.all()))]
        assert rows[0] == rows[1] and rows[2] == rows[3]
        return len(rows[0])

    assert same() == 0
    store.write(a, "a")
    assert same() == 3
    store.write(b, "b")
    assert same() == 4
    store.purge_stale(taxonomy)
    assert same() == 3
    store.write(a.limit(1), "a")
    assert same() == 1
    store.write(a.limit(0), "a")
    assert same() == 0


def test_files_of_a_batch_are_analysed_together(spark, tmp_path, monkeypatch):
    """One extraction for all files with the same columns, each stored as on its own."""
    taxonomy, blacklist = tax.taxonomy_from_map(spark, {"Pin": ("pin",)}), tax.blacklist_from_terms(spark)
    models = extract.Models(heads=("pin",), positive=("tốt",), negative=("xấu",))
    (tmp_path / "in").mkdir()
    texts = {
        "a%41 b": 'comment,product\n"pin\ntốt",A\n"pin\ntốt",A\n,\npin xấu,B\n', "b": "comment,product\npin xấu,B\n",
        "c": "comment,product\n", "d": "product,comment,n\nA,pin tốt,\nA,pin tốt,7\n", "e": "comment,product\nloa,C\n"}
    for name, text in texts.items():
        (tmp_path / "in" / f"{name}.csv").write_text(text, encoding="utf-8")
    args = (rv.Roles("comment", "product"), taxonomy, blacklist, models)
    calls = []

    def watched(*a, **k):
        calls.append(1)
        return extract.extract_opinions(*a, **k)

    monkeypatch.setattr("opinionmill.plans.uploads.extract_opinions", watched)
    store = st.OpinionStore(spark, str(tmp_path / "store"))
    score_uploads(spark, str(tmp_path / "in"), *args, store, str(tmp_path / "progress")).awaitTermination()
    assert len(calls) == 2  # two kinds of header
    alone = st.OpinionStore(spark, str(tmp_path / "alone"))
    for name in ("b", "c", "d", "e"):
        analyse_upload(spark, str(tmp_path / "in" / f"{name}.csv"), *args, alone)
    got, want = ([tuple(r) for r in s.all().orderBy("cache_key", "ord").collect()] for s in (store, alone))
    assert set(want) <= set(got) and len(got) == len(want) + 2 == 5
    ledger = [(r["seq"], r["name"], r["rows"]) for r in store.history().orderBy("seq").collect()]
    assert ledger == [(1, "a%41 b.csv", 2), (2, "b.csv", 1), (3, "c.csv", 0), (4, "d.csv", 2), (5, "e.csv", 1)]
    assert {r["cache_key"]: r["rows"] for r in alone.keys().collect()}.items() <= {
        r["cache_key"]: r["rows"] for r in store.keys().collect()}.items()


def test_rows_of_a_file_need_one_reading(spark, tmp_path):
    """Offsets and files are settled; what uses the rows reads the file once more."""
    (tmp_path / "x.csv").write_text("comment\n" + "pin\n" * 50, encoding="utf-8")
    rows = rv.read_reviews(spark, str(tmp_path / "x.csv"))
    plan = rows.where("comment = 'pin'")._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count() == 50 and 1 <= plan.count("] text") <= 2  # whole lines, and pieces


def test_memo_takes_its_terms_once(spark, tmp_path):
    """What is returned comes from the terms as written, not from the input again."""
    (tmp_path / "terms").write_text("camerra\nzzz\n", encoding="utf-8")
    terms = spark.read.text(str(tmp_path / "terms")).withColumnRenamed("value", "s")
    got = TermMemo(spark, str(tmp_path / "memo")).categories(
        terms, tax.taxonomy_from_map(spark, {"Camera": ("camera",)}))
    assert [tuple(r) for r in got.collect()] == [("camerra", "Camera")]
    assert got.inputFiles() and not any(f.endswith("/terms") for f in got.inputFiles())
