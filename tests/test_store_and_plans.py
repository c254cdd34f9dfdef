import hashlib
import json

import pytest
from pyspark.sql import functions as F

from opinionmill import schema as S
from opinionmill.operators import scoring
from opinionmill.operators import taxonomy as tax
from opinionmill.plans import dashboard, extract
from opinionmill.sources import reviews as rv
from opinionmill.sources import store as st
from opinionmill.streaming.live import score_stream

DICT = {"Pin": ("pin", "sạc nhanh"), "Âm thanh": ("loa",)}
TEXTS = [
    "Pin tốt, loa xấu https://x.y/z", "pin xấu xấu tốt", None, "NaN", "<br>", "Sạc nhanh và pinn tốt",
    "không có gì", "loa loa xấu",
]


@pytest.fixture
def env(spark):
    taxonomy = tax.taxonomy_from_map(spark, DICT)
    models = extract.Models(
        heads=("pin", "pinn", "loa", "sạc", "máy"), tails=("nhanh",),
        positive=("tốt,", "tốt"), negative=("xấu",))
    return taxonomy, tax.blacklist_from_terms(spark), models


@pytest.fixture
def reviews(spark):
    return spark.createDataFrame(
        [(i, f"P{i % 2}", t, "") for i, t in enumerate(TEXTS)], S.REVIEWS)


def brief(df):
    return sorted(
        (r["ord"] >> S.MENTION_BITS, r["ord"] & 0xFFFFF, r["category"], r["aspect_raw"], r["polarity"])
        for r in df.collect())


WANT = [
    (0, 0, "Pin", "Pin", "pos"), (0, 1, "Âm thanh", "loa", "pos"),
    (1, 0, "Pin", "pin", "neg"), (5, 0, "Pin", "Sạc nhanh", "pos"), (5, 1, "Pin", "pinn", "pos"),
    (7, 0, "Âm thanh", "loa", "neg"), (7, 1, "Âm thanh", "loa", "neg"),
]


def test_extract(reviews, env):
    out = extract.extract_opinions(reviews, *env)
    assert [f.name for f in out.schema] == [f.name for f in S.OPINIONS]
    assert brief(out) == WANT
    # the stored text is the raw one
    assert out.where("ord = 0").first()["review_text"] == TEXTS[0]


def test_extract_with_python_models(reviews, env):
    taxonomy, blacklist, m = env
    models = extract.Models(
        tagger=scoring.dictionary_tagger(list(m.heads), list(m.tails)),
        scorer=scoring.lexicon_scorer(list(m.positive), list(m.negative)))
    assert brief(extract.extract_opinions(reviews, taxonomy, blacklist, models)) == WANT


@pytest.mark.parametrize("fuzzy", [False, True])
def test_only_pairs_are_scored(spark, env, monkeypatch, fuzzy):
    """Mentions without a category reach ``build_pairs``; what it drops is never labelled."""
    given = {}

    def watched(name):
        step = getattr(extract, name)

        def run(df, *more):
            given[name] = df
            return step(df, *more)

        monkeypatch.setattr(extract, name, run)

    watched("build_pairs")
    watched("score_mentions")
    df = spark.createDataFrame([(0, "P", "sạc xấu loa máy tốt xấu", ""), (1, "P", "sạc", "")], S.REVIEWS)
    assert brief(extract.extract_opinions(df, *env, fuzzy=fuzzy)) == [(0, 1, "Âm thanh", "loa", "neg")]
    found = sorted((r["ord"] >> 20, r["term"], r["category"]) for r in given["build_pairs"].collect())
    assert found == [(0, "loa", "Âm thanh"), (0, "sạc", None), (1, "sạc", None)]
    pairs = given["score_mentions"]
    assert [(r["sentence"], r["term"], tuple(r["hits"])) for r in pairs.collect()] == [
        ("sạc xấu loa máy tốt xấu", "loa", (1, 2))]
    assert "label" not in pairs.columns


def test_each_stage_of_extraction_counts(spark, monkeypatch):
    """There are rows for which leaving any one stage out changes the opinions."""
    taxonomy = tax.taxonomy_from_map(spark, {"Âm thanh": ("loa",), "Trầm": ("bass",)})
    blacklist = tax.blacklist_from_terms(spark, ("loa cũ",))
    models = extract.Models(
        heads=("loa", "sạc"), tails=("cũ", "5", "bass"), positive=("tốt",), negative=("xấu",))
    texts = ["<b>loa</b> tốt", "Loa cũ", "loa 5 bass", "sạc Loa xấu", "loa https://x.y/ xấu", "NaN"]
    df = spark.createDataFrame([(i, "P", t, "") for i, t in enumerate(texts)], S.REVIEWS)

    def found():
        rows = extract.extract_opinions(df, taxonomy, blacklist, models, fuzzy=False).collect()
        return {(r["ord"] >> 20, r["ord"] & 0xFFFFF, r["category"], r["aspect_raw"], r["polarity"]) for r in rows}

    whole = [
        (0, 0, "Âm thanh", "loa", "pos"), (2, 0, "Âm thanh", "loa 5 bass", "pos"),
        (3, 1, "Âm thanh", "Loa", "neg"), (4, 0, "Âm thanh", "loa", "neg")]
    assert sorted(found()) == whole

    def same(x, *_):
        return x

    for at, stage, left_out in (
        (extract, "clean_reviews", lambda r: r.withColumn("clean", F.col("text"))),
        (extract.tx, "strip_spec_tail", same), (extract.tx, "canonical_aspect", same),
        (tax, "drop_generic", same), (extract, "build_pairs", same),
        (extract, "score_mentions", lambda p, _: p.withColumn("polarity", F.lit(S.POS))),
    ):
        with monkeypatch.context() as patch:
            patch.setattr(at, stage, left_out)
            assert found() != set(whole), stage


def test_extract_with_segmenter(spark, env):
    taxonomy, blacklist, m = env
    seen = spark.createDataFrame(
        [(0, "P", "Loa Ngoài xấu"), (1, "P", None), (2, "P", "  "), (3, "P", "loa")],
        "ord bigint, product string, text string").withColumn("time_text", F.lit(""))
    models = extract.Models(
        heads=("loa_ngoài", "loa"), tails=(), positive=("tốt",), negative=("xấu",),
        segmenter=scoring.phrase_segmenter(["loa ngoài", "ngoài xấu"]))
    found = extract.tag_mentions(rv.clean_reviews(seen), models)
    got = [tuple(r) for r in found.orderBy("ord").select("sentence", "aspect_raw", "term").collect()]
    assert got == [("Loa_Ngoài xấu", "Loa Ngoài", "Loa_Ngoài"), ("loa", "loa", "loa")]
    out = extract.extract_opinions(seen, taxonomy, blacklist, models)
    got = [tuple(r) for r in out.orderBy("ord").select("category", "aspect_raw", "polarity").collect()]
    assert got == [("Âm thanh", "Loa Ngoài", "neg"), ("Âm thanh", "loa", "pos")]
    # an empty table, and columns of other names, pass
    assert scoring.segment_words(seen.limit(0), models.segmenter, text="text").isEmpty()
    assert scoring.segment_words(seen, models.segmenter, text="text").where(
        "ord = 1 and text is null").count() == 1


def test_score_one(spark, env):
    got = [tuple(r) for r in extract.score_one(spark, " loa xấu ", *env).collect()]
    assert got == [("Âm thanh", "loa", "neg")]
    for nothing in (None, "  ", 3):
        assert extract.score_one(spark, nothing, *env).collect() == []


def test_models_from_taxonomy(spark):
    rows = tax.taxonomy_from_map(spark, DICT).collect()
    m = extract.models_from_taxonomy(rows)
    assert m.heads == ("loa", "pin", "sạc") and m.tails == ("nhanh",)


def test_stream_equals_batch(spark, tmp_path, reviews, env):
    whole = reviews.repartition(3)
    whole.write.parquet(str(tmp_path / "in"))
    store = st.OpinionStore(spark, str(tmp_path / "store"))
    stream = (
        spark.readStream.schema(S.REVIEWS).option("maxFilesPerTrigger", 1)
        .parquet(str(tmp_path / "in")))
    def run():
        score_stream(stream, *env, store, str(tmp_path / "progress")).awaitTermination()
    run()
    assert brief(store.all()) == WANT
    run()  # nothing new: nothing stored twice
    assert brief(store.all()) == WANT


def test_csv_values(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.csv").write_text('text,name\n"line\nbreak, ""q""",x\nNA,\n', encoding="utf-8")
    (tmp_path / "in" / "a ă.csv").write_text("text,name\n007,N/A\nkết nối,y\n", encoding="utf-8")
    df = rv.read_reviews(spark, str(tmp_path / "in"))
    got = [tuple(r) for r in df.orderBy("ord").select("text", "name").collect()]
    assert got == [("007", None), ("kết nối", "y"), ('line\nbreak, "q"', "x"), (None, None)]
    assert df.select("ord").distinct().count() == 4
    one = rv.read_reviews(spark, str(tmp_path / "in" / "b.csv"))
    assert [r["ord"] for r in one.orderBy("ord").collect()] == [0, 1]
    clean = rv.dedupe_rows(rv.drop_empty_rows(df))
    assert clean.count() == 3
    assert tuple(rv.load_report(df).first()) == (4, 3)


def test_parquet_and_json_positions(spark, tmp_path):
    data = spark.range(1000).select(F.col("id").alias("n")).repartition(4)
    data.write.parquet(str(tmp_path / "p"))
    data.write.json(str(tmp_path / "j"))
    for fmt, path in (("parquet", "p"), ("json", "j")):
        df = rv.read_reviews(spark, str(tmp_path / path), fmt)
        assert df.select("ord").distinct().count() == 1000
        assert df.agg(F.max("ord")).first()[0] < 1 << S.REVIEW_ORD_BITS
        assert df.schema["n"].dataType.simpleString() == "string"


def test_dedupe_keeps_first(spark):
    df = spark.createDataFrame(
        [("a", None, 5), ("a", None, 2), (None, None, 1), ("b", "x", 3)], "t string, u string, ord long")
    got = sorted(tuple(r) for r in rv.dedupe_rows(rv.drop_empty_rows(df)).collect())
    assert got == [("a", None, 2), ("b", "x", 3)]


def test_bind_roles(spark):
    df = spark.createDataFrame([(0, "t", None, None)], "ord long, `my text` string, p string, d string")
    got = rv.bind_roles(df, rv.Roles("my text", "p", "d")).first()
    assert tuple(got) == (0, "Sản phẩm chưa rõ", "t", "")[:1] + ("Sản phẩm chưa rõ", "t", "")
    assert rv.bind_roles(df, rv.Roles("my text")).first()["product"] == "Sản phẩm chung"


def test_content_key(spark, tmp_path):
    body = "text\nxin chào\n".encode()
    (tmp_path / "f.csv").write_bytes(body)
    got = st.content_key(spark, str(tmp_path / "f.csv"), rv.Roles("text", "sp")).first()
    want = hashlib.md5(body + b"text" + b"sp" + "(Không có cột Ngày tháng)".encode()).hexdigest()
    assert got["cache_key"] == want


def test_table_key_sees_order_and_content(spark):
    def key(rows, parts=1):
        df = spark.createDataFrame(rows, "src string, ord long, text string").repartition(parts)
        return {r["src"]: r["cache_key"] for r in st.table_key(df, "src", rv.Roles("text")).collect()}

    base = [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x")]
    assert key(base) == key(base, 5)
    assert key(base)["a"] != key([("a", 0, "y"), ("a", 1, "x"), ("b", 0, "x")])["a"]
    assert key(base)["b"] != key([("b", 0, "x2")])["b"]

    def with_product(product):
        df = spark.createDataFrame(
            [("a", 0, "x", product)], "src string, ord long, text string, sp string")
        return st.table_key(df, "src", rv.Roles("text", "sp")).first()["cache_key"]

    assert len({with_product(p) for p in ("p", "q", "", None)}) == 4


def upload(spark, batch, key):
    return spark.createDataFrame(
        [(batch, f"{key}.csv", 3, key)], "batch long, name string, rows int, hash string"
    ).withColumn("ts", F.lit("2026-02-03 04:05:06").cast("timestamp"))


def test_store_round_trip(spark, tmp_path, make_opinions, env):
    taxonomy = env[0]
    store = st.OpinionStore(spark, str(tmp_path / "store"))
    assert store.history().count() == 0
    good = make_opinions([("A", "t", "Pin", "pos"), ("A", "u", "Âm thanh", "neg")])
    store.write(good, "k1")
    store.write(good.limit(1), "k2")
    store.write(make_opinions([("A", "t", "unknown", "pos")]), "old")
    for key in ("k1", "k2"):
        store.append_history(upload(spark, 0, key))
    assert store.read("k1").count() == 2
    assert store.latest().count() == 1
    assert store.load("k1", taxonomy).count() == 2
    assert store.latest().count() == 2  # reopening makes it the latest
    view = store_view(store)
    assert view[0][:2] == (3, "k1.csv") and view[-1][:3] == (1, "k1.csv", "03/02/2026 04:05")
    for bad in ("old", "missing", "../k1"):
        with pytest.raises(ValueError):
            store.load(bad, taxonomy)
    with pytest.raises(ValueError):
        store.write(good, "../x")
    store.write(good.limit(1), "k1")  # replaces only its own partition
    assert (store.read("k1").count(), store.read("k2").count()) == (1, 1)
    assert store.purge_stale(taxonomy) == ["old"]
    assert store.all().count() == 2 and store.stale_keys(taxonomy).count() == 0


def store_view(store):
    return [tuple(r) for r in st.history_view(store.history()).collect()]


def test_history_view_keys(spark):
    df = spark.createDataFrame(
        [(1, "a", "d", 1, "<ab-1_>"), (2, "b", "d", 2, None)], S.HISTORY)
    got = [(r["seq"], r["key"], r["can_open"]) for r in st.history_view(df).collect()]
    assert got == [(2, "", False), (1, "ab-1_", True)]


def test_skip_processed(spark):
    batch = upload(spark, 0, "new").unionByName(upload(spark, 1, "old"))
    history = spark.createDataFrame([(1, "x", "d", 1, "old"), (2, "y", "d", 1, "old")], S.HISTORY)
    got = {r["hash"]: r["status"] for r in st.skip_processed(batch, history).collect()}
    assert got == {"new": "new", "old": "cached"}


def test_dashboard(spark, tmp_path, make_opinions):
    ops = make_opinions([
        ("A", "t1", "Pin", "pos", "2 ngày trước"), ("B", "t2", "Loa", "neg", ""), ("A", 'q"', "Pin", "neg")])
    sections = dashboard.dashboard_sections(ops)
    doc = json.loads(dashboard.dashboard_document(sections).first()["document"])
    assert set(doc) == set(dashboard.BOUNDED)

    def section(name):
        rows = sections.where(F.col("section") == name).orderBy("place", "key").collect()
        return [json.loads(r["json"]) for r in rows]

    assert doc["metrics"][0]["total"] == 3 and doc["metrics"][0]["top_aspect"] == "Pin"
    assert [x["product"] for x in section("products")] == ["A", "B"]
    assert [x["category"] for x in doc["heatmap_columns"]] == ["Pin", "Loa"]
    assert section("heatmap")[0]["aspects"]["Pin"] == {"pos_pct": 50, "neg_pct": 50}
    feed = section("feed")
    assert [x["text"] for x in feed] == ['q"', "t1", "t2"]
    assert feed[1]["tags"] == [{"aspect": "Pin", "polarity": "pos"}]
    found = ops.limit(1).select("category", "aspect_raw", "polarity")
    live = dashboard.dashboard_sections(ops, live=("pin tốt", found)).where("section like 'live%'")
    got = {r["section"]: json.loads(r["json"]) for r in live.collect()}
    assert got["live_text"] == {"text": "pin tốt"} and got["live"]["category"] == found.first()[0]
    nothing = dashboard.dashboard_sections(ops, live=("x", found.limit(0))).where("section like 'live%'")
    assert [r["section"] for r in nothing.collect()] == ["live_text"]
    dashboard.export_dashboard(ops, str(tmp_path / "out"))
    feed = spark.read.json(str(tmp_path / "out" / "section=feed"))
    assert feed.count() == 3


def test_empty_store_and_unledgered_load(spark, make_opinions, tmp_path):
    store = st.OpinionStore(spark, str(tmp_path / "fresh"))
    taxonomy = spark.createDataFrame([("Pin", "pin", 0)], "category string, keyword string, kw_ord int")
    assert store.latest().isEmpty()
    with pytest.raises(ValueError):
        store.load("k1", taxonomy)
    store.write(make_opinions([("p", "t", "Pin", "pos")]), "k1")
    assert store.load("k1", taxonomy).count() == 1
    assert store.latest().count() == 1
    with pytest.raises(Exception, match="cache key"):
        store.write(make_opinions([("p", "t", "Pin", "pos")]).withColumn("cache_key", F.lit("a:b=c")))
