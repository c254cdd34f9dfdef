"""One query per operator, over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionmill import schema as S
from opinionmill.functions import text as tx
from opinionmill.functions import tokens as tk
from opinionmill.operators import feed as fd
from opinionmill.operators import metrics as m
from opinionmill.operators import products as p
from opinionmill.operators import scoring
from opinionmill.operators import taxonomy as tax
from opinionmill.operators import tokens as tok
from opinionmill.plans import dashboard, extract
from opinionmill.plans.scale import global_index, rank_rows, settle, shared_path
from opinionmill.plans.uploads import analyse_upload as analyse
from opinionmill.sources import reviews as rv
from opinionmill.sources import store as st
from opinionmill.sources.memo import TermMemo
from opinionmill.streaming.live import score_stream
from opinionmill.streaming.live import score_uploads as score_upload_stream
from workload import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DOC_ROLES = rv.Roles("text", "source", "lang")
SELECTION = fd.Slice(product="Brand#3", category="PROMO-0")
SEARCH = fd.Slice(query="2-HIGH")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def flat_tags(tags: Column) -> Column:
    return F.array_join(
        F.transform(tags, lambda t: F.concat(t["aspect"], F.lit(":"), t["polarity"])), "|")


def on_facts(fn: Callable[[DataFrame], DataFrame], drop: tuple[str, ...] = ()) -> Query:
    return lambda spark, sf: fn(fx.opinion_facts(spark, sf)).drop(*drop)


def on_feed(fn: Callable[[DataFrame], DataFrame], drop: tuple[str, ...] = ()) -> Query:
    return lambda spark, sf: fn(fd.review_feed(fx.opinions(spark, sf))).drop(*drop)


def on_text(fn: Callable[[Column], Column], view=fx.reviews) -> Query:
    return lambda spark, sf: view(spark, sf).select("ord", fn(F.col("text")).alias("out"))


# ---------------------------------------------------------------- sources, rows


@query
def read_reviews(spark, sf):
    """Documents read as text, numbered by their row in the file."""
    return (
        rv.read_reviews(spark, f"{sf}/documents.parquet", "parquet")
        .select("ord", "doc_id", "source", "n_chars", F.md5("text").alias("text_md5")))


def _as_csv(spark, sf) -> str:
    """The documents as CSV files whose names follow the ids."""
    path = shared_path(spark, "csv")
    (fx.table(spark, sf, "documents").orderBy("doc_id")
     .write.option("header", True).option("escape", '"').csv(path))
    return path


@query
def read_reviews_csv(spark, sf):
    """All columns of files in id order; their rows numbered throughout."""
    rows = rv.read_reviews(spark, _as_csv(spark, sf), "csv")
    return global_index(rows.withColumnRenamed("ord", "place"), ["place"], "ord").drop("place")


@query
def bind_roles(spark, sf):
    raw = rv.read_reviews(spark, f"{sf}/documents.parquet", "parquet")
    return rv.bind_roles(raw, rv.Roles("text", "source"))


@query
def bind_roles_defaults(spark, sf):
    raw = rv.read_reviews(spark, f"{sf}/documents.parquet", "parquet")
    return rv.bind_roles(raw, rv.Roles("text", None, "lang"))


def _gappy(spark, sf):
    """Orders with columns blanked and identities dropped, so rows repeat."""
    return fx.table(spark, sf, "orders").select(
        F.when(F.col("o_custkey") % 5 > 0, F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_custkey") % 5 > 1, F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_custkey") % 5 > 2, F.col("o_custkey") % 97).alias("cust"),
        F.col("o_orderkey").alias("ord"))


@query
def drop_empty_rows(spark, sf):
    return rv.drop_empty_rows(_gappy(spark, sf))


@query
def dedupe_rows(spark, sf):
    return rv.dedupe_rows(_gappy(spark, sf))


@query
def load_report(spark, sf):
    return rv.load_report(_gappy(spark, sf))


@query
def clean_reviews(spark, sf):
    return rv.clean_reviews(fx.reviews(spark, sf))


@query
def clean_html_reviews(spark, sf):
    return rv.clean_reviews(fx.html_reviews(spark, sf)).drop("text", "time_text")


@query
def parse_days_ago(spark, sf):
    return fx.opinion_facts(spark, sf).select(
        "ord", "time_text", tx.parse_days_ago(F.col("time_text")).alias("days_ago"))


@query
def polarity_code(spark, sf):
    shown = F.when(F.col("polarity") != S.NEU, tx.display_polarity(F.col("polarity")))
    return fx.opinion_facts(spark, sf).select(
        "ord", shown.alias("shown"), tx.polarity_code(shown).alias("code"))


QUERIES |= {
    "blank_missing": on_text(tx.blank_missing),
    "nfc_text": on_text(tx.normalize_nfc),
    "strip_urls": on_text(tx.strip_urls),
    "strip_html": on_text(tx.strip_html),
    "strip_html_pages": on_text(tx.strip_html, fx.html_reviews),
    "collapse_ws": on_text(tx.collapse_ws),
    "preprocess_text": on_text(tx.preprocess_text),
}


# ------------------------------------------------------------------------ tokens


@query
def split_words(spark, sf):
    return fx.words(spark, sf)


@query
def argmax_label(spark, sf):
    return tok.argmax_labels(fx.tokens(spark, sf)).drop("logits")


@query
def truncate_subwords(spark, sf):
    return tok.truncate_subwords(fx.tokens(spark, sf)).drop("logits")


@query
def first_subword_label(spark, sf):
    return tok.first_subword_label(fx.tokens(spark, sf))


@query
def align_words_labels(spark, sf):
    labels = tok.first_subword_label(fx.tokens(spark, sf))
    return tok.align_words_labels(fx.words(spark, sf), labels)


@query
def bio_spans(spark, sf):
    return tok.bio_spans(fx.labelled_words(spark, sf))


@query
def bio_spans_in_row(spark, sf):
    """The same spans from arrays inside the row, as the extraction plan does."""
    words = tk.split_words(F.col("text"))

    def label(w):
        n = F.length(w) % 5
        return F.when(n == 0, "B-ASP").when(n == 1, "I-ASP").otherwise("O")

    return (
        fx.sentences(spark, sf)
        .select("sent_id", words.alias("w"))
        .select("sent_id", F.posexplode(
            tk.bio_spans(F.col("w"), F.transform("w", label))).alias("nth", "s"))
        .select("sent_id", "nth", "s.display", "s.seg"))


@query
def score_tokens(spark, sf):
    clean = rv.clean_reviews(fx.reviews(spark, sf)).select(F.col("ord").alias("sent_id"), "clean")
    model = scoring.dictionary_tagger(list(fx.MODELS.heads), list(fx.MODELS.tails))
    scored = scoring.explode_tokens(scoring.score_tokens(clean, model))
    return scored.select(
        "sent_id", "pos", "word_id", tk.label_name(tk.argmax(F.col("logits"))).alias("label"))


@query
def segment_words(spark, sf):
    clean = rv.clean_reviews(fx.reviews(spark, sf)).select("ord", "clean")
    return scoring.segment_words(clean, scoring.phrase_segmenter(fx.PHRASES)).select(
        "ord", F.col("clean").alias("segmented"))


def _mentions(spark, sf):
    return extract.tag_mentions(rv.clean_reviews(fx.reviews(spark, sf)), fx.MODELS)


def _categorised(spark, sf):
    return tax.normalize_aspects(
        _mentions(spark, sf), fx.taxonomy(spark), fx.blacklist(spark), fuzzy=False)


@query
def tag_mentions(spark, sf):
    return _mentions(spark, sf).select("ord", "product", "aspect_raw")


@query
def build_pairs(spark, sf):
    return tok.build_pairs(_categorised(spark, sf)).select("ord", "sentence", "term")


@query
def score_pairs(spark, sf):
    model = scoring.lexicon_scorer(list(fx.MODELS.positive), list(fx.MODELS.negative))
    return scoring.score_pairs(_categorised(spark, sf), model).select("ord", "term", "label")


@query
def extract_opinions(spark, sf):
    return extract.extract_opinions(
        fx.reviews(spark, sf), fx.taxonomy(spark), fx.blacklist(spark), fx.MODELS,
        fuzzy=False)


@query
def extract_opinions_fuzzy(spark, sf):
    """Heads of which most are only spelled like a keyword."""
    return extract.extract_opinions(
        fx.reviews(spark, sf), fx.taxonomy(spark), fx.blacklist(spark), fx.NEAR_MODELS)


@query
def extract_opinions_models(spark, sf):
    """Python models in both slots instead of the built-in expressions."""
    models = extract.Models(
        tagger=scoring.dictionary_tagger(list(fx.MODELS.heads), list(fx.MODELS.tails)),
        scorer=scoring.lexicon_scorer(list(fx.MODELS.positive), list(fx.MODELS.negative)))
    return extract.extract_opinions(
        fx.reviews(spark, sf), fx.taxonomy(spark), fx.blacklist(spark), models, fuzzy=False)


@query
def score_one(spark, sf):
    """The longest first sentence of the conversations, scored on its own."""
    row = (
        fx.sentences(spark, sf).orderBy(F.desc(F.length("text")), "sent_id").first())
    return extract.score_one(
        spark, row["text"], fx.taxonomy(spark), fx.blacklist(spark), fx.MODELS)


@query
def score_stream_query(spark, sf):
    source = spark.readStream.schema(
        fx.table(spark, sf, "documents").schema).parquet(f"{sf}/documents*.parquet")
    reviews = source.select(
        F.col("doc_id").alias("ord"), F.col("source").alias("product"), "text",
        F.lit("").alias("time_text"))
    store = st.OpinionStore(spark, shared_path(spark, "stream"))
    score_stream(
        reviews, fx.taxonomy(spark), fx.blacklist(spark), fx.MODELS, store,
        shared_path(spark, "progress"), fuzzy=False).awaitTermination()
    return store.all().drop("cache_key", "time_text")


QUERIES["score_stream"] = QUERIES.pop("score_stream_query")


# ---------------------------------------------------------------------- taxonomy


@query
def canonical_aspect(spark, sf):
    return fx.raw_aspects(spark, sf).withColumn(
        "canonical", tx.canonical_aspect(F.col("aspect_raw")))


@query
def strip_spec_tail(spark, sf):
    return tax.with_clean_aspect(fx.raw_aspects(spark, sf))


def _terms(spark, sf):
    clean = tax.with_clean_aspect(fx.raw_aspects(spark, sf)).where("s is not null")
    return tax.drop_generic(clean, fx.blacklist(spark)).select("s").distinct()


@query
def drop_generic(spark, sf):
    return _terms(spark, sf)


@query
def keyword_match(spark, sf):
    return tax.keyword_match(_terms(spark, sf), fx.taxonomy(spark))


@query
def keyword_match_words(spark, sf):
    """Whole-word matching, over sentences instead of single terms."""
    lines = fx.sentences(spark, sf).select("sent_id", F.lower("text").alias("s"))
    return tax.keyword_match(lines, fx.taxonomy(spark), word_boundary=True).drop("s")


@query
def keyword_match_join(spark, sf):
    """The route for dictionaries too large to inline."""
    return tax.keyword_match_by_anchor(
        _terms(spark, sf), tax.taxonomy_index(fx.taxonomy(spark)))


@query
def keyword_match_large(spark, sf):
    """Thousands of keywords: every word of the conversations."""
    index = tax.taxonomy_index(fx.word_taxonomy(fx.table(spark, sf, "conversations")))
    return tax.keyword_match_by_anchor(_terms(spark, sf), index)


@query
def fuzzy_match_large(spark, sf):
    """Keywords beyond the band comparison: every word of the benchmark."""
    return tax.fuzzy_match(_terms(spark, sf), fx.word_taxonomy(fx.table(spark, sf, "benchmark")))


@query
def length_band_candidates(spark, sf):
    return tax.length_band_candidates(_terms(spark, sf), fx.taxonomy(spark)).select(
        "s", "category", "keyword")


@query
def similarity(spark, sf):
    pairs = tax.length_band_candidates(_terms(spark, sf), fx.taxonomy(spark))
    return pairs.select(
        "s", "keyword", tax.similarity(F.col("s"), F.col("keyword")).alias("ratio"))


@query
def fuzzy_match(spark, sf):
    return tax.fuzzy_match(_terms(spark, sf), fx.taxonomy(spark))


@query
def normalize_aspects(spark, sf):
    return tax.normalize_aspects(
        fx.raw_aspects(spark, sf), fx.taxonomy(spark), fx.blacklist(spark))


@query
def normalize_aspects_memo(spark, sf):
    """Half of the terms in a first run; the second one matches only the others."""
    # both runs are given the same terms: they are taken from the documents once
    memo, raw = TermMemo(spark, shared_path(spark, "memo")), settle(fx.raw_aspects(spark, sf))
    run = lambda df: tax.normalize_aspects(
        df, fx.taxonomy(spark), fx.blacklist(spark), matcher=memo.categories)
    run(raw.where("length(aspect_raw) % 2 = 0")).count()
    return run(raw)


@query
def normalize_aspects_exact(spark, sf):
    return tax.normalize_aspects(
        fx.raw_aspects(spark, sf), fx.taxonomy(spark), fx.blacklist(spark), fuzzy=False)


@query
def validate_categories(spark, sf):
    return tax.validate_categories(
        fx.opinion_facts(spark, sf), fx.known_categories(spark, sf), ["aspect_raw"])


@query
def taxonomy_index(spark, sf):
    return tax.taxonomy_index(fx.part_taxonomy(spark, sf)).drop("kw_ord")


# ----------------------------------------------------------------------- metrics

QUERIES |= {
    "kpi_metrics": on_facts(m.kpi_metrics),
    "top_aspect": on_facts(m.top_aspect),
    "opinion_cube": on_facts(m.opinion_cube),
    "aspect_profile": on_facts(m.aspect_profile, ("impact", "first_ord")),
    "aspect_impact": on_facts(m.aspect_impact, ("first_ord",)),
    "worst_aspects": on_facts(m.worst_aspects, ("first_ord",)),
    "drivers": on_facts(m.drivers),
    "has_time": on_facts(m.has_time),
    "trend_by_recency": on_facts(m.trend_by_recency),
    "trend_by_position": on_facts(m.trend_by_position),
    "trend_series": on_facts(m.trend_series),
    "trend_series_untimed": on_facts(
        lambda o: m.trend_series(o.withColumn("time_text", F.lit("")))),
    "product_ranking": on_facts(p.product_ranking),
    "best_products": on_facts(p.best_products),
    "top_products": on_facts(p.top_products),
    "top_aspects_scaled": on_facts(lambda o: p.top_aspects_scaled(m.aspect_profile(o))),
    "heatmap": on_facts(p.heatmap),
    "heatmap_dominant": on_facts(lambda o: p.heatmap_dominant(p.heatmap(o))),
}


@query
def heatmap_maps(spark, sf):
    maps = p.heatmap_maps(fx.opinion_facts(spark, sf))
    cells = F.transform(
        F.array_sort(F.map_entries("aspects")),
        lambda e: F.concat_ws(
            ":", e["key"], e["value"]["pos_pct"].cast("string"),
            e["value"]["neg_pct"].cast("string")))
    return maps.select("product", F.array_join(cells, "|").alias("cells"))


@query
def sample_reviews(spark, sf):
    return p.sample_reviews(fx.opinions(spark, sf))


# -------------------------------------------------------------------------- feed


@query
def review_feed(spark, sf):
    return fd.review_feed(fx.opinions(spark, sf)).withColumn("tags", flat_tags(F.col("tags")))


@query
def feed_summary(spark, sf):
    return fd.feed_summary(fx.opinions(spark, sf))


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", flat_tags(F.col("tags")))


QUERIES |= {
    "smart_alerts": on_feed(fd.smart_alerts),
    "aspect_facet_counts": on_feed(fd.aspect_facet_counts, ("seen",)),
    "product_facet_counts": on_feed(fd.product_facet_counts, ("seen",)),
    "facet_page": on_feed(lambda f: fd.facet_page(f, page=2)),
    "facet_page_past_end": on_feed(lambda f: fd.facet_page(f, page=9)),
    "filter_feed": on_feed(
        lambda f: _flat(fd.filter_feed(f, SELECTION.product, SELECTION.category))),
    "search_feed": on_feed(lambda f: _flat(fd.search_feed(f, SEARCH.query))),
    "feed_page": on_feed(lambda f: _flat(fd.feed_page(f, SEARCH, page=3))),
    "feed_page_past_end": on_feed(lambda f: _flat(fd.feed_page(f, SELECTION, page=900))),
    "feed_page_deep": on_feed(lambda f: _flat(fd.feed_page(f, page=10**9))),
    "slice_aspects": on_feed(lambda f: fd.slice_aspects(f, SEARCH)),
    "slice_aspects_selected": on_feed(lambda f: fd.slice_aspects(f, SELECTION)),
    "slice_sentiment": on_feed(lambda f: fd.slice_sentiment(f, SELECTION)),
    "slice_alerts": on_feed(lambda f: fd.slice_alerts(f, SEARCH)),
    "slice_best_products": on_feed(
        lambda f: fd.slice_best_products(f, fd.Slice(category="PROMO-0"))),
}


def _stored_feed(spark, sf) -> str:
    path = shared_path(spark, "feed")
    fd.store_feed(fd.review_feed(fx.opinions(spark, sf)), path)
    return path


@query
def stored_page_deep(spark, sf):
    """The last page, read from the file it is in."""
    return _flat(fd.stored_page(spark, _stored_feed(spark, sf), 10**9))


@query
def stored_facet_page(spark, sf):
    return fd.stored_facet_page(spark, _stored_feed(spark, sf), 2)


@query
def dashboard_json(spark, sf):
    """Over a stored opinion table, as a dashboard has it: joined once, read by each section."""
    path = shared_path(spark, "opinions")
    fx.opinions(spark, sf).write.parquet(path)
    return dashboard.dashboard_sections(spark.read.parquet(path))


# ------------------------------------------------------------------ store, ledger


def _keyed(spark, sf):
    return fx.opinions(spark, sf).withColumn("cache_key", F.col("aspect_raw"))


def _history(spark, sf):
    """A ledger with one entry per opinion key, in name order."""
    rows = fx.table(spark, sf, "part").groupBy(F.lower("p_type").alias("hash")).agg(
        F.count(F.lit(1)).alias("rows"))
    seq = F.ascii("hash") * 1000 + F.length("hash")
    return rows.select(
        seq.cast("bigint").alias("seq"), F.concat("hash", F.lit(".csv")).alias("name"),
        F.lit("01/01/2026 00:00").alias("date"), "rows", "hash")


def _store(spark, sf) -> st.OpinionStore:
    store = st.OpinionStore(spark, shared_path(spark, "store"))
    store.write(_keyed(spark, sf))
    store.append_history(rank_rows(_history(spark, sf), ["seq"], "batch").withColumn(
        "ts", F.lit(fx.CLOCK).cast("timestamp")))
    return store


@query
def write_opinions(spark, sf):
    """Written twice: the second write replaces the first."""
    store = _store(spark, sf)
    store.write(_keyed(spark, sf).where("aspect_raw = 'promo'"))
    return store.all().groupBy("cache_key", "polarity").agg(F.count(F.lit(1)).alias("n"))


@query
def store_cube(spark, sf):
    """Counts merged from those of each table; two tables replaced, one of them by nothing."""
    store = _store(spark, sf)
    store.write(_keyed(spark, sf).where("aspect_raw = 'promo'").limit(5))
    store.write(_keyed(spark, sf).where("aspect_raw = 'promo'"))
    store.write(_keyed(spark, sf).where("false"), "medium")
    return store.cube()


@query
def write_nothing(spark, sf):
    """An empty result replaces the rows stored under its key."""
    store = _store(spark, sf)
    store.write(_keyed(spark, sf).where("false"), "promo")
    return store.all().groupBy("cache_key").agg(F.count(F.lit(1)).alias("n"))


@query
def analyse_upload(spark, sf):
    """The documents as an upload, analysed and then found again."""
    path, store = _as_csv(spark, sf), st.OpinionStore(spark, shared_path(spark, "store"))
    for reused in (False, True):
        found = analyse(
            spark, path, rv.Roles("text", "source"), fx.taxonomy(spark), fx.blacklist(spark),
            fx.MODELS, store, fuzzy=False)
        assert found.reused is reused
    return store.latest().drop("ord", "time_text")


@query
def score_uploads(spark, sf):
    """A batch run and a stream over the same files: analysed and stored once."""
    path, store = _as_csv(spark, sf), st.OpinionStore(spark, shared_path(spark, "store"))
    args = (rv.Roles("text", "source"), fx.taxonomy(spark), fx.blacklist(spark), fx.MODELS, store)
    analyse(spark, spark.read.text(path).inputFiles()[0], *args, fuzzy=False)
    score_upload_stream(
        spark, path, *args, shared_path(spark, "progress"), fuzzy=False).awaitTermination()
    return store.all().drop("ord", "time_text", "cache_key")


@query
def read_opinions(spark, sf):
    return _store(spark, sf).read("medium")


@query
def latest_opinions(spark, sf):
    return _store(spark, sf).latest()


@query
def load_history(spark, sf):
    return _store(spark, sf).load("economy", fx.known_categories(spark, sf))


@query
def purge_stale(spark, sf):
    """What is left after removing results with unknown categories."""
    store = _store(spark, sf)
    store.purge_stale(fx.known_categories(spark, sf))
    return store.all().groupBy("cache_key").agg(F.count(F.lit(1)).alias("n"))


@query
def stale_keys(spark, sf):
    return _store(spark, sf).stale_keys(fx.known_categories(spark, sf))


@query
def content_key(spark, sf):
    rows = fx.table(spark, sf, "documents").withColumnRenamed("doc_id", "ord")
    return st.table_key(rows, "source", DOC_ROLES)


@query
def file_key(spark, sf):
    """Documents in text files of a thousand ids each, many lines a document."""
    path = shared_path(spark, "texts")
    block = F.floor(F.col("doc_id") / 1000).alias("block")
    (fx.table(spark, sf, "documents").select(block, "doc_id", "text")
     .repartition("block").sortWithinPartitions("block", "doc_id")
     .select("block", "text").write.partitionBy("block").text(path))
    return st.file_key(spark, path, DOC_ROLES).select(
        F.regexp_extract("path", "block=([0-9]+)", 1).cast("bigint").alias("block"),
        "rows", "cache_key")


def _uploads(spark, sf):
    """The document sources as uploaded files."""
    return content_key(spark, sf).select(
        F.substring("source", 4, 9).cast("bigint").alias("batch"),
        F.concat("source", F.lit(".csv")).alias("name"),
        F.lit(fx.CLOCK).cast("timestamp").alias("ts"), "rows",
        F.col("cache_key").alias("hash"))


def _ledger(spark, sf):
    """Every other source is already recorded."""
    old = _uploads(spark, sf).where("batch % 2 = 0")
    return old.select(
        (F.col("batch") + 1).alias("seq"), "name",
        F.date_format("ts", "dd/MM/yyyy HH:mm").alias("date"), "rows", "hash")


@query
def append_history(spark, sf):
    ledger = _ledger(spark, sf)
    return ledger.unionByName(st.new_entries(_uploads(spark, sf), ledger))


@query
def skip_processed(spark, sf):
    return st.skip_processed(_uploads(spark, sf), _ledger(spark, sf)).select(
        "batch", "name", "hash", "status")


@query
def history_view(spark, sf):
    ledger = _ledger(spark, sf)
    odd = F.when(F.col("seq") % 3 == 0, F.lit("?")).otherwise(
        F.concat(F.lit("<b>"), "hash", F.lit("</b>")))
    return st.history_view(ledger.withColumn("hash", odd))
