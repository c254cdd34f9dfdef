import itertools

import pytest
from pyspark.sql import functions as F

from opinionmill.functions import text as tx
from opinionmill.functions import tokens as tk
from opinionmill.operators import scoring
from opinionmill.operators import tokens as tok

NAMES = {"B": "B-ASP", "I": "I-ASP", "O": "O"}
GOLDEN = [
    ("aa bb cc dd", "BIOI", ["aa bb"]),
    ("aa bb cc dd", "IBBI", ["bb", "cc dd"]),
    ("aa bb cc", "BOI", ["aa"]),
    ("x", "B", []),
    ("man_hinh x", "BO", ["man hinh"]),
]


def long_form(spark, cases):
    rows = [
        (i, j, w, NAMES[l])
        for i, (words, labels) in enumerate(cases)
        for j, (w, l) in enumerate(zip(words, labels))
    ]
    return spark.createDataFrame(rows, "sent_id bigint, word_id int, word string, label string")


def spans_long(df):
    out = {}
    for r in tok.bio_spans(df).orderBy("sent_id", "start").collect():
        out.setdefault(r["sent_id"], []).append((r["display"], r["seg"]))
    return out


def spans_in_row(spark, cases):
    rows = [(i, list(w), [NAMES[x] for x in l]) for i, (w, l) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, w array<string>, l array<string>")
    got = df.select("i", tk.bio_spans(F.col("w"), F.col("l")).alias("s")).collect()
    return {r["i"]: [(s["display"], s["seg"]) for s in r["s"]] for r in got if r["s"]}


def test_golden(spark):
    cases = [(w.split(), l) for w, l, _ in GOLDEN]
    want = {i: [x for x in g[2]] for i, g in enumerate(GOLDEN) if g[2]}
    for got in (spans_long(long_form(spark, cases)), spans_in_row(spark, cases)):
        assert {i: [d for d, _ in s] for i, s in got.items()} == want
    assert spans_in_row(spark, cases)[4] == [("man hinh", "man_hinh")]


@pytest.mark.parametrize("chunk", [2, 512])
def test_every_label_sequence(spark, monkeypatch, chunk):
    """Both forms agree with reading the labels left to right; small chunks
    exercise the carry between chunks."""
    monkeypatch.setattr(tok, "_CHUNK", chunk)
    cases = [
        ([f"w{j}" for j in range(n)], "".join(s))
        for n in range(1, 6) for s in itertools.product("BIO", repeat=n)
    ]
    want = {}
    for i, (words, labels) in enumerate(cases):
        spans, current = [], None
        for w, l in zip(words, labels):
            if l == "B":
                current = [w]
                spans.append(current)
            elif l == "I" and current is not None:
                current.append(w)
            else:
                current = None
        if spans:
            want[i] = [(" ".join(s), " ".join(s)) for s in spans]
    assert spans_long(long_form(spark, cases)) == want
    assert spans_in_row(spark, cases) == want


def test_split_words(spark):
    df = spark.createDataFrame(
        [("  a b\u00a0c\n",), ("",), ("   ",), (None,)], "t string")
    got = [r[0] for r in df.select(tk.split_words(F.col("t"))).collect()]
    assert got == [["a", "b", "c"], [], [], None]


def test_argmax_first_on_ties(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.1],), ([0.0, 0.2, 0.9],)], "l array<float>")
    got = [r[0] for r in df.select(tk.label_name(tk.argmax(F.col("l")))).collect()]
    assert got == ["O", "I-ASP"]


def test_model_route_matches_dictionary(spark):
    """The Python tagger, read through first-subword labels, tags what the
    built-in expression tags, also past the token limit."""
    heads, tails = ["pin", "camera"], ["sau"]
    texts = ["Pin tốt camera sau đẹp", "không có gì", "a " * 140 + "pin", "camera_sau sau pin",
             "camera " * 125 + "abcde" * 200 + " sau camera " + "sau " * 300 + "pin"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, clean string")
    scored = scoring.score_words(df, scoring.dictionary_tagger(heads, tails), batch=2)
    words, labels = scoring.token_labels()
    by_model = {
        r["i"]: [s["seg"] for s in r["s"]]
        for r in scored.select("i", tk.bio_spans(words, labels).alias("s")).collect()}
    by_dict = {
        r["i"]: [s["seg"] for s in r["s"]]
        for r in df.select("i", tk.marked_spans(
            tk.dictionary_marks(F.col("clean"), heads, tails)).alias("s")).collect()}
    long = by_dict.pop(4)
    assert long == ["camera"] * 125 + ["camera" + " sau" * 300, "pin"]
    assert by_dict == {0: ["Pin", "camera sau"], 1: [], 2: ["pin"], 3: ["pin"]}
    assert by_model == {**by_dict, 4: long}


def test_runs_hold_every_text_once(spark, monkeypatch):
    texts = ["pin " * n for n in (0, 3, 200, 1, 90, 0, 40)] + [None, "camera sau"]
    assert [t for run in scoring._runs(100)(texts) for t in run] == texts
    assert all(len(run) == 1 or sum(len(t or "") for t in run) <= 100 for run in scoring._runs(100)(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, clean string").coalesce(1)
    model = scoring.dictionary_tagger(["pin", "camera"], ["sau"])

    def scores():
        words = scoring.score_words(df, model, batch=2).orderBy("i").collect()
        return words, scoring.score_tokens(df, model, batch=2).orderBy("i").collect()

    whole = scores()
    monkeypatch.setattr(scoring, "RUN_CHARS", 100)
    assert scores() == whole


def test_long_form_labels(spark):
    df = spark.createDataFrame([(0, "pin sạc nhanh")], "sent_id int, clean string")
    scored = scoring.score_tokens(df, scoring.dictionary_tagger(["pin", "nhanh"], []))
    tokens = scoring.explode_tokens(scored)
    assert tokens.count() == 6  # two markers, pin, sạc, and two pieces of nhanh
    labels = tok.first_subword_label(tok.truncate_subwords(tokens))
    got = sorted((r["word_id"], r["label"]) for r in labels.collect())
    assert got == [(0, "B-ASP"), (1, "O"), (2, "B-ASP")]
    cut = tok.first_subword_label(tok.truncate_subwords(tokens, max_len=4))
    assert cut.count() == 2


def test_scorer(spark):
    df = spark.createDataFrame(
        [("tốt tốt xấu", "pin"), ("xấu", "pin"), ("", "pin")], "sentence string, term string")
    scored = scoring.score_pairs(df, scoring.lexicon_scorer(["tốt"], ["xấu"]), batch=1)
    assert [r["label"] for r in scored.collect()] == ["positive", "negative", "positive"]
    direct = df.select(tk.lexicon_label(F.col("sentence"), ["tốt"], ["xấu"]).alias("l"))
    assert [r["l"] for r in direct.collect()] == ["positive", "negative", "positive"]


def test_label_is_told_once_a_review(spark):
    """Mentions of one review share its label, counted before they become rows."""
    from opinionmill.plans import extract

    models = extract.Models(heads=("pin", "loa"), positive=("tốt",), negative=("xấu",))
    df = spark.createDataFrame(
        [(0, "A", "x", "", "Pin xấu xấu loa tốt pin"), (1, "A", "x", "", "pin tốt"), (2, "A", "x", "", "xấu")],
        "ord bigint, product string, text string, time_text string, clean string")
    got = extract.tag_mentions(df, models)
    assert sorted((r["ord"] >> 20, r["label"]) for r in got.collect()) == [
        (0, "negative"), (0, "negative"), (0, "negative"), (1, "positive")]


def test_dictionary_spans(spark):
    """Spans and label as from the marks, told from one splitting of the lowered text."""
    heads, tails, lexicon = ["loa", "màn", "σας"], ["ngoài", "hình", "i̇n"], (["tốt"], ["xấu"])
    texts = ["Loa Ngoài xấu", "LOA  ngoài\tMàn　hình tốt", "hình loa", "no head xấu", "loa xấu loa_x tốt màn",
             "ΣΑΣ İn loa İN", "", " ", "\nloa\n\nngoài \r\n", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = {r["i"]: (r["s"] or [], r["l"] if r["s"] else None) for r in df.select(
        "i", tk.marked_spans(tk.dictionary_marks(F.col("t"), heads, tails)).alias("s"),
        tk.lexicon_label(F.col("t"), *lexicon).alias("l")).collect()}
    assert len(want[1][0]) == 2 and want[1][1] == "positive" and len(want[5][0]) == 2 and want[3] == ([], None)

    def found(rows, even):
        told = tk.dictionary_spans(
            F.col("t"), heads, tails, lambda low: tk.lexicon_label_of(low, *lexicon), even)
        return {r["i"]: (r["x"]["spans"] or [], r["x"]["label"]) for r in rows.select("i", told.alias("x")).collect()}

    assert found(df, False) == want
    assert found(df.withColumn("t", tx.collapse_ws(F.col("t"))), True) == want
    alone = df.select(tk.dictionary_spans(F.col("t"), heads, tails).alias("x")).collect()
    assert [r["x"]["spans"] or [] for r in alone] == [want[i][0] for i in range(len(texts))]


def test_cleaned_texts_are_read_for_spaces_once(spark):
    from opinionmill.operators.taxonomy import blacklist_from_terms, taxonomy_from_map
    from opinionmill.plans import extract

    reviews = spark.createDataFrame(
        [(0, "A", " loa　xấu  Loa ", "")], "ord bigint, product string, text string, time_text string")
    models = extract.Models(heads=("loa",), positive=("tốt",), negative=("xấu",))
    found = extract.extract_opinions(
        reviews, taxonomy_from_map(spark, {"Âm": ("loa",)}), blacklist_from_terms(spark, ()), models, fuzzy=False)
    assert [(r["review_text"], r["aspect_raw"], r["polarity"]) for r in found.orderBy("ord").collect()] == [
        (" loa　xấu  Loa ", "loa", "neg"), (" loa　xấu  Loa ", "Loa", "neg")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(tx._WIDE_ODD_PATTERN) == 1
