import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from opinionmill import schema as S
from opinionmill.operators import grams
from opinionmill.operators import taxonomy as tax
from opinionmill.plans import scale

DICT = {
    "Camera": ("camera", "cam", "chụp ảnh"),
    "Pin": ("pin", "sạc nhanh", "sạc", "sạc dự phòng"),
    "Bảo hành": ("bảo hành", "đổi trả"),
    "AI": ("ai",),
    "Vỏ": ("vỏ điện thoại",),
}


@pytest.fixture(scope="module")
def taxonomy(spark):
    return tax.taxonomy_from_map(spark, DICT)


@pytest.fixture(scope="module")
def blacklist(spark):
    return tax.blacklist_from_terms(spark)


def terms(spark, values):
    return spark.createDataFrame([(v,) for v in values], "s string")


def raws(spark, values):
    return spark.createDataFrame([(v,) for v in values], "aspect_raw string")


def as_map(df, key="s", value="category"):
    return {r[key]: r[value] for r in df.collect()}


def test_index_order(taxonomy):
    rows = tax.taxonomy_index(taxonomy).orderBy("rank").collect()
    keys = [(-len(r["keyword"]), r["category"], r["kw_ord"]) for r in rows]
    assert keys == sorted(keys)
    assert [r["rank"] for r in rows] == list(range(len(rows)))


def test_substring_not_word(spark, taxonomy):
    got = as_map(tax.keyword_match(terms(spark, ["hai", "main", "cammera", "sạc nhanh pin"]), taxonomy))
    assert got == {"hai": "AI", "main": "AI", "cammera": "Camera", "sạc nhanh pin": "Pin"}
    strict = as_map(tax.keyword_match(
        terms(spark, ["hai", "ai, nhé", "pin"]), taxonomy, word_boundary=True))
    assert strict == {"hai": None, "ai, nhé": "AI", "pin": "Pin"}


@pytest.mark.parametrize("large", [False, True])
def test_whole_words_with_signs(spark, monkeypatch, large):
    """Keywords that hold other characters than letters are whole words too."""
    if large:
        monkeypatch.setattr(tax, "bounded_rows", lambda *a: None)
    signs = tax.taxonomy_from_map(spark, {"Net": ("wi-fi", "wi-fi 6e"), "Lang": ("c++",), "Price": ("5%",)})
    got = as_map(tax.keyword_match(terms(spark, [
        "wi-fi", "the wi-fi, ok", "wi fi", "awi-fi", "wi-fix", "my wi-fi 6e!", "c++", "c", "abc++", "15%", "for 5% off"]),
        signs, word_boundary=True), value="keyword")
    assert got == {"wi-fi": "wi-fi", "the wi-fi, ok": "wi-fi", "wi fi": None, "awi-fi": None, "wi-fix": None,
                   "my wi-fi 6e!": "wi-fi 6e", "c++": "c++", "c": None, "abc++": None, "15%": None,
                   "for 5% off": "5%"}


def test_both_match_routes_agree(spark, taxonomy, monkeypatch):
    rng = random.Random(7)
    letters = "aipnmcer sạ"
    values = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 14))) for _ in range(300)]
    values += ["chụp ảnh camera", "pin sạc dự phòng"]
    df = terms(spark, values)
    inline = as_map(tax.keyword_match(df, taxonomy))
    ranked = sorted(
        ((k, c) for c, ks in DICT.items() for k in ks), key=lambda x: (-len(x[0]), x[1]))
    brute = {v: next((c for k, c in ranked if k in v), None) for v in values}
    assert inline == brute
    joined = as_map(tax.keyword_match_by_anchor(df, tax.taxonomy_index(taxonomy)))
    assert joined == {k: v for k, v in brute.items() if v is not None}
    monkeypatch.setattr(tax, "bounded_rows", lambda *a: None)
    assert as_map(tax.keyword_match(df, taxonomy)) == brute


def test_similarity_values(spark):
    df = spark.createDataFrame(
        [("cammera", "camera"), ("bảo hàh", "bảo hành"), ("điện thoại", "vỏ điện thoại"),
         ("abcd", "bcda"), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(tax.similarity(F.col("a"), F.col("b"))).collect()]
    assert [round(x, 4) if x is not None else None for x in got] == [0.9231, 0.9333, 0.8696, 0.75, None]


def brute_fuzzy(value, ranked, cutoff=S.FUZZY_CUTOFF):
    near = [
        (SequenceMatcher(None, value, k).ratio(), -i, k, c)
        for i, (k, c) in enumerate(ranked) if abs(len(k) - len(value)) <= 3
    ]
    if not near:
        return None
    ratio, _, keyword, category = max(near)
    return category if ratio >= cutoff and value not in keyword else None


def test_anchor_is_the_rarest_gram(spark):
    keys = spark.createDataFrame([("abcdefg",), ("abcdefh",), ("xyzxyzx",), ("ab",)], "piece string")
    seen = spark.createDataFrame(
        [("t1", "abcdef"), ("t2", "abcdef"), ("t1", "bcdefg"), ("t1", "ab"), ("t3", "xyzxyz")], "s string, gram string")
    # one keyword has a gram that no term has; so has the one with x's
    assert as_map(grams.anchors(keys, seen), "piece", "gram") == {"abcdefg": "bcdefg", "ab": "ab"}


def test_large_dictionary_against_inlined(spark, monkeypatch):
    """Long and short keywords over sentences, both routes, and few needless candidates."""
    rng = random.Random(11)
    words = ["".join(rng.choice("aeioumnrst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    kws = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(1500)}
    dictionary = spark.createDataFrame(
        [(f"c{i % 7}", k, i) for i, k in enumerate(sorted(kws))], S.TAXONOMY)
    df = terms(spark, [" ".join(rng.choice(words) for _ in range(12)) for _ in range(300)] + ["", "x"])
    for whole in (False, True):
        inlined = as_map(tax.keyword_match(df, dictionary, whole), value="keyword")
        index = tax.taxonomy_index(dictionary)
        anchored = as_map(tax.keyword_match_by_anchor(df, index, whole), value="keyword")
        assert anchored == {k: v for k, v in inlined.items() if v is not None} and len(anchored) > 100
    keys = index.select(F.col("keyword").alias("piece"))
    hays = df.withColumn("hay", F.col("s"))
    seen = hays.select("s", "hay", F.explode(F.array_distinct(F.flatten(F.array(
        *[grams.pieces(F.col("hay"), n) for n in range(2, grams.GRAM + 1)])))).alias("gram"))
    met = grams.candidates(seen, grams.anchors(keys, seen))
    hits = met.where(F.contains("hay", F.col("piece"))).count()
    assert hits == grams.containing(hays, keys).count() > 1000 and met.count() < 2 * hits


def test_least_matched():
    for total in range(1, 80):
        m = grams.least_matched(total, S.FUZZY_CUTOFF)
        assert 2.0 * m / total >= S.FUZZY_CUTOFF > 2.0 * (m - 1) / total


@pytest.mark.parametrize(("heavy", "cutoff"), [(grams.HEAVY, S.FUZZY_CUTOFF), (3, S.FUZZY_CUTOFF), (3, 0.6)])
def test_similarity_join_by_definition(spark, heavy, cutoff, monkeypatch):
    """All pairs of many strings over few letters, with and without salted segments."""
    monkeypatch.setattr(grams, "HEAVY", heavy)
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(1200)})
    kws = rng.sample(words, 500)
    pairs = grams.alike(
        terms(spark, words), spark.createDataFrame([(k,) for k in kws], "keyword string"), cutoff, 3)
    got = [tuple(r) for r in pairs.collect()]
    want = {(a, b) for a in words for b in kws
            if abs(len(a) - len(b)) <= 3 and SequenceMatcher(None, a, b).ratio() >= cutoff}
    assert len(got) == len(set(got)) and want <= set(got)
    assert len(got) < (0.02 if cutoff > 0.8 else 0.5) * len(words) * len(kws)


@pytest.mark.parametrize("large", [False, True])
def test_fuzzy_against_brute_force(spark, taxonomy, monkeypatch, large):
    """Every keyword with one or two edits, through both candidate routes."""
    if large:
        monkeypatch.setattr(tax, "within", lambda *a: False)
    rng = random.Random(3)
    ranked = sorted(
        ((k, c) for c, ks in DICT.items() for k in ks), key=lambda x: (-len(x[0]), x[1]))
    values = {"điện thoại", "bảo hàh", "đổi trảa", "sạc nhan", "sạc nhanhh"}
    for k, _ in ranked:
        for _ in range(12):
            s = list(k)
            for _ in range(rng.randint(1, 2)):
                i = rng.randrange(len(s))
                s[i:i + 1] = rng.choice([[], [s[i]] * 2, ["x"], [s[i], "h"]])
                if not s:
                    break
            if len(s) >= 2:
                values.add("".join(s))
    values = sorted(values)
    got = as_map(tax.fuzzy_match(terms(spark, values), taxonomy))
    want = {v: c for v in values if (c := brute_fuzzy(v, ranked)) is not None}
    assert len(want) > 20
    assert got == want


def test_band_routes_agree(spark, taxonomy, monkeypatch):
    df = terms(spark, ["pinn", "camra", "bảo hàh", "zz"])
    def pairs():
        return sorted(
            (r["s"], r["keyword"])
            for r in tax.length_band_candidates(df, taxonomy).collect())
    small = pairs()
    assert small == sorted(
        (v, k) for v in ("pinn", "camra", "bảo hàh", "zz") for ks in DICT.values()
        for k in ks if abs(len(k) - len(v)) <= 3)
    monkeypatch.setattr(tax, "within", lambda *a: False)
    assert pairs() == small


def test_cascade(spark, taxonomy, blacklist):
    values = ["Pin 5800", "Điện_thoại", "bảo hàh", "x", None, "bàn", "SP", "sạc  nhanh 20 w", "cam_sau"]
    got = as_map(tax.normalize_aspects(raws(spark, values), taxonomy, blacklist), "aspect_raw")
    assert got == {"Pin 5800": "Pin", "bảo hàh": "Bảo hành", "sạc  nhanh 20 w": "Pin",
                   "cam_sau": "Camera"}
    exact = as_map(
        tax.normalize_aspects(raws(spark, values), taxonomy, blacklist, fuzzy=False), "aspect_raw")
    assert "bảo hàh" not in exact and len(exact) == 3


def test_cascade_keeps_every_row(spark, taxonomy, blacklist, monkeypatch):
    df = raws(spark, ["pin"] * 500 + ["bảo hàh"] * 300 + ["máy"] * 50)
    want = {"Pin": 500, "Bảo hành": 300}
    def counts():
        done = tax.normalize_aspects(df, taxonomy, blacklist)
        return as_map(done.groupBy("category").count(), "category", "count")
    assert counts() == want
    monkeypatch.setattr(tax, "within", lambda *a: False)
    monkeypatch.setattr(scale, "within", lambda *a: False)
    assert counts() == want


def test_empty_dictionary(spark, blacklist):
    empty = tax.taxonomy_from_map(spark, {})
    assert tax.normalize_aspects(raws(spark, ["pin"]), empty, blacklist).count() == 0


def test_validate_categories(spark, taxonomy):
    def check(values):
        df = spark.createDataFrame([(v,) for v in values], "category string")
        return tax.validate_categories(df, taxonomy).first()["valid"]

    assert check(["Pin", "Camera", None]) is True
    assert check(["Pin", "other"]) is False
    assert check([None, "nan"]) is False
    assert check([]) is False
