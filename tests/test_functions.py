"""Column builders against the Python standard library."""

import re
import time
import unicodedata

from pyspark.sql import functions as F

from opinionmill.functions import rounding as r
from opinionmill.functions import text as tx


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()
    return [x["o"] for x in rows]


def test_three_roundings(spark):
    pairs = [(a, b) for b in range(0, 161) for a in range(b + 1)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint").select(
        "a", "b",
        r.half_even_pct(F.col("a"), F.col("b")).alias("even"),
        r.half_up_pct(F.col("a"), F.col("b")).alias("up"),
        r.half_even_pct(F.col("a") - F.col("b"), F.col("b")).alias("signed"),
        r.satisfaction_score(F.col("a"), F.col("b")).alias("score"))
    for x in df.collect():
        a, b = x["a"], x["b"]
        assert x["even"] == (round(a / b * 100) if b else 0)
        assert x["signed"] == (round((a - b) / b * 100) if b else 0)
        assert x["up"] == (int(a / b * 100 + 0.5) if b else 0)
        assert x["score"] == round(1.0 + (a / b if b else 0) * 4.0, 1), (a, b)


def test_rounding_ties(spark):
    df = spark.createDataFrame([(1, 8), (27, 200)], "a bigint, b bigint")
    got = df.select(
        r.half_even_pct(F.col("a"), F.col("b")).alias("e"),
        r.half_up_pct(F.col("a"), F.col("b")).alias("u")).collect()
    assert [(x["e"], x["u"]) for x in got] == [(12, 13), (14, 14)]


MESSY = [
    "plain text", "  two  spaces\t\n", "xem https://a.b/c?d=1<b>x</b> nhé", "<p>hi</p>www.x.y z",
    "nbsp\u00a0\u00a0here\u3000", "e\u0301 kết nô\u0301i", "\x1cctl\x1fsep\x85", "", "<unclosed", "a<>b",
    "HTTP://UPPER http://", "한\u1112\u1161\u11ab", "\u212b\u2126", "🙂🟢 ok",
]


def expected_clean(text):
    s = unicodedata.normalize("NFC", text)
    for pattern in (r"https?://\S+|www\.\S+", r"<[^>]+>", r"\s+"):
        s = re.sub(pattern, " ", s)
    return s.strip()


def test_preprocess(spark):
    got = column(spark, [*MESSY, None], tx.preprocess_text)
    assert got == [*map(expected_clean, MESSY), ""]


def test_nfc_shortcut_is_safe():
    stable = re.compile(
        "[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", tx.NFC_STABLE) + "]")
    for code in range(0x110000):
        c = chr(code)
        if stable.match(c):
            assert unicodedata.normalize("NFC", c) == c, hex(code)
            assert unicodedata.combining(c) == 0, hex(code)
            # no stable character combines with one before it
            assert unicodedata.normalize("NFC", "a" + c) == "a" + c, hex(code)


def test_blank_missing(spark):
    got = column(spark, [None, "", "NaN", "nan", "Nan ", "x"], tx.blank_missing)
    assert got == ["", "", "", "", "Nan ", "x"]


def test_parse_days_ago(spark):
    cases = {
        "٣ ngày trước": 3, "１２ tuần trước": 84,
        "2 Tuần trước": 14, "1 tháng 5 ngày": 30, "5ngày": -1, "hôm nay": -1,
        "12/05/2024": -1, "3\u00a0năm": 1095, "0 ngày": 0, "cách đây 10  NGÀY": 10,
        "9" * 30 + " ngày": 10**15, "": -1, None: -1,
    }
    assert column(spark, list(cases), tx.parse_days_ago) == list(cases.values())


def test_canonical_and_spec_tail(spark):
    raw = ["pin 5800", "Sạc_nhanh 67 w", "sạc  nhanh 67 w!", "x", None, "Màn hình 6.7",
           " LOA 2 ", "sóng 4 g 5", "pin", "camera 50 mp zoom"]
    got = column(spark, raw, lambda c: tx.strip_spec_tail(tx.canonical_aspect(c)))
    assert got == ["pin", "sạc nhanh", "sạc nhanh 67 w!", None, None, "màn hình 6.7",
                   "loa", "sóng 4 g", "pin", "camera"]


def test_bands(spark):
    df = spark.createDataFrame([(4.5, 0), (4.4, -1), (3.4, 5)], "s double, n int")
    got = df.select(tx.star_band(F.col("s")).alias("s"), tx.nps_band(F.col("n")).alias("n")).collect()
    assert [(x["s"], x["n"]) for x in got] == [
        (5, "good"), (4, "needs improvement"), (3, "good")]


def test_polarity_code(spark):
    got = column(spark, ["positive", "🔴 Tiêu cực", "🟢 Tích cực", "?", None], tx.polarity_code)
    assert got == ["pos", "neg", "pos", "neu", "neu"]


def test_even_spaces(spark):
    """Only runs other than a single U+0020 are replaced."""
    texts = [*MESSY, "a b", " a  b ", "a \t b\n", "\u3000", "\n \n", " ", "", "a\u2003 b", " \x85 x"]
    assert column(spark, [*texts, None], tx.even_spaces) == [*(re.sub(r"\s+", " ", t) for t in texts), None]


def test_even_spaces_reads_even_texts_without_the_full_pattern(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c) != " " and (chr(c).isspace() and c != 0x180e)]
    texts = ["", " ", "a b", " a b ", "a  b", "é b", "é  b", *(f"a{s}b" for s in spaces), *(f"é {s} b" for s in spaces)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = dict(tuple(r) for r in rows.select("i", tx.even_spaces(F.col("t"))).collect())
    assert got == {**{i: re.sub(r"\s+", " ", t) for i, t in enumerate(texts)}, len(texts): None}
    even = spark.range(4000).select(F.concat(F.repeat(F.lit("word "), 400), F.col("id").cast("string")).alias("t"))

    def seconds(column):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            even.agg(F.sum(F.length(column))).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    assert seconds(tx.even_spaces(F.col("t"))) < 0.8 * seconds(
        F.regexp_replace("t", tx.UNEVEN_SPACES_PATTERN, " "))
