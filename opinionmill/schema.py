"""Table contracts and the fixed values every operator agrees on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
# Labels, defaults and small word lists that must stay exactly as written for
# results to agree with previously stored opinion tables.

POS, NEG, NEU = "pos", "neg", "neu"
DISPLAY_POS = "🟢 Tích cực"
DISPLAY_NEG = "🔴 Tiêu cực"

TAG_LABELS = ("O", "B-ASP", "I-ASP")
POLARITY_LABELS = ("negative", "positive")

DEFAULT_PRODUCT = "Sản phẩm chung"
UNKNOWN_PRODUCT = "Sản phẩm chưa rõ"
NO_PRODUCT_COLUMN = "(Không có cột Sản phẩm)"
NO_DATE_COLUMN = "(Không có cột Ngày tháng)"

GENERIC_TERMS = (
    "sản phẩm", "sảm phẩm", "sp", "máy", "laptop", "đt", "điện thoại",
    "di động", "thiết bị", "hàng", "vỏ", "hộp",
)

SPEC_HEADS = (
    "pin", "sạc nhanh", "sạc", "camera", "cam", "wifi", "sóng 4 g", "sóng",
    "màn hình", "màn", "loa",
)

DAYS_PER_UNIT = {"ngày": 1, "tuần": 7, "tháng": 30, "năm": 365}

# Cell contents a CSV reader treats as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

FUZZY_CUTOFF = 0.82
LENGTH_BAND = 3
MAX_TOKENS = 128  # two of them are sentence markers
# end of fixed values ---------------------------------------------------------

# A mention's position packs the review's position and the mention's index into
# one LONG: ord * 2**20 + index. Review positions therefore use 43 bits.
MENTION_BITS = 20
REVIEW_ORD_BITS = 43

REVIEWS = T.StructType([
    T.StructField("ord", T.LongType()),
    T.StructField("product", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("time_text", T.StringType()),
])

OPINIONS = T.StructType([
    T.StructField("ord", T.LongType()),
    T.StructField("product", T.StringType()),
    T.StructField("review_text", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("aspect_raw", T.StringType()),
    T.StructField("polarity", T.StringType()),
    T.StructField("time_text", T.StringType()),
])

HISTORY = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("hash", T.StringType()),
])

TAXONOMY = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("keyword", T.StringType()),
    T.StructField("kw_ord", T.IntegerType()),
])

TOKENS = T.ArrayType(T.StructType([
    T.StructField("pos", T.IntegerType()),
    T.StructField("word_id", T.IntegerType()),
    T.StructField("logits", T.ArrayType(T.FloatType())),
]))
