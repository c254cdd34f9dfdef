"""The operators' queries over whole tables, and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionmill.llm import (
    filter_audit, line_dedup, max_sketch, mixing, near_dups, pieces, pseudo_likelihood,
    quality_rules, repeats, token_files, topk_search, toxicity, url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


ORACLE["op4_quality_rules"] = f"""with {quality_rules.duck_judged()}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept
from judged"""


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"))


ORACLE["op7_mixing"] = f"""with recursive {mixing.duck_mix('documents')}
select doc_id, size, source_size, target, copies * size as taken from mixed"""


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.dedup_lines(docs, count_as="n_removed").select(
        "doc_id", "n_removed", F.length("text").alias("kept_chars"), F.md5("text").alias("kept_md5"))


ORACLE["op8_line_dedup"] = f"""with {line_dedup.duck_lines('documents')}
select doc_id, n_removed, length(new_text) as kept_chars, md5(new_text) as kept_md5
from line_deduped"""


@query
def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, scores and the exact round trip of every text."""
    return pieces.encode_pieces(table(spark, sf_dir, "documents"))


@query
def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_groups(table(spark, sf_dir, "documents"))


_BLANK = " \\t\\n\\x0B\\f\\r"
ORACLE["op9_near_dups"] = f"""with recursive
w as materialized (select doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^{_BLANK}]+') as ws from documents),
s as materialized (select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [ws] else
  list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i:i + 3])) end as ss from w),
sh as materialized (select doc_id, hash(unnest(ss)) as h, len(ss) as n from s),
common as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c
  from sh a join sh b on a.h = b.h and a.doc_id < b.doc_id
  and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by 1, 2),
link as materialized (select a, b from common where 100 * c >= 80 * (na + nb - c)),
reach as (select doc_id as a, doc_id as b from s
  union select reach.a, case when link.a = reach.b then link.b else link.a end
  from reach join link on link.a = reach.b or link.b = reach.b)
select s.doc_id, len(ss)::bigint as n_shingles, min(b) as component_id, min(b) = s.doc_id as kept
from s join reach on reach.a = s.doc_id group by s.doc_id, ss"""


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return topk_search.search(docs, docs.where("doc_id % 50 = 0"))


ORACLE["op2_topk_search"] = f"""with
d as materialized (select row_number() over () as rn, doc_id, text from documents where doc_id is not null),
w as materialized (select rn, doc_id, unnest(regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^{_BLANK}]+')) as word from d),
tf as materialized (select rn, doc_id, word, count(*) as tf from w group by all),
n as materialized (select count(*)::double as docs, (select count(*) from w) / count(*) as mean from d),
df as materialized (select word, ln(1.0 + (any_value(docs) - count(*) + 0.5) / (count(*) + 0.5)) as idf
  from tf, n group by word),
len as materialized (select rn, sum(tf) as dl from tf group by rn),
asked as materialized (select rn as asked_rn, doc_id as query_id, word, idf from tf join df using (word)
  where doc_id % 50 = 0 qualify row_number() over (partition by rn order by tf * idf desc, word) <= {topk_search.TERMS}),
hit as (select asked_rn, query_id, tf.rn, tf.doc_id, round(sum(idf * tf * {topk_search.K1 + 1} /
    (tf + {topk_search.K1} * (1 - {topk_search.B} + {topk_search.B} * dl / mean))), {topk_search.DIGITS}) as score
  from asked join tf using (word) join len using (rn), n group by all)
select query_id, row_number() over (partition by asked_rn order by score desc, doc_id)::int as rank, doc_id, score
from hit qualify rank <= 10"""


@query
def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score_documents(table(spark, sf_dir, "documents"))


@query
def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op11_filter_audit"] = filter_audit.duck_audit()


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_sketch.ranked_search(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op12_ranked_search"] = max_sketch.duck_ranked()


@query
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
