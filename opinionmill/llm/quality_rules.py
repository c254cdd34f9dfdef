"""Quality rules by weak supervision.

Each rule looks at a document and votes that it is poor (``-1``) or good (``1``),
or abstains (``0``). Nobody says how far a rule can be trusted: expectation-
maximisation over the vote patterns estimates each rule's accuracy, the share of
its votes that agree with the documents' posterior. A document is kept when its
posterior probability of being good is at least ``KEEP_AT``; one failed rule does
not reject a document that other, better rules speak for.

The classes are taken as balanced beforehand (``prior`` 0.5, as usual for such
label models): with a prior estimated too, a lone kind of junk that one rule sees
is drowned by the good majority. Abstaining says nothing about a document.

Everything runs on DataFrame expressions. The texts are read twice: once to count
vote patterns (at most ``2 ** len(RULES)`` rows, whatever the input, so the
estimation itself is a few loops over that small table) and once to judge them.

Defined results: a null or blank text has no words and fails the base rules;
repeated rows are judged alike; an empty table gives an empty result; other
columns of the input are carried through untouched, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionmill.llm.columns import BLANK_CLASS, count_chars, count_rare, let, whole_text, words_of

SYMBOLS = "#*$%&|<>"
KEEP_AT = 0.5
ROUNDS = 25
#: Accuracy assumed before the first round, and the range an estimate may take.
GUESS = 0.9
LEAST, MOST = 0.6, 0.999

#: name -> (vote, condition over the measures below). The conditions are SQL that
#: the DuckDB form uses as well, hence plain operators.
RULES: dict[str, tuple[int, str]] = {
    "symbols": (-1, "5 * n_symbols > n_words"),
    "repetition": (-1, "100 * n_repeat_words > 30 * n_words"),
    "short_words": (-1, "word_chars < 2 * n_words"),
    "long_words": (-1, "word_chars > 14 * n_words"),
    "capitals": (-1, "5 * n_upper > 2 * word_chars"),
    "shouting": (-1, "10 * n_bangs > n_words"),
    "repeated_lines": (-1, "2 * n_dup_lines > n_lines"),
    "no_stops": (-1, "60 * n_stops < n_words"),
    "prose": (1, "word_chars >= 3 * n_words and word_chars <= 10 * n_words"
                 " and 20 * n_symbols <= n_words and 5 * n_repeat_words <= n_words"
                 " and 4 * n_upper <= word_chars and 20 * n_bangs <= n_words"),
    "sentences": (1, "25 * n_stops >= n_words and 2 * n_stops <= n_words"
                     " and 20 * n_symbols <= n_words and 4 * n_upper <= word_chars"
                     " and 20 * n_bangs <= n_words and 10 * n_repeat_words <= 3 * n_words"),
}
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
            "n_upper", "n_bangs", "n_stops")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more in the text."""
    def covered(keys: Column) -> Column:
        # equal windows stand side by side once sorted; then back to their places
        placed = F.sort_array(F.transform(
            keys, lambda k, i: F.struct(k.alias("key"), i.alias("at"))))
        return let(placed, lambda s: let(F.size(s), lambda n: F.size(F.array_distinct(F.flatten(
            F.transform(
                F.filter(F.sequence(F.lit(1), n), lambda i: (
                    ((i > 1) & (F.get(s, i - 2)["key"] == F.get(s, i - 1)["key"]))
                    | ((i < n) & (F.get(s, i)["key"] == F.get(s, i - 1)["key"])))),
                lambda i: let(F.get(s, i - 1)["at"], lambda p: F.array(p, p + 1, p + 2))))))))

    def some(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(1), F.size(w) - 2),
            lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))
        return let(windows, lambda keys: F.when(
            F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(covered(keys)))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(some(words))


def measures(text: Column) -> Column:
    """The measures of one whole text, as a struct computed once."""
    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit("[^" + BLANK_CLASS[1:])))
        return let(lines, lambda ls: let(words_of(t), lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            count_rare(t, SYMBOLS).cast("bigint").alias("n_symbols"),
            F.size(ls).cast("bigint").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"),
            _repeat_words(w).cast("bigint").alias("n_repeat_words"),
            count_chars(t, _UPPER).cast("bigint").alias("n_upper"),
            count_rare(t, "!").cast("bigint").alias("n_bangs"),
            count_rare(t, ".,").cast("bigint").alias("n_stops"))))

    return let(whole_text(text), of)


def _over(condition: str, m: Column) -> Column:
    """One of the conditions above over a struct of measures."""
    names = sorted(MEASURES, key=len, reverse=True)
    tests = []
    for part in condition.split(" or "):
        parts = []
        for test in part.split(" and "):
            left, op, right = next(
                test.partition(f" {o} ") for o in ("<=", ">=", "<", ">", "=") if f" {o} " in test)
            a, b = (_product(x, m, names) for x in (left, right))
            parts.append({"<=": a <= b, ">=": a >= b, "<": a < b, ">": a > b, "=": a == b}[op.strip()])
        tests.append(reduce(and_, parts))
    return reduce(or_, tests)


def _product(term: str, m: Column, names: Sequence[str]) -> Column:
    out = None
    for x in term.split(" * "):
        factor = m[x] if x in names else F.lit(int(x))
        out = factor if out is None else out * factor
    return out


def base_failed(m: Column) -> Column:
    return _over(BASE_FAILED, m)


def votes(m: Column) -> Column:
    """The rules' votes as an array, in the order of ``RULES``."""
    return F.array(*[
        F.when(_over(condition, m), F.lit(vote)).otherwise(F.lit(0))
        for vote, condition in RULES.values()])


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> list[float]:
    """Each rule's weight, the log-odds of its accuracy, from counted vote patterns."""
    weights = [math.log(GUESS / (1 - GUESS))] * len(RULES)
    for _ in range(rounds):
        good = {
            p: 1 / (1 + math.exp(-sum(v * w for v, w in zip(p, weights, strict=True))))
            for p in patterns}
        for j, (vote, _) in enumerate(RULES.values()):
            cast = sum(n for p, n in patterns.items() if p[j])
            right = sum(n * (good[p] if vote > 0 else 1 - good[p])
                        for p, n in patterns.items() if p[j])
            accuracy = min(MOST, max(LEAST, right / cast)) if cast else GUESS
            weights[j] = math.log(accuracy / (1 - accuracy))
    return weights


def p_good(cast: Column, weights: list[float]) -> Column:
    """Posterior probability of being good, given an array of votes."""
    odds = F.lit(0.0)
    for j, w in enumerate(weights):
        odds = odds + F.get(cast, F.lit(j)) * F.lit(w)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit(judged: DataFrame) -> list[float]:
    """Estimate from a frame with the column ``_votes``: one small aggregate."""
    rows = judged.groupBy("_votes").count().collect()  # at most 2 ** len(RULES) + 1 rows
    return estimate({tuple(r["_votes"]): r["count"] for r in rows if r["_votes"] is not None})


def vote_patterns(docs: DataFrame, text: str = "text") -> DataFrame:
    """Only ``_votes`` of each document, null where the base rules fail.

    Not filtered here: a filter would be pushed below and measure every text twice.
    """
    return docs.select(let(measures(F.col(text)), lambda m: F.when(
        ~base_failed(m), votes(m))).alias("_votes"))


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents whose posterior probability of being good reaches ``KEEP_AT``.

    Columns, names and types of ``docs`` stay as they are.
    """
    weights = fit(vote_patterns(docs, text))
    return docs.where(let(measures(F.col(text)), lambda m: ~base_failed(m) & let(
        votes(m), lambda v: p_good(v, weights) >= KEEP_AT)))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's measures, votes, posterior and verdict, none removed.

    ``doc_id``, ``n_words``, ``n_symbols``, ``word_chars``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``votes``, ``p_good`` and ``kept``. The
    posterior of documents that fail the base rules is given too; they are not
    kept.
    """
    weights = fit(vote_patterns(docs, text))
    found = docs.select(F.col(doc_id).alias("doc_id"), let(
        measures(F.col(text)), lambda m: let(votes(m), lambda v: F.struct(
            m.alias("m"), v.alias("votes"), base_failed(m).alias("base_failed"),
            p_good(v, weights).alias("p_good")))).alias("j"))
    return found.select(
        "doc_id", *[F.col(f"j.m.{n}").alias(n) for n in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "j.base_failed", "j.votes", "j.p_good",
        (~F.col("j.base_failed") & (F.col("j.p_good") >= KEEP_AT)).alias("kept"))


def duck_judged(docs: str = "documents", rounds: int = ROUNDS) -> str:
    """DuckDB: CTEs ending in ``judged(rid, doc_id, …, base_failed, kept)``.

    The same estimation, one CTE per round, from texts measured by other means.
    """
    blank = "[ \\t\\n\\x0B\\f\\r]"
    word = "[^ \\t\\n\\x0B\\f\\r]+"
    case = lambda j, r: f"case when {r[1]} then {r[0]} else 0 end as v{j}"
    names = range(len(RULES))
    sql = f"""
src as materialized (select row_number() over () as rid, * from {docs}),
word as materialized (select rid, w, row_number() over (partition by rid order by i) as i from (
  select rid, unnest(ws) as w, generate_subscripts(ws, 1) as i
  from (select rid, regexp_extract_all(coalesce(text, ''), '{word}') as ws from src))),
tri as (select rid, i, w || ' ' || lead(w) over o || ' ' || lead(w, 2) over o as t
  from word window o as (partition by rid order by i)),
rep as (select rid, count(distinct p) as n_repeat_words from (
  select rid, unnest([i, i + 1, i + 2]) as p from (
    select rid, i, count(*) over (partition by rid, t) as n from tri where t is not null)
  where n > 1) group by rid),
line as (select rid, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines from (
  select rid, unnest(string_split(coalesce(text, ''), chr(10))) as l from src)
  where regexp_matches(l, '[^ \\t\\n\\x0B\\f\\r]') group by rid),
cnt as (select rid, count(*) as n_words, sum(length(w)) as word_chars from word group by rid),
m as (select src.rid, doc_id, coalesce(n_words, 0) as n_words,
  coalesce(word_chars, 0)::bigint as word_chars,
  length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words,
  length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) as n_upper,
  length(regexp_replace(coalesce(text, ''), '[^!]', '', 'g')) as n_bangs,
  length(regexp_replace(coalesce(text, ''), '[^.,]', '', 'g')) as n_stops
  from src left join cnt using (rid) left join rep using (rid) left join line using (rid)),
voted as materialized (select *, {BASE_FAILED} as base_failed, {', '.join(
        case(j, r) for j, r in enumerate(RULES.values()))} from m),
pat as materialized (select {', '.join(f'v{j}' for j in names)}, count(*)::double as n
  from voted where not base_failed group by all),
w0 as materialized (select {', '.join(f'ln({GUESS} / {1 - GUESS}) as w{j}' for j in names)})"""
    odds = " + ".join(f"v{j} * w{j}" for j in names)
    for k in range(rounds):
        new = ", ".join(
            f"coalesce(least({MOST}, greatest({LEAST}, sum(n * {'q' if vote > 0 else '(1 - q)'}) filter (v{j} != 0)"
            f" / sum(n) filter (v{j} != 0))), {GUESS}) as a{j}"
            for j, (vote, _) in enumerate(RULES.values()))
        sql += f""",
e{k} as materialized (select pat.*, 1 / (1 + exp(-({odds}))) as q from pat, w{k}),
a{k} as materialized (select {new} from e{k}),
w{k + 1} as materialized (select {', '.join(f'ln(a{j} / (1 - a{j})) as w{j}' for j in names)} from a{k})"""
    return sql.lstrip("\n") + f""",
judged as materialized (select voted.*, not base_failed and 1 / (1 + exp(-({odds}))) >= {KEEP_AT} as kept
  from voted, w{rounds})"""
