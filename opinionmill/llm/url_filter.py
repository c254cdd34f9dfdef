"""URL filters: listed rules first, then word segmentation and naive Bayes.

Host labels written together are split by a unigram Viterbi: word counts come from
all page texts, unknown strings are charged by length. The words of host and path
go to a multinomial naive Bayes model. Its classes are taught by a short list of
telling words (``SEEDS``): a url with one of them in its segmented host counts as
an example to block, any other as one to allow; the model then weighs every token,
so words that keep such company block as well.

Counts run over all rows as Spark aggregates; only the most frequent
``VOCABULARY`` words and tokens go to the tasks, a bound of the model's size. Each
url is judged in one pass without a shuffle, segmented hosts being kept in a
bounded cache per task.

Defined results: a null url or one without ``://`` has empty host and path, no
rule, and is judged on the class prior; repeated rows are judged alike; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = 50_000
LONGEST = 24
#: Words that mark a host to be blocked.
SEEDS = ("adult", "ads", "bet", "bets", "betting", "casino", "pills", "poker", "porn",
         "sex", "spam", "viagra", "warez", "xxx")
#: The query's rules, host and path together.
RULES = {
    "org/": "allow", "example.org/es/": "block", "example.org/en/1": "block",
    "com/fr/": "allow", "com/de/": "block",
}
_WORD = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return host.translate(_LOWER), path


class Rules:
    """Host-suffix rules; the longest rule that fits decides."""

    def __init__(self, rules: dict[str, str]) -> None:
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for rule in sorted(rules, key=lambda r: (-len(r), r)):
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule))
        self.verdicts = rules

    def find(self, host: str, path: str) -> str | None:
        best = None
        labels = host.split(".")
        for i in range(len(labels)):
            for prefix, rule in self.by_host.get(".".join(labels[i:]), ()):
                if path.startswith(prefix):
                    if best is None or len(rule) > len(best):
                        best = rule
                    break
        return best


class Segmenter:
    """Norvig-style unigram Viterbi over one run of letters."""

    def __init__(self, counts: dict[str, int]) -> None:
        total = float(sum(counts.values())) or 1.0
        self.cost = {w: -math.log(c / total) for w, c in counts.items()}
        self.unknown = math.log(total)

    def split(self, run: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(run) + 1):
            cost, at = math.inf, end - 1
            for start in range(max(0, end - LONGEST), end):
                word = run[start:end]
                c = best[start] + self.cost.get(word, self.unknown + 2.4 * len(word))
                if c < cost:
                    cost, at = c, start
            best.append(cost)
            back.append(at)
        words, end = [], len(run)
        while end:
            words.append(run[back[end]:end])
            end = back[end]
        return words[::-1]


def host_words(host: str, segmenter: Segmenter) -> list[str]:
    out = []
    for run in _WORD.findall(host):
        out += segmenter.split(run) if run[0].isalpha() and len(run) <= 256 else [run]
    return out


def tokens(host: str, path: str, split) -> list[str]:
    """Tagged tokens of a url: segmented host words, and path words without digits."""
    return [f"h:{w}" for w in split(host)] + [
        "p:#" if w.isdigit() else f"p:{w}" for w in _WORD.findall(path.translate(_LOWER))]


def _cached(segmenter: Segmenter):
    return lru_cache(maxsize=20_000)(lambda host: tuple(host_words(host, segmenter)))


def word_counts(pages: DataFrame, html: str = "html", size: int = VOCABULARY,
                seeds: tuple[str, ...] = SEEDS) -> dict[str, int]:
    """The ``size`` most frequent words of all page texts, and the seeds."""
    plain = F.regexp_replace(F.lower(F.col(html)), "<(script|style)[^>]*>[^<]*</[a-z]+>|<[^>]*>", " ")
    words = pages.where(F.col(html).isNotNull()).select(
        F.explode(F.split(plain, r"[^\p{L}]+")).alias("w")).where(
        (F.length("w") > 0) & (F.length("w") <= LONGEST))
    top = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect()
    counts = {r["w"]: r["count"] for r in top}
    floor = max(10, sum(counts.values()) // 20_000)
    return counts | {s: max(counts.get(s, 0), floor) for s in seeds}


class Bayes:
    """Multinomial naive Bayes; block when its log-odds are above 0."""

    def __init__(self, counts: list[tuple[str, int, int]], docs: tuple[int, int]) -> None:
        allow, block = (sum(c[i] for c in counts) for i in (1, 2))
        size = len(counts) + 1
        self.prior = math.log((docs[1] + 1) / (docs[0] + 1))
        self.weight = {
            t: math.log((b + 1) / (block + size)) - math.log((a + 1) / (allow + size))
            for t, a, b in counts}
        # an unseen token speaks for neither class
    def blocks(self, found: list[str]) -> bool:
        return self.prior + sum(self.weight.get(t, 0.0) for t in found) > 0


def filter_urls(pages: DataFrame, rules: dict[str, str] = RULES, page_id: str = "page_id",
                url: str = "url", html: str = "html", seeds: tuple[str, ...] = SEEDS,
                size: int = VOCABULARY) -> DataFrame:
    """``page_id, host, path, rule, verdict, host_words`` of every row."""
    sc = pages.sparkSession.sparkContext
    unigrams = sc.broadcast(word_counts(pages, html, size, seeds))  # at most size + seeds
    urls = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    marked = frozenset(seeds)

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _cached(Segmenter(unigrams.value))
        for batch in batches:
            seen: dict[tuple[str, int], int] = {}
            for x in batch.column(0).to_pylist():
                host, path = parts(x)
                found = tokens(host, path, split)
                block = int(not marked.isdisjoint(split(host)))
                for t in found:
                    seen[t, block] = seen.get((t, block), 0) + 1
                seen["", block] = seen.get(("", block), 0) + 1
            keys = list(seen)
            yield pa.record_batch({
                "token": pa.array([k[0] for k in keys], pa.string()),
                "block": pa.array([k[1] for k in keys], pa.int32()),
                "n": pa.array([seen[k] for k in keys], pa.int64())})

    taught = urls.select("url").mapInArrow(teach, "token string, block int, n bigint")
    per = taught.groupBy("token").agg(
        F.sum(F.when(F.col("block") == 0, F.col("n")).otherwise(0)).alias("allow"),
        F.sum(F.when(F.col("block") == 1, F.col("n")).otherwise(0)).alias("block"))
    rows = per.orderBy(F.col("token") != "", F.desc(F.col("allow") + F.col("block")), "token").limit(
        size + 1).collect()
    docs = next(((r["allow"], r["block"]) for r in rows if r["token"] == ""), (0, 0))
    model = sc.broadcast(Bayes([(r["token"], r["allow"], r["block"]) for r in rows if r["token"]], docs))
    kind = pages.schema[page_id].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, listed = _cached(Segmenter(unigrams.value)), Rules(rules)
        for batch in batches:
            hosts, paths, hit, verdict, words = [], [], [], [], []
            for x in batch.column(1).to_pylist():
                host, path = parts(x)
                rule = listed.find(host, path)
                hosts.append(host)
                paths.append(path)
                hit.append(rule)
                words.append(list(split(host)))
                verdict.append(listed.verdicts[rule] if rule else (
                    "block" if model.value.blocks(tokens(host, path, split)) else "allow"))
            yield pa.record_batch({
                "page_id": batch.column(0), "host": pa.array(hosts, pa.string()),
                "path": pa.array(paths, pa.string()), "rule": pa.array(hit, pa.string()),
                "verdict": pa.array(verdict, pa.string()),
                "host_words": pa.array(words, pa.list_(pa.string()))})

    return urls.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, "
                                  "verdict string, host_words array<string>")
