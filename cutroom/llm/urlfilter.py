"""URL filters: rules first, then naive Bayes on the words of host and path.

Names in hosts are written without spaces. A unigram model of the words of all pages splits them: Viterbi keeps, for each
end, the cheapest split that reaches it. Candidate pieces of the distinct names meet the word counts in a join, so
neither names nor words have to fit into one place.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from cutroom.session import settle, ship

#: Longest word of the unigram model, and longest name that DNS allows in a host: a longer run is one word as it stands.
LONGEST, NAME = 24, 63
#: Labelled urls that the classes are learned from, about, and the longest of them: both bound the model, nothing else.
FIT_ROWS, FIT_CHARS = 20_000, 2_000
#: Words a task holds before it sends their counts.
HELD = 200_000
#: Words that speak for themselves (fixed values): each counts like one of so many of its class's urls.
SEEDS = {
    "block": ("ads", "adult", "bet", "bets", "casino", "gambling", "pills", "poker", "porn", "spam", "viagra", "xxx"),
    "allow": ("docs", "encyclopedia", "library", "museum", "news", "school", "university"),
}
SEED_SHARE = 20
_WORD = re.compile(r"[^\W\d_]+|\d+")
_TAGS = r"<[^<>]*>|&[A-Za-z0-9#]+;"


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case, and ``0`` for a run of digits."""
    return ["0" if w[0].isdigit() else w for w in _WORD.findall(text.lower())]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lowered, and path of a url; both empty where it is null or has no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest of (verdict, host/path) that fits; null without one. Of equally long ones the first."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    told = lambda: pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())}, schema=schema)
    for batch in batches:
        for text in batch.column("text"):
            held.update(w for w in words_of(text.as_py()) if w != "0" and len(w) <= LONGEST)
            if len(held) > HELD:
                yield told()
                held = Counter()
    yield told()


def word_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all texts, mark-up left out; words longer than LONGEST are none."""
    ship(texts.sparkSession)
    text = F.regexp_replace(F.coalesce(texts[text_col].cast("string"), F.lit("")), _TAGS, " ")
    return texts.select(text.alias("text")).mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def segment(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The words that a name most likely consists of.

    A word costs -log(n / total); a piece of no word, log(10 * total) and log(10) more for each character. Of
    splits that cost alike the one with the longest last word stays.
    """
    costs, back = [0.0], [0]
    total = max(1, total)
    for end in range(1, len(name) + 1):
        best, cut = math.inf, 0
        for start in range(end):
            n = counts.get(name[start:end], 0)
            cost = costs[start] + (math.log(total / n) if n else math.log(10 * total) + (end - start) * math.log(10))
            if cost < best - 1e-9:
                best, cut = cost, start
        costs.append(best)
        back.append(cut)
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def segment_names(names: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(name, words) of distinct names; names and words meet piece by piece."""
    short = names.where(F.length("name") <= NAME)
    starts = short.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("start"))
    size = F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("name") - F.col("start") + 1))).alias("size")
    pieces = starts.select("name", "start", size).select("name", F.col("name").substr(F.col("start"), F.col("size")).alias("word"))
    known = pieces.distinct().join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    rows = names.join(known, "name", "left")

    @pandas_udf("array<string>")
    def split(held: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([[n] if k is None else segment(n, {p["word"]: p["n"] for p in k}, total) if len(n) <= NAME else [n] for n, k in zip(held, found, strict=True)])

    # a name without any known word is one word
    return rows.select("name", split("name", "known").alias("words"))


class Bayes:
    """Log odds of block against allow by word, and before any word."""

    def __init__(self, rows: dict[str, int], counts: dict[str, Counter]):
        for verdict, words in SEEDS.items():
            for word in words if rows.get(verdict) else ():
                counts.setdefault(verdict, Counter())[word] += math.ceil(rows[verdict] / SEED_SHARE)
        block, allow = counts.get("block", Counter()), counts.get("allow", Counter())
        both = {*block, *allow}
        n_block, n_allow = block.total() + len(both), allow.total() + len(both)
        self.odds = {w: math.log((block[w] + 1) / n_block) - math.log((allow[w] + 1) / n_allow) for w in both}
        self.prior = math.log((rows.get("block", 0) + 1) / (rows.get("allow", 0) + 1))

    def score(self, words: list[str]) -> float:
        """Probability that a url of these words is to be blocked; words that were never met say nothing."""
        odds = self.prior + sum(self.odds.get(w, 0.0) for w in words)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Bayes:
    """The classes of about fit_rows of the distinct (host, path, words, verdict) rows, by a hash of the url: all of them where there are fewer."""
    rows = labelled.where(F.length("host") + F.length("path") <= FIT_CHARS).groupBy("host", "path").agg(F.first("words").alias("words"), F.first("verdict").alias("verdict"))
    there = rows.count()
    place = F.pmod(F.xxhash64("host", "path"), F.lit(1_000_000))
    sample = rows.where(place < math.ceil(fit_rows * 1e6 / max(1, there))).select("words", "path", "verdict")
    n: Counter = Counter()
    counts: dict[str, Counter] = {}
    for row in sample.toLocalIterator():  # about FIT_ROWS urls of at most FIT_CHARS characters
        n[row.verdict] += 1
        counts.setdefault(row.verdict, Counter()).update([*row.words, *words_of(row.path)])
    return Bayes(n, counts)


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", id_col: str = "page_id", text_col: str = "html", fit_rows: int = FIT_ROWS
) -> DataFrame:
    """A verdict on every url, and what it rests on.

    Returns id_col, host, path, rule (the longest (verdict, host/path) rule that fits, else null), verdict (the rule's;
    else ``block`` where the words of host and path make that likelier than not, else ``allow``), score (that
    likelihood, for all), words (of the host). The classes are learned from urls that a rule decides, and words from
    text_col of all pages. rules are a configuration, few enough to be an expression.

    A null url and one without ``://`` have an empty host and path, which no rule fits; without any word the score is
    the classes' own, and ``allow`` where nothing was learned. Repeated rows are judged each; other columns are
    ignored, clashing names included. An empty table gives no rows.
    """
    spark = pages.sparkSession
    ship(spark)
    host, path = split_url(pages[url_col])
    rows = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("ruled"))
    hosts = rows.select("host").distinct()
    names = hosts.select("host", F.posexplode(F.regexp_extract_all(F.lower("host"), F.lit(r"\p{L}+|\p{Nd}+"), F.lit(0))).alias("place", "name"))
    counts = settle(word_counts(pages, text_col))
    total = counts.agg(F.sum("n")).first()[0] or 0
    letters = names.where(F.rlike("name", F.lit(r"^\p{L}"))).select("name").distinct()
    split = names.join(segment_names(letters, counts, total), "name", "left").select("host", "place", F.coalesce("words", F.array(F.lit("0"))).alias("words"))
    split = split.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "words"))), lambda s: s["words"])).alias("words"))
    split = settle(split)
    rows = rows.join(split, "host", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    model = fit(rows.where("ruled is not null").select("host", "path", "words", F.col("ruled.verdict").alias("verdict")), fit_rows)
    shared = spark.sparkContext.broadcast(model)  # bounded by FIT_ROWS and FIT_CHARS

    @pandas_udf("double")
    def score(words: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series(np.array([shared.value.score([*w, *words_of(p)]) for w, p in zip(words, paths, strict=True)], float))

    verdict = F.coalesce("ruled.verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    scored = rows.select("id", "host", "path", "ruled", "words", score("words", "path").alias("score"))
    return scored.select(F.col("id").alias(id_col), "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), "score", "words")
