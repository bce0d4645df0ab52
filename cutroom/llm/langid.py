"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word is covered by character n-grams
from left to right: at each place the longest known n-gram counts, falling back to shorter ones, down to
single characters and a floor.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from cutroom.llm.words import grams_of
from cutroom.session import settle, ship

#: Distinct labelled texts of each language that the model is fitted on, about; all of them where there are fewer.
FIT_ROWS = 3_000
#: Words and n-grams met less often in a language's sample are left to shorter n-grams.
LEAST = 2
LONGEST = 4
CACHE_ENTRIES = 100_000
#: Words of a text that its score takes for independent, at most: words of one text repeat each other's evidence.
EVIDENCE = 50
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; signs that regular expressions take for word characters (½, ², Ⅷ) are none."""
    return [w for run in _WORDS.findall(text.lower()) for w in ((run,) if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, size, item, n): size 0 for words, else the length of an n-gram of the word between spaces."""
    for batch in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            words.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py() or ""))
        for lang, counts in words.items():
            for size, found, n in chain([(0, list(counts), np.fromiter(counts.values(), np.int64, len(counts)))], grams_of(counts, LONGEST)):
                yield pa.RecordBatch.from_pydict(
                    {"lang": [lang] * len(found), "size": pa.array([size] * len(found), pa.int32()), "item": found, "n": pa.array(n, pa.int64())},
                    schema=pa.schema([("lang", pa.string()), ("size", pa.int32()), ("item", pa.string()), ("n", pa.int64())]),
                )


class Model:
    """Log frequencies of items, a row of one value a language each; row 0 is that of a character never met."""

    def __init__(self, counts: list[tuple[str, int, str, int]], totals: dict[tuple[str, int], int]):
        self.langs = sorted({lang for lang, *_ in counts})
        place = {lang: i for i, lang in enumerate(self.langs)}
        held: dict[tuple[int, str], np.ndarray] = {}
        for lang, size, item, n in counts:
            held.setdefault((size, item), np.zeros(len(self.langs)))[place[lang]] += n
        total = np.array([[max(1, totals.get((lang, size), 0)) for lang in self.langs] for size in range(LONGEST + 1)], float)
        self.tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        self.rows = np.empty((len(held) + 1, len(self.langs)))
        self.rows[0] = np.log(0.5 / total[1])
        for k, ((size, item), n) in enumerate(held.items(), 1):
            self.tables[size][item] = k
            self.rows[k] = np.log((n + 0.5) / (total[size] + 1))

    def places(self, word: str) -> list[int]:
        """The row of a known word, or those of an unseen one's longest known n-grams from left to right."""
        known = self.tables[0].get(word)
        if known is not None:
            return [known]
        padded, at, out = f" {word} ", 0, []
        end = len(padded)
        while at < end:
            row = 0
            for size in range(min(LONGEST, end - at), 0, -1):
                row = self.tables[size].get(padded[at : at + size], 0)
                if row:
                    break
            out.append(row)
            at += max(1, size - 1)  # neighbours overlap by a character
        return out

    def score(self, words: list[str]) -> np.ndarray:
        """A row for each word: the mean over its places."""
        found = [self.places(word) for word in words]
        sizes = np.array([len(f) for f in found])
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        return np.add.reduceat(self.rows[flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]


class Scorer(dict):
    """Rows of word scores, kept by word."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.rows = np.zeros((0, len(model.langs)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text; new words are scored together."""
        split = [words_of(t or "") if self.model.langs else [] for t in texts]
        if len(self) > CACHE_ENTRIES:
            self.clear()
            self.rows = self.rows[:0]
        new = [w for w in set().union(*split) if w not in self]
        if new:
            self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, self.model.score(new)])
        return [self._best(words) if words else ("und", 0.0) for words in split]

    def _best(self, words: list[str]) -> tuple[str, float]:
        mean = self.rows[[self[word] for word in words]].mean(axis=0)
        weight = np.exp((mean - mean.max()) * min(len(words), EVIDENCE))
        best = int(np.argmax(mean))
        return self.model.langs[best], float(weight[best] / weight.sum())


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """A model of the rows that have a language: of about fit_rows distinct texts of each, or all if there are fewer.

    The sample takes distinct texts by a hash of text and language, so a text that fills many rows counts
    once and a rare language is learned as well as a frequent one. Every word and n-gram that a language's
    sample has LEAST times (once, if that is all it has) is kept; the model's size is bounded by the sample's.
    """
    ship(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    place = F.xxhash64("text", "lang")
    there = rows.select("lang", place.alias("place")).distinct().groupBy("lang").count()  # a row a language
    shares = there.select(F.col("lang").alias("_lang"), F.ceil(fit_rows * 1e6 / F.col("count")).alias("_share"))
    sample = rows.join(F.broadcast(shares), (F.col("lang") == F.col("_lang")) & (F.pmod(place, F.lit(1_000_000)) < F.col("_share")), "left_semi")
    sample = sample.groupBy("lang", place.alias("place")).agg(F.first("text").alias("text"))
    counts = settle(
        sample.mapInArrow(_count_batches, "lang string, size int, item string, n long").groupBy("lang", "size", "item").agg(F.sum("n").alias("n"))
    )
    sums = counts.groupBy("lang", "size").agg(F.sum("n").alias("total"), F.max("n").alias("most")).collect()
    rare = [(r.lang, r["size"]) for r in sums if r.most < LEAST]
    kept = counts.where((F.col("n") >= LEAST) | F.concat_ws(" ", "size", "lang").isin([f"{size} {lang}" for lang, size in rare]))
    return Model([(r.lang, r["size"], r["item"], r.n) for r in kept.collect()], {(r.lang, r["size"]): r.total for r in sums})


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows with lang_pred and score (0 to 1) added; columns of those names are replaced.

    A null text and one without letters are ``und`` with score 0, as is every text where nothing was
    learned. Languages that score alike: the first in order. Repeated rows are predicted each.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # the items of FIT_ROWS texts a language

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            held = texts.tolist()
            found = [row for at in range(0, len(held), 256) for row in scorer.predict(held[at : at + 256])]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    # not to be worked out again for each of its fields or for a filter on them
    predict = pandas_udf(predict, "struct<lang_pred: string, score: double>").asNondeterministic()
    row = F.struct(*[docs[c] for c in docs.columns if c not in ("lang_pred", "score")]).alias("row")  # no name of theirs can clash
    return docs.select(row, predict(docs[text_col]).alias("found")).select("row.*", "found.lang_pred", "found.score")


def held_out(id_col: str = "doc_id"):  # noqa: ANN201
    """Whether crc32 of the id, as text, leaves 1 on division by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
