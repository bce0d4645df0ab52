"""Toxicity of text behind leetspeak, spacing and repetition.

A character language model is counted over all texts and stays a table in Spark, whole. Stretches that look disguised (letters next to
digits or signs, letters spaced out, a letter three times over) are read as lattices: every character
stands for the letters it may have been written for, separators and repeats may be deleted, and a Viterbi
search finds the likeliest word under the language model. Distinct stretches are decoded in buckets, each
with the grams that its lattices ask for, and joined back to their texts. The restored words join the plain ones, and a
model of word rates learned from labelled texts scores them.
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

from cutroom.llm.words import grams_of
from cutroom.session import settle, ship

#: Characters of a language-model gram; shorter ones back it off.
ORDER = 4
#: Characters of distinct stretches that are decoded together, about.
BUCKET_CHARS = 30_000
#: Labelled rows the classifier is fitted on, about; all of them where there are fewer.
FIT_ROWS = 20_000
#: Least log likelihood ratio, and toxic texts, of an item (a word or a beginning of words) that the classifier uses.
LEAST_GAIN, LEAST_TEXTS = 4.0, 3
PREFIXES = (4, 5, 6, 7)
CACHE_ENTRIES = 150_000

#: The letters that a digit or sign is written for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou",
}
_SIGN = "".join(re.escape(c) for c in LEET)
_LETTER = r"[^\W\d_]"
_WORD = re.compile(rf"{_LETTER}+")
#: A letter beside a sign inside a word, or three letters alike: where a disguised word is.
_ANCHOR = re.compile(rf"{_LETTER}[0-9@$|+*€(](?={_LETTER}|[0-9@$!|+€])|[0-9@$|+!€(]{_LETTER}|({_LETTER})\1\1")
#: Single characters with one separator between any two.
_SPACED = re.compile(rf"(?<![\w@$])(?:{_LETTER}|[0-9@$!|])(?:[ .\-_*](?:{_LETTER}|[0-9@$!|])(?![\w@$])){{2,}}")
_INSIDE = re.compile(rf"(?:{_LETTER}|[{_SIGN}])*")
_SEPARATORS = " .-_*"
#: Log costs of the channel.
SIGN_COST, DROP_REPEAT, DROP_DOUBLE, DROP_SEPARATOR, KEEP_SEPARATOR = 0.7, 0.4, 6.0, 0.2, 2.5
#: Log odds that the length of a text can cost at most, so that plain evidence counts in long ones too.
LENGTH_COST = 7.0


def plain_words(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return _WORD.findall(text.lower())


def disguised(text: str) -> list[str]:
    """The stretches of a text in lower case that look disguised."""
    found: list[str] = []
    done = -1
    for anchor in _ANCHOR.finditer(text):
        if anchor.start() < done:
            continue
        start = anchor.start()
        while start > max(done, 0) and (text[start - 1] in LEET or text[start - 1].isalpha()):
            start -= 1
        done = max(_INSIDE.match(text, start).end(), anchor.end())
        for part in re.split(r"([^\w])\1{2,}", text[start:done])[::2]:  # three signs alike only decorate
            core = part.strip("!*(+|")
            if len(core) > 2:
                found.append(core)
    for spaced in _SPACED.finditer(text):
        found.append(spaced[0])
    return found


class CharacterModel:
    """Probability of a letter after the ones before it, from counts of grams of up to ORDER characters."""

    def __init__(self, counts: dict[str, int], after: dict[str, int], letters: int):
        """after: for a context, the counts of all grams that are one letter longer."""
        self.counts, self.after, self.letters = counts, after, max(2, letters)
        self.known: dict[tuple[str, str], float] = {}

    def log_p(self, before: str, letter: str) -> float:
        key = (before, letter)
        found = self.known.get(key)
        if found is None:
            p = 1.0 / (10 * self.letters)
            for k in range(len(before) + 1):
                context = before[len(before) - k :]
                total = self.after.get(context, 0)
                # Witten-Bell with a fixed number of kinds: the longer context counts the more the more it was seen
                weight = total / (total + 5.0 * (k + 1))
                p = weight * (self.counts.get(context + letter, 0) / total if total else 0) + (1 - weight) * p
            if len(self.known) > CACHE_ENTRIES:
                self.known.clear()
            found = self.known[key] = math.log(p)
        return found


class Asked:
    """Stands for a model while a lattice is walked, and notes the grams and contexts that are asked for."""

    def __init__(self):
        self.grams: set[str] = set()

    def log_p(self, before: str, letter: str) -> float:
        for k in range(len(before) + 1):
            context = before[len(before) - k :]
            self.grams.add(context)
            self.grams.add(context + letter)
        return 0.0


class Grams:
    """The whole gram table, kept in Spark: gram, n and total (of the grams that are one letter longer)."""

    def __init__(self, table: DataFrame, letters: int):
        self.table, self.letters = table, letters

    def model(self, stretch: str) -> CharacterModel:
        """What one stretch's lattice asks for."""
        asked = Asked()
        Restorer(asked).decode(stretch)
        rows = self.table.where(F.col("gram").isin(*asked.grams)).collect()
        return CharacterModel({r.gram: r.n for r in rows}, {r.gram: r.total for r in rows}, self.letters)

    def restore(self, stretches: DataFrame) -> DataFrame:
        """stretch and words of each distinct stretch."""
        letters = self.letters
        distinct = settle(stretches.select("stretch").distinct())
        chars = distinct.agg(F.sum(F.length("stretch"))).first()[0] or 0
        buckets = chars // BUCKET_CHARS + 1
        held = distinct.withColumn("bucket", F.pmod(F.xxhash64("stretch"), F.lit(buckets)))

        def ask(frame: pd.DataFrame) -> pd.DataFrame:
            asked = Asked()
            walker = Restorer(asked)
            for stretch in frame.stretch:
                walker.decode(stretch)
            return pd.DataFrame({"bucket": frame.bucket.iloc[0], "gram": sorted(asked.grams)})

        def decode(stretches: pd.DataFrame, grams: pd.DataFrame) -> pd.DataFrame:
            model = CharacterModel(dict(zip(grams.gram, grams.n, strict=True)), dict(zip(grams.gram, grams.total, strict=True)), letters)
            restorer = Restorer(model)
            return pd.DataFrame({"stretch": stretches.stretch, "words": [list(restorer.decode(s)) for s in stretches.stretch]})

        asked = held.groupBy("bucket").applyInPandas(ask, "bucket long, gram string")
        found = asked.join(self.table, "gram").select("bucket", "gram", "n", "total")
        return settle(held.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInPandas(decode, "stretch string, words array<string>"))


class Restorer(dict):
    """Likeliest words behind disguised stretches, kept by stretch."""

    def __init__(self, model: CharacterModel | Grams | Asked):
        super().__init__()
        self.model = model

    def __missing__(self, stretch: str) -> tuple[str, ...]:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        self[stretch] = words = self.decode(stretch)
        return words

    def decode(self, stretch: str) -> tuple[str, ...]:
        """Viterbi over the lattice; a state is the last ORDER - 1 characters of the output."""
        model = self.model.model(stretch) if isinstance(self.model, Grams) else self.model
        log_p, depth = model.log_p, ORDER - 1
        # state -> (log probability, link to the letters so far)
        states: dict[str, tuple[float, tuple | None]] = {" ": (0.0, None)}
        before = ""
        spaced = len(stretch) > 2 and all(c in _SEPARATORS for c in stretch[1::2])
        for place, char in enumerate(stretch):
            new: dict[str, tuple[float, tuple | None]] = {}
            separator = spaced and place % 2 == 1
            choices = [] if separator else [(c, SIGN_COST if char in LEET else 0.0) for c in LEET.get(char, char)]
            drop = DROP_SEPARATOR if separator else None
            if char == before and not separator:
                drop = DROP_REPEAT if char * 3 in stretch or spaced else DROP_DOUBLE
            for state, (score, link) in states.items():
                if separator:
                    choices = [(" ", KEEP_SEPARATOR)] if state[-1] != " " else []
                for letter, cost in choices:
                    value = score - cost + log_p(state, letter)
                    key = (state + letter)[-depth:]
                    if key not in new or value > new[key][0]:
                        new[key] = (value, (letter, link))
                if drop is not None and (state not in new or score - drop > new[state][0]):
                    new[state] = (score - drop, link)
            states, before = new, before if separator else char
        best = max(states, key=lambda s: states[s][0] + (log_p(s, " ") if s[-1] != " " else 0.0))
        out, link = [], states[best][1]
        while link is not None:
            out.append(link[0])
            link = link[1]
        return tuple("".join(reversed(out)).split())

    def hidden_words(self, text: str) -> list[str]:
        """Words behind the disguised stretches of a text in lower case."""
        return [word for stretch in disguised(text) for word in self[stretch]]

    def words(self, text: str | None) -> list[str]:
        """The plain words of a text, then the hidden ones."""
        low = (text or "").lower()
        return _WORD.findall(low) + self.hidden_words(low)


class RateModel:
    """Log odds of toxicity from the rates of words, each by itself if seen or by its longest learned beginning."""

    def __init__(self, items: dict[str, float], words: dict[str, float], per_word: float, prior: float):
        self.items, self.words, self.per_word, self.prior = items, words, per_word, prior
        self.sizes = tuple(sorted((n for n in PREFIXES if any(len(i) == n + 1 for i in items)), reverse=True))

    def weight(self, word: str) -> float:
        found = self.words.get(word)
        if found is not None:
            return found
        for size in self.sizes:
            if len(word) >= size and (found := self.items.get(f"^{word[:size]}")) is not None:
                return found
        return 0.0


class Weights(dict):
    def __init__(self, model: RateModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        self[word] = value = self.model.weight(word)
        return value

    def total(self, words: list[str]) -> dict[str, float]:
        return {"weight": float(sum(map(self.__getitem__, words))), "words": len(words)}


def items_of(words: list[str]) -> set[str]:
    """Words, marked with =, and their beginnings, marked with ^."""
    found = {f"={w}" for w in words}
    for word in set(words):
        found.update(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)
    return found


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words: Counter = Counter()
        for text in batch.column("text"):
            words.update(plain_words(text.as_py() or ""))
        for _, grams, counts in grams_of(words, ORDER):
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(counts, pa.int64())], ["gram", "n"])


def _disguised_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [disguised((t.as_py() or "").lower()) for t in batch.column("text")]
        some = [k for k, stretches in enumerate(found) if stretches]
        yield pa.RecordBatch.from_arrays(
            [batch.column("text_key").take(pa.array(some, pa.int64())), pa.array([found[k] for k in some], pa.list_(pa.string()))], ["text_key", "stretches"]
        )


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _stretches(docs: DataFrame, text_col: str) -> DataFrame:
    """text_key and stretch of each disguised stretch of each distinct text, as often as it is there."""
    texts = docs.select(_text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text")).where("text is not null")
    found = texts.mapInArrow(_disguised_batches, "text_key binary, stretches array<string>").groupBy("text_key").agg(F.first("stretches").alias("stretches"))
    return settle(found).select("text_key", F.explode("stretches").alias("stretch"))


def fit_characters(docs: DataFrame, text_col: str = "text") -> Grams:
    """Counts of all grams over all texts."""
    ship(docs.sparkSession)
    counts = settle(  # at most the alphabet to the power of ORDER
        docs.select(F.col(text_col).alias("text")).where("text is not null")
        .mapInArrow(_gram_batches, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    )
    context = F.expr("substring(gram, 1, length(gram) - 1)")
    both = counts.select("gram", "n", F.lit(0).cast("long").alias("total")).unionByName(counts.select(context.alias("gram"), F.lit(0).cast("long").alias("n"), F.col("n").alias("total")))
    table = settle(both.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    return Grams(table, counts.where(F.length("gram") == 1).count())


def _gain(t: np.ndarray, c: np.ndarray, nt: float, nc: float) -> np.ndarray:
    """Log likelihood ratio of presence in t of nt toxic and c of nc clean texts; 0 where clean has the greater share."""
    def part(k, n, p):  # noqa: ANN001, ANN202
        return k * np.log(np.clip(p, 1e-12, 1)) + (n - k) * np.log(np.clip(1 - p, 1e-12, 1))

    both = (t + c) / (nt + nc)
    gain = part(t, nt, t / nt) + part(c, nc, c / nc) - part(t, nt, both) - part(c, nc, both)
    return np.where(t / nt > c / nc, gain, 0.0)


def _cover(rows: list[tuple[int, set[int]]], size: int, needed: int = 2) -> list[int]:
    """Items that tell toxic texts apart, the best first; a text with needed of them asks for no more."""
    toxic = [items for label, items in rows if label]
    clean = [items for label, items in rows if not label]
    t, c = np.zeros(size), np.zeros(size)
    for items in clean:
        c[list(items)] += 1
    for items in toxic:
        t[list(items)] += 1
    open_texts, chosen, hits = list(range(len(toxic))), [], Counter()
    blocked = np.zeros(size, bool)
    while open_texts:
        gain = _gain(np.minimum(t, len(toxic)), c, max(1, len(toxic)), max(1, len(clean)))
        gain[blocked] = 0
        best = int(np.argmax(gain))
        if gain[best] < LEAST_GAIN or t[best] < LEAST_TEXTS:
            break
        chosen.append(best)
        blocked[best] = True
        left = []
        for k in open_texts:
            hits[k] += best in toxic[k]
            if hits[k] >= needed:
                t[list(toxic[k])] -= 1
            else:
                left.append(k)
        open_texts = left
    return chosen


def fit(labelled: DataFrame, characters: Grams, text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> RateModel:
    """A rate model of labelled texts (label 0 or 1), of about fit_rows of them if there are more.

    The sample takes rows by a hash of their text; equal texts with equal labels count once. With no toxic
    or no clean text the model knows only the share of either.
    """
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).where("text is not null and label in (0, 1)")
    there = rows.count()
    if there > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < math.ceil(1e6 * fit_rows / there))
    rows = rows.dropDuplicates()
    rows = settle(rows)
    found = _stretches(rows, "text")
    behind = found.join(characters.restore(found), "stretch").groupBy("text_key").agg(F.flatten(F.collect_list("words")).alias("hidden"))
    rows = rows.withColumn("text_key", _text_key(F.col("text"))).join(behind, "text_key", "left").select("label", "text", "hidden")

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_pylist()
            words = [plain_words(t.lower()) + (h or []) for t, h in zip(batch.column("text").to_pylist(), batch.column("hidden").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict(
                {"label": pa.array(labels, pa.int32()), "words": pa.array(words, pa.list_(pa.string())), "items": pa.array([sorted(items_of(w)) for w in words], pa.list_(pa.string()))}
            )

    texts = rows.mapInArrow(restored, "label int, words array<string>, items array<string>").persist()
    sums = {r.label: (r.texts, r["words"]) for r in texts.groupBy("label").agg(F.count("*").alias("texts"), F.sum(F.size("words")).alias("words")).collect()}
    (nt, wt), (nc, wc) = sums.get(1, (0, 0)), sums.get(0, (0, 0))
    prior = math.log((nt + 0.5) / (nc + 0.5))
    if not nt or not nc:
        texts.unpersist()
        return RateModel({}, {}, 0.0, prior)
    item = texts.select("label", F.explode("items").alias("item")).groupBy("item").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    share = (F.col("t") / nt) / (F.col("c") / nc + F.lit(1.0 / nc))

    def part(k: Column, n: float, p: Column) -> Column:
        return k * F.ln(F.greatest(p, F.lit(1e-12))) + (n - k) * F.ln(F.greatest(1 - p, F.lit(1e-12)))

    # as in _gain; texts that are covered only lower an item's gain, so the rest can never be chosen
    t, c = F.col("t"), F.col("c")
    both = (t + c) / (nt + nc)
    gain = part(t, nt, t / nt) + part(c, nc, c / nc) - part(t, nt, both) - part(c, nc, both)
    top = item.where((t >= LEAST_TEXTS) & (share > 1.3) & (gain >= LEAST_GAIN - 1e-6)).orderBy(F.desc(t / nt * F.ln(share)), "item").collect()  # of FIT_ROWS texts
    index = {r["item"]: k for k, r in enumerate(top)}
    named = spark.sparkContext.broadcast(index)

    def listed(items: pd.Series) -> pd.Series:
        return items.map(lambda x: [named.value[i] for i in x if i in named.value])

    places = texts.select("label", pandas_udf(listed, "array<int>")("items").alias("at")).collect()  # FIT_ROWS rows of small numbers
    chosen = [top[k]["item"] for k in _cover([(r.label, set(r["at"])) for r in places], len(index))]
    prefixes = sorted({i for i in chosen if i[0] == "^"})
    whole = sorted({i[1:] for i in chosen if i[0] == "="})
    word = F.explode("words").alias("word")
    begins = F.lit(False)
    for n in PREFIXES:
        begins = begins | F.concat(F.lit("^"), F.substring("word", 1, n)).isin(*[p for p in prefixes if len(p) == n + 1])
    counts = (
        texts.select("label", word).where(begins | F.col("word").isin(*whole)).groupBy("word").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
        .orderBy(F.desc(F.col("t") + F.col("c")), "word").collect()  # words of FIT_ROWS texts that a chosen item covers
    )
    texts.unpersist()
    # a beginning's own ratio is that of its words; a word's leans on it by what three words would show
    ratio = lambda t, c: (t + 0.5) / (wt + 1.0) / ((c + 0.5) / (wc + 1.0))
    sum_t, sum_c = Counter(), Counter()
    owner: dict[str, str] = {}
    for r in counts:
        own = next((p for n in sorted(PREFIXES, reverse=True) if (p := f"^{r.word[:n]}") in prefixes and len(r.word) >= n), None)
        if own and r.word not in whole:
            owner[r.word] = own
            sum_t[own] += r.t
            sum_c[own] += r.c
    items = {p: math.log(ratio(sum_t[p], sum_c[p])) for p in prefixes}
    words, toxic_rate, clean_rate = {}, 0.0, 0.0
    for r in counts:
        base = math.exp(items[owner[r.word]]) if r.word in owner else 1.0
        lean = 3.0 if r.word in owner else 0.5
        expected = wt / wc
        words[r.word] = math.log((r.t + lean * base * expected / (1 + base * expected)) / wt / ((r.c + lean / (1 + base * expected)) / wc))
        toxic_rate += r.t / wt
        clean_rate += r.c / wc
    return RateModel(items, words, max(0.0, toxic_rate - clean_rate), prior)


def score_documents(docs: DataFrame, characters: Grams, rates: RateModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows with score (0 to 1, higher: likelier toxic) and predicted (1 from the threshold on) added.

    A null or empty text has the score of no words, the share of toxic texts. Repeated rows are scored each;
    columns named score or predicted are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(rates)

    def plain(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights = Weights(shared.value)
        for texts in batches:
            yield pd.DataFrame([weights.total(plain_words(t or "")) for t in texts], columns=["weight", "words"]).astype({"weight": "float64", "words": "int64"})

    def hidden(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights = Weights(shared.value)
        for lists in batches:
            yield pd.DataFrame([weights.total(list(words)) for words in lists], columns=["weight", "words"]).astype({"weight": "float64", "words": "int64"})

    kind = "weight double, words long"
    found = _stretches(docs, text_col)
    restored = characters.restore(found).select("stretch", pandas_udf(hidden, kind)("words").alias("h"))
    behind = settle(found.join(restored, "stretch").groupBy("text_key").agg(F.sum("h.weight").alias("_weight"), F.sum("h.words").alias("_words")).withColumnRenamed("text_key", "_key"))
    # names of their own, so that none can clash, and a column each, so that what the caller drops is not moved
    columns = {f"_c{i}": c for i, c in enumerate(docs.columns) if c not in ("score", "predicted")}
    marked = docs.select(*[docs[c].alias(own) for own, c in columns.items()], _text_key(docs[text_col]).alias("_own_key"), pandas_udf(plain, kind)(docs[text_col]).alias("_plain"))
    joined = marked.join(behind, F.col("_own_key") == F.col("_key"), "left")
    words = F.col("_plain.words") + F.coalesce("_words", F.lit(0))
    odds = rates.prior + F.col("_plain.weight") + F.coalesce("_weight", F.lit(0.0)) - F.least(F.lit(LENGTH_COST), words * rates.per_word)
    score = 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))
    scored = joined.select(*columns, score.alias("_score"))
    return scored.select(*[F.col(own).alias(c) for own, c in columns.items()], F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))
