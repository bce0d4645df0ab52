"""How the sources of a language differ in the terms they use, in exact arithmetic.

Tasks count terms of whole texts and send sums of what they have met. Each kept term then becomes one wide row: an
array with a place for every source of its language. Higher-order functions give a term's contributions to the
pairs of sources that it tells apart, and map-side sums add them up; terms that neither source of a pair has
contribute alike, so they are counted and multiplied rather than emitted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutroom.session import settle, ship

#: Parts in 1,000,000,000 that a term's share is told in, and what is added to each count before.
SCALE, ADDED = 1_000_000_000, 2
LEAST_DOCS = 10
TOP_TERMS = 10
#: Entries that a task holds before it sends their sums.
HELD = 200_000
#: (lang, source) groups up to which the table of languages is sent to every task; beyond, it is joined by shuffle.
SENT_GROUPS = 20_000
#: Terms are runs of ASCII letters, A-Z lowered, and of whatever is not ASCII; all other bytes part them.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order, in UTF-8."""
    return text.encode("utf-8", "replace").translate(_TERM).split()


def _sums(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in held.items():
        terms = list(n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(terms), pa.string()),
                pa.array([source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array([n[t] for t in terms], pa.int64()),
                pa.array([docs[t] for t in terms], pa.int64()),
            ],
            schema=_COUNTS,
        )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term), summed over what a task has read so far."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
            n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            terms = terms_of(text.as_py())
            size -= len(n)
            n.update(terms)
            size += len(n)
            docs.update(set(terms))
            if size > HELD:
                yield from _sums(held)
                held, size = {}, 0
    yield from _sums(held)


def _share(n: str, total: str) -> str:
    """1 + floor(SCALE * (n + ADDED) / total) by long division, three digits at a time: whole numbers that fit as long as the counts do."""
    left = f"(({n}) + {ADDED})"
    out = f"1 + {left} div ({total}) * {SCALE}"
    for unit in (1_000_000, 1_000, 1):
        left = f"({left} % ({total}) * 1000)"
        out += f" + {left} div ({total}) * {unit}"
    return f"({out})"


def _apart(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def count_terms(docs: DataFrame, least_docs: int, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, term, n, posts) of the terms in at least that many documents of their language; posts: (source, n) of each source that has it."""
    ship(docs.sparkSession)
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counts = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # one shuffle serves both groups: rows of a term stay together when sources are summed
    counts = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("posts"))
    return terms.where(F.col("docs") >= least_docs).select("lang", "term", "n", "posts")


def audit_sources(
    docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """Distances between the sources of each language, and the terms that set a source apart from its language.

    Returns lang, source, part, item, value, rank. Part ``pair``: item is each other source of the language.
    Part ``term``: item is a term the source uses more than its language, the top ones. Ranks start at 1 in each
    group and part, by value from the greatest and then by item in order of UTF-8.

    Null texts, languages and sources are empty ones; a source without terms is a group like any other, and where a
    language keeps no term all its distances are 0. A language of one source has no pairs. Each row is a document,
    repeated ones too; other columns are ignored, clashing names included. An empty table gives no rows.
    """
    kept = settle(count_terms(docs, least_docs, text_col, lang_col, source_col))
    name = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    groups = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source")).distinct()
    own = kept.select("lang", F.explode("posts").alias("post")).groupBy("lang", F.col("post.source").alias("source")).agg(F.sum("post.n").alias("total"))
    groups = groups.join(own, ["lang", "source"], "left").na.fill(0, ["total"])
    langs = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("groups"))
    whole = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_total"))
    langs = settle(langs.join(whole, "lang", "left").na.fill(0, ["v", "lang_total"]))
    few = langs.agg(F.sum(F.size("groups"))).first()[0] or 0

    wide = kept.join(F.broadcast(langs) if few <= SENT_GROUPS else langs, "lang")
    wide = wide.withColumn("at", F.map_from_entries("posts"))
    wide = wide.withColumn("counts", F.transform("groups", lambda g: F.struct(g["source"].alias("source"), F.coalesce(F.try_element_at("at", g["source"]), F.lit(0)).alias("n"), g["total"].alias("total"))))
    wide = wide.select("lang", "term", F.expr(_share("n", "lang_total + 2 * v")).alias("q"), F.expr(f"transform(counts, g -> struct(g.source as source, g.n as n, {_share('g.n', 'g.total + 2 * v')} as p))").alias("w"))

    met = wide.select("lang", F.explode(F.expr(
        "flatten(transform(w, (x, i) -> filter(transform(slice(w, i + 2, size(w)), (y, j) -> "
        f"if(x.n + y.n > 0, struct(i as a, i + 1 + j as b, {_apart('x.p', 'y.p')} as f), null)), z -> z is not null)))"
    )).alias("z"))
    met = met.groupBy("lang", F.col("z.a").alias("a"), F.col("z.b").alias("b")).agg(F.sum("z.f").alias("f"), F.count(F.lit(1)).alias("met"))
    return _pairs(langs, met).unionByName(_terms(wide, top))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(best).alias("rank"))


def _pairs(langs: DataFrame, met: DataFrame) -> DataFrame:
    """Every two sources of a language; terms that neither has are as many as are left, each at the distance of two counts of 0."""
    first = langs.select("lang", "v", "groups", F.posexplode("groups").alias("a", "x"))
    both = first.select("lang", "v", "a", "x", F.posexplode(F.expr("slice(groups, a + 2, size(groups))")).alias("j", "y"))
    both = both.select("lang", "v", "a", (F.col("a") + 1 + F.col("j")).alias("b"), "x", "y")
    none: Column = F.expr(_apart(_share("0", "greatest(1, x.total + 2 * v)"), _share("0", "greatest(1, y.total + 2 * v)")))
    told = both.join(met, ["lang", "a", "b"], "left").select(
        "lang", "x", "y", (F.coalesce("f", F.lit(0)) + (F.col("v") - F.coalesce("met", F.lit(0))) * F.when(F.col("v") > 0, none).otherwise(0)).cast("long").alias("value")
    )
    sides = told.select("lang", "value", F.explode(F.array(F.struct(F.col("x.source").alias("source"), F.col("y.source").alias("item")), F.struct(F.col("y.source").alias("source"), F.col("x.source").alias("item")))).alias("s"))
    return _ranked(sides.select("lang", "s.source", "s.item", "value"), "pair")


def _terms(wide: DataFrame, top: int) -> DataFrame:
    above = wide.select("lang", "term", "q", F.explode(F.expr("filter(w, g -> g.n > 0 and g.p > q)")).alias("g"))
    rows = above.select("lang", F.col("g.source").alias("source"), F.col("term").alias("item"), F.expr(_apart("g.p", "q")).cast("long").alias("value"))
    return _ranked(rows, "term").where(F.col("rank") <= top)
