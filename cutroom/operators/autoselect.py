"""Automatic selection of an episode: signals, suggestions, one a group, turns or scores within a budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cutroom.operators import intervals, windows
from cutroom.operators.selection import spans_for
from cutroom.session import ship

#: Fixed value: a focus at which a photo's score is half of the greatest.
SOFT_FOCUS = 60.0


def painted(moments: DataFrame, frames: DataFrame, keys: list[str], start: str, end: str, frame_t: str, interest: str) -> DataFrame:
    """Moments with the interest of the frame nearest to their middle, of equals the earlier; null without frames."""
    middle = moments.withColumn("_mid", F.floor((F.col(start) + F.col(end)) / 2))
    best = frames.groupBy(*keys, frame_t).agg(F.first(interest).alias(interest))
    return intervals.nearest(middle, best, keys, "_mid", frame_t, [interest]).drop("_mid", "matched_t").withColumnRenamed(f"matched_{interest}", "interest")


def spoken(moments: DataFrame, spans: DataFrame, keys: list[str], ident: str, start: str, end: str, span: tuple[str, str], bin_width: int) -> DataFrame:
    """Moments whose speech follows the transcript of their clip, where it has one: the ones that a span meets."""
    heard = intervals.overlapping(moments.select(*keys, ident, start, end), spans.select(*keys, *span), keys, bin_width, (start, end), span)
    met = heard.select(*keys, ident).distinct().withColumn("_met", F.lit(True))
    clips = spans.select(*keys).distinct().withColumn("_has", F.lit(True))
    both = moments.join(clips, keys, "left").join(met, [*keys, ident], "left")
    return both.withColumn("speech", F.when(F.col("_has"), F.coalesce("_met", F.lit(False))).otherwise(F.col("speech"))).drop("_has", "_met")


def suggestions(moments: DataFrame, keys: list[str], order: str, score: str, target: int, least: int, cut: str, most: int = 3) -> DataFrame:
    """Up to most stretches of each clip: of the target length without a cut inside, halved down to the least while
    there is none; then of the target length with cuts. Returns keys, rank, order (the first moment), score, span."""
    tries = [(span, wall) for wall in (cut, None) for span in spans_for(target, least)]
    kind = "struct<try:int,span:int,mean:double>"
    means = [windows.mean_ahead(keys, order, score, span, cut=wall) for span, wall in tries]
    # all lengths in one pass over the clip's line, then the first try that found any
    found = [F.when(m.isNotNull(), F.struct(F.lit(n).alias("try"), F.lit(span).alias("span"), m.alias("mean")).cast(kind)) for n, ((span, _), m) in enumerate(zip(tries, means, strict=True))]
    every = moments.select(*keys, F.col(order).alias("_s"), F.array(*found).alias("_f")).select(*keys, "_s", F.explode(F.array_compact("_f")).alias("_f"))
    chosen = every.withColumn("_first", F.min("_f.try").over(Window.partitionBy(*keys))).where(F.col("_f.try") == F.col("_first"))
    rows = chosen.select(*keys, "_s", F.col("_f.mean").alias("_m"), F.col("_f.span").alias("span"))
    top = windows.suppressed_top(rows, keys, "_s", "_m", "span", most)
    spans = rows.groupBy(*keys).agg(F.max("span").alias("span"))
    return top.join(spans, keys).select(*keys, "rank", F.col("_s").alias(order), F.col("_m").alias(score), "span")


def photo_score(focus: Column) -> Column:
    """0 to 100 by mean focus."""
    return 100.0 * focus / (focus + SOFT_FOCUS)


def one_a_group(candidates: DataFrame, keys: list[str], group: str, ident: str, score: str) -> DataFrame:
    """The best candidate of each similar group, of equals the smaller id; those in no group all stay. An aggregate, not a window."""
    rest = [c for c in candidates.columns if c not in (*keys, group)]
    best = candidates.where(F.col(group).isNotNull()).groupBy(*keys, group).agg(F.min_by(F.struct(*rest), F.struct((-F.col(score)).alias("m"), F.col(ident).alias("i"))).alias("_r"))
    return best.select(*keys, group, "_r.*").select(*candidates.columns).unionByName(candidates.where(F.col(group).isNull()))


def take_turns(candidates: DataFrame, episode: str, chapter: str, chapter_rank: str, ident: str, score: str, seconds: str, budget: float) -> DataFrame:
    """Candidates of each episode picked chapter by chapter in turns, the best first, while they fit.

    A chapter's turn goes on to its next candidate that fits; what does not is passed over for good. The fold
    is one task an episode, whose candidates are one a clip. Returns episode, ident, place (from 1).
    """
    ship(candidates.sparkSession)
    kinds = dict(candidates.dtypes)

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([chapter_rank, chapter, score, ident], ascending=[True, True, False, True], na_position="last", kind="stable")
        queues = [list(zip(part[ident], part[seconds], strict=True)) for _, part in frame.groupby([chapter_rank, chapter], sort=False, dropna=False)]
        waiting = [iter(queue) for queue in queues]
        total, picked, going = 0.0, [], True
        while going:
            going = False
            for queue in waiting:
                for who, long in queue:
                    if total + long <= budget + 1e-9:
                        total += long
                        picked.append(who)
                        going = True
                        break
        return pd.DataFrame({episode: frame[episode].iloc[0], ident: picked, "place": range(1, len(picked) + 1)})

    return candidates.groupBy(episode).applyInPandas(pick, f"{episode} {kinds[episode]}, {ident} {kinds[ident]}, place long")


def with_fallback(chosen: DataFrame, wider: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each key from the first table, and of keys that it has none of, from the second."""
    return chosen.withColumn("fallback", F.lit(False)).unionByName(wider.join(chosen.select(*keys).distinct(), keys, "left_anti").withColumn("fallback", F.lit(True)))


def reweighted(parts: dict[str, tuple[Column, float]], bias: dict[str, float], kept: set[str]) -> Column:
    """A mean of the parts by weights times a bias, normalised to 1; those in kept stay in the denominator when they are null."""
    weights = {n: w * bias.get(n, 1.0) for n, (_, w) in parts.items()}
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("weights must not all be 0")
    top, below = F.lit(0.0), F.lit(0.0)
    for name, (value, _) in parts.items():
        w = weights[name] / total
        top = top + F.coalesce(value * w, F.lit(0.0))
        below = below + (F.lit(w) if name in kept else F.when(value.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)))
    return F.when(below > 0, top / below)


def numbered_best(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first most rows of each key with their places."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= most)
