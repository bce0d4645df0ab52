"""Scores, budgets and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutroom.functions.scalars import clamp01, labels, moderate

#: Default weights of the moment score.
MOMENT_WEIGHTS = {"sharp": 0.24, "motion": 0.20, "exposure": 0.16, "sound": 0.12, "no_cut": 0.08, "interest": 0.20}
#: Default weights of the take score.
TAKE_WEIGHTS = {"technical": 0.28, "composition": 0.18, "motion": 0.20, "human": 0.14, "audio": 0.12, "narrative": 0.08}


def check_weights(weights: dict[str, float], known: dict[str, float]) -> dict[str, float]:
    """Defaults with the given weights over them; raises for unknown names, values outside 0 to 1, or a sum of 0."""
    wrong = sorted(set(weights) - set(known))
    if wrong:
        raise ValueError(f"unknown weights: {', '.join(wrong)}")
    if any(not 0 <= w <= 1 for w in weights.values()):
        raise ValueError("weights must lie between 0 and 1")
    out = known | weights
    if sum(out.values()) <= 0:
        raise ValueError("weights must not all be 0")
    return out


def weighted_mean(parts: dict[str, tuple[Column, float]]) -> Column:
    """Mean of the parts by weight; a part that is null counts in neither sum. Null without any part."""
    top, below = F.lit(0.0), F.lit(0.0)
    for value, weight in parts.values():
        top = top + F.coalesce(value * weight, F.lit(0.0))
        below = below + F.when(value.isNotNull(), F.lit(weight)).otherwise(F.lit(0.0))
    return F.when(below > 0, top / below)


def moment_score(sharp: Column, motion: Column, exposure_ok: Column, speech: Column, loud: Column, cut: Column, interest: Column, has_audio: Column, weights: dict[str, float] | None = None) -> Column:
    """Score of a window; sound counts only where there is audio, interest only where it is known."""
    w = check_weights(weights or {}, MOMENT_WEIGHTS)
    sound = F.when(speech, 1.0).when(loud, 0.6).otherwise(0.0)
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    parts = {
        "sharp": (sharp, w["sharp"]),
        "motion": (moderate(motion, 0.05, 0.45, 0.2), w["motion"]),
        "exposure": (one(exposure_ok), w["exposure"]),
        "no_cut": (1.0 - one(cut), w["no_cut"]),
        "sound": (F.when(has_audio, sound), w["sound"]),
        "interest": (F.when(interest.isNotNull() & ~F.isnan(interest), clamp01(interest)), w["interest"]),
    }
    return clamp01(F.coalesce(weighted_mean(parts), F.lit(0.0)))


def take_score(axes: dict[str, Column], boost: Column, weights: dict[str, float] | None = None, most: float = 0.20) -> Column:
    """Mean of the known axes by weight, and a learned boost of at most most, between 0 and 1."""
    w = check_weights(weights or {}, TAKE_WEIGHTS)
    mean = weighted_mean({name: (axes[name], w[name]) for name in axes})
    return clamp01(mean + F.least(F.lit(most), F.coalesce(boost, F.lit(0.0))))


def safety(technical: Column, narrative: Column, low: float = 0.35, rescue: float = 0.70) -> Column:
    """Unusable where all technical scores (an array) are low, unless the story needs it."""
    bad = F.forall(technical, lambda s: F.coalesce(s <= low, F.lit(False))) & (F.size(technical) > 0)
    return F.when(bad & (narrative >= rescue), "rescue").when(bad, "unusable").otherwise("usable")


def quality_badges(over: Column, under: Column, blurred: Column, clipped: Column, share: float = 0.15) -> Column:
    return labels((over > share, "overexposed"), (under > share, "underexposed"), (blurred > share, "out_of_focus"), (clipped, "clipped"))


def spans_for(target: int, least: int) -> list[int]:
    """A target length, halved down to the least."""
    out = [target]
    while out[-1] // 2 >= least:
        out.append(out[-1] // 2)
    return out


def greedy_budget(df: DataFrame, keys: list[str], order: list[Column], ident: str, cost: str, budget: int | Column) -> DataFrame:
    """Take rows of each key in order while they fit; what does not fit is passed over and later rows still may.

    A fold over one key's sorted rows, in the JVM. Keys are projects, whose rows are bounded by what one holds.
    """
    rows = df.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(ident).cast("string").alias("i"), F.col(cost).cast("long").alias("c")))).alias("_r")
    )
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("picked"))
    limit = budget if isinstance(budget, Column) else F.lit(budget)

    def step(acc: Column, row: Column) -> Column:
        fits = acc["used"] + row["c"] <= limit
        return F.struct(
            F.when(fits, acc["used"] + row["c"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["picked"], F.array(row["i"]))).otherwise(acc["picked"]).alias("picked"),
        )

    folded = rows.withColumn("_f", F.aggregate("_r", start, step))
    return folded.select(*keys, F.col("_f.used").alias("used"), F.posexplode("_f.picked").alias("place", "i")).select(
        *keys, (F.col("place") + 1).alias("place"), F.col("i").cast(dict(df.dtypes)[ident]).alias(ident), "used"
    )


def rotated_order(df: DataFrame, keys: list[str], group: str, order: list[Column]) -> DataFrame:
    """Rows dealt in turns over a key's groups: every group's best, then every second one; column turn says which."""
    from pyspark.sql.window import Window

    return df.withColumn("turn", F.row_number().over(Window.partitionBy(*keys, group).orderBy(*order)))


def rough_cut(df: DataFrame, keys: list[str], ident: str, length: str, target: int, least: int = 1000, share: int = 2000) -> DataFrame:
    """Lengths of clips for a target in milliseconds, in two folds.

    Each clip is cut to max(share, target / n), at least ``least``; what is left of the target then extends
    the longest clips first. Ties go to the smaller id. Returns keys, ident, granted.
    """
    rows = df.where(F.col(length) > 0).groupBy(*keys).agg(
        F.count("*").alias("_n"), F.sort_array(F.collect_list(F.struct((-F.col(length)).alias("m"), F.col(ident).alias("i"), F.col(length).cast("long").alias("c")))).alias("_r")
    )
    cap = F.greatest(F.lit(share).cast("long"), F.floor(F.lit(target) / F.col("_n")))
    first = F.transform("_r", lambda r: F.struct(r["i"].alias("i"), r["c"].alias("c"), F.least(r["c"], F.greatest(cap, F.lit(least))).cast("long").alias("g")))
    rows = rows.withColumn("_g", first).withColumn("_left", F.greatest(F.lit(target) - F.aggregate("_g", F.lit(0).cast("long"), lambda s, x: s + x["g"]), F.lit(0)).cast("long"))
    kind = rows.schema["_g"].dataType
    start = F.struct(F.col("_left").alias("left"), F.array().cast(kind).alias("out"))

    def extend(acc: Column, x: Column) -> Column:
        more = F.least(acc["left"], x["c"] - x["g"])
        return F.struct((acc["left"] - more).alias("left"), F.concat(acc["out"], F.array(F.struct(x["i"].alias("i"), x["c"].alias("c"), (x["g"] + more).alias("g")))).alias("out"))

    return rows.withColumn("_f", F.aggregate("_g", start, extend, lambda a: a["out"])).select(*keys, F.explode("_f").alias("_x")).select(
        *keys, F.col("_x.i").alias(ident), F.col("_x.g").alias("granted")
    )


def stack_key(parts: list[Column], alone: Column, ident: Column) -> Column:
    """A key that groups equal parts; rows whose labels aren't all known stay alone."""
    return F.when(alone, F.concat(F.lit("#"), ident.cast("string"))).otherwise(F.concat_ws("|", *parts))


def replay_duels(df: DataFrame, session: str, queue: str, verdicts: str) -> DataFrame:
    """Who leads each session after its verdicts over its queue.

    The first two of the queue meet; the winner stays in front and meets the next. A null verdict parks the
    left one as a co-winner, and the right one goes on. verdicts is an array of winners in order; one that is
    neither of the two is passed over.
    """
    start = F.struct(F.try_element_at(queue, F.lit(1)).alias("front"), F.lit(2).alias("at"), F.slice(queue, 1, 0).alias("parked"))

    def step(acc: Column, verdict: Column) -> Column:
        other = F.try_element_at(F.col(queue), acc["at"])
        known = other.isNotNull() & (verdict.isNull() | (verdict == acc["front"]) | (verdict == other))
        return F.struct(
            F.when(known & (verdict.isNull() | (verdict == other)), other).otherwise(acc["front"]).alias("front"),
            F.when(known, acc["at"] + 1).otherwise(acc["at"]).alias("at"),
            F.when(known & verdict.isNull(), F.concat(acc["parked"], F.array(acc["front"]))).otherwise(acc["parked"]).alias("parked"),
        )

    done = F.aggregate(verdicts, start, step)
    return df.withColumn("_d", done).select(session, F.col("_d.front").alias("winner"), F.col("_d.parked").alias("co_winners"), (F.greatest(F.size(queue) - F.col("_d.at") + 1, F.lit(0))).alias("waiting"))
