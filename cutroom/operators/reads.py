"""What a view reads in one go: a row with its parts gathered, weights, briefs, recalls and the revision that says whether to read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of a moment's score.
WEIGHTS = {"sharp": 0.24, "motion": 0.20, "exposure": 0.16, "sound": 0.12, "no_cut": 0.08, "interest": 0.20, "horizon_tilt_deg": 0.0, "exposure_worst_cell": 0.0, "saliency_sharpness": 0.0}
#: What kinds of motion are called, and the phrases of a brief.
MOTION_NAMES = {"pan": "横摇", "tilt": "俯仰", "zoom": "变焦", "handheld": "手持", "static": "固定机位"}
UNKNOWN_MOTION, NOTHING_TO_SAY = "运镜不明", "这条素材还没分析出可说的内容,先跑一次分析再看。"
SPEECH_LENGTH, LEAST_LABEL = 24, 0.22


def gathered(base: DataFrame, keys: list[str], parts: dict[str, tuple[DataFrame, list[Column], list[str]]]) -> DataFrame:
    """base with an array of structs for each part: its rows of the key, in order. A key without rows has an empty array.

    parts: name -> (table, order, fields). One group a part and one join each, in place of a look-up a key; what is gathered is what one
    view shows of one key. order must tell a key's rows apart.
    """
    out = base
    for name, (df, order, fields) in parts.items():
        held = df.select(*keys, F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)]).alias("o"), F.struct(*fields).alias("v"))
        rows = held.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]).alias(name))
        out = out.join(rows, keys, "left").withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    return out


def weight_faults(settings: Column) -> Column:
    """array<struct<key, fault>> of a JSON object of weights: keys that are none, numbers that are none of 0 to 1, in order of keys; all 0; no object.

    Keys that are left out have their default; null and an empty text are no object.
    """
    given = F.from_json(settings, "map<string,string>")
    kind = "array<struct<key:string,fault:string>>"
    number = lambda v: F.coalesce(v.try_cast("double"), F.lit(float("nan")))
    told = F.transform(F.array_sort(F.map_keys(given)), lambda k: F.struct(k.alias("key"), F.when(~((number(F.element_at(given, k)) >= 0) & (number(F.element_at(given, k)) <= 1)), "range").when(~k.isin(*WEIGHTS), "unknown").alias("fault")))
    bad = F.filter(told, lambda t: t["fault"].isNotNull())
    total = sum((F.coalesce(F.try_element_at(given, F.lit(k)).try_cast("double"), F.lit(w)) for k, w in WEIGHTS.items()), F.lit(0.0))
    none = F.when(total <= 0, F.array(F.struct(F.lit("").alias("key"), F.lit("all 0").alias("fault")))).otherwise(F.array()).cast(kind)
    return F.when(given.isNull(), F.array(F.struct(F.lit("").alias("key"), F.lit("no object").alias("fault")))).when(F.size(bad) > 0, bad).otherwise(none).cast(kind)


def brief(subject: Column, shot_size: Column, viewpoint: Column, person_state: Column, motion: Column, phrases: Column, speech: Column, fixable: Column) -> Column:
    """A sentence of what is known of a clip, never empty. phrases and fixable are arrays; anything may be null."""
    head = F.when(subject.isNotNull() & viewpoint.isNull() & shot_size.isNull(), F.concat(F.lit("拍的是"), subject)).when(
        subject.isNotNull(), F.concat(F.coalesce(viewpoint, F.lit("")), F.coalesce(shot_size, F.lit("")), F.lit("的"), subject)
    ).when(shot_size.isNotNull(), F.concat(F.lit("一个"), shot_size, F.lit("镜头")))
    moved = F.lit(UNKNOWN_MOTION)
    for name, called in MOTION_NAMES.items():
        moved = F.when(motion == name, called).otherwise(moved)
    said = F.trim(speech)
    said = F.when(F.length(said) > SPEECH_LENGTH, F.concat(F.substring(said, 1, SPEECH_LENGTH), F.lit("…"))).otherwise(said)
    parts = F.array(
        head, F.concat(F.lit("画面里的人在"), person_state), F.when(motion.isNotNull(), F.concat(moved, F.lit("拍摄"))),
        F.when(F.size(phrases) > 0, F.concat(F.lit("画面文字「"), F.array_join(phrases, "、"), F.lit("」"))),
        F.when(F.length(said) > 0, F.concat(F.lit("有人说「"), F.regexp_replace(said, "。+$", ""), F.lit("」"))),
        F.when(F.size(fixable) > 0, F.concat(F.lit("可修:"), F.array_join(fixable, "、"))),
    )
    known = F.array_compact(parts)
    return F.when(F.size(known) > 0, F.concat(F.array_join(known, ","), F.lit("。"))).otherwise(NOTHING_TO_SAY)


def event_recalls(fixtures: DataFrame, observations: DataFrame, key: str) -> DataFrame:
    """(metric, hits, n, rate) over all fixtures, observed or not.

    fixtures: key, important, golden, unique_event, narrative (flags); observations: key, detected, recommended, retained,
    rejected. Important events that were detected (1 without any); golden ones that were recommended or retained and not rejected
    (0 without any); unique ones rejected and narrative ones suppressed: not observed, rejected, or neither recommended nor
    retained (0 without any).
    """
    seen = observations.withColumn("_seen", F.lit(True))
    rows = fixtures.join(seen, key, "left")
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    kept = yes("_seen") & (yes("recommended") | yes("retained")) & ~yes("rejected")
    metrics = {"important_recall": ("important", yes("detected"), 1.0), "critical_recall": ("golden", kept, 0.0), "unique_false_reject_rate": ("unique_event", yes("rejected"), 0.0), "narrative_suppression_rate": ("narrative", ~kept, 0.0)}
    wide = rows.agg(*[x for name, (flag, hit, _) in metrics.items() for x in (F.count_if(yes(flag) & hit).alias(f"{name}_h"), F.count_if(yes(flag)).alias(f"{name}_n"))])
    lines = [F.struct(F.lit(name).alias("metric"), F.col(f"{name}_h").alias("hits"), F.col(f"{name}_n").alias("n"), F.coalesce(F.try_divide(f"{name}_h", f"{name}_n"), F.lit(empty)).alias("rate")) for name, (_, _, empty) in metrics.items()]
    return wide.select(F.explode(F.array(*lines)).alias("x")).select("x.*")


def revision(parts: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """One row, one text: the named aggregates of each table. It changes when what a reader shows of them may have changed."""
    out = None
    for name, (df, sums) in parts.items():
        line = df.agg(*[F.coalesce(c.cast("string"), F.lit("-")).alias(n) for n, c in sums.items()]).select(F.concat(F.lit(f"{name}="), F.concat_ws(":", *sums)).alias(name))
        out = line if out is None else out.crossJoin(line)  # one row each
    return out.select(F.concat_ws("|", *parts).alias("revision"))


class Reader:
    """A view that is read again only when its revision has changed: poll() returns the new rows, or None."""

    def __init__(self, revise: Callable[[], DataFrame], read: Callable[[], DataFrame]):
        self.revise, self.read, self.seen = revise, read, None

    def poll(self) -> DataFrame | None:
        now = self.revise().first()[0]
        if now == self.seen:
            return None
        self.seen = now
        return self.read()
