"""The pool of clips: ratings, filters, orders, stacks and lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cutroom.functions.vectors import cosine
from cutroom.operators.components import connected_components
from cutroom.operators.latest import latest_per_key
from cutroom.session import ship

#: Reasons that rule a clip out, by key and by label.
BLOCKERS = ("defocus", "失焦", "excessive_shake", "抖动过大", "bad_timing", "时机差", "high_contrast", "大光比")
#: The tests of a window's sound and light.
SPEECH_RMS, SPEECH_CREST, SPEECH_PROMINENCE, SPEECH_SPAN = -30.0, 10.0, 1.0, 4.0
OVER_HIGH, OVER_MEAN = 225.0, 170.0
UNDER_LOW, UNDER_MEAN, UNDER_HIGHLIGHT = 16.0, 60.0, 200.0
#: Bounds of an export's bit rate.
RATE_FLOOR, RATE_HEADROOM = 2_000_000.0, 1.5


def rated(clips: DataFrame, ratings: DataFrame, clip: str, kind: str, value: str, order: list[str]) -> DataFrame:
    """Clips with their latest binary and star values; no rating is 0."""
    last = latest_per_key(ratings.select(F.col(clip).alias("_clip"), kind, value, *order), ["_clip", kind], order)
    wide = last.groupBy("_clip").agg(*[F.max(F.when(F.col(kind) == k, F.col(value))).alias(k) for k in ("binary", "star")])
    kept = clips.join(wide, clips[clip] == F.col("_clip"), "left").drop("_clip")
    return kept.withColumns({k: F.coalesce(k, F.lit(0)) for k in ("binary", "star")})


def in_scope(scope: str, binary: Column, star: Column) -> Column:
    """Whether a clip is in an automatic selection's scope."""
    favourite, three = binary == 1, star >= 3
    scopes = {"favorites_or_rated3": favourite | three, "favorites": favourite, "rated3": three, "all": F.lit(True)}
    if scope not in scopes:
        raise ValueError(f"unknown scope: {scope}")
    return F.coalesce(scopes[scope], F.lit(False))


def rating_filter(mode: str, binary: Column, star: Column, suspect: Column, exempt: Column, exclude_suspect: bool) -> Column:
    """Whether a clip is shown; a rating of 0 is none, and exempt clips are never left out as suspected waste."""
    chosen = {"favorite": binary == 1, "unrated": (F.coalesce(binary, F.lit(0)) == 0) & (F.coalesce(star, F.lit(0)) == 0), "rejected": binary == -1}.get(mode, F.lit(True))
    return F.coalesce(chosen, F.lit(False)) & (~F.coalesce(suspect, F.lit(False)) | F.coalesce(exempt, F.lit(False)) | F.lit(not exclude_suspect))


def labelled(clips: DataFrame, labels: DataFrame, clip: str, dimension: str, label: str) -> DataFrame:
    """Clips with a label in a dimension; empty names filter nothing."""
    if not dimension or not label:
        return clips
    return clips.join(labels.where((F.col("dimension") == dimension) & (F.col("label") == label)).select(clip).distinct(), clip, "left_semi")


def blocked(reasons: Column) -> Column:
    """Whether an array of reasons has one that rules its clip out."""
    return F.coalesce(F.arrays_overlap(reasons, F.array(*[F.lit(b) for b in BLOCKERS])), F.lit(False))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def has_speech(rms: Column, peak: Column, band: Column, baseline: Column, crest_peak: Column, trough: Column) -> Column:
    """Loud and peaky, a voice band that stands out of the clip's own, and a syllable's rise and fall; what is missing fails."""
    known = _finite(rms) & _finite(peak) & _finite(band) & _finite(baseline) & _finite(crest_peak) & _finite(trough)
    ok = (rms >= SPEECH_RMS) & (peak - rms >= SPEECH_CREST) & (band - rms - baseline >= SPEECH_PROMINENCE) & (crest_peak - trough >= SPEECH_SPAN)
    return F.coalesce(known & ok, F.lit(False))


def exposure_ok(low: Column, mean: Column, high: Column, greatest: Column) -> Column:
    """Neither burnt out nor dark without any highlight."""
    over = (high >= OVER_HIGH) & (mean >= OVER_MEAN)
    under = (low <= UNDER_LOW) & (mean <= UNDER_MEAN) & (greatest < UNDER_HIGHLIGHT)
    return ~over & ~under


def bit_rate(rates: Column, ceiling: float) -> Column:
    """Kilobits a second of an export: the greatest source rate with headroom, between floor and ceiling; none known is the ceiling."""
    wanted = F.max(rates) * RATE_HEADROOM
    return F.floor(F.coalesce(F.least(F.greatest(wanted, F.lit(RATE_FLOOR)), F.lit(float(ceiling))), F.lit(float(ceiling))) / 1000 + 0.5).cast("long")


def stack_wall(shown: DataFrame, members: DataFrame, clip: str, stack: str, preferred: str, place: str) -> DataFrame:
    """The wall of shown clips, in their order: a stack once, where its first shown clip stands, by its preferred shown member or the first one."""
    shown_members = members.join(shown.select(clip, place), clip)
    at = shown_members.groupBy(stack).agg(
        F.min(place).alias(place), F.min_by(clip, F.struct((~F.col(preferred)).alias("p"), F.col("member_place"))).alias(clip), F.count("*").alias("shown")
    )
    alone = shown.join(members.select(clip), clip, "left_anti").select(F.lit(None).cast(dict(members.dtypes)[stack]).alias(stack), place, clip, F.lit(1).cast("long").alias("shown"))
    return at.select(stack, place, clip, "shown").unionByName(alone)


def dense_numbers(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """Rows numbered from 1 in order without gaps, by ranges: no task sees all rows. order must tell rows apart."""
    from cutroom.operators.windows import running_sum

    numbered = running_sum(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", "_before")
    return numbered.withColumn(name, F.col("_before") + 1).drop("_one", "_before")


def photo_clusters(photos: DataFrame, most: int = 200, **rule: float) -> DataFrame:
    """Groups of photos that belong together, in each of which every two do: (id, group, is_primary) of groups of two and more.

    photos: id, event, camera, taken_ms, number, hash (long), vector, sharpness; rule as in photo_pairs(). In order of time (undated
    last) and id, a photo joins the first group with room that it is close to all members of. A photo left alone because a group was
    full gets that group's weakest member. group is the group's least id, its primary the sharpest photo, of equals
    the one of least id.

    The order only matters among photos that are linked, so each component of close pairs is a task of its own and
    an event of any size is spread over many; a task compares its photos as they come and makes no pairs.
    """
    ship(photos.sparkSession)
    rule = {"close": 18, "similar": 0.90, "burst_ms": 1200, "numbers": 3, "hard_ms": 1_800_000} | rule
    parts = connected_components(photo_pairs(photos, **rule), "a", "b")
    rows = photos.join(parts, F.col("id") == F.col("node")).select("component", "id", "camera", "taken_ms", "number", "hash", F.col("vector").cast("array<double>").alias("vector"), F.coalesce("sharpness", F.lit(0.0)).cast("double").alias("sharpness"))
    kind = dict(photos.dtypes)["id"]

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["taken_ms", "id"], na_position="last", kind="stable").reset_index(drop=True)
        taken, number = frame.taken_ms.to_numpy(float, na_value=np.nan), frame.number.to_numpy(float, na_value=np.nan)
        camera = frame.camera.fillna("").to_numpy()
        bits = frame["hash"].to_numpy(np.int64).view(np.uint64)
        length = max((len(v) for v in frame.vector if v is not None), default=0)
        unit = np.zeros((len(frame), length))
        for i, v in enumerate(frame.vector):
            if v is not None and len(v) == length and np.isfinite(v).all() and np.linalg.norm(v) > 0:
                unit[i] = v / np.linalg.norm(v)

        def close(i: int, to: np.ndarray) -> np.ndarray:
            gap = np.abs(taken[to] - taken[i])  # a time that is missing is no gap
            burst = (camera[to] == camera[i]) & (camera[i] != "") & ((gap <= rule["burst_ms"]) | (np.abs(number[to] - number[i]) <= rule["numbers"]))
            alike = (np.bitwise_count(bits[to] ^ bits[i]) <= rule["close"]) | (unit[to] @ unit[i] >= rule["similar"])
            return (burst | alike) & ~(gap > rule["hard_ms"])

        groups: list[list[int]] = []
        for i in range(len(frame)):
            near = np.zeros(len(frame), bool)
            near[:i] = close(i, np.arange(i))
            home = next((g for g in groups if len(g) < most and near[g].all()), None)
            if home is None:
                groups.append([i])
            else:
                home.append(i)
        for spill, alone in enumerate(groups):
            if len(alone) == 1:
                full = next((g for g in groups[:spill] if len(g) == most and close(alone[0], np.array(g)).all()), None)
                if full is not None:
                    weakest = min(full, key=lambda k: (frame.sharpness[k], -frame.id[k]))
                    full.remove(weakest)
                    alone.append(weakest)
        out = []
        for g in groups:
            if len(g) > 1:
                best = min(g, key=lambda k: (-frame.sharpness[k], frame.id[k]))
                out += [(frame.id[k], min(frame.id[g]), k == best) for k in g]
        return pd.DataFrame(out, columns=["id", "group", "is_primary"])

    return rows.groupBy("component").applyInPandas(group, f"id {kind}, group {kind}, is_primary boolean")


def section_labels(df: DataFrame, keys: list[str], place: str, energy: str) -> DataFrame:
    """Names of a piece's sections: its strongest (of equals the last) is the climax, then intro, outro, and by the one before."""
    line = Window.partitionBy(*keys).orderBy(place)
    whole = Window.partitionBy(*keys)
    last = F.max(place).over(whole)
    strongest = F.max(F.struct(energy, place)).over(whole)[place]
    before = F.lag(energy).over(line)
    named = F.when(F.col(place) == strongest, "climax").when(before.isNull(), "intro").when(F.col(place) == last, "outro").when(F.col(energy) > before, "build").otherwise("verse")
    return df.withColumn("label", F.when(F.count("*").over(whole) >= 2, named))


def overlapping_slices(df: DataFrame, keys: list[str], place: str, rate: int) -> DataFrame:
    """Each row under every second whose slice it is in: a slice has the second's rows, the one before and the one after."""
    i, n = F.col(place), F.count("*").over(Window.partitionBy(*keys))
    seconds = F.ceil(F.col("_n") / rate)
    first, last = F.greatest(F.floor((i - 1) / rate), F.lit(0)), F.least(F.floor((i + 1) / rate), seconds - 1)
    return df.withColumn("_n", n).withColumn("second", F.explode(F.sequence(first, F.greatest(first, last)))).drop("_n")


def trailing_eta(samples: DataFrame, keys: list[str], at: str, done: str, left: str, window: int) -> DataFrame:
    """Seconds left by the speed over the trailing window; none without progress."""
    last = samples.groupBy(*keys).agg(F.max(at).alias("_end"))
    ends = samples.join(last, keys).where(F.col(at) >= F.col("_end") - window).groupBy(*keys).agg(
        F.min_by(F.struct(at, done), at).alias("a"), F.max_by(F.struct(at, done, left), at).alias("b")
    )
    gained, span = F.col(f"b.{done}") - F.col(f"a.{done}"), F.col(f"b.{at}") - F.col(f"a.{at}")
    return ends.select(*keys, F.when((gained > 0) & (span > 0), F.col(f"b.{left}") / gained * span).alias("eta"))


def authoritative_union(first: DataFrame, second: DataFrame, ident: str, order: list[str]) -> DataFrame:
    """All hits of the first list, and the second's best hit of every thing that the first has none of."""
    rest = second.join(first.select(ident).distinct(), ident, "left_anti")
    best = rest.groupBy(ident).agg(F.min_by(F.struct(*[c for c in rest.columns if c != ident]), F.struct(*order)).alias("_r"))
    return first.unionByName(best.select(ident, *[F.col("_r")[c].alias(c) for c in rest.columns if c != ident]))


def top_phrases(df: DataFrame, key: str, text: str, order: list[Column], most: int = 3) -> DataFrame:
    """The first distinct phrases of each key, trimmed, empty ones left out."""
    phrases = df.withColumn("_t", F.trim(text)).where("_t <> ''")
    ranks = [c.alias(f"o{i}") for i, c in enumerate(order)]
    each = phrases.groupBy(key, "_t").agg(F.min(F.struct(*ranks)).alias("_o"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_o"))
    return each.withColumn("rank", rank).where(F.col("rank") <= most).select(key, "rank", F.col("_t").alias("phrase"))


def photo_pairs(photos: DataFrame, close: int = 18, similar: float = 0.90, burst_ms: int = 1200, numbers: int = 3, hard_ms: int = 1_800_000) -> DataFrame:
    """Pairs a < b of one event's photos that belong together.

    photos: id, event, camera, taken_ms, number, hash (long), vector. Both have hashes and are not half an hour
    apart; then a burst (one camera, close in time or number), or few differing bits, or similar vectors.
    Events are split at half-hour gaps before, and each is bounded by that; the join is on the event and on
    bins of time, so photos far apart in a long event never meet.
    """
    binned = photos.where("hash is not null").withColumn("_bin", F.floor(F.col("taken_ms") / hard_ms))
    left = binned.select("event", *[F.col(c).alias(f"a_{c}") for c in ("id", "camera", "taken_ms", "number", "hash", "vector")], F.explode(F.when(F.col("_bin").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(F.col("_bin") - 1, F.col("_bin"), F.col("_bin") + 1))).alias("_bin"))
    right = binned.select("event", "_bin", *[F.col(c).alias(f"b_{c}") for c in ("id", "camera", "taken_ms", "number", "hash", "vector")])
    met = left.join(right, (left["event"] == right["event"]) & left["_bin"].eqNullSafe(right["_bin"])).where(f"a_id < b_id and coalesce(abs(a_taken_ms - b_taken_ms) <= {hard_ms}, true)")
    burst = (F.col("a_camera") != "") & (F.col("a_camera") == F.col("b_camera")) & (
        F.coalesce(F.abs(F.col("a_taken_ms") - F.col("b_taken_ms")) <= burst_ms, F.lit(False)) | F.coalesce(F.abs(F.col("a_number") - F.col("b_number")) <= numbers, F.lit(False))
    )
    bits = F.bit_count(F.col("a_hash").bitwiseXOR(F.col("b_hash")))
    kind = F.when(F.coalesce(burst, F.lit(False)), "burst").when(bits <= close, "visual").when(cosine("a_vector", "b_vector") >= similar, "semantic")
    return met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), kind.alias("why")).where("why is not null")
