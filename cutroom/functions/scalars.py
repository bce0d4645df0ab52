"""Small scalar rules: clamps, rational time, clocks, text excerpts, keywords, formats, colours of score."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    """Between 0 and 1; missing and not-finite numbers are 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def moderate(motion: Column, low: float, high: float, wild: float) -> Column:
    """Rises to 1 at low, stays, and falls from high to wild at 1."""
    m = clamp01(motion)
    return F.when(m < low, m / low).when(m <= high, F.lit(1.0)).otherwise(1.0 - (m - high) / (1.0 - high) * (1.0 - wild))


def rescale(ticks: Column, num: Column, den: Column, per_second: int) -> Column:
    """Ticks of num/den seconds in units of 1/per_second, rounded half away from zero in exact arithmetic."""
    exact = ticks.cast("decimal(19,0)") * num.cast("decimal(10,0)") * F.lit(per_second).cast("decimal(8,0)")
    return F.round(exact / den.cast("decimal(10,0)"), 0).cast("long")


def clock(ms: Column, comma: bool = False) -> Column:
    """HH:MM:SS.mmm, with a comma as in subtitles if asked."""
    ms = ms.cast("long")
    return F.format_string(
        f"%02d:%02d:%02d{',' if comma else '.'}%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000
    )


def excerpt(text: Column, needle: str, radius: int = 18) -> Column:
    """Text around the first place of the needle, whatever the case; from the start where it isn't there."""
    at = F.instr(F.lower(text), needle.lower())
    start = F.greatest(at - 1 - radius, F.lit(0))
    taken = F.substring(text, start + 1, F.lit(2 * radius + len(needle)))
    return F.when(at == 0, F.substring(text, 1, 2 * radius)).when(start > 0, F.concat(F.lit("…"), taken)).otherwise(taken)


def contains_folded(text: Column, needle: str) -> Column:
    return F.contains(F.lower(text), F.lit(needle.lower()))


def keywords(text: Column) -> Column:
    """Distinct lower-case ASCII words of three letters or more, and pairs of neighbouring Han characters."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]{3,}"), F.lit(0))
    runs = F.regexp_extract_all(text, F.lit(r"\p{IsHan}{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_union(words, pairs)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often then names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def guard_formula(cell: Column) -> Column:
    """A cell that a spreadsheet would run gets an apostrophe."""
    return once(cell, lambda x: F.when(F.substring(F.ltrim(x), 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), x)).otherwise(x))


def metric(pairs: Column, name: str) -> Column:
    """A number out of k=v;k=v text; null where it is missing or no number."""
    return F.try_element_at(F.str_to_map(pairs, F.lit(";"), F.lit("=")), F.lit(name)).try_cast("double")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem_number(path: Column) -> Column:
    """Digits at the end of a file's name, before its extension; null without."""
    digits = F.regexp_extract(F.regexp_replace(file_name(path), r"\.[^.]*$", ""), r"(\d+)$", 1)
    return F.when(digits != "", digits.cast("long"))


def shorten(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


def display_size(width: Column, height: Column, rotation: Column) -> tuple[Column, Column]:
    turned = F.pmod(rotation, F.lit(180)) == 90
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def orientation(width: Column, height: Column, rotation: Column) -> Column:
    w, h = display_size(width, height, rotation)
    return F.when(h > w, "portrait").when(w > h, "landscape").otherwise("square")


def resolution_tier(width: Column, height: Column) -> Column:
    short = F.least(width, height)
    return F.when(short >= 2160, "4K").when(short >= 1080, "1080p").when(short >= 720, "720p").otherwise("480p")


def backoff_seconds(attempt: Column, most: int = 300) -> Column:
    """1, 2, 4, ... seconds."""
    return F.least(F.lit(most), F.pow(F.lit(2), F.greatest(attempt - 1, F.lit(0))).cast("int"))


def labels(*rules: tuple[Column, str]) -> Column:
    """The labels of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]))


def like_literal(text: Column, needle: str) -> Column:
    """Whether the text holds the needle, per cent, underscore and backslash being plain characters; ASCII letters of either case."""
    escaped = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.ilike(text, F.lit(f"%{escaped}%"), F.lit("\\"))


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether the text holds one of the words, whatever the case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(low, w))


def seconds_per_clip(clips: Column) -> Column:
    """Seconds that a clip may have by how many there are."""
    return F.when(clips <= 15, 4).when(clips <= 60, 5).when(clips <= 90, 6).otherwise(8)


def clarity(text: Column, covered: Column) -> Column:
    """0.55 of the share of letters, digits and Han characters among what is not space, and 0.45 of the share that speech covers."""
    solid = F.length(F.regexp_replace(text, r"\s", ""))
    valid = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return 0.55 * F.coalesce(valid / F.nullif(solid, F.lit(0)), F.lit(0.0)) + 0.45 * clamp01(covered)


def tempo_prior(bpm: Column, centre: float = 120.0, width: float = 0.9) -> Column:
    """Log-normal weight of a tempo around the centre, in octaves."""
    octaves = F.log2(bpm / centre)
    return F.exp(-0.5 * F.pow(octaves / width, 2))


def parabolic_peak(left: Column, middle: Column, right: Column) -> Column:
    """Offset, within half a step, of the top of the parabola through three values; 0 where they are level."""
    bend = left - 2 * middle + right
    return F.when(F.abs(bend) > 1e-12, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (left - right) / bend))).otherwise(0.0)


def folder(path: Column) -> Column:
    """All but the last part of a path; empty without a slash."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def story_key(kind: Column, clip: Column, segment: Column) -> Column:
    """kind:clip:segment, the segment empty for a whole clip."""
    return F.concat_ws(":", kind, clip.cast("string"), F.coalesce(segment.cast("string"), F.lit("")))


_HAN = "零一二三四五六七八九"


def han_number(text: Column) -> Column:
    """A whole number below ten thousand written with Han or ASCII digits; null for anything else."""
    plain = F.translate(F.translate(text, "两〇", "二零"), _HAN, "0123456789")
    part = lambda unit: F.regexp_extract(plain, rf"(\d?){unit}", 1)
    times = lambda unit, n: F.when(F.contains(plain, F.lit(unit)), F.when(part(unit) == "", 1).otherwise(part(unit).try_cast("int")) * n).otherwise(0)
    ones = F.coalesce(F.regexp_extract(plain, r"[十百千]0?(\d)$", 1).try_cast("int"), F.lit(0))
    units = times("千", 1000) + times("百", 100) + times("十", 10) + ones
    return F.when(F.rlike(plain, F.lit(r"^\d+$")), plain.try_cast("int")).when(F.rlike(plain, F.lit(r"^(\d?千)?0?(\d?百)?0?(\d?十)?\d?$")) & F.rlike(plain, F.lit("[十百千]")), units)


def spoken_seconds(text: Column) -> Column:
    """Seconds of a phrase such as 90秒, 一分半, 两分钟三十秒 or 1.5 min; null without one."""
    number = r"([0-9.]+|[零〇一二两三四五六七八九十百]+)"
    value = lambda k, unit: F.regexp_extract(text, number + unit, k)
    as_number = lambda c: F.coalesce(c.try_cast("double"), han_number(c).cast("double"))
    minutes, secs = as_number(F.nullif(value(1, r"\s*(?:分钟|分|min)"), F.lit(""))), as_number(F.nullif(value(1, r"\s*(?:秒|s\b|sec)"), F.lit("")))
    half = F.when(F.rlike(text, F.lit("(?:分钟?|分)半")), 30).otherwise(0)
    return F.when(minutes.isNotNull() | secs.isNotNull(), F.coalesce(minutes * 60, F.lit(0.0)) + half + F.coalesce(secs, F.lit(0.0)))


#: Cents for a second of a model's pictures by resolution, for a picture handed in, and how many of those are free.
CENTS = {("MiniMax-H3", "768P"): 8, ("MiniMax-H3", "2K"): 13, ("MiniMax-H3-Max", "480P"): 5, ("MiniMax-H3-Max", "768P"): 8}
PICTURE_CENTS, FREE_PICTURES = 4, 5


def cost_usd(model: Column, resolution: Column, seconds: Column, pictures: Column) -> Column:
    """What a request costs, in dollars and whole cents; seconds of an unknown model or resolution cost nothing."""
    cents = F.lit(0)
    for (name, size), price in CENTS.items():
        cents = F.when((model == name) & (resolution == size), price).otherwise(cents)
    return (cents * seconds + F.greatest(pictures - FREE_PICTURES, F.lit(0)) * PICTURE_CENTS) / F.lit(100.0)


#: Routines in the order in which they are tried, with the words that tell them.
ROUTINES = (
    ("起床", ("起床", "醒了", "早安", "wake up", "waking up")),
    ("咖啡", ("咖啡", "coffee", "espresso", "手冲")),
    ("收营", ("收营", "撤营", "拔营", "pack up camp", "break camp")),
    ("发动", ("发动", "点火", "启动房车", "start the rv", "start engine")),
    ("驾驶", ("驾驶", "开车", "上路", "drive", "driving")),
    ("加油", ("加油", "油站", "gas station", "fuel", "refuel")),
    ("采购", ("采购", "买菜", "超市", "grocery", "groceries", "shopping")),
    ("倒车", ("倒车", "倒库", "reverse", "backing up")),
    ("调平", ("调平", "支腿", "leveling", "levelling", "level the rv")),
    ("接水", ("接水", "加水", "水管", "fill water", "water hookup")),
    ("接电", ("接电", "岸电", "电桩", "shore power", "electric hookup")),
    ("遮阳棚", ("遮阳棚", "雨棚", "awning")),
    ("做饭", ("做饭", "烹饪", "下厨", "cook", "cooking")),
    ("篝火", ("篝火", "营火", "campfire", "fire pit")),
    ("睡觉", ("睡觉", "晚安", "上床", "go to bed", "sleep")),
)
#: What labels alone tell, in order: person_state, subject, time_stage, function (None: any) and the routine.
LABELLED = (
    (None, "交通", "路上", None, "驾驶"),
    ("操作", "食物", None, None, "做饭"),
    ("吃喝", "食物", "出发", None, "咖啡"),
    ("操作", "交通", None, "Transition", "收营"),
)


def routine_of(text: Column, person_state: Column, subject: Column, time_stage: Column, function: Column) -> Column:
    """The routine that a clip shows: the first whose words its text has, whatever the case, else what its labels tell; else null."""
    given = (person_state, subject, time_stage, function)
    out = F.lit(None).cast("string")
    for *wanted, name in reversed(LABELLED):
        fits = F.lit(True)
        for column, value in zip(given, wanted, strict=True):
            fits = fits if value is None else fits & (column == value)
        out = F.when(fits, name).otherwise(out)

    def told(folded: Column) -> Column:
        found = out
        for name, words in reversed(ROUTINES):
            found = F.when(reduce(or_, [F.contains(folded, F.lit(w)) for w in words]), name).otherwise(found)
        return found

    return once(F.lower(F.coalesce(text, F.lit(""))), told)
