"""What is delivered, in which order, and whether its times hold; bands, revisions and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds that a container may shift the first frame by.
MUX_SHIFT = 0.05
#: A long recording is analysed in parts of this length at least, so many at most, on this grid.
PART_SECONDS, MOST_PARTS, GRID = 40.0, 4, 0.5
#: The slots of a chapter in order, and those that are filmed.
FLOW = ("DH INTRO", "MAP", "REAL/ESTABLISHING", "REAL/EXPERIENCE", "REAL/DETAIL", "DH OVERLAY", "REAL/HUMAN", "ATMOSPHERE", "TRANSITION")


def packet_bounds(packets: DataFrame, keys: list[str], pts: str, duration: str, frame: Column) -> DataFrame:
    """First time and last end of each key's packets; a packet without a duration lasts a frame, none lasts less than 0."""
    end = F.col(pts) + F.greatest(F.coalesce(F.col(duration), frame), F.lit(0.0))
    return packets.where(F.col(pts).isNotNull()).groupBy(*keys).agg(F.min(pts).alias("first_seconds"), F.max(end).alias("end_seconds"))


def bounds_hold(first: Column, end: Column, expected: Column, frame: Column) -> Column:
    """Whether the first frame is within a frame and the container's shift of 0, and the length within a frame of the expected one."""
    tolerance = F.greatest(frame, F.lit(0.000001))
    return (F.abs(first) <= tolerance + MUX_SHIFT + 2.0**-52) & (F.abs(end - first - expected) <= tolerance + 2.0**-52)


def window_bounds(frames: DataFrame, keys: list[str], pts: str, duration: str, start: Column, stop: Column) -> DataFrame:
    """First frame of each key inside [start, stop), and where the last one ends: at the first frame from stop on,
    else after the last one's distance to the next, its own duration, or a tick. Equal times are one frame."""
    order = Window.partitionBy(*keys).orderBy(pts)
    one = frames.where(F.col(pts).isNotNull()).groupBy(*keys, pts).agg(F.first(F.when(F.col(duration) > 0, F.col(duration)), True).alias("_d"), F.first(start).alias("_a"), F.first(stop).alias("_b"))
    lasting = one.withColumn("_next", F.lead(pts).over(order))
    inside = (F.col(pts) >= F.col("_a")) & (F.col(pts) < F.col("_b"))
    found = lasting.groupBy(*keys).agg(
        F.min(F.when(inside, F.col(pts))).alias("first"),
        F.max(F.when(inside, F.struct(F.col(pts).alias("p"), (F.col(pts) + F.coalesce(F.col("_next") - F.col(pts), F.col("_d"), F.lit(1))).alias("e")))).alias("_last"),
        F.min(F.when(F.col(pts) >= F.col("_b"), F.col(pts))).alias("_after"),
    )
    return found.where("first is not null").select(*keys, "first", F.coalesce("_after", F.col("_last.e")).alias("end"))


def delivery_order(items: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Places of delivered items: by narrative chapter and beat, then story position, then capture time, photos last.

    items: keys, ident, chapter, beat, position, captured (each may be null), photo (boolean), start.
    """
    order = [F.col("photo"), F.asc_nulls_last("chapter"), F.asc_nulls_last("beat"), F.asc_nulls_last("position"), F.asc_nulls_last("captured"), F.col(ident), F.col("start")]
    return items.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def appended(new: DataFrame, held: DataFrame, key: str, order: list[Column], position: str = "position") -> DataFrame:
    """New rows with the positions that follow the greatest one each key holds."""
    last = held.groupBy(key).agg(F.max(position).alias("_last"))
    placed = new.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return placed.join(last, key, "left").withColumn(position, F.coalesce(F.col("_last") + F.col("_r"), F.col("_r") - 1)).drop("_last", "_r")


def moved(df: DataFrame, key: str, place: str, ident: str, moves: DataFrame) -> DataFrame:
    """Lists with one item moved to another place (moves: key, item, target from 0; beyond the end is the end) and numbered anew; a null target removes it."""
    wanted = moves.select(F.col(key).alias("_k"), F.col("item"), F.col("target"))
    rows = df.join(wanted, F.col(key) == F.col("_k"), "left")
    rest = Window.partitionBy(key, (F.col("_k").isNotNull() & (F.col(ident) == F.col("item")))).orderBy(place)
    own = F.coalesce(F.col(ident) == F.col("item"), F.lit(False))
    # the others keep their order around the moved one, which stands before the one that has its target place
    at = F.when(own, F.struct((F.coalesce(F.col("target"), F.lit(0)).cast("double") - 0.5).alias("p"), F.lit(0).alias("o"))).otherwise(F.struct((F.row_number().over(rest) - 1).cast("double").alias("p"), F.lit(1).alias("o")))
    kept = rows.withColumn("_at", at).where(~(own & F.col("target").isNull()))
    return kept.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy("_at")) - 1).drop("_at", "_k", "item", "target")


def collapsed_gaps(df: DataFrame, keys: list[str], order: str, gap: Column, name: str) -> DataFrame:
    """Rows in order, where neighbouring gaps are one row with the names of all; other rows stand alone."""
    line = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("_g", gap).withColumn("_new", (~F.col("_g") | ~F.coalesce(F.lag("_g").over(line), F.lit(False))).cast("int"))
    runs = marked.withColumn("_run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.sort_array(F.collect_list(F.struct(order, name)))
    return runs.groupBy(*keys, "_run").agg(F.min(order).alias(order), F.first("_g").alias("gap"), held.alias("_h")).select(*keys, order, "gap", F.transform("_h", lambda h: h[name]).alias("names"))


def part_plan(seconds: Column, slots: Column) -> Column:
    """array<struct<start, seek, end>> of a long recording's parts; none where one would do. The last has no end."""
    count = F.least(F.floor(seconds / PART_SECONDS), slots + 1, F.lit(MOST_PARTS)).cast("int")
    snap = lambda i: F.floor((i * (seconds / count)) / GRID + 0.5) * GRID

    def part(i: Column) -> Column:
        return F.struct(snap(i).cast("double").alias("start"), F.when(i > 0, F.greatest(snap(i) - GRID, F.lit(0.0))).otherwise(0.0).cast("double").alias("seek"), F.when(i + 1 < count, snap(i + 1)).cast("double").alias("end"))

    none = F.array().cast("array<struct<start:double,seek:double,end:double>>")
    return F.when((seconds > 0) & (count >= 2), F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), part)).otherwise(none)


def audio_role(index: Column, total: Column, channels: Column, rate: Column) -> Column:
    """What an audio stream probably is: a mono one at 48 kHz beside others is a wireless microphone, a first stereo one the camera's own."""
    wireless = F.coalesce((channels == 1) & (rate == 48_000), F.lit(False)) & (total > 1)
    return F.when(wireless, "wireless_mic").when((index == 0) & F.coalesce(channels == 2, F.lit(False)), "onboard_mic").otherwise("unknown")


def filmed_between(left: Column, right: Column) -> Column:
    """Filmed slots between two slots of a chapter's flow."""
    flow = F.array(*[F.lit(f) for f in FLOW])
    filmed = [f for f in FLOW if f.startswith("REAL/") or f in ("ATMOSPHERE", "TRANSITION")]
    a, b = F.array_position(flow, left).cast("int"), F.array_position(flow, right).cast("int")
    between = F.filter(F.slice(flow, a + 1, F.greatest(b - a - 1, F.lit(0))), lambda s: s.isin(*filmed))
    return F.when((a > 0) & (b > a), F.size(between)).otherwise(0)


def draft_faults(beats: DataFrame, selection: DataFrame, draft: str, item: str) -> DataFrame:
    """What keeps each draft from being accepted: items beyond the selection, items missing from it, items twice.

    beats: draft, item; selection: draft, item. A full outer join on both, after counting, so nothing is
    gathered. Drafts without faults have a row of zeros.
    """
    used = beats.groupBy(draft, item).agg(F.count("*").alias("n"))
    both = used.join(selection.select(draft, item, F.lit(True).alias("wanted")).distinct(), [draft, item], "full_outer")
    one = lambda c: F.sum(c.cast("long"))
    return both.groupBy(draft).agg(
        one(F.col("wanted").isNull()).alias("foreign"), one(F.col("n").isNull()).alias("missing"), one(F.coalesce(F.col("n") > 1, F.lit(False))).alias("repeated")
    )


def remembered(total: Column, narrative: Column, routine: Column, novelty: Column, uses: Column) -> Column:
    """The narrative score after the channel's memory: routine pictures lose 0.20, in a new place they gain 0.10; between 0 and 1."""
    change = F.when(novelty, 0.10).otherwise(-0.20)
    return F.when(routine & (uses > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(narrative, F.lit(0.5)) + change))).otherwise(narrative)
