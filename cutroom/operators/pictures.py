"""Motion of clips and quality of pictures, from gray frames in rows.

Frames meet their neighbours in blocks that borrow one frame, so a clip of any length is spread over tasks; what a
clip's pairs of frames say together is sums, medians by ranges, and neighbours within two places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutroom.functions import pictures
from cutroom.functions.kernels import laplacian_variance
from cutroom.operators.windows import interpolated_percentiles, placed
from cutroom.session import settle, ship, tasks

#: Frames of a block, pairs of one, and frames that a task compares, about.
FRAMES, PAIRS, TASK = 32, 1024, 2048
#: Frames a second, pixels a frame of a clip that stands still, and what zoom, direction and agreement must reach (fixed values).
FPS, STILL, ZOOM, DIRECTION, AGREEMENT = 2, 0.5, 0.6, 0.7, 0.6
#: Pixels of high-frequency motion that can be a shake, and its share of all motion in a shaky clip.
SHAKE_PIXELS, SHAKY = 2.0, 0.15


def frame_pairs(frames: DataFrame, keys: list[str], order: str, frame: str | Column | Callable[..., bytes]) -> DataFrame:
    """(keys, pair, dx, dy, zoom, residual, agreement) of every two neighbouring frames of a clip, pairs counted from 0.

    Frames are SIDE x SIDE gray bytes; order tells those of a clip apart and need not be without gaps. A null frame is
    none; one of another size is an error, as its neighbours would be paired wrongly without it. An expression in place of
    a column's name makes the frames only where they are compared, so that no frame is shuffled, only what it is made of; it makes
    one of every row. So does a function, a decoder that is called in the tasks with a row's values, by the names of the columns other
    than keys and order; rows come clip by clip and in order, so what it keeps of the last ones serves the next.
    """
    ship(frames.sparkSession)
    if isinstance(frame, str):
        known = frames.where(F.col(frame).isNotNull())
        at = placed(known.select(*keys, order).withColumn("_one", F.lit(1)), keys, [F.col(order)], "_one").select(*keys, order, (F.col("place") - 1).alias("_at"))
        held, seen, n = known.select(*keys, order, F.col(frame).alias("_frame")).join(at, [*keys, order]), F.col("_frame"), at.count()
    else:
        held = placed(frames.withColumn("_one", F.lit(1)), keys, [F.col(order)], "_one").withColumn("_at", F.col("place") - 1)
        seen = F.struct(*[c for c in frames.columns if c not in (*keys, order)]) if callable(frame) and not isinstance(frame, Column) else frame
        n = held.count()
    decode = None if isinstance(frame, str | Column) else frame
    own = F.floor(F.col("_at") / FRAMES)
    # the first frame of a block ends the pairs of the block before
    to = F.when(F.col("_at") % FRAMES == 0, F.array(own, own - 1)).otherwise(F.array(own))
    blocks = held.withColumn("_block", F.explode(to)).where("_block >= 0").repartition(n // TASK + 1, *keys, "_block").sortWithinPartitions(*keys, "_block", "_at")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema if f.name in keys)
    kinds = [pa.int64()] + [pa.float64()] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, b""
        for batch in batches:
            places, out = [], []
            clips = zip(*(batch.column(k).to_pylist() for k in [*keys, "_block"]), strict=True)
            for i, (clip, at, data) in enumerate(zip(clips, batch.column("_at").to_pylist(), batch.column("_frame"), strict=True)):
                after = decode(**data.as_py()) if decode else data.as_py()
                if after is None or len(after) != pictures.SIDE**2:
                    raise ValueError(f"a frame has {pictures.SIDE**2} bytes, not {after and len(after)}")
                if clip == last:
                    places.append(i)
                    out.append((at - 1, *pictures.motion_vector(before, after)))
                last, before = clip, after
            held = [batch.column(k).take(pa.array(places, pa.int64())) for k in keys]
            yield pa.RecordBatch.from_arrays([*held, *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds))], [*keys, "pair", "dx", "dy", "zoom", "residual", "agreement"])

    return blocks.select(*keys, "_block", "_at", seen.alias("_frame")).mapInArrow(run, f"{types}, pair bigint, dx double, dy double, zoom double, residual double, agreement double")


def _with_neighbours(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs with the two before (_b1, _b2) and after (_a1, _a2), looked up in blocks that borrow their neighbours' edges."""
    own = F.floor(F.col("pair") / PAIRS)
    block = F.explode(F.array_distinct(F.array(own, F.floor((F.col("pair") - 2) / PAIRS), F.floor((F.col("pair") + 2) / PAIRS))))
    line = Window.partitionBy(*keys, "_block").orderBy("pair")
    seen = F.struct("dx", "dy", (F.col("agreement") >= AGREEMENT).alias("ok"))
    rows = pairs.withColumn("_block", block)
    rows = rows.select("*", *[F.lead(seen, k).over(line).alias(f"_a{k}") for k in (1, 2)], *[F.lag(seen, k).over(line).alias(f"_b{k}") for k in (1, 2)])
    return rows.where(F.col("_block") == own).drop("_block")


def _shakes(pairs: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, scope, shake): the share of high-frequency motion, over the whole clip, its first and last third, and each second.

    Only runs of three and more pairs whose blocks agree count; what a pair's motion has beyond the mean of itself
    and its neighbours in the run is high-frequency. A scope cuts the runs at its ends.
    """
    n, i = F.col("n"), F.col("pair")
    third = F.ceil(n / 3)
    second = lambda k: F.struct(F.concat(F.lit("second "), k.cast("string")).alias("scope"), F.greatest(F.lit(0), k * FPS - 1).alias("low"), F.least((k + 1) * FPS + 1, n).alias("high"))
    scopes = F.concat(
        F.array(F.struct(F.lit("whole").alias("scope"), F.lit(0).cast("long").alias("low"), n.alias("high"))),
        F.when(i < third, F.array(F.struct(F.lit("start").alias("scope"), F.lit(0).cast("long").alias("low"), third.alias("high")))).otherwise(F.array()),
        F.when(i >= n - third, F.array(F.struct(F.lit("end").alias("scope"), (n - third).alias("low"), n.alias("high")))).otherwise(F.array()),
        F.transform(F.sequence(F.greatest(F.lit(0).cast("long"), F.ceil((i - FPS) / FPS)), F.least(F.floor((i + 1) / FPS), F.ceil(n / FPS) - 1)), second),
    )
    rows = _with_neighbours(pairs, keys).join(sizes, keys).withColumn("s", F.explode(scopes))
    low, high = F.col("s.low"), F.col("s.high")

    def met(name: str, step: int) -> Column:
        return F.coalesce(F.col(f"{name}.ok"), F.lit(False)) & (i + step >= low) & (i + step < high)

    rows = rows.where(F.col("agreement") >= AGREEMENT).select("*", met("_b1", -1).alias("b1"), met("_a1", 1).alias("a1"), met("_b2", -2).alias("b2"), met("_a2", 2).alias("a2"))
    rows = rows.where("(b1 and b2) or (b1 and a1) or (a1 and a2)")

    def beyond(axis: str) -> Column:
        near = F.col(axis) + F.when(F.col("b1"), F.col(f"_b1.{axis}")).otherwise(0) + F.when(F.col("a1"), F.col(f"_a1.{axis}")).otherwise(0)
        return F.col(axis) - near / (1 + F.col("b1").cast("int") + F.col("a1").cast("int"))

    sums = rows.groupBy(*keys, "s.scope").agg(
        F.count("*").alias("trusted"), F.sum(F.col("dx") ** 2 + F.col("dy") ** 2).alias("total"), F.sum(beyond("dx") ** 2 + beyond("dy") ** 2).alias("beyond")
    )
    moved = (F.col("trusted") >= 3) & (F.col("total") > STILL**2 * F.col("trusted")) & (F.col("beyond") / F.col("trusted") >= SHAKE_PIXELS**2)
    return sums.select(*keys, "scope", F.when(moved, F.least(F.lit(1.0), F.col("beyond") / F.col("total"))).otherwise(0.0).alias("shake"))


def clip_motion(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """What a clip's frame_pairs() say together.

    Returns keys, class (zoom, static, pan, tilt, else handheld), pan_ratio, tilt_ratio, zoom_corr, shake_score, is_shaky,
    sample_pairs, mean_magnitude, residual_rms, direction_coherence, trusted_pairs, start_shake, end_shake and second_shake
    (an array by second). A clip without pairs has no row.
    """
    pairs = settle(pairs)
    pairs = pairs.coalesce(tasks(pairs))  # those that compare frames hold a few rows each
    dx, dy, size = F.col("dx"), F.col("dy"), F.hypot("dx", "dy")
    told = lambda a, b: (F.abs(a) > F.abs(b)) & (F.abs(a) >= STILL)
    count = lambda c: F.sum(c.cast("long"))
    clips = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(dx)).alias("mx"), F.avg(F.abs(dy)).alias("my"), F.avg(size).alias("mean_magnitude"), F.avg("residual").alias("residual_rms"),
        F.greatest(count(told(dx, dy) & (dx > 0)), count(told(dx, dy) & (dx <= 0))).alias("pan"), F.greatest(count(told(dy, dx) & (dy > 0)), count(told(dy, dx) & (dy <= 0))).alias("tilt"),
        count(F.col("agreement") >= AGREEMENT).alias("trusted_pairs"), F.avg(F.when(size >= STILL, dx)).alias("vx"), F.avg(F.when(size >= STILL, dy)).alias("vy"), count(size >= STILL).alias("moving"),
    )
    along = pairs.join(clips.where(F.hypot("vx", "vy") >= STILL).select(*keys, "vx", "vy"), keys).where((size >= STILL) & (dx * F.col("vx") + dy * F.col("vy") > 0)).groupBy(*keys).agg(F.count("*").alias("along"))
    zoom = interpolated_percentiles(pairs.select(*keys, "pair", "zoom"), keys, "zoom", [F.col("pair")], {"zoom_corr": 0.5})
    shakes = _shakes(pairs, clips.select(*keys, "n"), keys)
    named = shakes.where("scope not like 'second%'").groupBy(*keys).agg(*[F.max(F.when(F.col("scope") == s, F.col("shake"))).alias(s) for s in ("whole", "start", "end")])
    # one number a second: a clip's row holds them as the catalogue does
    second = shakes.where("scope like 'second%'").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.substring("scope", 8, 20).cast("long"), "shake"))).alias("seconds"))
    rows = clips.join(zoom, keys).join(along, keys, "left").join(named, keys, "left").join(second, keys, "left")
    pan, tilt = F.col("pan") / F.col("n"), F.col("tilt") / F.col("n")
    kind = (
        F.when(F.abs("zoom_corr") > ZOOM, "zoom").when(F.col("mean_magnitude") < STILL, "static")
        .when((F.col("mx") > F.col("my")) & (pan > DIRECTION), "pan").when((F.col("my") > F.col("mx")) & (tilt > DIRECTION), "tilt").otherwise("handheld")
    )
    none = F.lit(0.0)
    by_second = F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / FPS) - 1), lambda k: F.coalesce(F.try_element_at("seconds", k), none))
    return rows.select(
        *keys, kind.alias("class"), pan.alias("pan_ratio"), tilt.alias("tilt_ratio"), "zoom_corr", F.coalesce("whole", none).alias("shake_score"), (F.coalesce("whole", none) > SHAKY).alias("is_shaky"),
        F.col("n").alias("sample_pairs"), "mean_magnitude", "residual_rms", F.when(F.col("moving") > 0, F.coalesce(F.col("along") / F.col("moving"), none)).otherwise(none).alias("direction_coherence"),
        "trusted_pairs", F.coalesce("start", none).alias("start_shake"), F.coalesce("end", none).alias("end_shake"), by_second.alias("second_shake"),
    )


def sharpness(frames: DataFrame, frame: str, width: str, height: str) -> DataFrame:
    """Rows with sharpness, the variance of the four-neighbour Laplacian of their gray picture: 0 without an inside, null where bytes are not width x height."""
    ship(frames.sparkSession)

    @F.pandas_udf("double")
    def measure(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for held, wide, high in parts:
            yield pd.Series([laplacian_variance(np.frombuffer(d, np.uint8).reshape(int(h), int(w))) if d and w == w and h == h and len(d) == int(w) * int(h) else None for d, w, h in zip(held, wide, high, strict=True)], dtype="float64")

    return frames.withColumn("sharpness", measure(frame, width, height))


#: What exposure() tells of a picture.
_EXPOSURE = "worst_cell:int,exposure:string,severity:double"


def _told(frames: DataFrame, frame: str, width: str, height: str, fields: str, tell: Callable[[np.ndarray], tuple]) -> DataFrame:
    """Rows with what tell says of their gray picture; null for a null picture or one whose bytes are not width x height."""
    ship(frames.sparkSession)
    names = [f.split(":")[0] for f in fields.split(",")]

    @F.pandas_udf(f"struct<{fields}>")
    def measure(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for held, wide, high in parts:
            out = []
            for data, w, h in zip(held, wide, high, strict=True):
                if data is None or w is None or h is None or w != w or h != h or len(data) != int(w) * int(h) or not data:
                    out.append((None,) * len(names))
                else:
                    out.append(tell(np.frombuffer(data, np.uint8).reshape(int(h), int(w))))
            yield pd.DataFrame(out, columns=names).astype({"worst_cell": "Int32"})

    return frames.withColumn("_q", measure(frame, width, height)).select(*frames.columns, "_q.*")


def exposures(frames: DataFrame, frame: str, width: str, height: str) -> DataFrame:
    """Rows with worst_cell, exposure and severity (of the worst of nine cells) of their gray picture, and nothing that costs more; null as in picture_quality()."""
    return _told(frames, frame, width, height, _EXPOSURE, pictures.exposure)


def picture_quality(frames: DataFrame, frame: str, width: str, height: str) -> DataFrame:
    """Rows with worst_cell, exposure, severity (of the worst of nine cells), tilt and saliency_sharpness of their gray picture.

    Null where a picture does not tell; all are null for a null picture or one whose bytes are not width x height.
    """
    return _told(frames, frame, width, height, f"{_EXPOSURE},tilt:double,saliency_sharpness:double", lambda gray: (*pictures.exposure(gray), pictures.tilt(gray), pictures.salient_sharpness(gray)))
