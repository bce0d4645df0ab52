"""Sources: subtitle files, window logs, probe JSON, capture clocks, companion files, file kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cutroom.functions.scalars import file_name, once

#: What a file is by its extension.
VIDEO = ("3gp", "avi", "insv", "m2ts", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "mts", "webm")
PHOTO = ("jpg", "jpeg", "png", "heic", "heif", "webp", "tiff", "tif")
RAW = ("arw", "dng")
#: Share of steps off the mean step from which a recording counts as one of variable frame rate.
IRREGULAR, STEP_TOLERANCE = 0.05, 0.10


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"[^.]\.([^.]+)$", 1))


def media_kind(path: Column) -> Column:
    """video or photo by extension, raw pictures being photos; null for anything else."""
    return F.when(_extension(path).isin(*PHOTO, *RAW), "photo").when(_extension(path).isin(*VIDEO), "video")


def is_raw(path: Column) -> Column:
    return _extension(path).isin(*RAW)


def importable(path: Column) -> Column:
    """Whether a media file is taken: nothing hidden and nothing inside a package (a folder whose name has an extension of one)."""
    hidden = F.rlike(path, F.lit(r"/\.[^/]*"))
    package = F.rlike(path, F.lit(r"(?i)\.(photoslibrary|photolibrary|fcpbundle|imovielibrary|aplibrary|lrdata|app|bundle)/"))
    return media_kind(path).isNotNull() & ~hidden & ~package


def list_media(spark: SparkSession, folder: str) -> DataFrame:
    """Media files under a folder: path, kind, length, modificationTime. Contents are not read; hidden files and packages are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).drop("content")
    return files.withColumn("kind", media_kind(F.col("path"))).where(importable(F.col("path")))


def clock_ms(text: Column) -> Column:
    """HH:MM:SS,mmm in milliseconds; null for anything else."""
    part = lambda k: F.regexp_extract(F.trim(text), r"^(\d{2,}):([0-5]\d):([0-5]\d)[,.](\d{3})$", k)
    ms = part(1).try_cast("long") * 3_600_000 + part(2).try_cast("long") * 60_000 + part(3).try_cast("long") * 1000 + part(4).try_cast("long")
    return F.when(part(1) != "", ms)


def parse_srt(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Cues of subtitle texts: keys, cue (the number that the file gives), start_ms, end_ms, text, fault.

    Cues without words are dropped. What a strict reader refuses keeps its row and says why in fault: number
    (none given), clock (unreadable times), order (an end before its start); the rest of the text is read on.
    """
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), "^﻿", "")
    blocks = df.select(*keys, F.posexplode(F.split(F.trim(clean), r"\n{2,}")).alias("block", "b"))
    lines = blocks.select(*keys, "block", F.filter(F.split("b", "\n"), lambda x: F.trim(x) != "").alias("l"))
    at = F.when(F.get("l", F.lit(0)).contains("-->"), 0).otherwise(1)
    times = F.split(F.get(F.col("l"), at), r"\s*-->\s*")
    words = F.array_join(F.slice("l", at + 2, F.greatest(F.size("l"), F.lit(1))), "\n")
    number = F.when(at == 1, F.trim(F.get("l", F.lit(0)))).try_cast("long")
    cues = lines.where(F.size("l") > 0).select(
        *keys, "block", number.alias("cue"), clock_ms(F.get(times, F.lit(0))).alias("start_ms"), clock_ms(F.get(times, F.lit(1))).alias("end_ms"), F.trim(words).alias("text")
    ).where("text <> ''")
    fault = F.when(F.col("cue").isNull(), "number").when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "clock").when(F.col("end_ms") < F.col("start_ms"), "order")
    return cues.withColumn("fault", fault).drop("block")


def parse_window_log(df: DataFrame, keys: list[str], order: str, text: str, header: str, names: list[str]) -> DataFrame:
    """Window rows out of log lines: a header line, with the window's time in group 1, opens a block; k=v lines fill it.

    A value named twice in a block counts last; lines before the first header are none.
    """
    line = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract(text, header, 1)
    rows = df.withColumn("_t", F.when(head != "", head.try_cast("double"))).withColumn("win_index", F.sum(F.col("_t").isNotNull().cast("long")).over(line) - 1).where("win_index >= 0")
    pair = lambda n: F.max_by(F.when(F.regexp_extract(text, rf"(?:^|\s){n}=(\S+)", 1) != "", F.regexp_extract(text, rf"(?:^|\s){n}=(\S+)", 1)), F.when(F.regexp_extract(text, rf"(?:^|\s){n}=(\S+)", 1) != "", F.col(order))).try_cast("double").alias(n)
    return rows.groupBy(*keys, "win_index").agg(F.max("_t").alias("t"), *[pair(n) for n in names])


_STREAM = (
    "struct<codec_type:string,width:string,height:string,time_base:string,r_frame_rate:string,avg_frame_rate:string,codec_time_base:string,duration_ts:string,duration:string,"
    "sample_rate:string,channels:string,tags:map<string,string>,side_data_list:array<struct<rotation:string>>>"
)
_PROBE = f"struct<streams:array<{_STREAM}>,format:struct<duration:string,tags:map<string,string>>>"


def fraction(text: Column) -> Column:
    """struct<num, den> of a fraction with parts above 0; null for anything else."""
    parts = F.split(text, "/")
    num, den = F.get(parts, F.lit(0)).try_cast("long"), F.when(F.size(parts) == 2, F.get(parts, F.lit(1)).try_cast("long")).when(F.size(parts) == 1, F.lit(1).cast("long"))
    return F.when((num > 0) & (den > 0), F.struct(num.alias("num"), den.alias("den")))


def tag(tags: Column, name: str) -> Column:
    """A tag's value, whatever the case of its name."""
    return F.get(F.transform(F.filter(F.map_entries(tags), lambda e: F.lower(e["key"]) == name), lambda e: e["value"]), F.lit(0))


def parse_probe(text: Column) -> Column:
    """A typed row out of probe JSON: of the first video stream, with fallbacks; fields that are missing are null.

    The rate is the average one, else the nominal; a recording has a variable rate where both are known and
    differ or the codec's time base is none. The length in ticks is the stream's, else its seconds', else the file's.
    """
    return once(F.from_json(text, _PROBE), _typed)


def _typed(probe: Column) -> Column:
    first = lambda kind: F.get(F.filter(probe["streams"], lambda s: s["codec_type"] == kind), F.lit(0))
    v, a, whole = first("video"), first("audio"), probe["format"]
    base, nominal, average = fraction(v["time_base"]), fraction(v["r_frame_rate"]), fraction(v["avg_frame_rate"])
    rate = F.coalesce(average, nominal)
    ticks = lambda seconds: F.floor(seconds.try_cast("double") * base["den"] / base["num"] + 0.5).cast("long")
    side = F.get(F.filter(F.transform(v["side_data_list"], lambda d: d["rotation"].try_cast("long")), lambda r: r.isNotNull()), F.lit(0))
    differs = nominal["num"] * average["den"] != average["num"] * nominal["den"]
    return F.struct(
        v["width"].try_cast("long").alias("width"), v["height"].try_cast("long").alias("height"), base["num"].alias("tb_num"), base["den"].alias("tb_den"),
        rate["num"].alias("fps_num"), rate["den"].alias("fps_den"),
        (F.coalesce(differs, F.lit(False)) | (v["codec_time_base"].isNotNull() & fraction(v["codec_time_base"]).isNull())).alias("is_vfr"),
        F.coalesce(v["duration_ts"].try_cast("long"), ticks(v["duration"]), ticks(whole["duration"])).alias("duration_ticks"),
        F.coalesce(tag(whole["tags"], "creation_time"), tag(v["tags"], "creation_time")).alias("created"),
        F.when(a["sample_rate"].try_cast("long") > 0, a["sample_rate"].try_cast("long")).alias("audio_rate"),
        F.pmod(F.coalesce(side, tag(v["tags"], "rotate").try_cast("long")), F.lit(360)).alias("rotation"),
    )


def audio_streams(text: Column) -> Column:
    """array<struct<channels, rate>> of the audio streams of probe JSON, in the file's order."""
    heard = F.filter(F.from_json(text, _PROBE)["streams"], lambda s: s["codec_type"] == "audio")
    return F.transform(heard, lambda s: F.struct(s["channels"].try_cast("long").alias("channels"), s["sample_rate"].try_cast("long").alias("rate")))


def frame_times(text: Column) -> Column:
    """Sorted distinct times of frame JSON; frames without a time are none."""
    frames = F.from_json(text, "struct<frames:array<struct<best_effort_timestamp:string,pts:string>>>")["frames"]
    times = F.transform(frames, lambda f: F.coalesce(f["best_effort_timestamp"], f["pts"]).try_cast("long"))
    return F.array_sort(F.array_distinct(F.filter(times, lambda t: t.isNotNull())))


def variable_rate(times: Column) -> Column:
    """Whether more than a twentieth of the steps between sorted times differ from their mean by more than a tenth; fewer than two steps never do."""
    steps = F.zip_with(F.slice(times, 2, F.greatest(F.size(times) - 1, F.lit(0))), F.slice(times, 1, F.greatest(F.size(times) - 1, F.lit(0))), lambda b, a: b - a)
    mean = (F.element_at(times, -1) - F.element_at(times, 1)) / (F.size(times) - 1)
    off = F.size(F.filter(steps, lambda d: F.abs(d - mean) > STEP_TOLERANCE * mean))
    return F.when(F.size(times) >= 3, off / (F.size(times) - 1) > IRREGULAR).otherwise(False)


def cut_times(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Seconds of the frames that a scene filter's log names: keys, seconds; other lines are none, repeats one."""
    found = F.when(F.col(text).contains("showinfo"), F.regexp_extract(text, r"\bpts_time:\s*(\d+(?:\.\d+)?)", 1))
    return df.select(*keys, found.try_cast("double").alias("seconds")).where("seconds is not null").distinct()


def signal_totals(df: DataFrame, keys: list[str], text: str, names: list[str]) -> DataFrame:
    """Count, mean, least and greatest of each named signal (name=value or name:value) over a whole log; broken numbers are none."""
    value = lambda n: F.regexp_extract(text, rf"(?:^|[\s.]){n}[=:]\s*(-?\d+(?:\.\d+)?)(?:\s|$)", 1).try_cast("double")
    every = [agg(value(n)).alias(f"{n.lower()}_{kind}") for n in names for kind, agg in (("n", F.count), ("mean", F.avg), ("min", F.min), ("max", F.max))]
    return df.groupBy(*keys).agg(*every)


def ocr_lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Texts out of JSON lines {"t": tick, "text": ..., "confidence": ...}: keys, tick, text, confidence (0 to 1). Broken lines and empty texts are none."""
    each = df.select(*keys, F.explode(F.split(F.col(text), "\n")).alias("_l")).select(*keys, F.from_json("_l", "struct<t:bigint,text:string,confidence:double>").alias("_j"))
    rows = each.select(*keys, F.col("_j.t").alias("tick"), F.trim("_j.text").alias("text"), F.col("_j.confidence").alias("confidence"))
    return rows.where("tick is not null and text <> ''").withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.0)))))


def quick_hash(content: Column, size: Column, chunk: int = 4 << 20) -> Column:
    """Identity of a file by its first and last chunk and its size; a shorter one is hashed whole in both."""
    ends = F.concat(F.substring(content, 1, chunk), F.substring(content, F.greatest(F.length(content) - chunk + 1, F.lit(1)), F.lit(chunk)))
    return F.sha2(F.concat(ends, size.cast("string").cast("binary")), 256)


def manifest_fixtures(df: DataFrame, text: str) -> DataFrame:
    """Fixtures of evaluation manifests, a group's defaults under each fixture's own values: group_id, id, scenario, golden, tolerance_us, boundaries."""
    kind = "struct<group:struct<id:string>,defaults:struct<golden:boolean,scene_tolerance_us:bigint>,fixtures:array<struct<id:string,scenario:string,golden:boolean,scene_tolerance_us:bigint,scene_boundaries_us:array<bigint>>>>"
    rows = df.select(F.from_json(text, kind).alias("m")).select("m.group.id", "m.defaults", F.explode("m.fixtures").alias("f"))
    return rows.select(
        F.col("id").alias("group_id"), F.col("f.id").alias("id"), F.col("f.scenario").alias("scenario"), F.coalesce("f.golden", "defaults.golden", F.lit(False)).alias("golden"),
        F.coalesce("f.scene_tolerance_us", "defaults.scene_tolerance_us").alias("tolerance_us"), F.col("f.scene_boundaries_us").alias("boundaries"),
    )


def offset_seconds(text: Column) -> Column:
    """UTC+HH:MM, +HHMM or +HH:MM in seconds; null for anything else."""
    part = lambda k: F.regexp_extract(text, r"^(?:UTC)?([+-])(\d{2}):?([0-5]\d)$", k)
    size = part(2).try_cast("int") * 3600 + part(3).try_cast("int") * 60
    return F.when(part(1) == "-", -size).when(part(1) == "+", size)


def capture_time(local: Column, offset: Column) -> Column:
    """UTC of a camera's wall clock (YYYY:MM:DD HH:MM:SS) and zone text; without a zone the clock counts as UTC."""
    return F.timestamp_seconds(F.unix_timestamp(F.try_to_timestamp(local, F.lit("yyyy:MM:dd HH:mm:ss"))) - F.coalesce(offset_seconds(offset), F.lit(0)))


def companions(files: DataFrame, path: str) -> DataFrame:
    """Files of one folder and stem beside a photo or raw: primary, companion."""
    stem = F.lower(F.regexp_replace(F.col(path), r"\.[^./]*$", ""))
    rows = files.select(F.col(path).alias("p"), stem.alias("stem"), (media_kind(F.col(path)) == "photo").alias("photo"), is_raw(F.col(path)).alias("raw"))
    primary = rows.where("photo and not raw").groupBy("stem").agg(F.min("p").alias("primary"))
    return rows.join(primary, "stem").where("p <> primary").select("primary", F.col("p").alias("companion"))


def duplicate_files(files: DataFrame, quick: str, full: str, size: str, ident: str, small: int = 8 << 20) -> DataFrame:
    """Files that repeat an earlier one: equal quick hash and size, confirmed by the full hash where the file is not small."""
    first = F.min(ident).over(Window.partitionBy(quick, size, F.when(F.col(size) > small, F.col(full)).otherwise(F.lit("")), (F.col(size) > small) & F.col(full).isNull()))
    rows = files.where(F.col(quick).isNotNull()).withColumn("original", first)
    return rows.where((F.col(ident) != F.col("original")) & ((F.col(size) <= small) | F.col(full).isNotNull())).select(ident, "original")
