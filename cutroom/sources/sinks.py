"""Sinks: shot lists, subtitles, nested drafts and dumps, written by Spark's own writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutroom.functions.scalars import clock, guard_formula
from cutroom.operators.windows import placed
from cutroom.session import settle

#: What may come after a draft's one video track (fixed values).
TRAILING = ("", "audio", "text", "text,audio")


def shot_list(df: DataFrame) -> DataFrame:
    """Every column as text, cells that a spreadsheet would run guarded, null as empty."""
    return df.select(*[guard_formula(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in df.columns])


def write_shot_list(df: DataFrame, path: str) -> None:
    shot_list(df).write.mode("overwrite").option("header", True).option("quoteAll", True).option("lineSep", "\r\n").option("escape", '"').csv(path)


#: The columns of a shot list as an editor's spreadsheet shows them; a mark of byte order begins the file.
SHOT_COLUMNS = ("顺序号", "文件名", "包内路径", "入点", "出点", "段时长", "分辨率", "编码", "FPS", "VFR", "拍摄时间", "Chapter", "Beat", "星级", "L1角标摘要", "对白摘要", "平台", "画布", "转录音轨", "备注")
BYTE_ORDER, FOLDER, DONE, WAITING, YES, NO = "\ufeff", "Selected", "已导出", "等待处理", "是", "否"


def shot_rows(clips: DataFrame, delivery: str, order: list[Column]) -> DataFrame:
    """The delivery and the SHOT_COLUMNS of its clips, numbered from 1 in order, which must tell them apart; a delivery may be of any size.

    clips: the delivery, file, output, start and seconds, width, height, codec, fps_num, fps_den, vfr, taken, chapter, beat, stars, badges, dialogue,
    platform, canvas_width, canvas_height, track (the one transcribed), tracks (how many were found), status and note. What is
    unknown is an empty cell; a track is named where one was chosen or found.
    """
    c = F.col
    rows = placed(clips.withColumn("_one", F.lit(1)), [delivery], order, "_one", "_n", "_before")
    ms = lambda seconds: F.floor(F.greatest(seconds, F.lit(0.0)) * 1000 + 0.5)
    begin = F.coalesce("start", F.lit(0.0))
    size = lambda w, h, x: F.concat(w.cast("string"), F.lit(x), h.cast("string"))
    cells = [
        c("_n"), c("file"), F.concat(F.lit(f"{FOLDER}/"), "output"), clock(ms(begin)), clock(ms(begin + c("seconds"))), clock(ms(c("seconds"))), size(c("width"), c("height"), "×"), c("codec"),
        F.when(c("fps_den") > 0, F.format_string("%.3f", c("fps_num") / c("fps_den"))), F.when(c("vfr"), YES).otherwise(NO), c("taken"), c("chapter"), c("beat"), c("stars"), c("badges"), c("dialogue"), c("platform"),
        size(c("canvas_width"), c("canvas_height"), "x"), F.when(c("track").isNotNull() | (c("tracks") > 0), F.coalesce("track", F.lit(0))), F.coalesce("note", F.when(c("status") == "done", DONE).otherwise(WAITING)),
    ]
    return rows.select(delivery, *[guard_formula(F.coalesce(cell.cast("string"), F.lit(""))).alias(name) for name, cell in zip(SHOT_COLUMNS, cells, strict=True)])


def csv_line(columns: list[Column]) -> Column:
    """A line of a CSV file; cells with a comma, a quote or a line's end are quoted."""
    odd = lambda x: F.contains(x, F.lit(",")) | F.contains(x, F.lit('"')) | F.contains(x, F.lit("\r")) | F.contains(x, F.lit("\n"))
    quoted = lambda x: F.when(odd(x), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    return F.concat_ws(",", F.transform(F.array(*columns), quoted))


def write_shot_rows(rows: DataFrame, delivery: str, path: str) -> None:
    """A folder a delivery with its shot list in order: a mark of byte order, the names of the columns, lines ended by CR LF.

    The files are text, sorted inside: a delivery's lines lie in as many files as it has ranges, the first of which has the head.
    """
    head = BYTE_ORDER + ",".join(SHOT_COLUMNS)
    number = F.col(SHOT_COLUMNS[0]).cast("long")
    lines = rows.select(delivery, number.alias("_n"), csv_line([F.col(c) for c in SHOT_COLUMNS]).alias("value"))
    heads = rows.select(delivery).distinct().select(delivery, F.lit(0).cast("long").alias("_n"), F.lit(head).alias("value"))
    whole = lines.unionByName(heads).repartitionByRange(delivery, "_n").sortWithinPartitions(delivery, "_n")
    whole.select(delivery, "value").write.mode("overwrite").partitionBy(delivery).option("lineSep", "\r\n").text(path)


def subtitles(df: DataFrame, keys: list[str], start: str, end: str, text: str) -> DataFrame:
    """One subtitle text a key: numbered cues in order of time, cut where the next one starts."""
    cue = F.struct(F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), F.col(text).alias("t"))
    cues = df.groupBy(*keys).agg(F.sort_array(F.collect_list(cue)).alias("c"))
    stop = lambda c, i: F.least(c["e"], F.coalesce(F.get(F.col("c"), i + 1)["s"], c["e"]))
    block = lambda c, i: F.concat((i + 1).cast("string"), F.lit("\n"), clock(c["s"], True), F.lit(" --> "), clock(stop(c, i), True), F.lit("\n"), c["t"], F.lit("\n"))
    return cues.select(*keys, F.array_join(F.transform("c", block), "\n").alias("srt"))


def drafts(df: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """One JSON draft a key: its segments in order as nested objects."""
    held = F.sort_array(F.collect_list(F.struct(order, *fields)))
    return df.groupBy(*keys).agg(F.to_json(F.struct(F.lit(1).alias("version"), held.alias("segments"))).alias("draft"))


def _gaps(video: DataFrame) -> DataFrame:
    """(draft, _gap) of drafts whose segments do not follow each other from 0 on in order of place; so are those with a segment that is off.

    Segments that last follow each other if no two start at once and each starts at 0 or where one of an earlier place ends: each
    then has one before it, back to the one at 0, and none has two after it. So moments tell, whatever a draft holds of them.
    """
    nowhere = F.lit(None).cast(video.schema["place"].dataType)
    begin = F.struct(F.col("start").alias("t"), "_off", F.lit(1).alias("begins"), F.lit(0).alias("ends"), F.col("place").alias("first"), nowhere.alias("last"))
    end = F.struct((F.col("start") + F.col("duration")).alias("t"), F.col("_off"), F.lit(0).alias("begins"), F.lit(1).alias("ends"), nowhere.alias("first"), F.col("place").alias("last"))
    moments = video.select("draft", F.inline(F.array(begin, end))).groupBy("draft", "t").agg(
        F.max("_off").alias("off"), F.sum("begins").alias("begins"), F.sum("ends").alias("ends"), F.min("first").alias("first"), F.min("last").alias("last")
    )
    earlier = (F.col("last") < F.col("first")) | F.col("last").isNull() & F.col("first").isNotNull()  # a place that is null comes first
    sound = (F.col("begins") == 0) | (F.col("begins") == 1) & ~F.col("off") & ((F.col("t") == 0) | (F.col("ends") == 1) & earlier)
    return moments.where(~F.coalesce(sound, F.lit(False))).select("draft", F.lit(True).alias("_gap")).distinct()


def draft_faults(drafts: DataFrame, tracks: DataFrame, segments: DataFrame, materials: DataFrame, version: str) -> DataFrame:
    """(draft, fault) of drafts that an editor would not open, each fault of a draft once.

    drafts: draft, name, version, duration; tracks: draft, track (from 0), kind; segments: draft, track, place, start, duration,
    source_start, source_duration, material; materials: draft, material, kind, path, duration. A sound draft has this version and a
    name, a video track first and then at most text and audio; its video segments follow each other from 0 on without a gap and
    last as long as the draft, each of a source range as long as itself and a video material of the draft, and
    there are as many materials; paths are absolute. Its music is one segment from 0 on, no longer than draft and material.
    Rows of drafts that are not in drafts are ignored.
    """
    known = drafts.select("draft", F.col("name").alias("_name"), F.col("version").alias("_version"), F.col("duration").alias("_whole"))
    line = tracks.groupBy("draft").agg(F.sort_array(F.collect_list(F.struct("track", "kind"))).alias("t"))
    kinds = F.transform("t", lambda t: t["kind"])
    shape = known.join(line, "draft", "left").select(
        "draft", "_name", "_version", "_whole", F.coalesce(F.get(kinds, F.lit(0)), F.lit("")).alias("first"), F.array_join(F.slice(kinds, 2, 99), ",").alias("rest"), (F.size(F.filter("t", lambda t: t["kind"] == "audio")) > 0).alias("music")
    )
    off = (F.col("duration") <= 0) | (F.col("source_start") < 0) | (F.col("source_duration") != F.col("duration"))
    video = segments.where("track = 0").withColumn("_off", F.coalesce(off, F.lit(True)))
    own = materials.where("kind = 'video'").select("draft", "material", F.lit(True).alias("_met")).distinct()
    told = video.join(own, ["draft", "material"], "left").groupBy("draft").agg(F.count("*").alias("segments"), F.sum("duration").alias("total"), F.max(F.col("_off") | F.col("_met").isNull()).alias("broken"))
    told = told.join(_gaps(video), "draft", "left").withColumn("broken", F.col("broken") | F.col("_gap").isNotNull())
    held = materials.groupBy("draft").agg(
        F.count_if(F.col("kind") == "video").alias("videos"), F.count_if(F.col("kind") == "audio").alias("audios"), F.max(~F.coalesce(F.startswith("path", F.lit("/")), F.lit(False))).alias("loose")
    )
    sound = tracks.where("kind = 'audio'").select("draft", "track").join(segments, ["draft", "track"])
    piece = sound.join(materials.where("kind = 'audio'").select("draft", "material", F.col("duration").alias("_long")), ["draft", "material"], "left")
    music = piece.groupBy("draft").agg(F.count("*").alias("pieces"), F.max("duration").alias("played"), F.max(F.coalesce((F.col("start") != 0) | (F.col("source_start") != 0) | (F.col("duration") <= 0) | (F.col("duration") != F.col("source_duration")) | (F.col("duration") > F.col("_long")), F.lit(True))).alias("off"))
    rows = shape.join(told, "draft", "left").join(held, "draft", "left").join(music, "draft", "left").na.fill(0, ["segments", "total", "videos", "audios", "pieces", "played"]).na.fill(False, ["broken", "loose", "off", "music"])
    tests: dict[str, Column] = {
        "version": ~F.coalesce(F.col("_version") == version, F.lit(False)), "name": F.coalesce(F.col("_name"), F.lit("")) == "", "tracks": (F.col("first") != "video") | ~F.col("rest").isin(*TRAILING),
        "counts": F.col("segments") != F.col("videos"), "timeline": F.col("broken"), "duration": ~F.coalesce(F.col("_whole") == F.col("total"), F.lit(False)), "path": F.col("loose"),
        "music count": F.col("audios") != F.col("music").cast("long"), "music": F.col("music") & ((F.col("pieces") != 1) | F.col("off") | (F.col("played") > F.col("total"))),
    }
    faults = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), name) for name, test in tests.items()]))
    return rows.select("draft", F.explode(faults).alias("fault"))


def publish(parts: dict[str, DataFrame], path: str) -> None:
    """Write several tables that count only together: each part first, and then a marker with their numbers of rows.

    What was published under the path is refused to be written over; what a failed attempt left there is not published and is.
    """
    spark = next(iter(parts.values())).sparkSession
    if _marker(spark, path) is not None:
        raise FileExistsError(f"{path} is published already")
    counts = []
    for name, df in parts.items():
        held = settle(df)  # what is counted is what is written
        held.write.mode("overwrite").parquet(f"{path}/{name}")
        counts.append((name, held.count()))
    spark.createDataFrame(counts, "part string, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/_published")


def _marker(spark: SparkSession, path: str) -> dict[str, int] | None:
    try:
        return {r.part: r.n for r in spark.read.parquet(f"{path}/_published").collect()}
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
            return None
        raise


def published(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts of what publish() has finished, each with as many rows as its marker says."""
    counts = _marker(spark, path)
    if counts is None:
        raise FileNotFoundError(f"{path} is not published")
    found = {name: spark.read.parquet(f"{path}/{name}") for name in counts}
    for name, df in found.items():
        if (n := df.count()) != counts[name]:
            raise ValueError(f"{path}/{name} has {n} rows, not {counts[name]}")
    return found


def dump(tables: dict[str, DataFrame], path: str) -> None:
    """Every table as JSON lines in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
