"""An episode's story without a model: chapters at strong boundaries, orders and picks by template, and what a draft of one must be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cutroom.operators.windows import placed, ranked
from cutroom.session import settle

#: Templates with the share of a chapter that becomes montage; the boundary that begins a chapter; a steady clip.
MONTAGE = {"cinematic": 0.35, "fastcut": 0.75, "ambient": 0.60, "diary": 0.0}
SPLIT, STEADY = 0.65, 0.50
#: What chapters, beats and downgraded beats may be, and how many chapters there may be.
CHAPTER_KINDS = ("destination", "attraction", "journey", "experience", "rv_life", "people", "unexpected", "information", "atmosphere", "transition")
BEAT_ROLES, DOWNGRADED, CHAPTERS = ("beat", "montage", "transition"), ("montage", "transition"), 40


def _by_template(**columns: Column) -> Column:
    out = F.lit(None)
    for name, column in columns.items():
        out = F.when(F.col("template") == name, column).otherwise(out)
    return out


def fallback_story(clips: DataFrame, templates: tuple[str, ...] = tuple(MONTAGE)) -> DataFrame:
    """(episode, template, clip, chapter, position, part, role) of every clip of every episode under each template.

    clips: episode, clip, place (its order, unique in the episode), boundary (0 to 1, how much it begins something new), taken
    (seconds, may be null), seconds, technical, stability, energy, and flags wide, people, establishing, reveal, experience, sunset.
    A chapter begins where boundary reaches SPLIT. A diary keeps the order of time, undated first; cinematic goes from
    reveals to experiences to the rest, fastcut from short to long, ambient puts clips without people and steady ones first. But
    for a diary the opening's chapter leads and the opening leads it; a cinematic closing ends the story. Of each chapter
    the first clips, round(n * (1 - MONTAGE)) and one at least, are beats, as are opening and closing; the rest is montage.

    Of clips that are equally fit to open or close the last one does. Episodes and chapters may be of any size.
    """
    c = F.col
    rows = placed(clips.withColumn("_new", F.when(c("boundary") >= SPLIT, 1).otherwise(0)), ["episode"], [c("place")], "_new", "_n", "_before")
    rows = settle(rows.withColumn("chapter", c("_before") + c("_new")).drop("_n", "_before", "_new"))
    empty, never = ~c("people"), F.lit(None).cast("double")
    number = lambda condition: condition.cast("int")
    tier = {"cinematic": number((c("wide") | empty | c("establishing")) & (c("stability") >= STEADY)), "fastcut": number(c("energy") > 0), "ambient": number(empty) + number(empty & c("wide")), "diary": F.lit(0)}
    fit = {"cinematic": c("technical"), "fastcut": -c("seconds"), "ambient": c("stability"), "diary": F.when(c("taken").isNull(), float("inf")).otherwise(-c("taken"))}
    # what an episode's templates open, lead, close and end with is told by a row an episode, before its clips are dealt to the templates
    turn = lambda name: -c("place") if name == "diary" else c("place")
    facts = rows.groupBy("episode").agg(*[F.max(F.struct(tier[t].alias("t"), fit[t].alias("f"), turn(t).alias("p"), c("clip").alias("clip"), c("chapter").alias("chapter"))).alias(f"_{t}") for t in templates])
    if "cinematic" in templates:
        opened = rows.join(facts.select("episode", "_cinematic"), "episode")
        close = opened.where((c("clip") != c("_cinematic.clip")) & (c("sunset") | (c("stability") >= STEADY)))
        closing = close.groupBy("episode").agg(F.max(F.struct(c("sunset").alias("t"), c("seconds").alias("f"), c("place").alias("p"), c("clip").alias("clip")))["clip"].alias("_closing"))
        facts = settle(facts.join(closing, "episode", "left"))
        others = rows.join(facts.select("episode", "_cinematic", "_closing"), "episode").where(~c("clip").eqNullSafe(c("_closing")))
        last = others.groupBy("episode").agg(F.max(F.when(c("chapter") == c("_cinematic.chapter"), -1).otherwise(c("chapter"))).alias("_last"))
        facts = facts.join(last, "episode", "left")
    else:
        facts = facts.withColumns({"_closing": F.lit(None), "_last": F.lit(None).cast("long")})
    rows = rows.join(facts, "episode").withColumn("template", F.explode(F.array(*[F.lit(t) for t in templates])))
    best = lambda field: _by_template(**{t: c(f"_{t}.{field}") for t in templates})
    closes = (c("template") == "cinematic") & (c("clip") == c("_closing"))
    part = F.when(c("clip") == best("clip"), "opening").when(closes, "closing").otherwise("body")
    chapter = F.when(c("part") == "closing", c("_last")).when((c("template") != "diary") & (c("chapter") == best("chapter")), -1).otherwise(c("chapter"))
    rows = rows.withColumn("part", part).withColumn("chapter", chapter)
    phase = F.when(c("reveal"), 1).when(c("experience"), 2).otherwise(3).cast("double")
    first = F.when(c("template") == "diary", 1).when(c("part") == "opening", 0).when(c("part") == "closing", 2).otherwise(1)
    order = {
        "_o0": first,
        "_o1": _by_template(cinematic=phase, fastcut=c("seconds"), ambient=c("people").cast("double"), diary=F.coalesce(c("taken").cast("double"), F.lit(float("-inf")))),
        "_o2": _by_template(cinematic=never, fastcut=-c("energy"), ambient=-c("stability"), diary=never),
        "_o3": _by_template(cinematic=never, fastcut=never, ambient=-c("seconds"), diary=never),
    }
    keys = ["episode", "template", "chapter"]
    rows = rows.select(*keys, "clip", "part", "place", *[o.alias(name) for name, o in order.items()])
    line = settle(ranked(rows, keys, [c("_o0"), c("_o1"), c("_o2"), c("_o3"), c("place")], "position").select(*keys, "clip", "part", "position"))
    # chapters are numbered from 1 as they come
    sizes = line.groupBy(*keys).agg(F.max("position").alias("_size")).withColumn("_number", F.row_number().over(Window.partitionBy("episode", "template").orderBy("chapter")))
    density = _by_template(**{name: F.lit(share) for name, share in MONTAGE.items()})
    keep = F.greatest(F.lit(1), F.round(c("_size") * (1 - density)))
    told = line.join(sizes, keys)
    role = F.when((c("position") <= keep) | (c("part") != "body"), "beat").otherwise("montage")
    return told.select("episode", "template", "clip", c("_number").cast("long").alias("chapter"), "position", "part", role.alias("role"))


def story_faults(drafts: DataFrame, chapters: DataFrame, beats: DataFrame, selected: DataFrame, downgrades: DataFrame) -> DataFrame:
    """(draft, fault) of drafts of a story that do not hold together, each fault of a draft once.

    drafts: draft; chapters: draft, chapter, kind; beats: draft, chapter, clip, role; selected: draft, clip; downgrades: draft, clip, role. A
    sound draft has 1 to CHAPTERS chapters of known kinds, each with a beat; beats of known roles that name every selected clip
    once and nothing else; and a list of downgrades that is just the beats of montage and transition, each once with its role.
    """
    c = F.col

    def broken(rows: DataFrame, *faults: tuple[Column, str]) -> DataFrame:
        named = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), name) for test, name in faults]))
        return rows.select("draft", F.explode(named).alias("fault"))

    counts = drafts.join(chapters.groupBy("draft").agg(F.count("*").alias("n")), "draft", "left")
    held = chapters.join(beats.groupBy("draft", "chapter").agg(F.count("*").alias("n")), ["draft", "chapter"], "left")
    used = beats.groupBy("draft", "clip").agg(F.count("*").alias("n"), F.max(F.when(c("role").isin(*DOWNGRADED), c("role"))).alias("_down"))
    met = used.join(selected.select("draft", "clip", F.lit(True).alias("_in")).distinct(), ["draft", "clip"], "full")
    listed = downgrades.groupBy("draft", "clip").agg(F.count("*").alias("n"), F.max("role").alias("_listed"))
    both = used.where("_down is not null").select("draft", "clip", "_down").join(listed, ["draft", "clip"], "full")
    parts = [
        broken(counts, (~c("n").between(1, CHAPTERS), "chapter count")),
        broken(held, (~c("kind").isin(*CHAPTER_KINDS), "kind"), (c("n").isNull(), "empty chapter")),
        broken(beats, (~c("role").isin(*BEAT_ROLES), "role")),
        broken(met, (c("_in").isNull(), "not selected"), (c("n").isNull(), "left out"), (F.coalesce(c("n") > 1, F.lit(False)), "repeated")),
        broken(downgrades, (~c("role").isin(*DOWNGRADED), "downgrade role")),
        broken(both, (~c("_down").eqNullSafe(c("_listed")), "downgrades"), (F.coalesce(c("n") > 1, F.lit(False)), "downgrade repeated")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.join(drafts.select("draft"), "draft", "left_semi").distinct()
