"""Views, stories, briefs and checks through queries, over analogues: users are episodes or clips, their events what is known of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cutroom.functions import scalars
from cutroom.operators import narrative, reads, search
from cutroom.plans import selection as stories
from cutroom.plans.registry import Register
from cutroom.plans.timelines import seconds
from cutroom.session import table
from cutroom.sources import media

_register = Register()
QUERIES, ORACLE_SQL = _register.queries, _register.sql


# Stories

_CLIPS = f"""b AS ({stories.ORACLE_SQL["boundary_score"]}), clips AS (SELECT user_id AS episode, e.event_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY ts, e.event_id) AS place, boundary, CASE WHEN e.event_id % 13 > 0 THEN epoch_us(ts) // 1000000 END AS taken, e.event_id % 9 + 0.5 AS seconds,
 e.event_id % 17 / 17.0 AS technical, e.event_id % 5 / 4.0 AS stability, e.event_id % 3 / 2.0 AS energy, e.event_id % 4 = 1 AS wide, e.event_id % 5 = 2 AS people, event_type = 'signup' AS establishing, event_type IN ('signup', 'view') AS reveal, event_type = 'click' AS experience, e.event_id % 19 = 3 AS sunset FROM events e LEFT JOIN b ON b.event_id = e.event_id)"""


@_register.query(f"""
WITH {_CLIPS}, s AS (SELECT *, sum(CASE WHEN boundary >= 0.65 THEN 1 ELSE 0 END) OVER (PARTITION BY episode ORDER BY place) AS ch FROM clips), t AS (SELECT s.*, template, density FROM s, (VALUES ('cinematic', 0.35), ('fastcut', 0.75), ('ambient', 0.60), ('diary', 0.0)) v(template, density)),
o AS (SELECT *, row_number() OVER (PARTITION BY episode, template ORDER BY CASE template WHEN 'cinematic' THEN CASE WHEN (wide OR NOT people OR establishing) AND stability >= 0.5 THEN 1 ELSE 0 END WHEN 'fastcut' THEN CASE WHEN energy > 0 THEN 1 ELSE 0 END WHEN 'ambient' THEN CASE WHEN NOT people AND wide THEN 2 WHEN NOT people THEN 1 ELSE 0 END ELSE 0 END DESC,
  CASE template WHEN 'cinematic' THEN technical WHEN 'fastcut' THEN -seconds WHEN 'ambient' THEN stability ELSE CASE WHEN taken IS NULL THEN 1e18 ELSE -taken END END DESC, CASE WHEN template = 'diary' THEN -place ELSE place END DESC) = 1 AS opens FROM t),
l AS (SELECT *, CASE WHEN template = 'cinematic' AND NOT opens AND (sunset OR stability >= 0.5) THEN row_number() OVER (PARTITION BY episode, template, template = 'cinematic' AND NOT opens AND (sunset OR stability >= 0.5) ORDER BY sunset DESC, seconds DESC, place DESC) = 1 ELSE FALSE END AS closes FROM o),
m AS (SELECT *, CASE WHEN template <> 'diary' AND ch = max(CASE WHEN opens THEN ch END) OVER (PARTITION BY episode, template) THEN -1 ELSE ch END AS c1 FROM l), n AS (SELECT *, CASE WHEN closes THEN max(CASE WHEN NOT closes THEN c1 END) OVER (PARTITION BY episode, template) ELSE c1 END AS c2 FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY episode, template, c2 ORDER BY CASE WHEN template = 'diary' THEN 1 WHEN opens THEN 0 WHEN closes THEN 2 ELSE 1 END, CASE template WHEN 'cinematic' THEN CASE WHEN reveal THEN 1 WHEN experience THEN 2 ELSE 3 END WHEN 'fastcut' THEN seconds WHEN 'ambient' THEN CASE WHEN people THEN 1 ELSE 0 END ELSE coalesce(taken, -1e18) END,
  CASE template WHEN 'fastcut' THEN -energy WHEN 'ambient' THEN -stability ELSE 0 END, CASE template WHEN 'ambient' THEN -seconds ELSE 0 END, place) AS position, count(*) OVER (PARTITION BY episode, template, c2) AS size, dense_rank() OVER (PARTITION BY episode, template ORDER BY c2) AS chapter FROM n)
SELECT episode, template, clip, chapter, position, CASE WHEN opens THEN 'opening' WHEN closes THEN 'closing' ELSE 'body' END AS part, CASE WHEN position <= greatest(1, round(size * (1 - density::DOUBLE))) OR opens OR closes THEN 'beat' ELSE 'montage' END AS role FROM p
""")
def fallback_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-33, WIN-06: chapters at boundaries, openings, closings, orders and montage of every episode by four templates."""
    e = F.col("event_id")
    found = stories.QUERIES["boundary_score"](spark, sf_dir).select("event_id", "boundary")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    events = table(spark, sf_dir, "events").withColumn("place", place).join(found, "event_id", "left")
    clips = events.select(
        F.col("user_id").alias("episode"), e.alias("clip"), "place", "boundary", F.when(e % 13 > 0, seconds("ts")).alias("taken"), (e % 9 + 0.5).alias("seconds"), (e % 17 / 17.0).alias("technical"), (e % 5 / 4.0).alias("stability"), (e % 3 / 2.0).alias("energy"),
        (e % 4 == 1).alias("wide"), (e % 5 == 2).alias("people"), (F.col("event_type") == "signup").alias("establishing"), F.col("event_type").isin("signup", "view").alias("reveal"), (F.col("event_type") == "click").alias("experience"), (e % 19 == 3).alias("sunset"),
    )
    return narrative.fallback_story(clips).select("episode", "template", "clip", F.col("chapter").cast("long").alias("chapter"), F.col("position").cast("long").alias("position"), "part", "role")


_LISTS = "chapter AS (SELECT DISTINCT o_custkey AS draft, o_orderkey % 50 AS chapter FROM orders), beat AS (SELECT o_custkey AS draft, o_orderkey % 50 AS chapter, o_orderkey - CASE WHEN o_orderkey % 41 = 0 THEN 1 ELSE 0 END AS clip, CASE WHEN o_orderkey % 5 = 0 THEN 'montage' WHEN o_orderkey % 97 = 1 THEN 'intro' ELSE 'beat' END AS role FROM orders WHERE o_orderkey % 37 > 0)"


@_register.query(f"""
WITH {_LISTS}, kinds AS (SELECT *, CASE WHEN chapter = 13 THEN 'advert' ELSE 'journey' END AS kind FROM chapter), selected AS (SELECT o_custkey AS draft, o_orderkey AS clip FROM orders WHERE o_orderkey % 37 > 0), down AS (SELECT draft, clip, CASE WHEN clip % 83 = 0 THEN 'beat' ELSE role END AS role FROM beat WHERE role = 'montage' AND clip % 59 > 0),
d AS (SELECT c_custkey AS draft FROM customer), n AS (SELECT d.draft, count(k.chapter) AS n FROM d LEFT JOIN kinds k ON k.draft = d.draft GROUP BY d.draft), u AS (SELECT draft, clip, count(*) AS n, max(CASE WHEN role = 'montage' THEN role END) AS down FROM beat GROUP BY draft, clip), l AS (SELECT draft, clip, count(*) AS n, max(role) AS role FROM down GROUP BY draft, clip),
f AS (SELECT draft, 'chapter count' AS fault FROM n WHERE n NOT BETWEEN 1 AND 40 UNION SELECT draft, 'kind' FROM kinds WHERE kind = 'advert' UNION SELECT k.draft, 'empty chapter' FROM kinds k LEFT JOIN beat b ON b.draft = k.draft AND b.chapter = k.chapter WHERE b.draft IS NULL UNION SELECT draft, 'role' FROM beat WHERE role = 'intro'
 UNION SELECT u.draft, 'not selected' FROM u LEFT JOIN selected s ON s.draft = u.draft AND s.clip = u.clip WHERE s.clip IS NULL UNION SELECT s.draft, 'left out' FROM selected s LEFT JOIN u ON s.draft = u.draft AND s.clip = u.clip WHERE u.clip IS NULL UNION SELECT draft, 'repeated' FROM u WHERE n > 1
 UNION SELECT draft, 'downgrade role' FROM down WHERE role = 'beat' UNION SELECT coalesce(u.draft, l.draft), 'downgrades' FROM (SELECT * FROM u WHERE down IS NOT NULL) u FULL JOIN l ON l.draft = u.draft AND l.clip = u.clip WHERE u.down IS DISTINCT FROM l.role UNION SELECT draft, 'downgrade repeated' FROM l WHERE n > 1)
SELECT f.draft, fault FROM f JOIN d ON d.draft = f.draft
""")
def story_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-34: kinds, roles, coverage, repeats and downgrades of drafts of a story."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("draft"), (k % 50).alias("chapter"), k)
    chapters = orders.select("draft", "chapter").distinct().withColumn("kind", F.when(F.col("chapter") == 13, "advert").otherwise("journey"))
    kept = orders.where(k % 37 > 0)
    beats = kept.select("draft", "chapter", (k - F.when(k % 41 == 0, 1).otherwise(0)).alias("clip"), F.when(k % 5 == 0, "montage").when(k % 97 == 1, "intro").otherwise("beat").alias("role"))
    down = beats.where("role = 'montage' and clip % 59 > 0").select("draft", "clip", F.when(F.col("clip") % 83 == 0, "beat").otherwise(F.col("role")).alias("role"))
    return narrative.story_faults(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("draft")), chapters, beats, kept.select("draft", k.alias("clip")), down)


# Facts of a clip

@_register.query("""
WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '人' WHEN 1 THEN '风景' WHEN 2 THEN '食物' END AS subject, CASE p_partkey % 3 WHEN 0 THEN '广角' END AS size, CASE p_partkey % 4 WHEN 1 THEN '航拍' END AS view, CASE p_partkey % 7 WHEN 2 THEN '吃喝' END AS state,
 CASE p_partkey % 6 WHEN 0 THEN 'pan' WHEN 1 THEN 'static' WHEN 2 THEN 'spin' END AS motion, CASE WHEN p_partkey % 8 = 3 THEN ['站', p_brand] ELSE [] END AS words, CASE WHEN p_partkey % 9 = 4 THEN p_name || ' ' || p_name || ' ' || p_type ELSE CASE WHEN p_partkey % 9 = 5 THEN '  好。。' END END AS speech, CASE WHEN p_partkey % 11 = 6 THEN ['抖动'] ELSE [] END AS fixable FROM part),
l AS (SELECT p_partkey, list_filter([CASE WHEN subject IS NOT NULL AND view IS NULL AND size IS NULL THEN '拍的是' || subject WHEN subject IS NOT NULL THEN coalesce(view, '') || coalesce(size, '') || '的' || subject WHEN size IS NOT NULL THEN '一个' || size || '镜头' END, '画面里的人在' || state,
 CASE motion WHEN 'pan' THEN '横摇' WHEN 'static' THEN '固定机位' WHEN 'spin' THEN '运镜不明' END || '拍摄', CASE WHEN len(words) > 0 THEN '画面文字「' || array_to_string(words, '、') || '」' END,
 CASE WHEN length(trim(speech)) > 0 THEN '有人说「' || rtrim(CASE WHEN length(trim(speech)) > 24 THEN substr(trim(speech), 1, 24) || '…' ELSE trim(speech) END, '。') || '」' END, CASE WHEN len(fixable) > 0 THEN '可修:' || array_to_string(fixable, '、') END], lambda x: x IS NOT NULL) AS parts FROM p)
SELECT p_partkey, CASE WHEN len(parts) = 0 THEN '这条素材还没分析出可说的内容,先跑一次分析再看。' ELSE array_to_string(parts, ',') || '。' END AS brief FROM l
""")
def clip_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-47: a sentence of what is known of each clip."""
    k = F.col("p_partkey")
    pick = lambda n, values: _picked(k % n, values)
    none = F.array().cast("array<string>")
    speech = F.when(k % 9 == 4, F.concat_ws(" ", "p_name", "p_name", "p_type")).when(k % 9 == 5, "  好。。")
    told = reads.brief(
        pick(5, {0: "人", 1: "风景", 2: "食物"}), pick(3, {0: "广角"}), pick(4, {1: "航拍"}), pick(7, {2: "吃喝"}), pick(6, {0: "pan", 1: "static", 2: "spin"}),
        F.when(k % 8 == 3, F.array(F.lit("站"), F.col("p_brand"))).otherwise(none), speech, F.when(k % 11 == 6, F.array(F.lit("抖动"))).otherwise(none),
    )
    return table(spark, sf_dir, "part").select(k, told.alias("brief"))


def _picked(turn, values):  # noqa: ANN001, ANN202
    out = F.lit(None).cast("string")
    for i, value in values.items():
        out = F.when(turn == i, value).otherwise(out)
    return out


@_register.query("""
WITH c AS (SELECT doc_id, lower(coalesce(text, '')) AS t, CASE WHEN doc_id % 3 = 0 THEN '操作' WHEN doc_id % 3 = 1 THEN '吃喝' END AS state, CASE WHEN doc_id % 2 = 0 THEN '交通' ELSE '食物' END AS subject, CASE WHEN doc_id % 5 = 0 THEN '路上' WHEN doc_id % 5 = 1 THEN '出发' END AS stage, CASE WHEN doc_id % 7 = 0 THEN 'Transition' END AS fn FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '起床|醒了|早安|wake up|waking up') THEN '起床' WHEN regexp_matches(t, '咖啡|coffee|espresso|手冲') THEN '咖啡' WHEN regexp_matches(t, '收营|撤营|拔营|pack up camp|break camp') THEN '收营' WHEN regexp_matches(t, '发动|点火|启动房车|start the rv|start engine') THEN '发动' WHEN regexp_matches(t, '驾驶|开车|上路|drive|driving') THEN '驾驶'
 WHEN regexp_matches(t, '加油|油站|gas station|fuel|refuel') THEN '加油' WHEN regexp_matches(t, '采购|买菜|超市|grocery|groceries|shopping') THEN '采购' WHEN regexp_matches(t, '倒车|倒库|reverse|backing up') THEN '倒车' WHEN regexp_matches(t, '调平|支腿|leveling|levelling|level the rv') THEN '调平' WHEN regexp_matches(t, '接水|加水|水管|fill water|water hookup') THEN '接水'
 WHEN regexp_matches(t, '接电|岸电|电桩|shore power|electric hookup') THEN '接电' WHEN regexp_matches(t, '遮阳棚|雨棚|awning') THEN '遮阳棚' WHEN regexp_matches(t, '做饭|烹饪|下厨|cook|cooking') THEN '做饭' WHEN regexp_matches(t, '篝火|营火|campfire|fire pit') THEN '篝火' WHEN regexp_matches(t, '睡觉|晚安|上床|go to bed|sleep') THEN '睡觉'
 WHEN subject = '交通' AND stage = '路上' THEN '驾驶' WHEN state = '操作' AND subject = '食物' THEN '做饭' WHEN state = '吃喝' AND subject = '食物' AND stage = '出发' THEN '咖啡' WHEN state = '操作' AND subject = '交通' AND fn = 'Transition' THEN '收营' END AS routine FROM c
""")
def routines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9 #25: routines by words in order, then by labels."""
    k = F.col("doc_id")
    found = scalars.routine_of(F.col("text"), F.when(k % 3 == 0, "操作").when(k % 3 == 1, "吃喝"), F.when(k % 2 == 0, "交通").otherwise("食物"), F.when(k % 5 == 0, "路上").when(k % 5 == 1, "出发"), F.when(k % 7 == 0, "Transition"))
    return table(spark, sf_dir, "documents").select(k, found.alias("routine"))


@_register.query("""
SELECT o_orderkey, (CASE WHEN o_orderkey % 3 < 2 THEN CASE o_orderkey % 3 * 10 + o_custkey % 4 WHEN 0 THEN 8 WHEN 1 THEN 13 WHEN 12 THEN 5 WHEN 10 THEN 8 ELSE 0 END ELSE 0 END * (o_orderkey % 61) + greatest(o_custkey % 12 - 5, 0) * 4) / 100.0::DOUBLE AS usd FROM orders
""")
def request_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9 #18: costs of requests by model, resolution, seconds and pictures."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    usd = scalars.cost_usd(_picked(k % 3, {0: "MiniMax-H3", 1: "MiniMax-H3-Max", 2: "other"}), _picked(c % 4, {0: "768P", 1: "2K", 2: "480P", 3: "1K"}), k % 61, c % 12)
    return table(spark, sf_dir, "orders").select(k, usd.alias("usd"))


@_register.query("""
WITH w AS (SELECT c_custkey AS k, c_custkey % 5 = 0 AS odd, c_custkey % 7 / 5.0::DOUBLE AS sharp, (c_custkey % 3 - 1) / 2.0::DOUBLE AS sound, c_custkey % 11 = 3 AS zero, c_custkey % 13 = 5 AS broken FROM customer),
f AS (SELECT k, unnest(CASE WHEN broken THEN [struct_pack(key := '', fault := 'no object')] WHEN zero THEN [struct_pack(key := '', fault := 'all 0')] ELSE list_filter([CASE WHEN odd THEN struct_pack(key := 'contrast', fault := 'unknown') END, CASE WHEN sharp > 1 THEN struct_pack(key := 'sharp', fault := 'range') END, CASE WHEN sound < 0 THEN struct_pack(key := 'sound', fault := 'range') END], lambda x: x IS NOT NULL) END) AS x FROM w)
SELECT k AS c_custkey, x.key AS key, x.fault AS fault FROM f
""")
def weight_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-04: weights that are no known key, no number of 0 to 1, or all 0."""
    k = F.col("c_custkey")
    given = F.concat(F.lit('{"sharp":'), (k % 7 / 5.0).cast("string"), F.lit(',"sound":'), ((k % 3 - 1) / 2.0).cast("string"), F.when(k % 5 == 0, ',"contrast":0.5').otherwise(""), F.lit("}"))
    zero = '{"sharp":0,"motion":0,"exposure":0,"sound":0,"no_cut":0,"interest":0}'
    settings = F.when(k % 13 == 5, "[1, 2").when(k % 11 == 3, zero).otherwise(given)
    return table(spark, sf_dir, "customer").select(k, F.explode(reads.weight_faults(settings)).alias("x")).select("c_custkey", "x.*")


# Views

@_register.query("""
WITH e AS (SELECT user_id AS clip, event_id AS id, event_type AS t, value AS v FROM events), u AS (SELECT DISTINCT clip FROM e) SELECT clip, (SELECT arg_max(v, id) FROM e WHERE e.clip = u.clip AND t = 'signup') AS analysis,
 coalesce((SELECT list(id ORDER BY v DESC, id) FROM e WHERE e.clip = u.clip AND t = 'view'), []) AS moments, coalesce((SELECT list(id ORDER BY id) FROM e WHERE e.clip = u.clip AND t = 'error'), []) AS artifacts FROM u
""")
def clip_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRD-09: all that is known of a clip as one row: its last analysis, its moments from the best, its artifacts."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), F.col("event_id").alias("id"), F.col("event_type").alias("t"), F.col("value").alias("v"))
    last = rows.where("t = 'signup'").groupBy("clip").agg(F.max_by("v", "id").alias("analysis"))
    base = rows.select("clip").distinct().join(last, "clip", "left")
    view = reads.gathered(base, ["clip"], {"moments": (rows.where("t = 'view'"), [-F.col("v"), F.col("id")], ["id", "v"]), "artifacts": (rows.where("t = 'error'"), [F.col("id")], ["id"])})
    return view.select("clip", "analysis", F.col("moments.id").alias("moments"), F.col("artifacts.id").alias("artifacts"))


@_register.query("""
WITH m AS (SELECT p_brand AS "group", p_partkey AS id, p_retailprice AS sharp FROM part WHERE p_size > 5), g AS (SELECT "group", count(*) AS n FROM m GROUP BY "group" HAVING count(*) > 1)
SELECT g."group", n AS members, (SELECT arg_max(id, (sharp, -id)) FROM m WHERE m."group" = g."group") AS primary_id, (SELECT list(id ORDER BY sharp DESC, id) FROM m WHERE m."group" = g."group") AS rows FROM g
""")
def group_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRD-18: similar groups with their primaries and members from the sharpest."""
    rows = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_brand").alias("group"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("sharp"))
    groups = rows.groupBy("group").agg(F.count("*").alias("members"), F.max_by("id", F.struct("sharp", -F.col("id"))).alias("primary_id")).where("members > 1")
    return reads.gathered(groups, ["group"], {"rows": (rows, [-F.col("sharp"), F.col("id")], ["id"])}).withColumn("rows", F.col("rows.id"))


@_register.query("""
SELECT o_orderkey AS track, coalesce((SELECT list(l_partkey * 1000 ORDER BY l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber <= 4), []) AS beats, coalesce((SELECT list(l_partkey * 1000 ORDER BY l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber > 4), []) AS sections
FROM orders WHERE o_orderstatus <> 'P'
""")
def track_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRD-19: tracks that were not deleted, with their beats and sections in order."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("track"), (F.col("l_partkey") * 1000).alias("tick"), F.col("l_quantity").alias("strength"), "l_suppkey", "l_linenumber")
    tracks = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("track"))
    beats, sections = (lines.where("l_linenumber <= 4"), [F.col("tick"), F.col("l_suppkey"), F.col("strength")], ["tick", "strength"]), (lines.where("l_linenumber > 4"), [F.col("tick"), F.col("l_suppkey")], ["tick"])
    return reads.gathered(tracks, ["track"], {"beats": beats, "sections": sections}).select("track", F.col("beats.tick").alias("beats"), F.col("sections.tick").alias("sections"))


@_register.query("""
WITH f AS (SELECT 'card/' || p_brand || '/IMG_' || (p_partkey // 4) || CASE p_partkey % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.cr3' WHEN 2 THEN '.xmp' ELSE '.jpeg' END AS p, p_partkey FROM part), s AS (SELECT p, lower(regexp_replace(p, '\\.[^./]*$', '')) AS stem, p_partkey % 4 IN (0, 3) AS photo FROM f),
a AS (SELECT stem, min(p) AS prim FROM s WHERE photo GROUP BY stem) SELECT prim AS "primary", list(p ORDER BY p) FILTER (p <> prim) AS companions FROM a JOIN s ON s.stem = a.stem GROUP BY prim HAVING count(*) > 1
""")
def photo_companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRD-20, SRC-19: photos with the files beside them of the same stem."""
    k = F.col("p_partkey")
    path = F.concat(F.lit("card/"), F.col("p_brand"), F.lit("/IMG_"), F.floor(k / 4).cast("string"), _picked(k % 4, {0: ".JPG", 1: ".cr3", 2: ".xmp", 3: ".jpeg"}))
    pairs = media.companions(table(spark, sf_dir, "part").select(path.alias("path")), "path")
    return reads.gathered(pairs.select("primary").distinct(), ["primary"], {"companions": (pairs, [F.col("companion")], ["companion"])}).withColumn("companions", F.col("companions.companion"))


@_register.query("""
SELECT 'clips=' || count(*) || ':' || max(c_custkey) || ':' || count(*) FILTER (c_acctbal < 0) || ':' || sum(length(c_name)) || ':' || count(DISTINCT c_nationkey) || '|orders=' || (SELECT count(*) || ':' || max(o_orderkey) || ':' || count(*) FILTER (o_orderstatus = 'F') FROM orders) || '|none=' || '0:-' AS revision FROM customer
""")
def clips_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-08: the text that changes when a list of clips has to be read again."""
    count = F.count(F.lit(1))
    clips = {"n": count, "last": F.max("c_custkey"), "missing": F.count_if(F.col("c_acctbal") < 0), "names": F.sum(F.length("c_name")), "folders": F.count_distinct("c_nationkey")}
    jobs = {"n": count, "last": F.max("o_orderkey"), "done": F.count_if(F.col("o_orderstatus") == "F")}
    customer = table(spark, sf_dir, "customer")
    return reads.revision({"clips": (customer, clips), "orders": (table(spark, sf_dir, "orders"), jobs), "none": (customer.where("false"), {"n": count, "last": F.max("c_custkey")})})


@_register.query("""
WITH o AS (SELECT doc_id, quality = 1 AS detected, quality = 1 AND toxic = 0 AS recommended, toxic = 0 AND doc_id % 2 = 0 AS retained, toxic = 1 AS rejected FROM labels), f AS (SELECT doc_id, n_chars > 1000 AS important, lang = 'de' AS golden, source = 'src3' AS uniq, n_chars < 500 AS narrative FROM documents),
j AS (SELECT f.*, o.doc_id IS NOT NULL AND (recommended OR retained) AND NOT rejected AS kept, coalesce(detected, FALSE) AS detected, coalesce(rejected, FALSE) AS rejected FROM f LEFT JOIN o ON o.doc_id = f.doc_id),
m AS (SELECT 'important_recall' AS metric, count(*) FILTER (important AND detected) AS hits, count(*) FILTER (important) AS n, 1.0::DOUBLE AS e FROM j UNION ALL SELECT 'critical_recall', count(*) FILTER (golden AND kept), count(*) FILTER (golden), 0 FROM j UNION ALL SELECT 'unique_false_reject_rate', count(*) FILTER (uniq AND rejected), count(*) FILTER (uniq), 0 FROM j
 UNION ALL SELECT 'narrative_suppression_rate', count(*) FILTER (narrative AND NOT coalesce(kept, FALSE)), count(*) FILTER (narrative), 0 FROM j) SELECT metric, hits, n, round(CASE WHEN n = 0 THEN e ELSE hits / n END, 6) AS rate FROM m
""")
def event_recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-04: recall of important and golden fixtures, false rejects and suppressions, by labels that some documents have."""
    labels = table(spark, sf_dir, "labels")
    good, bad = F.col("quality") == 1, F.col("toxic") == 1
    seen = labels.select("doc_id", good.alias("detected"), (good & ~bad).alias("recommended"), (~bad & (F.col("doc_id") % 2 == 0)).alias("retained"), bad.alias("rejected"))
    wanted = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 1000).alias("important"), (F.col("lang") == "de").alias("golden"), (F.col("source") == "src3").alias("unique_event"), (F.col("n_chars") < 500).alias("narrative"))
    return reads.event_recalls(wanted, seen, "doc_id").select("metric", "hits", "n", F.round("rate", 6).alias("rate"))


def _five() -> str:
    sources = [("file", "pages", "page_id", "url", "url"), ("transcript", "conversations", "conv_id", "text", "text"), ("description", "documents", "doc_id", "text", "text"), ("dimension", "documents", "doc_id", "source", "lang || ':' || source"), ("ocr", "benchmark", "item_id", "text", "text")]
    out = []
    for place, (name, rows, ident, text, shown) in enumerate(sources):
        at = "instr(lower(t), 'sr')"
        cut = f"substr(t, greatest({at} - 1 - 18, 0) + 1, 38)"
        out.append(f"SELECT {place} AS place, '{name}' AS source, id, CASE WHEN {at} - 1 > 18 THEN '…' || {cut} ELSE {cut} END AS excerpt FROM (SELECT {ident} AS id, min({shown}) AS t FROM {rows} WHERE contains(lower({text}), 'sr') GROUP BY 1 ORDER BY 1 LIMIT 20)")
    return " UNION ALL ".join(out)


@_register.query(_five())
def global_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-15: names, transcripts, descriptions, labels and screen texts that hold a needle, twenty each, one hit a clip."""
    docs = table(spark, sf_dir, "documents").withColumn("shown", F.concat_ws(":", "lang", "source"))
    parts = [("file", table(spark, sf_dir, "pages"), "page_id", "url"), ("transcript", table(spark, sf_dir, "conversations"), "conv_id", "text"), ("description", docs, "doc_id", "text"), ("dimension", docs, "doc_id", "source", "shown"), ("ocr", table(spark, sf_dir, "benchmark"), "item_id", "text")]
    return search.search_text(parts, "sr", one_each=True)
