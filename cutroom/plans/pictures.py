"""Motion and quality of pictures through queries: frames are made of digests of the tables' rows, moved by rules."""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha512

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cutroom.functions import pictures as kernels
from cutroom.operators import pictures
from cutroom.plans.registry import Register
from cutroom.session import spread, table

_register = Register()
QUERIES, ORACLE_SQL = _register.queries, _register.sql
SIDE = kernels.SIDE


@lru_cache(maxsize=4)
def _texture(seed: int | None, height: int) -> np.ndarray:
    """Rows of a texture, each a digest of 64 bytes four times over."""
    named = "" if seed is None else f"{seed}:"
    lines = b"".join(sha512(f"{named}{r}".encode()).digest() for r in range(height))
    return np.tile(np.frombuffer(lines, np.uint8).reshape(height, 64), 4)


def _seen(seed: int | None, x: int, y: int, height: int) -> bytes:
    """What is seen of a texture from (x, y) on."""
    return np.ascontiguousarray(_texture(seed, height)[y : y + SIDE, x : x + SIDE]).tobytes()


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip a user and a frame an event, told by what _seen() makes it of: a texture that stands still, is panned, tilted or shaken, or noise, by the user."""
    user, k = F.col("user_id"), F.col("event_id")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", number.alias("k"))
    kind, turn, jump = user % 5, F.col("k") % 20, F.pmod(F.xxhash64(k), F.lit(11)).cast("int")
    x, y = F.when(kind == 1, turn * 3).when(kind == 3, jump).otherwise(0), F.when(kind == 2, turn * 2).when(kind == 3, 10 - jump).otherwise(0)
    # a user's texture has the rows that all its frames see
    height = SIDE + F.when(kind == 2, 38).when(kind == 3, 10).otherwise(0)
    return rows.select("user_id", "event_id", F.when(kind == 4, k).otherwise(user).alias("seed"), x.alias("x"), y.alias("y"), height.alias("height"))


@_register.query()
def clip_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-41, SRC-12: motion of clips by blocks of neighbouring frames; tests hold it against a plain loop."""
    found = pictures.clip_motion(pictures.frame_pairs(_frames(spark, sf_dir), ["user_id"], "event_id", _seen), ["user_id"])
    return found.select("user_id", "class", "sample_pairs", "trusted_pairs", *[F.round(c, 6).alias(c) for c in ("pan_ratio", "tilt_ratio", "zoom_corr", "shake_score", "mean_magnitude", "residual_rms", "direction_coherence")])


_PAIRS = """p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, CAST(event_id * 7 % 13 - 4 AS DOUBLE) / CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 100 END AS dx,
 CAST(event_id * 5 % 11 - 5 AS DOUBLE) / CASE user_id % 2 WHEN 0 THEN 1 ELSE 8 END AS dy, (event_id % 19 - 9) / 10.0::DOUBLE + user_id % 4 / 5.0::DOUBLE AS z, (event_id % 7) / 2.0::DOUBLE AS r, event_id % 6 > 0 AS ok FROM events)"""
_SCOPES = """c AS (SELECT user_id, 'whole' AS scope, 0 AS low, n AS high FROM p UNION SELECT user_id, 'start', 0, (n + 2) // 3 FROM p UNION SELECT user_id, 'end', n - (n + 2) // 3, n FROM p),
o AS (SELECT c.user_id, c.scope, i, dx, dy, i - row_number() OVER (PARTITION BY c.user_id, c.scope ORDER BY i) AS island FROM p JOIN c ON c.user_id = p.user_id AND i >= low AND i < high WHERE ok),
w AS (SELECT *, count(*) OVER (PARTITION BY user_id, scope, island) AS size, dx - avg(dx) OVER v AS hx, dy - avg(dy) OVER v AS hy FROM o WINDOW v AS (PARTITION BY user_id, scope, island ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
h AS (SELECT user_id, scope, CASE WHEN sum(dx * dx + dy * dy) > 0.25 * count(*) AND sum(hx * hx + hy * hy) / count(*) >= 4 THEN least(1, sum(hx * hx + hy * hy) / sum(dx * dx + dy * dy)) ELSE 0 END AS shake FROM w WHERE size >= 3 GROUP BY user_id, scope)"""


@_register.query(f"""
WITH {_PAIRS}, {_SCOPES}, m AS (SELECT user_id, count(*) AS n, avg(abs(dx)) AS mx, avg(abs(dy)) AS my, avg(sqrt(dx * dx + dy * dy)) AS mag, median(z) AS zoom, avg(dx) FILTER (sqrt(dx * dx + dy * dy) >= 0.5) AS vx, avg(dy) FILTER (sqrt(dx * dx + dy * dy) >= 0.5) AS vy, count(*) FILTER (ok) AS trusted,
 greatest(count(*) FILTER (abs(dx) > abs(dy) AND dx >= 0.5), count(*) FILTER (abs(dx) > abs(dy) AND dx <= -0.5)) / count(*) AS pan, greatest(count(*) FILTER (abs(dy) > abs(dx) AND dy >= 0.5), count(*) FILTER (abs(dy) > abs(dx) AND dy <= -0.5)) / count(*) AS tilt FROM p GROUP BY user_id),
d AS (SELECT p.user_id, avg(CASE WHEN dx * vx + dy * vy > 0 THEN 1.0 ELSE 0.0 END) AS along FROM p JOIN m ON m.user_id = p.user_id WHERE sqrt(dx * dx + dy * dy) >= 0.5 AND sqrt(vx * vx + vy * vy) >= 0.5 GROUP BY p.user_id)
SELECT m.user_id, CASE WHEN abs(zoom) > 0.6 THEN 'zoom' WHEN mag < 0.5 THEN 'static' WHEN mx > my AND pan > 0.7 THEN 'pan' WHEN my > mx AND tilt > 0.7 THEN 'tilt' ELSE 'handheld' END AS class, n AS sample_pairs, trusted AS trusted_pairs, round(pan, 6) AS pan_ratio, round(tilt, 6) AS tilt_ratio, round(zoom, 6) AS zoom_corr,
 round(coalesce(hw.shake, 0), 6) AS shake_score, coalesce(hw.shake, 0) > 0.15 AS is_shaky, round(coalesce(hs.shake, 0), 6) AS start_shake, round(coalesce(he.shake, 0), 6) AS end_shake, round(coalesce(along, 0), 6) AS direction_coherence
FROM m LEFT JOIN d ON d.user_id = m.user_id LEFT JOIN h hw ON hw.user_id = m.user_id AND hw.scope = 'whole' LEFT JOIN h hs ON hs.user_id = m.user_id AND hs.scope = 'start' LEFT JOIN h he ON he.user_id = m.user_id AND he.scope = 'end'
""")
def motion_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-41: class, zoom and shake of clips from the motion of their pairs, runs of trusted pairs cut at a scope's ends."""
    u, e = F.col("user_id"), F.col("event_id")
    number = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    pairs = table(spark, sf_dir, "events").select(
        "user_id", number.alias("pair"), ((e * 7 % 13 - 4).cast("double") / F.when(u % 3 == 0, 1).when(u % 3 == 1, 4).otherwise(100)).alias("dx"), ((e * 5 % 11 - 5).cast("double") / F.when(u % 2 == 0, 1).otherwise(8)).alias("dy"),
        ((e % 19 - 9) / F.lit(10.0) + u % 4 / F.lit(5.0)).alias("zoom"), ((e % 7) / F.lit(2.0)).alias("residual"), F.when(e % 6 > 0, 0.9).otherwise(0.1).alias("agreement"),
    )
    found = pictures.clip_motion(pairs, ["user_id"])
    return found.select("user_id", "class", "sample_pairs", "trusted_pairs", "is_shaky", *[F.round(c, 6).alias(c) for c in ("pan_ratio", "tilt_ratio", "zoom_corr", "shake_score", "start_shake", "end_shake", "direction_coherence")])


@_register.query("""
WITH d AS (SELECT doc_id, hex(encode(text)) AS h, CAST(floor(sqrt(strlen(text))) AS BIGINT) AS side FROM documents WHERE strlen(text) > 0),
x AS (SELECT doc_id, side, h, unnest(range(0, side * side)) AS i FROM d), b AS (SELECT doc_id, side, i // side AS y, i % side AS x, CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) AS v FROM x),
p AS (SELECT doc_id, side, y, x, CASE WHEN v = 101 THEN 0 WHEN v < 70 THEN 255 ELSE v END AS v FROM b), n AS (SELECT doc_id, c, v FROM p, range(0, 9) r(c) WHERE y >= (c // 3) * side // 3 AND y < (c // 3 + 1) * side // 3 AND x >= (c % 3) * side // 3 AND x < (c % 3 + 1) * side // 3),
m AS (SELECT doc_id, c, avg(v) AS mean, avg(CASE WHEN v <= 8 THEN 1.0 ELSE 0.0 END) AS low, avg(CASE WHEN v >= 247 THEN 1.0 ELSE 0.0 END) AS high FROM n GROUP BY doc_id, c),
s AS (SELECT doc_id, c, CASE WHEN low >= 0.1 AND mean <= 60 THEN 'under' WHEN high >= 0.1 AND mean >= 170 THEN 'over' ELSE 'normal' END AS status, CASE WHEN low >= 0.1 AND mean <= 60 THEN low * (1 - mean / 255) WHEN high >= 0.1 AND mean >= 170 THEN high * mean / 255 ELSE 0 END AS sev FROM m),
w AS (SELECT doc_id, arg_min(c, struct_pack(a := -round(sev, 9), b := c)) AS c, max(sev) AS sev, arg_min(status, struct_pack(a := -round(sev, 9), b := c)) AS status FROM s GROUP BY doc_id) SELECT w.doc_id, side, CAST(c AS INTEGER) AS worst_cell, status AS exposure, round(sev, 6) AS severity FROM w JOIN d ON d.doc_id = w.doc_id
""")
def exposure_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-43, FLT-16: the worst of nine cells of square pictures of text bytes, some of them black and some white."""
    side = F.floor(F.sqrt(F.octet_length("text").cast("double")))
    # a character a byte, so that bytes are exchanged as characters are: those below 70 are white, one is black
    pixels = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    pixels = F.replace(F.translate(pixels, "".join(map(chr, range(70))), "\u00ff" * 70), F.lit("e"), F.lit("\0"))
    docs = table(spark, sf_dir, "documents").where("octet_length(text) > 0").select("doc_id", side.cast("int").alias("side"), pixels.alias("p"))
    gray = F.encode(F.substring("p", F.lit(1), F.col("side") * F.col("side")), "ISO-8859-1")
    found = pictures.exposures(docs.select("doc_id", F.col("side").cast("long").alias("side"), gray.alias("gray")), "gray", "side", "side")
    return found.select("doc_id", "side", "worst_cell", "exposure", F.round("severity", 6).alias("severity"))


@_register.query()
def picture_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-43, DOM-42: exposure by cells, tilt of the longest line and sharpness of what stands out, of a picture a page; tests hold it against plain loops."""
    k = F.col("page_id")
    slope, side, band = k % 7 - 3, 96, 8
    # a line at a slope by page between a texture of digests, one a band of rows, and darkness
    at = lambda r: (40 + F.floor(slope * r / 8)).cast("int")
    textures = F.transform(F.sequence(F.lit(0), F.lit(side // band - 1)), lambda b: F.repeat(F.regexp_replace(F.sha2(F.concat_ws(":", "url", b.cast("string")), 256), "(.).", "4$1"), 3))
    row = lambda texture, r: F.concat(F.substring(texture, F.lit(1), at(r) * 2), F.lit("FF" * 6), F.repeat(F.lit("18"), side - 6 - at(r)))
    bands = F.transform(textures, lambda texture, b: F.concat(*[row(texture, b * band + r) for r in range(band)]))
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    frames = pages.select(k, F.unhex(F.array_join(bands, "")).alias("gray"), F.lit(side).alias("side"))
    found = pictures.picture_quality(frames, "gray", "side", "side")
    return found.select("page_id", "worst_cell", "exposure", F.round("severity", 4).alias("severity"), "tilt", F.round("saliency_sharpness", 2).alias("saliency_sharpness"))
