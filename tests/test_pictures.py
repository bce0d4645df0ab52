"""Motion and quality of pictures against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutroom.functions import pictures as kernels
from cutroom.operators import pictures
from cutroom.plans import pictures as plans
from cutroom.plans.pictures import QUERIES

SIDE = kernels.SIDE


def plain_vector(before, after):
    offsets = sorted(((dx, dy) for dy in range(-8, 9) for dx in range(-8, 9)), key=lambda o: (abs(o[0]) + abs(o[1]), abs(o[1]), abs(o[0]), o[1], o[0]))
    vectors, textured, places = [], [], []
    for row in range(8):
        for column in range(8):
            x, y = 16 + column * 16, 16 + row * 16
            block = before[y : y + 16, x : x + 16].astype(int)
            costs = [int(np.abs(block - after[y + dy : y + dy + 16, x + dx : x + dx + 16].astype(int)).sum()) for dx, dy in offsets]
            vectors.append(offsets[costs.index(min(costs))])
            textured.append(block.std() >= 6)
            places.append((x + 7.5 - 79.5, y + 7.5 - 79.5))
    enough = sum(textured) >= 8
    used = [i for i in range(64) if textured[i] or not enough]
    gx, gy = (float(np.median([vectors[i][a] for i in used])) for a in (0, 1))
    left = [(vectors[i][0] - gx, vectors[i][1] - gy) for i in used]
    energy = sum(x * x + y * y for x, y in left)
    radial = sum(places[i][0] ** 2 + places[i][1] ** 2 for i in used)
    dot = sum(a * places[i][0] + b * places[i][1] for (a, b), i in zip(left, used, strict=True))
    near = sum(abs(vectors[i][0] - gx) <= 1 and abs(vectors[i][1] - gy) <= 1 for i in range(64) if textured[i])
    return gx, gy, dot / math.sqrt(energy * radial) if energy else 0.0, math.sqrt(energy / len(used)), near / sum(textured) if enough else 0.0


def plain_shake(pairs):
    runs, run = [], []
    for p in [*pairs, None]:
        if p and p[4] >= 0.6:
            run.append(p)
        else:
            runs.append(run)
            run = []
    runs = [r for r in runs if len(r) >= 3]
    n = sum(map(len, runs))
    if n < 3:
        return 0.0
    total = high = 0.0
    for r in runs:
        for i, p in enumerate(r):
            near = r[max(0, i - 1) : i + 2]
            total += p[0] ** 2 + p[1] ** 2
            high += sum((p[a] - sum(q[a] for q in near) / len(near)) ** 2 for a in (0, 1))
    return 0.0 if total <= 0.25 * n or high / n < 4 else min(1.0, high / total)


def plain_clip(pairs):
    n = len(pairs)
    size = [math.hypot(p[0], p[1]) for p in pairs]
    mx, my = (sum(abs(p[a]) for p in pairs) / n for a in (0, 1))
    ratio = lambda a: max(sum(abs(p[a]) > abs(p[1 - a]) and p[a] * s >= 0.5 for p in pairs) for s in (1, -1)) / n
    zoom = float(np.median([p[2] for p in pairs]))
    kind = "zoom" if abs(zoom) > 0.6 else "static" if sum(size) / n < 0.5 else "pan" if mx > my and ratio(0) > 0.7 else "tilt" if my > mx and ratio(1) > 0.7 else "handheld"
    moving = [p for p, s in zip(pairs, size, strict=True) if s >= 0.5]
    coherence = 0.0
    if moving:
        vx, vy = (sum(p[a] for p in moving) / len(moving) for a in (0, 1))
        if math.hypot(vx, vy) >= 0.5:
            coherence = sum(p[0] * vx + p[1] * vy > 0 for p in moving) / len(moving)
    third = -(-n // 3)
    seconds = [plain_shake(pairs[max(0, 2 * k - 1) : min(2 * k + 3, n)]) for k in range(-(-n // 2))]
    return (kind, ratio(0), ratio(1), zoom, plain_shake(pairs), sum(size) / n, sum(p[3] for p in pairs) / n, coherence, sum(p[4] >= 0.6 for p in pairs), plain_shake(pairs[:third]), plain_shake(pairs[n - third :]), *seconds)


def told(r):
    return (r["class"], r.pan_ratio, r.tilt_ratio, r.zoom_corr, r.shake_score, r.mean_magnitude, r.residual_rms, r.direction_coherence, r.trusted_pairs, r.start_shake, r.end_shake, *r.second_shake)


def test_motion_of_frames_against_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(pictures, "FRAMES", 3)  # clips end within blocks, at their ends and one after
    rng = np.random.default_rng(4)
    plane = rng.integers(0, 256, (400, 400)).astype(np.uint8)
    see = lambda x, y: plane[y : y + SIDE, x : x + SIDE]
    zoomed = [plane[np.clip(200 + ((np.arange(SIDE) - 79.5) * z), 0, 399).astype(int)][:, np.clip(200 + ((np.arange(SIDE) - 79.5) * z), 0, 399).astype(int)] for z in (1, 1.04, 1.08)]
    clips = {
        "still": [see(50, 50)] * 4, "pan": [see(40 + 5 * k, 50) for k in range(7)], "tilt": [see(40, 90 - 3 * k) for k in range(6)], "flat": [np.full((SIDE, SIDE), 40, np.uint8)] * 3,
        "shaky": [see(60 + int(a), 60 + int(b)) for a, b in rng.integers(-4, 5, (9, 2))], "noise": [rng.integers(0, 256, (SIDE, SIDE)).astype(np.uint8) for _ in range(3)], "zoom": zoomed, "one": [see(9, 9)],
    }
    rows = [(name, 10 * k * k, bytearray(f.tobytes())) for name, fs in clips.items() for k, f in enumerate(fs)] + [("still", 15, None), ("none", 1, None)]
    frames = spark.createDataFrame(rows, "clip string, at long, frame binary").repartition(5)
    pairs = pictures.frame_pairs(frames, ["clip"], "at", "frame")
    got = {name: sorted(tuple(r)[1:] for r in pairs.collect() if r.clip == name) for name in clips}
    want = {name: [(k, *plain_vector(a, b)) for k, (a, b) in enumerate(zip(fs, fs[1:], strict=False))] for name, fs in clips.items()}
    for name in clips:
        assert np.array(got[name]) == pytest.approx(np.array(want[name])), name
    found = {r.clip: r for r in pictures.clip_motion(pairs, ["clip"]).collect()}
    assert set(found) == set(clips) - {"one"}
    for name, r in found.items():
        assert told(r)[0] == plain_clip([p[1:] for p in want[name]])[0] and told(r)[1:] == pytest.approx(plain_clip([p[1:] for p in want[name]])[1:])
    assert [found[n]["class"] for n in ("still", "pan", "tilt", "shaky", "zoom")] == ["static", "pan", "tilt", "handheld", "zoom"]
    assert found["shaky"].is_shaky and not found["pan"].is_shaky
    with pytest.raises(Exception, match="a frame has"):
        pictures.frame_pairs(spark.createDataFrame([("a", 1, bytearray(5)), ("a", 2, bytearray(5))], "clip string, at long, frame binary"), ["clip"], "at", "frame").collect()


def test_frames_are_made_where_they_are_compared(spark, monkeypatch):
    rng = np.random.default_rng(6)
    plane = rng.integers(0, 256, (200, 200)).astype(np.uint8)
    rows = [("a", k, bytearray(plane[2 * k : 2 * k + SIDE, k : k + SIDE].tobytes())) for k in range(5)]
    frames = spark.createDataFrame(rows, "clip string, at long, frame binary")
    halves = frames.selectExpr("clip", "at", "substring(frame, 1, 12800) AS x", "substring(frame, 12801) AS y")
    want = sorted(tuple(r) for r in pictures.frame_pairs(frames, ["clip"], "at", "frame").collect())
    made = pictures.frame_pairs(halves, ["clip"], "at", F.concat("x", "y"))
    assert sorted(tuple(r) for r in made.collect()) == want and [p[2:4] for p in want] == [(-1.0, -2.0)] * 4
    # blocks that are found again need no search of all places
    monkeypatch.setattr(kernels, "_costs", lambda own, new: pytest.fail("searched"))
    assert kernels.motion_vector(bytes(rows[0][2]), bytes(rows[1][2]))[:2] == (-1.0, -2.0)


def test_frames_are_made_by_a_function(spark, monkeypatch):
    monkeypatch.setattr(pictures, "FRAMES", 3)
    line = lambda r: F.sha2(F.concat_ws(":", "seed", (r + F.col("y")).cast("string")), 512)
    rows = [("pan", k, 7, 3 * k, 0, SIDE) for k in range(5)] + [("tilt", k, 8, 0, 2 * k, SIDE + 8) for k in range(5)] + [("noise", k, k, 0, 0, SIDE) for k in range(3)] + [("none", k, None, 0, k, SIDE + 1) for k in range(2)]
    told = spark.createDataFrame(rows, "clip string, at long, seed long, x int, y int, height int").repartition(3)
    # a row of the texture is a digest of 64 bytes four times over; what is seen of it begins at x
    texture = F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda r: F.substring(F.repeat(line(r), 4), 2 * F.col("x") + 1, F.lit(2 * SIDE)))
    want = pictures.frame_pairs(told, ["clip"], "at", F.unhex(F.array_join(texture, "")))
    got = pictures.frame_pairs(told, ["clip"], "at", plans._seen)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {tuple(r)[2:] for r in got.collect() if r.clip == "pan"} == {(-3.0, 0.0, 0.0, 0.0, 1.0)}
    # what the frames of a clip are cut from is made once
    plans._texture.cache_clear()
    for _, _, seed, x, y, height in rows[:10]:
        plans._seen(seed, x, y, height)
    assert plans._texture.cache_info().misses == 2


def test_blocks_differ_as_a_plain_loop_says():
    rng = np.random.default_rng(9)
    for low, high in ((0, 256), (254, 256), (0, 2)):
        before, after = rng.integers(low, high, (2, SIDE, SIDE)).astype(np.uint8)
        before[40:60], after[50:75] = 255, 0
        own = before[16:144, 16:144]
        costs = kernels._costs(own, after)
        for k, (dx, dy) in enumerate(kernels._shifts()):
            apart = np.abs(own.astype(int) - after[16 + dy : 144 + dy, 16 + dx : 144 + dx])
            assert (costs[k] == apart.reshape(8, 16, 8, 16).sum(axis=(1, 3))).all()
        blocks = own.astype(float).reshape(8, 16, 8, 16)
        assert (kernels._textured(own) == (blocks.std(axis=(1, 3)) >= 6)).all()
    assert kernels.motion_vector(before.tobytes(), before.tobytes())[:4] == (0, 0, 0, 0)


def test_long_clips_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(pictures, "PAIRS", 5)
    rng = random.Random(3)
    clips = {c: [(rng.choice([-3.0, 0.0, 0.4, 2.0, 6.0]), rng.choice([-1.0, 0.0, 5.0]), rng.uniform(-1, 1), rng.random(), rng.choice([0.2, 0.6, 0.9, 0.95])) for _ in range(n)] for c, n in enumerate([1, 2, 3, 4, 5, 6, 23, 60])}
    rows = [(c, k, *p) for c, ps in clips.items() for k, p in enumerate(ps)]
    found = pictures.clip_motion(spark.createDataFrame(rows, "clip long, pair long, dx double, dy double, zoom double, residual double, agreement double").repartition(4), ["clip"]).collect()
    assert len(found) == len(clips)
    for r in found:
        want = plain_clip(clips[r.clip])
        assert told(r)[0] == want[0] and told(r)[1:] == pytest.approx(want[1:])


def plain_tilt(g):
    h, w = g.shape
    g = g.astype(float)
    edges = []
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            dx = g[y - 1, x + 1] + 2 * g[y, x + 1] + g[y + 1, x + 1] - g[y - 1, x - 1] - 2 * g[y, x - 1] - g[y + 1, x - 1]
            dy = g[y + 1, x - 1] + 2 * g[y + 1, x] + g[y + 1, x + 1] - g[y - 1, x - 1] - 2 * g[y - 1, x] - g[y - 1, x + 1]
            if math.hypot(dx, dy) >= 80:
                edges.append((x, y))
    if min(h, w) < 8 or len(edges) < 8:
        return None
    best, angle = 0, 0
    for degree in range(180):
        votes = {}
        for x, y in edges:
            rho = math.floor(x * math.cos(math.radians(degree)) + y * math.sin(math.radians(degree)) + 0.5)
            votes[rho] = votes.get(rho, 0) + 1
        if max(votes.values()) > best:
            best, angle = max(votes.values()), degree
    return None if best < int(max(max(w, h) * 0.25, 12)) else float(min(angle % 90, 90 - angle % 90))


def plain_cells(g):
    h, w = g.shape
    found = []
    for cell in range(9):
        values = [float(g[y, x]) for y in range(h) for x in range(w) if (cell // 3) * h // 3 <= y < (cell // 3 + 1) * h // 3 and (cell % 3) * w // 3 <= x < (cell % 3 + 1) * w // 3]
        if values:
            mean, low, high = sum(values) / len(values), sum(v <= 8 for v in values) / len(values), sum(v >= 247 for v in values) / len(values)
            status, severity = ("under", low * (1 - mean / 255)) if low >= 0.1 and mean <= 60 else ("over", high * mean / 255) if high >= 0.1 and mean >= 170 else ("normal", 0.0)
            found.append((-severity, cell, status))
    return (min(found)[1], min(found)[2], -min(found)[0]) if found else (None, "unknown", 0.0)


def sample_pictures():
    rng = np.random.default_rng(2)
    y, x = np.mgrid[0:48, 0:60]
    dark = np.full((48, 60), 120)
    dark[:16, 20:40] = 2
    light = np.full((48, 60), 130)
    light[32:, 40:] = 255
    sloped = np.where(y > 0.2 * x + 15, 220, 30)
    spot = np.full((64, 64), 90.0)
    spot[20:36, 24:40] += rng.uniform(-60, 60, (16, 16))
    return [dark, light, sloped, np.full((30, 30), 77), rng.integers(0, 256, (40, 52)), spot, rng.integers(0, 256, (1, 2)), np.where(x > 30, 200, 20), rng.integers(0, 256, (5, 5))]


def test_quality_against_plain_loops(spark):
    shown = [p.astype(np.uint8) for p in sample_pictures()]
    rows = [(i, bytearray(p.tobytes()), p.shape[1], p.shape[0], "x") for i, p in enumerate(shown)] + [(90, None, 3, 3, "x"), (91, bytearray(5), 3, 3, "x"), (92, bytearray(), 0, 0, "x"), (93, bytearray(9), None, 3, "x")]
    found = {r.id: r for r in pictures.picture_quality(spark.createDataFrame(rows, "id long, gray binary, w int, h int, label string"), "gray", "w", "h").collect()}
    for i, p in enumerate(shown):
        want = plain_cells(p)
        assert (found[i].worst_cell, found[i].exposure) == want[:2] and found[i].severity == pytest.approx(want[2])
        assert found[i].tilt == plain_tilt(p)
    assert all(found[i].exposure is None and found[i].tilt is None for i in (90, 91, 92, 93))
    assert found[2].tilt == pytest.approx(11, abs=1) and found[7].tilt == 0 and found[0].exposure == "under" and found[1].exposure == "over"


def test_sharpness_looks_where_the_picture_stands_out():
    shown = [p.astype(np.uint8) for p in sample_pictures()]
    spot = shown[5]
    soft = spot.copy().astype(float)
    for _ in range(4):
        soft[1:-1, 1:-1] = (soft[:-2, 1:-1] + soft[2:, 1:-1] + soft[1:-1, :-2] + soft[1:-1, 2:] + soft[1:-1, 1:-1]) / 5
    assert kernels.salient_sharpness(spot) > 10 * kernels.salient_sharpness(soft)
    assert kernels.salient_sharpness(shown[3]) is None and kernels.salient_sharpness(shown[6]) is None
    # the spot fills a sixteenth of the picture; the mean over all of it would be far less
    edges = spot[1:-1, :-2].astype(float) + spot[1:-1, 2:] + spot[:-2, 1:-1] + spot[2:, 1:-1] - 4.0 * spot[1:-1, 1:-1]
    assert kernels.salient_sharpness(spot) > 2 * edges.var()


def test_pages_are_dealt_to_all_tasks_and_edges_vote_in_rounds(spark):
    found = QUERIES["picture_quality"](spark, "/root/testdata/sf0.001")
    assert found.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    noise = np.random.default_rng(4).integers(0, 256, (60, 57)).astype(np.uint8)
    noise[np.tril_indices(60, -3, 57)] //= 9
    assert kernels.tilt(noise) == plain_tilt(noise)


def test_resizing_keeps_flat_pictures_flat():
    for old, new in ((7, 64), (64, 7), (64, 64), (300, 64)):
        assert kernels.resized(np.full((old, old), 5.0), new, new) == pytest.approx(np.full((new, new), 5.0))


def test_exposures_alone_do_not_look_for_lines(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(k, bytearray(rng.integers(0, 256, 400).astype(np.uint8).tobytes()), 20) for k in range(4)] + [(9, None, 20), (10, bytearray(3), 20)]
    frames = spark.createDataFrame(rows, "id long, gray binary, side int")
    names = ["id", "worst_cell", "exposure", "severity"]
    want = sorted(tuple(r) for r in pictures.picture_quality(frames, "gray", "side", "side").select(*names).collect())
    seen = []
    monkeypatch.setattr(pictures, "_told", lambda *a, told=pictures._told: seen.append(a[-1]) or told(*a))
    assert sorted(tuple(r) for r in pictures.exposures(frames, "gray", "side", "side").select(*names).collect()) == want
    assert seen == [kernels.exposure]
