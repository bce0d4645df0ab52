import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutroom.functions import kernels, scalars
from cutroom.operators import components, evaluate, intervals, merge, selection, similarity, story, windows
from tests.conftest import rows


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(5, k) for k in range(6, 40)] + [(900, 900), (None, 3), (7, 6)]
    found = dict(rows(components.connected_components(spark.createDataFrame(edges, "src long, dst long"))))
    assert {found[i] for i in range(100, 181)} == {100}
    assert {found[i] for i in range(5, 40)} == {5}
    assert 900 not in found and len(found) == 81 + 35
    assert not rows(components.connected_components(spark.createDataFrame([], "src long, dst long")))


def test_similar_pairs_are_exact(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.15])
    vectors = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16)]
    got = {(a, b) for a, b, _ in rows(similarity.similar_pairs(spark.createDataFrame(vectors, "i long, v array<double>"), "i", "v", 0.9))}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.9}


def test_rough_cut_against_a_loop(spark):
    rng = random.Random(1)
    data = [(g, i, rng.choice([0, 400, 900, 5000, 20000, 61000])) for g in range(6) for i in range(rng.randint(0, 7))]
    got = {(g, i): n for g, i, n in rows(selection.rough_cut(spark.createDataFrame(data, "g long, i long, n long"), ["g"], "i", "n", 30_000))}
    for g in range(6):
        clips = sorted([(-n, i) for h, i, n in data if h == g and n > 0])
        if not clips:
            continue
        cap = max(2000, 30_000 // len(clips), 1000)
        granted = {i: min(-m, cap) for m, i in clips}
        left = max(0, 30_000 - sum(granted.values()))
        for m, i in clips:
            more = min(left, -m - granted[i])
            granted[i] += more
            left -= more
        assert {i: got[g, i] for _, i in clips} == granted


def test_duels_replay(spark):
    data = [(1, [10, 20, 30], [20, 30]), (2, [1, 2, 3], [None, 2]), (3, [5], []), (4, [1, 2], [9, 1]), (5, [], [])]
    got = {r["s"]: (r.winner, r.co_winners, r.waiting) for r in selection.replay_duels(spark.createDataFrame(data, "s long, q array<long>, v array<long>"), "s", "q", "v").collect()}
    assert got[1] == (30, [], 0) and got[2] == (2, [1], 0) and got[3] == (5, [], 0) and got[4] == (1, [], 0) and got[5][0] is None


def test_boundary_matching_against_a_loop(spark):
    rng = random.Random(2)
    data = [(i, sorted(rng.randint(0, 100) for _ in range(rng.randint(0, 6))), sorted(rng.randint(0, 100) for _ in range(rng.randint(0, 6)))) for i in range(30)] + [(99, None, [1])]
    got = {k: v for k, *v in rows(evaluate.matched_boundaries(spark.createDataFrame(data, "k long, t array<long>, f array<long>"), ["k"], "t", "f", 8))}
    for k, truth, found in data:
        free, tp = list(found), 0
        for t in truth or []:
            near = [f for f in free if abs(f - t) <= 8]
            if near:
                free.remove(min(near, key=lambda f: (abs(f - t), f)))
                tp += 1
        assert got[k] == [tp, len(found) - tp, len(truth or []) - tp]


def test_complete_link_against_a_loop(spark):
    rng = random.Random(4)
    data = [(i, i % 3, rng.random()) for i in range(60)]
    close = lambda frame, i, members: all(abs(frame.x[i] - frame.x[m]) < 0.2 for m in members)
    got = {i: (e, c) for e, i, c in rows(similarity.complete_link(spark.createDataFrame(data, "i long, e long, x double"), "e", ["i"], "i", close, most=5))}
    for e in range(3):
        groups = []
        for i, _, x in (r for r in data if r[1] == e):
            for k, g in enumerate(groups):
                if len(g) < 5 and all(abs(x - y) < 0.2 for y in g):
                    g.append(x)
                    break
            else:
                k = len(groups)
                groups.append([x])
            assert got[i] == (e, k)


def test_complete_link_leaves_no_copy_alone(spark):
    data = spark.createDataFrame([(i, 0, float(s)) for i, s in enumerate([5, 1, 3, 1, 9, 7])], "i long, e long, sharp double")
    close = lambda frame, i, members: True
    got = {i: c for _, i, c in rows(similarity.complete_link(data, "e", ["i"], "i", close, most=5, weakest=["sharp"]))}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 0, 5: 1}


def test_running_sum_over_partitions(spark):
    data = [(i * 7 % 1000, i % 5) for i in range(1000)]
    got = {k: b for k, v, b in rows(windows.running_sum(spark.createDataFrame(data, "k long, v long"), [F.col("k")], "v"))}
    total = 0
    for k, v in sorted(data):
        assert got[k] == total
        total += v


def test_weights_and_null_axes(spark):
    one = spark.range(1)
    score = selection.take_score({"technical": F.lit(0.5), "motion": F.lit(None).cast("double"), "audio": F.lit(1.0)}, F.lit(9.0))
    assert one.select(score).first()[0] == pytest.approx((0.28 * 0.5 + 0.12) / 0.40 + 0.20)
    for wrong in ({"speed": 0.1}, {"sharp": 2.0}, dict.fromkeys(selection.MOMENT_WEIGHTS, 0.0)):
        with pytest.raises(ValueError):
            selection.check_weights(wrong, selection.MOMENT_WEIGHTS)
    assert one.select(scalars.clamp01(F.lit(float("nan")))).first()[0] == 0.0


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.excerpt(F.lit("x" * 30 + "NEEDLE" + "y" * 30), "needle", 4).alias("a"), scalars.excerpt(F.lit("short"), "zz", 3).alias("b"),
        scalars.keywords(F.lit("An Orange orange 旅行日记 ab")).alias("c"), scalars.metric(F.lit("a=1.5;b=x"), "a").alias("d"), scalars.metric(F.lit("a=1.5;b=x"), "b").alias("e"),
        scalars.rescale(F.lit(5), F.lit(1), F.lit(2), 1).alias("f"), scalars.clock(F.lit(3_723_004), True).alias("g"), scalars.stem_number(F.lit("/d/IMG_0042.JPG")).alias("h"),
    ).first()
    assert (row.a, row.b, row.c) == ("…xxxxNEEDLEyyyy", "short", ["orange", "旅行", "行日", "日记"])
    assert (row.d, row.e, row.f, row.g, row.h) == (1.5, None, 3, "01:02:03,004", 42)


def test_upserts_and_deltas(spark):
    old = spark.createDataFrame([(1, "a", "user"), (2, "b", "auto")], "k long, v string, source string")
    new = spark.createDataFrame([(1, "x", "auto"), (2, "y", "auto"), (3, "z", "auto")], "k long, v string, source string")
    assert rows(merge.upsert(old, new, ["k"], guard=F.col("source") != "user")) == [(1, "a", "user"), (2, "y", "auto"), (3, "z", "auto")]
    assert rows(merge.insert_absent(old, new, ["k"])) == [(1, "a", "user"), (2, "b", "auto"), (3, "z", "auto")]
    assert rows(merge.delta(old, new, ["k"])) == [(1, "modified"), (2, "modified"), (3, "added")]
    assert rows(merge.violations_unique(old.union(old), ["k"])) == [(1, 2), (2, 2)]
    assert merge.fingerprint(old).first() == merge.fingerprint(old.orderBy(F.desc("k"))).first()


def test_intervals_at_their_edges(spark):
    spans = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 15, 18), (1, 30, 30), (2, 5, 6)], "k long, s long, e long")
    assert rows(intervals.coverage(spans, ["k"], "s", "e")) == [(1, 20), (2, 1)]
    left = spark.createDataFrame([(1, 100, 0, 10), (1, 101, 10, 20)], "k long, i long, a long, b long")
    right = spark.createDataFrame([(1, 5, 10), (1, 0, 35)], "k long, c long, d long")
    assert sorted((r.i, r.c) for r in intervals.overlapping(left, right, ["k"], 7, ("a", "b"), ("c", "d")).collect()) == [(100, 0), (100, 5), (101, 0)]


def test_kernels():
    rng = np.random.default_rng(1)
    frame = rng.integers(0, 255, (160, 160)).astype(np.uint8)
    assert kernels.laplacian_variance(np.zeros((9, 9))) == 0.0 and kernels.laplacian_variance(frame) > 100
    assert list(kernels.waveform_peaks(np.array([1, 5, -2, 7]), 2)) == [1, 5, -2, 7]


def test_moments_of_one_place_meet_once(spark, monkeypatch):
    compared = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def apart(a, b, c, d):
        compared.add(1)
        return abs(a - c) + abs(b - d)

    monkeypatch.setattr(story, "haversine_km", apart)
    moments = spark.createDataFrame([(k % 3, k, 1000 * k, 40.0, 10.0) for k in range(200)], "d long, i long, t long, la double, lo double")
    reference = spark.createDataFrame([(k, 500 + k, 40.0, 10.0) for k in range(200)] + [(900, 3, 40.001, 10.0)], "i long, t long, la double, lo double")
    found = story.gps_matches(moments, reference, "d", "i", "t", "la", "lo")
    assert rows(found) == sorted([(k % 3, k, 1000 * k, 500) for k in range(200)], key=repr)
    assert compared.value <= 8


@pytest.mark.parametrize("few", [0, 2, 16])
def test_vectors_meet_once_in_any_bins(spark, monkeypatch, few):
    for name, value in {"HELD": 9, "ASKED": 7, "CHUNK": 4, "FEW": few}.items():
        monkeypatch.setattr(similarity, name, value)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 6))
    x[60:85] = x[3]  # a cell of more than a bin
    frames = [(i % 30, i, [float(v) for v in row]) for i, row in enumerate(x)] + [(2, 900, None), (31, 901, [1.0] * 6)]
    df = spark.createDataFrame(frames, "c long, i long, v array<double>").repartition(3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = {(i, j) for i in range(90) for j in range(i + 1, 90) if u[i] @ u[j] >= 0.7}
    found = [(a, b) for a, b, _ in rows(similarity.similar_pairs(df.where("i < 90"), "i", "v", 0.7))]
    assert len(found) == len(set(found)) and set(found) == near
    groups = dict(rows(components.connected_components(spark.createDataFrame(sorted(near), "a long, b long"), "a", "b")))
    assert {r.node: r.component for r in similarity.similar_clusters(df.where("i < 90"), "i", "v", 0.7).collect()} == groups
    m = np.stack([x[i::30].mean(axis=0) for i in range(30)])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    means = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(m)], "c long, v array<double>")
    alike = {(a, b) for a in range(30) for b in range(a + 1, 30) if m[a] @ m[b] >= 0.8 or (m[a] @ m[b] >= 0.3 and (u[a::30] @ u[b::30].T).max() >= 0.75)}
    got = rows(similarity.refined_pairs(means, df, "c", "i", "v", sure=0.8, slack=0.5, frame_sure=0.75))
    assert len(got) == len(set(got)) and set(got) == alike


def test_ranks_deal_rows_out_once(spark):
    rows = [(k, v) for k in (1, None, 2) for v in range(7)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (windows.ranked(df, ["k"], [F.col("v").desc()]), windows.placed(df, ["k"], [F.col("v").desc()], "v", "rank", "before")):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") <= 4  # rows, counts, counts by key, starts
            got = {(r.k, r.v): r for r in found.collect()}
            assert len(got) == 21 and all(r["rank"] == 7 - v for (_, v), r in got.items())
            assert "before" not in found.columns or all(r.before == sum(range(v + 1, 7)) for (_, v), r in got.items())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
