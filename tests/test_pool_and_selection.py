"""Automatic selection, hot keys and lists against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutroom.functions import geo, scalars
from cutroom.operators import autoselect, delivery, pool, records, similarity, windows
from cutroom.operators.components import connected_components, fold
from tests.conftest import rows


def test_turns_equal_a_plain_loop(spark):
    rng = random.Random(5)
    data = [(e, c, None if c == 3 else c * 2 % 5, i, rng.randint(0, 9) / 2, rng.choice([1.5, 3.0, 8.0])) for i, (e, c) in enumerate((rng.randint(0, 2), rng.randint(0, 3)) for _ in range(60))]
    df = spark.createDataFrame(data, "e int, c int, r int, i int, s double, t double")
    got = {}
    for r in autoselect.take_turns(df, "e", "c", "r", "i", "s", "t", 40.0).orderBy("e", "place").collect():
        got.setdefault(r.e, []).append(r.i)
    for episode in {d[0] for d in data}:
        chapters = sorted({(d[2] is None, d[2] or 0, d[1]) for d in data if d[0] == episode})
        queues = [sorted(((-d[4], d[3], d[5]) for d in data if d[0] == episode and d[1] == c)) for _, _, c in chapters]
        total, picked, at = 0.0, [], [0] * len(queues)
        while True:
            moved = False
            for k, queue in enumerate(queues):
                while at[k] < len(queue):
                    _, who, long = queue[at[k]]
                    at[k] += 1
                    if total + long <= 40 + 1e-9:
                        total, moved = total + long, True
                        picked.append(who)
                        break
            if not moved:
                break
        assert got[episode] == picked


def test_scopes_and_weights_are_checked():
    with pytest.raises(ValueError):
        pool.in_scope("some", F.lit(1), F.lit(1))
    with pytest.raises(ValueError):
        autoselect.reweighted({"a": (F.lit(1.0), 0.0)}, {}, set())


def test_ranks_by_range(spark):
    data = [(None if k == 4 else k, v % 7, v) for k in (1, 1, 1, 4) for v in range(50)]
    df = spark.createDataFrame([(k, s, i) for i, (k, s, _) in enumerate(data)], "k int, s int, i int").repartition(5)
    got = {r.i: r["rank"] for r in windows.ranked(df, ["k"], [F.col("s"), F.col("i")]).collect()}
    for key in (1, None):
        want = sorted((s, i) for i, (k, s, _) in enumerate(data) if k == key)
        assert [got[i] for _, i in want] == list(range(1, len(want) + 1))


def test_percentiles_interpolate(spark):
    rng = random.Random(3)
    data = [(k, i, rng.random()) for k, n in ((1, 1), (2, 2), (3, 57)) for i in range(n)] + [(3, 99, None)]
    df = spark.createDataFrame(data, "k int, i int, v double")
    for r in windows.interpolated_percentiles(df, ["k"], "v", [F.col("i")], {"a": 0.5, "b": 0.95}).collect():
        held = [v for k, _, v in data if k == r.k and v is not None]
        assert (r.a, r.b) == pytest.approx(tuple(np.percentile(held, [50, 95])))


@pytest.mark.parametrize("few", [0, 1000])
def test_percentiles_sort_only_the_ranges_that_are_asked_for(spark, monkeypatch, few):
    monkeypatch.setattr(windows, "ROWS", 20, raising=False)
    monkeypatch.setattr(windows, "FEW", few, raising=False)
    rng = random.Random(7)
    data = [(k, i, float(rng.randrange(40)) if i % 3 else 5.0) for k, n in ((1, 1), (2, 300), (None, 150)) for i in range(n)]
    numbered = []
    monkeypatch.setattr(windows.F, "row_number", lambda row_number=windows.F.row_number: numbered.append(1) or row_number())
    found = windows.interpolated_percentiles(spark.createDataFrame(data, "k int, i int, v double"), ["k"], "v", [F.col("i")], {"a": 0.5, "b": 0.95})
    got = {r.k: (r.a, r.b) for r in found.collect()}
    assert len(numbered) == 1 and set(got) == {1, 2, None}
    for key, told in got.items():
        assert told == pytest.approx(tuple(np.percentile([v for k, _, v in data if k == key], [50, 95])))


def test_least_within_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 7)
    rng = np.random.default_rng(4)
    data = [(g, i, [float(x) for x in rng.normal(size=6)]) for g, n in ((1, 30), (2, 2), (3, 1)) for i in range(n)] + [(4, 0, None), (4, 1, [1.0] * 6), (4, 2, [1.0] * 6)]
    got = {r.g: (r.least, r.pairs) for r in similarity.least_within(spark.createDataFrame(data, "g int, i int, v array<double>"), "g", "i", "v").collect()}
    for g in (1, 2):
        u = np.array([v for k, _, v in data if k == g])
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        near = (u @ u.T)[np.triu_indices(len(u), 1)]
        assert got[g][0] == pytest.approx(near.min()) and got[g][1] == len(near)
    assert got[4] == (0.0, 3) and 3 not in got


def test_clusters_without_pairs(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 4))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i long, v array<double>")
    p, q = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
    label = np.arange(len(x))
    fold(label, p, q)
    want = {i: label[i] for i in range(len(x)) if (label == label[i]).sum() > 1}
    assert {r.node: r.component for r in similarity.similar_clusters(df, "i", "v", 0.95).collect()} == want


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(5000, 4999), (None, 3), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(301)} | {k: 1000 for k in range(1000, 1400)} | {5000: 4999, 4999: 4999}


def test_moves_keep_the_rest_in_order(spark):
    df = spark.createDataFrame([(k, i, p) for k in (1, 2, 3, 4) for p, i in enumerate("abcde")], "k int, i string, place int")
    moves = spark.createDataFrame([(1, "a", 3), (2, "e", 0), (3, "c", None), (4, "b", 99)], "k int, item string, target int")
    got = {}
    for r in delivery.moved(df, "k", "place", "i", moves).orderBy("k", "place").collect():
        got.setdefault(r.k, []).append(r.i)
    assert {k: "".join(v) for k, v in got.items()} == {1: "bcdae", 2: "eabcd", 3: "abde", 4: "acdeb"}


def test_words_for_numbers_and_lengths(spark):
    numbers = {"三十二": 32, "十": 10, "一百零五": 105, "两千": 2000, "42": 42, "一千三百": 1300, "百": 100, "x": None, "": None}
    phrases = {"90秒": 90.0, "一分半": 90.0, "两分钟三十秒": 150.0, "1.5 min": 90.0, "short": None}
    df = spark.createDataFrame([(t,) for t in numbers], "t string").select("t", scalars.han_number(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == numbers
    df = spark.createDataFrame([(t,) for t in phrases], "t string").select("t", scalars.spoken_seconds(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == phrases
    places = {"+48.8577+002.295/": (48.8577, 2.295), "-33.8 , 151.2": (-33.8, 151.2), "91,0": None, "x": None}
    df = spark.createDataFrame([(t,) for t in places], "t string").select("t", geo.parse_place(F.col("t")).alias("p"))
    assert {r.t: r.p and (r.p.lat, r.p.lon) for r in df.collect()} == places


def test_overview_needs_the_whole_selection(spark):
    beats = spark.createDataFrame([(1, "b", 2, 20), (1, "a", 1, 10), (2, "a", 1, 10)], "e int, c string, p int, i int")
    chosen = spark.createDataFrame([(1, 10), (1, 20), (2, 10), (2, 30)], "e int, i int")
    assert [(r.e, [(c.c, c["items"]) for c in r.chapters]) for r in records.overview(beats, chosen, "e", "c", "p", "i").collect()] == [(1, [("a", [10]), ("b", [20])])]
    assert rows(records.all_or_nothing(chosen, "e", F.col("i") < 30)) == [(1, 10), (1, 20)]
