"""Sound chunk by chunk against a loop over whole tracks, however the bytes are cut."""

import math
import random

import numpy as np
import pytest

from cutroom.functions import spectra
from cutroom.operators import sound

RATE = sound.RATE


def clicks(seconds, bpm, gain=0.9, seed=3):
    rng = np.random.default_rng(seed)
    out = np.zeros(int(seconds * RATE))
    burst = RATE // 100
    for beat in range(math.ceil(seconds * bpm / 60)):
        start = round(beat * 60 / bpm * RATE)
        size = min(burst, len(out) - start)
        if size > 0:
            out[start : start + size] = rng.uniform(-1, 1, size) * gain * 30_000 * (1 - np.arange(size) / burst)
    return out.astype(np.int16)


def dither(seconds, seed):
    return np.random.default_rng(seed).integers(-1, 2, int(seconds * RATE)).astype(np.int16)


def staircase():
    rng = np.random.default_rng(9)
    t = np.arange(60 * RATE) / RATE
    bed = rng.uniform(-1, 1, len(t)) * np.where((t >= 20) & (t < 40), 0.9, 0.08) * 2_500
    return (bed + clicks(60, 120) // 2).astype(np.int16)


def plain(samples):
    """The whole track at once: (bpm, confidence, beats, downbeats, sections, cuts), or None without beats."""
    if len(samples) < 2 * spectra.FRAME:
        return None
    flux, loud, centre = spectra.envelope(samples, RATE)
    rate, count = RATE / spectra.HOP, len(flux)
    if flux.max() <= 1e-6 or loud.max() <= 1e-5:
        return None
    beats = []
    half = round(1.5 * rate / 2)
    for i in range(1, count - 1):
        near = flux[max(0, i - half) : i + half + 1]
        if flux[i] < 0.05 * flux.max() or flux[i] < flux[i - 1] or flux[i] <= flux[i + 1] or flux[i] < near.mean() + near.std():
            continue
        bend = flux[i - 1] - 2 * flux[i] + flux[i + 1]
        at, strength = i + max(-0.5, min(0.5, 0.5 * (flux[i - 1] - flux[i + 1]) / bend)), flux[i] / flux.max()
        if beats and at - beats[-1][0] < 0.1 * rate:
            if strength > beats[-1][1]:
                beats[-1] = (at, strength)
        else:
            beats.append((at, strength))
    if not beats:
        return None
    c, best, scores = flux - flux.mean(), None, []
    for step in range(1401):
        bpm = 60 + step * 0.1
        lag = 60 * rate / bpm
        span = math.ceil(lag) + 1
        if span >= count:
            continue
        low, part = int(lag), lag - int(lag)
        n = count - span
        score = (c[:n] * (c[low : low + n] * (1 - part) + c[low + 1 : low + 1 + n] * part)).sum() * math.exp(-0.5 * math.log(bpm / 120) ** 2 / 0.49)
        scores.append(max(score, 0))
        if best is None or score > best[0]:
            best = (score, bpm)
    confidence = best[0] / np.mean(scores) if best[0] > 0 else 0
    if confidence < 5:
        return None
    gaps = np.diff([b[0] for b in beats])
    bpm, most = best[1], 3
    for tried in [best[1]] + [best[1] * 2] * (best[1] * 2 <= 210) + [best[1] / 2] * (best[1] / 2 >= 57):
        period = 60 * rate / tried
        kept = gaps[(gaps > period * 0.75) & (gaps < period * 1.25)]
        if len(kept) > most:
            bpm, most = 60 * rate / kept.mean(), len(kept)
    ticks = [round(b[0] / rate * 1e6) for b in beats]
    first = max(range(min(4, len(beats))), key=lambda i: (beats[i][1], i))
    down = ticks[first::4]
    w = round(8 * rate)
    level, colour = loud / loud.max(), centre / centre.max()
    new = np.zeros(count)
    for i in range(w, count - w):
        new[i] = math.hypot(level[i - w : i].mean() - level[i : i + w].mean(), colour[i - w : i].mean() - colour[i : i + w].mean())
    bounds = [0]
    if count > 2 * w:
        least = max(0.08, new[w : count - w].mean() + new[w : count - w].std())
        for i in range(w, count - w):
            if new[i] >= least and new[i] >= new[i - 1] and new[i] > new[i + 1] and i - bounds[-1] >= w:
                bounds.append(i)
    ends = [*bounds[1:], count]
    energy = [level[a:b].mean() for a, b in zip(bounds, ends, strict=True)]
    starts = [round(b / rate * 1e6) for b in bounds]
    sections = list(zip(starts, [*starts[1:], int(len(samples) / RATE * 1e6)], energy, strict=True))
    cuts = []
    for t in sorted([*down, *starts]):
        if not cuts or t - cuts[-1] >= 100_000:
            cuts.append(t)
    return bpm, confidence, ticks, down, sections, cuts


def cut(pcm, rng):
    at, out = 0, [b""]
    while at < len(pcm):
        size = rng.choice([1, 2, 3, 777, 30_001, 64 * 1024])
        out.append(pcm[at : at + size])
        at += size
    return [*out, None, b""]


@pytest.fixture(scope="module")
def tracks():
    return {
        1: clicks(60, 120), 2: dither(30, 2), 3: clicks(60, 60), 4: clicks(60, 200), 5: np.zeros(60 * RATE, np.int16), 6: np.full(1000, 100, np.int16), 7: staircase(),
        8: np.concatenate([clicks(30, 90), clicks(30, 120)]), 9: clicks(8, 100), 10: np.zeros(0, np.int16),
    }


def test_chunks_against_whole_tracks(spark, tracks):
    rng = random.Random(6)
    rows = [(i, k, chunk, "x") for i, samples in tracks.items() for k, chunk in enumerate(cut(samples.tobytes(), rng))]
    rows += [(11, 0, clicks(20, 120).tobytes() + b"\x01", "x")]
    chunks = spark.createDataFrame(rows, "track long, k long, data binary, block string").repartition(6)
    found = sound.analyse(chunks, ["track"], "k", "data")
    got = {r.track: r for r in found.tracks.collect()}
    assert got[11].fault == "odd length" and set(got) == {*tracks, 11}
    beats, sections, cuts = ({i: [r for r in rows if r.track == i] for i in got} for rows in (found.beats.orderBy("tick").collect(), found.sections.orderBy("start_tick").collect(), found.cuts.orderBy("tick").collect()))
    assert not beats[11] and not sections[11] and not cuts[11]
    for i, samples in tracks.items():
        want = plain(samples)
        if want is None:
            assert (got[i].fault, got[i].bpm) == ("no beats", None) and not beats[i] and not sections[i] and not cuts[i]
            continue
        assert got[i].fault is None
        assert (got[i].bpm, got[i].confidence) == pytest.approx(want[:2])
        assert [r.tick for r in beats[i]] == pytest.approx(want[2], abs=1) and [r.beat for r in beats[i]] == list(range(1, len(want[2]) + 1))
        assert [r.tick for r in beats[i] if r.is_downbeat] == pytest.approx(want[3], abs=1)
        assert [(r.start_tick, r.end_tick) for r in sections[i]] == [s[:2] for s in want[4]]
        assert [r.energy for r in sections[i]] == pytest.approx([s[2] for s in want[4]])
        assert [r.tick for r in cuts[i]] == pytest.approx(want[5], abs=1)
    # what such tracks must be found to be
    assert abs(got[1].bpm - 120) <= 2 and abs(got[3].bpm - 60) <= 2 and abs(got[4].bpm - 200) <= 3
    assert {i for i in tracks if got[i].fault} == {2, 5, 6, 10}
    assert 88 <= got[8].bpm <= 122
    assert len(sections[7]) >= 3 and sections[7][1].label in ("climax", "build") and abs(sections[7][1].start_tick - 20_000_000) <= 2_100_000
    assert sections[7][1].energy > 2 * sections[7][0].energy and [r.label for r in sections[1]] == ["other"]


def test_any_cut_gives_the_same_samples(spark):
    rng = random.Random(1)
    pcm = bytes(rng.randrange(256) for _ in range(5_001))
    rows = [(t, k, c) for t in range(6) for k, c in enumerate(cut(pcm[: 5_001 - t], rng) if t else [pcm[i : i + 1] for i in range(5_001)])]
    found = sound.carried_samples(spark.createDataFrame(rows, "t long, k long, data binary").repartition(3), ["t"], "k", "data").collect()
    for t in range(6):
        parts = sorted((r.first, r.n, bytes(r.pcm)) for r in found if r.t == t)
        assert b"".join(p for *_, p in parts) == pcm[: (5_001 - t) // 2 * 2]
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:i]) for i in range(len(parts))]


def test_chains_break_where_values_are_far(spark):
    from cutroom.operators.windows import chains

    rows = [(k, float(v)) for k in range(3) for v in (1, 2, 2.5, 9, 9.4, 20)] + [(7, 1.0)]
    found = chains(spark.createDataFrame(rows, "k int, v double").repartition(4), ["k"], "v", 1.0).collect()
    held = {}
    for r in found:
        held.setdefault((r.k, r.chain), []).append(r.v)
    assert sorted(sorted(v) for k, v in held.items() if k[0] == 1) == [[1.0], [2.0, 2.5], [9.0, 9.4], [20.0]] and sum(k[0] == 7 for k in held) == 1


def test_silent_frames_take_no_spectrum(monkeypatch):
    samples = np.concatenate([clicks(2, 60), np.zeros(20 * spectra.FRAME, np.int16), clicks(1, 60)])
    frames = [samples[i : i + spectra.FRAME] / 32768.0 for i in range(0, len(samples) - spectra.FRAME + 1, spectra.HOP)]
    sizes = [np.abs(np.fft.rfft(f * spectra._TAPER)) for f in frames]
    made, rfft = [], np.fft.rfft
    monkeypatch.setattr(np.fft, "rfft", lambda x, **how: (made.append(len(x)), rfft(x, **how))[1])
    flux, loud, _ = spectra.envelope(samples, RATE)
    assert flux == pytest.approx([0.0] + [np.maximum(b - a, 0).sum() for a, b in zip(sizes, sizes[1:])])
    assert loud == pytest.approx([np.sqrt((f**2).mean()) for f in frames])
    assert sum(made) <= sum(f.any() for f in frames) + 4 * spectra.FEW < len(frames)


def test_chunks_are_made_twice_at_most(spark):
    from pyspark.sql import functions as F

    made = spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def chunk(k):
        made.add(1)
        return bytes([k % 251, k % 7]) * 500

    n = 300
    sound.analyse(spark.range(n).select((F.col("id") % 2).alias("track"), F.col("id").alias("k"), chunk("id").alias("data")), ["track"], "k", "data").tracks.collect()
    assert n <= made.value <= 2 * n


def test_totals_of_samples_take_no_row_a_sample(spark):
    rng = random.Random(4)
    streams = {t: bytes(rng.randrange(256) for _ in range(n)) for t, n in enumerate((0, 1, 2, 2_600, 9_001))}
    chunks = spark.createDataFrame([(t, k, c) for t, pcm in streams.items() for k, c in enumerate(cut(pcm, rng))], "t long, k long, data binary")
    found = sound.sample_totals(sound.carried_samples(chunks, ["t"], "k", "data"), ["t"])
    assert "posexplode" not in found._jdf.queryExecution().executedPlan().toString()
    want = {t: np.frombuffer(pcm[: len(pcm) // 2 * 2], "<i2").astype(int) for t, pcm in streams.items() if len(pcm) > 1}
    assert {r.t: (r.n_samples, r.total, r.low, r.high, r.by_place) for r in found.collect()} == {t: (len(v), v.sum(), v.min(), v.max(), (v * (np.arange(len(v)) % 1000)).sum()) for t, v in want.items()}
