"""Short-time spectra of sound, and what a stretch of frames says about tempo, beats and sections."""

from __future__ import annotations

import numpy as np

#: Samples of a frame and between two frames' starts.
FRAME, HOP = 2048, 512
#: Tempos that are looked for, in steps, and the usual one with the width of the preference for it.
SLOWEST, FASTEST, STEP, USUAL, WIDTH = 60.0, 200.0, 0.1, 120.0, 0.7
#: Surroundings of a beat in seconds, deviations that it stands out by, and the share of the track's greatest flux that it needs.
AROUND, DEVIATIONS, FLOOR = 1.5, 1.0, 0.05
#: Frames whose spectra are made at a time.
FEW = 8
_TAPER = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)


def envelope(samples: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flux, loudness, centroid in hertz) of each whole frame; flux is the rise of magnitudes since the frame before, 0 for the first."""
    if len(samples) < FRAME:
        return (np.zeros(0),) * 3
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(float) / 32768.0, FRAME)[::HOP]
    loud, centre, flux = (np.zeros(len(frames)) for _ in range(3))
    pitch = np.arange(FRAME // 2 + 1) * rate / FRAME
    # a few frames at a time in buffers that stay in the cache; row 0 of size is the frame before, and silence has no spectrum
    work, spectrum, size = np.empty((FEW, FRAME)), np.empty((FEW, len(pitch)), complex), np.zeros((FEW + 1, len(pitch)))
    sounds, silent = _sounding(samples, len(frames)), True
    for at in range(0, len(frames), FEW):
        n = min(FEW, len(frames) - at)
        heard = sounds[at : at + n]
        if heard.any():
            few = frames[at : at + n]
            loud[at : at + n] = np.sqrt(np.multiply(few, few, out=work[:n]).mean(axis=1))
            np.fft.rfft(np.multiply(few, _TAPER, out=work[:n]), axis=1, out=spectrum[:n])
            np.abs(spectrum[:n], out=size[1 : n + 1])
            total = size[1 : n + 1].sum(axis=1)
            np.divide(size[1 : n + 1] @ pitch, total, out=centre[at : at + n], where=total > 0)
        elif not silent:
            size[1:] = 0
        if not silent or heard.any():
            rise = np.subtract(size[1 : n + 1], size[:n], out=work[:n, : len(pitch)])
            flux[at : at + n] = np.maximum(rise, 0, out=rise).sum(axis=1)
        size[0] = size[n]
        silent = not heard[-1]
    flux[0] = 0.0
    return flux, loud, centre


def _sounding(samples: np.ndarray, count: int) -> np.ndarray:
    """Which of count frames hold a sample other than 0."""
    steps = FRAME // HOP
    loud = samples[: (count + steps - 1) * HOP].reshape(-1, HOP).any(axis=1)
    return np.lib.stride_tricks.sliding_window_view(loud, steps).any(axis=1)


def lags(frame_rate: float) -> tuple[int, int]:
    """Least and greatest whole lag, in frames, that a tempo in the range lies next to."""
    return int(60 * frame_rate / FASTEST), int(60 * frame_rate / SLOWEST)


def lagged(flux: np.ndarray, first: int, here: slice, count: int, mean: float, frame_rate: float) -> list[tuple[int, float, float, float]]:
    """(lag, a, b, whole): sums of products of the frames in here with those a lag, and one more, later.

    flux starts at frame first of a track of count frames. a and b leave out the pairs that a lag between the two has
    no partner for, whole is the sum for the lag itself.
    """
    low, high = lags(frame_rate)
    own = np.zeros(len(flux) + high + 2)
    own[: len(flux)] = flux - mean  # frames beyond the end are never multiplied: what is left of them is cut below
    out = []
    for lag in range(low, high + 1):
        def total(ahead: int, end: int, own: np.ndarray = own) -> float:
            stop = min(here.stop, end - first)
            return float(own[here.start : stop] @ own[here.start + ahead : stop + ahead]) if stop > here.start else 0.0

        out.append((lag, total(lag, count - lag - 2), total(lag + 1, count - lag - 2), total(lag, count - lag - 1)))
    return out


def beats(flux: np.ndarray, first: int, here: slice, count: int, peak: float, frame_rate: float) -> list[tuple[float, float]]:
    """(position, strength) of frames in here that stand out, the position refined by a parabola; neighbours too close to each other included."""
    half = max(1, int(np.floor(AROUND * frame_rate / 2 + 0.5)))
    out = []
    i = np.arange(max(here.start, 1 - first), min(here.stop, count - 1 - first))
    tall = (flux[i] >= peak * FLOOR) & (flux[i] >= flux[i - 1]) & (flux[i] > flux[i + 1])
    for i in i[tall].tolist():
        v = flux[i]
        near = flux[max(0, i - half) : i + half + 1]
        if v < near.mean() + DEVIATIONS * near.std():
            continue
        bend = flux[i - 1] - 2 * v + flux[i + 1]
        shift = 0.0 if abs(bend) < 2.3e-16 else float(np.clip(0.5 * (flux[i - 1] - flux[i + 1]) / bend, -0.5, 0.5))
        out.append((first + i + shift, float(v / peak)))
    return out


def novelty(level: np.ndarray, colour: np.ndarray, first: int, here: slice, count: int, span: int) -> np.ndarray:
    """Difference of the means of span frames before and after each frame in here; 0 where there are not as many."""
    out = np.zeros(max(0, here.stop - here.start))
    sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in (level, colour)]
    i = np.arange(max(here.start, span - first), min(here.stop, count - span - first))
    if len(i):
        out[i - here.start] = np.hypot(*[(2 * s[i] - s[i - span] - s[i + span]) / span for s in sums])
    return out


def merged(found: list[tuple[float, float]], least: float) -> list[tuple[float, float]]:
    """Beats in order, of those closer than least the stronger one, the first of equals."""
    out: list[tuple[float, float]] = []
    for position, strength in found:
        if out and position - out[-1][0] < least:
            if strength > out[-1][1]:
                out[-1] = (position, strength)
        else:
            out.append((position, strength))
    return out


def thinned(values: list, least: float) -> list:
    """Sorted values that are at least that far from the last one kept."""
    out: list = []
    for v in values:
        if not out or v - out[-1] >= least:
            out.append(v)
    return out
