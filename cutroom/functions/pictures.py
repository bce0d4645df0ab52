"""Numbers of gray pictures: motion between two frames, exposure by cells, tilt, and sharpness of what stands out."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Side of a frame, of a block, blocks a side and the reach of the search, in pixels (fixed values).
SIDE, BLOCK, GRID, REACH = 160, 16, 8, 8
ORIGIN = (SIDE - BLOCK * GRID) // 2
#: Deviation of a block that has texture, blocks of it that make a frame's vectors trusted, and pixels within which blocks agree.
TEXTURE, TEXTURED, WITHIN = 6.0, 8, 1.0
#: Cells darker or lighter in the mean, with that share of black or white pixels (fixed values).
BLACK, WHITE, CLIPPED, DARK, LIGHT = 8, 247, 0.1, 60, 170
#: Gradient of an edge; least edges and votes of a line, and the share of the longer side it needs.
EDGE, EDGES, VOTES, LINE = 80.0, 8, 12, 0.25
#: Side of the picture whose spectrum tells what stands out, and the blur of the map.
SALIENT, BLUR = 64, 2.5


@lru_cache
def _shifts() -> tuple[tuple[int, int], ...]:
    span = range(-REACH, REACH + 1)
    return tuple(sorted(((dx, dy) for dx in span for dy in span), key=lambda s: (abs(s[0]) + abs(s[1]), abs(s[1]), abs(s[0]), s[1], s[0])))


def _costs(own: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Sums of absolute differences of each block (GRID x GRID) at each shift; a block's is 65,280 at most, so two bytes hold it.

    A difference is twice the greater less both, so the sums of the greater tell it beside those of each picture.
    """
    side, span, tall, first = BLOCK * GRID, 2 * REACH + 1, BLOCK + 2 * REACH, ORIGIN - REACH
    # rows lie by their place in the block first, so that all blocks' sums go down long lines, of all shifts down together
    here = np.ascontiguousarray(own.reshape(GRID, BLOCK, side).swapaxes(0, 1)).reshape(BLOCK, 1, -1)
    slab = np.empty((tall, GRID, side), np.uint8)
    beside = np.lib.stride_tricks.as_strided(new[first:, first:], (span, tall, GRID, side), (1, SIDE, BLOCK * SIDE, 1))
    below = np.lib.stride_tricks.as_strided(slab, (BLOCK, span, GRID * side), (GRID * side, GRID * side, 1))
    most = np.empty((BLOCK, span, GRID * side), np.uint8)
    both = most.view(np.uint16)
    odd, rows = np.empty_like(both), np.empty((span, span, GRID * side // 2), np.uint16)
    for dx in range(span):
        np.copyto(slab, beside[dx])
        np.maximum(here, below, out=most)
        # two neighbours are a number of two bytes; sums of these wrap around, and come right once the odd ones' share is taken off
        np.right_shift(both, 8, out=odd)
        half = BLOCK // 2
        while half:
            np.add(both[:half], both[half : 2 * half], out=both[:half])
            np.add(odd[:half], odd[half : 2 * half], out=odd[:half])
            half //= 2
        np.multiply(odd[0], 255, out=odd[0])
        np.subtract(both[0], odd[0], out=rows[dx])
    # eight sums of a block's columns are two numbers of eight bytes, whose four parts are added side by side
    eight = rows.view(np.uint64).reshape(span, span, GRID, GRID, BLOCK // 8)
    total = eight[..., 0] + eight[..., 1]
    total += total >> np.uint64(32)
    total += total >> np.uint64(16)
    greater = total.astype(np.uint16)
    windows = new.astype(np.uint16)
    step = 1
    while step < BLOCK:
        windows = windows[:-step] + windows[step:]
        windows = windows[:, :-step] + windows[:, step:]
        step *= 2
    down, along = windows.strides
    there = np.lib.stride_tricks.as_strided(windows[first:, first:], (span, span, GRID, GRID), (along, down, BLOCK * down, BLOCK * along))
    cost = greater + greater - there - _sums(own.astype(np.float32)).astype(np.uint16)
    x, y = _moves().T
    return cost[x + REACH, y + REACH]


@lru_cache
def _belong() -> np.ndarray:
    """A row a block of a side, with ones where its pixels lie."""
    return np.repeat(np.eye(GRID, dtype=np.float32), BLOCK, axis=1)


def _sums(own: np.ndarray) -> np.ndarray:
    """Sum of each block, of whole numbers whose sums four bytes hold (bytes and their squares)."""
    return _belong() @ own @ _belong().T


def _textured(own: np.ndarray) -> np.ndarray:
    """Blocks that deviate by TEXTURE or more, in whole numbers."""
    n, single = BLOCK * BLOCK, own.astype(np.float32)
    return n * _sums(single * single).astype(np.int64) - _sums(single).astype(np.int64) ** 2 >= TEXTURE**2 * n**2


@lru_cache
def _moves() -> np.ndarray:
    return np.array(_shifts())


@lru_cache
def _spots() -> np.ndarray:
    """Where the upper left corner of each block lies in the next frame, rows of shifts."""
    x, y = _moves().T
    corner = ORIGIN + np.arange(GRID) * BLOCK
    return ((corner[None, :, None] + y[:, None, None]) * SIDE + corner[None, None, :] + x[:, None, None]).reshape(len(x), -1)


@lru_cache
def _order() -> tuple[np.ndarray, np.ndarray]:
    """Place of each shift among those by rows and columns, and the other way round."""
    x, y = _moves().T
    place = (y + REACH) * (2 * REACH + 1) + x + REACH
    return place, np.argsort(place)


def _unmoved(own: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The first shift at which each block is found again without any difference, -1 for a block that is not.

    No other shift can cost less, nor an earlier one as little. Shifts are tried where the corner's eight bytes are the same, the
    nearest first, as long as each settles a block.
    """
    span, first = 2 * REACH + 1, ORIGIN - REACH
    head = np.ndarray((span, span, GRID, GRID), np.uint64, new, first * SIDE + first, (SIDE, 1, BLOCK * SIDE, BLOCK))
    corners = np.ascontiguousarray(own.reshape(GRID, BLOCK, GRID, BLOCK)[:, 0, :, :8]).view(np.uint64)[..., 0]
    alike = (head == corners).reshape(span * span, GRID * GRID)
    met = np.flatnonzero(alike.any(axis=1))
    place = np.full(GRID * GRID, -1)
    if not len(met):
        return place
    order, rank = _order()
    blocks = None
    for k in np.sort(rank[met]):
        same, (dx, dy) = alike[order[k]], _shifts()[k]
        if same.all() and (place < 0).all() and np.array_equal(own, new[ORIGIN + dy : ORIGIN + dy + BLOCK * GRID, ORIGIN + dx : ORIGIN + dx + BLOCK * GRID]):
            return np.full(GRID * GRID, k)
        if blocks is None:
            blocks = own.reshape(GRID, BLOCK, GRID, BLOCK).transpose(0, 2, 1, 3).reshape(GRID * GRID, BLOCK, BLOCK)
            seen = np.lib.stride_tricks.sliding_window_view(new, (BLOCK, BLOCK))
        open_ = np.flatnonzero(same & (place < 0))
        if not len(open_):
            continue
        y, x = np.divmod(_spots()[k, open_], SIDE)
        found = open_[(seen[y, x] == blocks[open_]).all(axis=(1, 2))]
        if not len(found):
            break  # alike at their corners only: the costs of all shifts tell
        place[found] = k
    return place


def motion_vector(before: bytes, after: bytes) -> tuple[float, float, float, float, float]:
    """(dx, dy, zoom, residual, agreement) between two frames.

    Every block looks for its place in the next frame by least absolute difference, the nearest of equals. dx and dy are
    the medians of the trusted blocks; zoom is the correlation of what is left of their vectors with their place;
    agreement, the share of textured blocks within a pixel of the median, 0 where too few have texture.
    """
    old, new = (np.frombuffer(f, np.uint8).reshape(SIDE, SIDE) for f in (before, after))
    own = old[ORIGIN : ORIGIN + BLOCK * GRID, ORIGIN : ORIGIN + BLOCK * GRID]
    shifts = _moves()
    place = np.zeros(GRID * GRID, int) if np.array_equal(old, new) else _unmoved(own, new)
    if (place < 0).any():
        place = np.where(place < 0, np.argmin(_costs(own, new), axis=0).ravel(), place)
    textured = _textured(own).ravel()
    enough = textured.sum() >= TEXTURED
    if (place == place[0]).all():  # all blocks agree
        dx, dy = shifts[place[0]]
        return float(dx), float(dy), 0.0, 0.0, 1.0 if enough else 0.0
    found = shifts[place].astype(float)
    trusted = textured if enough else np.ones_like(textured)
    middle = np.median(found[trusted], axis=0)
    left = found[trusted] - middle
    at = ORIGIN + np.arange(GRID) * BLOCK + (BLOCK - 1) / 2 - (SIDE - 1) / 2
    centre = np.stack([np.tile(at, GRID), np.repeat(at, GRID)], axis=1)[trusted]
    energy = (left**2).sum()
    zoom = float(np.clip((left * centre).sum() / np.sqrt(energy * (centre**2).sum()), -1, 1)) if energy > 0 else 0.0
    near = (np.abs(found - middle) <= WITHIN).all(axis=1)
    return float(middle[0]), float(middle[1]), zoom, float(np.sqrt(energy / len(left))), float((near & textured).sum() / textured.sum()) if enough else 0.0


def exposure(gray: np.ndarray) -> tuple[int | None, str, float]:
    """(cell, status, severity) of the worst of 3 x 3 cells, the first of equals; ``unknown`` for a picture too small to have any."""
    height, width = gray.shape
    worst: tuple[int | None, str, float] = (None, "unknown", 0.0)
    for cell in range(9):
        y, x = divmod(cell, 3)
        part = gray[y * height // 3 : (y + 1) * height // 3, x * width // 3 : (x + 1) * width // 3]
        if not part.size:
            continue
        mean, low, high = int(part.sum()) / part.size, np.count_nonzero(part <= BLACK) / part.size, np.count_nonzero(part >= WHITE) / part.size
        if low >= CLIPPED and mean <= DARK:
            told = (cell, "under", low * (1 - mean / 255))
        elif high >= CLIPPED and mean >= LIGHT:
            told = (cell, "over", high * mean / 255)
        else:
            told = (cell, "normal", 0.0)
        if worst[0] is None or told[2] > worst[2]:
            worst = told
    return worst


@lru_cache
def _normals() -> tuple[np.ndarray, np.ndarray]:
    turns = [np.radians(degree) for degree in range(180)]
    return np.array([np.cos(t) for t in turns]), np.array([np.sin(t) for t in turns])


def tilt(gray: np.ndarray) -> float | None:
    """Degrees, 0 to 45, between the longest line of edges and the nearest axis; None without a long one.

    Edges vote for the lines through them: a line is an angle of its normal and a distance.
    """
    height, width = gray.shape
    if min(height, width) < 8:
        return None
    g = gray.astype(np.float32)  # squares of gradients are whole numbers to 2,080,800, which four bytes hold
    smooth_y, smooth_x = g[:-2] + 2 * g[1:-1] + g[2:], g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]
    y, x = np.nonzero((smooth_y[:, 2:] - smooth_y[:, :-2]) ** 2 + (smooth_x[2:] - smooth_x[:-2]) ** 2 >= EDGE**2)
    if len(x) < EDGES:
        return None
    reach, lines = height + width, 2 * (height + width) + 1
    best = np.zeros(180, np.int64)
    some = min(180, max(1, 16_000 // len(x)))  # angles at a time, as many as stay near
    # a distance, made positive and moved to its angle's own row, is a product of three numbers; what follows the point is cut off
    spots = np.stack([x + 1.0, y + 1.0, np.ones(len(x))])
    turns = np.column_stack([*_normals(), np.arange(180) % some * lines + reach + 0.5])
    line, place = np.empty((some, len(x))), np.empty((some, len(x)), np.int64)
    for at in range(0, 180, some):
        n = min(some, 180 - at)
        np.matmul(turns[at : at + n], spots, out=line[:n])
        place[:n] = line[:n]
        best[at : at + n] = np.bincount(place[:n].ravel(), minlength=n * lines).reshape(n, lines).max(axis=1)
    angle = int(best.argmax())
    if best[angle] < int(max(max(width, height) * LINE, VOTES)):
        return None
    return float(min(angle % 90, 90 - angle % 90))


@lru_cache(maxsize=64)
def _weights(old: int, new: int) -> np.ndarray:
    """Rows of a triangle filter that takes old pixels to new ones."""
    ratio = old / new
    width = max(1.0, ratio)
    centre = (np.arange(new)[:, None] + 0.5) * ratio
    weight = np.maximum(0, 1 - np.abs(np.arange(old)[None, :] + 0.5 - centre) / width)
    return weight / weight.sum(axis=1, keepdims=True)


def resized(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    return _weights(gray.shape[0], height) @ gray @ _weights(gray.shape[1], width).T


@lru_cache
def _blur() -> np.ndarray:
    apart = np.arange(SALIENT)[:, None] - np.arange(SALIENT)[None, :]
    weight = np.exp(-0.5 * (apart / BLUR) ** 2) * (np.abs(apart) <= 4 * BLUR)
    return weight / weight.sum(axis=1, keepdims=True)


@lru_cache
def _ring() -> tuple[np.ndarray, np.ndarray]:
    """Places of a spectrum and of one more on each side, which are those of the other side."""
    place = np.arange(-1, SALIENT + 1) % SALIENT
    return np.ix_(place, place)


def salient_sharpness(gray: np.ndarray) -> float | None:
    """Variance of the Laplacian where the picture stands out, weighted by how much; None for a flat picture.

    What stands out is what the spectrum has beyond its own local mean (the spectral residual), at the picture's phase.
    """
    height, width = gray.shape
    g = gray.astype(float)
    # n squared times the variance, in whole numbers
    if min(height, width) < 3 or g.size * int(np.vdot(g, g)) - int(g.sum()) ** 2 < g.size**2:
        return None
    spectrum = np.fft.fft2(resized(g / 255, SALIENT, SALIENT))
    power = np.abs(spectrum)
    size = np.log(np.maximum(power, 1e-8))
    ring = size[_ring()]
    around = sum(ring[1 - y : 1 - y + SALIENT, 1 - x : 1 - x + SALIENT] for y in (-1, 0, 1) for x in (-1, 0, 1)) / 9
    # the phase as a number on the unit circle; nothing has that of its sign
    none = power == 0
    phase = np.where(none, np.copysign(1.0, spectrum.real), spectrum / np.where(none, 1.0, power))
    residual = np.exp(size - around) * phase
    residual[0, 0] = 0
    shown = np.abs(np.fft.ifft2(residual)) ** 2
    if shown.max() <= 1e-28:
        return None
    weight = resized(_blur() @ (shown / shown.max()) @ _blur().T, height, width)
    keep = weight[1:-1, 1:-1] > 2 * weight.mean()
    inner = weight[1:-1, 1:-1][keep]
    total = inner.sum()
    if total <= 1e-12:
        return None
    small = gray.astype(np.int16)
    edges = (small[1:-1, :-2] + small[1:-1, 2:] + small[:-2, 1:-1] + small[2:, 1:-1] - 4 * small[1:-1, 1:-1])[keep].astype(float)
    mean = (inner * edges).sum() / total
    return float(max(0.0, (inner * edges**2).sum() / total - mean**2))
