"""NumPy kernels of pairwise registration, each for one tile or one pair of tiles; Spark deals them out by key."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable blur of the last two axes, reaching int(4 sigma + 0.5) pixels, edges repeated."""
    reach = int(4 * sigma + 0.5)
    if not reach:
        return image.astype(float)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()
    out = image.astype(float)
    for axis in (-1, -2):
        pad = [(0, 0)] * out.ndim
        pad[axis] = (reach, reach)
        windows = np.lib.stride_tricks.sliding_window_view(np.pad(out, pad, "edge"), 2 * reach + 1, axis)
        out = windows @ weights
    return out


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centers aligned."""
    def places(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, size - 1), at - low

    a, b, t = places(height, image.shape[0])
    rows = image[a] * (1 - t)[:, None] + image[b] * t[:, None]
    a, b, t = places(width, image.shape[1])
    return rows[:, a] * (1 - t) + rows[:, b] * t


def phase_correlation(fixed: np.ndarray, moving: np.ndarray) -> tuple[float, float, float]:
    """(dy, dx, quality): the shift that takes moving onto fixed, to a fraction of a pixel, and their correlation there."""
    f, g = np.fft.fft2(fixed - fixed.mean()), np.fft.fft2(moving - moving.mean())
    cross = f * np.conj(g)
    peak = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
    at = np.unravel_index(int(np.argmax(peak)), peak.shape)
    shift = []
    for axis, n in enumerate(peak.shape):
        line = [peak[tuple((at[k] + (d if k == axis else 0)) % peak.shape[k] for k in range(2))] for d in (-1, 0, 1)]
        curve = line[0] - 2 * line[1] + line[2]
        part = 0.5 * (line[0] - line[2]) / curve if curve < -1e-12 and n > 2 else 0.0
        whole = at[axis] if at[axis] <= n // 2 else at[axis] - n
        shift.append(whole + (part if abs(part) <= 0.5 and max(line[0], line[2]) > 0.25 * line[1] else 0.0))
    rolled = np.roll(moving, (round(shift[0]), round(shift[1])), (0, 1))
    spread = fixed.std() * rolled.std()
    quality = float(((fixed - fixed.mean()) * (rolled - rolled.mean())).mean() / spread) if spread > 0 else 0.0
    return float(shift[0]), float(shift[1]), quality


def _parted(fixed: np.ndarray, moving: np.ndarray, dy: int, dx: int) -> tuple[np.ndarray, np.ndarray]:
    """What both images show where moving is shifted by whole pixels."""
    h, w = fixed.shape
    return fixed[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)], moving[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]


def shift_by_peaks(fixed: np.ndarray, moving: np.ndarray, peaks: int = 5, subpixel: bool = True, least: float = 0.2) -> tuple[float, float, float]:
    """(dy, dx, quality): of the highest peaks of the phase correlation, each taken forward and around, the shift under which both correlate best.

    Only shifts that leave at least a part of the images in common count. Quality is that correlation, not under 0.
    """
    f, g = np.fft.fft2(fixed - fixed.mean()), np.fft.fft2(moving - moving.mean())
    cross = f * np.conj(g)
    peak = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
    (h, w), best = fixed.shape, (-np.inf, 0, 0)
    for at in np.argsort(-peak, axis=None, kind="stable")[:peaks]:
        y, x = np.unravel_index(at, peak.shape)
        for dy in {int(y), int(y) - h}:
            for dx in {int(x), int(x) - w}:
                a, b = _parted(fixed, moving, dy, dx)
                if a.size < max(4, least * fixed.size):
                    continue
                spread = a.std() * b.std()
                quality = float(((a - a.mean()) * (b - b.mean())).mean() / spread) if spread > 0 else 0.0
                best = max(best, (quality, -abs(dy) - abs(dx), (dy, dx)), key=lambda t: t[:2]) if best[0] > -np.inf else (quality, -abs(dy) - abs(dx), (dy, dx))
    if best[0] <= 0:
        return 0.0, 0.0, 0.0
    quality, _, (dy, dx) = best
    out = []
    for axis, (d, n) in enumerate(((dy, h), (dx, w))):
        line = [peak[(dy + (k if axis == 0 else 0)) % h, (dx + (k if axis == 1 else 0)) % w] for k in (-1, 0, 1)]
        curve = line[0] - 2 * line[1] + line[2]
        part = 0.5 * (line[0] - line[2]) / curve if subpixel and curve < -1e-12 and n > 2 and max(line[0], line[2]) > 0.25 * line[1] else 0.0
        out.append(d + (part if abs(part) <= 0.5 else 0.0))
    return float(out[0]), float(out[1]), quality


def otsu(values: np.ndarray, bins: int = 256) -> float:
    """The threshold with the largest variance between the classes on its sides."""
    counts, edges = np.histogram(values, bins)
    middle, weight = (edges[:-1] + edges[1:]) / 2, counts / counts.sum()
    low, mean = np.cumsum(weight), np.cumsum(weight * middle)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num((mean[-1] * low - mean) ** 2 / (low * (1 - low)))
    return float(middle[int(np.argmax(between))])


def area_points(image: np.ndarray) -> np.ndarray:
    """Centers (y, x) of the regions above Otsu's threshold whose area is over the mean."""
    mask = image > otsu(image)
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:  # least label of four neighbours until nothing changes
        padded = np.pad(label, 1)
        near = np.stack([padded[1:-1, 1:-1], padded[:-2, 1:-1], padded[2:, 1:-1], padded[1:-1, :-2], padded[1:-1, 2:]])
        new = np.where(mask, np.where(near > 0, near, label.size + 1).min(axis=0), 0)
        if (new == label).all():
            break
        label = new
    ids, area = np.unique(label[mask], return_counts=True)
    kept = ids[area >= area.mean()] if len(ids) else ids
    return np.array([np.argwhere(label == i).mean(axis=0) for i in kept]).reshape(-1, 2)


def points_by_thresholds(image: np.ndarray) -> np.ndarray:
    """Centers (y, x) of bright regions of an image from 0 to 255: above Otsu's threshold or, where that gives at most one region, above the first of 0, 5, 10 and on that gives more; regions over the mean area."""
    for level in (otsu(image), *range(0, 256, 5)):
        found = _regions(image > level)
        if len(found) > 1:
            break
    mean = max(np.mean([len(r) for r in found]), 1) if found else 0
    return np.array([r.mean(axis=0) for r in sorted(found, key=len, reverse=True) if len(r) > mean or len(found) == 1 or all(len(q) == len(r) for q in found)]).reshape(-1, image.ndim)


def _regions(mask: np.ndarray) -> list[np.ndarray]:
    """The places of each part of a mask that is connected along its axes."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        padded = np.pad(label, 1)
        core = tuple(slice(1, -1) for _ in label.shape)
        near = [padded[core]]
        for axis in range(label.ndim):
            for side in (slice(0, -2), slice(2, None)):
                at = list(core)
                at[axis] = side
                near.append(padded[tuple(at)])
        stack = np.stack(near)
        new = np.where(mask, np.where(stack > 0, stack, label.size + 1).min(axis=0), 0)
        if (new == label).all():
            break
        label = new
    places, ids = np.argwhere(mask), label[mask]
    order = np.argsort(ids, kind="stable")
    return np.split(places[order], np.flatnonzero(np.diff(ids[order])) + 1) if len(ids) else []


def volume_points(volume: np.ndarray, least: float = 1.0, most: float = 30.0, sizes: int = 10, threshold: float = 0.1) -> np.ndarray:
    """Centers (z, y, x) of bright blobs: maxima over place and size of the scaled Laplacian of Gaussians, above a threshold.

    Of blobs that overlap by more than half the larger one stays. Sizes that the volume is too small for are left out.
    """
    sigmas = [s for s in np.linspace(least, most, sizes) if s <= max(volume.shape)]
    cube = np.stack([_laplacian(volume, s) * s * s for s in sigmas], axis=-1)
    padded = np.pad(cube, 1, constant_values=-np.inf)
    peak = cube > threshold
    for step in np.ndindex(*(3,) * cube.ndim):
        peak &= cube >= padded[tuple(slice(k, k + n) for k, n in zip(step, cube.shape, strict=True))]
    found = [(*at[:-1], sigmas[at[-1]], cube[tuple(at)]) for at in np.argwhere(peak)]
    kept: list[tuple] = []
    for blob in sorted(found, key=lambda b: (-b[-2], -b[-1])):
        radius = blob[-2] * np.sqrt(volume.ndim)
        if all(np.linalg.norm(np.subtract(blob[:-2], other[:-2])) > max(radius, other[-2] * np.sqrt(volume.ndim)) * 0.5 for other in kept):
            kept.append(blob)
    return np.array([b[:-2] for b in kept], float).reshape(-1, volume.ndim)


def _laplacian(volume: np.ndarray, sigma: float) -> np.ndarray:
    """Minus the Laplacian of a Gaussian, one axis after the other, edges repeated."""
    reach = int(4 * sigma + 0.5)
    at = np.arange(-reach, reach + 1)
    smooth = np.exp(-0.5 * (at / sigma) ** 2)
    smooth /= smooth.sum()
    bend = smooth * (at**2 / sigma**4 - 1 / sigma**2)

    def along(data: np.ndarray, axis: int, weights: np.ndarray) -> np.ndarray:
        pad = [(0, 0)] * data.ndim
        pad[axis] = (reach, reach)
        return np.lib.stride_tricks.sliding_window_view(np.pad(data, pad, "edge"), 2 * reach + 1, axis) @ weights

    total = np.zeros(volume.shape)
    for bent in range(volume.ndim):
        part = volume.astype(float)
        for axis in range(volume.ndim):
            part = along(part, axis, bend if axis == bent else smooth)
        total -= part
    return total


def corners(image: np.ndarray, most: int = 500, size: int = 9, sigma: float = 1.5, blur: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Harris corners (y, x) by strength and normalised patches around them as descriptors."""
    dy, dx = np.gradient(gaussian(image, blur))
    a, b, c = (gaussian(p, sigma) for p in (dx * dx, dy * dy, dx * dy))
    strength = a * b - c * c - 0.05 * (a + b) ** 2
    r = size // 2
    padded = np.pad(strength, 1, constant_values=-np.inf)
    peak = strength >= np.lib.stride_tricks.sliding_window_view(padded, (3, 3)).max(axis=(2, 3))
    peak[:r], peak[-r:], peak[:, :r], peak[:, -r:] = False, False, False, False
    at = np.argwhere(peak & (strength > 1e-6 * max(strength.max(), 1e-12)))
    at = at[np.argsort(-strength[tuple(at.T)], kind="stable")][:most]
    patches = np.array([image[y - r : y + r + 1, x - r : x + r + 1].ravel() for y, x in at], float).reshape(len(at), size * size)
    patches -= patches.mean(axis=1, keepdims=True)
    return at.astype(float), patches / np.maximum(np.linalg.norm(patches, axis=1, keepdims=True), 1e-12)


def ransac(fixed: np.ndarray, moving: np.ndarray, threshold: float, trials: int = 100, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The similarity (3x3, rows y, x) from moving to fixed points with the most inliers, refitted on them."""
    r, best = np.random.default_rng(seed), np.zeros(len(fixed), bool)
    for _ in range(trials if len(fixed) >= 2 else 0):
        pick = r.choice(len(fixed), 2, replace=False)
        m = similarity_fit(fixed[pick], moving[pick])
        near = np.linalg.norm(moving @ m[:2, :2].T + m[:2, 2] - fixed, axis=1) <= threshold
        if near.sum() > best.sum():
            best = near
    return (similarity_fit(fixed[best], moving[best]) if best.sum() >= 2 else np.eye(3)), best


def ransac_shift(fixed: np.ndarray, moving: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The shift (3x3) from moving to fixed points that most of them agree with, each one's shift tried, refitted on these."""
    shifts = fixed - moving
    near = np.linalg.norm(shifts[:, None] - shifts[None], axis=2) <= threshold
    best = near[int(np.argmax(near.sum(axis=1)))] if len(shifts) else np.zeros(0, bool)
    out = np.eye(3)
    if best.any():
        out[:2, 2] = shifts[best].mean(axis=0)
    return out, best


def similarity_fit(fixed: np.ndarray, moving: np.ndarray, scaled: bool = True) -> np.ndarray:
    """Least squares rotation, scale and shift (Umeyama)."""
    mf, mm = fixed.mean(axis=0), moving.mean(axis=0)
    u, s, vt = np.linalg.svd((fixed - mf).T @ (moving - mm))
    flip = np.diag([1.0] * (len(mf) - 1) + [np.sign(np.linalg.det(u @ vt)) or 1.0])
    rotation, spread = u @ flip @ vt, ((moving - mm) ** 2).sum()
    size = float((s * np.diag(flip)).sum() / spread) if scaled and spread > 0 else 1.0
    out = np.eye(len(mf) + 1)
    out[:-1, :-1], out[:-1, -1] = size * rotation, mf - size * rotation @ mm
    return out


#: Pairs of points whose distances coherent point drift holds at a time; more pairs in a plane are summed by grids or near pairs.
CPD_CELLS = 1 << 19
#: Steps of the grid in a standard deviation, and its nodes on each axis to which a point is dealt: right to 2e-12 of the weights.
GAUSS_STEPS, GAUSS_NODES = 6, 16
#: Standard deviations beyond which a point counts as out of reach (2e-22), nodes of the largest grid, the most products of polynomials.
GAUSS_REACH, GAUSS_GRID, GAUSS_TERMS = 10, 1 << 24, 10_000
#: Points that are dealt at a time.
GAUSS_ROWS = 1 << 14


def gauss_sums(at: np.ndarray, weights: np.ndarray, to: np.ndarray, spread: float) -> np.ndarray:
    """For each point ``to`` the sums of the weights (rows of points ``at``, any columns) times exp(-distance**2 / (2 * spread)), in a plane.

    All points count, and only beyond ten standard deviations none. A wide bell is a sum of products of Chebyshev's polynomials. For
    others, few pairs of points within reach are summed one by one; else points are dealt to a grid's nodes, blurred there and read back.
    The time of the first and last way grows with points and not with pairs.
    """
    sigma, low, high = np.sqrt(spread), np.minimum(at.min(axis=0), to.min(axis=0)), np.maximum(at.max(axis=0), to.max(axis=0))
    terms = 14 + np.ceil(3.6 * (high - low) / sigma)
    if np.prod(terms) <= GAUSS_TERMS:
        return _by_polynomials(at, weights, to, spread, low, high, terms.astype(int))
    reach = max(GAUSS_REACH * sigma, 1e-8 * float((high - low).max()))
    cells, own = (((x - low) / reach).astype(np.int64) + 1 for x in (at, to))
    wide = int(max(cells[:, 1].max(), own[:, 1].max())) + 2
    keys = cells[:, 0] * wide + cells[:, 1]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    middle = own[:, 0, None] * wide + own[:, 1, None] + np.array([-wide, 0, wide])  # of three runs of cells around each point
    begin, end = np.searchsorted(keys, middle - 1), np.searchsorted(keys, middle + 1, "right")
    pairs, step = int((end - begin).sum()), sigma / GAUSS_STEPS
    if np.prod((high - low) / step + 100) <= GAUSS_GRID and pairs > 100 * (len(at) + len(to)) + 6 * np.prod((high - low) / step + 100):
        return _by_grid(at, weights, to, spread, low - GAUSS_NODES // 2 * step, [_smooth(int(x / step) + 2 * GAUSS_NODES + GAUSS_STEPS * GAUSS_REACH) for x in high - low])
    at, weights = at[order], weights[order]
    out = np.zeros((len(to), weights.shape[1]))
    total = np.append(0, np.cumsum((end - begin).sum(axis=1)))
    k = 0
    while k < len(to):
        last = max(k + 1, int(np.searchsorted(total, total[k] + CPD_CELLS, "right")) - 1)
        first, many = begin[k:last].ravel(), (end - begin)[k:last].ravel()
        source = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
        target = np.repeat(np.arange(last - k).repeat(3), many)
        near = np.exp(sum((at[source, a] - to[k:last][target, a]) ** 2 for a in (0, 1)) * (-0.5 / spread))
        for c in range(weights.shape[1]):
            out[k:last, c] = np.bincount(target, near * weights[source, c], last - k)
        k = last
    return out


def _by_polynomials(at: np.ndarray, weights: np.ndarray, to: np.ndarray, spread: float, low: np.ndarray, high: np.ndarray, terms: np.ndarray) -> np.ndarray:
    half = np.maximum(high - low, 1e-300) / 2
    parts = []  # of each product of two polynomials, by axis
    for h, n in zip(half, terms, strict=True):
        turns = np.pi * (np.arange(n) + 0.5) / n
        whole = 2 / n * np.cos(np.arange(n)[:, None] * turns)
        whole[0] /= 2
        parts.append(whole @ np.exp(np.subtract.outer(np.cos(turns), np.cos(turns)) ** 2 * (-0.5 / spread * h**2)) @ whole.T)

    def polynomials(points: np.ndarray) -> list[np.ndarray]:
        out = [np.ones((n, len(points))) for n in terms]
        for a, t in enumerate(out):
            t[1] = (points[:, a] - low[a]) / half[a] - 1
            for k in range(2, len(t)):
                t[k] = 2 * t[1] * t[k - 1] - t[k - 2]
        return out

    sums = np.zeros((weights.shape[1], *terms))
    for k in range(0, len(at), GAUSS_ROWS):
        x, y = polynomials(at[k : k + GAUSS_ROWS])
        for c, s in enumerate(sums):
            s += x * weights[k : k + GAUSS_ROWS, c] @ y.T
    sums = parts[0] @ sums @ parts[1].T
    out = np.zeros((len(to), len(sums)))
    for k in range(0, len(to), GAUSS_ROWS):
        x, y = polynomials(to[k : k + GAUSS_ROWS])
        for c, s in enumerate(sums):
            out[k : k + GAUSS_ROWS, c] = (s.T @ x * y).sum(axis=0)
    return out


def _smooth(n: int) -> int:
    """The next number that has only 2, 3 and 5 as factors."""
    while True:
        rest = n
        for f in (2, 3, 5):
            while rest % f == 0:
                rest //= f
        if rest == 1:
            return n
        n += 1


def _by_grid(at: np.ndarray, weights: np.ndarray, to: np.ndarray, spread: float, low: np.ndarray, sizes: list[int]) -> np.ndarray:
    p, rows, step = GAUSS_NODES, GAUSS_ROWS, np.sqrt(spread) / GAUSS_STEPS
    nodes = np.arange(p) - (p // 2 - 1)
    below = np.array([np.prod([float(a - b) for b in nodes if a != b]) for a in nodes])

    def dealt(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes around points, p * p of each, and their parts."""
        places, parts = [], []
        for a in (0, 1):
            x = (points[:, a] - low[a]) / step
            k = np.floor(x).astype(np.int64)
            gap = (x - k)[:, None] - nodes
            one = np.ones((len(x), 1))
            before, after = np.cumprod(np.hstack((one, gap[:, :-1])), axis=1), np.cumprod(np.hstack((one, gap[:, :0:-1])), axis=1)[:, ::-1]
            places.append(k[:, None] + nodes)
            parts.append(before * after / below)
        return (places[0][:, :, None] * sizes[1] + places[1][:, None]).reshape(len(points), -1), (parts[0][:, :, None] * parts[1][:, None]).reshape(len(points), -1)

    grids = np.zeros((weights.shape[1], sizes[0] * sizes[1]))
    for k in range(0, len(at), rows):
        place, part = dealt(at[k : k + rows])
        for c, grid in enumerate(grids):
            grid += np.bincount(place.ravel(), (part * weights[k : k + rows, c, None]).ravel(), len(grid))
    waves = []
    for n in sizes:
        x = np.arange(n)
        waves.append(np.fft.fft(np.exp(-0.5 / spread * (np.minimum(x, n - x) * step) ** 2)).real)
    blur = waves[0][:, None] * waves[1][: sizes[1] // 2 + 1]
    for grid in grids:
        grid[:] = np.fft.irfft2(np.fft.rfft2(grid.reshape(sizes)) * blur, sizes).ravel()
    out = np.zeros((len(to), len(grids)))
    for k in range(0, len(to), rows):
        place, part = dealt(to[k : k + rows])
        for c, grid in enumerate(grids):
            out[k : k + rows, c] = np.einsum("ij,ij->i", grid[place], part)
    return out


def cpd(fixed: np.ndarray, moving: np.ndarray, iterations: int = 1000, noise: float = 0.1) -> np.ndarray | None:
    """Rigid coherent point drift with scale; None with fewer than two points on a side.

    Steps come in pairs, whose change is then carried on as far as it shrinks evenly (squared extrapolation), since for many
    points single steps become small long before the end; not by more than a fourth of the matrix, and not to where the points
    are less likely. It ends where nothing moves or the points lie on each other. Many points in a plane are summed by ``gauss_sums``,
    all of them in every step.
    """
    if len(fixed) < 2 or len(moving) < 2:
        return None
    m, n, d = len(moving), len(fixed), fixed.shape[1]
    at, to = moving.mean(axis=0), fixed.mean(axis=0)
    moving, fixed = moving - at, fixed - to
    first = ((fixed**2).sum() / n + (moving**2).sum() / m) / d
    block = max(1, CPD_CELLS // m)

    def step(state: np.ndarray) -> tuple[np.ndarray, float]:
        """The next state, and how unlikely the fixed points are at this one."""
        t, spread = state[:-1].reshape(d, d + 1), np.exp(state[-1])
        moved = moving @ t[:, :-1].T + t[:, -1]
        w, drawn, square, unlikely = np.zeros(m), np.zeros((m, d)), 0.0, n * d / 2 * state[-1]
        noisy = (2 * np.pi * spread) ** (d / 2) * noise / (1 - noise) * m / n + 1e-300
        if d == 2 and m * n > 4 * CPD_CELLS:
            near = np.maximum(gauss_sums(moved, np.ones((m, 1)), fixed, spread)[:, 0], 0)
            reached = near + noisy
            unlikely -= np.log(reached).sum()
            sums = gauss_sums(fixed, np.column_stack((np.ones(n), fixed)) / reached[:, None], moved, spread)
            w, drawn, square = sums[:, 0], sums[:, 1:], near / reached @ (fixed**2).sum(axis=1)
        else:
            for k in range(0, n, block):
                part = fixed[k : k + block]
                p = sum(np.subtract.outer(moved[:, a], part[:, a]) ** 2 for a in range(d))
                p *= -0.5 / spread
                np.exp(p, out=p)
                reached = p.sum(axis=0) + noisy
                p /= reached
                unlikely -= np.log(reached).sum()
                w += p.sum(axis=1)
                drawn += p @ part
                square += p.sum(axis=0) @ (part**2).sum(axis=1)
        total = w.sum()
        if not total > 0:  # an extrapolated state that brings no points within reach
            return np.full_like(state, np.nan), float(unlikely)
        mf, mm = drawn.sum(axis=0) / total, w @ moving / total
        cross = drawn.T @ moving - total * np.outer(mf, mm)
        u, _, vt = np.linalg.svd(cross)
        rotation = u @ np.diag([1.0] * (d - 1) + [np.linalg.det(u @ vt)]) @ vt
        size = np.trace(cross.T @ rotation) / (w @ ((moving - mm) ** 2).sum(axis=1))
        t = np.column_stack((size * rotation, mf - size * rotation @ mm))
        moved = moving @ t[:, :-1].T + t[:, -1]
        left = (square - 2 * (drawn * moved).sum() + w @ (moved**2).sum(axis=1)) / (total * d)
        return np.append(t, np.log(max(left, 1e-300))), float(unlikely)

    state = np.append(np.eye(d, d + 1), np.log(first or 1.0))
    least = np.log(max(1e-9, 1e-13 * first))
    sure, known = state, np.inf  # where steps alone have led, and what the next state must not be worse than
    for _ in range(iterations if first else 0):
        once, unlikely = step(state)
        if unlikely > known or not np.isfinite(once).all():
            state = sure
            once, _ = step(state)
        if once[-1] < least:
            state = once
            break
        twice, known = step(once)
        change, bend = once - state, twice - 2 * once + state
        if twice[-1] < least or np.abs(twice - once).max() < 1e-9:
            state = twice
            break
        far = np.clip(np.linalg.norm(change) / max(np.linalg.norm(bend), 1e-300), 1, 32)
        more = 2 * far * change + far**2 * bend - (twice - state)
        turn, size = (np.linalg.norm(x[:-1].reshape(d, d + 1)[:, :-1]) for x in (more, twice))
        sure, state = twice, twice + more * min(1.0, size / 4 / max(turn, 1e-300))
        state[-1] = np.clip(state[-1], twice[-1] - 0.5, twice[-1])
    t = np.eye(d + 1)
    t[:-1, :-1] = state[:-1].reshape(d, d + 1)[:, :-1]
    t[:-1, -1] = state[:-1].reshape(d, d + 1)[:, -1] + to - t[:-1, :-1] @ at
    return t


def oriented_box(points: np.ndarray) -> np.ndarray:
    """Four corners of the least-area rectangle around 2D points; candidate sides are the hull's edges."""
    pts = np.unique(points, axis=0)
    hull: list[np.ndarray] = []
    for order in (pts, pts[::-1]):  # monotone chain
        part: list[np.ndarray] = []
        for p in order:
            while len(part) > 1 and (part[-1][0] - part[-2][0]) * (p[1] - part[-2][1]) - (part[-1][1] - part[-2][1]) * (p[0] - part[-2][0]) <= 0:
                part.pop()
            part.append(p)
        hull += part[:-1]
    h = np.array(hull if len(hull) else pts)
    best = (np.inf, None)
    for edge in np.roll(h, -1, axis=0) - h if len(h) > 1 else np.array([[1.0, 0.0]]):
        c, s = edge / (np.linalg.norm(edge) or 1.0)
        axes = np.array([[c, s], [-s, c]])
        low, high = (h @ axes.T).min(axis=0), (h @ axes.T).max(axis=0)
        area = float(np.prod(high - low))
        if area < best[0] - 1e-12:
            best = (area, np.array([[low[0], low[1]], [high[0], low[1]], [high[0], high[1]], [low[0], high[1]]]) @ axes)
    return best[1]


def oriented_box_3d(points: np.ndarray) -> np.ndarray:
    """Eight corners of a least box around 3D points; candidate axes are those of planes through three points, and of the points' spread.

    Flat clouds give a box without height. The corners go around the lower face, then the upper one.
    """
    pts = np.unique(points, axis=0)
    mean = pts.mean(axis=0)
    spread = np.linalg.svd(pts - mean, full_matrices=True)[2]
    bases = [spread]
    for i, j, k in combinations(range(len(pts)), 3) if len(pts) <= 40 else ():
        a, b = pts[j] - pts[i], pts[k] - pts[i]
        normal = np.cross(a, b)
        if np.linalg.norm(normal) < 1e-9 * (np.linalg.norm(a) * np.linalg.norm(b) + 1e-300):
            continue
        normal /= np.linalg.norm(normal)
        for edge in (a, b, pts[k] - pts[j]):
            side = edge / np.linalg.norm(edge)
            bases.append(np.array([side, np.cross(normal, side), normal]))
    best = (np.inf, None)
    for axes in bases:
        low, high = (pts @ axes.T).min(axis=0), (pts @ axes.T).max(axis=0)
        sides = np.sort(high - low)
        key = (float(np.prod(high - low)), float(sides[1:].prod()))
        if best[1] is None or key < best[0]:
            ring = [(0, 0), (1, 0), (1, 1), (0, 1)]
            corner = np.array([[(low, high)[x][0], (low, high)[y][1], (low, high)[z][2]] for z in (0, 1) for x, y in ring])
            best = (key, corner @ axes)
    return best[1]


def box_edges(corner: np.ndarray) -> np.ndarray:
    """A path of 17 places along all twelve edges of a box."""
    return corner[[0, 1, 2, 3, 0, 4, 5, 6, 7, 4, 5, 1, 2, 6, 7, 3, 0]]


def turned(image: np.ndarray, degrees: float, dy: float, dx: float) -> np.ndarray:
    """An image turned around its center and shifted, bilinear; NaN beyond it."""
    h, w = image.shape
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    y, x = np.mgrid[0:h, 0:w] - np.array([(h - 1) / 2 + dy, (w - 1) / 2 + dx])[:, None, None]
    u, v = c * x + s * y + (w - 1) / 2, c * y - s * x + (h - 1) / 2
    inside = (u >= 0) & (u <= w - 1) & (v >= 0) & (v <= h - 1)
    v, u = np.clip(v, 0, h - 1), np.clip(u, 0, w - 1)
    a, b = np.minimum(v.astype(int), max(h - 2, 0)), np.minimum(u.astype(int), max(w - 2, 0))
    p, q = v - a, u - b
    a1, b1 = np.minimum(a + 1, h - 1), np.minimum(b + 1, w - 1)
    out = image[a, b] * (1 - p) * (1 - q) + image[a, b1] * (1 - p) * q + image[a1, b] * p * (1 - q) + image[a1, b1] * p * q
    return np.where(inside, out, np.nan)


def intensity(fixed: np.ndarray, moving: np.ndarray, levels: int = 3, steps: int = 40) -> tuple[float, float, float, float]:
    """(degrees, dy, dx, quality): the turn and shift that take moving onto fixed with the best correlation, from coarse to fine.

    At each level a blurred pair is climbed along each parameter in steps that halve. Stands in for rigid
    registration by intensity of other tools, which it approximates.
    """
    def quality(a: np.ndarray, b: np.ndarray) -> float:
        both = ~np.isnan(b)
        if both.sum() < 0.25 * b.size:
            return -1.0
        p, q = a[both] - a[both].mean(), b[both] - b[both].mean()
        spread = np.sqrt((p * p).sum() * (q * q).sum())
        return float((p * q).sum() / spread) if spread > 0 else -1.0

    at, best = np.zeros(3), -1.0
    dy, dx, _ = shift_by_peaks(fixed, moving)
    for level in range(levels - 1, -1, -1):
        a, b = (gaussian(i, 0.6 * 2**level) for i in (fixed, moving))
        if level == levels - 1:
            at = max((np.array([g, y, x]) for g in (-8.0, -4.0, 0.0, 4.0, 8.0) for y, x in ((0.0, 0.0), (dy, dx))), key=lambda p: quality(a, turned(b, *p)))
        step, best = np.array([2.0, 1.0, 1.0]) * 2**level, quality(a, turned(b, *at))
        for _ in range(steps):
            moved = False
            for k in range(3):
                for sign in (1, -1):
                    new = at.copy()
                    new[k] += sign * step[k]
                    if (got := quality(a, turned(b, *new))) > best + 1e-9:
                        at, best, moved = new, got, True
            if not moved:
                step /= 2
                if step[1] < 0.02:
                    break
    return float(at[0]), float(at[1]), float(at[2]), best


def frc(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fourier ring correlation by ring."""
    f, g = np.fft.fftshift(np.fft.fft2(a)), np.fft.fftshift(np.fft.fft2(b))
    y, x = np.indices(a.shape)
    ring = np.hypot(y - a.shape[0] // 2, x - a.shape[1] // 2).astype(int).ravel()
    n = min(a.shape) // 2

    def total(v: np.ndarray) -> np.ndarray:
        return np.bincount(ring, v.ravel(), ring.max() + 1)[:n]

    return total((f * np.conj(g)).real) / np.maximum(np.sqrt(total(np.abs(f) ** 2) * total(np.abs(g) ** 2)), 1e-12)


Kernel = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float]]


def by_phase(fixed: np.ndarray, moving: np.ndarray) -> tuple[np.ndarray, float]:
    dy, dx, quality = phase_correlation(fixed, moving)
    return np.array([[1, 0, dx], [0, 1, dy], [0, 0, 1.0]]), quality


def by_peaks(fixed: np.ndarray, moving: np.ndarray, subpixel: bool = True) -> tuple[np.ndarray, float]:
    dy, dx, quality = shift_by_peaks(fixed, moving, subpixel=subpixel)
    return np.array([[1, 0, dx], [0, 1, dy], [0, 0, 1.0]]), quality


def fixed_transform(fixed: np.ndarray, moving: np.ndarray) -> tuple[np.ndarray, float]:
    """A turn by 38 degrees and a shift, whatever the images: stands in for a method in tests of what uses one."""
    c, s = np.cos(np.radians(38)), np.sin(np.radians(38))
    return np.array([[c, -s, 300], [s, c, 25], [0, 0, 1.0]]), 1.0


def by_features(fixed: np.ndarray, moving: np.ndarray, kind: str = "similarity", sigma: float = 1.5, blur: float = 1.0) -> tuple[np.ndarray, float]:
    """Corners, best patches with a ratio test of 0.92, then RANSAC over similarities or shifts; quality is (inliers / keypoints) ^ (1/3)."""
    size = 9 if min(fixed.shape) >= 18 else 5
    (p, d), (q, e) = corners(fixed, size=size, sigma=sigma, blur=blur), corners(moving, size=size, sigma=sigma, blur=blur)
    if len(p) < 2 or len(q) < 2:
        return np.eye(3), 0.0
    distance = np.linalg.norm(d[:, None] - e[None], axis=2)
    order = np.argsort(distance, axis=1)[:, :2]
    rows = np.arange(len(p))
    clear = distance[rows, order[:, 0]] < 0.92 * distance[rows, order[:, 1]]
    threshold = 0.05 * np.mean(np.array(fixed.shape)) / np.sqrt(2)
    a, b = p[clear][:, ::-1], q[order[clear, 0]][:, ::-1]
    t, inliers = ransac_shift(a, b, threshold) if kind == "translation" else ransac(a, b, threshold)
    return (t, float((inliers.sum() / len(p)) ** (1 / 3))) if inliers.sum() >= 2 else (np.eye(3), 0.0)


def by_intensity(fixed: np.ndarray, moving: np.ndarray) -> tuple[np.ndarray, float]:
    degrees, dy, dx, quality = intensity(fixed, moving)
    (h, w), c, s = fixed.shape, np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    cy, cx = (h - 1) / 2, (w - 1) / 2
    return np.array([[c, -s, cx + dx - c * cx + s * cy], [s, c, cy + dy - s * cx - c * cy], [0, 0, 1.0]]), max(quality, 0.0)


def by_points(fixed: np.ndarray, moving: np.ndarray) -> tuple[np.ndarray, float]:
    from weftwork.operators.matching import assignment

    p, q = area_points(fixed)[:, ::-1], area_points(moving)[:, ::-1]
    t = cpd(p, q)
    if t is None:
        return np.eye(3), 0.0
    step = np.median([np.sort(np.linalg.norm(s - s[:, None], axis=2), axis=1)[:, 1] for s in (p,)])
    found = assignment(p, q @ t[:2, :2].T + t[:2, 2], float(step))
    return t, sum(ok for *_, ok in found) / min(len(p), len(q))


#: Registration methods by the names that configurations use.
KERNELS: dict[str, Kernel] = {"phase": by_phase, "features": by_features, "cpd": by_points, "peaks": by_peaks, "intensity": by_intensity, "dummy": fixed_transform}


def kernel(name: str) -> Kernel:
    name = (name or "").lower()
    if name in KERNELS:
        return KERNELS[name]
    if "cpd" in name:
        return by_points
    if "ant" in name or "intens" in name:
        return by_intensity
    return by_features if any(x in name for x in ("feature", "orb", "sift")) else by_phase


def image(rows: pd.DataFrame) -> np.ndarray:
    """A tile's pixels as an array; missing ones take its mean."""
    out = np.full((int(rows.y.max()) + 1, int(rows.x.max()) + 1), np.nan)
    out[rows.y.to_numpy(int), rows.x.to_numpy(int)] = rows.value.to_numpy(float)
    return np.where(np.isnan(out), np.nanmean(out), out)


def register_pairs(pixels: DataFrame, pairs: DataFrame, method: str = "") -> DataFrame:
    """(i, j, matrix, quality): the transform (rows x, y) that takes tile j onto tile i, for each pair.

    A tile is one row with its rows of pixels, made once and joined by its id; pairs are rows of two such tiles.
    Missing pixels take the tile's mean. The kernel's failures, and tiles without values, give the identity with quality 0.
    """
    run = kernel(method)
    rows = pixels.groupBy("tile_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "value"))).alias("row"))
    tiles = rows.groupBy("tile_id").agg(F.array_sort(F.collect_list(F.struct("y", "row"))).alias("rows"))

    def whole(rows: list) -> np.ndarray | None:
        out = np.full((rows[-1]["y"] + 1, max(r["row"][-1]["x"] for r in rows) + 1), np.nan)
        for r in rows:
            for p in r["row"]:
                if p["value"] is not None:
                    out[r["y"], p["x"]] = p["value"]
        return None if np.isnan(out).all() else np.where(np.isnan(out), np.nanmean(out), out)

    @F.arrow_udf("matrix array<double>, quality double")
    def both(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(a.to_pylist(), b.to_pylist(), strict=True):
            fixed, moving = whole(p), whole(q)
            matrix, quality = (np.eye(3), 0.0) if fixed is None or moving is None else run(fixed, moving)
            out.append({"matrix": matrix.ravel().tolist(), "quality": float(quality)})
        return pa.array(out, pa.struct([("matrix", pa.list_(pa.float64())), ("quality", pa.float64())]))

    sides = [tiles.select(F.col("tile_id").alias(k), F.col("rows").alias(f"{k}_rows")) for k in "ij"]
    found = pairs.select("i", "j").join(sides[0], "i").join(sides[1], "j").select("i", "j", both("i_rows", "j_rows").alias("found"))
    return found.select("i", "j", "found.matrix", "found.quality")


def drifted(points: DataFrame, by: str, degrees: float, shift: tuple[float, float]) -> DataFrame:
    """(by, m): the transform that coherent point drift finds between point sets and themselves turned and shifted; null under two points."""
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        moving = rows[["x", "y"]].dropna().drop_duplicates().to_numpy(float)
        t = cpd(moving @ np.array([[c, -s], [s, c]]).T + shift, moving)
        return pd.DataFrame({by: [key[0]], "m": [None if t is None else t.ravel().tolist()]})

    spark = points.sparkSession
    tasks = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = points.select(by, "x", "y").repartitionByRange(tasks, by)  # small tables' groups would all be put into one task
    return dealt.groupBy(by).applyInPandas(run, f"`{by}` {dict(points.dtypes)[by]}, m array<double>")


def blurred(pixels: DataFrame, sigma: float) -> DataFrame:
    """Gaussian blur of each tile's planes; a group is one plane."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = gaussian(image(rows), sigma)
        return rows.assign(value=out[rows.y.to_numpy(int), rows.x.to_numpy(int)])

    return pixels.groupBy("tile_id", "z").applyInPandas(run, pixels.schema)


def boxes(points: DataFrame, by: str) -> DataFrame:
    """(by, corner, x, y): the oriented box of each point cloud."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        c = oriented_box(rows[["x", "y"]].to_numpy(float))
        return pd.DataFrame({by: [key[0]] * 4, "corner": range(4), "x": c[:, 0], "y": c[:, 1]})

    return points.groupBy(by).applyInPandas(run, f"`{by}` {dict(points.dtypes)[by]}, corner int, x double, y double")
