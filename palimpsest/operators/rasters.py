"""What pictures show, as vectorised functions over grey (a byte a pixel) or colour (three) rasters with their width and height."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
SLIDE_SCALES, SLIDE_STEPS, SLIDE_MOST = (1.0, 0.9, 1.1, 0.8, 1.25), 24, 110
FLAT, LEAST_SHARP_PX = 3.0, 16
BLANK_GREY, BLANK_LEAST, TALL = 250, 8.0, 320.0
SIZES, COARSE, SURE_GREY, SURE_EDGES, CANDIDATES, VERIFY_PX = 25, 0.35, 0.65, 0.5, 5, 96
GREY_STEP, HUE_STEP, LEAST_CHROMA, MOST_CHANGED, LEAST_REGION, MOST_REGIONS, MOST_SHIFT = 60, 18, 40, 0.35, 0.004, 6, 0.10
BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])


def grey_of(data, w, h) -> np.ndarray | None:
    if data is None or not w or not h or w != w or h != h or len(data) < int(w) * int(h):
        return None
    return np.frombuffer(data, np.uint8, int(w) * int(h)).reshape(int(h), int(w)).astype(np.float64)


def resized(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """Box averages where it shrinks, the nearest pixel where it grows."""
    total = np.pad(img.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    edge = lambda n, k: (np.floor(np.arange(k) * n / k).astype(int), np.maximum(np.ceil(np.arange(1, k + 1) * n / k).astype(int), np.floor(np.arange(k) * n / k).astype(int) + 1).clip(max=n))
    (y0, y1), (x0, x1) = edge(img.shape[0], h), edge(img.shape[1], w)
    y0, x0 = np.minimum(y0, y1 - 1), np.minimum(x0, x1 - 1)
    s = total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]
    return s / np.outer(y1 - y0, x1 - x0)


def correlations(small: np.ndarray, large: np.ndarray) -> np.ndarray | None:
    """The normalised correlation of `small` at every place in `large`, by Fourier transforms; None if it does not fit or shows nothing."""
    (h, w), (hh, ww) = small.shape, large.shape
    if h > hh or w > ww or h < 4 or w < 4:
        return None
    s = small - small.mean()
    norm = np.sqrt((s * s).sum())
    if norm < 1e-3:
        return None
    shape = (hh, ww)
    dot = np.fft.irfft2(np.fft.rfft2(large, shape) * np.conj(np.fft.rfft2(s, shape)), shape)[: hh - h + 1, : ww - w + 1]
    pad = lambda x: np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    area = lambda t: t[h:, w:] - t[:-h, w:] - t[h:, :-w] + t[:-h, :-w]
    spread = area(pad(large * large)) - area(pad(large)) ** 2 / (h * w)
    wide = np.sqrt(np.maximum(spread, 0))
    return np.where(wide > 1e-3, dot / (norm * np.maximum(wide, 1e-3)), -1.0)


def slide(a: np.ndarray, b: np.ndarray) -> float | None:
    """The best correlation of either picture, at five relative sizes, placed anywhere inside the other."""
    best = None
    for scale in SLIDE_SCALES:
        one = a if scale == 1 else resized(a, max(4, int(a.shape[0] * scale)), max(4, int(a.shape[1] * scale)))
        for small, large in ((one, b), (b, one)):
            found = correlations(small, large)
            if found is not None:
                step = max(1, min(large.shape[0] - small.shape[0], large.shape[1] - small.shape[1]) // SLIDE_STEPS + 1)
                best = max(float(found[::step, ::step].max()), -1.0 if best is None else best)
    return best


def _shrunk(img: np.ndarray, most: int) -> np.ndarray:
    k = most / max(img.shape)
    return img if k >= 1 else resized(img, max(4, round(img.shape[0] * k)), max(4, round(img.shape[1] * k)))


@F.pandas_udf(T.DoubleType())
def slide_score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """How well one picture is found inside the other, whatever part of it either shows; null if it cannot be told."""
    for a, aw, ah, b, bw, bh in batches:
        out = []
        for x, y in zip(map(grey_of, a, aw, ah), map(grey_of, b, bw, bh), strict=True):
            out.append(None if x is None or y is None else slide(_shrunk(x, SLIDE_MOST), _shrunk(y, SLIDE_MOST)))
        yield pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def sharpness(data: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    """The energy of a picture's edges by its contrast; null for what is flat or under sixteen pixels."""
    out = []
    for img in map(grey_of, data, w, h):
        if img is None or min(img.shape) < LEAST_SHARP_PX or img.std() < FLAT:
            out.append(None)
            continue
        gy, gx = np.gradient(img)
        out.append(float((np.abs(gx).mean() + np.abs(gy).mean()) / img.std()))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def ink(data: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    """The share of a picture that is printed dark: how heavy its strokes are."""
    return pd.Series([None if img is None or not img.size else float((255 - img).mean() / 255) for img in map(grey_of, data, w, h)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def colour_share(data: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    """The share of a colour picture's pixels whose channels differ by 40 or more."""
    out = []
    for d, x, y in zip(data, w, h, strict=True):
        if d is None or not x or not y or len(d) < 3 * int(x) * int(y):
            out.append(None)
            continue
        p = np.frombuffer(d, np.uint8, 3 * int(x) * int(y)).reshape(-1, 3).astype(int)
        out.append(float((np.ptp(p, axis=1) >= LEAST_CHROMA).mean()))
    return pd.Series(out, dtype="float64")


def blank_bands(img: np.ndarray, points: float) -> list[tuple[float, float]]:
    """Bands of wholly blank rows, eight points high at least, inside a picture of `points` height (not at its ends)."""
    blank = (img >= BLANK_GREY).all(axis=1)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], blank.astype(np.int8), [0]))))
    scale = points / len(img)
    return [(a * scale, b * scale) for a, b in zip(edge[::2], edge[1::2], strict=True) if a and b < len(img) and (b - a) * scale >= BLANK_LEAST]


def halves(img: np.ndarray, top: float, foot: float, marks: list[tuple[float, float]], qualifies) -> list[tuple[float, float]]:
    """The heights a tall picture is cut at its widest blank bands into, as long as both halves qualify by the marks inside them."""
    if foot - top <= TALL:
        return [(top, foot)]
    for a, b in sorted(blank_bands(img, foot - top), key=lambda s: (s[0] - s[1], s[0])):
        at = round((a + b) / 2 / (foot - top) * len(img))
        cut = top + (a + b) / 2
        upper, lower = [m for m in marks if m[1] <= cut], [m for m in marks if m[0] >= cut]
        if qualifies(top, cut, len(upper)) and qualifies(cut, foot, len(lower)):
            return halves(img[:at], top, cut, upper, qualifies) + halves(img[at:], cut, foot, lower, qualifies)
    return [(top, foot)]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("y0", T.DoubleType()), T.StructField("y1", T.DoubleType())])))
def split_tall(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """The parts that a cluster over 320 points high is cut into where its rendering is blank: (grey, w, h, y0, y1, x0, x1, marks).

    Marks are the heights (y0, y1) of its shapes; each part must hold four of them, be 60 points a side and of 6000 square points.
    """
    for data, w, h, y0, y1, x0, x1, marks in batches:
        out = []
        for img, top, foot, left, right, each in zip(map(grey_of, data, w, h), y0, y1, x0, x1, marks, strict=True):
            fit = lambda a, b, n, wide=right - left: n >= 4 and b - a >= 60 and wide >= 60 and (b - a) * wide >= 6000
            parts = [(top, foot)] if img is None else halves(img, float(top), float(foot), [(m["y0"], m["y1"]) for m in each], fit)
            out.append([{"y0": float(a), "y1": float(b)} for a, b in parts])
        yield pd.Series(out)


def _edges(img: np.ndarray) -> np.ndarray:
    """Edges, a little wider than they are: places are known to a pixel or two."""
    gy, gx = np.gradient(img)
    e = np.pad(np.hypot(gx, gy), 2, mode="edge")
    return sum(e[2 + dy : e.shape[0] - 2 + dy, 2 + dx : e.shape[1] - 2 + dx] for dy in range(-2, 3) for dx in range(-2, 3)) / 25


def _alike(a: np.ndarray, b: np.ndarray) -> float:
    x, y = a - a.mean(), b - b.mean()
    n = np.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / n) if n > 1e-6 else 0.0


def find_picture(art: np.ndarray, page: np.ndarray) -> tuple[float, float, float, float, float] | None:
    """(x0, y0, x1, y1, score) in the page's pixels of a piece of artwork at half to double its size.

    Coarse correlations over SIZES geometric steps name the candidates, grey levels and edges at VERIFY_PX must both agree.
    """
    found = []
    for scale in np.geomspace(0.5, 2.0, SIZES):
        h, w = round(art.shape[0] * scale), round(art.shape[1] * scale)
        if min(h, w) < 8 or h > page.shape[0] or w > page.shape[1]:
            continue
        k = min(1.0, 24 / min(h, w))
        small, large = resized(art, max(4, round(h * k)), max(4, round(w * k))), page if k == 1 else resized(page, max(4, round(page.shape[0] * k)), max(4, round(page.shape[1] * k)))
        c = correlations(small, large)
        if c is not None and c.max() >= COARSE:
            y, x = np.unravel_index(c.argmax(), c.shape)
            found.append((float(c.max()), int(y / k), int(x / k), h, w, int(np.ceil(1 / k)) + 1))
    best = None
    for _, y, x, h, w, reach in sorted(found, reverse=True)[:CANDIDATES]:
        # The place is known to a coarse pixel: once more at full size about it.
        top, left = max(0, y - reach), max(0, x - reach)
        c = correlations(resized(art, h, w), page[top : y + h + reach, left : x + w + reach])
        if c is None:
            continue
        dy, dx = np.unravel_index(c.argmax(), c.shape)
        y, x = top + int(dy), left + int(dx)
        a, b = resized(art, VERIFY_PX, VERIFY_PX), resized(page[y : y + h, x : x + w], VERIFY_PX, VERIFY_PX)
        grey, edge = _alike(a, b), _alike(_edges(a), _edges(b))
        if grey >= SURE_GREY and edge >= SURE_EDGES and (best is None or grey + edge > best[4]):
            best = (float(x), float(y), float(x + w), float(y + h), grey + edge)
    return best


@F.pandas_udf(T.StructType([*BOX.fields, T.StructField("score", T.DoubleType())]))
def find_artwork(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """Where a piece of artwork stands on a page of the other side, in the page's pixels; null if nowhere."""
    for a, aw, ah, b, bw, bh in batches:
        hits = [None if x is None or y is None else find_picture(x, y) for x, y in zip(map(grey_of, a, aw, ah), map(grey_of, b, bw, bh), strict=True)]
        yield pd.DataFrame([h or (None,) * 5 for h in hits], columns=["x0", "y0", "x1", "y1", "score"], dtype="float64")


def _shift(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How far `b` is moved against `a`, by phase correlation, a tenth of the picture at most."""
    f = np.fft.fft2(a - a.mean()) * np.conj(np.fft.fft2(b - b.mean()))
    peak = np.abs(np.fft.ifft2(f / np.maximum(np.abs(f), 1e-9)))
    y, x = np.unravel_index(peak.argmax(), peak.shape)
    y, x = (int(v - n if v > n // 2 else v) for v, n in ((y, a.shape[0]), (x, a.shape[1])))
    return (y, x) if abs(y) <= MOST_SHIFT * a.shape[0] and abs(x) <= MOST_SHIFT * a.shape[1] else (0, 0)


def _regions(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(pixels, x0, y0, x1, y1) of the parts that hang together, cells of four pixels being neighbours."""
    cell = 4
    h, w = -(-mask.shape[0] // cell), -(-mask.shape[1] // cell)
    grid = np.pad(mask, ((0, h * cell - mask.shape[0]), (0, w * cell - mask.shape[1]))).reshape(h, cell, w, cell).sum((1, 3))
    seen, out = np.zeros((h, w), bool), []
    for y, x in zip(*np.nonzero(grid), strict=True):
        if seen[y, x]:
            continue
        todo, part = [(y, x)], []
        seen[y, x] = True
        while todo:
            i, j = todo.pop()
            part.append((i, j))
            for p in range(max(0, i - 1), min(h, i + 2)):
                for q in range(max(0, j - 1), min(w, j + 2)):
                    if grid[p, q] and not seen[p, q]:
                        seen[p, q] = True
                        todo.append((p, q))
        ys, xs = [i for i, _ in part], [j for _, j in part]
        out.append((int(sum(grid[p] for p in part)), min(xs) * cell, min(ys) * cell, min(mask.shape[1], (max(xs) + 1) * cell), min(mask.shape[0], (max(ys) + 1) * cell)))
    return out


def differing(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes, largest first, in which two colour pictures of one size differ: by grey level, or by hue where both have colour.

    Pictures are laid over each other first; if over a third differs they are other pictures, not changed ones.
    """
    grey = [x @ np.array([0.299, 0.587, 0.114]) for x in (a, b)]
    dy, dx = _shift(*grey)
    b, other = np.roll(b, (dy, dx), (0, 1)), np.roll(grey[1], (dy, dx), (0, 1))
    chroma, hue = zip(*((np.ptp(x, axis=2), np.degrees(np.arctan2(np.sqrt(3) * (x[..., 1] - x[..., 2]), 2 * x[..., 0] - x[..., 1] - x[..., 2]))) for x in (a, b)), strict=True)
    turn = np.abs((hue[0] - hue[1] + 180) % 360 - 180)
    mask = (np.abs(grey[0] - other) >= GREY_STEP) | ((turn >= HUE_STEP) & (np.minimum(*chroma) >= LEAST_CHROMA))
    # What came round the edge by the shift is no difference.
    mask[: max(0, dy)], mask[mask.shape[0] + min(0, dy) :] = False, False
    mask[:, : max(0, dx)], mask[:, mask.shape[1] + min(0, dx) :] = False, False
    if not mask.any() or mask.mean() > MOST_CHANGED:
        return []
    parts = [p for p in _regions(mask) if (p[3] - p[1]) * (p[4] - p[2]) >= LEAST_REGION * mask.size]
    return [p[1:] for p in sorted(parts, key=lambda p: (-p[0], p[1:]))[:MOST_REGIONS]]


@F.pandas_udf(T.ArrayType(BOX))
def differing_regions(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """Where two renderings of a matched figure (three bytes a pixel) differ, in pixels of the first."""
    for a, aw, ah, b, bw, bh in batches:
        out = []
        for x, w, h, y, v, u in zip(a, aw, ah, b, bw, bh, strict=True):
            if x is None or y is None or not (w and h and v and u):
                out.append([])
                continue
            p = np.frombuffer(x, np.uint8).reshape(int(h), int(w), 3).astype(float)
            q = np.frombuffer(y, np.uint8).reshape(int(u), int(v), 3).astype(float)
            q = q if q.shape == p.shape else np.stack([resized(q[..., c], *p.shape[:2]) for c in range(3)], axis=2)
            out.append([dict(zip(("x0", "y0", "x1", "y1"), map(float, box), strict=True)) for box in differing(p, q)])
        yield pd.Series(out)
