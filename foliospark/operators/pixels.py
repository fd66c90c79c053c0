"""Pixel kernels: compression error levels, ink masks and glyph shapes of grey images."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard luminance quantisation table (JPEG, annex K).
LUMINANCE = np.array([
    [16, 11, 10, 16, 24, 40, 51, 61],
    [12, 12, 14, 19, 26, 58, 60, 55],
    [14, 13, 16, 24, 40, 57, 69, 56],
    [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77],
    [24, 35, 55, 64, 81, 104, 113, 92],
    [49, 64, 78, 87, 103, 121, 120, 101],
    [72, 92, 95, 98, 112, 100, 103, 99],
])
# Fixed value: a split below this share of the greatest possible variance is no ink.
LEAST_SEPARABILITY = 0.03
#: Pixels that are compressed at once.
STACK = 1 << 19


@cache
def _cosines() -> np.ndarray:
    k, n = np.mgrid[0:8, 0:8]
    return np.cos((2 * n + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)


def jpeg_round_trip(grey: np.ndarray, quality: int = 90) -> np.ndarray:
    """Grey images, one or a stack of equal sizes, after lossy compression: 8 by 8 cosine transform, quantised and back."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    table = np.clip((LUMINANCE * scale + 50) // 100, 1, 255)
    *stack, h, w = grey.shape
    ys, xs = np.arange(h + -h % 8), np.arange(w + -w % 8)
    padded = grey[..., np.minimum(ys, h - 1)[:, None], np.minimum(xs, w - 1)].astype(np.float64) - 128
    rows, cols = padded.shape[-2] // 8, padded.shape[-1] // 8
    blocks = padded.reshape(*stack, rows, 8, cols, 8).swapaxes(-3, -2)
    c = _cosines()
    quantised = np.round(c @ blocks @ c.T / table) * table
    back = (c.T @ quantised @ c).swapaxes(-3, -2).reshape(padded.shape)[..., :h, :w]
    return np.clip(np.round(back + 128), 0, 255).astype(np.uint8)


def otsu_threshold(grey: np.ndarray) -> tuple[float, float]:
    """(threshold, separability): class 0 is counted up to the threshold, the first best one wins."""
    n = np.bincount(grey.ravel(), minlength=256).astype(np.float64)
    below, weighted = np.cumsum(n), np.cumsum(n * np.arange(256))
    total, whole = below[-1], weighted[-1]
    ok = (below > 0) & (below < total)
    if not ok.any():
        return 128.0, 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where(ok, below * (total - below) * (weighted / below - (whole - weighted) / (total - below)) ** 2, -1.0)
    best = int(between.argmax())
    return float(best), float(max(between[best], 0) / (total**2 * 255.0**2 / 4))


def ink_mask(grey: np.ndarray) -> np.ndarray | None:
    """The minority side of the split, dark or light; None if the image has no clear split."""
    threshold, separability = otsu_threshold(grey)
    if separability < LEAST_SEPARABILITY:
        return None
    dark = grey < threshold
    return dark if dark.mean() <= 0.5 else ~dark


def error_level(grey: np.ndarray, quality: int = 90, only_ink: bool = False) -> int:
    """The largest change by compression, over ink only if asked for and there is some; 1 at least."""
    change = np.abs(grey.astype(np.int16) - jpeg_round_trip(grey, quality))
    mask = ink_mask(grey) if only_ink else None
    if mask is not None and mask.any():
        change = change[mask]
    return max(1, int(change.max(initial=0)))


def error_levels(images: Sequence[bytes | None], widths: Sequence[int | None], quality: int = 90) -> list[int | None]:
    """``error_level`` of images stored as bytes in row order, those of one size together."""
    out: list[int | None] = [None] * len(images)
    alike: dict[tuple[int, int], list[int]] = {}
    for i, (d, w) in enumerate(zip(images, widths, strict=True)):
        if d is not None and w is not None and w == w and w:
            alike.setdefault((len(d), int(w)), []).append(i)
    for (size, width), at in alike.items():
        many = max(1, STACK // max(size, 1))
        for lo in range(0, len(at), many):
            part = at[lo : lo + many]
            grey = np.frombuffer(b"".join(images[i] for i in part), np.uint8).reshape(len(part), size // width, width)
            change = np.abs(grey.astype(np.int16) - jpeg_round_trip(grey, quality))
            for i, level in zip(part, change.reshape(len(part), size).max(axis=1, initial=0).tolist(), strict=True):
                out[i] = max(1, level)
    return out


def connected_components(mask: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ys, xs) of the 8-connected parts of a mask, in row order of their first pixel.

    Runs of a row are joined with those of the row above that they touch, so the work is that of the pixels.
    """
    padded = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    padded[:, 1:-1] = mask
    edges = np.diff(padded, axis=1)
    rows, starts = np.nonzero(edges == 1)
    stops = np.nonzero(edges == -1)[1]
    parent = list(range(len(rows)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    first = np.searchsorted(rows, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        above, here = first[y - 1], first[y]
        while above < first[y] and here < first[y + 1]:
            if starts[above] <= stops[here] and starts[here] <= stops[above]:  # runs that touch at a corner count
                a, b = root(int(above)), root(int(here))
                parent[max(a, b)] = min(a, b)
            if stops[above] < stops[here]:
                above += 1
            else:
                here += 1
    parts: dict[int, list[int]] = {}
    for k in range(len(rows)):
        parts.setdefault(root(k), []).append(k)
    return [(np.concatenate([np.full(stops[k] - starts[k], rows[k]) for k in ks]), np.concatenate([np.arange(starts[k], stops[k]) for k in ks])) for ks in parts.values()]


def component_shape(ys: np.ndarray, xs: np.ndarray) -> tuple[float, float]:
    """Slant in degrees from second moments, and width over height."""
    dy, dx = ys - ys.mean(), xs - xs.mean()
    slant = np.degrees(0.5 * np.arctan2(2 * (dx * dy).mean(), (dx * dx).mean() - (dy * dy).mean()))
    return float(slant), float((np.ptp(xs) + 1) / (np.ptp(ys) + 1))


# Pixels of a glyph and around a field, least side of a field's crop, background darker than plain paper.
LEAST_GLYPH, FIELD_PADDING, LEAST_SIDE, PAPER = 5, 3, 6, 150.0
# Pixels around a field whose error level is measured, and the level above which it is odd.
ERROR_PADDING, FIELD_ERROR, PAGE_ERROR = 14, 20, 35


def pad_box(box: Sequence[int], width: int, height: int, padding: int = 12) -> tuple[int, int, int, int]:
    x1, y1, x2, y2 = box
    return max(0, x1 - padding), max(0, y1 - padding), min(width, x2 + padding), min(height, y2 + padding)


def polygon_box(points: Column, scale: float | Column = 1.0) -> Column:
    """struct<x1, y1, x2, y2> around a reader's polygon, array<struct<x, y>>, in the unscaled image's whole pixels."""
    edge = lambda pick, axis: (pick(F.transform(points, lambda p: p[axis])) * scale).cast("int")
    return F.struct(edge(F.array_min, "x").alias("x1"), edge(F.array_min, "y").alias("y1"), edge(F.array_max, "x").alias("x2"), edge(F.array_max, "y").alias("y2"))


def median_shape(ink: np.ndarray) -> tuple[float, float, bool]:
    """Median slant and proportions of the glyphs, and whether there are any with enough ink; else 0 and 1."""
    shapes = [component_shape(ys, xs) for ys, xs in connected_components(ink) if len(ys) >= LEAST_GLYPH]
    if not shapes:
        return 0.0, 1.0, False
    slant, aspect = np.median(np.array(shapes), axis=0)
    return float(slant), float(aspect), True


def field_ink(grey: np.ndarray, box: Sequence[int]) -> tuple[np.ndarray, np.ndarray | None]:
    """A field's crop and its ink; None for an empty crop or one without a clear split."""
    x1, y1, x2, y2 = pad_box(box, grey.shape[1], grey.shape[0], FIELD_PADDING)
    crop = grey[y1 : max(y1, y2), x1 : max(x1, x2)]
    return crop, ink_mask(crop) if crop.size else None


def crop_features(grey: np.ndarray, box: Sequence[int], cut: tuple[np.ndarray, np.ndarray | None] | None = None) -> dict | None:
    """Height, ink and glyph shapes of a field; None for a crop that is too small or has no clear ink. ``cut`` is its ``field_ink``."""
    crop, ink = cut or field_ink(grey, box)
    if min(crop.shape) < LEAST_SIDE or ink is None:
        return None
    inked = crop[ink] if ink.any() else crop
    slant, aspect, reliable = median_shape(ink)
    return {"height": float(crop.shape[0]), "ink_ratio": float(ink.mean()), "mean_ink": float(inked.mean()), "ink_std": float(inked.std()), "slant_angle": slant, "aspect_ratio": aspect, "shape_reliable": reliable}


def background_mean(grey: np.ndarray, box: Sequence[int], cut: tuple[np.ndarray, np.ndarray | None] | None = None) -> float | None:
    """Mean of a field's pixels that are not ink; None without a clear split. ``cut`` is its ``field_ink``."""
    crop, ink = cut or field_ink(grey, box)
    return None if ink is None or ink.all() else float(crop[~ink].mean())


def heat_map(grey: np.ndarray, quality: int = 90) -> np.ndarray:
    """Where compression changes an image, the greatest change white."""
    change = np.abs(grey.astype(np.int16) - jpeg_round_trip(grey, quality))
    return np.clip(np.floor(change * (255.0 / max(1, int(change.max(initial=0))))), 0, 255).astype(np.uint8)


def grey_of(rgb: np.ndarray) -> np.ndarray:
    """Luma of a height by width by 3 image, in the usual 16-bit integer weights."""
    r, g, b = (rgb[..., k].astype(np.int64) for k in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


REGION = "level int, anomaly boolean, ink_masked boolean, highlighted boolean, height double, ink_ratio double, mean_ink double, ink_std double, slant_angle double, aspect_ratio double, shape_reliable boolean"


def measure_region(grey: np.ndarray, box: Sequence[int]) -> dict:
    """A field's error level, on ink only where the background is highlighted, and its features."""
    cut = field_ink(grey, box)
    mean = background_mean(grey, box, cut)
    highlighted = mean is not None and mean < PAPER
    x1, y1, x2, y2 = pad_box(box, grey.shape[1], grey.shape[0], ERROR_PADDING)
    crop = grey[y1:y2, x1:x2]
    level = error_level(crop, only_ink=highlighted) if crop.size else None
    mask = ink_mask(crop) if highlighted and crop.size else None
    features = crop_features(grey, box, cut) or {}
    return {"level": level, "anomaly": level is not None and level > FIELD_ERROR, "ink_masked": mask is not None and bool(mask.any()), "highlighted": highlighted, **features}


def measure_regions(pixels: Column, width: Column, boxes: Column) -> Column:
    """array of REGION for the boxes array<struct<x1, y1, x2, y2>> of a grey image, in their order; null for a null box.

    All of a document's fields are measured from one copy of its pixels.
    """

    @F.pandas_udf(f"array<struct<{', '.join(': '.join(f.split(' ')) for f in REGION.split(', '))}>>")
    def measure(data: pd.Series, columns: pd.Series, all_boxes: pd.Series) -> pd.Series:
        names = [f.split(" ")[0] for f in REGION.split(", ")]
        out = []
        for d, w, boxes in zip(data, columns, all_boxes, strict=True):
            if d is None or not w or boxes is None:
                out.append(None)
                continue
            grey = np.frombuffer(d, np.uint8).reshape(-1, int(w))
            edges = [[b[k] for k in ("x1", "y1", "x2", "y2")] if b is not None else [None] for b in boxes]
            found = [None if any(pd.isna(e) for e in box) else measure_region(grey, list(map(int, box))) for box in edges]
            out.append([None if m is None else {n: m.get(n) for n in names} for m in found])
        return pd.Series(out)

    return measure(pixels, width, boxes)


def error_level_column(pixels: Column, width: Column, quality: int = 90, only_ink: bool = False) -> Column:
    """``error_level`` of grey images stored as bytes in row order."""

    @F.pandas_udf("int")
    def measure(data: pd.Series, columns: pd.Series) -> pd.Series:
        if not only_ink:
            return pd.Series(error_levels(data.tolist(), columns.tolist(), quality), dtype="Int32")
        return pd.Series([None if d is None or not w else error_level(np.frombuffer(d, np.uint8).reshape(-1, int(w)), quality, only_ink) for d, w in zip(data, columns, strict=True)], dtype="Int32")

    return measure(pixels, width)


# Mean distance of a corner from white and mean saturation above which an image is a photo.
PHOTO_CORNER, PHOTO_SATURATION = 60.0, 40.0


def capture_mode(rgb: np.ndarray) -> tuple[str, float, float]:
    """(mode, greatest distance of a corner's mean colour from white, mean saturation) of a height by width by 3 image."""
    h, w = rgb.shape[:2]
    side = max(10, min(h, w) // 12)
    corners = [rgb[ys, xs].reshape(-1, 3) for ys in (slice(0, side), slice(max(h - side, 0), h)) for xs in (slice(0, side), slice(max(w - side, 0), w))]
    distance = max(float(np.linalg.norm(c.mean(axis=0) - 255.0)) for c in corners)
    most, least = rgb.max(axis=2).astype(np.float64), rgb.min(axis=2)
    saturation = float(np.floor(np.divide(most - least, most, out=np.zeros_like(most), where=most > 0) * 255).mean())
    return "photo" if distance > PHOTO_CORNER or saturation > PHOTO_SATURATION else "digital_or_scan", round(distance, 1), round(saturation, 1)


def capture_mode_column(pixels: Column, width: Column) -> Column:
    """``capture_mode`` of images stored as RGB bytes in row order; no pixels: ``digital_or_scan`` without measures."""

    @F.pandas_udf("mode string, corner_distance double, saturation double")
    def measure(data: pd.Series, columns: pd.Series) -> pd.DataFrame:
        found = [("digital_or_scan", None, None) if not d or not w else capture_mode(np.frombuffer(d, np.uint8).reshape(-1, int(w), 3)) for d, w in zip(data, columns, strict=True)]
        return pd.DataFrame(found, columns=["mode", "corner_distance", "saturation"])

    return measure(pixels, width)
