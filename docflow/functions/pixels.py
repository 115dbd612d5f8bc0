"""Pixel measurements of text crops, in Arrow batches of grey or colour rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of blue, green and red bytes in the grey value (in thousandths), as they fall when red and blue are
#: taken for each other; the level up to which a pixel is ink; the area a glyph box must exceed.
GREY, INK, GLYPH_AREA = (299, 587, 114), 128, 10


def grey(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Grey values of an image row of the engine's image source (bytes in the order blue, green, red)."""
    x = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return x[:, :, 0]
    return ((x[:, :, :3] @ np.array(GREY) + 500) // 1000).astype(np.uint8)


def ink(values: np.ndarray) -> np.ndarray:
    return values <= INK


def run_thickness(mask: np.ndarray) -> float:
    """Median over rows of ink pixels per run; a run that touches the left edge adds pixels but is no run. NaN without any."""
    if not mask.size:
        return float("nan")
    runs = (mask[:, 1:] & ~mask[:, :-1]).sum(1)
    rows = runs > 0
    return float(np.median(mask[rows].sum(1) / runs[rows])) if rows.any() else float("nan")


def erosions(mask: np.ndarray) -> int:
    """3 x 3 erosions until no ink is left; what lies outside does not erode, so a full mask stops at its shorter side."""
    n, most = 0, min(mask.shape) if mask.size else 0
    while mask.any() and n < most:
        padded = np.pad(mask, 1, constant_values=True)
        h, w = mask.shape
        mask = np.logical_and.reduce([padded[i : i + h, j : j + w] for i in range(3) for j in range(3)])
        n += 1
    return n


def _labels(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, int]:
    """Connected components by runs of each row and union-find; 0 is outside the mask."""
    parent = [0]

    def top(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    out = np.zeros(mask.shape, dtype=np.int64)
    above: list[tuple[int, int, int]] = []
    reach = 1 if diagonal else 0
    for y, row in enumerate(mask):
        edge = np.diff(np.concatenate(([0], row.astype(np.int8), [0])))
        here = []
        for a, b in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist(), strict=True):
            parent.append(len(parent))
            label = len(parent) - 1
            for c, d, other in above:
                if c < b + reach and a < d + reach:
                    x, z = top(label), top(other)
                    parent[max(x, z)] = min(x, z)
            out[y, a:b] = label
            here.append((a, b, label))
        above = here
    roots = np.array([top(i) for i in range(len(parent))])
    kinds, number = np.unique(roots, return_inverse=True)
    return number[out] if len(kinds) > 1 else out, len(kinds) - 1


def glyph_boxes(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, w, h) of the 8-connected ink parts that do not lie in a hole of another part."""
    if not mask.any():
        return []
    # ink and background 4-connected to the border; parts that touch that background are outer ones
    around, _ = _labels(np.pad(~mask, 1, constant_values=True), diagonal=False)
    open_ = around == around[0, 0]
    touches = open_[:-2, 1:-1] | open_[2:, 1:-1] | open_[1:-1, :-2] | open_[1:-1, 2:]
    parts, n = _labels(mask, diagonal=True)
    outer = set(np.unique(parts[mask & touches]).tolist())
    boxes = []
    for k in range(1, n + 1):
        if k in outer:
            ys, xs = np.nonzero(parts == k)
            boxes.append((int(xs.min()), int(ys.min()), int(xs.max() - xs.min() + 1), int(ys.max() - ys.min() + 1)))
    return boxes


def font_style(mask: np.ndarray, area: int = GLYPH_AREA) -> tuple[float | None, float | None]:
    """Median glyph height and stroke thickness of a crop; nulls with fewer than two glyphs of enough area."""
    heights = [h for _, _, w, h in glyph_boxes(mask) if w * h > area]
    return (float(np.median(heights)), run_thickness(mask)) if len(heights) > 1 else (None, None)


def image(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)


def crop(pixels: np.ndarray, x1: float, y1: float, x2: float, y2: float) -> np.ndarray:
    """The part of an image within corners rounded half to even; what lies outside of the image is black."""
    a, b, c, d = (round(v) for v in (x1, y1, x2, y2))
    out = np.zeros((max(d - b, 0), max(c - a, 0), pixels.shape[2]), dtype=np.uint8)
    h, w = pixels.shape[:2]
    lo_x, hi_x, lo_y, hi_y = max(a, 0), min(c, w), max(b, 0), min(d, h)
    if lo_x < hi_x and lo_y < hi_y:
        out[lo_y - b : hi_y - b, lo_x - a : hi_x - a] = pixels[lo_y:hi_y, lo_x:hi_x]
    return out


def png(data: bytes, width: int, height: int, channels: int) -> bytes:
    """An image row (bytes in the order blue, green, red, or grey) as a PNG file."""
    x = image(data, width, height, channels)
    x = x[:, :, 2::-1] if channels >= 3 else x[:, :, :1]
    lines = np.concatenate((np.zeros((height, 1), np.uint8), x.reshape(height, -1)), axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels >= 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def png_size(content: Column) -> Column:
    """Width and height in the head of a PNG file."""
    return F.struct(*[F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int").alias(n) for n, at in (("width", 17), ("height", 21))])


_IMAGE = "width int, height int, channels int, data binary"


def _mapped(rows: DataFrame, keys: tuple[str, ...], schema: str, types: list[pa.DataType], of: Callable[..., list[tuple]], extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows (keys, schema): what a function makes of each image row; null data make nothing."""
    columns = [*keys, "width", "height", "channels", "data", *extra]
    kinds = {f.name: f for f in rows.schema}
    whole = ", ".join([*(f"`{k}` {kinds[k].dataType.simpleString()}" for k in keys), schema])
    names = [*keys, *(part.split()[0] for part in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (*head, w, h, c, d) in enumerate(zip(*(b.column(n).to_pylist() for n in columns[: len(columns) - len(extra)]), strict=True)):
                found = of(image(d, w, h, c), *(b.column(e)[i].as_py() for e in extra)) if d is not None else []
                if found:
                    own = [b.column(k).take(pa.array([i] * len(found))) for k in keys]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, t) for v, t in zip(zip(*found, strict=True), types, strict=True))], names=names)

    return rows.select(*columns).mapInArrow(run, whole)


_PIXELS = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]


def _row(x: np.ndarray) -> tuple[int, int, int, bytes]:
    return x.shape[1], x.shape[0], x.shape[2], x.tobytes()


def greyed(images: DataFrame, *keys: str) -> DataFrame:
    """Images (keys, width, height, channels, data) as grey ones."""
    return _mapped(images, keys, _IMAGE, _PIXELS, lambda x: [_row(grey(x.tobytes(), x.shape[1], x.shape[0], x.shape[2])[:, :, None])])


def inked(images: DataFrame, *keys: str) -> DataFrame:
    """Images as masks: 255 where the grey value is ink, else 0."""
    return _mapped(images, keys, _IMAGE, _PIXELS, lambda x: [_row(np.where(ink(grey(x.tobytes(), x.shape[1], x.shape[0], x.shape[2])), 255, 0).astype(np.uint8)[:, :, None])])


def glyphs(images: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, x, y, w, h): boxes of the glyphs of each crop."""
    return _mapped(images, keys, "x int, y int, w int, h int", [pa.int32()] * 4, lambda x: glyph_boxes(ink(grey(x.tobytes(), x.shape[1], x.shape[0], x.shape[2]))))


def cropped(images: DataFrame, boxes: DataFrame, page: str, key: str) -> DataFrame:
    """Rows (page, key, width, height, channels, data): each box of ``boxes(page, key, x1, y1, x2, y2)`` cut out of its page.

    A page's boxes meet its image as one list; crops without a pixel are left out, as elements without one are.
    """
    listed = boxes.groupBy(page).agg(F.sort_array(F.collect_list(F.struct(F.col(key).cast("long").alias("key"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]))).alias("boxes"))

    def cut(x: np.ndarray, found: list[dict]) -> list[tuple]:
        parts = [(f["key"], crop(x, f["x1"], f["y1"], f["x2"], f["y2"])) for f in found]
        return [(k, *_row(p)) for k, p in parts if p.size]

    return _mapped(images.join(listed, page), (page,), f"{key} long, {_IMAGE}", [pa.int64(), *_PIXELS], cut, ("boxes",))


#: Bits of a weight in interpolation.
_WEIGHT = 11


def _between(n: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``to`` places along ``n`` pixels the pixel before it, and the weight of the next one in 1 / 2048.

    Centres of pixels lie on centres; places before the first or after the last centre have the pixel's own value.
    """
    over, whole = (2 * np.arange(to, dtype=np.int64) + 1) * n - to, 2 * max(to, 1)
    first, rest = np.divmod(over, whole)
    weight = (2 * rest * (1 << _WEIGHT) + whole) // (2 * whole)
    weight = np.where((first < 0) | (first >= n - 1), 0, weight)
    return np.clip(first, 0, n - 1), weight


def interpolated(x: np.ndarray, to_h: int, to_w: int) -> np.ndarray:
    """An image at another size, bilinear in whole numbers: each side's two pixels by weights that sum to 2048, rounded at the end."""
    (top, down), (left, right) = _between(x.shape[0], to_h), _between(x.shape[1], to_w)
    whole, wide = 1 << _WEIGHT, x.astype(np.int64)
    across = wide[:, left] * (whole - right)[None, :, None] + wide[:, np.minimum(left + 1, x.shape[1] - 1)] * right[None, :, None]
    both = across[top] * (whole - down)[:, None, None] + across[np.minimum(top + 1, x.shape[0] - 1)] * down[:, None, None]
    return ((both + (1 << (2 * _WEIGHT - 1))) >> (2 * _WEIGHT)).astype(np.uint8)


def resized(images: DataFrame, *keys: str, longest: int = 640, nearest: bool = False) -> DataFrame:
    """Images whose longest side is ``longest``, the ratio kept, fractions of the size cut off.

    Pixels are interpolated, or the nearest ones on request.
    """

    def scaled(x: np.ndarray) -> list[tuple]:
        h, w = x.shape[:2]
        factor = min(longest / w, longest / h) if w and h else 0
        to_h, to_w = int(h * factor), int(w * factor)
        if not nearest and to_h and to_w:
            return [_row(interpolated(x, to_h, to_w))]
        return [_row(x[((2 * np.arange(to_h) + 1) * h // (2 * to_h or 1))[:, None], ((2 * np.arange(to_w) + 1) * w // (2 * to_w or 1))[None, :]])]

    return _mapped(images, keys, _IMAGE, _PIXELS, scaled)


#: Colours of overlays as blue, green, red.
COLOURS = {"green": (0, 128, 0), "red": (0, 0, 255), "orange": (0, 165, 255), "blue": (255, 0, 0)}


def drawn(images: DataFrame, boxes: DataFrame, page: str) -> DataFrame:
    """Images with the outlines of ``boxes(page, id, x1, y1, x2, y2, colour)``, later ids over earlier ones."""
    corners = ("x1", "y1", "x2", "y2")
    listed = boxes.groupBy(page).agg(F.sort_array(F.collect_list(F.struct(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in corners], "colour"))).alias("boxes"))

    def outlined(x: np.ndarray, found: list[dict]) -> list[tuple]:
        x = x.copy()
        h, w = x.shape[:2]
        for f in found:
            a, b, c, d = (round(f[n]) for n in corners)
            ys, xs = (np.arange(max(lo, 0), max(min(hi + 1, n), 0)) for lo, hi, n in ((b, d, h), (a, c, w)))
            edge = ((ys == b) | (ys == d))[:, None] | ((xs == a) | (xs == c))[None, :]
            ys, xs = ys[np.nonzero(edge)[0]], xs[np.nonzero(edge)[1]]
            x[ys, xs] = COLOURS[f["colour"]][: x.shape[2]]
        return [_row(x)]

    return _mapped(images.join(listed, page), (page,), _IMAGE, _PIXELS, outlined, ("boxes",))


def styled(crops: DataFrame, key: str) -> DataFrame:
    """Rows (key, fontsize, thickness, erosions) of crops (key, width, height, channels, data). Null data give nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for d, w, h, c in zip(*(b.column(n).to_pylist() for n in ("data", "width", "height", "channels")), strict=True):
                mask = ink(grey(d, w, h, c)) if d else None
                out.append((None, None, None) if mask is None else (*font_style(mask), erosions(mask)))
            sizes, strokes, steps = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(sizes, pa.float64()), pa.array(strokes, pa.float64()), pa.array(steps, pa.int32())], names=[key, "fontsize", "thickness", "erosions"])

    rows = crops.select(F.col(key).cast("string").alias("key"), "width", "height", "channels", "data")
    return rows.mapInArrow(run, f"`{key}` string, fontsize double, thickness double, erosions int")


def glyph_size(glyphs: DataFrame, key: str, area: int = GLYPH_AREA) -> DataFrame:
    """Rows (key, n_glyphs, fontsize) from glyph boxes (key, w, h): the exact median height of those above ``area``.

    Without pixels this stays in generated code. Fewer than two such glyphs give null.
    """
    kept = F.when(F.col("w") * F.col("h") > area, F.col("h"))
    return glyphs.groupBy(key).agg(F.count(kept).alias("n_glyphs"), F.when(F.count(kept) >= 2, F.median(kept)).alias("fontsize"))


def run_lengths(rows: DataFrame, key: str, pixels: str = "pixels") -> DataFrame:
    """Rows (key, thickness) from mask rows (key, array of 0 and 255): median ink per run, without Python."""
    row = F.col(pixels)
    count = F.aggregate(row, F.lit(0), lambda a, p: a + (p > 0).cast("int"))
    rising = F.size(F.filter(F.arrays_zip(F.slice(row, 1, F.greatest(F.size(row) - 1, F.lit(0))).alias("a"), F.slice(row, 2, F.greatest(F.size(row), F.lit(1))).alias("b")), lambda p: (p["a"] == 0) & (p["b"] > 0)))
    measured = rows.select(key, F.when(rising > 0, count / rising).alias("ratio"))
    return measured.groupBy(key).agg(F.coalesce(F.median("ratio"), F.lit(float("nan"))).alias("thickness"))
