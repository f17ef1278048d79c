"""Boxes as four columns or as (x1, y1, x2, y2) structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def quad_box(x: Column, y: Column) -> Box:
    """The upright box around the corners of a quad (arrays of their x and y)."""
    return F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)


def union_bbox(words: DataFrame, line: list[str], x: str, y: str, text: str, order: list[str]) -> DataFrame:
    """line, x1, y1, x2, y2, text: of each line the box around its words' quads, and their texts in order, joined by spaces."""
    b = quad_box(F.col(x), F.col(y))
    edges = [f(c).alias(n) for f, c, n in zip((F.min, F.min, F.max, F.max), b, ("x1", "y1", "x2", "y2"), strict=True)]
    said = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("text_"))))
    return words.groupBy(*line).agg(*edges, F.array_join(F.transform(said, lambda w: w["text_"]), " ").alias("text"))


def area(b: Box) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0)) * F.greatest(b[3] - b[1], F.lit(0))


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    i = intersection(a, b)
    u = area(a) + area(b) - i
    return F.when(u > 0, i / u).otherwise(0.0)


def coverage(gt: Box, pred: Box) -> Column:
    """Share of gt that pred covers; 0 for an empty gt."""
    return F.when(area(gt) > 0, intersection(gt, pred) / area(gt)).otherwise(0.0)


def as_bbox(c: Column) -> Column:
    """Four numbers from "[a, b, c, d]", else null."""
    a = F.from_json(c.cast("string"), "array<double>")
    return F.when(F.size(a) == 4, a)


def rescale(b: Box, sx: Column, sy: Column, w: Column, h: Column) -> Box:
    """Scaled on each axis and clipped to the image."""

    def clip(v: Column, most: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(v, most))

    return clip(b[0] * sx, w), clip(b[1] * sy, h), clip(b[2] * sx, w), clip(b[3] * sy, h)


def denormalise(b: Box, w: Column, h: Column) -> Box:
    """Centre and size in shares of the page, as corners in pixels."""
    return (b[0] - b[2] / 2) * w, (b[1] - b[3] / 2) * h, (b[0] + b[2] / 2) * w, (b[1] + b[3] / 2) * h


def pad_crop(b: Box, w: Column, h: Column, ratio: float, min_pad: float) -> Box:
    """The box with a margin, whole pixels inside the image; null where under two pixels remain."""
    px = F.greatest(F.lit(float(min_pad)), (b[2] - b[0]) * ratio)
    py = F.greatest(F.lit(float(min_pad)), (b[3] - b[1]) * ratio)
    x1, y1 = (F.greatest(F.lit(0.0), v).cast("int") for v in (b[0] - px, b[1] - py))
    x2, y2 = F.least(w.cast("double"), b[2] + px).cast("int"), F.least(h.cast("double"), b[3] + py).cast("int")
    ok = (x2 - x1 >= 2) & (y2 - y1 >= 2)
    return tuple(F.when(ok, v) for v in (x1, y1, x2, y2))


def is_transposed(w: Column, h: Column, pw: Column, ph: Column, tol: float = 0.12) -> Column:
    """Whether an image and its page have reciprocal aspect ratios, clearly not equal ones."""
    a, p = w / h, pw / ph
    return (F.abs(a - 1 / p) < tol * F.greatest(F.lit(1.0), a)) & ~(F.abs(a - p) < 0.3)


def aspect_off(w: Column, h: Column, pw: Column, ph: Column, most: float = 0.02) -> Column:
    """Whether the scales of the axes differ by more than `most`."""
    return F.abs((w / pw) / (h / ph) - 1) > most
