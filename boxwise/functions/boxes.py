"""Box geometry as column expressions. Formats are named: xyxy, xywh (corner and size), cxcywh (centre and size)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def columns(*names: str) -> Box:
    return tuple(F.col(n) for n in names)  # type: ignore[return-value]


def xywh_to_xyxy(b: Box) -> Box:
    x, y, w, h = b
    return x, y, x + w, y + h


def xyxy_to_xywh(b: Box) -> Box:
    x0, y0, x1, y1 = b
    return x0, y0, x1 - x0, y1 - y0


def xyxy_to_cxcywh(b: Box) -> Box:
    x0, y0, x1, y1 = b
    return (x0 + x1) / 2, (y0 + y1) / 2, x1 - x0, y1 - y0


def cxcywh_to_xyxy(b: Box) -> Box:
    cx, cy, w, h = b
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    """x within [low, high]; NaN stays NaN, as it counts as the largest number only above `high`."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.when(F.isnan(x), x).otherwise(F.greatest(lit(low), F.least(lit(high), x)))


def clip_to_image(b: Box, width: Column | float, height: Column | float) -> Box:
    x0, y0, x1, y1 = b
    return clamp(x0, 0, width), clamp(y0, 0, height), clamp(x1, 0, width), clamp(y1, 0, height)


def is_valid(b: Box) -> Column:
    """Whether an xyxy box has an inside."""
    x0, y0, x1, y1 = b
    return (x1 > x0) & (y1 > y0)


def area(b: Box) -> Column:
    x0, y0, x1, y1 = b
    return (x1 - x0) * (y1 - y0)


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def union(a: Box, b: Box) -> Column:
    return area(a) + area(b) - intersection(a, b)


def iou(a: Box, b: Box, empty: str = "zero") -> Column:
    """Intersection over union; of two boxes without area: 'zero' 0, 'floor' over at least 1e-12, 'null' NULL."""
    u = union(a, b)
    if empty == "floor":
        return intersection(a, b) / F.greatest(u, F.lit(1e-12))
    ratio = F.try_divide(intersection(a, b), u)
    return F.coalesce(ratio, F.lit(0.0)) if empty == "zero" else ratio


def giou(a: Box, b: Box) -> Column:
    """IoU less the share of the enclosing box that the union leaves; NULL without area."""
    hull = area((F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])))
    return iou(a, b, "null") - F.try_divide(hull - union(a, b), hull)


def l1(a: Box, b: Box) -> Column:
    return F.abs(a[0] - b[0]) + F.abs(a[1] - b[1]) + F.abs(a[2] - b[2]) + F.abs(a[3] - b[3])


def edge_distances(x: Column, y: Column, b: Box) -> Box:
    """From a point to the left, top, right and bottom edge of an xyxy box."""
    return x - b[0], y - b[1], b[2] - x, b[3] - y


def box_of_distances(x: Column, y: Column, d: Box) -> Box:
    """The xyxy box with the given edge distances from a point."""
    return x - d[0], y - d[1], x + d[2], y + d[3]


def contains(x: Column, y: Column, b: Box, eps: float = 1e-9) -> Column:
    """Whether a point is farther than eps inside of every edge."""
    return F.least(*edge_distances(x, y, b)) > eps


def normalise(b: Box, width: Column | float, height: Column | float) -> Box:
    return b[0] / width, b[1] / height, b[2] / width, b[3] / height


def crop(b: Box, top: float, left: float, height: float, width: float) -> Box:
    """The box within a cropped image."""
    moved = (b[0] - left, b[1] - top, b[2] - left, b[3] - top)
    return clip_to_image(moved, width, height)


def flip(b: Box, width: Column | float) -> Box:
    """The box in the image mirrored left to right."""
    return width - b[2], b[1], width - b[0], b[3]


def resize(b: Box, ratio_x: Column | float, ratio_y: Column | float) -> Box:
    return b[0] * ratio_x, b[1] * ratio_y, b[2] * ratio_x, b[3] * ratio_y


def unpad(b: Box, pad_x: Column | float, pad_y: Column | float) -> Box:
    """The box before padding on the left and above."""
    return b[0] - pad_x, b[1] - pad_y, b[2] - pad_x, b[3] - pad_y


def revert(b: Box, model: tuple[Column | float, Column | float], original: tuple[Column, Column], resized: tuple[Column, Column] | None = None, pad: tuple[Column | float, Column | float] = (0.0, 0.0)) -> Box:
    """A normalised xyxy box of the model's input, in pixels of the original image.

    resized: the image's size within the model's input, where its sides kept their ratio
    (None: it was stretched to the whole input); pad: what lies left of and above it.
    """
    pixels = unpad(resize(b, *model), *pad)
    width, height = resized or model
    return resize(pixels, original[0] / width, original[1] / height)


def envelope(b: Box, deviation: Box, z: float = 1.96) -> Box:
    """The hull of a normalised cxcywh box whose parts may each be off by z deviations, as xyxy within [0, 1]."""
    cx, cy, w, h = b
    s = deviation
    half_w, half_h = (F.greatest(F.lit(0.0), x + z * d) / 2 for x, d in ((w, s[2]), (h, s[3])))
    return clamp(cx - z * s[0] - half_w, 0, 1), clamp(cy - z * s[1] - half_h, 0, 1), clamp(cx + z * s[0] + half_w, 0, 1), clamp(cy + z * s[1] + half_h, 0, 1)
