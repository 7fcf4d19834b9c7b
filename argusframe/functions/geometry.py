"""Boxes, letterboxes, anchors and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def from_centre(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Normalised centre and size as a struct of corner pixels, area and share of the image."""
    s = F.struct(((cx - w / 2) * width).alias("x1"), ((cy - h / 2) * height).alias("y1"), ((cx + w / 2) * width).alias("x2"), ((cy + h / 2) * height).alias("y2"), (w * width * h * height).alias("area"), (w * h).alias("share"))
    return s


def iou(a: str, b: str) -> Column:
    """Intersection over union of two box structs (x1, y1, x2, y2); 0 where the union is empty."""
    g = lambda s, f: F.col(f"{s}.{f}")
    w = F.greatest(F.least(g(a, "x2"), g(b, "x2")) - F.greatest(g(a, "x1"), g(b, "x1")), F.lit(0.0))
    h = F.greatest(F.least(g(a, "y2"), g(b, "y2")) - F.greatest(g(a, "y1"), g(b, "y1")), F.lit(0.0))
    size = lambda s: (g(s, "x2") - g(s, "x1")) * (g(s, "y2") - g(s, "y1"))
    union = size(a) + size(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def letterbox(w: Column, h: Column, side: int) -> Column:
    """(scale, new_w, new_h, left, top) of an image fitted into a square: sizes are cut, paddings floored."""
    scale = F.least(F.lit(float(side)) / w, F.lit(float(side)) / h)
    nw, nh = F.floor(w * scale), F.floor(h * scale)
    return F.struct(scale.alias("scale"), nw.alias("new_w"), nh.alias("new_h"), F.floor((side - nw) / 2).alias("left"), F.floor((side - nh) / 2).alias("top"))


def unletterbox(x: Column, pad: Column, scale: Column, limit: Column) -> Column:
    """A coordinate back in the image, held between 0 and limit - 1."""
    return F.least(F.greatest((x - pad) / scale, F.lit(0.0)), limit - 1)


def frame_timestamp(position_ms: Column, index: Column, fps: Column) -> Column:
    return F.when(position_ms > 0, position_ms / 1000).when(fps > 0, index / fps).otherwise(0.0)


def even_indices(count: Column, wanted: Column) -> Column:
    """Evenly spaced positions, rounded half to even: array<bigint>; one position is 0; null unless both are positive."""
    n = F.least(count, wanted)
    many = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.bround(i * (count - 1) / (n - 1)).cast("bigint"))
    return F.when((count <= 0) | (wanted <= 0), F.lit(None)).when(n == 1, F.array(F.lit(0).cast("bigint"))).otherwise(many)


def anchors(size: int, strides=(8, 16, 32, 64)) -> Column:
    """Centres of a detector's anchor grid: array of (stride, x, y), row by row."""
    def grid(stride: int) -> Column:
        along = F.sequence(F.lit(0), F.lit(-(-size // stride) - 1))
        at = lambda k: k * stride + 0.5 * (stride - 1)
        return F.flatten(F.transform(along, lambda j: F.transform(along, lambda i: F.struct(F.lit(stride).alias("stride"), at(i).alias("x"), at(j).alias("y")))))

    per = [grid(s) for s in strides]
    return F.concat(*per)


def from_distances(x: Column, y: Column, left: Column, top: Column, right: Column, bottom: Column, side: int) -> Column:
    """The box that lies at these distances around a point, held inside a square."""
    held = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(side)))
    return F.struct(held(x - left).alias("x1"), held(y - top).alias("y1"), held(x + right).alias("x2"), held(y + bottom).alias("y2"))


def integral_distance(logits: Column, stride: Column) -> Column:
    """Softmax expectation of bins 0, 1, 2 ... times stride."""
    e = F.transform(logits, F.exp)
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(F.transform(e, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x) / total * stride
