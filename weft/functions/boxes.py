"""Bounding boxes as arrays of four numbers, by column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..columns import to_column

FORMATS = ("voc", "coco", "yolo", "albumentations")


def convert(box, source: str, target: str, width, height) -> Column:
    """``voc``: corners; ``coco``: corner and size; ``yolo``: centre and size, and ``albumentations``: corners, as shares
    of the image. Null where the box is null or has no four numbers."""
    if source not in FORMATS or target not in FORMATS:
        raise ValueError(f"formats are {', '.join(FORMATS)}")
    b, w, h = to_column(box), to_column(width, names=isinstance(width, str)), to_column(height, names=isinstance(height, str))
    p = [F.get(b, F.lit(i)).cast("double") for i in range(4)]
    if source in ("yolo", "albumentations"):
        p = [p[0] * w, p[1] * h, p[2] * w, p[3] * h]
    if source == "yolo":
        p = [p[0] - p[2] / 2, p[1] - p[3] / 2, p[2], p[3]]
    if source in ("yolo", "coco"):
        p = [p[0], p[1], p[0] + p[2], p[1] + p[3]]
    if target in ("coco", "yolo"):
        p = [p[0], p[1], p[2] - p[0], p[3] - p[1]]
    if target == "yolo":
        p = [p[0] + p[2] / 2, p[1] + p[3] / 2, p[2], p[3]]
    if target in ("yolo", "albumentations"):
        p = [p[0] / w, p[1] / h, p[2] / w, p[3] / h]
    return F.when(F.size(b) == 4, F.array(*p))


def contains_point(box, x, y) -> Column:
    """Whether corners ``box`` hold a point, edges included."""
    b, px, py = to_column(box), to_column(x), to_column(y)
    at = [F.get(b, F.lit(i)) for i in range(4)]
    return (px >= at[0]) & (px <= at[2]) & (py >= at[1]) & (py <= at[3])
