"""Annotation models as dataclasses: columns of structs, and objects in user functions that hint them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class BBox:
    """A box by its corners (left, top, right, bottom)."""

    title: str = ""
    coords: list[int] = field(default_factory=list)

    @classmethod
    def from_list(cls, coords: list[float], title: str = "") -> BBox:
        if len(coords) != 4:
            raise ValueError("a box has four numbers")
        return cls(title, [round(c) for c in coords])

    @classmethod
    def from_dict(cls, coords: dict[str, float], title: str = "") -> BBox:
        if set(coords) != {"x1", "y1", "x2", "y2"}:
            raise ValueError("a box has x1, y1, x2 and y2")
        return cls.from_list([coords[k] for k in ("x1", "y1", "x2", "y2")], title)

    @classmethod
    def from_coco(cls, coords: list[float], title: str = "") -> BBox:
        x, y, w, h = coords
        return cls.from_list([x, y, x + w, y + h], title)

    @classmethod
    def from_yolo(cls, coords: list[float], size: tuple[int, int], title: str = "") -> BBox:
        x, y, w, h = (c * size[i % 2] for i, c in enumerate(coords))
        return cls.from_list([x - w / 2, y - h / 2, x + w / 2, y + h / 2], title)

    def to_coco(self) -> list[int]:
        a, b, c, d = self.coords
        return [a, b, c - a, d - b]

    def to_yolo(self, size: tuple[int, int]) -> list[float]:
        a, b, c, d = self.coords
        return [(a + c) / 2 / size[0], (b + d) / 2 / size[1], (c - a) / size[0], (d - b) / size[1]]

    def point_inside(self, x: int, y: int) -> bool:
        a, b, c, d = self.coords
        return a <= x <= c and b <= y <= d

    def pose_inside(self, pose: Pose | Pose3D) -> bool:
        """Whether all points lie in the box; those at the origin were not seen."""
        return all(self.point_inside(x, y) for x, y in zip(pose.x, pose.y) if (x, y) != (0, 0))


@dataclass
class OBBox:
    """A turned box by its four corners."""

    title: str = ""
    coords: list[int] = field(default_factory=list)

    @classmethod
    def from_list(cls, coords: list[float], title: str = "") -> OBBox:
        if len(coords) != 8:
            raise ValueError("a turned box has eight numbers")
        return cls(title, [round(c) for c in coords])


def _points(data: list, dims: int, n: int | None) -> list[list]:
    if len(data) != dims or len({len(x) for x in data}) > 1 or n is not None and len(data[0]) != n:
        raise ValueError(f"{dims} lists of {n or 'equally many'} numbers are needed")
    return [[round(v) if i < 2 else float(v) for v in x] for i, x in enumerate(data)]


@dataclass
class Pose:
    """The seventeen key points of a body."""

    x: list[int] = field(default_factory=list)
    y: list[int] = field(default_factory=list)

    @classmethod
    def from_list(cls, points: list[list[float]]) -> Pose:
        return cls(*_points(points, 2, 17))

    @classmethod
    def from_dict(cls, points: dict[str, list[float]]) -> Pose:
        return cls.from_list([points["x"], points["y"]])


@dataclass
class Pose3D:
    """Key points with how well each was seen."""

    x: list[int] = field(default_factory=list)
    y: list[int] = field(default_factory=list)
    visible: list[float] = field(default_factory=list)

    @classmethod
    def from_list(cls, points: list[list[float]]) -> Pose3D:
        return cls(*_points(points, 3, 17))


@dataclass
class Segment:
    """The outline of an area."""

    title: str = ""
    x: list[int] = field(default_factory=list)
    y: list[int] = field(default_factory=list)

    @classmethod
    def from_list(cls, points: list[list[float]], title: str = "") -> Segment:
        return cls(title, *_points(points, 2, None))


@dataclass
class Detection:
    """One object that a detector found: class, name, confidence and box."""

    cls: int = -1
    name: str = ""
    confidence: float = 0.0
    box: BBox = field(default_factory=BBox)


@dataclass
class PoseDetection(Detection):
    pose: Pose3D = field(default_factory=Pose3D)


@dataclass
class SegmentDetection(Detection):
    segment: Segment = field(default_factory=Segment)
