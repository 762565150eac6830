import pytest

from weft import read_values
from weft import functions as fn


def test_formats_go_round(spark):
    c = read_values(b=[[10.0, 20.0, 30.0, 60.0], None, [1.0]], w=[100, 100, 100], h=[200, 200, 200])
    want = {"voc": [10, 20, 30, 60], "coco": [10, 20, 20, 40], "yolo": [0.2, 0.2, 0.2, 0.2], "albumentations": [0.1, 0.1, 0.3, 0.3]}
    for name, box in want.items():
        got = c.mutate(t=fn.boxes.convert("b", "voc", name, "w", "h"))
        assert got.to_values("t") == [pytest.approx(box), None, None]
        back = got.mutate(v=fn.boxes.convert("t", name, "voc", "w", "h")).to_values("v")
        assert back == [pytest.approx(want["voc"]), None, None]
    with pytest.raises(ValueError):
        fn.boxes.convert("b", "voc", "other", 1, 1)


def test_point_in_box(spark):
    c = read_values(b=[[0, 0, 2, 2]] * 3, x=[1, 2, 3], y=[1, 2, 1])
    assert c.mutate(i=fn.boxes.contains_point("b", "x", "y")).to_values("i") == [True, True, False]
