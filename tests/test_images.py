import numpy as np

from tallyframe.functions import images
from tallyframe.operators import ocr


def striped(angle=0.0, h=200, w=300):
    """A page of lines, turned clockwise by an angle."""
    yy, xx = np.mgrid[:h, :w]
    t = np.radians(angle)
    y, x = (yy - h / 2) * np.cos(t) - (xx - w / 2) * np.sin(t), (xx - w / 2) * np.cos(t) + (yy - h / 2) * np.sin(t)
    return np.where((np.abs(y) < 60) & (np.abs(x) < 100) & (np.floor(y / 8) % 2 == 0), 20, 235).astype(np.uint8)


def test_tilts_are_measured_and_taken_out():
    for angle in (0.0, 2.0, -3.5, 8.0, -14.0):
        ink, found = images.tilt(striped(angle))
        assert ink > 5000 and abs(found - angle) < 0.4
        page, turn = images.deskewed(striped(angle))
        assert abs(images.tilt(page)[1]) < 0.4 and abs(turn + angle) < 0.4
    assert images.deskewed(striped(20.0))[1] == 0.0 and images.tilt(np.full((50, 50), 255, np.uint8)) [1] == 0.0


def test_levels():
    x = np.array([[100, 100, 100], [100, 160, 100], [100, 100, 100]], np.uint8)
    assert images.contrasted(x).tolist()[1] == [93, 213, 93] and images.contrasted(np.array([[0, 255]], np.uint8)).tolist() == [[0, 255]]
    assert images.sharpened(x)[1, 1] == 197 and images.sharpened(x)[0, 0] == 100
    assert (images.enhanced(np.full((9, 7, 3), 80, np.uint8)) == 80).all()
    assert images.grey(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255]]], np.uint8)).tolist() == [[76, 150, 29]]
    assert images.turned(np.array([[1, 2], [3, 4]]), 90).tolist() == [[3, 1], [4, 2]]


def test_pages_are_prepared_and_read(spark):
    page = striped(3.0)
    rows = [("a", 0, 200, 300, page.tobytes()), ("a", 1, 300, 200, np.rot90(striped()).tobytes()), ("b", 0, 200, 300, np.repeat(page[..., None], 3, 2).tobytes())]
    frame = spark.createDataFrame(rows, "path string, page_pos int, height int, width int, pixels binary")

    def sideways(x):
        if x.shape[0] == 200 and x.shape[1] == 300:
            raise ValueError("no orientation found")
        return 90

    got = {(r.path, r.page_pos): r for r in ocr.prepared(frame, sideways).collect()}
    assert abs(got["a", 0].degrees + 3) < 0.4 and got["a", 0].turned == 0 and got["a", 0].pixels == got["b", 0].pixels
    assert (got["a", 1].turned, got["a", 1].height, got["a", 1].width) == (90, 200, 300)

    def broken(x):
        raise RuntimeError("not installed")

    read = ocr.first_reading(ocr.prepared(frame), [broken, lambda x: " " if x.shape[0] == 300 else f" ink {x.shape[1]} "])
    assert {(r.path, r.page_pos): r.text for r in read.collect()} == {("a", 0): "ink 300", ("a", 1): "", ("b", 0): "ink 300"}
