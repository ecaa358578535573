"""Fingerprints of pictures against averages worked out pixel by pixel."""

import numpy as np
import struct
import zlib

from corvane.operators import fingerprints


def averages(grey, lines, columns):
    h, w = grey.shape
    out = np.zeros((lines, columns))
    for i in range(lines):
        for j in range(columns):
            for y in range(h):
                for x in range(w):
                    a = min((y + 1) * lines, (i + 1) * h) - max(y * lines, i * h)
                    b = min((x + 1) * columns, (j + 1) * w) - max(x * columns, j * w)
                    out[i, j] += grey[y, x] * max(a, 0) * max(b, 0)
    return out / (h * w)


def bits_by_hand(grey):
    a = np.round(averages(grey, 8, 9), 9)
    value = 0
    for line in a:
        for left, right in zip(line, line[1:], strict=False):
            value = value * 2 + int(right > left)
    return value - 2**64 if value >= 2**63 else value


def test_area_averages_and_hashes():
    rng = np.random.default_rng(1)
    for h, w in ((8, 9), (5, 4), (17, 23), (30, 11)):
        grey = rng.integers(0, 256, (h, w))
        assert np.allclose(fingerprints.area_sums(grey, 8, 9) / (h * w), averages(grey, 8, 9))
        assert fingerprints.difference_hash(grey) == bits_by_hand(grey)
    assert fingerprints.difference_hash(np.zeros((20, 20), dtype=int)) == 0 and len(fingerprints.thumbnail(np.ones((3, 3), dtype=int))) == 128 * 128
    rising = np.tile(np.arange(9), (8, 1))
    assert fingerprints.difference_hash(rising) == -1 and fingerprints.difference_hash(rising[:, ::-1]) == 0
    half = rng.integers(0, 200, (64, 72)) + np.arange(72) * 5
    assert (fingerprints.difference_hash(half) ^ fingerprints.difference_hash(np.kron(half, np.ones((2, 2), dtype=int)))) == 0


def png(grey):
    h, w = grey.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + bytes(row) for row in grey.astype(np.uint8).tolist())
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def test_picture_fingerprints(spark, tmp_path):
    rng = np.random.default_rng(2)
    shapes = {"a.png": rng.integers(0, 256, (16, 18)), "b.png": rng.integers(0, 256, (40, 25))}
    for name, grey in shapes.items():
        (tmp_path / name).write_bytes(png(grey))
    (tmp_path / "c.png").write_bytes(b"no picture")
    got = {r.file_name: r for r in fingerprints.picture_fingerprints(spark.read.format("image").load(str(tmp_path))).collect()}
    for name, grey in shapes.items():
        assert (got[name].height, got[name].width) == grey.shape and got[name].dhash == bits_by_hand(grey)
        assert np.allclose(got[name].thumb, fingerprints.thumbnail(grey), atol=1e-3)
    assert got["c.png"].dhash is None and got["c.png"].thumb is None


def test_drawn_fingerprints(spark):
    images = spark.createDataFrame([(1, 10, 12), (2, 10, 12), (3, 4, 4)], "image_id long, height int, width int")
    runs = spark.createDataFrame([(1, 2, 3, 9, 5), (1, 2, 5, 7, 4), (1, 50, 0, 4, 5), (1, 3, -2, 40, 1), (3, 0, 0, 1, 7), (9, 0, 0, 1, 7)], "image_id long, line long, x0 long, x1 long, level long")
    grey = np.zeros((10, 12), dtype=int)
    grey[2, 3:9] += 5
    grey[2, 5:7] += 4
    grey[3] += 1
    got = {r.image_id: r for r in fingerprints.drawn_fingerprints(images, runs).collect()}
    assert set(got) == {1, 2, 3} and got[1].dhash == bits_by_hand(grey) and np.isclose(got[1].mean, grey.mean())
    assert got[2].dhash == 0 and got[2].mean == 0 and np.isclose(sum(got[3].thumb) / 128**2, 7 / 16)


def test_block_sums_draw_no_picture():
    g = np.random.default_rng(5)
    height, width, picture = np.array([30, 1, 640]), np.array([7, 50, 9]), np.array([0, 0, 0, 1, 1, 2])
    line, x0 = g.integers(-5, 30, 6), g.integers(-5, 9, 6)
    blocks = np.stack([line, line + g.integers(-1, 40, 6), x0, x0 + g.integers(-1, 60, 6), g.integers(1, 9, 6)])
    sums = fingerprints.block_sums(picture, height[picture], width[picture], blocks, at_once=2)
    for p in range(3):
        grey = np.zeros((height[p], width[p]), dtype=int)
        for a, b, c, d, level in blocks[:, picture == p].T:
            grey[max(a, 0) : max(b, 0), max(c, 0) : max(d, 0)] += level
        assert (sums[p] == fingerprints.area_sums(grey, 8, 9)).all()


def test_drawn_pictures_that_batches_cut(spark):
    images = spark.createDataFrame([(i, 20 + i % 7, 30 + i % 5) for i in range(60)], "image_id long, height int, width int")
    g = np.random.default_rng(6)
    made = [(i, int(a), int(a + b), int(c), int(c + d), int(v)) for i in range(50) for a, b, c, d, v in g.integers((-3, 0, -3, 0, 1), (25, 9, 30, 20, 9), (40, 5))]
    blocks = spark.createDataFrame(made, "image_id long, line long, stop long, x0 long, x1 long, level long")
    lines = spark.createDataFrame([(i, y, c, d, v) for i, a, b, c, d, v in made for y in range(a, b)], "image_id long, line long, x0 long, x1 long, level long")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
        got = {r.image_id: (r.dhash, r.mean, r.thumb) for r in fingerprints.drawn_fingerprints(images, blocks).collect()}
        same = {r.image_id: (r.dhash, r.mean, r.thumb) for r in fingerprints.drawn_fingerprints(images, lines).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got == same and set(got) == set(range(60))
    for i, (dhash, mean, thumb) in got.items():
        grey = np.zeros((20 + i % 7, 30 + i % 5), dtype=int)
        for _, a, b, c, d, v in (m for m in made if m[0] == i):
            grey[max(a, 0) : max(b, 0), max(c, 0) : max(d, 0)] += v
        assert (dhash, mean) == (bits_by_hand(grey), grey.mean()) and np.allclose(thumb, fingerprints.thumbnail(grey), atol=1e-3)
