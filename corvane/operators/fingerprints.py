"""Fingerprints of grey pictures: difference hashes and thumbnails by exact area averages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.functions.parts import finely
from corvane.functions.streams import begins, streamed

#: Side of a thumbnail.
SIDE = 128


def shares(size: int, cells: int) -> np.ndarray:
    """How much of each of `size` pixels lies in each of `cells` equal cells, in parts of 1 / cells of a pixel: whole numbers."""
    cell, pixel = np.arange(cells)[:, None] * size, np.arange(size) * cells
    return np.clip(np.minimum(cell + size, pixel + cells) - np.maximum(cell, pixel), 0, None)


def area_sums(grey: np.ndarray, lines: int, columns: int) -> np.ndarray:
    """Sums of whole grey values over lines x columns cells, exact; divided by the picture's pixels they are averages."""
    return shares(grey.shape[0], lines) @ grey.astype(np.int64) @ shares(grey.shape[1], columns).T


def difference_hash(grey: np.ndarray) -> int:
    """64 bits, as a signed number: whether each of 9 x 8 averages is less than the one to its right, line by line, the first bit highest."""
    sums = area_sums(grey, 8, 9)
    value = int("".join("01"[b] for b in (sums[:, 1:] > sums[:, :-1]).ravel().astype(int)), 2)
    return value - (1 << 64) if value >> 63 else value


def thumbnail(grey: np.ndarray) -> np.ndarray:
    return (area_sums(grey, SIDE, SIDE) / grey.size).ravel()


def grey_of(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Whole grey values of a decoded picture, whose channels come as blue, green, red or as one."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return pixels[:, :, 0].astype(np.int64)
    return np.floor(pixels[:, :, :3] @ np.array([0.114, 0.587, 0.299]) + 0.5).astype(np.int64)


_PRINT = [T.StructField("dhash", T.LongType()), T.StructField("thumb", T.ArrayType(T.FloatType()))]


def picture_fingerprints(pictures: DataFrame) -> DataFrame:
    """file_name, width, height, dhash and thumb (128 x 128) of rows of Spark's image source.

    Pictures that could not be decoded have nulls. Write the result once: everything later works on it, and a
    picture is decoded once only. One row at a time is in Python.
    """
    name = F.regexp_extract("image.origin", r"([^/]+)$", 1).alias("file_name")
    given = pictures.select(name, *(F.col(f"image.{k}").alias(k) for k in ("height", "width", "nChannels", "data")))
    schema = T.StructType([T.StructField("file_name", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), *_PRINT])

    def prints(rows: Iterator[tuple]) -> Iterator[tuple]:
        for file, height, width, channels, data in rows:
            if not data or height is None or height <= 0 or width <= 0:
                yield file, None, None, None, None
                continue
            grey = grey_of(data, height, width, channels)
            yield file, width, height, difference_hash(grey), thumbnail(grey).tolist()

    return given.mapInArrow(streamed(prints, schema, 200), schema)


def block_sums(picture: np.ndarray, height: np.ndarray, width: np.ndarray, blocks: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
    """area_sums of 8 x 9 cells for many pictures, each the sum of its blocks (line, stop, x0, x1, level), without drawing them.

    picture numbers each block's picture, falling nowhere; height and width are the blocks' pictures'.
    """
    sums = np.zeros((int(picture[-1]) + 1, 8, 9), dtype=np.int64)

    def covered(begin: np.ndarray, end: np.ndarray, size: np.ndarray, cells: int) -> np.ndarray:
        cell = size[:, None] * np.arange(cells + 1)
        return np.clip(np.minimum(cells * end[:, None], cell[:, 1:]) - np.maximum(cells * begin[:, None], cell[:, :-1]), 0, None)

    for k in range(0, len(picture), at_once):
        own, (line, stop, x0, x1, level) = picture[k : k + at_once], blocks[:, k : k + at_once]
        down, along = covered(line, stop, height[k : k + at_once], 8), covered(x0, x1, width[k : k + at_once], 9) * level[:, None]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        sums[own[first]] += np.add.reduceat(down[:, :, None] * along[:, None, :], first)
    return sums


def drawn_fingerprints(images: DataFrame, runs: DataFrame, thumbs: bool = True) -> DataFrame:
    """image_id, dhash, thumb (null if not asked for) and mean of pictures drawn from runs (image_id, line, x0, x1, level): levels add up where runs overlap.

    Runs may have stop, the line after their last one, and are blocks of lines then. images have image_id, height
    and width in the runs' cells; one without a size has nulls. What lies outside is cut off; a picture without
    runs is blank. Images and runs are shuffled by image once, together. Hashes and means come from how much of
    each cell a run covers, of a batch's pictures at once; only thumbnails are drawn, one picture at a time.
    """
    places = ("line", "stop", "x0", "x1", "level")
    long = lambda k: F.col(k).cast("long").alias(k)
    none = lambda *names: [F.lit(None).cast("long").alias(k) for k in names]
    sized = images.select("image_id", F.lit(0).alias("kind"), long("height"), long("width"), *none(*places))
    stop = long("stop") if "stop" in runs.columns else (F.col("line") + 1).cast("long").alias("stop")
    drawn = runs.where(F.col("image_id").isNotNull()).select("image_id", F.lit(1).alias("kind"), *none("height", "width"), long("line"), stop, *map(long, places[2:]))
    ordered = finely(sized.unionByName(drawn), "image_id").sortWithinPartitions("image_id", "kind")
    schema = T.StructType([images.schema["image_id"], *_PRINT, T.StructField("mean", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def made(ids: pa.Array, size: np.ndarray, copies: np.ndarray, sums: np.ndarray, greys: list) -> pa.RecordBatch:
        here = copies > 0  # else runs of no image
        (height, width), sums = size[:, here], sums[here] * copies[here, None, None]
        blank = (height <= 0) | (width <= 0)
        hashes = np.packbits((sums[:, :, 1:] > sums[:, :, :-1]).reshape(-1, 64), axis=1).view(">i8")[:, 0].astype(np.int64)
        means = sums.sum((1, 2)) // 72 / np.where(blank, 1, height * width)
        thumb = [None if not thumbs or b else (thumbnail(g) * c).tolist() for g, b, c in zip((g for g, h in zip(greys, here, strict=True) if h), blank, copies[here], strict=True)]
        return pa.RecordBatch.from_arrays([ids.filter(pa.array(here)).cast(arrow.field(0).type), pa.array(hashes, pa.int64(), mask=blank), pa.array(thumb, arrow.field("thumb").type), pa.array(means, pa.float64(), mask=blank)], schema=arrow)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the picture that a batch has ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            new = begins(pa.Table.from_batches([batch]), ["image_id"])
            first, picture = np.flatnonzero(new), np.cumsum(new) - 1
            column = {k: batch.column(k).fill_null(0).to_numpy(zero_copy_only=False) for k in ("kind", "height", "width", *places)}
            ids, size = batch.column("image_id").take(pa.array(first)), np.stack([column["height"][first], column["width"][first]])
            cut = last is not None and last[0][0] == ids[0]
            if cut:
                size[:, 0] = last[1][:, 0]
            blocks = np.stack([column[k] for k in places])
            copies = np.add.reduceat((column["kind"] == 0).astype(np.int64), first)
            sums = block_sums(picture, size[0, picture], size[1, picture], blocks)
            greys: list = [np.zeros(np.maximum(s, 0), dtype=np.int64) for s in size.T] if thumbs else [None] * len(first)
            if cut:
                copies[0] += last[2][0]
                sums[0] += last[3][0]
                greys[0] = last[4][0]
            elif last is not None:
                yield made(*last)
            if thumbs:
                for p, (line, stop, x0, x1, level) in zip(picture.tolist(), np.maximum(blocks, [[0], [0], [0], [0], [np.iinfo(np.int64).min]]).T.tolist(), strict=True):
                    greys[p][line:stop, x0:x1] += level
            if len(first) > 1:
                yield made(ids[:-1], size[:, :-1], copies[:-1], sums[:-1], greys[:-1])
            last = ids[-1:], size[:, -1:], copies[-1:], sums[-1:], greys[-1:]
        if last is not None:
            yield made(*last)

    return ordered.mapInArrow(prints, schema)
