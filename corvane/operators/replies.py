"""Boxes in the free text of a model's replies."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corvane.operators.vocabulary import mapped_names


@F.pandas_udf(StringType())
def first_array(texts: pd.Series) -> pd.Series:
    """The text from its first [ to the bracket that closes it, code fences left out; null if none does.

    Brackets count wherever they stand, also inside strings.
    """

    def cut(text: str | None) -> str | None:
        bare, depth, begin = re.sub(r"```(?:json)?", "", text or ""), 0, None
        for bracket in re.finditer(r"[\[\]]", bare):
            opens = bracket.group() == "["
            if begin is None and not opens:
                continue
            begin = bracket.start() if begin is None else begin
            depth += 1 if opens else -1
            if depth == 0:
                return bare[begin : bracket.end()]
        return None

    return texts.map(cut)


def reply_boxes(replies: DataFrame, categories: DataFrame) -> DataFrame:
    """Detections (image_id, category_id, x, y, w, h, score) read from replies (image_id, width, height, text).

    A reply's first JSON array holds objects with class, box_2d (four numbers, corners in any order) and
    confidence. Boxes are clipped to the image; those of an unknown class, without four numbers, or thinner than
    a pixel are left out. A score that is missing or no number is 0.5, others are clipped to 0..1. Replies
    without an array, or with one that is no JSON, give no rows.
    """
    json = lambda c, schema: F.from_json(c, schema, {"allowSingleQuotes": "false"})
    items = replies.withColumn("_a", first_array("text")).select("image_id", "width", "height", F.explode(json("_a", "array<string>")).alias("_i"))
    item = items.withColumn("_i", json("_i", "class string, box_2d string, confidence string")).select("image_id", "width", "height", F.btrim("_i.class").alias("name"), json("_i.box_2d", "array<string>").alias("_b"), F.col("_i.confidence").alias("_s"))
    known = mapped_names(item.where("size(_b) = 4"), categories).where("category_id is not null")
    number = known.withColumns({f"_{i}": F.get("_b", i).try_cast("double") for i in range(4)}).where("_0 is not null and _1 is not null and _2 is not null and _3 is not null")
    inside = lambda k, size: F.greatest(F.lit(0.0), F.least(F.col(k), F.col(size).cast("double")))
    ends = number.withColumns({"_0": inside("_0", "width"), "_2": inside("_2", "width"), "_1": inside("_1", "height"), "_3": inside("_3", "height")})
    said = F.col("_s").try_cast("double")
    score = F.when(said.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), said)))
    boxes = ends.select("image_id", "category_id", F.least("_0", "_2").alias("x"), F.least("_1", "_3").alias("y"), F.abs(F.col("_2") - F.col("_0")).alias("w"), F.abs(F.col("_3") - F.col("_1")).alias("h"), score.alias("score"))
    return boxes.where("w >= 1 and h >= 1")
