"""Registered queries of pictures drawn from annotations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import evaluation, fingerprints
from corvane.plans import views
from corvane.plans.registry import registered

_DRAWN = """sized AS (SELECT image_id, split, ceil(width / 8.0)::BIGINT AS w8, ceil(height / 8.0)::BIGINT AS h8 FROM v_img),
boxes AS (SELECT a.image_id, category_id AS level, x // 8 AS x0, (x + w) // 8 AS x1, y // 8 AS y0, (y + h) // 8 AS y1 FROM v_ann a),
spots AS (SELECT image_id, w8, h8, i, j FROM sized, (SELECT unnest(range(0, 8)) AS i), (SELECT unnest(range(0, 9)) AS j)),
sums AS (SELECT s.image_id, i, j, coalesce(sum(level * greatest(0, least(9 * x1, w8 * (j + 1)) - greatest(9 * x0, w8 * j)) * greatest(0, least(8 * y1, h8 * (i + 1)) - greatest(8 * y0, h8 * i))), 0)::BIGINT AS s FROM spots s LEFT JOIN boxes USING (image_id) GROUP BY 1, 2, 3),
bits AS (SELECT l.image_id, 63 - 8 * l.i - l.j AS place, r.s > l.s AS b FROM sums l JOIN sums r ON r.image_id = l.image_id AND r.i = l.i AND r.j = l.j + 1),
prints AS (SELECT image_id, (sum(CASE WHEN b AND place < 63 THEN 1::HUGEINT << place::INTEGER ELSE 0 END) - max(CASE WHEN b AND place = 63 THEN 9223372036854775808::HUGEINT ELSE 0 END))::BIGINT AS dhash FROM bits GROUP BY 1)"""


def pictures(spark: SparkSession, d: str) -> DataFrame:
    """Boxes drawn on cells of 8 pixels, as light as their class's number."""
    grid = lambda k: F.ceil(F.col(k) / 8).cast("int").alias(k)
    images = views.images(spark, d).select("image_id", grid("height"), grid("width"))
    blocks = evaluation.box_blocks(views.annotations(spark, d), 8, ("image_id", "category_id")).withColumnRenamed("category_id", "level")
    return fingerprints.drawn_fingerprints(images, blocks, thumbs=False)


@registered(f"WITH {_DRAWN} SELECT p.image_id, dhash, coalesce(sum(level * (x1 - x0) * (y1 - y0)), 0) / any_value(w8 * h8) AS mean FROM prints p JOIN sized USING (image_id) LEFT JOIN boxes USING (image_id) GROUP BY 1, 2")
def drawn_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return pictures(spark, d).select("image_id", "dhash", "mean")
