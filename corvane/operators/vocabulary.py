"""Class names: mapping one vocabulary to another, and corpora to one vocabulary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.gates import refused


def mapped_names(names: DataFrame, categories: DataFrame) -> DataFrame:
    """names (name) with category_id of the category (category_id, name) of that name, else of that name in lower case; null if none has it.

    Of several categories with one name the greatest id stands.
    """
    exact = categories.groupBy("name").agg(F.max("category_id").alias("_exact"))
    lower = categories.groupBy(F.lower("name").alias("_lower")).agg(F.max("category_id").alias("_any"))
    met = names.join(exact, "name", "left").withColumn("_lower", F.lower("name")).join(lower, "_lower", "left")
    return met.select(*names.columns, F.coalesce("_exact", "_any").alias("category_id"))


def unmapped(names: DataFrame, categories: DataFrame) -> DataFrame:
    """Names that no category has."""
    return mapped_names(names, categories).where(F.col("category_id").isNull()).select("name").distinct()


def fully_mapped(names: DataFrame, categories: DataFrame) -> DataFrame:
    """mapped_names(), which stops the job at a name that no category has."""
    return refused(mapped_names(names, categories), F.col("category_id").isNull(), F.concat(F.lit("no such class: "), F.coalesce("name", F.lit("null"))))


def focused(annotations: DataFrame, categories: DataFrame, names: DataFrame) -> DataFrame:
    """Annotations of the classes with these names; a name that no category has stops the job."""
    return annotations.join(fully_mapped(names, categories).select("category_id").distinct(), "category_id", "left_semi")


def head_sizes(annotations: DataFrame, images: DataFrame, renamed: dict[str, str] | None = None) -> DataFrame:
    """Per split, under the name that `renamed` gives it, the classes that a detector's head needs: the greatest id and one."""
    split = F.col("split")
    for old, new in (renamed or {}).items():
        split = F.when(F.col("split") == old, new).otherwise(split)
    met = annotations.join(images.select("image_id", split.alias("split")), "image_id")
    return met.groupBy("split").agg((F.max("category_id") + 1).alias("num_classes"))


def one_class_corpus(sets: dict[str, DataFrame], category_id: int = 1) -> DataFrame:
    """External sets (file_name and columns of their own) as one class: file_name behind its set's name, provenance, category_id.

    Names can't clash as each set has its own prefix. Rows without a file are left out.
    """
    named = [rows.where("file_name is not null").withColumns({"file_name": F.concat(F.lit(f"{k}_"), F.col("file_name")), "provenance": F.lit(k), "category_id": F.lit(category_id).cast("long")}) for k, rows in sets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def revocabulary(annotations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Annotations under the ids (new_id) that mapping (category_id, new_id) gives their class; others are dropped."""
    return annotations.join(mapping.select("category_id", "new_id"), "category_id").drop("category_id").withColumnRenamed("new_id", "category_id")


def with_annotations(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images with at least one annotation."""
    return images.join(annotations.select("image_id"), "image_id", "left_semi")


def vocabulary_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Names that one side has and the other has not: name, side."""
    a, b = left.select("name").distinct(), right.select("name").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def merged_corpora(first: DataFrame, second: DataFrame, key: str = "file_name") -> DataFrame:
    """Rows of both with provenance (first or second); of rows with one key those of the first stand."""
    return first.withColumn("provenance", F.lit("first")).unionByName(second.join(first.select(key), key, "left_anti").withColumn("provenance", F.lit("second")), allowMissingColumns=True)
