"""Readers and writers of label text, annotation JSON, class names and files with checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.ranges import numbered

COCO = (
    "images array<struct<id:long,file_name:string,width:int,height:int>>, categories array<struct<id:long,name:string>>, "
    "annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,area:double,iscrowd:int,segmentation:string>>"
)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """stem, line_no (from 1) and line of label files; blank lines are no rows."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^.]*$", 1).alias("stem"), "value")
    lines = files.select("stem", F.posexplode(F.split("value", "\n")).alias("_at", "line"))
    return lines.where(F.btrim("line") != "").select("stem", (F.col("_at") + 1).alias("line_no"), F.rtrim("line").alias("line"))


def read_coco(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """images, categories and annotations of documents. A document is one task; write the result once as Parquet."""
    doc = spark.read.schema(COCO).json(path, multiLine=True)
    return {k: doc.select(F.inline(k)) for k in ("images", "categories", "annotations")}


def read_class_names(spark: SparkSession, path: str) -> DataFrame:
    """category_id (from 1) and name of a `names:` mapping with numeric keys, or of one name a line."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("_at", "_line"))
    parsed = lines.select("_at", "_line", F.regexp_extract("_line", r"^\s*(\d+)\s*:\s*(.+?)\s*$", 1).alias("_k"), F.regexp_extract("_line", r"^\s*(\d+)\s*:\s*(.+?)\s*$", 2).alias("_v"))
    keyed = parsed.withColumn("_any", F.max(F.col("_k") != "").over(Window.partitionBy()))
    named = keyed.select(F.when(F.col("_any"), F.when(F.col("_k") != "", F.col("_k").cast("long"))).otherwise(F.col("_at").cast("long")).alias("_n"), F.btrim(F.when(F.col("_any"), F.col("_v")).otherwise(F.btrim("_line")), F.lit("'\"")).alias("name"))
    return named.where(F.col("_n").isNotNull() & (F.col("name") != "")).select(F.row_number().over(Window.orderBy("_n")).cast("long").alias("category_id"), "name")


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """run, epoch, time_s, metric of CSV logs, one a run: columns are found by part of their padded names, runs by their folder."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    named = {c.strip().lower(): c for c in raw.columns}

    def column(*parts: str):
        found = next((c for k, c in named.items() if any(p in k for p in parts)), None)
        return (F.lit(None) if found is None else F.col(f"`{found}`")).try_cast("double")

    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1)
    return raw.select(run.alias("run"), column("epoch").cast("int").alias("epoch"), column("time").alias("time_s"), column("map50-95", "metric").alias("metric"))


def read_predictions(spark: SparkSession, path: str, segmentation: bool = False) -> tuple[DataFrame, DataFrame]:
    """Detections with the model that the file's name gives, and (model, n_read) of files with text that is no JSON. A file is one task.

    A file is a list of detections, or an object with such a list as its annotations. With segmentation, detections
    have that column too, in JSON as it stands.
    """
    one = "image_id long, category_id long, bbox array<double>, score double, segmentation string"
    kind = ", ".join(f"{k}:{t}" for k, t in (f.rsplit(" ", 1) for f in one.split(", ")))
    rows = spark.read.schema(f"{one}, annotations array<struct<{kind}>>, _corrupt string").json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    named = rows.withColumn("model", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^.]*$", 1))
    own = F.struct("image_id", "category_id", "bbox", "score", "segmentation")
    each = named.select("model", "_corrupt", F.explode_outer(F.when(F.col("annotations").isNull() & F.col("image_id").isNotNull(), F.array(own)).otherwise(F.col("annotations"))).alias("_d"))
    good = each.where("_corrupt is null and _d is not null").select("model", "_d.image_id", "_d.category_id", *(F.get("_d.bbox", i).alias(k) for i, k in enumerate("xywh")), "_d.score", *(["_d.segmentation"] if segmentation else []))
    read = each.groupBy("model").agg(F.count("_d.image_id").alias("n_read"), F.count("_corrupt").alias("_bad"))
    return good, read.where("_bad > 0").drop("_bad")


#: Extensions of images, in lower case; fixed values.
IMAGES = ("bmp", "jpeg", "jpg", "png", "tif", "tiff", "webp")


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """file_name, width, height and problem (null, or unreadable) of a folder's images, by their extensions in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    named = files.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*IMAGES))
    sizes = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path).select(F.col("image.origin").alias("_o"), "image.width", "image.height")
    bare = lambda c: F.regexp_replace(c, r"^file:/+", "/")  # noqa: E731  the two readers name local files differently
    met = named.withColumn("_p", bare("path")).join(sizes.withColumn("_p", bare("_o")), "_p", "left")
    return met.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "width", "height", F.when(F.col("width").isNull(), "unreadable").alias("problem"))


def image_manifest(images: DataFrame) -> DataFrame:
    """Readable images (file_name, width, height) numbered from 1 by name, the pool to be labelled."""
    return numbered(images.where(F.col("width").isNotNull()).select("file_name", "width", "height"), ["file_name"], "image_id")


def checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, bytes and sha256 of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and what happened (added, removed, changed) between two checksum tables."""
    a, b = old.select("path", F.col("sha256").alias("_a")), new.select("path", F.col("sha256").alias("_b"))
    what = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, "path", "full_outer").select("path", what.alias("what")).where("what is not null")


def pending(keys: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys that have no row in done."""
    return keys.join(done.select(key), key, "left_anti")


def write_labels(labels: DataFrame, path: str) -> None:
    """Label lines (split, line) as text, a folder for each split."""
    labels.select("split", "line").write.partitionBy("split").mode("overwrite").text(path)


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str) -> None:
    """A corpus as JSON lines, a folder for each of images, annotations and categories; no document is put together in one task."""
    for name, rows in (("images", images), ("annotations", annotations), ("categories", categories)):
        rows.write.mode("overwrite").json(f"{path}/{name}")


def write_split(images: DataFrame, path: str, seed: int) -> None:
    """Lists of file names, a folder for each split, and a manifest of one JSON line: seed and counts of files and patients."""
    images.select("split", "file_name").write.partitionBy("split").mode("overwrite").text(f"{path}/lists")
    counts = images.groupBy("split").agg(F.count(F.lit(1)).alias("images"), F.count_distinct("patient").alias("patients"))
    manifest = counts.agg(F.array_sort(F.collect_list(F.struct("split", "images", "patients"))).alias("counts")).select(F.lit(seed).alias("seed"), "counts")
    manifest.write.mode("overwrite").json(f"{path}/manifest")


def markdown(table: DataFrame, most: int = 1000) -> str:
    """A report's table as Markdown. It must have `most` rows or fewer: classes or models, not data."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(table.columns), line(["---"] * len(table.columns)), *(line(map(cell, r)) for r in rows)])
