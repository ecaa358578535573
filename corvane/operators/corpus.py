"""Corpora: class counts, weights, splits, subsets and sampling plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.gates import refused
from corvane.functions.geometry import box_iou, box_polygon, polygon_bbox, scaled, shoelace_area
from corvane.functions.keys import hash32, uniform
from corvane.functions.parts import finely
from corvane.functions.ranges import numbered, quantiles, running_sums
from corvane.operators.audit import typed_lines


def size_group(n: str, head_min: int = 5000, tail_max: int = 100):
    """head above head_min, tail below tail_max, else mid."""
    return F.when(F.col(n) > head_min, "head").when(F.col(n) < tail_max, "tail").otherwise("mid")


def class_counts(annotations: DataFrame, images: DataFrame, splits=("train", "valid", "test")) -> DataFrame:
    """Per class: instances and distinct images of each split.

    Annotations are counted by image and class, then by class: a distinct count needs no set of images. Both tables are
    dealt by image, finely, and nothing else is shuffled but counts.
    """
    per = finely(annotations.select("image_id", "category_id"), "image_id").groupBy("image_id", "category_id").agg(F.count(F.lit(1)).alias("_n"))
    named = finely(images.select("image_id", "split"), "image_id").groupBy("image_id", "split").agg(F.count(F.lit(1)).alias("_times"))
    wide = per.join(named, "image_id").groupBy("category_id").pivot("split", list(splits)).agg(F.sum(F.col("_n") * F.col("_times")).alias("n"), F.count(F.lit(1)).alias("images"))
    return wide.select("category_id", *(F.coalesce(f"{s}_{k}", F.lit(0)).alias(f"{s}_{k}") for s in splits for k in ("n", "images")))


def image_frequency(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Per class: distinct images with it over all images."""
    total = images.agg(F.count(F.lit(1)).alias("_all"))
    return annotations.groupBy("category_id").agg(F.count_distinct("image_id").alias("n_images")).join(F.broadcast(total)).select("category_id", "n_images", (F.col("n_images") / F.col("_all")).alias("frequency"))


def repeat_factors(annotations: DataFrame, images: DataFrame, threshold: float) -> DataFrame:
    """Per image: the largest of max(1, sqrt(threshold / f)) over its classes; 1 for an empty image."""
    factor = F.greatest(F.lit(1.0), F.sqrt(F.lit(threshold) / F.col("frequency")))
    per = annotations.select("image_id", "category_id").join(image_frequency(annotations, images), "category_id").groupBy("image_id").agg(F.max(factor).alias("_f"))
    return images.select("image_id").join(per, "image_id", "left").select("image_id", F.coalesce("_f", F.lit(1.0)).alias("repeat_factor"))


def epoch(factors: DataFrame, seed: int, number: int) -> DataFrame:
    """An epoch's list: each image floor(r) times and once more with the chance of the rest, in hashed order."""
    key = F.concat(F.lit(f"{seed + number}/"), F.col("image_id"))
    copies = F.floor("repeat_factor") + (uniform(key) < F.col("repeat_factor") - F.floor("repeat_factor")).cast("long")
    rows = factors.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(copies, F.lit(1)))))
    return rows.select("image_id", "copy", hash32(F.concat(F.lit(f"{seed + number}/"), F.col("image_id"), F.lit("/"), F.col("copy"))).alias("order_key"))


def class_weights(counts: DataFrame, beta: float = 0.999, tau: float = 1.0) -> DataFrame:
    """Per class (category_id, n): prior (absent classes get the least count), logit shift, and normalised weights."""
    every = Window.partitionBy()
    seen = F.coalesce(F.nullif(F.col("n"), F.lit(0)), F.min(F.when(F.col("n") > 0, F.col("n"))).over(every))
    prior = counts.withColumn("_seen", seen).withColumn("prior", F.col("_seen") / F.sum("_seen").over(every))
    number = F.when(F.col("n") > 0, (1 - beta) / (1 - F.pow(F.lit(beta), F.col("n"))))
    raw = prior.withColumns({"_e": F.coalesce(number, F.max(number).over(every)), "_i": 1 / F.sqrt(F.greatest(F.col("n"), F.lit(1)))})
    return raw.select(
        "category_id",
        "n",
        "prior",
        (-tau * F.ln("prior")).alias("logit_shift"),
        F.when(F.col("n") > 0, F.ln(F.col("n") / F.sum("n").over(every))).otherwise(0.0).alias("log_prior_or_zero"),
        (F.col("_e") / F.avg("_e").over(every)).alias("effective_number"),
        (F.col("_i") / F.avg("_i").over(every)).alias("inverse_sqrt"),
    )


def group_weights(weights: DataFrame, head_min: int, tail_max: int) -> DataFrame:
    """Mean weight of each scheme in head, mid and tail classes."""
    long = weights.withColumn("grp", size_group("n", head_min, tail_max)).unpivot(["category_id", "grp"], ["effective_number", "inverse_sqrt"], "scheme", "weight")
    return long.groupBy("scheme", "grp").agg(F.avg("weight").alias("mean_weight"), F.count(F.lit(1)).alias("n_classes"))


def restricted(annotations: DataFrame, images: DataFrame, keep: DataFrame) -> DataFrame:
    """Annotations of the kept classes under contiguous new ids in the old order, and images left empty as rows without one."""
    ids = keep.select("category_id").distinct().withColumn("new_id", F.row_number().over(Window.orderBy("category_id")))
    kept = annotations.join(ids, "category_id").select("image_id", "ann_key", "new_id")
    return images.select("image_id").join(kept, "image_id", "left")


def fraction_subset(annotations: DataFrame, images: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Images drawn in each stratum (an image's rarest class, -1 without one): half-even rounded, one at least."""
    freq = annotations.groupBy("category_id").agg(F.count_distinct("image_id").alias("f"))
    rare = annotations.join(freq, "category_id").groupBy("image_id").agg(F.min_by("category_id", F.struct("f", "category_id")).alias("stratum"))
    named = images.select("image_id").join(rare, "image_id", "left").select("image_id", F.coalesce("stratum", F.lit(-1).cast("long")).alias("stratum"))
    sizes = named.groupBy("stratum").agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * fraction)).alias("_most"))
    order = [F.md5(F.concat(F.lit(f"{seed}/"), F.col("image_id"))), "image_id"]
    ranked = running_sums(named, ["stratum"], order, {"_r": F.lit(1).cast("long")})
    return ranked.join(sizes, "stratum").where(F.col("_r") <= F.col("_most")).select("image_id", "stratum")


def quota_split(annotations: DataFrame, images: DataFrame, group: str, ratios=(0.7, 0.15, 0.15), seed: int = 0) -> DataFrame:
    """group and split: groups, stratified by their rarest class, cut at cumulative shares of files in hashed order."""
    named = annotations.join(images.select("image_id", group), "image_id")
    freq = annotations.groupBy("category_id").agg(F.count(F.lit(1)).alias("f"))
    rare = named.join(freq, "category_id").groupBy(group).agg(F.min_by("category_id", F.struct("f", "category_id")).alias("stratum"))
    sized = images.groupBy(group).agg(F.count(F.lit(1)).alias("n_files")).join(rare, group, "left").withColumn("stratum", F.coalesce("stratum", F.lit(-1).cast("long")))
    order = [F.md5(F.concat(F.lit(f"{seed}/"), F.col(group))), group]
    summed = running_sums(sized, ["stratum"], order, {"_upto": F.col("n_files")})
    totals = sized.groupBy("stratum").agg(F.sum("n_files").alias("_all"))
    share = (F.col("_upto") - F.col("n_files")) / F.col("_all")
    split = F.when(share < ratios[0], "train").when(share < ratios[0] + ratios[1], "valid").otherwise("test")
    return summed.join(totals, "stratum").select(group, "stratum", "n_files", split.alias("split"))


def denoised(annotations: DataFrame, suspects: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """Annotations that no suspect of the same image and class overlaps by least_iou or more."""
    s = suspects.select(F.col("image_id").alias("_i"), F.col("category_id").alias("_c"), *(F.col(k).alias(f"s_{k}") for k in "xywh"))
    a = annotations.withColumnsRenamed({k: f"a_{k}" for k in "xywh"})
    kept = a.join(s, (F.col("image_id") == F.col("_i")) & (F.col("category_id") == F.col("_c")) & (box_iou("a_", "s_") >= least_iou), "left_anti")
    return kept.withColumnsRenamed({f"a_{k}": k for k in "xywh"})


def pseudo_labels(detections: DataFrame, images: DataFrame, least_score: float = 0.9, most: int = 100) -> DataFrame:
    """Label lines of sure detections, clipped and normalised; the first `most` of an image in input order; empty images keep a null line.

    A line has the detection's polygon where detections have that column and it has three points or more, else its box.
    """
    ids = detections.select("category_id").distinct().withColumn("class_id", F.dense_rank().over(Window.orderBy("category_id")) - 1)
    sure = detections.where(F.coalesce("score", F.lit(0.0)) >= least_score).withColumn("_n", F.row_number().over(Window.partitionBy("image_id").orderBy("ann_key"))).where(F.col("_n") <= most)
    sized = sure.join(images.select("image_id", "width", "height"), "image_id").join(ids, "category_id")
    d = lambda k: F.col(k).cast("double")
    polygon = box_polygon(d("x"), d("y"), d("w"), d("h"), d("width"), d("height"))
    if "polygon" in detections.columns:
        polygon = F.when(F.size("polygon") >= 6, F.col("polygon")).otherwise(polygon)
    unit = F.transform(polygon, lambda v, i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / F.when(i % 2 == 0, F.col("width")).otherwise(F.col("height")))))
    line = F.concat_ws(" ", F.col("class_id"), F.transform(unit, lambda v: F.format_string("%.6f", v)))
    return images.select("image_id").join(sized.where(polygon.isNotNull()).select("image_id", line.alias("line")), "image_id", "left")


def hold_out(images: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """image_id and split: max(1, floor(n * fraction)) images in hashed order go to valid.

    The cut is the hash of that rank, looked for only among hashes that share the first four digits with it.
    """
    hashed = images.select("image_id", F.md5(F.concat(F.lit(f"{seed}/"), F.col("image_id"))).alias("_h")).withColumn("_p", F.substring("_h", 1, 4))
    upto, total = F.sum("_n").over(Window.orderBy("_p")), F.sum("_n").over(Window.partitionBy())
    heads = hashed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumns({"_upto": upto, "_k": F.greatest(F.lit(1), F.floor(total * fraction))})
    edge = heads.where("_upto >= _k and _upto - _n < _k").select("_p", (F.col("_k") - F.col("_upto") + F.col("_n")).alias("_need"))
    near = hashed.join(edge, "_p").withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_h")))
    cut = near.where("_r = _need").select(F.col("_h").alias("_cut"))
    return hashed.join(F.broadcast(cut)).select("image_id", F.when(F.col("_h") <= F.col("_cut"), "valid").otherwise("train").alias("split"))


def paste_plan(annotations: DataFrame, images: DataFrame, max_count: int, copies: int = 2, tries: int = 20, seed: int = 0) -> DataFrame:
    """Where instances of rare classes are pasted: copy, host image, try and box; the first try that fits and overlaps no box by more than 0.1.

    Hosts are images of the same class's copy number, drawn by hash; scales lie in 0.8..1.2.
    """
    counts = annotations.groupBy("category_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= max_count)
    rare = annotations.join(counts.select("category_id"), "category_id").where((F.col("w") >= 4) & (F.col("h") >= 4))
    hosts_n = images.agg(F.count(F.lit(1)).alias("_hosts"))
    u = lambda what: uniform(F.concat(F.lit(f"{seed}/{what}/"), F.col("ann_key"), F.lit("/"), F.col("copy"), F.lit("/"), F.col("try")))
    at = numbered(images.select(F.col("image_id").alias("host_id"), "width", "height"), ["host_id"], "_host").withColumn("_host", F.col("_host") - 1)
    drawn = F.floor(uniform(F.concat(F.lit(f"{seed}/host/"), F.col("ann_key"), F.lit("/"), F.col("copy"))) * F.col("_hosts"))
    planned = rare.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).join(F.broadcast(hosts_n)).withColumn("_host", drawn)
    tried = planned.join(at, "_host").withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    scale = 0.8 + 0.4 * uniform(F.concat(F.lit(f"{seed}/scale/"), F.col("ann_key"), F.lit("/"), F.col("copy")))
    sized = tried.withColumns({"p_w": F.floor(F.col("w") * scale), "p_h": F.floor(F.col("h") * scale)}).where("p_w < width and p_h < height")
    placed = sized.withColumns({"p_x": F.floor(u("x") * (F.col("width") - F.col("p_w"))), "p_y": F.floor(u("y") * (F.col("height") - F.col("p_h")))})
    hosts = annotations.select(F.col("image_id").alias("host_id"), *(F.col(k).alias(f"b_{k}") for k in "xywh"))
    free = placed.join(hosts, (placed["host_id"] == hosts["host_id"]) & (box_iou("p_", "b_") > 0.1), "left_anti")
    first = F.row_number().over(Window.partitionBy("ann_key", "copy").orderBy("try"))
    return free.withColumn("_r", first).where("_r = 1").select("ann_key", "category_id", "copy", "host_id", "try", "p_x", "p_y", "p_w", "p_h")


def converted(lines: DataFrame, n_classes: int) -> DataFrame:
    """Annotations of well-formed label lines (line, width, height): category_id (from 1), polygon in pixels, clamped to the image, bbox and area.

    Lines with a bad class, fewer than three points, an odd number of values or one that is no finite number are
    left out; an area below 1 marks those that a converter drops.
    """
    typed = typed_lines(lines)
    good = typed.where(F.col("class_id").between(0, n_classes - 1) & (F.size("_v") >= 6) & (F.size("_v") % 2 == 0) & ~F.exists("_v", lambda v: v.isNull()))
    placed = good.withColumn("category_id", F.col("class_id") + 1).withColumn("polygon", F.explode(F.array(scaled(F.col("_v"), F.col("width"), F.col("height")))))
    return placed.withColumns({"bbox": polygon_bbox(F.col("polygon")), "area": shoelace_area(F.col("polygon"))}).drop("class_id", "_v")


def conversion_report(images: DataFrame, lines: DataFrame, n_classes: int, strict: bool = False) -> DataFrame:
    """One row on label lines (image_id, line, width, height) and images: n_images, n_negatives, n_empty, n_annotations, n_dropped.

    Negatives are images without a label file, which stay in the corpus; empty ones have a file without a line
    that becomes an annotation. Dropped are lines that break a rule and those of less than a pixel. With strict,
    a line that is no list of numbers stops the job.
    """
    files = lines.select("image_id").distinct().withColumn("_file", F.lit(True))
    if strict:
        checked = typed_lines(lines)
        broken = F.col("class_id").isNull() | F.exists("_v", lambda v: v.isNull()) | (F.size("_v") % 2 == 1)
        lines = refused(checked, broken, F.concat(F.lit("malformed label line: "), "line")).select(*lines.columns)
    given = lines.where(F.btrim("line") != "").groupBy("image_id").agg(F.count(F.lit(1)).alias("_lines"))
    good = converted(lines, n_classes).where("area >= 1").groupBy("image_id").agg(F.count(F.lit(1)).alias("_good"))
    met = images.select("image_id").join(files, "image_id", "left").join(given, "image_id", "left").join(good, "image_id", "left")
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0))
    return met.agg(F.count(F.lit(1)).alias("n_images"), F.count_if(F.col("_file").isNull()).alias("n_negatives"), F.count_if(F.col("_file").isNotNull() & F.col("_good").isNull()).alias("n_empty"), total("_good").alias("n_annotations"), (total("_lines") - total("_good")).alias("n_dropped"))


def checked_split(images: DataFrame, annotations: DataFrame, group: str, train: str = "train") -> DataFrame:
    """verified_split(), which stops the job for a split that shares groups or lacks a class in train."""
    return refused(verified_split(images, annotations, group, train), (F.col("n_shared") > 0) | (F.col("n_absent_in_train") > 0), "the split shares groups or lacks classes in train")


def denoise_report(annotations: DataFrame, suspects: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """One row on denoised(): annotations kept and dropped, images that lost some, and images that lost all."""
    kept = denoised(annotations, suspects, least_iou).groupBy("image_id").agg(F.count(F.lit(1)).alias("_k"))
    met = annotations.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n")).join(kept, "image_id", "left").withColumn("_k", F.coalesce("_k", F.lit(0)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return met.agg(total("_k").alias("n_kept"), total(F.col("_n") - F.col("_k")).alias("n_dropped"), F.count_if(F.col("_k") < F.col("_n")).alias("n_touched"), F.count_if(F.col("_k") == 0).alias("n_emptied"))


def restriction_report(annotations: DataFrame, images: DataFrame, keep: DataFrame) -> DataFrame:
    """One row on restricted(): annotations kept and dropped, and images that had some and have none left."""
    marked = annotations.join(keep.select("category_id").distinct().withColumn("_kept", F.lit(1)), "category_id", "left")
    per = marked.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"), F.count("_kept").alias("_k")).join(images.select("image_id"), "image_id", "left_semi")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(total("_k").alias("n_kept"), total(F.col("_n") - F.col("_k")).alias("n_dropped"), F.count_if(F.col("_k") == 0).alias("n_emptied"))


def group_class_counts(annotations: DataFrame, images: DataFrame, group: str) -> DataFrame:
    """Instances of each class by group of images (a patient, say): a row for each pair that occurs."""
    return annotations.join(images.select("image_id", group), "image_id").groupBy(group, "category_id").agg(F.count(F.lit(1)).alias("n"))


def scheme_weights(counts: DataFrame, scheme: str | float) -> DataFrame:
    """Class weights by a named scheme: none, inverse_sqrt, or a number, the beta of effective numbers."""
    if scheme == "none":
        return counts.select("category_id", F.lit(1.0).alias("weight"))
    if scheme == "inverse_sqrt":
        return class_weights(counts).select("category_id", F.col("inverse_sqrt").alias("weight"))
    if isinstance(scheme, str):
        raise ValueError(f"no such scheme: {scheme}")
    return class_weights(counts, scheme).select("category_id", F.col("effective_number").alias("weight"))


def verified_split(images: DataFrame, annotations: DataFrame, group: str, train: str = "train") -> DataFrame:
    """One row: groups found in more than one split, and classes that the train split has not. A good split has neither."""
    shared = images.groupBy(group).agg(F.count_distinct("split").alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("n_shared"))
    in_train = annotations.join(images.where(F.col("split") == train), "image_id", "left_semi").select("category_id").distinct()
    absent = annotations.select("category_id").distinct().join(in_train, "category_id", "left_anti").agg(F.count(F.lit(1)).alias("n_absent_in_train"))
    return shared.join(F.broadcast(absent))


def largest_of_class(annotations: DataFrame, k: int) -> DataFrame:
    """Each class's k largest annotations, by class and falling area."""
    area = F.col("w") * F.col("h")
    ranked = annotations.withColumns({"area": area, "_r": F.row_number().over(Window.partitionBy("category_id").orderBy(F.desc(area), "ann_key"))})
    return ranked.where(F.col("_r") <= k).orderBy("category_id", F.desc("area"), "ann_key").select("category_id", "ann_key", "area")


def smallest_classes(annotations: DataFrame, k: int) -> DataFrame:
    """The k classes whose boxes have the smallest median side (the root of the area), ties by class."""
    sides = annotations.select("category_id", F.sqrt((F.col("w") * F.col("h")).cast("double")).alias("_s"))
    return quantiles(sides, ["category_id"], "_s", {"median_side": 0.5}).orderBy("median_side", "category_id").limit(k)


def shift_summary(weights: DataFrame) -> DataFrame:
    """Least and greatest logit shift over classes, their spread, and how often the commonest class is the rarest seen one."""
    return weights.agg(F.min("logit_shift").alias("least_shift"), F.max("logit_shift").alias("most_shift"), (F.max("logit_shift") - F.min("logit_shift")).alias("spread"), (F.max("n") / F.min(F.when(F.col("n") > 0, F.col("n")))).alias("imbalance"))


def scheme_ratios(weights: DataFrame, head_min: int, tail_max: int, schemes=("effective_number", "inverse_sqrt", "none")) -> DataFrame:
    """Of each scheme the greatest weight over the least, and mean weights of head and tail classes; `none` weighs all alike."""
    long = weights.withColumn("none", F.lit(1.0)).unpivot(["category_id", "n"], list(schemes), "scheme", "weight")
    mean = lambda cond: F.avg(F.when(cond, F.col("weight")))
    return long.groupBy("scheme").agg((F.max("weight") / F.min("weight")).alias("ratio"), mean(F.col("n") > head_min).alias("head"), mean(F.col("n") < tail_max).alias("tail"))


def adjusted_scores(detections: DataFrame, weights: DataFrame, least: float = 1e-4) -> DataFrame:
    """detections with adjusted: scores, kept `least` from 0 and 1, whose logits are moved by their class's shift."""
    s = F.greatest(F.lit(least), F.least(F.lit(1 - least), F.col("score")))
    return detections.join(weights.select("category_id", "logit_shift"), "category_id").withColumn("adjusted", 1 / (1 + F.exp(-(F.ln(s / (1 - s)) + F.col("logit_shift"))))).drop("logit_shift")


def weighted_draws(rows: DataFrame, weights: DataFrame, uniform: Column) -> DataFrame:
    """rows with drawn: a class of weights (category_id, cumulative) that `uniform` picks; classes of probability 0 are never picked.

    The classes' table goes to every row as one array, so it must be a table of classes.
    """
    table = weights.agg(F.array_sort(F.collect_list(F.struct("cumulative", "category_id"))).alias("_table"))
    met = rows.withColumn("_u", uniform).join(F.broadcast(table))
    return met.withColumn("drawn", F.get(F.filter("_table", lambda c: c["cumulative"] > F.col("_u")), 0)["category_id"]).drop("_table", "_u")


def pasted_corpus(images: DataFrame, pasted: DataFrame, train: str = "train") -> DataFrame:
    """images and the pasted copies (image_id, source_id) that come to the train split, with provenance; no other split gets one."""
    kept = pasted.join(images.where(F.col("split") == train).select("image_id"), "image_id", "left_semi")
    added = kept.select("image_id", F.lit(train).alias("split"), F.lit("pasted").alias("provenance"), "source_id")
    return images.select("image_id", "split", F.lit("original").alias("provenance"), F.lit(None).cast("string").alias("source_id")).unionByName(added)
