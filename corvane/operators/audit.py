"""Audits: rows, pairs, duplicates and overlaps between splits."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.gates import refused
from corvane.functions.geometry import let, scaled, shoelace_area
from corvane.functions.keys import SAFE, anonymous, patient_key, source_key
from corvane.functions.parts import finely
from corvane.functions.ranges import quantiles
from corvane.functions.storage import durable


def typed_lines(lines: DataFrame) -> DataFrame:
    """Rows of lines that are not blank, with class_id (int, or null) and _v (doubles; null for what is no finite number).

    A row's line is computed and taken apart once, whatever it is derived from: filters that come later can't
    reach behind the array that is exploded here.
    """

    spaces = F.lit(" \t\n\x0b\x0c\r")

    def parts(line: Column) -> Column:
        split = F.split(F.btrim(line, spaces), r"\s+")
        number = lambda v: let(v.try_cast("double"), lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x))
        return let(split, lambda p: F.struct(line.alias("line"), F.get(p, 0).try_cast("int").alias("class_id"), F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), number).alias("_v")))

    taken = lines.select(*(c for c in lines.columns if c != "line"), F.explode(F.filter(F.array("line"), lambda x: F.btrim(x, spaces) != "")).alias("line"))
    rows = taken.select(*(c for c in lines.columns if c != "line"), F.explode(F.array(parts(F.col("line")))).alias("_l"))
    return rows.select(*(F.col("_l.line").alias("line") if c == "line" else F.col(c) for c in lines.columns), "_l.class_id", "_l._v")


def check_label_lines(lines: DataFrame, n_classes: int, clamp: bool = False) -> DataFrame:
    """lines (with line, width, height) with problem (the first fatal rule broken, else null) and out_of_range.

    Fatal: malformed_line, malformed_polygon, class_out_of_range, zero_area_polygon. A coordinate beyond the
    unit square by more than 1e-6 is recorded only; one that is NaN or infinite is no number. Blank lines are
    not rows.
    """
    typed = typed_lines(lines)
    n, broken = F.size("_v"), F.exists("_v", lambda v: v.isNull())
    area = shoelace_area(scaled(F.col("_v"), F.col("width"), F.col("height"), clamp))
    problem = (
        F.when(F.col("class_id").isNull(), "malformed_line")
        .when((n < 6) | (n % 2 == 1), "malformed_polygon")
        .when((F.col("class_id") < 0) | (F.col("class_id") >= n_classes), "class_out_of_range")
        .when(broken, "malformed_line")
        .when(area < 1.0, "zero_area_polygon")
    )
    outside = F.coalesce(F.exists("_v", lambda v: (v < -1e-6) | (v > 1 + 1e-6)), F.lit(False))
    good = F.col("problem").isNull() | (F.col("problem") == "zero_area_polygon")
    return typed.withColumn("problem", problem).withColumn("out_of_range", outside & good).drop("_v")


PROBLEMS = ("malformed_line", "malformed_polygon", "class_out_of_range", "zero_area_polygon")


def split_verdicts(checked: DataFrame) -> DataFrame:
    """Per split of checked label lines (split, problem): lines, those of each problem, and whether there is none."""
    of = [F.count_if(F.col("problem") == p).alias(f"n_{p}") for p in PROBLEMS]
    return checked.groupBy("split").agg(F.count(F.lit(1)).alias("n_lines"), *of, (F.count("problem") == 0).alias("passes"))


def unpaired(images: DataFrame, labels: DataFrame, key: str = "image_id") -> DataFrame:
    """Keys that only one side has, with the problem's name; a null key equals none of the other side.

    Keys of both sides meet in one shuffle and are grouped once.
    """
    side = lambda rows, image: rows.select(key, F.lit(image).alias("_image"))
    met = finely(side(images, True).unionByName(side(labels, False)), key).groupBy(key).agg(F.bool_or("_image").alias("_a"), F.bool_and("_image").alias("_b"))
    null, has_image, has_label = F.col(key).isNull(), F.col("_a"), ~F.col("_b")
    problems = F.array(F.when(has_image & (null | ~has_label), "image_without_label"), F.when(has_label & (null | ~has_image), "label_without_image"))
    return met.select(key, F.explode(F.array_compact(problems)).alias("problem"))


def exact_groups(files: DataFrame) -> DataFrame:
    """Per hash that several files share: files, splits, and whether splits differ."""
    return files.groupBy("sha").agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct("split").alias("n_splits"), F.min("file_name").alias("first_file")).where(F.col("n_files") > 1).withColumn("leaks", F.col("n_splits") > 1)


def within_split_duplicates(files: DataFrame) -> DataFrame:
    """Per split: files, distinct contents (its effective size) and groups of equal files."""
    per = files.groupBy("split", "sha").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("split").agg(F.sum("n").alias("n_files"), F.count(F.lit(1)).alias("effective_size"), F.count_if(F.col("n") > 1).alias("n_groups"))


def _near_hashes(left: DataFrame, right: DataFrame, bits: int, distance: int, bands: int) -> DataFrame:
    """Pairs (_a, _b, hamming) of distinct hashes (dhash) that differ in at most distance bits.

    Of so many bands, distance flipped bits leave bands - distance untouched; so a key of as many equal bands,
    one for each choice of them, finds every pair, and a pair is given at its first equal bands only.
    """
    width, whole = bits // bands, bands - distance
    cuts = [(i * width, width if i < bands - 1 else bits - i * width) for i in range(bands)]
    band = lambda h, i: F.shiftrightunsigned(h, cuts[i][0]).bitwiseAND(F.lit((1 << cuts[i][1]) - 1))
    choices = list(combinations(range(bands), whole))
    key = lambda h, c: reduce(lambda k, i: F.shiftleft(k, cuts[i][1]).bitwiseOR(band(h, i)), c, F.lit(0).cast("long"))
    keys = lambda rows, name: rows.select(F.col("dhash").alias(name), F.posexplode(F.array(*(key(F.col("dhash"), c) for c in choices))).alias("_c", "_key"))
    # dealt before they become so many keys, which few tasks would make and hold else, and once more by key
    dealt = lambda rows, name: finely(keys(finely(rows.select("dhash"), "dhash").distinct(), name), "_c", "_key")
    apart = F.bit_count(F.col("_a").bitwiseXOR(F.col("_b")))
    equal = F.concat(*(F.when(band(F.col("_a"), i) == band(F.col("_b"), i), F.array(F.lit(i))).otherwise(F.array().cast("array<int>")) for i in range(bands)))
    first = F.array_position(F.array(*(F.array(*map(F.lit, c)) for c in choices)), F.slice(equal, 1, whole)) - 1
    met = dealt(left, "_a").join(dealt(right, "_b"), ["_c", "_key"])
    return met.where((apart <= distance) & (first == F.col("_c"))).select("_a", "_b", apart.cast("int").alias("hamming"))


def hamming_pairs(left: DataFrame, right: DataFrame, bits: int = 63, distance: int = 5, bands: int = 8) -> DataFrame:
    """Pairs of rows (file_name, dhash) whose hashes differ in at most distance bits: left_file, right_file, hamming.

    Distinct hashes are paired, by keys of bands - distance bands (24 of 63 bits as a rule), and then files put
    in their place: a hash that many files have is compared once. Null hashes pair with nothing.
    """
    near = _near_hashes(left.where("dhash is not null"), right.where("dhash is not null"), bits, distance, bands)
    a, b = left.select(F.col("file_name").alias("left_file"), F.col("dhash").alias("_a")), right.select(F.col("file_name").alias("right_file"), F.col("dhash").alias("_b"))
    return near.join(a, "_a").join(b, "_b").select("left_file", "right_file", "hamming")


def cross_split_hashes(files: DataFrame, bits: int = 63, distance: int = 5, bands: int = 8) -> DataFrame:
    """All near duplicates between any two splits, as pairs of hash classes: left_file, right_file, hamming, n_left, n_right.

    Files (file_name, split, dhash) of one hash are a class, named by its first file; hash_members() tells whose
    it is. A pair is given once, left before right, where files of different splits meet in it; a class that
    several splits share is a pair with itself, at distance 0. Copies are not expanded into pairs of files.
    """
    known = files.where("dhash is not null")
    classes = durable(known.groupBy("dhash").agg(F.min("file_name").alias("file"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("split")).alias("splits")))
    near = _near_hashes(classes, classes, bits, distance, bands)
    side = lambda p: classes.select(F.col("dhash").alias(f"_{p}"), F.col("file").alias(f"{p}_file"), F.col("n").alias(f"n_{p}"), F.col("splits").alias(f"_s{p}"))
    met = near.withColumnsRenamed({"_a": "_left", "_b": "_right"}).join(side("left"), "_left").join(side("right"), "_right")
    apart = F.size(F.array_union("_sleft", "_sright")) > 1
    return met.where((F.col("left_file") <= F.col("right_file")) & apart).select("left_file", "right_file", "hamming", "n_left", "n_right")


def hash_members(files: DataFrame) -> DataFrame:
    """file_name and class_file, the first file of the same hash."""
    first = files.groupBy("dhash").agg(F.min("file_name").alias("class_file"))
    return files.where("dhash is not null").join(first, "dhash").select("file_name", "class_file")


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r of two arrays of one length; null if one is constant."""
    n = F.size(a)
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
    dot = lambda v, w: F.aggregate(F.zip_with(v, w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cov = dot(a, b) - n * mean(a) * mean(b)
    var = (dot(a, a) - n * mean(a) * mean(a)) * (dot(b, b) - n * mean(b) * mean(b))
    return F.when(var > 1e-18, cov / F.sqrt(var))


def _scored(pairs: DataFrame, thumbs: DataFrame, least: float) -> DataFrame:
    """pairs, finely dealt by left_file, with ncc and verdict. Thumbnails are dealt as finely as the pairs that they join, as a task sorts its share of all of them."""
    a, b = thumbs.select(F.col("file_name").alias("left_file"), F.col("thumb").alias("_x")), thumbs.select(F.col("file_name").alias("right_file"), F.col("thumb").alias("_y"))
    scored = finely(pairs.join(a, "left_file"), "right_file").join(b, "right_file").withColumn("ncc", correlation(F.col("_x"), F.col("_y"))).drop("_x", "_y")
    return scored.withColumn("verdict", F.when(F.coalesce(F.col("ncc") >= least, F.lit(True)), "confirmed").otherwise("rejected"))


def confirmed_pairs(pairs: DataFrame, thumbs: DataFrame, least: float = 0.98) -> DataFrame:
    """pairs with ncc and verdict: confirmed (also without a score) or rejected."""
    return _scored(finely(pairs, "left_file"), thumbs, least)


def verdict_counts(confirmed: DataFrame) -> DataFrame:
    """One row: pairs confirmed, rejected, and unscored, which count as confirmed as well."""
    return confirmed.agg(F.count_if(F.col("verdict") == "confirmed").alias("confirmed"), F.count_if(F.col("verdict") == "rejected").alias("rejected"), F.count_if(F.col("ncc").isNull()).alias("unscored"))


def apart_from_groups(files: DataFrame, groups: DataFrame) -> DataFrame:
    """files (sha) whose content no other split has, those that a search for near duplicates begins with. Copies inside a split stay."""
    return files.join(groups.where("leaks").select("sha"), "sha", "left_anti")


def confirmed_partners(pairs: DataFrame, thumbs: DataFrame, least: float = 0.98) -> DataFrame:
    """Each left file's nearest confirmed partner, or its nearest one if all are rejected, ties to the first name, with ncc, verdict and the number of its pairs."""
    counted = finely(pairs, "left_file").withColumn("n_pairs", F.count(F.lit(1)).over(Window.partitionBy("left_file")))
    best = F.min(F.struct((F.col("verdict") != "confirmed").alias("_r"), "hamming", "right_file", "ncc", "verdict"))
    return _scored(counted, thumbs, least).groupBy("left_file", "n_pairs").agg(best.alias("_best")).select("left_file", "n_pairs", "_best.right_file", "_best.hamming", "_best.ncc", "_best.verdict")


def dhash(values: Column) -> Column:
    """63 bits, most significant first: whether each of 64 values is less than the next."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(62)), F.lit(0).cast("long"), lambda acc, i: F.shiftleft(acc, 1) + F.when(F.get(values, i + 1) > F.get(values, i), F.lit(1)).otherwise(F.lit(0)))


def identities(images: DataFrame) -> DataFrame:
    """images with source and patient keys read from file_name."""
    return images.withColumn("source", source_key(F.col("file_name"))).withColumn("patient_key", patient_key(F.col("source")))


def shared_keys(images: DataFrame, key: str) -> DataFrame:
    """Keys found in more than one split."""
    return images.groupBy(key).agg(F.count_distinct("split").alias("n_splits"), F.count(F.lit(1)).alias("n_files")).where(F.col("n_splits") > 1)


def contamination(images: DataFrame, key: str, test: str = "test") -> DataFrame:
    """How many files and keys of the test split are also in others."""
    held = images.groupBy(key).agg(F.count_if(F.col("split") == test).alias("_t"), F.count_if(F.col("split") != test).alias("_o")).where("_t > 0")
    return held.agg(F.sum("_t").alias("test_files"), F.sum(F.when(F.col("_o") > 0, F.col("_t")).otherwise(0)).alias("contaminated_files"), F.count_if(F.col("_o") > 0).alias("shared_keys"), F.count_if(F.col("_o") == 0).alias("unseen_keys"))


def anonymised(files: DataFrame) -> DataFrame:
    """file_name, clean, is_safe (the whitelist) and n_same: how many names become this one."""
    clean = files.select("file_name", anonymous(F.col("file_name")).alias("clean"))
    return clean.withColumns({"is_safe": F.rlike("clean", F.lit(SAFE)), "n_same": F.count(F.lit(1)).over(Window.partitionBy("clean"))})


def safely_anonymised(files: DataFrame) -> DataFrame:
    """anonymised(), which stops the job at a name outside the whitelist."""
    return refused(anonymised(files), ~F.col("is_safe"), F.concat(F.lit("no anonymous name: "), "clean"))


def anonymisation_map(files: DataFrame) -> DataFrame:
    """clean, original and collides of names that change; collides where several originals become one name, of which no mapping could keep all."""
    named = files.select("file_name", anonymous(F.col("file_name")).alias("clean")).distinct()
    counted = named.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("clean")))
    return counted.where(F.col("clean") != F.col("file_name")).select("clean", F.col("file_name").alias("original"), (F.col("_n") > 1).alias("collides"))


def annotation_reconciliation(images: DataFrame, annotations: DataFrame, labelled: DataFrame) -> DataFrame:
    """All differences between annotations (image_id, category_id, and segmentation if there is one) and label lines (image_id, category_id) of one corpus.

    kind, image_id, category_id, n_left, n_right: image_only_left and image_only_right (of images that have rows
    on one side only), unknown_image (neither side's image is listed), class_count (classes whose counts
    differ), empty_segmentation (an image's annotations without one).
    """
    no_id, no_class = F.lit(None).cast("long"), F.lit(None).cast("long")
    per = lambda rows, name: rows.groupBy("image_id").agg(F.count(F.lit(1)).alias(name))
    met = per(annotations, "n_left").join(per(labelled, "n_right"), "image_id", "full_outer")
    row = lambda rows, kind, image, category, left, right: rows.select(F.lit(kind).alias("kind"), image.alias("image_id"), category.alias("category_id"), F.coalesce(left, F.lit(0)).cast("long").alias("n_left"), F.coalesce(right, F.lit(0)).cast("long").alias("n_right"))
    left, right = F.col("n_left"), F.col("n_right")
    out = [
        row(met.where(right.isNull()), "image_only_left", F.col("image_id"), no_class, left, right),
        row(met.where(left.isNull()), "image_only_right", F.col("image_id"), no_class, left, right),
        row(met.join(images.select("image_id"), "image_id", "left_anti"), "unknown_image", F.col("image_id"), no_class, left, right),
        row(reconciled(annotations, labelled, ["category_id"]), "class_count", no_id, F.col("category_id"), left, right),
    ]
    if "segmentation" in annotations.columns:
        empty = annotations.where(F.col("segmentation").isNull() | F.btrim("segmentation").isin("", "[]", "{}"))
        out.append(row(per(empty, "n_left"), "empty_segmentation", F.col("image_id"), no_class, left, F.lit(0)))
    return reduce(DataFrame.unionByName, out)


def reconciled(left: DataFrame, right: DataFrame, keys: list[str], count: Column | None = None) -> DataFrame:
    """Keys whose counts (of rows, or another aggregate) differ between two tables."""
    count = F.count(F.lit(1)) if count is None else count
    a, b = left.groupBy(*keys).agg(count.alias("n_left")), right.groupBy(*keys).agg(count.alias("n_right"))
    both = a.join(b, keys, "full_outer").select(*keys, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    return both.where("n_left <> n_right")


def distribution(rows: DataFrame, by: list[str], value: str, threshold: float) -> DataFrame:
    """Per group least, greatest and mean value, exact percentiles, and how many reach the threshold; all 0 where no value is.

    Without `by` there is one row, for an empty table too.
    """
    whole = rows.groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.count_if(F.col(value) >= threshold).alias("n_above"))
    cuts = quantiles(rows, by, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    if by:
        same = None
        cuts = cuts.withColumnsRenamed({k: f"_by_{k}" for k in by})
        for k in by:
            same = F.col(k).eqNullSafe(F.col(f"_by_{k}")) if same is None else same & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
        met = whole.join(cuts, same, "left")
    else:
        met = whole.join(cuts, F.lit(True), "left")  # a row with a row
    names = ("least", "most", "mean", "p50", "p95", "p99")
    return met.select(*by, *(F.coalesce(F.col(k).cast("double"), F.lit(0.0)).alias(k) for k in names), "n_above")
