"""Evaluation of detections and masks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.functions.geometry import box_iou
from corvane.functions.ranges import quantiles, running_sums
from corvane.functions.storage import durable
from corvane.functions.streams import begins, streamed, whole_keys
from corvane.operators.corpus import size_group


def sure(detections: DataFrame, least: float, missing: float = 1.0) -> DataFrame:
    """Detections of at least this score; those without one count as `missing`: 1 where masks are compared, 0 in consensus and pseudo-labels."""
    return detections.where(F.coalesce("score", F.lit(missing)) >= least)


def missed(annotations: DataFrame, detections: DataFrame, models: Sequence, least_score: float = 0.15, least_iou: float = 0.1) -> DataFrame:
    """(model, annotation) of annotations that no detection of the same image and class hits.

    A model of the list without any detection misses all. Rows with iscrowd set, if there is such a column, are
    left out.
    """
    single = annotations.where(F.coalesce("iscrowd", F.lit(0)) == 0) if "iscrowd" in annotations.columns else annotations
    a = single.withColumn("model", F.explode(F.array(*map(F.lit, models)))).withColumnsRenamed({k: f"a_{k}" for k in "xywh"})
    d = sure(detections, least_score, 0.0).select(F.col("model").alias("_m"), F.col("image_id").alias("_i"), F.col("category_id").alias("_c"), *(F.col(k).alias(f"d_{k}") for k in "xywh"))
    same = (F.col("model") == F.col("_m")) & (F.col("image_id") == F.col("_i")) & (F.col("category_id") == F.col("_c"))
    return a.join(d, same & (box_iou("a_", "d_") >= least_iou), "left_anti").select("model", "image_id", "ann_key", "category_id")


def _found_by(annotations: DataFrame, detections: DataFrame, models: Sequence, least_score: float = 0.15, least_iou: float = 0.1) -> DataFrame:
    """Annotations (image_id, ann_key, category_id; see missed()) with _h0, _h1, ...: whether each model of the list hits them.

    Annotations and detections are dealt once, by image and class, for all models. Of rows of one annotation all must be hit.
    """
    single = annotations.where(F.coalesce("iscrowd", F.lit(0)) == 0) if "iscrowd" in annotations.columns else annotations
    keys, box = ["image_id", "ann_key", "category_id"], [f"a_{k}" for k in "xywh"]
    a = single.select(*keys, *(F.col(k).alias(f"a_{k}") for k in "xywh"))
    d = sure(detections, least_score, 0.0).where(F.col("model").isin(*models)).select(F.col("model").alias("_m"), F.col("image_id").alias("_i"), F.col("category_id").alias("_c"), *(F.col(k).alias(f"d_{k}") for k in "xywh"))
    same = (F.col("image_id") == F.col("_i")) & (F.col("category_id") == F.col("_c"))
    flags = {f"_h{i}": F.coalesce(F.max(F.col("_m") == m), F.lit(False)) for i, m in enumerate(models)}
    hit = a.join(d, same & (box_iou("a_", "d_") >= least_iou), "left").groupBy(*keys, *box).agg(*(v.alias(k) for k, v in flags.items()))
    return hit.groupBy(*keys).agg(*(F.min(k).alias(k) for k in flags))


def _none(n: int) -> Column:
    """Whether none of the first n flags of _found_by() is set."""
    out = F.lit(True)
    for i in range(n):
        out &= ~F.col(f"_h{i}")
    return out


def universal_misses(annotations: DataFrame, detections: DataFrame, models: Sequence, **cut) -> DataFrame:
    """Annotations that all models of the list miss."""
    return _found_by(annotations, detections, models, **cut).where(_none(len(models))).select("image_id", "ann_key", "category_id")


def miss_shares(annotations: DataFrame, universal: DataFrame) -> DataFrame:
    """Per class: annotations, universal misses and their share."""
    total = annotations.groupBy("category_id").agg(F.count(F.lit(1)).alias("total"))
    lost = universal.groupBy("category_id").agg(F.count(F.lit(1)).alias("_m"))
    n = F.coalesce("_m", F.lit(0))
    return total.join(lost, "category_id", "left").select("category_id", "total", n.alias("universal"), (n / F.col("total")).alias("share"))


def probe_recovery(annotations: DataFrame, detections: DataFrame, probe: int, others: Sequence[int]) -> DataFrame:
    """Per class: misses of all other models, and how many of them the probe finds."""
    found = _found_by(annotations, detections, [*others, probe]).where(_none(len(others)))
    return found.groupBy("category_id").agg(F.count(F.lit(1)).alias("universal"), F.count_if(f"_h{len(others)}").alias("recovered"))


def top_detections(detections: DataFrame, k: int) -> DataFrame:
    """Each model's k best of an image, ties by annotation key."""
    w = Window.partitionBy("model", "image_id").orderBy(F.desc("score"), "ann_key")
    return detections.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def greedy_instances(pairs: DataFrame, least_iou: float = 0.1, by: Sequence[str] = ("image_id", "category_id")) -> DataFrame:
    """One-to-one matches among pairs (the keys, det, score, gt, iou): detections by falling score, then det, each takes the free truth of highest iou.

    Equal ious go to the smaller gt; pairs below least_iou match nothing. Pairs are sorted inside partitions and
    streamed: a task holds which truths of one key are taken.
    """
    schema = T.StructType([pairs.schema[k] for k in (*by, "det", "gt", "iou")])
    n = len(by)

    def matched(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, of_key in groupby(rows, key=lambda r: r[:n]):
            used: set = set()
            for _, of_det in groupby(of_key, key=lambda r: r[n : n + 2]):
                if best := next((r for r in of_det if r[n + 2] not in used), None):
                    used.add(best[n + 2])
                    yield *key, best[n + 1], best[n + 2], best[n + 3]

    near = pairs.where(F.col("iou") >= least_iou).select(*by, (-F.col("score")).alias("_s"), "det", "gt", "iou")
    ordered = near.repartition(*by).sortWithinPartitions(*by, "_s", "det", F.desc("iou"), "gt")
    return ordered.mapInArrow(streamed(matched, schema), schema)


def average_precision(scored: DataFrame, key: str) -> DataFrame:
    """Per key of rows (label 0/1, score, id): mean of precision at each positive, null without one; precision and recall at 0.5."""
    summed = running_sums(scored, [key], [F.desc("score"), "id"], {"_tp": F.col("label"), "_n": F.lit(1).cast("long")})
    ranked = summed.withColumn("_p", F.col("_tp") / F.col("_n"))
    tp, said, real = F.count_if((F.col("score") >= 0.5) & (F.col("label") == 1)), F.count_if(F.col("score") >= 0.5), F.sum("label")
    return ranked.groupBy(key).agg((F.sum(F.col("_p") * F.col("label")) / F.nullif(real, F.lit(0))).alias("ap"), (tp / F.greatest(said, F.lit(1))).alias("precision"), (tp / F.greatest(real, F.lit(1))).alias("recall"), F.avg("label").alias("prevalence"))


def box_blocks(boxes: DataFrame, grid: int = 8, by: Sequence[str] = ("image_id", "category_id")) -> DataFrame:
    """Boxes as blocks of grid cells: the keys, line, stop (the line after the last), x0, x1 (half open)."""
    c = lambda v: F.floor(v / grid)
    blocks = boxes.select(*by, c(F.greatest(F.col("y"), F.lit(0))).alias("line"), c(F.greatest(F.col("y") + F.col("h"), F.lit(0))).alias("stop"), c(F.greatest(F.col("x"), F.lit(0))).alias("x0"), c(F.greatest(F.col("x") + F.col("w"), F.lit(0))).alias("x1"))
    return blocks.where("x1 > x0 and stop > line")


def box_runs(boxes: DataFrame, grid: int = 8, by: Sequence[str] = ("image_id", "category_id")) -> DataFrame:
    """Boxes as runs of grid cells: the keys, line, x0, x1 (half open)."""
    return box_blocks(boxes, grid, by).select(*by, F.explode(F.sequence("line", F.col("stop") - 1)).alias("line"), "x0", "x1")


def mask_cases(truth: DataFrame, predicted: DataFrame, by: Sequence[str] = ("image_id", "category_id")) -> DataFrame:
    """Per key of two run tables: gt_px, dt_px, both_px, dice, iou, tversky, focal_tversky and soft_dice (with 1 added above and below).

    Runs may overlap. Each line is swept once from run end to run end, counting the runs of either side that lie
    open. Dice and IoU are 0 where one side is empty.
    """
    ends = lambda t, p: F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(t).alias("t"), F.lit(p).alias("p")), F.struct(F.col("x1").alias("x"), F.lit(-t).alias("t"), F.lit(-p).alias("p"))))
    events = truth.select(*by, "line", ends(1, 0).alias("_e")).unionByName(predicted.select(*by, "line", ends(0, 1).alias("_e"))).select(*by, "line", "_e.*")
    w = Window.partitionBy(*by, "line").orderBy("x")
    held = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = events.select(*by, F.coalesce(F.lead("x").over(w) - F.col("x"), F.lit(0)).alias("_w"), (F.sum("t").over(held) > 0).alias("_t"), (F.sum("p").over(held) > 0).alias("_p"))
    size = lambda cond: F.sum(F.when(cond, F.col("_w")).otherwise(0))
    return _overlaps(swept.groupBy(*by).agg(size(F.col("_t")).alias("gt_px"), size(F.col("_p")).alias("dt_px"), size(F.col("_t") & F.col("_p")).alias("both_px")))


def _overlaps(sizes: DataFrame) -> DataFrame:
    g, d, c = F.col("gt_px"), F.col("dt_px"), F.col("both_px")
    tversky = (c + 1) / (c + 0.7 * (g - c) + 0.3 * (d - c) + 1)
    soft = (2 * c + 1) / (g + d + 1)
    return sizes.withColumns({"dice": 2 * c / (g + d), "iou": c / (g + d - c), "tversky": tversky, "focal_tversky": F.pow(1 - tversky, F.lit(1 / 1.33)), "soft_dice": soft})


def box_cells(boxes: DataFrame, grid: int = 8, by: Sequence[str] = ("image_id", "category_id")) -> DataFrame:
    """Boxes as blocks of grid cells, a row a box: the keys, y0, y1, x0, x1 (half open). What lies left of or above the image is cut off."""
    c = lambda v: F.floor(F.greatest(v, F.lit(0)) / grid)
    x, y = F.col("x"), F.col("y")
    blocks = boxes.select(*by, c(y).alias("y0"), c(y + F.col("h")).alias("y1"), c(x).alias("x0"), c(x + F.col("w")).alias("x1"))
    return blocks.where("x1 > x0 and y1 > y0")


def _block_sizes(key: np.ndarray, side: np.ndarray, blocks: np.ndarray, shape: tuple[int, int], at_once: int = 200_000) -> np.ndarray:
    """Of blocks (y0, y1, x0, x1) of keys 0, 1, ... and sides 0 (truth), 1, ...: cells of the truth, of each other side, and those these share with the truth.

    Blocks may overlap. Lines are swept together from block end to block end; more lines than at_once are halved
    by height first, so that only the blocks themselves are held whole.
    """
    n_keys, n_sides = shape
    y0, y1 = blocks[:, 0], blocks[:, 1]
    lines = y1 - y0
    top, bottom = int(y0.min()), int(y1.max())
    if lines.sum() > at_once and top + 1 < bottom:
        middle, out = (top + bottom) // 2, np.zeros((n_keys, 2 * n_sides - 1), dtype=np.int64)
        for low, high in ((top, middle), (middle, bottom)):
            part = np.clip(blocks, (low, low, -(1 << 62), -(1 << 62)), (high, high, 1 << 62, 1 << 62))
            here = part[:, 1] > part[:, 0]
            if here.any():
                out += _block_sizes(key[here], side[here], part[here], shape, at_once)
        return out
    at = np.repeat(np.arange(len(blocks)), lines)
    line = np.arange(len(at)) - np.repeat(np.cumsum(lines) - lines, lines) + (y0 - top)[at]
    left, width, height = int(blocks[:, 2].min()), int(blocks[:, 3].max()) + 1 - int(blocks[:, 2].min()), bottom - top
    place, x = key[at] * height + line, np.concatenate([blocks[at, 2], blocks[at, 3]]) - left
    place = np.concatenate([place, place])
    order = np.argsort(place * width + x) if n_keys * height * width < 1 << 62 else np.lexsort((x, place))
    place, x, of_side = place[order], x[order], np.concatenate([side[at], side[at]])[order]
    step = np.where(order < len(at), 1, -1).astype(np.int32)
    of = place[:-1] // height
    # at the end of a line all blocks are closed, so that sums over all lines begin anew at each
    wide = np.where(place[1:] == place[:-1], x[1:] - x[:-1], 0)
    open_of = [np.cumsum(np.where(of_side == s, step, 0))[:-1] > 0 for s in range(n_sides)]
    cells = lambda held: np.bincount(of[held], wide[held], n_keys).astype(np.int64)
    return np.stack([*(cells(o) for o in open_of), *(cells(open_of[0] & o) for o in open_of[1:])], axis=1)


def _single_sizes(key: np.ndarray, side: np.ndarray, blocks: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """_block_sizes() of keys with one block a side at most."""
    at = np.zeros((*shape, 4), dtype=np.int64)
    at[key, side] = blocks
    y0, y1, x0, x1 = np.moveaxis(at, 2, 0)
    share = lambda low, high: np.clip(np.minimum(high[:, :1], high[:, 1:]) - np.maximum(low[:, :1], low[:, 1:]), 0, None)
    return np.concatenate([(y1 - y0) * (x1 - x0), share(y0, y1) * share(x0, x1)], axis=1)


def block_cases(truth: DataFrame | None, predicted: DataFrame | None, models: Sequence, blocks: DataFrame | None = None) -> DataFrame:
    """mask_cases() by model, image_id and category_id, of blocks of cells (y0, y1, x0, x1, half open; see box_cells).

    predicted has model; blocks of models that are not in the list don't count. A model has a case where it or
    the truth has a cell. Blocks, not their lines, go through the one shuffle, the truth's once for all models. A
    task holds the blocks of one class of one image and those of a batch. Where both tables are one that is dealt by
    image already, that is blocks (truth has no model there).
    """
    n_models, keys, ends = len(models), ["image_id", "category_id"], ["y0", "y1", "x0", "x1"]
    cells = [F.col(k).cast("long").alias(k) for k in ends]
    number = F.array_position(F.array(*map(F.lit, models)), F.col("model")).cast("int")
    if blocks is None:
        both = truth.select(*keys, F.lit(0).alias("_m"), *cells).unionByName(predicted.select(*keys, number.alias("_m"), *cells).where("_m > 0")).where("x1 > x0 and y1 > y0").repartition(*keys)
    else:
        real = F.col("model").isNull()
        both = blocks.where(real | (number > 0)).select(*keys, F.when(real, 0).otherwise(number).alias("_m"), *cells).where("x1 > x0 and y1 > y0")
    ordered = both.sortWithinPartitions(*keys)
    schema = T.StructType([both.schema["image_id"], both.schema["category_id"], T.StructField("_m", T.IntegerType()), *(T.StructField(k, T.LongType()) for k in ("gt_px", "dt_px", "both_px"))])
    arrow = to_arrow_schema(schema)

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: pa.Table) -> pa.RecordBatch:
            new = begins(rows, keys)
            first, key = np.flatnonzero(new), np.cumsum(new) - 1
            side, blocks, shape = rows["_m"].to_numpy(), np.stack([rows[k].to_numpy() for k in ends], axis=1), (len(first), n_models + 1)
            several = (np.bincount(key * shape[1] + side, minlength=shape[0] * shape[1]).reshape(shape) > 1).any(1)[key]
            sizes = _single_sizes(key[~several], side[~several], blocks[~several], shape)
            if several.any():
                sizes += _block_sizes(key[several], side[several], blocks[several], shape)
            g, d, common = sizes[:, :1], sizes[:, 1 : n_models + 1], sizes[:, n_models + 1 :]
            at, m = np.nonzero((g > 0) | (d > 0))
            named = rows.select(keys).take(pa.array(first[at]))
            values = [pa.array(m.astype(np.int32)), pa.array(g[at, 0]), pa.array(d[at, m]), pa.array(common[at, m])]
            return pa.RecordBatch.from_arrays([*(named[k].combine_chunks() for k in keys), *values], schema=arrow)

        for rows in whole_keys(batches, keys):
            yield made(rows)

    out = ordered.mapInArrow(sized, schema)
    each = out.select(F.get(F.array(*map(F.lit, models)), F.col("_m")).alias("model"), *(c for c in out.columns if c != "_m"))
    return _overlaps(each)


def model_mask_cases(truth: DataFrame, predicted: DataFrame, models: Sequence) -> DataFrame:
    """block_cases() of runs (line, x0, x1)."""
    block = [F.col("line").alias("y0"), (F.col("line") + 1).alias("y1"), "x0", "x1"]
    keys = ["image_id", "category_id"]
    return block_cases(truth.select(*keys, *block), predicted.select("model", *keys, *block), models)


def case_summary(cases: DataFrame) -> DataFrame:
    """Per model and class, and (category_id null) per model: mean dice and iou, cases, both, misses and false alarms."""
    g, d = F.col("gt_px") > 0, F.col("dt_px") > 0
    sets = cases.groupingSets([["model", "category_id"], ["model"]], "model", "category_id")
    return sets.agg(F.avg("dice").alias("dice"), F.avg("iou").alias("iou"), F.count(F.lit(1)).alias("n_cases"), F.count_if(g & d).alias("n_both"), F.count_if(g & ~d).alias("n_miss"), F.count_if(~g & d).alias("n_false_alarm"))


def area_endpoint(cases: DataFrame, images: DataFrame, category: int, cell: int = 64) -> DataFrame:
    """Every model's and image's true and predicted share of area of a class, in percent. images has a row per model and image."""
    one = cases.where(F.col("category_id") == category)
    pct = lambda c: F.coalesce(F.col(c) * cell * 100.0 / (F.col("width") * F.col("height")), F.lit(0.0))
    return images.select("model", "image_id", "width", "height").join(one, ["model", "image_id"], "left").select("model", "image_id", pct("gt_px").alias("g"), pct("dt_px").alias("p"))


def endpoint_stats(endpoint: DataFrame) -> DataFrame:
    """Per model: agreement over images with g > 0, and false positives over the others; nulls where there is nothing to say.

    Spearman's correlation is over ordinal ranks, ties by image. The endpoint is kept, as it is read several times.
    """
    endpoint = durable(endpoint)
    one = {"_r": F.lit(1).cast("long")}
    rank = lambda rows, c: running_sums(rows, ["model"], [c, "image_id"], one).withColumnRenamed("_r", f"_r{c}")
    ranked = rank(rank(endpoint.where("g > 0"), "g"), "p").unionByName(endpoint.where("not g > 0"), allowMissingColumns=True)
    e, pos = F.col("p") - F.col("g"), F.col("g") > 0
    at = lambda v: F.when(pos, v)
    sd = F.stddev_samp(at(e))
    ape = endpoint.where("g > 0").select("model", (F.abs(e) / F.greatest("g", F.lit(1e-9)) * 100).alias("ape"))
    median = quantiles(ape, ["model"], "ape", {"median_ape": 0.5})
    stats = ranked.groupBy("model").agg(
        F.count_if(pos).alias("n_positive"),
        F.avg(at(F.abs(e))).alias("mae"),
        F.avg(at(e)).alias("bias"),
        (F.avg(at(e)) - 1.96 * sd).alias("loa_low"),
        (F.avg(at(e)) + 1.96 * sd).alias("loa_high"),
        F.corr(at(F.col("g")), at(F.col("p"))).alias("pearson"),
        F.corr(F.col("_rg").cast("double"), F.col("_rp").cast("double")).alias("spearman"),
        F.avg(F.when(~pos, F.col("p"))).alias("false_positive_area"),
        F.avg(F.when(~pos, (F.col("p") > 0).cast("double"))).alias("false_positive_rate"),
    )
    return stats.join(median, "model", "left")


def endpoint_changes(endpoint: DataFrame, reference: int = 0) -> DataFrame:
    """Each other model's absolute error less the reference's, of images with g > 0: model, image_id, change."""
    err = durable(endpoint.where("g > 0").select("model", "image_id", F.abs(F.col("p") - F.col("g")).alias("_e")))  # both sides of the join
    base = err.where(F.col("model") == reference).select("image_id", F.col("_e").alias("_b"))
    return err.where(F.col("model") != reference).join(base, "image_id").select("model", "image_id", (F.col("_e") - F.col("_b")).alias("change"))


def change_verdicts(intervals: DataFrame) -> DataFrame:
    """intervals (low, high) of changes of an error with a verdict by their sign."""
    verdict = F.when(F.col("high") < 0, "reduced").when(F.col("low") > 0, "increased").otherwise("no detectable difference")
    return intervals.withColumn("verdict", verdict)


def box_overlap(pairs: DataFrame) -> DataFrame:
    """Per model and class the mean IoU of paired boxes (a_ and d_), to hold a mask's gain against the same predictions scored as boxes."""
    return pairs.groupBy("model", "category_id").agg(F.avg(box_iou("a_", "d_")).alias("box_iou"), F.count(F.lit(1)).alias("n"))


def box_mask_control(boxes: DataFrame, masks: DataFrame) -> DataFrame:
    """Per class of two tables of gains (category_id, delta): both, and whether the gain is the mask's alone (above the box's)."""
    b, m = boxes.select("category_id", F.col("delta").alias("box_delta")), masks.select("category_id", F.col("delta").alias("mask_delta"))
    return m.join(b, "category_id").withColumn("mask_only", F.col("mask_delta") > F.greatest(F.lit(0.0), F.col("box_delta")))


def ceiling_attribution(scores: DataFrame) -> DataFrame:
    """Of (ceiling, oracle, achieved) the whole gap, what the basis and what the head lose, and their shares; null shares without a gap."""
    gap = F.col("ceiling") - F.col("achieved")
    basis, head = F.col("ceiling") - F.col("oracle"), F.col("oracle") - F.col("achieved")
    share = lambda v: v / F.nullif(gap, F.lit(0.0))
    return scores.select(gap.alias("total_gap"), basis.alias("basis_gap"), head.alias("head_gap"), share(basis).alias("basis_share"), share(head).alias("head_share"))


def macro_micro(cases: DataFrame) -> DataFrame:
    """Per model, mean dice and iou over classes (macro) and over cases (micro)."""
    per = cases.groupBy("model", "category_id").agg(F.sum("dice").alias("_d"), F.sum("iou").alias("_i"), F.count(F.lit(1)).alias("_n"))
    both = per.groupBy("model").agg(F.avg(F.col("_d") / F.col("_n")).alias("_md"), F.avg(F.col("_i") / F.col("_n")).alias("_mi"), (F.sum("_d") / F.sum("_n")).alias("_sd"), (F.sum("_i") / F.sum("_n")).alias("_si"))
    rows = F.array(F.struct(F.lit("macro").alias("kind"), F.col("_md").alias("dice"), F.col("_mi").alias("iou")), F.struct(F.lit("micro").alias("kind"), F.col("_sd").alias("dice"), F.col("_si").alias("iou")))
    return both.select("model", F.explode(rows).alias("_r")).select("model", "_r.*")


def group_means(values: DataFrame, counts: DataFrame, head_min: int = 5000, tail_max: int = 100) -> DataFrame:
    """Mean of each model's class values (model, category_id, value) in head, mid and tail classes by train count; nulls are skipped."""
    met = values.join(counts.select("category_id", "train_n"), "category_id").withColumn("grp", size_group("train_n", head_min, tail_max))
    return met.groupBy("model", "grp").agg(F.avg("value").alias("mean"), F.count("value").alias("n_classes"))


def class_report(ap: DataFrame, counts: DataFrame, head_min: int = 5000, tail_max: int = 100, least: int = 10) -> DataFrame:
    """Rows of a report, commonest class first: its group by train count, counts, ap, and whether too few test instances make it unstable."""
    met = ap.join(counts.select("category_id", "train_n", F.col("test_n").alias("eval_n")), "category_id").withColumns({"grp": size_group("train_n", head_min, tail_max), "unstable": F.col("eval_n") < least})
    return met.orderBy(F.desc("train_n"), "category_id").select("model", "category_id", "grp", "train_n", "eval_n", "ap", *(c for c in ("ap50",) if c in met.columns), "unstable")


def centres_in_boxes(boxes: DataFrame, points: DataFrame, labels: dict) -> DataFrame:
    """Each box's multi-label bits: whether a point (image_id, px, py, category_id) of a kind lies in it, borders included.

    labels: name and condition on the point's class (_c). Boxes without a point have zeros.
    """
    p = points.select(F.col("image_id").alias("_i"), "px", "py", F.col("category_id").alias("_c"))
    inside = (F.col("image_id") == F.col("_i")) & F.col("px").between(F.col("x"), F.col("x") + F.col("w")) & F.col("py").between(F.col("y"), F.col("y") + F.col("h"))
    return boxes.select("image_id", "ann_key", *"xywh").join(p, inside, "left").groupBy("image_id", "ann_key").agg(*(F.coalesce(F.max(c.cast("int")), F.lit(0)).alias(k) for k, c in labels.items()))


def area_ratios(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per class of both corpora: mean box area of the left over that of the right."""
    mean = lambda a, name: a.groupBy("category_id").agg(F.avg(F.col("w") * F.col("h")).alias(name))
    return mean(left, "_l").join(mean(right, "_r"), "category_id").select("category_id", (F.col("_l") / F.col("_r")).alias("ratio"))
