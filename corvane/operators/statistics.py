"""Uncertainty and experiment tables."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.functions.keys import md5_heads
from corvane.functions.ranges import numbered
from corvane.functions.streams import whole_keys


#: Images whose weights are counted together.
_TOGETHER = 4096


def weights(images: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """Resamples with replacement, a row an image: image_id and ws, how often each of n_boot resamples has it.

    Images are numbered by id, and draw number b + n_boot * i of resample b names one of them by hash. Draws of
    some thousand slots go to runs of images as one compressed list each, not as rows.
    """
    at = numbered(images.select("image_id"), ["image_id"], "_at").withColumn("_at", F.col("_at") - 1)
    n = images.count()

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in np.array_split(batch.column("id").to_numpy(), max(1, batch.num_rows // 10_000)):
                heads = md5_heads(b"%d/" % seed, (part[:, None] * n_boot + np.arange(n_boot)).ravel())
                to = np.floor(heads / float(1 << 32) * n).astype(np.int64)
                places = np.sort(to * n_boot + np.tile(np.arange(n_boot), len(part)))
                groups = places // (_TOGETHER * n_boot)
                cuts = np.flatnonzero(np.diff(groups, prepend=-1))
                lists = [zlib.compress(np.diff(p, prepend=g * _TOGETHER * n_boot).astype("<u4").tobytes(), 1) for g, p in zip(groups[cuts].tolist(), np.split(places, cuts[1:]), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(groups[cuts]), pa.array(lists, pa.binary())], ["_group", "_drawn"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches, ["_group"]):
            group = rows["_group"].to_numpy()
            for g in np.unique(group).tolist():
                ws = np.zeros(_TOGETHER * n_boot, dtype=np.int64)
                for row in np.flatnonzero(group == g).tolist():
                    ws += np.bincount(np.cumsum(np.frombuffer(zlib.decompress(rows["_drawn"][row].as_py()), "<u4").astype(np.int64)), minlength=len(ws))
                ids = g * _TOGETHER + np.flatnonzero(ws.reshape(-1, n_boot).any(1))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(ws.reshape(-1, n_boot)[ids - g * _TOGETHER].ravel().astype(np.int32)), n_boot)
                yield pa.RecordBatch.from_arrays([pa.array(ids), lists.cast(pa.list_(pa.int32()))], ["_at", "ws"])

    lists = images.sparkSession.range(n).mapInArrow(drawn, "_group long, _drawn binary").repartition("_group").sortWithinPartitions("_group")
    # Spark takes a list for one number when it guesses sizes, and would send all weights through the driver
    return lists.mapInArrow(counted, "_at long, ws array<int>").hint("shuffle_merge").join(at, "_at").select("image_id", "ws")


def draws(images: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """weights() as rows: b, image_id, w, where w is not 0. There are up to n_boot times as many as images."""
    return weights(images, n_boot, seed).select("image_id", F.posexplode("ws").alias("b", "w")).where("w > 0").select("b", "image_id", F.col("w").cast("long").alias("w"))


def _resampled(per: DataFrame, resamples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of per (the keys, image_id, _s, _n): the keys, b and _m, the sum of w * _s over that of w * _n, for each resample b that has an image of the key.

    Of weights(), a task multiplies its rows' sums by their weights, many images at once, and gives a row for each
    key and resample. Weights are never broadcast (see there).
    """
    if "ws" not in resamples.columns:
        met = resamples.join(per, "image_id")
        return met.groupBy(*by, "b").agg((F.sum(F.col("w") * F.col("_s")) / F.sum(F.col("w") * F.col("_n"))).alias("_m"))
    met = resamples.hint("shuffle_merge").join(per, "image_id").select(*by, F.col("_s").cast("double"), F.col("_n").cast("double"), "ws")
    schema = T.StructType([*(met.schema[k] for k in by), T.StructField("b", T.IntegerType()), *(T.StructField(k, T.DoubleType()) for k in ("_t", "_c"))])
    arrow = to_arrow_schema(schema)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ws = batch.column("ws").flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
            values = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in ("_s", "_n")])
            number = np.zeros(batch.num_rows, dtype=np.int64)
            for k in by:
                code = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
                number = np.unique(number * (int(code.max()) + 1) + code, return_inverse=True)[1]
            order = np.argsort(number, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
                key = tuple(batch.column(k)[int(rows[0])].as_py() for k in by)
                here = values[:, rows] @ ws[rows]
                sums[key] = sums[key] + here if key in sums else here
        for key, (t, c) in sums.items():
            b = np.flatnonzero(c)
            keys = [pa.array([v] * len(b), arrow.field(k).type) for k, v in zip(by, key, strict=True)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(b.astype(np.int32)), pa.array(t[b]), pa.array(c[b])], schema=arrow)

    return met.mapInArrow(summed, schema).groupBy(*by, "b").agg((F.sum("_t") / F.sum("_c")).alias("_m"))


def bootstrap_mean(values: DataFrame, resamples: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group the mean over rows and its 95 percent interval when images are resampled; records are weighted, not repeated.

    resamples are of weights() or draws(). With values of fewer than two images the interval and what it says are null.
    """
    per = values.where(F.col(value).isNotNull()).groupBy(*by, "image_id").agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    means = _resampled(per, resamples, by)
    interval = means.groupBy(*by).agg(F.percentile("_m", 0.025).alias("low"), F.percentile("_m", 0.975).alias("high"))
    whole = per.groupBy(*by).agg((F.sum("_s") / F.sum("_n")).alias("mean"), F.sum("_n").alias("n"), F.count(F.lit(1)).alias("_images"))
    bound = lambda k: F.when(F.col("_images") >= 2, F.col(k))
    met = whole.join(interval, list(by), "left") if by else whole.join(F.broadcast(interval))
    return met.withColumns({"low": bound("low"), "high": bound("high")}).drop("_images").withColumn("separable", (F.col("low") > 0) | (F.col("high") < 0))


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str, sign: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """Cases both sides have a value for: diff = b - a, and better in the metric's own direction."""
    right = b.select(*keys, *keep, F.col(value).alias("_b"))
    d = a.where(F.col(value).isNotNull()).join(right.where(F.col("_b").isNotNull()), keys).withColumn("diff", F.col("_b") - F.col(value))
    return d.select(*keys, *keep, "diff", (F.lit(sign) * F.col("diff") > 0).alias("better"))


def win_fraction(diffs: DataFrame, by: list[str], sign: int = 1, legacy_sign: bool = False) -> DataFrame:
    """By group of paired cases: how many, and the share of those that are better in the metric's own direction (sign -1 for distances).

    With legacy_sign a distance counts as better where it grew, as old reports did.
    """
    better = F.col("diff") > 0 if sign > 0 or legacy_sign else F.col("diff") < 0
    return diffs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(better.cast("double")).alias("win_fraction"))


def bootstrap_classes(values: DataFrame, resamples: DataFrame, value: str) -> DataFrame:
    """Mean of each class and (category_id null) of all classes alike, with 95 percent intervals when images are resampled.

    A class that no image of a resample has is left out of it. Intervals of fewer than two resamples that have the class are null.
    """
    per = values.where(F.col(value).isNotNull()).groupBy("image_id", "category_id").agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    again = _resampled(per, resamples, ["category_id"])
    macro = lambda means, *by: means.unionByName(means.groupBy(*by).agg(F.avg("_m").alias("_m")).withColumn("category_id", F.lit(None).cast("long")))
    bound = lambda p: F.when(F.count("_m") > 1, F.percentile("_m", p))
    intervals = macro(again, "b").groupBy(F.coalesce("category_id", F.lit(-1).cast("long")).alias("_c")).agg(bound(0.025).alias("low"), bound(0.975).alias("high"))
    whole = macro(per.groupBy("category_id").agg((F.sum("_s") / F.sum("_n")).alias("_m"))).withColumn("_c", F.coalesce("category_id", F.lit(-1).cast("long")))
    return whole.join(intervals, "_c", "left").select("category_id", F.col("_m").alias("mean"), "low", "high")


def noise_floor(runs: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Over seeds: mean, sample deviation, twice it in points, and half the width of a normal interval."""
    sd = F.stddev_samp(value)
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), sd.alias("sd"), (200 * sd).alias("two_sd_points"), (1.96 * sd / F.sqrt(F.count(F.lit(1)))).alias("half_width"))


def contrasts(runs: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(arm, reference) pairs seed by seed: mean effect, whether beyond twice the pooled deviation, relative percent."""
    spark = runs.sparkSession
    named = F.broadcast(spark.createDataFrame(pairs, "arm string, reference string"))
    a = runs.select("arm", "seed", "metric", F.col("value").alias("_a"))
    r = runs.select(F.col("arm").alias("reference"), "seed", "metric", F.col("value").alias("_r"))
    met = named.join(a, "arm").join(r, ["reference", "seed", "metric"])
    pooled = F.sqrt((F.var_samp("_a") + F.var_samp("_r")) / 2)
    effect = F.avg(F.col("_a") - F.col("_r"))
    return met.groupBy("arm", "reference", "metric").agg((100 * effect).alias("effect_points"), (F.abs(effect) > 2 * pooled).alias("beyond_noise"), (100 * effect / F.avg("_r")).alias("relative_percent"))


def against(means: DataFrame, baseline: str) -> DataFrame:
    """means (arm, metric, mean) with _b, the baseline arm's mean of the metric; metrics without it have no row.

    Each mean is computed once. A second computation may add up in another order, and the baseline would differ from itself.
    """
    base = F.max(F.when(F.col("arm") == baseline, F.col("mean"))).over(Window.partitionBy("metric"))
    return means.withColumn("_b", base).where("_b is not null")


def admitted(means: DataFrame, baseline: str, floor: float) -> DataFrame:
    """Arms by their mean: delta against the baseline arm, admitted if above the floor, and the best marked."""
    delta = against(means, baseline).withColumn("delta", F.col("mean") - F.col("_b"))
    best = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("mean"), "arm")) == 1
    return delta.select("arm", "metric", "mean", "delta", (F.col("delta") > floor).alias("is_admitted"), best.alias("is_best"))


def epochs(log: DataFrame) -> DataFrame:
    """Per run of (run, epoch, time_s, metric): epochs, steady seconds an epoch (without the first), peak, its epoch and the fall after it."""
    w = Window.partitionBy("run").orderBy("epoch")
    timed = log.withColumn("_d", F.col("time_s") - F.lag("time_s").over(w))
    return timed.groupBy("run").agg(F.max("epoch").alias("last_epoch"), F.avg("_d").alias("steady_s"), F.max("metric").alias("peak"), F.min_by("epoch", F.struct(-F.col("metric"), F.col("epoch"))).alias("peak_epoch"), (F.max("metric") - F.max_by("metric", "epoch")).alias("fall"))


def gain_shares(old: DataFrame, new: DataFrame, counts: DataFrame | None = None, by: Sequence[str] = (), least: int = 10) -> DataFrame:
    """Per class of two reports (category_id, ap): contribution to the gain of the mean, its share, and the gain without the class.

    With counts (category_id, train_n), n_improved and n_worsened count classes of at least so many train
    instances. new may hold several reports, told apart by the columns of by.
    """
    d = old.select("category_id", F.col("ap").alias("_o")).join(new.select(*by, "category_id", F.col("ap").alias("_n")), "category_id").withColumn("_d", F.col("_n") - F.col("_o"))
    every = Window.partitionBy(*by)
    k, total = F.count(F.lit(1)).over(every), F.sum("_d").over(every)
    shares = [(F.col("_d") / k).alias("contribution"), (F.col("_d") / F.nullif(total, F.lit(0.0))).alias("share"), ((total - F.col("_d")) / F.nullif(k - 1, F.lit(0))).alias("gain_without")]
    if counts is None:
        return d.select(*by, "category_id", *shares)
    many = lambda cond: F.count_if(cond & (F.col("train_n") >= least)).over(every)
    return d.join(counts.select("category_id", "train_n"), "category_id").select(*by, "category_id", *shares, many(F.col("_d") > 0).alias("n_improved"), many(F.col("_d") < 0).alias("n_worsened"))


def focal_losses(logits: DataFrame, priors: DataFrame, tau: float = 1.0, gamma: float = 2.0, alpha: float = 0.25) -> DataFrame:
    """logits (category_id, logit, target 0/1) with loss, the prior-adjusted sigmoid focal loss of each row; a negative alpha weighs both targets alike."""
    x = F.col("logit") - tau * F.ln("prior")
    t = F.col("target").cast("double")
    bce: Column = F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))
    p = 1 / (1 + F.exp(-x))
    p_t = p * t + (1 - p) * (1 - t)
    weight = alpha * t + (1 - alpha) * (1 - t) if alpha >= 0 else F.lit(1.0)
    return logits.join(priors, "category_id").withColumn("loss", weight * bce * F.pow(1 - p_t, F.lit(gamma))).drop("prior")


def focal_loss(logits: DataFrame, priors: DataFrame, tau: float = 1.0, gamma: float = 2.0, alpha: float = 0.25) -> DataFrame:
    """Per class: sum and mean of focal_losses()."""
    return focal_losses(logits, priors, tau, gamma, alpha).groupBy("category_id").agg(F.sum("loss").alias("loss_sum"), F.avg("loss").alias("loss_mean"))
