"""Registered queries of reports, vocabularies and experiment tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.geometry import evens
from corvane.functions.keys import hash32, uniform
from corvane.functions.ranges import numbered
from corvane.operators import audit, corpus, evaluation, experiments, replies, vocabulary
from corvane.plans import views
from corvane.plans.queries import _CELLS, _CHECKED, _COUNTS, _FLOOR, _IOU, _LINES, _LOG, _MISSED, _RUNS, _WEIGHTS, cases, class_flip_weights, class_weights, label_lines, noise_floor, quota_split, run_log, runs
from corvane.plans.registry import registered


@registered("""SELECT category_id, count(DISTINCT image_id) FILTER (WHERE split = 'valid') AS valid_images, count(DISTINCT image_id) FILTER (WHERE split = 'test') AS test_images
FROM v_ann JOIN v_img USING (image_id) GROUP BY 1 HAVING count(DISTINCT image_id) FILTER (WHERE split = 'valid') < 150""")
def thin_classes(spark: SparkSession, d: str) -> DataFrame:
    wide = corpus.class_counts(views.annotations(spark, d), views.images(spark, d))
    return wide.where("valid_images < 150").orderBy("valid_images", "category_id").select("category_id", "valid_images", "test_images")


@registered(f"""WITH {_LINES}, {_CHECKED}
SELECT split, count(*) AS n_lines, count(*) FILTER (WHERE problem = 'malformed_line') AS n_malformed_line, count(*) FILTER (WHERE problem = 'malformed_polygon') AS n_malformed_polygon,
 count(*) FILTER (WHERE problem = 'class_out_of_range') AS n_class_out_of_range, count(*) FILTER (WHERE problem = 'zero_area_polygon') AS n_zero_area_polygon, count(problem) = 0 AS passes FROM a JOIN (SELECT image_id, split FROM v_img) USING (image_id) GROUP BY 1""")
def split_verdicts(spark: SparkSession, d: str) -> DataFrame:
    split = views.images(spark, d).select("image_id", "split")
    return audit.split_verdicts(audit.check_label_lines(label_lines(spark, d), 32).join(split, "image_id"))



@registered(f"""WITH {_LINES}, p AS (SELECT *, string_split_regex(trim(line), '\\s+') AS t FROM lines WHERE trim(line) <> ''),
v AS (SELECT *, try_cast(t[1] AS INTEGER) AS class_id, list_transform(t[2:], lambda z: try_cast(z AS DOUBLE)) AS c FROM p),
g AS (SELECT *, list_transform(c, lambda z, i: greatest(0, least(1, z)) * CASE WHEN i % 2 = 1 THEN width ELSE height END) AS q FROM v WHERE class_id BETWEEN 0 AND 31 AND len(c) >= 6 AND len(c) % 2 = 0 AND len(list_filter(c, lambda z: z IS NULL)) = 0),
a AS (SELECT *, abs(list_sum(list_transform(range(1, len(q), 2), lambda i: q[i] * q[(i + 2) % len(q) + 1] - q[(i + 1) % len(q) + 1] * q[i + 1]))) / 2 AS area FROM g)
SELECT class_id + 1 AS category_id, count(*) AS n, count(*) FILTER (WHERE area < 1) AS n_dropped, avg(area) FILTER (WHERE area >= 1) AS area,
 avg(list_max(list_transform(range(1, len(q), 2), lambda i: q[i])) - list_min(list_transform(range(1, len(q), 2), lambda i: q[i]))) FILTER (WHERE area >= 1) AS bbox_width FROM a GROUP BY 1""")
def converted_labels(spark: SparkSession, d: str) -> DataFrame:
    kept = corpus.converted(label_lines(spark, d), 32).withColumn("_x", evens(F.col("polygon")))
    big = lambda v: F.avg(F.when(F.col("area") >= 1, v))
    return kept.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("area") < 1).alias("n_dropped"), big(F.col("area")).alias("area"), big(F.array_max("_x") - F.array_min("_x")).alias("bbox_width"))


@registered("""SELECT split, count(DISTINCT image_id) AS n_images, count(DISTINCT file_name) AS n_files, count(DISTINCT patient) AS n_patients, count(ann_key) AS n_annotations, count(DISTINCT category_id) AS n_classes FROM v_img LEFT JOIN v_ann USING (image_id) GROUP BY 1""")
def split_totals(spark: SparkSession, d: str) -> DataFrame:
    met = views.images(spark, d).join(views.annotations(spark, d).select("image_id", "ann_key", "category_id"), "image_id", "left")
    return met.groupBy("split").agg(F.count_distinct("image_id").alias("n_images"), F.count_distinct("file_name").alias("n_files"), F.count_distinct("patient").alias("n_patients"), F.count("ann_key").alias("n_annotations"), F.count_distinct("category_id").alias("n_classes"))


_QUOTA = """freq AS (SELECT category_id, count(*) AS f FROM v_ann GROUP BY 1),
rare AS (SELECT patient, arg_min(category_id, (f, category_id)) AS s FROM v_ann JOIN v_img USING (image_id) JOIN freq USING (category_id) GROUP BY 1),
z AS (SELECT patient, count(*) AS n_files FROM v_img GROUP BY 1), c AS (SELECT patient, coalesce(s, -1) AS stratum, n_files FROM z LEFT JOIN rare USING (patient)),
q AS (SELECT *, (sum(n_files) OVER (PARTITION BY stratum ORDER BY md5('0/' || patient), patient) - n_files) / sum(n_files) OVER (PARTITION BY stratum) AS share FROM c),
assigned AS (SELECT patient, CASE WHEN share < 0.7 THEN 'train' WHEN share < 0.7::DOUBLE + 0.15::DOUBLE THEN 'valid' ELSE 'test' END AS new_split FROM q),
placed AS (SELECT i.image_id, i.patient, a.new_split FROM v_img i JOIN assigned a USING (patient))"""


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return views.images(spark, d).select("image_id", "patient").join(quota_split(spark, d).select("patient", F.col("split").alias("new_split")), "patient")


@registered(f"""WITH {_QUOTA} SELECT (SELECT count(*) FROM (SELECT patient FROM placed GROUP BY 1 HAVING count(DISTINCT new_split) > 1)) AS n_shared,
 (SELECT count(*) FROM (SELECT DISTINCT category_id FROM v_ann EXCEPT SELECT category_id FROM v_ann JOIN placed USING (image_id) WHERE new_split = 'train')) AS n_absent_in_train""")
def split_verification(spark: SparkSession, d: str) -> DataFrame:
    return corpus.verified_split(_placed(spark, d).withColumnRenamed("new_split", "split"), views.annotations(spark, d), "patient")


@registered(f"WITH {_QUOTA} SELECT new_split AS split, count(DISTINCT image_id) AS n_images, count(ann_key) AS n_annotations, count(*) FILTER (WHERE ann_key IS NULL) AS n_without_labels FROM placed LEFT JOIN v_ann USING (image_id) GROUP BY 1")
def materialised_split(spark: SparkSession, d: str) -> DataFrame:
    met = _placed(spark, d).join(views.annotations(spark, d).select("image_id", "ann_key"), "image_id", "left")
    return met.groupBy(F.col("new_split").alias("split")).agg(F.count_distinct("image_id").alias("n_images"), F.count("ann_key").alias("n_annotations"), F.count_if(F.col("ann_key").isNull()).alias("n_without_labels"))


@registered("""SELECT model, min(score) AS least, max(score) AS most, avg(score) AS mean, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.95) AS p95, quantile_cont(score, 0.99) AS p99, count(*) FILTER (WHERE score >= 0.9) AS n_above FROM v_det GROUP BY 1""")
def score_distribution(spark: SparkSession, d: str) -> DataFrame:
    return audit.distribution(views.detections(spark, d), ["model"], "score", 0.9)


_NAMES = """cats AS (SELECT DISTINCT category_id, CASE WHEN category_id % 2 = 0 THEN 'Class ' ELSE 'class ' END || category_id AS name FROM v_ann), asked AS (SELECT unnest(['class ', 'Class ', 'CLASS ']) || n AS name FROM (SELECT unnest(range(1, 41)) AS n))"""


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ids = views.annotations(spark, d).select("category_id").distinct()
    cats = ids.select("category_id", F.concat(F.when(F.col("category_id") % 2 == 0, "Class ").otherwise("class "), F.col("category_id")).alias("name"))
    return spark.range(1, 41).select(F.explode(F.array(*map(F.lit, ("class ", "Class ", "CLASS ")))).alias("p"), "id").select(F.concat("p", "id").alias("name")), cats


@registered(f"WITH {_NAMES} SELECT a.name, coalesce(e.category_id, l.category_id) AS category_id FROM asked a LEFT JOIN cats e ON e.name = a.name LEFT JOIN cats l ON lower(l.name) = lower(a.name)")
def class_mapping(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.mapped_names(*_names(spark, d))


@registered(f"WITH {_NAMES} SELECT name, 'left' AS side FROM (SELECT name FROM asked EXCEPT SELECT name FROM cats) UNION ALL SELECT name, 'right' FROM (SELECT name FROM cats EXCEPT SELECT name FROM asked)")
def vocabulary_differences(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.vocabulary_differences(*_names(spark, d))


@registered("SELECT category_id % 3 AS category_id, count(*) AS n, count(DISTINCT image_id) AS n_images FROM v_ann WHERE category_id <= 12 GROUP BY 1")
def external_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    mapping = spark.range(1, 13).select(F.col("id").alias("category_id"), (F.col("id") % 3).alias("new_id"))
    a = vocabulary.revocabulary(views.annotations(spark, d), mapping)
    return vocabulary.with_annotations(a, a).groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("image_id").alias("n_images"))


@registered("SELECT split, max(category_id) + 1 AS num_classes FROM v_ann JOIN v_img USING (image_id) GROUP BY 1")
def head_sizes(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.head_sizes(views.annotations(spark, d), views.images(spark, d))


@registered("""WITH f AS (SELECT * FROM v_img WHERE split = 'train'), s AS (SELECT * FROM v_img WHERE image_id % 2 = 0)
SELECT file_name, 'first' AS provenance FROM f UNION ALL SELECT file_name, 'second' FROM s WHERE file_name NOT IN (SELECT file_name FROM f)""")
def merged_corpora(spark: SparkSession, d: str) -> DataFrame:
    names = views.images(spark, d)
    return vocabulary.merged_corpora(names.where("split = 'train'").select("file_name"), names.where("image_id % 2 = 0").select("file_name"))


@registered("""SELECT a.image_id, a.ann_key, coalesce(max((b.category_id <= 5)::INTEGER), 0) AS common, coalesce(max((b.category_id > 5)::INTEGER), 0) AS other
FROM v_ann a LEFT JOIN v_det b ON b.image_id = a.image_id AND b.model = 0 AND b.x + b.w / 2.0 BETWEEN a.x AND a.x + a.w AND b.y + b.h / 2.0 BETWEEN a.y AND a.y + a.h GROUP BY 1, 2""")
def centres_in_boxes(spark: SparkSession, d: str) -> DataFrame:
    points = views.detections(spark, d).where("model = 0").select("image_id", (F.col("x") + F.col("w") / 2).alias("px"), (F.col("y") + F.col("h") / 2).alias("py"), "category_id")
    return evaluation.centres_in_boxes(views.annotations(spark, d), points, {"common": F.col("_c") <= 5, "other": F.col("_c") > 5})


@registered(f"""WITH {_CELLS}, per AS (SELECT model, category_id, avg(dice) AS dice, avg(iou) AS iou FROM cases GROUP BY 1, 2)
SELECT model, 'macro' AS kind, avg(dice) AS dice, avg(iou) AS iou FROM per GROUP BY 1 UNION ALL SELECT model, 'micro', avg(dice), avg(iou) FROM cases GROUP BY 1""")
def macro_micro(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.macro_micro(cases(spark, d))


@registered(f"""WITH {_CELLS}, n AS (SELECT category_id, count(*) AS train_n FROM v_ann JOIN v_img USING (image_id) WHERE split = 'train' GROUP BY 1),
per AS (SELECT model, category_id, avg(dice) AS value FROM cases GROUP BY 1, 2)
SELECT model, CASE WHEN train_n > 5000 THEN 'head' WHEN train_n < 700 THEN 'tail' ELSE 'mid' END AS grp, avg(value) AS mean, count(*) AS n_classes FROM per JOIN n USING (category_id) GROUP BY 1, 2""")
def group_means(spark: SparkSession, d: str) -> DataFrame:
    per = cases(spark, d).groupBy("model", "category_id").agg(F.avg("dice").alias("value"))
    return evaluation.group_means(per, corpus.class_counts(views.annotations(spark, d), views.images(spark, d)), 5000, 700)


@registered("SELECT model, count(*) AS n, count(DISTINCT image_id) AS n_images, count(*) FILTER (WHERE score >= 0.9) AS n_kept FROM v_det GROUP BY 1")
def export_stats(spark: SparkSession, d: str) -> DataFrame:
    return views.detections(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("image_id").alias("n_images"), F.count_if(F.col("score") >= 0.9).alias("n_kept"))


@registered("SELECT category_id, ann_key, w * h AS area FROM v_ann QUALIFY row_number() OVER (PARTITION BY category_id ORDER BY w * h DESC, ann_key) <= 5")
def audit_list(spark: SparkSession, d: str) -> DataFrame:
    return corpus.largest_of_class(views.annotations(spark, d), 5)


@registered("SELECT image_id FROM v_img ORDER BY image_id LIMIT 100")
def pilot_images(spark: SparkSession, d: str) -> DataFrame:
    return views.images(spark, d).select("image_id").orderBy("image_id").limit(100)


@registered("SELECT category_id, quantile_cont(sqrt(w * h), 0.5) AS median_side FROM v_ann GROUP BY 1 ORDER BY 2, 1 LIMIT 12")
def smallest_classes(spark: SparkSession, d: str) -> DataFrame:
    return corpus.smallest_classes(views.annotations(spark, d), 12)


@registered("""WITH a AS (SELECT category_id, avg(w * h) AS x FROM v_ann WHERE image_id % 2 = 0 GROUP BY 1), b AS (SELECT category_id, avg(w * h) AS y FROM v_ann WHERE image_id % 2 = 1 GROUP BY 1)
SELECT category_id, x / y AS ratio FROM a JOIN b USING (category_id)""")
def granularity(spark: SparkSession, d: str) -> DataFrame:
    a = views.annotations(spark, d)
    return evaluation.area_ratios(a.where("image_id % 2 = 0"), a.where("image_id % 2 = 1"))


@registered(f"WITH {_WEIGHTS} SELECT min(logit_shift) AS least_shift, max(logit_shift) AS most_shift, max(logit_shift) - min(logit_shift) AS spread, max(n) / min(n) FILTER (WHERE n > 0) AS imbalance FROM weights")
def logit_shifts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.shift_summary(class_weights(spark, d))


@registered(f"""WITH {_WEIGHTS} SELECT scheme, max(weight) / min(weight) AS ratio, avg(weight) FILTER (WHERE n > 5000) AS head, avg(weight) FILTER (WHERE n < 700) AS tail
FROM (SELECT 'effective_number' AS scheme, n, effective_number AS weight FROM weights UNION ALL SELECT 'inverse_sqrt', n, inverse_sqrt FROM weights UNION ALL SELECT 'none', n, 1.0 FROM weights) GROUP BY 1""")
def scheme_ratios(spark: SparkSession, d: str) -> DataFrame:
    return corpus.scheme_ratios(class_weights(spark, d), 5000, 700)


@registered(f"""WITH {_WEIGHTS}, p AS (SELECT category_id, n, -logit_shift AS lp FROM weights) SELECT model, ann_key, 1 / (1 + exp(-(ln(s / (1 - s)) - lp))) AS adjusted
FROM (SELECT *, greatest(0.0001::DOUBLE, least(0.9999::DOUBLE, score)) AS s FROM v_det) JOIN p USING (category_id)""")
def adjusted_scores(spark: SparkSession, d: str) -> DataFrame:
    return corpus.adjusted_scores(views.detections(spark, d), class_weights(spark, d)).select("model", "ann_key", "adjusted")


@registered(f"WITH {_RUNS} SELECT a.metric, avg(a.value - r.value) AS effect, stddev_samp(a.value - r.value) AS sd, abs(avg(a.value - r.value)) > 2 * stddev_samp(a.value - r.value) AS exceeds_noise FROM runs a JOIN runs r USING (seed, metric) WHERE a.arm = 'm1' AND r.arm = 'm0' GROUP BY 1")
def seed_effects(spark: SparkSession, d: str) -> DataFrame:
    return experiments.seed_effects(runs(spark, d), "m1", "m0")


@registered(f"WITH {_RUNS}, {_FLOOR} SELECT a.metric, CASE WHEN b.mean - a.mean > 0.003 THEN 'm2' ELSE 'm0' END AS arm, b.mean - a.mean AS delta FROM floor_of a JOIN floor_of b USING (metric) WHERE a.arm = 'm0' AND b.arm = 'm2'")
def threshold_choice(spark: SparkSession, d: str) -> DataFrame:
    return experiments.chosen(noise_floor(spark, d), "m0", "m2", 0.003)


@registered(f"WITH {_RUNS}, p AS (SELECT arm || '/' || metric AS curve, seed, value FROM runs) SELECT curve, seed, value, (value - lag(value) OVER w) / nullif(seed - lag(seed) OVER w, 0) AS slope, value - first_value(value) OVER w AS change FROM p WINDOW w AS (PARTITION BY curve ORDER BY seed)")
def learning_curves(spark: SparkSession, d: str) -> DataFrame:
    return experiments.curve(runs(spark, d).withColumn("curve", F.concat_ws("/", "arm", "metric")), "curve", "seed", "value")


@registered(f"""WITH {_RUNS}, {_FLOOR} SELECT f.metric, row_number() OVER w AS place, f.arm, f.mean, 100 * (f.mean - b.mean) AS delta_points, 100 * (f.mean - b.mean) / b.mean AS relative_percent, CASE WHEN row_number() OVER w = 1 THEN '*' ELSE '' END AS mark
FROM floor_of f JOIN floor_of b ON b.metric = f.metric AND b.arm = 'm0' WINDOW w AS (PARTITION BY f.metric ORDER BY f.mean DESC, f.arm)""")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return experiments.leaderboard(noise_floor(spark, d), "m0")


@registered(f"WITH {_RUNS}, {_FLOOR} SELECT arm, count(*) AS n_metrics FROM (SELECT metric, arg_min(arm, (-mean, arm)) AS arm FROM floor_of GROUP BY 1) GROUP BY 1")
def best_of_metrics(spark: SparkSession, d: str) -> DataFrame:
    return experiments.best_of_metrics(noise_floor(spark, d))


@registered(f"""WITH {_RUNS}, {_FLOOR}, x AS (SELECT f.metric, f.arm, f.mean - b.mean AS delta, f.arm IN ('m1', 'm2', 'm3') AS v FROM floor_of f JOIN floor_of b ON b.metric = f.metric AND b.arm = 'm0' WHERE f.mean - b.mean > -0.01)
SELECT metric, arm, delta FROM x QUALIFY NOT v OR row_number() OVER (PARTITION BY metric, v ORDER BY delta DESC, arm) = 1""")
def exclusive_levers(spark: SparkSession, d: str) -> DataFrame:
    return experiments.exclusive_levers(noise_floor(spark, d), "m0", -0.01, ["m1", "m2", "m3"])


@registered(f"WITH {_RUNS}, {_FLOOR} SELECT f.arm, f.metric, CASE WHEN f.mean > b.mean THEN 'better' WHEN f.mean < b.mean THEN 'worse' ELSE 'equal' END AS verdict FROM floor_of f JOIN floor_of b ON b.metric = f.metric AND b.arm = 'm0'")
def final_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return experiments.verdicts(noise_floor(spark, d), "m0")


@registered(f"""WITH {_LOG}, s AS (SELECT run, avg(d) AS s FROM timed GROUP BY 1), r AS (SELECT min(run) AS ref FROM log),
a AS (SELECT l.run, max(abs(x.metric - l.metric) / greatest(abs(x.metric), 1e-8)) AS dev FROM log l JOIN log x ON x.epoch = l.epoch AND x.run = (SELECT ref FROM r) GROUP BY 1)
SELECT run, (SELECT s FROM s WHERE run = (SELECT ref FROM r)) / s AS speedup, coalesce(dev, 0) AS deviation, coalesce(dev <= 0.02, true) AS equivalent, coalesce(dev <= 0.02, true) AND (SELECT s FROM s WHERE run = (SELECT ref FROM r)) / s > 1.02 AS adopt FROM s LEFT JOIN a USING (run) WHERE run <> (SELECT ref FROM r)""")
def speed_equivalence(spark: SparkSession, d: str) -> DataFrame:
    return experiments.equivalence(run_log(spark, d).withColumnRenamed("metric", "loss"))


@registered("SELECT image_id, row_number() OVER (ORDER BY file_name) AS number FROM v_img")
def image_numbers(spark: SparkSession, d: str) -> DataFrame:
    return numbered(views.images(spark, d).select("image_id", "file_name"), ["file_name"], "number").select("image_id", "number")


@registered(f"""WITH {_COUNTS}, p AS (SELECT category_id, CASE WHEN n > 0 THEN 1 / sqrt(n) ELSE 0 END AS r FROM counts), c AS (SELECT category_id, sum(r) OVER (ORDER BY category_id) / sum(r) OVER () AS cumulative FROM p),
u AS (SELECT ann_key, ('0x' || substr(md5('flip/' || ann_key), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM v_ann)
SELECT drawn, count(*) AS n FROM (SELECT (SELECT min(category_id) FROM c WHERE cumulative > u) AS drawn FROM u) GROUP BY 1""")
def class_flips(spark: SparkSession, d: str) -> DataFrame:
    flipped = corpus.weighted_draws(views.annotations(spark, d).select("ann_key"), class_flip_weights(spark, d), uniform(F.concat(F.lit("flip/"), F.col("ann_key"))))
    return flipped.groupBy("drawn").agg(F.count(F.lit(1)).alias("n"))


@registered("""WITH pasted AS (SELECT image_id, ann_key FROM v_ann WHERE category_id % 5 = 0)
SELECT split, 'original' AS provenance, count(*) AS n FROM v_img GROUP BY 1 UNION ALL SELECT split, 'pasted', count(*) FROM pasted JOIN v_img USING (image_id) WHERE split = 'train' GROUP BY 1""")
def paste_guard(spark: SparkSession, d: str) -> DataFrame:
    pasted = views.annotations(spark, d).where("category_id % 5 = 0").select("image_id", F.col("ann_key").alias("source_id"))
    return corpus.pasted_corpus(views.images(spark, d), pasted).groupBy("split", "provenance").agg(F.count(F.lit(1)).alias("n"))


def reply_texts(spark: SparkSession, d: str) -> DataFrame:
    """A model's reply on each annotation, some of them faulty in one of eight ways by a hash: ann_key, image_id, width, height, text."""
    a = views.annotations(spark, d).join(views.images(spark, d).select("image_id", "width", "height"), "image_id")
    box = lambda *v: F.concat(F.lit("["), F.concat_ws(", ", *v), F.lit("]"))
    x0, y0, x1, y1 = "x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")
    item = lambda name, b, more: F.concat(F.lit('[{"class": "'), name, F.lit('", "box_2d": '), b, F.lit(more + "}]"))
    name, k = F.concat(F.lit("class "), F.col("category_id")), hash32(F.concat(F.lit("r/"), F.col("ann_key"))) % 16
    text = (
        F.when(k == 0, F.lit("I see no [boxes"))
        .when(k == 1, item(F.lit("nothing"), box(x0, y0, x1, y1), ', "confidence": 0.7'))
        .when(k == 2, item(name, box(x0, y0, x1), ', "confidence": 0.7'))
        .when(k == 3, item(name, box(x1, y1, x0, y0), ', "confidence": 1.5'))
        .when(k == 4, item(F.concat(F.lit(" "), F.upper(name)), box(x0, y0, x1, y1), ""))
        .when(k == 5, item(name, box(x0, y0, x0, y1), ', "confidence": 0.7'))
        .when(k == 6, item(name, box(x0, y0, F.lit(5000), y1), ', "confidence": "high"'))
        .when(k == 7, F.lit('[{"class": "class 1", oops}]'))
        .otherwise(F.concat(F.lit("Here it is:\n```json\n"), item(name, box(x0, y0, x1, y1), ', "confidence": 0.25'), F.lit("\n```\nand [more]")))
    )
    return a.select("ann_key", "image_id", "width", "height", text.alias("text"))


@registered("""WITH r AS (SELECT *, ('0x' || substr(md5('r/' || ann_key), 1, 8))::BIGINT % 16 AS k FROM v_ann JOIN v_img USING (image_id)),
b AS (SELECT image_id, category_id, least(x, width)::DOUBLE AS x0, least(y, height)::DOUBLE AS y0, least(CASE WHEN k = 6 THEN 5000 ELSE x + w END, width)::DOUBLE AS x1, least(y + h, height)::DOUBLE AS y1,
 CASE WHEN k = 3 THEN 1.0 WHEN k IN (4, 6) THEN 0.5 ELSE 0.25 END::DOUBLE AS score FROM r WHERE k NOT IN (0, 1, 2, 5, 7))
SELECT image_id, category_id, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h, score FROM b WHERE x1 - x0 >= 1 AND y1 - y0 >= 1""")
def reply_boxes(spark: SparkSession, d: str) -> DataFrame:
    ids = views.annotations(spark, d).select("category_id").distinct()
    return replies.reply_boxes(reply_texts(spark, d), ids.select("category_id", F.concat(F.lit("class "), F.col("category_id")).alias("name")))


@registered("""WITH m AS (SELECT b.model, a.category_id, CASE WHEN a.x + a.w <= b.x OR b.x + b.w <= a.x OR a.y + a.h <= b.y OR b.y + b.h <= a.y THEN 0 ELSE
 (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) END AS common, a.w * a.h + b.w * b.h AS total FROM v_ann a JOIN v_det b ON b.image_id = a.image_id AND b.ann_key = a.ann_key AND b.category_id = a.category_id)
SELECT model, category_id, avg(common / (total - common)) AS box_iou, count(*) AS n FROM m GROUP BY 1, 2""")
def box_control(spark: SparkSession, d: str) -> DataFrame:
    truth = views.annotations(spark, d).withColumnsRenamed({k: f"a_{k}" for k in "xywh"})
    found = views.detections(spark, d).withColumnsRenamed({k: f"d_{k}" for k in "xywh"})
    return evaluation.box_overlap(truth.join(found, ["image_id", "ann_key", "category_id"]))


@registered("""WITH c AS (SELECT DISTINCT file_name, CASE WHEN instr(file_name, 'rf.') > 0 THEN substr(file_name, instr(file_name, 'rf.')) ELSE 'rf.' || substr(sha256(file_name), 1, 32) || '.jpg' END AS clean FROM v_img)
SELECT clean, file_name AS original, count(*) OVER (PARTITION BY clean) > 1 AS collides FROM c QUALIFY clean <> file_name""")
def anonymisation_map(spark: SparkSession, d: str) -> DataFrame:
    return audit.anonymisation_map(views.images(spark, d))


@registered(f"""WITH {_LINES}, {_CHECKED},
good AS (SELECT image_id, list_transform(c, lambda z, i: greatest(0, least(1, z)) * CASE WHEN i % 2 = 1 THEN width ELSE height END) AS q FROM v WHERE class_id BETWEEN 0 AND 31 AND len(c) >= 6 AND len(c) % 2 = 0 AND len(list_filter(c, lambda z: z IS NULL)) = 0),
kept AS (SELECT image_id, count(*) AS n FROM good WHERE abs(list_sum(list_transform(range(1, len(q), 2), lambda i: q[i] * q[(i + 2) % len(q) + 1] - q[(i + 1) % len(q) + 1] * q[i + 1]))) / 2 >= 1 GROUP BY 1),
per AS (SELECT i.image_id, f.image_id IS NULL AS negative, g.n AS lines, k.n AS kept FROM v_img i LEFT JOIN (SELECT DISTINCT image_id FROM lines) f USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS n FROM p GROUP BY 1) g USING (image_id) LEFT JOIN kept k USING (image_id))
SELECT count(*) AS n_images, count(*) FILTER (WHERE negative) AS n_negatives, count(*) FILTER (WHERE NOT negative AND kept IS NULL) AS n_empty, sum(coalesce(kept, 0))::BIGINT AS n_annotations, sum(coalesce(lines, 0) - coalesce(kept, 0))::BIGINT AS n_dropped FROM per""")
def conversion_report(spark: SparkSession, d: str) -> DataFrame:
    return corpus.conversion_report(views.images(spark, d), label_lines(spark, d), 32)


@registered(f"""WITH missed AS ({_MISSED}), suspects AS (SELECT a.* FROM v_ann a WHERE a.ann_key IN (SELECT ann_key FROM missed GROUP BY 1 HAVING count(DISTINCT model) = 5)),
marked AS (SELECT a.image_id, EXISTS (SELECT 1 FROM suspects b WHERE b.image_id = a.image_id AND b.category_id = a.category_id AND {_IOU} >= 0.5) AS gone FROM v_ann a),
per AS (SELECT image_id, count(*) AS n, count(*) FILTER (WHERE NOT gone) AS k FROM marked GROUP BY 1)
SELECT sum(k)::BIGINT AS n_kept, sum(n - k)::BIGINT AS n_dropped, count(*) FILTER (WHERE k < n) AS n_touched, count(*) FILTER (WHERE k = 0) AS n_emptied FROM per""")
def denoise_report(spark: SparkSession, d: str) -> DataFrame:
    a = views.annotations(spark, d)
    lost = evaluation.universal_misses(a, views.detections(spark, d), range(views.N_MODELS)).select("ann_key")
    return corpus.denoise_report(a, a.join(lost, "ann_key", "left_semi"))


@registered("WITH per AS (SELECT image_id, count(*) AS n, count(*) FILTER (WHERE category_id % 3 = 0) AS k FROM v_ann JOIN v_img USING (image_id) GROUP BY 1) SELECT sum(k)::BIGINT AS n_kept, sum(n - k)::BIGINT AS n_dropped, count(*) FILTER (WHERE k = 0) AS n_emptied FROM per")
def restriction_report(spark: SparkSession, d: str) -> DataFrame:
    a = views.annotations(spark, d)
    return corpus.restriction_report(a, views.images(spark, d), a.where("category_id % 3 = 0").select("category_id"))


@registered("SELECT patient, category_id, count(*) AS n FROM v_ann JOIN v_img USING (image_id) GROUP BY 1, 2")
def group_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.group_class_counts(views.annotations(spark, d), views.images(spark, d), "patient")


@registered("SELECT image_id, ann_key, category_id FROM v_ann WHERE category_id IN (1, 2, 3)")
def focused_classes(spark: SparkSession, d: str) -> DataFrame:
    """Annotations of three classes named in other cases; a name that no class has would stop the job."""
    categories = spark.range(1, 33).select(F.col("id").alias("category_id"), F.concat(F.lit("class "), "id").alias("name"))
    names = spark.range(1, 4).select(F.concat(F.lit("CLASS "), "id").alias("name"))
    return vocabulary.focused(views.annotations(spark, d), categories, names).select("image_id", "ann_key", "category_id")


@registered(f"""WITH {_LOG}, per AS (SELECT run % 7 AS arm, run, max(epoch) AS last, max(metric) AS best FROM log GROUP BY 1, 2)
SELECT arm, min(run) FILTER (WHERE last >= 40 AND best = top) AS run, any_value(top) AS best, count(*) AS n_runs, count(*) FILTER (WHERE last < 40) AS n_incomplete FROM (SELECT *, max(best) FILTER (WHERE last >= 40) OVER (PARTITION BY arm) AS top FROM per) GROUP BY 1""")
def best_runs(spark: SparkSession, d: str) -> DataFrame:
    return experiments.best_runs(run_log(spark, d).withColumn("arm", F.col("run") % 7), 40)


@registered("""WITH l AS (SELECT image_id, category_id FROM v_det WHERE model = 0), a AS (SELECT image_id, count(*) AS n FROM v_ann GROUP BY 1), b AS (SELECT image_id, count(*) AS n FROM l GROUP BY 1),
x AS (SELECT category_id, count(*) AS n FROM v_ann GROUP BY 1), y AS (SELECT category_id, count(*) AS n FROM l GROUP BY 1)
SELECT CASE WHEN b.n IS NULL THEN 'image_only_left' ELSE 'image_only_right' END AS kind, image_id, NULL::BIGINT AS category_id, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right FROM a FULL JOIN b USING (image_id) WHERE a.n IS NULL OR b.n IS NULL
UNION ALL SELECT 'unknown_image', image_id, NULL, coalesce(a.n, 0), coalesce(b.n, 0) FROM a FULL JOIN b USING (image_id) WHERE image_id NOT IN (SELECT image_id FROM v_img)
UNION ALL SELECT 'class_count', NULL, category_id, coalesce(x.n, 0), coalesce(y.n, 0) FROM x FULL JOIN y USING (category_id) WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)""")
def annotation_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Annotations against the detections of model 0, as if these were the corpus's label files."""
    return audit.annotation_reconciliation(views.images(spark, d), views.annotations(spark, d), views.detections(spark, d).where("model = 0").select("image_id", "category_id"))
