"""Operators against values worked out by hand or by plain Python."""

import hashlib
import random
from collections import Counter

import duckdb
import pandas as pd
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions.geometry import box_iou, box_polygon, corners, polygon_bbox, shoelace_area
from corvane.functions.keys import anonymous, md5_heads, patient_key, source_key
from corvane.functions.ranges import numbered, running_sums
from corvane.operators import audit, coco, corpus, evaluation, experiments, replies, statistics
from corvane.plans import queries as plans

TINY = "/root/testdata/sf0.001"
BOXES = "image_id long, category_id long, ann_key string, x double, y double, w double, h double"


def test_geometry(spark):
    df = spark.createDataFrame([([0.0, 0.0, 4.0, 0.0, 4.0, 3.0],), ([1.0, 1.0, 2.0, 2.0],)], "p array<double>")
    assert [r[0] for r in df.select(shoelace_area(F.col("p"))).collect()] == [6.0, 0.0]
    assert df.select(polygon_bbox(F.col("p"))).first()[0] == (0.0, 0.0, 4.0, 3.0)
    iou = spark.createDataFrame([(0, 0, 10, 10, 5, 0, 10, 10), (0, 0, 1, 1, 5, 5, 1, 1), (0, 0, 0, 0, 0, 0, 0, 0)], "ax int, ay int, aw int, ah int, bx int, by int, bw int, bh int")
    assert [r[0] for r in iou.select(box_iou("a", "b")).collect()] == [pytest.approx(1 / 3), 0.0, 0.0]
    turned = spark.range(1).select(corners(F.lit(9.0), F.lit(2.0), F.lit(4.0), F.lit(8.0))).first()[0]
    assert tuple(turned) == (4.0, 2.0, 5.0, 6.0)
    clip = spark.range(1).select(box_polygon(F.lit(-5.0), F.lit(0.0), F.lit(10.0), F.lit(4.0), F.lit(100), F.lit(100)), box_polygon(F.lit(-50.0), F.lit(0.0), F.lit(10.0), F.lit(4.0), F.lit(100), F.lit(100))).first()
    assert clip[0] == [0.0, 0.0, 5.0, 0.0, 5.0, 4.0, 0.0, 4.0] and clip[1] is None


def test_keys(spark):
    names = ["0a1b2c3d-Smith_J_2021-03-04_jpg.rf.0123abcdef.jpg", "plain.png", "Doe-45yo_png.rf.aa11.jpg", "Doe 45 yo.jpg", "a_jpg.rf.abc_v2.jpg", "2020-01-02.JPG"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(source_key(F.col("n")), patient_key(source_key(F.col("n"))), anonymous(F.col("n"))).collect()
    assert [tuple(r)[:2] for r in got] == [("Smith_J_2021-03-04", "smith_j"), ("plain", "plain"), ("Doe-45yo_png.rf.aa11", "doe"), ("Doe 45 yo", "doe"), ("a_jpg.rf.abc_v2", "a_jpg.rf.abc_v2"), ("2020-01-02", "2020-01-02")]
    assert got[0][2] == "rf.0123abcdef.jpg" and got[1][2].startswith("rf.") and got[1][2].endswith(".png")


def test_banded_join_is_exhaustive(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(63) for _ in range(60)]
    hashes = [(f"a{i}", h) for i, h in enumerate(base)] + [(f"b{i}", h ^ sum(1 << b for b in rnd.sample(range(63), rnd.randint(0, 8)))) for i, h in enumerate(base)]
    df = spark.createDataFrame(hashes, "file_name string, dhash long")
    got = {tuple(r) for r in audit.hamming_pairs(df.where("file_name like 'a%'"), df.where("file_name like 'b%'")).collect()}
    want = {(a, b, (x ^ y).bit_count()) for a, x in hashes for b, y in hashes if a[0] == "a" and b[0] == "b" and (x ^ y).bit_count() <= 5}
    assert got == want and want


def test_a_rejected_nearer_candidate_hides_no_duplicate(spark):
    rnd = random.Random(9)
    thumb, other, third = ([rnd.random() for _ in range(64)] for _ in range(3))
    rows = [("t1", thumb, 0), ("t2", other, 1 << 40), ("t3", thumb, 1 << 50), ("near", third, 0), ("same", [v + 1 for v in thumb], 0b111), ("same2", thumb, 0b111), ("far", third, 1 << 40)]
    df = spark.createDataFrame(rows, "file_name string, thumb array<double>, dhash long")
    pairs = audit.hamming_pairs(df.where("file_name like 't%'"), df.where("file_name not like 't%'"))
    got = {r.left_file: (r.right_file, r.hamming, r.n_pairs, r.verdict) for r in audit.confirmed_partners(pairs, df).collect()}
    assert got == {"t1": ("same", 3, 4, "confirmed"), "t2": ("far", 0, 4, "rejected"), "t3": ("same", 4, 4, "confirmed")}


def test_self_evaluation_is_perfect(spark):
    rows = [(i, c, f"{i}-{c}-{k}", 100.0 * k, 10.0, 20.0 + 30 * k, 20.0 + 30 * k) for i in range(12) for c in (1, 2) for k in range(2)]
    gt = spark.createDataFrame(rows, BOXES)
    ap = coco.coco_ap(gt, gt.withColumn("score", F.lit(0.9)))
    assert all(r.ap == pytest.approx(1.0) and r.recall == 1.0 for r in ap.where("area = 'all' and max_det = 100").collect())
    moved = gt.withColumns({"x": F.col("x") + F.when(F.col("category_id") == 2, 30).otherwise(0), "score": F.lit(0.9)})
    worse = {r.category_id: r.ap for r in coco.coco_ap(gt, moved).where("area = 'all' and max_det = 100 and thr = 0").collect()}
    assert worse[1] == pytest.approx(1.0) and worse[2] < 0.1
    assert {r.metric: r.value for r in coco.coco_summary(ap).collect()}["AP"] == pytest.approx(1.0)


def test_ap_of_known_curve(spark):
    gt = spark.createDataFrame([(i, 1, str(i), 0.0, 0.0, 50.0, 50.0) for i in range(4)], BOXES)
    det = [(i, 1, f"d{i}", 0.0 if hit else 500.0, 0.0, 50.0, 50.0, s) for i, (hit, s) in enumerate([(True, 0.9), (False, 0.8), (True, 0.7)])]
    got = coco.coco_ap(gt, spark.createDataFrame(det, BOXES + ", score double")).where("area = 'all' and max_det = 100 and thr = 0").first()
    points = [1.0 if r <= 0.25 else 2 / 3 if r <= 0.5 else 0.0 for r in (i / 100 for i in range(101))]
    assert got.ap == pytest.approx(sum(points) / 101) and got.recall == 0.5


def test_greedy_instances(spark):
    pairs = spark.createDataFrame([(1, 1, "d1", 0.9, "g1", 0.6), (1, 1, "d1", 0.9, "g2", 0.5), (1, 1, "d2", 0.8, "g1", 0.9), (1, 1, "d2", 0.8, "g2", 0.05)], "image_id long, category_id long, det string, score double, gt string, iou double")
    assert [(r.det, r.gt) for r in evaluation.greedy_instances(pairs).collect()] == [("d1", "g1")]


def test_run_masks_match_cells(spark):
    rnd = random.Random(2)
    boxes = [[(1, 1, str(i), float(rnd.randint(0, 80)), float(rnd.randint(0, 80)), float(rnd.randint(8, 60)), float(rnd.randint(8, 60))) for i in range(6)] for _ in range(2)]
    cells = [{(cx, cy) for _, _, _, x, y, w, h in b for cx in range(int(x // 8), int((x + w) // 8)) for cy in range(int(y // 8), int((y + h) // 8))} for b in boxes]
    got = evaluation.mask_cases(*(evaluation.box_runs(spark.createDataFrame(b, BOXES)) for b in boxes)).first()
    assert (got.gt_px, got.dt_px, got.both_px) == (len(cells[0]), len(cells[1]), len(cells[0] & cells[1]))


def test_block_cases_match_cells(spark):
    rnd = random.Random(5)
    block = lambda: (y := rnd.randint(0, 9), y + rnd.randint(1, 9), x := rnd.randint(0, 9), x + rnd.randint(1, 9))
    kinds = [(i, c) for i in (1, 2, 3, None) for c in (1, 2)]
    rows = [(m, *k, *block()) for k in kinds for m in ("t", "a", "b", "other") for _ in range(rnd.choice([0, 1, 1, 3]))]
    given = spark.createDataFrame(rows, "model string, image_id long, category_id long, y0 long, y1 long, x0 long, x1 long")
    cells = lambda m, k: {(y, x) for r in rows if r[:3] == (m, *k) for y in range(r[3], r[4]) for x in range(r[5], r[6])}
    want = {(m, *k): (len(t), len(p), len(t & p)) for k in kinds for m in ("a", "b", "silent") if (t := cells("t", k)) | (p := cells(m, k))}
    got = evaluation.block_cases(given.where("model = 't'"), given.where("model <> 't'"), ["a", "b", "silent"])
    assert {(r.model, r.image_id, r.category_id): (r.gt_px, r.dt_px, r.both_px) for r in got.collect()} == want
    key, side = np.array([k for k in range(5) for _ in range(40)]), np.array([rnd.randint(0, 2) for _ in range(200)])
    blocks = np.array([block() for _ in range(200)])
    whole = evaluation._block_sizes(key, side, blocks, (5, 3))
    assert (evaluation._block_sizes(key, side, blocks, (5, 3), at_once=7) == whole).all() and whole.min() > 0
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan  # blocks are shuffled, not their lines


def test_a_baseline_equals_itself(spark):
    random_mean = F.rand().alias("mean")
    means = spark.range(0, 40, 1, 4).select(F.concat(F.lit("m"), F.col("id") % 4).alias("arm"), F.floor(F.col("id") / 4).cast("string").alias("metric"), F.col("id")).groupBy("arm", "metric").agg(F.min("id")).select("arm", "metric", random_mean)
    plan = experiments.verdicts(means, "m0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1  # means are computed once
    assert {r.verdict for r in experiments.verdicts(means, "m0").where("arm = 'm0'").collect()} == {"equal"}
    assert {r.delta for r in statistics.admitted(means, "m0", 0.0).where("arm = 'm0'").collect()} == {0.0}


def test_resamples_are_weights_of_images(spark):
    ids, n_boot = list(range(100, 20_000, 3)), 7
    images = spark.createDataFrame([(i,) for i in ids], "image_id long")
    at = lambda j: int(int(hashlib.md5(f"0/{j}".encode()).hexdigest()[:8], 16) / 2**32 * len(ids))
    want = Counter((j % n_boot, ids[at(j)]) for j in range(n_boot * len(ids)))
    resamples = statistics.weights(images, n_boot)
    assert {(b, r.image_id): w for r in resamples.collect() for b, w in enumerate(r.ws) if w} == want
    assert {(r.b, r.image_id): r.w for r in statistics.draws(images, n_boot).collect()} == want
    values = images.withColumn("v", F.col("image_id") % 11)
    assert [tuple(statistics.bootstrap_mean(values, r, "v").first()) for r in (resamples,)] == [pytest.approx(tuple(statistics.bootstrap_mean(values, statistics.draws(images, n_boot), "v").first()))]


def test_weights_of_resamples_are_never_broadcast(spark):
    images = spark.range(20_000).withColumnRenamed("id", "image_id")
    values = images.select("image_id", (F.col("image_id") % 3).alias("category_id"), (F.col("image_id") % 11).alias("dice"))
    resamples = statistics.weights(images, 100)
    for df, joins in ((resamples, 1), (statistics.bootstrap_mean(values, resamples, "dice", ["category_id"]), 2)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("SortMergeJoin") >= joins  # with numbers of images, and with their values
    by_class, by_rows = ({r.category_id: r for r in statistics.bootstrap_classes(values, r, "dice").collect()} for r in (resamples, statistics.draws(images, 100)))
    assert by_class.keys() == by_rows.keys() == {0, 1, 2, None}
    assert all(tuple(by_class[k])[1:] == pytest.approx(tuple(by_rows[k])[1:]) for k in by_rows)


def test_md5_heads_equal_those_of_the_library():
    numbers = np.concatenate([np.arange(1200), np.random.default_rng(0).integers(0, 10**15, 500), [10**17, 10**18 - 1, 10**18]])
    for prefix in (b"0/", b"", b"a longer prefix/"):
        assert md5_heads(prefix, numbers).tolist() == [int(hashlib.md5(prefix + b"%d" % i).hexdigest()[:8], 16) for i in numbers.tolist()]


def test_found_equals_greedy_matches():
    rnd = random.Random(9)
    box = lambda: [float(rnd.randint(0, 30)), float(rnd.randint(0, 30)), float(rnd.randint(20, 45)), float(rnd.randint(20, 45))]
    areas = [*coco.AREAS.values(), (0.0, 600.0), (600.0, 900.0), (900.0, 1200.0), (500.0, 501.0)]  # more than 64 bits
    rows = [(k, m, box()) for k in range(60) for m in (-1, 0, 1, 2) for _ in range(rnd.choice([0, 1, 1, 2, 4]))]
    key = np.unique([r[0] for r in rows], return_inverse=True)[1]
    side, boxes = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    for at_once in (1 << 20, 3):
        hit, seen = coco._found(key, side, boxes, areas, at_once)
        for k in set(key.tolist()):
            for m in (0, 1, 2):
                at = (key == k) & (side == m)
                want = np.array(coco._match(boxes[(key == k) & (side < 0)].tolist(), boxes[at].tolist(), areas)).reshape(-1, 80)
                assert (hit[at] == (want == 1)).all() and (seen[at] == (want >= 0)).all()
    assert (coco._unpacked(coco._packed(coco._bits(hit)[3:]), 80) == hit[3:]).all()


def test_misses_deal_annotations_once(spark):
    a, d = plans.views.annotations(spark, "/root/testdata/sf0.001"), plans.views.detections(spark, "/root/testdata/sf0.001")
    lost = evaluation.universal_misses(a, d, range(5))
    want = evaluation.missed(a, d, range(5)).groupBy("ann_key").agg(F.count_distinct("model").alias("n")).where("n = 5")
    assert {r.ann_key for r in lost.collect()} == {r.ann_key for r in want.collect()} != set()
    plan = lost._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") <= 2


def test_repeat_factors(spark):
    images = spark.range(100).withColumnRenamed("id", "image_id")
    ann = spark.createDataFrame([(i, 1) for i in range(99)] + [(50, 2)], "image_id long, category_id long")
    factors = corpus.repeat_factors(ann, images, 0.04)
    by = {r.image_id: r.repeat_factor for r in factors.collect()}
    assert by[50] == pytest.approx(2.0) and by[99] == 1.0 and corpus.epoch(factors, 1, 1).count() == 101


def test_splits_keep_groups_whole(spark):
    images = plans.views.images(spark, TINY)
    named = images.drop("split").join(plans.quota_split(spark, TINY), "patient")
    assert named.count() == images.count() and audit.shared_keys(named, "patient").isEmpty()


def test_a_silent_model_misses_all(spark):
    gt = spark.createDataFrame([(1, 1, "a", 0.0, 0.0, 10.0, 10.0)], BOXES)
    det = spark.createDataFrame([(0, 1, 1, "d", 500.0, 0.0, 10.0, 10.0, 0.9)], "model long, " + BOXES + ", score double")
    assert evaluation.universal_misses(gt, det, [0, 1]).count() == 1 and evaluation.universal_misses(gt.withColumn("iscrowd", F.lit(1)), det, [0, 1]).isEmpty()


def test_paste_plan_is_free_of_collisions(spark):
    a, i = plans.views.annotations(spark, TINY), plans.views.images(spark, TINY)
    plan = corpus.paste_plan(a, i, 10_000, copies=1).limit(200)
    hosts = a.select(F.col("image_id").alias("host_id"), *(F.col(k).alias(f"b_{k}") for k in "xywh"))
    assert plan.join(hosts, "host_id").where(box_iou("p_", "b_") > 0.1).isEmpty()
    assert plan.join(i, plan["host_id"] == i["image_id"]).where("p_x + p_w > width or p_y + p_h > height").isEmpty()


def test_better_means_lower_for_distances(spark):
    a, b = (spark.createDataFrame([(1, 1, v)], "image_id long, category_id long, hd95 double") for v in (5.0, 3.0))
    assert statistics.paired(a, b, ["image_id", "category_id"], "hd95", sign=-1).first().better


def test_bootstrap_interval_holds_the_mean(spark):
    values = spark.range(200).select(F.col("id").alias("image_id"), (F.col("id") % 7).cast("double").alias("v"))
    got = statistics.bootstrap_mean(values, statistics.draws(values, 200), "v").first()
    assert got.low < got.mean < got.high and got.separable


def test_running_sums_equal_plain_ones(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), rnd.randint(0, 9), i, rnd.randint(1, 5)) for i in range(500)] + [("hot", 1, i, 1) for i in range(500, 900)]
    df = spark.createDataFrame(rows, "g string, v long, id long, n long").repartition(7)
    got = {r.id: (r["rank"], r["total"]) for r in running_sums(df, ["g"], [F.desc("v"), "id"], {"rank": F.lit(1).cast("long"), "total": F.col("n")}).collect()}
    want, at = {}, {}
    for g, v, i, n in sorted(rows, key=lambda r: (-r[1], r[2])):
        k, t = at.get(g, (0, 0))
        at[g] = want[i] = (k + 1, t + n)
    assert got == want
    assert running_sums(df.limit(0), [], ["id"], {"rank": F.lit(1)}).isEmpty()
    assert [r.k for r in numbered(df.where("id < 40"), [F.desc("id")], "k").orderBy(F.desc("id")).collect()] == list(range(1, 41))


def test_replies(spark):
    texts = {
        1: 'Sure:\n```json\n[{"class": "tooth ", "box_2d": [5, 5, -1, 20], "confidence": 2}, {"class": "TOOTH", "box_2d": ["1", 1, 3.5, 3]}, 7, {"class": "x", "box_2d": [1, 1, 3, 3]}]\n```',
        2: '[{"class": "tooth", "box_2d": [1, 1, 1.5, 9], "confidence": 0.4}]',
        3: "no array", 4: "[[1, 2]", 5: None, 6: '[{"class": "tooth", "box_2d": [1, 1, 4, "z"]}]', 7: '] [{"class": "tooth", "box_2d": [0, 0, 4, 4], "confidence": "high"}]',
    }
    df = spark.createDataFrame([(k, 10, 10, v) for k, v in texts.items()], "image_id long, width int, height int, text string")
    got = replies.reply_boxes(df, spark.createDataFrame([(3, "tooth")], "category_id long, name string"))
    assert sorted(map(tuple, got.collect())) == [(1, 3, 0.0, 5.0, 5.0, 5.0, 1.0), (1, 3, 1.0, 1.0, 2.5, 2.0, 0.5), (7, 3, 0.0, 0.0, 4.0, 4.0, 0.5)]


def test_bootstrap_of_classes(spark):
    values = spark.createDataFrame([(i, c, float((i * c) % 5)) for i in range(60) for c in (1, 2)] + [(0, 3, 9.0)], "image_id long, category_id long, dice double")
    got = {r.category_id: r for r in statistics.bootstrap_classes(values, statistics.draws(values.select("image_id").distinct(), 80), "dice").collect()}
    assert got[1].low < got[1].mean < got[1].high and got[3].low == got[3].high == 9.0
    assert got[None].mean == pytest.approx((got[1].mean + got[2].mean + 9.0) / 3)
    one = statistics.bootstrap_mean(values.where("category_id = 3"), statistics.draws(values.select("image_id").distinct(), 80), "dice").first()
    assert one.low is None and one.separable is None


def test_distances_win_where_they_fall(spark):
    d = spark.createDataFrame([(1, -1.0), (1, 2.0), (1, -3.0)], "model int, diff double")
    assert [round(statistics.win_fraction(d, ["model"], s, old).first().win_fraction, 3) for s, old in ((1, False), (-1, False), (-1, True))] == [0.333, 0.667, 0.333]


def test_ceiling_and_box_control(spark):
    got = evaluation.ceiling_attribution(spark.createDataFrame([(0.9, 0.8, 0.5), (0.5, 0.5, 0.5)], "ceiling double, oracle double, achieved double")).collect()
    assert (round(got[0].basis_share, 6), round(got[0].head_share, 6), got[1].head_share) == (0.25, 0.75, None)
    a, b = (spark.createDataFrame(list(enumerate(v)), "category_id long, delta double") for v in ((0.1, 0.3, -0.2), (0.2, 0.2, -0.1)))
    assert [r.mask_only for r in evaluation.box_mask_control(a, b).orderBy("category_id").collect()] == [True, False, False]


def test_groups_of_equal_files_begin_no_search(spark):
    files = spark.createDataFrame([("a", "test", "x"), ("b", "train", "x"), ("c", "test", "y")], "file_name string, split string, sha string")
    assert [r.file_name for r in audit.apart_from_groups(files, audit.exact_groups(files)).collect()] == ["c"]


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_sql_parity(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{TINY}/{t}.parquet')")
    got, want = plans.QUERIES[name](spark, TINY).toPandas(), con.sql(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    key = sorted(got.columns)
    assert sorted(norm_rows(got, key)) == sorted(norm_rows(want, key))


def norm_rows(df, key):
    def one(x):
        if pd.isna(x):
            return "null"
        if isinstance(x, str):
            return x
        return f"{float(x) + 0.0:.5f}"

    return [tuple(one(x) for x in r) for r in df[key].astype(object).itertuples(index=False)]


def test_label_lines_of_no_numbers(spark):
    lines = ["1 0.1 NaN 0.2 0.1 0.2 0.2", "1 0.1 0.1 Infinity 0.1 0.2 0.2", "0 0.1 0.1 0.9 0.1 0.9 0.9", " \t", "x 0.1 0.1 0.9 0.1 0.9 0.9", ""]
    df = spark.createDataFrame([(i, x, 100, 100) for i, x in enumerate(lines)], "image_id long, line string, width int, height int")
    assert {r.image_id: r.problem for r in audit.check_label_lines(df, 5).collect()} == {0: "malformed_line", 1: "malformed_line", 2: None, 4: "malformed_line"}
    assert [(r.image_id, r.category_id, round(r.area)) for r in corpus.converted(df, 5).collect()] == [(2, 1, 3200)]
    verdicts = audit.split_verdicts(audit.check_label_lines(df.withColumn("split", F.when(F.col("image_id") == 2, "good").otherwise("bad")), 5)).collect()
    assert {r.split: (r.n_lines, r.n_malformed_line, r.passes) for r in verdicts} == {"good": (1, 0, True), "bad": (3, 3, False)}


def test_replies_in_single_quotes_are_no_json(spark):
    texts = ["[{'class':'tooth','box_2d':[1,1,5,5]}]", '[{"class":"tooth","box_2d":[1,1,5,5]}]']
    df = spark.createDataFrame([(i, 10, 10, x) for i, x in enumerate(texts)], "image_id long, width int, height int, text string")
    assert [r.image_id for r in replies.reply_boxes(df, spark.createDataFrame([(1, "tooth")], "category_id long, name string")).collect()] == [1]


def test_class_counts_hold_no_sets_of_images(spark):
    """Repeated annotations and images count as in a join; distinct images are counted without a set a class."""
    a = spark.createDataFrame([(1, 7), (1, 7), (1, 8), (2, 7), (3, None), (None, 7), (9, 7), (4, 8)], "image_id long, category_id long")
    i = spark.createDataFrame([(1, "train"), (1, "train"), (2, "valid"), (2, "test"), (3, "test"), (4, None), (None, "train")], "image_id long, split string")
    got = corpus.class_counts(a, i)
    assert {tuple(r) for r in got.collect()} == {(7, 4, 1, 1, 1, 1, 1), (8, 2, 1, 0, 0, 0, 0), (None, 0, 0, 0, 0, 1, 1)}
    assert "distinct" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_unpaired_groups_keys_once(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "image_id long")
    b = spark.createDataFrame([(2,), (3,), (3,), (None,)], "image_id long")
    got = audit.unpaired(a, b)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "image_without_label"), (None, "image_without_label"), (3, "label_without_image"), (None, "label_without_image")]))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_top_detections_shuffle_annotations_alone(spark):
    """The one shuffle is of the table's numbers, before models and keys are made of them."""
    plan = plans.top_detections(spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "hashpartitioning(l_orderkey" in plan


def test_near_duplicates_are_dealt_finely(spark):
    """Hash keys and the pairs that fetch thumbnails go to more partitions than other shuffles, whose number adaptive execution may lower."""
    n = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = plans.cross_split_hashes(spark, TINY)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f", {n}\n") >= 4 and "RepartitionByExpression [_c" in plan and "RepartitionByExpression [dhash" in plan
    plan = plans.near_duplicate_images(spark, TINY)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [left_file" in plan and "RepartitionByExpression [right_file" in plan


def test_matching_deals_boxes_once_and_keeps_them_small(spark):
    g = random.Random(21)
    box = lambda i: (i % 7, i % 3, f"k{i:03d}", float(g.randint(0, 40)), float(g.randint(0, 40)), float(g.randint(5, 60)), float(g.randint(5, 60)))
    gt = spark.createDataFrame([box(i) for i in range(120)], BOXES)
    det = spark.createDataFrame([(*box(i), m, g.choice([0.25, 0.5, None])) for i in range(200) for m in "ab"], BOXES + ", model string, score double")
    found = coco.matches(gt, det, ["a", "b"], 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
    ranks = {}
    for r in found.collect():
        ranks.setdefault((r.model, r.image_id, r.category_id), []).append((r["rank"], r.score))
    want = {}
    for r in det.collect():
        want.setdefault(("ab".index(r.model), r.image_id, r.category_id), []).append((-r.score if r.score is not None else 1, r.ann_key, r.score))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: [(i, s) for i, (_, _, s) in enumerate(sorted(v)[:5])] for k, v in want.items()}
    rows = found.select(F.lit(0).alias("_range"), F.lit(0).alias("model"), F.lit(1).cast("long").alias("category_id"), "rank", "hit", "seen").coalesce(1)
    (bundle,) = rows.mapInArrow(coco._bundled, coco._DEALT).collect()
    hit, seen, rank = coco._opened(bundle.rows, 40)
    assert [(h.tobytes(), s.tobytes(), int(k)) for h, s, k in zip(hit, seen, rank, strict=True)] == [(bytes(r.hit), bytes(r.seen), r["rank"]) for r in rows.collect()]
    assert coco.coco_ap(gt, det, ["a", "b"]).collect() == coco.coco_ap(gt, None, ["a", "b"], boxes=coco.together(gt, det)).collect()


def test_cases_of_one_model_make_no_others(spark):
    zero = plans.cases(spark, TINY, models=[0])
    assert zero._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1  # of one model, once
    assert sorted(map(tuple, zero.collect())) == sorted(map(tuple, plans.cases(spark, TINY).where("model = 0").collect()))
    plan = plans.QUERIES["class_bootstrap"](spark, TINY)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow sized" not in plan  # cases are kept, as two steps read them


def test_each_box_is_hashed_once(spark):
    for df in (plans.cases(spark, TINY, 1), plans.cases(spark, TINY)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 5  # a time a model


def test_blocks_of_one_dealt_table(spark):
    g = random.Random(31)
    block = lambda: (g.randint(0, 9), g.randint(8, 15), g.randint(0, 9), g.randint(8, 15))
    rows = [(m, i, c, *block()) for m in (None, 0, 1, 7) for i in range(9) for c in (1, None) for _ in range(g.randint(0, 3))]
    both = spark.createDataFrame(rows, "model int, image_id long, category_id long, y0 long, y1 long, x0 long, x1 long")
    apart = evaluation.block_cases(both.where("model is null").drop("model"), both.where("model is not null"), [1, 0])
    one = evaluation.block_cases(None, None, [1, 0], both.repartition("image_id"))
    assert sorted(map(str, apart.collect())) == sorted(map(str, one.collect())) and one.count() > 20
