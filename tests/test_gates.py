"""Gates that stop a job, and the counts and mappings beside them."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corvane.functions.gates import refused
from corvane.operators import audit, corpus, evaluation, experiments, statistics, vocabulary
from corvane.sources import tables


def test_refused(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    assert refused(df, F.col("v") > 5, "no").count() == 3
    with pytest.raises(PySparkException, match="bad 2"):
        refused(df, F.col("v") == 2, F.concat(F.lit("bad "), F.col("v").cast("string"))).collect()


def test_names(spark):
    cats = spark.createDataFrame([(1, "Caries"), (2, "crown")], "category_id long, name string")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    a = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "image_id long, category_id long")
    assert sorted(r.category_id for r in vocabulary.focused(a, cats, names("CROWN", "crown")).collect()) == [2, 2]
    with pytest.raises(PySparkException, match="no such class: tooth"):
        vocabulary.focused(a, cats, names("crown", "tooth")).collect()
    assert [r.name for r in vocabulary.unmapped(names("x", "x", "caries"), cats).collect()] == ["x"]
    images = spark.createDataFrame([(1, "valid"), (2, "train")], "image_id long, split string")
    assert {r.split: r.num_classes for r in vocabulary.head_sizes(a, images, {"valid": "val"}).collect()} == {"val": 3, "train": 3}
    sets = {"a": spark.createDataFrame([("x.png", 1), (None, 2)], "file_name string, w int"), "b": spark.createDataFrame([("x.png", 7)], "file_name string, category_id int")}
    assert sorted((r.file_name, r.provenance, r.category_id) for r in vocabulary.one_class_corpus(sets).collect()) == [("a_x.png", "a", 1), ("b_x.png", "b", 1)]


def test_anonymous_names(spark):
    names = ["x.rf.0123456789ab.jpg", "y.rf.0123456789ab.jpg", "rf.aaaaaaaa.png", "plain.JPG"]
    df = spark.createDataFrame([(n,) for n in names], "file_name string")
    got = {r.original: (r.clean, r.collides) for r in audit.anonymisation_map(df).collect()}
    assert set(got) == {names[0], names[1], names[3]} and got[names[0]] == ("rf.0123456789ab.jpg", True) and not got[names[3]][1]
    assert audit.safely_anonymised(df).count() == 4
    with pytest.raises(PySparkException, match="no anonymous name"):
        audit.safely_anonymised(spark.createDataFrame([("a.rf.zz.jpg",)], "file_name string")).collect()


def test_conversion_report(spark):
    images = spark.createDataFrame([(i, 100, 100) for i in range(1, 6)], "image_id long, width int, height int")
    box = "0.1 0.1 0.9 0.1 0.9 0.9 0.1 0.9"
    lines = [(1, f"0 {box}"), (1, f"9 {box}"), (2, "0 0.1 0.1 0.1 0.1 0.1 0.1"), (3, ""), (4, f"1 {box}"), (4, " ")]
    df = spark.createDataFrame(lines, "image_id long, line string").join(images, "image_id")
    assert tuple(corpus.conversion_report(images, df, 5, strict=True).first()) == (5, 1, 2, 2, 2)
    broken = df.unionByName(spark.createDataFrame([(5, "0 0.1 x 0.9 0.1 0.9 0.9", 100, 100)], df.schema))
    assert tuple(corpus.conversion_report(images, broken, 5).first()) == (5, 0, 3, 2, 3)
    with pytest.raises(PySparkException, match="malformed label line: 0 0.1 x"):
        corpus.conversion_report(images, broken, 5, strict=True).collect()


def test_reports_add_up(spark):
    a = spark.createDataFrame([(1, 1, "a", 0, 0, 9, 9), (1, 1, "b", 50, 50, 9, 9), (2, 1, "c", 0, 0, 9, 9), (3, 2, "d", 0, 0, 9, 9)], "image_id long, category_id long, ann_key string, x int, y int, w int, h int")
    assert tuple(corpus.denoise_report(a, a.where("ann_key in ('a', 'c')")).first()) == (2, 2, 2, 1)
    images = spark.range(1, 6).withColumnRenamed("id", "image_id")
    assert tuple(corpus.restriction_report(a, images, spark.createDataFrame([(1,), (1,)], "category_id long")).first()) == (3, 1, 1)
    assert tuple(corpus.restriction_report(a.limit(0), images, a.select("category_id")).first()) == (0, 0, 0)
    split = spark.createDataFrame([(1, "train", "p"), (2, "train", "q"), (3, "test", "r")], "image_id long, split string, patient string")
    assert corpus.verified_split(split, a, "patient").first().n_absent_in_train == 1
    with pytest.raises(PySparkException, match="the split"):
        corpus.checked_split(split, a, "patient").collect()
    counts = {(r.patient, r.category_id): r.n for r in corpus.group_class_counts(a, split, "patient").collect()}
    assert counts == {("p", 1): 2, ("q", 1): 1, ("r", 2): 1}
    n = spark.createDataFrame([(1, 100), (2, 4)], "category_id long, n long")
    assert {r.weight for r in corpus.scheme_weights(n, "none").collect()} == {1.0}
    for scheme in ("inverse_sqrt", 0.9):
        w = {r.category_id: r.weight for r in corpus.scheme_weights(n, scheme).collect()}
        assert w[2] > w[1]
    with pytest.raises(ValueError):
        corpus.scheme_weights(n, "other")


def test_full_reconciliation(spark):
    images = spark.range(1, 4).withColumnRenamed("id", "image_id")
    a = spark.createDataFrame([(1, 1, "[[1,2]]"), (1, 2, "[]"), (2, 1, None), (9, 1, "x")], "image_id long, category_id long, segmentation string")
    b = spark.createDataFrame([(1, 1), (3, 1)], "image_id long, category_id long")
    got = sorted((r.kind, r.image_id, r.category_id, r.n_left, r.n_right) for r in audit.annotation_reconciliation(images, a, b).collect() if r.kind != "class_count")
    assert got == [("empty_segmentation", 1, None, 1, 0), ("empty_segmentation", 2, None, 1, 0), ("image_only_left", 2, None, 1, 0), ("image_only_left", 9, None, 1, 0), ("image_only_right", 3, None, 0, 1), ("unknown_image", 9, None, 1, 0)]
    assert {(r.category_id, r.n_left, r.n_right) for r in audit.annotation_reconciliation(images, a, b).where("kind = 'class_count'").collect()} == {(1, 3, 2), (2, 1, 0)}


def test_runs_and_scores(spark):
    log = spark.createDataFrame([("a", "r1", 9, 0.5), ("a", "r2", 10, 0.4), ("a", "r2", 3, 0.45), ("a", "r0", 10, 0.45), ("b", "r3", 2, 0.9)], "arm string, run string, epoch int, metric double")
    got = {r.arm: tuple(r)[1:] for r in experiments.best_runs(log, 10).collect()}
    assert got == {"a": ("r0", 0.45, 3, 1), "b": (None, None, 1, 1)}
    with pytest.raises(PySparkException, match="no complete run of b"):
        experiments.complete_arms(log, 10).collect()
    d = spark.createDataFrame([(0.2,), (0.9,), (None,)], "score double")
    assert evaluation.sure(d, 0.5).count() == 2 and evaluation.sure(d, 0.5, 0.0).count() == 1
    rows = spark.createDataFrame([(1, 0.0, 1), (1, 0.0, 0), (2, 3.0, 0)], "category_id long, logit double, target int")
    priors = spark.createDataFrame([(1, 0.5), (2, 0.5)], "category_id long, prior double")
    each = statistics.focal_losses(rows, priors)
    assert each.count() == 3 and each.agg(F.sum("loss")).first()[0] == pytest.approx(statistics.focal_loss(rows, priors).agg(F.sum("loss_sum")).first()[0])


def test_predictions_of_either_form(spark, tmp_path):
    d = {"image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4], "score": 0.5, "segmentation": [[1, 2, 3, 4, 5, 6]]}
    (tmp_path / "listed.json").write_text(json.dumps([d, d]))
    (tmp_path / "held.json").write_text(json.dumps({"annotations": [d]}))
    (tmp_path / "empty.json").write_text(json.dumps({"annotations": []}))
    (tmp_path / "broken.json").write_text("[{")
    good, bad = tables.read_predictions(spark, str(tmp_path), segmentation=True)
    assert sorted((r.model, r.image_id, r.w, *json.loads(r.segmentation)) for r in good.collect()) == [(m, 1, 3.0, [1, 2, 3, 4, 5, 6]) for m in ("held", "listed", "listed")]
    assert [r.model for r in bad.collect()] == ["broken"]
