import json
import struct
import zlib

from pyspark.sql import functions as F

from corvane.sources import tables
from corvane.streaming import gate


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.1 0.1 0.2 0.1 0.2 0.2\n\n1 0 0 1 0 1 1\n")
    assert [(r.stem, r.line_no) for r in tables.read_labels(spark, str(tmp_path / "a.txt")).collect()] == [("a", 1), ("a", 3)]
    (tmp_path / "n.yaml").write_text("names:\n  10: tooth\n  2: root tip\n")
    assert [tuple(r) for r in tables.read_class_names(spark, str(tmp_path / "n.yaml")).collect()] == [(1, "root tip"), (2, "tooth")]
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a", "width": 2, "height": 3}], "categories": [], "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [0, 0, 1, 1], "segmentation": [[1, 2]]}, {"id": 2, "image_id": 1, "category_id": 1, "segmentation": {"size": [1, 2], "counts": "x"}}]}))
    got = tables.read_coco(spark, str(tmp_path / "c.json"))
    assert [r.segmentation for r in got["annotations"].orderBy("id").collect()] == ["[[1, 2]]", '{"size": [1, 2], "counts": "x"}']
    old = tables.checksums(spark, str(tmp_path), "*.txt").collect()
    old = spark.createDataFrame(old)
    (tmp_path / "b.txt").write_text("x")
    assert [r.what for r in tables.changed_files(old, tables.checksums(spark, str(tmp_path), "*.txt")).collect()] == ["added"]


def test_gate(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1), ("y", 1 << 40)], "file_name string, dhash long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("k", 3)], "file_name string, dhash long")
    gate.gate(stream, known, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert {(r.left_file, r.hamming) for r in spark.read.parquet(str(tmp_path / "out")).select("left_file", F.col("hamming")).collect()} == {("x", 1), ("y", 3)}


def test_fresh(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0), ("a", 60), ("b", 60), ("b", 60)], "sha string, s long").select("sha", F.timestamp_seconds("s").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    written = gate.fresh(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    written.trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.sha for r in spark.read.schema(rows.schema).parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_logs_and_predictions(spark, tmp_path):
    for run in ("r1", "r2"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "results.csv").write_text("  epoch,   time, metrics/mAP50-95(B)\n  1, 2.5, 0.25\n  2, 5.0, bad\n")
    got = tables.read_run_logs(spark, str(tmp_path / "*" / "results.csv")).orderBy("run", "epoch").collect()
    assert [tuple(r) for r in got] == [(r, *v) for r in ("r1", "r2") for v in ((1, 2.5, 0.25), (2, 5.0, None))]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.json").write_text(json.dumps([{"image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4], "score": 0.5}]))
    (tmp_path / "p" / "two.json").write_text("[{oops")
    found, broken = tables.read_predictions(spark, str(tmp_path / "p"))
    assert [tuple(r) for r in found.collect()] == [("one", 1, 2, 1.0, 2.0, 3.0, 4.0, 0.5)] and [r.model for r in broken.collect()] == ["two"]


def test_image_listing(spark, tmp_path):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head, lines = struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0), zlib.compress(b"\0\1\2\3" * 2)
    (tmp_path / "b.PNG").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", lines) + chunk(b"IEND", b""))
    (tmp_path / "a.jpg").write_bytes(b"no image")
    (tmp_path / "c.txt").write_text("x")
    listed = tables.list_images(spark, str(tmp_path))
    assert sorted(map(tuple, listed.collect())) == [("a.jpg", None, None, "unreadable"), ("b.PNG", 3, 2, None)]
    assert [tuple(r) for r in tables.image_manifest(listed).select("image_id", "file_name").collect()] == [(1, "b.PNG")]


def test_sinks(spark, tmp_path):
    images = spark.createDataFrame([(1, "a", "p", "train"), (2, "b", "p", "train"), (3, "c", "q", "test")], "image_id long, file_name string, patient string, split string")
    tables.write_split(images, str(tmp_path), 7)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lists" / "split=train")).collect()) == ["a", "b"]
    manifest = spark.read.json(str(tmp_path / "manifest")).first()
    assert manifest.seed == 7 and [(r.split, r.images, r.patients) for r in manifest.counts] == [("test", 1, 1), ("train", 2, 1)]
    tables.write_coco(images, images.limit(0), images.limit(1), str(tmp_path / "coco"))
    assert spark.read.json(str(tmp_path / "coco" / "images")).count() == 3
    assert tables.markdown(spark.createDataFrame([("a|b", 0.5)], "k string, v double")) == "| k | v |\n| --- | --- |\n| a\\|b | 0.5000 |"


def test_labels_out_and_pending_keys(spark, tmp_path):
    labels = spark.createDataFrame([("train", "0 0.1 0.2"), ("test", "1 0.3 0.4")], "split string, line string")
    tables.write_labels(labels, str(tmp_path / "l"))
    assert [r.value for r in spark.read.text(str(tmp_path / "l" / "split=test")).collect()] == ["1 0.3 0.4"]
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    assert [r.k for r in tables.pending(keys, keys.where("k = 'a'"), "k").collect()] == ["b"]
