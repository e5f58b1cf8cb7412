"""Files, exports, the data source, sinks, streams and the commands over a store."""
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import alerts
from tidemark.plans import workflow
from tidemark.sources import coco, files, sinks, video
from tidemark.streaming import live


def fake_decoder(path, sample_seconds, max_side, max_seconds):
    t = 0.0
    while t <= (max_seconds or 20.0):
        yield t, max_side, max_side // 2, b"frame" if t >= 10 else b""
        t += sample_seconds


def fake_probe(path):
    return None if "bad" in path else (60.0, 25.0, 640, 480)


def load_detector():
    return lambda images: [[(0.0, 0.0, 120.0, 90.0, 0.9)] if x else [] for x in images]


def test_listing_and_index(spark, tmp_path):
    for n in ("video_20240102_070000.mkv", "2024-01-02_23-00-00.mkv", "broken.mkv", "x.txt"):
        (tmp_path / n).write_bytes(b"abc")
    rejected = workflow.build_index(spark, str(tmp_path), f"{tmp_path}/index")
    assert [r[0] for r in rejected.collect()] == ["broken.mkv"]
    index = files.read_index(spark, f"{tmp_path}/index").orderBy("date", "time").collect()
    assert [(r["video_name"], r["hour"], r["lighting"]) for r in index] == [("video_20240102_070000.mkv", 7, "day"), ("2024-01-02_23-00-00.mkv", 23, "night")]
    assert files.read_index(spark, f"{tmp_path}/none").count() == 0
    good, bad = video.probe(files.listing(spark, str(tmp_path), "*.mkv"), f"{__name__}:fake_probe")
    assert good.count() == 3 and bad.count() == 0


def test_read_exact():
    assert video.read_exact(io.BytesIO(b"abcd"), 2) == b"ab" and video.read_exact(io.BytesIO(b""), 2) is None
    with pytest.raises(EOFError):
        video.read_exact(io.BytesIO(b"a"), 2)


def test_coco_import(spark, tmp_path):
    (tmp_path / "task1").mkdir()
    doc = {"categories": [{"id": 1, "name": "tom"}], "images": [{"id": 1, "file_name": "sub/a.jpg"}, {"id": 2, "file_name": "b.jpg"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [1, 2, 3, 4], "iscrowd": 1}, {"id": 2, "image_id": 1, "category_id": 9, "area": 5.0}, {"id": 3, "image_id": 2, "category_id": 1}, {"id": 4, "image_id": 7, "category_id": 1}]}
    (tmp_path / "task1" / "export.json").write_text(json.dumps(doc))
    frames = spark.createDataFrame([("f1", "a.jpg")], "frame_uid string, frame_name string")
    rows, missed = coco.import_annotations(spark, f"{tmp_path}/task1/export.json", frames)
    got = sorted((r["label"], r["bbox_x"], r["bbox_height"], r["area"], r["is_crowd"], r["cvat_task_name"]) for r in rows.collect())
    assert got == [("tom", 1.0, 4.0, None, True, "task1"), ("unknown", None, None, 5.0, False, "task1")]
    assert [r[0] for r in missed.collect()] == ["b.jpg"]


def test_prepare_over_a_store(spark, tmp_path):
    store = files.Store(spark, str(tmp_path / "store"))
    store.save("videos", spark.createDataFrame([("a.mkv", 18.0), ("b.mkv", 600.0)], "video_name string, duration_seconds double"))
    pts = spark.createDataFrame([("a.mkv", float(t), f"a/{t}.jpg", 640, 480) for t in range(19)], "video_name string, pts double, frame_path string, width int, height int")
    workflow.prepare(store, ["/v/a.mkv"], f"{__name__}:fake_decoder", load_detector, pts)
    det = store.read("detections").collect()
    assert sorted(r["timestamp_seconds"] for r in det) == [10.0, 15.0, 20.0]
    (i,) = store.read("intervals").collect()
    assert (i["start_seconds"], i["end_seconds"], i["detection_count"]) == (7.0, 18.0, 3)
    assert store.read("frames").count() == store.read("frame_intervals").count() == 12
    workflow.prepare(store, ["/v/a.mkv"], f"{__name__}:fake_decoder", load_detector, pts)
    assert store.read("detections").count() == 3 and store.read("frames").count() == 12
    hashes = store.read("frames").select("frame_uid", F.lit(0).cast("long").alias("phash"))
    assert workflow.deduplicate_frames(store, hashes).count() == 11
    images = store.read("frames").select("frame_uid", F.lit(b"img").alias("content"))
    workflow.auto_crop(store, images, load_detector)
    crops = store.read("crops").collect()
    assert len(crops) == 1 and crops[0]["label"] == "unsorted" and crops[0]["crop_path"].endswith("__box_0.jpg")
    folder = tmp_path / "crops" / "tom"
    folder.mkdir(parents=True)
    (folder / crops[0]["crop_path"]).write_bytes(b"x")
    workflow.assign_labels(store, str(tmp_path / "crops"))
    assert store.read("crops").first()["label"] == "tom" and sinks.training_view(store.read("crops")).count() == 1
    grouped = workflow.group_crops(store)
    assert workflow.scatter_groups(grouped, spark.createDataFrame([("group_001", "group_001_Felix")], "group_name string, folder string"), spark.createDataFrame([("felix",)], "label string")).first()["label"] == "felix"
    store.save("frame_intervals", store.read("frame_intervals").limit(0))
    workflow.prune(store)
    assert store.read("frames").count() == 0
    assert {r["table_name"]: r["n"] for r in workflow.stats(store).collect()}["detections"] == 3
    listed = spark.createDataFrame([("a.mkv",), ("b.mkv",)], "name string")
    assert [r[0] for r in workflow.retrain_videos(store, listed).collect()] == ["b.mkv"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("n1.jpg", bytearray(b"abc"), "tom"), ("n2.jpg", bytearray(b"d"), "felix")], "name string, content binary, label string")
    sinks.write_images(df, f"file://{tmp_path}/img")
    assert (tmp_path / "img" / "n1.jpg").read_bytes() == b"abc" and len(list((tmp_path / "img").iterdir())) == 2
    sinks.write_by_label(df.select("name", "label"), f"{tmp_path}/labels")
    assert {p.name for p in (tmp_path / "labels").glob("label=*")} == {"label=tom", "label=felix"}
    alerts_ = spark.createDataFrame([("2024-01-01T00:00:00", "tom", 0.98765, 1.2, 2.0, 3.0, 4.0)], "timestamp string, name string, confidence double, x double, y double, w double, h double")
    assert json.loads(sinks.webhook_payload(alerts_).first()[0]) == {"timestamp": "2024-01-01T00:00:00", "name": "tom", "confidence": 0.9876, "model_version": "", "bbox": {"x": 1, "y": 2, "w": 3, "h": 4}}
    assert sinks.post("http://127.0.0.1:9/none", b"", "text/plain", 0.2) is False
    store = files.Store(spark, str(tmp_path / "s"))
    row = spark.createDataFrame([("u1", "tom")], "detection_uid string, cat_name string")
    sinks.log_once(store, row)
    sinks.log_once(store, row.withColumn("cat_name", F.lit("other")))
    assert [r["cat_name"] for r in store.read("live_detections").collect()] == ["tom"]
    sinks.log_run(spark, f"{tmp_path}/runs", "r1", {"epochs": 3}, {"accuracy": 0.5})
    assert spark.read.parquet(f"{tmp_path}/runs").first()["metrics"] == {"accuracy": 0.5}


def test_predict(spark):
    rows = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "name string, content binary")
    load = lambda: lambda xs: [[5.0, 0.0, 1.0] if bytes(x) == b"1" else [0.0, 0.0, 0.0] for x in xs]
    got = {r["name"]: (r["label"], [t["name"] for t in r["top3"]]) for r in workflow.predict(rows, load, ["x", "y", "z"]).collect()}
    assert got == {"a": ("x", ["x", "z", "y"]), "b": ("unknown", ["x", "y", "z"])}
    assert {r["name"]: r["status"] for r in workflow.auto_label(rows, load, ["x", "y", "z"]).collect()} == {"a": "labelled", "b": "rejected"}


def test_stream_equals_batch_over_many_batches(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(s, float(t), i, rnd.choice("aaab"), rnd.choice([0.5, 0.7, 0.9])) for s in "xy" for t in range(0, 400, 5) for i in range(rnd.randint(1, 2))]
    df = spark.createDataFrame(rows, "source string, ts double, idx long, name string, conf double")
    for k in range(4):  # batches arrive in order
        df.filter((F.col("ts") >= k * 100) & (F.col("ts") < (k + 1) * 100)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = []
    query = live.start(live.live_alerts(stream), lambda b, n: out.extend(map(tuple, b.select("source", "ts", "name").collect())), f"{tmp_path}/cp", available_now=True)
    query.awaitTermination()
    hits = alerts.majority_windows(df, ["source"], ["ts", "idx"], "name", "conf").select("source", "ts", "idx", F.col("majority_name").alias("name"))
    want = alerts.cooldown(hits, "source", "ts", "name", tie=["idx"]).select("source", "ts", "name")
    assert sorted(out) == sorted(map(tuple, want.collect())) and out


def test_throttle_and_reload():
    m = live.Debounce(interval=1.0)
    assert [m.frame(t) for t in (0.0, 0.5, 1.0, 1.9, 2.0, 2.0)] == [True, False, True, False, True, True]
    versions, loads = iter(["1", "1", "2"]), []
    r = live.Reloading(lambda: next(versions), lambda v: loads.append(v) or f"model {v}", every=10)
    assert [r.get(t) for t in (0, 5, 10, 20)] == ["model 1", "model 1", "model 1", "model 2"] and loads == ["1", "2"]
