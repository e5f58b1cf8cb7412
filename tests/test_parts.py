"""Parts that read cameras, move files, train and watch."""
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import images
from tidemark.operators import alerts, evaluate, lookup, models, sampling, training
from tidemark.plans import workflow
from tidemark.sources import camera, files, sinks, video
from tidemark.streaming import live


class FakeCamera:
    def __init__(self, n):
        self.left = n

    def read(self):
        self.left -= 1
        time.sleep(0.002)
        return (64, 48, b"tom" if self.left % 6 else b"other") if self.left >= 0 else None


def fake_capture(source):
    assert source == 0
    return FakeCamera(12)


def fake_models():
    def load(version):
        return (lambda xs: [[(-5.0, 1.4, 20.0, 30.6), (70.0, 1.0, 80.0, 9.0)] for _ in xs]), (lambda image, boxes: [(bytes(image).decode(), 0.9) for _ in boxes])

    return (lambda: "1"), load


def to_file(folder):
    def send(url, body, kind, timeout):
        with open(f"{folder}/{time.time_ns()}-{url}", "wb") as out:
            out.write(body)
        return True

    return send


def test_live_from_camera_to_webhook(spark, tmp_path):
    store = files.Store(spark, str(tmp_path / "store"))
    (tmp_path / "sent").mkdir()
    query = workflow.live(store, "0", f"{__name__}:fake_capture", f"{__name__}:fake_models", f"{tmp_path}/cp", interval=0.0, webhook="hook", metrics="metrics", version="7", send=to_file(tmp_path / "sent"), batchseconds=0.5)
    try:
        for _ in range(120):
            if store.read("live_detections").count() == 12:
                break
            time.sleep(0.5)
        query.processAllAvailable()
    finally:
        query.stop()
    rows = store.read("live_detections").collect()
    assert len(rows) == 12 and {r["cat_name"] for r in rows} == {"tom", "other"} and all(r["created_at"] for r in rows)
    sent = {k: [f.read_text() for f in (tmp_path / "sent").iterdir() if f.name.endswith(k)] for k in ("hook", "metrics")}
    assert len(sent["hook"]) == 1  # once in the cooldown
    alert = json.loads(sent["hook"][0])
    assert (alert["name"], alert["model_version"], alert["bbox"]) == ("tom", "7", {"x": 0, "y": 1, "w": 20, "h": 30})
    assert sum(x.count("cat_detected{") for x in sent["metrics"]) == 12


def test_camera_reader():
    r = camera._Reader({"source": "0", "capture": f"{__name__}:fake_capture", "interval": "0", "maxframes": "5"})
    rows, end = r.read(r.initialOffset())
    assert end == {"frame": 5} and len(list(rows)) == 5 and len(list(r.readBetweenOffsets({"frame": 2}, end))) == 3
    r.commit(end)
    assert not r.held and camera.device("rtsp://x") == "rtsp://x"
    _, end = r.read(end)
    _, end = r.read(end)
    assert end == {"frame": 12} and r.read(end)[1] == end
    slow = camera._Reader({"source": "0", "capture": f"{__name__}:fake_capture", "interval": "100"})
    assert slow.read({"frame": 0})[1] == {"frame": 1}  # the others come too soon


def test_seek_falls_back():
    class Stream:
        def __init__(self, refuse):
            self.refuse, self.at, self.tried = refuse, 3.0, []

        def seek(self, seconds):
            self.tried.append(seconds)
            if seconds >= self.refuse:
                raise OSError
            self.at = max(0.0, seconds - 1)

        def frames(self):
            yield None, 1, 1, b""
            while self.at <= 6:
                yield self.at, 1, 1, b"x"
                self.at += 0.5

    assert [video.frame_at(Stream(99), t)[0] for t in (-1.0, 2.2, 5.0)] == [0.0, 2.2, 5.0]
    s = Stream(1)
    assert video.frame_at(s, 4.0)[0] == 4.0 and s.tried == [4.0, 0.0]
    assert video.frame_at(Stream(0), 1.0)[0] == 3.0 and video.frame_at(Stream(99), 7.0) is None
    assert video.recorder("rtsp://c", "/v/")[-1] == "/v/%Y-%m-%d_%H-%M-%S.mkv"


def test_images():
    rnd = np.random.default_rng(3)
    smooth = images.resized(rnd.uniform(0, 255, (14, 14, 3)), 120, 160)
    h = images.perceptual_hash(smooth)
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert -(1 << 63) <= h < 1 << 63
    assert bits(h, images.perceptual_hash(images.resized(smooth, 60, 80) + 3)) <= 8 < 15 < bits(h, images.perceptual_hash(images.resized(rnd.uniform(0, 255, (14, 14, 3)), 120, 160)))
    x = images.evaluation_input(np.full((100, 300, 3), 255.0))
    assert x.shape == (3, 224, 224) and np.allclose(x[:, 0, 0], (1 - np.array(images.MEAN)) / images.STD, atol=1e-5)
    a, b, c = images.training_input(smooth, 1), images.training_input(smooth, 1), images.training_input(smooth, 2)
    assert a.shape == (3, 224, 224) and (a == b).all() and (a != c).any()
    drawn = images.overlay(np.zeros((20, 20, 3), np.uint8), [(2, 3, 12, 15, True)])
    assert tuple(drawn[3, 2]) == (0, 255, 0) and not drawn[8, 8].any()


def test_file_effects(spark, tmp_path):
    for n in ("a.jpg", "b.jpg", "c.txt"):
        (tmp_path / n).write_bytes(n.encode())
    rows = spark.createDataFrame([(f"file://{tmp_path}/a.jpg", "tom", True), (f"file://{tmp_path}/b.jpg", "tom", False)], "path string, label string, first boolean")
    for _ in range(2):  # a task that runs again
        sinks.move_files(rows, f"file://{tmp_path}/groups", preview="first")
    assert sorted(p.name for p in (tmp_path / "groups" / "tom").iterdir()) == ["_preview.jpg", "a.jpg", "b.jpg"] and not (tmp_path / "a.jpg").exists()
    (tmp_path / "groups" / "unsorted").mkdir()
    (tmp_path / "groups" / "unsorted" / "x.jpg").write_bytes(b"x")
    listed = files.listing(spark, str(tmp_path / "groups")).withColumn("label", F.element_at(F.split("path", "/"), -2)).withColumn("path", F.regexp_replace("path", "^file:/+", "file:///"))
    for _ in range(2):
        assert sinks.rebuild_training_set(listed, f"file://{tmp_path}/train") == 2
    assert sorted(str(p.relative_to(tmp_path / "train")) for p in (tmp_path / "train").rglob("*.jpg")) == ["tom/a.jpg", "tom/b.jpg"]
    assert (tmp_path / "train" / "tom" / "a.jpg").is_symlink()


def test_pushes(spark, tmp_path):
    send = to_file(tmp_path)
    samples = spark.createDataFrame([("m", {"k": "v"}, float(i)) for i in range(5)], "name string, labels map<string,string>, value double").coalesce(1)
    sinks.push_metrics(samples, "m", send, batch=2)
    assert sorted(len(p.read_text().split("\n")) for p in tmp_path.iterdir()) == [1, 2, 2]
    sinks.post_webhooks(spark.createDataFrame([("t", "tom", 0.5)], "timestamp string, name string, confidence double"), "w", send)
    assert [json.loads(p.read_text())["name"] for p in tmp_path.iterdir() if p.name.endswith("-w")] == ["tom"]


def test_commands_that_write_crops(spark, tmp_path):
    store = files.Store(spark, str(tmp_path / "store"))
    store.save("frames", spark.createDataFrame([("f1", "v__ts_0000000001.jpg", 640, 480)], "frame_uid string, frame_name string, width int, height int"))
    store.save("annotations", spark.createDataFrame([("a1", "f1", "tom cat", 1.0, 2.0, 40.0, 50.0), ("a2", "f1", "tom", 1.0, 2.0, 10.0, 50.0), ("a3", "f1", "x", None, 2.0, 40.0, 50.0)], "annotation_uid string, frame_uid string, label string, bbox_x double, bbox_y double, bbox_width double, bbox_height double"))
    workflow.export_crops(store)
    assert [(r["label"], r["crop_width"], r["crop_height"]) for r in store.read("crops").collect()] == [("tom_cat", 45, 57)]
    names = ["v__ts_0000000001__box_0.jpg", "v__ts_0000000002__box_0.jpg", "v__ts_0000000009__box_0.jpg", "w__ts_0000000001__box_0.jpg", "odd.jpg"]
    store.save("crops", spark.createDataFrame([(f"c{i}", f"crops/{n}") for i, n in enumerate(names)], "crop_uid string, crop_path string"))
    hashes = spark.createDataFrame([("c0", 0), ("c1", 63), ("c2", -1), ("c3", 0), ("c4", 0)], "crop_uid string, phash long")
    before = store._versions("crops")
    assert [r[0] for r in workflow.deduplicate_crops(store, hashes, dry_run=True).collect()] == ["c1"] and store._versions("crops") == before
    workflow.deduplicate_crops(store, hashes)
    assert [r["crop_uid"] for r in store.read("crops").filter("is_duplicate").collect()] == ["c1"]
    made = store.read("crops").select("crop_uid", "created_at").collect()
    assert all(r["created_at"] for r in made)
    store.save("crops", store.read("crops"))
    assert sorted(store.read("crops").select("crop_uid", "created_at").collect()) == sorted(made)  # the first save's time stays
    assert schemas.conform(spark.createDataFrame([("v",)], "video_name string"), "videos").first()["updated_at"] is not None


def test_skips_and_starts(spark):
    rows = spark.createDataFrame([("a.jpg",), ("b.jpg",)], "name string")
    there, gone = lookup.present(rows, rows.filter("name = 'b.jpg'"), "name")
    assert [r[0] for r in there.collect()] == ["b.jpg"] and gone.count() == 1
    assert lookup.from_name(rows, "name", "b.jpg").count() == 1
    with pytest.raises(ValueError):
        lookup.from_name(rows, "name", "c.jpg")
    bad = spark.createDataFrame([("x", bytearray(b"1")), ("y", bytearray(b""))], "name string, content binary")
    load = lambda: lambda xs: [[9.0, 0.0] if bytes(x) else None for x in xs]
    assert {r["name"]: r["status"] for r in workflow.auto_label(bad, load, ["a", "b"]).collect()} == {"x": "labelled", "y": "undecodable"}
    frames = spark.createDataFrame([("s", t) for t in (0.0, 0.9, 1.0, 1.9, 2.5)] + [("r", 0.5)], "source string, ts double")
    assert sorted(map(tuple, alerts.throttle(frames, "source", "ts").collect())) == [("r", 0.5), ("s", 0.0), ("s", 1.0), ("s", 2.5)]


def test_idle_sources_and_late_rows():
    m = live.Debounce(size=2, least=2)
    assert m.frame(5.0) and not m.frame(4.0) and m.frame(5.0)
    assert m.box(5.0, "a", 0.9, "one") is None and m.box(5.0, "a", 0.7, "two") == ("a", 2, pytest.approx(0.8), "two")
    again = live.Debounce(m.state(), size=2, least=2)
    assert again.last_name == "a" and again.window == m.window


def samples(spark, n=240):
    rnd = np.random.default_rng(5)
    centre = {"tom": 2.0, "felix": -2.0, "kit": 0.0}
    return spark.createDataFrame([(i, c, [float(centre[c] + x) for x in rnd.normal(0, 0.6, 4)]) for i in range(n) for c in [sorted(centre)[i % 3]]], "vec_id long, name string, features array<double>")


def test_models_are_saved_and_trained_runs_logged(spark, tmp_path):
    df = samples(spark)
    model, classes, held, accuracy, per_class = workflow.train(df, "name", "features", epochs=20)
    assert classes == ["felix", "kit", "tom"] and accuracy.first()["accuracy"] > 0.9
    models.save_model(spark, model, classes, f"{tmp_path}/m", best_epoch=3)
    loaded, names, about = models.load_model(spark, f"{tmp_path}/m")
    assert names == classes and about == {"best_epoch": 3}
    want = {r["vec_id"]: r["predicted"] for r in held.collect()}
    from pyspark.ml.functions import array_to_vector

    again = loaded.transform(df.withColumn("features", array_to_vector("features")).withColumn("_name", F.col("name")))
    assert {r["vec_id"]: r["predicted"] for r in again.collect() if r["vec_id"] in want} == want
    workflow.log_training(spark, f"{tmp_path}/runs", "r", {"epochs": 20}, accuracy, per_class)
    assert spark.read.parquet(f"{tmp_path}/runs").first()["metrics"].keys() == {"accuracy", *(f"{k}_{c}" for k in ("precision", "recall") for c in classes)}
    with pytest.raises(ValueError):
        workflow.train(df.filter("name = 'tom'"), "name", "features")


def test_head_training(spark):
    split = sampling.class_split(samples(spark).repartition(2, "vec_id"), "name", ["vec_id"])
    head = training.fit_head(split, "name", "features", ["tom", "felix", "kit"], epochs=16, lr=0.1)
    assert len(head.history) >= 2 and max(h["val_accuracy"] for h in head.history) > 0.85
    frozen = training.fit_head(split, "name", "features", ["tom", "felix", "kit"], epochs=2, lr=0.05)
    assert not frozen.trunk.any() and head.history[0]["train_loss"] > head.history[-1]["train_loss"]
    assert training.rate(1.0, 0, 10) == 1.0 and training.rate(1.0, 5, 10) == pytest.approx(0.5) and training.rate(1.0, 10, 10) == pytest.approx(0)
    assert [training.device(x) for x in (["cpu"], ["cuda", "cpu"], ["cuda", "mps"])] == ["cpu", "cuda:0", "mps"]
    with pytest.raises(ValueError):
        training.fit_head(split, "name", "features", ["tom"])


def test_matrix_text(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "bcd"), ("bcd", "bcd")], "t string, p string")
    assert evaluate.matrix_text(evaluate.confusion_matrix(df, "t", "p", ["a", "bcd"]), ["a", "bcd"]) == "          a     bcd\na         1       1\nbcd       0       1"


def test_queries_without_corpus_operators(monkeypatch):
    import builtins

    import __spark_entry__

    real = builtins.__import__
    everything = set(__spark_entry__.queries())

    def fail(name, *a, **k):
        if name == "xxhash":
            raise ImportError(name)
        return real(name, *a, **k)

    import sys

    for m in [m for m in sys.modules if m.startswith("tidemark.llm") or m in ("corpus_pipeline", "xxhash")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", fail)
    with pytest.warns(UserWarning):
        left = set(__spark_entry__.queries())
    assert left and left <= everything and not any(n.startswith("op") and n[2].isdigit() for n in left) and "gap_intervals" in left
