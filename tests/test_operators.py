"""Boundary rows of the operators."""
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import scalars as S
from tidemark.operators import alerts, dedup, evaluate, lookup, merge, models, sampling, temporal


def one(spark, column, **values):
    row = {k: v for k, v in values.items()} or {"_": 0}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {t}" for k, t in ((k, "double" if isinstance(v, float) else "int" if isinstance(v, int) else "string") for k, v in row.items()))).select(column.alias("x")).first()["x"]


def test_gap_intervals_at_the_bounds(spark):
    rows = [("v", "m", t, 0.5) for t in (1.0, 16.0, 31.001, 100.0)] + [("v", "m", 200.0, 0.25), ("v", "m", 300.0, 0.2499), ("w", "m", 5.0, 0.9)]
    det = spark.createDataFrame(rows, "video_name string, model_name string, timestamp_seconds double, confidence double")
    vid = spark.createDataFrame([("v", 203.0), ("w", 600.0)], "video_name string, duration_seconds double")
    got = sorted((r["video_name"], r["start_seconds"], r["end_seconds"], r["detection_count"], r["max_confidence"]) for r in temporal.build_intervals(det, vid).collect())
    assert got == [("v", 0.0, 23.0, 2, 0.5), ("v", 28.001, 38.001, 1, 0.5), ("v", 97.0, 107.0, 1, 0.5), ("v", 197.0, 203.0, 1, 0.25), ("w", 2.0, 12.0, 1, 0.9)]


def test_gap_clusters_partition_their_input(spark):
    rnd = random.Random(1)
    rows = sorted({(rnd.choice("ab"), rnd.randint(0, 200)) for _ in range(80)})
    df = spark.createDataFrame([(k, ms, f"{i:03d}") for i, (k, ms) in enumerate(rows)], "video_stem string, ms long, name string")
    got = temporal.group_crops(df, gap_seconds=0.005).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in got:
        groups.setdefault((r["video_stem"], r["group_name"]), []).append((r["ms"], r["is_preview"]))
    for g in groups.values():
        times = sorted(t for t, _ in g)
        assert all(b - a <= 5 for a, b in zip(times, times[1:])) and [p for _, p in sorted(g)] == [True] + [False] * (len(g) - 1)
    assert [n for _, n in sorted(groups)] == [f"group_{i:03d}" for i in range(1, len(groups) + 1)]


def test_leader_is_the_last_kept(spark):
    a, near, drift, far = 0, 0b111111, 0b1111111, (1 << 64) - (1 << 63) - 1
    rows = [("i", 1, "a", a), ("i", 2, "b", near), ("i", 3, "c", drift), ("i", 4, "d", far), ("i", 5, "e", None), ("j", 1, "b", near), ("k", 1, "x", 5)]
    df = spark.createDataFrame(rows, "interval_uid string, ts int, frame_uid string, phash long")
    got = {(r["interval_uid"], r["frame_uid"]): r["is_duplicate"] for r in dedup.leader_dedup(df, "interval_uid", ["ts"], "phash", "frame_uid").collect()}
    assert got == {("i", "a"): False, ("i", "b"): True, ("i", "c"): False, ("i", "d"): False, ("j", "b"): False, ("k", "x"): False}
    items = df.select("frame_uid").distinct().withColumn("is_duplicate", F.lit(True))
    flags = {r["frame_uid"]: r["is_duplicate"] for r in dedup.flag_duplicates(items, df, "interval_uid", ["ts"], "phash", "frame_uid").collect()}
    assert flags == {"a": False, "b": True, "c": False, "d": False, "e": False, "x": False}


def test_scalars(spark):
    assert one(spark, S.frame_name(F.lit("v"), F.lit(12345678.9015))) == "v__ts_12345678902.jpg"
    assert one(spark, S.timestamp_grid(F.lit(1.0), F.lit(2.0), 0.5)) == [1.0, 1.5, 2.0] and one(spark, S.timestamp_grid(F.lit(2.0), F.lit(1.0), 0.5)) == []
    assert [one(spark, S.lighting(F.lit(h))) for h in (5, 6, 7, 18, 19, 21, 22)] == ["night", "unknown", "day", "day", "unknown", "unknown", "night"]
    for name, stem, ms in (("a__ts_b__ts_0000000012__box_0.jpg", "a__ts_b", 12), ("a__ts_12.jpg", None, None), ("x__box_1.jpg", None, None)):
        assert (one(spark, S.crop_stem(F.lit(name))), one(spark, S.crop_ms(F.lit(name)))) == (stem, ms)
    assert one(spark, S.sanitize_label(F.lit("  café au/lait "))) == "café_au_lait" and one(spark, S.sanitize_label(F.lit(" "))) == "unknown"
    for name, ok in (("video_20240131_235959.mkv", True), ("2024-01-31_23-59-59.mkv", True), ("video_20240231_000000.mkv", False), ("other.mkv", False)):
        assert (one(spark, S.video_time(F.lit(name))) is not None) == ok
    assert tuple(one(spark, S.resize_dims(F.lit(300), F.lit(201), 512))) == (300, 200) and tuple(one(spark, S.resize_dims(F.lit(4000), F.lit(3), 512))) == (512, 2) and one(spark, S.resize_dims(F.lit(0), F.lit(3), 512)) is None
    assert tuple(one(spark, S.padded_box(F.lit(10.0), F.lit(0.0), F.lit(100.0), F.lit(50.0), 0.1, F.lit(105), F.lit(60)))) == (0, 0, 105, 55)
    assert not one(spark, S.has_area(S.clipped_box(F.lit(700.0), F.lit(1.0), F.lit(800.0), F.lit(2.0), F.lit(640), F.lit(480))))
    assert one(spark, S.suffix(F.lit("a/.hidden"))) == "" and one(spark, S.stem(F.lit("a/b.c.JPG"))) == "b.c" and one(spark, S.has_suffix(F.lit("x.JPG"), [".jpg"]))
    assert one(spark, S.metric_line(F.lit("m"), F.create_map().cast("map<string,string>"), F.lit(1.5))) == "m 1.5"
    assert one(spark, S.device_id(F.lit("0"))) == 0 and one(spark, S.device_id(F.lit("rtsp://x"))) is None
    assert one(spark, S.make_uid("det", F.lit("v"), F.lit(1))) == "det_" + __import__("hashlib").sha1(b"v\x1f1\x1f").hexdigest()[:16]
    assert one(spark, S.relative_path(F.lit("/data/x/y.jpg"), "/data")) == "x/y.jpg" and one(spark, S.relative_path(F.lit("/other/y"), "/data")) == "/other/y"


def test_majority_and_cooldown(spark):
    names = "aabaa" "bbbbb" "abcde"
    rows = [("s", float(i * 10), n, 0.9 if i != 3 else 0.95) for i, n in enumerate(names)] + [("s", 5.0, "z", 0.1), ("t", 1.0, "a", 0.9)]
    df = spark.createDataFrame(rows, "source string, ts double, name string, conf double")
    hit = alerts.majority_windows(df, ["source"], ["ts"], "name", "conf")
    got = [(r["ts"], r["majority_name"], r["votes"]) for r in hit.orderBy("ts").collect()]
    # rows 0-4 are a a b a a; 5-9 are b: four of five from row 8 on, and still at row 10 (b b b b a)
    assert got == [(40.0, "a", 4), (80.0, "b", 4), (90.0, "b", 5), (100.0, "b", 4), (110.0, "b", 4)]
    fires = spark.createDataFrame([("s", t, n) for t, n in ((0.0, "a"), (29.9, "a"), (30.0, "a"), (31.0, "b"), (32.0, "a"), (61.9, "a"), (62.0, "a"))], "source string, ts double, name string")
    assert sorted((r["ts"], r["name"]) for r in alerts.cooldown(fires, "source", "ts", "name").collect()) == [(0.0, "a"), (30.0, "a"), (31.0, "b"), (32.0, "a"), (62.0, "a")]


def test_labels_by_substring(spark, monkeypatch):
    folders = spark.createDataFrame([("group_001 TomCat",), ("tom",), ("nobody",)], "folder string")
    labels = spark.createDataFrame([("tom",), ("cat",), ("Tomcat",), ("",)], "label string")
    want = [("group_001 TomCat", "Tomcat"), ("tom", "tom")]
    assert sorted(map(tuple, lookup.longest_label(folders, "folder", labels, "label").collect())) == want
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, lookup.longest_label(folders, "folder", labels, "label").collect())) == want


def test_forward_asof(spark):
    targets = spark.createDataFrame([("v", 1.0, "i"), ("v", 1.0, "j"), ("v", 2.5, "i"), ("v", 9.0, "i"), ("w", 0.0, "k")], "video string, ts double, interval string")
    frames = spark.createDataFrame([("v", 1.0 - 5e-7, "f1"), ("v", 2.0, "f2"), ("v", 3.0, "f3")], "video string, pts double, frame string")
    got = sorted((r["ts"], r["interval"], r["frame"]) for r in lookup.forward_asof(targets, frames, "video", "ts", "pts", "frame").collect())
    assert got == [(1.0, "i", "f1"), (1.0, "j", "f1"), (2.5, "i", "f3")]


def test_merges(spark):
    t = spark.createDataFrame([(1, "a", True), (2, "b", None)], "k int, v string, flag boolean")
    s = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    up = merge.upsert(t, s, ["k"])
    assert sorted(map(tuple, up.collect())) == [(1, "a", True), (2, None, None), (3, "c", None)]
    assert sorted(map(tuple, merge.upsert(up, s, ["k"]).collect())) == sorted(map(tuple, up.collect()))
    assert sorted(map(tuple, merge.upsert(t, s, ["k"], []).collect())) == [(1, "a", True), (2, "b", None), (3, "c", None)]
    assert sorted(r["v"] for r in merge.insert_ignore(t, s.fillna("x"), ["k"]).collect()) == ["a", "b", "c"]
    assert sorted(map(tuple, merge.replace_where(t.select("k", "v"), s, ["k"]).collect()), key=str) == sorted([(1, "a"), (2, None), (3, "c")], key=str)
    frames = spark.createDataFrame([("f1", "p1"), ("f2", "p2")], "frame_uid string, frame_path string")
    kept, notes, gone = merge.prune_orphans(frames, frames, frames.filter("frame_uid = 'f1'"))
    assert [r[0] for r in kept.collect()] == [r[0] for r in notes.collect()] == ["f1"] and [r[0] for r in gone.collect()] == ["p2"]
    assert schemas.violations(schemas.conform(spark.createDataFrame([("x",), ("x",)], "crop_uid string"), "crops"), "crops").count() == 1
    assert schemas.conform(spark.createDataFrame([("x",)], "crop_uid string"), "crops").first()["label"] == "unsorted"


def test_samples_and_splits(spark):
    df = spark.createDataFrame([(f"v{i:03d}",) for i in range(23)], "name string")
    assert sorted(r[0] for r in sampling.stride_sample(df, ["name"], 5).collect()) == ["v000", "v004", "v008", "v012", "v016"]
    assert sampling.stride_sample(df, ["name"], 50).count() == 23 and sampling.stride_sample(df.limit(0), ["name"], 5).count() == 0
    rows = spark.createDataFrame([("one", 1)] + [("five", i) for i in range(5)], "label string, id int")
    split = {(r["label"], r["id"]): r["split"] for r in sampling.class_split(rows, "label", ["id"]).collect()}
    assert split[("one", 1)] == "train" and [split[("five", i)] for i in range(5)] == ["train"] * 4 + ["val"]


def test_evaluation(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "t string, p string")
    assert {r["class"]: (r["pred_a"], r["pred_b"], r["pred_c"]) for r in evaluate.confusion_matrix(df, "t", "p", ["a", "b", "c"]).collect()} == {"a": (1, 1, 0), "b": (0, 1, 0), "c": (0, 0, 0)}
    got = {r["class"]: (r["precision"], r["recall"]) for r in evaluate.precision_recall(df, "t", "p", ["a", "b", "c"]).collect()}
    assert got == {"a": (1.0, 0.5), "b": (0.5, 1.0), "c": (0.0, 0.0)}
    history = spark.createDataFrame(list(enumerate([0.5, 0.6, 0.6, 0.55, 0.7])), "epoch int, acc double")
    assert tuple(evaluate.best_epoch(history, "epoch", "acc").first()) == (4, 0.7)
    assert [(r["streak"], r["stopped"]) for r in evaluate.training_progress(history, "epoch", "acc", 2).orderBy("epoch").collect()] == [(0, False), (0, False), (1, False), (2, True), (0, True)]


def load_detector():
    return lambda images: [[(0, 0, 100, 80, 0.9), (5, 5, 20, 20, 0.8), (0, 0, 60, 60, 0.2)] if i else [] for i in (bytes(x) for x in images)]


def test_models_as_dataflow(spark):
    frames = spark.createDataFrame([("v.mkv", 5.0, 640, 480, bytearray(b"x"), "f1", "v__ts_0000005000.jpg"), ("v.mkv", 10.0, 640, 480, bytearray(b""), "f2", "v__ts_0000010000.jpg")], "video_name string, timestamp_seconds double, width int, height int, content binary, frame_uid string, frame_name string")
    found = models.detect(frames, load_detector, batch=1)
    det = models.detections(found, "m").collect()
    assert [(r["timestamp_seconds"], r["confidence"]) for r in det] == [(5.0, 0.9)]
    crops = models.crops(found).collect()
    assert [(r["crop_path"], r["crop_width"], r["crop_height"]) for r in crops] == [("v__ts_0000005000__box_0.jpg", 115, 92)]
    rows = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2")), ("c", bytearray(b""))], "name string, content binary")
    load = lambda: lambda xs: [[5.0, 0.0] if bytes(x) == b"1" else [0.1, 0.0] if x else None for x in xs]
    got = {r["name"]: (r["label"], r["status"]) for r in models.label_status(models.classify(rows, load, ["cat", "dog"])).collect()}
    assert got == {"a": ("cat", "labelled"), "b": ("cat", "rejected"), "c": (None, "undecodable")}
    ann = spark.createDataFrame([("n1", "f1", "My Label", 1.0, 1.0, 32.0, 40.0), ("n2", "f1", "x", 1.0, 1.0, 31.9, 40.0), ("n3", "f1", "x", None, 1.0, 50.0, 50.0)], "annotation_uid string, frame_uid string, label string, bbox_x double, bbox_y double, bbox_width double, bbox_height double")
    assert [r["label"] for r in models.exported_crops(ann, frames).collect()] == ["My_Label"]


def test_training(spark):
    rows = spark.createDataFrame([(i, i % 2, [float(i % 2) + i / 1000, 1.0]) for i in range(60)], "vec_id long, label int, embedding array<double>")
    _, classes, held = models.train(rows, "label", "embedding")
    got = evaluate.accuracy(held.withColumn("t", F.col("label").cast("string")), "t", "predicted").first()
    assert classes == ["0", "1"] and got["accuracy"] == 1.0 and got["total"] == 12
    with pytest.raises(ValueError):
        models.train(rows.filter("label = 0"), "label", "embedding")


def test_ranks_are_global(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [5, 3, 9, 1, 7, 2] * 5, "y": range(30)}))
    got = [r["_rank"] for r in sampling.ranked(df, ["x", "y"]).orderBy("x", "y").collect()]
    assert got == list(range(30))
