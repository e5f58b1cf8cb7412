"""The commands as functions over a table store, with the defaults that define their semantics."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import alerts, dedup, evaluate, lookup, merge, models, monitoring, sampling, temporal
from tidemark.sources import camera, coco, files, sinks, video
from tidemark.sources.files import Store
from tidemark.streaming import live as streams


def build_index(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """Writes the video index; returns the names that hold no valid time."""
    index, rejected = files.video_metadata(files.listing(spark, folder, "*.mkv"))
    files.write_index(index, path)
    return rejected


def scan(store: Store, paths: Sequence[str], decoder: str, load: Callable, *, model_name: str = "detector", sample_seconds: float = 5.0, max_side: int = 512, least: float = 0.25, batch: int = 64) -> None:
    """Sampled frames -> detections; those of the scanned videos and this model are replaced."""
    spark = store.spark
    spark.dataSource.register(video.SampledFrames)
    frames = spark.read.format("sampled_frames").option("paths", "\n".join(paths)).option("decoder", decoder).option("sampleSeconds", str(sample_seconds)).option("maxSide", str(max_side)).load()
    found = models.detections(models.detect(frames, load, batch=batch), model_name, least=least, sample_seconds=sample_seconds)
    scanned = spark.createDataFrame([(p.rsplit("/", 1)[-1], model_name) for p in paths], "video_name string, model_name string")
    old = store.read("detections").join(scanned, ["video_name", "model_name"], "left_anti")
    store.save("detections", old.unionByName(found, allowMissingColumns=True))


def intervals(store: Store, *, gap: float = temporal.GAP_SECONDS, before: float = temporal.PAD_BEFORE, after: float = temporal.PAD_AFTER, least: float = 0.25, source: str = "detector") -> None:
    """Intervals of a source are recomputed as a whole; edges of intervals that are gone go too."""
    new = temporal.build_intervals(store.read("detections"), store.read("videos"), min_confidence=least, gap=gap, before=before, after=after, source=source)
    rest = store.read("intervals").filter(~F.col("interval_source").eqNullSafe(F.lit(source)))
    store.save("intervals", rest.unionByName(new, allowMissingColumns=True))
    store.save("frame_intervals", store.read("frame_intervals").join(store.read("intervals").select("interval_uid"), "interval_uid", "left_semi"))


def frames(store: Store, pts: DataFrame, *, step: float = 1.0, source: str = "detector", force: bool = False) -> None:
    """Targets of intervals not yet extracted -> frames and edges. ``pts`` has ``video_name``,
    ``pts``, ``frame_path``, ``width``, ``height`` of decodable frames. Orphans are pruned last."""
    wanted = store.read("intervals").filter(F.col("interval_source") == source)
    if not force:
        wanted = lookup.missing(wanted, store.read("frame_intervals"), ["interval_uid"])
    targets = temporal.expand_intervals(wanted.select("interval_uid", "video_name", "start_seconds", "end_seconds"), step).select("video_name", "timestamp_seconds", "interval_uid")
    packed = pts.select("video_name", "pts", F.struct("frame_path", "width", "height").alias("frame"))
    hit = lookup.forward_asof(targets, packed, "video_name", "timestamp_seconds", "pts", "frame").withColumn("frame_uid", S.make_uid("frm", "video_name", S.rounded("timestamp_seconds", 3)))
    rows = hit.dropDuplicates(["frame_uid"]).select("frame_uid", "video_name", "timestamp_seconds", S.frame_name(S.stem("video_name"), "timestamp_seconds").alias("frame_name"), "frame.*")
    store.save("frames", merge.upsert(store.read("frames"), rows, ["frame_uid"], ["frame_name", "frame_path", "width", "height"]))
    store.save("frame_intervals", merge.insert_ignore(store.read("frame_intervals"), hit.select("frame_uid", "interval_uid"), ["frame_uid", "interval_uid"]))
    prune(store)


def prune(store: Store) -> DataFrame:
    kept, annotations, gone = merge.prune_orphans(store.read("frames"), store.read("annotations"), store.read("frame_intervals"))
    store.save("annotations", annotations)
    store.save("frames", kept)
    return gone


def deduplicate_frames(store: Store, hashes: DataFrame, threshold: int = dedup.THRESHOLD, dry_run: bool = False) -> DataFrame:
    """``hashes`` has ``frame_uid``, ``phash``; flags are set anew. Returns the duplicates."""
    f = store.read("frames")
    edges = store.read("frame_intervals").join(f.select("frame_uid", "timestamp_seconds"), "frame_uid").join(hashes, "frame_uid")
    flagged = dedup.flag_duplicates(f, edges, "interval_uid", ["timestamp_seconds", "frame_uid"], "phash", "frame_uid", threshold)
    if not dry_run:
        store.save("frames", flagged)
    return flagged.filter("is_duplicate").select("frame_uid")


def deduplicate_crops(store: Store, hashes: DataFrame, threshold: int = dedup.THRESHOLD, dry_run: bool = False) -> DataFrame:
    """Crops with names that parse, per video by time and name. Returns the duplicates."""
    c = store.read("crops")
    named = c.withColumn("name", S.basename("crop_path")).withColumn("video_stem", S.crop_stem("crop_path")).withColumn("ms", S.crop_ms("crop_path")).filter("video_stem is not null").join(hashes, "crop_uid")
    found = dedup.leader_dedup(named, "video_stem", ["ms", "name"], "phash", "crop_uid", threshold).filter("is_duplicate").select("crop_uid")
    if not dry_run:
        store.save("crops", merge.update_by_key(c, found.withColumn("is_duplicate", F.lit(True)), ["crop_uid"], ["is_duplicate"]))
    return found


def import_annotations(store: Store, path: str) -> DataFrame:
    """Upserts a COCO export and names its task on the frames; returns the images without a frame."""
    rows, missed = coco.import_annotations(store.spark, path, store.read("frames"))
    store.save("annotations", merge.upsert(store.read("annotations"), rows, ["annotation_uid"]))
    tasks = rows.groupBy("frame_uid").agg(F.max("cvat_task_name").alias("cvat_task_name"))
    store.save("frames", merge.update_by_key(store.read("frames"), tasks, ["frame_uid"], ["cvat_task_name"]))
    return missed


def export_crops(store: Store, *, padding: float = 0.1, min_size: float = 32) -> None:
    rows = models.exported_crops(store.read("annotations"), store.read("frames"), padding=padding, min_size=min_size)
    store.save("crops", merge.upsert(store.read("crops"), rows, ["crop_uid"]))


def auto_crop(store: Store, images: DataFrame, load: Callable, *, least: float = 0.3, padding: float = 0.15, min_size: float = 50, batch: int = 32, limit: int | None = None) -> None:
    """Crops of frames that are no duplicates and have none yet; ``images`` has ``frame_uid``, ``content``."""
    todo = lookup.missing(dedup.not_duplicate(store.read("frames")), store.read("crops"), ["frame_uid"]).select("frame_uid", "frame_name", "width", "height", "video_name", "timestamp_seconds")
    todo = todo.orderBy("video_name", "timestamp_seconds")
    todo = (todo.limit(limit) if limit else todo).drop("video_name", "timestamp_seconds")
    found = models.crops(models.detect(todo.join(images, "frame_uid"), load, batch=batch), least=least, padding=padding, min_size=min_size)
    keep = ["frame_uid", "frame_name", "crop_path", "confidence", "bbox_x", "bbox_y", "bbox_width", "bbox_height", "padding", "crop_width", "crop_height"]
    store.save("crops", merge.upsert(store.read("crops"), found.drop("p"), ["crop_uid"], keep))


def assign_labels(store: Store, folder: str) -> DataFrame:
    """The folder a crop lies in becomes its label. Returns counts per label."""
    found = files.labelled(files.listing(store.spark, folder, suffixes=files.IMAGES))
    crops = store.read("crops")
    uid = lookup.last_by_name(crops.withColumn("name", S.basename("crop_path")), "name", "crop_uid")
    change = found.select("name", "label").dropDuplicates(["name"]).join(uid, "name").select("crop_uid", "label")
    store.save("crops", merge.update_by_key(crops, change, ["crop_uid"], ["label"]))
    return monitoring.label_counts(change, "label")


def group_crops(store: Store, gap_seconds: float = temporal.CROP_GAP_SECONDS) -> DataFrame:
    c = store.read("crops").withColumn("name", S.basename("crop_path")).withColumn("video_stem", S.crop_stem("crop_path")).withColumn("ms", S.crop_ms("crop_path")).filter("video_stem is not null")
    return temporal.group_crops(c, gap_seconds=gap_seconds)


def scatter_groups(grouped: DataFrame, folders: DataFrame, labels: DataFrame) -> DataFrame:
    """Crops of groups whose folder (renamed by hand) holds a label's name get that label."""
    chosen = lookup.longest_label(folders, "folder", labels, "label")
    return grouped.select("crop_uid", "group_name").join(folders, "group_name").join(chosen, "folder").select("crop_uid", "label")


def train(samples: DataFrame, label: str, vector: str, **options):
    """Model, classes, held-out rows, and their accuracy and per-class precision and recall."""
    model, classes, held = models.train(samples, label, vector, **options)
    rows = held.withColumn("_true", F.col(label).cast("string"))
    return model, classes, held, evaluate.accuracy(rows, "_true", "predicted"), evaluate.precision_recall(rows, "_true", "predicted", classes)


def predict(rows: DataFrame, load: Callable, classes: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Best class or unknown, with the three best scores."""
    scored = models.classify(rows, load, classes)
    names = F.array(*[F.lit(c) for c in classes])
    ranked = F.array_sort(F.transform("scores", lambda s, i: F.struct((-s).alias("minus"), i.alias("i"))))
    top = F.transform(F.slice(ranked, 1, 3), lambda x: F.struct(F.get(names, x["i"]).alias("name"), (-x["minus"]).alias("score")))
    return scored.select("name", S.or_unknown("label", "score", threshold).alias("label"), "score", top.alias("top3"))


def auto_label(rows: DataFrame, load: Callable, classes: Sequence[str], threshold: float = 0.8) -> DataFrame:
    return models.label_status(models.classify(rows, load, classes), threshold)


def retrain_videos(store: Store, listed: DataFrame, n: int = 10) -> DataFrame:
    """Videos to scan next: not yet scanned, evenly spread over their names."""
    return sampling.stride_sample(lookup.missing(listed.select(F.col("name").alias("video_name")), store.read("detections"), ["video_name"]), ["video_name"], n)


def prepare(store: Store, paths: Sequence[str], decoder: str, load: Callable, pts: DataFrame, hashes: DataFrame | None = None) -> None:
    """scan, intervals, frames and, with hashes, de-duplication."""
    scan(store, paths, decoder, load)
    intervals(store)
    frames(store, pts)
    if hashes is not None:
        deduplicate_frames(store, hashes)


def stats(store: Store) -> DataFrame:
    return monitoring.table_counts({n: store.read(n) for n in ("videos", "detections", "intervals", "frames", "crops")})


def log_training(spark: SparkSession, path: str, run: str, params: dict, accuracy: DataFrame, per_class: DataFrame) -> None:
    metrics = {"accuracy": accuracy.first()["accuracy"]}
    for r in per_class.collect():  # one row a class
        metrics |= {f"precision_{r['class']}": r["precision"], f"recall_{r['class']}": r["recall"]}
    sinks.log_run(spark, path, run, params, metrics)


def live(store: Store, source: str, capture: str, models: str, checkpoint: str, *, interval: float = 1.0, threshold: float = alerts.THRESHOLD, window: int = alerts.SIZE, majority: int = alerts.MAJORITY, cooldown: float = alerts.COOLDOWN, reload_seconds: float = 3600.0, webhook: str | None = None, metrics: str | None = None, version: str = "", send: Callable = sinks.post, **options):
    """Watches a camera: every accepted prediction is logged and pushed as metrics, and a majority of the
    last ones that is not in its cooldown goes to the webhook. Returns the running query; stop it, or see
    :func:`tidemark.streaming.live.stop_on_signals`. After the camera's last frame nothing more comes."""
    spark = store.spark
    spark.dataSource.register(camera.Camera)
    reader = spark.readStream.format("camera").option("source", source).option("capture", capture).option("interval", str(interval))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    found = streams.predictions(reader.load(), models, every=reload_seconds)
    rows = streams.live_alerts(found, every=True, size=window, least=majority, threshold=threshold, seconds=cooldown)
    at = F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))

    def act(batch: DataFrame, _: int) -> None:
        seen = batch.withColumn("timestamp", at.cast("timestamp_ntz")).persist()
        uid = S.make_uid("live", "timestamp", "seen", F.bround("conf", 4), "source", "idx")
        sinks.log_once(store, seen.select(uid.alias("detection_uid"), "timestamp", F.col("seen").alias("cat_name"), F.col("conf").alias("confidence"), "source"))
        if metrics:
            samples = F.array(F.struct(F.lit("cat_detected").alias("name"), F.lit(1.0).alias("value")), F.struct(F.lit("cat_confidence").alias("name"), F.col("conf").alias("value")))
            sinks.push_metrics(seen.select(F.create_map(F.lit("cat_name"), F.col("seen")).alias("labels"), F.explode(samples).alias("x")).select("x.name", "labels", "x.value"), metrics, send)
        if webhook:
            fired = seen.filter("name is not null").withColumn("b", F.from_json("box", "x int, y int, w int, h int"))
            sinks.post_webhooks(fired.select(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), "name", F.col("mean_conf").alias("confidence"), F.lit(version).alias("model_version"), "b.*"), webhook, send)
        seen.unpersist()

    return streams.start(rows, act, checkpoint)
