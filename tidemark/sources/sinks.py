"""Where results go: label folders, images, metric pushes, webhooks, run and model registries."""
from __future__ import annotations

import json
import logging
import os
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import has_suffix, metric_line
from tidemark.operators import merge

log = logging.getLogger(__name__)
METRIC_TIMEOUT, WEBHOOK_TIMEOUT = 3.0, 5.0
PREVIEW = "_preview.jpg"


def write_by_label(df: DataFrame, path: str, label: str = "label") -> None:
    """Folders ``label=<value>``; only the labels in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(label).parquet(path)


def training_view(crops: DataFrame, reserved=("unsorted", "groups")) -> DataFrame:
    """What may train: labelled crops that are no duplicates."""
    return crops.filter(F.col("label").isNotNull() & ~F.col("label").isin(*reserved) & ~F.coalesce(F.col("is_duplicate"), F.lit(False)))


def write_images(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """Writes encoded images under their names, from the executors, through ``pyarrow.fs``; a file
    is complete under another name before it gets its own."""

    def write(rows) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for r in rows:
            target = f"{base}/{r[name]}"
            with store.open_output_stream(f"{target}.{os.getpid()}.part") as out:
                out.write(bytes(r[content]))
            store.move(f"{target}.{os.getpid()}.part", target)

    df.select(name, content).foreachPartition(write)


def move_files(df: DataFrame, folder: str, path: str = "path", label: str = "label", preview: str | None = None) -> None:
    """Moves the files of ``path`` into ``folder/<label>/`` under their names, from the executors; where
    the boolean column ``preview`` is true, a copy is left there as ``_preview.jpg``. A file that has
    moved already, in a task that runs again, is left where it is."""

    def move(rows) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for r in rows:
            _, source = fs.FileSystem.from_uri(r[path])
            target = f"{base}/{r[label]}"
            store.create_dir(target, recursive=True)
            name = f"{target}/{source.rsplit('/', 1)[-1]}"
            if store.get_file_info(source).type != fs.FileType.NotFound:
                store.move(source, name)
            if preview and r[preview]:
                store.copy_file(name, f"{target}/{PREVIEW}")

    columns = [path, label, *([preview] if preview else [])]
    df.select(*columns).foreachPartition(move)


def rebuild_training_set(files: DataFrame, folder: str, suffixes=(".jpg", ".jpeg", ".png"), reserved=("unsorted", "groups")) -> int:
    """Makes ``folder`` anew with a folder for each label that holds links to its images (copies where the
    store has no links), without previews and reserved labels. ``files`` has ``path``, ``name``,
    ``label``. Returns the number of images."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    if store.get_file_info(base).type != fs.FileType.NotFound:
        store.delete_dir(base)
    store.create_dir(base, recursive=True)
    chosen = files.filter(F.col("label").isNotNull() & ~F.col("label").isin(*reserved) & (F.col("name") != PREVIEW) & has_suffix("name", suffixes))

    def link(rows) -> None:
        own, root = fs.FileSystem.from_uri(folder)
        for r in rows:
            source, target = fs.FileSystem.from_uri(r["path"])[1], f"{root}/{r['label']}/{r['name']}"
            own.create_dir(f"{root}/{r['label']}", recursive=True)
            if not isinstance(own, fs.LocalFileSystem):
                own.copy_file(source, target)
            elif not os.path.lexists(target):
                os.symlink(source, target)

    chosen.select("path", "name", "label").foreachPartition(link)
    return chosen.count()


def post(url: str, body: bytes, kind: str, timeout: float) -> bool:
    """False, and a log line, where the receiver does not take it: alerts must not stop a stream."""
    try:
        request = urllib.request.Request(url, data=body, headers={"Content-Type": kind}, method="POST")
        with urllib.request.urlopen(request, timeout=timeout):
            return True
    except Exception as e:  # noqa: BLE001
        log.warning("%s: %s", url, e)
        return False


def push_metrics(samples: DataFrame, url: str, send: Callable = post, batch: int = 500) -> None:
    """Sends ``name``, ``labels``, ``value`` rows as text lines, many a request, from the executors."""

    def push(rows) -> None:
        held: list[str] = []
        for r in rows:
            held.append(r["line"])
            if len(held) == batch:
                send(url, "\n".join(held).encode(), "text/plain", METRIC_TIMEOUT)
                held = []
        if held:
            send(url, "\n".join(held).encode(), "text/plain", METRIC_TIMEOUT)

    samples.select(metric_line("name", "labels", "value").alias("line")).foreachPartition(push)


def webhook_payload(alerts: DataFrame) -> DataFrame:
    """``payload``: the JSON of an alert."""
    box = F.struct(*[F.col(c).cast("int").alias(c) for c in "xywh"]) if {"x", "y", "w", "h"} <= set(alerts.columns) else F.lit(None).cast("struct<x:int,y:int,w:int,h:int>")
    version = F.col("model_version") if "model_version" in alerts.columns else F.lit("")
    return alerts.select(F.to_json(F.struct(F.col("timestamp").cast("string").alias("timestamp"), F.col("name"), F.bround("confidence", 4).alias("confidence"), version.alias("model_version"), box.alias("bbox"))).alias("payload"))


def post_webhooks(alerts: DataFrame, url: str, send: Callable = post) -> None:
    def push(rows) -> None:
        for r in rows:
            send(url, r["payload"].encode(), "application/json", WEBHOOK_TIMEOUT)

    webhook_payload(alerts).foreachPartition(push)


def log_once(store, alerts: DataFrame) -> None:
    """Adds alerts to the live log; one that is there stays as it is."""
    store.save("live_detections", merge.insert_ignore(store.read("live_detections"), alerts, ["detection_uid"]))


def log_run(spark: SparkSession, path: str, run: str, params: dict, metrics: dict, artifact: str = "") -> None:
    """One row a run: parameters and metrics as maps."""
    row = [(run, {k: json.dumps(v) for k, v in params.items()}, {k: float(v) for k, v in metrics.items()}, artifact)]
    spark.createDataFrame(row, "run string, params map<string,string>, metrics map<string,double>, artifact string").withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)
