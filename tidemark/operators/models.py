"""Detection, classification and training as dataflow. Models are injected callables."""
from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S

BOX = "x1 double, y1 double, x2 double, y2 double, confidence double"


def detect(frames: DataFrame, load: Callable[[], Callable], *, batch: int = 64, content: str = "content") -> DataFrame:
    """``frames`` without contents, with ``boxes``. ``load()`` runs once a task and gives a function
    from a list of images to a list of lists of (x1, y1, x2, y2, confidence)."""
    keep = [c for c in frames.columns if c != content]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema if f.name != content)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            found: list = []
            for i in range(0, len(pdf), batch):
                images = pdf[content].iloc[i : i + batch].tolist()
                result = model(images)
                if len(result) != len(images):
                    raise ValueError("the detector must give one result an image")
                found += [[dict(zip(("x1", "y1", "x2", "y2", "confidence"), map(float, b), strict=True)) for b in r] for r in result]
            yield pdf[keep].assign(boxes=found)

    return frames.mapInPandas(run, f"{kinds}, boxes array<struct<{', '.join(b.replace(' ', ':') for b in BOX.split(', '))}>>")


def detections(found: DataFrame, model_name: str, *, least: float = 0.25, sample_seconds: float = 5.0) -> DataFrame:
    """Rows of ``detections``: the best box of each frame that has one of at least ``least``."""
    best = F.array_max(F.transform(F.filter("boxes", lambda b: b["confidence"] >= least), lambda b: b["confidence"]))
    rows = found.withColumn("confidence", best).filter(F.col("confidence").isNotNull())
    ts = S.rounded("timestamp_seconds", 3)
    return rows.select(S.make_uid("det", "video_name", F.lit(model_name), ts).alias("detection_uid"), "video_name", ts.alias("timestamp_seconds"), S.rounded("confidence", 4).alias("confidence"), F.lit(model_name).alias("model_name"), F.lit(float(sample_seconds)).alias("sampler_interval_seconds"), F.col("width").alias("frame_width"), F.col("height").alias("frame_height"))


def crops(found: DataFrame, *, least: float = 0.3, padding: float = 0.15, min_size: float = 50) -> DataFrame:
    """Rows of ``crops`` for boxes large and sure enough, padded and inside the frame."""
    rows = found.select("frame_uid", "frame_name", "width", "height", F.posexplode("boxes").alias("idx", "b")).filter(F.col("b.confidence") >= least)
    w, h = F.col("b.x2") - F.col("b.x1"), F.col("b.y2") - F.col("b.y1")
    rows = rows.filter(S.large_enough(w, h, min_size)).withColumn("p", S.padded_box("b.x1", "b.y1", w, h, padding, "width", "height")).filter(S.has_area(F.col("p")))
    r = lambda c: S.rounded(c, 2)
    uid = S.make_uid("crp", "frame_uid", "idx", r("b.x1"), r("b.y1"), r("b.x2"), r("b.y2"))
    name = F.concat(F.regexp_replace("frame_name", r"\.[^.]*$", ""), F.lit("__box_"), F.col("idx").cast("string"), F.lit(".jpg"))
    return rows.select(uid.alias("crop_uid"), "frame_uid", "frame_name", name.alias("crop_path"), F.col("b.confidence").alias("confidence"), F.col("b.x1").alias("bbox_x"), F.col("b.y1").alias("bbox_y"), w.alias("bbox_width"), h.alias("bbox_height"), F.lit(padding).alias("padding"), (F.col("p.right") - F.col("p.left")).alias("crop_width"), (F.col("p.bottom") - F.col("p.top")).alias("crop_height"), "p")


def exported_crops(annotations: DataFrame, frames: DataFrame, *, padding: float = 0.1, min_size: float = 32) -> DataFrame:
    """Crops of annotated boxes that are whole and large enough; labels become folder names."""
    a = annotations.dropna(subset=["bbox_x", "bbox_y", "bbox_width", "bbox_height"]).filter(S.large_enough("bbox_width", "bbox_height", min_size))
    rows = a.join(frames.select("frame_uid", "frame_name", "width", "height"), "frame_uid").withColumn("p", S.padded_box("bbox_x", "bbox_y", "bbox_width", "bbox_height", padding, "width", "height")).filter(S.has_area(F.col("p")))
    return rows.select(S.make_uid("crp", "annotation_uid", F.lit(padding)).alias("crop_uid"), "annotation_uid", "frame_uid", "frame_name", S.sanitize_label("label").alias("label"), "bbox_x", "bbox_y", "bbox_width", "bbox_height", F.lit(padding).alias("padding"), (F.col("p.right") - F.col("p.left")).alias("crop_width"), (F.col("p.bottom") - F.col("p.top")).alias("crop_height"), "p")


def classify(rows: DataFrame, load: Callable[[], Callable], classes: Sequence[str], *, content: str = "content", key: str = "name") -> DataFrame:
    """``key``, ``label``, ``score``, ``scores``. The model gives a list of logits an image, or None
    for one that cannot be decoded, whose label stays null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "logits": model(pdf[content].tolist())})

    kind = rows.schema[key].dataType.simpleString()
    scored = rows.select(key, content).mapInPandas(run, f"`{key}` {kind}, logits array<double>").withColumn("scores", S.softmax("logits"))
    return scored.withColumn("_top", F.when(F.col("scores").isNotNull(), S.top_class("scores", classes))).select(key, F.col("_top.name").alias("label"), F.col("_top.score").alias("score"), "scores")


def label_status(classified: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``status``: labelled, rejected below the threshold, or undecodable. Nothing is deleted."""
    return classified.withColumn("status", F.when(F.col("score").isNull(), "undecodable").when(F.col("score") >= threshold, "labelled").otherwise("rejected"))


def train(samples: DataFrame, label: str, vector: str, *, epochs: int = 30, fraction: float = 0.2, order: Sequence[str] = ("vec_id",)):
    """A classifier over vectors; class ids follow the sorted names. Returns the model, the classes
    and the held-out rows with their ``predicted`` class. An error for fewer than two classes."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IndexToString, StringIndexer
    from pyspark.ml.functions import array_to_vector

    from tidemark.operators.sampling import class_split

    split = class_split(samples, label, list(order), fraction).withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))).withColumn("_name", F.col(label).cast("string"))
    index = StringIndexer(inputCol="_name", outputCol="_class", stringOrderType="alphabetAsc").fit(split)
    names = list(index.labels)
    if len(names) < 2:
        raise ValueError("training needs two classes at least")
    steps = [index, LogisticRegression(labelCol="_class", predictionCol="_predicted", maxIter=epochs), IndexToString(inputCol="_predicted", outputCol="predicted", labels=names)]
    model = Pipeline(stages=steps).fit(split.filter("split = 'train'"))
    held = model.transform(split.filter("split = 'val'")).select(*[c for c in samples.columns], "predicted")
    return model, names, held


def save_model(spark, model, classes: Sequence[str], path: str, **about) -> None:
    """Saves a fitted pipeline with its classes and what else is said about it (numbers and strings)."""
    model.write().overwrite().save(f"{path}/model")
    row = [(json.dumps(list(classes)), len(classes), json.dumps(about))]
    spark.createDataFrame(row, "classes string, n_classes int, about string").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load_model(spark, path: str) -> tuple:
    """A saved model, its classes, and what was said about it."""
    from pyspark.ml import PipelineModel

    row = spark.read.schema("classes string, n_classes int, about string").json(f"{path}/about").first()
    return PipelineModel.load(f"{path}/model"), json.loads(row["classes"]), json.loads(row["about"])
