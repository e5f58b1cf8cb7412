"""COCO exports: categories, images and annotations as tables, and their import."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import scalars as S
from tidemark.operators import lookup


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Categories, images and annotations, each with the path of its export."""
    raw = spark.read.schema(schemas.COCO).json(path, multiLine=True).withColumn("export_path", F.input_file_name())
    part = lambda name: raw.select("export_path", F.explode(name).alias("x")).select("export_path", "x.*")
    return part("categories"), part("images"), part("annotations")


def import_annotations(spark: SparkSession, path: str, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``annotations`` for images whose base name is a known frame, and the images that are
    not. An annotation without image is left out; without category its label is 'unknown'."""
    categories, images, annotations = read_coco(spark, path)
    known = lookup.last_by_name(frames, "frame_name", "frame_uid")
    named = images.select("export_path", F.col("id").alias("image_id"), S.basename("file_name").alias("image_name"))
    found = named.join(known.withColumnRenamed("frame_name", "image_name"), "image_name", "left")
    linked = annotations.join(found.filter(F.col("frame_uid").isNotNull()), ["export_path", "image_id"])
    labels = categories.select("export_path", F.col("id").alias("category_id"), F.col("name").alias("label"))
    rows = linked.join(labels, ["export_path", "category_id"], "left")
    box = lambda i: F.get("bbox", F.lit(i))
    out = rows.select(
        S.make_uid("ann", "export_path", "id").alias("annotation_uid"), "frame_uid", "image_name", F.coalesce("label", F.lit("unknown")).alias("label"),
        box(0).alias("bbox_x"), box(1).alias("bbox_y"), box(2).alias("bbox_width"), box(3).alias("bbox_height"), "area",
        (F.coalesce("iscrowd", F.lit(0)) != 0).alias("is_crowd"), S.parent_name("export_path").alias("cvat_task_name"), "export_path",
    )
    return schemas.conform(out, "annotations"), found.filter(F.col("frame_uid").isNull()).select("image_name")
