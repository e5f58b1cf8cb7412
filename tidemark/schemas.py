"""The eight tables as explicit Spark schemas, with their keys, and the COCO document."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType()}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (x.split() for x in text.split(", "))])


TABLES: dict[str, T.StructType] = {
    "videos": _schema("video_name string, video_path string, date string, time string, hour int, lighting string, split_group string, duration_seconds double, fps double, width int, height int, file_size_bytes bigint, updated_at timestamp_ntz"),
    "detections": _schema("detection_uid string, video_name string, timestamp_seconds double, confidence double, model_name string, label string, sampler_interval_seconds double, frame_width int, frame_height int, created_at timestamp_ntz"),
    "intervals": _schema("interval_uid string, video_name string, start_seconds double, end_seconds double, detection_count int, max_confidence double, interval_source string, model_name string, created_at timestamp_ntz"),
    "frames": _schema("frame_uid string, video_name string, timestamp_seconds double, frame_name string, frame_path string, width int, height int, cvat_task_name string, is_duplicate boolean, created_at timestamp_ntz"),
    "frame_intervals": _schema("frame_uid string, interval_uid string, created_at timestamp_ntz"),
    "annotations": _schema("annotation_uid string, frame_uid string, image_name string, label string, bbox_x double, bbox_y double, bbox_width double, bbox_height double, area double, is_crowd boolean, cvat_task_name string, export_path string, created_at timestamp_ntz"),
    "crops": _schema("crop_uid string, frame_uid string, frame_name string, crop_path string, label string, confidence double, bbox_x double, bbox_y double, bbox_width double, bbox_height double, padding double, crop_width int, crop_height int, is_duplicate boolean, created_at timestamp_ntz"),
    "live_detections": _schema("detection_uid string, timestamp timestamp_ntz, cat_name string, confidence double, source string, created_at timestamp_ntz"),
}
KEYS = {"videos": ["video_name"], "detections": ["detection_uid"], "intervals": ["interval_uid"], "frames": ["frame_uid"], "frame_intervals": ["frame_uid", "interval_uid"], "annotations": ["annotation_uid"], "crops": ["crop_uid"], "live_detections": ["detection_uid"]}
#: What a column holds where a row does not say.
DEFAULTS = {"frames": {"is_duplicate": False}, "crops": {"is_duplicate": False, "label": "unsorted"}}
#: Columns that hold the time of the first save where a row does not say.
TIMES = ("created_at", "updated_at")
INDEX_COLUMNS = ["video_name", "date", "time", "hour", "lighting", "split_group"]
COCO = T.StructType([
    T.StructField("categories", T.ArrayType(_schema("id bigint, name string"))),
    T.StructField("images", T.ArrayType(_schema("id bigint, file_name string"))),
    T.StructField("annotations", T.ArrayType(T.StructType([*_schema("id bigint, image_id bigint, category_id bigint"), T.StructField("bbox", T.ArrayType(T.DoubleType())), *_schema("area double, iscrowd int")]))),
])


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with exactly the columns of a table: missing ones get their default, the time of now
    or null, surplus ones go (how columns are added and dropped over time)."""
    defaults = DEFAULTS.get(name, {})
    out = []
    for f in TABLES[name]:
        value = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in defaults:
            value = F.coalesce(value, F.lit(defaults[f.name]))
        if f.name in TIMES:
            value = F.coalesce(value.cast(f.dataType), F.current_timestamp().cast(f.dataType))
        out.append(value.cast(f.dataType).alias(f.name))
    return df.select(*out)


def empty(spark, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def violations(df: DataFrame, name: str) -> DataFrame:
    """Keys that occur more than once or hold null: an invariant to check, as Spark has no index."""
    keys = KEYS[name]
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | missing)
