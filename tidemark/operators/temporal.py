"""Gap sessions, padded intervals, timestamp expansion and numbered groups."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalars import make_uid, rounded, timestamp_grid
from tidemark.operators.sampling import ranked

GAP_SECONDS, PAD_BEFORE, PAD_AFTER = 15.0, 3.0, 7.0
CROP_GAP_SECONDS = 10.0


def gap_sessions(df: DataFrame, keys: Sequence[str], ts: str, gap: float, to: str = "session", tie: Sequence[str] = ()) -> DataFrame:
    """A session number per key: a row begins one if it comes more than ``gap`` after the row before.
    One shuffle by key serves this and a following aggregation by key and session."""
    order = Window.partitionBy(*keys).orderBy(ts, *tie)
    starts = F.coalesce((F.col(ts) - F.lag(ts).over(order) > gap).cast("int"), F.lit(0))
    return df.withColumn("_starts", starts).withColumn(to, F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_starts")


def session_bounds(df: DataFrame, keys: Sequence[str], ts: str, score: str, session: str = "session") -> DataFrame:
    return df.groupBy(*keys, session).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").cast("int").alias("detection_count"), F.max(score).alias("max_confidence"))


def pad_and_clamp(df: DataFrame, duration: Column | str, before: float = PAD_BEFORE, after: float = PAD_AFTER) -> DataFrame:
    end = F.col(duration) if isinstance(duration, str) else duration
    return df.withColumn("start_seconds", rounded(F.greatest(F.lit(0.0), F.col("first_ts") - before), 3)).withColumn("end_seconds", rounded(F.least(end, F.col("last_ts") + after), 3))


def build_intervals(detections: DataFrame, videos: DataFrame, *, min_confidence: float = 0.25, gap: float = GAP_SECONDS, before: float = PAD_BEFORE, after: float = PAD_AFTER, source: str = "detector") -> DataFrame:
    """Detections of a table -> rows of ``intervals`` with content-derived ids."""
    known = detections.filter(F.col("confidence") >= min_confidence).select("video_name", "model_name", "timestamp_seconds", "confidence").join(videos.select("video_name", "duration_seconds"), "video_name")
    keys = ["video_name", "model_name", "duration_seconds"]
    bounds = session_bounds(gap_sessions(known, keys, "timestamp_seconds", gap), keys, "timestamp_seconds", "confidence")
    out = pad_and_clamp(bounds, "duration_seconds", before, after).withColumn("interval_source", F.lit(source))
    uid = make_uid("int", "interval_source", "video_name", "start_seconds", "end_seconds", "model_name")
    return out.select(uid.alias("interval_uid"), "video_name", "start_seconds", "end_seconds", "detection_count", "max_confidence", "interval_source", "model_name")


def expand_intervals(intervals: DataFrame, step: float = 1.0) -> DataFrame:
    """One row for each timestamp of each interval's grid."""
    return intervals.withColumn("timestamp_seconds", F.explode(timestamp_grid("start_seconds", "end_seconds", step)))


def group_crops(crops: DataFrame, key: str = "video_stem", ms: str = "ms", name: str = "name", gap_seconds: float = CROP_GAP_SECONDS) -> DataFrame:
    """Crops with ``group_name`` (group_001, ... by key and time) and ``is_preview`` (its first crop).
    The groups, which grow with the crops, are numbered by range partitions."""
    sessions = gap_sessions(crops, [key], ms, int(gap_seconds * 1000), "cluster", [name])
    numbered = ranked(sessions.select(key, "cluster").distinct(), [key, "cluster"]).select(key, "cluster", F.format_string("group_%03d", F.col("_rank") + 1).alias("group_name"))
    first = F.row_number().over(Window.partitionBy(key, "cluster").orderBy(ms, name)) == 1
    return sessions.withColumn("is_preview", first).join(numbered, [key, "cluster"])


def group_size_stats(groups: DataFrame, by: Sequence[str]) -> DataFrame:
    sizes = groups.groupBy(*by).agg(F.count("*").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return sizes.agg(zero(F.min("n")).alias("min_size"), zero(F.max("n")).alias("max_size"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_size"), F.count("*").alias("n_groups"))
