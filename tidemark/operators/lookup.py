"""Joins by name, by substring and by time, and what finds no partner."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_ROWS = 200_000


def matched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "left_semi")


def missing(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without a partner: set difference, orphans, what is not yet processed. An anti-join, as
    NOT IN over a nullable column would compare every pair."""
    return left.join(right.select(*on).distinct(), list(on), "left_anti")


def last_by_name(lookup: DataFrame, name: str, uid: str) -> DataFrame:
    """One row a name: the greatest id, where a name occurs more than once."""
    return lookup.groupBy(name).agg(F.max(uid).alias(uid))


def with_default(left: DataFrame, lookup: DataFrame, on: str, value: str, default: str) -> DataFrame:
    return left.join(lookup.select(on, value), on, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def longest_label(folders: DataFrame, folder: str, labels: DataFrame, label: str) -> DataFrame:
    """``folder``, ``label``: the longest label that a folder's name contains, case ignored; ties go
    to the first label in order. Labels are a small dictionary; beyond ``BROADCAST_ROWS`` of them,
    each folder's substrings are looked up by an equality join instead of comparing all pairs."""
    names = labels.select(label).filter(F.col(label) != "").distinct().withColumn("_key", F.lower(label))
    if names.count() <= BROADCAST_ROWS:
        pairs = folders.select(folder).distinct().join(F.broadcast(names), F.contains(F.lower(folder), F.col("_key")))
    else:
        text = F.lower(folder)
        pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.transform(F.sequence(F.lit(1), F.length(text) - i + 1), lambda n: F.substring(text, i, n))))
        pairs = folders.select(folder).distinct().filter(F.length(folder) > 0).withColumn("_key", F.explode(F.array_distinct(pieces))).join(names, "_key")
    best = Window.partitionBy(folder).orderBy(F.length(label).desc(), label)
    return pairs.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(folder, label)


def forward_asof(targets: DataFrame, frames: DataFrame, key: str, ts: str, pts: str, frame: str, *, slack: float = 1e-6) -> DataFrame:
    """``targets`` with the first frame of the key whose ``pts`` + slack is at or after ``ts``; none
    past the last frame. Both sides are merged in time order and the next frame is carried
    backwards: one shuffle by key and one sort, no join of ranges."""
    extra = [c for c in targets.columns if c not in (key, ts)]
    a = targets.select(key, F.col(ts).alias("_t"), F.lit(0).alias("_kind"), F.struct(*[F.col(c) for c in [ts, *extra]]).alias("_row"), F.lit(None).cast(frames.schema[pts].dataType).alias("_pts"), F.lit(None).cast(frames.schema[frame].dataType).alias("_frame"))
    b = frames.select(key, (F.col(pts) + slack).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(pts).alias("_pts"), F.col(frame).alias("_frame"))
    ahead = Window.partitionBy(key).orderBy(F.col("_t"), F.col("_kind"), F.col("_frame")).rowsBetween(0, Window.unboundedFollowing)
    hit = F.first(F.when(F.col("_kind") == 1, F.struct("_pts", "_frame")), ignorenulls=True).over(ahead)
    out = a.unionByName(b).withColumn("_hit", hit).filter((F.col("_kind") == 0) & F.col("_hit").isNotNull())
    return out.select(key, "_row.*", F.col("_hit._pts").alias(pts), F.col("_hit._frame").alias(frame))


def from_name(df: DataFrame, name: str, start: str) -> DataFrame:
    """The rows from the one called ``start`` on, by name; an error where there is none."""
    if df.filter(F.col(name) == start).isEmpty():
        raise ValueError(f"{start} is not there")
    return df.filter(F.col(name) >= start)


def present(rows: DataFrame, files: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose file is listed, and those whose file is missing, to be counted and skipped."""
    known = files.select(key).distinct()
    return rows.join(known, key, "left_semi"), rows.join(known, key, "left_anti")
