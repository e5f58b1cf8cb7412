"""Changes of a table as functions from tables to a table: upsert, insert-or-ignore, update,
replacement of a part, and pruning of orphans."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row a key: the last in ``order`` (columns that together leave no tie)."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) if isinstance(o, str) else o for o in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None) -> DataFrame:
    """``target`` with the rows of ``source`` (one a key): known keys take the columns in ``update``
    (default: all that source has), new keys come with the columns that source has."""
    has = [c for c in target.columns if c in source.columns and c not in keys]
    update = has if update is None else [c for c in update if c in has]
    t = target.withColumn("_t", F.lit(True)).alias("t")
    s = source.select(*keys, *has).withColumn("_s", F.lit(True)).alias("s")
    both = t.join(s, list(keys), "full_outer")
    new = F.col("s._s").isNotNull()
    columns = []
    for c in target.columns:
        if c in keys:
            columns.append(F.col(c))
        elif c in has:
            take = new & (F.col("t._t").isNull() | F.lit(c in update))
            columns.append(F.when(take, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            columns.append(F.col(f"t.{c}").alias(c))
    return both.select(*columns)


def insert_ignore(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds rows of new keys; what is there stays. Of rows of one key in ``source``, one comes."""
    fresh = source.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True).select(*target.columns)


def update_by_key(target: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sets columns of the rows whose key is in ``changes``; a null there changes nothing."""
    c = changes.select(*keys, *[F.col(x).alias(f"_{x}") for x in columns])
    out = target.join(c, list(keys), "left")
    return out.select(*[F.coalesce(F.col(f"_{x}"), F.col(x)).alias(x) if x in columns else F.col(x) for x in target.columns])


def replace_where(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deletes every row whose key is in ``source``, then inserts ``source``."""
    return target.join(source.select(*keys).distinct(), list(keys), "left_anti").unionByName(source, allowMissingColumns=True)


def reset(target: DataFrame, column: str, value) -> DataFrame:
    return target.withColumn(column, F.lit(value))


def prune_orphans(frames: DataFrame, annotations: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames with an interval, their annotations, and the paths of the frames that go. Crops stay."""
    used = edges.select("frame_uid").distinct()
    gone = frames.join(used, "frame_uid", "left_anti")
    return frames.join(used, "frame_uid", "left_semi"), annotations.join(gone.select("frame_uid"), "frame_uid", "left_anti"), gone.select("frame_path")
