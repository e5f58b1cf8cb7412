"""Deterministic samples and splits."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import materialized


def ranked(df: DataFrame, order: Sequence[str], to: str = "_rank") -> DataFrame:
    """Global ranks 0.. of a total order without sorting in one task: rows are range-partitioned and
    written with the number of their partition, partitions counted, and ranks within one moved by the
    counts before it, a broadcast row a partition."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialized(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    before, starts = 0, []
    for r in placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # a row a partition
        starts.append((r["_part"], before))
        before += r["n"]
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    counted = placed.join(F.broadcast(spark.createDataFrame(starts, "_part int, _before long")), "_part")
    return counted.withColumn(to, F.col("_before") + within).select(*df.columns, to)


def stride_sample(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """At most n rows at even steps of the order: every max(1, count // k)-th, the first k of them."""
    count = df.count()
    k = min(n, count)
    if k < 1:
        return df.limit(0)
    step = max(1, count // k)
    return ranked(df, order).filter((F.col("_rank") % step == 0) & (F.col("_rank") < step * k)).drop("_rank")


def class_split(df: DataFrame, label: str, order: Sequence[str], val_fraction: float = 0.2) -> DataFrame:
    """``split`` of each row: the first max(1, floor(n * (1 - fraction))) of a class train."""
    w = Window.partitionBy(label)
    cut = F.greatest(F.lit(1), F.floor(F.count("*").over(w) * F.lit(1 - val_fraction)))
    return df.withColumn("split", F.when(F.row_number().over(w.orderBy(*order)) <= cut, "train").otherwise("val"))
