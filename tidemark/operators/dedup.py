"""Leader de-duplication over perceptual hashes: an item is a duplicate if it is close to the last
kept item of its group (not to its neighbour), else it becomes the item to compare with."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 6
MASK = (1 << 64) - 1


def leader_dedup(df: DataFrame, key: str, order: list[str], hash_col: str, item: str, threshold: int = THRESHOLD) -> DataFrame:
    """``key``, ``item``, ``is_duplicate`` for every row with a hash. The fold is sequential within a
    key by definition; keys run in parallel, and rows stream through a task in order, with one hash held."""
    rows = df.filter(F.col(hash_col).isNotNull()).select(F.col(key).alias("key"), F.col(item).alias("item"), F.col(hash_col).cast("long").alias("hash"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    rows = rows.repartition("key").sortWithinPartitions("key", *[f"o{i}" for i in range(len(order))], "item").select("key", "item", "hash")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leader = None, None
        for batch in batches:
            out = []
            for k, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                near = leader is not None and k == now and ((leader ^ h) & MASK).bit_count() <= threshold
                if not near:
                    now, leader = k, h
                out.append(near)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=["key", "item", "is_duplicate"])

    kinds = df.schema[key].dataType.simpleString(), df.schema[item].dataType.simpleString()
    return rows.mapInArrow(fold, f"key {kinds[0]}, item {kinds[1]}, is_duplicate boolean").toDF(key, item, "is_duplicate")


def flag_duplicates(items: DataFrame, edges: DataFrame, key: str, order: list[str], hash_col: str, item: str, threshold: int = THRESHOLD) -> DataFrame:
    """``items`` with ``is_duplicate`` set anew: true where any group says so; rows that are in no
    group, or have no hash, are none."""
    found = leader_dedup(edges, key, order, hash_col, item, threshold).filter("is_duplicate").select(item).distinct().withColumn("_dup", F.lit(True))
    return items.drop("is_duplicate").join(found, item, "left").withColumn("is_duplicate", F.coalesce("_dup", F.lit(False))).drop("_dup")


def not_duplicate(df: DataFrame) -> DataFrame:
    return df.filter(~F.coalesce(F.col("is_duplicate"), F.lit(False)))
