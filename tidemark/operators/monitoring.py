"""Counts, gauges and dashboard queries over metric samples and tables."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per label, and the grand total in the row of null label."""
    return df.rollup(label).agg(F.count("*").alias("n"))


def label_values(df: DataFrame, label: str) -> DataFrame:
    return df.select(label).filter(F.col(label).isNotNull()).distinct().orderBy(label)


def per_hour(df: DataFrame, key: str, ts: str) -> DataFrame:
    return df.groupBy(key, F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))


def trailing_count(df: DataFrame, key: Sequence[str], seconds: str, span: int, to: str = "n_trailing") -> DataFrame:
    """Rows of the same key in the last ``span`` seconds, this one included. Rows are counted by second
    first; a second's count also goes to the next stretch of ``span`` seconds, so that a task holds two
    stretches of a key and not the whole key."""
    second = F.floor(seconds).cast("long")
    stretch = F.floor(F.col("_second") / span)
    counts = df.groupBy(*key, second.alias("_second")).agg(F.count("*").alias("_n")).withColumn("_stretch", F.explode(F.array(stretch, stretch + 1)))
    w = Window.partitionBy(*key, "_stretch").orderBy("_second").rangeBetween(-span, 0)
    sums = counts.withColumn(to, F.sum("_n").over(w)).filter(F.col("_stretch") == stretch).select(*key, "_second", to)
    left, right = df.withColumn("_second", second).alias("l"), sums.alias("r")
    same = F.col("l._second").eqNullSafe(F.col("r._second"))
    for k in key:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.join(right, same).select(*[F.col(f"l.{c}") for c in df.columns], F.col(f"r.{to}"))


def last_seen(df: DataFrame, key: str, ts: str, pattern: str = ".*") -> DataFrame:
    """Latest time per key whose whole name matches ``pattern``."""
    return df.filter(F.col(key).rlike(f"^(?:{pattern})$")).groupBy(key).agg(F.max(ts).alias("last_seen"))


def last_not_null(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, ts).alias("last_value"))
