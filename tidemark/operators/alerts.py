"""Debounced alerts in batch: a majority over the last rows, then a cooldown per source."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIZE, MAJORITY, THRESHOLD, COOLDOWN = 5, 4, 0.6, 30.0


def majority(window: Column) -> Column:
    """struct(name, votes, mean_conf) of an array of struct(name, conf): most frequent name, on ties
    the one seen first."""
    names = F.transform(window, lambda r: r["name"])
    counted = F.transform(F.array_distinct(names), lambda n: F.struct((-F.size(F.filter(names, lambda m: m == n))).alias("minus"), F.array_position(names, n).alias("first"), n.alias("name")))
    best = F.array_min(counted)
    of = F.filter(window, lambda r: r["name"] == best["name"])
    mean = F.aggregate(of, F.lit(0.0), lambda a, r: a + r["conf"]) / F.greatest(F.size(of), F.lit(1))
    return F.struct(best["name"].alias("name"), (-best["minus"]).alias("votes"), mean.alias("mean_conf"))


def majority_windows(df: DataFrame, source: Sequence[str], order: Sequence[str], name: str, conf: str, *, size: int = SIZE, least: int = MAJORITY, threshold: float = THRESHOLD) -> DataFrame:
    """Rows accepted by ``threshold`` whose last ``size`` accepted rows agree: adds ``name``,
    ``votes``, ``mean_conf``."""
    w = Window.partitionBy(*source).orderBy(*order).rowsBetween(-(size - 1), 0)
    rows = df.filter(F.col(conf) >= threshold).withColumn("_window", F.collect_list(F.struct(F.col(name).alias("name"), F.col(conf).alias("conf"))).over(w))
    rows = rows.filter(F.size("_window") == size).withColumn("_best", majority(F.col("_window")))
    rows = rows.filter((F.col("_best.votes") >= least) & (F.col("_best.mean_conf") >= threshold))
    return rows.select(*df.columns, F.col("_best.name").alias("majority_name"), F.col("_best.votes").alias("votes"), F.col("_best.mean_conf").alias("mean_conf"))


def _folded(df: DataFrame, source: str, order: Sequence[str], columns: Sequence[str], keep) -> DataFrame:
    """The rows of ``columns`` that a state machine keeps of each source, in order. ``keep()`` makes one,
    which says of each row whether it stays. Rows stream through a task in order; nothing is gathered."""
    rows = df.select(*dict.fromkeys([source, *columns, *order])).repartition(source).sortWithinPartitions(source, *order)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, now = None, None
        for batch in batches:
            taken = []
            for i, (key, *row) in enumerate(zip(batch.column(source).to_pylist(), *(batch.column(c).to_pylist() for c in columns), strict=True)):
                if machine is None or key != now:
                    machine, now = keep(), key
                if machine(row):
                    taken.append(i)
            yield batch.select(list(columns)).take(pa.array(taken, pa.int64()))

    return rows.mapInArrow(run, schema)


def cooldown(df: DataFrame, source: str, ts: str, name: str, seconds: float = COOLDOWN, tie: Sequence[str] = ()) -> DataFrame:
    """``source``, ``ts``, ``name`` of the rows that fire: another name than the last fired, or the
    same after ``seconds``."""

    def machine():
        last: list = [None, None]

        def fires(row: list) -> bool:
            _, t, n = row
            if None not in (*last, t, n) and last[0] == n and t < last[1] + seconds:
                return False
            last[:] = n, t
            return True

        return fires

    return _folded(df, source, [ts, *tie, name], [source, ts, name], machine)


def throttle(df: DataFrame, source: str, ts: str, interval: float = 1.0, keep: Sequence[str] = ()) -> DataFrame:
    """``source``, ``ts`` and ``keep`` of the frames that are processed: the first of a source, and each
    that comes ``interval`` or more after the last processed one; others are dropped."""

    def machine():
        last: list = [None]

        def processed(row: list) -> bool:
            if last[0] is not None and row[1] - last[0] < interval:
                return False
            last[0] = row[1]
            return True

        return processed

    return _folded(df.filter(F.col(ts).isNotNull()), source, [ts, *keep], [source, ts, *keep], machine)
