"""Range partitions of a table by an integer id, with known cuts and no unbounded part."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_PARTS = 100_000


def text_parts(docs: DataFrame, part_bytes: int = 8 << 20) -> int:
    """How many parts of about ``part_bytes`` of stored files ``docs`` makes (at most
    ``MOST_PARTS``); the number of shuffle partitions where it has no files."""
    spark = docs.sparkSession
    files = docs.inputFiles()
    if not files:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = 0
    for folder in {f.rsplit("/", 1)[0] if f.rsplit("/", 1)[0].endswith(".parquet") or "/part-" in f else f for f in files}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(1, min(MOST_PARTS, total // part_bytes + 1))


def boundaries(docs: DataFrame, column: str, parts: int) -> list[int]:
    """Up to ``parts``-1 ascending values of ``column`` that cut its rows into about even parts;
    each is a value that occurs, and so the first of its part."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    cuts = docs.agg(F.percentile_approx(column, shares, 10 * max(parts, 1000)).alias("q")).first()["q"]
    return sorted(set(cuts or []))


def part_of(value: Column, cuts: list[int]) -> Column:
    """The number of cuts at or below a value: its part. Null goes first. The cuts are one literal in
    the plan, however many; two levels, so that a row costs the square root of their number."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts)) + 1
    known = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    below = lambda array: F.size(F.filter(array, lambda c: c <= value))
    heads = below(known(cuts[::width]))
    inner = F.when(heads > 0, (heads - 1) * width + below(F.slice(known(cuts), (F.greatest(heads, F.lit(1)) - 1) * width + 1, F.lit(width))))
    return F.coalesce(inner, F.lit(0))
