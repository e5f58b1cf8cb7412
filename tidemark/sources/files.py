"""Files as tables: listings, the video index, and the table store."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import scalars as S

IMAGES = (".jpg", ".jpeg", ".png")
IMAGES_STATS = (".jpg", ".jpeg")
IMAGES_PREDICT = (*IMAGES, ".bmp", ".webp")
RESERVED_LABELS = ("unsorted", "groups")


def listing(spark: SparkSession, path: str, pattern: str = "*", suffixes: Sequence[str] | None = None) -> DataFrame:
    """Files below ``path`` by path: ``path``, ``name``, ``modified``, ``size``. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    out = files.select("path", S.basename("path").alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    return (out if suffixes is None else out.filter(S.has_suffix("name", suffixes))).orderBy("path")


def contents(spark: SparkSession, path: str, suffixes: Sequence[str] = IMAGES) -> DataFrame:
    """Files with their bytes, for decoding on executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", S.basename("path").alias("name"), "content").filter(S.has_suffix("name", suffixes))


def labelled(files: DataFrame, reserved: Sequence[str] = RESERVED_LABELS) -> DataFrame:
    """The parent folder as ``label``, without reserved folders."""
    return files.withColumn("label", S.parent_name("path")).filter(F.col("label").isNotNull() & ~F.col("label").isin(*reserved))


def video_metadata(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index rows of recordings whose name holds a valid time, and the rejected names."""
    t = S.video_time("name")
    rows = files.withColumn("_t", t)
    good = rows.filter(F.col("_t").isNotNull())
    day = F.date_format("_t", "yyyy-MM-dd")
    index = good.select(F.col("name").alias("video_name"), day.alias("date"), F.date_format("_t", "HH:mm:ss").alias("time"), F.hour("_t").alias("hour"), S.lighting(F.hour("_t")).alias("lighting"), day.alias("split_group"))
    return index, rows.filter(F.col("_t").isNull()).select("name")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index CSV with its fixed columns; empty where there is no file."""
    schema = "video_name string, date string, time string, hour int, lighting string, split_group string"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(path, header=True)


def write_index(index: DataFrame, path: str) -> None:
    """One CSV file: an index has a row a recording."""
    index.select(*schemas.INDEX_COLUMNS).orderBy("video_name").coalesce(1).write.mode("overwrite").csv(path, header=True)


class Store:
    """Tables as Parquet below a root. A save writes a new version beside the old and only then is
    it the latest, so a table can be computed from itself and a failed save changes nothing."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        done = [p.getName() for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n[1:]) for n in done if n[:1] == "v" and n[1:].isdigit())

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            return schemas.empty(self.spark, name)
        return self.spark.read.schema(schemas.TABLES[name]).parquet(f"{self.root}/{name}/v{versions[-1]:08d}")

    def save(self, name: str, df: DataFrame, keep: int = 2) -> None:
        versions = self._versions(name)
        number = versions[-1] + 1 if versions else 1
        schemas.conform(df, name).write.parquet(f"{self.root}/{name}/v{number:08d}")
        for old in versions[: -(keep - 1) or None] if len(versions) >= keep else []:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/v{old:08d}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
