"""Where operators cut lineage: a folder that the driver and all executors share."""
from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where that is unset and driver and
    executors are one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, as a full URI: the same place for Spark and for others."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has written into the shared folder, results that were not
    copied elsewhere included."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def narrow_parts(spark: SparkSession) -> int:
    """Partitions for tables that are a small part of the data: half of the shuffle partitions, so that
    they grow with the data as those do, and as many as there are cores at least."""
    return max(2, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)


def few_files(df: DataFrame) -> DataFrame:
    """:func:`narrow_parts` partitions at most, joined without a shuffle: for narrow tables made by
    little work behind an exchange, so that their files do not outnumber what they hold."""
    return df.coalesce(narrow_parts(df.sparkSession))


def written(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage ends there,
    so a lost executor costs a reread and not a recomputation. ``small``: in :func:`few_files`."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (few_files(df) if small else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables made by :func:`written` that no later step reads, and lets the driver collect
    its garbage, upon which Spark removes the shuffle files that nothing refers to any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tidemark/" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()
