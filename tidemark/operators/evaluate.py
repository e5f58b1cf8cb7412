"""Classifier evaluation and training history."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def class_counts(df: DataFrame, label: str, classes: DataFrame) -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return classes.select(label).distinct().join(counts, label, "left").select(label, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def confusion_matrix(df: DataFrame, true: str, predicted: str, classes: Sequence) -> DataFrame:
    """A row for each true class, a column ``pred_<class>`` for each predicted one, zeros filled in.
    Rows are counted first, so that a row a class is joined."""
    counts = df.groupBy(F.col(true).alias("class")).agg(*[F.count(F.when(F.col(predicted) == F.lit(c), 1)).alias(f"pred_{c}") for c in classes])
    rows = df.sparkSession.createDataFrame([(c,) for c in classes], df.select(F.col(true).alias("class")).schema)
    return rows.join(counts, "class", "left").select("class", *[F.coalesce(f"pred_{c}", F.lit(0)).cast("long").alias(f"pred_{c}") for c in classes])


def matrix_text(matrix: DataFrame, classes: Sequence) -> str:
    """A confusion matrix as text: names flush left, counts flush right in columns of six."""
    width = max(len(str(c)) for c in classes)
    rows = {r["class"]: r for r in matrix.collect()}  # a row a class
    lines = ["  ".join([" " * width, *(f"{c!s:>6}" for c in classes)])]
    lines += ["  ".join([f"{c!s:<{width}}", *(f"{rows[c][f'pred_{p}']:>6}" for p in classes)]) for c in classes]
    return "\n".join(lines)


def precision_recall(df: DataFrame, true: str, predicted: str, classes: Sequence) -> DataFrame:
    """Per class: tp, fp, fn, precision, recall; 0 where a denominator is 0."""
    aggs = []
    for i, c in enumerate(classes):
        t, p = F.col(true) == F.lit(c), F.col(predicted) == F.lit(c)
        aggs += [F.count(F.when(t & p, 1)).alias(f"tp{i}"), F.count(F.when(~t & p, 1)).alias(f"fp{i}"), F.count(F.when(t & ~p, 1)).alias(f"fn{i}")]
    one = df.agg(*aggs)
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("class"), *[F.col(f"{k}{i}").alias(k) for k in ("tp", "fp", "fn")]) for i, c in enumerate(classes)])).alias("x")).select("x.*")
    share = lambda other: F.col("tp") / F.greatest(F.col("tp") + F.col(other), F.lit(1))
    return rows.select("class", "tp", "fp", "fn", share("fp").alias("precision"), share("fn").alias("recall"))


def accuracy(df: DataFrame, true: str, predicted: str) -> DataFrame:
    correct = F.count(F.when(F.col(true) == F.col(predicted), 1))
    return df.agg(F.count("*").alias("total"), correct.alias("correct"), (correct / F.greatest(F.count("*"), F.lit(1))).alias("accuracy"))


def weighted_loss(df: DataFrame, loss: str, n: str) -> DataFrame:
    return df.agg((F.sum(F.col(loss) * F.col(n)) / F.greatest(F.sum(n), F.lit(1))).alias("loss"))


def training_progress(history: DataFrame, epoch: str, score: str, patience: int = 7) -> DataFrame:
    """``best_so_far``, ``improved`` (strictly above all before), ``streak`` of epochs without
    improvement, ``stopped`` once a streak has reached ``patience``. One row an epoch, so small."""
    order = Window.orderBy(epoch)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    earlier = F.max(score).over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = history.withColumn("improved", F.coalesce(F.col(score) > earlier, F.lit(True))).withColumn("best_so_far", F.max(score).over(upto))
    out = out.withColumn("_block", F.sum(F.col("improved").cast("int")).over(upto))
    out = out.withColumn("streak", (F.row_number().over(Window.partitionBy("_block").orderBy(epoch)) - 1).cast("int")).drop("_block")
    return out.withColumn("stopped", F.max(F.col("streak") >= patience).over(upto))


def best_epoch(history: DataFrame, epoch: str, score: str) -> DataFrame:
    """The first epoch of the best score among those run before stopping."""
    return history.agg(F.min_by(epoch, F.struct(-F.col(score), F.col(epoch))).alias(epoch), F.max(score).alias(score))
