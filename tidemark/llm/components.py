"""Connected components of a graph given as edges, by minimum labels and pointer jumping."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``label`` (the least node of its component) for every node of ``edges``. Each round
    takes the least label of a node's neighbours and then the label of its label, so rounds grow
    with the logarithm of the diameter. Neighbours are reduced to a minimum, never collected."""
    both = written(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(b, a)).filter("x != y").distinct(), "edges", small=True)
    labels = both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("least")).select("node", F.least("node", "least").alias("label"))
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("x"), "left").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = step.select(F.col("node").alias("via"), F.col("label").alias("further"))
        after = written(step.join(jump, F.col("label") == F.col("via"), "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old"), "labels", small=True)
        labels = after.select("node", "label")
        if after.filter(F.col("label") != F.col("old")).isEmpty():
            return labels
