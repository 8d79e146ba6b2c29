"""Connected components of a distributed graph by min labels and pointer jumping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mandisight.llm.common import drop, written_at


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) from ``edges`` (a, b: long): the smallest id reachable.

    Each round takes the smallest label among a node's neighbours, combined
    inside every task before the shuffle, then replaces a label by the label
    of that label, which halves the length of chains. Labels are written each
    round, so the plan does not grow and a lost executor costs one round; what
    the round before wrote goes.
    """
    spark = edges.sparkSession
    both = edges.where("a <> b").select("a", "b")
    both, edges_at = written_at(
        both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels, labels_at = written_at(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m"))
                                   .select("node", F.least("node", "_m").alias("component")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near")))
        hooked = labels.join(near, "node").select(
            "node", F.col("component").alias("_old"), F.least("component", "_near").alias("_new"))
        jump = labels.select(F.col("node").alias("_new"), F.col("component").alias("_jump"))
        after, after_at = written_at(hooked.join(jump, "_new").select(
            "node", F.least("_new", "_jump").alias("component"), "_old"), "labels")
        drop(spark, labels_at)
        if after.where(F.col("component") != F.col("_old")).isEmpty():
            drop(spark, edges_at)
            return after.select("node", "component")
        labels, labels_at = after.select("node", "component"), after_at


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes through the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label
