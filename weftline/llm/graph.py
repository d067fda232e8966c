"""Connected components of a graph whose links lie in a table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import shared


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links a-b that aren't the least of their component, and that least node, in memory."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new != (jump := new[new])).any():
            new = jump
        if (new == label).all():
            break
        label = new
    far = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[far], nodes[label[far]]


def components(links: DataFrame, spark: SparkSession) -> DataFrame:
    """links (a long, b long) to (node, root): the least node of its component for every node but that one.

    Large-star and small-star steps in turn until nothing changes; each round is a table in the shared
    folder. Rounds grow with the logarithm of the longest chain. Joins are on written tables, so that Spark
    can split the partition of a node with very many links. Nulls and loops are left out.
    """

    def mark(e: DataFrame):
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    e = shared.written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), spark, "links")
    was = mark(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = shared.written(large, spark, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = shared.written(small, spark, "small-star")
        now = mark(e)
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
