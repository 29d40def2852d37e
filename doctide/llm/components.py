"""Connected components of a graph of any size, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctide.llm.work import Work


def components(edges: DataFrame, work: Work, name: str) -> DataFrame:
    """(id, comp) for each id in edges (a, b): comp is the smallest id of its component.

    A round takes each node's least label among its neighbours, then the label of that
    label.  Labels and edges stay tables; a hub's edges are summed before the shuffle
    and its join is one that Spark can split.
    """
    rows = 2 * edges.count()
    both = work.put(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), f"{name}-edges", rows=rows)
    labels = work.put(both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("id"), F.least("u", "m").alias("comp")), f"{name}-0", rows=rows)
    k = 0
    while True:
        near = (both.join(labels.withColumnRenamed("id", "v"), "v")
                .groupBy("u").agg(F.min("comp").alias("near")))
        met = labels.join(near.withColumnRenamed("u", "id"), "id").select(
            "id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        # a label is a node as well: its own label is at least as small
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        new = work.put(met.join(jump, "comp").select("id", "old", F.least("comp", "far").alias("comp")), f"{name}-{k + 1}", rows=rows)
        changed = new.filter(F.col("old") != F.col("comp")).limit(1).count()
        labels = new.select("id", "comp")
        work.drop(f"{name}-{k}")
        k += 1
        if not changed:
            work.drop(f"{name}-edges")
            return labels
