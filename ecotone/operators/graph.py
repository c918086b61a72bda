"""Connected components of a graph of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecotone.sources.staging import stage


def components(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(id, component): the smallest id reachable over edges (u, v), for every id with an edge.

    Each round an id takes the least label among its own, its neighbours' and
    its label's; rounds are written to shared storage, so lineage stays short.
    Hot ids meet in partial aggregations and in joins that can be split.
    """
    some = edges.where("u <> v")
    both = stage(some.select("u", "v").union(some.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "graph")
    label = stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("component")), "labels")
    for _ in range(most_rounds):
        near = both.join(label.select(F.col("id").alias("v"), "component"), "v").groupBy("u").agg(F.min("component").alias("m"))
        own = label.join(near.withColumnRenamed("u", "id"), "id").select("id", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        jump = label.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = stage(own.join(jump, "component", "left").select("id", F.least("component", F.coalesce("next", "component")).alias("component"), "was"), "labels")
        label = new.select("id", "component")
        if not new.where("component <> was").limit(1).count():
            return label
    raise RuntimeError(f"labels still move after {most_rounds} rounds")
