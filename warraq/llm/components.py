"""Connected components by minimum labels and pointer jumping, on tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage


#: A graph of up to this many links (16 bytes each) is settled by one task's union-find.
ONE_TASK_LINKS = 200_000


def _union_find(batches):
    up: dict[int, int] = {}

    def root(x: int) -> int:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "comp"])


def components(edges: DataFrame, work: str) -> DataFrame:
    """node, comp for every node of ``edges`` (a, b): comp is the smallest node reachable.

    Each round takes the least label of the neighbours (a pre-aggregated minimum, so a
    hub is no bottleneck) and then the label of that label; rounds are written to
    ``work``, so a lost executor re-reads one round.  Links of a node with itself are no
    links; without links there are no rows.
    """
    spark = edges.sparkSession
    edges = stage(edges.where("a <> b").select("a", "b").distinct(), f"{work}/links")
    if edges.count() <= ONE_TASK_LINKS:
        return stage(edges.repartition(1).mapInArrow(_union_find, "node long, comp long"), f"{work}/labels")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage(both.distinct(), f"{work}/edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), f"{work}/labels-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("m"))
        moved = labels.join(near, labels.node == near.a).select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        to = labels.select(F.col("node").alias("t"), F.col("comp").alias("up"))
        moved = moved.join(to, moved.comp == to.t, "left").select("node", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp"))
        new = stage(moved, f"{work}/labels-{step}")
        done = new.where("old <> comp").isEmpty()
        drop_stage(spark, f"{work}/labels-{step - 1}")
        labels = new.select("node", "comp")
        if done:
            drop_stage(spark, f"{work}/edges")
            return labels
