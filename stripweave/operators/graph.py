"""Graph clustering on edge tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """A written table in the folder that all executors share (spark.checkpoint.dir); checkpoint() where only the context knows one."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        return df.checkpoint()
    path = f"{base.rstrip('/')}/stripweave/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """nodes: id; edges: a, b. Each node with the least id of its component.

    In a round each node takes the least label of its neighbours, the node that is its label learns of it too, and then labels' own labels
    are taken. As a label learns what any of its nodes meets, rounds grow with the logarithm of the nodes, not with the length of paths
    (15 for a path of 10,000 nodes in random order). Beyond `most_rounds` an error is raised rather than a partial answer returned.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    now = cut_lineage(nodes.select("id", F.col("id").alias("label")))
    for _ in range(most_rounds):
        near = both.join(now.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        met = now.join(near, "id", "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        told = met.filter("new < label").groupBy(F.col("label").alias("id")).agg(F.min("new").alias("told"))
        step = cut_lineage(met.join(told, "id", "left").select("id", "label", F.least("new", F.coalesce("told", "new")).alias("new")))
        changed = step.filter("new <> label").limit(1).count()
        if not changed:
            return now
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("further"))
        now = cut_lineage(step.join(jump, "new", "left").select("id", F.least("new", F.coalesce("further", "new")).alias("label")))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_pairs(points: DataFrame, size: float) -> DataFrame:
    """a, b: points of one group nearer than `size`. Cells of that width are equi-joined with their neighbours, so no group is crossed with itself."""
    cell = [F.floor(F.col(c) / size).cast("int").alias(f"c{c}") for c in "xyz"]
    a = points.select("grp", "id", "x", "y", "z", *cell)
    for c in "xyz":
        a = a.withColumn(f"c{c}", F.explode(F.array(F.col(f"c{c}") - 1, F.col(f"c{c}"), F.col(f"c{c}") + 1)))
    b = points.select("grp", F.col("id").alias("other"), *[F.col(c).alias(f"o{c}") for c in "xyz"], *cell)
    d2 = sum(((F.col(c) - F.col(f"o{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("ox")) ** 2)
    return a.join(b, ["grp", "cx", "cy", "cz"]).filter((F.col("id") < F.col("other")) & (d2 <= size * size)).select(F.col("id").alias("a"), F.col("other").alias("b"))
