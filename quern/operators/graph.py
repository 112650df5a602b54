"""Connected components by repeated minima of neighbouring labels, each round written to the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of our own only if all executors are in this process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="quern-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df as files of the checkpoint folder, without its lineage.

    DataFrame.checkpoint() hands a plan's constraints on, and over the rounds of a loop they grow until the driver can't
    hold them.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    path = f"{context.getCheckpointDir()}/quern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable. edges: a, b in either direction.

    In a round all nodes of a label take the smallest label that any of them has beside it.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = nodes.select("node", F.col("node").alias("label"))
    while True:
        own, other = (now.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in ("a", "b"))
        seen = both.join(own, "a").join(other, "b").filter("label_b < label_a").groupBy("label_a").agg(F.min("label_b").alias("near"))
        lower = now.join(seen, now["label"] == seen["label_a"], "left").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        # A label is itself a node: its own label may be smaller still.
        jump = lower.select(F.col("node").alias("k"), F.col("label").alias("far"))
        new = checkpointed(lower.join(jump, lower["label"] == jump["k"]).select("node", F.least("label", "far").alias("label"), "was"))
        now = new.select("node", "label")
        if new.filter("label < was").limit(1).count() == 0:
            return now
