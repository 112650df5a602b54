"""Components of large graphs."""

import numpy as np
from pyspark.sql import functions as F

from quern.operators import graph


def test_labels_of_a_long_chain(spark):
    """Nodes in random order: many rounds, none of which leaves anything in the next one's plan."""
    at = np.random.default_rng(4).permutation(400)
    edges = spark.createDataFrame(list(zip(at[:-1].tolist(), at[1:].tolist())), "a long, b long")
    got = graph.labelled(spark.range(400).select(F.col("id").alias("node")), edges)
    assert [tuple(r) for r in got.groupBy("label").count().collect()] == [(0, 400)]
    assert got._jdf.queryExecution().analyzed().constraints().size() <= 2
