"""Connected components of an edge table, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame) -> DataFrame:
    """(v, comp): for every vertex of edges (a, b) the smallest vertex that it reaches.

    Each round takes the smallest label among the neighbours and then that label's own label (pointer jumping), so the
    number of rounds grows with the logarithm of a component's width for chains and is two or three for stars.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = stage(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("comp")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "comp"), "b").groupBy(F.col("a").alias("v")).agg(F.min("comp").alias("near"))
        hooked = labels.join(near, "v").select("v", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        roots = labels.select(F.col("v").alias("comp"), F.col("comp").alias("root"))
        jumped = hooked.join(roots, "comp").select("v", "was", F.least("comp", "root").alias("comp"))
        moved = stage(jumped, "cc-labels")
        labels = moved.select("v", "comp")
        if moved.filter("was <> comp").isEmpty():
            return labels
