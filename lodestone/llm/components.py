"""Connected components with DataFrames: least labels of neighbours and pointer jumping, in written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def components(links: DataFrame) -> DataFrame:
    """Rows (node, comp) for each node of the undirected ``links`` (a, b): comp is the least node reachable.

    Each round takes the least label among the neighbours and then the label of the label, so a chain of n
    nodes needs about log n rounds. Rounds are written tables; a lost executor costs no earlier round.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct(), "links")
    labels = written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        least = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("to"))
        up = labels.select(F.col("node").alias("to"), F.col("comp").alias("top"))
        after = written(least.join(up, "to", "left").select("node", "was", F.least("to", "top").alias("comp")), "labels")
        moved = after.where("was <> comp").limit(1).count()
        labels = after.select("node", "comp")
        if not moved:
            return labels
