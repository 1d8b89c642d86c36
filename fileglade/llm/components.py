"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileglade.llm.common import materialised


def components(links: DataFrame) -> DataFrame:
    """The least id of each id's component, for all ids in ``links`` (a, b), which must be written.

    Each round takes the least label among neighbours, then the label of that label; labels are
    written to the shared folder, so a lost executor costs one round at most. Only a count of
    changes reaches the driver.
    """
    spark = links.sparkSession
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialised(both.filter("a <> b").distinct(), spark)
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
    labels = materialised(labels.withColumnRenamed("a", "id"), spark)
    while True:
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nearest = labels.join(seen, F.col("id") == F.col("a")).select(
            "id", "label", F.least("label", "near").alias("next")
        )
        jump = labels.select(F.col("id").alias("j"), F.col("label").alias("further"))
        moved = materialised(
            nearest.join(jump, F.col("next") == F.col("j")).select(
                "id", F.col("label").alias("before"), F.least("next", "further").alias("label")
            ),
            spark,
        )
        labels = moved.select("id", "label")
        if moved.filter("before <> label").limit(1).count() == 0:
            return labels
