"""Connected components of links between documents, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postscreen.session import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node that it reaches) of every node of ``edges``.

    Each round, every node takes the smallest node among itself and its neighbours, and then what that one
    took; links are then drawn between what their ends took, and those within one node go. So
    the links shrink from round to round, and a star is done in one. All tables are written to
    the shared folder, and only counts come to the driver.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    links = materialise(links, "links")
    total = None
    while True:
        both = links.union(links.select("b", "a")).toDF("node", "other")
        took = both.groupBy("node").agg(F.least("node", F.min("other")).alias("took"))
        took = materialise(took, "took")
        beyond = took.select(F.col("node").alias("took"), F.col("took").alias("beyond"))
        took = took.join(beyond, "took").select("node", F.col("beyond").alias("took"))
        took = materialise(took, "took")
        if total is None:
            total = took
        else:
            onward = took.select(F.col("node").alias("took"), F.col("took").alias("onward"))
            total = total.join(onward, "took", "left").select(
                "node", F.coalesce("onward", "took").alias("took")
            )
            total = materialise(total, "took")
        links = (
            links.join(took.toDF("a", "x"), "a").join(took.toDF("b", "y"), "b")
            .filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        links = materialise(links, "links")
        if links.isEmpty():
            return total.withColumnRenamed("took", "component")
