"""Connected groups of a graph given by links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import discard, staged


def lowest_linked(links: DataFrame, rounds: int = 50) -> DataFrame:
    """links: a, b (bigint). (id, root): the lowest id that links lead to, for every linked id. Each round takes the
    lowest root around and then the root of that root, so chains shorten by more than half. No links give
    no rows; links given twice or both ways, and of an id to itself, change nothing."""
    pairs = links.select("a", "b")
    edges = staged(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")).unionByName(pairs.select(F.col("a").alias("x"), F.col("b").alias("y"))).distinct(), "edges")
    held = labels = staged(edges.groupBy(F.col("x").alias("id")).agg(F.least(F.col("x"), F.min("y")).alias("root")), "labels")
    for _ in range(rounds):
        around = edges.join(labels.select(F.col("id").alias("y"), "root"), "y").groupBy(F.col("x").alias("id")).agg(F.min("root").alias("near"))
        lower = labels.join(around, "id").select("id", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("root").alias("far"))
        stepped = staged(lower.join(jump, "low", "left").select("id", "root", F.least("low", F.coalesce("far", "low")).alias("next")), "labels")
        settled = stepped.filter("root <> next").isEmpty()
        discard(held)
        held, labels = stepped, stepped.select("id", F.col("next").alias("root"))
        if settled:
            discard(edges)
            return labels
    raise RuntimeError("links did not settle")
