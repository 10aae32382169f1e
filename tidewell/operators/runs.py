"""Counters of runs, what a run may be expected to fetch, and the histories kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEARCH = ("source", "search_query", "search_location")


def run_counters(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*SEARCH).agg(
        F.count(F.lit(1)).alias("runs"), F.sum("fetched").alias("fetched"), F.sum("created").alias("created"), F.sum("errors").alias("errors"), F.count_if(~F.col("ok")).alias("failed")
    )


def expected_fetch(runs: DataFrame, last: int = 3) -> DataFrame:
    """Adds `expected`: mean fetch of the `last` runs of the same search before this one; null before there
    are as many."""
    w = Window.partitionBy(*SEARCH).orderBy("finished_at", "run_id").rowsBetween(-last, -1)
    return runs.withColumn("expected", F.when(F.count("fetched").over(w) == last, F.avg("fetched").over(w)))


def below_floor(runs: DataFrame, ratio: float = 0.2, last: int = 3) -> DataFrame:
    """Runs that fetched less than `ratio` of what was to be expected."""
    return expected_fetch(runs, last).filter(F.col("fetched") < F.col("expected") * ratio)


def latest_runs(runs: DataFrame, keep: int = 500) -> DataFrame:
    """The last `keep` runs by finish, ties by run_id: top-k, no full sort."""
    return runs.orderBy(F.col("finished_at").desc(), F.col("run_id").desc()).limit(keep)
