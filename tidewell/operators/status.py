"""State over events and runs: forward-only status, ageing by missed runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold_status(events: DataFrame, edges: list[tuple[str, str]], start: str, key: str = "job_id", to: str = "to_status", at: str = "event_at", seq: str = "seq") -> DataFrame:
    """(key, status, n_accepted, n_refused): events of each key, folded in order of (at, seq) along a graph of
    allowed steps; a step the graph does not have is refused and changes nothing. Equal (at, seq, to) count
    once; null states are refused."""
    ordered = F.array_sort(F.collect_set(F.struct(F.col(at), F.col(seq), F.coalesce(F.col(to), F.lit("")).alias("to"))))
    steps = F.array(*(F.lit(f"{a}>{b}") for a, b in edges))
    zero = F.struct(F.lit(start).alias("status"), F.lit(0).alias("yes"), F.lit(0).alias("no"))

    def step(acc, e):
        ok = F.array_contains(steps, F.concat(acc["status"], F.lit(">"), e["to"]))
        return F.struct(F.when(ok, e["to"]).otherwise(acc["status"]).alias("status"), (acc["yes"] + ok.cast("int")).alias("yes"), (acc["no"] + (~ok).cast("int")).alias("no"))

    folded = events.groupBy(key).agg(F.aggregate(ordered, zero, step).alias("f"))
    return folded.select(key, "f.status", F.col("f.yes").alias("n_accepted"), F.col("f.no").alias("n_refused"))


def last_event(events: DataFrame, key: str = "job_id", at: str = "event_at", seq: str = "seq", columns: tuple[str, ...] = ("to_status",)) -> DataFrame:
    """The latest event of each key by (at, seq), ties by the columns themselves."""
    return events.groupBy(key).agg(F.max(F.struct(at, seq, *columns)).alias("e")).select(key, *(F.col(f"e.{c}").alias(c) for c in columns))


def missed_runs(runs: DataFrame, close_after: int = 3) -> DataFrame:
    """(id, source, missed_runs, closed): trailing runs of its source that did not see an id. runs: run_id,
    source, finished_at, seen_ids; a source's runs that finished at one instant are one. Failed or empty runs
    count as seeing nothing, null ids are left out. Works on ids with their last sighting, not on ids times
    runs."""
    turns = runs.groupBy("source", "finished_at").agg(F.max("run_id").alias("run_id")).withColumn("turn", F.row_number().over(Window.partitionBy("source").orderBy("finished_at")))
    last = turns.groupBy("source").agg(F.max("turn").alias("last"))
    seen = runs.select("source", "finished_at", F.explode("seen_ids").alias("id")).filter("id is not null").groupBy("source", "id").agg(F.max("finished_at").alias("finished_at"))
    missed = F.col("last") - F.col("turn")
    return (
        seen.join(turns.select("source", "finished_at", "turn"), ["source", "finished_at"]).join(last, "source")
        .select("id", "source", missed.cast("int").alias("missed_runs"), (missed >= close_after).alias("closed"))
    )


def miss_streaks(seen: DataFrame, key: str, at: str, hit: str) -> DataFrame:
    """Gaps and islands: adds `streak`, how many rows in a row up to this one had hit = false, for each key in
    order of `at`."""
    w = Window.partitionBy(key).orderBy(at)
    hits = F.sum(F.col(hit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    with_block = seen.withColumn("_block", hits)
    counted = F.sum((~F.col(hit)).cast("int")).over(Window.partitionBy(key, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    return with_block.withColumn("streak", counted.cast("int")).drop("_block")
