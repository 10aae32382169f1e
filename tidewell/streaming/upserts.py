"""The state operators over streams: micro-batches fold into the same state as one batch would."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.sources.files import VersionedTable


def stream_into(stream: DataFrame, state: VersionedTable, fold: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Fold each micro-batch into the next version of a state table. A batch that is played again after a
    loss finds its number in the state and changes nothing. state has a column batch_id."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        before = state.read()
        done = before.agg(F.max("batch_id")).first()[0]
        if done is None or done < batch_id:
            state.write(fold(before.drop("batch_id"), batch).withColumn("batch_id", F.lit(batch_id).cast("long")).select(*before.columns))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_sightings(stream: DataFrame, key: str, at: str, late: str = "10 days") -> DataFrame:
    """Each key once while it keeps coming within `late`; rows later than that are dropped and state is freed."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def fresh_only(stream: DataFrame, posted: str, arrived: str, most_days: float) -> DataFrame:
    """Rows not older at arrival than most_days; rows of unknown age stay."""
    age = (F.unix_micros(arrived) - F.unix_micros(posted)) / F.lit(86_400_000_000.0)
    return stream.filter(age.isNull() | (age <= most_days))
