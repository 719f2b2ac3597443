"""Tables that a stream carries from batch to batch, in two slots.

Batch ``n`` writes slot ``n % 2`` and reads the other one, so two versions exist
however long the stream runs, and a batch that is repeated after a failure finds
what its predecessor left. A version counts once its mark, written last, names
the batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from duskwatch.plans.selection import among_first, before, bound_at
from duskwatch.session import new_folder

Step = Callable[[DataFrame | None, DataFrame], DataFrame]
_MARK = "slot int, batch bigint"


def _marks(spark: SparkSession, folder: str) -> list[tuple[int, int]]:
    """``(batch, slot)`` of the complete versions, oldest first."""
    for slot in (0, 1):
        spark.createDataFrame([], _MARK).write.mode("ignore").parquet(f"{folder}/mark-{slot}")
    rows = spark.read.schema(_MARK).parquet(f"{folder}/mark-0", f"{folder}/mark-1").collect()
    return sorted((r["batch"], r["slot"]) for r in rows)


def latest(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest complete version of a table kept by a stream."""
    marks = _marks(spark, folder)
    return spark.read.parquet(f"{folder}/slot-{marks[-1][1]}") if marks else None


def before_batch(spark: SparkSession, folder: str, number: int) -> DataFrame | None:
    """The newest complete version that batch ``number`` builds on."""
    earlier = [slot for n, slot in _marks(spark, folder) if n < number]
    return spark.read.parquet(f"{folder}/slot-{earlier[-1]}") if earlier else None


def advance(folder: str, step: Step) -> Callable[[DataFrame, int], None]:
    """A batch function that merges each batch into the next version."""

    def merge(batch: DataFrame, number: int) -> None:
        spark, slot = batch.sparkSession, number % 2
        earlier = [s for n, s in _marks(spark, folder) if n < number]
        state = spark.read.parquet(f"{folder}/slot-{earlier[-1]}") if earlier else None
        if earlier and earlier[-1] == slot:  # the batch in between left nothing
            state = _copied(state, folder)
        spark.createDataFrame([], _MARK).write.mode("overwrite").parquet(f"{folder}/mark-{slot}")
        step(state, batch).write.mode("overwrite").parquet(f"{folder}/slot-{slot}")
        mark = spark.createDataFrame([(slot, number)], _MARK).coalesce(1)
        mark.write.mode("overwrite").parquet(f"{folder}/mark-{slot}")

    return merge


def _copied(state: DataFrame, folder: str) -> DataFrame:
    """A version aside, where the slot it lies in is the one to be written."""
    state.write.mode("overwrite").parquet(f"{folder}/aside")
    return state.sparkSession.read.parquet(f"{folder}/aside")


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> StreamingQuery:
    """Hand what is there to ``each`` batch by batch, and stop."""
    checkpoint = checkpoint or new_folder(stream.sparkSession, "stream-state")
    started = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return started


def newest(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The last ``limit`` rows in ``order``: a bound is found by counting, then one filter.

    Rows equal in all of ``order`` are interchangeable.
    """
    total = rows.count()
    if total <= limit:
        return rows
    start, ahead = bound_at(rows, order, total - limit)
    kept = rows.filter(~before(rows, order, start))
    if not ahead:
        return kept
    equal = among_first(rows, order, start)
    spare = kept.filter(equal)
    return kept.filter(~equal).unionByName(spare.limit(spare.count() - ahead))
