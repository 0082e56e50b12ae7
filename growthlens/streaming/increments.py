"""Keeps a daily series up to date from new intervals as they come.

A batch adds the steps of its intervals to a table of sums by group and day, under its
own number: a batch that runs again replaces itself. Running sums are taken when the
series is read, so late intervals need no state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from growthlens.operators.temporal import running, steps


def append_steps(stream: DataFrame, path: str, checkpoint: str, groups: Sequence[str], start: str, end: str, measure: str) -> StreamingQuery:
    """Starts a query that takes all there is and ends."""

    def write(batch: DataFrame, number: int) -> None:
        steps(batch, groups, start, end, measure).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def series(spark: SparkSession, path: str, groups: Sequence[str]) -> DataFrame:
    """The daily series of all batches so far: groups, dt, freq, length."""
    sums = spark.read.parquet(path).groupBy(*groups, "dt").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return running(sums, groups, sums.agg(F.max("dt").alias("last")))
