"""Registry of queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    """Registers a function of (tables) under its name, with its SQL where SQL can say it."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


class Tables:
    """The tables of a directory, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def versions(t: Tables) -> DataFrame:
    """`events` as versions of ways: one row a version and area; a third of the versions lie in two parts."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    v = t.events.select(
        F.col("user_id").alias("way_id"), nth.cast("long").alias("version"), F.col("ts").cast("date").alias("valid_from"),
        (F.col("event_type") != "error").alias("visible"), F.col("event_type").isin("purchase", "view").alias("road"),
        F.rint(F.col("value") * 10).cast("long").alias("length"), "event_id",
        F.when(F.col("user_id") % 11 != 0, F.col("user_id") % 7).alias("id0"), F.when(F.col("user_id") % 11 != 0, F.col("user_id") % 5).alias("id1"),
    )
    return v.withColumn("part", F.explode(F.when(F.col("event_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))


#: The same in SQL, as the head of a WITH clause.
VERSIONS = """v0 AS (
  SELECT user_id AS way_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, CAST(ts AS DATE) AS valid_from,
         event_type <> 'error' AS visible, event_type IN ('purchase', 'view') AS road, CAST(round_even(value * 10, 0) AS BIGINT) AS length, event_id,
         CASE WHEN user_id % 11 <> 0 THEN user_id % 7 END AS id0, CASE WHEN user_id % 11 <> 0 THEN user_id % 5 END AS id1
  FROM events),
v AS (SELECT *, 0 AS part FROM v0 UNION ALL SELECT *, 1 AS part FROM v0 WHERE event_id % 3 = 0),
iv AS (SELECT *, coalesce(first_value(valid_from) OVER (PARTITION BY way_id ORDER BY version RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), DATE '2099-12-31') AS valid_to FROM v)"""
