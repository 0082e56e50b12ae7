"""From versions to series by level, and the lookups that go with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from growthlens.operators import temporal as T


def usable(df: DataFrame, most: int | None = None, denied: Sequence[int] = (), length: str = "length", key: str = "way_id") -> DataFrame:
    """Visible versions of a plausible or unknown length. Goes after with_valid_to(): a deletion ends the version before it."""
    out = df.where("visible")
    if most is not None:
        out = out.where(F.col(length).isNull() | (F.col(length) < most))
    return out.where(~F.col(key).isin(list(denied))) if denied else out


def level_rows(intervals: DataFrame, level: int, way: str = "way_id", order: str = "part") -> DataFrame:
    """One row a version and unit of a level: -1 the world, 0 by id0, 1 by id0 and id1.

    Each level drops duplicates on its own keys, so levels cannot be rolled up from
    one another. Versions outside every unit count for the world alone.
    """
    units = {-1: [], 0: ["id0"], 1: ["id0", "id1"]}[level]
    rows = intervals.where("visible")
    for u in units:
        rows = rows.where(F.col(u).isNotNull())
    rows = T.best_row(rows, [way, "version", *units], [F.col(order).asc()])
    return rows.withColumn("id0", F.lit(-1)) if level < 0 else rows


def collapse(intervals: DataFrame, level: int, measure: str = "length", extra: Sequence[str] = ()) -> DataFrame:
    """Daily number and length of active versions by road flag and unit."""
    keys = ["road", "id0"] + (["id1"] if level == 1 else []) + list(extra)
    return T.active_series(level_rows(intervals, level), keys, "valid_from", "valid_to", measure)


def last_day_gaps(intervals: DataFrame, level: int) -> DataFrame:
    """Last values of the series less what is still open, in a full join; all zero if both are right."""
    keys = ["road", "id0"] + (["id1"] if level == 1 else [])
    rows = level_rows(intervals, level)
    series = T.active_series(rows, keys, "valid_from", "valid_to", "length")
    last = series.groupBy(*keys).agg(F.max(F.struct("dt", "freq", "length")).alias("x")).select(*keys, F.col("x.freq").alias("f1"), F.col("x.length").alias("l1"))
    open_ = T.still_open(rows, keys, "valid_to", "length").withColumnsRenamed({"freq": "f2", "length": "l2"})
    zero = F.lit(0)
    return last.join(open_, keys, "full").select(*keys, (F.coalesce("f1", zero) - F.coalesce("f2", zero)).cast("long").alias("freq_gap"), (F.coalesce("l1", zero) - F.coalesce("l2", zero)).cast("long").alias("length_gap"))


def range_join(df: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Rows with each range that holds their value, ends included.

    Ranges are spread over the bins of `width` they touch and values go to one bin, so
    this is an equality join and then a filter; the choice of width only moves cost.
    """
    bins = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    spread = ranges.withColumn("_bin", F.explode(bins))
    return df.withColumn("_bin", F.floor(F.col(value) / width)).join(spread, "_bin").where((F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high))).drop("_bin")


def in_order(files: DataFrame, low: str, high: str, tie: str) -> DataFrame:
    """Flags files that start before the file before them ends. One row a file, so one partition sorts them."""
    by = Window.orderBy(low, tie)
    return files.withColumn("in_order", F.coalesce(F.col(low) - F.lag(high).over(by) >= 0, F.lit(True)))


def calendar(df: DataFrame, groups: Sequence[str], day: str, overall_end: bool) -> DataFrame:
    spans = df.groupBy(*groups).agg(F.min(day).alias("_first"), F.max(day).alias("_last"))
    if overall_end:
        spans = spans.drop("_last").crossJoin(F.broadcast(df.agg(F.max(day).alias("_last"))))  # one row
    return spans.select(*groups, F.explode(F.sequence("_first", "_last", F.expr("interval 1 day"))).alias(day))


def missing_days(df: DataFrame, groups: Sequence[str], day: str) -> DataFrame:
    return calendar(df, groups, day, False).join(df.select(*groups, day).distinct(), [*groups, day], "left_anti")


def forward_fill(df: DataFrame, groups: Sequence[str], day: str, value: str) -> DataFrame:
    """A row a day from a group's first to the table's last, with the latest known value."""
    run = Window.partitionBy(*groups).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    filled = calendar(df, groups, day, True).join(df.select(*groups, day, value), [*groups, day], "left")
    return filled.withColumn(value, F.last(value, ignorenulls=True).over(run))
