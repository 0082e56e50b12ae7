"""Versioned rows as valid-time intervals, and dense daily series of what is active."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: End of an interval that is still open.
OPEN_END = "2099-12-31"


def with_valid_to(df: DataFrame, key: str, version: str, valid_from: str, open_end: str = OPEN_END) -> DataFrame:
    """Adds valid_to: the date of the next higher version of the key, the same for all rows of a version.

    Versions run downwards, so the frame only grows and a key costs no more than its rows.
    """
    higher = Window.partitionBy(key).orderBy(F.col(version).desc()).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn("valid_to", F.coalesce(F.last(valid_from).over(higher), F.lit(open_end).cast("date")))


def drop_repeats(df: DataFrame, key: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keeps the first row of each run of rows of a key that agree in `values`; nulls agree."""
    by = Window.partitionBy(key).orderBy(*order)
    same = F.lit(True)
    for v in values:
        same &= F.lag(v).over(by).eqNullSafe(F.col(v))
    return df.withColumn("_same", same & (F.row_number().over(by) > 1)).where(~F.col("_same")).drop("_same")


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by an order that must be total for the result to be one."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def latest_before(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, rank: str, values: Sequence[str], left_id: Sequence[str]) -> DataFrame:
    """As-of join: for each left row the right row of highest `rank` whose time is not after the left one's.

    The left rows' distinct keys and times run with the right rows through one window by
    key, which carries the highest rank so far forward; then they meet the left rows by
    equality, which Spark can split where a key is hot. No row meets every version of its
    key. Left rows without a match drop out.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    of = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    row = F.struct(F.col(rank).alias("rank"), *(F.col(v).alias(v) for v in values))
    rows = right.select(*of, F.col(right_time).alias("_time"), row.alias("_row"))
    asked = left.select(*of, F.col(left_time).alias("_time")).distinct()
    both = rows.withColumn("_ask", F.lit(False)).unionByName(asked.withColumn("_ask", F.lit(True)), allowMissingColumns=True)
    # A struct is ordered by its first field; ranks are unique within a key.
    upto = Window.partitionBy(*names).orderBy("_time").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    known = both.withColumn("_best", F.max("_row").over(upto)).where("_ask and _best is not null").select(*names, "_time", "_best")
    asks = left.select(*left_id, *of, F.col(left_time).alias("_time"))
    return asks.join(known, [*names, "_time"]).select(*left_id, *(F.col(f"_best.{v}").alias(v) for v in values))


def steps(df: DataFrame, groups: Sequence[str], start: str, end: str, measure: str, open_end: str = OPEN_END) -> DataFrame:
    """Sums by group and day of +1 (and the measure) where a row starts and -1 where it ends: columns dt, n, m."""
    up = F.struct(F.col(start).alias("dt"), F.lit(1).alias("n"), F.col(measure).alias("m"))
    down = F.struct(F.col(end).alias("dt"), F.lit(-1).alias("n"), (-F.col(measure)).alias("m"))
    both = F.when(F.col(end) < F.lit(open_end).cast("date"), F.array(up, down)).otherwise(F.array(up))
    return df.select(*groups, F.inline(both)).groupBy(*groups, "dt").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def running(sums: DataFrame, groups: Sequence[str], last: DataFrame) -> DataFrame:
    """The daily series that steps add up to, each level held until the day before the next step, or to `last(last)`, one row."""
    by = Window.partitionBy(*groups).orderBy("dt")
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    levels = sums.select(*groups, "dt", F.sum("n").over(run).cast("long").alias("freq"), F.coalesce(F.sum("m").over(run), F.lit(0)).cast("long").alias("length"), F.lead("dt").over(by).alias("_next"))
    days = F.sequence("dt", F.coalesce(F.date_sub("_next", 1), F.col("last")), F.expr("interval 1 day"))
    return levels.crossJoin(F.broadcast(last)).select(*groups, F.explode(days).alias("dt"), "freq", "length")


def active_series(df: DataFrame, groups: Sequence[str], start: str, end: str, measure: str, open_end: str = OPEN_END) -> DataFrame:
    """Number and total measure of rows active on each day, by group, without gaps.

    Each row is a step up at its start and one down at its end; running sums of the
    steps of a day are the series. Series start with the group's first step and end with
    the last step of any group. Steps are summed by group and day before the window, so
    its partitions have a row a day however many versions there are; days without a step
    are only made at the end.
    """
    ended = F.max(F.when(F.col(end) < F.lit(open_end).cast("date"), F.col(end)))
    last = df.agg(F.greatest(F.max(start), ended).alias("last"))
    return running(steps(df, groups, start, end, measure, open_end), groups, last)


def still_open(df: DataFrame, groups: Sequence[str], end: str, measure: str, open_end: str = OPEN_END) -> DataFrame:
    """What the last day of active_series() must equal: rows without an end."""
    return df.where(F.col(end) >= F.lit(open_end).cast("date")).groupBy(*groups).agg(F.count("*").cast("long").alias("freq"), F.coalesce(F.sum(measure), F.lit(0)).cast("long").alias("length"))


def to_months(series: DataFrame, groups: Sequence[str], day: str, values: Sequence[str]) -> DataFrame:
    """The value on the last day of each month that the series has."""
    month = F.trunc(day, "MM").cast("date")
    last = F.max(F.struct(F.col(day).alias("d"), *(F.col(v) for v in values)))
    return series.groupBy(*groups, month.alias("month")).agg(last.alias("x")).select(*groups, "month", *(F.col(f"x.{v}").alias(v) for v in values))


def slopes(df: DataFrame, groups: Sequence[str], x: str, y: str) -> DataFrame:
    """Adds prev_x and dy, the rise of y from the row before; null on a group's first row."""
    by = Window.partitionBy(*groups).orderBy(x)
    return df.withColumn("prev_x", F.lag(x).over(by)).withColumn("dy", F.col(y) - F.lag(y).over(by))


def steepest(df: DataFrame, groups: Sequence[str], x: str, y: str) -> DataFrame:
    """Each group's largest rise, the first of equals, with the place before it."""
    s = slopes(df, groups, x, y).where("dy is not null")
    return best_row(s, groups, [F.col("dy").desc(), F.col(x).asc()]).select(*groups, F.col("prev_x").alias("jump_x"), F.col("dy").alias("jump_dy"))


def flat_runs(df: DataFrame, groups: Sequence[str], x: str, y: str) -> DataFrame:
    """Numbers the runs of rows whose rise is below, or not below, the group's mean rise."""
    all_ = Window.partitionBy(*groups)
    by = all_.orderBy(x)
    s = slopes(df, groups, x, y).where("dy is not null").withColumn("flatter", F.col("dy") < F.avg("dy").over(all_))
    change = F.coalesce((F.lag("flatter").over(by) != F.col("flatter")).cast("int"), F.lit(0))
    return s.withColumn("_change", change).withColumn("run", F.sum("_change").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_change")


def jumps(df: DataFrame, groups: Sequence[str], x: str, y: str, count: int) -> DataFrame:
    """The `count` steepest rises, each in another run of steep rows: columns nth, jump_x, jump_dy."""
    runs = flat_runs(df, groups, x, y).where("not flatter")
    peaks = best_row(runs, [*groups, "run"], [F.col("dy").desc(), F.col(x).asc()])
    nth = F.row_number().over(Window.partitionBy(*groups).orderBy(F.col("dy").desc(), F.col(x).asc()))
    return peaks.withColumn("nth", nth).where(F.col("nth") <= count).select(*groups, F.col("nth").cast("long").alias("nth"), F.col("prev_x").alias("jump_x"), F.col("dy").alias("jump_dy"))


def month_starts(df: DataFrame, groups: Sequence[str], day: str, least: int = 50) -> DataFrame:
    """Only first days of months, unless a group has fewer than `least` of them: then all its rows."""
    first = F.dayofmonth(day) == 1
    n = F.count_if(first).over(Window.partitionBy(*groups))
    return df.withColumn("_n", n).where(first | (F.col("_n") < least)).drop("_n")


def tail_mean(df: DataFrame, groups: Sequence[str], day: str, value: str, days: int = 14, overall: bool = False) -> DataFrame:
    """Per group the largest value, and the whole-number mean over the last `days` days of the group or, with `overall`, of the table."""
    last = F.max(day).over(Window.partitionBy(*groups))
    if overall:
        end = df.agg(F.max(day).alias("_last"))
        df = df.crossJoin(F.broadcast(end))  # one row
    else:
        df = df.withColumn("_last", last)
    recent = F.col(day) > F.date_sub(F.col("_last"), days)
    tail = F.floor(F.avg(F.when(recent, F.col(value)))).cast("long")
    return df.groupBy(*groups).agg(F.max(value).cast("long").alias("max_value"), tail.alias("tail_value")).withColumn("level", F.coalesce("tail_value", "max_value"))
