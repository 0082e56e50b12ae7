"""Roll-ups through overlapping hierarchies."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Label of the subtotal over all classes, and of the total over all units.
ALL_CLASSES = 99
TOTAL = -99


def drop_key(df: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sums again over what is not among `keys`."""
    return df.groupBy(*keys).agg(*(F.sum(s).cast("long").alias(s) for s in sums))


def by_region(df: DataFrame, membership: DataFrame, unit: str, region: str, keys: Sequence[str], klass: str, value: str, world: str = "WLD", totals: Sequence[str] = ("ALL",)) -> DataFrame:
    """Sums by region, class and keys, with a subtotal over classes.

    A unit may be in several regions; `world` is every unit. Rows that are totals already are left out.
    """
    units = df.where(~F.col(unit).isin(list(totals)))
    own = units.join(membership, unit).select(region, klass, *keys, value)
    rows = own.unionByName(units.select(F.lit(world).alias(region), klass, *keys, value))
    sets = rows.groupingSets([[F.col(c) for c in (region, *keys, klass)], [F.col(c) for c in (region, *keys)]], F.col(region), *(F.col(k) for k in keys), F.col(klass))
    # The subtotal is told from a class that is null by its grouping bit.
    out = sets.agg(F.sum(value).alias(value), F.grouping(klass).alias("_all"))
    return out.select(region, *keys, F.when(F.col("_all") == 1, F.lit(ALL_CLASSES)).otherwise(F.col(klass)).cast("int").alias(klass), value)


def with_total(df: DataFrame, key: str, sums: Sequence[str]) -> DataFrame:
    """Sums by key and a row of all, under the key TOTAL."""
    sets = df.groupingSets([[F.col(key)], []], F.col(key)).agg(*(F.sum(s).alias(s) for s in sums), F.grouping(key).alias("_all"))
    return sets.select(F.when(F.col("_all") == 1, F.lit(TOTAL)).otherwise(F.col(key)).alias(key), *sums)


def add_up(df: DataFrame, keys: Sequence[str], size: str, sizes_full: str) -> DataFrame:
    """Share that known sizes are of estimated full sizes, at most 1; rows without an estimate do not count."""
    known = F.when(F.col(sizes_full).isNotNull(), F.col(size))
    return df.groupBy(*keys).agg(F.least(F.lit(1.0), F.try_divide(F.sum(known), F.sum(sizes_full))).alias("share"))


def outer(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of several frames."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, list(keys), "full")
    return out


def strict_lookup(df: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Adds `value` from a table keyed by `key`; the query fails on a key the table lacks."""
    found = df.join(table.select(key, value, F.lit(True).alias("_hit")), key, "left")
    return found.where(F.assert_true(F.col("_hit").isNotNull(), F.concat(F.lit("no such key: "), F.col(key).cast("string"))).isNull()).drop("_hit")


def cumulative_cut(df: DataFrame, group: str, order: Sequence[Column], mass: str, share: float) -> DataFrame:
    """The rows of greatest order that hold at most a share of a group's mass; one row at least."""
    by = Window.partitionBy(group).orderBy(*order)
    total = F.sum(mass).over(Window.partitionBy(group))
    return df.withColumn("_cum", F.sum(mass).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_nth", F.row_number().over(by)).withColumn("_cut", total * share).where((F.col("_cum") <= F.col("_cut")) | (F.col("_nth") == 1)).drop("_cum", "_nth", "_cut")


def _kept(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed once, in the checkpoint folder; one of our own where a local master has none."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="growthlens-"))
    return df.checkpoint()


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds 1, 2, ... in an order that must be total.

    Rows are dealt out by ranges of the order, each range is numbered by itself, and the
    counts of the ranges, a row each, say where it starts. So no task sees all rows.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written down, as ranges are drawn anew by each run of a plan.
    dealt = _kept(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + nth).cast("long")).drop("_range", "_before")


def dense_key(df: DataFrame, key: str, name: str) -> DataFrame:
    """Adds 1..J in order of the distinct keys."""
    return df.join(numbered(df.select(key).distinct(), [F.col(key).asc()], name), key)


def pages(df: DataFrame, order: Sequence[Column], size: int) -> DataFrame:
    """Numbers rows of a report in pages; every row has one, the last page included."""
    return numbered(df, order, "nth").withColumn("page", F.floor((F.col("nth") - 1) / size).cast("long"))
