"""Points drawn with probability in proportion to size, and from the densest part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from growthlens.operators import rollup as R


#: Rows of a group that are put in order by one task.
BLOCK_ROWS = 1 << 20


def uniform(seed: int, *parts: str) -> Column:
    """A number in [0, 1) that hangs on its parts alone: the first 52 bits of a digest of their text, as any engine has it."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(p).cast("string") for p in parts))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / float(1 << 52)


def proportional(df: DataFrame, group: str, size: str, order: Sequence[str], n: int, draw: Column | None = None, seed: int = 11) -> DataFrame:
    """`n` draws a group, with replacement, in proportion to size, and n times the draw's probability.

    Sizes below 0 count as 0. Draw k of a group falls into the stretch of running sizes
    that holds u_k of their total. Rows run by `order` within blocks of about BLOCK_ROWS,
    dealt by a hash where a group has more. A draw first finds its block by the blocks'
    sums; then only blocks with draws are sorted, each by itself.
    """
    mass = F.greatest(F.coalesce(F.col(size).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = df.withColumn("_m", mass).where("_m > 0")
    blocks = rows.groupBy(group).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("_blocks"))
    rows = rows.join(blocks, group).withColumn("_block", F.pmod(F.xxhash64(*order), F.col("_blocks"))).drop("_blocks")
    every = Window.partitionBy(group)
    upto = every.orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(group, "_block").agg(F.sum("_m").alias("_s")).withColumn("_base", F.sum("_s").over(upto) - F.col("_s")).withColumn("_total", F.sum("_s").over(every)).withColumn("_end", F.lead("_base").over(every.orderBy("_block")))
    draws = sums.where("_base = 0").select(group, "_total", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw")).withColumn("_u", draw if draw is not None else uniform(seed, group, "draw")).select(group, "draw", (F.col("_u") * F.col("_total")).alias("_at"))
    # The last stretch is open, so that rounding loses no draw.
    found = draws.join(sums, group).where((F.col("_at") >= F.col("_base")) & (F.col("_end").isNull() | (F.col("_at") < F.col("_end")))).select(group, "_block", "draw", "_total", (F.col("_at") - F.col("_base")).alias("_at"))
    by = Window.partitionBy(group, "_block").orderBy(*order)
    hi = F.sum("_m").over(by.rowsBetween(Window.unboundedPreceding, 0))
    run = rows.join(found.select(group, "_block").distinct(), [group, "_block"], "left_semi").withColumn("_hi", hi).withColumn("_last", F.lead("_m").over(by).isNull())
    hit = run.join(found, [group, "_block"]).where((F.col("_at") >= F.col("_hi") - F.col("_m")) & (F.col("_last") | (F.col("_at") < F.col("_hi"))))
    return hit.withColumn("selection", F.col("_m") / F.col("_total") * n).drop("_m", "_hi", "_last", "_total", "_at", "_block")


def dense_part(df: DataFrame, group: str, density: str, mass: str, order: Sequence[str], share: float, n: int, seed: int = 13) -> DataFrame:
    """`n` uniform draws a group from the densest rows that hold `share` of its mass."""
    top = R.cumulative_cut(df, group, [F.col(density).desc(), *(F.col(c) for c in order)], mass, share)
    return proportional(top.withColumn("_one", F.lit(1.0)), group, "_one", order, n, seed=seed).drop("_one").withColumn("selection", F.lit(1 / (1 - share)) if share < 1 else F.lit(1.0))


def jittered(df: DataFrame, lon: str, lat: str, cell: float, *parts: str, seed: int = 29) -> DataFrame:
    """Points moved at random within their cell."""
    return df.withColumn(lon, F.col(lon) + (uniform(seed, *parts) - 0.5) * cell).withColumn(lat, F.col(lat) + (uniform(seed + 1, *parts) - 0.5) * cell)
