"""Weighted estimates from stratified samples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_share(present: str, missing: str, weight: str | None = None) -> Column:
    """Aggregate: weighted share of what is present."""
    w = F.col(weight) if weight else F.lit(1.0)
    return F.try_divide(F.sum(F.col(present) * w), F.sum((F.col(present) + F.col(missing)) * w))


def weighted_mean(value: str, weight: str, where: Column | None = None) -> Column:
    """Aggregate: weighted mean of rows that have both."""
    mask = F.col(value).isNotNull() & F.col(weight).isNotNull()
    mask = mask & where if where is not None else mask
    return F.try_divide(F.sum(F.when(mask, F.col(value) * F.col(weight))), F.sum(F.when(mask, F.col(weight))))


def standardized(df: DataFrame, value: str, take_log: bool = False, reference: DataFrame | None = None) -> Column | DataFrame:
    """Adds z-scores with the sample deviation; by the moments of a reference frame if one is given."""
    x = F.ln(value) if take_log else F.col(value)
    moments = (df if reference is None else reference).agg(F.avg(x).alias("_mean"), F.stddev_samp(x).alias("_std"))
    return df.crossJoin(F.broadcast(moments)).withColumn(f"{value}_z", F.try_divide(x - F.col("_mean"), F.col("_std"))).drop("_mean", "_std")


def complete_cases(df: DataFrame, dimension: DataFrame, key: str, needed: Sequence[str]) -> DataFrame:
    """Rows whose key has all covariates."""
    return df.join(dimension.na.drop(subset=list(needed)).select(key, *needed), key)


def model_errors(df: DataFrame, estimate: str, truth: str, model: str) -> DataFrame:
    """Mean error and mean squared error by model, least mean error first by rank."""
    e = F.col(estimate) - F.col(truth)
    out = df.where(e.isNotNull()).groupBy(model).agg(F.avg(e).alias("mean_error"), F.avg(e * e).alias("mse"))
    return out.withColumn("place", F.row_number().over(Window.orderBy("mean_error", model)).cast("long"))


def bootstrap_share(df: DataFrame, group: str, stratum: str, present: str, missing: str, weight: str, order: Sequence[str], replicates: int = 1000, seed: int = 17, block: int = 512) -> DataFrame:
    """Mean, deviation (population) and 5th and 95th percentile of the weighted share over resamples within strata.

    A resample draws as many rows of a stratum as it has, with replacement and with
    chances in proportion to 1 / weight. Rows are dealt to blocks of about `block`. The
    number of draws goes down a binary tree over a stratum's blocks: at each node a
    binomial draw, which all blocks below repeat alike, splits it by the chances of the
    two halves. A block then draws its rows, and a replicate's totals are sums over
    blocks; so a stratum of any size is spread over tasks, and only sums of replicates are
    shuffled. Draws depend on seed, group, stratum and place in the tree alone. Rows
    without a weight above 0 are left out.
    """
    keys = [group, stratum, "_block"]
    keyed = df.where(F.col(weight) > 0).select(group, stratum, *(F.col(c).cast("double").alias(c) for c in (present, missing, weight)), F.xxhash64(*order).alias("_o"))
    # Sums of decimals do not hang on their order, so the two halves of a split see one chance.
    keyed = keyed.withColumn("_p", (1 / F.col(weight)).cast("decimal(38,18)"))
    sizes = keyed.groupBy(group, stratum).agg(F.count("*").alias("_n"), F.ceil(F.count("*") / block).cast("long").alias("_blocks")).withColumn("_depth", F.ceil(F.log2("_blocks")).cast("int"))
    dealt = keyed.join(sizes.select(group, stratum, "_blocks"), [group, stratum]).withColumn("_block", F.pmod("_o", F.col("_blocks"))).drop("_blocks")
    blocks = dealt.groupBy(*keys).agg(F.sum("_p").alias("_p")).join(sizes, [group, stratum])
    # A row for each node above a block: its place, and the side that leads to the block.
    levels = F.filter(F.sequence(F.lit(0), F.col("_depth")), lambda d: d < F.col("_depth"))
    above = blocks.select(*keys, "_p", "_depth", F.explode(levels).alias("_d")).withColumn("_node", F.expr("shiftright(_block, _depth - _d)")).withColumn("_right", F.expr("shiftright(_block, _depth - _d - 1) & 1"))
    nodes = above.groupBy(group, stratum, "_d", "_node").agg((F.coalesce(F.sum(F.when(F.col("_right") == 0, F.col("_p"))), F.lit(0)) / F.sum("_p")).cast("double").alias("_left"))
    paths = above.join(nodes, [group, stratum, "_d", "_node"]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_d", "_node", "_right", "_left"))).alias("_path"))
    plan = blocks.join(paths, keys, "left").select(F.col(group).alias("_g"), F.col(stratum).alias("_s"), F.col("_block").alias("_b"), "_n", "_path")

    def draw(key: tuple, rows: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        def generator(*place: int) -> np.random.Generator:
            return np.random.Generator(np.random.PCG64([seed, *(int.from_bytes(str(k).encode()[:32], "little") for k in key[:2]), *place]))

        total = np.full(replicates, plan["_n"].iloc[0])
        for step in plan["_path"].iloc[0] if plan["_path"].iloc[0] is not None else ():
            left = generator(int(step["_d"]), int(step["_node"])).binomial(total, min(1.0, float(step["_left"])))
            total = total - left if step["_right"] else left
        rows = rows.sort_values(["_o", present, missing, weight])
        chance = 1 / rows[weight].to_numpy()
        counts = generator(1 << 20, int(key[2])).multinomial(total, chance / chance.sum())
        top = (rows[present] * rows[weight]).to_numpy()
        all_ = ((rows[present] + rows[missing]) * rows[weight]).to_numpy()
        return pd.DataFrame({group: key[0], "rep": np.arange(replicates), "top": counts @ top, "all": counts @ all_})

    kind = df.schema[group].dataType.simpleString()
    sums = dealt.groupBy(*keys).cogroup(plan.groupBy("_g", "_s", "_b")).applyInPandas(draw, f"{group} {kind}, rep long, top double, all double")
    shares = sums.groupBy(group, "rep").agg((F.sum("top") / F.sum("all")).alias("x"))
    edges = F.percentile("x", F.array(F.lit(0.05), F.lit(0.95)))
    return shares.groupBy(group).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), edges.alias("_p")).select(group, "mean", "std", F.get("_p", F.lit(0)).alias("p5"), F.get("_p", F.lit(1)).alias("p95"))
