"""A hierarchical model of counts and shares by country, and scoring of grid cells with its draws.

Points have present and missing segments. Totals are Poisson and presence is binomial,
both on a standardised log density, with coefficients by country around a common mean:
log of the mean total and logit of the share are b1 + b2 x, and more by variant. Draws
are a table: draw, cid, and an array of coefficients for either part.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Standard deviations of normal stand-ins for the prior's wide tails.
PRIOR = 2.5
#: Metropolis steps for each draw.
MOVES = 2
VARIANTS = ("linear", "square", "top", "classes")


def design(variant: str, x: Column, top: Column | None = None, klass: Column | None = None) -> list[Column]:
    """Terms of the linear predictor; `classes` has one intercept for each of five classes."""
    one = F.lit(1.0)
    if variant == "linear":
        return [one, x]
    if variant == "square":
        return [one, x, x * x]
    if variant == "top":
        return [one, top.cast("double"), x]
    return [*((klass == k).cast("double") for k in range(1, 6)), x]


def predictor(coefficients: Column, terms: Sequence[Column]) -> Column:
    out = F.get(coefficients, F.lit(0)) * terms[0]
    for i, term in enumerate(terms[1:], 1):
        out = out + F.get(coefficients, F.lit(i)) * term
    return out


def draw_arrays(draws: DataFrame) -> DataFrame:
    """One row a country with its draws, in order, as arrays. Bounded: draws times coefficients."""
    return draws.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("draw", "total_b", "share_b"))).alias("d"))


def quantile(sorted_values: Column, q: float) -> Column:
    """A quantile of a sorted array, by linear interpolation."""
    at = (F.size(sorted_values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(sorted_values, low), F.get(sorted_values, F.least(low + 1, F.size(sorted_values) - 1))
    return a + (b - a) * (at - low)


def summary(values: Column, name: str) -> list[Column]:
    """Mean, 5th and 95th percentile of an array."""
    s = F.array_sort(values)
    return [(F.aggregate(values, F.lit(0.0), lambda t, v: t + v) / F.size(values)).alias(f"{name}_mean"), quantile(s, 0.05).alias(f"{name}_p5"), quantile(s, 0.95).alias(f"{name}_p95")]


def score_cells(cells: DataFrame, draws: DataFrame, variant: str = "square", x: str = "x", top: str = "top", klass: str = "klass") -> DataFrame:
    """Segments and share of each cell: mean and 5th and 95th percentile over the draws of its country; null for an unknown one.

    A cell meets its country's draws as one array, so rows do not multiply.
    """
    arrays = draw_arrays(draws)
    terms = design(variant, F.col(x), F.col(top) if top in cells.columns else None, F.col(klass) if klass in cells.columns else None)
    joined = cells.join(arrays, "cid", "left")
    totals = F.transform("d", lambda r: F.exp(predictor(r["total_b"], terms)))
    shares = F.transform("d", lambda r: 1 / (1 + F.exp(-predictor(r["share_b"], terms))))
    return joined.withColumn("_t", totals).withColumn("_s", shares).select(*cells.columns, *summary(F.col("_t"), "segments"), *summary(F.col("_s"), "share"))


def roll_up(scored: DataFrame, unit: str, total: int = -99) -> DataFrame:
    """Present segments over segments by unit and of all. The 5th (95th) percentile of a product is taken as the product of the 5th (95th) percentiles."""
    rows = scored
    for s in ("mean", "p5", "p95"):
        rows = rows.withColumn(f"present_{s}", F.col(f"segments_{s}") * F.col(f"share_{s}"))
    sums = [f"{n}_{s}" for n in ("segments", "present") for s in ("mean", "p5", "p95")]
    sets = rows.groupingSets([[F.col(unit)], []], F.col(unit)).agg(*(F.sum(c).alias(c) for c in sums), F.grouping(unit).alias("_all"))
    ratios = [F.try_divide(F.col(f"present_{s}"), F.col(f"segments_{s}")).alias(f"share_{s}") for s in ("mean", "p5", "p95")]
    return sets.select(F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(unit)).alias(unit), *sums, *ratios)


def totals_by_country(points: DataFrame, draws: DataFrame, variant: str = "square") -> DataFrame:
    """For each draw and country: predicted and actual share of present segments, by inverse weights, and their difference."""
    joined = points.join(draws, "cid")
    terms = design(variant, F.col("x"))
    mean = F.exp(predictor(F.col("total_b"), terms))
    share = 1 / (1 + F.exp(-predictor(F.col("share_b"), terms)))
    out = joined.select("draw", "cid", (F.col("present") / F.col("w")).alias("a"), (F.col("total") / F.col("w")).alias("b"), (mean * share / F.col("w")).alias("c"), (mean / F.col("w")).alias("d")).groupBy("draw", "cid").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c"), F.sum("d").alias("d"))
    return out.select("draw", "cid", F.try_divide("a", "b").alias("actual"), F.try_divide("c", "d").alias("predicted")).withColumn("error", F.col("predicted") - F.col("actual"))


def marginal_effects(draws: DataFrame, low: float, high: float, step: float = 0.2, variant: str = "square") -> DataFrame:
    """Share over a grid of x: mean and 5th and 95th percentile over all draws of all countries."""
    n = int(round((high - low) / step))
    grid = draws.select("draw", "cid", "share_b", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("place")).withColumn("x", F.lit(low) + F.col("place") * step)
    p = 1 / (1 + F.exp(-predictor(F.col("share_b"), design(variant, F.col("x")))))
    out = grid.groupBy("place").agg(F.avg(p).alias("mean"), F.percentile(p, F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    return out.select((F.lit(low) + F.col("place") * step).alias("x"), "mean", F.get("q", F.lit(0)).alias("p5"), F.get("q", F.lit(1)).alias("p95"))


def coefficient_table(draws: DataFrame) -> DataFrame:
    """Mean and 5th and 95th percentile of each coefficient of either part, over countries and draws."""
    long_ = draws.select(F.explode(F.array(F.struct(F.lit("total").alias("part"), F.col("total_b").alias("b")), F.struct(F.lit("share").alias("part"), F.col("share_b").alias("b")))).alias("m")).select("m.part", F.posexplode("m.b").alias("coefficient", "b"))
    out = long_.groupBy("part", "coefficient").agg(F.avg("b").alias("mean"), F.percentile("b", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    return out.select("part", "coefficient", "mean", F.get("q", F.lit(0)).alias("p5"), F.get("q", F.lit(1)).alias("p95"))


def chains_agree(draws: DataFrame, most: float = 1.1) -> DataFrame:
    """For `draws(chain, draw, part, coefficient, b)`, means over countries in each draw: the number of rows and draws, the potential scale reduction, and whether that is below `most`."""
    each = draws.groupBy("part", "coefficient", "chain", "draw").agg(F.avg("b").alias("b"), F.count("*").alias("rows"))
    chain = each.groupBy("part", "coefficient", "chain").agg(F.avg("b").alias("m"), F.var_samp("b").alias("v"), F.count("*").alias("n"), F.sum("rows").alias("rows"))
    out = chain.groupBy("part", "coefficient").agg(F.sum("rows").alias("n"), F.sum("n").alias("draws"), F.avg("n").alias("length"), F.var_samp("m").alias("between"), F.avg("v").alias("within"))
    scale = F.sqrt((F.col("length") - 1) / F.col("length") + F.col("between") / F.col("within"))
    return out.select("part", "coefficient", "n", "draws", scale.alias("scale"), (scale < most).alias("mixed"))


def _terms(variant: str, x: np.ndarray, top: np.ndarray, klass: np.ndarray) -> np.ndarray:
    one = np.ones_like(x)
    if variant == "linear":
        return np.stack([one, x], 1)
    if variant == "square":
        return np.stack([one, x, x * x], 1)
    if variant == "top":
        return np.stack([one, top, x], 1)
    return np.column_stack([*((klass == k).astype(float) for k in range(1, 6)), x])


def sample_chain(present: np.ndarray, total: np.ndarray, terms: np.ndarray, country: np.ndarray, countries: int, iterations: int, thin: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Draws of both parts' coefficients by country: random-walk Metropolis within Gibbs, all countries side by side.

    Countries are independent given the common mean and spread, so each has a step and an
    acceptance of its own; means and spreads have closed forms under normal and inverse
    gamma priors. Steps follow the curvature of a country's likelihood and prior, so
    coefficients that go together move together, and there are MOVES of them for each draw.
    Then all countries are moved and stretched together with their common mean and spread,
    one coefficient after the other: where points are few, the two would hold each other
    fast. The first half adapts the steps and is dropped.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    k = terms.shape[1]
    b = np.zeros((2, countries, k))
    b[0, :, 0] = np.log(max(total.mean(), 0.1))
    mean, spread = b.mean(1), np.ones((2, k))
    step = np.full((2, countries), 1.0)
    shift, stretch = np.full((2, k), 0.1), np.full((2, k), 0.3)
    shape = np.tile(0.1 * np.eye(k), (2, countries, 1, 1))
    squares = terms[:, :, None] * terms[:, None, :]

    def likelihood(part: int, c: np.ndarray) -> np.ndarray:
        eta = np.clip((terms * c[country]).sum(1), -20, 20)
        each = total * eta - np.exp(eta) if part == 0 else present * eta - total * np.logaddexp(0, eta)
        return np.bincount(country, each, countries)

    def curvature(part: int, c: np.ndarray) -> np.ndarray:
        """A factor of the covariance that the likelihood's curvature and the prior leave each country."""
        eta = np.clip((terms * c[country]).sum(1), -20, 20)
        weight = np.exp(eta) if part == 0 else total / (2 + 2 * np.cosh(eta))
        h = np.zeros((countries, k, k))
        np.add.at(h, country, weight[:, None, None] * squares)
        return np.linalg.cholesky(np.linalg.inv(h + np.diag(1 / spread[part] ** 2)))

    now = [likelihood(p, b[p]) for p in (0, 1)]
    out = []
    for it in range(iterations):
        for p in (0, 1):
            if it < iterations // 2 and it % 20 == 0:
                shape[p] = curvature(p, b[p])
            for _ in range(MOVES):
                new = b[p] + step[p][:, None] * (shape[p] @ rng.standard_normal((countries, k, 1)))[:, :, 0]
                then = likelihood(p, new)
                prior = (((b[p] - mean[p]) ** 2 - (new - mean[p]) ** 2) / (2 * spread[p] ** 2)).sum(1)
                taken = np.log(rng.random(countries)) < then - now[p] + prior
                b[p][taken], now[p][taken] = new[taken], then[taken]
                if it < iterations // 2:
                    step[p] *= np.exp((taken - 0.3) * 0.1)
                precision = countries / spread[p] ** 2 + 1 / PRIOR**2
                mean[p] = rng.normal(b[p].sum(0) / spread[p] ** 2 / precision, 1 / np.sqrt(precision))
                spread[p] = np.sqrt((0.5 + ((b[p] - mean[p]) ** 2).sum(0) / 2) / rng.gamma(1 + countries / 2, size=k))
            for j in range(k):
                for size, sort in ((shift, 0), (stretch, 1)):
                    by = size[p, j] * rng.standard_normal()
                    new, center, width = b[p].copy(), mean[p, j], spread[p, j]
                    if sort == 0:
                        center = center + by
                        new[:, j] += by
                        prior = (mean[p, j] ** 2 - center**2) / (2 * PRIOR**2)
                    else:
                        width = width * np.exp(by)
                        new[:, j] = center + (new[:, j] - center) * np.exp(by)
                        prior = -2 * by + 0.5 / spread[p, j] ** 2 - 0.5 / width**2
                    then = likelihood(p, new)
                    taken = np.log(rng.random()) < (then - now[p]).sum() + prior
                    if taken:
                        b[p], now[p], mean[p, j], spread[p, j] = new, then, center, width
                    if it < iterations // 2:
                        size[p, j] *= np.exp((taken - 0.4) * 0.1)
        if it >= iterations // 2 and it % thin == 0:
            out.append(b.copy())
    kept = np.stack(out)
    return kept[:, 0], kept[:, 1]


def sample_model(points: DataFrame, variant: str = "square", chains: int = 4, iterations: int = 400, thin: int = 5, seed: int = 5000, most_points: int = 200_000) -> DataFrame:
    """Draws from `points(cid 1..J, present, total, x[, top, klass])`: draw, cid, total_b, share_b.

    A chain is one task. It needs all points, which are a labelled sample and bounded by
    `most_points`; more is an error, not a cut.
    """
    spark = points.sparkSession
    names = [c for c in ("cid", "present", "total", "x", "top", "klass") if c in points.columns]
    rows = points.select(*names).limit(most_points + 1).toPandas()
    if len(rows) > most_points:
        raise ValueError(f"more than {most_points} labelled points")
    rows = rows.sort_values(names)
    x = rows["x"].to_numpy(float)
    zero = np.zeros_like(x)
    terms = _terms(variant, x, rows["top"].to_numpy(float) if "top" in rows else zero, rows["klass"].to_numpy(float) if "klass" in rows else zero)
    data = spark.sparkContext.broadcast((rows["present"].to_numpy(float), rows["total"].to_numpy(float), terms, rows["cid"].to_numpy(int) - 1, int(rows["cid"].max()) if len(rows) else 0))

    def run(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        present, total, t, country, j = data.value
        if not j:
            return pd.DataFrame(columns=["draw", "cid", "total_b", "share_b"], dtype=object)
        a, b = sample_chain(present, total, t, country, j, iterations, thin, seed + int(key[0]))
        n = len(a)
        return pd.DataFrame({"draw": np.repeat(np.arange(n) * chains + int(key[0]), j), "cid": np.tile(np.arange(1, j + 1), n), "total_b": list(a.reshape(n * j, -1)), "share_b": list(b.reshape(n * j, -1))})

    return spark.range(chains).repartition(chains, "id").groupBy("id").applyInPandas(run, "draw long, cid long, total_b array<double>, share_b array<double>")
