"""Queries on sampling, hierarchical draws and scored cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.operators import hierarchical as H
from growthlens.operators import sampling as L
from growthlens.plans.base import Tables, query
from growthlens.plans.spatial import _PT, located

_DRAWS = """d AS (SELECT i AS draw, c + 1 AS cid, 1.5 + (i * 7 % 50) / 100.0 + c / 50.0 AS t1, 0.3 - (i * 3 % 50) / 200.0 AS t2, -0.05 - (i % 10) / 400.0 AS t3, 0.2 + (i * 11 % 50) / 80.0 - c / 40.0 AS s1, 0.4 + (i * 13 % 50) / 150.0 AS s2, -0.1 + (i % 7) / 100.0 AS s3 FROM range(0, 50) a(i), range(0, 25) b(c))"""
_CELLS = "x AS (SELECT c_custkey, c_nationkey AS id0, c_nationkey + 1 AS cid, (c_acctbal - 4500) / 3000 AS x FROM customer)"


def draws(t: Tables) -> DataFrame:
    i, c = F.col("draw"), F.col("c")
    d = t.spark.range(1250).select(F.floor(F.col("id") / 25).alias("draw"), (F.col("id") % 25).alias("c"))
    total = F.array(F.lit(1.5) + (i * 7 % 50) / F.lit(100.0) + c / F.lit(50.0), F.lit(0.3) - (i * 3 % 50) / F.lit(200.0), F.lit(-0.05) - (i % 10) / F.lit(400.0))
    share = F.array(F.lit(0.2) + (i * 11 % 50) / F.lit(80.0) - c / F.lit(40.0), F.lit(0.4) + (i * 13 % 50) / F.lit(150.0), F.lit(-0.1) + (i % 7) / F.lit(100.0))
    return d.select("draw", (c + 1).alias("cid"), total.alias("total_b"), share.alias("share_b"))


def cells(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.col("c_nationkey").alias("id0"), (F.col("c_nationkey") + 1).cast("long").alias("cid"), ((F.col("c_acctbal") - 4500) / 3000).alias("x"))


_SCORED = f"""WITH {_DRAWS}, {_CELLS}, v AS (SELECT c_custkey, id0, exp(t1 + t2 * x + t3 * (x * x)) AS seg, 1 / (1 + exp(-(s1 + s2 * x + s3 * (x * x)))) AS fc FROM x JOIN d USING (cid)),
sc AS (SELECT c_custkey, id0, avg(seg) AS m1, quantile_cont(seg, 0.05) AS a1, quantile_cont(seg, 0.95) AS b1, avg(fc) AS m2, quantile_cont(fc, 0.05) AS a2, quantile_cont(fc, 0.95) AS b2 FROM v GROUP BY 1, 2)"""


def _variant_sql(name: str, eta: str) -> str:
    return f"SELECT '{name}' AS variant, cid, round(avg(1 / (1 + exp(-({eta})))), 6) AS share, CAST(count(DISTINCT c_custkey) AS BIGINT) AS n FROM y JOIN d USING (cid) GROUP BY cid"


@query(f"""WITH {_DRAWS}, {_CELLS}, y AS (SELECT *, CAST(x >= 1 AS DOUBLE) AS top, CAST((x >= -1)::INT + (x >= -0.5)::INT + (x >= 0.25)::INT + (x >= 1)::INT + 1 AS INT) AS klass FROM x)
{_variant_sql("linear", "s1 + s2 * x")} UNION ALL {_variant_sql("square", "s1 + s2 * x + s3 * (x * x)")} UNION ALL {_variant_sql("top", "s1 + s2 * top + s3 * x")}
UNION ALL {_variant_sql("classes", "CASE klass WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN s3 WHEN 4 THEN s1 ELSE s2 END + s3 * x")}""")
def scored_variants(t: Tables) -> DataFrame:
    """M16a, M16b, M16c, M16d, E9, E10: the four linear predictors of the model, scored with the same draws."""
    from growthlens.functions import binning as B

    c = cells(t).withColumn("top", (F.col("x") >= 1).cast("int")).withColumn("klass", B.digitize("x", [-1, -0.5, 0.25, 1]) + 1)
    b = F.col("share_b")
    six = F.array(*(F.get(b, F.lit(i)) for i in (0, 1, 2, 0, 1, 2)))
    out = []
    for v in H.VARIANTS:
        d = draws(t) if v != "classes" else draws(t).withColumn("share_b", six).withColumn("total_b", six)
        s = H.score_cells(c, d, v).groupBy("cid").agg(F.round(F.avg("share_mean"), 6).alias("share"), F.count("*").alias("n"))
        out.append(s.select(F.lit(v).alias("variant"), "cid", "share", "n"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(f"{_SCORED} SELECT c_custkey, round(m1, 6) AS segments_mean, round(a1, 6) AS segments_p5, round(b1, 6) AS segments_p95, round(m2, 6) AS share_mean, round(a2, 6) AS share_p5, round(b2, 6) AS share_p95 FROM sc")
def scored_cells(t: Tables) -> DataFrame:
    """All draws of a cell's country, summed up."""
    s = H.score_cells(cells(t), draws(t))
    return s.select("c_custkey", *(F.round(f"{n}_{q}", 6).alias(f"{n}_{q}") for n in ("segments", "share") for q in ("mean", "p5", "p95")))


@query(f"""{_SCORED}, g AS (SELECT CASE WHEN grouping(id0) = 1 THEN -99 ELSE id0 END AS id0, sum(m1) AS sm, sum(a1) AS s5, sum(b1) AS s95, sum(m1 * m2) AS pm, sum(a1 * a2) AS p5, sum(b1 * b2) AS p95 FROM sc GROUP BY GROUPING SETS ((id0), ()))
SELECT id0, round(sm, 4) AS segments_mean, round(pm, 4) AS present_mean, round(pm / sm, 6) AS share_mean, round(p5 / s5, 6) AS share_p5, round(p95 / s95, 6) AS share_p95 FROM g""")
def rolled_up_cells(t: Tables) -> DataFrame:
    """By country and for all."""
    r = H.roll_up(H.score_cells(cells(t), draws(t)), "id0")
    return r.select("id0", F.round("segments_mean", 4).alias("segments_mean"), F.round("present_mean", 4).alias("present_mean"), *(F.round(f"share_{q}", 6).alias(f"share_{q}") for q in ("mean", "p5", "p95")))


@query(f"""WITH {_DRAWS}, {_CELLS}, p AS (SELECT cid, x, CAST(c_custkey % 9 AS DOUBLE) AS present, CAST(c_custkey % 9 + c_custkey % 4 AS DOUBLE) AS total, 1.0 + c_custkey % 3 AS w FROM x),
q AS (SELECT draw, cid, sum(present / w) / sum(total / w) AS actual, sum(exp(t1 + t2 * x + t3 * (x * x)) / (1 + exp(-(s1 + s2 * x + s3 * (x * x)))) / w) / sum(exp(t1 + t2 * x + t3 * (x * x)) / w) AS predicted FROM p JOIN d USING (cid) GROUP BY 1, 2)
SELECT draw, cid, round(actual, 8) AS actual, round(predicted, 6) AS predicted, round(predicted - actual, 6) AS error FROM q""")
def totals_by_draw(t: Tables) -> DataFrame:
    """Predicted against actual shares within the model."""
    k = F.col("c_custkey")
    p = cells(t).select("cid", "x", (k % 9).cast("double").alias("present"), (k % 9 + k % 4).cast("double").alias("total"), (F.lit(1.0) + k % 3).alias("w"))
    out = H.totals_by_country(p, draws(t))
    return out.select("draw", "cid", F.round("actual", 8).alias("actual"), F.round("predicted", 6).alias("predicted"), F.round("error", 6).alias("error"))


@query(f"""WITH {_DRAWS}, g AS (SELECT k, -2.0 + k * 0.2 AS x FROM range(0, 21) t(k)), p AS (SELECT k, x, 1 / (1 + exp(-(s1 + s2 * x + s3 * (x * x)))) AS p FROM g, d) SELECT CAST(round(x, 6) AS DOUBLE) AS x, round(avg(p), 6) AS mean, round(quantile_cont(p, 0.05), 6) AS p5, round(quantile_cont(p, 0.95), 6) AS p95 FROM p GROUP BY k, x""")
def marginal_effects(t: Tables) -> DataFrame:
    """M19."""
    return H.marginal_effects(draws(t), -2.0, 2.0).select(*(F.round(c, 6).alias(c) for c in ("x", "mean", "p5", "p95")))


@query(f"""WITH {_DRAWS}, u AS (UNPIVOT d ON t1, t2, t3, s1, s2, s3 INTO NAME n VALUE b)
SELECT CASE WHEN n LIKE 't%' THEN 'total' ELSE 'share' END AS part, CAST(n[2] AS INT) - 1 AS coefficient, round(avg(b), 8) AS mean, round(quantile_cont(b, 0.05), 8) AS p5, round(quantile_cont(b, 0.95), 8) AS p95 FROM u GROUP BY 1, 2""")
def coefficient_table(t: Tables) -> DataFrame:
    """M20."""
    return H.coefficient_table(draws(t)).select("part", "coefficient", *(F.round(c, 8).alias(c) for c in ("mean", "p5", "p95")))


@query()
def sampled_model(t: Tables) -> DataFrame:
    """Draws by chain; rows only."""
    k = F.col("s_suppkey")
    p = t.supplier.select((F.col("s_nationkey") + 1).cast("long").alias("cid"), (k % 7).cast("double").alias("present"), (k % 7 + k % 3).cast("double").alias("total"), (F.col("s_acctbal") / 5000 - 1).alias("x"))
    return H.sample_model(p, chains=10, iterations=1000)


@query("""WITH r AS (SELECT c_nationkey AS g, c_custkey, CAST(c_custkey % 10 AS DOUBLE) AS m FROM customer WHERE c_custkey % 10 > 0), s AS (SELECT *, sum(m) OVER (PARTITION BY g ORDER BY c_custkey) AS hi, sum(m) OVER (PARTITION BY g) AS total FROM r),
d AS (SELECT g, k, (k + 0.5) / 25.0 * max(total) AS at_ FROM s, range(0, 25) t(k) GROUP BY g, k) SELECT s.g, CAST(d.k AS INT) AS draw, s.c_custkey, round(m / total * 25, 8) AS selection FROM s JOIN d ON s.g = d.g AND at_ >= hi - m AND at_ < hi""")
def points_by_size(t: Tables) -> DataFrame:
    """Draws in proportion to size, here at even steps."""
    r = t.customer.select(F.col("c_nationkey").alias("g"), "c_custkey", (F.col("c_custkey") % 10).alias("m"))
    out = L.proportional(r, "g", "m", ["c_custkey"], 25, draw=(F.col("draw") + 0.5) / F.lit(25.0))
    return out.select("g", "draw", "c_custkey", F.round("selection", 8).alias("selection"))


def _uniform(seed: int, *parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(parts)})), 1, 13) AS BIGINT) / {float(1 << 52)}"


_DENSE = """p AS (SELECT *, greatest(ln(density), 0.0) AS m FROM (SELECT *, exp(c_acctbal / 2000) AS density, CAST(c_custkey % 7 + 1 AS DOUBLE) AS mass FROM c)),
r AS (SELECT *, sum(m) OVER (PARTITION BY g ORDER BY c_custkey) AS hi, sum(m) OVER (PARTITION BY g) AS total FROM p WHERE m > 0),
e AS (SELECT g, c_custkey, lon, lat, row_number() OVER (PARTITION BY g ORDER BY c_custkey) AS hi, count(*) OVER (PARTITION BY g) AS total FROM
  (SELECT *, sum(mass) OVER w AS cum, row_number() OVER w AS nth, sum(mass) OVER (PARTITION BY g) AS whole FROM p WINDOW w AS (PARTITION BY g ORDER BY density DESC, c_custkey)) WHERE cum <= whole * 0.2 OR nth = 1)"""


@query(f"""WITH c AS (SELECT c_custkey, c_nationkey AS g, c_acctbal, {_PT} FROM customer), {_DENSE},
d AS (SELECT g, k, max(total) * {_uniform(11, 'g', 'k')} AS u FROM r, range(0, 25) t(k) GROUP BY g, k), f AS (SELECT g, k, max(total) * {_uniform(13, 'g', 'k')} AS u FROM e, range(0, 20) t(k) GROUP BY g, k),
b AS (SELECT r.g, 'popWeighted' AS stratum, k, c_custkey, lon, lat, m / total * 25 AS selection FROM r JOIN d ON r.g = d.g AND u >= hi - m AND u < hi UNION ALL SELECT e.g, 'highDensity', k, c_custkey, lon, lat, 1.25 FROM e JOIN f ON e.g = f.g AND u >= hi - 1 AND u < hi)
SELECT g AS c_nationkey, stratum, CAST(k AS INT) AS draw, c_custkey, round(lon + ({_uniform(29, 'c_custkey', 'k', 'stratum')} - 0.5) / 120, 8) AS lon, round(lat + ({_uniform(30, 'c_custkey', 'k', 'stratum')} - 0.5) / 120, 8) AS lat, round(selection, 8) AS selection FROM b""")
def sampled_points(t: Tables) -> DataFrame:
    """Both strata, moved within their cells."""
    c = located(t).join(t.customer.select("c_custkey", "c_acctbal"), "c_custkey").withColumn("density", F.exp(F.col("c_acctbal") / 2000)).withColumn("size", F.greatest(F.ln("density"), F.lit(0.0))).withColumn("mass", (F.col("c_custkey") % 7 + 1).cast("double"))
    wide = L.proportional(c, "c_nationkey", "size", ["c_custkey"], 25).withColumn("stratum", F.lit("popWeighted"))
    dense = L.dense_part(c, "c_nationkey", "density", "mass", ["c_custkey"], 0.2, 20).withColumn("stratum", F.lit("highDensity"))
    both = wide.unionByName(dense)
    out = L.jittered(both, "lon", "lat", 1 / 120, "c_custkey", "draw", "stratum")
    return out.select("c_nationkey", "stratum", "draw", "c_custkey", *(F.round(x, 8).alias(x) for x in ("lon", "lat", "selection")))


@query("""WITH RECURSIVE c AS (SELECT DISTINCT s_nationkey + 1 AS cid FROM supplier), p AS (SELECT part, coefficient FROM (VALUES ('total'), ('share')) a(part), range(0, 3) b(coefficient)), j AS (SELECT max(cid) AS j FROM c)
SELECT part, CAST(coefficient AS INT) AS coefficient, CAST(j * 1000 AS BIGINT) AS n, CAST(1000 AS BIGINT) AS draws, true AS mixed FROM p, j""")
def sampled_model_checks(t: Tables) -> DataFrame:
    """Draws of every country and chain, and chains that agree by the potential scale reduction of each coefficient."""
    d = sampled_model(t)
    long_ = d.select("draw", "cid", F.explode(F.array(F.struct(F.lit("total").alias("part"), F.col("total_b").alias("b")), F.struct(F.lit("share").alias("part"), F.col("share_b").alias("b")))).alias("m")).select((F.col("draw") % 10).alias("chain"), "draw", "m.part", F.posexplode("m.b").alias("coefficient", "b"))
    return H.chains_agree(long_).select("part", "coefficient", "n", "draws", "mixed")
