"""Queries on roll-ups, quantile bins and sample estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from growthlens.functions import binning as B
from growthlens.functions import scalars as S
from growthlens.operators import estimates as E
from growthlens.operators import rollup as R
from growthlens.operators import temporal as T
from growthlens.plans.base import Tables, query


def _customer_orders(t: Tables) -> DataFrame:
    """Values by nation and customer, as 32-bit floats as the bins are defined on."""
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("id0"))
    means = t.orders.join(c, "o_custkey").groupBy("id0", "o_custkey").agg(F.avg(F.col("o_totalprice").cast("decimal(18,2)")).cast("float").alias("v"))
    return means


_MEANS = "m AS (SELECT c_nationkey AS id0, o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) / count(*) AS FLOAT) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
_EDGES = f"{_MEANS}, e AS (SELECT id0, quantile_cont(CAST(round(v, 0) AS DOUBLE), [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) AS q FROM m GROUP BY id0)"


def _rounded_means(t: Tables) -> DataFrame:
    return _customer_orders(t).withColumn("v", F.round("v", 0).cast("double"))


@query(f"WITH {_EDGES} SELECT id0, unnest(range(0, 11)) AS edge, round(unnest(q), 4) AS v FROM e")
def quantile_edges(t: Tables) -> DataFrame:
    """A2: means by customer first, then exact quantiles by nation; A17."""
    e = _rounded_means(t).groupBy("id0").agg(B.quantile_edges("v").alias("q"))
    return e.select("id0", F.posexplode("q").alias("edge", "v")).select("id0", F.col("edge").cast("long").alias("edge"), F.round("v", 4).alias("v"))


_DECILES = f"""{_EDGES}, d AS (SELECT m.id0, o_custkey, CAST(CASE WHEN v IS NULL THEN -1 ELSE coalesce(list_max(list_filter(range(1, 10), lambda i: q[i + 1] < CAST(round(v, 0) AS DOUBLE) AND NOT list_contains(q[1:i], q[i + 1]))), 0) END AS INTEGER) AS decile
  FROM m JOIN e ON m.id0 = e.id0)"""


def _deciles(t: Tables) -> DataFrame:
    rows = _rounded_means(t)
    e = rows.groupBy("id0").agg(B.quantile_edges("v").alias("q"))
    return rows.join(e, "id0").select("id0", "o_custkey", B.edge_label(F.col("v"), F.col("q")).alias("decile"))


@query(f"WITH {_DECILES} SELECT id0, decile, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM d GROUP BY 1, 2")
def decile_labels(t: Tables) -> DataFrame:
    """E8."""
    return _deciles(t).groupBy("id0", "decile").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys"))


@query(f"WITH {_DECILES} SELECT id0, CAST(decile // 2 AS INTEGER) AS quintile, CAST(count(*) AS BIGINT) AS n FROM d WHERE decile >= 0 GROUP BY 1, 2")
def quintile_sums(t: Tables) -> DataFrame:
    """A6."""
    return _deciles(t).select("id0", B.decile_to_quintile("decile").alias("quintile")).where("quintile is not null").groupBy("id0", "quintile").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer)
SELECT CAST((v >= -500)::INT + (v >= 0)::INT + (v >= 2500)::INT + (v >= 5000)::INT + (v >= 7500)::INT + (v >= 9000)::INT AS INTEGER) AS bin, CAST((v >= 9000) AS INTEGER) AS top, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY 1, 2""")
def fixed_bins(t: Tables) -> DataFrame:
    """Fixed edges, 0 below the first; top flag."""
    v = F.when(F.col("c_custkey") % 13 != 0, F.col("c_acctbal"))
    x = t.customer.select(v.alias("v"))
    return x.groupBy(B.digitize("v", [-500, 0, 2500, 5000, 7500, 9000]).alias("bin"), (F.col("v") >= 9000).cast("int").alias("top")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT n_name AS unit, CAST(o_orderdate AS DATE) AS dt, o_custkey % 3 AS klass, CAST(o_totalprice * 100 AS BIGINT) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
mem AS (SELECT n_name AS unit, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 'GROUP_' || (n_nationkey % 2) FROM nation),
r AS (SELECT region, dt, klass, v FROM d JOIN mem USING (unit) UNION ALL SELECT 'WLD', dt, klass, v FROM d)
SELECT region, dt, CAST(CASE WHEN grouping(klass) = 1 THEN 99 ELSE klass END AS INTEGER) AS klass, CAST(sum(v) AS BIGINT) AS v FROM r GROUP BY GROUPING SETS ((region, dt, klass), (region, dt))""")
def region_rollup(t: Tables) -> DataFrame:
    """Overlapping regions, the world, and a subtotal over classes; total rows do not count twice."""
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("unit"))
    d = t.orders.join(c, "o_custkey").select("unit", F.col("o_orderdate").cast("date").alias("dt"), (F.col("o_custkey") % 3).alias("klass"), F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))
    total = d.groupBy("dt", "klass").agg(F.sum("v").alias("v")).select(F.lit("ALL").alias("unit"), "dt", "klass", "v")
    member = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("unit"), F.col("r_name").alias("region"))
    member = member.unionByName(t.nation.select(F.col("n_name").alias("unit"), F.concat(F.lit("GROUP_"), F.col("n_nationkey") % 2).alias("region")))
    return R.by_region(d.unionByName(total), member, "unit", "region", ["dt"], "klass", "v")


@query("SELECT l_returnflag, l_linestatus, CAST(sum(n) AS BIGINT) AS n, CAST(sum(q) AS BIGINT) AS q FROM (SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2")
def recollapsed(t: Tables) -> DataFrame:
    """A1, A3."""
    fine = t.lineitem.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"))
    return R.drop_key(fine, ["l_returnflag", "l_linestatus"], ["n", "q"])


_POINTS = "p AS (SELECT l_suppkey % 25 AS iso, l_returnflag AS stratum, l_quantity AS present, CAST(l_linenumber AS DOUBLE) AS missing, 1 + round(l_discount * 100, 0) AS w FROM lineitem)"


def points(t: Tables) -> DataFrame:
    """`lineitem` as sample points; weights are whole numbers, so sums do not hang on their order."""
    return t.lineitem.select((F.col("l_suppkey") % 25).alias("iso"), F.col("l_returnflag").alias("stratum"), F.col("l_quantity").alias("present"), F.col("l_linenumber").cast("double").alias("missing"), (1 + F.rint(F.col("l_discount") * 100)).alias("w"), "l_orderkey", "l_partkey", "l_linenumber")


@query(f"""WITH {_POINTS} SELECT iso, CAST(count(*) AS BIGINT) AS n, round(sum(w), 4) AS weight, round(var_samp(present), 4) AS var_present, round(sum(present * w) / sum((present + missing) * w), 8) AS share,
round(sum(present) FILTER (WHERE stratum = 'A') / sum(present + missing) FILTER (WHERE stratum = 'A'), 8) AS share_dense FROM p GROUP BY iso""")
def sample_shares(t: Tables) -> DataFrame:
    """A8, A9, A10."""
    p = points(t)
    dense = F.col("stratum") == "A"
    return p.withColumn("dp", F.when(dense, F.col("present"))).withColumn("dm", F.when(dense, F.col("missing"))).groupBy("iso").agg(
        F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("weight"), F.round(F.var_samp("present"), 4).alias("var_present"),
        F.round(E.weighted_share("present", "missing", "w"), 8).alias("share"), F.round(E.weighted_share("dp", "dm"), 8).alias("share_dense"))


@query()
def bootstrapped_shares(t: Tables) -> DataFrame:
    """Resampled within strata, by the chances of their selection; rows only, as draws have no SQL."""
    return E.bootstrap_share(points(t), "iso", "stratum", "present", "missing", "w", ["l_orderkey", "l_partkey", "l_linenumber"])


@query(f"""WITH {_POINTS}, s AS (SELECT iso, stratum, CAST(count(*) AS DOUBLE) AS n, sum(1 / w) AS inv, sum(present) AS a, sum(present + missing) AS b FROM p GROUP BY 1, 2),
r AS (SELECT iso, sum(n * a / inv) / sum(n * b / inv) AS share, sum(n * b / inv) AS whole FROM s GROUP BY 1),
v AS (SELECT p.iso, p.stratum, sum(w * pow(present - share * (present + missing), 2)) AS sq, sum(present - share * (present + missing)) AS m FROM p JOIN r ON p.iso = r.iso GROUP BY 1, 2)
SELECT r.iso, round(max(share), 6) AS share, round(sqrt(sum(n * (sq / inv - pow(m / inv, 2)))) / max(whole), 6) AS deviation, true AS mean_agrees, true AS std_agrees, true AS between FROM v JOIN s ON v.iso = s.iso AND v.stratum = s.stratum JOIN r ON v.iso = r.iso GROUP BY r.iso""")
def bootstrap_against_theory(t: Tables) -> DataFrame:
    """The share and deviation that drawing by 1 / weight leads to by formula, and whether the resamples agree: their mean to a sixth of the deviation, their deviation to an eighth."""
    p, drawn = points(t), bootstrapped_shares(t)
    both = F.col("present") + F.col("missing")
    s = p.groupBy("iso", "stratum").agg(F.count("*").cast("double").alias("n"), F.sum(1 / F.col("w")).alias("inv"), F.sum("present").alias("a"), F.sum(both).alias("b"))
    r = s.groupBy("iso").agg((F.sum(F.col("n") * F.col("a") / F.col("inv")) / F.sum(F.col("n") * F.col("b") / F.col("inv"))).alias("share"), F.sum(F.col("n") * F.col("b") / F.col("inv")).alias("whole"))
    off = F.col("present") - F.col("share") * both
    v = p.join(r, "iso").groupBy("iso", "stratum", "share", "whole").agg(F.sum(F.col("w") * off * off).alias("sq"), F.sum(off).alias("m"))
    each = F.col("n") * (F.col("sq") / F.col("inv") - F.pow(F.col("m") / F.col("inv"), F.lit(2)))
    known = v.join(s.select("iso", "stratum", "n", "inv"), ["iso", "stratum"]).groupBy("iso", "share", "whole").agg(F.sum(each).alias("e")).select("iso", "share", (F.sqrt("e") / F.col("whole")).alias("deviation"))
    out = known.join(drawn, "iso")
    return out.select("iso", F.round("share", 6).alias("share"), F.round("deviation", 6).alias("deviation"), (F.abs(F.col("mean") - F.col("share")) < F.col("deviation") / 6).alias("mean_agrees"), (F.abs(F.col("std") / F.col("deviation") - 1) < 0.125).alias("std_agrees"), ((F.col("p5") < F.col("share")) & (F.col("share") < F.col("p95"))).alias("between"))


@query("""WITH u AS (SELECT c_nationkey AS id0, c_custkey % 9 AS id1, CAST(sum(floor(c_acctbal)) AS DOUBLE) AS len FROM customer GROUP BY 1, 2), f AS (SELECT *, CASE WHEN id1 % 4 <> 0 THEN len * 1.25 + 1000 END AS len_full FROM u)
SELECT id0, round(least(1.0, sum(len) FILTER (WHERE len_full IS NOT NULL) / sum(len_full)), 8) AS share FROM f GROUP BY id0""")
def added_up_share(t: Tables) -> DataFrame:
    """A12, E17."""
    u = t.customer.groupBy(F.col("c_nationkey").alias("id0"), (F.col("c_custkey") % 9).alias("id1")).agg(F.sum(F.floor("c_acctbal")).cast("double").alias("len"))
    u = u.withColumn("len_full", F.when(F.col("id1") % 4 != 0, F.col("len") * 1.25 + 1000))
    return R.add_up(u, ["id0"], "len", "len_full").select("id0", F.round("share", 8).alias("share"))


@query("""WITH n AS (SELECT c_nationkey AS iso, CAST(floor(avg(c_acctbal)) AS DOUBLE) AS v, CAST(count(*) AS DOUBLE) AS w FROM customer GROUP BY 1), x AS (SELECT iso, CASE WHEN iso % 6 <> 0 THEN v END AS v, w FROM n)
SELECT CAST(iso AS VARCHAR) AS iso, round(v, 6) AS v FROM x UNION ALL SELECT 'ALL', round(sum(v * w) / sum(w) FILTER (WHERE v IS NOT NULL), 6) FROM x""")
def world_mean(t: Tables) -> DataFrame:
    """A row for all from the rows that have the measure."""
    n = t.customer.groupBy(F.col("c_nationkey").alias("iso")).agg(F.floor(F.avg("c_acctbal")).cast("double").alias("v"), F.count("*").cast("double").alias("w"))
    x = n.select(F.col("iso").cast("string").alias("iso"), F.when(F.col("iso") % 6 != 0, F.col("v")).alias("v"), "w")
    return x.select("iso", F.round("v", 6).alias("v")).unionByName(x.agg(F.round(E.weighted_mean("v", "w"), 6).alias("v")).select(F.lit("ALL").alias("iso"), "v"))


@query("SELECT CAST(percentile AS BIGINT) AS percentile, round(v, 6) AS v FROM (SELECT unnest(range(0, 101)) AS percentile, unnest(quantile_cont(p_retailprice, [i / 100.0 for i in range(0, 101)])) AS v FROM part WHERE p_retailprice > 0)")
def percentile_table(t: Tables) -> DataFrame:
    """A17."""
    p = t.part.where("p_retailprice > 0").agg(B.quantile_edges("p_retailprice", 100).alias("q"))
    return p.select(F.posexplode("q").alias("percentile", "v")).select(F.col("percentile").cast("long").alias("percentile"), F.round("v", 6).alias("v"))


@query("""WITH e AS (SELECT 'm' || (l_suppkey % 4) AS model, l_quantity AS est, CAST(l_linenumber * 7 AS DOUBLE) AS truth FROM lineitem)
SELECT model, round(avg(est - truth), 6) AS mean_error, round(avg((est - truth) * (est - truth)), 6) AS mse, row_number() OVER (ORDER BY avg(est - truth), model) AS place FROM e GROUP BY model""")
def model_errors(t: Tables) -> DataFrame:
    """A18."""
    e = t.lineitem.select(F.concat(F.lit("m"), F.col("l_suppkey") % 4).alias("model"), F.col("l_quantity").alias("est"), (F.col("l_linenumber") * 7).cast("double").alias("truth"))
    return E.model_errors(e, "est", "truth", "model").select("model", F.round("mean_error", 6).alias("mean_error"), F.round("mse", 6).alias("mse"), "place")


@query("""SELECT c_nationkey, round((count(*) FILTER (WHERE c_acctbal < 4000) + count(*) FILTER (WHERE c_acctbal <= 4000) + CASE WHEN count(*) FILTER (WHERE c_acctbal = 4000) > 0 THEN 1 ELSE 0 END) * 50.0 / count(c_acctbal), 6) AS pct FROM customer GROUP BY 1""")
def percentile_of_score(t: Tables) -> DataFrame:
    """A26."""
    return t.customer.groupBy("c_nationkey").agg(F.round(B.percentile_of_score("c_acctbal", F.lit(4000.0)), 6).alias("pct"))


@query("""SELECT s_nationkey, s_suppkey, round(s_acctbal, 2) AS bal FROM (SELECT *, sum(w) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS cum, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS nth, sum(w) OVER (PARTITION BY s_nationkey) AS tot
FROM (SELECT *, CAST(s_suppkey % 17 + 1 AS BIGINT) AS w FROM supplier)) WHERE cum <= tot * 0.25 OR nth = 1""")
def cumulative_cut(t: Tables) -> DataFrame:
    """Densest rows up to a share of the mass; one at least."""
    s = t.supplier.withColumn("w", F.col("s_suppkey") % 17 + 1)
    return R.cumulative_cut(s, "s_nationkey", [F.col("s_acctbal").desc(), F.col("s_suppkey")], "w", 0.25).select("s_nationkey", "s_suppkey", F.round("s_acctbal", 2).alias("bal"))


@query("SELECT c_custkey, c_nationkey, dense_rank() OVER (ORDER BY c_nationkey) AS cid FROM customer")
def dense_keys(t: Tables) -> DataFrame:
    """W16."""
    return R.dense_key(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", "cid").withColumn("cid", F.col("cid").cast("long"))


@query("""SELECT n_name, CAST((row_number() OVER (ORDER BY bal DESC, n_name) - 1) // 11 AS BIGINT) AS page, row_number() OVER (ORDER BY bal DESC, n_name) AS nth FROM (SELECT n_name, sum(CAST(floor(c_acctbal) AS BIGINT)) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)""")
def report_pages(t: Tables) -> DataFrame:
    """Pages of a sorted report, the last one included."""
    bal = t.customer.groupBy("c_nationkey").agg(F.sum(F.floor("c_acctbal")).alias("bal")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return R.pages(bal.select("n_name", "bal"), [F.col("bal").desc(), F.col("n_name")], 11).select("n_name", "page", "nth")


@query("""WITH p AS (SELECT DISTINCT p_type FROM part) SELECT p_type, row_number() OVER (ORDER BY CASE p_type WHEN 'STANDARD' THEN 1 WHEN 'PROMO' THEN 2 ELSE 3 END, p_type) AS place FROM p""")
def explicit_order(t: Tables) -> DataFrame:
    """W14, A23."""
    place = F.row_number().over(Window.orderBy(S.explicit_order("p_type", ["STANDARD", "PROMO"]), "p_type"))
    return t.part.select("p_type").distinct().withColumn("place", place.cast("long"))


@query("""WITH d AS (SELECT c_nationkey AS g, c_custkey % 5 AS q, CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS DOUBLE) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
p AS (SELECT g, day, sum(y) AS total FROM d GROUP BY 1, 2) SELECT d.g, d.q, d.day, round(y / (SELECT max(total) FROM p WHERE p.g = d.g), 8) AS level FROM d""")
def normalized_series(t: Tables) -> DataFrame:
    """A part's series against the greatest of its parent over all days."""
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("g"))
    d = t.orders.join(c, "o_custkey").groupBy("g", (F.col("o_custkey") % 5).alias("q"), F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").cast("double").alias("y"))
    total = F.sum("y").over(Window.partitionBy("g", "day"))
    top = F.max("total").over(Window.partitionBy("g"))
    return d.withColumn("total", total).withColumn("top", top).select("g", "q", "day", F.round(F.col("y") / F.col("top"), 8).alias("level"))


@query("""WITH a AS (SELECT c_nationkey AS k, CAST(count(*) AS BIGINT) AS n_cust FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1), b AS (SELECT s_nationkey AS k, CAST(count(*) AS BIGINT) AS n_supp FROM supplier WHERE s_nationkey % 3 = 0 GROUP BY 1), c AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation WHERE n_nationkey > 15)
SELECT coalesce(ab.k, c.k) AS k, n_cust, n_supp, r FROM (SELECT coalesce(a.k, b.k) AS k, n_cust, n_supp FROM a FULL JOIN b ON a.k = b.k) ab FULL JOIN c ON ab.k = c.k""")
def outer_joined(t: Tables) -> DataFrame:
    """J6, J7, J9, J10."""
    a = t.customer.where("c_nationkey % 2 = 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_cust"))
    b = t.supplier.where("s_nationkey % 3 = 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_supp"))
    c = t.nation.where("n_nationkey > 15").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    return R.outer([a, b, c], ["k"])


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def strict_lookup(t: Tables) -> DataFrame:
    """A lookup that fails on a key it lacks."""
    table = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return R.strict_lookup(t.supplier.select("s_suppkey", "s_nationkey"), table, "s_nationkey", "n_name").select("s_suppkey", "n_name")


@query("SELECT c_nationkey AS id0, CAST(sum(CAST(floor(c_acctbal) AS BIGINT)) AS BIGINT) AS a, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1 UNION ALL SELECT -99, CAST(sum(CAST(floor(c_acctbal) AS BIGINT)) AS BIGINT), CAST(count(*) AS BIGINT) FROM customer")
def with_grand_total(t: Tables) -> DataFrame:
    """A14, A24."""
    rows = t.customer.select(F.col("c_nationkey").alias("id0"), F.floor("c_acctbal").alias("a"), F.lit(1).alias("n"))
    return R.with_total(rows, "id0", ["a", "n"])


@query("""WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey % 7 <> 0 THEN c_acctbal END AS x FROM customer), d AS (SELECT n_nationkey AS c_nationkey, CASE WHEN n_nationkey % 5 <> 0 THEN n_regionkey END AS cov FROM nation)
SELECT c_custkey, cov FROM c JOIN d USING (c_nationkey) WHERE cov IS NOT NULL AND x IS NOT NULL""")
def complete_cases(t: Tables) -> DataFrame:
    """F12, F13."""
    c = t.customer.select("c_custkey", "c_nationkey", F.when(F.col("c_nationkey") % 7 != 0, F.col("c_acctbal")).alias("x")).na.drop(subset=["x"])
    d = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_regionkey")).alias("cov"))
    return E.complete_cases(c, d, "c_nationkey", ["cov"]).select("c_custkey", "cov")


@query("WITH r AS (SELECT avg(ln(p_retailprice)) AS m, stddev_samp(ln(p_retailprice)) AS s FROM part WHERE p_size < 25) SELECT p_partkey, round((ln(p_retailprice) - m) / s, 6) AS z FROM part, r")
def standardized(t: Tables) -> DataFrame:
    """E11 with log and another frame's moments."""
    out = E.standardized(t.part, "p_retailprice", take_log=True, reference=t.part.where("p_size < 25"))
    return out.select("p_partkey", F.round("p_retailprice_z", 6).alias("z"))


@query("SELECT c_mktsegment, c_custkey FROM customer WHERE c_custkey % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) = 1")
def first_unlabelled(t: Tables) -> DataFrame:
    """the next point to label in each part of the world."""
    todo = t.customer.where("c_custkey % 4 <> 0")
    return T.best_row(todo, ["c_mktsegment"], [F.col("c_custkey").asc()]).select("c_mktsegment", "c_custkey")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1 HAVING count(*) >= 70")
def groups_with_enough_points(t: Tables) -> DataFrame:
    """F11."""
    return t.events.groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 70")
