"""Queries on growth curves, their errors and their choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from growthlens.functions import curves as C
from growthlens.functions import scalars as S
from growthlens.operators import fitting as M
from growthlens.plans.base import Tables, query

#: Parameters that the expressions are tried with, on x in [0, 10].
TRIED = {
    "line": [2.0, 0.5],
    "sigmoid": [4.0, 1.2, 9.0],
    "sigmoid_1_jumps": [4.0, 1.1, 0.4, 9.0, 3.0, 1.5],
    "sigmoid_2_jumps": [4.5, 0.9, -0.3, 10.0, 2.0, 1.0, 6.0, -2.0],
    "sigmoid_3_jumps": [5.0, 1.3, 0.2, 12.0, 2.0, 1.0, 4.0, 1.5, 7.0, 0.5],
    "sigmoid_4_jumps": [5.0, 0.8, 0.1, 12.0, 1.0, 0.7, 3.0, 1.1, 6.0, 0.9, 30.0, 4.0],
    "sigmoid_ramp": [5.0, 1.0, 9.0, 2.0, 6.0, -3.0],
    "gompertz": [8.0, 7.0, 6.0],
}
FIRST, LAST = 0.0, 10.0


def _x() -> Column:
    return F.col("c_custkey") / F.lit(150.0)


def _sql_logistic(m: str, k: str, h: str) -> str:
    return f"({h}) / (1 + exp(-({k}) * (x - ({m}))))"


def _sql_curve(name: str, p: list[float]) -> str:
    if name == "line":
        return f"CASE WHEN x > {p[0]} THEN (x - {p[0]}) * {p[1]} ELSE 0.0 END"
    if name == "sigmoid":
        return _sql_logistic(*map(str, p))
    if name == "gompertz":
        return f"{p[0]} * exp(-{p[1]} * exp(-{p[2]} * (x - {FIRST}) / ({LAST} - {FIRST})))"
    if name == "sigmoid_ramp":
        m, k, top, a, width, h = p
        return f"{top} / (1 + exp(-{k} * (x - {m} + CASE WHEN x > {a} AND x < {a} + {width} THEN abs({h}) * (x - {a}) / {width} ELSE 0 END)))"
    jumps = [(a, abs(h) if a <= LAST else 0.0) for a, h in zip(p[4::2], p[5::2], strict=True)]
    after = " + ".join(f"CASE WHEN x > {a} THEN {h} ELSE 0.0 END" for a, h in jumps)
    return f"{abs(p[2])} + {after} + " + _sql_logistic(p[0], p[1], p[3] - sum(h for _, h in jumps) - abs(p[2]))


_GRID = "g AS (SELECT c_custkey, CAST(c_custkey AS DOUBLE) / 150.0 AS x FROM customer)"


@query(f"WITH {_GRID} " + " UNION ALL ".join(f"SELECT c_custkey, '{n}' AS curve, round({_sql_curve(n, p)}, 6) AS y FROM g" for n, p in TRIED.items()))
def curve_values(t: Tables) -> DataFrame:
    """M2 to M9 as column expressions."""
    every = [F.struct(F.lit(n).alias("curve"), F.round(C.CURVES[n].value(_x(), [F.lit(v) for v in p], F.lit(FIRST), F.lit(LAST)), 6).alias("y")) for n, p in TRIED.items()]
    return t.customer.select("c_custkey", F.explode(F.array(*every)).alias("v")).select("c_custkey", "v.curve", "v.y")


def _sql_end(n: str, p: list[float]) -> str:
    if n == "line":
        return "CAST(NULL AS DOUBLE)"
    if n == "gompertz":
        return f"-ln(-ln(0.99) / {p[1]}) / {p[2]} * ({LAST} - {FIRST}) + {FIRST}"
    return f"{p[0]} - ln(1 / 0.99 - 1) / {p[1]}"


@query(" UNION ALL ".join(f"SELECT '{n}' AS curve, round({_sql_end(n, p)}, 6) AS end_x, {'CAST(NULL AS DOUBLE)' if C.CURVES[n].top is None else f'CAST({p[C.CURVES[n].top]} AS DOUBLE)'} AS asymptote" for n, p in TRIED.items()))
def curve_completion(t: Tables) -> DataFrame:
    """M10, M11."""
    rows = t.spark.createDataFrame([(n, p) for n, p in TRIED.items()], "curve string, params array<double>")
    end = M.by_curve(lambda c, p: c.end(p, F.lit(FIRST), F.lit(LAST)))
    return rows.select("curve", F.round(end, 6).alias("end_x"), M.by_curve(lambda c, p: c.asymptote(p)).alias("asymptote"))


@query(f"WITH {_GRID}, y AS (SELECT x, CAST(c_custkey % 10 AS DOUBLE) AS y FROM g) " + " UNION ALL ".join(f"SELECT '{n}' AS curve, round(avg(pow(({_sql_curve(n, p)}) - y, 2)), 6) AS mse FROM y" for n, p in TRIED.items()))
def curve_errors(t: Tables) -> DataFrame:
    """A19."""
    grid = t.customer.select(_x().alias("x"), (F.col("c_custkey") % 10).cast("double").alias("y"))
    out = grid.agg(*(F.round(C.mean_square_error("y", C.CURVES[n].value(F.col("x"), [F.lit(v) for v in p], F.lit(FIRST), F.lit(LAST))), 6).alias(n) for n, p in TRIED.items()))
    return out.unpivot([], list(TRIED), "curve", "mse")


@query("""WITH u AS (SELECT p_partkey, 'sigmoid' AS curve, 1 AS ordinal, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size * 1.0 END AS mse FROM part UNION ALL SELECT p_partkey, 'gompertz', 2, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(p_partkey % 50 AS DOUBLE) END FROM part UNION ALL SELECT p_partkey, 'line', 3, CASE WHEN p_partkey % 20 = 0 THEN NULL ELSE 25.0 END FROM part),
b AS (SELECT * FROM u WHERE mse IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY mse, ordinal) = 1) SELECT p.p_partkey, b.curve, round(b.mse, 4) AS mse FROM part p LEFT JOIN b ON p.p_partkey = b.p_partkey""")
def best_curve(t: Tables) -> DataFrame:
    """Least error, the first of equals; parts without any keep a row."""
    k = F.col("p_partkey")
    rows = t.part.select("p_partkey", F.when(k % 5 != 0, F.col("p_size") * F.lit(1.0)).alias("sigmoid"), F.when(k % 10 != 0, (k % 50).cast("double")).alias("gompertz"), F.when(k % 20 != 0, F.lit(25.0)).alias("line"))
    long_ = rows.unpivot("p_partkey", ["sigmoid", "gompertz", "line"], "curve", "mse")
    ordinal = F.array_position(F.array(F.lit("sigmoid"), F.lit("gompertz"), F.lit("line")), F.col("curve"))
    return M.best_fit(long_.withColumn("ordinal", ordinal), ["p_partkey"]).select("p_partkey", "curve", F.round("mse", 4).alias("mse"))


@query("""WITH u AS (SELECT p_partkey, 'gompertz' AS curve, 2 AS ordinal, CAST(p_partkey % 50 AS DOUBLE) AS mse FROM part UNION ALL SELECT p_partkey, 'sigmoid', 1, p_size * 1.0 FROM part)
SELECT p_partkey, curve FROM u QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY mse, ordinal) = 1""")
def best_curve_without_lines(t: Tables) -> DataFrame:
    """a family of curves left out."""
    k = F.col("p_partkey")
    rows = t.part.select("p_partkey", (F.col("p_size") * F.lit(1.0)).alias("sigmoid"), (k % 50).cast("double").alias("gompertz"), F.lit(0.0).alias("line"))
    long_ = rows.unpivot("p_partkey", ["sigmoid", "gompertz", "line"], "curve", "mse").withColumn("ordinal", F.when(F.col("curve") == "sigmoid", 1).otherwise(2))
    return M.best_fit(long_, ["p_partkey"], without=["line"]).select("p_partkey", "curve")


def cumulative(t: Tables) -> DataFrame:
    """Running order totals of a segment by month, both axes scaled to about 1."""
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("grp"))
    monthly = t.orders.join(c, "o_custkey").groupBy("grp", F.trunc("o_orderdate", "MM").cast("date").alias("day")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    run = F.sum("v").over(Window.partitionBy("grp").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return monthly.select("grp", "day", S.to_axis("day").alias("x"), (run.cast("double") / 1e9).alias("y"))


@query("""WITH m AS (SELECT c_mktsegment AS grp, CAST(date_trunc('month', o_orderdate) AS DATE) AS day, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT grp, day, round(date_diff('day', DATE '1970-01-01', day) * 86400.0 / 1e9, 9) AS x, round(CAST(sum(v) OVER (PARTITION BY grp ORDER BY day ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 1e9, 6) AS y FROM m""")
def fit_frame(t: Tables) -> DataFrame:
    """E5, W4, IO11: the series that curves are fitted to."""
    return cumulative(t).select("grp", "day", F.round("x", 9).alias("x"), F.round("y", 6).alias("y"))


_AXIS = [d * 86400.0 / 1e9 for d in (9131, 11688)]


@query()
def fitted_curves(t: Tables) -> DataFrame:
    """All curves by group; rows only, as a simplex search has no SQL."""
    fits = M.fit_curves(cumulative(t), "grp", "x", "y", *_AXIS)
    return fits.select("grp", "curve", "params", "mse", "success", "asymptote", S.from_axis("end_x").alias("finished"))


_MONTHLY = """m AS (SELECT c_mktsegment AS grp, CAST(date_trunc('month', o_orderdate) AS DATE) AS day, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
f AS (SELECT grp, date_diff('day', DATE '1970-01-01', day) * 86400.0 / 1e9 AS x, CAST(sum(v) OVER (PARTITION BY grp ORDER BY day ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 1e6 AS y FROM m),
g AS (SELECT grp, min(x) AS x0, max(x) AS x1, avg(x) AS xm, max(y) AS top FROM f GROUP BY 1),
s AS (SELECT f.*, 0.0 AS line, top / (1 + exp(-10 / (x1 - x0) * (x - (x0 + x1) / 2))) AS sigmoid, top / 2 AS sigmoid_ramp, top * exp(-10 * exp(-6 * (x - {a}) / ({b} - {a}))) AS gompertz FROM f JOIN g USING (grp))"""


@query(f"""WITH {_MONTHLY.format(a=_AXIS[0], b=_AXIS[1])}, n AS (SELECT grp, CAST(count(*) AS BIGINT) AS n, avg(pow(y - line, 2)) AS line, avg(pow(y - sigmoid, 2)) AS sigmoid, avg(pow(y - sigmoid_ramp, 2)) AS sigmoid_ramp, avg(pow(y - gompertz, 2)) AS gompertz FROM s GROUP BY 1),
k AS (SELECT unnest({list(C.CURVES)}) AS curve)
SELECT grp, curve, n, round(CASE curve WHEN 'line' THEN line WHEN 'sigmoid' THEN sigmoid WHEN 'sigmoid_ramp' THEN sigmoid_ramp WHEN 'gompertz' THEN gompertz END, 3) AS start_mse, true AS recomputed, true AS improved, true AS least FROM n, k""")
def fitted_checks(t: Tables) -> DataFrame:
    """What a fit must keep. The error at the plain curves' start; the error is that of the parameters, is not above that of the start, and no parameter a hundredth more or less lowers it by more than a fiftieth."""
    series = cumulative(t).withColumn("y", F.col("y") * 1000)
    fits = M.fit_curves(series, "grp", "x", "y", *_AXIS).where("params is not null").select("grp", "curve", "params", "mse")
    ends = series.groupBy("grp").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.avg("x").alias("xm"), F.max("y").alias("top"))
    starts = {"line": (F.lit(0.0), F.lit(0.0)), "sigmoid": ((F.col("x0") + F.col("x1")) / 2, 10 / (F.col("x1") - F.col("x0")), F.col("top")), "sigmoid_ramp": (F.col("x0"), F.lit(0.0), F.col("top"), F.col("xm"), F.lit(0.01), F.lit(0.01)), "gompertz": (F.col("top"), F.lit(10.0), F.lit(6.0))}
    start = F.coalesce(*(F.when(F.col("curve") == name, F.array(*p)) for name, p in starts.items()))
    near = F.flatten(F.transform(F.sequence(F.lit(0), F.size("params") - 1), lambda i: F.transform(F.array(F.lit(0.99), F.lit(1.01)), lambda by: F.transform("params", lambda v, k: F.when(k == i, v * by).otherwise(v)))))
    tried = fits.join(ends, "grp").withColumn("start", start)
    tried = tried.select("grp", "curve", "mse", F.explode(F.concat(F.array(F.struct(F.lit("own").alias("kind"), F.col("params"))), F.when(F.col("start").isNotNull(), F.array(F.struct(F.lit("start").alias("kind"), F.col("start").alias("params")))).otherwise(F.array()), F.transform(near, lambda p: F.struct(F.lit("near").alias("kind"), p.alias("params"))))).alias("v")).select("grp", "curve", "mse", "v.kind", "v.params")
    value = M.by_curve(lambda c, p: c.value(F.col("x"), p, F.lit(_AXIS[0]), F.lit(_AXIS[1])))
    errors = tried.join(series.select("grp", "x", "y"), "grp").groupBy("grp", "curve", "mse", "kind", "params").agg(F.count("*").alias("n"), C.mean_square_error("y", value).alias("e"))
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("e")))
    out = errors.groupBy("grp", "curve", "mse").agg(F.max("n").alias("n"), of("own").alias("own"), of("start").alias("start"), of("near").alias("near"))
    return out.select("grp", "curve", "n", F.round("start", 3).alias("start_mse"), (F.abs(F.col("own") - F.col("mse")) <= 1e-6 * F.col("mse")).alias("recomputed"), F.coalesce(F.col("mse") <= F.col("start"), F.lit(True)).alias("improved"), (F.col("near") >= 0.98 * F.col("mse")).alias("least"))


@query()
def fitted_choice(t: Tables) -> DataFrame:
    """The best curve by group and what it says of completeness."""
    fits = M.fit_curves(cumulative(t), "grp", "x", "y", *_AXIS)
    best = M.best_fit(fits.withColumn("ordinal", F.col("curve")), ["grp"])
    return M.fit_summary(best, cumulative(t), "grp", "x", "y", *_AXIS).select("grp", "curve", "mse", "asymptote", "x_now", "y_now", "share_model", "share_fit")


@query()
def fitted_by_class(t: Tables) -> DataFrame:
    """Fits by region and class in one key."""
    from growthlens.plans.aggregates import region_rollup

    rows = region_rollup(t).select(F.concat_ws("_", "region", "klass").alias("key"), S.to_axis("dt").alias("x"), "dt", "v")
    run = F.sum("v").over(Window.partitionBy("key").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0))
    return M.fit_curves(rows.withColumn("y", run / 1e9), "key", "x", "y", *_AXIS).select("key", "curve", "params", "mse", "success")
