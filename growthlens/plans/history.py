"""Queries on versioned history: intervals, daily series, as-of joins, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.operators import history as H
from growthlens.operators import temporal as T
from growthlens.plans.base import VERSIONS, Tables, query, versions


def intervals(t: Tables) -> DataFrame:
    return T.with_valid_to(versions(t), "way_id", "version", "valid_from")


def _series_sql(keys: list[str], source: str, tail: str = "") -> str:
    g = ", ".join(keys)
    eq = " AND ".join(f"d.{k} IS NOT DISTINCT FROM s.{k}" for k in [*keys, "dt"])
    return f"""WITH {VERSIONS}, kept AS ({source}),
st AS (SELECT {g}, dt, sum(n) AS n, sum(m) AS m FROM (
   SELECT {g}, valid_from AS dt, 1 AS n, length AS m FROM kept UNION ALL SELECT {g}, valid_to, -1, -length FROM kept WHERE valid_to < DATE '2099-12-31') GROUP BY {g}, dt),
days AS (SELECT {g}, CAST(unnest(generate_series(f, (SELECT max(dt) FROM st), INTERVAL 1 DAY)) AS DATE) AS dt FROM (SELECT {g}, min(dt) AS f FROM st GROUP BY {g})),
series AS (SELECT {", ".join(f"d.{k}" for k in keys)}, d.dt, CAST(coalesce(sum(s.n) OVER w, 0) AS BIGINT) AS freq, CAST(coalesce(sum(s.m) OVER w, 0) AS BIGINT) AS length
  FROM days d LEFT JOIN st s ON {eq} WINDOW w AS (PARTITION BY {", ".join(f"d.{k}" for k in keys)} ORDER BY d.dt ROWS UNBOUNDED PRECEDING))
{tail or "SELECT * FROM series"}"""


_LEVEL0 = "SELECT * FROM iv WHERE visible AND id0 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY way_id, version, id0 ORDER BY part) = 1"
_LEVEL1 = "SELECT * FROM iv WHERE visible AND id0 IS NOT NULL AND id1 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY way_id, version, id0, id1 ORDER BY part) = 1"
_WORLD = "SELECT * REPLACE (-1 AS id0) FROM iv WHERE visible QUALIFY row_number() OVER (PARTITION BY way_id, version ORDER BY part) = 1"


@query(_series_sql(["road", "id0"], _LEVEL0))
def active_history_daily(t: Tables) -> DataFrame:
    """W1, F8, F10, W3, W5, J5, A1, A4 at level 0: steps up and down make one series, so no frames are laid side by side."""
    return H.collapse(intervals(t), 0)


@query(_series_sql(["road", "id0"], _WORLD))
def active_history_world(t: Tables) -> DataFrame:
    """A4, level -1: one row a version wherever it lies, also outside every unit."""
    return H.collapse(intervals(t), -1)


@query(_series_sql(["road", "id0", "id1"], _LEVEL1))
def active_history_level1(t: Tables) -> DataFrame:
    """A4, level 1."""
    return H.collapse(intervals(t), 1)


@query(_series_sql(["road", "id0"], _LEVEL0, "SELECT road, id0, CAST(date_trunc('month', dt) AS DATE) AS \"month\", arg_max(freq, dt) AS freq, arg_max(length, dt) AS length FROM series GROUP BY 1, 2, 3"))
def active_history_monthly(t: Tables) -> DataFrame:
    """Month-end values."""
    return T.to_months(H.collapse(intervals(t), 0), ["road", "id0"], "dt", ["freq", "length"])


@query(f"WITH {VERSIONS} SELECT way_id, version, part, valid_from, valid_to FROM iv")
def valid_intervals(t: Tables) -> DataFrame:
    """W1 on rows that share a version."""
    return intervals(t).select("way_id", "version", "part", "valid_from", "valid_to")


@query(f"WITH {VERSIONS} SELECT way_id, min(version) AS first_version, max(valid_from) AS last_from, count(DISTINCT valid_to) AS n_ends, CAST(count(*) AS BIGINT) AS n FROM iv GROUP BY way_id")
def version_consistency(t: Tables) -> DataFrame:
    """Spread of dates and versions."""
    return intervals(t).groupBy("way_id").agg(F.min("version").alias("first_version"), F.max("valid_from").alias("last_from"), F.count_distinct("valid_to").alias("n_ends"), F.count("*").alias("n"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events)
WHERE nth = 1 OR p IS DISTINCT FROM event_type""")
def repeats_dropped(t: Tables) -> DataFrame:
    """W2."""
    return T.drop_repeats(t.events, "user_id", ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey, round(l_extendedprice, 2) AS price FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity, l_extendedprice, l_partkey, l_suppkey, l_discount, l_tax, l_shipdate) = 1""")
def deduplicated_rows(t: Tables) -> DataFrame:
    """The row of least quantity, with a total order."""
    order = ["l_quantity", "l_extendedprice", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_shipdate"]
    best = T.best_row(t.lineitem, ["l_orderkey", "l_linenumber"], [F.col(c).asc() for c in order])
    return best.select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey", F.round("l_extendedprice", 2).alias("price"))


_ORDERED = "ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events)"


@query(f"""WITH {_ORDERED}, l AS (SELECT * FROM ev WHERE event_type = 'purchase'), r AS (SELECT * FROM ev WHERE event_type = 'view')
SELECT l.event_id, arg_max(r.event_id, r.version) AS view_id, round(arg_max(r.value, r.version), 6) AS view_value FROM l JOIN r ON l.user_id = r.user_id AND r.ts <= l.ts GROUP BY l.event_id""")
def asof_latest_view(t: Tables) -> DataFrame:
    """The latest view not after each purchase."""
    from pyspark.sql import Window

    ev = t.events.withColumn("version", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    right = ev.where("event_type = 'view'").withColumn("view_id", F.col("event_id")).withColumn("view_value", F.round("value", 6))
    return T.latest_before(ev.where("event_type = 'purchase'"), right, ["user_id"], "ts", "ts", "version", ["view_id", "view_value"], ["event_id"])


@query(f"""WITH {VERSIONS}, kept AS ({_LEVEL0}) SELECT road, id0, CAST(count(*) AS BIGINT) AS freq, CAST(sum(length) AS BIGINT) AS length FROM kept WHERE valid_to = DATE '2099-12-31' GROUP BY 1, 2""")
def open_versions(t: Tables) -> DataFrame:
    """The invariant that the last day of a series is what is still open."""
    return T.still_open(H.level_rows(intervals(t), 0), ["road", "id0"], "valid_to", "length")


@query(_series_sql(["road", "id0"], _LEVEL0, """, last AS (SELECT road, id0, arg_max(freq, dt) AS freq, arg_max(length, dt) AS length FROM series GROUP BY 1, 2),
open AS (SELECT road, id0, count(*) AS freq, sum(length) AS length FROM kept WHERE valid_to = DATE '2099-12-31' GROUP BY 1, 2)
SELECT coalesce(l.road, o.road) AS road, coalesce(l.id0, o.id0) AS id0, CAST(coalesce(l.freq, 0) - coalesce(o.freq, 0) AS BIGINT) AS freq_gap, CAST(coalesce(l.length, 0) - coalesce(o.length, 0) AS BIGINT) AS length_gap
FROM last l FULL JOIN open o ON l.road = o.road AND l.id0 = o.id0"""))
def series_check(t: Tables) -> DataFrame:
    """Outer join of last values and open rows; every gap is 0."""
    return H.last_day_gaps(intervals(t), 0)


_DAILY = "daily AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS grp, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey % 1000) AS BIGINT) AS y FROM orders GROUP BY 1, 2)"


def daily_orders(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("grp")).agg(F.count("*").alias("n"), F.sum(F.col("o_orderkey") % 1000).alias("y"))


@query(f"""WITH {_DAILY}, x AS (SELECT *, max(day) OVER (PARTITION BY grp) AS last FROM daily)
SELECT grp, max(y) AS max_value, CAST(floor(avg(y) FILTER (WHERE day > last - 14)) AS BIGINT) AS tail_value, coalesce(CAST(floor(avg(y) FILTER (WHERE day > last - 14)) AS BIGINT), max(y)) AS "level" FROM x GROUP BY grp""")
def tail_mean_by_group(t: Tables) -> DataFrame:
    """A5 with each group's own last date."""
    return T.tail_mean(daily_orders(t), ["grp"], "day", "y")


@query(f"""WITH {_DAILY}, x AS (SELECT *, (SELECT max(day) FROM daily) AS last FROM daily)
SELECT grp, max(y) AS max_value, CAST(floor(avg(y) FILTER (WHERE day > last - 3)) AS BIGINT) AS tail_value, coalesce(CAST(floor(avg(y) FILTER (WHERE day > last - 3)) AS BIGINT), max(y)) AS "level" FROM x GROUP BY grp""")
def tail_mean_overall(t: Tables) -> DataFrame:
    """A5, J18 with the table's last date, and E18 where a group has no row that late."""
    return T.tail_mean(daily_orders(t), ["grp"], "day", "y", days=3, overall=True)


@query(f"""WITH {_DAILY}, c AS (SELECT grp, day, n, sum(CASE WHEN dayofmonth(day) = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY grp) AS k FROM daily)
SELECT grp, day, n FROM c WHERE dayofmonth(day) = 1 OR k < 75""")
def month_start_sample(t: Tables) -> DataFrame:
    """F16, A27."""
    return T.month_starts(daily_orders(t), ["grp"], "day", least=75).select("grp", "day", "n")


_SLOPES = f"{_DAILY}, s AS (SELECT grp, day, y, lag(day) OVER w AS prev_x, y - lag(y) OVER w AS dy FROM daily WINDOW w AS (PARTITION BY grp ORDER BY day))"


@query(f"WITH {_SLOPES} SELECT grp, prev_x AS jump_x, dy AS jump_dy FROM s WHERE dy IS NOT NULL QUALIFY row_number() OVER (PARTITION BY grp ORDER BY dy DESC, day) = 1")
def steepest_step(t: Tables) -> DataFrame:
    """The first of the largest rises."""
    return T.steepest(daily_orders(t), ["grp"], "day", "y")


_RUNS = f"""{_SLOPES}, f AS (SELECT *, dy < avg(dy) OVER (PARTITION BY grp) AS flatter FROM s WHERE dy IS NOT NULL),
r AS (SELECT *, CAST(sum(c) OVER (PARTITION BY grp ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM (SELECT *, CASE WHEN lag(flatter) OVER (PARTITION BY grp ORDER BY day) <> flatter THEN 1 ELSE 0 END AS c FROM f))"""


@query(f"WITH {_RUNS} SELECT grp, run, flatter, CAST(count(*) AS BIGINT) AS n, min(day) AS first_day, max(dy) AS most FROM r GROUP BY 1, 2, 3")
def flat_and_steep_runs(t: Tables) -> DataFrame:
    """Runs as gaps and islands."""
    return T.flat_runs(daily_orders(t), ["grp"], "day", "y").groupBy("grp", "run", "flatter").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("dy").alias("most"))


@query(f"""WITH {_RUNS}, p AS (SELECT * FROM r WHERE NOT flatter QUALIFY row_number() OVER (PARTITION BY grp, run ORDER BY dy DESC, day) = 1)
SELECT grp, nth, prev_x AS jump_x, dy AS jump_dy FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY dy DESC, day) AS nth FROM p) WHERE nth <= 4""")
def jump_candidates(t: Tables) -> DataFrame:
    """The four steepest rises of different runs."""
    return T.jumps(daily_orders(t), ["grp"], "day", "y", 4)


@query("""WITH r AS (SELECT i AS file_id, CAST(lo AS DOUBLE) AS lo, CAST(lo + 19.9 AS DOUBLE) AS hi FROM (SELECT i, 900 + 20 * i AS lo FROM range(50) t(i)))
SELECT p_partkey, r.file_id FROM part JOIN r ON p_retailprice >= r.lo AND p_retailprice <= r.hi""")
def range_lookup(t: Tables) -> DataFrame:
    """Which range holds a value, by bins instead of comparing all pairs."""
    ranges = t.spark.range(50).select(F.col("id").alias("file_id"), (900.0 + 20 * F.col("id")).alias("lo"), (919.9 + 20 * F.col("id")).alias("hi"))
    return H.range_join(t.part.select("p_partkey", "p_retailprice"), ranges, "p_retailprice", "lo", "hi", width=50.0).select("p_partkey", "file_id")


@query("""WITH f AS (SELECT o_custkey % 50 AS file_id, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY 1)
SELECT file_id, low, high, coalesce(low - lag(high) OVER (ORDER BY low, file_id) >= 0, true) AS in_order FROM f""")
def range_order_check(t: Tables) -> DataFrame:
    """Do files follow each other without overlap?"""
    files = t.orders.groupBy((F.col("o_custkey") % 50).alias("file_id")).agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))
    return H.in_order(files, "low", "high", "file_id")


@query(_series_sql(["road", "id0"], _LEVEL0, "SELECT id0, dt, freq, round(length / 1e9, 9) AS y, round(date_diff('day', DATE '1970-01-01', dt) * 86400.0 / 1e9, 9) AS x FROM series WHERE road"))
def road_series(t: Tables) -> DataFrame:
    """IO11, F5, E5: the roads of a level on the axes that curves are fitted on."""
    from growthlens.functions import scalars as S

    rows = H.collapse(intervals(t), 0).where("road")
    return rows.select("id0", "dt", "freq", F.round(F.col("length") / 1e9, 9).alias("y"), F.round(S.to_axis("dt"), 9).alias("x"))


@query(f"""WITH {VERSIONS} SELECT way_id, version, part, length FROM iv WHERE visible AND (length IS NULL OR length < 2000) AND way_id <> 13 AND id0 IN (1, 2, 5)""")
def filtered_versions(t: Tables) -> DataFrame:
    """Null-or-range, denylist, visibility after intervals, list."""
    return H.usable(intervals(t), most=2000, denied=[13]).where(F.col("id0").isin(1, 2, 5)).select("way_id", "version", "part", "length")


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), b AS (SELECT user_id, min(day) AS f, max(day) AS l FROM d GROUP BY 1),
c AS (SELECT user_id, CAST(unnest(generate_series(f, l, INTERVAL 1 DAY)) AS DATE) AS day FROM b)
SELECT c.user_id, c.day FROM c LEFT JOIN d ON c.user_id = d.user_id AND c.day = d.day WHERE d.n IS NULL""")
def missing_days(t: Tables) -> DataFrame:
    """Calendar days a series lacks, by anti-join."""
    days = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").cast("date").alias("day"))
    return H.missing_days(days, ["user_id"], "day")


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, max(round(value, 2)) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), b AS (SELECT user_id, min(day) AS f FROM d GROUP BY 1),
c AS (SELECT user_id, CAST(unnest(generate_series(f, (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS day FROM b)
SELECT c.user_id, c.day, last_value(d.v IGNORE NULLS) OVER (PARTITION BY c.user_id ORDER BY c.day ROWS UNBOUNDED PRECEDING) AS v FROM c LEFT JOIN d ON c.user_id = d.user_id AND c.day = d.day""")
def forward_filled(t: Tables) -> DataFrame:
    """Calendar and forward fill."""
    daily = t.events.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.max(F.round("value", 2)).alias("v"))
    return H.forward_fill(daily, ["user_id"], "day", "v")
