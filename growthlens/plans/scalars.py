"""Queries on column expressions, XML, lookups and the final choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.functions import scalars as S
from growthlens.operators import compile as K
from growthlens.plans.base import Tables, query
from growthlens.sources import xml as X


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d')::INT AS day_number, strftime(o_orderdate, '%Y%m')::INT AS month_number, round(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 86400.0 / 1e9, 9) AS x,
round(year(o_orderdate) + (dayofyear(o_orderdate) - 1) / 366.0, 6) AS decimal_year FROM orders""")
def time_axes(t: Tables) -> DataFrame:
    """E4, E5, E7, W6."""
    d = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", F.date_format(d, "yyyyMMdd").cast("int").alias("day_number"), F.date_format(d, "yyyyMM").cast("int").alias("month_number"), F.round(S.to_axis(d), 9).alias("x"), F.round(S.decimal_year(d), 6).alias("decimal_year"))


@query("""SELECT p_partkey, CASE WHEN x > 0.9466848 AND x < 4.1024448 THEN DATE '1970-01-01' + CAST(floor(floor(x * 1e9) / 86400) AS INT) END AS day FROM (SELECT p_partkey, p_partkey / 400.0 AS x FROM part)""")
def axis_to_date(t: Tables) -> DataFrame:
    """Dates outside 2000 to 2100 are null."""
    return t.part.select("p_partkey", S.from_axis(F.col("p_partkey") / F.lit(400.0)).alias("day"))


@query("""SELECT n_nationkey, CASE n_name WHEN 'NATION_3' THEN 'XKO' WHEN 'NATION_7' THEN 'XSP' ELSE n_name END AS code, n_regionkey || '_' || n_nationkey AS unit, split_part(n_name, '_', 2) AS tail FROM nation""")
def code_strings(t: Tables) -> DataFrame:
    """E1, E2."""
    return t.nation.select("n_nationkey", S.recode("n_name", {"NATION_3": "XKO", "NATION_7": "XSP"}).alias("code"), F.concat_ws("_", "n_regionkey", "n_nationkey").alias("unit"), F.split_part("n_name", F.lit("_"), F.lit(2)).alias("tail"))


@query("""WITH a(name, iso) AS (VALUES ('NATION_1', 'AA1'), ('NATION_2', 'AA2'), ('ISLE', 'ISL')), b AS (SELECT n_name AS name, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iso FROM nation)
SELECT coalesce(a.name, b.name) AS name, coalesce(a.iso, b.iso) AS iso FROM a FULL JOIN b ON a.name = b.name""")
def name_lookup(t: Tables) -> DataFrame:
    """Manual names win over the file's."""
    manual = t.spark.createDataFrame([("NATION_1", "AA1"), ("NATION_2", "AA2"), ("ISLE", "ISL")], "name string, iso_a string")
    file = t.nation.select(F.col("n_name").alias("name"), F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("iso_b"))
    return manual.join(file, "name", "full").select("name", F.coalesce("iso_a", "iso_b").alias("iso"))


@query("""WITH z AS (SELECT c_custkey, c_acctbal / 4000 AS x FROM customer)
SELECT c_custkey, round(1 / (1 + exp(-x)), 10) AS p, round(CASE WHEN x < 1 THEN ln(1 - x) END, 10) AS left_log, round(CASE WHEN x > -1 THEN ln(1 + x) END, 10) AS log1p, round(0.5 + x * (0.25 + x * -0.142857142857), 10) AS poly,
round((x + 0.5) / 3, 10) AS scaled, round(0.2 + (least(greatest(x, 1.0), 3.0) - 1) / 2 * 0.8, 10) AS alpha FROM z""")
def transforms(t: Tables) -> DataFrame:
    """E12, E13, E14."""
    x = F.col("c_acctbal") / 4000
    lit = F.lit
    return t.customer.select(
        "c_custkey", F.round(S.invlogit(x), 10).alias("p"), F.round(S.log_share_left(x), 10).alias("left_log"), F.round(F.when(x > -1, F.log1p(x)), 10).alias("log1p"),
        F.round(S.polynomial(x, [lit(0.5), lit(0.25), lit(-0.142857142857)]), 10).alias("poly"), F.round(S.min_max(x, lit(-0.5), lit(2.5)), 10).alias("scaled"), F.round(S.opacity(x), 10).alias("alpha"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + l_linenumber AS total, round(l_quantity / (l_quantity + l_linenumber), 8) AS share, CAST(round_even(l_extendedprice, 0) AS INT) AS metres, least(l_quantity / 30, 1.0) AS capped, coalesce(nullif(l_tax, 0), l_discount, 0) AS first_known,
least(l_tax, l_discount) AS smallest FROM lineitem""")
def row_arithmetic(t: Tables) -> DataFrame:
    """E17, E18, E19, E20, E23, E25."""
    q, m = F.col("l_quantity"), F.col("l_linenumber")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", (q + m).alias("total"), F.round(F.try_divide(q, q + m), 8).alias("share"), F.rint("l_extendedprice").cast("int").alias("metres"), F.least(q / 30, F.lit(1.0)).alias("capped"),
        F.coalesce(F.nullif("l_tax", F.lit(0.0)), "l_discount", F.lit(0.0)).alias("first_known"), F.coalesce(F.least("l_tax", "l_discount"), F.lit(0.0)).alias("smallest"))


@query("""SELECT DISTINCT c, replace(replace(replace(c, 'sigmoid', 'Logistic'), '_2_jumps', ' (2J)'), '_ramp', ' (1R)') AS label FROM (SELECT CASE p_size % 3 WHEN 0 THEN 'sigmoid' WHEN 1 THEN 'sigmoid_2_jumps' ELSE 'sigmoid_ramp' END AS c FROM part)""")
def model_labels(t: Tables) -> DataFrame:
    """E21, E24."""
    c = F.when(F.col("p_size") % 3 == 0, "sigmoid").when(F.col("p_size") % 3 == 1, "sigmoid_2_jumps").otherwise("sigmoid_ramp")
    return t.part.select(c.alias("c")).distinct().select("c", S.replace_all("c", [("sigmoid", "Logistic"), ("_2_jumps", " (2J)"), ("_ramp", " (1R)")]).alias("label"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE printf('%.2f', c_acctbal) END AS two, CASE WHEN v >= 1000000 THEN CAST(CAST(round(v / 1e6) AS BIGINT) AS VARCHAR) || 'M' WHEN v >= 1000 THEN CAST(CAST(round(v / 1e3) AS BIGINT) AS VARCHAR) || 'k' ELSE CAST(v AS VARCHAR) END AS short,
CASE WHEN v = 0 THEN 0.0 ELSE round(round_even(v * pow(10.0, 1 - floor(log10(v))), 0) / pow(10.0, 1 - floor(log10(v))), 6) END AS two_digits FROM (SELECT *, CAST(c_custkey AS BIGINT) * 1777 AS v FROM customer)""")
def number_formats(t: Tables) -> DataFrame:
    """E22."""
    rows = t.customer.withColumn("v", F.col("c_custkey") * 1777)
    return rows.select("c_custkey", K.two_decimals(F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal"))).alias("two"), K.short_count("v").alias("short"), F.round(S.significant("v", 2), 6).alias("two_digits"))


_WAYS = """w AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, CAST(ts AS DATE) AS valid_from, event_type FROM events)"""


def way_xml(t: Tables) -> DataFrame:
    """Each event as an XML element of a way."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    kind = F.create_map(*(F.lit(x) for x in ("view", "primary", "purchase", "residential", "click", "service", "signup", "footway")))
    text = F.concat(
        F.lit('<way id="'), F.col("user_id"), F.lit('" version="'), nth, F.lit('" timestamp="'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('" visible="'), F.when(F.col("event_type") == "error", "False").otherwise("True"), F.lit('">'),
        F.lit('<nd ref="'), F.col("event_id") % 100, F.lit('"/><nd ref="'), F.col("event_id") % 37, F.lit('"/>'),
        F.coalesce(F.concat(F.lit('<tag k="highway" v="'), F.get(F.transform(F.array("event_type"), lambda e: F.try_element_at(kind, e)), F.lit(0)), F.lit('"/>')), F.lit('<tag k="building" v="yes"/>')), F.lit("</way>"))
    return t.events.select("event_id", text.alias("xml"))


@query(f"""WITH {_WAYS} SELECT user_id AS way_id, CAST(version AS INT) AS version, valid_from, event_type <> 'error' AS visible, event_type IN ('view', 'purchase') AS road, event_type = 'click' AS service, CAST(2 AS INT) AS n_refs, CAST(event_id % 100 + event_id % 37 AS BIGINT) AS ref_sum FROM w WHERE event_type <> 'error'""")
def ways_from_xml(t: Tables) -> DataFrame:
    """IO4, IO5, F1, F2, F3: nested elements to rows with flags."""
    ways = X.ways(X.parse_column(way_xml(t).select("xml"), "xml", X.WAY))
    return ways.select("way_id", "version", "valid_from", "visible", "road", "service", F.size("refs").alias("n_refs"), F.aggregate("refs", F.lit(0).cast("long"), lambda s, x: s + x).alias("ref_sum"))


@query("""SELECT event_id % 100 AS node_id, CAST(event_id % 10 + 1 AS SMALLINT) AS version, round(value / 10, 4) AS lat, CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type <> 'error' GROUP BY 1, 2, 3, 4""")
def nodes_from_xml(t: Tables) -> DataFrame:
    """IO4, F1, E4: visible nodes, in any letter case."""
    text = F.concat(F.lit('<node id="'), F.col("event_id") % 100, F.lit('" lat="'), F.round(F.col("value") / 10, 4), F.lit('" lon="1.5" version="'), F.col("event_id") % 10 + 1, F.lit('" timestamp="'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('" visible="'), F.when(F.col("event_type") == "error", "FALSE").otherwise("TRUE"), F.lit('"/>'))
    rows = X.nodes(X.parse_column(t.events.select(text.alias("xml")), "xml", X.NODE))
    return rows.groupBy("node_id", "version", "lat", "day").agg(F.count("*").alias("n"))


@query(f"""WITH {_WAYS} SELECT user_id AS way_id, CAST(version AS INT) AS version FROM w WHERE event_type <> 'error' AND strftime(valid_from, '%Y-%m-%d') LIKE '2024-01-2%'""")
def incremental_ways(t: Tables) -> DataFrame:
    """an update reads only elements of a time prefix."""
    return X.ways(X.parse_column(way_xml(t).select("xml"), "xml", X.WAY), since="2024-01-2").select("way_id", "version")


@query(f"""WITH {_WAYS}, refs AS (SELECT user_id AS way_id, version, valid_from, 0 AS place, event_id % 100 AS node_id FROM w WHERE event_type <> 'error' UNION ALL SELECT user_id, version, valid_from, 1, event_id % 37 FROM w WHERE event_type <> 'error'),
n AS (SELECT c_custkey % 60 AS node_id, c_custkey AS node_version, DATE '2024-01-01' + CAST(c_custkey % 29 AS INT) AS day, c_acctbal AS lat FROM customer),
hit AS (SELECT way_id, version, place, arg_max(lat, node_version) AS lat FROM refs JOIN n USING (node_id) WHERE n.day <= valid_from GROUP BY 1, 2, 3)
SELECT w.user_id AS way_id, CAST(w.version AS INT) AS version, CAST(count(hit.place) AS INT) AS n_nodes, CAST(2 - count(hit.place) AS INT) AS n_missing, round(coalesce(sum(lat), 0), 4) AS lat_sum FROM w LEFT JOIN hit ON w.user_id = hit.way_id AND w.version = hit.version WHERE event_type <> 'error' GROUP BY 1, 2""")
def way_geometry(t: Tables) -> DataFrame:
    """J1, G1, IO7: points of ways from the node versions of their time."""
    nodes = t.customer.select((F.col("c_custkey") % 60).alias("node_id"), F.col("c_custkey").alias("version"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 29).cast("int")).alias("day"), F.col("c_acctbal").alias("lat"), F.lit(0.0).alias("lon"))
    out = X.geometry(X.ways(X.parse_column(way_xml(t).select("xml"), "xml", X.WAY)), nodes)
    return out.select("way_id", "version", F.col("n_nodes").cast("int").alias("n_nodes"), F.col("n_missing").cast("int").alias("n_missing"), F.round(F.coalesce(F.aggregate("points", F.lit(0.0), lambda s, p: s + p["lat"]), F.lit(0.0)), 4).alias("lat_sum"))


_EST = """e AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 100) / 100.0 END AS fit, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey * 3 % 100) / 100.0 END AS model, CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey * 3 % 100) / 100.0 END AS sample, CAST(p_size AS DOUBLE) AS len, CAST(25 AS DOUBLE) AS then_ FROM part),
i AS (SELECT *, model - 0.1 AS lo, model + 0.1 AS hi, sample - 0.1 AS slo, sample + 0.1 AS shi FROM e)"""


def estimates(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    e = t.part.select(k.alias("k"), F.when(k % 7 != 0, (k % 100) / F.lit(100.0)).alias("fit"), F.when(k % 5 != 0, (k * 3 % 100) / F.lit(100.0)).alias("model"), F.when(k % 4 != 0, (k * 3 % 100) / F.lit(100.0)).alias("sample"), F.col("p_size").cast("double").alias("len"), F.lit(25.0).alias("then_"))
    return e.withColumns({"lo": F.col("model") - 0.1, "hi": F.col("model") + 0.1, "slo": F.col("sample") - 0.1, "shi": F.col("sample") + 0.1})


@query(f"""WITH {_EST}, a AS (SELECT *, fit IS NOT NULL AND (coalesce(abs(fit - model) <= 0.05, false) OR coalesce(fit BETWEEN lo AND hi, false)) AND (coalesce(abs(fit - sample) <= 0.05, false) OR coalesce(fit BETWEEN slo AND shi, false)) AS agree FROM i)
SELECT k, agree, CASE WHEN agree THEN 'fit' WHEN coalesce(fit BETWEEN lo - 0.05 AND hi + 0.05, false) THEN 'fit' WHEN model IS NOT NULL THEN 'model' WHEN fit IS NOT NULL AND model IS NULL THEN 'fit' END AS choice FROM a""")
def chosen_estimate(t: Tables) -> DataFrame:
    """E15, E16, M23."""
    agree = K.agreement("fit", "model", "lo", "hi", "sample", "slo", "shi")
    return estimates(t).select("k", agree.alias("agree"), K.choose("fit", "model", "lo", "hi", agree).alias("choice"))


@query(f"""WITH {_EST}, g AS (SELECT *, greatest(1.0, coalesce(len / then_, 1.0)) AS growth FROM i)
SELECT k, round(growth, 8) AS growth, round(CASE WHEN sample IS NOT NULL AND least(1.0, sample * growth) >= 0.05 THEN least(1.0, sample * growth) END, 8) AS share FROM g""")
def growth_scaled(t: Tables) -> DataFrame:
    """Shares of an older sample brought up to date."""
    g = K.growth_factor("len", "then_")
    return estimates(t).select("k", F.round(g, 8).alias("growth"), F.round(K.scaled_share("sample", g), 8).alias("share"))


@query("""SELECT n_name AS name, n_nationkey AS id, CAST(round(sum(floor(c_acctbal)) / 1000) AS BIGINT) AS length_km FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def exported_table(t: Tables) -> DataFrame:
    """Renamed, in kilometres, without scratch columns, in a fixed order."""
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum(F.floor("c_acctbal")).alias("length_m"), F.count("*").alias("tmp_n"))
    rows = c.join(t.nation, "n_nationkey").select("n_nationkey", "n_name", "length_m", "tmp_n")
    return K.exported(rows, {"n_name": "name", "n_nationkey": "id", "length_m": "length_km"}, ["name", "id"], drop_prefixes=["tmp_"], kilometres=["length_m"])


@query("SELECT 'orders' AS name, CAST(count(*) AS BIGINT) AS n FROM orders UNION ALL SELECT 'part', CAST(count(*) AS BIGINT) FROM part UNION SELECT 'part', CAST(count(*) AS BIGINT) FROM part")
def unions(t: Tables) -> DataFrame:
    """With and without duplicates."""
    n = [t.orders.agg(F.count("*").alias("n")).select(F.lit("orders").alias("name"), "n"), t.part.agg(F.count("*").alias("n")).select(F.lit("part").alias("name"), "n")]
    return n[0].unionByName(n[1]).union(n[1]).distinct()
