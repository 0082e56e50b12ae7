"""Versioned nodes and ways from XML elements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlens.operators.temporal import latest_before

NODE = "_id long, _lat double, _lon double, _version int, _timestamp string, _visible string"
WAY = "_id long, _version int, _timestamp string, _visible string, nd array<struct<_ref: long>>, tag array<struct<_k: string, _v: string>>"
#: The tag values that make a way a road.
ROAD_CLASSES = (
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link",
    "tertiary", "tertiary_link", "residential", "road", "unclassified", "living_street",
)


def read_elements(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Elements of one tag from XML files, compressed or not, split at tag boundaries by Spark."""
    return spark.read.format("xml").option("rowTag", tag).schema(NODE if tag == "node" else WAY).load(path)


def parse_column(df: DataFrame, column: str, schema: str) -> DataFrame:
    return df.withColumn("e", F.from_xml(column, schema)).select(*(c for c in df.columns if c != column), "e.*")


def day_of(timestamp: str) -> Column:
    return F.to_date(F.substring(timestamp, 1, 10))


def nodes(elements: DataFrame) -> DataFrame:
    """Visible node versions."""
    seen = F.lower(F.coalesce("_visible", F.lit("true"))) == "true"
    return elements.where(seen).select(F.col("_id").alias("node_id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), F.col("_version").cast("short").alias("version"), day_of("_timestamp").alias("day"))


def has_tag(key: str, values: Sequence[str] | None = None) -> Column:
    """Some tag has the key and, if values are given, one of them."""

    def test(t: Column) -> Column:
        same = t["_k"] == key
        return same if values is None else same & t["_v"].isin(list(values))

    return F.coalesce(F.exists("tag", test), F.lit(False))


def ways(elements: DataFrame, key: str = "highway", since: str | None = None) -> DataFrame:
    """Way versions that carry the key, with flags and the node references in order."""
    rows = elements if since is None else elements.where(F.col("_timestamp").startswith(since))
    return rows.where(has_tag(key)).select(
        F.col("_id").alias("way_id"), F.col("_version").alias("version"), day_of("_timestamp").alias("valid_from"), (F.lower(F.coalesce("_visible", F.lit("true"))) == "true").alias("visible"),
        has_tag(key, ROAD_CLASSES).alias("road"), has_tag(key, ["service"]).alias("service"), F.coalesce(F.transform("nd", lambda n: n["_ref"]), F.array().cast("array<bigint>")).alias("refs"),
    )


def geometry(ways_: DataFrame, nodes_: DataFrame) -> DataFrame:
    """Ways as points in order, from the latest node versions not after the way's day, with the number of nodes found and missing."""
    refs = ways_.select("way_id", "version", "valid_from", F.posexplode("refs").alias("place", "node_id"))
    hit = latest_before(refs, nodes_.withColumnsRenamed({"version": "node_version"}), ["node_id"], "valid_from", "day", "node_version", ["lon", "lat"], ["way_id", "version", "place"])
    points = hit.groupBy("way_id", "version").agg(F.sort_array(F.collect_list(F.struct("place", "lon", "lat"))).alias("p"))
    out = ways_.join(points, ["way_id", "version"], "left")
    found = F.coalesce(F.size("p"), F.lit(0))
    return out.withColumn("n_nodes", F.greatest(found, F.lit(0))).withColumn("n_missing", F.size("refs") - F.greatest(found, F.lit(0))).withColumn("points", F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat")))).drop("p")
