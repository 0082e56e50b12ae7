"""Sources, sinks and stages that run once."""

from pyspark.sql import functions as F

from growthlens.plans import run as stages
from growthlens.sources import files, xml
from growthlens.streaming import increments


def test_xml_files(spark, tmp_path):
    (tmp_path / "h.xml").write_text(
        '<all><node id="1" lat="2.5" lon="3" version="1" timestamp="2015-01-02T03:04:05Z" visible="true"/><node id="1" lat="2.6" lon="3" version="2" timestamp="2015-03-02T03:04:05Z" visible="FALSE"/>'
        '<way id="7" version="1" timestamp="2015-02-01T00:00:00Z" visible="true"><nd ref="1"/><nd ref="9"/><tag k="highway" v="service"/></way>'
        '<way id="8" version="1" timestamp="2015-02-01T00:00:00Z" visible="true"><nd ref="1"/><tag k="building" v="yes"/></way></all>'
    )
    nodes = xml.nodes(xml.read_elements(spark, str(tmp_path / "h.xml"), "node"))
    ways = xml.ways(xml.read_elements(spark, str(tmp_path / "h.xml"), "way"))
    assert [(r["node_id"], r["version"]) for r in nodes.collect()] == [(1, 1)]
    row = xml.geometry(ways, nodes).first()
    assert (row["way_id"], row["service"], row["road"], row["n_nodes"], row["n_missing"]) == (7, True, False, 1, 1)
    assert [(p["lon"], p["lat"]) for p in row["points"]] == [(3.0, 2.5)]


def test_lookup_with_mixed_line_ends(spark, tmp_path):
    (tmp_path / "l.tsv").write_bytes(b"iso\tname\tarea\rAAA\tOne\t1,234\nBBB\tTwo\t\r")
    rows = files.read_lookup(spark, str(tmp_path / "l.tsv"), "iso string, name string, area string").select("iso", files.number("area").alias("area")).collect()
    assert [tuple(r) for r in rows] == [("AAA", 1234.0), ("BBB", None)]


def test_made_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3).withColumn("level", F.col("id") % 2)

    path = str(tmp_path / "t")
    assert files.made_once(spark, path, make, partition_by=["level"]).count() == 3
    assert files.made_once(spark, path, make).count() == 3 and len(calls) == 1
    files.made_once(spark, path, make, force=True)
    assert len(calls) == 2


def test_batches_resume(spark, tmp_path):
    path = str(tmp_path / "out")
    keys = spark.range(10).select(F.col("id").alias("k"))
    spark.range(4).select(F.col("id").alias("k")).write.parquet(path)
    assert files.process_in_batches(spark, keys, "k", path, lambda b: b, size=4) == 2
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == list(range(10))


def test_keys_without_rows_are_done(spark, tmp_path):
    path, tried = str(tmp_path / "out"), []

    def work(batch):
        tried.extend(r["k"] for r in batch.collect())
        return batch.where("k % 3 <> 0")

    keys = spark.range(10).select(F.col("id").alias("k"))
    assert files.process_in_batches(spark, keys, "k", path, work, size=4) == 3
    assert sorted(tried) == list(range(10)) and spark.read.parquet(path).count() == 6
    assert files.process_in_batches(spark, keys, "k", path, work, size=4) == 0


def test_store_skips_files(spark, tmp_path):
    files.write_store(spark.range(1000), str(tmp_path / "s"), "id", 4)
    import pyarrow.parquet as pq

    spans = sorted((s.statistics.min, s.statistics.max) for f in (tmp_path / "s").glob("*.parquet") for s in [pq.ParquetFile(f).metadata.row_group(0).column(0)])
    assert all(a[1] < b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a_b", 1), ("<x>", None)], "name string, n int")
    assert "<td>&lt;x&gt;</td><td></td>" in files.to_html(df)
    assert r"a\_b & 1 \\" in files.to_latex(df, ["Name", "N"])
    files.write_tsv(df, str(tmp_path / "r"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "r")).count() == 2


def test_stages_run_once(spark, data, tmp_path):
    done = stages.run(spark, data, str(tmp_path), "report")
    assert done == ["history", "fits", "shares", "draws", "cells", "units", "report"]
    assert stages.run(spark, data, str(tmp_path), "report") == []
    assert stages.run(spark, data, str(tmp_path), "fits", force=True) == ["fits"]
    assert stages.run(spark, data, str(tmp_path), "coefficients") == ["coefficients"]
    report = spark.read.parquet(str(tmp_path / "report"))
    assert report.where("curve is not null").count() == 5 and report.where("model_share between model_p5 and model_p95").count() > 0 and report.where("grp = '-99'").count() == 1


def test_increments_match_one_go(spark, data, tmp_path):
    from growthlens.operators import history
    from growthlens.plans.base import Tables
    from growthlens.plans.history import intervals

    rows = history.level_rows(intervals(Tables(spark, data)), 0).select("road", "id0", "valid_from", "valid_to", "length")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    increments.append_steps(stream, str(tmp_path / "steps"), str(tmp_path / "mark"), ["road", "id0"], "valid_from", "valid_to", "length").awaitTermination()
    got = increments.series(spark, str(tmp_path / "steps"), ["road", "id0"])
    want = history.collapse(intervals(Tables(spark, data)), 0)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_list_tables(spark):
    spark.range(1).createOrReplaceTempView("a_view")
    assert "a_view" not in files.list_tables(spark)
