"""Cuts lineage with tables in the folder that every executor can read."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, as in local tests, one of our own."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="growthlens-"))
    return _LOCAL[0]


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small next to a worker's memory, unless the session has limits of its own."""
    for key, usual, small in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", "4m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", small)


def give_back(spark: SparkSession) -> None:
    """Returns native memory that the driver's JVM has freed to the machine, where the JVM can.

    The C library keeps what compiled plans have freed: over many plans as much as the
    live heap, beside a heap that may grow to its limit.
    """
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    named = jvm.java.lang.Class.forName
    with contextlib.suppress(Py4JError):  # a JVM without this command keeps its memory
        types, values = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[k] = named(kind)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # By reflection, as the server's own class is not open to Py4J.
        named("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


#: Removes what was shuffled for a query when that ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed once, written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/growthlens-{uuid.uuid4().hex}"
    usual = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # the rows are written, so their shuffle files can go
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, usual)
    give_back(spark)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._growthlens_path = path
    return kept


@contextlib.contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """Plans run inside broadcast a side only once its rows are written and measured, never by an estimate.

    Estimates go by compressed files and by types: arrays count as one value and Arrow
    functions as one row a row, so millions of rows can pass for less than the limit, and
    a broadcast goes through the driver.
    """
    static, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    usual, usual_measured = spark.conf.get(static), spark.conf.get(measured, None)
    if usual_measured is None:
        spark.conf.set(measured, usual)
    spark.conf.set(static, "-1")
    try:
        yield
    finally:
        spark.conf.set(static, usual)
        if usual_measured is None:
            spark.conf.unset(measured)


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of materialize() that no later plan reads."""
    for table in tables:
        path = getattr(table, "_growthlens_path", None)
        if path:
            jvm, session = table.sparkSession._jvm, table.sparkSession._jsparkSession
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(session.sessionState().newHadoopConf()).delete(where, True)
