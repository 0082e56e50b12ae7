"""Lookups, tables that are made once, and exports of small reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lookup(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """A delimited lookup with a header; line ends may be mixed."""
    return spark.read.schema(schema).option("sep", sep).option("header", True).csv(path)


def number(column: str):
    """A number written with thousands separators; null if it is none."""
    return F.try_to_number(F.replace(column, F.lit(","), F.lit("")), F.lit("999999999999")).cast("double")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where))


def made_once(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False, partition_by: Sequence[str] = ()) -> DataFrame:
    """The table at `path`, made if it isn't there or if `force`. Writers commit whole tables, so a lost run leaves none."""
    if force or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def write_store(df: DataFrame, path: str, key: str, files: int) -> None:
    """Rows sorted by key over files of their own ranges: readers skip files by their least and greatest key."""
    df.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").option("compression", "zstd").parquet(path)


def remaining(spark: SparkSession, inputs: DataFrame, key: str, path: str) -> DataFrame:
    """The keys that the table at `path` does not have."""
    if not exists(spark, path):
        return inputs
    return inputs.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")


def process_in_batches(spark: SparkSession, inputs: DataFrame, key: str, path: str, work: Callable[[DataFrame], DataFrame], size: int = 450) -> int:
    """Works on at most `size` keys at a time and appends, until none remains; resumes where a lost run ended. Returns the number of batches.

    Keys that are done are noted in a table of their own, so one that yields no rows is
    not tried again, and the output is read once, for what a lost run has written and not
    noted. Keys are unique.
    """
    done = f"{path.rstrip('/')}.done"
    if exists(spark, path):
        remaining(spark, spark.read.parquet(path).select(key).distinct(), key, done).write.mode("append").parquet(done)
    n = 0
    while True:
        batch = remaining(spark, inputs, key, done).orderBy(key).limit(size)
        if batch.isEmpty():
            return n
        work(batch).write.mode("append").parquet(path)
        batch.select(key).write.mode("append").parquet(done)
        n += 1


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def _cells(df: DataFrame, most: int) -> list[list[str]]:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    return [["" if v is None else str(v) for v in r] for r in rows]


def to_html(df: DataFrame, headings: Sequence[str] | None = None, most: int = 1000) -> str:
    """A small report as an HTML table."""
    import html

    def row(cells: Sequence[str], tag: str) -> str:
        return "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"

    return "<table>\n" + "\n".join([row(headings or df.columns, "th"), *(row(r, "td") for r in _cells(df, most))]) + "\n</table>"


def to_latex(df: DataFrame, headings: Sequence[str] | None = None, most: int = 1000) -> str:
    """A small report as a LaTeX tabular."""

    def safe(text: str) -> str:
        return "".join("\\" + c if c in "&%$#_{}" else c for c in text)

    lines = [" & ".join(map(safe, r)) + r" \\" for r in [list(headings or df.columns), *_cells(df, most)]]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", lines[0], r"\hline", *lines[1:], r"\end{tabular}"])


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Tables of a database, views aside."""
    return sorted(t.name for t in spark.catalog.listTables(database) if t.tableType in ("MANAGED", "EXTERNAL"))
