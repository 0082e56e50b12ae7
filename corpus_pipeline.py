"""From raw documents to token ids, in five stages over whole tables.

Each stage takes all that the stage before kept, as Parquet written and read again. No
rows give no rows, in every stage; columns beside those of `documents` go with their rows,
whatever their names, until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlens.llm import mixing, neardup, pieces, suffixdedup, toxicity
from growthlens.llm.tables import discard, materialize, measured_joins


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic by a model of the labelled ones outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (four fifths of their shingles in common): that of the smallest id.

    An id that stands for one text names it. Rows of an id that stands for several, and
    rows without an id, are told apart by their texts, and count after all others.
    """
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.struct(*others).alias("rest"))
    several = materialize(rows.groupBy("id").agg(F.min(F.xxhash64("text")).alias("least"), F.max(F.xxhash64("text")).alias("most")).where("id is null or least < most").select(F.col("id").alias("several")))
    if several.isEmpty():
        keyed = rows.withColumnRenamed("id", "key")
    else:  # written down, as the operator reads it more than once
        of_several = F.col("id").eqNullSafe(F.col("several"))
        late = F.xxhash64("id", "text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
        keyed = rows.join(several, of_several, "left_anti").unionByName(rows.join(several, of_several, "left_semi").withColumn("id", late)).withColumnRenamed("id", "key")
        with measured_joins(spark):
            keyed = materialize(keyed)
    discard(several)
    ids = neardup.near_duplicates(keyed, percent=80, id_col="key").where("kept").select("key").distinct()
    # Rows of one key have one text; the least of their other columns stay.
    one = keyed.join(ids, "key", "left_semi").groupBy("key").agg(F.min("rest").alias("rest"), F.first("text").alias("text"))
    return one.select(*("text" if c == "text" else F.col(f"rest.{c}") for c in docs.columns))


#: Fifty words of four bytes: repeated passages of a stage's documents that are as long as that go.
PASSAGE_BYTES = 200


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the whole characters that repeated strings of PASSAGE_BYTES bytes cover. Null texts become empty."""
    others = tuple(c for c in docs.columns if c != "text")
    cut = suffixdedup.remove_repeats(docs, length=PASSAGE_BYTES, whole_characters=True, with_text=True, keep=others)
    columns = {c: F.col("kept_text") if c == "text" else F.length("kept_text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"keep_{c}") for c in docs.columns}
    return cut.select(*(column.alias(c) for c, column in columns.items()))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Rows that repeat each other share their copies evenly. Documents of no words stay once where their source is taken whole."""
    return mixing.take(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of each document's token ids and of what they decode to."""
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), digests=True)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("suffix_dedup", without_repeats),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: Models, suffix arrays and tokens are beyond SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents in `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
