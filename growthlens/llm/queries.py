"""One query for each operator of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlens.llm import chat, langid, media, mixing, neardup, oracles, pieces, quality, sharding, suffixdedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(doc_id: str, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves `fold`; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", _fold("doc_id", 4, 2))
    model = langid.fit(docs.where("doc_id is not null and not held_out"))
    return langid.identify(docs, model).withColumn("held_out", _fold("doc_id", 4, 2)).select("doc_id", "held_out", "lang_pred", "score")


def op2_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), digests=True)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.texts_as_media(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = _fold("doc_id", 5, 0)
    labels = _table(spark, sf_dir, "labels").where(~held_out)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(_table(spark, sf_dir, "documents"), length=400)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    text = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.round_trip(rows, _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("n_tokens", "n_loss_tokens")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(_table(spark, sf_dir, "documents"), with_text=False)


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_hilbert_sharding, op3_media_columns, op4_sentencepiece, op5_toxicity, op6_suffix_dedup, op7_source_mixing, op8_chat_format, op9_quality_rules, op10_minhash_neardup)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
