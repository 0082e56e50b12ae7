"""The pipeline on its small input, stage by stage."""

import hashlib
import random

from pyspark.sql import functions as F

import corpus_pipeline
from growthlens.llm import mixing
from growthlens.llm.tables import materialize
from tests.llm.conftest import words
from tests.llm.test_neardup import brute
from tests.llm.test_repeats import brute as covered


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "near_duplicates", "suffix_dedup", "mixing", "sentencepiece"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    clean = materialize(steps["toxicity"](spark, docs, d))
    assert clean.columns == docs.columns
    left = {r["doc_id"] for r in clean.collect()}
    toxic = [i for i, x in labels.items() if x == 1]
    assert sum(i in left for i in toxic) <= 0.5 * len(toxic)  # few labels here; accuracy is tested on more
    assert all(i in left for i, x in labels.items() if x == 0)

    single = materialize(steps["near_duplicates"](spark, clean, d))
    classes = brute([(r["doc_id"], r["text"]) for r in clean.collect()], 80)
    assert {r["doc_id"] for r in single.collect()} == {i for i, (n, c) in classes.items() if i == c or not n}

    cut = materialize(steps["suffix_dedup"](spark, single, d))
    assert cut.columns == docs.columns
    before = sorted(single.collect(), key=lambda r: r["doc_id"])
    gone = covered([r["text"].encode() for r in before], corpus_pipeline.PASSAGE_BYTES)
    for old, g, new in zip(before, gone, sorted(cut.collect(), key=lambda r: r["doc_id"]), strict=True):
        kept = "".join(c for c, at in zip(old["text"], _starts(old["text"]), strict=True) if not all(g[at : at + len(c.encode())]))
        assert new["text"] == kept and new["n_chars"] == len(kept)

    mix = materialize(steps["mixing"](spark, cut, d))
    assert mix.columns == docs.columns and {r["doc_id"] for r in mix.collect()} <= {r["doc_id"] for r in cut.collect()}
    last = steps["sentencepiece"](spark, mix, d)
    want = sorted(len(r["text"].encode()) for r in mix.collect())
    assert sorted(r["n_bytes"] for r in last.collect()) == want
    ran = sorted(map(str, corpus_pipeline.run(spark, d).collect()))
    assert hashlib.sha256("".join(ran).encode()).digest() == hashlib.sha256("".join(sorted(map(str, last.collect()))).encode()).digest()


def _odd(spark):
    rng = random.Random(4)
    text, passage = words(rng, 120), words(rng, 55)
    near = text.split()
    near[60] = "other"
    rows = [(None, text, "en", "a", 1)] * 12 + [(1, text, "en", "a", 1), (2, " ".join(near), "en", "a", 1), (3, words(rng, 90), "en", "b", 1), (3, words(rng, 80), "de", "b", 2), (3, None, None, None, None), (4, "", "en", "b", 0)]
    rows += [(10 + i, f"{words(rng, 40)} {passage} {words(rng, 40)}", "en", "b", 5) for i in range(3)] + [(20, words(rng, 20_000), "fr", "c", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("id", "key", "copies", "_n", "rep", "component_id", "kept", "kept_text", "score", "predicted", "spans", "size"):
        docs = docs.withColumn(name, F.lit(name))
    return docs.repartition(3), text, passage


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, one id of several texts, and columns of clashing names, through every stage but the last."""
    docs, text, passage = _odd(spark)
    steps = dict(corpus_pipeline.STAGES)
    d = "/root/testdata/sf0.001"
    clean = steps["toxicity"](spark, docs, d)
    assert clean.columns == docs.columns and sorted(map(str, clean.collect())) == sorted(map(str, docs.collect()))
    single = steps["near_duplicates"](spark, docs, d)
    kept = single.collect()
    assert single.columns == docs.columns
    # The group of near copies keeps its smallest id; the three texts of id 3, and all others, stay.
    assert sorted(((r["doc_id"], r["text"] is None) for r in kept)) == [(1, False), (3, False), (3, False), (3, True), (4, False), (10, False), (11, False), (12, False), (20, False)]
    cut = steps["suffix_dedup"](spark, single, d)
    assert cut.columns == docs.columns
    after = {r["doc_id"]: r["text"] for r in cut.collect() if r["doc_id"] != 3}
    assert not any(passage in after[i] for i in (10, 11, 12)) and after[1] == text
    mix = steps["mixing"](spark, docs, d)
    assert mix.columns == docs.columns and set(map(str, mix.collect())) <= set(map(str, docs.collect()))
    # Twelve equal rows are taken as often as the mix says, not as often for each of them.
    assert mix.where("doc_id is null").count() == sum(r["copies"] for r in mixing.mix(docs).collect() if r["doc_id"] is None) <= 24
    last = steps["sentencepiece"](spark, docs, d)
    assert last.count() == docs.count()


def test_no_rows(spark):
    nothing = _odd(spark)[0].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "/root/testdata/sf0.001").count() == 0, name


def _starts(text):
    at = 0
    for c in text:
        yield at
        at += len(c.encode())


def test_ids_of_several_texts_are_not_broadcast_by_an_estimate(spark, odd, monkeypatch):
    plans, written = [], corpus_pipeline.materialize

    def watched(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return written(df)

    monkeypatch.setattr(corpus_pipeline, "materialize", watched)
    monkeypatch.setattr(corpus_pipeline.neardup, "near_duplicates", lambda keyed, **_: keyed.withColumn("kept", F.lit(True)))
    corpus_pipeline.without_near_duplicates(spark, odd, "")
    assert len(plans) == 2 and not any("BroadcastHashJoin" in p for p in plans)
