"""What the driver holds."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from growthlens.llm import tables, toxicity
from tests.llm.conftest import words


def test_the_toxicity_model_is_not_trained_in_the_driver(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, f"{words(rng, 20)} idiot{'s' * (i % 2)} {words(rng, 5)}" if i % 3 == 0 else words(rng, 25), int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(5)
    features = docs.select("toxic", "text").mapInArrow(toxicity._features, "toxic int, x binary").collect()
    got = sorted((r["toxic"], bytes(r["x"])) for r in features)
    want = toxicity.train([np.frombuffer(x, np.int32).reshape(-1, 1 + len(toxicity.BEGINNINGS)) for _, x in got], np.array([k == 1 for k, _ in got]))

    def here(*_):
        raise AssertionError("trained in the driver")

    monkeypatch.setattr(toxicity, "train", here)
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    for name in ("weights", "bias", "change", "begin", "curve"):
        np.testing.assert_array_equal(getattr(model, name), getattr(want, name))
    assert toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", F.lit(0).alias("toxic"))) is None
    assert toxicity.fit(docs.select("doc_id", "text").limit(0), docs.select("doc_id", "toxic")) is None


def test_tables_give_freed_native_memory_back(spark):
    """What compilers and codecs of the JVM have freed is kept by the C library unless it is told to let go."""
    status = Path(f"/proc/{spark._jvm.java.lang.ProcessHandle.current().pid()}/status")
    if not status.exists():
        pytest.skip("no /proc")
    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", status.read_text())[1]) // 1024
    for _ in range(3):
        tables.discard(tables.materialize(spark.range(10)))
    before = held()
    made = [spark._jvm.java.util.zip.Deflater() for _ in range(4000)]
    full = held()
    for k, one in enumerate(made):
        if k % 40:  # those left keep the others' memory from the end of the heap
            one.end()
    tables.discard(tables.materialize(spark.range(10)))
    low = held()
    for one in made[::40]:
        one.end()
    assert full - low > (full - before) / 2, (before, full, low)
