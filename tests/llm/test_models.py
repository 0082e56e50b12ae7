"""Classifiers: exact inference, and accuracy on held-out rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from growthlens.llm import langid, queries, toxicity
from growthlens.llm import textops as T
from tests.llm.conftest import words


def chain(e, change, begin):
    n = len(e)
    a, b, w = np.zeros((n, 2)), np.ones((n, 2)), np.stack([np.ones(n), np.exp(e)], 1)
    a[0] = begin * w[0]
    for i in range(1, n):
        a[i] = a[i - 1] @ change * w[i]
        a[i] /= a[i].sum()
    for i in range(n - 2, -1, -1):
        b[i] = change @ (w[i + 1] * b[i + 1])
        b[i] /= b[i].sum()
    return (a * b)[:, 1] / (a * b).sum(1)


@pytest.mark.parametrize("cuts", [[0, 1, 6, 300, 511, 512, 1299], [0, 1200]])
def test_forward_backward(cuts):
    rng = np.random.default_rng(0)
    e, first = rng.normal(size=1300) * 3, np.zeros(1300, bool)
    first[cuts] = True
    change, begin = np.array([[0.9, 0.3], [0.4, 2.6]]), np.array([0.8, 0.2])
    m = toxicity.marginals(*toxicity.forward_backward(e, first, change, begin))
    for a, b in zip(cuts, [*cuts[1:], 1300], strict=True):
        np.testing.assert_allclose(m[a:b], chain(e[a:b], change, begin), atol=1e-12)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op5_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    n, right, false = out.agg(F.count("*"), F.count_if(F.col("predicted") == F.col("toxic")), F.count_if(F.expr("predicted = 1 and toxic = 0"))).first()
    assert n > 40 and right >= 0.97 * n and false <= 0.01 * n


def test_spans(spark):
    rows = [(i, f"clean words here {i} and idiot{'s' * (i % 2)} there" if i % 3 == 0 else f"clean words here {i} and there") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    texts = dict(rows)
    assert [texts[3][s["start"] : s["end"]] for s in out[3]["spans"]] == ["idiots"] and out[3]["predicted"] == 1
    assert out[4]["predicted"] == 0 and not out[4]["spans"]


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    out = queries.op1_language_id(spark, d).join(docs, "doc_id").where("held_out")
    n, right = out.agg(F.count("*"), F.count_if(F.col("lang_pred") == F.col("lang"))).first()
    assert right >= 0.97 * n


def test_ngrams_of_blocks():
    data = np.frombuffer("Abc é!".encode() + b"" + "zz".encode(), np.uint8)
    offsets = np.array([0, 7, 7, 9])
    got = list(langid.ngram_counts(data, offsets))
    assert len(got) == 1
    doc, _, count, letters = got[0]
    assert letters.tolist() == [True, False, True]
    # Of n characters: n single ones, n - 1 pairs, n - 2 triples.
    assert np.bincount(doc, count, 3).tolist() == [6 + 5 + 4, 0, 2 + 1 + 0]


def test_temperature_is_calibrated():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    target = np.array([rng.choice(3, p=q) for q in p])
    assert langid._temperature(logits * 3, target) == pytest.approx(3, rel=0.15)


def toxic_model(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, 30) + (f" vile{i % 2} person {i}" if i % 3 == 0 else "")) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    return rows, toxicity.fit(docs, labels)


def test_scores_token_by_token(spark):
    """The score of every row, from its words one after the other."""
    rows, model = toxic_model(spark)
    rng = random.Random(2)
    rows = rows[:40] + [(1000, ""), (1001, None), (1002, "... 12"), (1003, "VILE0 é vile1"), (1004, words(rng, 30_000) + " vile1"), (1005, "vile0 " * 700)]

    def plain(text):
        tokens = [t.lower() for t in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())]
        e = []
        for t in tokens:
            _, _, x, _ = toxicity.tokens(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
            e.append(model.bias + sum(model.weights[f] for f in x[0]))
        m = chain(np.clip(e, -30, 30), model.change, model.begin) if e else np.zeros(0)
        z = np.array([1.0, max(m, default=0.0), math.log1p(sum(v for v in m if v >= 0.5))]) @ model.curve
        return 1 / (1 + math.exp(-min(max(z, -30), 30)))

    out = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        assert out[i]["score"] == pytest.approx(plain(text), abs=1e-9), i
        assert out[i]["predicted"] == (out[i]["score"] >= 0.5)
    assert out[1004]["predicted"] == out[1003]["predicted"] == 1 and out[1000]["predicted"] == out[1001]["predicted"] == 0


def test_labels_that_disagree(spark):
    """An id, or a text, with both labels counts as toxic, whatever the order of rows."""
    rows = [(i, f"fine words number{i} and {'horrid' if i % 3 == 0 else 'pleasant'} ends") for i in range(200)]
    labels = [(i, int(i % 3 == 0)) for i in range(200)]
    more = rows + [(1000 + i, t) for i, t in rows[:60]]
    twice = labels + [(i, 0) for i in range(0, 60, 3)] + [(1000 + i, 0) for i in range(60)]
    models = []
    for n, r in ((1, more), (5, more[::-1])):
        docs = spark.createDataFrame(r, "doc_id long, text string").repartition(n)
        models.append(toxicity.fit(docs, spark.createDataFrame(twice[::-1] if n > 1 else twice, "doc_id long, toxic int").repartition(n)))
    plain = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    for m in models:
        assert np.array_equal(m.weights, plain.weights) and np.array_equal(m.curve, plain.curve)


def test_language_row_by_row(spark):
    """Predictions and scores from plain counts of n-grams, their TF-IDF and a softmax."""
    rng = random.Random(3)
    rows = [(i, words(rng, 20, 9) + (" zu und" if i % 2 else " the of"), ("de", "en")[1 - i % 2]) for i in range(120)] + [(900, "Ünd, ZU; 12\nthe", None), (901, "x", None), (902, "zu " * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)

    def plain(text):
        letters = [ord(c.lower()) if c.isalpha() else 0 for c in text]
        count = Counter()
        for width in (1, 2, 3):
            for i in range(len(letters) - width + 1):
                value = letters[i] + (1 << 40) if width == 1 else width << 40
                for x in letters[i : i + width] if width > 1 else ():
                    value = (value * 0x100000001B3 + x) % (1 << 64)
                count[int(T.mix(np.array([value], np.uint64))[0]) % langid.DIMENSIONS] += 1
        x = {f: math.log1p(n) * model.idf[f] for f, n in count.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        logits = [sum(v / norm * model.weights[f, k] for f, v in x.items()) + model.bias[k] for k in range(len(model.languages))]
        e = [math.exp((v - max(logits)) / model.temperature) for v in logits]
        best = max(range(len(e)), key=lambda k: e[k])
        return model.languages[best], e[best] / sum(e)

    for r in langid.identify(docs, model).collect():
        lang, score = plain(next(t for i, t, _ in rows if i == r["doc_id"]))
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-9)


def test_copies_and_rare_languages_in_the_sample(spark):
    """Copies of one text take one place, and every labelled language is learned."""
    rng = random.Random(6)
    rows = [(words(rng, 12) + " the of", "en") for _ in range(700)] + [("one text copied over", "en")] * 3000 + [(words(rng, 12) + " ß zu", "de") for _ in range(3)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), sample_rows=60)
    assert model.languages == ["de", "en"]
