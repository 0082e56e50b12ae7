"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Characters are lower-cased; what isn't a letter counts as one blank. N-grams of one
to three characters are hashed to DIMENSIONS features with log-damped counts, weighted
by inverse document frequency over all labelled rows and scaled to unit length. The
weights are trained by follow-the-regularised-leader with elastic-net penalties (the
first makes them sparse), on a bounded sample of labelled rows, and a temperature
fitted on a part of that sample kept out of training calibrates the scores.

Null texts, texts without a letter, and all texts if no row is labelled give `und`
with score 0. Equal texts get equal results; ties go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.llm import textops as T
from growthlens.llm.tables import materialize, small_batches

DIMENSIONS = 1 << 14
#: Documented bound on the labelled rows that the weights are fitted on, and on the bytes of their texts.
SAMPLE_ROWS = 4000
#: Rows of a language that the sample has at least, where there are as many.
LEAST_ROWS = 50
SAMPLE_BYTES = 32 << 20
EPOCHS = 4
UNKNOWN = "und"
#: Documents whose counts are held side by side.
_BLOCK = 64


def _folded() -> np.ndarray:
    """Letter of each code point in lower case, 0 for what isn't a letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x30000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_FOLD: list[np.ndarray] = []


def ngram_counts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of documents: document numbers, features and counts in order, and which documents have a letter."""
    if not _FOLD:
        _FOLD.append(_folded())
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    letters = _FOLD[0][points].astype(np.uint64)
    n = len(letters)
    mask = np.uint64(DIMENSIONS - 1)
    grams = [T.mix(letters + np.uint64(1 << 40))]
    for width in (2, 3):
        value = np.full(max(0, n - width + 1), np.uint64(width << 40))
        for i in range(width):
            value = value * np.uint64(0x100000001B3) + letters[i : n - width + 1 + i]
        grams.append(T.mix(value))
    features = [(g & mask).astype(np.int64) for g in grams]
    owner = np.repeat(np.arange(len(place) - 1), np.diff(place))
    letter_sum = np.concatenate([[0], np.cumsum(letters > 0)])
    for lo in range(0, len(offsets) - 1, _BLOCK):
        hi = min(lo + _BLOCK, len(offsets) - 1)
        flat = np.zeros((hi - lo) * DIMENSIONS, np.int64)
        for width, feature in enumerate(features, 1):
            a, b = int(place[lo]), int(min(place[hi], len(feature)))
            if a >= b:
                continue
            key = (owner[a:b] - lo) * DIMENSIONS + feature[a:b]
            if width > 1:  # an n-gram ends in the document that it starts in
                key = key[owner[a:b] == owner[a + width - 1 : b + width - 1]]
            flat += np.bincount(key, minlength=len(flat))
        at = np.flatnonzero(flat)
        yield lo + at // DIMENSIONS, at % DIMENSIONS, flat[at], letter_sum[place[lo + 1 : hi + 1]] > letter_sum[place[lo:hi]]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def _weighed(doc: np.ndarray, feature: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """TF-IDF of each entry, of unit length in each document."""
    x = np.log1p(count) * idf[feature]
    norm = np.sqrt(np.bincount(doc, x * x, n))
    return x / np.maximum(norm, 1e-12)[doc]


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, languages: list[str], idf: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = EPOCHS) -> Model:
    """FTRL-proximal over rows of (features, counts); every fifth row is left for the temperature."""
    k = len(languages)
    z, n = np.zeros((DIMENSIONS + 1, k)), np.zeros((DIMENSIONS + 1, k))
    inputs = []
    for feature, count in rows:
        x = _weighed(np.zeros(len(feature), np.int64), feature, count, idf, 1)
        inputs.append((np.append(feature, DIMENSIONS), np.append(x, 1.0)))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        z_at = z[at]
        return np.where(np.abs(z_at) <= l1, 0.0, -(z_at - np.sign(z_at) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.Generator(np.random.PCG64(7))
    fit = np.array([i for i in range(len(rows)) if i % 5], np.int64) if len(rows) >= 10 else np.arange(len(rows))
    for _ in range(epochs):
        for i in order.permutation(fit):
            at, x = inputs[i]
            w = weights(at)
            p = _softmax((x @ w)[None])[0]
            p[target[i]] -= 1.0
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(slice(None))
    check = [i for i in range(len(rows)) if i % 5 == 0]
    logits = np.stack([inputs[i][1] @ w[inputs[i][0]] for i in check]) if check else np.zeros((0, k))
    return Model(languages, idf, w[:-1], w[-1], _temperature(logits, target[check] if check else target[:0]))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature in [1/8, 8] with the least negative log-likelihood, by golden section."""
    if not len(logits):
        return 1.0

    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(p)), target], 1e-12)).mean())

    a, b, ratio = np.log(1 / 8), np.log(8), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


@T.tidy
def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of this task that have each feature; -1 counts the documents."""
    df, docs = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for a, b in T.slices(batch):
            docs += b - a
            for _, feature, _, _ in ngram_counts(*T.flat(batch.column("text").slice(a, b - a))):
                df += np.bincount(feature, minlength=DIMENSIONS)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], docs))], names=["feature", "n"])


@T.tidy
def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in T.slices(batch):
            part = batch.slice(a, b - a)
            features, counts, at = [], [], 0
            for doc, feature, count, has in ngram_counts(*T.flat(part.column("text"))):
                cut = np.searchsorted(doc, at + np.arange(1, len(has)))
                at += len(has)
                for f, c in zip(np.split(feature, cut), np.split(count, cut), strict=True):
                    features.append(f.astype(np.int16))
                    counts.append(np.minimum(c, 32767).astype(np.int16))
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(features, pa.list_(pa.int16())), pa.array(counts, pa.list_(pa.int16()))], names=["lang", "features", "counts"])


@T.tidy
def _predict(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in T.slices(batch):
            part = batch.slice(a, b - a)
            best, score = np.full(b - a, UNKNOWN, object), np.zeros(b - a)
            if model:
                at = 0
                for doc, feature, count, has in ngram_counts(*T.flat(part.column("text"))):
                    n = len(has)
                    x = _weighed(doc - at, feature, count, model.idf, n)
                    logits = np.stack([np.bincount(doc - at, x * model.weights[feature, k], n) for k in range(len(model.languages))], 1) + model.bias
                    p = _softmax(logits / model.temperature)
                    top = p.argmax(1)
                    best[at : at + n][has] = np.array(model.languages, object)[top[has]]
                    score[at : at + n][has] = p[np.arange(n), top][has]
                    at += n
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(best, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """A model of `labelled`; None if no row has a label and a text.

    Document frequencies are those of all rows. The weights see about `sample_rows`
    distinct rows, those of least hash in proportion, but LEAST_ROWS of each language
    where there are as many, and never more than twice `sample_rows`; their texts have at
    most `sample_bytes / sample_rows * 16` bytes each. Copies count once.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("lang"))
    df = {r["feature"]: r["n"] for r in rows.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    total = df.pop(-1, 0)
    if not total:
        return None
    counts = np.zeros(DIMENSIONS)
    counts[list(df)] = list(df.values())
    idf = np.log((1 + total) / (1 + counts)) + 1
    small = rows.where(F.octet_length("text") <= sample_bytes // sample_rows * 16).withColumn("o", F.xxhash64("text", "lang"))
    # A row a language, no more than there are labels.
    kinds = materialize(small.select("lang", "o").distinct().groupBy("lang").agg(F.count("*").alias("n")))
    distinct = kinds.agg(F.sum("n")).first()[0]
    if not distinct:
        return None
    share = kinds.select("lang", F.greatest(F.lit(sample_rows / distinct), LEAST_ROWS / F.col("n")).alias("share"))
    near = small.join(share, "lang").where(F.pmod("o", F.lit(1 << 53)) < F.col("share") * float(1 << 53)).groupBy("o").agg(F.first("lang").alias("lang"), F.first("text").alias("text"))
    sample = near.orderBy("o", "lang").limit(2 * sample_rows).select("lang", "text").mapInArrow(_sparse, "lang string, features array<smallint>, counts array<smallint>").collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r["lang"], r["features"], r["counts"]))
    languages = sorted({r["lang"] for r in sample})
    target = np.array([languages.index(r["lang"]) for r in sample])
    return train([(np.array(r["features"], np.int64), np.array(r["counts"], np.float64)) for r in sample], target, languages, idf)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, lang_pred, score for each row of `docs`."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(lambda it: _predict(it, model), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)
