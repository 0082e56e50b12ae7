"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are runs of letters (ASCII letters in lower case, and every byte of other
scripts). Labels come by document, so tokens are labelled first: a greedy cover picks
the word or word-beginning that explains most toxic documents not yet explained and
occurs in next to no clean one, until few are left; tokens with a picked feature are
toxic in toxic documents, and all others are not. The field has weights for the
word and its beginnings, for the first state and for state changes, fitted by adaptive
gradient steps on the exact likelihood. Forward-backward marginals then give
spans (runs of tokens of marginal 0.5 or more, in byte offsets) and, through a logistic
curve over the largest marginal and the toxic mass, a score.

The fit sees a bounded sample: SAMPLE_TOXIC and SAMPLE_CLEAN rows of texts of at most
SAMPLE_TEXT bytes. It runs in one task, so the driver holds the model and no texts. Scoring sees every whole text. Null and empty texts have no tokens
and get the score of a document without toxic mass. Without a label of each kind the
score is 0 for every row. Equal texts get equal scores.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.llm import textops as T
from growthlens.llm.tables import give_back, small_batches

DIMENSIONS = 1 << 18
#: Documented bounds of the labelled sample.
SAMPLE_TOXIC = 1500
SAMPLE_CLEAN = 3000
SAMPLE_TEXT = 1 << 16
#: Lengths, in code points, of the word-beginnings that are features beside the word.
BEGINNINGS = (3, 4, 5)
#: Fewest distinct texts that a picked feature must explain, and most clean share of its texts.
LEAST_COVER = 3
MOST_CLEAN = 0.02
#: A document is explained by so many features if there are as many; past the first, only by those in a share OFTEN of toxic ones.
COVERS = 3
OFTEN = 0.02
LANE = 256

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and features (a column a kind) of each token, and tokens of each document."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros((0, 1 + len(BEGINNINGS)), np.int64), np.zeros(len(offsets) - 1, np.int64)
    data = T.LOWER[data]
    inside = _LETTER[data]
    spaced = np.where(inside, data, 32).astype(np.uint8)
    start, end, count = T.words(spaced, offsets)
    prefix = T.prefix_hash(data)
    leads = np.flatnonzero((data & 0xC0) != 0x80)
    rank = np.searchsorted(leads, start)
    leads = np.append(leads, np.full(max(BEGINNINGS) + 1, len(data)))
    out = [T.span_hash(prefix, start, end)]
    for n in BEGINNINGS:
        stop = np.minimum(leads[rank + n], end)
        out.append(T.span_hash(prefix, start, stop) ^ np.uint64(n << 56))
    return start, end, np.stack([(T.mix(x) & np.uint64(DIMENSIONS - 1)).astype(np.int64) for x in out], 1), count


def _lanes(x: np.ndarray, fill: float) -> np.ndarray:
    lanes = -(-len(x) // LANE)
    out = np.full(lanes * LANE, fill)
    out[: len(x)] = x
    return np.ascontiguousarray(out.reshape(lanes, LANE).T)


def forward_backward(emission: np.ndarray, first: np.ndarray, change: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward and backward vectors (n, 2) of chains laid end to end.

    `emission` is the log weight of state 1 over state 0, `first` marks where a chain
    starts, `change` and `begin` are weights of state changes and first states. The
    sequence is cut into lanes that are multiplied up side by side, joined one after
    the other, and then run through side by side: the same result as token by token.
    """
    n = len(emission)
    if not n:
        return np.zeros((0, 2)), np.zeros((0, 2))
    weight = _lanes(np.exp(np.clip(emission, -30, 30)), 1.0)
    fresh = _lanes(first, 1.0) > 0  # what fills up the last lane is no part of the last chain
    step = np.empty((2, 2, *weight.shape))
    for i in (0, 1):
        for j in (0, 1):
            step[i, j] = np.where(fresh, begin[j], change[i, j])
        step[i, 1] *= weight
    lanes = weight.shape[1]
    product = np.broadcast_to(np.eye(2)[:, :, None], (2, 2, lanes)).copy()
    for t in range(LANE):
        a = step[:, :, t]
        product = np.stack([np.stack([product[i, 0] * a[0, j] + product[i, 1] * a[1, j] for j in (0, 1)]) for i in (0, 1)])
        product /= product.max((0, 1))
    into, back = np.empty((2, lanes)), np.empty((2, lanes))
    x0, x1 = 0.5, 0.5
    y0, y1 = 0.5, 0.5
    p = product.transpose(2, 0, 1).tolist()
    for k in range(lanes):
        into[0, k], into[1, k] = x0, x1
        (a, b), (c, d) = p[k]
        x0, x1 = x0 * a + x1 * c, x0 * b + x1 * d
        x0, x1 = x0 / (x0 + x1), x1 / (x0 + x1)
    for k in range(lanes - 1, -1, -1):
        back[0, k], back[1, k] = y0, y1
        (a, b), (c, d) = p[k]
        y0, y1 = a * y0 + b * y1, c * y0 + d * y1
        y0, y1 = y0 / (y0 + y1), y1 / (y0 + y1)
    alpha, beta = np.empty((2, LANE, lanes)), np.empty((2, LANE, lanes))
    x0, x1 = into
    for t in range(LANE):
        a = step[:, :, t]
        x0, x1 = x0 * a[0, 0] + x1 * a[1, 0], x0 * a[0, 1] + x1 * a[1, 1]
        total = x0 + x1
        x0, x1 = x0 / total, x1 / total
        alpha[0, t], alpha[1, t] = x0, x1
    y0, y1 = back
    for t in range(LANE - 1, -1, -1):
        beta[0, t], beta[1, t] = y0, y1
        a = step[:, :, t]
        y0, y1 = a[0, 0] * y0 + a[0, 1] * y1, a[1, 0] * y0 + a[1, 1] * y1
        total = y0 + y1
        y0, y1 = y0 / total, y1 / total
    return tuple(x.transpose(2, 1, 0).reshape(-1, 2)[:n] for x in (alpha, beta))


def marginals(alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    both = alpha * beta
    return both[:, 1] / both.sum(1)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    change: np.ndarray
    begin: np.ndarray
    curve: np.ndarray


def cover(features: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Features that explain the toxic documents, by greedy choice."""
    doc = np.repeat(np.arange(len(features), dtype=np.int32), [len(f) for f in features])
    flat = np.concatenate(features) if features else np.zeros(0, np.int64)
    n0 = np.bincount(flat[~toxic[doc]], minlength=DIMENSIONS)
    n1 = np.bincount(flat[toxic[doc]], minlength=DIMENSIONS)
    share = max(1, (~toxic).sum()) / max(1, toxic.sum())
    fine = n0 <= MOST_CLEAN * n1 * share
    use = toxic[doc] & fine[flat]
    doc, flat = doc[use], flat[use]
    picked, need = [], np.where(toxic, COVERS, 0)
    often = max(LEAST_COVER, OFTEN * toxic.sum())
    while True:
        bare = np.bincount(flat[need[doc] == COVERS], minlength=DIMENSIONS)
        more = np.bincount(flat[need[doc] > 0], minlength=DIMENSIONS)
        gain = np.where((bare >= LEAST_COVER) | (more >= often), more - 10 * n0, 0)
        gain[picked] = 0
        best = int(gain.argmax())
        if gain[best] <= 0:
            return np.array(picked, np.int64)
        picked.append(best)
        hit = np.unique(doc[flat == best])
        need[hit] = np.maximum(need[hit] - 1, 0)


def train(docs: list[np.ndarray], toxic: np.ndarray, epochs: int = 12, rate: float = 0.5, l2: float = 1e-5) -> Model:
    """`docs`: token features (n, kinds) of each document."""
    counts = np.array([len(d) for d in docs], np.int64)
    picked = np.zeros(DIMENSIONS, bool)
    picked[cover([np.unique(d) for d in docs], toxic)] = True
    rng = np.random.Generator(np.random.PCG64(11))
    weights, bias = np.zeros(DIMENSIONS), -2.0
    log_change, log_begin = np.log(np.array([[0.9, 0.1], [0.5, 0.5]])), np.log(np.array([0.9, 0.1]))
    squares, square_b, square_c = np.full(DIMENSIONS, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // 150)):
            x = np.concatenate([docs[i] for i in part]) if len(part) else np.zeros((0, 1), np.int64)
            if not len(x):
                continue
            of = np.repeat(part, counts[part])
            y = (picked[x].any(1) & toxic[of]).astype(float)
            first = np.concatenate([[True], of[1:] != of[:-1]])
            change = np.exp(log_change)
            begin = np.exp(log_begin)
            e = weights[x].sum(1) + bias
            alpha, beta = forward_backward(e, first, change, begin)
            m = marginals(alpha, beta)
            g = np.bincount(x.ravel(), np.repeat(m - y, x.shape[1]), DIMENSIONS) / len(part) + l2 * weights
            squares += g * g
            weights -= rate * g / np.sqrt(squares)
            gb = (m - y).sum() / len(part)
            square_b += gb * gb
            bias -= rate * gb / np.sqrt(square_b)
            inner = np.flatnonzero(~first)
            ex = np.exp(np.clip(e[inner], -30, 30))
            pair = alpha[inner - 1][:, :, None] * change[None] * beta[inner][:, None, :] * np.stack([np.ones_like(ex), ex], 1)[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
            gc = (pair.sum(0) - seen) / len(part)
            square_c += gc * gc
            log_change = np.clip(log_change - rate * gc / np.sqrt(square_c), -6, 6)
    model = Model(weights, bias, np.exp(log_change), np.exp(log_begin), np.zeros(3))
    figures = np.concatenate([document_figures(model, docs[i : i + 200])[0] for i in range(0, len(docs), 200)])
    curve = np.zeros(3)
    x = np.column_stack([np.ones(len(figures)), figures])
    for _ in range(60):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        curve -= np.clip(np.linalg.solve(h, x.T @ (p - toxic) + 1e-2 * curve), -4, 4)
    model.curve = curve
    return model


def document_figures(model: Model, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each document the largest marginal and the log of its toxic mass; and all marginals."""
    counts = np.array([len(d) for d in docs], np.int64)
    x = np.concatenate(docs) if len(docs) else np.zeros((0, 1), np.int64)
    return _figures(model, x, counts)


def _figures(model: Model, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.zeros(len(x), bool)
    lead = np.cumsum(counts) - counts
    first[lead[counts > 0]] = True
    e = np.full(len(x), model.bias)
    for k in range(x.shape[1]):
        e += model.weights[x[:, k]]
    m = marginals(*forward_backward(e, first, model.change, model.begin))
    out = np.zeros((len(counts), 2))
    has = counts > 0
    if has.any():
        out[has, 0] = np.maximum.reduceat(m, lead[has])
        out[has, 1] = np.log1p(np.add.reduceat(np.where(m >= 0.5, m, 0.0), lead[has]))
    return out, m


@T.tidy
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in T.slices(batch):
            part = batch.slice(a, b - a)
            _, _, x, count = tokens(*T.flat(part.column("text")))
            rows = [r.astype(np.int32).tobytes() for r in np.split(x, np.cumsum(count)[:-1])]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(rows, pa.binary())], names=["toxic", "x"])


@T.tidy
def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows; nothing without both kinds. The order of the rows does not matter."""
    got = sorted(pair for batch in batches for pair in zip(batch.column("toxic").to_pylist(), batch.column("x").to_pylist(), strict=True))
    toxic = np.array([kind == 1 for kind, _ in got], bool)
    if toxic.any() and not toxic.all():
        model = train([np.frombuffer(x, np.int32).reshape(-1, 1 + len(BEGINNINGS)) for _, x in got], toxic)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


@T.tidy
def _score(batches: Iterator[pa.RecordBatch], model: Model | None, keep: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in T.slices(batch):
            part = batch.slice(a, b - a)
            n = b - a
            score, spans = np.zeros(n), [[] for _ in range(n)]
            if model is not None:
                data, offsets = T.flat(part.column("text"))
                start, end, x, count = tokens(data, offsets)
                figures, m = _figures(model, x, count)
                z = np.column_stack([np.ones(n), figures]) @ model.curve
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                hot = np.flatnonzero(m >= 0.5)
                of = np.repeat(np.arange(n), count)[hot]
                for t, d in zip(hot.tolist(), of.tolist(), strict=True):
                    lo, hi = int(start[t] - offsets[d]), int(end[t] - offsets[d])
                    if spans[d] and spans[d][-1]["token"] == t - 1:
                        spans[d][-1] |= {"end": hi, "token": t}
                    else:
                        spans[d].append({"start": lo, "end": hi, "token": t})
            found = [[{"start": s["start"], "end": s["end"]} for s in x] for x in spans]
            kept = [part.column(f"keep_{c}") for c in keep]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(found, _SPANS), *kept], names=["id", "score", "predicted", "spans", *(f"keep_{c}" for c in keep)])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN, sample_text: int = SAMPLE_TEXT) -> Model | None:
    """A model of the rows of `labels`; None without both kinds. An id, or a text, that has both labels counts as toxic."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    picks = [known.where(F.col("toxic") == kind).orderBy(F.xxhash64("id"), "id").limit(n) for kind, n in ((1, sample_toxic), (0, sample_clean))]
    sample = picks[0].unionByName(picks[1])  # bounded by its limits, so it may be broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= sample_text)
    rows = texts.join(F.broadcast(sample), "id").groupBy("text").agg(F.max("toxic").alias("toxic")).select("toxic", "text")
    found = rows.mapInArrow(_features, "toxic int, x binary").repartition(1).mapInArrow(_trained, "model binary").collect()
    give_back(docs.sparkSession)
    return pickle.loads(found[0]["model"]) if found else None


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns id, score, predicted, spans and keep_<column> for each row of `docs` and column of `keep`."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "id long, score double, predicted int, spans array<struct<start: long, end: long>>" + "".join(f", keep_{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(lambda it: _score(it, shared.value, keep), schema).withColumnRenamed("id", id_col)


def reject(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are not predicted toxic, in their own columns."""
    scored = score(docs, model, id_col, text_col, keep=tuple(docs.columns))
    return scored.where("predicted = 0").select(*(F.col(f"keep_{c}").alias(c) for c in docs.columns))
