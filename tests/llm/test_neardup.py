"""Near-duplicate classes against all pairs."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from growthlens.llm import neardup, textops
from tests.llm.conftest import words


def shingle_set(text):
    w = [x for x in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(texts, percent):
    sets = {i: shingle_set(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block,seed", [(2048, 1), (3, 2)])
def test_classes(spark, monkeypatch, block, seed):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(seed)
    texts = []
    for _ in range(8):
        base = words(rng, rng.choice([3, 8, 60, 150])).split()
        for _ in range(rng.choice([1, 6, 25])):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(w) + ("\n" if rng.random() < 0.3 else ""))
    texts += [texts[0].upper(), "", None, "one two", "ONE two"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 85).collect()}
    assert got == brute(rows, 85)


def test_pigeonhole():
    """Signatures within the distance always share a key."""
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 1 << 16, (40, neardup.SYMBOLS)).astype(np.uint16)
    other = sig.copy()
    for row in other:
        at = rng.choice(neardup.SYMBOLS, neardup.MAX_DISTANCE, replace=False)
        row[at] ^= np.uint16(1)
    a, b = neardup.chunk_keys(sig), neardup.chunk_keys(other)
    assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


def test_shingles_of_slices():
    texts = ["A b c d e f", "", None, "x", "x", "a b c d e f a b c d e f", " q  r\ts\x0bt\nu "]
    sets, lead = textops.shingles(*textops.flat(pa.array(texts)))
    assert np.diff(lead).tolist() == [len(shingle_set((t or "").replace("\x0b", " "))) for t in texts]
    assert sets[lead[3] : lead[4]].tolist() == sets[lead[4] : lead[5]].tolist()
    assert set(sets[lead[0] : lead[1]].tolist()) <= set(sets[lead[5] : lead[6]].tolist())


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["u"]: r["v"] for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


def test_pairs_at_lower_similarity(spark):
    """A pair of similarity 0.80 is linked at 80 percent though its signatures differ in more symbols than are searched at 85."""
    texts = [f"a{i} b c d e f g h i j k l {end}{i}" for i in range(6000) for end in "xy"]
    sets, lead = textops.shingles(*textops.flat(pa.array(texts)))
    sig = neardup.signature(sets, lead)
    errors = (sig[::2] != sig[1::2]).sum(1)
    far = np.flatnonzero((errors > neardup.limits(85)[0]) & (errors <= neardup.limits(80)[0]))[:2].tolist()
    assert far
    for i in far:
        rows = [(0, texts[2 * i]), (1, texts[2 * i + 1])]
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()}
        assert got == brute(rows, 80) and got[1][1] == 0


def test_limits():
    assert neardup.limits(85) == (23, 12) and neardup.limits(80) == (27, 14)
    with pytest.raises(ValueError):
        neardup.limits(50)


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_share_of_pairs_beyond_the_distance(percent):
    """Pairs of just the similarity differ in more symbols than are searched no more often than the module says."""
    import math

    most, chunks = neardup.limits(percent)
    p = 1 - percent / 100
    beyond = sum(math.comb(neardup.SYMBOLS, k) * p**k * (1 - p) ** (neardup.SYMBOLS - k) for k in range(most + 1, neardup.SYMBOLS + 1))
    assert beyond <= neardup.MISSED and most < 2 * chunks  # the pigeonhole: some chunk has one error at most
    rng = random.Random(percent)
    texts = []
    for _ in range(120):  # twenty shingles' worth of words a part; the second text shares `percent` of the union
        both, own = 4 * percent, 4 * (100 - percent) // 2
        common = [f"w{rng.randrange(10**9)}" for _ in range(both + 4)]
        texts += [" ".join(common + [f"x{rng.randrange(10**9)}" for _ in range(own)]) for _ in (0, 1)]
    found = [b for b in neardup._profiles(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])]))]
    sig = np.concatenate([b.column("sig").flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(-1, neardup.SYMBOLS) for b in found])
    apart = (sig[::2] != sig[1::2]).sum(1)
    assert apart.max() <= most and abs(apart.mean() / neardup.SYMBOLS - p) < 0.02


def test_no_side_is_broadcast_by_an_estimate(spark, data, monkeypatch):
    """Representatives, keys and texts grow with the corpus, and their compressed files say little of their rows."""
    plans, written = [], neardup.materialize

    def watched(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return written(df)

    monkeypatch.setattr(neardup, "materialize", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    out = neardup.near_duplicates(spark.read.parquet(f"{data}/documents.parquet"))
    plans.append(out._jdf.queryExecution().sparkPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None
