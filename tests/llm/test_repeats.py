"""Suffix arrays and repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from growthlens.llm import suffixdedup as S


def brute(texts, length):
    seen = {}
    for t, x in enumerate(texts):
        for i in range(len(x) - length + 1):
            seen.setdefault(hash(x[i : i + length]), []).append((t, i))
    gone = [bytearray(len(x)) for x in texts]
    for places in seen.values():
        if len(places) > 1:
            for t, i in places:
                gone[t][i : i + length] = b"\1" * length
    return gone


@pytest.mark.parametrize("seed", range(12))
def test_shard_and_merge(seed):
    rng = random.Random(seed)
    length = rng.choice([9, 12, 16, 20, 33])
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(length, 60))) for _ in range(7)]
    shard = S.Shard(texts, length)
    order = sorted(range(len(shard.data)), key=lambda i: bytes(shard.data[i : i + shard.left[i]]))
    assert [bytes(shard.data[i : i + shard.left[i]]) for i in shard.order] == [bytes(shard.data[i : i + shard.left[i]]) for i in order]
    for a, b in zip(shard.order[:-1], shard.order[1:], strict=True):
        x, y = (bytes(shard.data[i : i + shard.left[i]]) for i in (a, b))
        if len(y) < length:
            continue
        assert shard.common[b] == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
    want = {i: set(np.flatnonzero(np.frombuffer(g, np.uint8))) for i, g in enumerate(brute(texts, length)) if any(g)}
    for limit in (10**6, 40):  # one shard, or many that are merged
        got = {}
        for _, i, s, e in S.repeats([texts], length, limit):
            got.setdefault(i, set()).update(range(s, e))
        assert got == want


@pytest.mark.parametrize("length,gram,many,limit,crowd", [(20, 8, 1, 200, 512), (20, 8, 256, 1 << 19, 512), (33, 16, 2, 500, 512), (20, 8, 1, 200, 2), (33, None, 1, 500, 1)])
def test_documents(spark, length, gram, many, limit, crowd):
    rng = random.Random(length + many)
    base = "".join(rng.choice("abcdefgh é") for _ in range(70))
    texts = []
    for _ in range(80):
        a, b = sorted((rng.randint(0, 70), rng.randint(0, 70)))
        texts.append("".join(rng.choice("ab ") for _ in range(rng.randint(0, 30))) + base[a:b] + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))))
    texts += ["", texts[3], texts[3], "a" * 50, None]
    rows = list(enumerate(texts)) + [(None, texts[5]), (7, texts[7])]
    out = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length, gram=gram, many=many, limit=limit, crowd=crowd).collect()
    raws = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), raw, gone in zip(rows, raws, brute(raws, length), strict=True):
        kept = bytes(a for a, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        want.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in out)


def test_whole_characters(spark):
    text = "é" * 30
    rows = [(1, "x" + text), (2, "yy" + text + "z")]
    out = {r["doc_id"]: r for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 21, gram=8, whole_characters=True, with_text=True, keep=("text",)).collect()}
    assert out[1]["kept_text"] == "x" and out[2]["kept_text"] == "yyz" and out[1]["keep_text"] == "x" + text
