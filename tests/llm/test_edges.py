"""Each operator on odd rows and on no rows: a defined result, and none lost."""

import hashlib
import re
import zlib

import pytest

from growthlens.llm import chat, langid, media, mixing, neardup, pieces, quality, sharding, suffixdedup, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _toxicity(docs):
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    return toxicity.score(docs, toxicity.fit(docs, labels))


RUNS = {
    "language": lambda d: langid.identify(d, langid.fit(d)),
    "shards": lambda d: sharding.assign(d),
    "media": lambda d: media.texts_as_media(d),
    "pieces": lambda d: pieces.encode(d, MODEL, digests=True),
    "toxicity": _toxicity,
    "toxicity without a model": lambda d: toxicity.score(d, None),
    "repeats": lambda d: suffixdedup.remove_repeats(d, length=40, gram=16),
    "mix": lambda d: mixing.mix(d),
    "quality": lambda d: quality.clean_lines(d),
    "near": lambda d: neardup.near_duplicates(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_every_row_once(name, odd, nothing):
    out = RUNS[name](odd)
    ids = sorted((r["doc_id"] for r in out.collect()), key=str)
    assert ids == sorted((r["doc_id"] for r in odd.select("doc_id").collect()), key=str)
    assert RUNS[name](nothing).count() == 0


def test_equal_texts_equal_values(odd):
    for name in ("language", "media", "pieces", "quality", "toxicity"):
        rows = {r["doc_id"]: r.asDict() for r in RUNS[name](odd).collect()}
        one, two = ({k: v for k, v in rows[i].items() if k != "doc_id"} for i in (1, 2))
        assert one == two, name


def test_language_of_texts_without_letters(odd):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in RUNS["language"](odd).collect()}
    for i in (3, 4, 5, 10):
        assert got[i] == ("und", 0.0)
    assert got[9][0] in ("en", "de", "fr", "ja")


def test_shards_are_even_and_gapless(odd):
    rows = sharding.assign(odd, shards=4).collect()
    counts = {k: sorted(r["slot"] for r in rows if r["shard"] == k) for k in range(4)}
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(v == list(range(len(v))) for v in counts.values())


def test_mix_of_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    texts = {(r["doc_id"], zlib.crc32((r["text"] or "").encode())): r["text"] or "" for r in odd.collect()}
    for r in rows:
        assert r["size"] == len(re.findall(mixing.WORD, texts[r["doc_id"], r["text_crc32"]]))
        assert 0 <= r["taken"] <= 2 * r["size"]


def test_media_reads_back(odd):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in odd.where("doc_id is not null").collect()}
    for r in media.texts_as_media(odd.where("doc_id is not null")).collect():
        padded = texts[r["doc_id"]] + b" " * (-len(texts[r["doc_id"]]) % 192 or (0 if texts[r["doc_id"]] else 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(texts[r["doc_id"]]), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, ids string, mask string"
    rows = [(1, 2, "assistant", "b: </turn> ### \\", "x", "y"), (1, 1, "user", None, "x", "y"), (1, 1, "user", None, "x", "y"), (None, None, None, None, None, None), (2, 0, "a: b\\### ", "", "x", "y"), (2, 1, "assistant", "é😀\n\n", "x", "y")]
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = {r["conv_id"]: r for r in chat.round_trip(spark.createDataFrame(rows, schema), vocabulary, public_tokenizers.PATTERN).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == digest("user\n\nuser\n\nassistant\nb: </turn> ### \\\n")
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (3, 16, digest("b: </turn> ### \\"))
    assert got[2]["turns_sha256"] == digest("a: b\\### \n\nassistant\né😀\n\n\n")
    assert got[None]["turns_sha256"] == digest("\n\n")
    long_ = "né </turn> ### \\ 😀\n" * 20_000
    one = chat.round_trip(spark.createDataFrame([(5, 0, "user", "q", "x", "y"), (5, 1, "assistant", long_, "x", "y")], schema), vocabulary, public_tokenizers.PATTERN).first()
    assert (one["loss_chars"], one["loss_sha256"], one["turns_sha256"]) == (len(long_), digest(long_), digest(f"user\nq\nassistant\n{long_}\n"))
    assert chat.round_trip(spark.createDataFrame([], schema), vocabulary, public_tokenizers.PATTERN).count() == 0


def test_mix_of_rows_that_repeat(spark):
    """However often a row repeats, its source ends near its target, and rows are emitted as often as they are taken."""
    text = "w " * 9
    rows = [(None, text, "a", 1)] * 3000 + [(None, text, "a", 2)] * 5 + [(7, "x y", "a", 3)] * 4 + [(8, "", "b", 4), (9, None, "b", 5), (10, "z z z", "b", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long").repartition(3)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    by = {s: (sum(r["taken"] for r in out if r["source"] == s), next(r["target"] for r in out if r["source"] == s)) for s in "ab"}
    assert all(abs(taken - target) <= 9 for taken, target in by.values())
    assert all(r["taken"] <= 2 * r["size"] for r in out)
    got = mixing.take(docs)
    assert got.columns == docs.columns
    kept = [tuple(r) for r in got.collect()]
    assert set(kept) <= set(rows) and sum(len((r[1] or "").split()) for r in kept if r[2] == "a") == by["a"][0]
    assert len(kept) == sum(r["copies"] for r in out)
    assert sorted(kept, key=str) == sorted((tuple(r) for r in mixing.take(docs.repartition(2)).collect()), key=str)
    assert mixing.take(docs.limit(0)).count() == 0


def test_mix_takes_odd_rows_whole(odd):
    kept = mixing.take(odd)
    assert kept.columns == odd.columns
    assert {str(r) for r in kept.collect()} <= {str(r) for r in odd.collect()}
    assert kept.count() == mixing.mix(odd).groupBy().sum("copies").first()[0]
