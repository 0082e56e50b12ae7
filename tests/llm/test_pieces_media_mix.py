"""Round trips of pieces and media, and the laws of shards and mixes."""

import re

import numpy as np
import pytest

from growthlens.llm import media, mixing, pieces, sharding
from tests.llm.conftest import words

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = ["", "a", " ", "Hé llo  w▁orld 你😀\x07 x", "  \n\t b", "a\x00b", "ſtraße " * 50, "́combining"]


def test_spans_match_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    coder = pieces.Encoder(open(path, "rb").read())
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for t in TEXTS[1:]:
        s, e = coder.spans(t.encode(), np.array(library.encode(t)))
        assert [(p.begin, p.end) for p in library.encode(t, return_type="proto").pieces] == list(zip(s.tolist(), e.tolist(), strict=True))


def test_encode_matches_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {r["doc_id"]: r for r in pieces.encode(spark.createDataFrame(list(enumerate([*TEXTS, None])), "doc_id long, text string"), path).collect()}
    for i, t in enumerate([*TEXTS, ""]):
        assert out[i]["ids"] == library.encode(t) and out[i]["decoded"] == library.decode(library.encode(t))


class _Spec:
    add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces = True, True, True

    def __init__(self, blob):
        self.precompiled_charsmap = blob


def _double_array(rules):
    """A double array over rules, built by trial as its reader walks it."""
    strings, place = b"", {}
    for k, v in rules.items():
        place[k] = len(strings)
        strings += v + b"\0"
    units = {0: 0}
    trie = {}
    for k in rules:
        node = trie
        for b in k:
            node = node.setdefault(b, {})
        node[None] = place[k]
    queue, used = [(trie, 0)], {0}
    while queue:
        node, at = queue.pop(0)
        labels = [b for b in node if b is not None]
        offset = 1
        while any((at ^ offset ^ b) in used for b in [*labels, *([0] if None in node else [])]):
            offset += 1
        units[at] = units.get(at, 0) | offset << 10 | (256 if None in node else 0)
        if None in node:
            used.add(at ^ offset)
            units[at ^ offset] = node[None] | 1 << 31
        for b in labels:
            used.add(at ^ offset ^ b)
            units[at ^ offset ^ b] = b
            queue.append((node[b], at ^ offset ^ b))
    array = np.zeros(max(units) + 300, np.uint32)
    for k, v in units.items():
        array[k] = v
    raw = array.tobytes()
    return len(raw).to_bytes(4, "little") + raw + strings


def test_character_map():
    rules = {"ﬁ".encode(): b"fi", "Ａ".encode(): b"A", "é".encode(): "é".encode(), b"e": b"E"}
    normalize = pieces.Normalizer(_Spec(_double_array(rules)))
    data = "  ﬁ é  eＡ ".encode()
    out, start, end = normalize(data)
    assert out.decode() == "▁fi▁é▁EA"
    spans = [(s, e) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
    at = data.index("ﬁ".encode())
    assert spans[3] == spans[4] == (at, at + 3)  # both letters stand for the ligature
    assert data[slice(*spans[8])] == "é".encode() and data[slice(*spans[-1])] == "Ａ".encode()


@pytest.mark.parametrize("rules", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_normalisation_matches_the_library(rules):
    """Texts and places of their source, by the compiled character maps that come with the library."""
    import random

    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    library = sentencepiece.SentencePieceNormalizer(rule_name=rules)
    spec = sentencepiece_model_pb2.ModelProto.FromString(library.serialized_model_proto()).normalizer_spec
    normalize = pieces.Normalizer(spec)
    rng = random.Random(5)
    pool = ["a", "B", " ", "  ", "\t", "\u3000", "ＡＢ", "ﬁ", "①", "é", "e\u0301", "한", "ㅎㅏ", "ｶﾞ", "①", "½", "™", "\u200b", "\x01", "ß", "İ", "😀", "…", "ſ", "㌔", "ﷺ", "▁", "\u0345", "Å", "\ufeff"]
    for _ in range(1500):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))
        want, places = library.Normalize(text, with_offsets=True)
        out, start, _ = normalize(text.encode())
        assert out.decode() == want, repr(text)
        data = text.encode()
        lead = [k for k, b in enumerate(out) if b & 0xC0 != 0x80]
        assert [len(data[: start[k]].decode()) for k in lead] == places[: len(lead)], repr(text)


def test_png_round_trip():
    for raw in (b"", b"x", bytes(range(256)) * 3, b"a" * 192):
        payload = media.pad(raw)
        assert len(payload) % 192 == 0 and payload and media.samples(media.png(payload)) == payload
    broken = bytearray(media.png(media.pad(b"abc")))
    broken[45] ^= 1
    with pytest.raises(ValueError):
        media.samples(bytes(broken))


def test_interleaving(spark):
    pages = [
        (1, '<p>one &amp; <b>two</b></p><script>no</script><figure><img src="digest:AA" alt="x"><figcaption>said <i>so</i></figcaption></figure>after<img src="http://h/i.png">'),
        (2, None), (3, ""), (4, "<p>unclosed <img src='digest:zz'>"),
    ]
    payload = media.pad(b"hello")
    import hashlib

    digest = hashlib.sha256(payload).hexdigest()
    pages[0] = (1, pages[0][1].replace("AA", digest))
    store = spark.createDataFrame([(digest, bytearray(media.png(payload)))] * 2, "digest string, media binary")
    out = {r["page_id"]: r["items"] for r in media.interleave(spark.createDataFrame(pages, "page_id long, html string"), store).collect()}
    assert [(i["kind"], i["text"], i["payload_bytes"]) for i in out[1]] == [("text", "one & two", None), ("image", "said so", 192), ("text", "after", None), ("image", None, None)]
    assert [i["position"] for i in out[1]] == [0, 1, 2, 3]
    assert out[2] == [] and out[3] == []
    assert [(i["kind"], i["digest"], i["payload_bytes"]) for i in out[4]] == [("text", None, None), ("image", "zz", None)]


@pytest.mark.parametrize(
    "page,items",
    [
        ("<html><head><title>x</title><body><p>hi</p><img src=a>", [("hi", None), (None, "a")]),
        ("<head><title>t</title><meta charset=u><p>one<p>two", [("one", None), ("two", None)]),
        ("<head>plain<p>more", [("plain", None), ("more", None)]),
        ("<div><noscript>on<img src=q></div>shown", [("shown", None)]),
        ("<figure><img src=a><figcaption>said<h2>Title</h2>rest", [("said", "a"), ("Title", None), ("rest", None)]),
        ("<figure><img src=a><figcaption>said</figure><p>rest", [("said", "a"), ("rest", None)]),
        ("<figure><img src=a alt=x></figure><figcaption>late</figcaption>", [("x", "a"), ("late", None)]),
        ("<figure><figcaption>first</figcaption><img src=b></figure>z", [("first", "b"), ("z", None)]),
        ("<figure><figcaption>alone</figcaption></figure>z", [("alone", None), ("z", None)]),
        ("<figure><img src=a><figure><img src=b><figcaption>in</figcaption></figure>", [(None, "a"), ("in", "b")]),
        ("</head></p></figure>a<br/>b<script>no", [("a", None), ("b", None)]),
    ],
)
def test_pages_that_lack_end_tags(page, items):
    got = media._Interleaved().read(page)
    assert [(i["text"], i["ref"]) for i in got] == items and [i["position"] for i in got] == list(range(len(items)))


def test_hilbert_curve_is_one_path(spark):
    from pyspark.sql import functions as F

    cells = spark.range(512).select((F.col("id") % 8).cast("int").alias("a"), (F.floor(F.col("id") / 8) % 8).cast("int").alias("b"), F.floor(F.col("id") / 64).cast("int").alias("c"))
    rows = sorted(cells.withColumn("h", sharding.hilbert_index([F.col("a"), F.col("b"), F.col("c")], 3)).collect(), key=lambda r: r["h"])
    assert [r["h"] for r in rows] == list(range(512))
    assert all(abs(x["a"] - y["a"]) + abs(x["b"] - y["b"]) + abs(x["c"] - y["c"]) == 1 for x, y in zip(rows[:-1], rows[1:], strict=True))


def test_written_shards_prune(spark, tmp_path):
    rows = [(i, "w " * (i % 40), f"l{i % 4}", f"s{i % 6}", i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long")
    stats = sharding.write(docs, str(tmp_path / "out"), shards=8).collect()
    assert sum(r["hilbert_rows"] for r in stats) == 400 and len(stats) == 8
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in back.select(*docs.columns).collect()) == sorted(rows)


def test_places_row_by_row(spark):
    """Every shard and slot from a plain sort by curve, part, checksum and id; the classes follow the order of their values."""
    import zlib
    from collections import Counter, defaultdict

    import xxhash

    rows = [(i, None if i % 17 == 0 else "w " * (i * i % 90), None if i % 23 == 0 else f"l{i % 5}", f"s{i % 70:02d}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    size = {i: len((t or "").encode()) + 16 for i, t, _, _ in rows}
    crc = {i: zlib.crc32((t or "").encode()) for i, t, _, _ in rows}

    fine = {i: int(np.floor(16 * np.log2(s / 16))) for i, s in size.items()}

    def classes(values, most):
        n = Counter(values)
        top, before, out = sorted(sorted(n, key=lambda v: (-n[v], v is not None, v))[:most], key=lambda v: (v is not None, v)), 0, []
        for v in top:
            out.append((v, before * 32 // sum(n[w] for w in top)))
            before += n[v]
        return lambda x: max((c for v, c in out if None not in (v, x) and v <= x), default=0)

    lang_class, source_class, grade = classes([r[2] for r in rows], 32), classes([r[3] for r in rows], 32), classes(fine.values(), 10**6)
    cell = {i: (lang_class(lang), source_class(s), grade(fine[i])) for i, _, lang, s in rows}
    cells = spark.createDataFrame(sorted(set(cell.values())), "a int, b int, c int")
    curve = {(r["a"], r["b"], r["c"]): r["h"] for r in cells.withColumn("h", sharding.hilbert_index([cells.a, cells.b, cells.c], 5)).collect()}
    # Spark's xxhash64 of a long is that of its eight bytes with seed 42.
    signed = {i: (h if (h := xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42)) < 1 << 63 else h - (1 << 64)) % 16 for i in size}
    part = {i: (crc[i] >> 24) * 16 + signed[i] for i in size}
    order = sorted(size, key=lambda i: (curve[cell[i]], part[i], crc[i], i))
    want, shards = {}, defaultdict(int)
    for place, i in enumerate(order):
        k = place * 7 // len(order)
        want[i] = (k, shards[k], curve[cell[i]])
        shards[k] += 1
    got = {r["doc_id"]: (r["shard"], r["slot"], r["curve"]) for r in sharding.assign(docs, shards=7).collect()}
    assert got == want


def test_files_are_skipped(spark, tmp_path):
    """Shares of the files that a reader needs not open, by their ranges."""
    rows = [(i, "w " * (i * 7919 % 400), f"l{i % 4}", f"s{i * 31 % 20:02d}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stats = sharding.write(docs.selectExpr("*", "length(text) as chars"), str(tmp_path / "out"), shards=40).collect()
    skip = {c: np.mean([[not (r[f"min_{c}"] <= v <= r[f"max_{c}"]) for r in stats] for v in values]) for c, values in (("lang", ["l0", "l1", "l2", "l3"]), ("source", [f"s{i:02d}" for i in range(20)]), ("chars", range(0, 800, 40)))}
    assert skip["lang"] > 0.4 and skip["source"] > 0.5 and skip["chars"] > 0.4, skip


def plain_targets(sizes):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total >= 2 * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
            open_.discard(s)
        left -= sum(2 * sizes[s] for s in full)
    return out


def test_mix(spark):
    import random

    rng = random.Random(9)
    rows = [(i, words(rng, rng.randrange(0, 60)), rng.choice(["a", "b", "b", "c", "d", "d", "d", None, "é", "zzz"])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.mix(docs).collect()
    size = {i: len(re.findall(mixing.WORD, t)) for i, t, _ in rows}
    by = {}
    for i, _, s in rows:
        by.setdefault(s, []).append(size[i])
    want = plain_targets({s: sum(v) for s, v in by.items()})
    taken = {}
    for r in out:
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 2 * r["size"] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, v in taken.items():
        assert abs(v - want[s]) <= max(by[s])  # within one document
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(2)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in out}


def test_rounding_keeps_expectations(spark):
    """Over many disjoint sources, documents get copies as often as their fraction says."""
    rows = [(i, "w " * (1 + i % 7), f"s{i // 30:03d}") for i in range(9000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    error, n = 0.0, 0
    for r in out:
        p = r["target"] / r["source_size"]
        if p % 1:
            error += r["copies"] - p
            n += 1
    assert n > 1000 and abs(error / n) < 0.03
